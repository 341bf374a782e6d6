"""Forms of text under which words are looked up, and proper nouns in scripts without capitals."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf

# Proclitics, suffixes of persons and organisations, frequent words of languages.
ARABIC_CLITICS = ["ال", "و", "ف", "ب", "ك", "ل", "س"]
HEBREW_CLITICS = ["ה", "ו", "ב", "כ", "ל", "מ", "ש"]
HONORIFICS = ["さん", "様", "氏", "先生", "部長"]
ORGANISATIONS = ["株式会社", "会社", "銀行", "大学", "公司", "集团"]
COMMON_WORDS = {"en": ["the", "and", "of", "to", "in", "is", "that", "for"], "de": ["der", "die", "und", "das", "nicht", "ist", "von", "mit"], "fr": ["le", "la", "les", "et", "de", "des", "une", "que"], "es": ["el", "la", "los", "que", "y", "en", "una", "por"]}
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]"
MARKS = r"[\x{0591}-\x{05C7}\x{064B}-\x{065F}\x{0670}]"

# Signs of a model's size in its file's name.
SMALL_MODELS = ["0.5b", "0.8b", "0.9b", "1.0b", "1.1b"]
MEDIUM_MODELS = ["1.5b", "1.6b", "1.7b", "1.8b", "2b", "2.0b", "2.5b", "3b", "3.0b", "3.5b", "4b", "4.0b"]


def nfc(text: Column) -> Column:
    """Composed form; there is no built-in function for it."""

    @pandas_udf("string")
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return compose(text)


def lookup_form(text: Column) -> Column:
    """Trimmed, without invisible signs and vowel marks, in lower case. Compose with ``nfc`` where texts may be decomposed."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), INVISIBLE, ""), MARKS, ""))


def peeled(word: Column, clitics: list[str], most: int = 3) -> Column:
    """A word and what is left after taking up to ``most`` proclitics off its front; two letters stay."""
    pattern = "^(?:" + "|".join(clitics) + ")(?=..)"
    forms = [word]
    for _ in range(most):
        forms.append(F.regexp_replace(forms[-1], pattern, ""))
    return F.array_distinct(F.array(*forms))


def in_table(word: Column, table: list[str], clitics: list[str]) -> Column:
    return F.arrays_overlap(peeled(word, clitics), F.array(*map(F.lit, table)))


def cjk_nouns(text: Column) -> Column:
    """``(kind, content)``: runs of katakana, persons before a form of address, organisations by their suffix."""
    of = lambda kind, pattern, group: F.transform(F.regexp_extract_all(text, F.lit(pattern), group), lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("content")))
    return F.concat(of("term", r"[\x{30A1}-\x{30FF}]{2,}", 0), of("person", r"([\x{4E00}-\x{9FFF}]{1,4})(?:" + "|".join(HONORIFICS) + ")", 1), of("organisation", r"[\x{30A1}-\x{30FF}\x{4E00}-\x{9FFF}]+?(?:" + "|".join(ORGANISATIONS) + ")", 0))


def language_by_words(tokens: Column, least: int = 3) -> Column:
    """The language whose frequent words are most often among the tokens; null below ``least``, ties by name."""
    counts = [F.struct(F.size(_among(tokens, words)).alias("n"), F.lit(tag).alias("tag")) for tag, words in sorted(COMMON_WORDS.items(), reverse=True)]
    best = reduce(lambda a, b: F.when(b["n"] >= a["n"], b).otherwise(a), counts)
    return F.when(best["n"] >= least, best["tag"])


def _among(tokens: Column, words: list[str]) -> Column:
    return F.filter(tokens, lambda t: t.isin(words))


def model_class(path: Column) -> Column:
    """small, medium or large, by the file's name; large if it says nothing."""
    name = F.element_at(F.split(F.lower(path), "/"), -1)
    has = lambda signs: F.exists(F.array(*map(F.lit, signs)), lambda s: F.contains(name, s))
    return F.when(has(SMALL_MODELS), "small").when(has(MEDIUM_MODELS), "medium").otherwise("large")
