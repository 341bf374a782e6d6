"""Column functions on text: scripts, tokens, sentences, importance, references and query shapes.

All are built-in expressions, so that they stay inside generated code.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Code points of scripts that are written without spaces.
UNSEGMENTED = r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}\x{FF65}-\x{FF9F}\x{2E80}-\x{2EFF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EE5F}\x{30000}-\x{33479}\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{19E0}-\x{19FF}\x{A9E0}-\x{A9FF}\x{AA60}-\x{AA7F}"

#: Any character from where those scripts begin: texts without one are told by one comparison a character.
WIDE = r"[^\x{0}-\x{DFF}]"

# The importance lexicon.
NOISE_TOKENS = ["hi", "hello", "hey", "yo", "sup", "ok", "okay", "k", "kk", "thanks", "thx", "ty", "+1", "-1", "lol", "lmao", "rofl", "nice", "great", "cool", "yes", "no", "yep", "nope", "sure", "fine", "👍", "🎉", "❤️", "🚀", "✅", "💯"]
NOISE_PHRASES = ["good morning", "good afternoon", "good evening", "good night", "have a good one", "have a great day", "thanks!", "thank you", "thank you!", "you're welcome"]
CRITICAL_KEYWORDS = ["policy", "regulatory", "compliance", "approved", "signed", "budget confirmed", "executed", "ratified", "authorised", "authorized", "legal hold", "incident", "outage", "breach"]
IMPORTANT_KEYWORDS = ["deadline", "owner", "decision", "launch", "milestone", "assigned to", "blocker", "release", "ship", "approval needed", "kickoff", "go-live", "commit"]
NEGATIONS = ["not", "no longer", "cancelled", "canceled", "rejected", "denied", "revoked", "rescinded", "withdrawn", "postponed", "deferred", "reverted", "rolled back", "on hold", "blocked", "declined", "refused", "abandoned", "scrapped", "voided"]
NEGATION_WINDOW = 30
MIN_SIGNAL = 5

# Words that the recall lanes leave out.
RECALL_STOPWORDS = ["です", "ます", "の", "は", "が", "を", "に", "へ", "と", "で", "や", "も", "か", "ね", "よ", "な", "だ", "的", "了", "在", "是", "和", "也", "就", "都", "而", "及", "与", "或", "之",
                    "และ", "หรือ", "ที่", "ใน", "บน", "ของ", "เป็น", "จะ", "แล้ว", "ནི", "དང", "ལ", "ཡིན", "རེད", "ཡོད", "མེད", "និង", "នៅ", "ជា", "သည်", "က", "နှင့်", "မှ", "ကို", "တွင်", "မှာ", "ໃນ", "ຂອງ", "ແລະ", "ຫຼື", "ເປັນ"]

# What a question about memory is recognised by.
TEMPORAL = ["yesterday", "today", "last week", "this week", "last month", "recent", "recently", "just now"]
HOLISTIC = ["catch me up", "summary", "summarise", "summarize", "overview", "tldr", "tl;dr", "what's going on", "what is going on", "the project"]
RELATIONAL = ["decided by", "approved by", "assigned to", "owns", "owner of", "linked to", "part of", "depends on", "blocked by", "blocking"]
POINT = ["who is", "what is", "what's", "who's"]
COST = {"summary": 0, "fts": 1, "semantic_vector": 2, "graph_traversal": 3, "raw_evidence": 4}

SENTENCE_END = r"\x{002E}!?\x{3002}\x{FF01}\x{FF1F}\x{FF0E}\x{0964}\x{0965}\x{061F}\x{06D4}\x{1362}\x{0F0D}\x{0F0E}\x{17D4}\x{17D5}\x{104A}\x{104B}\n"


def any_of(words: list[str]) -> str:
    """A pattern for one of some words, longest first."""
    return "|".join(re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", w) for w in sorted(words, key=lambda w: (-len(w), w)))


def whole_word(words: list[str]) -> str:
    """A pattern for one of some words with no ASCII letter or digit beside it. Group 2 is the word."""
    return rf"(^|[^A-Za-z0-9])({any_of(words)})([^A-Za-z0-9]|$)"


def is_noise(text: Column) -> Column:
    """Nothing, a short text without a digit, or a greeting."""
    return _noise(F.lower(F.trim(text)))


def _noise(low: Column) -> Column:
    return (low == "") | ((F.length(low) < MIN_SIGNAL) & ~low.rlike("[0-9]")) | low.isin(NOISE_TOKENS + NOISE_PHRASES)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, in which the value is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _class(low: Column, words: list[str], value: int) -> Column:
    """value if the first keyword of the list is there, one less if a negation is near it, else null.

    The text is searched once; what stands there is then read from the few characters behind the place.
    """
    pattern = whole_word(words)
    reach = max(map(len, words)) + 2  # a keyword and what stands on both sides

    def judge(place: Column) -> Column:
        head = low.substr(place, F.lit(reach))
        size = F.length(F.regexp_extract(head, pattern, 2))
        at = place + F.length(F.regexp_extract(head, pattern, 1))
        around = F.concat(low.substr(F.greatest(at - NEGATION_WINDOW, F.lit(1)), F.least(F.lit(NEGATION_WINDOW), at - 1)), F.lit(" | "), low.substr(at + size, F.lit(NEGATION_WINDOW)))
        return F.when(place > 0, F.when(around.rlike(whole_word(NEGATIONS)), value - 1).otherwise(value))

    return once(F.regexp_instr(low, F.lit(pattern)), judge)


def importance(text: Column) -> Column:
    """3 critical, 2 important, 1 useful, 0 noise. Windows for negation are in characters."""
    judge = lambda low: F.coalesce(_class(low, CRITICAL_KEYWORDS, 3), _class(low, IMPORTANT_KEYWORDS, 2), F.lit(1))
    return once(F.lower(F.trim(text)), lambda low: F.when(_noise(low), 0).otherwise(judge(low)))


def judged(text: Column) -> Column:
    """``(importance, negated)``: what a text is worth, and whether a negation stands near its first keyword. A text is searched once for each class."""

    def both(low: Column) -> Column:
        critical = lambda use: once(_class(low, CRITICAL_KEYWORDS, 3), use)
        other = lambda use: once(_class(low, IMPORTANT_KEYWORDS, 2), use)
        of = lambda value, least: F.struct(F.when(_noise(low), 0).otherwise(F.coalesce(value, F.lit(1))).alias("importance"), F.coalesce(value == least, F.lit(False)).alias("negated"))
        return critical(lambda c: F.when(c.isNotNull(), of(c, 2)).otherwise(other(lambda i: of(i, 1))))

    return once(F.lower(F.trim(text)), both)


def negated(text: Column) -> Column:
    """Whether a negation stands near the first keyword."""
    return judged(text)["negated"]


def has_unsegmented(text: Column) -> Column:
    return text.rlike(WIDE) & text.rlike(f"[{UNSEGMENTED}]")


def unsegmented_only(text: Column) -> Column:
    """The characters of unsegmented scripts, in order."""
    return F.when(text.rlike(WIDE), _unsegmented_only(text)).otherwise(F.substring(text, 1, 0))


def _unsegmented_only(text: Column) -> Column:
    return F.regexp_replace(text, rf"[\x{{0}}-\x{{DFF}}]++|[^{UNSEGMENTED}]++", "")


def searched_unsegmented(text: Column) -> Column:
    """``unsegmented_only`` of a text without recall-lane stop words."""
    return F.when(text.rlike(WIDE), _unsegmented_only(_strip(text))).otherwise(F.substring(text, 1, 0))


def ngrams(text: Column, n: int) -> Column:
    """Overlapping runs of n characters; none if the text is shorter. The text is cut into characters once, so that a long one costs its length."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), 0)
    runs = F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
    for k in range(3, n + 1):
        runs = F.zip_with(runs, F.slice(chars, k, F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.filter(runs if n > 1 else chars, lambda r: r.isNotNull())


def bigrams(text: Column) -> Column:
    """Two-character grams over the unsegmented characters: they cross gaps."""
    return ngrams(unsegmented_only(text), 2)


def bigram_query(text: Column) -> Column:
    """Quoted bigrams joined by AND; null if there is none."""
    grams = bigrams(text)
    return F.when(F.size(grams) > 0, F.array_join(F.transform(grams, lambda g: F.concat(F.lit('"'), g, F.lit('"'))), " AND "))


def script_counts(text: Column) -> Column:
    """Characters by kind, white space apart."""
    alone = F.regexp_replace(text, r"[\s\x{00A0}\x{3000}]", "")
    rest = F.regexp_replace(alone, f"[{UNSEGMENTED}]", "")
    letters = F.regexp_replace(rest, r"\p{L}", "")
    digits = F.regexp_replace(letters, r"\p{N}", "")
    return F.struct(F.length(alone).alias("total"), (F.length(alone) - F.length(rest)).alias("cjk_family"), (F.length(rest) - F.length(letters)).alias("whitespace_segmented"), (F.length(letters) - F.length(digits)).alias("digit"), F.length(digits).alias("symbol"))


def strip_stopwords(text: Column) -> Column:
    """Recall-lane stop words become spaces; longer ones first."""
    return F.when(text.rlike(WIDE), _strip(text)).otherwise(text)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?={WIDE})(?:{any_of(RECALL_STOPWORDS)})", " ")


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def escape_query(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def literal_fallback(text: Column) -> Column:
    """Words quoted one by one, numbers as prefixes; null if there is none."""
    parts = F.filter(F.split(text, r"[\s\-]+"), lambda p: p != "")
    quoted = F.transform(parts, lambda p: F.concat(escape_query(p), F.when(p.rlike("^[0-9]+$"), "*").otherwise("")))
    return F.when(F.size(parts) > 0, F.array_join(quoted, " "))


def has_identifier(text: Column) -> Column:
    """A word of letters or digits with a hyphen inside."""
    return text.rlike(r"[A-Za-z0-9]-[A-Za-z0-9]")


def snippet(text: Column, most: int = 160) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def raw_sentences(text: Column) -> Column:
    """Sentences as they stand, each with what ends it."""
    return F.regexp_extract_all(text, F.lit(f"[^{SENTENCE_END}]*[{SENTENCE_END}]|[^{SENTENCE_END}]+$"), 0)


def sentences(text: Column) -> Column:
    """``(text, terminator)`` of each sentence, without empty ones."""
    raw = raw_sentences(text)
    cut = F.transform(raw, lambda s: F.struct(F.trim(F.regexp_replace(s, f"[{SENTENCE_END}]$", "")).alias("text"), F.regexp_extract(s, f"[{SENTENCE_END}]$", 0).alias("terminator")))
    return F.filter(cut, lambda s: s["text"] != "")


def urls(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s,;)\]]*"), 0)
    return F.filter(F.transform(found, lambda u: F.regexp_replace(u, r"[.!?\"']+$", "")), lambda u: F.length(u) > 8)


def emails(text: Column) -> Column:
    words = F.transform(F.split(text, r"[\s,;<>]"), lambda w: F.regexp_replace(F.regexp_replace(w, r"^[.!?\"'()]+", ""), r"[.!?\"'()]+$", ""))
    return F.filter(words, lambda w: w.rlike(r"^[A-Za-z0-9._+\-]+@[A-Za-z0-9\-]*\.[A-Za-z0-9.\-]*$"))


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("@[A-Za-z0-9_]+"), 0)


def capitalised(text: Column, stop: list[str]) -> Column:
    """Words of two letters or more that begin in upper case, without stop words."""
    words = F.regexp_extract_all(F.translate(text, "’‘ʼ", "'''"), F.lit(r"[\p{L}']+"), 0)
    return F.filter(words, lambda w: w.rlike(r"^\p{Lu}") & (F.length(w) >= 2) & ~w.isin(stop))


def quarters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[Qq][1-4][ \t]*[0-9]{4}(?:[^0-9]|$)"), 0)


def day_or_month(text: Column) -> Column:
    """Names of days and months, as written."""
    names = "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december".split()
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), 0), lambda w: F.lower(w).isin(names))))


def amounts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\$[0-9,.]+[kKmMbB]?"), 0)


def fact_shaped(sentence: Column) -> Column:
    """Has a space, or at least four characters of a script without spaces."""
    return sentence.contains(" ") | (F.length(unsegmented_only(sentence)) >= 4)


def query_class(text: Column) -> Column:
    """temporal, holistic, relational, point_lookup or other: the first that fits."""
    low = F.lower(text)
    has = lambda words: low.rlike(any_of(words))
    return F.when(has(TEMPORAL), "temporal").when(has(HOLISTIC), "holistic").when(has(RELATIONAL), "relational").when(low.rlike("^(" + any_of(POINT) + ")"), "point_lookup").otherwise("other")


def polarity(text: Column) -> Column:
    """``(negated, core)`` of a claim: negation words drop out, each turns the polarity."""
    words = F.transform(F.filter(F.split(F.translate(text, "’", "'"), r"\s+"), lambda w: w != ""), lambda w: F.lower(F.regexp_replace(F.regexp_replace(w, r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", "")))
    joined = F.concat(F.lit(" "), F.array_join(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(w, F.lit("  "))), ""))
    marked = F.regexp_replace(joined, r" no  longer ", " \u0001 ")
    marked = F.regexp_replace(marked, r" (?:not|no|never|don't|dont|doesn't|doesnt|didn't|didnt) ", " \u0001 ")
    for stem, full in (("wo", "will"), ("ca", "can"), ("sha", "shall")):
        marked = F.regexp_replace(marked, f" {stem}n't ", f" \u0001  {full} ")
    marked = F.regexp_replace(marked, r" ([^ ]+)n't ", " \u0001  $1 ")
    flips = F.length(F.regexp_replace(marked, "[^\u0001]", ""))
    return F.struct((flips % 2 == 1).alias("negated"), F.trim(F.regexp_replace(F.regexp_replace(marked, "\u0001", ""), " +", " ")).alias("core"))


def router_terms(text: Column) -> Column:
    """Lower-case words of more than two bytes."""
    return F.filter(tokens(text), lambda t: F.octet_length(t) > 2)


def salient_terms(text: Column) -> Column:
    """Words of four characters or more, first seen first."""
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= 4))


def first_token(text: Column) -> Column:
    return F.regexp_extract(text, r"\p{L}+", 0)


def first_bigram(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\p{L}+"), 0)
    return F.when(F.size(found) >= 2, F.array_join(F.slice(found, 1, 2), " "))
