"""Licence scans: a trained paragraph classifier, confirmed by templates (DataFrame operations only).

Training. A multinomial logistic regression over hashed word n-grams (1 to 3 words) learns
from the licence phrases below, each in several surroundings, and from an ``unknown``
class: shuffled phrases and sentences that only speak about licences. It is trained anew
in each run, in numpy on the driver; that takes about a second, and reads no corpus.
Probabilities are calibrated by a temperature on held-out variants, and so is the threshold
that the probability of being a licence must reach, all families together: the lowest at
which at most ``miss`` of the unknown ones pass.

Scanning. A text's paragraphs are its lines. One that has none of the cue stems, which are of
several languages, is not a licence paragraph; every phrase has a cue, so nothing that a
phrase could confirm is lost. The others are cut into n-grams, which
meet the weights by an equi-join on the hashed n-gram, and one sum per class makes the
logits of a paragraph. The weights' table has at most ``2**bits`` rows, whatever the
corpus. A prediction is confirmed if, for a phrase of the family, 0.8 or more of its
five-word shingles (shorter phrases: the whole) are in the paragraph; a paragraph whose
prediction isn't confirmed, or is below the threshold, is ``unknown``. So is one that says
that something is not licensed, released, distributed or available so.

A phrase may be wrapped: a line that isn't confirmed alone is judged again with the words
next to it in the lines around, unless those lines hold the phrase without it.

Words are runs of a-z after lower-casing A-Z; digits are no words, and neither are ``version``,
``v``, ``clause`` and ``the``: notices differ in these. The ``v`` of ``GPLv3`` counts as such.

Rows are numbered where their cued lines are first written, and all later steps read those
numbers: the partitioning of the input changes nothing. Null and empty texts have no
paragraphs. Repeated rows are rows of their own. Null ids are carried. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cairn.plans.durable import Scratch

#: Notices and characteristic sentences of licence families, as their publishers word them, in short.
PHRASES = {
    "AGPL": ["gnu affero general public license", "under the terms of the gnu affero general public license", "spdx license identifier agpl", "licensed under the gnu agpl version", "licensed under gnu agpl", "licensed under agpl", "license agpl", "agpl licensed"],
    "Apache": ["licensed under the apache license version", "you may not use this file except in compliance with the license", "spdx license identifier apache", "released under the apache license", "this work is licensed under the apache license version", "apache licensed", "license apache", "licensed under apache", "distributed under the apache license"],
    "BSD": ["redistributions of source code must retain the above copyright notice", "redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd license", "licensed under the bsd license", "spdx license identifier bsd clause", "this software is released under the clause bsd license", "bsd licensed", "license bsd", "licensed under bsd", "distributed under the bsd license"],
    "CC-BY": ["licensed under cc by", "licensed under a creative commons attribution international license", "this work is licensed under the creative commons attribution license", "licensed under creative commons attribution"],
    "CC-BY-NC": ["licensed under cc by nc", "this work is licensed under a creative commons attribution noncommercial license", "licensed under creative commons attribution noncommercial", "released under cc by nc", "licensed under cc by nc sa", "licensed under cc by nc nd"],
    "CC-BY-SA": ["licensed under cc by sa", "this work is licensed under a creative commons attribution sharealike license", "licensed under creative commons attribution share alike", "text is available under the creative commons attribution sharealike license"],
    "CC0": ["dedicated to the public domain under cc", "creative commons zero public domain dedication license", "no rights reserved released under cc zero license", "released into the public domain under the cc license"],
    "EPL": ["licensed under the eclipse public license version", "under the terms of the eclipse public license", "released under the eclipse public license", "spdx license identifier epl", "license epl", "licensed under epl"],
    "GPL": ["this work is licensed under the gnu general public license version", "under the terms of the gnu general public license as published by the free software foundation", "licensed under the gnu general public license", "released under the gnu gpl license", "licensed under the gpl version", "spdx license identifier gpl", "licensed under gnu gpl", "licensed under gpl", "license gpl", "gpl licensed", "distributed under the gnu general public license"],
    "ISC": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "released under the isc license", "licensed under the isc license", "spdx license identifier isc", "license isc", "isc licensed", "distributed under the isc license"],
    "LGPL": ["gnu lesser general public license", "under the terms of the gnu lesser general public license", "licensed under the gnu lgpl version", "spdx license identifier lgpl", "licensed under gnu lgpl", "licensed under lgpl", "license lgpl", "lgpl licensed"],
    "MIT": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "this project is licensed under the terms of the mit license", "spdx license identifier mit", "license mit", "mit licensed", "licensed under mit", "distributed under the mit license", "available under the mit license"],
    "MPL": ["this source code form is subject to the terms of the mozilla public license", "licensed under the mozilla public license", "released under the mozilla public license version", "spdx license identifier mpl", "license mpl", "licensed under mpl", "distributed under the mozilla public license"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense license", "spdx license identifier unlicense", "license unlicense", "licensed under the unlicense"],
}
#: Sentences that speak about licences and are none.
ABOUT = [
    "all rights reserved no license is granted", "the driver lost his license last week", "a fishing license is required at the lake", "see the license file for details", "you need a license to use this product",
    "please read the license agreement before installing", "the public was licensed to enter the house", "permission was denied by the server", "copyright by the authors", "licensed professionals only",
    "this license is proprietary and confidential", "the license server is not available", "the apache helicopter was released in spring", "students of mit were granted permission to travel", "commercial license available on request",
    "released under a custom license", "licensed under terms to be announced", "the general public has no license", "source code must be kept secret under this license", "the software license expires in june",
]
UNKNOWN = "unknown"
CUES = r"(?i)licen[cs]|permission|redistribution|public domain|affero|spdx|creative commons|\bcc[ -](?:by|zero)\b|\bcc0\b|\b[al]?gpl|lizenz|licenz|licença|gemeinfrei|domaine public|dominio p[uú]blico|лиценз|许可|授权|ライセンス|라이선스"
#: Words that notices of one family differ in.
DROPPED = ["v", "version", "clause", "the"]
#: What a line says that speaks against a licence.
DENIED = r"(?:^| )(?:not|never|no longer|cannot be|isn t|wasn t|aren t|neither|nor)(?: [a-z]+){0,2} (?:licensed|released|distributed|available|dedicated|covered)(?: |$)"
SHINGLE, SIMILAR = 5, 0.8
#: A wrapped phrase may go on in so many lines on either side, and is no longer than so many words.
NEAR, REACH = 4, max(len(p.split()) for ps in PHRASES.values() for p in ps)
_UPPER = {i: i + 32 for i in range(65, 91)}


def spoken(text: str) -> list[str]:
    """The words of a text."""
    return [w for w in re.findall("[a-z]+", re.sub("(gpl|mpl|epl)v", r"\1 v", text.translate(_UPPER))) if w not in DROPPED]


def spoken_column(text: Column) -> Column:
    """``spoken`` as an expression."""
    low = F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "(gpl|mpl|epl)v", "$1 v")
    return F.filter(F.regexp_extract_all(low, F.lit("([a-z]+)"), 1), lambda w: ~w.isin(DROPPED))


def _grams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


class Model:
    """Classes (the last is unknown), weights by hashed n-gram, bias and threshold."""

    def __init__(self, bits: int = 12, miss: float = 0.02, seed: int = 5, rounds: int = 300):
        self.bits, self.classes = bits, [*sorted(PHRASES), UNKNOWN]
        rng = np.random.default_rng(seed)
        around = "the of and on in with for this that data table green river house seven report also may not".split()
        rows, labels = [], []

        def add(words: list[str], label: int) -> None:
            rows.append(words)
            labels.append(label)

        for _ in range(8):
            for c, name in enumerate(self.classes[:-1]):
                for phrase in PHRASES[name]:
                    words = spoken(phrase)
                    before, after = (list(rng.choice(around, rng.integers(0, 6))) for _ in range(2))
                    add([*before, *words, *after], c)
                    if len(words) > 4:  # of fewer words an order says little
                        add([*before, *rng.permutation([w for w in words if w not in around]), *after], len(self.classes) - 1)
            for about in ABOUT:
                add([*rng.choice(around, rng.integers(0, 6)), *spoken(about)], len(self.classes) - 1)
            add(list(rng.choice(around, 12)), len(self.classes) - 1)
        x = np.zeros((len(rows), 1 << bits), np.float32)
        for i, words in enumerate(rows):
            for g in set(_grams(words)):
                x[i, self.place(g)] = 1.0
        y = np.array(labels)
        held = np.arange(len(y)) % 5 == 4
        self.weights, self.bias = self._fit(x[~held], y[~held], rounds)
        loss = {t: -float(np.log(self._probabilities(x[held], t)[np.arange(held.sum()), y[held]] + 1e-12).mean()) for t in np.geomspace(0.25, 4, 33)}
        best = min(loss, key=loss.get)
        self.weights, self.bias = (self.weights / best).astype(np.float32), (self.bias / best).astype(np.float32)
        p = self._probabilities(x[held])
        other = np.sort(1 - p[y[held] == len(self.classes) - 1][:, -1])
        self.threshold = float(max(0.5, other[min(len(other) - 1, int(np.ceil(len(other) * (1 - miss))))]))

    def place(self, gram: str) -> int:
        return zlib.crc32(gram.encode()) % (1 << self.bits)

    def _fit(self, x: np.ndarray, y: np.ndarray, rounds: int, ridge: float = 1e-4, rate: float = 4.0):
        """Accelerated gradient descent on the mean cross entropy with an L2 penalty."""
        want = np.eye(len(self.classes), dtype=np.float32)[y]
        w, b = np.zeros((x.shape[1], len(self.classes)), np.float32), np.zeros(len(self.classes), np.float32)
        vw, vb = w.copy(), b.copy()
        seen = np.flatnonzero(x.any(0))
        z = x[:, seen]
        for _ in range(rounds):
            s = z @ w[seen] + b
            s = np.exp(s - s.max(1, keepdims=True))
            gap = (s / s.sum(1, keepdims=True) - want) / len(y)
            vw[seen] = 0.9 * vw[seen] - rate * 0.1 * (z.T @ gap + ridge * w[seen])
            vb = 0.9 * vb - rate * 0.1 * gap.sum(0)
            w[seen] += vw[seen]
            b = b + vb
        return w, b

    def _probabilities(self, x: np.ndarray, temperature: float = 1.0) -> np.ndarray:
        s = (x @ self.weights + self.bias) / temperature
        s = np.exp(s - s.max(1, keepdims=True))
        return s / s.sum(1, keepdims=True)

    def table(self, spark, scratch: Scratch) -> DataFrame:
        """``(h, w0, w1, ...)``: the hashed n-grams that have a weight."""
        rows = [{"h": int(h), **{f"w{c}": round(float(v), 5) for c, v in enumerate(self.weights[h])}} for h in np.flatnonzero(self.weights.any(1))]
        fields = ", ".join(["h bigint", *(f"w{c} double" for c in range(len(self.classes)))])
        return scratch.keep(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>"))), "weights")


def _ngrams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _shingles(phrase: str) -> list[str]:
    words = spoken(phrase)
    return sorted({" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))})


def _confirmed(family: Column, words: Column) -> Column:
    """0.8 or more of the five-word shingles of one of the family's phrases are in the paragraph."""
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    by_family = F.create_map(*[x for f, ps in sorted(PHRASES.items()) for x in (F.lit(f), F.from_json(F.lit(json.dumps([_shingles(p) for p in ps])), "array<array<string>>"))])
    return F.exists(F.coalesce(by_family[family], F.array().cast("array<array<string>>")), lambda phrase: F.size(F.filter(phrase, lambda s: text.contains(F.concat(F.lit(" "), s, F.lit(" "))))) >= SIMILAR * F.size(phrase))


def cued_lines(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, cues)``: the rows, numbered, and their lines with a cue, each with the words next to it in the lines around."""
    lines = F.split("text", "\n")
    line = lambda k: F.get("lines", k)
    words = lambda a, n: spoken_column(F.array_join(F.slice("lines", a, n), " "))

    def cue(k: Column) -> Column:
        before, after = words(F.greatest(k - NEAR, F.lit(0)) + 1, F.least(k, F.lit(NEAR))), words(k + 2, F.lit(NEAR))
        return F.struct(k.alias("place"), line(k).alias("paragraph"), F.slice(before, F.greatest(F.size(before) - REACH, F.lit(0)) + 1, F.lit(REACH)).alias("before"), F.slice(after, 1, REACH).alias("after"))

    numbered = docs.select("doc_id", F.when(F.col("text").rlike(CUES), lines).alias("lines"), F.monotonically_increasing_id().alias("row"))
    cued = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda k: line(k).rlike(CUES))
    return numbered.select("row", "doc_id", F.when(F.col("lines").isNotNull(), F.transform(cued, cue)).alias("cues"))


def scan_paragraphs(rows: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """``(row, doc_id, place, paragraph, family, probability)`` for each paragraph of ``cued_lines``; family may be unknown. probability: of being a licence."""
    found = (
        rows.where("cues is not null").select("row", "doc_id", F.explode("cues").alias("cue"))
        .select("row", "doc_id", "cue.place", "cue.paragraph", "cue.before", spoken_column(F.col("cue.paragraph")).alias("own"), "cue.after")
        .select("*", F.posexplode(F.array(F.col("own"), F.concat("before", "own", "after"))).alias("form", "words"))
        .where("form = 0 or size(before) + size(after) > 0")
    )
    found = scratch.keep(found, "paragraphs")
    grams = F.array_distinct(F.concat(*(_ngrams(F.col("words"), n) for n in (1, 2, 3))))
    hashed = F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(1 << model.bits))
    k = len(model.classes)
    # a feature is present or not, as in training, even if two n-grams of a paragraph share a place
    exploded = found.select("row", "place", "form", F.explode(grams).alias("gram")).select("row", "place", "form", hashed.alias("h")).distinct()
    logits = exploded.join(model.table(rows.sparkSession, scratch), "h").groupBy("row", "place", "form").agg(*[F.sum(f"w{c}").alias(f"w{c}") for c in range(k)])
    joined = found.join(logits, ["row", "place", "form"], "left")
    z = [F.coalesce(F.col(f"w{c}"), F.lit(0.0)) + F.lit(round(float(model.bias[c]), 5)) for c in range(k)]
    scored = joined.select("row", "doc_id", "place", "form", "paragraph", "before", "own", "after", "words", F.array(*z).alias("z"))
    scored = scored.select("*", F.array_max("z").alias("top"), F.slice("z", 1, k - 1).alias("families"))
    none = F.exp(F.element_at("z", k) - F.col("top")) / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    family = F.array_position("families", F.array_max("families")).cast("int")
    scored = scored.select("row", "doc_id", "place", "form", "paragraph", "before", "own", "after", "words", (1 - none).alias("probability"), F.element_at(F.array(*map(F.lit, model.classes)), family).alias("guess"))
    # a phrase that stands in the lines around alone is theirs
    theirs = _confirmed(F.col("guess"), F.col("before")) | _confirmed(F.col("guess"), F.col("after"))
    denied = F.array_join("own", " ").rlike(DENIED)
    sure = ~denied & (F.col("probability") >= model.threshold) & _confirmed(F.col("guess"), F.col("words")) & ((F.col("form") == 0) | ~theirs)
    per = scored.groupBy("row", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("paragraph").alias("paragraph"),
        F.min(F.when(sure, F.struct("form", "guess", "probability"))).alias("best"), F.max(F.when(F.col("form") == 0, F.col("probability"))).alias("alone"),
    )
    return per.select("row", "doc_id", "place", "paragraph", F.coalesce("best.guess", F.lit(UNKNOWN)).alias("family"), F.coalesce("best.probability", "alone").alias("probability"))


def scan_licenses(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, license, licenses, n_licensed, n_unknown, confidence)``, one row per row of ``docs``.

    license: the family of the most paragraphs (then of the highest probability, then by
    name), ``unknown`` if paragraphs speak of licences and none is confirmed, else null.
    """
    scratch = Scratch(docs.sparkSession, "license-scan")
    rows = scratch.keep(cued_lines(docs), "cues")
    ids = rows.select("row", "doc_id")
    seen = scan_paragraphs(rows, model or Model(), scratch)
    per = seen.groupBy("row", "family").agg(F.count("*").alias("n"), F.max("probability").alias("p"))
    best = per.groupBy("row").agg(
        F.min(F.when(F.col("family") != UNKNOWN, F.struct((-F.col("n")).alias("n"), (-F.col("p")).alias("p"), "family"))).alias("best"),
        F.array_sort(F.collect_set(F.when(F.col("family") != UNKNOWN, F.col("family")))).alias("licenses"),
        F.sum(F.when(F.col("family") != UNKNOWN, F.col("n")).otherwise(0)).alias("n_licensed"),
        F.sum(F.when(F.col("family") == UNKNOWN, F.col("n")).otherwise(0)).alias("n_unknown"),
    )
    none = F.array().cast("array<string>")
    return ids.join(best, "row", "left").select(
        "doc_id",
        F.when(F.col("n_licensed") > 0, F.col("best.family")).when(F.col("n_unknown") > 0, UNKNOWN).alias("license"),
        F.coalesce("licenses", none).alias("licenses"),
        F.coalesce("n_licensed", F.lit(0)).alias("n_licensed"),
        F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"),
        (-F.col("best.p")).alias("confidence"),
    )
