"""The corpus operators against brute force, exact round trips and held-out labels, and on odd tables."""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import chat, decontaminate as dec, exact_dedup as ex, language as lang, license_scan as lic, mixing as mix, queries, simhash as sim, token_shards as tok, toxicity as tox, url_filter as url
from cairn.plans.durable import Scratch
from tests.conftest import rows_of, sql_rows

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, fp string, score string, slot int, epoch string, block int, best int"


def odd_docs(spark):
    """Nulls in every column, empty, very long and repeated texts, ties, and extra columns with names that operators use."""
    long = "word " * 60_000
    rows = [(1, "a b c", "en", "s"), (2, "abc", None, None), (2, "abc", None, None), (None, None, "en", "s"), (None, "a  b c", "fr", "t"), (5, "", "en", ""), (6, "   \n", "en", None), (7, long, "en", "s"), (8, long + "x", "en", "s"), (9, "Ünï çödé 123 ١٢٣", "de", "s"), (10, "!!! 123", "es", "t"), (11, "a b c", "en", "t")]
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), 0, "x", "y", 1, "z", 2, 3) for i, t, la, s in rows], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    assert rows_of(frame, columns) == sql_rows(duck, queries.SQL[name], columns)


# ---- exact duplicates


def brute_exact(rows):
    norm = [(t or "").translate({ord(c): None for c in ex.SPACES}) for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        group = [(-len(t or ""), j is None, j or 0, k) for k, ((j, t), m) in enumerate(zip(rows, norm, strict=True)) if m == n]
        best = rows[min(group)[3]][0]
        out.append((i, best, len(group), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("run_rows, fan_in", [(1 << 14, 8), (1, 2), (3, 3)])
def test_exact_dedup_brute_force(spark, run_rows, fan_in):
    docs = odd_docs(spark)
    got = ex.exact_dedup(docs, run_rows, fan_in).collect()
    want = brute_exact([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got})  # one row of each group stays, even of repeated rows


# ---- near duplicates


def brute_components(points, radius=3):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(points, 2):
        if bin(a ^ b).count("1") <= radius:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in points}


def clumps(n=700, seed=1):
    """Far fingerprints, chains of near ones, and a dense clump around one."""
    rng = np.random.default_rng(seed)
    points = [int(x) for x in rng.integers(0, 2**64, n, dtype=np.uint64)]
    for p in points[:40]:
        for _ in range(5):
            p ^= 1 << int(rng.integers(64))
            points.append(p)
    points += [points[0] ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(30), 2)]
    return sorted(set(points) | {0, 1, 7, 15})


@pytest.mark.parametrize("shard", [1 << 16, 100])
def test_vantage_search_is_exact(spark, shard):
    points = clumps()
    signed = [int(np.uint64(p).view(np.int64)) for p in points]
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    found = sim.near_components(frame, Scratch(spark, "t"), shard=shard)
    got = {int(np.int64(r["fp"]).view(np.uint64)): r["component_fp"] for r in found.collect()}
    want = brute_components(points)
    groups = lambda of: sorted(sorted(m for m in of if of[m] == c) for c in set(of.values()))
    linked = {p: c for p, c in want.items() if list(want.values()).count(c) > 1}
    assert groups(got) == groups(linked)


def test_local_search_returns_a_forest():
    points = np.array(clumps(), np.uint64)
    links = sim.near_links(points, np.ones(len(points), bool), leaf=32)
    assert len(links) < len(points) and all(bin(int(points[a] ^ points[b])).count("1") <= 3 for a, b in links)


def test_fingerprint_plainly():
    import xxhash

    def plain(text):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    for text in ["", "one", "One TWO", "a b c d e f a b c", "Ünï ÇÖDÉ x\ty \x0b z W", "É A B C"]:
        assert sim.fingerprint(text) == plain(text)


def test_simhash_odd_table(spark):
    got = sim.simhash_dedup(odd_docs(spark)).collect()
    assert len(got) == 12
    zero = {(r["doc_id"], r["component_id"]) for r in got if r["fingerprint"] == "0" * 16}
    assert {i for i, _ in zero} >= {None, 5, 6} and all(c is not None for _, c in zero)


def brute_near(rows, similar=0.8):
    """The kept doc_id of each row, by comparing all pairs of shingle sets."""
    sets = [frozenset(np.frombuffer(sim.sketch(t)[2], "<u4").tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both >= similar * (len(sets[a]) + len(sets[b]) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(rows))]


@pytest.mark.parametrize("n, words, lot", [(30, 100, 4096), (200, 100, 4096), (600, 100, 4096), (250, 60, 4096), (300, 100, 64)])
def test_large_groups_of_near_copies_lose_no_link(spark, n, words, lot):
    """One text, n copies with up to six words replaced: many pairs are near by their fingerprints and too far apart by their sets."""
    rng = np.random.default_rng(n)
    text = [f"w{i}" for i in rng.integers(0, 10_000, words)]
    rows = []
    for k in range(n):
        copy = list(text)
        for at in rng.choice(words, int(rng.integers(0, 7)), replace=False):
            copy[at] = f"x{rng.integers(10_000)}"
        rows.append((k, " ".join(copy)))
    frame, stays = sim.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), Scratch(spark, "t"), lot=lot)
    kept = sorted(r["doc_id"] for r in frame.join(stays, "row", "left_semi").select("doc.doc_id").collect())
    assert kept == sorted(set(brute_near(rows)))


def test_heads_of_sets_tell_their_similarity():
    rng = np.random.default_rng(1)
    for size, shared in [(5, 3), (64, 60), (900, 800), (900, 300), (4000, 3600), (1, 0)]:
        every = rng.choice(1 << 32, 2 * size - shared, replace=False).astype("<u4")
        a, b = np.sort(every[:size]), np.sort(every[size - shared :])
        share = sim.head_share(a[: sim._HEAD], b[: sim._HEAD])
        exact = shared / (2 * size - shared)
        assert share == exact if 2 * size - shared <= sim._HEAD else abs(share - exact) < 0.2
    none = np.zeros(0, "<u4")
    assert sim.head_share(none, none) == 1.0 and sim.head_share(none, a) == 0.0


def test_tiles_bring_all_pairs_of_different_parts_together(spark):
    rng = np.random.default_rng(6)
    rows = [(k, int(row), int(rng.choice([1, 1, 1, 2, 3, row]))) for k in (1, 2) for row in range(90)] + [(3, 1, 1), (3, 2, 1)]
    tiles = sim._tiles(spark.createDataFrame(rows, "key bigint, row bigint, part bigint"), 16, 8).collect()
    met, of = set(), {}
    for t in tiles:
        of.setdefault((t["key"], t["p"], t["r"]), []).append(t)
    for (k, _, _), own in of.items():
        met |= {(k, *sorted((a["row"], b["row"]))) for a in own if a["ask"] for b in own if not b["ask"] and a["part"] != b["part"]}
    assert met == {(k, a, b) for k, a, x in rows for j, b, y in rows if k == j and a < b and x != y}
    assert max(len(x) for x in of.values()) < 90


def test_tiles_of_weighty_rows_are_smaller_and_a_key_of_one_piece_has_a_row_twice(spark):
    rows = [(k, row, row, 1 if k == 1 else 4) for k in (1, 2) for row in range(64)]
    frame = spark.createDataFrame(rows, "key bigint, row bigint, part bigint, size bigint")
    made = {r["key"]: (r["p"], r["n"]) for r in sim._tiles(frame, 64, 64, F.col("size")).groupBy("key").agg(F.countDistinct("p", "r").alias("p"), F.count("*").alias("n")).collect()}
    assert made[1] == (1, 64 + 63) and made[2] == (16, 64 * 4 + 63 * 4)


def test_near_copies_move_no_text(spark, monkeypatch):
    """Neither the documents nor all shingle sets are shuffled, and no set is written that nobody asks for."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(i, F.expr("id div 1")), F.lit(5000))))).alias("text"))
    docs = docs.union(docs.where("doc_id < 4").select((F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit(" more")).alias("text")))
    kept, scratch = {}, Scratch(spark, "t")
    monkeypatch.setattr(scratch, "keep", lambda frame, name="step", **o: kept.setdefault(f"{name}{len(kept)}", Scratch.keep(scratch, frame, name, **o)))
    monkeypatch.setattr(scratch, "drop", lambda frame: None)
    out = sim.stay(*sim.near_copies(docs, scratch), scratch)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(400))
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert "sh" not in kept["sketches0"].columns
    assert next(f for n, f in kept.items() if n.startswith("sets")).count() == 8


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_rows_among_many_ids(spark, monkeypatch, few):
    monkeypatch.setattr(sim, "_FEW", few)
    rows = spark.createDataFrame([(i, "t") for i in (0, 1, 62, 63, 64, 65, (1 << 33) + 63, (5 << 33))], "row bigint, text string")
    ids = spark.createDataFrame([(i,) for i in (0, 63, 64, (1 << 33) + 63, 1 << 33)], "row bigint")
    assert sorted(r["row"] for r in sim._among(rows, ids, Scratch(spark, "t")).collect()) == [0, 63, 64, (1 << 33) + 63]


@pytest.mark.parametrize("lot", [4096, 3])
def test_near_copies_equal_brute_force(spark, lot):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for _ in range(40):
        words = list(rng.choice(vocabulary, int(rng.integers(30, 200))))
        rows.append((at, " ".join(words)))
        for _ in range(int(rng.integers(0, 4))):
            at += 1
            copy = list(words)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = "changed"
            rows.append((at, " ".join(copy)))
        at += 1
    rows += [(900, "a b c"), (901, "A  b\tc"), (902, None), (903, ""), (None, rows[0][1]), (0, rows[5][1])]
    frame, stays = sim.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), Scratch(spark, "t"), lot=lot)
    kept = frame.join(stays, "row", "left_semi").select("doc.*").collect()
    want = brute_near(rows)
    best = {g: min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if want[i] == g) for g in set(want)}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(best.values())


# ---- decontamination


def brute_hits(text, items, window=13):
    words = dec.WORD.findall(dec.lower(text or ""))
    hit, ids = set(), set()
    for i, item in items:
        own = dec.WORD.findall(dec.lower(item or ""))
        n = min(window, len(own))
        for a in range(len(own) - n + 1 if n else 0):
            for b in range(len(words) - n + 1):
                if words[b : b + n] == own[a : a + n]:
                    hit |= set(range(b, b + n))
                    ids.add(i)
    return len(words), len(hit), sorted(ids, key=str)


@pytest.mark.parametrize("most", [1 << 24, 300])
def test_decontamination_brute_force(spark, most):
    rng = np.random.default_rng(5)
    vocabulary = ["ab", "ü", "c3", "D"]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(1, say(3)), (2, say(15)), (10, "D"), (3, None), (4, "..."), (5, say(14))]
    docs = [(i, say(int(n)) + "." * int(n % 3)) for i, n in enumerate(rng.integers(0, 60, 40))] + [(90, None), (91, ""), (92, items[1][1].upper().replace(" ", " -- "))]
    got = dec.scan_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), max_chars=most).collect()
    text_of = dict(docs)
    for r in got:
        n, hits, ids = brute_hits(text_of[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) == (n, hits, ids, hits > 0 and 20 * hits >= n)
        assert sum(len(dec.WORD.findall(dec.lower(text_of[r["doc_id"]][s["start"] : s["end"]]))) for s in r["spans"]) == hits


def test_decontamination_shares_ids_and_names(spark):
    docs = spark.createDataFrame([(1, " ".join(["a b c"] * 15 + ["x"] * 55), 5)], "doc_id bigint, text string, n_hit int")
    bench = spark.createDataFrame([("q1", "a b c"), (None, "x"), ("q2", None)], "item_id string, text string")
    got = dec.scan_documents(docs, bench, share=0.4).first()
    assert (got["n_words"], got["n_hit"], got["item_ids"], got["contaminated"]) == (100, 45, ["q1"], True)
    assert not dec.scan_documents(docs, bench, share=0.46).first()["contaminated"]
    held = dec.scan_documents(docs.select("text", F.struct("doc_id", "n_hit").alias("doc")), bench, carry=("doc",)).first()
    assert held["doc"]["n_hit"] == 5 and held["n_hit"] == 45


# ---- languages, toxicity, licences


def test_language_equals_plain_multinomial_bayes():
    rng = np.random.default_rng(4)
    letters = {"xx": "abcde", "yy": "cdefg", "zz": "éèêaü"}
    say = lambda la, n: " ".join("".join(rng.choice(list(letters[la]), 4)) for _ in range(n))
    bits, taught = 10, [(la, say(la, 6)) for la in letters for _ in range(1 + 2 * (la == "xx"))]
    counts = np.zeros((3, 1 << bits), np.int64)
    for la, t in taught:
        for h in lang.grams(lang.codes(t), bits):
            counts[sorted(letters).index(la), h] += 1
    model = lang.Model(sorted(letters), counts, bits, np.array([3, 1, 1]))
    texts = [say(la, n) for la in letters for n in (1, 3, 40)] + ["", None, "12 !", "a", say("xx", 3) * 30_000]
    got, sizes = model.joint(texts)
    for text, row, size in zip(texts, got, sizes, strict=True):
        hs = lang.grams(lang.codes(text), bits).tolist() if text and len(lang.codes(text)) else []
        assert size == len(hs)
        plain = [np.log(n / 5) + sum(np.log((counts[k, h] + 0.5) / (counts[k].sum() + 0.5 * (1 << bits))) for h in hs) for k, n in enumerate([3, 1, 1])] if len(hs) < 1000 else None
        assert plain is None or np.allclose(row, plain, rtol=1e-5)
    names, sure = model.score(texts)
    assert names[9:12] == ["und"] * 3 and (sure[9:12] == 0).all() and names[13] == "xx"


def test_language_held_out(spark, sf_dir):
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_language_odd_table(spark):
    docs = odd_docs(spark)
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in lang.identify(docs, lang.train(docs), ["doc_id", "text"]).collect()}
    assert got[(None, None)] == got[(5, "")] == got[(10, "!!! 123")] == ("und", 0.0) and got[(9, "Ünï çödé 123 ١٢٣")][0] != "und"
    nothing = lang.train(empty_docs(spark))
    assert {r["lang_pred"] for r in lang.identify(docs, nothing).collect()} == {"und"}


def naive_kernel(a, b, decay=0.6):
    total = 0.0
    for i in itertools.combinations(range(len(a)), 3):
        for j in itertools.combinations(range(len(b)), 3):
            if [a[x] for x in i] == [b[x] for x in j]:
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_string_kernel_and_its_folded_form():
    words = ["idiot", "idxiot", "banana", "abab", "xyz", "ab"]
    got = tox.raw_kernel(words, words)
    assert np.allclose(got, [[naive_kernel(a, b) for b in words] for a in words], atol=1e-5)
    m = tox.Machine(["idiot", "banana", "abab"])
    m.weights, m.bias = np.array([1.0, -0.5, 0.25], np.float32), np.float32(-0.1)
    m.fold()
    some = ["idxiot", "bananas", "zzzz", "üabab"]
    assert np.allclose(m.decide(some), m.kernel(some) @ m.weights + m.bias, atol=1e-5)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    english = docs.where("lang = 'en'")
    machine = tox.train(english, labels.where(~tox.held_out(F.col("doc_id"))))
    test = english.join(labels.select("doc_id", "toxic"), "doc_id").where(tox.held_out(F.col("doc_id")))
    got = tox.score_documents(test, machine, ["doc_id", "toxic"]).collect()
    hits = [r["score"] >= 0.5 for r in got if r["toxic"] == 1]
    assert np.mean(hits) > 0.85 and np.mean([r["score"] >= 0.5 for r in got if r["toxic"] == 0]) < 0.02
    spelt = machine.score(["you are an i d i o t really", "such an idxiot here", "id-iot", "the weather is fine"])
    assert (spelt[:3] > spelt[3]).all() and spelt[0] >= 0.5 and spelt[2] >= 0.5


def test_toxicity_words_have_a_beginning():
    long = "abcdefghij" * 3
    assert tox.units("Hi THERE, th*ere i d i o t") == {"^hi", "^there", "^idiot", "^i^", "^d^", "^o^", "^t^"}
    assert tox.units(long) == {"^" + long[:16], long[8:24], long[16:]} and tox.units(None) == tox.units("1 2 !") == set()
    assert "^idiot" in tox.units("an 1d10t") and tox.units("他 是 混蛋 fu") == {"^他^", "^是^", "^混蛋", "^fu"}


def test_folding_many_letters_is_small_and_right():
    words = ["^" + "".join(chr(0x4E00 + 16 * k + i) for i in range(16)) for k in range(125)] + ["^😀😁😂"]
    m = tox.Machine(words)
    m.weights, m.bias = np.random.default_rng(1).normal(size=len(words)).astype(np.float32), np.float32(-0.1)
    m.fold()
    assert m.base > 2000 and m.full is None and len(m.places) < 128 * 680
    some = words[:3] + ["^😀😁", "^😃😁😂", "zzz", words[5][3:9] + words[9][2:5]]
    assert np.allclose(m.decide(some), m.kernel([w if len(w) > 2 else w + "^" for w in some]) @ m.weights + m.bias, atol=1e-4)


def test_training_text_is_bounded(spark):
    own = F.translate(F.md5(F.col("id").cast("string")), "0123456789", "ghijklmnop")
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, F.lit("such an idiot you are ")).otherwise(F.lit("a fine day in town ")), own).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    machine = tox.train(docs, labels, sample_chars=2000)
    assert machine.score(["an idiot", "a day"])[0] > 0.5


def test_toxicity_in_all_languages(spark):
    found = queries.op3_toxicity(spark, "/root/testdata/sf0.1").where("held_out")
    marked = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = found.join(marked, "doc_id").collect()
    assert np.mean([r["predicted"] for r in got if r["toxic"] == 1]) > 0.75
    assert np.mean([r["predicted"] for r in got if r["toxic"] == 0]) < 0.02


def test_toxicity_odd_table(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 1, None), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in tox.score_documents(docs, tox.train(docs, labels.where("toxic = 0"))).collect()} == {0.0}
    assert len(tox.score_documents(docs, tox.train(docs, labels)).collect()) == 12


@pytest.mark.parametrize("line, family", [
    ("Licensed under the Apache License, Version 2.0.", "Apache"), ("released under the MIT license", "MIT"), ("This work is licensed under the GNU General Public License, version 3.", "GPL"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"),
    ("Licensed under CC BY-SA 4.0", "CC-BY-SA"), ("GNU Lesser General Public License v2.1", "LGPL"), ("The driver lost his license last week", "unknown"), ("Licensed under a licence of our own making", "unknown"), ("nothing of the kind", None),
])
def test_license_families(spark, line, family):
    docs = spark.createDataFrame([(1, f"Some text before.\n{line}\nand after")], "doc_id bigint, text string")
    assert lic.scan_licenses(docs).first()["license"] == family


@pytest.mark.parametrize("notice, family", [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files", "MIT"),
    (" * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 3", "GPL"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted", "ISC"),
])
def test_wrapped_notices(spark, notice, family):
    docs = spark.createDataFrame([(1, notice), (2, "the licence of a driver\nreleased under the MIT license")], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in lic.scan_licenses(docs).collect()}
    assert found[1]["license"] == family
    assert (found[2]["n_licensed"], found[2]["n_unknown"]) == (1, 1)


@pytest.mark.parametrize("line, family", [
    ("licensed under the GNU AGPL v3", "AGPL"), ("licensed under the GPLv3", "GPL"), ("Licensed under the BSD 3-Clause License", "BSD"), ("distributed under the MIT license", "MIT"), ("License: MIT", "MIT"), ("Apache-2.0 licensed", "Apache"),
    ("This project is not licensed under the MIT license", "unknown"), ("Dieses Werk ist unter einer freien Lizenz", "unknown"), ("SPDX-License-Identifier: GPL-2.0", "GPL"),
])
def test_short_forms_and_denials(spark, line, family):
    assert lic.scan_licenses(spark.createDataFrame([(1, line)], "doc_id bigint, text string")).first()["license"] == family


def brute_licenses(text, model):
    """The scan of one text in plain Python: ``(license, licenses, n_licensed, n_unknown)``."""
    import re

    lines, seen = (text or "").split("\n"), []
    inside = lambda family, words: any(sum(f" {x} " in f" {' '.join(words)} " for x in sh) >= lic.SIMILAR * len(sh) for sh in map(lic._shingles, lic.PHRASES.get(family, [])))
    for k, line in enumerate(lines):
        if not re.search(lic.CUES, line):
            continue
        own = lic.spoken(line)
        before, after = lic.spoken(" ".join(lines[max(0, k - lic.NEAR) : k]))[-lic.REACH :], lic.spoken(" ".join(lines[k + 1 : k + 1 + lic.NEAR]))[: lic.REACH]
        best = None
        for form, words in enumerate([own, before + own + after]):
            if best or (form and not before and not after):
                continue
            hs = {model.place(g) for g in lic._grams(words)}
            z = np.array([sum(round(float(model.weights[h, c]), 5) for h in hs) + round(float(model.bias[c]), 5) for c in range(len(model.classes))])
            guess, p = model.classes[int(np.argmax(z[:-1]))], 1 - np.exp(z[-1] - z.max()) / np.exp(z - z.max()).sum()
            if p >= model.threshold and inside(guess, words) and not re.search(lic.DENIED, " ".join(own)) and not (form and (inside(guess, before) or inside(guess, after))):
                best = (guess, p)
        seen.append(best or (lic.UNKNOWN, 0.0))
    named = [f for f, _ in seen if f != lic.UNKNOWN]
    top = min(set(named), key=lambda f: (-named.count(f), -max(p for g, p in seen if g == f), f)) if named else lic.UNKNOWN if seen else None
    return top, sorted(set(named)), len(named), len(seen) - len(named)


def test_license_scan_equals_brute_force_however_rows_are_dealt(spark, sf_dir):
    model = lic.Model()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd_docs(spark).select("doc_id", "text"))
    more = [(-1, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software\n\nlicensed under the GPLv3"), (-2, "released under the MIT license\nreleased under the ISC license\nnot released under the MIT license")]
    docs = docs.union(spark.createDataFrame(more, "doc_id bigint, text string"))
    want = sorted((str((r["doc_id"], *brute_licenses(r["text"], model))) for r in docs.collect()))
    for dealt in (docs, docs.repartition(7), docs.repartition(3, "text")):
        got = lic.scan_licenses(dealt, model).collect()
        assert sorted(str((r["doc_id"], r["license"], r["licenses"], r["n_licensed"], r["n_unknown"])) for r in got) == want


def test_every_phrase_has_a_cue():
    import re

    assert all(re.search(lic.CUES, p) for ps in lic.PHRASES.values() for p in ps)


# ---- chat


def test_rendering_locates_turns_and_marks_what_rewrites(spark):
    turns = [("user", "hi"), ("assistant", "yo"), ("user", "again")]
    out, spans, rewrote = chat.locate(turns, chat.turn_template)
    assert rewrote is None and [chat.read_back(out, s)[:2] for s in spans] == turns
    ending = lambda ts: "".join(t for _, t in ts) + ("<end>" if ts else "")
    assert chat.locate(turns, ending)[2] == 1
    many = [("user" if i % 3 else "assistant", f"text {i} <") for i in range(100)]
    assert chat.locate(many, chat.turn_template, 32) == chat.locate(many, chat.turn_template) and chat.locate([], chat.turn_template, 32) == ("", [], None)


def test_a_long_conversation_costs_its_length(spark):
    import time

    start = time.monotonic()
    out, spans, _ = chat.locate([("user", "x" * 50)] * 50_000, chat.turn_template, chat.BLOCK)
    assert len(spans) == 50_000 and spans[-1][1] == len(out) and time.monotonic() - start < 30


def test_sql_and_query_agree_on_nulls_and_ties(spark):
    import duckdb

    rows = [(1, None, None, "b"), (1, None, "", "a"), (1, 2, "user", None), (1, 2, "user", ""), (1, 1, "assistant", "x"), (1, 1, "assistant", "x")]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = chat.digest(chat.format_conversations(chat.planted(conv)))
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    columns = sorted(found.columns)
    assert rows_of(found, columns) == sql_rows(con, chat.SQL, columns)


def test_chat_round_trip_of_hostile_texts(spark):
    rows = [(1, 2, "assistant", "\\### Assistant: </turn> ok"), (1, 1, None, None), (1, 1, "us:er\n", "a\\\\</turn>\n### x: y"), (None, 0, "assistant", ""), (2, None, "assistant", "é" * 20_000), (2, None, "assistant", "é" * 20_000)]
    conv = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(conv)).collect()}
    for c in (1, 2, None):
        own = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256("".join(r[3] or "" for r in own if r[2] == "assistant").encode()).hexdigest()
    assert chat.digest(chat.format_conversations(conv.where("false"))).count() == 0


# ---- addresses


def test_aliases_take_block_decisions_and_allow_goes_first(spark):
    page = lambda i, u, canonical=None: (i, u, f'<link rel="canonical" href="{canonical}">' if canonical else None, "x")
    rows = [page(1, "http://a.test/x", "http://b.com/en/1"), page(2, "http://c.test/", "http://a.test/x"), page(3, "http://d.test/", "http://e.com/en/2"), page(4, "http://f.test/", "http://e.com/en/2"), page(5, "http://f.test", "http://www.example.com/en/77"), page(6, None), page(7, "no scheme"), page(8, "HTTP://X.COM/en/?q#f"), page(8, "HTTP://X.COM/en/?q#f"), page(9, "http://com.test/en/")]
    got = {r["page_id"]: r for r in url.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string, rule string")).collect()}
    assert {i: r["verdict"] for i, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "allow"}
    assert (got[8]["host"], got[8]["path"], got[8]["rule"], got[6]["host"], got[7]["path"]) == ("x.com", "/en/", "com/en/", "", "")
    moved = spark.createDataFrame([("http://com.test/en/", "http://b.org/es/")], "from_url string, to_url string")
    assert {r["verdict"] for r in url.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string, rule string"), redirects=moved).where("page_id = 9").collect()} == {"block"}


def test_all_links_of_a_page_are_followed(spark):
    link = lambda t: f'<link rel="canonical" href="{t}">'
    rows = [
        (1, "http://x.com/a", link("/en/5"), "block"), (2, "http://q.com/en2/y", link("../en/z"), "block"), (3, "http://w.test/d/e?x#f", link("?y=2"), "block"),
        (4, "http://q.com/en3", '<link rel=canonical href="http://nowhere.test/"><link rel="alternate canonical" href="//r.com/en/9?a=1&amp;b=2">', "block"),
        (5, "http://w.test/d/e?y=2", '<meta http-equiv="refresh" content="0; url=http://s.org/es/4">', "block"), (6, "http://m.test/", link("mailto:a@b.com/en/"), "allow"), (7, "http://m.test", link("#top"), "allow"),
        (8, "http://t.test/u/v", '<META content="0;URL=w.html" HTTP-EQUIV=refresh>', "block"), (9, "http://t.test/u/w.html", link("./../u/./z"), "block"), (10, "http://t.test/u/z", "<link href='http://b.com/en/1' rel='canonical'>", "block"),
        (11, "http://rel.test/", '<link rel="noncanonical" href="http://b.com/en/1">', "allow"), (12, "zzz", link("http://b.com/en/1"), "allow"),
    ]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string")
    found = url.judge_urls(pages)
    assert {r["page_id"]: r["verdict"] for r in found.collect()} == {r[0]: r[3] for r in rows}
    import duckdb

    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    columns = sorted(found.columns)
    assert rows_of(found, columns) == sql_rows(con, url.SQL, columns)


# ---- training order


def test_carried_names_of_the_result_are_an_error(spark):
    with pytest.raises(ValueError, match="slot"):
        tok.training_order(odd_docs(spark), carry=["doc_id", "slot"])


def test_shards_are_read_from_what_was_written(spark):
    ordered = tok.training_order(odd_docs(spark), length=64, shard_rows=100, carry=["doc_id", "fp"])
    read = tok.materialise(ordered, Scratch(spark, "t"))
    assert sorted(map(str, read.collect())) == sorted(map(str, ordered.collect())) and all("shards" in f for f in read.inputFiles())


@pytest.mark.parametrize("total", [1, 2, 3, 4, 5, 17, 1000, 4097])
def test_feistel_is_a_permutation(total):
    got = tok.feistel(np.arange(total), total, key=9)
    assert sorted(got.tolist()) == list(range(total))
    assert total < 17 or (got != tok.feistel(np.arange(total), total, key=10)).any()


def test_tokens_round_trip_and_resume(spark, tmp_path):
    docs = odd_docs(spark)
    uri = f"file://{tmp_path}/shards"
    ordered = tok.training_order(docs, length=64, shard_rows=100).persist()
    rows = ordered.orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows))) and all((r["shard"], r["row_in_shard"]) == divmod(r["slot"], 100) and len(r["tokens"]) == 128 for r in rows)
    tool, end = tok.encoder()
    texts = {}
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["seq_no"])):
        if r["doc_id"] in (1, 5, 7, 8, 9, 10, 11):
            texts.setdefault(r["doc_id"], []).extend(np.frombuffer(r["tokens"], "<u2")[: r["n_tokens"]].tolist())
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(ids[-1] == end and tool.decode(ids[:-1]) == want[d] for d, ids in texts.items())
    written = {r["shard"]: r["rows"] for r in tok.write_shards(ordered, uri).collect()}
    assert sum(written.values()) == len(rows)
    shard, row = divmod(123, 100)
    data = (tmp_path / "shards" / f"shard-{shard:08d}.bin").read_bytes()
    assert (tok.read_slots(data, row, 64)[0] == np.frombuffer(rows[123]["tokens"], "<u2")).all()


# ---- mixing


@pytest.mark.parametrize("weights, period", [({"a": 3, "b": 1, "c": 96.5}, None), ({"a": 1, "b": 1000, "c": 0}, None), ({f"s{i}": 1 for i in range(20)}, None), ({"x": 2**0.5, "y": 1, "z": 3.14159}, 64)])
def test_pfair_stays_within_a_block_of_the_target_weights(spark, weights, period):
    whole = mix.whole_weights(weights)
    period = period or mix.period_of(whole)
    periods = 3 if period > 64 else 60
    rows = [tuple(r) for r in mix.schedule(spark, whole, periods, period).select("src", "turn", "slot", "release_slot", "deadline_slot").collect()]
    slots = np.arange(periods * period)
    assert sorted(r[2] for r in rows) == slots.tolist() and all(r[3] <= r[2] < r[4] for r in rows)
    for s, w in weights.items():
        own = sorted((r[2], r[1]) for r in rows if r[0] == s)
        assert [t for _, t in own] == list(range(len(own)))
        done = np.cumsum(np.isin(slots, [x for x, _ in own]))
        # two turns are a block; the weight is the target itself, not a quota
        assert np.abs(done - w / sum(weights.values()) * (slots + 1)).max() < 2


def _sources(spark, **sizes):
    at, rows = 0, []
    for s, n in sizes.items():
        rows += [(at + i, f"t{at + i}", "en", s) for i in range(n)]
        at += n
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def test_mixing_loses_nothing_and_has_one_row_a_position(spark):
    docs = odd_docs(spark).union(spark.range(100, 400).select(F.col("id"), F.lit("t"), F.lit("en"), F.when(F.col("id") % 3 == 0, "s").otherwise("big"), *[F.lit(None)] * 8))
    got = mix.mix_sources(docs, block_docs=4, carry=["text"]).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in docs.collect()}
    assert len({r["position"] for r in got}) == len(got) and all(r["release_slot"] <= r["slot"] < r["deadline_slot"] for r in got if r["in_mix"])
    assert sum(r["epoch"] == 0 for r in got) == docs.count()


def test_mixing_with_extreme_weights_is_bounded_and_whole(spark):
    docs = _sources(spark, a=400, b=400, c=30)
    got = mix.mix_sources(docs, weights={"a": 0.99, "b": 0.01}, block_docs=4, max_epochs=3).collect()
    assert len(got) <= 3 * 830 and {r["doc_id"] for r in got} == set(range(830))
    assert len({r["position"] for r in got}) == len(got)
    assert not any(r["in_mix"] for r in got if r["source"] == "c") and any(r["in_mix"] for r in got if r["source"] == "b")
    inside = [r["source"] for r in sorted(got, key=lambda r: r["position"]) if r["in_mix"]]
    assert abs(inside.count("a") / len(inside) - 0.99) < 0.01 and max(r["position"] for r in got if r["in_mix"]) < min(r["position"] for r in got if not r["in_mix"])
    only = mix.mix_sources(docs, weights={"a": 0}, block_docs=4).collect()
    assert len(only) == 830 and not any(r["in_mix"] for r in only)


# ---- empty tables


def test_empty_tables(spark):
    docs = empty_docs(spark)
    none = spark.createDataFrame([], "item_id bigint, text string")
    frames = [ex.exact_dedup(docs), sim.simhash_dedup(docs), dec.scan_documents(docs, none), lang.identify(docs, lang.train(docs)), lic.scan_licenses(docs), mix.mix_sources(docs), tok.training_order(docs), tox.score_documents(docs, None), url.judge_urls(spark.createDataFrame([], "page_id bigint, url string, html string"))]
    assert [f.count() for f in frames] == [0] * len(frames)
    assert dec.scan_documents(odd_docs(spark), none).where("n_hit > 0").count() == 0


def test_odd_table_passes_the_rest(spark):
    docs = odd_docs(spark)
    assert lic.scan_licenses(docs).count() == 12 and mix.mix_sources(docs).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
