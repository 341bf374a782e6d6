"""Observations, their evaluation, and states of contradictions, on rows worked out by hand and by plain replays."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import entities as ent, text as tx
from cairn.operators import extraction as ex, fulltext as ft, governance as gov, graph as gr
from cairn.operators.components import connected_components
from cairn.plans.durable import Scratch


@pytest.mark.parametrize("language, text, kinds", [
    ("en", "We decided to ship. Please send it! Who knows? The sky is blue. ok", ["decision", "task", "question", "fact"]),
    ("en", "Review the draft\nIt was signed off", ["task", "decision"]), ("es", "Fue aprobada ayer. Revisa el texto. Por favor, ven.", ["decision", "task", "task"]),
    ("fr", "Nous avons décidé. Merci de venir. Vérifie le plan.", ["decision", "task", "task"]), ("de-AT", "Es wurde beschlossen. Prüfe den Plan. Bitte kommen.", ["decision", "task", "task"]),
    ("ja", "予算は承認されました。資料をお願いします。", ["decision", "task"]), ("zh", "我们决定了。请跟进。", ["decision", "task"]), ("ar", "قررنا ذلك. والراجع الآن.", ["decision", "task"]),
    ("xx", "it was rejected", ["decision"]), (None, "please do", ["task"]), ("en", "", []), ("en", None, []),
])
def test_sentences_are_what_their_language_says(spark, language, text, kinds):
    docs = spark.createDataFrame([(1, text, language, "extra")], "doc_id int, text string, language_tag string, kind string")
    got = ex.observations(docs).collect()
    assert sorted(r["kind"] for r in got) == sorted(kinds) and all(r["confidence"] == ex.SURE[r["kind"]] for r in got)


@pytest.mark.parametrize("text, kind", [("todo: what?", "task"), ("What now", "question"), ("we agreed", "decision"), ("a reminder", "task"), ("service restored", "fact"), ("lol that", "noise"), ("plain words", "fact"), ("action item: decided", "task")])
def test_turns_are_judged_by_the_first_rule_that_fits(spark, text, kind):
    assert spark.range(1).select(ex.turn_kind(F.lit(text))).first()[0] == kind


def test_scores_have_zero_guards(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("a", None), (None, "d")]
    got = {r["kind"]: r for r in ex.scores(ex.confusion(spark.createDataFrame(rows, "e string, p string"), "e", "p")).collect()}
    assert {k: (r["tp"], r["fp"], r["fn"]) for k, r in got.items()} == {"a": (1, 0, 2), "b": (1, 2, 0), "c": (0, 0, 1), "d": (0, 1, 0)}
    assert (got["c"]["precision"], got["c"]["recall"], got["c"]["f1"], got["d"]["f1"]) == (0, 0, 0, 0) and abs(got["a"]["f1"] - 0.5) < 1e-9
    counts = spark.createDataFrame([("a", 1, 0, 2), ("c", 0, 0, 1)], "kind string, tp long, fp long, fn long")
    assert ex.macro_f1(counts).first()[0] == 0.25 and ex.macro_f1(counts.where("false")).first()[0] == 0


def test_adjudication_equals_a_replay(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.choice(["detect", "review", "resolve"]), t) for t in range(300)]
    want: dict[int, list] = {}
    early: dict[int, int] = {}
    for i, kind, _ in rows:
        case = want.get(i)
        if case is None:
            if kind == "detect":
                want[i] = ["detected", early.get(i, 0)]
            else:
                early[i] = early.get(i, 0) + 1
        elif kind == "review" and case[0] == "detected":
            case[0] = "under_review"
        elif kind == "resolve" and case[0] != "resolved":
            case[0] = "resolved"
        else:
            case[1] += 1
    got = gr.adjudicate(spark.createDataFrame(rows, "id int, kind string, t int")).collect()
    assert {r["id"]: [r["state"], r["refused"]] for r in got} == want


def test_nodes_are_added_once(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    new = spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], "id string, n int")
    assert sorted(map(tuple, gr.add_nodes(old, new).collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_content_of_another_scope_is_a_leak(spark):
    rows = [(1, "s1", "h", 5), (2, "s2", "h", 6), (3, "s2", "h", 7), (4, "s2", "g", 1)]
    got = gov.leaks(spark.createDataFrame(rows, "evidence_id int, scope_id string, content_hash string, created_at int")).collect()
    assert [(r["scope_id"], r["leaks"]) for r in got] == [("s2", 2)]


def test_both_kinds_of_ip_addresses(spark):
    text = "from 10.0.0.1, 300.1.1.1 and 2001:0DB8:85a3:0000:0000:8a2e:0370:7334!"
    assert spark.range(1).select(ent.found(F.lit(text), "ip")).first()[0] == ["10.0.0.1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"]


@pytest.mark.parametrize("text, n, runs", [("abcd", 3, ["abc", "bcd"]), ("ab", 3, []), ("", 2, []), ("会議𠀀室", 2, ["会議", "議𠀀", "𠀀室"]), ("abc", 1, ["a", "b", "c"])])
def test_runs_of_characters(spark, text, n, runs):
    assert spark.range(1).select(tx.ngrams(F.lit(text), n)).first()[0] == runs


def test_search_counts_overlapping_runs_and_reads_texts_once(spark):
    docs = spark.createDataFrame([(1, "aaaa x"), (2, "aaa"), (3, "none"), (4, None)], "id int, text string")
    got = {r["doc"]: r["score"] for r in ft.search(docs, "id", "text", ["aaa"], "trigram").collect()}
    assert got.keys() == {1, 2}
    n, df, avg = 4, 2, (4 + 1 + 2 + 0) / 4
    part = lambda tf, dl: max(__import__("math").log((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert abs(got[1] - part(2, 4)) < 1e-12 and abs(got[2] - part(1, 1)) < 1e-12


def test_components_with_hubs(spark):
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 400)] + [(5000, i) for i in range(4000, 4300)] + [(i, i + 1) for i in range(6000, 6040)] + [(rng.randrange(7000, 7300), rng.randrange(7000, 7300)) for _ in range(150)]
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b", Scratch(spark, "t"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in root}


def test_entities_once_each_as_the_first_kind(spark):
    rows = [(1, "Ask @bob and @bob, Bob or Anna at https://x.example/a. The cost is $5M on Monday, Q3 2026 (anna@example.com)."), (2, None), (3, ""), (4, "プロジェクト")]
    got = sorted((r["doc_id"], r["kind"], r["content"], r["confidence"]) for r in ex.entities(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    of = lambda kind: [c for d, k, c, _ in got if d == 1 and k == kind]
    assert of("mention") == ["@bob", "@example"] and of("url") == ["https://x.example/a"] and of("email") == ["anna@example.com"] and of("number") == ["$5M"]
    # a day is a name by its letter first, and stays what it was found as
    assert {"Anna", "Bob", "Monday"} <= set(of("name")) and "The" not in of("name") and not of("date") == ["Monday"]
    assert [(k, c) for d, k, c, _ in got if d == 4] == [("cjk_term", "プロジェクト")]
    assert not [g for g in got if g[0] in (2, 3)] and len({(d, c) for d, _, c, _ in got}) == len(got)


def test_lexicon_of_another_language(spark):
    texts = spark.createDataFrame([(1, "Foi decidido ontem. Segue a ata agora. Faz favor de ler tudo", "pt-BR"), (2, "It was decided. Please do", "xx")], "doc_id int, text string, language_tag string")
    mine = ex.LEXICON.adding("pt", ["decidido"], ["tarefa"], ["faz favor"])
    got = sorted((r["doc_id"], r["kind"], r["content"]) for r in ex.observations(texts, lexicon=mine).collect())
    assert got == [(1, "decision", "Foi decidido ontem"), (1, "fact", "Segue a ata agora"), (1, "task", "Faz favor de ler tudo"), (2, "decision", "It was decided"), (2, "task", "Please do")]
    with pytest.raises(ValueError):
        ex.Lexicon({}, {}, {})
