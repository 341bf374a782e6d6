"""Mixing sources to target weights by Pfair scheduling (DataFrame operations only).

Each source is cut into turns of ``block_docs / 2`` documents, two to a block, in the order of
the MD5 of their ids. Turn i (from 0) of a source that has q of a period's P slots is released
at floor(i * P / q) and due at ceil((i + 1) * P / q); slot by slot, the released turn with
the earliest deadline goes next. So each source stays within one turn of its quota.

Quotas are differences of cumulative exact targets: of the first k * P slots, the sources up
to s in name order have ``floor(k * P * (weights up to s) / (all weights))``, in integers. No
rounding is ever repeated: after any number of periods a source is within one turn of its
target weight, so in every prefix it is within two turns, which is one block. A period is a
row of a table; its schedule is one aggregate over its slots in that row, and periods run side
by side. A period is long enough that the least weight has a slot in it. Work grows with slots
times sources: sources are meant to be some hundreds, those that someone sets weights for.

The mixture ends with the slot in which the last source with a weight has been used once, and
in any case before a source would start epoch ``max_epochs``. Documents that it hasn't used by
then, and those of sources of weight 0, follow behind it, once each, with ``in_mix`` false and
no slot. No document is lost, and none appears more than ``max_epochs`` times.

Ranks inside a source come from two levels of counts, by ranges of the MD5, so that a source
with a third of all rows is spread over many tasks. Turns find their slots by an equi-join.

A null source is a source of its own, named ''. Repeated rows are rows of their own. Null ids
are ordered by a hash of their row's plain columns. Extra columns pass through in ``carry``. An
empty table gives no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import AtomicType

from cairn.plans.durable import Scratch

#: A slot-by-slot aggregate copies what it has so far: it runs over lots of this many slots.
_LOT = 1024


def tempered(counts: dict[str, int], power: float) -> dict[str, int]:
    """Target weights, as integers, in proportion to a power of the counts; 1 keeps the observed shares."""
    return {s: math.floor(n**power * (1 << 20) + 0.5) for s, n in counts.items()}


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Weights as integers in the same proportions, to one part in 2**40 of the greatest."""
    if any(w < 0 or not math.isfinite(w) for w in weights.values()):
        raise ValueError("weights are finite and not negative")
    top = max(weights.values(), default=0)
    return {s: math.floor(w / top * (1 << 40) + 0.5) if top else 0 for s, w in weights.items()}


def period_of(weights: dict[str, int]) -> int:
    """Slots of a period: a power of two, 16 or more a source, and at least one for the least weight."""
    least = min((w for w in weights.values() if w), default=1)
    need = max(_LOT, 16 * len(weights), -(-sum(weights.values()) // least))
    return 1 << (need - 1).bit_length()


def _literal_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table from a JSON literal: the plan has no Python rows."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def schedule(spark: SparkSession, weights: dict[str, int], periods: int, period: int | None = None) -> DataFrame:
    """``(src, turn, slot, release_slot, deadline_slot)`` of the first ``periods`` periods; sources of weight 0 have none."""
    names = sorted(s for s, w in weights.items() if w)
    period = period or period_of(weights)
    total, up_to = sum(weights.values()), [0]
    for s in names:
        up_to.append(up_to[-1] + weights[s])
    if not names or periods < 1:
        return _literal_table(spark, [], "src string, turn bigint, slot bigint, release_slot bigint, deadline_slot bigint")
    # targets need more than 64 bits: weights have up to 40, slots as many again
    share = f"transform(array({', '.join(f'{u}BD' for u in up_to)}), u -> cast(u as decimal(19,0)) * cast(slots as decimal(18,0)) div {total}BD)"
    had = spark.range(periods).select(F.col("id").alias("k"), F.expr(share.replace("slots", f"id * {period}")).alias("a"), F.expr(share.replace("slots", f"(id + 1) * {period}")).alias("b"))
    idx = f"sequence(0, {len(names) - 1})"
    plans = had.select("k", F.expr(f"transform({idx}, i -> a[i + 1] - a[i])").alias("first"), F.expr(f"transform({idx}, i -> b[i + 1] - b[i] - a[i + 1] + a[i])").alias("q"))
    lots = -(-period // _LOT)
    pick = f"""array_min(transform({idx}, i -> if(s.c[i] < q[i] and s.c[i] * {period} div q[i] <= t, struct(((s.c[i] + 1) * {period} + q[i] - 1) div q[i] as due, i as i), null))).i"""
    slot = f"""aggregate(array({pick}), s, (w, p) -> named_struct('c', transform(w.c, (x, i) -> if(i = p, x + 1, x)), 'picks', concat(w.picks, array(p))))"""
    lot = f"""aggregate(sequence(l * {_LOT}L, l * {_LOT}L + {min(period, _LOT) - 1}L), named_struct('c', w0.c, 'picks', cast(array() as array<int>)), (s, t) -> {slot})"""
    grown = f"""aggregate(array({lot}), w0, (w1, d) -> named_struct('c', d.c, 'lots', concat(w1.lots, array(d.picks))))"""
    whole = f"""aggregate(sequence(0L, {lots - 1}L), named_struct('c', transform(q, x -> 0L), 'lots', cast(array() as array<array<int>>)), (w0, l) -> {grown}, w0 -> flatten(w0.lots))"""
    # one row a period to a task's lot of rows: the schedule is worked out where the row is
    picked = plans.repartition(max(1, min(periods, 4096)), "k").select("k", "first", "q", F.expr(whole).alias("picks"))
    # outer: of an inner one Spark would infer a filter that works the schedule out a second time
    each = picked.select("k", "first", "q", F.posexplode_outer("picks").alias("t", "i"))
    at = F.row_number().over(Window.partitionBy("k", "i").orderBy("t")) - 1  # a period's slots of one source: bounded by the period
    placed = each.withColumn("j", at).select("i", "k", F.col("j").cast("bigint").alias("j"), F.expr("first[i]").alias("f"), F.expr("q[i]").alias("q"), F.col("t").cast("bigint").alias("t"))
    named = F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)
    return placed.select(
        named.alias("src"), (F.col("f") + F.col("j")).alias("turn"), (F.col("k") * period + F.col("t")).alias("slot"),
        F.expr(f"k * {period} + j * {period} div q").alias("release_slot"), F.expr(f"k * {period} + ((j + 1) * {period} + q - 1) div q").alias("deadline_slot"),
    )


def source_rank(docs: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``: the document's place, from 0, in its source ``src`` by ``(md5, id)``.

    The MD5's leading digits cut each source into about sqrt(total) ranges; ranks inside a
    range and the ranges' offsets are two windows, and neither sees more than about
    sqrt(total) rows of one source.
    """
    ranges = max(1, math.isqrt(total))
    docs = docs.withColumn("range", F.expr(f"cast(conv(substr(md5, 1, 8), 16, 10) as bigint) * {ranges} div 4294967296"))
    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = docs.groupBy("src", "range").count().select("src", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("src", "range").orderBy("md5", F.col("id").asc_nulls_first())
    return docs.withColumn("at", F.row_number().over(inside) - 1).join(offsets, ["src", "range"]).withColumn("rank", F.col("offset") + F.col("at"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.9, block_docs: int = 16, max_epochs: int = 8, period: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """``(doc_id, source, in_mix, epoch, block, release_slot, deadline_slot, slot, position)`` and the columns of ``carry``.

    weights: by source name ('' for null), a missing one is 0; the default is the power of the
    counts. position numbers the rows of the mixture with a document's place for each slot.
    """
    if block_docs < 2 or block_docs % 2:
        raise ValueError("a block is two turns of equal size")
    spark, size = docs.sparkSession, block_docs // 2
    src = F.coalesce("source", F.lit(""))
    counts = {r["src"]: r["count"] for r in docs.groupBy(src.alias("src")).count().collect()}  # a row per source
    target = whole_weights({s: weights.get(s, 0) for s in counts}) if weights is not None else tempered(counts, power)
    period = period or period_of(target)
    turns, total = {s: -(-n // size) for s, n in counts.items()}, sum(target.values())
    used = [s for s in counts if target[s]]
    # a turn is within two of its target: so many slots hold every turn that decides where the mixture ends
    slots = min(max((-(-(turns[s] + 2) * total // target[s]) for s in used), default=0), min((-(-(max_epochs * turns[s] + 3) * total // target[s]) for s in used), default=0))
    scratch = Scratch(spark, "mixing")
    plan = scratch.keep(schedule(spark, target, -(-slots // period), period), "schedule")
    per = _literal_table(spark, [{"src": s, "turns": turns[s]} for s in sorted(counts)], "src string, turns bigint")
    marks = plan.join(F.broadcast(per), "src").agg(F.max(F.when(F.col("turn") == F.col("turns") - 1, F.col("slot"))).alias("once"), F.min(F.when(F.col("turn") == max_epochs * F.col("turns"), F.col("slot"))).alias("again")).first()
    end = min(marks["once"] if marks["once"] is not None else -1, marks["again"] - 1 if marks["again"] is not None else 1 << 62)
    plan = plan.where(F.col("slot") <= end)
    had = {r["src"]: r["count"] for r in plan.groupBy("src").count().collect()}  # a row per source
    rows, behind = [], (end + 1) * size
    for s in sorted(counts):
        rows.append({"src": s, "turns": turns[s], "used": had.get(s, 0), "behind": behind - had.get(s, 0) * size})
        behind += max(0, turns[s] - had.get(s, 0)) * size
    per = F.broadcast(_literal_table(spark, rows, "src string, turns bigint, used bigint, behind bigint"))  # a row per source
    carry = carry or []
    plain = [c for c in docs.columns if c not in ("doc_id", "source") and isinstance(docs.schema[c].dataType, AtomicType)]
    key = F.coalesce(F.col("doc_id").cast("string"), F.hex(F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in plain])))
    ranked = source_rank(docs.select(src.alias("src"), F.col("doc_id").alias("id"), F.md5(key).alias("md5"), F.struct("doc_id", "source", *carry).alias("doc")), sum(counts.values()))
    cut = ranked.join(per, "src").withColumn("own", F.expr(f"rank div {size}"))
    # turn ``own`` is used as the source's turn epoch * turns + own, while that is below ``used``; one that never is stands behind
    out = cut.select("*", F.explode(F.expr("sequence(0L, if(own < used, (used - 1 - own) div turns, 0L))")).alias("epoch"))
    out = out.withColumn("turn", F.expr("epoch * turns + own")).join(plan, ["src", "turn"], "left")
    return out.select(
        F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), F.col("slot").isNotNull().alias("in_mix"), "epoch", F.expr("own div 2").alias("block"),
        "release_slot", "deadline_slot", "slot",
        F.coalesce(F.expr(f"slot * {size} + rank % {size}"), F.col("behind") + F.col("rank")).alias("position"),
        *[F.col(f"doc.{c}").alias(c) for c in carry],
    )


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS src,
         row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id NULLS FIRST) - 1 AS rank
  FROM documents),
n AS (SELECT src, (count(*) + 7) // 8 AS turns, CAST(floor(pow(count(*), 0.9) * 1048576 + 0.5) AS HUGEINT) AS w FROM d GROUP BY src),
m AS (SELECT CAST(pow(2, ceil(log2(greatest(1024, 16 * count(*), (sum(w) + min(w) - 1) // greatest(min(w), 1))))) AS BIGINT) AS period, sum(w) AS total FROM n),
cum AS (SELECT src, turns, w, row_number() OVER (ORDER BY src) AS i, CAST(sum(w) OVER (ORDER BY src) AS HUGEINT) AS up, CAST(sum(w) OVER (ORDER BY src) AS HUGEINT) - w AS below FROM n),
len AS (SELECT CAST((least(max(((turns + 2) * total + w - 1) // w), min(((8 * turns + 3) * total + w - 1) // w)) + any_value(period) - 1) // any_value(period) AS BIGINT) AS periods FROM cum, m),
quota AS (
  SELECT k, i, src, turns, period, CAST(up * k * period // total - below * k * period // total AS BIGINT) AS first,
         CAST(up * (k + 1) * period // total - below * (k + 1) * period // total - up * k * period // total + below * k * period // total AS BIGINT) AS q
  FROM cum, m, (SELECT unnest(range(0, periods)) AS k FROM len)),
lists AS (SELECT k, list(q ORDER BY i) AS qs, any_value(period) AS period FROM quota GROUP BY k),
edf(k, t, c, pick) AS (
  SELECT k, CAST(-1 AS BIGINT), list_transform(qs, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM lists
  UNION ALL
  SELECT k, t + 1, list_transform(range(1, len(c) + 1), lambda i: c[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p
  FROM (SELECT e.k, t, c, qs, (list_sort(list_transform(list_filter(range(1, len(qs) + 1), lambda i: c[i] < qs[i] AND c[i] * period // qs[i] <= t + 1),
                   lambda i: {'due': ((c[i] + 1) * period + qs[i] - 1) // qs[i], 'i': i}))[1]).i AS p
        FROM edf e JOIN lists l ON l.k = e.k WHERE t + 1 < period)),
picks AS (SELECT k, pick, t, row_number() OVER (PARTITION BY k, pick ORDER BY t) - 1 AS j FROM edf WHERE pick > 0),
placed AS (
  SELECT q.src, q.turns, q.first + p.j AS turn, q.k * q.period + p.t AS slot, q.k * q.period + p.j * q.period // q.q AS release_slot,
         q.k * q.period + ((p.j + 1) * q.period + q.q - 1) // q.q AS deadline_slot
  FROM picks p JOIN quota q ON q.k = p.k AND q.i = p.pick),
ends AS (SELECT least(max(slot) FILTER (WHERE turn = turns - 1), coalesce(min(slot) FILTER (WHERE turn = 8 * turns) - 1, 4611686018427387904)) AS e FROM placed),
mix AS (SELECT placed.* FROM placed, ends WHERE slot <= e),
used AS (SELECT src, count(*) AS used FROM mix GROUP BY src),
per AS (SELECT n.src, n.turns, coalesce(used, 0) AS used,
          (e + 1) * 8 + 8 * coalesce(sum(greatest(0, n.turns - coalesce(used, 0))) OVER (ORDER BY n.src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 8 * coalesce(used, 0) AS behind
        FROM n LEFT JOIN used USING (src), ends),
turned AS (SELECT d.doc_id, d.source, d.src, d.rank, p.behind, d.rank // 8 AS own, g.epoch, g.epoch * p.turns + d.rank // 8 AS turn
          FROM d JOIN per p USING (src), LATERAL (SELECT unnest(generate_series(0, CASE WHEN d.rank // 8 < p.used THEN (p.used - 1 - d.rank // 8) // p.turns ELSE 0 END)) AS epoch) g)
SELECT t.doc_id, t.source, m.slot IS NOT NULL AS in_mix, t.epoch, t.own // 2 AS block, m.release_slot, m.deadline_slot, m.slot,
       CAST(coalesce(m.slot * 8 + t.rank % 8, t.behind + t.rank) AS BIGINT) AS position
FROM turned t LEFT JOIN mix m ON m.src = t.src AND m.turn = t.turn
"""
