"""Queries over the concept graph, reasoning and synthesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import graph as gr, synthesis as sy
from cairn.operators.relational import count_where, latest, top_per, where_equal, without
from cairn.plans.durable import Scratch
from cairn.plans.text_queries import QCLASS
from cairn.registry import AS_OF, query

# ---- graph

query("sink.graph_add_node", "SELECT id, label FROM nodes UNION ALL SELECT * FROM (SELECT 'n' || CAST(n_nationkey + 20 AS VARCHAR) AS id, 'new ' || n_name AS label FROM nation) WHERE id NOT IN (SELECT id FROM nodes)")(
    lambda v: gr.add_nodes(v.nodes.select("id", "label"), v.nation.select(F.concat(F.lit("n"), (F.col("n_nationkey") + 20).cast("string")).alias("id"), F.concat(F.lit("new "), "n_name").alias("label"))))
query("sink.graph_add_edge", "SELECT id FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE state <> 'superseded') OR dst NOT IN (SELECT id FROM nodes WHERE state <> 'superseded')")(lambda v: gr.dangling(v.edges, v.nodes.where("state <> 'superseded'")))
query("sink.graph_remove_node", "SELECT id FROM edges WHERE src <> 'n3' AND dst <> 'n3'")(lambda v: gr.remove_node(v.nodes, v.edges, "n3")[1].select("id"))
query("sec.graph_remove_edge", "SELECT id FROM edges WHERE id <> 'en3'")(lambda v: v.edges.where("id <> 'en3'").select("id"))
query("sec.graph_count_scope", "SELECT scope_id, count(*) AS n FROM nodes GROUP BY scope_id")(lambda v: v.nodes.groupBy("scope_id").agg(F.count("*").alias("n")))
query("sec.graph_edge_count", "SELECT scope_id, count(*) AS n FROM edges GROUP BY scope_id")(lambda v: v.edges.groupBy("scope_id").agg(F.count("*").alias("n")))
query("flt.edge_filter", "SELECT id FROM edges WHERE relation IN ('part_of', 'assigned_to') AND scope_id IN ('s1', 's2')")(lambda v: v.edges.where(gr.edge_passes(["part_of", "assigned_to"], ["s1", "s2"])).select("id"))
query("flt.view_filter", "SELECT id FROM nodes WHERE state IN ('canonical', 'candidate') AND scope_id IN (SELECT scope_id FROM nodes WHERE id IN ('n1', 'n2'))")(
    lambda v: gr.visible(v.nodes, ["canonical", "candidate"], v.nodes.where("id IN ('n1', 'n2')")).select("id"))
query("graph.neighbors", "SELECT DISTINCT dst AS id FROM edges WHERE src = 'c20' AND relation = 'part_of'")(lambda v: gr.neighbours(v.edges, "c20", "part_of"))
query("graph.get_edges", "SELECT id, CASE WHEN src = 'n4' THEN 0 ELSE 1 END AS place FROM edges WHERE src = 'n4' OR dst = 'n4'")(lambda v: gr.incident(v.edges, "n4").select("id", "place"))
query("graph.expand", "SELECT id, CASE WHEN src = 'n4' THEN dst ELSE src END AS \"to\" FROM edges WHERE src = 'n4' OR dst = 'n4'")(lambda v: gr.directed(v.edges, "both").where(F.col("from") == "n4").select("id", "to"))
_BFS = """WITH RECURSIVE walk(start, id, depth) AS (SELECT id, id, 0 FROM nodes WHERE {start} UNION SELECT w.start, e.{to}, w.depth + 1 FROM walk w JOIN edges e ON e.{frm} = w.id WHERE w.depth < {depth} AND {ok})
    SELECT start, id, min(depth) AS depth FROM walk GROUP BY start, id"""
_starts = lambda v, where: v.nodes.where(where).select("id")
query("graph.traverse_typed", _BFS.format(start="id IN ('c50', 'c51', 'c90')", to="dst", frm="src", depth=4, ok="e.relation = 'derived_from'"))(
    lambda v: gr.traverse(v.edges, _starts(v, "id IN ('c50', 'c51', 'c90')"), 4, Scratch(v.spark, "walk"), "out", ["derived_from"]).select("start", "id", "depth"))
query("graph.traverse", _BFS.format(start="id IN ('c50', 'n3')", to="dst", frm="src", depth=3, ok="true"))(lambda v: gr.traverse(v.edges, _starts(v, "id IN ('c50', 'n3')"), 3, Scratch(v.spark, "walk")).select("start", "id", "depth"))
query("graph.affected", _BFS.format(start="id IN ('c43', 'c50')", to="src", frm="dst", depth=3, ok="e.relation = 'derived_from'"))(
    lambda v: gr.traverse(v.edges, _starts(v, "id IN ('c43', 'c50')"), 3, Scratch(v.spark, "walk"), "in", ["derived_from"]).select("start", "id", "depth"))
query("graph.recompute", "SELECT id, row_number() OVER (ORDER BY depth, id) AS place FROM (" + _BFS.format(start="id = 'c43'", to="src", frm="dst", depth=3, ok="e.relation = 'derived_from'").replace("WITH RECURSIVE", "WITH RECURSIVE") + ")")(
    lambda v: top_per(gr.traverse(v.edges, _starts(v, "id = 'c43'"), 3, Scratch(v.spark, "walk"), "in", ["derived_from"]), [], [F.col("depth"), F.col("id")], 1_000_000, rank="place").select("id", "place"))
query("graph.propagate", "SELECT depth, count(*) AS touched FROM (" + _BFS.format(start="id = 'n3'", to="src", frm="dst", depth=2, ok="true") + ") GROUP BY depth")(
    lambda v: gr.traverse(v.edges, _starts(v, "id = 'n3'"), 2, Scratch(v.spark, "walk"), "in").groupBy("depth").agg(F.count("*").alias("touched")))
_BOTH = """WITH RECURSIVE shown AS (SELECT id FROM nodes WHERE state = 'canonical'), steps AS (SELECT src AS f, dst AS t FROM edges WHERE src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown) UNION ALL SELECT dst, src FROM edges WHERE src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown)),
    walk(id, depth) AS (SELECT id, 0 FROM shown WHERE id = '{start}' UNION SELECT s.t, w.depth + 1 FROM walk w JOIN steps s ON s.f = w.id WHERE w.depth < {depth}) SELECT id, min(depth) AS depth FROM walk GROUP BY id ORDER BY depth, id LIMIT {cap}"""
for _op, _start, _depth, _cap in (("graph.explore", "n3", 2, 40), ("graph.neighborhood", "n7", 1, 256), ("sec.explore_from", "r1", 2, 60)):
    query(_op, _BOTH.format(start=_start, depth=_depth, cap=_cap))(lambda v, s=_start, d=_depth, c=_cap: gr.explore(gr.visible(v.nodes, ["canonical"]), v.edges, s, d, c, Scratch(v.spark, "explore")))
_PARTS = """WITH RECURSIVE own AS (SELECT id FROM nodes WHERE state = 'canonical'), e AS (SELECT src AS a, dst AS b FROM edges WHERE relation = 'derived_from' AND src IN (SELECT id FROM own) AND dst IN (SELECT id FROM own)),
    s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach(a, b) AS (SELECT id, id FROM own UNION SELECT r.a, s.b FROM reach r JOIN s ON s.a = r.b), parts AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)"""
_derived = lambda v: v.edges.where("relation = 'derived_from'")
_parts = lambda v: gr.communities(v.nodes, _derived(v), Scratch(v.spark, "communities"))
query("graph.components", _PARTS + " SELECT id, component FROM parts")(_parts)
query("agg.community_members", _PARTS + " SELECT p.component, count(*) AS members, count(DISTINCT n.scope_id) AS scopes, min(n.label) AS label FROM parts p JOIN nodes n ON n.id = p.id GROUP BY p.component")(
    lambda v: _parts(v).join(v.nodes, "id").groupBy("component").agg(F.count("*").alias("members"), F.countDistinct("scope_id").alias("scopes"), F.min("label").alias("label")))
query("join.community_edges", _PARTS + " SELECT e.id, p.component FROM edges e JOIN parts p ON p.id = e.src JOIN parts q ON q.id = e.dst WHERE p.component = q.component")(
    lambda v: (lambda p: v.edges.join(p.select(F.col("id").alias("src"), "component"), "src").join(p.select(F.col("id").alias("dst"), "component"), ["dst", "component"]).select("id", "component"))(_parts(v)))
query("agg.community_summary", _PARTS + " SELECT p.component, string_agg(n.label, ', ' ORDER BY n.label, n.id) AS concepts FROM parts p JOIN nodes n ON n.id = p.id GROUP BY p.component HAVING count(*) > 1")(
    lambda v: _parts(v).join(v.nodes, "id").groupBy("component").agg(F.array_sort(F.collect_list(F.struct("label", "id"))).alias("c")).where("size(c) > 1").select("component", F.array_join(F.transform("c", lambda x: x["label"]), ", ").alias("concepts")))
query("sec.summarise_all", _PARTS + " SELECT component, count(*) AS members FROM parts GROUP BY component")(lambda v: _parts(v).groupBy("component").agg(F.count("*").alias("members")))
query("sec.hierarchy_level", _PARTS + " SELECT component FROM parts GROUP BY component HAVING count(*) >= 3")(lambda v: _parts(v).groupBy("component").agg(F.count("*").alias("n")).where("n >= 3").select("component"))
query("agg.community_hierarchy", _PARTS + " SELECT n.scope_id, count(DISTINCT p.component) AS communities FROM parts p JOIN nodes n ON n.id = p.id GROUP BY n.scope_id")(
    lambda v: _parts(v).join(v.nodes, "id").groupBy("scope_id").agg(F.countDistinct("component").alias("communities")))
query("join.subgraph_edges", "SELECT id FROM edges WHERE src IN (SELECT id FROM nodes WHERE scope_id = 's1') AND dst IN (SELECT id FROM nodes WHERE scope_id = 's1')")(lambda v: gr.inner_edges(v.edges, where_equal(v.nodes, scope_id="s1")).select("id"))
query("graph.degrees", "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id")(lambda v: gr.degrees(v.edges))
query("graph.supersede", "SELECT id, CASE WHEN id IN (SELECT src FROM edges WHERE relation = 'derived_from' AND src <> dst) THEN 'superseded' ELSE state END AS state FROM nodes")(
    lambda v: gr.supersede(v.nodes, _derived(v).select(F.col("src").alias("predecessor"), F.col("dst").alias("successor"))).select("id", "state"))
_CORE = "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(label, ' (never|not|no longer)', '', 'g'), 'n''t', ''), '[.!]$', ''), '^ +| +$', ''))"
_NEG = "CASE WHEN label LIKE '%never not%' THEN false ELSE regexp_matches(label, ' not | no longer |n''t') END"
_CONTRA = f"(SELECT least(a.id, b.id) AS left_id, greatest(a.id, b.id) AS right_id, a.core FROM (SELECT *, {_CORE} AS core, {_NEG} AS neg FROM claims WHERE state = 'canonical') a JOIN (SELECT *, {_CORE} AS core, {_NEG} AS neg FROM claims WHERE state = 'canonical') b ON a.scope_id = b.scope_id AND a.core = b.core AND NOT a.neg AND b.neg)"
query("join.contradiction_pairs", f"SELECT left_id, right_id, core FROM {_CONTRA}")(lambda v: gr.contradictions(v.claims))
query("graph.contradict", f"SELECT id, CASE WHEN id IN (SELECT left_id FROM {_CONTRA} UNION SELECT right_id FROM {_CONTRA}) THEN 'contradicted' ELSE state END AS state FROM claims")(
    lambda v: (lambda p: v.claims.join(p.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct().withColumn("k", F.lit(True)), "id", "left").select("id", F.when(F.col("k"), "contradicted").otherwise(F.col("state")).alias("state")))(gr.contradictions(v.claims)))
query("agg.contradiction_rate", f"SELECT count(*) AS truth, count(p.left_id) AS found, round(count(p.left_id) / count(*), 6) AS rate FROM (SELECT 'a' || n_nationkey AS l, 'b' || n_nationkey AS r FROM nation) t LEFT JOIN {_CONTRA} p ON p.left_id = t.l AND p.right_id = t.r")(
    lambda v: v.nation.select(F.concat(F.lit("a"), F.col("n_nationkey")).alias("left_id"), F.concat(F.lit("b"), F.col("n_nationkey")).alias("right_id")).join(gr.contradictions(v.claims), ["left_id", "right_id"], "left").agg(F.count("*").alias("truth"), F.count("core").alias("found")).withColumn("rate", F.round(F.col("found") / F.col("truth"), 6)))
query("set.pair_intersection", f"SELECT left_id, right_id FROM {_CONTRA} INTERSECT SELECT 'a' || n_nationkey, 'b' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0")(
    lambda v: gr.contradictions(v.claims).select("left_id", "right_id").intersect(v.nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("a"), F.col("n_nationkey")), F.concat(F.lit("b"), F.col("n_nationkey")))))
query("sec.prefix_negation", "SELECT n_nationkey AS left_id, n_nationkey + 100 AS right_id FROM nation WHERE n_nationkey % 3 = 0")(
    lambda v: gr.prefix_negations(v.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")).union(v.nation.where("n_nationkey % 3 = 0").select(F.col("n_nationkey") + 100, F.concat(F.lit("Not "), F.lower("n_name"))))))
_SNAP = "SELECT m.id, s.b AS baseline, m.state FROM memory m JOIN (SELECT id, list(source ORDER BY source) AS b FROM memory_sources GROUP BY id) s ON s.id = m.id"
_RATIO = "len([x for x in b if CAST(x AS BIGINT) % 4 = 0])"


def snapshots(v):
    base = v.memory_sources.groupBy("id").agg(F.array_sort(F.collect_list("source")).alias("baseline"))
    by = lambda r, m=4: F.filter("baseline", lambda s: s.cast("bigint") % m == r)
    return base.select("id", "baseline", by(0).alias("removed"), by(1).alias("superseded"), F.array_except(F.array_except(F.col("baseline"), by(0)), by(1)).alias("still_valid"))


query("graph.drift", "SELECT id, CASE WHEN r > 0 THEN 'evidence_removed' WHEN s > 0 THEN 'evidence_superseded' END AS reason, n AS at_promotion, n - r - s AS remaining FROM (SELECT id, count(*) AS n, count(*) FILTER (WHERE CAST(source AS BIGINT) % 4 = 0) AS r, count(*) FILTER (WHERE CAST(source AS BIGINT) % 4 = 1) AS s FROM memory_sources GROUP BY id) WHERE r > 0 OR s > 0")(
    lambda v: gr.drift(snapshots(v)))
query("join.drift_partition", "SELECT id, count(*) FILTER (WHERE CAST(source AS BIGINT) % 4 > 1) AS removed FROM memory_sources GROUP BY id")(lambda v: snapshots(v).select("id", F.size("still_valid").cast("bigint").alias("removed")))
query("join.drift_predecessors", "SELECT a.id, count(s.source) AS evidence FROM memory a LEFT JOIN memory p ON p.superseded_by = a.id LEFT JOIN memory_sources s ON s.id = p.id GROUP BY a.id")(
    lambda v: v.memory.select("id").join(v.memory.where("superseded_by IS NOT NULL").select(F.col("id").alias("p"), F.col("superseded_by").alias("id")).join(v.memory_sources.groupBy(F.col("id").alias("p")).agg(F.count("*").alias("n")), "p").groupBy("id").agg(F.sum("n").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("evidence")))
query("nest.project_graph", "SELECT a.id AS src, a.superseded_by AS dst FROM memory a JOIN memory b ON b.id = a.superseded_by WHERE a.id <> a.superseded_by")(
    lambda v: v.memory.where("superseded_by IS NOT NULL AND id <> superseded_by").select(F.col("id").alias("src"), F.col("superseded_by").alias("dst")).join(v.memory.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
query("win.visual_search", "SELECT id FROM nodes WHERE contains(lower(label), 'an') OR contains(lower(definition), 'building') ORDER BY id LIMIT 256")(
    lambda v: v.nodes.where(F.lower("label").contains("an") | F.lower("definition").contains("building")).orderBy("id").limit(256).select("id"))
query("fn.path_score", "SELECT src AS id, round(CASE WHEN n = 0 THEN 1 ELSE greatest(pow(w, 1.0 / n) * (1 - least(0.05 * n, 1)), 0) END, 6) AS score FROM (SELECT src, count(*) AS n, product(CASE relation WHEN 'part_of' THEN 0.9 WHEN 'derived_from' THEN 0.7 ELSE 1.0 END) AS w FROM edges GROUP BY src)")(
    lambda v: v.edges.groupBy(F.col("src").alias("id")).agg(F.collect_list("relation").alias("r")).select("id", F.round(gr.path_score(F.col("r"), {"part_of": 0.9, "derived_from": 0.7}), 6).alias("score")))
query("fn.got_score", "SELECT scope_id, round(CASE WHEN c THEN least(m * pow(0.95, n - 1) + 0.1, 1) ELSE m * pow(0.95, n - 1) END, 6) AS score FROM (SELECT scope_id, avg(confidence) AS m, count(*) AS n, bool_or(sensitivity = 'critical' AND position < 50) AS c FROM concepts GROUP BY scope_id)")(
    lambda v: v.concepts.groupBy("scope_id").agg(F.collect_list("confidence").alias("c"), F.bool_or((F.col("sensitivity") == "critical") & (F.col("position") < 50)).alias("k")).select("scope_id", F.round(gr.thought_score(F.col("c"), F.col("k")), 6).alias("score")))
query("sec.thought_connect", "SELECT id FROM edges WHERE dst IN (SELECT id FROM nodes WHERE state = 'canonical')")(lambda v: v.edges.join(where_equal(v.nodes, state="canonical").select(F.col("id").alias("dst")), "dst", "left_semi").select("id"))
query("sec.graph_evidence", "SELECT e.id, round(0.9 * c.confidence, 6) AS confidence FROM edges e JOIN concepts c ON c.id = 'p' || substr(e.src, 2) WHERE e.relation = 'derived_from'")(
    lambda v: _derived(v).select("id", F.concat(F.lit("p"), F.expr("substr(src, 2)")).alias("c")).join(v.concepts.select(F.col("id").alias("c"), "confidence"), "c").select("id", F.round(0.9 * F.col("confidence"), 6).alias("confidence")))
query("sec.change_anchors", "SELECT id, unnest(CASE WHEN relation = 'part_of' THEN [src] ELSE [src, dst] END) AS anchor FROM edges")(lambda v: v.edges.select("id", F.explode(F.when(F.col("relation") == "part_of", F.array("src")).otherwise(F.array("src", "dst"))).alias("anchor")))
_CASE = "(SELECT actor AS id, CASE action WHEN 'signup' THEN 'detect' WHEN 'click' THEN 'review' WHEN 'purchase' THEN 'resolve' END AS kind, (moment, id) AS t FROM audit WHERE action IN ('signup', 'click', 'purchase'))"
query("graph.adjudicate", f"""WITH e AS {_CASE}, d AS (SELECT id, min(t) AS t FROM e WHERE kind = 'detect' GROUP BY id),
    r AS (SELECT e.id, min(e.t) AS t FROM e JOIN d ON d.id = e.id AND e.t > d.t WHERE kind = 'resolve' GROUP BY e.id),
    u AS (SELECT e.id, min(e.t) AS t FROM e JOIN d ON d.id = e.id AND e.t > d.t LEFT JOIN r ON r.id = e.id WHERE kind = 'review' AND (r.t IS NULL OR e.t < r.t) GROUP BY e.id)
    SELECT d.id, CASE WHEN r.t IS NOT NULL THEN 'resolved' WHEN u.t IS NOT NULL THEN 'under_review' ELSE 'detected' END AS state, n - 1 - CASE WHEN r.t IS NULL THEN 0 ELSE 1 END - CASE WHEN u.t IS NULL THEN 0 ELSE 1 END AS refused
    FROM d LEFT JOIN r ON r.id = d.id LEFT JOIN u ON u.id = d.id JOIN (SELECT id, count(*) AS n FROM e GROUP BY id) c ON c.id = d.id""")(
    lambda v: gr.adjudicate(v.audit.select(F.col("actor").alias("id"), F.when(F.col("action") == "signup", "detect").when(F.col("action") == "click", "review").when(F.col("action") == "purchase", "resolve").alias("kind"), F.struct("moment", "id").alias("t")).where("kind is not null")))

# ---- planning

CHAINS = {"point_lookup": ["summary", "fts", "semantic_vector", "raw_evidence"], "relational": ["graph_traversal", "fts", "raw_evidence"], "temporal": ["fts", "semantic_vector", "summary", "raw_evidence"], "holistic": ["graph_traversal", "summary", "raw_evidence"], "other": ["summary", "fts", "semantic_vector", "graph_traversal", "raw_evidence"]}
_CHAIN = "CASE class " + " ".join(f"WHEN '{c}' THEN '{'>'.join(s)}'" for c, s in CHAINS.items()) + " END"


def planned(v):
    chain = F.create_map(*[x for c, s in CHAINS.items() for x in (F.lit(c), F.lit(">".join(s)))])
    return v.texts.select("doc_id", tx.query_class(F.col("text")).alias("class")).withColumn("chain", chain[F.col("class")])


query("txt.plan", f"SELECT doc_id, class, {_CHAIN} AS chain FROM (SELECT doc_id, {QCLASS} AS class FROM texts)")(planned)
query("txt.explain", f"SELECT DISTINCT class, 'class ' || class || ': ' || {_CHAIN} AS rationale FROM (SELECT {QCLASS} AS class FROM texts)")(lambda v: planned(v).select("class", F.concat(F.lit("class "), "class", F.lit(": "), "chain").alias("rationale")).distinct())


def traces(v):
    return v.audit.groupBy(F.col("actor").alias("id"), F.col("scope_id").alias("class")).agg(F.transform(F.array_sort(F.collect_list(F.struct("moment", "id", "action"))), lambda s: F.struct(s["action"].alias("mode"), (s["action"] == "purchase").alias("ok"))).alias("steps"))


_TRACE = "(SELECT actor, scope_id AS class, list(action ORDER BY moment, id) AS steps FROM audit GROUP BY 1, 2)"
_PATTERN = f"(SELECT class, array_to_string(CASE WHEN list_position(steps, 'purchase') > 0 THEN steps[1:list_position(steps, 'purchase')] ELSE steps END, '>') AS chain, count(*) AS support, avg(CASE WHEN list_contains(steps, 'purchase') THEN 1.0 ELSE 0.0 END) AS success_rate FROM {_TRACE} GROUP BY 1, 2)"
query("agg.workflow_patterns", f"SELECT class, chain, support, round(success_rate, 6) AS success_rate FROM {_PATTERN} WHERE support >= 2")(lambda v: gr.patterns(traces(v), 2).withColumn("success_rate", F.round("success_rate", 6)))
query("agg.pattern_best", f"SELECT class, chain FROM {_PATTERN} QUALIFY row_number() OVER (PARTITION BY class ORDER BY success_rate DESC, support DESC, chain) = 1")(lambda v: gr.best_pattern(gr.patterns(traces(v), 1)).select("class", "chain"))
query("sec.plan_execute", f"SELECT actor AS id, class, list_position(steps, 'purchase') AS answered_at FROM {_TRACE} WHERE list_contains(steps, 'purchase')")(
    lambda v: traces(v).select("id", "class", F.array_position(F.transform("steps", lambda s: s["ok"]), True).alias("answered_at")).where("answered_at > 0"))
query("sec.trace_record", f"SELECT actor AS id, len(steps) AS attempts FROM {_TRACE}")(lambda v: traces(v).select("id", F.size("steps").cast("bigint").alias("attempts")))

# ---- synthesis

query("flt.election_eligible", "SELECT id FROM devices WHERE online AND NOT stepped_down AND battery >= 20 AND tier >= 1 AND 1706745600 - heartbeat_at < 300")(lambda v: v.devices.where(sy.eligible(AS_OF)).select("id"))
for _op in ("win.election", "lc.elect"):
    query(_op, "SELECT scope_id, arg_max(id, (tier, heartbeat_at, battery, id)) AS elected FROM devices WHERE online AND NOT stepped_down AND battery >= 20 AND tier >= 1 AND 1706745600 - heartbeat_at < 300 GROUP BY scope_id")(lambda v: sy.elect(v.devices, AS_OF))
_PINGS = "(SELECT 'd' || substr(actor, 5) AS id, max(moment) AS pinged, arg_max(action, (moment, id)) AS last FROM audit GROUP BY 1)"


def pings(v):
    return v.audit.groupBy(F.concat(F.lit("d"), F.substring("actor", 5, 20)).alias("id")).agg(F.max("moment").alias("at"), F.max_by("action", F.struct("moment", "id")).alias("last"))


query("sec.heartbeat", f"SELECT d.id, greatest(heartbeat_at, coalesce(pinged, heartbeat_at)) AS heartbeat_at, stepped_down AND pinged IS NULL AS stepped_down FROM devices d LEFT JOIN {_PINGS} p ON p.id = d.id")(
    lambda v: sy.heartbeat(v.devices.select("id", "heartbeat_at", "stepped_down"), pings(v).select("id", "at")))
query("sec.step_down", f"SELECT d.id, stepped_down OR coalesce(last = 'error', false) AS stepped_down FROM devices d LEFT JOIN {_PINGS} p ON p.id = d.id")(
    lambda v: sy.step_down(v.devices.select("id", "stepped_down"), pings(v).where("last = 'error'").select("id")))
query("sec.defer_medium", "SELECT id, battery < 35 AS defers FROM devices")(lambda v: v.devices.select("id", (F.col("battery") < 35).alias("defers")))
query("win.newest_object", "SELECT scope_id, arg_max(id, (window_end, id)) AS id FROM windows WHERE tier = 'domain' GROUP BY scope_id")(lambda v: latest(where_equal(v.windows, tier="domain").select("scope_id", "id", "window_end"), ["scope_id"], ["window_end", "id"]).select("scope_id", "id"))
query("win.newest_complete", "SELECT scope_id, id FROM windows WHERE status = 'complete' QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY window_end DESC, id DESC) = 1")(lambda v: sy.newest_complete(v.windows, ["scope_id"]).select("scope_id", "id"))
query("win.recent_syntheses", "SELECT scope_id, id FROM windows QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY window_end DESC, id DESC) <= 50")(lambda v: top_per(v.windows, ["scope_id"], [F.desc("window_end"), F.desc("id")], 50).select("scope_id", "id"))
query("win.window_prune", "SELECT scope_id, id FROM windows WHERE status = 'complete' QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY window_end DESC, id DESC) <= 20")(lambda v: sy.newest_complete(v.windows, ["scope_id"], 20).select("scope_id", "id"))
query("win.synthesis_window", "SELECT w.id, count(a.id) AS observations FROM windows w JOIN (SELECT *, 'c' || scope_id AS s FROM audit) a ON a.s = w.scope_id AND a.moment >= w.window_start + 820454400 AND a.moment < w.window_end + 820454400 GROUP BY w.id")(
    lambda v: sy.in_windows(v.audit.select(F.col("id").alias("event"), F.concat(F.lit("c"), "scope_id").alias("scope_id"), (F.col("moment") - 820454400).alias("moment")), v.windows, "moment", 86400).groupBy("id").agg(F.count("*").alias("observations")))
query("win.rolling", "SELECT id FROM audit WHERE moment >= 1706745600 - 604800 AND moment <= 1706745600")(lambda v: sy.rolling(v.audit, "moment", AS_OF, 604800).select("id"))
query("win.stuck_pending", "SELECT id, CASE WHEN status = 'pending' AND 1706745600 - window_end > 3600 THEN 'failed' ELSE status END AS status FROM windows")(lambda v: sy.fail_stuck(v.windows, AS_OF, 3600).select("id", "status"))
query("lc.window_states", "SELECT id, CASE WHEN status = 'pending' THEN 'in_progress' ELSE status END AS status FROM windows")(lambda v: v.windows.select("id", sy.change(F.col("status"), "in_progress").alias("status")))
query("sec.window_replay", "SELECT id, CASE WHEN status = 'complete' THEN 'pending' ELSE status END AS status FROM windows")(lambda v: v.windows.select("id", sy.change(F.col("status"), "pending").alias("status")))
query("sec.windows_for", "SELECT id FROM windows WHERE scope_id = 'c7'")(lambda v: where_equal(v.windows, scope_id="c7").select("id"))
query("sec.window_remove", "SELECT id FROM windows WHERE id NOT IN (SELECT window_id FROM versions WHERE version = 3)")(lambda v: without(v.windows, v.versions.where("version = 3").select(F.col("window_id").alias("id")), ["id"]).select("id"))
query("join.gather_channel", "SELECT scope_id, arg_max(recap, (created_at, window_id, version, recap)) AS recap FROM versions GROUP BY scope_id")(lambda v: v.versions.groupBy("scope_id").agg(F.max_by("recap", F.struct("created_at", "window_id", "version", "recap")).alias("recap")))
query("join.gather_domain", "SELECT w.scope_id, arg_max(v.recap, (v.version, v.window_id, v.recap)) AS recap FROM windows w JOIN versions v ON v.window_id = w.id WHERE w.tier = 'domain' GROUP BY w.scope_id")(
    lambda v: where_equal(v.windows, tier="domain").select("scope_id", F.col("id").alias("window_id")).join(v.versions.select("window_id", "version", "recap"), "window_id").groupBy("scope_id").agg(F.max_by("recap", F.struct("version", "window_id", "recap")).alias("recap")))
query("join.hierarchy_domain", "SELECT DISTINCT scope_id FROM versions WHERE scope_id NOT IN (SELECT scope_id FROM windows WHERE tier = 'channel' AND status = 'complete' AND window_start > 900000000)")(
    lambda v: v.versions.select("scope_id").distinct().join(v.windows.where("tier = 'channel' AND status = 'complete' AND window_start > 900000000").select("scope_id").distinct(), "scope_id", "left_anti"))
query("join.hierarchy_tenant", "SELECT document_id FROM approved_docs WHERE document_id NOT IN (SELECT document_id FROM citations)")(lambda v: without(v.approved_docs, v.citations, ["document_id"]).select("document_id"))
query("fn.adaptive_budget", "SELECT window_id, least(greatest(640 + 48 * count(*), 640), 1024) AS budget FROM versions GROUP BY window_id")(
    lambda v: v.versions.groupBy("window_id").agg(F.count("*").alias("n")).select("window_id", sy.adaptive_budget(F.col("n")).alias("budget")))
query("fn.retry_budget", "SELECT id, least(size_bytes + 384, 1536) AS budget FROM (SELECT evidence_id AS id, size_bytes FROM evidence)")(lambda v: v.evidence.select(F.col("evidence_id").alias("id"), F.least(F.col("size_bytes") + 384, F.lit(1536)).alias("budget")))
_TERMS = r"list_distinct([t for t in regexp_extract_all(lower(text), '[\p{L}\p{N}]+') if length(t) >= 4])"
_RECAP = "substr(text, 1, 100)"
query("fn.term_coverage", f"SELECT doc_id, round(CASE WHEN len({_TERMS}) = 0 THEN 1.0 ELSE len([t for t in {_TERMS} if contains(lower({_RECAP}), t)]) / len({_TERMS}) END, 6) AS coverage FROM documents")(
    lambda v: v.documents.select("doc_id", F.round(sy.term_coverage(F.substring("text", 1, 100), tx.salient_terms(F.col("text"))), 6).alias("coverage")))
query("fn.bundle_score", f"SELECT doc_id, least(length(trim({_RECAP})), 280) + 16 + 12 * c - CASE WHEN starts_with(lower(trim({_RECAP})), 'the ') THEN 500 ELSE 0 END - CASE WHEN length(trim({_RECAP})) < 40 THEN 200 ELSE 0 END - CASE WHEN n >= 5 AND c / n < 0.2 THEN 50 ELSE 0 END - 20 AS score FROM (SELECT doc_id, text, least(len([t for t in {_TERMS} if contains(lower(trim({_RECAP})), t)]), 1000) AS c, len({_TERMS}) AS n FROM documents)")(
    lambda v: v.documents.select("doc_id", sy.bundle_score(F.substring("text", 1, 100), tx.salient_terms(F.col("text")), F.lit(2), F.lit(1), ["the "]).cast("bigint").alias("score")))
query("set.term_except", f"SELECT doc_id, len([t for t in {_TERMS} if NOT contains(lower({_RECAP}), t)]) AS absent FROM documents")(lambda v: v.documents.select("doc_id", F.size(F.filter(tx.salient_terms(F.col("text")), lambda t: ~F.contains(F.lower(F.substring("text", 1, 100)), t))).cast("bigint").alias("absent")))
_ALL = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'))"
query("join.recap_ungrounded", f"SELECT c.conv_id, c.turn, len([t for t in {_ALL.format('c.text')} if NOT list_contains({_ALL.format('d.text')}, t)]) AS ungrounded FROM conversations c JOIN documents d ON d.doc_id = c.conv_id")(
    lambda v: v.conversations.join(v.documents.select(F.col("doc_id").alias("conv_id"), F.col("text").alias("evidence")), "conv_id").select("conv_id", "turn", F.size(F.array_except(F.array_distinct(tx.tokens(F.col("text"))), tx.tokens(F.col("evidence")))).cast("bigint").alias("ungrounded")))
query("join.quality_ungrounded", f"SELECT c.conv_id, count(*) FILTER (WHERE len([t for t in {_ALL.format('c.text')} if list_contains({_ALL.format('d.text')}, t)]) = 0) AS ungrounded FROM conversations c JOIN documents d ON d.doc_id = c.conv_id GROUP BY c.conv_id")(
    lambda v: v.conversations.join(v.documents.select(F.col("doc_id").alias("conv_id"), F.col("text").alias("evidence")), "conv_id").groupBy("conv_id").agg(count_where("ungrounded", ~F.arrays_overlap(tx.tokens(F.col("text")), tx.tokens(F.col("evidence"))))))
query("agg.synth_metrics", "SELECT tier, count(*) FILTER (WHERE status = 'failed') AS failed, round(avg(window_end - window_start), 4) AS mean FROM windows GROUP BY tier")(lambda v: v.windows.groupBy("tier").agg(count_where("failed", F.col("status") == "failed"), F.round(F.avg(F.col("window_end") - F.col("window_start")), 4).alias("mean")))
query("agg.mean_recap", "SELECT round(avg(length(recap)), 6) AS mean FROM versions")(lambda v: v.versions.agg(F.round(F.avg(F.length("recap")), 6).alias("mean")))
query("lc.verify_retry", "SELECT window_id, arg_max(version, (length(recap), version)) AS kept FROM versions GROUP BY window_id")(lambda v: v.versions.groupBy("window_id").agg(F.max_by("version", F.struct(F.length("recap"), "version")).alias("kept")))
query("sec.render_prompt_rows", "SELECT scope_id, md5(string_agg('- ' || body, chr(10) ORDER BY body, id)) AS digest FROM observations GROUP BY scope_id")(
    lambda v: v.observations.groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct("body", "id"))).alias("o")).select("scope_id", F.md5(F.array_join(F.transform("o", lambda x: F.concat(F.lit("- "), x["body"])), "\n")).alias("digest")))
query("txt.router_score", "SELECT id, 2 * len([t for t in ['germany', 'nation'] if contains(lower(label), t)]) + len([t for t in ['germany', 'nation'] if contains(lower(definition), t)]) AS score FROM nodes")(
    lambda v: v.nodes.select("id", (2 * F.size(F.filter(F.array(F.lit("germany"), F.lit("nation")), lambda t: F.contains(F.lower("label"), t))) + F.size(F.filter(F.array(F.lit("germany"), F.lit("nation")), lambda t: F.contains(F.lower("definition"), t)))).cast("bigint").alias("score")))
