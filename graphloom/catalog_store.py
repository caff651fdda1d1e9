"""Queries of graph files, changes, validation and the read service, and their SQL, over tables with injected faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.scalars import assertion_id
from graphloom.operators import graph as G
from graphloom.operators import mutate as M
from graphloom.operators import service as R
from graphloom.operators import validate as V
from graphloom.plans.patterns import Graph
from graphloom.session import table
from graphloom.sources import files as W
from graphloom.sources import star_graph as S

Q, O = {}, {}


def query(sql: str):
    def keep(f):
        Q[f.__name__], O[f.__name__] = f, sql
        return f

    return keep


WITH = "WITH " + S.gv()
AID = "'a:' || substr(sha256(f || chr(31) || rel || chr(31) || t || chr(31) || source), 1, 20)"
TYPES = {"Region": None, "Nation": None, "Supplier": "Party", "Customer": "Party", "Party": None}
SCHEMA = V.Schema(TYPES, {"part_of": (("Nation", "Party"), ("Nation", "Region"))}, set(), {}, {"part_of"})
TODAY = "2024-03-01"


def key(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


# ---- files -----------------------------------------------------------------------------------------------------

LINES = """lines AS (SELECT 4 * n_nationkey AS ord, n_nationkey AS k, n_name AS label, 'node' AS kind FROM nation UNION ALL SELECT 4 * n_nationkey + 1, n_nationkey, 'again', 'node' FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT 4 * n_nationkey + 2, n_nationkey, NULL, CASE n_nationkey % 3 WHEN 0 THEN 'bad JSON' WHEN 1 THEN 'not an object' ELSE 'blank' END FROM nation)"""


def lines(spark, d):
    n = table(spark, d, "nation").withColumn("k", F.col("n_nationkey"))
    node = lambda label: F.to_json(F.struct(key("nation", "k").alias("id"), F.lit("Nation").alias("type"), label.alias("label"), F.array(F.lit("nation#1")).alias("sources")))
    bad = F.element_at(F.array(F.lit('{"id": '), F.lit("[1]"), F.lit("  ")), (F.col("k") % 3 + 1).cast("int"))
    out = n.select((4 * F.col("k")).cast("long").alias("ord"), node(F.col("n_name")).alias("line"))
    out = out.unionByName(n.filter("k % 5 = 0").select((4 * F.col("k") + 1).cast("long").alias("ord"), node(F.lit("again")).alias("line")))
    return out.unionByName(n.select((4 * F.col("k") + 2).cast("long").alias("ord"), bad.alias("line")))


@query(f"WITH {LINES} SELECT 'nation:' || k AS id, arg_max(label, ord) AS label, min(ord) AS ord FROM lines WHERE kind = 'node' GROUP BY k")
def kg_load_nodes(spark, d):
    return W.load_nodes(lines(spark, d))[0].select("id", "label", "ord")


@query(f"WITH {LINES} SELECT ord, kind AS error FROM lines WHERE kind IN ('bad JSON', 'not an object') UNION ALL SELECT ord, 'duplicate node id nation:' || k FROM lines WHERE kind = 'node' AND ord % 4 = 1")
def kg_load_errors(spark, d):
    return W.load_nodes(lines(spark, d))[1]


NAMES = "('docs/a.md'), ('.env'), ('conf/.env.local'), ('keys/id_rsa'), ('x/server.pem'), ('logs/run.txt'), ('data/app.sqlite'), ('secrets.yaml'), ('my.credentials'), ('a/environment.md')"
SECRET = " OR ".join("regexp_matches(text, '{}')".format(p.replace("'", "''")) for p in W.SECRETS)


@query(
    f"SELECT doc_id, source, CASE WHEN regexp_matches(source, '{W.SENSITIVE_NAME}') THEN 'sensitive name' WHEN regexp_matches(source, '{W.RUNTIME_NAME}') THEN 'runtime name' WHEN text IS NULL THEN 'not a file' WHEN strlen(text) > 2097152 THEN 'oversized' WHEN contains(text, chr(0)) THEN 'binary' WHEN {SECRET} THEN 'secret pattern' ELSE 'ok' END AS verdict "
    f"FROM (SELECT doc_id, text, 'docs/' || doc_id || '.md' AS source FROM documents UNION ALL SELECT -1, 'plain', n FROM (VALUES {NAMES}) v(n) UNION ALL SELECT -2, 'api-key = \"' || repeat('a', 16) || '\"', 'a.md' UNION ALL SELECT -3, 'token: ' || repeat('a', 15), 'a.md' UNION ALL SELECT -4, repeat('long ', 500000), 'a.md')"
)
def sec_preflight(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), "text")
    more = spark.sql(f"SELECT -1L AS doc_id, n AS source, 'plain' AS text FROM VALUES {NAMES} AS v(n) UNION ALL SELECT -2L, 'a.md', concat('api-key = \"', repeat('a', 16), '\"') UNION ALL SELECT -3L, 'a.md', concat('token: ', repeat('a', 15)) UNION ALL SELECT -4L, 'a.md', repeat('long ', 500000)")
    return docs.unionByName(more).select("doc_id", "source", W.preflight(F.col("source"), F.col("text")).alias("verdict"))


PATHS = "('a/b.md', 'a/b.md'), ('./a//b.md', 'a/b.md'), ('a/../b.md', 'b.md'), ('../a.md', NULL), ('a/../../b', NULL), ('/abs', NULL), ('', NULL), ('.', NULL), ('a/node_modules/x', NULL), ('a/./c', 'a/c')"


@query(f"SELECT raw, folded FROM (VALUES {PATHS}) t(raw, folded)")
def src_fold_path(spark, d):
    return spark.sql(f"SELECT raw FROM VALUES {PATHS} AS t(raw, folded)").select("raw", M.fold_path(F.col("raw")).alias("folded"))


# ---- changes ---------------------------------------------------------------------------------------------------

_SUP = "'supplier:' || s_suppkey"
#: Suppliers by the last digit of their key: same, renamed, gone, undeclared type, foreign provenance, malformed id, and faults of assertions.
STAGED = f"""sn AS (SELECT CASE s_suppkey % 10 WHEN 3 THEN 'supplier:x' || s_suppkey WHEN 5 THEN 'Bad ' || s_suppkey ELSE {_SUP} END AS id, CASE s_suppkey % 10 WHEN 3 THEN 'Vendor' ELSE 'Supplier' END AS type,
  CASE s_suppkey % 10 WHEN 1 THEN 'renamed' ELSE s_name END AS label, CASE s_suppkey % 10 WHEN 4 THEN 'other#' ELSE 'supplier#' END || s_suppkey AS src, s_suppkey AS k FROM supplier WHERE s_suppkey % 10 <> 2),
se AS (SELECT CASE s_suppkey % 10 WHEN 3 THEN 'supplier:x' || s_suppkey ELSE {_SUP} END AS f, CASE s_suppkey % 10 WHEN 6 THEN 'ships_to' ELSE 'part_of' END AS rel, CASE s_suppkey % 10 WHEN 7 THEN 'nation:999' ELSE 'nation:' || s_nationkey END AS t,
  CASE s_suppkey % 10 WHEN 8 THEN 'other#' ELSE 'supplier#' END || s_suppkey AS source, s_suppkey AS k FROM supplier WHERE s_suppkey % 10 NOT IN (2, 5)
  UNION ALL SELECT {_SUP}, 'part_of', 'nation:' || s_nationkey, 'supplier#' || s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 10 = 9)"""


def staged(spark, d):
    s = table(spark, d, "supplier").withColumn("m", F.col("s_suppkey") % 10)
    case = lambda pairs, other: F.coalesce(*[F.when(F.col("m") == n, x) for n, x in pairs], other)
    text, own = F.col("s_suppkey").cast("string"), key("supplier", "s_suppkey")
    cited = lambda n: F.concat(F.when(F.col("m") == n, "other#").otherwise("supplier#"), text)
    odd = [(3, F.concat(F.lit("supplier:x"), text)), (5, F.concat(F.lit("Bad "), text))]
    props = F.create_map().cast("map<string,string>")
    n = s.filter("m <> 2").select(case(odd, own).alias("id"), case([(3, F.lit("Vendor"))], F.lit("Supplier")).alias("type"), case([(1, F.lit("renamed"))], F.col("s_name")).alias("label"), props.alias("props"), F.array(cited(4)).alias("sources"))
    nation = key("nation", "s_nationkey")
    e = s.filter("m NOT IN (2, 5)").select(case(odd[:1], own).alias("from"), case([(6, F.lit("ships_to"))], F.lit("part_of")).alias("rel"), case([(7, F.lit("nation:999"))], nation).alias("to"), cited(8).alias("source"))
    return n, e.unionByName(s.filter("m = 9").select(own.alias("from"), F.lit("part_of").alias("rel"), nation.alias("to"), F.concat(F.lit("supplier#"), text).alias("source")))


def refreshed(spark, d, prefer=False):
    return M.refresh(S.nodes(spark, d), S.edges(spark, d), *staged(spark, d), "supplier", SCHEMA, TODAY, prefer)


_T = "f || ' ' || rel || ' ' || t"


@query(
    f"{WITH}, {STAGED} SELECT id AS subject, 'malformed id' AS reason FROM sn WHERE k % 10 = 5 UNION ALL SELECT id, 'undeclared type' FROM sn WHERE k % 10 = 3 UNION ALL SELECT id, 'provenance of another source' FROM sn WHERE k % 10 = 4 UNION ALL SELECT id, 'differs in label' FROM sn WHERE k % 10 = 1 "
    f"UNION ALL SELECT {_T}, 'source of another path' FROM se WHERE k % 10 = 8 UNION ALL SELECT {_T}, 'undeclared relation' FROM se WHERE k % 10 = 6 UNION ALL SELECT {_T}, 'dangling end' FROM se WHERE k % 10 = 7 UNION ALL SELECT DISTINCT {_T}, 'assertion staged twice' FROM se WHERE k % 10 = 9"
)
def kg_refresh_reasons(spark, d):
    return refreshed(spark, d)[2]


@query(
    f"{WITH}, {STAGED} SELECT id, type, label, src AS sources FROM nodes WHERE type <> 'Supplier' UNION ALL SELECT id, type, label, src FROM sn WHERE k % 10 <> 5"
)
def kg_refresh_nodes(spark, d):
    return refreshed(spark, d, True)[0].select("id", "type", "label", F.array_join("sources", ",").alias("sources"))


@query(f"{WITH}, {STAGED}, whole AS (SELECT f, rel, t, source, '2024-01-01' AS recorded FROM edges WHERE source NOT LIKE 'supplier#%' UNION ALL SELECT f, rel, t, source, '{TODAY}' FROM se WHERE k % 10 NOT IN (7, 8)) SELECT {AID} AS id, f AS \"from\", rel, t AS \"to\", source, recorded FROM whole")
def kg_refresh_edges(spark, d):
    return refreshed(spark, d, True)[1]


def _twins(spark, d):
    """Nodes with a pair to merge: two segments, shared and own properties, aliases."""
    n = S.nodes(spark, d).withColumns({"aliases": F.array().cast("array<string>"), "description": F.lit("")})
    pair = spark.createDataFrame([("customer:new", "Customer", "Twin One", {"mktsegment": "X", "own": "1"}, ["t#1", "t#2"], ["Twin", "twin one!"], "d1"), ("customer:old", "Customer", "Twin 1", {"mktsegment": "Y", "more": "2"}, ["t#2", "u#1"], ["Second"], "d2")], n.schema)
    e = S.edges(spark, d).select("from", "rel", "to", "source").filter("`from` LIKE 'nation:%'")
    more = spark.createDataFrame([("customer:old", "part_of", "nation:1", "t#2"), ("customer:new", "part_of", "nation:1", "t#2"), ("nation:2", "part_of", "customer:old", "t#3")], e.schema)
    return n.unionByName(pair), e.unionByName(more).withColumn("id", assertion_id("from", "rel", "to", "source")).withColumn("recorded", F.lit("2024-01-01"))


@query("SELECT * FROM (VALUES ('description', 'd2', 'd1'), ('props.mktsegment', 'Y', 'X')) t(field, duplicate, canonical)")
def kg_merge_conflicts(spark, d):
    return M.merge_nodes(*_twins(spark, d), "customer:old", "customer:new")[2]


@query(f"{WITH} SELECT id, label, src AS sources, '' AS aliases, CASE WHEN type = 'Customer' THEN 'mktsegment=' || c_mktsegment ELSE '' END AS props FROM nodes LEFT JOIN customer ON id = 'customer:' || c_custkey UNION ALL SELECT 'customer:new', 'Twin One', 't#1,t#2,u#1', 'Twin,Twin 1,Second', 'merged_from=customer:old,mktsegment=X,more=2,own=1'")
def kg_merge_nodes(spark, d):
    n = M.merge_nodes(*_twins(spark, d), "customer:old", "customer:new", "canon")[0]
    props = F.array_join(F.array_sort(F.transform(F.map_entries("props"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",")
    return n.select("id", "label", F.array_join("sources", ",").alias("sources"), F.array_join("aliases", ",").alias("aliases"), props.alias("props"))


@query(f"{WITH}, e2 AS (SELECT f, rel, t, source FROM edges WHERE f LIKE 'nation:%' UNION ALL VALUES ('customer:new', 'part_of', 'nation:1', 't#2'), ('nation:2', 'part_of', 'customer:new', 't#3')) SELECT {AID} AS id, f AS \"from\", rel, t AS \"to\", source FROM e2")
def kg_merge_edges(spark, d):
    return M.merge_nodes(*_twins(spark, d), "customer:old", "customer:new", "dup")[1].select("id", "from", "rel", "to", "source")


_NEW = [("nation:1", "Nation", "Atlantis", ["x#1"]), ("Bad", "Nation", "Nowhere", ["x#2"]), ("thing:1", "Thing", "Thing", ["x#3"]), ("nation:x", "Nation", "nation 3!", ["x#4"]), ("nation:y", "Nation", "Ys", ["broken"])]


def _new_nodes(spark, rows):
    return spark.createDataFrame([(i, t, lab, {}, s) for i, t, lab, s in rows], "id string, type string, label string, props map<string,string>, sources array<string>")


@query("SELECT * FROM (VALUES ('nation:1', 'id exists'), ('Bad', 'malformed id'), ('thing:1', 'undeclared type'), ('nation:x', 'possible duplicate'), ('nation:y', 'malformed source')) t(subject, reason)")
def kg_add_node_conflicts(spark, d):
    return M.add_nodes(S.nodes(spark, d), _new_nodes(spark, _NEW), SCHEMA)[1]


@query(f"{WITH} SELECT id, label FROM nodes UNION ALL SELECT 'nation:z', 'Ys'")
def kg_add_nodes(spark, d):
    return M.add_nodes(S.nodes(spark, d), _new_nodes(spark, [("nation:z", "Nation", "Ys", ["x#1"])]), SCHEMA)[0].select("id", "label")


def _new_edges(spark, rows):
    return spark.createDataFrame(rows, "`from` string, rel string, `to` string, source string")


_BAD_EDGES = [("nation:1", "part_of", "region:1", "nation#1"), ("NATION_2", "near", "region:2", "x#1"), ("nobody", "part_of", "region:1", "x#2"), ("nation:3", "part_of", "region:3", "no anchor")]


@query("SELECT * FROM (VALUES ('nation:1 part_of region:1', 'assertion exists'), ('NATION_2 near region:2', 'undeclared relation'), ('nobody', 'from is none'), ('nation:3 part_of region:3', 'malformed source')) t(subject, reason)")
def kg_add_edge_conflicts(spark, d):
    return M.add_edges(S.nodes(spark, d), S.edges(spark, d), _new_edges(spark, _BAD_EDGES), SCHEMA, TODAY)[1]


@query(f"{WITH}, e2 AS (SELECT f, rel, t, source FROM edges UNION ALL SELECT 'nation:2', 'part_of', 'nation:3', 'x#1') SELECT {AID} AS id, f AS \"from\", t AS \"to\" FROM e2")
def kg_add_edges(spark, d):
    return M.add_edges(S.nodes(spark, d), S.edges(spark, d), _new_edges(spark, [("NATION_2", "part_of", "nation 3", "x#1")]), SCHEMA, TODAY)[0].select("id", "from", "to")


@query(f"{WITH} SELECT 'node' AS what, id, CASE WHEN type = 'Supplier' THEN '' ELSE src END AS sources FROM nodes UNION ALL SELECT 'edge', {AID}, source FROM edges WHERE source NOT LIKE 'supplier#%'")
def kg_forget_source(spark, d):
    n, e, _ = M.forget_source(S.nodes(spark, d), S.edges(spark, d), manifest(spark), "supplier")
    return n.select(F.lit("node").alias("what"), "id", F.array_join("sources", ",").alias("sources")).unionByName(e.select(F.lit("edge").alias("what"), "id", F.col("source").alias("sources")))


@query(f"{WITH}, s AS (SELECT i, string_agg(DISTINCT source, ',' ORDER BY source) AS found FROM (SELECT f AS i, source FROM edges UNION ALL SELECT t, source FROM edges) GROUP BY i) SELECT id, CASE type WHEN 'Customer' THEN 'old#' || substr(id, 10) WHEN 'Region' THEN coalesce(found, '') ELSE src END AS sources FROM nodes LEFT JOIN s ON i = id")
def kg_migrate(spark, d):
    """Regions have lost their sources, customers have an older single one."""
    n = S.nodes(spark, d)
    old = F.when(F.col("type") == "Customer", F.concat(F.lit("old#"), F.substring("id", 10, 99)))
    n = n.withColumns({"source": old, "sources": F.when(F.col("type").isin("Region", "Customer"), F.array().cast("array<string>")).otherwise(F.col("sources"))})
    return M.migrate(n, S.edges(spark, d).withColumn("id", F.lit("e:1")))[0].select("id", F.array_join("sources", ",").alias("sources"))


@query(f"{WITH} SELECT {AID} AS id, f AS \"from\" FROM edges")
def kg_migrate_edges(spark, d):
    return M.migrate(S.nodes(spark, d), S.edges(spark, d).withColumn("id", F.lit("e:1")))[1].select("id", "from")


# ---- validation ------------------------------------------------------------------------------------------------

MANIFEST = [("nation", "h1", "2024-02-01", False, None), ("supplier", "h2", "2023-12-01", False, None), ("customer", None, "2024-01-01", False, None), ("gone", "h", "2024-01-01", False, None), ("rt", "h5", "2024-01-01", True, 10), ("rt2", "h6", "2024-02-25", True, 10)]
FILES = [("nation", "h1"), ("supplier", "changed"), ("customer", "h3"), ("rt", "h5"), ("rt2", "h6")]


def manifest(spark):
    return spark.createDataFrame(MANIFEST, W.MANIFEST)


def now_files(spark):
    return spark.createDataFrame(FILES, "source string, sha256 string")


def marked(spark, d):
    """part_of assertions with repeated and missing ids and bad dates."""
    e = S.edges(spark, d)
    at = lambda *k: F.col("from").isin(*[f"nation:{x}" for x in k])
    return e.withColumn("id", F.when(at(1, 2), "e:1").when(~at(3), F.col("id"))).withColumn("recorded", F.when(at(4), "01/02/2024").when(at(5), "").when(at(6), "2024-01-01T10:00:00Z").when(at(7), "2024-13-01").otherwise(F.col("recorded")))


@query("SELECT 'nation:3 part_of region:' || n_regionkey AS subject, 'no id' AS detail FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'e:1', 'duplicate 2'")
def kg_validate_edge_ids(spark, d):
    return V.edge_ids(None, marked(spark, d), SCHEMA)


@query(f"{WITH} SELECT {_T} AS subject, {AID} AS detail FROM edges WHERE f IN ('nation:1', 'nation:2', 'nation:3')")
def kg_validate_content_ids(spark, d):
    return V.content_ids(None, marked(spark, d), SCHEMA)


@query(f"{WITH} SELECT {_T} AS subject, CASE f WHEN 'nation:4' THEN '01/02/2024' WHEN 'nation:5' THEN '' ELSE '2024-13-01' END AS detail FROM edges WHERE f IN ('nation:4', 'nation:5', 'nation:7')")
def kg_validate_recorded(spark, d):
    return V.recorded(None, marked(spark, d), SCHEMA)


@query("SELECT * FROM (VALUES ('nation', 'fresh'), ('supplier', 'stale'), ('customer', 'no hash'), ('gone', 'missing'), ('rt', 'expired'), ('rt2', 'fresh')) t(source, state)")
def kg_validate_manifest(spark, d):
    return V.manifest_states(manifest(spark), now_files(spark), TODAY)


@query(f"{WITH} SELECT f || ' ' || rel || ' ' || t AS subject, 'nation' AS detail FROM edges WHERE source LIKE 'nation#%'")
def kg_validate_drift(spark, d):
    return V.drift(S.edges(spark, d), manifest(spark))


@query(f"{WITH}, c AS (SELECT id AS subject, src AS source FROM nodes UNION ALL SELECT {AID}, source FROM edges) SELECT subject, source || ': ' || CASE WHEN source LIKE 'region#%' THEN 'absent from manifest' WHEN source LIKE 'supplier#%' THEN 'stale' ELSE 'no hash' END AS detail FROM c WHERE source NOT LIKE 'nation#%'")
def kg_validate_evidence(spark, d):
    n, e = S.nodes(spark, d), S.edges(spark, d)
    return V.evidence_freshness(V.cited_sources(n, e), manifest(spark), now_files(spark))


@query("WITH l AS (SELECT 'supplier:' || s_suppkey AS id, 'Supplier' AS t, 'mktsegment' AS p FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', 'capital' FROM nation), r AS (SELECT *, row_number() OVER (PARTITION BY t, p ORDER BY id) AS n FROM l) SELECT t || '.' || p AS subject, count(*) || ': ' || string_agg(id, ', ' ORDER BY id) FILTER (WHERE n <= 5) AS detail FROM r GROUP BY t, p")
def kg_validate_required_props(spark, d):
    return V.required_props(S.nodes(spark, d), {"Customer": ["mktsegment"], "Supplier": ["mktsegment"], "Nation": ["capital"]})


SHAPE = {"target": {"type": ["Nation", "Region"]}, "require_props": ["label", "props.capital"], "require_edges": [{"rel": "part_of", "direction": "both", "min": 2, "max": 60, "source_policy": "canonical-fresh"}, {"rel": "part_of", "direction": "in", "max": 70}]}


@query(
    f"{WITH}, k AS (SELECT id, (SELECT count(*) FROM edges WHERE f = id AND source LIKE 'nation#%') + (SELECT count(*) FROM edges WHERE t = id AND source LIKE 'nation#%') AS fresh, (SELECT count(*) FROM edges WHERE t = id) AS n FROM nodes WHERE type IN ('Nation', 'Region')) "
    "SELECT id AS subject, 'missing required props.capital' AS detail FROM k UNION ALL SELECT id, 'too few both part_of: ' || fresh FROM k WHERE fresh < 2 UNION ALL SELECT id, 'too many both part_of: ' || fresh FROM k WHERE fresh > 60 UNION ALL SELECT id, 'too many in part_of: ' || n FROM k WHERE n > 70"
)
def kg_validate_shape(spark, d):
    fresh = V.manifest_states(manifest(spark), now_files(spark), TODAY).filter("state = 'fresh'").select("source")
    return V.shape_findings(S.nodes(spark, d), S.edges(spark, d), SHAPE, fresh)


def _observed(spark, d):
    o = table(spark, d, "orders")
    seen = F.when(F.col("o_orderkey") % 50 == 7, "soon").when(F.col("o_orderkey") % 50 == 9, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return o.select(key("order", "o_orderkey").alias("id"), F.lit("Order").alias("type"), F.lit("o").alias("label"), F.create_map(F.lit("observed_at"), seen, F.lit("placeholder"), F.when(F.col("o_orderkey") % 100 == 3, "true").otherwise("false")).alias("props"), F.array(F.lit("o#1")).alias("sources"))


OBSERVED_NOW = "2001-06-01T00:00:00Z"


@query("SELECT 'order:' || o_orderkey AS subject, CASE WHEN o_orderkey % 50 IN (7, 9) THEN 'no valid time at props.observed_at' ELSE 'observation at props.observed_at too old' END AS detail FROM orders WHERE o_orderkey % 50 IN (7, 9) OR floor((epoch(TIMESTAMP '2001-06-01') - epoch(date_trunc('second', o_orderdate))) / 86400) > 365")
def kg_validate_freshness(spark, d):
    shape = {"target": {"type": "Order"}, "freshness": {"max_age_days": 365}}
    return V.shape_findings(_observed(spark, d), S.edges(spark, d), shape, None, OBSERVED_NOW)


@query("SELECT 'order:' || o_orderkey AS subject, 'unresolved placeholder' AS detail FROM orders WHERE o_orderkey % 100 = 3")
def kg_validate_placeholders(spark, d):
    return V.placeholders(_observed(spark, d))


def _health(spark, d):
    return R.health(S.nodes(spark, d), marked(spark, d), SCHEMA)


@query("SELECT * FROM (VALUES ('edge_ids', 2), ('content_ids', 3), ('recorded', 3)) t(rule, n)")
def kg_health(spark, d):
    return _health(spark, d).groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT 8 AS errors, 0 AS warnings, 0 AS notes, 1 AS exit_code")
def kg_validate_verdict(spark, d):
    return V.verdict(_health(spark, d))


QUESTIONS = [
    {"id": "all", "query": ["?s type Supplier", "?s part_of ?n"], "assert": {"min_results": 1, "covers": {"var": "?s", "type": "Supplier"}}},
    {"id": "few", "query": "?s type Region", "assert": {"max_results": 4}},
    {"id": "none", "query": "?c type Planet"},
    {"id": "gap", "query": "?n part_of region:1", "assert": {"covers": {"type": "Nation"}}},
]


@query("SELECT 'all' AS id, true AS passed, count(*) AS rows, 0 AS missing FROM supplier UNION ALL SELECT 'few', false, count(*), 0 FROM region UNION ALL SELECT 'none', false, 0, 0 UNION ALL SELECT 'gap', false, count(*) FILTER (WHERE n_regionkey = 1), count(*) FILTER (WHERE n_regionkey <> 1) FROM nation")
def kg_cq_results(spark, d):
    graph, out = Graph(S.nodes(spark, d), S.edges(spark, d)), None
    for q in QUESTIONS:
        part = V.ask(graph, q)
        out = part if out is None else out.unionByName(part)
    return out


# ---- read service ----------------------------------------------------------------------------------------------


@query(f"{WITH} SELECT 'type' AS what, type AS name, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'rel', rel, count(*) FROM edges GROUP BY rel UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges UNION ALL SELECT 'total', 'sources', 4 UNION ALL SELECT 'total', 'components', (SELECT count(DISTINCT n_regionkey) FROM nation) + (SELECT count(*) FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)) UNION ALL SELECT 'total', 'orphans', (SELECT count(*) FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation))")
def kg_overview(spark, d):
    return R.overview(S.nodes(spark, d), S.edges(spark, d))


_DEG = "deg AS (SELECT id, count(e) AS degree FROM nodes LEFT JOIN (SELECT f AS e FROM edges UNION ALL SELECT t FROM edges) ON e = id GROUP BY id)"


@query(f"{WITH}, {_DEG} SELECT n.id, label, degree, src AS source FROM nodes n JOIN deg ON deg.id = n.id LEFT JOIN customer ON n.id = 'customer:' || c_custkey WHERE type = 'Customer' AND contains(lower(c_mktsegment), 'build') ORDER BY degree DESC, n.id DESC LIMIT 50")
def kg_search(spark, d):
    return R.search(S.nodes(spark, d), S.edges(spark, d), "Build", "Customer", deep=True, limit=500).select("id", "label", "degree", F.col("sources")[0].alias("source"))


@query("SELECT 0 AS place, 'supplier:1' AS id, 'supplier#1' AS source UNION ALL SELECT 1, 'nation:' || s_nationkey, 'nation#' || s_nationkey FROM supplier WHERE s_suppkey = 1 UNION ALL SELECT 2, 'region:' || n_regionkey, 'region#' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1")
def kg_path(spark, d):
    region = table(spark, d, "supplier").filter("s_suppkey = 1").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    return R.path(S.nodes(spark, d), S.edges(spark, d), "supplier:1", f"region:{region}").select("place", "id", F.col("sources")[0].alias("source"))


@query(f"{WITH}, ids AS (SELECT f AS id FROM edges WHERE t = 'nation:3' UNION SELECT 'nation:3') SELECT 'node' AS what, n.id, n.src AS source FROM nodes n SEMI JOIN ids ON ids.id = n.id UNION ALL SELECT * FROM (SELECT 'edge', {AID} AS aid, source FROM edges WHERE f IN (SELECT id FROM ids) AND t IN (SELECT id FROM ids) ORDER BY aid LIMIT 100)")
def kg_provenance(spark, d):
    n, e = S.nodes(spark, d), S.edges(spark, d)
    ids = e.filter("`to` = 'nation:3'").select(F.col("from").alias("id")).union(spark.createDataFrame([("nation:3",)], "id string"))
    return R.node_provenance(ids, n).select(F.lit("node").alias("what"), "id", "source").unionByName(R.edge_provenance(ids, e).select(F.lit("edge").alias("what"), "id", "source"))


@query(f"{WITH}, {_DEG} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT string_agg(id, ',' ORDER BY degree DESC, id) FROM (SELECT * FROM deg ORDER BY degree DESC, id LIMIT 6)) AS top, 8 AS findings")
def kg_brief(spark, d):
    return R.brief(S.nodes(spark, d), S.edges(spark, d), _health(spark, d)).select("nodes", "edges", F.array_join("top", ",").alias("top"), "findings")


@query("SELECT 'region:2 (' || (SELECT r_name FROM region WHERE r_regionkey = 2) || ')' AS r, 'nation:' || n_nationkey || ' (' || n_name || ')' AS n, 'supplier:' || s_suppkey || ' (' || s_name || ')' AS s FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 2 UNION ALL SELECT 'region:2 (' || (SELECT r_name FROM region WHERE r_regionkey = 2) || ')', 'nation:' || n_nationkey || ' (' || n_name || ')', '?' FROM nation WHERE n_regionkey = 2 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def kg_labelled(spark, d):
    """The region is named by its label, not its id; unbound suppliers show as ``?``."""
    graph = Graph(S.nodes(spark, d), S.edges(spark, d))
    name = table(spark, d, "region").filter("r_regionkey = 2").first()["r_name"]
    wanted = graph.resolved([f"?n part_of {name.replace(' ', '_')}"])
    suppliers = Graph(graph.nodes, graph.edges.filter("`from` LIKE 'supplier:%' OR `from` LIKE 'nation:%'"))
    found = suppliers.query([*wanted, f"?n part_of {wanted[0].split()[2]}", "?r type Region", "?n part_of ?r"], optional=("?s part_of ?n",))
    return suppliers.labelled(found.select("r", "n", "s"))


@query(f"{WITH}, {_DEG}, e AS (SELECT DISTINCT f, t FROM edges), i AS (SELECT t AS id, count(*) AS k FROM e GROUP BY t) SELECT id FROM deg ORDER BY degree DESC, id LIMIT 3")
def kg_top_degree(spark, d):
    return G.degree(S.nodes(spark, d), S.edges(spark, d)).orderBy(F.desc("degree"), "id").limit(3).select("id")


@query(f"{WITH} SELECT 1 AS depth, f AS \"from\", rel, t AS \"to\" FROM edges WHERE t = 'region:1' UNION ALL SELECT 2, f, rel, t FROM edges WHERE t IN (SELECT f FROM edges WHERE t = 'region:1')")
def kg_neighbors_in(spark, d):
    return G.neighborhood(S.nodes(spark, d), S.edges(spark, d), "region:1", 2, "part_of", "in")
