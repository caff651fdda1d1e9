"""Telemetry, text, registry, release and execution-analytics queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import source_anchor, source_path
from graphloom.operators import release as R
from graphloom.operators.quantiles import quantiles
from graphloom.session import cut, table
from graphloom.streaming import events as E

Q, O = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


def r6(x):
    return F.round(x, 6)


# ---- sources ---------------------------------------------------------------------------------------------------

@query("SELECT doc_id, line, regexp_replace(trim(t), '\\s+', ' ', 'g') AS snippet FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE contains(lower(t), 'license') OR (contains(lower(t), 'the') AND contains(lower(t), 'worthless')) ORDER BY doc_id, line LIMIT 40")
def src_line_search(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t"))
    low = F.lower("t")
    hit = F.contains(low, F.lit("license")) | (F.contains(low, F.lit("the")) & F.contains(low, F.lit("worthless")))
    return rows.filter(hit).select("doc_id", (F.col("p") + 1).cast("long").alias("line"), F.regexp_replace(F.trim("t"), r"\s+", " ").alias("snippet")).orderBy("doc_id", "line").limit(40)


TOC = [(1, "- file: intro"), (2, "caption: Models"), (3, "- file: a"), (4, "- file: b"), (5, "caption: Tools"), (6, "- file: c")]
TOC_SQL = "(VALUES " + ", ".join(f"({n}, '{t}')" for n, t in TOC) + ") t(line, text)"


@query(f"SELECT caption, slug FROM (SELECT line, text, coalesce(last_value(CASE WHEN text LIKE 'caption: %' THEN substr(text, 10) END IGNORE NULLS) OVER (ORDER BY line), 'Uncategorized') AS caption, substr(text, 9) AS slug FROM {TOC_SQL}) WHERE text LIKE '- file: %'")
def src_toc(spark, d):
    rows = spark.createDataFrame(TOC, "line int, text string")
    cap = F.last(F.when(F.startswith("text", F.lit("caption: ")), F.substring("text", 10, 1000)), ignorenulls=True).over(Window.orderBy("line"))
    return rows.withColumn("caption", F.coalesce(cap, F.lit("Uncategorized"))).filter("text LIKE '- file: %'").select("caption", F.substring("text", 9, 1000).alias("slug"))


# References of several forms, good and bad, by the language of a document.
REFS = "SELECT doc_id, CASE lang WHEN 'en' THEN source || '.md#L' || doc_id WHEN 'de' THEN source || '.md' WHEN 'fr' THEN '#' || source WHEN 'es' THEN source || '# ' || source ELSE source || '#b#' || n_chars END AS v FROM documents"


@query(f"SELECT doc_id, v, nullif(regexp_extract(v, '^([^#]+)#([^\\s#].*)$', 1), '') AS path, nullif(regexp_extract(v, '^([^#]+)#([^\\s#].*)$', 2), '') AS anchor FROM ({REFS})")
def src_reference(spark, d):
    refs = spark.sql(REFS.replace("FROM documents", "FROM {documents}"), documents=table(spark, d, "documents"))
    return refs.select("doc_id", "v", source_path("v").alias("path"), source_anchor("v").alias("anchor"))


# ---- release and registry --------------------------------------------------------------------------------------

# Suppliers are release roots; their nation decides which manifests they have and what is wrong with them.
def toml(section: str, version: str) -> str:
    before, after = "'[other]' || chr(10) || 'version = \"0.0.1\"' || chr(10)", "'version = \"8.8.8\"'"
    return f"{before} || ' [{section}] ' || chr(10) || 'version = 5' || chr(10) || ' version=\"' || {version} || '\" # now' || chr(10) || {after}"


SHOWN = "'1.' || s_nationkey || '.0'"
MIXED = f"CASE WHEN s_nationkey = 3 THEN '3.0.0' ELSE {SHOWN} END"
BROKEN = "CASE s_nationkey WHEN 13 THEN '{\"version\": 1.5}' WHEN 14 THEN '{\"version\": \"\"}' WHEN 15 THEN '[\"version\"]' WHEN 16 THEN '{\"version\": ' ELSE NULL END"
FILES = (
    f"SELECT s_suppkey AS root, 'pyproject.toml' AS path, {toml('project', SHOWN)} AS text FROM supplier WHERE s_nationkey < 12 UNION ALL SELECT s_suppkey, 'pyproject.toml', {toml('tool.other', SHOWN)} FROM supplier WHERE s_nationkey = 12 "
    f"UNION ALL SELECT s_suppkey, 'Cargo.toml', {toml('package', SHOWN)} FROM supplier WHERE s_nationkey BETWEEN 5 AND 8 UNION ALL SELECT s_suppkey, 'package.json', '{{\"a\": {{\"version\": \"7.7.7\"}}, \"version\": \"' || {MIXED} || '\"}}' FROM supplier WHERE s_nationkey < 6 "
    f"UNION ALL SELECT s_suppkey, 'package.json', {BROKEN} FROM supplier WHERE s_nationkey BETWEEN 13 AND 17 UNION ALL SELECT s_suppkey, 'setup.cfg', 'version = \"6.6.6\"' FROM supplier"
)
ROOTS = "SELECT s_suppkey AS root, s_nationkey <> 18 AS git, CASE s_nationkey WHEN 19 THEN NULL WHEN 20 THEN '' ELSE 'main' END AS branch, CASE WHEN s_acctbal < 0 THEN 2 ELSE 0 END AS changes, CASE WHEN s_nationkey IN (1, 2, 3, 5, 18) THEN '1.2.0' END AS expected FROM supplier"
TAGS = "SELECT s_suppkey AS root, CASE WHEN s_nationkey IN (1, 5) THEN 'v1.2.0' WHEN s_nationkey IN (2, 18) THEN '1.2.0' ELSE 'v0.9.0' END AS tag FROM supplier"
SHOWN_SQL = (
    f"SELECT s_suppkey AS root, 'pyproject.toml' AS path, 'python' AS kind, {SHOWN} AS version FROM supplier WHERE s_nationkey < 12 UNION ALL SELECT s_suppkey, 'Cargo.toml', 'rust', {SHOWN} FROM supplier WHERE s_nationkey BETWEEN 5 AND 8 "
    f"UNION ALL SELECT s_suppkey, 'package.json', 'node', {MIXED} FROM supplier WHERE s_nationkey < 6"
)


def suppliers(spark, d, sql):
    """Rows of a statement over the supplier table."""
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, d, "supplier"))


@query(SHOWN_SQL)
def rel_versions(spark, d):
    return R.manifest_versions(suppliers(spark, d, FILES))


@query(
    f"WITH r AS ({ROOTS}), v AS ({SHOWN_SQL}), t AS ({TAGS}), f AS (SELECT root, 'not_git_repository' AS code, 'blocker' AS severity FROM r WHERE NOT git UNION ALL SELECT root, 'dirty_worktree', 'blocker' FROM r WHERE git AND changes > 0 "
    "UNION ALL SELECT root, 'detached_head', 'warning' FROM r WHERE git AND (branch IS NULL OR branch = '') UNION ALL SELECT DISTINCT r.root, 'tag_collision', 'blocker' FROM r JOIN t ON r.root = t.root AND t.tag IN (expected, 'v' || expected) WHERE git "
    "UNION ALL SELECT root, 'no_version_metadata', 'warning' FROM r WHERE root NOT IN (SELECT root FROM v) UNION ALL SELECT root, 'inconsistent_versions', 'blocker' FROM v GROUP BY root HAVING count(DISTINCT version) > 1 "
    "UNION ALL SELECT DISTINCT r.root, 'expected_version_mismatch', 'blocker' FROM r JOIN v ON r.root = v.root WHERE v.version <> expected) "
    "SELECT r.root, code, severity, CASE WHEN r.root IN (SELECT root FROM f WHERE severity = 'blocker') THEN 'blocked' ELSE 'ready' END AS status FROM r LEFT JOIN f ON f.root = r.root"
)
def rel_preflight(spark, d):
    found = R.manifest_versions(suppliers(spark, d, FILES))
    return R.preflight(suppliers(spark, d, ROOTS), found, suppliers(spark, d, TAGS))


# Parts are the registry. Faults are put in by size: names in capitals, versions of several grammars, entries listed twice,
# versions that differ, entries that are not there and rows that nobody registered.
REG_NAME = "replace(p_name, ' ', '-') || '-' || p_partkey"
REG_VERSION = "CASE p_size WHEN 1 THEN '1.0' WHEN 2 THEN '1.0.0-rc.1' WHEN 3 THEN '1.0.0+b7' WHEN 4 THEN 'v1.0.0' WHEN 5 THEN '1.0.0-' WHEN 6 THEN NULL ELSE '1.2.' || p_size END"
ENTRIES = f"SELECT CASE WHEN p_size = 8 THEN upper({REG_NAME}) ELSE {REG_NAME} END AS name, {REG_VERSION} AS version FROM part WHERE p_size <> 12 UNION ALL SELECT {REG_NAME}, {REG_VERSION} FROM part WHERE p_size = 9"
THERE = f"SELECT {REG_NAME} AS name, CASE WHEN p_size = 10 THEN '9.9.9' ELSE {REG_VERSION} END AS version FROM part WHERE p_size <> 11"


@query(
    f"WITH e AS ({ENTRIES}), t AS ({THERE}) SELECT DISTINCT name, 'bad name' AS finding FROM e WHERE NOT regexp_full_match(name, '[a-z0-9]+(?:-[a-z0-9]+)*') "
    "UNION ALL SELECT DISTINCT name, 'bad version' FROM e WHERE version IS NULL OR NOT regexp_full_match(version, '\\d+\\.\\d+\\.\\d+(?:-[0-9A-Za-z.-]+)?(?:\\+[0-9A-Za-z.-]+)?') "
    "UNION ALL SELECT name, 'registered more than once' FROM e GROUP BY name HAVING count(*) > 1 UNION ALL SELECT DISTINCT e.name, 'versions differ' FROM e JOIN t ON e.name = t.name WHERE e.version IS DISTINCT FROM t.version "
    "UNION ALL SELECT DISTINCT name, 'missing' FROM e WHERE name NOT IN (SELECT name FROM t) UNION ALL SELECT DISTINCT name, 'not registered' FROM t WHERE name NOT IN (SELECT name FROM e)"
)
def reg_validate(spark, d):
    parts = table(spark, d, "part")
    name, version = F.expr(REG_NAME), F.expr(REG_VERSION)
    e = parts.filter("p_size <> 12").select(F.when(F.col("p_size") == 8, F.upper(name)).otherwise(name).alias("name"), version.alias("version"))
    e = e.unionByName(parts.filter("p_size = 9").select(name.alias("name"), version.alias("version")))
    there = parts.filter("p_size <> 11").select(name.alias("name"), F.when(F.col("p_size") == 10, "9.9.9").otherwise(version).alias("version"))
    return R.registry_findings(e, there)


# Parts are to be installed under two targets; by size they are there as links, as other links, as copies, changed, or not at all.
PLACE_OF = "'/src/' || p_partkey"


@query(
    "SELECT CAST(p_partkey AS VARCHAR) AS name, target, state, CASE state WHEN 'missing' THEN 'PLAN' WHEN 'synced' THEN 'OK' WHEN 'synced-copy' THEN 'OK' ELSE 'CONFLICT' END AS action FROM ("
    "SELECT p_partkey, 'one' AS target, CASE WHEN p_size <= 10 THEN 'synced' WHEN p_size <= 15 THEN 'conflict-link' WHEN p_size <= 25 THEN 'synced-copy' WHEN p_size <= 30 THEN 'conflict-existing' WHEN p_size <= 35 THEN 'conflict-existing' ELSE 'missing' END AS state FROM part UNION ALL SELECT p_partkey, 'two', 'missing' FROM part)"
)
def reg_install_plan(spark, d):
    parts = table(spark, d, "part")
    wanted = parts.select(F.col("p_partkey").cast("string").alias("name"), F.explode(F.array(F.lit("one"), F.lit("two"))).alias("target"), F.expr(PLACE_OF).alias("place"), F.md5(F.col("p_name").cast("binary")).alias("digest"))
    link = F.when(F.col("p_size") <= 10, F.expr(PLACE_OF)).when(F.col("p_size") <= 15, "/elsewhere")
    digest = F.when(F.col("p_size") <= 25, F.md5(F.col("p_name").cast("binary"))).when(F.col("p_size") <= 30, "changed")
    found = parts.filter("p_size <= 35").select(F.col("p_partkey").cast("string").alias("name"), F.lit("one").alias("target"), link.alias("link"), digest.alias("digest"))
    return R.install_plan(wanted, found, copies=True)


# Orders are release candidates, their lines gates and, where many are ordered, destinations; urgent orders in part are retired.
GATE = "CASE WHEN l_returnflag = 'R' AND l_quantity < 10 THEN 'FAIL' WHEN l_tax > 0.07 THEN 'UNKNOWN' WHEN l_discount > 0.08 THEN NULL ELSE 'PASS' END"
PLACE = "CASE WHEN l_linestatus = 'F' THEN 'VERIFIED' WHEN l_discount < 0.03 THEN 'PUBLISHED' WHEN l_discount < 0.06 THEN 'UNKNOWN' ELSE 'FAILED' END"


@query(
    f"WITH g AS (SELECT l_orderkey AS c, {GATE} AS state FROM lineitem), p AS (SELECT l_orderkey AS c, {PLACE} AS state FROM lineitem WHERE l_quantity > 40), r AS (SELECT o_orderkey AS c FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'), "
    "n AS (SELECT o_orderkey AS c, (SELECT count(*) FROM r WHERE r.c = o_orderkey) AS gone, (SELECT count(*) FROM p WHERE p.c = o_orderkey) AS places, (SELECT count(*) FROM p WHERE p.c = o_orderkey AND state = 'VERIFIED') AS verified, (SELECT count(*) FROM p WHERE p.c = o_orderkey AND state IN ('VERIFIED', 'PUBLISHED')) AS published, "
    "(SELECT count(*) FROM g WHERE g.c = o_orderkey) AS gates, (SELECT count(*) FROM g WHERE g.c = o_orderkey AND state IS NULL) AS skipped, (SELECT count(*) FROM g WHERE g.c = o_orderkey AND state = 'PASS') AS passed FROM orders) "
    "SELECT c AS candidate, CASE WHEN gone > 0 THEN 'ARCHIVED_VERIFIED' WHEN places > 0 AND places = verified THEN 'PUBLISHED_VERIFIED' WHEN published > 0 THEN 'PUBLISHED_PARTIAL' WHEN gates = skipped THEN 'PLANNED' WHEN gates = passed THEN 'READY' ELSE 'BLOCKED' END AS status FROM n"
)
def rel_gate_rollup(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    gates = lines.select(F.col("l_orderkey").alias("candidate"), F.expr(GATE).alias("state"))
    places = lines.filter("l_quantity > 40").select(F.col("l_orderkey").alias("candidate"), F.expr(PLACE).alias("state"))
    retired = orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("candidate"), (F.col("o_orderstatus") == "P").alias("visible"), F.lit(True).alias("replaced"))
    return R.release_states(orders.select(F.col("o_orderkey").alias("candidate")), gates, places, retired)


# ---- transaction costs: lines as fills, orders as parents, the part's mean price as benchmark --------------------

FILLS = "(SELECT l_orderkey, l_partkey, l_quantity AS qty, l_extendedprice / l_quantity AS px, l_extendedprice * l_tax AS fee, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS side, l_shipdate, l_returnflag, b.bench FROM lineitem JOIN (SELECT l_partkey AS pk, sum(l_extendedprice) / sum(l_quantity) AS bench FROM lineitem GROUP BY 1) b ON b.pk = l_partkey)"


def fills(spark, d):
    """Fills with the volume-weighted mean price of their part. The benchmark has a row a part, so it is joined, not windowed."""
    li = table(spark, d, "lineitem")
    bench = li.groupBy("l_partkey").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("bench"))
    return li.join(bench, "l_partkey").select("l_orderkey", "l_partkey", F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), (F.col("l_extendedprice") * F.col("l_tax")).alias("fee"), F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("side"), "l_shipdate", "l_returnflag", "bench")


def cost():
    return F.expr("side * (px - bench) * qty")


def notional():
    return F.expr("bench * qty")


@query(f"SELECT l_returnflag, side, count(*) AS n, round(sum(side * (px - bench) * qty), 2) AS cost FROM {FILLS} GROUP BY 1, 2")
def tca_fill_cost(spark, d):
    return fills(spark, d).groupBy("l_returnflag", "side").agg(F.count("*").alias("n"), F.round(F.sum(cost()), 2).alias("cost"))


@query(f"SELECT l_orderkey, round(1e4 * sum(side * (px - bench) * qty) / sum(bench * qty), 3) AS bps FROM {FILLS} GROUP BY 1")
def tca_parent_cost(spark, d):
    return fills(spark, d).groupBy("l_orderkey").agg(F.round(1e4 * F.sum(cost()) / F.sum(notional()), 3).alias("bps"))


@query(f"SELECT side, round(sum(side * (px - bench) * qty), 2) AS executed, round(sum(fee), 2) AS explicit, round(sum(side * (px - bench) * qty) + sum(fee), 2) AS total FROM {FILLS} GROUP BY side")
def tca_bridge(spark, d):
    return fills(spark, d).groupBy("side").agg(F.round(F.sum(cost()), 2).alias("executed"), F.round(F.sum("fee"), 2).alias("explicit"), F.round(F.sum(cost()) + F.sum("fee"), 2).alias("total"))


@query(f"SELECT l_returnflag, side, count(*) AS n, round(1e4 * sum(side * (px - bench) * qty) / sum(bench * qty), 4) AS bps FROM {FILLS} GROUP BY GROUPING SETS ((l_returnflag, side), (side), ())")
def tca_strata(spark, d):
    f = fills(spark, d)
    return f.groupingSets([[F.col("l_returnflag"), F.col("side")], [F.col("side")], []], F.col("l_returnflag"), F.col("side")).agg(F.count("*").alias("n"), F.round(1e4 * F.sum(cost()) / F.sum(notional()), 4).alias("bps"))


@query(f"WITH p AS (SELECT side, 1e4 * side * (px - bench) / bench AS bps FROM {FILLS}), q AS (SELECT side, quantile_cont(bps, 0.95) AS q95 FROM p GROUP BY side) SELECT p.side, round(median(bps), 4) AS median, round(any_value(q95), 4) AS p95, round(avg(bps) FILTER (WHERE bps >= q95), 4) AS shortfall FROM p JOIN q ON p.side = q.side GROUP BY p.side")
def tca_tails(spark, d):
    p = cut(fills(spark, d).select("side", (1e4 * F.col("side") * (F.col("px") - F.col("bench")) / F.col("bench")).alias("bps")))
    q = quantiles(p, "bps", {"m": 0.5, "q95": 0.95}, ["side"])
    return p.join(F.broadcast(q), "side").groupBy("side").agg(F.round(F.first("m"), 4).alias("median"), F.round(F.first("q95"), 4).alias("p95"), F.round(F.avg(F.when(F.col("bps") >= F.col("q95"), F.col("bps"))), 4).alias("shortfall"))


@query("WITH v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view'), c AS (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'view') SELECT c.event_id, (SELECT value FROM v WHERE v.user_id = c.user_id AND v.ts <= c.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS quote FROM c")
def tca_asof_benchmark(spark, d):
    """Latest view of the user at or before each other event: one ordered pass over both streams, no range join."""
    e = table(spark, d, "events").withColumn("is_view", F.coalesce(F.col("event_type") == "view", F.lit(False)))
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("is_view"), 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("is_view"), F.struct("value")), ignorenulls=True).over(w)
    return e.withColumn("q", last).filter(~F.col("is_view")).select("event_id", F.col("q.value").alias("quote"))


@query(f"WITH p AS (SELECT side, CAST(floor(qty / 10) AS BIGINT) AS bucket, 1e4 * side * (px - bench) / bench AS bps FROM {FILLS}) SELECT bucket, round(avg(bps) FILTER (WHERE side = 1) - avg(bps) FILTER (WHERE side = -1), 4) AS gap FROM p GROUP BY bucket")
def tca_matched(spark, d):
    p = fills(spark, d).select("side", F.floor(F.col("qty") / 10).cast("long").alias("bucket"), (1e4 * F.col("side") * (F.col("px") - F.col("bench")) / F.col("bench")).alias("bps"))
    mean = lambda s: F.avg(F.when(F.col("side") == s, F.col("bps")))
    return p.groupBy("bucket").agg(F.round(mean(1) - mean(-1), 4).alias("gap"))


# ---- volume ----------------------------------------------------------------------------------------------------

DAILY = "(SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS volume, sum(value) AS value FROM events GROUP BY 1, 2)"


def daily(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("volume"), F.sum("value").alias("value"))


@query(f"SELECT event_type, CAST(day AS VARCHAR) AS day, volume FROM {DAILY}")
def vol_daily(spark, d):
    return daily(spark, d).select("event_type", F.col("day").cast("string").alias("day"), "volume")


@query(f"SELECT event_type, CAST(day AS VARCHAR) AS day, round(avg(volume) OVER w, 6) AS mean5, median(volume) OVER w AS median5 FROM {DAILY} WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def vol_rolling_mean_median(spark, d):
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-5, -1)
    s = F.sort_array(F.collect_list("volume").over(w))
    n = F.size("s")
    med = F.when(n > 0, (F.element_at("s", F.floor((n + 1) / 2).cast("int")) + F.element_at("s", F.floor(n / 2).cast("int") + 1)) / 2)
    return daily(spark, d).withColumns({"mean5": r6(F.avg("volume").over(w)), "s": s}).withColumn("median5", med).select("event_type", F.col("day").cast("string").alias("day"), "mean5", "median5")


HOURS = "(SELECT hour(ts) AS h, count(*) AS v FROM events GROUP BY 1)"


@query(f"SELECT h, round(sum(v) OVER (ORDER BY h) / sum(v) OVER (), 6) AS fraction FROM {HOURS}")
def vol_curve(spark, d):
    h = table(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("h")).agg(F.count("*").alias("v"))
    total = h.agg(F.sum("v").alias("t"))  # 24 rows at most
    return h.crossJoin(total).select("h", r6(F.sum("v").over(Window.orderBy("h")) / F.col("t")).alias("fraction"))


@query("WITH x AS (SELECT CAST(ts AS DATE) AS day, hour(ts) AS h, count(*) AS v FROM events GROUP BY 1, 2) SELECT CAST(day AS VARCHAR) AS day, h, CAST(sum(v) OVER (PARTITION BY day) - sum(v) OVER (PARTITION BY day ORDER BY h) AS BIGINT) AS remaining FROM x")
def vol_remaining(spark, d):
    x = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), F.hour("ts").cast("long").alias("h")).agg(F.count("*").alias("v"))
    w = Window.partitionBy("day")
    return x.select(F.col("day").cast("string").alias("day"), "h", (F.sum("v").over(w) - F.sum("v").over(w.orderBy("h"))).alias("remaining"))


@query(f"WITH f AS (SELECT event_type, volume, avg(volume) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p FROM {DAILY}) SELECT event_type, round(avg(p - volume), 6) AS bias, round(avg(abs(p - volume)), 6) AS mae, round(sqrt(avg((p - volume) * (p - volume))), 6) AS rmse, round(avg(CASE WHEN p < volume THEN 1.0 ELSE 0.0 END), 6) AS under FROM f WHERE p IS NOT NULL GROUP BY event_type")
def vol_forecast_error(spark, d):
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-5, -1)
    f = daily(spark, d).withColumn("p", F.avg("volume").over(w)).filter("p IS NOT NULL").withColumn("e", F.col("p") - F.col("volume"))
    return f.groupBy("event_type").agg(r6(F.avg("e")).alias("bias"), r6(F.avg(F.abs("e"))).alias("mae"), r6(F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("rmse"), r6(F.avg(F.when(F.col("e") < 0, 1.0).otherwise(0.0))).alias("under"))


# ---- risk ------------------------------------------------------------------------------------------------------

RET = f"(SELECT event_type, day, value / lag(value) OVER (PARTITION BY event_type ORDER BY day) - 1 AS ret FROM {DAILY})"


def returns(spark, d):
    w = Window.partitionBy("event_type").orderBy("day")
    return daily(spark, d).withColumn("ret", F.col("value") / F.lag("value").over(w) - 1).select("event_type", "day", "ret")


@query(f"SELECT event_type, CAST(day AS VARCHAR) AS day, round(ret, 6) AS ret FROM {RET}")
def risk_returns(spark, d):
    return returns(spark, d).select("event_type", F.col("day").cast("string").alias("day"), r6("ret").alias("ret"))


@query(f"SELECT event_type, CAST(day AS VARCHAR) AS day, round(stddev_samp(ret) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS vol FROM {RET} WHERE ret IS NOT NULL")
def risk_rolling_vol(spark, d):
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-9, 0)
    return returns(spark, d).filter("ret IS NOT NULL").select("event_type", F.col("day").cast("string").alias("day"), r6(F.stddev_samp("ret").over(w)).alias("vol"))


@query(f"WITH r AS (SELECT event_type, ret, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) - 1 AS k FROM {RET} WHERE ret IS NOT NULL) SELECT event_type, round(sum(pow(0.94, k) * ret * ret) / sum(pow(0.94, k)), 6) AS ewma FROM r GROUP BY event_type")
def risk_ewma(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("day"))
    x = returns(spark, d).filter("ret IS NOT NULL").withColumn("k", F.pow(F.lit(0.94), F.row_number().over(w) - 1))
    return x.groupBy("event_type").agg(r6(F.sum(F.col("k") * F.col("ret") * F.col("ret")) / F.sum("k")).alias("ewma"))


COV = f"(SELECT a.event_type AS i, b.event_type AS j, covar_samp(a.ret, b.ret) AS cov FROM {RET} a JOIN {RET} b ON a.day = b.day WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2)"


def covariance(spark, d):
    r = returns(spark, d).filter("ret IS NOT NULL")
    a, b = r.select(F.col("event_type").alias("i"), "day", F.col("ret").alias("x")), r.select(F.col("event_type").alias("j"), "day", F.col("ret").alias("y"))
    return a.join(b, "day").groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"))


@query(f"SELECT i, j, round(cov, 6) AS cov FROM {COV}")
def risk_cov(spark, d):
    return covariance(spark, d).select("i", "j", r6("cov").alias("cov"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity, 2) AS qty, round(sum(l_quantity) OVER (PARTITION BY l_orderkey) - sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE UNBOUNDED PRECEDING), 2) AS residual FROM lineitem")
def risk_residual_path(spark, d):
    w = Window.partitionBy("l_orderkey")
    left = F.sum("l_quantity").over(w) - F.sum("l_quantity").over(w.orderBy("l_linenumber").rangeBetween(Window.unboundedPreceding, 0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round("l_quantity", 2).alias("qty"), F.round(left, 2).alias("residual"))


@query(f"WITH w AS (SELECT event_type AS k, count(*) / (SELECT count(*) FROM events) AS x FROM events GROUP BY 1) SELECT round(sum(a.x * cov * b.x), 6) AS variance FROM {COV} c JOIN w a ON a.k = c.i JOIN w b ON b.k = c.j")
def risk_quadratic(spark, d):
    e = table(spark, d, "events")
    w = e.groupBy(F.col("event_type").alias("k")).agg(F.count("*").alias("n")).crossJoin(e.agg(F.count("*").alias("t"))).select("k", (F.col("n") / F.col("t")).alias("x"))
    c = covariance(spark, d).join(w.select(F.col("k").alias("i"), F.col("x").alias("xi")), "i").join(w.select(F.col("k").alias("j"), F.col("x").alias("xj")), "j")
    return c.agg(r6(F.sum(F.col("xi") * F.col("cov") * F.col("xj"))).alias("variance"))


# ---- model validation ------------------------------------------------------------------------------------------


@query("WITH b AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), c AS (SELECT day, n, (sum(n) OVER (ORDER BY day) - n) / sum(n) OVER () AS p FROM b) SELECT CASE WHEN p < 0.6 THEN 'train' WHEN p < 0.8 THEN 'validate' ELSE 'test' END AS part, CAST(sum(n) AS BIGINT) AS n, CAST(min(day) AS VARCHAR) AS first FROM c GROUP BY 1")
def val_split(spark, d):
    """Chronological split on daily counts: the ordered pass sees one row a day, not one an event."""
    b = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    total = b.agg(F.sum("n").alias("t"))
    p = (F.sum("n").over(Window.orderBy("day")) - F.col("n")) / F.col("t")
    part = F.when(F.col("p") < 0.6, "train").when(F.col("p") < 0.8, "validate").otherwise("test")
    return b.crossJoin(total).withColumn("p", p).groupBy(part.alias("part")).agg(F.sum("n").alias("n"), F.min("day").cast("string").alias("first"))


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20' AND ts + INTERVAL 2 DAY < TIMESTAMP '2024-01-20'")
def val_purge(spark, d):
    e = table(spark, d, "events")
    return e.filter((F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("ts") + F.expr("INTERVAL 2 DAYS") < F.lit("2024-01-20").cast("timestamp_ntz"))).select("event_id")


SCORED = "(SELECT d.doc_id, least(0.99, greatest(0.01, d.n_chars / 5000.0)) AS p, quality AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def scored(spark, d):
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("n_chars") / 5000.0))
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id").select("doc_id", p.alias("p"), F.col("quality").alias("y"))


@query(f"SELECT CAST(floor(p * 10) AS BIGINT) AS bucket, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM {SCORED} GROUP BY 1")
def val_calibration(spark, d):
    return scored(spark, d).groupBy(F.floor(F.col("p") * 10).cast("long").alias("bucket")).agg(F.count("*").alias("n"), r6(F.avg("p")).alias("mean_p"), r6(F.avg("y")).alias("rate"))


@query(f"SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss FROM {SCORED}")
def val_binary_metrics(spark, d):
    s = scored(spark, d)
    return s.agg(r6(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))).alias("brier"), r6(-F.avg(F.col("y") * F.ln("p") + (1 - F.col("y")) * F.ln(1 - F.col("p")))).alias("log_loss"))


@query("WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.1) AS lo, quantile_cont(o_totalprice, 0.9) AS hi FROM orders GROUP BY 1) SELECT o.o_orderpriority, round(avg(CASE WHEN o_totalprice BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM orders o JOIN q ON q.o_orderpriority = o.o_orderpriority GROUP BY 1")
def val_interval_coverage(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_totalprice")
    q = o.groupBy("o_orderpriority").agg(F.percentile("o_totalprice", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    inside = F.col("o_totalprice").between(F.col("q")[0], F.col("q")[1])
    return o.join(q, "o_orderpriority").groupBy("o_orderpriority").agg(r6(F.avg(F.when(inside, 1.0).otherwise(0.0))).alias("coverage"))


# ---- portfolios ------------------------------------------------------------------------------------------------

HOLD = "(SELECT c_mktsegment AS k, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS cur, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS target FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"


def holdings(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice")
    j = o.join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    part = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    return j.groupBy(F.col("c_mktsegment").alias("k")).agg(part("F").alias("cur"), part("O").alias("target"))


@query(f"SELECT k, CASE WHEN abs(coalesce(target, 0) - coalesce(cur, 0)) < 100000 THEN 'hold' WHEN target > cur THEN 'buy' ELSE 'sell' END AS action, round(coalesce(target, 0) - coalesce(cur, 0), 2) AS trade FROM {HOLD}")
def pf_trade_list(spark, d):
    trade = F.coalesce("target", F.lit(0.0)) - F.coalesce("cur", F.lit(0.0))
    return holdings(spark, d).select("k", F.when(F.abs(trade) < 100000, "hold").when(F.col("target") > F.col("cur"), "buy").otherwise("sell").alias("action"), F.round(trade, 2).alias("trade"))


@query(f"SELECT k, round(0.01 * abs(target - cur) - 0.001 * abs(target - cur) - 0.0001 * pow(abs(target - cur), 1.1), 2) AS net FROM {HOLD}")
def pf_net_benefit(spark, d):
    t = F.abs(F.col("target") - F.col("cur"))
    return holdings(spark, d).select("k", F.round(0.01 * t - 0.001 * t - 0.0001 * F.pow(t, F.lit(1.1)), 2).alias("net"))


@query(f"SELECT l AS lambda, round(sum(abs(target - cur)) / (1 + l), 2) AS risk, round(sum(abs(target - cur)) * l / (1 + l), 2) AS cost FROM {HOLD}, (SELECT unnest(range(5)) AS l) GROUP BY l")
def pf_frontier(spark, d):
    grid = spark.range(5).select(F.col("id").alias("lambda"))
    size = holdings(spark, d).agg(F.sum(F.abs(F.col("target") - F.col("cur"))).alias("t"))
    return grid.crossJoin(size).select("lambda", F.round(F.col("t") / (1 + F.col("lambda")), 2).alias("risk"), F.round(F.col("t") * F.col("lambda") / (1 + F.col("lambda")), 2).alias("cost"))


@query(f"SELECT CAST(pow(10, c) AS BIGINT) AS capital, k, round(0.05 * pow(10, c) - 0.1 * pow(pow(10, c), 1.5) / sqrt(cur), 4) AS net FROM {HOLD}, (SELECT unnest(range(2, 6)) AS c)")
def pf_capacity(spark, d):
    grid = spark.range(2, 6).select(F.pow(F.lit(10.0), F.col("id")).alias("c"))
    return holdings(spark, d).crossJoin(grid).select(F.col("c").cast("long").alias("capital"), "k", F.round(0.05 * F.col("c") - 0.1 * F.pow("c", F.lit(1.5)) / F.sqrt("cur"), 4).alias("net"))


@query(f"SELECT name, round(sum(cur * vol) , 2) AS loss FROM {HOLD}, (VALUES ('base', 0.01), ('double', 0.02), ('crash', 0.1)) s(name, vol) GROUP BY name")
def pf_stress(spark, d):
    s = spark.sql("SELECT * FROM VALUES ('base', 0.01D), ('double', 0.02D), ('crash', 0.1D) AS s(name, vol)")
    return holdings(spark, d).crossJoin(s).groupBy("name").agg(F.round(F.sum(F.col("cur") * F.col("vol")), 2).alias("loss"))


@query("SELECT x, round(0.1 * x, 6) AS linear, round(pow(x, 0.5), 6) AS concave, round(pow(x, 1.5), 6) AS convex FROM (SELECT unnest(range(1, 21)) / 10.0 AS x)")
def imp_curves(spark, d):
    x = spark.range(1, 21).select((F.col("id") / 10.0).alias("x"))
    return x.select("x", r6(0.1 * F.col("x")).alias("linear"), r6(F.pow("x", F.lit(0.5))).alias("concave"), r6(F.pow("x", F.lit(1.5))).alias("convex"))


# ---- streaming -------------------------------------------------------------------------------------------------


@query("SELECT event_type, CAST(date_trunc('day', ts) AS VARCHAR) AS start, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    return E.window_counts(spark, d)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe_refresh(spark, d):
    return E.first_seen(spark, d)
