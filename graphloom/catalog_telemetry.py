"""Telemetry queries over JSON lines made of the event table, and SQL over the table's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.scalars import safe_label, safe_segment
from graphloom.operators import telemetry as T
from graphloom.session import table

Q, O = {}, {}


def query(sql: str):
    def keep(f):
        Q[f.__name__], O[f.__name__] = f, sql
        return f

    return keep


def lines(spark, d):
    """Broken and blank lines, five forms of time, four of labels, nested objects with secret, id-like, odd and empty keys."""
    e = table(spark, d, "events").withColumn("i", F.col("event_id"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), (F.col("i") % n + 1).cast("int"))
    when = pick(5, F.concat(F.lit('"ts": "'), iso, F.lit('Z", ')), F.concat(F.lit('"timestamp": '), seconds, F.lit(", ")), F.concat(F.lit('"time": '), seconds, F.lit("250, ")), F.concat(F.lit('"ts": 5, "at": "'), iso, F.lit('", ')), "")
    label = pick(4, F.concat(F.lit('"event": "'), F.col("event_type"), F.lit('", ')), F.concat(F.lit('"event": "", "type": "'), F.col("event_type"), F.lit('", ')), '"event": 0, "status": "my_token", ', '"event": "a b", ')
    user = F.concat(F.lit('"user": {"id": '), F.col("user_id").cast("string"), F.lit(', "api_key": "x", "0123456789abcdef": 1, "a b": 2, "": 3}, '))
    rest = F.concat(F.lit('"props": '), F.coalesce("props", F.lit("null")), F.lit(', "flag": true, "big": 10000000000000, "list": [1], "value": '), F.coalesce(F.col("value").cast("string"), F.lit("null")), F.lit("}"))
    body = F.concat(F.lit("{"), when, label, user, rest)
    line = F.when(F.col("i") % 100 == 7, "[1]").when(F.col("i") % 100 == 17, "{bad").when(F.col("i") % 97 == 5, " ").otherwise(body)
    return e.select(F.col("event_id").alias("ord"), line.alias("line"))


BAD = "event_id % 100 IN (7, 17)"
SEC = "epoch(date_trunc('second', ts))"
ROWS = f"""WITH p AS (SELECT event_id AS ord, user_id, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, event_id % 5 AS form,
  CASE event_id % 5 WHEN 2 THEN {SEC} + 0.25 WHEN 4 THEN NULL ELSE {SEC} END AS t,
  CASE event_id % 4 WHEN 2 THEN 'redacted_label' WHEN 3 THEN 'redacted_label' ELSE event_type END AS label, event_id % 4 AS shape
  FROM events WHERE NOT {BAD} AND event_id % 97 <> 5),
f AS (SELECT ord, unnest(CASE form WHEN 0 THEN ['ts'] WHEN 1 THEN ['timestamp'] WHEN 2 THEN ['time'] WHEN 3 THEN ['ts', 'at'] ELSE [] END) AS key,
    unnest(CASE form WHEN 0 THEN [NULL] WHEN 1 THEN [t] WHEN 2 THEN [NULL] WHEN 3 THEN [5.0, NULL] ELSE [] END) AS number FROM p
  UNION ALL SELECT ord, 'event', CASE shape WHEN 2 THEN 0.0 END FROM p UNION ALL SELECT ord, 'type', NULL FROM p WHERE shape = 1 UNION ALL SELECT ord, 'status', NULL FROM p WHERE shape = 2
  UNION ALL SELECT ord, 'user.id', CAST(user_id AS DOUBLE) FROM p UNION ALL SELECT ord, 'user.redacted_key', NULL FROM p UNION ALL SELECT ord, 'user.dynamic_id', 1.0 FROM p
  UNION ALL SELECT ord, 'user.dynamic_key', 2.0 FROM p UNION ALL SELECT ord, 'user.empty_key', 3.0 FROM p UNION ALL SELECT ord, 'props.k', k FROM p
  UNION ALL SELECT ord, 'flag', NULL FROM p UNION ALL SELECT ord, 'big', NULL FROM p UNION ALL SELECT ord, 'value', value FROM p)"""
SINCE, UNTIL = 1704412800, 1704844800
SUMMARY = "count({0}) AS n, round(min({0}), 6) AS min, round(quantile_cont({0}, 0.05), 6) AS p05, round(quantile_cont({0}, 0.5), 6) AS median, round(avg({0}), 6) AS mean, round(quantile_cont({0}, 0.95), 6) AS p95, round(max({0}), 6) AS max, round(stddev_pop({0}), 6) AS sd"


def rows(spark, d):
    return T.parse_rows(lines(spark, d))


def parsed(spark, d):
    return T.kept(rows(spark, d))


@query("SELECT event_id AS ord FROM events ORDER BY event_id DESC LIMIT 200")
def tel_tail(spark, d):
    return T.tail(lines(spark, d), 200).select("ord")


@query(ROWS + " SELECT ord, key, round(number, 6) AS number FROM f")
def tel_flatten(spark, d):
    return T.flat(parsed(spark, d)).select("ord", "key", F.round("number", 6).alias("number"))


@query(ROWS + f", n AS (SELECT (SELECT count(*) FROM events WHERE {BAD}) AS bad) SELECT count(*) AS rows_parsed, any_value(bad) AS rows_malformed, 0 AS rows_outside_window, 0 AS rows_no_ts_skipped, strftime(to_timestamp(floor(min(t))) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS first, strftime(to_timestamp(floor(max(t))) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS last FROM p, n")
def tel_accounting(spark, d):
    return T.accounting(rows(spark, d))


@query(ROWS + f", n AS (SELECT (SELECT count(*) FROM events WHERE {BAD}) AS bad) SELECT count(*) FILTER (WHERE t BETWEEN {SINCE} AND {UNTIL}) AS rows_parsed, any_value(bad) AS rows_malformed, count(*) FILTER (WHERE t < {SINCE} OR t > {UNTIL}) AS rows_outside_window, count(*) FILTER (WHERE t IS NULL) AS rows_no_ts_skipped, strftime(to_timestamp(floor(min(t) FILTER (WHERE t BETWEEN {SINCE} AND {UNTIL}))) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS first, strftime(to_timestamp(floor(max(t) FILTER (WHERE t BETWEEN {SINCE} AND {UNTIL}))) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS last FROM p, n")
def tel_window(spark, d):
    return T.accounting(rows(spark, d), SINCE, UNTIL)


@query(ROWS + " SELECT label, count(*) AS n, min(ord) AS first_ord FROM p GROUP BY label")
def tel_event_counts(spark, d):
    return T.label_counts(parsed(spark, d))


@query(ROWS + " SELECT key AS field, count(*) AS n, min(ord) AS first_ord FROM f WHERE NOT regexp_matches(key, 'key') GROUP BY key")
def tel_field_counts(spark, d):
    return T.field_counts(parsed(spark, d))


@query(ROWS + " SELECT key AS field, count(*) AS n, min(ord) AS first_ord FROM f WHERE NOT regexp_matches(key, 'key') GROUP BY key ORDER BY n DESC, first_ord, field LIMIT 5")
def tel_top_fields(spark, d):
    return T.field_counts(parsed(spark, d), 5)


@query(ROWS + f" SELECT key AS field, {SUMMARY.format('number')} FROM f WHERE number IS NOT NULL AND NOT regexp_matches(key, 'key') GROUP BY key")
def tel_numeric_summary(spark, d):
    return T.numeric_fields(parsed(spark, d))


@query(ROWS + f", g AS (SELECT CASE WHEN form = 3 THEN '5' WHEN form IN (1, 2, 4) THEN 'unknown' ELSE strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS label, value, k FROM p), m AS (SELECT label, value AS v, 'value' AS metric FROM g UNION ALL SELECT label, k, 'props.k' FROM g) SELECT label, metric, (SELECT count(*) FROM g WHERE g.label = m.label) AS rows, {SUMMARY.format('v')} FROM m GROUP BY label, metric")
def tel_group_metrics(spark, d):
    shown = T.group_metrics(T.kept(rows(spark, d)), "ts", ["value", "props.k"])
    return shown


LABELS = "('ok'), (''), (NULL), ('my_token'), ('0123456789abcdef01'), ('123456789012'), ('12345678901'), ('a;b'), ('a b'), (' fill '), ('x/y'), ('author'), ('" + "x" * 65 + "'), ('0xABCDEF0123456789')"


@query(f"""SELECT v AS raw, CASE WHEN v IS NULL THEN 'unknown' WHEN NOT regexp_matches(trim(v), '^[A-Za-z0-9_.:_-]{{1,64}}$') OR regexp_matches(lower(v), 'secret|token|key|wallet|address|signature|auth|bearer') OR regexp_matches(trim(v), '^((0x)?[0-9a-fA-F]{{16,}}|[0-9]{{12,}})$') THEN 'redacted_label' ELSE trim(v) END AS shown,
CASE WHEN trim(v) = '' THEN 'empty_key' WHEN regexp_matches(lower(v), 'secret|token|key|wallet|address|signature|auth|bearer') THEN 'redacted_key' WHEN regexp_matches(trim(v), '^((0x)?[0-9a-fA-F]{{16,}}|[0-9]{{12,}})$') THEN 'dynamic_id' WHEN NOT regexp_matches(trim(v), '^[A-Za-z0-9_.:_-]{{1,64}}$') THEN 'dynamic_key' ELSE trim(v) END AS segment FROM (VALUES {LABELS}) t(v)""")
def tel_redaction(spark, d):
    return spark.sql(f"SELECT v AS raw FROM VALUES {LABELS} AS t(v)").select("raw", safe_label("raw").alias("shown"), safe_segment("raw").alias("segment"))


@query("SELECT event_type, " + SUMMARY.format("value") + " FROM events GROUP BY event_type")
def tel_summary_by_type(spark, d):
    return T.summary(table(spark, d, "events"), "value", ["event_type"])
