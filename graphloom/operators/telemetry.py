"""Profiles of JSON event lines: tail, flattening, time window, counts, exact summaries, group metrics, redaction.

A line is read once, in Arrow batches of Python (open keys, repeated keys and NaN are beyond the JVM's JSON readers);
what follows is column expressions over (ord, state, event, ts, fields).
"""

from __future__ import annotations

import json
import math
import re
from datetime import datetime, timezone
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import HEX_ID, LONG_ID, SAFE, SENSITIVE, is_sensitive, iso_utc, safe_label

# Keys of a row's time in their order, the largest whole number taken as a metric, and defaults.
TIME_KEYS = ("ts", "timestamp", "time", "created_at", "at", "t")
LABEL_KEYS = ("event", "type", "status")
MOST_WHOLE = 1_000_000_000_000
TAIL, TOP = 20_000, 12
_safe, _id = re.compile(SAFE).fullmatch, re.compile(f"{HEX_ID}|{LONG_ID}").fullmatch
PARSED = "ord long, state string, event string, ts double, fields array<struct<key:string,text:string,number:double>>"


def read_lines(spark, path: str) -> DataFrame:
    """(ord, line) of one file, ``.gz`` read as it is; one task, as lines are numbered in order."""
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    return raw.select((F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("ord"), "line")


def tail(lines: DataFrame, n: int = TAIL) -> DataFrame:
    """The last ``n`` physical lines, blank ones counted."""
    if n < 1:
        raise ValueError("the limit is 1 or more")
    return lines.orderBy(F.desc("ord")).limit(n)


def epoch_of(value) -> float | None:
    """Seconds of a number (above 1e11 milliseconds, above 1e8 seconds) or of text, tried as a number and then as ISO time, UTC unless it says."""
    if isinstance(value, str):
        try:
            number = float(value)
        except ValueError:
            try:
                when = datetime.fromisoformat(value.replace("Z", "+00:00"))
            except ValueError:
                return None
            return (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp()
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        number = float(value)
    else:
        return None
    if number > 1e11:
        return number / 1000
    return number if number > 1e8 else None


def metric_of(value) -> float | None:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    fits = abs(value) <= MOST_WHOLE if isinstance(value, int) else math.isfinite(value)
    return float(value) if fits else None


@lru_cache(1 << 16)
def shown_segment(key: str) -> str:
    """``scalars.safe_segment`` of one key."""
    key = key.strip()
    if not key:
        return "empty_key"
    if any(part in key.lower() for part in SENSITIVE):
        return "redacted_key"
    if _id(key):
        return "dynamic_id"
    return key if _safe(key) else "dynamic_key"


def leaves(value, path: str = ""):
    """(shown path, scalar) of an object, depth first; lists are left out."""
    waiting = [(path, value)]
    while waiting:
        path, value = waiting.pop()
        if isinstance(value, dict):
            waiting += [(f"{path}.{shown_segment(k)}" if path else shown_segment(k), v) for k, v in reversed(value.items())]
        elif not isinstance(value, list):
            yield path, value


def read_line(line: str) -> tuple:
    """(state, event, ts, fields): blank, malformed (also JSON that is no object) or parsed."""
    if not line.strip():
        return "blank", None, None, []
    try:
        row = json.loads(line)
    except ValueError:
        return "malformed", None, None, []
    if not isinstance(row, dict):
        return "malformed", None, None, []
    event = next((row[k] for k in LABEL_KEYS if row.get(k)), row.get(LABEL_KEYS[-1]))
    flat = dict(leaves(row))
    ts = next((t for t in (epoch_of(flat.get(k)) for k in TIME_KEYS) if t is not None), None)
    fields = [{"key": p, "text": None if v is None else str(v), "number": metric_of(v)} for p, v in flat.items()]
    return "parsed", None if event is None else str(event), ts, fields


def parse_rows(lines: DataFrame) -> DataFrame:
    """(ord, line) -> ``PARSED``: fields under their shown keys, of equal ones the last."""

    def run(frames):
        for pdf in frames:
            rows = [(o, *read_line(x or "")) for o, x in zip(pdf["ord"], pdf["line"], strict=True)]
            yield pd.DataFrame(rows, columns=["ord", "state", "event", "ts", "fields"])

    return lines.select(F.col("ord").cast("long").alias("ord"), "line").mapInPandas(run, PARSED)


def in_window(rows: DataFrame, since: float | None = None, until: float | None = None) -> Column:
    """What becomes of a row: blank, malformed, no_time (only where a bound is set), outside, or parsed."""
    if since is not None and until is not None and since > until:
        raise ValueError("the window ends before it begins")
    ts = F.col("ts")
    out = F.lit(False)
    out = out if since is None else out | (ts < since)
    out = out if until is None else out | (ts > until)
    bounded = F.lit(since is not None or until is not None)
    return F.when(F.col("state") != "parsed", F.col("state")).when(bounded & ts.isNull(), "no_time").when(F.coalesce(out, F.lit(False)), "outside").otherwise("parsed")


def kept(rows: DataFrame, since: float | None = None, until: float | None = None) -> DataFrame:
    return rows.filter(in_window(rows, since, until) == "parsed")


def accounting(rows: DataFrame, since: float | None = None, until: float | None = None) -> DataFrame:
    """One row: rows_parsed, rows_malformed, rows_outside_window, rows_no_ts_skipped, first and last time shown."""
    told = rows.withColumn("told", in_window(rows, since, until))
    n = lambda s: F.count_if(F.col("told") == s)
    ts = F.when(F.col("told") == "parsed", F.col("ts"))
    return told.agg(n("parsed").alias("rows_parsed"), n("malformed").alias("rows_malformed"), n("outside").alias("rows_outside_window"), n("no_time").alias("rows_no_ts_skipped"), iso_utc(F.min(ts)).alias("first"), iso_utc(F.max(ts)).alias("last"))


def flat(rows: DataFrame) -> DataFrame:
    """(ord, key, text, number) of rows."""
    return rows.select("ord", F.explode("fields").alias("f")).select("ord", "f.*")


def _top(counts: DataFrame, name: str, top: int | None) -> DataFrame:
    return counts if top is None else counts.orderBy(F.desc("n"), "first_ord", name).limit(top)


def label_counts(rows: DataFrame, top: int | None = None) -> DataFrame:
    """(label, n, first_ord): the first label that is set and not empty, zero or false, shown safely; the ``top`` most frequent, ties as first seen."""
    return _top(rows.groupBy(safe_label("event").alias("label")).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord")), "label", top)


def field_counts(rows: DataFrame, top: int | None = None) -> DataFrame:
    """(field, n, first_ord); secret-like names are left out, shown ones like ``redacted_key`` too."""
    long = flat(rows).filter(~is_sensitive("key"))
    return _top(long.groupBy(F.col("key").alias("field")).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord")), "field", top)


def summary(rows: DataFrame, value: str, by: list[str] | None = None, rounding: int = 6) -> DataFrame:
    """n, min, p05, median, mean, p95, max and population deviation, exact.

    Values are counted first, so that equal ones cost one row; their running counts, in a window by the group, give the
    two neighbours that a quantile lies between.
    """
    by = by or []
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    r = lambda c: F.round(c, rounding)
    order = Window.partitionBy(*by).orderBy("v")
    whole = Window.partitionBy(*by)
    placed = counted.withColumn("end", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("c").over(whole))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("end") > rank) & (F.col("end") - F.col("c") <= rank), F.col("v")))

    quantiles, out = {"p05": 0.05, "median": 0.5, "p95": 0.95}, []
    for name, q in quantiles.items():
        rank = F.lit(q) * (F.col("total") - 1)
        out += [at(F.floor(rank)).alias(f"{name}_low"), at(F.ceil(rank)).alias(f"{name}_high"), F.max(rank - F.floor(rank)).alias(f"{name}_part")]
    n, mean = F.sum("c"), F.sum(F.col("v") * F.col("c")) / F.sum("c")
    grouped = (placed.groupBy(*by) if by else placed.groupBy()).agg(n.alias("n"), F.min("v").alias("min"), mean.alias("mean"), F.max("v").alias("max"), *out)
    spread = counted.join(grouped.select(*by, F.col("mean").alias("m")), by, "inner") if by else counted.crossJoin(grouped.select(F.col("mean").alias("m")))  # one row
    deviation = F.sqrt(F.sum(F.col("c") * (F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))) / F.sum("c"))
    sd = (spread.groupBy(*by) if by else spread.groupBy()).agg(deviation.alias("sd"))
    full = grouped.join(sd, by) if by else grouped.crossJoin(sd)  # one row each
    lie = lambda x: r(F.col(f"{x}_low") * (1 - F.col(f"{x}_part")) + F.col(f"{x}_high") * F.col(f"{x}_part")).alias(x)
    return full.select(*by, F.coalesce("n", F.lit(0)).cast("long").alias("n"), r(F.col("min")).alias("min"), lie("p05"), lie("median"), r(F.col("mean")).alias("mean"), lie("p95"), r(F.col("max")).alias("max"), r(F.col("sd")).alias("sd"))


def numeric_fields(rows: DataFrame, top: int | None = None) -> DataFrame:
    """field and its summary; the ``top`` with the most values, ties as first seen."""
    long = flat(rows).filter(~is_sensitive("key") & F.col("number").isNotNull())
    found = summary(long, "number", ["key"]).withColumnRenamed("key", "field")
    if top is None:
        return found
    first = long.groupBy(F.col("key").alias("field")).agg(F.min("ord").alias("first_ord"))
    return found.join(first, "field").orderBy(F.desc("n"), "first_ord", "field").limit(top).drop("first_ord")


def group_metrics(rows: DataFrame, group_by: str, metrics: list[str]) -> DataFrame:
    """label, rows, metric and its summary: a row without the group is ``unknown``; a group without values of a metric has a row with n 0."""
    label = safe_label(F.get(F.filter("fields", lambda f: f["key"] == group_by), F.lit(0))["text"])
    named = rows.withColumn("label", label)
    counts = named.groupBy("label").agg(F.count("*").alias("rows"))
    asked = F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric")
    long = named.select("label", F.explode("fields").alias("f")).select("label", F.col("f.key").alias("metric"), F.col("f.number").alias("number"))
    long = long.filter(F.col("metric").isin(metrics) & ~is_sensitive("metric") & F.col("number").isNotNull())
    found = summary(long, "number", ["label", "metric"])
    return counts.select("label", "rows", asked).join(found, ["label", "metric"], "left").fillna(0, ["n"])
