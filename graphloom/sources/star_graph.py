"""A property graph over the star-schema tables: typed nodes and provenance-carrying assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import assertion_id
from graphloom.session import table

NODE = ["id", "type", "label", "props", "sources"]
EDGE = ["id", "from", "rel", "to", "source", "recorded"]


def _nodes(df: DataFrame, kind: str, key: str, label: str, props: dict[str, str]) -> DataFrame:
    pairs = [x for k, c in props.items() for x in (F.lit(k), F.col(c).cast("string"))]
    name = kind.lower()
    return df.select(
        F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("id"),
        F.lit(kind).alias("type"),
        F.expr(label).cast("string").alias("label"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("props"),
        F.array(F.concat(F.lit(f"{name}#"), F.col(key).cast("string"))).alias("sources"),
    )


def nodes(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("Region", "Nation", "Supplier", "Customer")) -> DataFrame:
    made = {
        "Region": lambda: _nodes(table(spark, sf_dir, "region"), "Region", "r_regionkey", "r_name", {}),
        "Nation": lambda: _nodes(table(spark, sf_dir, "nation"), "Nation", "n_nationkey", "n_name", {}),
        "Supplier": lambda: _nodes(table(spark, sf_dir, "supplier"), "Supplier", "s_suppkey", "s_name", {}),
        "Customer": lambda: _nodes(table(spark, sf_dir, "customer"), "Customer", "c_custkey", "c_name", {"mktsegment": "c_mktsegment"}),
        "Part": lambda: _nodes(table(spark, sf_dir, "part"), "Part", "p_partkey", "p_name", {"brand": "p_brand", "size": "p_size"}),
        "Order": lambda: _nodes(table(spark, sf_dir, "orders"), "Order", "o_orderkey", "o_orderkey", {"status": "o_orderstatus"}),
    }
    out = None
    for k in kinds:
        out = made[k]() if out is None else out.unionByName(made[k]())
    return out


def edges(spark: SparkSession, sf_dir: str, rels: tuple[str, ...] = ("part_of",)) -> DataFrame:
    """``trades_with`` joins each supplier to the next of its nation, so it grows with the suppliers only."""
    t = lambda n: table(spark, sf_dir, n)

    def side(kind: str, col: str):
        return F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))

    def edge(df: DataFrame, a, rel: str, b, source) -> DataFrame:
        return df.select(a.alias("from"), F.lit(rel).alias("rel"), b.alias("to"), source.alias("source"))

    parts = []
    if "part_of" in rels:
        parts.append(edge(t("nation"), side("nation", "n_nationkey"), "part_of", side("region", "n_regionkey"), F.concat(F.lit("nation#"), F.col("n_nationkey").cast("string"))))
        parts.append(edge(t("supplier"), side("supplier", "s_suppkey"), "part_of", side("nation", "s_nationkey"), F.concat(F.lit("supplier#"), F.col("s_suppkey").cast("string"))))
        parts.append(edge(t("customer"), side("customer", "c_custkey"), "part_of", side("nation", "c_nationkey"), F.concat(F.lit("customer#"), F.col("c_custkey").cast("string"))))
    if "placed_by" in rels:
        parts.append(edge(t("orders"), side("order", "o_orderkey"), "placed_by", side("customer", "o_custkey"), F.concat(F.lit("orders#"), F.col("o_orderkey").cast("string"))))
    if "includes" in rels:
        parts.append(edge(t("lineitem"), side("order", "l_orderkey"), "includes", side("part", "l_partkey"), F.concat_ws("", F.lit("lineitem#"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))))
    if "supplied_by" in rels:
        pairs = t("lineitem").select("l_partkey", "l_suppkey").distinct()
        parts.append(edge(pairs, side("part", "l_partkey"), "supplied_by", side("supplier", "l_suppkey"), F.concat_ws("", F.lit("lineitem#part-"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))))
    if "trades_with" in rels:
        after = F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
        pairs = t("supplier").select("s_suppkey", after.alias("s2")).filter("s2 IS NOT NULL")
        parts.append(edge(pairs, side("supplier", "s_suppkey"), "trades_with", side("supplier", "s2"), F.lit("supplier#trades")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("id", assertion_id("from", "rel", "to", "source")).withColumn("recorded", F.lit("2024-01-01")).select(*EDGE)


#: The same graph for the SQL checks.
NODES_SQL = """nodes AS (
SELECT 'region:' || r_regionkey AS id, 'Region' AS type, r_name AS label, 'region#' || r_regionkey AS src FROM region
UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, 'nation#' || n_nationkey FROM nation
UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name, 'supplier#' || s_suppkey FROM supplier
UNION ALL SELECT 'customer:' || c_custkey, 'Customer', c_name, 'customer#' || c_custkey FROM customer)"""
PART_OF_SQL = """SELECT 'nation:' || n_nationkey AS f, 'part_of' AS rel, 'region:' || n_regionkey AS t, 'nation#' || n_nationkey AS source FROM nation
UNION ALL SELECT 'supplier:' || s_suppkey, 'part_of', 'nation:' || s_nationkey, 'supplier#' || s_suppkey FROM supplier
UNION ALL SELECT 'customer:' || c_custkey, 'part_of', 'nation:' || c_nationkey, 'customer#' || c_custkey FROM customer"""
TRADES_SQL = "SELECT 'supplier:' || s_suppkey AS f, 'trades_with' AS rel, 'supplier:' || s2 AS t, 'supplier#trades' AS source FROM (SELECT s_suppkey, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS s2 FROM supplier) WHERE s2 IS NOT NULL"
PLACED_SQL = "SELECT 'order:' || o_orderkey AS f, 'placed_by' AS rel, 'customer:' || o_custkey AS t, 'orders#' || o_orderkey AS source FROM orders"
INCLUDES_SQL = "SELECT 'order:' || l_orderkey AS f, 'includes' AS rel, 'part:' || l_partkey AS t, 'lineitem#' || l_orderkey || '-' || l_linenumber AS source FROM lineitem"
SUPPLIED_SQL = "SELECT DISTINCT 'part:' || l_partkey AS f, 'supplied_by' AS rel, 'supplier:' || l_suppkey AS t, 'lineitem#part-' || l_partkey || '-' || l_suppkey AS source FROM lineitem"


def gv(*parts: str) -> str:
    """CTEs ``nodes`` and ``edges`` (f, rel, t, source) for the SQL checks."""
    return NODES_SQL + ", edges AS (" + " UNION ALL ".join(parts or (PART_OF_SQL,)) + ")"
