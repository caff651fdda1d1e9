"""Read service: bounded results with provenance, an overview, a health report, a search, paths and a session brief."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import validate as V

# Bounds of results.
MOST_FOUND, FOUND, PROVENANCE, BRIEF, OUTPUT = 50, 15, 100, 2400, 12_000


def node_provenance(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, source) of the nodes among ``ids`` (id)."""
    return nodes.join(ids.distinct(), "id", "left_semi").select("id", F.explode_outer("sources").alias("source"))


def edge_provenance(ids: DataFrame, edges: DataFrame, most: int = PROVENANCE) -> DataFrame:
    """Assertions with both ends among ``ids``, the first ``most`` by id."""
    known = ids.select("id").distinct()
    inside = edges.join(known.select(F.col("id").alias("from")), "from", "left_semi").join(known.select(F.col("id").alias("to")), "to", "left_semi")
    return inside.select("id", "from", "rel", "to", "source").orderBy("id").limit(most)


def truncated(text, most: int = OUTPUT):
    """Text of at most ``most`` characters, with a mark where it was cut."""
    mark = "\n... [truncated]"
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark)))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, sources, components, orphans."""
    sizes = G.components(nodes, edges).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.count_if(F.col("n") == 1).alias("orphans"))
    cited = V.cited_sources(nodes, edges).select(F.regexp_extract("source", "^([^#]+)#", 1).alias("path")).filter("path <> ''").agg(F.count_distinct("path").alias("sources"))
    # one row each
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(cited).crossJoin(sizes)


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, n): totals, nodes by type and assertions by relation."""
    t = totals(nodes, edges)
    rows = F.explode(F.array(*[F.struct(F.lit("total").alias("what"), F.lit(c).alias("name"), F.col(c).alias("n")) for c in t.columns])).alias("x")
    by = lambda df, what, c: df.groupBy(F.lit(what).alias("what"), F.coalesce(c, F.lit("?")).alias("name")).agg(F.count("*").alias("n"))
    return t.select(rows).select("x.*").unionByName(by(nodes, "type", "type")).unionByName(by(edges, "rel", "rel"))


def health(nodes: DataFrame, edges: DataFrame, schema: V.Schema, rules: tuple[str, ...] | None = None) -> DataFrame:
    """(severity, rule, subject, detail) of all rules over a graph."""
    out = None
    for name, rule in V.RULES.items():
        if rules is None or name in rules:
            part = rule(nodes, edges, schema).select(F.lit("I" if name == "selfloop" else "E").alias("severity"), F.lit(name).alias("rule"), "subject", "detail")
            out = part if out is None else out.unionByName(part)
    return out


def search(nodes: DataFrame, edges: DataFrame, text: str, kind: str | None = None, deep: bool = False, limit: int = FOUND) -> DataFrame:
    """What ``find`` gives, 1 to 50 rows, with its sources."""
    hits = G.find(nodes, edges, text, kind, min(max(int(limit), 1), MOST_FOUND), deep)
    return hits.join(nodes.select("id", "sources"), "id").orderBy(F.desc("degree"), F.desc("id"))


def path(nodes: DataFrame, edges: DataFrame, start: str, goal: str, rels: list[str] | None = None, directed: bool = False) -> DataFrame:
    """The steps of a shortest path with the sources of their nodes."""
    if rels is not None and len(rels) > 20:
        raise ValueError("at most 20 relations")
    steps = G.shortest_path(nodes, edges, start, goal, directed, rels)
    return steps.join(nodes.select("id", "sources"), "id", "left").orderBy("place")


def brief(nodes: DataFrame, edges: DataFrame, findings: DataFrame, top: int = 6, shown: int = 4) -> DataFrame:
    """One row: nodes, edges, top (ids by degree, then id), findings, first ones, text of at most ``BRIEF`` characters."""
    best = G.degree(nodes, edges).orderBy(F.desc("degree"), "id").limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("d"), "id"))).alias("b")).select(F.transform("b", lambda x: x["id"]).alias("top"))
    first = findings.orderBy("rule", "subject", "detail").limit(shown).agg(F.array_sort(F.collect_list(F.concat_ws(": ", "rule", "subject", "detail"))).alias("first"))
    counts = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(findings.agg(F.count("*").alias("findings")))  # one row each
    whole = counts.crossJoin(best).crossJoin(first)
    text = F.concat_ws("\n", F.concat_ws(" ", F.col("nodes").cast("string"), F.lit("nodes,"), F.col("edges").cast("string"), F.lit("assertions,"), F.col("findings").cast("string"), F.lit("findings")), F.array_join("top", ", "), F.array_join("first", "\n"))
    return whole.withColumn("text", truncated(text, BRIEF))
