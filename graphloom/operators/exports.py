"""Graph exports as lines: CSV, GraphML, Mermaid, and a page with the graph as JSON. A caller writes the lines in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import xml_escape
from graphloom.operators.graph import degree

# Heads of the formats and the edges that a diagram shows.
GRAPHML_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
    '<key id="label" for="node" attr.name="label" attr.type="string"/>',
    '<key id="type" for="node" attr.name="type" attr.type="string"/>',
    '<key id="rel" for="edge" attr.name="rel" attr.type="string"/>',
    '<graph edgedefault="directed">',
)
GRAPHML_FOOT = ("</graph>", "</graphml>")
MERMAID_EDGES = 300


def csv_field(x: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line break; null is empty."""
    text = F.coalesce(x, F.lit(""))
    return F.when(text.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _csv(df: DataFrame, file: str, columns: dict[str, Column]) -> DataFrame:
    head = df.sparkSession.createDataFrame([(file, -1, ",".join(columns))], "file string, ord int, line string")
    return head.unionByName(df.select(F.lit(file).alias("file"), F.lit(0).alias("ord"), F.concat_ws(",", *[csv_field(c) for c in columns.values()]).alias("line")))


def csv_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, ord, line): heads (ord -1) and rows of nodes and edges; lists are joined by ``|``, properties left out, dangling edges kept."""
    joined = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "|") if c in nodes.columns else F.lit("")
    n = _csv(nodes, "nodes", {"id": F.col("id"), "type": F.col("type"), "label": F.col("label"), "aliases": joined("aliases"), "sources": joined("sources")})
    return n.unionByName(_csv(edges, "edges", {c: F.col(c) for c in ("from", "rel", "to", "source", "recorded")}))


def _inside(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    for end in ("from", "to"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, line) of a GraphML document; dangling edges are left out."""
    spark = nodes.sparkSession
    fixed = lambda at, lines: spark.createDataFrame([(at + i, x) for i, x in enumerate(lines)], "ord int, line string")
    data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), F.coalesce(xml_escape(c), F.lit("")), F.lit("</data>"))
    n = nodes.select(F.lit(10).alias("ord"), F.concat(F.lit('<node id="'), xml_escape("id"), F.lit('">'), data("label", "label"), data("type", "type"), F.lit("</node>")).alias("line"))
    e = _inside(nodes, edges).select(F.lit(11).alias("ord"), F.concat(F.lit('<edge source="'), xml_escape("from"), F.lit('" target="'), xml_escape("to"), F.lit('">'), data("rel", "rel"), F.lit("</edge>")).alias("line"))
    return fixed(0, GRAPHML_HEAD).unionByName(n).unionByName(e).unionByName(fixed(12, GRAPHML_FOOT))


def mermaid_lines(nodes: DataFrame, edges: DataFrame, most: int = MERMAID_EDGES) -> DataFrame:
    """(ord, line) of a flow chart of the first ``most`` assertions, in order of their ends, whose ends are nodes, with a remark where there are more. Node numbers go by id."""
    spark = nodes.sparkSession
    first = edges.orderBy("from", "to", "source").limit(most)
    used = first.select(F.explode(F.array("from", "to")).alias("id")).distinct()
    # Only the few nodes of the chart need a number: how many ids come before theirs.
    shown = nodes.join(F.broadcast(used), "id", "left_semi").select("id", "label")  # at most two a shown edge
    below = nodes.select(F.col("id").alias("o")).join(F.broadcast(shown.select("id")), F.col("o") < F.col("id")).groupBy("id").agg(F.count("*").alias("k"))
    named = shown.join(below, "id", "left").select("id", "label", F.concat(F.lit("n"), F.coalesce("k", F.lit(0)).cast("string")).alias("k"))
    end = lambda c: named.select(F.col("id").alias(c), F.col("k").alias(f"{c}_k"))
    boxes = named.select(F.lit(1).alias("ord"), F.concat(F.lit("  "), "k", F.lit('["'), F.replace("label", F.lit('"'), F.lit("'")), F.lit('"]')).alias("line"))
    arrows = first.join(end("from"), "from").join(end("to"), "to").select(F.lit(2).alias("ord"), F.concat(F.lit("  "), "from_k", F.lit(" -->|"), "rel", F.lit("| "), "to_k").alias("line"))
    more = edges.agg(F.count("*").alias("c")).filter(F.col("c") > most).select(F.lit(3).alias("ord"), F.lit(f"  %% truncated at {most} edges").alias("line"))
    return spark.createDataFrame([(0, "graph LR")], "ord int, line string").unionByName(boxes).unionByName(arrows).unionByName(more)


PAGE = (
    '<!DOCTYPE html><meta charset="utf-8"><title>Graph</title><input id="q" placeholder="label or id"><select id="t"></select><ul id="r"></ul>'
    '<script type="application/json" id="graph">',
    "</script><script>const g=JSON.parse(document.getElementById('graph').textContent),q=document.getElementById('q'),t=document.getElementById('t'),r=document.getElementById('r');"
    "for(const x of ['',...new Set(g.nodes.map(n=>n.type))])t.add(new Option(x||'all',x));"
    "function show(){const s=q.value.toLowerCase();r.replaceChildren(...g.nodes.filter(n=>(!t.value||n.type===t.value)&&(n.id+' '+n.label).toLowerCase().includes(s))"
    ".map(n=>{const li=document.createElement('li');li.textContent=`${n.label} (${n.id}) ${n.degree}`;return li}))}q.oninput=t.onchange=show;show()</script>",
)


def html_page(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, html: a page to look through the graph. It holds the graph whole, so it is for graphs that a browser can hold."""
    n = nodes.join(degree(nodes, edges), "id").agg(F.array_sort(F.collect_list(F.struct("id", "type", "label", "degree"))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct("from", "rel", "to"))).alias("edges"))
    payload = F.replace(F.to_json(F.struct("nodes", "edges")), F.lit("</"), F.lit("<\\/"))
    return n.crossJoin(e).select(F.concat(F.lit(PAGE[0]), payload, F.lit(PAGE[1])).alias("html"))  # one row each
