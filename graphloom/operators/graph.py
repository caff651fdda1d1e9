"""Graph operators: degree, neighbourhoods, paths, ranks, similarity, communities, identity and cards."""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import norm
from graphloom.operators import names as N
from graphloom.operators import neighbours as B
from graphloom.operators.components import connected_components
from graphloom.session import cut


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("from", "to")).alias("id"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): parallel assertions count, a self-loop counts twice."""
    counted = ends(edges).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) neighbour sets, undirected."""
    return edges.select(F.col("from").alias("a"), F.col("to").alias("b")).union(edges.select(F.col("to").alias("a"), F.col("from").alias("b"))).distinct()


def neighborhood(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 1, rel: str | None = None, direction: str = "both") -> DataFrame:
    """(depth, from, rel, to): assertions met in breadth-first order, also those back to visited nodes; of one relation
    and one direction (out, in) if asked."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"no such direction: {direction}")
    edges = edges.filter(F.col("rel") == rel) if rel else edges
    known = nodes.select("id")
    frontier = known.filter(F.col("id") == start)
    seen, out = frontier, None
    for d in range(1, depth + 1):
        met = None
        for own, other in (("from", "to"), ("to", "from")):
            if direction == {"from": "in", "to": "out"}[own]:
                continue
            side = edges.join(frontier, edges[own] == frontier["id"], "left_semi").join(known, F.col(other) == known["id"], "left_semi").select("from", "rel", "to", F.col(other).alias("other"))
            met = side if met is None else met.unionByName(side)
        met = cut(met.distinct())
        row = met.select(F.lit(d).alias("depth"), "from", "rel", "to").distinct()
        out = row if out is None else out.unionByName(row)
        frontier = met.select(F.col("other").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = seen.unionByName(frontier)
    return out


def _steps(edges: DataFrame, directed: bool, rels: list[str] | None) -> DataFrame:
    of_rel = edges.filter(F.col("rel").isin(rels)) if rels else edges
    step = of_rel.select(F.col("from").alias("id"), F.col("to").alias("next"), "rel", F.lit(0).alias("turned"))
    return step if directed else step.unionByName(of_rel.select(F.col("to").alias("id"), F.col("from").alias("next"), "rel", F.lit(1).alias("turned")))


def distances(edges: DataFrame, start: str, directed: bool = False, rels: list[str] | None = None) -> DataFrame:
    """(id, distance) of all that breadth-first search reaches from ``start``, however far."""
    return _search(edges, start, directed, rels, None)[0].select("id", "distance")


def _search(edges: DataFrame, start: str, directed: bool, rels: list[str] | None, goal: str | None) -> tuple[DataFrame, bool]:
    """(id, distance, came, rel, turned) of what is reached, each by its least step (predecessor, direction, relation), and
    whether the goal is among it. Visited rows are written again now and then, so plans stay short."""
    step = cut(_steps(edges, directed, rels).distinct())
    seen = cut(edges.sparkSession.createDataFrame([(start, 0, None, None, None)], "id string, distance int, came string, rel string, turned int"))
    last, d = seen, 0
    while True:
        d += 1
        ways = last.select("id").join(step, "id").join(seen.select(F.col("id").alias("next")), "next", "left_anti")
        new = ways.groupBy("next").agg(F.min(F.struct(F.col("id").alias("came"), "turned", "rel")).alias("w"))
        last = cut(new.select(F.col("next").alias("id"), F.lit(d).alias("distance"), "w.came", "w.rel", "w.turned"))
        if last.isEmpty():
            return seen, False
        seen = seen.unionByName(last)
        seen = cut(seen) if d % 8 == 0 else seen
        if goal is not None and not last.filter(F.col("id") == goal).isEmpty():
            return seen, True


def shortest_path(nodes: DataFrame, edges: DataFrame, start: str, goal: str, directed: bool = False, rels: list[str] | None = None) -> DataFrame:
    """(place, id, rel, turned) of a path of fewest steps: of several, each node's least predecessor; ``rel`` and
    ``turned`` (1: against the assertion) tell the step to the node. Raises where there is none. Rows are as many as steps."""
    known = {r[0] for r in nodes.filter(F.col("id").isin(start, goal)).select("id").collect()}
    if lost := {start, goal} - known:
        raise ValueError(f"no such node: {sorted(lost)}")
    spark, schema = nodes.sparkSession, "place int, id string, rel string, turned int"
    if start == goal:
        return spark.createDataFrame([(0, start, None, None)], schema)
    inside = edges.join(nodes.select(F.col("id").alias("from")), "from", "left_semi").join(nodes.select(F.col("id").alias("to")), "to", "left_semi")
    seen, found = _search(inside, start, directed, rels, goal)
    if not found:
        raise ValueError(f"no path from {start} to {goal}")
    rows, at = [], goal
    while at != start:
        r = seen.filter(F.col("id") == at).first()
        rows.append((r["distance"], at, r["rel"], r["turned"]))
        at = r["came"]
    return spark.createDataFrame([(0, start, None, None), *reversed(rows)], schema)


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 25, damping: float = 0.85) -> DataFrame:
    """(id, rank): synchronous rounds; parallel assertions weigh; what dangles is not dealt out again."""
    known = cut(nodes.select("id"))
    n = max(1, known.count())
    out = edges.groupBy("from").agg(F.count("*").alias("out"))
    flow = cut(edges.join(known, edges["to"] == known["id"], "left_semi").groupBy("from", "to").agg(F.count("*").alias("w")).join(out, "from").select(F.col("from").alias("id"), "to", (F.col("w") / F.col("out")).alias("w")))
    rank = known.withColumn("rank", F.lit(1.0 / n))
    for i in range(rounds):
        sent = rank.join(flow, "id").groupBy("to").agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        rank = known.join(sent, known["id"] == sent["to"], "left").select("id", (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 5 == 4:
            rank = cut(rank)
    return rank


def important(nodes: DataFrame, edges: DataFrame, top: int = 12) -> DataFrame:
    """(id, rank, degree) of the highest ranks; ties by degree, then id."""
    ranked = pagerank(nodes, edges).withColumn("rank", F.round("rank", 9))
    return ranked.join(degree(nodes, edges), "id").orderBy(F.desc("rank"), F.desc("degree"), "id").limit(top)


def similar_to(edges: DataFrame, node: str, top: int = 8, rounding: int = 6) -> DataFrame:
    """(id, shared, jaccard, linked): nodes that share neighbours with one node, most alike first, ids descending;
    ``linked`` tells those that it has an assertion with. Work goes with the neighbours of its neighbours."""
    nb = both_ways(edges)
    own = nb.filter(F.col("a") == node).select("b")
    sizes = nb.groupBy("a").agg(F.count("*").alias("n"))
    shared = nb.join(own, "b", "left_semi").filter(F.col("a") != node).groupBy("a").agg(F.count("*").alias("shared"))
    full = shared.join(sizes, "a").crossJoin(own.agg(F.count("*").alias("m")))  # one row
    scored = full.select(F.col("a").alias("id"), "shared", F.round(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")), rounding).alias("jaccard"))
    direct = own.select(F.col("b").alias("id"), F.lit(True).alias("linked"))
    return scored.join(direct, "id", "left").withColumn("linked", F.coalesce("linked", F.lit(False))).orderBy(F.desc("jaccard"), F.desc("id")).limit(top)


def similar(edges: DataFrame, rounding: int = 6) -> DataFrame:
    """(a, b, shared, jaccard) of nodes with a common neighbour, a < b, by partial counts on the neighbour."""
    nb = both_ways(edges)
    size = nb.groupBy("a").agg(F.count("*").alias("n"))
    other = nb.select(F.col("a").alias("c"), "b")
    shared = nb.join(other, "b").filter(F.col("a") < F.col("c")).groupBy("a", "c").agg(F.count("*").alias("shared"))
    full = shared.join(size, "a").join(size.select(F.col("a").alias("c"), F.col("n").alias("m")), "c")
    return full.select("a", F.col("c").alias("b"), "shared", F.round(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")), rounding).alias("jaccard"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node, alone if it has no neighbour."""
    known = nodes.select("id")
    inside = edges.join(known, edges["from"] == known["id"], "left_semi").join(known, F.col("to") == known["id"], "left_semi")
    found = connected_components(inside.select(F.col("from").alias("a"), F.col("to").alias("b")))
    return known.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(id, community) by asynchronous label propagation in id order. Components are independent, so each runs alone."""
    comp = components(nodes, edges)
    near = both_ways(edges).join(comp, F.col("a") == comp["id"]).groupBy("component", "a").agg(F.collect_set("b").alias("near"))

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        around = dict(zip(pdf["a"], pdf["near"], strict=True))
        label = {i: i for i in around}
        for _ in range(rounds):
            changed = False
            for i in sorted(around):
                votes: dict[str, int] = {}
                for j in around[i]:
                    if j in label:
                        votes[label[j]] = votes.get(label[j], 0) + 1
                if votes:
                    n, best = max((c, k) for k, c in votes.items())
                    if best != label[i] and n > votes.get(label[i], 0):
                        label[i], changed = best, True
            if not changed:
                break
        return pd.DataFrame({"id": list(label), "community": list(label.values())})

    found = near.groupBy("component").applyInPandas(spread, "id string, community string")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def gazetteer(nodes: DataFrame) -> DataFrame:
    """(key, ids): normalised labels and aliases with the sorted ids that bear them."""
    alias = F.col("aliases") if "aliases" in nodes.columns else F.array().cast("array<string>")
    names = nodes.select("id", F.explode(F.array_append(F.coalesce(alias, F.array().cast("array<string>")), F.col("label"))).alias("name"))
    return names.select("id", norm("name").alias("key")).filter("key <> ''").groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def surface_duplicates(nodes: DataFrame) -> DataFrame:
    """(key, ids) of id sets that share a surface form, one report an id set."""
    return gazetteer(nodes).filter(F.size("ids") > 1).groupBy("ids").agg(F.min("key").alias("key")).select("key", "ids")


def resolve(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, status, ids): exact id, unique or ambiguous surface form, else none."""
    exact = terms.join(nodes.select(F.col("id").alias("term"), F.lit(True).alias("is_id")), "term", "left")
    found = exact.join(gazetteer(nodes), norm("term") == F.col("key"), "left")
    status = F.when(F.col("is_id"), "exact").when(F.size("ids") == 1, "unique").when(F.size("ids") > 1, "ambiguous").otherwise("none")
    return found.select("term", status.alias("status"), F.when(F.col("is_id"), F.array("term")).otherwise(F.col("ids")).alias("ids"))


def suggest(nodes: DataFrame, term: str, most: int = 5) -> DataFrame:
    """(id) for a term that nothing bears: ids of surface forms that hold it, else ids that are close to it."""
    inside = gazetteer(nodes).filter(F.contains("key", norm(F.lit(term)))).select(F.explode("ids").alias("id")).distinct().orderBy("id").limit(most)
    if not inside.isEmpty():
        return inside

    @F.pandas_udf("double")
    def closeness(ids: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, i, term).ratio() for i in ids], dtype="float64")

    near = nodes.select("id", closeness("id").alias("ratio")).filter("ratio >= 0.5")
    return near.orderBy(F.desc("ratio"), F.desc("id")).limit(most).select("id")


def find(nodes: DataFrame, edges: DataFrame, text: str, kind: str | None = None, limit: int = 15, deep: bool = False) -> DataFrame:
    """(id, label, degree): normalised substring in label, id or an alias, and with ``deep`` in description and
    properties; most connected first, ids descending. A text without letters or digits finds every node."""
    q = norm(F.lit(text))
    held = [norm("label"), norm("id")]
    if deep and "description" in nodes.columns:
        held.append(norm("description"))
    if deep:
        held.append(norm(F.to_json("props")))
    hit = F.lit(False)
    for c in held:
        hit = hit | F.coalesce(F.contains(c, q), F.lit(False))
    if "aliases" in nodes.columns:
        hit = hit | F.coalesce(F.exists("aliases", lambda x: F.contains(norm(x), q)), F.lit(False))
    found = nodes.filter(hit & (F.col("type") == kind) if kind else hit)
    return found.join(degree(nodes, edges), "id").select("id", "label", "degree").orderBy(F.desc("degree"), F.desc("id")).limit(limit)


#: Tasks that one block of names is dealt over.
SALTS = 64
#: Pairs that one task compares, names of a block for each further task, and tasks of a block by neighbours at most.
PAIRS_A_TASK = 150_000_000
NAMES_A_TASK = 100_000
PARTS = 16


def ratio_from(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """The sequence ratio of two names, null where letter counts show that it is below ``least``."""
    known: dict[tuple[str, str], float | None] = {}
    counts: dict[str, Counter] = {}
    for x, y, bound in zip(a, b, least, strict=True):
        if (x, y) not in known:
            for t in (x, y):
                if t not in counts:
                    counts[t] = Counter(t)
            p, q = counts[x], counts[y]
            common = sum([min(n, q[c]) for c, n in p.items() if c in q])
            # one batch has one bound
            known[x, y] = difflib.SequenceMatcher(None, x, y).ratio() if 2 * common >= bound * (len(x) + len(y)) else None
    return pd.Series([known[k] for k in zip(a, b, strict=True)], dtype="float64")


def shared_neighbours(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b, shared) of nodes of one block (type, first) with a common neighbour, a < b."""
    nb = both_ways(edges).join(names.select(F.col("id").alias("a"), "type", "first"), "a").select("a", F.col("b").alias("via"), "type", "first")
    return nb.join(nb.withColumnRenamed("a", "b"), ["via", "type", "first"]).filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))


def _alike(pairs: DataFrame, bound: float) -> DataFrame:
    # ratio <= 2*min/(n+m), so pairs of too unlike lengths need no look
    close = pairs.filter((F.col("a") < F.col("b")) & (2 * F.least("n", "m") >= bound * (F.col("n") + F.col("m"))))
    ratio = F.pandas_udf(ratio_from, "double")
    return close.withColumn("ratio", ratio("name", "other", F.lit(bound))).filter(F.col("ratio") >= bound).select("a", "b", "ratio")


def fuzzy_duplicates(nodes: DataFrame, edges: DataFrame, least: float = 0.82, least_shared: float = 0.6, shared: int = 2) -> DataFrame:
    """(a, b, ratio): label pairs of one type and first letter whose sequence ratio is at least ``least``, or at least
    ``least_shared`` if the nodes have ``shared`` neighbours in common. Pairs that alone share a surface form are left out."""
    names = nodes.select("id", "type", norm("label").alias("name")).filter("name <> ''").withColumns({"first": F.substring("name", 1, 1), "n": F.length("name")})
    names = cut(names)
    other = names.select(F.col("id").alias("b"), "type", "first", F.col("name").alias("other"), F.col("n").alias("m"))

    left = names.withColumnRenamed("id", "a").repartition(SALTS, "a").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    salted = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # The salted side is larger than its statistics tell, so it must not be broadcast.
    by_name = _alike(left.join(salted.hint("merge"), ["type", "first", "salt"]), least)
    near = shared_neighbours(edges, names).filter(F.col("shared") >= shared)
    linked = near.join(names.select(F.col("id").alias("a"), "name", "n"), "a").join(other.select("b", "other", "m"), "b")
    found = by_name.unionByName(_alike(linked, least_shared).filter(F.col("ratio") < least))
    exact = surface_duplicates(nodes).filter(F.size("ids") == 2).select(F.col("ids")[0].alias("a"), F.col("ids")[1].alias("b"))
    return found.join(exact, ["a", "b"], "left_anti").select("a", "b", F.round("ratio", 6).alias("ratio"))


def _lists(column: pa.ChunkedArray) -> list:
    return column.to_pylist() if column.null_count < len(column) else [None] * len(column)


def _links_by_name(least: float):
    def run(block: pa.Table) -> pa.Table:
        first = block.slice(0, 1).to_pylist()[0]
        told = N.links(block["num"].to_numpy(), block["name"].to_pylist(), _lists(block["skip"]), least, first["part"], first["parts"])
        return pa.Table.from_pandas(told, preserve_index=False)

    return run


def _links_by_neighbours(least: float, below: float, shared: int):
    def run(block: pa.Table) -> pa.Table:
        first = block.slice(0, 1).to_pylist()[0]
        around, named = block.filter(pc.is_valid(block["members"])), block.filter(pc.is_valid(block["num"]))
        members = around["members"].combine_chunks()
        size = pc.list_value_length(members).to_numpy(zero_copy_only=False)
        told = B.links(named["num"].to_numpy(), named["name"].to_pylist(), _lists(named["skip"]), pc.list_flatten(members).to_numpy(zero_copy_only=False), size, least, below, shared, first["part"], first["parts"])
        return pa.Table.from_pandas(told, preserve_index=False)

    return run


def _joined(block: pa.Table) -> pa.Table:
    """The classes of one block, from the classes that its tasks found."""
    block = block.sort_by("num")
    num, ends = block["num"].to_numpy(), block["roots"].combine_chunks()
    at = np.repeat(np.arange(len(num)), pc.list_value_length(ends).to_numpy(zero_copy_only=False))
    forest = N.Forest(len(num))
    forest.join(at, np.searchsorted(num, pc.list_flatten(ends).to_numpy(zero_copy_only=False)))
    return pa.table({"num": num, "links": block["links"], "root": num[forest.root]})


def fuzzy_classes(nodes: DataFrame, edges: DataFrame, least: float = 0.82, least_shared: float = 0.6, shared: int = 2) -> DataFrame:
    """(a, component, links) of every node: in how many pairs of ``fuzzy_duplicates`` it is, and the smallest node that
    those pairs connect it with, itself if none. Pairs by names and those by neighbours are counted where they are found,
    neither leaves its block (type, first), and only edges of a spanning forest leave a task."""
    told, block = "num long, links long, root long", ["type", "first"]
    named = nodes.select("id", "type", norm("label").alias("name")).filter("name <> '' AND type IS NOT NULL")
    # numbers in the order of ids
    names = cut(named.sort("id").withColumns({"num": F.monotonically_increasing_id(), "first": F.substring("name", 1, 1)}))
    of = lambda c: names.select(F.col("id").alias(f"{c}_id"), F.col("num").alias(c))
    exact = surface_duplicates(nodes).filter(F.size("ids") == 2).select(F.col("ids")[0].alias("a_id"), F.col("ids")[1].alias("b_id"))
    exact = exact.join(of("a"), "a_id").join(of("b"), "b_id").select("a", "b")
    skip = exact.select(F.explode(F.array(F.struct(F.col("a").alias("num"), "b"), F.struct(F.col("b").alias("num"), F.col("a").alias("b")))).alias("e")).select("e.*").groupBy("num").agg(F.collect_set("b").alias("skip"))
    dealt = cut(names.join(skip, "num", "left").select("num", "name", "skip", *block))

    def deal(rows: DataFrame, parts: DataFrame) -> DataFrame:
        """Every row of a block for each of its tasks; by ranges, as a hash puts several large tasks in one partition."""
        each = rows.join(F.broadcast(parts), block).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return each.repartitionByRange(SALTS, *block, "part").groupBy(*block, "part")

    k = F.count_distinct("name")
    parts = dealt.groupBy(*block).agg(F.least(F.ceil((k * k + 1) / (2 * PAIRS_A_TASK)), F.ceil(k / NAMES_A_TASK) + 2).cast("int").alias("parts"))
    by_name = cut(deal(dealt, parts).applyInArrow(_links_by_name(least), told))

    ways = F.array(F.struct(F.col("from").alias("id"), F.col("to").alias("via")), F.struct(F.col("to").alias("id"), F.col("from").alias("via")))
    nb = edges.select(F.explode(ways).alias("e")).select("e.*").filter("via IS NOT NULL").join(names.select("id", "num", *block), "id")
    around = cut(nb.groupBy("via", *block).agg(F.collect_set("num").alias("members")).filter(F.size("members") > 1).select("members", *block))
    work = F.sum(F.pow(F.size("members"), F.lit(2)))
    parts = around.groupBy(*block).agg(F.least(F.ceil(work / PAIRS_A_TASK), F.lit(PARTS)).cast("int").alias("parts"))
    rows = around.unionByName(dealt, allowMissingColumns=True)
    by_both = cut(deal(rows, parts).applyInArrow(_links_by_neighbours(least_shared, least, shared), told))

    found = by_name.unionByName(by_both).groupBy("num").agg(F.sum("links").alias("links"), F.collect_set("root").alias("roots"))
    joined = cut(found.join(names.select("num", *block), "num").repartition(SALTS, *block).groupBy(*block).applyInArrow(_joined, told))
    placed = joined.join(names.select("num", "id"), "num").join(names.select(F.col("num").alias("root"), F.col("id").alias("component")), "root")
    rest = nodes.select("id").join(placed.select("id", "component", "links"), "id", "left")
    return rest.select(F.col("id").alias("a"), F.coalesce("component", "id").alias("component"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def show(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(direction, rel, other) of a node's assertions."""
    out = edges.filter(F.col("from") == node).select(F.lit("out").alias("direction"), "rel", F.col("to").alias("other"))
    return out.unionByName(edges.filter(F.col("to") == node).select(F.lit("in").alias("direction"), "rel", F.col("from").alias("other")))


def context(edges: DataFrame, node: str) -> DataFrame:
    """(direction, rel, others): sorted, comma-joined ends by relation."""
    return show(edges, edges, node).groupBy("direction", "rel").agg(F.array_join(F.sort_array(F.collect_list("other")), ", ").alias("others"))


def second_ring(nodes: DataFrame, edges: DataFrame, node: str, top: int = 10) -> DataFrame:
    """(id, degree): nodes two steps away and not nearer, most connected first."""
    nb = both_ways(edges)
    one = nb.filter(F.col("a") == node).select(F.col("b").alias("id")).distinct()
    two = nb.join(one, F.col("a") == F.col("id")).select(F.col("b").alias("id")).distinct()
    ring = two.join(one, "id", "left_anti").filter(F.col("id") != node)
    return ring.join(degree(nodes, edges), "id").orderBy(F.desc("degree"), "id").limit(top)


def component_sizes(groups: DataFrame, by: str = "component", first: int = 6) -> DataFrame:
    """(by, size, members): largest first, then the smallest member; ``members`` names the first few."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("id"))
    named = groups.withColumn("place", place).filter(F.col("place") <= first).groupBy(by).agg(F.sort_array(F.collect_list("id")).alias("members"))
    sized = groups.groupBy(by).agg(F.count("*").alias("size"))
    return sized.join(named, by).select(by, "size", "members").orderBy(F.desc("size"), F.col("members")[0])


def orphans(groups: DataFrame, first: int = 6) -> DataFrame:
    """component_sizes with ``kind``: one main component, the largest (of equals that of the smallest member), orphans of one node, islands."""
    sized = component_sizes(groups, "component", first)
    top = sized.limit(1).select(F.col("component").alias("main"))
    kind = F.when(F.col("component") == F.col("main"), "main").when(F.col("size") == 1, "orphan").otherwise("island")
    return sized.crossJoin(top).select("component", "size", "members", kind.alias("kind"))  # one row
