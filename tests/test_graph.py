import difflib
import random

import numpy as np
import pytest

from graphloom.operators import graph as G
from graphloom.operators import names as N
from graphloom.operators import neighbours as B
from graphloom.operators.components import connected_components
from graphloom.plans.patterns import Graph, parse


@pytest.fixture()
def small(spark):
    nodes = spark.createDataFrame([(i, "T", i.upper(), {}, ["s#1"]) for i in "abcdefx"], "id string, type string, label string, props map<string,string>, sources array<string>")
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("c", "r", "d"), ("e", "r", "e"), ("d", "r", "gone"), ("a", "r", "b")], "`from` string, rel string, `to` string")
    return Graph(nodes, edges)


def test_closure_has_cycle_pairs_and_ends_at_nodes(small):
    got = {tuple(r) for r in small.closure("r").collect()}
    cycle = {(x, y) for x in "abc" for y in "abcd"}
    assert got == cycle | {("e", "e")}


def test_closure_seeds(small):
    assert {r["x"] for r in small.query(["?x r+ d"]).collect()} == {"a", "b", "c"}
    assert {r["y"] for r in small.query(["a r+ ?y"]).collect()} == {"a", "b", "c", "d"}


def test_closure_of_a_symmetric_relation_is_not_walked(spark, monkeypatch):
    """A chain of 40 needs no round a step; the pairs and their counts are those of its classes."""
    monkeypatch.setattr(Graph, "_grow", None)
    rows = [(f"n{i}", "r", f"n{i + 1}") for i in range(39)] + [("p", "r", "q"), ("q", "r", "p"), ("l", "r", "l"), ("p", "r", "gone"), ("gone", "r", "alone")]
    ids = [f"n{i}" for i in range(40)] + ["p", "q", "l", "alone"]
    nodes = spark.createDataFrame([(i, "T", i) for i in ids], "id string, type string, label string")
    graph = Graph(nodes, spark.createDataFrame(rows, "`from` string, rel string, `to` string"), {"r": {"symmetric": True}})
    chain = {f"n{i}" for i in range(40)}
    want = {(x, y) for x in chain for y in chain} | {(x, y) for x in "pq" for y in "pq"} | {("l", "l")}
    assert {tuple(r) for r in graph.query(["?x r+ ?y"]).collect()} == want
    sizes = dict.fromkeys(chain, 40) | {"p": 2, "q": 2, "l": 1}
    for by in ("x", "y"):
        assert {r[by]: r["n"] for r in graph.query(["?x r+ ?y"], count_by=f"?{by}").collect()} == sizes
    assert {r["y"] for r in graph.query(["n3 r+ ?y"]).collect()} == chain
    assert {r["x"] for r in graph.query(["?x r+ q"]).collect()} == {"p", "q"}


def test_parallel_edges_count_once_in_queries_and_twice_in_degree(small):
    assert small.query(["a r ?y"]).count() == 1
    assert {r["id"]: r["degree"] for r in G.degree(small.nodes, small.edges).collect()}["a"] == 3


def test_components_and_paths(small):
    comp = {r["id"]: r["component"] for r in G.components(small.nodes, small.edges).collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f", "x": "x"}
    assert {r["id"]: r["distance"] for r in G.distances(small.edges, "d").collect()}["b"] == 2


def test_long_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = connected_components(edges).collect()
    assert len(got) == 303 and {r["component"] for r in got} == {0, 1000}


@pytest.mark.parametrize(("few", "most"), [(0, 100), (3, 100), (1 << 17, 2)])
def test_components_by_rounds_and_at_once(spark, monkeypatch, few, most):
    """Few edges take one task and no rounds, each of which costs the driver several jobs; both ways agree, on names too."""
    from graphloom.operators import components

    tables = []
    monkeypatch.setattr(components, "FEW", few)
    cut = components.cut
    monkeypatch.setattr(components, "cut", lambda df: tables.append(1) or cut(df))
    pairs = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (90, 90), (200, 200), (None, 5), (301, 300), (302, 300)]
    want = {i: 0 for i in range(41)} | dict.fromkeys((90, 95, 100), 90) | {200: 200} | dict.fromkeys((300, 301, 302), 300)
    got = components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted(want.items()) and len(tables) <= most
    named = [(a and f"n{a:03}", f"n{b:03}") for a, b in pairs if a != 0]
    got = components.connected_components(spark.createDataFrame(named, "a string, b string")).collect()
    assert {r["id"]: r["component"] for r in got} == {f"n{i:03}": f"n{max(c, 1 if i < 41 else 0):03}" for i, c in want.items() if i}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fuzzy_duplicates_with_shared_neighbours(spark):
    labels = {"a": "alpha beta", "b": "alpha beto", "c": "alpha gamma", "d": "alpha", "e": "same", "f": "Same", "g": "trio", "h": "trio", "i": "trio"}
    nodes = spark.createDataFrame([(i, "T", x) for i, x in labels.items()], "id string, type string, label string")
    edges = spark.createDataFrame([(i, "r", t) for i in "ac" for t in "xy"] + [("d", "r", "x"), ("y", "r", "b"), ("b", "r", "x"), ("a", "r", "x")], "`from` string, rel string, `to` string")
    got = {(r["a"], r["b"]): r["ratio"] for r in G.fuzzy_duplicates(nodes, edges).collect()}
    ratio = {(a, b): round(difflib.SequenceMatcher(None, labels[a], labels[b]).ratio(), 6) for a in "abc" for b in "bc" if a < b}
    assert 0.6 <= ratio["a", "c"] < 0.82 <= ratio["a", "b"]
    assert ratio.pop(("b", "c")) < 0.6
    assert got == ratio | {(a, b): 1.0 for a, b in (("g", "h"), ("g", "i"), ("h", "i"))}


def test_fuzzy_duplicates_on_all_kinds(spark):
    from graphloom import catalog

    # on the smallest tables, by kind of node
    kinds = {r["k"] for r in catalog.queries()["kg_dupes_fuzzy"](spark, "/root/testdata/sf0.001").selectExpr("split(a, ':')[0] AS k").distinct().collect()}
    assert {"supplier", "customer", "part"} <= kinds


def classes_of(pairs, ids):
    """{node: (component, links)} by the pairs."""
    at, n = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in pairs:
        n[a], n[b] = n[a] + 1, n[b] + 1
        x, y = sorted((root(a), root(b)))
        at[y] = x
    return {i: (root(i), n[i]) for i in ids}


def test_fuzzy_classes_are_those_of_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "PAIRS_A_TASK", 300)
    labels = {"a": "alpha beta", "b": "alpha beto", "c": "alpha gamma", "d": "alpha", "e": "same", "f": "Same", "g": "trio", "h": "trio", "i": "trio", "j": "", "k": None}
    labels |= {f"n{i}": f"customer {i * 37 % 5000:06d}" for i in range(40)} | {f"m{i}": f"customer {i % 7:06d}" for i in range(20)} | {f"o{i}": str(i * 7919) for i in range(40)}
    nodes = spark.createDataFrame([(i, "T", x) for i, x in labels.items()], "id string, type string, label string")
    edges = spark.createDataFrame([(i, "r", t) for i in "ac" for t in "xy"] + [("d", "r", "x"), ("y", "r", "b"), ("b", "r", "x"), ("o1", "r", "x"), ("o1", "r", "z"), ("o19", "r", "x"), ("o19", "r", "z")], "`from` string, rel string, `to` string")
    pairs = [(r["a"], r["b"]) for r in G.fuzzy_duplicates(nodes, edges).collect()]
    assert {r["a"]: (r["component"], r["links"]) for r in G.fuzzy_classes(nodes, edges).collect()} == classes_of(pairs, labels)


def test_matches_by_equal_characters():
    """Names of one block at once, against a SequenceMatcher a pair."""
    rand = random.Random(5)
    for made in (lambda x: x[:6], lambda x: "customer 0" + x[:5], lambda x: "aab" + x[: rand.randint(0, 5)], lambda x: x * 2, lambda x: "xaxa" + x[:2]):
        names = [made("".join(rand.choice("012a") for _ in range(8))) for _ in range(60)]
        for least in (0.6, 0.82):
            told = N.links(np.arange(60), names, [None] * 60, least)
            pairs = [(i, j) for i in range(60) for j in range(i + 1, 60) if difflib.SequenceMatcher(None, names[i], names[j]).ratio() >= least]
            assert {r.num: (r.root, r.links) for r in told.itertuples()} == classes_of(pairs, range(60))


def whole(told, ids):
    """{num: (root, links)} from what the parts of a block told."""
    n = dict.fromkeys(ids, 0)
    for r in told:
        n[r.num] += r.links
    at = classes_of([(r.root, r.num) for r in told], ids)
    return {i: (at[i][0], n[i]) for i in ids}


def test_links_by_every_way():
    """Shared subsequences and histograms find the links of all pairs, in parts too, without those left out."""
    rand = random.Random(7)
    for made in (lambda x: x[:6], lambda x: "customer 0" + x[:5], lambda x: "customer 0" + x[: rand.randint(0, 4)], lambda x: x[: rand.randint(1, 5)], lambda x: "xaxa" + x[:2]):
        names = [made("".join(rand.choice("0123a") for _ in range(8))) for _ in range(90)]
        ids = rand.sample(range(1000), 90)
        skip = [[ids[i ^ 1]] if i < 30 else None for i in range(90)]
        left = {frozenset(ids[i : i + 2]) for i in range(0, 30, 2)}
        name, inorder = dict(zip(ids, names, strict=True)), sorted(ids)
        for least in (0.6, 0.82):
            pairs = [(a, b) for k, a in enumerate(inorder) for b in inorder[k + 1 :] if {a, b} not in left and difflib.SequenceMatcher(None, name[a], name[b]).ratio() >= least]
            block = N.Names(np.array(ids), names, skip, least)
            ways = ["one_by_one"] + [w for w, cost in (("by_subsequences", block.near_cost()), ("by_histograms", block.histogram_cost())) if cost < np.inf]
            for way in ways:
                for parts in (1, 3):
                    told = [r for p in range(parts) for r in N.links(np.array(ids), names, skip, least, p, parts, way).itertuples()]
                    assert whole(told, ids) == classes_of(pairs, ids)
            assert len(ways) > 1


@pytest.mark.parametrize("made", [lambda i: str(100000 + i), lambda i: f"customer {i:09d}"])
def test_large_blocks_are_not_compared_pair_by_pair(monkeypatch, made):
    monkeypatch.setattr(N.Block, "compare", None)
    names = [made(i * 3) for i in range(20000)]
    told = N.links(np.arange(20000), names, [None] * 20000, 0.82)
    for i in (0, 4321, 19999):
        ratios = [difflib.SequenceMatcher(None, *((names[i], x) if i < j else (x, names[i]))).ratio() for j, x in enumerate(names)]
        assert told["links"][i] == sum(r >= 0.82 for r in ratios) - 1


def test_links_by_neighbours_are_those_of_the_pairs():
    """With hubs around most nodes, whose pairs are not all looked at."""
    rand = random.Random(3)
    names = ["l" + "".join(rand.choice("01a") for _ in range(rand.choice((4, 9)))) for _ in range(200)]
    ids = rand.sample(range(1000), 200)
    around = [rand.sample(ids, rand.randint(2, 4)) for _ in range(40)] + [rand.sample(ids, 190), rand.sample(ids, 120)]
    skip = [[ids[1]], [ids[0]]] + [None] * 198
    name, near, inorder = dict(zip(ids, names, strict=True)), {i: {k for k, m in enumerate(around) if i in m} for i in ids}, sorted(ids)
    both = [(a, b) for k, a in enumerate(inorder) for b in inorder[k + 1 :] if len(near[a] & near[b]) >= 2 and {a, b} != set(ids[:2])]
    pairs = [(a, b) for a, b in both if 0.6 <= difflib.SequenceMatcher(None, name[a], name[b]).ratio() < 0.82]
    flat, size = np.concatenate(around), np.array([len(m) for m in around])
    for parts in (1, 4):
        told = [r for p in range(parts) for r in B.links(np.array(ids), names, skip, flat, size, 0.6, 0.82, 2, p, parts).itertuples()]
        assert len(pairs) > 100 and whole(told, ids) == classes_of(pairs, ids)


def test_bad_patterns():
    with pytest.raises(ValueError):
        parse("a b")
    with pytest.raises(ValueError):
        parse("?a ?r ?b")
