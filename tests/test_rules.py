"""Text rules, telemetry and graph files on small rows."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import release as R
from graphloom.operators import telemetry as T
from graphloom.operators import textlint as X
from graphloom.sources import files as W


def rules(spark, text, mode="auto"):
    return {r["rule"] for r in X.findings(spark.createDataFrame([("a.md", text)], "path string, text string"), mode).collect()}


def test_text_rules(spark):
    assert rules(spark, "The pump is small. It moves water.", "descriptive") == set()
    long = "Don't open the valve; turn the long red handle that stands on the left side of the old pump and wait until the gauge on top shows zero again."
    assert {"STE-4.2", "STE-5.1", "STE-8.1"} <= rules(spark, "# Procedure\n\n" + long)
    assert "STE-6.6" in rules(spark, "One. Two. Three. Four. Five. Six. Seven.", "descriptive")
    assert not {"STE-8.1", "STE-4.2"} & rules(spark, "See `a;b` and [text](http://x/;don't).\n\n```\ncan't;\n```\n")
    assert "STE-3.6" in rules(spark, "The part was removed by hand.")
    assert X.verdict(X.findings(spark.createDataFrame([("a", None), ("b", "")], "path string, text string"))).first().asDict() == {"errors": 0, "warnings": 0, "exit_code": 0}


def test_telemetry_rows(spark):
    rows = ['{"ts": "2026-07-28T00:00:00Z", "event": "fill", "asset": "BTC", "pnl": 2.5, "token": "hush", "wallet_address": "0xabc"}', '{"ts": "2026-07-28T01:00:00Z", "event": "fill", "asset": "BTC", "pnl": -1.0}', "", "[1]", "{bad", '{"a": 1, "a": {"b": true, "c": [1]}, "d": NaN, "e": 2000000000000}']
    read = T.parse_rows(spark.createDataFrame(list(enumerate(rows)), "ord long, line string"))
    told = T.accounting(read).first()
    assert (told["rows_parsed"], told["rows_malformed"], told["first"], told["last"]) == (3, 2, "2026-07-28T00:00:00Z", "2026-07-28T01:00:00Z")
    groups = {(r["label"], r["metric"]): (r["rows"], r["n"]) for r in T.group_metrics(T.kept(read), "asset", ["pnl"]).collect()}
    assert groups == {("BTC", "pnl"): (2, 2), ("unknown", "pnl"): (1, 0)}
    fields = {r["field"] for r in T.field_counts(T.kept(read)).collect()}
    assert fields == {"ts", "event", "asset", "pnl", "a.b", "d", "e"}
    assert {r["field"] for r in T.numeric_fields(T.kept(read)).collect()} == {"pnl"}
    with pytest.raises(ValueError):
        T.tail(read, 0)


def test_summary_of_few_values(spark):
    got = T.summary(spark.createDataFrame([(float(x),) for x in range(1, 8)], "v double"), "v").first()
    assert (got["n"], got["p05"], got["median"], got["p95"], got["sd"]) == (7, 1.3, 4.0, 6.7, 2.0)


def test_quantiles_rank_only_what_is_near(spark):
    """Many values, long tails, ties on the quantile, nulls and small groups: as the exact percentile has them."""
    from graphloom.operators.quantiles import quantiles

    many = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("k"), F.when(F.col("id") % 11 > 0, F.exp(F.pmod(F.col("id") * 7919, F.lit(60_013)) / 2000) - 5).alias("v"))
    ties = spark.range(40_000).select(F.lit("t").alias("k"), F.floor(F.col("id") / 30_000).cast("double").alias("v"))
    few = spark.createDataFrame([("f", 1.0), ("f", 4.0), ("f", None), ("one", -2.5), ("none", None)], "k string, v double")
    rows = many.unionByName(ties).unionByName(few)
    got = {r["k"]: r for r in quantiles(rows, "v", {"low": 0.0, "mid": 0.5, "high": 0.95, "top": 1.0}, ["k"]).collect()}
    want = rows.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(*[F.lit(x) for x in (0.0, 0.5, 0.95, 1.0)])).alias("q")).collect()
    assert set(got) == {"a", "b", "t", "f", "one", "none"}
    for r in want:
        found = got[r["k"]]
        assert found["n"] == r["n"] and [found[c] for c in ("low", "mid", "high", "top")] == (pytest.approx(r["q"], rel=1e-14) if r["q"] else [None] * 4)


def test_strict_lines_and_frontmatter(spark):
    lines = spark.createDataFrame([(0, '{"id": "a:b"}'), (1, ""), (2, "[1]")], "ord long, line string")
    with pytest.raises(ValueError, match="line 3"):
        W.load_strict(lines, W.NODE)
    assert W.frontmatter("---\nname: 'x'\ndescription: one\n  two\n---\nrest") == {"name": "x", "description": "one two"}
    with pytest.raises(ValueError):
        W.frontmatter("name: x")


def test_store_commits(spark, tmp_path):
    store = W.Store(spark, str(tmp_path / "g"))
    store.init()
    row = spark.createDataFrame([("a:1", "T", "A", None, None, {}, ["s#1"])], W.NODE.removesuffix(", source string"))
    assert store.append("nodes", row) == 2 and store.read("nodes").count() == 1 and store.read("nodes", 1).count() == 0
    with pytest.raises(RuntimeError):
        store.commit({"nodes": row}, 1)
    assert store.version == 2 and store.commit({}, 2, dry_run=True) == 2


def test_shortest_paths(spark):
    nodes = spark.createDataFrame([(i, "T", i) for i in "abcdx"], "id string, type string, label string")
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("d", "s", "c"), ("a", "r", "gone"), ("gone", "r", "d")], "`from` string, rel string, `to` string")
    assert [r["id"] for r in G.shortest_path(nodes, edges, "a", "d").collect()] == ["a", "b", "c", "d"]
    assert [r["id"] for r in G.shortest_path(nodes, edges, "a", "a").collect()] == ["a"]
    for bad in ({"directed": True}, {"rels": ["r"]}):
        with pytest.raises(ValueError, match="no path"):
            G.shortest_path(nodes, edges, "a", "d", **bad)
    assert G.pagerank(nodes.filter(F.lit(False)), edges).count() == 0


def test_release_states(spark):
    def rows(data, schema):
        return spark.createDataFrame(data, schema)

    names = rows([(c,) for c in "abcdefghij"], "candidate string")
    gates = rows([("a", "PASS"), ("a", "PASS"), ("b", "PASS"), ("b", "UNKNOWN"), ("c", "PASS"), ("c", None), ("d", None), ("f", "PASS"), ("g", "PASS"), ("h", "PASS"), ("i", "FAIL"), ("j", "PASS")], "candidate string, state string")
    places = rows([("f", "VERIFIED"), ("g", "VERIFIED"), ("g", None), ("h", "PUBLISHED"), ("j", "FAILED")], "candidate string, state string")
    retired = rows([("f", True, None), ("i", True, True)], "candidate string, visible boolean, replaced boolean")
    told = {r["candidate"]: r["status"] for r in R.release_states(names, gates, places, retired).collect()}
    assert told == {"a": "READY", "b": "BLOCKED", "c": "BLOCKED", "d": "PLANNED", "e": "PLANNED", "f": "PUBLISHED_VERIFIED", "g": "PUBLISHED_PARTIAL", "h": "PUBLISHED_PARTIAL", "i": "ARCHIVED_VERIFIED", "j": "READY"}
    assert R.release_states(names.limit(0), gates, places, retired).count() == 0


def test_registry_findings(spark):
    schema = "name string, version string"
    entries = spark.createDataFrame([("a-1", "1.0.0-rc.1"), ("b", "1.0.0+x"), ("C", "1.0.0"), ("d", "1.0"), ("e", None), ("f", "1.0.0"), ("f", "1.0.0"), (None, "1.0.0")], schema)
    found = spark.createDataFrame([("a-1", "1.0.0-rc.1"), ("b", "1.0.0"), ("C", "1.0.0"), ("d", "1.0"), ("e", None), ("f", "1.0.0"), ("g", "1.0.0")], schema)
    told = {(r["name"], r["finding"]) for r in R.registry_findings(entries, found).collect()}
    assert told == {("b", "versions differ"), ("C", "bad name"), ("d", "bad version"), ("e", "bad version"), ("f", "registered more than once"), (None, "bad name"), (None, "missing"), ("g", "not registered")}


def test_manifests_and_preflight(spark):
    files = spark.createDataFrame(
        [
            ("a", "pyproject.toml", 'version = "0"\n[project]\nversion = 1\r\nversion = \'1.2.3\'  # x\nversion = "9"\n'),
            ("a", "package.json", '{"version": "1.2.3", "deps": {"version": "4"}}'),
            ("b", "Cargo.toml", '[package.x]\nversion = "1"\n[ package ]\nversion = "2"'),
            ("b", ".claude-plugin/plugin.json", '{"version": "3"}'),
            ("c", "package.json", "{bad"),
            ("c", "pyproject.toml", None),
            ("c", "Cargo.toml", ""),
            ("c", "other.json", '{"version": "3"}'),
            ("d", "package.json", '{"version": null}'),
            ("d", ".codex-plugin/plugin.json", "[1]"),
        ],
        "root string, path string, text string",
    )
    found = R.manifest_versions(files)
    assert {(r["root"], r["kind"], r["version"]) for r in found.collect()} == {("a", "python", "1.2.3"), ("a", "node", "1.2.3"), ("b", "rust", "2"), ("b", "claude-plugin", "3")}
    roots = spark.createDataFrame([("a", True, "main", 0, "1.2.3"), ("b", True, None, 1, None), ("c", False, None, None, "1"), ("d", True, "main", 0, "")], "root string, git boolean, branch string, changes int, expected string")
    tags = spark.createDataFrame([("a", "v1.2.3"), ("a", "1.2.3"), ("b", "v2"), ("c", "1"), ("d", "v")], "root string, tag string")
    told = {(r["root"], r["code"], r["severity"], r["status"]) for r in R.preflight(roots, found, tags).collect()}
    assert told == {
        ("a", "tag_collision", "blocker", "blocked"),
        ("b", "dirty_worktree", "blocker", "blocked"),
        ("b", "detached_head", "warning", "blocked"),
        ("b", "inconsistent_versions", "blocker", "blocked"),
        ("c", "not_git_repository", "blocker", "blocked"),
        ("c", "no_version_metadata", "warning", "blocked"),
        ("d", "no_version_metadata", "warning", "ready"),
    }


def test_install_plan(spark):
    wanted = spark.createDataFrame([(n, "t", "/s/" + n, "h") for n in "abcdef"], "name string, target string, place string, digest string")
    found = spark.createDataFrame([("a", "t", "/s/a", None), ("b", "t", "/x", "h"), ("c", "t", None, "h"), ("d", "t", None, "g"), ("e", "t", None, None), ("f", "u", "/s/f", "h")], "name string, target string, link string, digest string")
    told = {r["name"]: (r["state"], r["action"]) for r in R.install_plan(wanted, found, True).collect()}
    assert told == {"a": ("synced", "OK"), "b": ("conflict-link", "CONFLICT"), "c": ("synced-copy", "OK"), "d": ("conflict-existing", "CONFLICT"), "e": ("conflict-existing", "CONFLICT"), "f": ("missing", "PLAN")}
    assert {r["state"] for r in R.install_plan(wanted, found).filter("name = 'c'").collect()} == {"conflict-existing"}
