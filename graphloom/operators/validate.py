"""Graph rules as DataFrames of findings (subject, detail)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import assertion_id, is_node_id, source_path
from graphloom.session import cut


@dataclass(frozen=True)
class Schema:
    """Types with their parents; relations with (domain, range); symmetric; inverse of; functional."""

    types: dict[str, str | None]
    relations: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]
    symmetric: set[str]
    inverse: dict[str, str]
    functional: set[str]

    def chain(self, kind: str) -> list[str]:
        out: list[str] = []
        while kind and kind not in out:
            out.append(kind)
            kind = self.types.get(kind)
        return out

    def allowed(self, kinds: tuple[str, ...]) -> list[str]:
        return [t for t in self.types if set(self.chain(t)) & set(kinds)]


def triple():
    return F.concat_ws(" ", "from", "rel", "to")


def finding(df: DataFrame, subject, detail) -> DataFrame:
    return df.select(subject.alias("subject"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def ids(n, e, s):
    return finding(n.filter(~is_node_id("id")), F.col("id"), "node id")


def types(n, e, s):
    undeclared = ~F.coalesce(F.col("type").isin(*s.types), F.lit(True))
    what = F.when(F.col("label").isNull(), "no label").when(F.col("type").isNull(), "no type").when(undeclared, "undeclared type")
    return finding(n.withColumn("w", what).filter("w IS NOT NULL"), F.col("id"), F.col("w"))


def provenance(n, e, s):
    return finding(n.filter(F.coalesce(F.size("sources"), F.lit(0)) <= 0), F.col("id"), "no source")


def dangling(n, e, s):
    out = None
    for end in ("from", "to"):
        lost = e.join(n.select(F.col("id").alias(end)), end, "left_anti")
        out = finding(lost, triple(), end) if out is None else out.unionByName(finding(lost, triple(), end))
    return out


def undeclared(n, e, s):
    return finding(e.filter(~F.col("rel").isin(*s.relations)), triple(), F.col("rel"))


def source(n, e, s):
    what = F.when(F.coalesce("source", F.lit("")) == "", "no source").when(source_path("source").isNull(), "malformed")
    return finding(e.withColumn("w", what).filter("w IS NOT NULL"), triple(), F.col("w"))


def functional(n, e, s):
    many = e.filter(F.col("rel").isin(*s.functional)).groupBy("from", "rel").agg(F.count_distinct("to").alias("n")).filter("n > 1")
    return finding(many, F.col("from"), F.concat_ws(":", "rel", F.col("n").cast("string")))


def domain_range(n, e, s):
    out = None
    for place, end, what in ((0, "from", "domain"), (1, "to", "range")):
        wrong = F.lit(False)
        for rel, sides in s.relations.items():
            if sides[place]:
                wrong = wrong | ((F.col("rel") == rel) & ~F.col("type").isin(*s.allowed(sides[place])))
        typed = e.join(n.select(F.col("id").alias(end), "type"), end).filter(wrong)
        part = finding(typed, triple(), what)
        out = part if out is None else out.unionByName(part)
    return out


def selfloop(n, e, s):
    return finding(e.filter(F.col("from") == F.col("to")), F.col("from"), F.col("rel"))


def dup_assertion(n, e, s):
    many = e.groupBy("from", "rel", "to", "source").agg(F.count("*").alias("n")).filter("n > 1")
    return finding(many, triple(), F.col("n").cast("string"))


def symmetric(n, e, s):
    a = e.filter(F.col("rel").isin(*s.symmetric)).select("from", "rel", "to").distinct()
    b = a.select(F.col("to").alias("from"), "rel", F.col("from").alias("to"))
    return finding(a.filter(F.col("from") < F.col("to")).join(b, ["from", "rel", "to"], "left_semi"), F.concat_ws(" ", "from", "to"), F.col("rel"))


def inverse(n, e, s):
    out = finding(e.limit(0), F.col("from"), F.col("rel"))
    for rel, other in s.inverse.items():
        b = e.filter(F.col("rel") == other).select(F.col("to").alias("from"), F.col("from").alias("to"))
        hit = e.filter(F.col("rel") == rel).select("from", "to").distinct().join(b, ["from", "to"], "left_semi")
        out = out.unionByName(finding(hit, F.concat_ws(" ", "from", "to"), f"{rel}/{other}"))
    return out


RULES = {f.__name__: f for f in (ids, types, provenance, dangling, undeclared, source, functional, domain_range, selfloop, dup_assertion, symmetric, inverse)}


def shape_cardinality(nodes: DataFrame, edges: DataFrame, rel: str, direction: str, least: int, most: int) -> DataFrame:
    """(subject, n) of targets whose number of assertions of a relation is out of bounds."""
    key = "from" if direction == "out" else "to"
    n = edges.filter(F.col("rel") == rel).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
    got = nodes.select("id").join(n, "id", "left").select(F.col("id").alias("subject"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return got.filter((F.col("n") < least) | (F.col("n") > most))


def coverage_gap(answers: DataFrame, var: str, targets: DataFrame) -> DataFrame:
    """Targets that a competency question's answers leave out."""
    return targets.select(F.col("id").alias("missing")).join(answers.select(F.col(var).alias("missing")).distinct(), "missing", "left_anti")


def drift(edges: DataFrame, manifest: DataFrame) -> DataFrame:
    """Assertions recorded before their source was last read; dates compare as text."""
    stamped = edges.withColumn("path", source_path("source")).join(manifest.select(F.col("source").alias("path"), "ingested"), "path")
    return finding(stamped.filter((F.col("recorded") != "") & (F.col("recorded") < F.col("ingested"))), triple(), F.col("path"))


def age_days(when: Column, now: str) -> Column:
    """Whole days from an ISO time, UTC unless it says, to ``now``."""
    return F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(iso_time(when))) / F.lit(86_400_000_000)).cast("long")


def iso_time(x: Column) -> Column:
    """The time of ISO text, null if it is none."""
    shaped = x.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d(:\d\d(:\d\d([.,]\d+)?)?)?(Z|[+-]\d\d(:?\d\d)?)?)?$")
    return F.when(shaped, F.try_to_timestamp(F.replace(x, F.lit("Z"), F.lit("+00:00"))))


def manifest_states(manifest: DataFrame, files: DataFrame, now: str) -> DataFrame:
    """(source, state): missing, no hash, stale, expired (a runtime source past its days) or fresh; ``files``: source, sha256 as they are now."""
    at = files.select("source", F.col("sha256").alias("now_sha"))
    old = F.coalesce(age_days(F.col("ingested"), now) > F.coalesce("max_age_days", F.lit(0)), F.lit(True))
    state = F.when(F.col("now_sha").isNull(), "missing").when(F.coalesce("sha256", F.lit("")) == "", "no hash").when(F.col("sha256") != F.col("now_sha"), "stale")
    state = state.when(F.coalesce("runtime", F.lit(False)) & old, "expired").otherwise("fresh")
    return manifest.join(at, "source", "left").select("source", state.alias("state"))


def evidence_freshness(cited: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of (subject, source) rows whose source is malformed, absent from the manifest, missing, without hash or stale."""
    known = manifest.join(files.select("source", F.col("sha256").alias("now_sha")), "source", "left").select(F.col("source").alias("path"), "sha256", "now_sha", F.lit(True).alias("listed"))
    what = F.when(F.col("path").isNull(), "malformed").when(F.col("listed").isNull(), "absent from manifest").when(F.col("now_sha").isNull(), "missing")
    what = what.when(F.coalesce("sha256", F.lit("")) == "", "no hash").when(F.col("sha256") != F.col("now_sha"), "stale")
    told = cited.withColumn("path", source_path("source")).join(known, "path", "left").withColumn("w", what)
    return finding(told.filter("w IS NOT NULL"), F.col("subject"), F.concat_ws(": ", "source", "w"))


def cited_sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject, source) of all evidence of nodes and edges."""
    of_nodes = nodes.select(F.col("id").alias("subject"), F.explode("sources").alias("source"))
    return of_nodes.unionByName(edges.filter("source <> ''").select(F.col("id").alias("subject"), "source"))


def required_props(nodes: DataFrame, required: dict[str, list[str]], shown: int = 5) -> DataFrame:
    """Findings by type and property: how many nodes of exactly that type lack it, and the first few in order of ids."""
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, ps in sorted(required.items()) for p in ps]))
    lost = nodes.filter(F.col("type").isin(*required)).select("id", "type", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"), pairs.alias("x"))
    lost = lost.filter((F.col("x.t") == F.col("type")) & ~F.array_contains(F.map_keys("props"), F.col("x.p"))).select("id", "type", F.col("x.p").alias("prop"))
    n = lost.groupBy("type", "prop").agg(F.count("*").alias("n"))
    first = lost.withColumn("place", F.row_number().over(Window.partitionBy("type", "prop").orderBy("id"))).filter(F.col("place") <= shown)
    named = first.groupBy("type", "prop").agg(F.array_join(F.sort_array(F.collect_list("id")), ", ").alias("first"))
    told = n.join(named, ["type", "prop"])
    return finding(told, F.concat_ws(".", "type", "prop"), F.concat(F.col("n").cast("string"), F.lit(": "), "first"))


def edge_ids(n, e, s):
    """Missing ids, and ids that more than one assertion bears."""
    lost = finding(e.filter(F.coalesce("id", F.lit("")) == ""), triple(), "no id")
    many = e.filter("id <> ''").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    return lost.unionByName(finding(many, F.col("id"), F.concat(F.lit("duplicate "), F.col("n").cast("string"))))


def content_ids(n, e, s):
    made = assertion_id("from", "rel", "to", "source")
    return finding(e.filter((F.col("source") != "") & ~F.col("id").eqNullSafe(made)), triple(), made)


def recorded(n, e, s):
    return finding(e.filter(iso_time(F.coalesce("recorded", F.lit(""))).isNull()), triple(), F.coalesce("recorded", F.lit("")))


RULES |= {f.__name__: f for f in (edge_ids, content_ids, recorded)}


def versions(found: dict[str, object], expected: int = 2) -> list[str]:
    """What of graph_format_version and schema_version is not the expected one."""
    return [f"{k}={found.get(k)!r}; expected {expected}" for k in ("graph_format_version", "schema_version") if found.get(k) != expected]


def prose_only(questions: list) -> list[str]:
    """Competency questions that cannot be run."""
    return [f"competency_questions[{i}] is prose-only" for i, q in enumerate(questions) if not isinstance(q, dict) or not q.get("query")]


def value_of(key: str) -> Column:
    """A node's value under ``type``, ``id``, ``label`` or ``props.<name>``."""
    return F.col("props")[key[6:]] if key.startswith("props.") else F.col(key)


def targets(nodes: DataFrame, target: dict) -> DataFrame:
    """Nodes that match every key of a target; a list names allowed values."""
    for key, wanted in target.items():
        allowed = wanted if isinstance(wanted, list) else [wanted]
        nodes = nodes.filter(F.coalesce(value_of(key).isin([str(x) for x in allowed]), F.lit(False)))
    return nodes


def shape_findings(nodes: DataFrame, edges: DataFrame, shape: dict, fresh: DataFrame | None = None, now: str | None = None) -> DataFrame:
    """Findings of one shape: ``target``, ``require_props``, ``require_edges`` (rel, direction out, in or both, min, max,
    source_policy canonical-fresh over ``fresh`` sources) and ``freshness`` (path, max_age_days)."""
    held = targets(nodes, shape.get("target", {}))
    parts = []
    for key in shape.get("require_props", []):
        value = value_of(key)
        lost = F.coalesce(F.size(value) <= 0, F.lit(True)) if key in ("sources", "aliases") else F.coalesce(value == "", F.lit(True))
        parts.append(finding(held.filter(lost), F.col("id"), f"missing required {key}"))
    for need in shape.get("require_edges", []):
        of_rel = edges.filter(F.col("rel") == need["rel"])
        if need.get("source_policy") == "canonical-fresh":
            of_rel = of_rel.withColumn("path", source_path("source")).join(fresh.select(F.col("source").alias("path")), "path", "left_semi")
        ends = {"out": ["from"], "in": ["to"], "both": ["from", "to"]}[need.get("direction", "out")]
        counted = of_rel.select(F.explode(F.array(*ends)).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
        got = held.select("id").join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
        told = F.concat(F.lit(f"{need.get('direction', 'out')} {need['rel']}: "), F.col("n").cast("string"))
        parts.append(finding(got.filter(F.col("n") < need.get("min", 0)), F.col("id"), F.concat(F.lit("too few "), told)))
        if need.get("max") is not None:
            parts.append(finding(got.filter(F.col("n") > need["max"]), F.col("id"), F.concat(F.lit("too many "), told)))
    if limit := shape.get("freshness"):
        key = limit.get("path", "props.observed_at")
        age = age_days(value_of(key), now)
        told = held.withColumn("age", age)
        parts.append(finding(told.filter("age IS NULL"), F.col("id"), f"no valid time at {key}"))
        parts.append(finding(told.filter(F.col("age") > limit.get("max_age_days", 0)), F.col("id"), f"observation at {key} too old"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def placeholders(nodes: DataFrame) -> DataFrame:
    return finding(nodes.filter(~F.coalesce(F.lower(F.col("props")["placeholder"]), F.lit("")).isin("", "false", "0", "none", "null")), F.col("id"), "unresolved placeholder")


def verdict(findings: DataFrame, strict: bool = False) -> DataFrame:
    """One row of findings (severity E, W or I): errors, warnings, notes, exit_code."""
    n = lambda s: F.count_if(F.col("severity") == s)
    bad = (F.col("errors") > 0) | (F.lit(strict) & (F.col("warnings") > 0))
    return findings.agg(n("E").alias("errors"), n("W").alias("warnings"), n("I").alias("notes")).withColumn("exit_code", F.when(bad, 1).otherwise(0))


def ask(graph, question: dict) -> DataFrame:
    """(id, passed, rows, missing) of one competency question: ``query``, ``optional``, ``not``, ``filter`` and ``assert``
    (min_results, 1 without any assertion; max_results; covers: a var and a target whose nodes must be among its values)."""
    lists = {k: [v] if isinstance(v := question.get(k) or [], str) else v for k in ("query", "optional", "not", "filter")}
    answers = cut(graph.query(lists["query"], tuple(lists["optional"]), tuple(lists["not"]), tuple(lists["filter"])))
    must = question.get("assert") or {"min_results": 1}
    rows = answers.agg(F.count("*").alias("rows"))
    missing = F.lit(0).cast("long").alias("missing")
    told = rows.select("rows", missing)
    if covers := must.get("covers"):
        wanted = targets(graph.nodes, {k: v for k, v in covers.items() if k != "var"})
        var = covers.get("var", lists["query"][0].split()[0]).lstrip("?")
        told = rows.crossJoin(coverage_gap(answers, var, wanted).agg(F.count("*").alias("missing")))  # one row each
    passed = (F.col("rows") >= must.get("min_results", 0)) & (F.col("rows") <= must.get("max_results", 1 << 62)) & (F.col("missing") == 0)
    return told.select(F.lit(question.get("id", "")).alias("id"), passed.alias("passed"), "rows", "missing")
