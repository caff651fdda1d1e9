"""Graph changes as new tables beside a table of conflicts; a caller commits only when the conflicts are empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import assertion_id, is_node_id, norm, source_path
from graphloom.session import cut


def merge_edges(edges: DataFrame, dup: str, canon: str) -> DataFrame:
    """Endpoints rewritten, ids made anew, one row for each assertion."""
    turned = lambda c: F.when(F.col(c) == dup, canon).otherwise(F.col(c))
    moved = edges.withColumns({"from": turned("from"), "to": turned("to")}).withColumn("id", assertion_id("from", "rel", "to", "source"))
    w = Window.partitionBy("id").orderBy("recorded")
    return moved.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def remove_source(edges: DataFrame, path: str) -> DataFrame:
    return edges.filter(F.coalesce(source_path("source") != path, F.lit(True)))


def refresh_nodes(nodes: DataFrame, staged: DataFrame, prefer_staged: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new nodes, conflicts): staged rows upsert; a differing label or type is a conflict unless staged ones win."""
    s = staged.select(F.col("id").alias("sid"), F.col("type").alias("stype"), F.col("label").alias("slabel"))
    both = nodes.select("id", "type", "label").join(s, F.col("id") == F.col("sid"), "full")
    pick = (lambda a, b: F.coalesce(a, b)) if prefer_staged else (lambda a, b: F.coalesce(b, a))
    new = both.select(F.coalesce("sid", "id").alias("id"), pick(F.col("stype"), F.col("type")).alias("type"), pick(F.col("slabel"), F.col("label")).alias("label"))
    clash = both.filter("id IS NOT NULL AND sid IS NOT NULL")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("held"), F.col(f"s{f}").alias("staged")) for f in ("type", "label")])
    conflicts = clash.select("id", F.explode(fields).alias("x")).select("id", "x.*").filter("held <> staged")
    return new, conflicts


def fold_path(x) -> Column:
    """A relative path without ``.``, empty and ``..`` steps; null if it is empty, absolute, leaves its root or stands in an excluded folder."""
    parts = F.filter(F.split(x, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p != "..", F.array_append(acc, p)).when((F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array_append(acc, p)))
    bad = F.startswith(x, F.lit("/")) | (F.size(folded) == 0) | F.array_contains(folded, "..") | F.arrays_overlap(folded, F.array(*[F.lit(p) for p in EXCLUDED]))
    return F.when(~bad, F.array_join(folded, "/"))


# Folders that hold no sources.
EXCLUDED = (".git", ".hg", ".svn", "__pycache__", ".pytest_cache", ".mypy_cache", "node_modules", "vendor", "dist", "build", ".next", ".cache")


def evidence(sources, source=None) -> Column:
    """The sources of a node, an older single one appended, each once."""
    known = F.coalesce(sources, F.array().cast("array<string>"))
    return F.array_distinct(known if source is None else F.concat(known, F.array_compact(F.array(F.nullif(source, F.lit(""))))))


def _uncited(sources, path: str) -> Column:
    return F.filter(sources, lambda s: F.coalesce(source_path(s) != path, F.lit(True)))


def _conflicts(df: DataFrame, subject, reason) -> DataFrame:
    return df.select(subject.cast("string").alias("subject"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def add_nodes(nodes: DataFrame, new: DataFrame, schema, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, conflicts): rows of known or malformed ids, undeclared types, malformed sources, or, unless forced, of a
    label or alias that a node bears already, are conflicts; with any conflict the nodes stay as they are."""
    from graphloom.operators.graph import gazetteer

    known = new.join(nodes.select("id"), "id", "left_semi")
    malformed = F.exists(evidence(F.col("sources")), lambda s: source_path(s).isNull())
    out = _conflicts(known, F.col("id"), "id exists").unionByName(_conflicts(new.filter(~is_node_id("id")), F.col("id"), "malformed id"))
    out = out.unionByName(_conflicts(new.filter(~F.coalesce(F.col("type").isin(*schema.types), F.lit(False))), F.col("id"), "undeclared type"))
    out = out.unionByName(_conflicts(new.filter(malformed), F.col("id"), "malformed source"))
    if not force:
        clash = gazetteer(new).select("key", F.explode("ids").alias("id")).join(gazetteer(nodes).select("key"), "key", "left_semi")
        out = out.unionByName(_conflicts(clash.select("id").distinct(), F.col("id"), "possible duplicate"))
    out = cut(out)
    return (nodes if not out.isEmpty() else nodes.unionByName(new.select(*nodes.columns))), out


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame, schema, today: str) -> tuple[DataFrame, DataFrame]:
    """(edges, conflicts): ends are resolved by id or unique surface form; unresolved ends, undeclared relations,
    malformed sources and assertions that exist already are conflicts; with any conflict the edges stay as they are."""
    from graphloom.operators.graph import resolve

    terms = new.select(F.explode(F.array("from", "to")).alias("term")).distinct()
    found = cut(resolve(nodes, terms).select("term", F.when(F.col("status").isin("exact", "unique"), F.col("ids")[0]).alias("id"), "status"))
    at = lambda end: found.select(F.col("term").alias(end), F.col("id").alias(f"{end}_id"), F.col("status").alias(f"{end}_status"))
    both = cut(new.join(at("from"), "from", "left").join(at("to"), "to", "left"))
    text = F.concat_ws(" ", "from", "rel", "to")
    out = None
    for end in ("from", "to"):
        part = _conflicts(both.filter(F.col(f"{end}_id").isNull()), F.col(end), F.concat(F.lit(f"{end} is "), F.col(f"{end}_status")))
        out = part if out is None else out.unionByName(part)
    out = out.unionByName(_conflicts(both.filter(~F.coalesce(F.col("rel").isin(*schema.relations), F.lit(False))), text, "undeclared relation"))
    out = out.unionByName(_conflicts(both.filter(source_path("source").isNull()), text, "malformed source"))
    made = both.select(F.col("from_id").alias("from"), "rel", F.col("to_id").alias("to"), "source").withColumn("id", assertion_id("from", "rel", "to", "source")).withColumn("recorded", F.lit(today))
    keys = made.groupBy("id").agg(F.count("*").alias("n"), F.first(F.concat_ws(" ", "from", "rel", "to")).alias("text"))
    again = keys.join(edges.select("id").distinct().withColumn("there", F.lit(True)), "id", "left").filter("there OR n > 1")
    out = cut(out.unionByName(_conflicts(again, F.col("text"), "assertion exists")))
    return (edges if not out.isEmpty() else edges.unionByName(made.select(*edges.columns))), out


def merge_nodes(nodes: DataFrame, edges: DataFrame, dup: str, canon: str, prefer: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, conflicts) with ``dup`` merged into ``canon``. Differing types, descriptions and shared properties
    are conflicts; unless ``prefer`` (canon or dup) settles them, both tables stay as they are. The two nodes are two rows."""
    if dup == canon:
        raise ValueError("the same node")
    if prefer not in (None, "canon", "dup"):
        raise ValueError("prefer canon or dup")
    side = lambda i, p: nodes.filter(F.col("id") == i).select(*[F.col(c).alias(f"{p}_{c}") for c in nodes.columns])
    pair = cut(side(dup, "d").crossJoin(side(canon, "c")))  # one row
    if pair.isEmpty():
        raise ValueError("no such node")
    fields = [F.struct(F.lit(f).alias("field"), F.col(f"d_{f}").alias("duplicate"), F.col(f"c_{f}").alias("canonical")) for f in ("type", "description") if f in nodes.columns]
    shared = F.array_sort(F.array_intersect(F.map_keys("d_props"), F.map_keys("c_props")))
    props = F.transform(shared, lambda k: F.struct(F.concat(F.lit("props."), k).alias("field"), F.col("d_props")[k].alias("duplicate"), F.col("c_props")[k].alias("canonical")))
    conflicts = cut(pair.select(F.explode(F.concat(F.array(*fields), props)).alias("x")).select("x.*").filter("duplicate <> '' AND canonical <> '' AND duplicate <> canonical"))
    if prefer is None and not conflicts.isEmpty():
        return nodes, edges, conflicts
    first, second = ("d", "c") if prefer == "dup" else ("c", "d")
    merged_props = F.map_from_entries(F.concat(F.map_entries(F.map_filter(f"{second}_props", lambda k, v: ~F.array_contains(F.map_keys(f"{first}_props"), k) & (k != "merged_from"))), F.map_entries(F.map_filter(f"{first}_props", lambda k, v: k != "merged_from"))))
    before = F.array_compact(F.array(F.coalesce(F.col("c_props")["merged_from"], F.col("d_props")["merged_from"])))
    merged_from = F.array_join(F.array_distinct(F.concat(F.flatten(F.transform(before, lambda x: F.split(x, ","))), F.array(F.lit(dup)))), ",")
    values = {"id": F.lit(canon), "sources": F.array_distinct(F.concat(evidence(F.col("c_sources")), evidence(F.col("d_sources")))), "props": F.map_concat(merged_props, F.create_map(F.lit("merged_from"), merged_from))}
    if "aliases" in nodes.columns:
        names = F.array_distinct(F.array_compact(F.concat(F.coalesce("c_aliases", F.array().cast("array<string>")), F.array("d_label"), F.coalesce("d_aliases", F.array().cast("array<string>")))))
        values["aliases"] = F.filter(names, lambda a: (a != "") & (norm(a) != norm(F.coalesce(f"{first}_label", F.lit("")))))
    row = pair.select(*[values.get(c, F.col(f"{first}_{c}")).alias(c) for c in nodes.columns])
    kept = nodes.filter(~F.col("id").isin(dup, canon)).unionByName(row)
    return kept, merge_edges(edges, dup, canon), conflicts


def forget_source(nodes: DataFrame, edges: DataFrame, manifest: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, manifest) without what was recorded from ``path``; nodes stay, without that evidence."""
    return nodes.withColumn("sources", _uncited(evidence(F.col("sources")), path)), remove_source(edges, path), manifest.filter(F.col("source") != path)


def refresh(nodes: DataFrame, edges: DataFrame, staged_nodes: DataFrame, staged_edges: DataFrame, path: str, schema, today: str, prefer_staged: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, conflicts) after one source's evidence and assertions are replaced by the staged ones.

    Conflicts: malformed ids, undeclared types and relations, provenance that is not of the source, attributes that
    differ (unless staged ones win), ends that are no nodes, referenced nodes left without evidence, assertions staged
    twice, ids staged twice. A caller commits only without any. Nodes that nothing supports or refers to go.
    """
    cites = lambda s: F.coalesce(source_path(s) == path, F.lit(False))
    staged = staged_nodes.select("id", "type", "label", "props", evidence(F.col("sources")).alias("sources"))
    fine_id = F.coalesce(is_node_id("id"), F.lit(False))
    out = _conflicts(staged.filter(~fine_id), F.coalesce("id", F.lit("")), "malformed id")
    staged = staged.filter(fine_id)
    out = out.unionByName(_conflicts(staged.filter(~F.coalesce(F.col("type").isin(*schema.types), F.lit(False))), F.col("id"), "undeclared type"))
    foreign = (F.size("sources") == 0) | F.exists("sources", lambda s: ~cites(s))
    out = out.unionByName(_conflicts(staged.filter(foreign), F.col("id"), "provenance of another source"))
    out = out.unionByName(_conflicts(staged.groupBy("id").count().filter("count > 1"), F.col("id"), "staged twice"))
    fields = ("type", "label", "props")
    held = nodes.select("id", *[F.col(c).alias(f"h_{c}") for c in fields], _uncited(evidence(F.col("sources")), path).alias("h_sources"), F.lit(True).alias("held"))
    both = cut(staged.withColumn("staged", F.lit(True)).join(held, "id", "full"))
    empty = lambda c, p: (F.size(F.map_keys(f"{p}{c}")) <= 0) if c == "props" else F.coalesce(F.col(f"{p}{c}") == "", F.lit(True))
    blank = {(c, p): F.col(f"{p}{c}").isNull() | empty(c, p) for c in fields for p in ("", "h_")}
    same = {c: (F.array_sort(F.map_entries(c)) == F.array_sort(F.map_entries(f"h_{c}"))) if c == "props" else F.col(c) == F.col(f"h_{c}") for c in fields}
    clash = F.array_compact(F.array(*[F.when(~blank[c, ""] & ~blank[c, "h_"] & ~same[c], c) for c in fields]))
    if not prefer_staged:
        out = out.unionByName(_conflicts(both.filter("held AND staged").withColumn("c", clash).filter(F.size("c") > 0), F.col("id"), F.concat(F.lit("differs in "), F.array_join("c", ", "))))
    pick = {c: F.when(~blank[c, ""] & (F.lit(prefer_staged) | blank[c, "h_"]), F.col(c)).otherwise(F.coalesce(f"h_{c}", c)) for c in fields}
    none = F.array().cast("array<string>")
    new = both.select("id", *[pick[c].alias(c) for c in fields], F.array_distinct(F.concat(F.coalesce("h_sources", none), F.coalesce("sources", none))).alias("sources"))
    text = F.concat_ws(" ", "from", "rel", "to")
    wrong = ~cites(F.col("source"))
    out = out.unionByName(_conflicts(staged_edges.filter(wrong), text, "source of another path"))
    of_path = staged_edges.filter(~wrong)
    out = out.unionByName(_conflicts(of_path.filter(~F.coalesce(F.col("rel").isin(*schema.relations), F.lit(False))), text, "undeclared relation"))
    ids = new.select("id").distinct()
    ends = of_path.join(ids.select(F.col("id").alias("from"), F.lit(True).alias("f_ok")), "from", "left").join(ids.select(F.col("id").alias("to"), F.lit(True).alias("t_ok")), "to", "left")
    out = out.unionByName(_conflicts(ends.filter("f_ok IS NULL OR t_ok IS NULL"), text, "dangling end"))
    fresh = ends.filter("f_ok AND t_ok").select("from", "rel", "to", "source").withColumn("id", assertion_id("from", "rel", "to", "source")).withColumn("recorded", F.lit(today))
    whole = cut(remove_source(edges, path).select("id", "from", "rel", "to", "source", "recorded").unionByName(fresh))
    twice = whole.groupBy("from", "rel", "to", "source").count().filter("count > 1")
    out = out.unionByName(_conflicts(twice, text, "assertion staged twice"))
    used = whole.select(F.explode(F.array("from", "to")).alias("id")).distinct().withColumn("used", F.lit(True))
    marked = cut(new.join(used, "id", "left"))
    out = out.unionByName(_conflicts(marked.filter("size(sources) = 0 AND used"), F.col("id"), "referenced without evidence"))
    return marked.filter("size(sources) > 0 OR used").drop("used"), whole, cut(out)


def migrate(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the second format: nodes without evidence take the sources of their assertions, in order of
    their text, those that have some keep them; ids of assertions with a source are made anew."""
    old = F.col("source") if "source" in nodes.columns else None
    own = nodes.withColumn("sources", evidence(F.col("sources"), old)).drop("source")
    seen = edges.filter("source <> ''").select(F.explode(F.array("from", "to")).alias("id"), "source").groupBy("id").agg(F.sort_array(F.collect_set("source")).alias("found"))
    filled = F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.coalesce("found", F.array().cast("array<string>")))
    new_id = F.when(F.coalesce(F.col("source") != "", F.lit(False)), assertion_id("from", "rel", "to", "source")).otherwise(F.col("id"))
    return own.join(seen, "id", "left").withColumn("sources", filled).drop("found"), edges.withColumn("id", new_id)


def mark_ingested(manifest: DataFrame, files: DataFrame, today: str, runtime_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest, rejected) with the hashes of ``files`` (source, size, content) entered. All or nothing: with one file
    rejected by ``sources.files.preflight`` the manifest stays."""
    from graphloom.sources.files import preflight

    told = cut(files.select("source", F.sha2("content", 256).alias("sha256"), preflight(F.col("source"), F.col("content"), runtime_days is not None).alias("reason")))
    rejected = told.filter(F.col("reason") != "ok").select("source", "reason")
    if not rejected.isEmpty():
        return manifest, rejected
    new = told.select("source", "sha256", F.lit(today).alias("ingested"), F.lit(runtime_days is not None).alias("runtime"), F.lit(runtime_days).cast("int").alias("max_age_days"))
    kept = manifest.join(new.select("source"), "source", "left_anti")
    return kept.unionByName(new.select(*manifest.columns)), rejected
