"""Triple-pattern queries compiled to one DataFrame plan: joins, optional and negated groups, filters, counts, closure."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.session import cut

_FILTER = re.compile(r"^\?(\w+)\.(type|id|label|props\.[\w.-]+)\s*(!=|=)\s*(.+)$")


@dataclass(frozen=True)
class Triple:
    s: str
    p: str
    o: str


def parse(text: str) -> Triple:
    parts = text.split(None, 2)
    if len(parts) != 3:
        raise ValueError(f"a pattern has three terms: {text!r}")
    if parts[1].startswith("?"):
        raise ValueError("a relation cannot be a variable")
    return Triple(*parts)


def is_var(term: str) -> bool:
    return term.startswith("?")


@dataclass
class Graph:
    """``relations``: flags of edge types, {rel: {"symmetric": bool, "inverse": rel}}."""

    nodes: DataFrame
    edges: DataFrame
    relations: dict[str, dict] = field(default_factory=dict)

    def expand(self, rel: str) -> DataFrame:
        """(s, o) of a relation, with its symmetric and inverse readings; subjects are nodes."""
        e = self.edges
        hits = e.filter(F.col("rel") == rel).select(F.col("from").alias("s"), F.col("to").alias("o"))
        turned = lambda r: e.filter(F.col("rel") == r).select(F.col("to").alias("s"), F.col("from").alias("o"))
        if self._symmetric(rel):
            hits = hits.unionByName(turned(rel))
        for r in self._inverses(rel):
            hits = hits.unionByName(turned(r))
        known = self.nodes.select(F.col("id").alias("s"))
        return hits.join(known, "s", "left_semi").distinct()

    def _symmetric(self, rel: str) -> bool:
        return bool(self.relations.get(rel, {}).get("symmetric"))

    def _inverses(self, rel: str) -> list[str]:
        own = self.relations.get(rel, {}).get("inverse")
        return sorted(({own} if own else set()) | {r for r, f in self.relations.items() if f.get("inverse") == rel})

    def _by_classes(self, rel: str) -> bool:
        """Whether every step can be gone back, so that closure is the same as being connected."""
        return self._symmetric(rel) and not self._inverses(rel)

    def classes(self, rel: str) -> DataFrame:
        """(id, component) of the nodes with a step of a symmetric relation, in a number of rounds that grows with the
        logarithm of the longest chain. Each node reaches its whole class, itself included: there and back."""
        known = self.nodes.select("id")
        inside = self.edges.filter(F.col("rel") == rel).select(F.col("from").alias("a"), F.col("to").alias("b")).join(known, F.col("a") == known["id"], "left_semi").join(known, F.col("b") == known["id"], "left_semi")
        return connected_components(inside)

    def closure_counts(self, rel: str) -> DataFrame:
        """(id, n): how many nodes each node reaches by a symmetric relation, from the sizes of the classes; no pair is made."""
        found = cut(self.classes(rel))
        return found.join(found.groupBy("component").agg(F.count("*").alias("n")), "component").select("id", "n")

    def closure(self, rel: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """(s, o) by one step or more. A bound end is where the loop starts, so only what it reaches is made."""
        if self._by_classes(rel):
            found = cut(self.classes(rel))
            one, two = found.select(F.col("id").alias("s"), "component"), found.select(F.col("id").alias("o"), "component")
            one = one if start is None else one.filter(F.col("s") == start)
            two = two if end is None else two.filter(F.col("o") == end)
            return one.join(two, "component").select("s", "o")
        known = self.nodes.select(F.col("id").alias("o"))
        step = cut(self.expand(rel).join(known, "o", "left_semi").select("s", "o"))
        if end is not None and start is None:
            back = step.select(F.col("o").alias("s"), F.col("s").alias("o"))
            return self._grow(back, back.filter(F.col("s") == end)).select(F.col("o").alias("s"), F.col("s").alias("o"))
        first = step if start is None else step.filter(F.col("s") == start)
        out = self._grow(step, first)
        return out if end is None else out.filter(F.col("o") == end)

    @staticmethod
    def _grow(step: DataFrame, first: DataFrame) -> DataFrame:
        rounds = [cut(first.select("s", "o").distinct())]
        hop = step.select(F.col("s").alias("o"), F.col("o").alias("n"))
        while True:
            seen = rounds[0]
            for r in rounds[1:]:
                seen = seen.unionByName(r)
            new = cut(rounds[-1].join(hop, "o").select("s", F.col("n").alias("o")).distinct().join(seen, ["s", "o"], "left_anti"))
            if new.isEmpty():
                return seen
            rounds.append(new)

    def pairs(self, t: Triple) -> DataFrame:
        if t.p == "type":
            return self.nodes.select(F.col("id").alias("s"), F.col("type").alias("o"))
        if t.p.startswith("prop."):
            return self.nodes.select(F.col("id").alias("s"), F.col("props")[t.p[5:]].alias("o")).filter(F.col("o").isNotNull())
        if t.p.rstrip("+") in ("*", "_"):
            known = self.nodes.select(F.col("id").alias("s"))
            return self.edges.select(F.col("from").alias("s"), F.col("to").alias("o")).distinct().join(known, "s", "left_semi")
        if t.p.endswith("+"):
            ends = [None if is_var(x) or x in ("*", "_") else x for x in (t.s, t.o)]
            return self.closure(t.p[:-1], *ends)
        return self.expand(t.p)

    def bindings(self, t: Triple) -> DataFrame:
        """One column for each variable of a pattern."""
        df, columns = self.pairs(t), {}
        for place, term in (("s", t.s), ("o", t.o)):
            if is_var(term):
                if term[1:] in columns:
                    df = df.filter(F.col("s") == F.col("o"))
                columns.setdefault(term[1:], place)
            elif term not in ("*", "_"):
                df = df.filter(F.col(place) == term)
        return df.select(*[F.col(p).alias(v) for v, p in columns.items()]).distinct() if columns else df.limit(1).select(F.lit(True).alias("__holds"))

    def join_all(self, patterns: list[Triple]) -> DataFrame:
        acc = None
        for t in patterns:
            b = self.bindings(t)
            if acc is None:
                acc = b
                continue
            shared = [c for c in b.columns if c in acc.columns]
            acc = acc.join(b, shared) if shared else acc.crossJoin(b)
        return acc.distinct()

    def resolved(self, patterns: list[str]) -> list[str]:
        """Patterns whose constants are ids: one that is none stands for the one node that bears it as a label or alias.
        Objects of ``type`` and ``prop.`` relations stay as they are, and so does what nothing or more than one node bears."""
        from graphloom.operators.graph import resolve

        triples = [parse(p) for p in patterns]
        free = [("s", t.s) for t in triples] + [("o", t.o) for t in triples if t.p != "type" and not t.p.startswith("prop.")]
        terms = sorted({x for _, x in free if not is_var(x) and x not in ("*", "_")})
        if not terms:
            return patterns
        rows = resolve(self.nodes, self.nodes.sparkSession.createDataFrame([(x,) for x in terms], "term string")).collect()  # as many as constants
        known = {r["term"]: r["ids"][0] for r in rows if r["status"] in ("exact", "unique")}
        fixed = lambda t: t.p == "type" or t.p.startswith("prop.")
        return [" ".join((known.get(t.s, t.s), t.p, t.o if fixed(t) else known.get(t.o, t.o))) for t in triples]

    def labelled(self, answers: DataFrame) -> DataFrame:
        """Answers as they are shown: ``id (label)``, the bare term where there is no other label, ``?`` where unbound."""
        out = answers
        for i, c in enumerate(answers.columns):
            names = self.nodes.select(F.col("id").alias(f"__id{i}"), F.col("label").alias(f"__label{i}"))
            shown = F.when((F.col(f"__label{i}") != "") & (F.col(f"__label{i}") != F.col(c)), F.concat(F.col(c), F.lit(" ("), F.col(f"__label{i}"), F.lit(")"))).otherwise(F.coalesce(F.col(c), F.lit("?")))
            out = out.join(names, F.col(c) == F.col(f"__id{i}"), "left").withColumn(c, shown).drop(f"__id{i}", f"__label{i}")
        return out.distinct()

    def query(self, patterns: list[str], optional: tuple[str, ...] = (), negated: tuple[str, ...] = (), filters: tuple[str, ...] = (), count_by: str | None = None) -> DataFrame:
        if count_by and len(patterns) == 1 and not (optional or negated or filters):
            t = parse(patterns[0])
            if t.p.endswith("+") and self._by_classes(t.p[:-1]) and is_var(t.s) and is_var(t.o) and t.s != t.o and count_by.lstrip("?") in (t.s[1:], t.o[1:]):
                return self.closure_counts(t.p[:-1]).withColumnRenamed("id", count_by.lstrip("?"))  # reaching goes both ways
        acc = self.join_all([parse(p) for p in patterns])
        certain = set(acc.columns)
        for p in optional:
            acc = self._optional(acc, self.bindings(parse(p)), certain)
        shown = [c for c in acc.columns if c != "__holds"]
        if negated:
            group = self.join_all([parse(p) for p in negated])
            shared = [c for c in group.columns if c in acc.columns]
            acc = acc.join(group.select(*shared).distinct(), shared, "left_anti") if shared else acc.join(group.limit(1).select(F.lit(1).alias("__any")), F.lit(True), "left_anti")
        for f in filters:
            acc = self._filter(acc, f)
        acc = acc.select(*shown).distinct() if shown else acc
        if count_by:
            return acc.groupBy(count_by.lstrip("?")).agg(F.count("*").alias("n"))
        return acc

    @staticmethod
    def _optional(acc: DataFrame, b: DataFrame, certain: set[str]) -> DataFrame:
        """Left join. Rows in which a shared variable is unbound go without that key, so both halves stay equi-joins."""
        shared = [c for c in b.columns if c in acc.columns]
        open_vars = [c for c in shared if c not in certain]
        new = [c for c in b.columns if c not in acc.columns]
        if not shared:
            return acc.join(b, F.lit(True), "left")
        halves = [(acc, shared)]
        for v in open_vars:
            halves = [x for df, keys in halves for x in ((df.filter(F.col(v).isNotNull()), keys), (df.filter(F.col(v).isNull()), [k for k in keys if k != v]))]
        out = None
        for df, keys in halves:
            right = b.select(*[F.col(c).alias(f"__{c}") for c in b.columns])
            on = [df[k] == right[f"__{k}"] for k in keys] or [F.lit(True)]
            cond = on[0]
            for c in on[1:]:
                cond = cond & c
            joined = df.join(right, cond, "left")
            picked = joined.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in open_vars and c not in keys else df[c].alias(c) for c in acc.columns], *[F.col(f"__{c}").alias(c) for c in new])
            out = picked if out is None else out.unionByName(picked)
        return out.distinct()

    def _filter(self, acc: DataFrame, text: str) -> DataFrame:
        m = _FILTER.match(text)
        if not m:
            raise ValueError(f"not a filter: {text!r}")
        var, key, sign, values = m.groups()
        value = F.col("props")[key[6:]] if key.startswith("props.") else F.col(key)
        actual = self.nodes.select(F.col("id").alias(var), F.coalesce(value.cast("string"), F.lit("None")).alias("__actual"))
        held = F.col("__actual").isin([v.strip() for v in values.split(",")])
        return acc.join(actual, var).filter(held if sign == "=" else ~held).drop("__actual")
