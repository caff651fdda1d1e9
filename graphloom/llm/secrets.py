"""Secret scans by a trigram inverted index, in DataFrame functions only.

Each rule's regex is read once into a Boolean trigram query: literal runs must show their trigrams, alternatives are
joined by OR, sequences by AND. The index posts every document under each query trigram it holds; the postings of a
rule's trigrams are intersected (bit by bit, combined before the shuffle), and what a query leaves as candidates is
verified by the regex itself on the whole text. Rules without a mandatory trigram scan every text.

Spans are (kind, start, end) in code points, leftmost and non-overlapping within a kind, whole texts, any number.

Defined results: a null text counts as empty and has no spans; equal rows give equal results; documents with a null
id are scanned like others; rows of one id are posted by id and a hash of the text, so that neither an id of many rows
nor the null id gathers them in one task; columns of ``docs`` may have any names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import fresh

ALL = ("all",)
#: String sets that are followed exactly; larger ones are cut into their trigrams.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``group``: the group whose length must be ``least`` or more; other matches are dropped. ``base``: of the contract."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False
    base: bool = False

    @property
    def regex(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


# The base patterns and public token formats.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, any_case=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, base=True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("vcs_token", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)


def _trigrams(strings: set[str]) -> tuple:
    """What a text that holds one of the strings must show."""
    if any(len(s) < 3 for s in strings):
        return ALL
    return _or([_and([("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _and(parts: list[tuple]) -> tuple:
    parts = list(dict.fromkeys(p for p in parts if p != ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts: list[tuple]) -> tuple:
    held = {p: frozenset(p[1:]) if p[0] == "and" else frozenset([p]) for p in parts}
    parts = [p for p in held if not any(other < held[p] for other in held.values())]  # a AND b adds nothing to a
    return ALL if ALL in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _read(nodes, any_case: bool) -> tuple[set[str] | None, tuple]:
    """Of a sequence: the strings it can be (None: too many), and its query."""
    whole, run, query = True, {""}, []
    for kind, value in nodes:
        exact, need = _read_one(kind, value, any_case)
        if exact is not None and len(run) * len(exact) <= MOST_STRINGS:
            run = {a + b for a in run for b in exact}
            continue
        query.append(_trigrams(run))
        query.append(need if exact is None else ALL)
        run, whole = (exact if exact is not None else {""}), False
    query.append(_trigrams(run))
    return (run if whole else None), _and(query)


def _read_one(kind, value, any_case: bool) -> tuple[set[str] | None, tuple]:
    if kind is op.LITERAL:
        return {chr(value).lower()}, ALL
    if kind is op.IN:
        chars = {chr(v).lower() for k, v in value if k is op.LITERAL}
        return (chars, ALL) if len(chars) <= 8 and all(k is op.LITERAL for k, _ in value) else (None, ALL)
    if kind is op.SUBPATTERN:
        return _read(value[3], any_case)
    if kind is op.BRANCH:
        read = [_read(branch, any_case) for branch in value[1]]
        if all(e is not None for e, _ in read) and sum(len(e) for e, _ in read) <= MOST_STRINGS:
            return set().union(*(e for e, _ in read)), ALL
        return None, _or([q if e is None else _trigrams(e) for e, q in read])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        exact, need = _read(inner, any_case)
        if exact is not None and (low, high) == (0, 1):
            return exact | {""}, ALL
        if exact is not None and low == high and len(exact) ** low <= MOST_STRINGS:
            strings = {""}
            for _ in range(low):
                strings = {a + b for a in strings for b in exact}
            return strings, ALL
        return None, (ALL if low == 0 else need if exact is None else _trigrams(exact))
    if kind is op.AT:
        return {""}, ALL
    return None, ALL


def trigram_query(pattern: str, any_case: bool = False) -> tuple:
    """("tri", t), ("and", ...), ("or", ...) or ("all",), over trigrams of the lower-cased text."""
    return _read(_parser.parse(pattern, re.IGNORECASE if any_case else 0), any_case)[1]


def trigrams_in(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*(trigrams_in(q) for q in query[1:] if isinstance(q, tuple)), set())


def query_trigrams(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted(set().union(*(trigrams_in(trigram_query(r.pattern, r.any_case)) for r in rules)))


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id, salt): every document under each of the given trigrams that its lower-cased text holds."""
    low = docs.select("doc_id", _salt(docs["text"]).alias("salt"), F.lower(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(n)) for n, t in enumerate(trigrams)]))
    return low.select("doc_id", "salt", F.explode(held).alias("trigram"))


#: Rows of one id spread over so many keys.
SALTS = 1024


def _salt(text: Column) -> Column:
    return F.pmod(F.xxhash64(text.cast("string")), F.lit(SALTS)).cast("int")


def candidates(postings: DataFrame, trigrams: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, salt and one Boolean ``may_<kind>`` for each rule with a query: the intersected postings."""
    place = {t: n for n, t in enumerate(trigrams)}
    masks = [
        F.bit_or(F.when(F.floor(F.col("trigram") / 63) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("trigram") % 63).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"m{w}")
        for w in range(-(-len(trigrams) // 63))
    ]

    def held(query: tuple) -> Column:
        if query[0] == "tri":
            n = place[query[1]]
            return F.col(f"m{n // 63}").bitwiseAND(F.lit(1 << (n % 63))) != 0
        parts = [held(q) for q in query[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if query[0] == "and" else (out | p)
        return out

    queries = {r.kind: trigram_query(r.pattern, r.any_case) for r in rules}
    posted = postings.groupBy("doc_id", "salt").agg(*masks)
    flags = {k: held(q) for k, q in queries.items() if q != ALL}
    found = posted.select("doc_id", "salt", *[c.alias(f"may_{k}") for k, c in flags.items()])
    any_flag = None
    for k in flags:
        any_flag = F.col(f"may_{k}") if any_flag is None else any_flag | F.col(f"may_{k}")
    return found.filter(any_flag) if any_flag is not None else found.filter(F.lit(False))


SPANS = "array<struct<s:int,e:int>>"


def rule_spans(text: Column, rule: Rule) -> Column:
    """All spans of one rule: the pieces between matches and the matches give the places."""
    regex = F.lit(rule.regex)
    found = F.arrays_zip(
        F.split(text, rule.regex, -1).alias("gap"),
        F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, regex, F.lit(rule.group)).alias("part"),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        keep = x["hit"].isNotNull() & (F.length(x["part"]) >= rule.least)
        span = F.array(F.struct(start.alias("s"), end.alias("e")))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(found, zero, step, lambda acc: acc["spans"])


def _numbered(spans: Column, n: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("k"), x["e"].alias("e")))


def _of_rule(spans: str, n: int) -> Column:
    return F.filter(spans, lambda x: x["k"] == n)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, name: str = "secret_spans") -> DataFrame:
    """Adds ``name``: array of (kind number, start, end) by start, then rule order, to each row of ``docs``."""
    trigrams = query_trigrams(rules)
    may = candidates(build_index(docs.select("doc_id", "text"), trigrams), trigrams, rules)
    kinds = [c.removeprefix("may_") for c in may.columns if c.startswith("may_")]
    key, salt, own, *flags = fresh(docs, "posted_id", "posted_salt", "own_salt", *[f"may_{k}" for k in kinds])
    renamed = may.select(F.col("doc_id").alias(key), F.col("salt").alias(salt), *[F.col(f"may_{k}").alias(f) for k, f in zip(kinds, flags, strict=True)])
    salted = docs.withColumn(own, _salt(F.col("text")))
    joined = salted.join(renamed, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(salt)), "left")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    flag = dict(zip(kinds, flags, strict=True))
    parts = []
    for n, rule in enumerate(rules):
        hit = text.rlike(rule.regex)
        if rule.kind in flag:
            hit = F.coalesce(F.col(flag[rule.kind]), F.lit(False)) & hit
        spans = _numbered(rule_spans(text, rule), n)
        parts.append(F.when(hit, spans).otherwise(none))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.array_sort(F.concat(*parts)).alias(name))


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<base kind>, base_sha256, spans."""
    found = find_secrets(docs.select("doc_id", "text"), rules)
    base = [n for n, r in enumerate(rules) if r.base]
    of_base = F.filter("secret_spans", lambda x: x["k"].isin(base))
    counts = [F.size(_of_rule("secret_spans", n)).cast("long").alias(f"n_{rules[n].kind}") for n in base]
    return found.select("doc_id", *counts, F.sha2(span_text(of_base, rules), 256).alias("base_sha256"), span_text(F.col("secret_spans"), rules).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Replaces every span by ``mark``; spans that overlap are replaced as one. Other columns stay; a null text stays null."""
    (spans,) = fresh(docs, "secret_spans")
    found = find_secrets(docs, rules, spans)

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(F.col("text"))).drop(spans)
