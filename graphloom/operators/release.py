"""Release states and registry checks over tables of gates, destinations and entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The grammars of entry names and of versions, and the states of a release.
NAME = "^[a-z0-9]+(-[a-z0-9]+)*$"
VERSION = r"^[0-9]+\.[0-9]+\.[0-9]+(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$"
PLANNED, READY, BLOCKED, PUBLISHED_VERIFIED, PUBLISHED_PARTIAL, ARCHIVED_VERIFIED = "PLANNED", "READY", "BLOCKED", "PUBLISHED_VERIFIED", "PUBLISHED_PARTIAL", "ARCHIVED_VERIFIED"


def release_states(candidates: DataFrame, gates: DataFrame, destinations: DataFrame, retirements: DataFrame) -> DataFrame:
    """candidate and status of each row of ``candidates`` (candidate).

    ``gates``: candidate, state (PASS, FAIL, UNKNOWN; null: not run). ``destinations``: candidate, state (VERIFIED from
    the consumer's side, PUBLISHED and not yet verified, FAILED, UNKNOWN; null: unknown). ``retirements``: candidate,
    visible, replaced. What happened last decides: a retirement of which all is visible and replaced, then publication,
    which is verified only if every destination is, then the gates. Gates none of which ran, or none at all, are a
    plan; one that failed, is unknown or was skipped blocks. Each side is aggregated before it is joined.
    """
    passed = F.coalesce(F.col("state") == "PASS", F.lit(False))
    verified = F.coalesce(F.col("state") == "VERIFIED", F.lit(False))
    out = F.coalesce(F.col("state").isin("VERIFIED", "PUBLISHED"), F.lit(False))
    gone = F.coalesce(F.col("visible") & F.col("replaced"), F.lit(False))
    g = gates.groupBy("candidate").agg(F.count("state").alias("ran"), F.bool_and(passed).alias("passed"))
    d = destinations.groupBy("candidate").agg(F.bool_or(out).alias("out"), F.bool_and(verified).alias("verified"))
    r = retirements.groupBy("candidate").agg(F.bool_and(gone).alias("gone"))
    status = F.when(F.col("gone"), ARCHIVED_VERIFIED).when(F.col("verified"), PUBLISHED_VERIFIED).when(F.col("out"), PUBLISHED_PARTIAL)
    status = status.when(F.coalesce("ran", F.lit(0)) == 0, PLANNED).when(F.col("passed"), READY).otherwise(BLOCKED)
    return candidates.select("candidate").distinct().join(g, "candidate", "left").join(d, "candidate", "left").join(r, "candidate", "left").select("candidate", status.alias("status"))


def registry_findings(entries: DataFrame, found: DataFrame) -> DataFrame:
    """name and finding. ``entries``: name, version as registered; ``found``: name, version of what is there.

    A name or version that is null or breaks its grammar, a name registered more than once, entries or found rows of
    one name with several versions between them, and names of one side only. Each name's rows are counted before the join.
    """
    versions = F.sort_array(F.collect_set("version"))
    bad = F.coalesce(~F.col("version").rlike(VERSION), F.lit(True))
    e = entries.groupBy("name").agg(F.count("*").alias("times"), F.bool_or(bad).alias("bad"), versions.alias("wanted"))
    f = found.groupBy("name").agg(F.count("*").alias("there"), versions.alias("has"))
    both = e.join(f, e["name"].eqNullSafe(f["name"]), "full").select(F.coalesce(e["name"], f["name"]).alias("name"), "times", "bad", "wanted", "there", "has")
    registered, there = F.col("times").isNotNull(), F.col("there").isNotNull()
    checks = F.array_compact(
        F.array(
            F.when(registered & F.coalesce(~F.col("name").rlike(NAME), F.lit(True)), "bad name"),
            F.when(registered & F.col("bad"), "bad version"),
            F.when(F.col("times") > 1, "registered more than once"),
            F.when(registered & there & ((F.col("wanted") != F.col("has")) | (F.size("wanted") > 1)), "versions differ"),
            F.when(registered & ~there, "missing"),
            F.when(~registered & there, "not registered"),
        )
    )
    return both.select("name", F.explode(checks).alias("finding"))


# Manifests by path, their kinds, and for TOML the sections that hold a version.
KINDS = {"pyproject.toml": "python", "package.json": "node", "Cargo.toml": "rust", ".codex-plugin/plugin.json": "codex-plugin", ".claude-plugin/plugin.json": "claude-plugin"}
SECTIONS = {"pyproject.toml": ["project", "tool.poetry"], "Cargo.toml": ["package"]}
VERSION_LINE = r"""^\s*version\s*=\s*["']([^"']+)["']\s*(?:#.*)?$"""


def manifest_versions(files: DataFrame) -> DataFrame:
    """root, path, kind and version of each manifest that names one. ``files``: root, path, text.

    TOML: the first version line within a section that may hold one; lines before any section count for none. JSON: the
    version of an object, if it is a string and not empty. Null and unreadable texts name none. A file's lines are
    folded in its row, so nothing is shuffled.
    """
    kind, sections = F.lit(None).cast("string"), F.array().cast("array<string>")
    for path, name in KINDS.items():
        kind = F.when(F.col("path") == path, name).otherwise(kind)
    for path, names in SECTIONS.items():
        sections = F.when(F.col("path") == path, F.array(*map(F.lit, names))).otherwise(sections)

    def step(state, raw):
        line = F.regexp_replace(raw, r"^\s+|\s+$", "")
        head = line.rlike(r"^\[.*\]$")
        section = F.when(head, F.regexp_replace(line, r"^\[\s*|\s*\]$", "")).otherwise(state["section"])
        here = F.when(~head & F.array_contains(sections, state["section"]) & raw.rlike(VERSION_LINE), F.regexp_extract(raw, VERSION_LINE, 1))
        return F.struct(section.alias("section"), F.coalesce(state["version"], here).alias("version"))

    start = F.struct(F.lit("").alias("section"), F.lit(None).cast("string").alias("version"))
    toml = F.aggregate(F.split("text", r"\r\n|[\n\r]"), start, step)["version"]
    value = F.try_variant_get(F.try_parse_json("text"), "$.version", "variant")
    json = F.when(F.schema_of_variant(value) == "STRING", F.nullif(F.try_variant_get(value, "$", "string"), F.lit("")))
    version = F.when(F.endswith("path", F.lit(".toml")), toml).otherwise(json)
    return files.filter(kind.isNotNull()).select("root", "path", kind.alias("kind"), version.alias("version")).filter("version IS NOT NULL")


def preflight(roots: DataFrame, versions: DataFrame, tags: DataFrame) -> DataFrame:
    """root, code, severity and status: a row a finding, and one without a code for a root that has none.

    ``roots``: root, git, branch, changes (count), expected (version; null: none). ``versions``: as from
    ``manifest_versions``. ``tags``: root, tag. Outside git nothing is asked of the work tree; a root is blocked by any
    finding that is no warning. Versions and tags are reduced to a row a root before they are joined.
    """
    v = versions.groupBy("root").agg(F.collect_set("version").alias("found"))
    wanted = roots.filter("git AND expected <> ''").select("root", F.explode(F.array("expected", F.concat(F.lit("v"), "expected"))).alias("tag"))
    taken = tags.join(wanted, ["root", "tag"], "left_semi").select("root").distinct().withColumn("taken", F.lit(True))
    # A null expectation or branch reads as none; an empty one too.
    git, expected, n = F.coalesce("git", F.lit(False)), F.nullif("expected", F.lit("")), F.coalesce(F.size("found"), F.lit(0))
    has = F.col("found").isNotNull()
    checks = {
        "not_git_repository": ~git,
        "dirty_worktree": git & (F.col("changes") > 0),
        "detached_head": git & (F.coalesce("branch", F.lit("")) == ""),
        "tag_collision": F.coalesce("taken", F.lit(False)),
        "no_version_metadata": ~has,
        "inconsistent_versions": has & (n > 1),
        "expected_version_mismatch": has & expected.isNotNull() & F.exists("found", lambda x: x != expected),
    }
    codes = F.array_compact(F.array(*[F.when(test, code) for code, test in checks.items()]))
    warning = lambda c: c.isin("detached_head", "no_version_metadata")
    told = roots.join(v, "root", "left").join(taken, "root", "left").select("root", codes.alias("codes"))
    status = F.when(F.exists("codes", lambda c: ~warning(c)), "blocked").otherwise("ready")
    return told.select("root", F.explode_outer("codes").alias("code"), status.alias("status")).select("root", "code", F.when(warning(F.col("code")), "warning").when(F.col("code").isNotNull(), "blocker").alias("severity"), "status")


def install_plan(wanted: DataFrame, found: DataFrame, copies: bool = False) -> DataFrame:
    """name, target, state and action of each row of ``wanted``.

    ``wanted``: name, target, place, digest (of the whole tree). ``found``: name, target, link (where a link leads;
    null: no link), digest (null: no folder). A link is in step if it leads to the place, else a conflict; what is no
    link is in step only when copies are asked for and the digests agree. Nothing that is there is ever replaced.
    """
    there = found.select("name", "target", "link", F.col("digest").alias("has"), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("link") == F.col("place"), "synced").when(F.col("link").isNotNull(), "conflict-link")
    state = state.when(F.lit(copies) & (F.col("has") == F.col("digest")), "synced-copy").otherwise("conflict-existing")
    action = F.when(F.col("state") == "missing", "PLAN").when(F.startswith("state", F.lit("synced")), "OK").otherwise("CONFLICT")
    return wanted.join(there, ["name", "target"], "left").select("name", "target", state.alias("state")).withColumn("action", action)
