"""Files of a graph: JSON lines with an error table, strict readers, hashes, preflight, and versioned tables behind a pointer."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "id string, type string, label string, aliases array<string>, description string, props map<string,string>, sources array<string>, source string"
EDGE = "id string, `from` string, rel string, `to` string, source string, recorded string, props map<string,string>"
MANIFEST = "source string, sha256 string, ingested string, runtime boolean, max_age_days int"
GRAPH_FORMAT = SCHEMA_VERSION = 2

# What is never taken as a source.
MOST_BYTES = 2 * 1024 * 1024
SENSITIVE_NAME = r"(?i)(^|/)(\.env($|\.)|id_(rsa|dsa|ecdsa|ed25519)(\.pub)?$|.*\.(pem|key|p12|pfx|keystore)$|credentials?(\..*)?$|secrets?(\..*)?$)"
RUNTIME_NAME = r"(?i)(^|/)(logs?|runtime|state|tmp|cache)(/|$)|\.(log|sqlite|db)$"
SECRETS = (
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"(?i)\b(?:api[_-]?key|secret|token|password)\s*[:=]\s*[\"']?[A-Za-z0-9_./+=-]{16,}",
)


def json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """(ord, line) -> (ord, error, row): blank lines are left out; ``error`` tells bad JSON and JSON that is no object."""
    said = lines.filter(F.trim("line") != "")
    parsed = F.try_parse_json("line")
    error = F.when(parsed.isNull(), "bad JSON").when(~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), "not an object")
    return said.select("ord", error.alias("error"), F.from_json("line", schema).alias("row"))


def load_nodes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, errors): of lines with one id the last is the node and each further one an error; bad lines are errors."""
    read = json_lines(lines, NODE)
    fine = read.filter("error IS NULL")
    nodes = fine.groupBy("row.id").agg(F.max_by("row", "ord").alias("row"), F.min("ord").alias("first")).select("row.*", F.col("first").alias("ord"))
    first = fine.groupBy("row.id").agg(F.min("ord").alias("first"))
    again = fine.select("ord", F.col("row.id").alias("id")).join(first, "id").filter("ord > first").select("ord", F.concat(F.lit("duplicate node id "), "id").alias("error"))
    return nodes, read.filter("error IS NOT NULL").select("ord", "error").unionByName(again)


def load_edges(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    read = json_lines(lines, EDGE)
    return read.filter("error IS NULL").select("row.*", "ord"), read.filter("error IS NOT NULL").select("ord", "error")


def load_strict(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of staged lines; the first bad one raises with its number."""
    read = json_lines(lines, schema)
    bad = read.filter("error IS NOT NULL").orderBy("ord").limit(1).collect()
    if bad:
        raise ValueError(f"line {bad[0]['ord'] + 1}: {bad[0]['error']}")
    return read.select("row.*", "ord")


def load_object(path: str) -> dict:
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError(f"{path}: expected a JSON object")
    return value


def hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, size, sha256) of files."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("source"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def preflight(source: Column, content: Column, allow_runtime: bool = False) -> Column:
    """The first reason against a source, or ``ok``: name, runtime name, size, NUL, secrets; content is bytes or text."""
    data = content.cast("binary")
    text = F.decode(data, "ISO-8859-1")  # one character a byte, as the patterns are on bytes
    out = F.when(source.rlike(SENSITIVE_NAME), "sensitive name")
    if not allow_runtime:
        out = out.when(source.rlike(RUNTIME_NAME), "runtime name")
    out = out.when(content.isNull(), "not a file").when(F.octet_length(data) > MOST_BYTES, "oversized").when(F.contains(text, F.lit("\0")), "binary")
    for pattern in SECRETS:
        out = out.when(text.rlike(pattern), "secret pattern")
    return out.otherwise("ok")


def digest(parts: DataFrame) -> DataFrame:
    """One row: sha256 over name, NUL and content of the rows (place, name, content), in order of their places. Few rows."""
    said = F.array_sort(F.collect_list(F.struct("place", F.concat(F.encode(F.concat("name", F.lit("\0")), "UTF-8"), F.col("content").cast("binary")).alias("x"))))
    return parts.agg(said.alias("a")).select(F.sha2(F.aggregate("a", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["x"])), 256).alias("digest"))


def find_root(start: str, names: tuple[str, ...] = ("nodes.jsonl", "edges.jsonl", "schema.json", "manifest.json"), folder: str = "knowledge-graph") -> str | None:
    """The nearest folder, from ``start`` up, whose ``folder`` holds all files."""
    at = Path(start).resolve()
    return next((str(p) for p in (at, *at.parents) if all((p / folder / n).is_file() for n in names)), None)


def frontmatter(text: str) -> dict[str, str]:
    """Fields of the block between the first two ``---`` lines; an indented line continues the field above it."""
    head, mark, rest = text.partition("---\n")
    if head or not mark:
        raise ValueError("missing frontmatter")
    fields: dict[str, str] = {}
    key = ""
    for line in rest.partition("---\n")[0].splitlines():
        if key and line[:1] in (" ", "\t"):
            fields[key] += " " + line.strip()
        elif ":" in line:
            key, value = (x.strip() for x in line.split(":", 1))
            fields[key] = value.strip("\"'")
    return fields


class Store:
    """Versions of a graph's tables in a folder. A commit writes a new version whole and then moves a pointer file, so
    readers see the old or the new one, never a mixture; a commit on another version than it read is refused."""

    TABLES = ("nodes", "edges", "manifest")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder)

    @property
    def version(self) -> int:
        pointer = self.folder / "CURRENT"
        return int(pointer.read_text()) if pointer.exists() else 0

    def init(self) -> None:
        """Empty typed tables, unless the store has some."""
        if not self.version:
            empty = {"nodes": NODE.removesuffix(", source string"), "edges": EDGE, "manifest": MANIFEST}
            self.commit({k: self.spark.createDataFrame([], v) for k, v in empty.items()}, 0)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(str(self.folder / f"v{version or self.version}" / name))

    def commit(self, tables: dict[str, DataFrame], based_on: int, dry_run: bool = False) -> int:
        """Writes the given tables, and the others as they were; gives the new version. A dry run writes nothing."""
        if dry_run:
            return based_on
        self.folder.mkdir(parents=True, exist_ok=True)
        new = based_on + 1
        lock = self.folder / f"v{new}.lock"
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
        except FileExistsError as taken:
            raise RuntimeError(f"version {new} is being written or was written by another") from taken
        if self.version != based_on:
            lock.unlink()
            raise RuntimeError(f"the graph moved on from version {based_on}")
        for name in self.TABLES:
            frame = tables.get(name)
            (frame if frame is not None else self.read(name, based_on)).write.mode("overwrite").parquet(str(self.folder / f"v{new}" / name))
        handle, temporary = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(handle, "w") as f:
            f.write(str(new))
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, self.folder / "CURRENT")
        return new

    def append(self, name: str, rows: DataFrame) -> int:
        at = self.version
        old = self.read(name, at)
        return self.commit({name: old.unionByName(rows.select(*old.columns))}, at)
