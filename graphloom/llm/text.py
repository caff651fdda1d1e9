"""Shared text plumbing of the corpus operators: Arrow batches of (doc_id, text), ASCII words, vocabulary memo."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes that one Arrow batch holds at most, so that a batch of very long texts fits a worker. One size serves
#: all operators: frames run lazily, so the setting of one would else rule another.
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20


def bounded_batches(df: DataFrame) -> None:
    """Lowers the session's bounds to these; lower ones of the session stay."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added to those that a column of ``df`` has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Free memory that allocators still hold goes back to the system: a worker outlives its task and waits beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def id_and_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Just the two columns that an operator reads; columns with other or clashing names do not reach it."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def rows_of(batch: pa.RecordBatch) -> tuple[list, list[str]]:
    """Ids (null stays null) and texts (null is the empty text) of one batch."""
    return batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]


def map_texts(docs: DataFrame, rows: Callable[[list, list[str]], dict[str, list]], schema: str) -> DataFrame:
    """``rows`` gets the ids and texts of a batch and gives the columns of ``schema``; narrow, no shuffle."""
    bounded_batches(docs)
    names = [part.split()[0] for part in schema.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = rows(*rows_of(batch))
                yield pa.RecordBatch.from_arrays([pa.array(out[n], arrow.field(n).type) for n in names], schema=arrow)
        give_back()

    return id_and_text(docs).mapInArrow(run, schema)


def words_of(text: str) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D: exactly what ``bytes.split`` takes as white space."""
    return text.encode().split()


class Memo(dict):
    """A cache that is emptied at ``limit`` entries; a miss calls ``make``."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.make(key)
        return value

