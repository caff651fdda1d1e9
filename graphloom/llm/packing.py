"""Best-fit packing with certified partitions.

Documents become token ids and an end id; one that is longer than a sequence is cut so that only its first piece is
shorter than a sequence. Full pieces are sequences by themselves. The rest is dealt into groups of bounded size; each
group is packed by best-fit decreasing, and dual feasible functions give a lower bound of its sequence count. Where
count and bound meet, the group's packing is certified. What stands in groups with a gap, and in the emptiest sequence
of the others, is exchanged: dealt anew over fewer groups and packed again, until one group is left, the bound of all
pieces is met, or a turn saves no sequence more.

Defined results: a null or empty text is a piece of one token (the end id); repeated rows are packed one by one;
without documents there are no pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import Pieces
from graphloom.llm.text import bounded_batches, id_and_text, rows_of
from graphloom.session import cut

#: Pieces that one group holds about; it bounds a task's memory and keeps best fit near its bound.
GROUP = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """The ids of the tokenizers library.

    Its merges stand in the order of the ids, so the rank merging of tiktoken, which is several times faster for
    single pieces, gives the same ids; that order is checked here. Texts with the string of a special token, which
    the library cuts out first, and vocabularies in another order go through the library itself.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf8") as f:
            model = json.load(f)["model"]
        byte = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.by_rank = [model["vocab"][a + b] for a, b in pairs] == list(range(256, 256 + len(pairs)))
        fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = Pieces(pattern, lambda p: array("I", fast.encode_ordinary(p)).tobytes(), 600_000)

    def encode(self, text: str) -> bytes:
        if not self.by_rank or any([s in text for s in self.special]):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self.pieces.encode(text)


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write bytes as letters: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


_encoders: dict[tuple[str, str], WordEncoder] = {}


def encoder(path: str, pattern: str) -> WordEncoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = WordEncoder(path, pattern)
    return _encoders[path, pattern]


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of one document's ids, which hold its end id already."""
    n = len(ids) // 4
    start, length = 0, n % capacity or capacity
    piece = 0
    while start < n:
        yield piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        piece, start, length = piece + 1, start + length, capacity


def document_pieces(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int, end_id: int) -> DataFrame:
    bounded_batches(docs)
    end = end_id.to_bytes(4, "little")
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(tokenizer_path, pattern)
        for batch in batches:
            ids, texts = rows_of(batch)
            rows = [(doc, *p) for doc, text in zip(ids, texts, strict=True) for p in pieces_of(enc.encode(text) + end, capacity)]
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return id_and_text(docs).mapInArrow(run, PIECES)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, and the room left in each bin. A bit set tells which rooms exist."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, left = 0, []
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left[b] = room - size
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins, offsets, np.array(left, np.int64)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The best bound of two families of dual feasible functions. ``counts[s]``: how many pieces have size s.

    ``cut``: sizes above capacity - e count as full, those below e as nothing. ``step``: a size counts as the
    number of whole (k+1)-ths of the capacity that it passes, by the k-th of a sequence; exact multiples keep their share.
    """
    size = np.arange(capacity + 1, dtype=np.int64)
    total = int((counts * size).sum())
    best = -(-total // capacity)
    amount = counts * size
    many, volume = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(amount)])
    for e in range(1, capacity // 2 + 1):
        full = int(many[-1] - many[capacity - e + 1])
        middle = int(volume[capacity - e + 1] - volume[e])
        best = max(best, full + -(-middle // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * size
        share = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * share).sum()) // (k * capacity)))
    return best


PACKED = PIECES + ", sequence_id long, offset long, open boolean"


def pack_groups(pieces: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """Packs each group; ``open`` marks what the next exchange may move."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "uid"], ascending=[False, True, True, True], kind="stable")
        sizes = pdf["length"].to_numpy()
        bins, offsets, left = best_fit_decreasing(sizes, capacity)
        certified = len(left) == lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        movable = np.zeros(len(left), bool)
        if len(left):
            movable = np.arange(len(left)) == int(left.argmax()) if certified else left > 0
            movable &= left > 0
        group = int(pdf["group"].iloc[0])
        out = pdf[[x.split()[0] for x in PIECES.split(", ")]].copy()
        out["sequence_id"] = ((turn << 40 | group) << 20) + bins
        out["offset"] = offsets
        out["open"] = movable[bins]
        out["uid"] = pdf["uid"]
        return out

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(pack, PACKED + ", uid long")


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset. Full pieces have negative sequence numbers."""
    made = document_pieces(docs, tokenizer_path, pattern, capacity, end_id)
    pieces = cut(made.withColumn("uid", F.monotonically_increasing_id()))
    done = [pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})]
    rest = pieces.filter(F.col("length") < capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in rest.groupBy("length").count().collect():
        counts[size] = n
    bound, n, closed, before, turn = lower_bound(counts, capacity), int(counts.sum()), 0, None, 0
    while n:
        groups = -(-n // GROUP)
        packed = cut(pack_groups(rest, groups, turn, capacity))
        made_of = {r["open"]: r for r in packed.groupBy("open").agg(F.count_distinct("sequence_id").alias("bins"), F.count("*").alias("n")).collect()}
        total = closed + sum(r["bins"] for r in made_of.values())
        if groups == 1 or True not in made_of or total <= bound or (before is not None and total >= before):
            done.append(packed)
            break
        done.append(packed.filter(~F.col("open")))
        closed += made_of[False]["bins"] if False in made_of else 0
        rest, n, before, turn = packed.filter("open").select(*pieces.columns), made_of[True]["n"], total, turn + 1
    columns = [x.split()[0] for x in PIECES.split(", ")] + ["sequence_id", "offset"]
    out = done[0].select(*columns)
    for part in done[1:]:
        out = out.unionByName(part.select(*columns))
    return out
