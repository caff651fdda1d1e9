"""Substring dedup by prefix-partitioned suffix trees over words.

Every window of ``length`` words is the head of one suffix. Equal heads must meet, so suffixes are routed by the
smallest hash of a word triple in their head; neighbouring suffixes mostly share it and travel as one stretch of text.
Stretches that are equal within a batch are resolved before the shuffle: only the smallest document's goes on, so what
one passage sends grows with the number of batches, not of documents. In a task, suffixes are split by prefixes, longer
ones where a prefix holds too many, until a group fits in memory; each group's tree is walked level by level and leaves
that are alone are dropped. Prefixes so are as long as memory asks, one word or up to ``length``. Nodes ``length`` words deep that still have several leaves are the repeats: a leaf is
covered if its node holds a smaller document.

Defined results: null, empty and short texts (below one window) keep all words; repeats within one document, and
within rows of one doc_id, do not count; rows are told apart by doc_id and text, so repeated rows get equal results;
rows without a doc_id keep all words and remove nothing elsewhere; the smallest id keeps its words.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import bounded_batches, fresh, give_back, words_of

LENGTH, TRIPLE = 13, 3
#: Bytes of text that feed one group of suffixes, suffixes in one tree, bytes of text in one batch of the map side.
GROUP_BYTES, TREE, BATCH_TEXT = 15 << 20, 1 << 16, 10 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(h: np.ndarray, length: int) -> np.ndarray:
    """Smallest triple hash of every window of one document."""
    with np.errstate(over="ignore"):
        g = mixed(h[:-2] + MIX * h[1:-1] + (MIX * MIX) * h[2:])
    out = g[: len(h) - length + 1].copy()
    for k in range(1, length - TRIPLE + 1):
        np.minimum(out, g[k : k + len(out)], out=out)
    return out


def add_stretches(found: dict[bytes, list], doc: int, key: int, words: list[bytes], length: int) -> None:
    """Adds one document to a batch: stretch text -> [anchor, occurrences (doc, row key, first word, end)]."""
    n = len(words)
    if n < length:
        return
    a = anchors(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n), length)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)])
    firsts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
    ends = np.concatenate([firsts[1:], [len(a)]]) + length - 1
    whole = b" ".join(words)
    for first, end, b, e, anchor in zip(firsts.tolist(), ends.tolist(), at[firsts].tolist(), (at[ends] - 1).tolist(), a[firsts].tolist()):
        text = whole[b:e]
        entry = found.get(text)
        if entry is None:
            found[text] = [anchor, [(doc, key, first, end)]]
        else:
            entry[1].append((doc, key, first, end))


SENT = "part int, payload binary"


def sent_rows(found: dict[bytes, list], parts: int) -> dict[int, bytes]:
    """For each part of a batch's stretches, which are used up: stretches (doc, row key, first word, anchor tag, text) to compare, and spans that the batch settles itself."""
    by_part: dict[int, tuple[list, list, list, list, list, list]] = {}
    for text, (anchor, places) in found.items():
        ids, keys, firsts, tags, texts, settled = by_part.setdefault(anchor % parts, ([], [], [], [], [], []))
        least = places[0][0] if len(places) == 1 else min(places)[0]
        for doc, key, first, end in places:
            if doc > least:
                settled.append((doc, key, first, end))
            else:
                ids.append(doc)
                keys.append(key)
                firsts.append(first)
                tags.append(anchor // parts & 0xFFFFFF)
                texts.append(text)
    found.clear()
    pack = zstandard.ZstdCompressor(level=3).compress
    out = {}
    for p in list(by_part):
        i, k, f, g, t, s = by_part.pop(p)
        ids = np.diff(np.array(i, np.int64), prepend=0)  # they mostly rise within a batch, so their steps pack well
        tags = np.array(g, "<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        out[p] = pack(pickle.dumps((ids, np.array(k, np.uint32), np.array(f, np.int32), tags, b"\n".join(t), s), protocol=5))
    return out


def tree_groups(ids: np.ndarray, heads: np.ndarray, depth: int, length: int) -> Iterator[tuple[np.ndarray, int]]:
    """Suffixes split by prefixes until a group fits: (suffixes, words that they are known to share or be split by)."""
    if len(heads) <= TREE or depth == length:
        yield heads, depth
        return
    word = ids[heads + depth]
    order = np.argsort(word, kind="stable")
    heads, word = heads[order], word[order]
    cuts = [0, *(np.flatnonzero(word[1:] != word[:-1]) + 1).tolist(), len(heads)]
    first = 0
    for at, end in zip(cuts, cuts[1:]):
        if end - at > TREE:
            if at > first:
                yield heads[first:at], depth
            yield from tree_groups(ids, heads[at:end], depth + 1, length)
            first = end
        elif end - first > TREE:
            yield heads[first:at], depth
            first = at
    if first < len(heads):
        yield heads[first:], depth


def repeats(ids: np.ndarray, heads: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffixes, node number) of all nodes ``length`` words deep with two leaves or more, group by group."""
    wide = int(ids.max()) + 1 if len(ids) else 1
    for group, depth in tree_groups(ids, heads, 0, length):
        node, nodes = np.zeros(len(group), np.int64), 1
        while depth < length and len(group):
            # An edge of the tree holds as many words as fit into one number.
            edge, span = node, nodes
            while depth < length and span <= (1 << 62) // wide:
                edge, span, depth = edge * wide + ids[group + depth], span * wide, depth + 1
            _, node, leaves = np.unique(edge, return_inverse=True, return_counts=True)
            many = leaves[node] > 1
            group, node, nodes = group[many], node[many], len(leaves)
        if len(group):
            yield group, np.unique(node, return_inverse=True)[1]


def covered(payloads: list[bytes], length: int) -> list[tuple[int, int, int, int]]:
    """(doc, row key, first word, end) spans to remove, of one part."""
    out, docs, keys, firsts, sizes, flat = [], [], [], [], [], []
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    unpack = zstandard.ZstdDecompressor().decompress
    held = []
    for payload in payloads:
        *rows, settled = pickle.loads(unpack(payload))
        out += settled
        if len(rows[0]):
            held.append(rows)
    if not held:
        return out
    # Windows that are equal have equal anchors, so a stretch alone with its anchor holds no repeat.
    tags = np.concatenate([np.frombuffer(rows[3], np.uint8).reshape(-1, 3) for rows in held]).astype(np.int64) @ np.array([1, 1 << 8, 1 << 16])
    _, group, times = np.unique(tags, return_inverse=True, return_counts=True)
    shared = times[group] > 1
    at = 0
    for i, k, f, _, t in held:
        keep = np.flatnonzero(shared[at : at + len(i)])
        at += len(i)
        if not len(keep):
            continue
        lines = t.split(b"\n")
        t = b"\n".join([lines[j] for j in keep.tolist()])
        docs.append(np.cumsum(i)[keep])
        keys.append(k[keep].astype(np.int64))
        firsts.append(f[keep])
        chars = np.frombuffer(t, np.uint8)
        breaks = chars[(chars == 10) | (chars == 32)] == 10  # one a gap between words: does a stretch end there
        sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(breaks), [len(breaks)]])))
        flat.append(np.fromiter(map(number.__getitem__, t.split()), np.int32, len(breaks) + 1))
    del held
    if not docs:
        return out
    doc, key, first = np.concatenate(docs), np.concatenate(keys), np.concatenate(firsts).astype(np.int64)
    del number
    ids, size = np.concatenate(flat).astype(np.int64), np.concatenate(sizes)
    del flat
    start = np.cumsum(size) - size
    windows = size - length + 1
    owner = np.repeat(np.arange(len(size)), windows)
    heads = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    owner_of = np.zeros(len(ids), np.int64)
    owner_of[heads] = owner
    for group, node in repeats(ids, heads, length):
        own = owner_of[group]
        least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, doc[own])
        hit = doc[own] > least[node]
        own, at = own[hit], first[own[hit]] + group[hit] - start[own[hit]]
        if len(own):
            order = np.lexsort((at, key[own], doc[own]))
            own, at = own[order], at[order]
            new = np.concatenate([[True], (doc[own][1:] != doc[own][:-1]) | (key[own][1:] != key[own][:-1]) | (at[1:] > at[:-1] + 1)])
            begin = np.flatnonzero(new)
            end = np.concatenate([begin[1:], [len(own)]]) - 1
            out += zip(doc[own][begin].tolist(), key[own][begin].tolist(), at[begin].tolist(), (at[end] + length).tolist(), strict=True)
    return out


def _row_key(text: Column) -> Column:
    """Tells rows of one doc_id apart; 32 bits, as every stretch carries it."""
    return F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), _row_key(text).alias("row_key"))


def repeat_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, row_key, spans (array of first word and end) of what smaller documents hold already."""
    bounded_batches(docs)
    # Counted on the texts themselves, as files tell little of texts that pack well.
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(1, -(-size // GROUP_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def flush():
            rows = sent_rows(held, parts)
            return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array(list(rows.values()), pa.binary())], names=["part", "payload"])

        for batch in batches:
            for doc, text, key in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if doc is not None:
                    add_stretches(held, doc, key, words_of(text), length)
                    size += len(text)
                    if size >= BATCH_TEXT:
                        yield flush()
                        size = 0
        if held:
            yield flush()
        give_back()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        spans = covered(list(pdf["payload"]), length)
        give_back()
        return pd.DataFrame(spans, columns=["doc_id", "row_key", "s", "e"])

    sent = keyed(docs).mapInArrow(send, SENT)
    met = sent.groupBy("part").applyInPandas(meet, "doc_id long, row_key long, s int, e int")
    return met.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def kept_words(words: list[bytes], spans) -> list[bytes]:
    if spans is None or not len(spans):
        return words
    gone = np.zeros(len(words), bool)
    for x in spans:
        gone[x["s"] : x["e"]] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _joined(docs: DataFrame, length: int) -> DataFrame:
    spans = repeat_spans(docs, length).withColumnsRenamed({"doc_id": "__id", "row_key": "__key"})
    source = keyed(docs)
    return source.join(spans, (source["doc_id"] == spans["__id"]) & (source["row_key"] == spans["__key"]), "left").select("doc_id", "text", "spans")


def substring_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans = [c.to_pylist() for c in batch.columns]
            n, removed, digest = [], [], []
            for text, sp in zip(texts, spans, strict=True):
                words = words_of(text)
                kept = kept_words(words, sp)
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _joined(docs, length).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated stretches taken out of ``text``; a text that loses nothing stays as it is."""
    key_id, key, held, row = fresh(docs, "spans_id", "spans_key", "spans", "row_key")
    spans = repeat_spans(docs, length).select(F.col("doc_id").alias(key_id), F.col("row_key").alias(key), F.col("spans").alias(held))
    marked = docs.withColumn(row, _row_key(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = marked.join(spans, (F.col("doc_id") == F.col(key_id)) & (F.col(row) == F.col(key)), "left")

    @F.pandas_udf("string")
    def strip(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or sp is None or not len(sp) else b" ".join(kept_words(words_of(t), sp)).decode() for t, sp in zip(text, spans, strict=True)])

    clean = F.when(F.col(held).isNull(), F.col("text")).otherwise(strip("text", held))
    return joined.select(*[clean.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
