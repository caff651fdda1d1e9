"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is four vectors side by side: its word vector (by a hash of the lower-cased word) and the means of its
character n-grams' vectors, those of ``GRAMS`` bytes that begin the word, those that end it, and all its trigrams.
The network runs over windows of ``WINDOW`` words that overlap by half; attention weighs a window's positions, and a
document's score is that of its most toxic window. All windows of a text are scored.

Trained in numpy by backpropagation through time, vectors included, on a bounded sample of labelled documents: about
``DOCS_A_LABEL`` of each label, ``SAMPLE_BYTES`` of text. Word and n-gram vectors start from log-odds of the sample in
their first coordinate and from zero elsewhere, so that what was never met says nothing. Every document of the sample
teaches, a toxic one by its window that looks most toxic so far, a clean one by its most toxic looking and by a random
window. With ``LEAST_TO_HOLD`` documents or more, the decision point is set on a fifth of them that is held from
training; with fewer, on those trained on.

Defined results: null and empty texts have one empty window and get its score; without labelled rows of both
labels every score is 0; ties do not arise, as rows are scored one by one; equal texts get equal scores; labelled rows
that repeat count once, by their greatest label.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.gru import GRU, Adam, RowAdam, scatter, sigmoid
from graphloom.llm.language import remainder, training_sample
from graphloom.llm.text import Memo, bounded_batches, give_back, id_and_text, map_texts, rows_of, words_of

HIDDEN, WINDOW, STRIDE, RUN = 8, 32, 16, 4096
WORD_ROWS, CHAR_ROWS, WIDTH = 1 << 15, 1 << 16, 8
#: Bytes of the n-grams that begin or end a word; inputs of a word: its vector, beginnings, endings, trigrams.
GRAMS, PARTS = range(3, 9), 4
#: Bounds of the training sample and of its use.
DOCS_A_LABEL, SAMPLE_BYTES, LEAST_TO_HOLD, ROUNDS, EPOCHS, BATCH = 1200, 24 << 20, 200, 3, 6, 128
#: Words that a scoring model remembers, and words whose inputs are made at once.
REMEMBERED, AT_ONCE = 100_000, 1 << 13
_EDGES = b".,;:!?%*#$&|\"'()[]{}<>-_"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Rows of the vectors of words: ``word`` (N,), ``begin`` and ``end`` (N, len(GRAMS)) with ``CHAR_ROWS`` for none, and
    the trigrams of word i in ``inner[ptr[i]:ptr[i + 1]]``."""

    def __init__(self, word: np.ndarray, begin: np.ndarray, end: np.ndarray, inner: np.ndarray, ptr: np.ndarray):
        self.word, self.begin, self.end, self.inner, self.ptr = word, begin, end, inner, ptr

    @classmethod
    def of(cls, words: list[bytes]) -> Features:
        cores = [w.strip(_EDGES) or w for w in words]
        size = np.array([len(c) for c in cores], np.int64)
        data = np.frombuffer(b"".join([b"^" + c + b"$" for c in cores]), np.uint8).astype(np.uint64)
        stop = np.cumsum(size + 2)
        start = stop - size - 2
        begin, end = (np.full((len(cores), len(GRAMS)), CHAR_ROWS) for _ in range(2))
        left, right = np.full(len(cores), 17, np.uint64), np.full(len(cores), 31, np.uint64)
        for k in range(1, GRAMS[-1] + 1):
            has = size >= k
            left[has] = (left[has] * _FACTOR) ^ data[start[has] + k]
            right[has] = (right[has] * _FACTOR) ^ data[stop[has] - 1 - k]
            if k in GRAMS:
                begin[has, k - GRAMS[0]], end[has, k - GRAMS[0]] = _slot(left[has]), _slot(right[has])
        # Every word has as many trigrams as bytes, the two edge marks counted, so those that cross a word's end are left out.
        ptr = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ptr[-1]) + np.repeat(start - ptr[:-1], size)
        inner = _slot((data[at] * _FACTOR ^ data[at + 1]) * _FACTOR ^ data[at + 2])
        return cls(np.array([zlib.crc32(c) % WORD_ROWS for c in cores], np.int64), begin, end, inner, ptr)

    def take(self, index: np.ndarray) -> Features:
        count = self.ptr[index + 1] - self.ptr[index]
        ptr = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(ptr[-1]) + np.repeat(self.ptr[index] - ptr[:-1], count)
        return Features(self.word[index], self.begin[index], self.end[index], self.inner[at], ptr)


def _slot(hashed: np.ndarray) -> np.ndarray:
    return ((hashed * _FACTOR) >> np.uint64(33)).astype(np.int64) % CHAR_ROWS


class ToxicModel:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.f, self.b = GRU(HIDDEN, rng), GRU(HIDDEN, rng)
        self.word = np.zeros((WORD_ROWS, WIDTH), np.float32)
        self.char = np.zeros((CHAR_ROWS + 1, WIDTH), np.float32)  # the last row stays zero
        self.xf, self.xb = n(PARTS * WIDTH, 3 * HIDDEN) * 3, n(PARTS * WIDTH, 3 * HIDDEN) * 3
        self.bf, self.bb = np.zeros(3 * HIDDEN, np.float32), np.zeros(3 * HIDDEN, np.float32)
        self.attend, self.out, self.bias = n(2 * HIDDEN), n(2 * HIDDEN) * 3, np.zeros(1, np.float32)
        self.shift = 0.0
        self._reset()

    def _reset(self) -> None:
        self.rows: Memo = Memo(self._row, 1 << 62)
        self.gates: tuple[np.ndarray, np.ndarray] | None = None
        self.filled = 0
        self.new: list[bytes] = []

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "gates", "filled", "new")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def _row(self, word: bytes) -> int:
        self.new.append(word)
        return len(self.rows) + 1

    def _input(self, f: Features) -> np.ndarray:
        means = [self.char[rows].sum(1) / np.maximum(1, (rows < CHAR_ROWS).sum(1))[:, None] for rows in (f.begin, f.end)]
        inner = np.add.reduceat(self.char[f.inner], f.ptr[:-1], axis=0) / np.diff(f.ptr)[:, None]
        return np.concatenate([self.word[f.word], *means, inner], 1).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Gate inputs of all words met; row 0 stands for no word. Rows are added as words are met, in room that doubles."""
        if self.gates is None:
            self.gates, self.filled = tuple(np.repeat(b[None], 1024, 0) for b in (self.bf, self.bb)), 1
        while self.new:
            part, self.new = self.new[:AT_ONCE], self.new[AT_ONCE:]
            end = self.filled + len(part)
            if end > len(self.gates[0]):
                self.gates = tuple(np.concatenate([g, np.empty((max(len(g), end - len(g)), g.shape[1]), np.float32)]) for g in self.gates)
            x = self._input(Features.of(part))
            self.gates[0][self.filled : end] = x @ self.xf + self.bf
            self.gates[1][self.filled : end] = x @ self.xb + self.bb
            self.filled = end
        return self.gates

    def windows(self, text: str) -> np.ndarray:
        """Word rows of all windows (count, WINDOW) of a text; the last is filled with 0."""
        rows = np.array(list(map(self.rows.__getitem__, words_of(text.lower()))), np.int32)
        count = 1 if len(rows) <= WINDOW else 1 - (WINDOW - len(rows)) // STRIDE
        padded = np.zeros((count - 1) * STRIDE + WINDOW, np.int32)
        padded[: len(rows)] = rows
        return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]

    def forward(self, win: np.ndarray, keep: bool = False, gates: tuple | None = None):
        """Logits of windows (N, WINDOW) of rows of ``gates``, those of all words met unless given."""
        gf, gb = gates or self.tables()
        idx = np.ascontiguousarray(win.T)
        hf, cf = self.f.run(gf[idx], keep)
        hb, cb = self.b.run(gb[idx[::-1]], keep)
        h = np.concatenate([hf, hb[::-1]], 2)
        a = np.exp(np.clip(h @ self.attend, -30, 30))
        a /= a.sum(0)
        pooled = (a[:, :, None] * h).sum(0)
        return pooled @ self.out + self.bias, (idx, h, a, pooled, cf, cb)

    def best(self, wins: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows, one text's after the other's, and where each text's begin."""
        flat = np.concatenate(wins)
        scores = np.concatenate([self.forward(flat[i : i + RUN])[0] for i in range(0, len(flat), RUN)])
        return scores, np.cumsum([0, *[len(w) for w in wins[:-1]]])

    def logits(self, texts: list[str]) -> np.ndarray:
        if len(self.rows) > REMEMBERED:
            self._reset()
        return np.maximum.reduceat(*self.best([self.windows(t) for t in texts]))

    def score(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.logits(texts).astype(np.float64) - self.shift)

    def params(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in ("xf", "xb", "bf", "bb", "attend", "out", "bias")} | {"uf": self.f.u, "ub": self.b.u}

    def start_from_odds(self, wins: list[np.ndarray], toxic: np.ndarray, feats: Features) -> np.ndarray:
        """First coordinate of word and n-gram vectors: smoothed log-odds of a document that holds them. Gives for each
        word how toxic it looks so far: the highest of its odds above one."""
        seen = np.zeros((2, WORD_ROWS)), np.zeros((2, CHAR_ROWS + 1))
        for w, y in zip(wins, toxic.astype(int), strict=True):
            rows = np.unique(w)
            f = feats.take(rows[rows > 0] - 1)
            seen[0][y, np.unique(f.word)] += 1
            seen[1][y, np.unique(np.concatenate([f.begin.ravel(), f.end.ravel(), f.inner]))] += 1
        n = np.bincount(toxic.astype(int), minlength=2)
        for table, (clean, bad) in ((self.word, seen[0]), (self.char, seen[1])):
            odds = np.log((bad + 0.5) / (n[1] + 1)) - np.log((clean + 0.5) / (n[0] + 1))
            table[:, 0] = np.clip(odds * (clean + bad) / (clean + bad + 8), -2, 4)  # rare ones tell little
        self.char[CHAR_ROWS] = 0
        top = np.maximum(self.word[feats.word, 0], np.maximum(self.char[feats.begin, 0].max(1), self.char[feats.end, 0].max(1)))
        return np.concatenate([[0], np.maximum(0, top - 1)])

    def fit(self, texts: list[str], toxic: np.ndarray, seed: int = 13) -> None:
        rng = np.random.default_rng(seed)
        wins = [self.windows(t) for t in texts]
        feats = Features.of(list(self.rows)) if self.rows else Features.of([b"-"])
        odds = self.start_from_odds(wins, toxic, feats)
        adam, tables = Adam(self.params(), 0.01), (RowAdam(self.word, 0.01), RowAdam(self.char, 0.01))
        for turn in range(ROUNDS):
            if turn:
                self._refresh(feats)
                scores, starts = self.best(wins)
                best = [w[int(s.argmax())] for w, s in zip(wins, np.split(scores, starts[1:]), strict=True)]
            else:
                best = [w[int(odds[w].sum(1).argmax())] for w in wins]
            other = [w[rng.integers(len(w))] for w, y in zip(wins, toxic, strict=True) if not y]
            data = np.stack([*best, *other])
            label = np.concatenate([toxic, np.zeros(len(other))]).astype(np.float32)
            for _ in range(EPOCHS):
                order = rng.permutation(len(data))
                for first in range(0, len(order), BATCH):
                    self._learn(data[order[first : first + BATCH]], label[order[first : first + BATCH]], feats, adam, tables)
        self._reset()

    def _refresh(self, feats: Features) -> None:
        """Gate inputs of all words of the sample by the vectors as they are now."""
        self.gates, self.filled, self.new = None, 0, []
        count, parts = len(feats.word), []
        for first in range(0, count, AT_ONCE):
            parts.append(self._input(feats.take(np.arange(first, min(count, first + AT_ONCE)))))
        inputs = np.concatenate([np.zeros((1, PARTS * WIDTH), np.float32), *parts])
        self.gates, self.filled = (inputs @ self.xf + self.bf, inputs @ self.xb + self.bb), len(inputs)

    def _learn(self, win: np.ndarray, label: np.ndarray, feats: Features, adam: Adam, tables: tuple[RowAdam, RowAdam]) -> None:
        used, place = np.unique(np.append(win, 0), return_inverse=True)  # row 0, no word, is always among them
        place = place[:-1]
        f = feats.take(used[1:] - 1)
        inputs = np.concatenate([np.zeros((1, PARTS * WIDTH), np.float32), *([self._input(f)] if len(used) > 1 else [])])
        gates = inputs @ self.xf + self.bf, inputs @ self.xb + self.bb
        logit, (idx, h, a, pooled, cf, cb) = self.forward(place.reshape(win.shape), True, gates)
        d = ((sigmoid(logit) - label) / len(win)).astype(np.float32)
        grads = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        dp = d[:, None] * self.out
        dh = a[:, :, None] * dp
        da = (h * dp).sum(2)
        ds = a * (da - (a * da).sum(0))
        grads["attend"] = np.einsum("tn,tnh->h", ds, h)
        dh = dh + ds[:, :, None] * self.attend
        dxf, grads["uf"] = self.f.back(np.ascontiguousarray(dh[:, :, :HIDDEN]), cf)
        dxb, grads["ub"] = self.b.back(np.ascontiguousarray(dh[::-1, :, HIDDEN:]), cb)
        dxb = dxb[::-1]
        flat = idx.ravel()
        dxf, dxb = scatter(flat, dxf.reshape(-1, 3 * HIDDEN), len(used)), scatter(flat, dxb.reshape(-1, 3 * HIDDEN), len(used))
        grads["xf"], grads["xb"], grads["bf"], grads["bb"] = inputs.T @ dxf, inputs.T @ dxb, dxf.sum(0), dxb.sum(0)
        if len(used) > 1:
            dx = (dxf @ self.xf.T + dxb @ self.xb.T)[1:]
            rows, at = np.unique(f.word, return_inverse=True)
            tables[0].update(rows, scatter(at, dx[:, :WIDTH], len(rows)))
            flat_rows, shares = [f.inner], [np.repeat(dx[:, 3 * WIDTH :] / np.diff(f.ptr)[:, None], np.diff(f.ptr), axis=0)]
            for part, held in ((1, f.begin), (2, f.end)):
                has = held < CHAR_ROWS
                count = has.sum(1)
                flat_rows.append(held[has])
                shares.append(np.repeat(dx[:, part * WIDTH : (part + 1) * WIDTH] / np.maximum(1, count)[:, None], count, axis=0))
            rows, at = np.unique(np.concatenate(flat_rows), return_inverse=True)
            tables[1].update(rows, scatter(at, np.concatenate(shares), len(rows)))
        adam.update(grads)

    def decide(self, logits: np.ndarray, toxic: np.ndarray, clean_for_toxic: float) -> None:
        """The decision point with the fewest errors where so many clean documents come with one toxic one."""
        order = np.argsort(logits)
        y = toxic[order]
        weight = (~toxic).sum() / max(1, toxic.sum()) / clean_for_toxic
        missed = np.concatenate([[0], np.cumsum(y) * weight])
        raised = np.concatenate([[0], np.cumsum(~y)])
        cost = missed + raised[-1] - raised
        at = int(np.flatnonzero(cost == cost.min()).mean())
        edges = np.concatenate([[logits[order[0]] - 1], logits[order], [logits[order[-1]] + 1]])
        self.shift = float((edges[at] + edges[at + 1]) / 2)


def train_toxicity_model(docs: DataFrame, labels: DataFrame, train: Column) -> ToxicModel | None:
    """``labels``: doc_id and toxic. ``train`` tells which documents may be learned from. The sample's ids are bounded, so they are broadcast.

    One task reads the sample's texts and trains; the driver, whose memory does not grow with machines, holds the ids and the model.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("text", F.lit("")).filter(remainder(F.col("doc_id"), 5) != 0)
    picked, shares = training_sample(known, "toxic", DOCS_A_LABEL)
    if len({y for _, _, y in picked}) < 2:
        return None
    label = dict((i, int(y == 1)) for i, _, y in picked)
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(label)], "sample_id long")
    found = docs.filter(train).join(F.broadcast(ids), docs["doc_id"] == ids["sample_id"], "left_semi").select("doc_id", "text")
    # The sample has few rows, so one task can order them; their texts are taken until the bound on bytes is met.
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "text").rowsBetween(Window.unboundedPreceding, 0))
    bounded = found.limit(2 * len(label)).withColumn("bytes_so_far", size).filter(F.col("bytes_so_far") <= SAMPLE_BYTES)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*rows_of(batch), strict=True))
        model = trained(rows, label, shares.get(0, 1) / max(1, shares.get(1, 1)))
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model, protocol=5)], pa.binary())], names=["model"])
        del rows, model
        give_back()

    bounded_batches(docs)
    made = id_and_text(bounded).mapInArrow(learn, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else None


def trained(rows: list[tuple[int, str]], label: dict[int, int], clean_for_toxic: float) -> ToxicModel | None:
    """The model of a sample's rows (doc_id, text), in order; none unless both labels occur."""
    toxic = np.array([label[i] for i, _ in rows], float)
    if len(set(toxic)) < 2:
        return None
    model = ToxicModel()
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= LEAST_TO_HOLD else np.zeros(len(rows), bool)
    texts = [t for _, t in rows]
    model.fit([t for t, h in zip(texts, held, strict=True) if not h], toxic[~held])
    tune = held if 0 < toxic[held].sum() < held.sum() else ~held
    model.decide(model.logits([t for t, h in zip(texts, tune, strict=True) if h]), toxic[tune].astype(bool), clean_for_toxic)
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel | None) -> DataFrame:
    """doc_id, score, predicted for every row; narrow, no shuffle."""

    def rows(ids: list, texts: list[str]) -> dict[str, list]:
        score = [0.0] * len(ids) if model is None else model.score(texts).tolist()
        return {"doc_id": ids, "score": score, "predicted": [int(s >= 0.5) for s in score]}

    return map_texts(docs, rows, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicModel | None) -> DataFrame:
    """The rows of ``docs`` that are not called toxic, all columns; narrow, no shuffle."""

    @F.pandas_udf("boolean")
    def fine(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            texts = [t or "" for t in text]
            yield pd.Series(model.score(texts) < 0.5) if texts else pd.Series([], dtype=bool)
        give_back()

    if model is None:
        return docs
    bounded_batches(docs)
    return docs.filter(fine(docs["text"].cast("string")))
