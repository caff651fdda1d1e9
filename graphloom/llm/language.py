"""Language ID: a bidirectional gated recurrent network over bytes that labels every position.

A text's bytes are cut into segments; both directions run over each segment and every byte gets probabilities. A
document's probabilities are the mean over all its bytes. Trained in numpy by backpropagation through time on a
bounded sample (``DOCS_A_LANGUAGE`` documents of each language, chosen by a hash of their ids).

Defined results: a null text, and one without a letter, is ``und`` with score 0; without any training document every
text is ``und``; ties go to the language that sorts first; every byte of a long text counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.gru import GRU, Adam, scatter
from graphloom.llm.text import map_texts

HIDDEN, SEGMENT, RUN = 8, 128, 4096
#: Bounds of the training sample and of its use.
DOCS_A_LANGUAGE, SEGMENTS_A_DOC, EPOCHS, BATCH = 300, 3, 5, 256


class ByteTagger:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.f, self.b = GRU(HIDDEN, rng), GRU(HIDDEN, rng)
        table = lambda: (rng.standard_normal((256, 3 * HIDDEN)) * 0.3).astype(np.float32)
        self.xf, self.xb = table(), table()
        self.wf = (rng.standard_normal((HIDDEN, len(labels))) * 0.3).astype(np.float32)
        self.wb = (rng.standard_normal((HIDDEN, len(labels))) * 0.3).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def params(self) -> dict[str, np.ndarray]:
        return {"uf": self.f.u, "ub": self.b.u, "xf": self.xf, "xb": self.xb, "wf": self.wf, "wb": self.wb, "bias": self.bias}

    def probabilities(self, seg: np.ndarray, keep: bool = False):
        """seg (T, N) bytes -> (T, N, labels)."""
        hf, cf = self.f.run(self.xf[seg], keep)
        hb, cb = self.b.run(self.xb[seg[::-1]], keep)
        logits = hf @ self.wf + hb[::-1] @ self.wb + self.bias
        p = np.exp(logits - logits.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        return p, (hf, hb, cf, cb)

    def train(self, segments: np.ndarray, target: np.ndarray, seed: int = 11) -> None:
        """segments (M, T), target (M,): every position of a segment has its document's label."""
        rng, adam = np.random.default_rng(seed), Adam(self.params(), 0.02)
        for _ in range(EPOCHS):
            order = rng.permutation(len(segments))
            for first in range(0, len(order), BATCH):
                pick = order[first : first + BATCH]
                seg = np.ascontiguousarray(segments[pick].T)
                p, (hf, hb, cf, cb) = self.probabilities(seg, keep=True)
                d = p
                d[:, np.arange(len(pick)), target[pick]] -= 1
                d /= seg.size
                flat = d.reshape(-1, d.shape[-1])
                dxf, duf = self.f.back(d @ self.wf.T, cf)
                dxb, dub = self.b.back((d @ self.wb.T)[::-1], cb)
                grads = {"uf": duf, "ub": dub, "wf": hf.reshape(-1, HIDDEN).T @ flat, "wb": hb[::-1].reshape(-1, HIDDEN).T @ flat, "bias": flat.sum(0)}
                grads["xf"] = scatter(seg.ravel(), dxf.reshape(-1, 3 * HIDDEN), 256)
                grads["xb"] = scatter(seg[::-1].ravel(), dxb.reshape(-1, 3 * HIDDEN), 256)
                adam.update(grads)

    def document_sums(self, texts: list[bytes]) -> np.ndarray:
        """Sum of the probabilities of all bytes of each text."""
        out = np.zeros((len(texts), len(self.labels)))
        owner, full = [], []
        for i, t in enumerate(texts):
            data = np.frombuffer(t, np.uint8)
            n = len(data) // SEGMENT
            if n:
                full.append(data[: n * SEGMENT].reshape(n, SEGMENT))
                owner.append(np.full(n, i))
        if full:
            segs, own = np.concatenate(full), np.concatenate(owner)
            for first in range(0, len(segs), RUN):
                p, _ = self.probabilities(np.ascontiguousarray(segs[first : first + RUN].T))
                np.add.at(out, own[first : first + RUN], p.sum(0))
        # Tails, by their length rounded up to eighths of a segment; what is filled up is run before both ends and not counted.
        groups: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            if tail := len(t) % SEGMENT:
                groups.setdefault(-(-tail // 16) * 16, []).append(i)
        for size, members in sorted(groups.items()):
            seg, mask = np.full((len(members), size), 0x20, np.uint8), np.zeros((len(members), size), np.float32)
            for k, i in enumerate(members):
                tail = texts[i][len(texts[i]) // SEGMENT * SEGMENT :]
                seg[k, : len(tail)] = np.frombuffer(tail, np.uint8)
                mask[k, : len(tail)] = 1
            for first in range(0, len(members), RUN):
                p, _ = self.probabilities(np.ascontiguousarray(seg[first : first + RUN].T))
                out[members[first : first + RUN]] += (p * mask[first : first + RUN].T[:, :, None]).sum(0)
        return out


def remainder(doc_id: Column, divisor: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def training_sample(docs: DataFrame, label: str, per_label: int) -> tuple[list[tuple], dict]:
    """(doc_id, text, label) of at most 2 * per_label rows a label, about per_label of them, spread by a hash of the id; and the labels' counts."""
    counts = {r[0]: r[1] for r in docs.groupBy(label).count().collect()}
    picked = None
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        share = min(1.0, per_label / n)
        part = docs.filter((F.col(label) == value) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).limit(2 * per_label)
        picked = part if picked is None else picked.unionByName(part)
    return ([] if picked is None else sorted(tuple(r) for r in picked.select("doc_id", "text", label).collect())), counts


def train_language_model(docs: DataFrame, train: Column) -> ByteTagger | None:
    """``train`` tells which rows may be learned from."""
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"), train.alias("t"))
    known = known.filter(F.col("t") & F.col("lang").isNotNull() & (F.length("text") > 0))
    rows, _ = training_sample(known, "lang", DOCS_A_LANGUAGE)
    labels = sorted({r[2] for r in rows})
    if not labels:
        return None
    rng = np.random.default_rng(3)
    segments, target = [], []
    for _, text, lang in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) < SEGMENT:
            data = np.resize(data, SEGMENT)
        for _ in range(SEGMENTS_A_DOC):
            at = rng.integers(0, len(data) - SEGMENT + 1)
            segments.append(data[at : at + SEGMENT])
            target.append(labels.index(lang))
    model = ByteTagger(labels)
    if len(labels) > 1:
        model.train(np.stack(segments), np.array(target))
    return model


def predict_languages(docs: DataFrame, model: ByteTagger | None) -> DataFrame:
    """doc_id, lang_pred, score; narrow, no shuffle."""

    def rows(ids: list, texts: list[str]) -> dict[str, list]:
        out = {"doc_id": ids, "lang_pred": ["und"] * len(ids), "score": [0.0] * len(ids)}
        real = [i for i, t in enumerate(texts) if model is not None and any(map(str.isalpha, t))]
        if real:
            sums = model.document_sums([texts[i].encode() for i in real])
            p = sums / sums.sum(1, keepdims=True)
            for i, row in zip(real, p, strict=True):
                out["lang_pred"][i] = model.labels[int(row.argmax())]
                out["score"][i] = float(row.max())
        return out

    return map_texts(docs, rows, "doc_id long, lang_pred string, score double")
