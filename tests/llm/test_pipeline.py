"""Every pipeline stage on odd tables, and the whole run against its stages by brute force."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as C
from graphloom.llm import secrets
from tests.llm.test_operators import BASE, brute_near, brute_repeats

CLASH = "secret_spans string, spans string, row_key string, gone_id string, posted_id string, own_salt string, __id string, part string, `a.b` string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH
VILE = "vile"


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    """documents and labels: toxic ones hold one word; nulls, empty and long texts, copies, repeated rows, clashing names."""
    rng = np.random.default_rng(0)
    base = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    texts = [" ".join(rng.choice(base, 40)) for _ in range(240)]
    bad = [" ".join([*rng.choice(base, 20), VILE, *rng.choice(base, 20)]) for _ in range(80)]
    odd = [None, "", " \t\n", "one two", BASE, BASE, BASE + " tail", "password = Abcdef123456 and " + BASE, "x " * 30_000]
    rows = [(i, t, "en", "s", len(t or ""), *["z"] * 9) for i, t in enumerate(texts + bad + odd)]
    rows += [rows[-5], (None, BASE, None, None, None, *[None] * 9), (None, None, None, None, None, *[None] * 9)]
    path = tmp_path_factory.mktemp("pipe")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i >= 240)) for i in range(320)] + [(5, 0), (None, 1), (6, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def read(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def key(r):
    return tuple((x is not None, x) for x in r)


def test_toxic_documents_go(spark, folder):
    docs = read(spark, folder)
    got = C.drop_toxic(spark, docs, folder)
    assert got.columns == docs.columns
    kept = {r["doc_id"] for r in got.collect()}
    assert len(kept & set(range(240))) >= 235 and len(kept & set(range(240, 320))) <= 5
    none = spark.createDataFrame([], "doc_id long, toxic int")
    from graphloom.llm import toxicity

    assert toxicity.without_toxic(docs, toxicity.train_toxicity_model(docs, none, C.F.lit(True))).count() == docs.count()


def test_one_of_each_group_stays(spark, folder):
    docs = read(spark, folder)
    rows = docs.collect()
    group = {i: c for i, _, c in brute_near([(r["doc_id"], r["text"] or "") for r in rows]) if i >= 0}
    want = sorted((r for r in rows if r["doc_id"] is None or group[r["doc_id"]] == r["doc_id"]), key=key)
    assert sorted(C.keep_one_of_near_copies(spark, docs, folder).collect(), key=key) == want


def test_repeats_are_cut(spark, folder):
    docs = read(spark, folder)
    got = C.cut_repeated_passages(spark, docs, folder)
    assert got.columns == docs.columns
    left = sorted((-1 if r["doc_id"] is None else r["doc_id"], len((r["text"] or "").split())) for r in got.collect())
    assert left == sorted((i, n - gone) for i, n, gone, _ in brute_repeats([(r["doc_id"], r["text"] or "") for r in docs.collect()]))
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.collect())


def test_secrets_are_masked(spark, folder):
    docs = read(spark, folder)
    got = C.mask_secrets(spark, docs, folder)
    assert got.columns == docs.columns
    before, after = (sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["lang"] or "")) for df in (docs, got))
    for a, b in zip(before, after, strict=True):
        assert b["text"] == (a["text"] and a["text"].replace("password = Abcdef123456", "[SECRET]"))
        assert a[5:] == b[5:] and b["n_chars"] == len(b["text"] or "")
    assert secrets.find_secrets(docs).count() == docs.count()


def test_run(spark, folder):
    out = C.run(spark, folder).collect()
    kept = {r["doc_id"] for r in out}
    docs = read(spark, folder)
    for _, stage in C.STAGES[:-1]:
        docs = C.cut(stage(spark, docs, folder))
    ids = C.tokenizer("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    lib, want = Tokenizer.from_file(ids[0]), {}
    for r in docs.collect():
        data = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first, start, piece = len(data) % 1024 or 1024, 0, 0
        while start < len(data):
            n = first if piece == 0 else 1024
            row = (r["doc_id"], piece, start, n, zlib.crc32(np.array(data[start : start + n], "<u4").tobytes()))
            want[row] = want.get(row, 0) + 1
            start, piece = start + n, piece + 1
    have = {}
    for r in out:
        row = tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32"))
        have[row] = have.get(row, 0) + 1
    assert have == want and kept == {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_empty_tables(spark, folder, name):
    none = spark.createDataFrame([], DOCS)
    got = dict(C.STAGES)[name](spark, none, folder)
    assert got.collect() == [] and (name == "best_fit_packing" or got.columns == none.columns)
