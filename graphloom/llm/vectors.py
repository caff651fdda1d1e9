"""Approximate nearest neighbours by a permutation index.

A bounded sample of the vectors gives pivots. A vector is represented by its ``PREFIX`` nearest pivots in order. The
first ``FILES`` pivots have inverted files; a vector is posted in those of its ``POSTS`` nearest. As nearness is the
inner product, orders of directions compare only vectors of like length: there are files for every class of lengths,
halving from the longest down to ``CLASSES``, and a query visits the files of its nearest pivots in each. A class of
few vectors has one file. In a file, ids are ranked by the least footrule distance between orders, and the nearest share
of them is reranked by the exact inner product in double precision, always summed in the order of the components. Files
are dealt in blocks of postings and blocks of queries, so neither has to fit one task. A query that finds fewer than
``k`` visits all files once more, whole.

Defined results: vectors that are null, zero, empty, of another length than most, or hold null or non-finite numbers
take no part; equal scores go to the smaller id; a query with fewer candidates than asked gets all of them; rows of one
id are one candidate and one query (the best score of its rows); a query never finds rows of its own id; without
vectors, no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.text import bounded_batches
from graphloom.session import cut

#: Pivots, length of a vector's order, pivots with files, files that a vector is posted in and a query visits.
PIVOTS, PREFIX, FILES, POSTS, VISITS = 128, 32, 64, 8, 12
#: The share (at least the number) of a file's ids, nearest by footrule first, that is reranked.
SHARE, LEAST = 0.75, 200
#: Bound of the sample that pivots come from; postings and queries in one block of a file; queries that are scored at once.
SAMPLE, BLOCK, QUERIES, CHUNK = 8192, 20_000, 4096, 256
#: Classes of lengths, and the vectors up to which a class has one file.
CLASSES, FEW = 16, 2000
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector, single precision only if it comes so, of rows that take part."""
    floats = dict(vectors.dtypes)["embedding"] == "array<float>"
    v = F.col("embedding").cast("array<float>" if floats else "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(fine)


def choose_pivots(sample: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """Unit vectors spread over the sample: each next one is the vector least like those chosen, of a few drawn."""
    rng = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen = [int(rng.integers(len(unit)))]
    near = unit @ unit[chosen[0]]
    while len(chosen) < min(count, len(unit)):
        drawn = rng.integers(0, len(unit), 8)
        pick = int(drawn[near[drawn].argmin()])
        chosen.append(pick)
        near = np.maximum(near, unit @ unit[pick])
    return unit[chosen]


def orders(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    return np.argsort(-(v @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


def footrule(query_rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Footrule distance of prefixes: pivots that one order lacks stand just after its end. (queries, postings)."""
    place = np.arange(order.shape[1], dtype=np.int16)
    columns = np.ascontiguousarray(order.T, np.intp)
    out = np.zeros((len(query_rank), len(order)), np.int16)
    for i, rank in enumerate(query_rank):
        step = np.abs(rank[None, :] - place[:, None])
        for j in place:
            out[i] += step[j].take(columns[j])
    return out


def usable_class(longest: Column) -> Column:
    """0 for lengths above half of the longest, 1 for those above a quarter, and so on; the last class holds all others."""
    return F.coalesce(F.least(F.lit(CLASSES - 1), F.greatest(F.lit(0), F.floor(F.log2(longest / F.nullif(F.col("length"), F.lit(0.0)))))), F.lit(CLASSES - 1)).cast("int")


def best_of(near: np.ndarray, scores: np.ndarray, exact, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` of ``near`` with the highest exact scores, ties to smaller ids. Fast products choose, with room for
    their rounding; ``exact`` sums the products of those chosen in one fixed order."""
    if len(near) > k:
        bound = np.partition(scores, -k)[-k]
        near = near[scores >= bound - 1e-9 * np.abs(scores).max()]
    scores = exact(near)
    best = np.lexsort((ids[near], -scores))[:k]
    return near[best], scores[best]


def search(pdf: pd.DataFrame, pivots: int, prefix: int, k: int, whole: bool) -> pd.DataFrame:
    """One block of postings of a file against one block of its queries."""
    asked, held = pdf[pdf["side"] == 1], pdf[pdf["side"] == 0].sort_values("vec_id", kind="stable")
    out: list[tuple] = []
    if len(asked) and len(held):
        hv, ho, hid = np.array(held["v"].tolist(), np.float64), np.array(held["o"].tolist(), np.int16), held["vec_id"].to_numpy()
        ids, first_row, copies = np.unique(hid, return_index=True, return_counts=True)
        repeated, share = len(ids) < len(hid), len(ids) if whole else max(LEAST, int(SHARE * len(ids)))
        for first in range(0, len(asked), CHUNK):
            part = asked.iloc[first : first + CHUNK]
            qv, qo, qid = np.array(part["v"].tolist(), np.float64), np.array(part["o"].tolist(), np.int16), part["vec_id"].to_numpy()
            far = None
            if share < len(ids):
                rank = np.full((len(part), pivots), prefix, np.int16)
                np.put_along_axis(rank, qo.astype(np.int64), np.arange(prefix, dtype=np.int16)[None, :], 1)
                far = footrule(rank, ho)
                if repeated:
                    far = np.minimum.reduceat(far, first_row, axis=1)
            for i in range(len(part)):
                near = np.arange(len(ids)) if far is None else np.argpartition(far[i], share - 1)[:share]
                near = near[ids[near] != qid[i]]
                if not len(near):
                    continue

                def exact(chosen: np.ndarray, q: np.ndarray = qv[i]) -> np.ndarray:
                    if not repeated:
                        return (hv[chosen] * q).sum(1)
                    at = np.cumsum(copies[chosen]) - copies[chosen]
                    rows = np.repeat(first_row[chosen] - at, copies[chosen]) + np.arange(copies[chosen].sum())
                    return np.maximum.reduceat((hv[rows] * q).sum(1), at)

                near, score = best_of(near, exact(near) if repeated else hv[near] @ qv[i], exact, ids, k)
                out += zip([int(qid[i])] * len(near), ids[near].tolist(), score.tolist(), strict=True)
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row for which ``is_query`` holds."""
    bounded_batches(vectors)
    spark = vectors.sparkSession
    rows = usable(vectors).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    kind = dict(rows.dtypes)["v"]
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("length", F.least(F.sqrt(squares), F.lit(1e300)))
    width = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("count"), F.max("length").alias("longest")).orderBy(F.desc("count"), "n").limit(1).collect()
    if not width:
        return spark.createDataFrame([], RESULT)
    rows = rows.filter(F.size("v") == width[0]["n"]).withColumn("class", usable_class(F.lit(float(width[0]["longest"])))).drop("length")
    counts = {r[0]: r[1] for r in rows.groupBy("class").count().collect()}
    total, asked = sum(counts.values()), rows.filter("is_query").count()
    keep = int(min(1.0, SAMPLE / total) * (1 << 20)) + 1
    sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < keep).select("vec_id", "v").limit(2 * SAMPLE).collect()
    if not sample:  # a hash of few ids may leave none
        sample = rows.select("vec_id", "v").orderBy("vec_id", "v").limit(SAMPLE).collect()
    pivots = choose_pivots(np.array([r["v"] for r in sorted(sample)], np.float64), PIVOTS)
    prefix = min(PREFIX, len(pivots))
    files = {c: 1 if n <= FEW else min(FILES, len(pivots)) for c, n in counts.items()}

    def dealt(rows: DataFrame, posts: int, visits: int) -> DataFrame:
        """Postings (side 0) and queries (side 1) by file, block of postings and block of queries."""
        blocks = {c: (max(1, -(-n * min(posts, files[c]) // (files[c] * BLOCK))), max(1, -(-asked * min(visits, files[c]) // (files[c] * QUERIES)))) for c, n in counts.items()}
        most = max(files.values())

        def post(frames):
            for pdf in frames:
                v = np.array(pdf["v"].tolist(), np.float64)
                order, near = orders(v, pivots, prefix), orders(v, pivots[:most], most).astype("int32")
                base = pd.DataFrame({"vec_id": pdf["vec_id"], "v": list(pdf["v"]), "o": list(order)})
                for side in (0, 1):
                    for c in sorted(counts):
                        own = (pdf["side"] == side).to_numpy() & ((pdf["class"] == c).to_numpy() | (side == 1))
                        if own.any():
                            extra = {"side": side, "blocks": blocks[c][0], "parts": blocks[c][1]}
                            for j in range(min(visits if side else posts, files[c])):
                                yield base[own].assign(file=c * FILES + (near[own, j] if files[c] > 1 else 0), **extra)

        posted = rows.mapInPandas(post, f"vec_id long, v {kind}, o array<short>, file int, side int, blocks int, parts int")
        own = F.xxhash64("vec_id", "v")
        # Rows of one id are spread over blocks too, so that an id of many rows does not fill one.
        each = lambda count, at: F.when(F.col("side") == at, F.array(F.pmod(own, F.col(count)).cast("int"))).otherwise(F.sequence(F.lit(0), F.col(count) - 1))
        return posted.withColumn("block", F.explode(each("blocks", 0))).withColumn("part", F.explode(each("parts", 1)))

    def found(posted: DataFrame, queries: DataFrame, posts: int, visits: int, whole: bool) -> DataFrame:
        both = posted.select("vec_id", "v", "class", F.lit(0).alias("side")).unionByName(queries.select("vec_id", "v", F.lit(0).alias("class"), F.lit(1).alias("side")))
        cells = dealt(both, posts, visits).groupBy("file", "block", "part")
        hits = cells.applyInPandas(lambda pdf: search(pdf, len(pivots), prefix, k, whole), "query_id long, vec_id long, score double")
        best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    queries = rows.filter("is_query").select("vec_id", "v").distinct()
    first = cut(found(rows, queries, POSTS, VISITS, False))
    full = first.groupBy(F.col("query_id").alias("vec_id")).count().filter(F.col("count") >= k)
    short = cut(queries.join(full, "vec_id", "left_anti"))
    if short.isEmpty():
        return first
    again = found(rows, short, 1, FILES, True)
    return first.join(full.select(F.col("vec_id").alias("query_id")), "query_id", "left_semi").unionByName(again)
