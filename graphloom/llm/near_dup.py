"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full shingle sets, union-find groups.

Documents with equal shingle sets are one class and its smallest id stands for it. Signatures are SuperMinHash: every
shingle throws correlated ranks (one permutation of the slots a shingle), and a document stops as soon as no later
throw can lower a slot. Classes that share a band key are linked to the key's smallest class; the groups so joined are
the candidates. A small candidate group is verified in one task: a union-find over its full sets, in which two
documents already joined are not compared again. A large group is dealt into blocks; every block also gets the same
pivots, and what is then not joined to the group's largest part meets all blocks once more, in blocks itself, its own
among them. So no pair list of a group is ever made and no comparison is left out.

Defined results: A-Z are lowered; null and empty texts have an empty set and stay alone; fewer than ``size`` words are
one shingle; repeated rows are equal documents; rows without a doc_id stay alone with a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.substrings import MIX, mixed
from graphloom.llm.text import Memo, bounded_batches, fresh, give_back, id_and_text
from graphloom.operators.components import connected_components
from graphloom.session import cut

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Shingles whose permutations stand in memory at once; members of a verified block; pivots of a large group.
SLICE, BLOCK, PIVOTS = 150_000, 400, 12
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_set(text: str, hashes: Memo, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(hashes.__getitem__, words)), np.uint64)
    n = max(1, len(h) - size + 1)
    acc = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(h))):
            acc = acc * MIX + h[k : k + n]
        return np.unique(mixed(acc + np.uint64(min(size, len(h)))))


def _uniform(seed: np.ndarray, j: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(seed + np.uint64(j + 1) * MIX)


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures (len(sets), slots) of nonempty sets."""
    out = np.full((len(sets), slots), np.inf)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= SLICE):
            size += len(sets[end])
            end += 1
        _throw(sets[at:end], out[at:end])
        at = end
    return out


def _throw(sets: list[np.ndarray], h: np.ndarray) -> None:
    slots = h.shape[1]
    seed = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    perm = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(seed), slots)).copy()
    flat, rows = h.reshape(-1), np.arange(len(seed))
    for j in range(slots):
        u = _uniform(seed, j)
        r = (u >> np.uint64(32)).astype(np.float64) / 2**32
        k = j + (((u & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        slot = perm[rows, k]
        perm[rows, k] = perm[rows, j]
        np.minimum.at(flat, doc * slots + slot, r + j)
        live = h.max(1) > j + 1
        if not live.all():
            keep = live[doc]
            seed, doc, perm = seed[keep], doc[keep], perm[keep]
            rows = np.arange(len(seed))
            if not len(seed):
                return


SIGNED = "doc_id long, n_shingles long, set_id binary, bands array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    bounded_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Memo(xxhash.xxh3_64_intdigest, 400_000)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets = [shingle_set(t or "", hashes) for t in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if full:
                sig = np.ascontiguousarray(super_minhash([sets[i] for i in full]))
                raw = sig.reshape(len(full), BANDS, ROWS).view(np.uint64)
                acc = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(full), BANDS)).copy()  # a key tells its band
                with np.errstate(over="ignore"):
                    for k in range(ROWS):
                        acc = mixed(acc * MIX + raw[:, :, k])
                for i, row in zip(full, acc.view(np.int64), strict=True):
                    keys[i] = row
            fp = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_id", "bands"],
            )
        give_back()

    return id_and_text(docs).mapInArrow(run, SIGNED)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= PERCENT * union, on full sets."""
    small, large = (len(a), len(b)) if len(a) <= len(b) else (len(b), len(a))
    if 100 * small < PERCENT * large:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= PERCENT * (small + large - inter)


class Union:
    def __init__(self, n: int):
        self.p = list(range(n))

    def find(self, i: int) -> int:
        while self.p[i] != i:
            self.p[i] = self.p[self.p[i]]
            i = self.p[i]
        return i


def forest(sets: list[np.ndarray], asked: list[int] | None = None, held: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join what is similar, as few as joining needs. With ``asked``: those against the ``held``, which may share members."""
    union, links = Union(len(sets)), []
    if asked is not None:
        for i in asked:
            for j in held or ():
                if union.find(i) != union.find(j) and similar(sets[i], sets[j]):
                    union.p[union.find(j)] = union.find(i)
                    links.append((i, j))
        return links
    members: dict[int, list[int]] = {}
    for i in range(len(sets)):
        joined = []
        for root, group in members.items():
            if any(similar(sets[i], sets[j]) and (links.append((i, j)) or True) for j in group):
                joined.append(root)
        merged = [i]
        for root in joined:
            merged = members.pop(root) + merged
        members[merged[0]] = merged
    return links


LINKS = "a long, b long"


#: A group above BLOCK meets its own figures under so many salts, so its members spread over tasks.
SALTS = 64


def _by_group(left: DataFrame, figures: DataFrame, key: str, how: str = "inner", unique: str = "doc_id") -> DataFrame:
    """``left`` with ``figures`` (one row per large group) by ``key``, without one task that reads a whole group."""
    salts = figures.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = left.withColumn("salt", F.pmod(F.xxhash64(unique), F.lit(SALTS)).cast("int"))
    return salted.join(salts, [key, "salt"], how).drop("salt")


def candidate_texts(sized: DataFrame, docs: DataFrame, total: int) -> DataFrame:
    """``sized`` with its documents' texts, as a table.

    Most documents are no candidates. A Bloom filter of the candidates' ids, of bounded size, keeps their texts out of
    the shuffle; where it is too full to keep out much, the join still decides.
    """
    bits = min(max(10 * total, 1 << 16), 1 << 28)
    name = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": str(1 << 40), "expectedNumItems": str(total), "maxNumItems": str(max(total, 1)), "numBits": str(bits), "maxNumBits": str(bits)}
    conf = docs.sparkSession.conf
    before = {k: conf.get(name + k) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(name + k, v)
        return cut(sized.filter(F.col("n") >= 2).join(id_and_text(docs), "doc_id"))
    finally:
        for k, v in before.items():
            conf.set(name + k, v)


def verify(members: DataFrame, by: list[str]) -> DataFrame:
    """``members``: doc_id, text, grp (verified among themselves), ``by`` (the task's key), role (1: asked against those of role 0; all 0: all)."""
    bounded_batches(members)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, out = Memo(xxhash.xxh3_64_intdigest, 400_000), []
        for _, part in pdf.groupby("grp", sort=False):
            # A document can be asked and held in one cell: then it also meets the others that are asked there.
            asked, held = set(part.loc[part["role"] == 1, "doc_id"]), set(part.loc[part["role"] == 0, "doc_id"])
            part = part.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
            ids = part["doc_id"].tolist()
            sets = [shingle_set(t or "", hashes) for t in part["text"]]
            both = [[k for k, i in enumerate(ids) if i in side] for side in (asked, held)] if asked else []
            out += [(ids[i], ids[j]) for i, j in forest(sets, *both)]
            del part, sets
        give_back()
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return members.groupBy(*by).applyInPandas(run, LINKS)


def _verified_links(candidate: DataFrame, docs: DataFrame) -> DataFrame:
    """``candidate`` (id, component) -> links (a, b) that hold on full sets."""
    big = candidate.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    known = _by_group(candidate, big, "component", "left", "id")
    sized = cut(known.select(F.col("id").alias("doc_id"), F.col("component").alias("grp"), F.coalesce("n", F.lit(2)).cast("long").alias("n")))
    total = sized.count()
    tasks = max(1, -(-total // BLOCK))
    texts = candidate_texts(sized, docs, total)
    small = texts.filter(F.col("n") <= BLOCK).withColumns({"bin": F.pmod(F.xxhash64("grp"), F.lit(tasks)), "role": F.lit(0)})
    links = verify(small.select("doc_id", "text", "grp", "bin", "role"), ["bin"])
    large = sized.filter(F.col("n") > BLOCK)
    told = texts.filter(F.col("n") > BLOCK).select("doc_id", "text")
    if large.isEmpty():
        return cut(links)
    place = F.xxhash64("doc_id", F.lit(1))
    blocked = large.withColumns({"blocks": F.ceil(F.col("n") / BLOCK), "h": place}).withColumn("block", F.pmod("h", F.col("blocks")))
    # The documents of smallest hash are pivots and go to every block of their group.
    tops = blocked.groupBy("grp", "blocks").agg(F.slice(F.sort_array(F.collect_list(F.when(F.pmod("h", F.col("n")) < 4 * PIVOTS, F.struct("h", "doc_id")))), 1, PIVOTS).alias("p"))
    pivots = tops.select("grp", "blocks", F.explode("p.doc_id").alias("doc_id")).select("grp", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"))
    first = blocked.select("grp", "doc_id", F.col("block").cast("long").alias("block")).unionByName(pivots).distinct().withColumn("role", F.lit(0))
    links = cut(links.unionByName(verify(first.join(told, "doc_id"), ["grp", "block"])))
    # What stands outside its group's largest part meets every block of the group.
    part = connected_components(links).withColumnsRenamed({"id": "doc_id", "component": "part"})
    parts = cut(large.join(part, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id")))
    count = parts.groupBy("grp", "part").agg(F.count("*").alias("m"))
    main = count.groupBy("grp").agg(F.max(F.struct("m", F.col("part"))).alias("top")).select("grp", F.col("top.part").alias("main"))
    rest = cut(_by_group(parts, main, "grp").filter(F.col("part") != F.col("main")).select("grp", "doc_id", "n"))
    n_rest = rest.groupBy("grp").agg(F.count("*").alias("r"))
    if n_rest.isEmpty():
        return links
    asked = _by_group(rest, n_rest, "grp").withColumn("row", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.ceil(F.col("r") / BLOCK)))
    cells = asked.select("grp", "doc_id", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK).cast("long") - 1)).alias("block"), F.lit(1).alias("role"))
    facing = _by_group(blocked, n_rest, "grp").select("grp", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("r") / BLOCK).cast("long") - 1)).alias("row"), F.col("block").cast("long").alias("block"), F.lit(0).alias("role"))
    return links.unionByName(cut(verify(cells.unionByName(facing).join(told, "doc_id"), ["grp", "row", "block"])))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, for every row."""
    signed = cut(signatures(docs))
    classes = signed.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    chosen = signed.join(classes, "set_id").filter(F.col("doc_id") == F.col("rep")).select("rep", "bands")
    # One exchange by key serves the smallest member of a key and the join that links the others to it.
    keyed = chosen.select("rep", F.explode("bands").alias("key")).repartition("key")
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("top")).filter(F.col("a") != F.col("top"))
    edges = cut(keyed.join(buckets, "key").filter(F.col("rep") != F.col("a")).select("a", F.col("rep").alias("b")).distinct())
    links = _verified_links(connected_components(edges), docs)
    joined = connected_components(links)
    named = classes.join(joined, classes["rep"] == joined["id"], "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id names its group; rows without an id stay. Of repeated rows of one id all stay."""
    (name,) = fresh(docs, "gone_id")
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
