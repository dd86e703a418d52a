"""Exact top-k search by inner product, with norm-bucketed retrieval.

Vectors are scaled to integers, sorted by length into buckets, and queries are taken in blocks.
For a query and a bucket, the k-th best score so far and the bucket's longest vector give a
local cosine threshold.  Above 1 the bucket is skipped.  A high threshold selects
coordinate pruning: the angle to the query's largest axis bounds that coordinate of every
candidate, which is a range of the bucket's sorted coordinate list.  Otherwise length
pruning applies: only the prefix of vectors long enough is taken.  What is left is verified
with exact integer products.

Work is a block of queries against a group of buckets.  First every block meets the group of its
dimension's longest vectors, which gives each query a lower bound of its k-th best score.  A query's bound over its length is
the shortest vector that can still matter, so a pair of block and group that is too short for all of the block's
queries is dropped before any vector is shipped for it; the others are searched with the bounds known.  The
pairs are made from numbers alone, dealt by salts on both sides, and a block or group that takes part in many
pairs is shipped in copies to several tasks.  Each pair returns k rows for each query at most, and nothing is
collected or broadcast.

Defined cases: vectors that are null or hold a null or non-finite component take no part;
only vectors of equal dimension meet; rows that share a vec_id are no candidates for
each other, and such a query is asked once, with its smallest vector; null vec_ids take no part; a scaled component or a score beyond 64 bits is clipped; an empty table
gives no rows; other columns are ignored; ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm._blocks import dump_arrays, load_arrays
from paperloom.llm._session import materialize, written

SCALE = 256
K = 5
QUERY_BLOCK = 2048
PAIRS_PER_COPY = 64
META_SALT = 256  # numbers of blocks or groups under one key when they are paired
BUCKET = 2048
GROUP_BUCKETS = 4
COORDINATE_COSINE = 0.7
_MAX = np.iinfo(np.int64).max


def _scaled(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    x, name = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`")
    fine = x.isNotNull() & name.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))
    y = vectors.where(F.coalesce(fine, F.lit(False))).select(name.cast("long").alias("vec_id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return y.select("vec_id", "v", F.size("v").alias("dim"), F.sqrt(squares).alias("length"), "asked")


def _packer(size: int):
    """Rows (dim, payload) of up to ``size`` vectors of one dimension, in the order of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            dims = table["dim"].to_numpy()
            for at in np.split(np.arange(len(dims)), np.flatnonzero(np.diff(dims)) + 1):
                part = table.slice(int(at[0]), len(at)).combine_chunks()
                flat = part["v"].combine_chunks().flatten().to_numpy()
                payload = dump_arrays(id=part["vec_id"].to_numpy(), length=part["length"].to_numpy())
                yield pa.RecordBatch.from_pydict({"dim": pa.array([int(dims[at[0]])], pa.int32()), "longest": pa.array([float(pa.compute.max(part["length"]).as_py())]), "payload": pa.array([payload], pa.binary()), "data": pa.array([dump_arrays(v=flat)], pa.binary())})

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            while rows >= size:
                table = pa.concat_tables(held)
                yield from flush(table.slice(0, size))
                held, rows = [table.slice(size)], rows - size
        if rows:
            yield from flush(pa.concat_tables(held))

    return run


def _products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of p and q."""
    if not p.size or not q.size:
        return np.zeros((len(q), len(p)), np.int64)
    bound = p.shape[1] * float(np.abs(p.astype(float)).max()) * float(np.abs(q.astype(float)).max())
    if bound < 2**52:
        return (q.astype(float) @ p.astype(float).T).astype(np.int64)
    return np.clip(q.astype(object) @ p.astype(object).T, -_MAX, _MAX).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > k:
        keep = scores >= np.partition(scores, -k)[-k]
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class _Bucket:
    """Vectors by descending length."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, length: np.ndarray):
        order = np.lexsort((ids, -length))
        self.ids, self.v, self.length = ids[order], v[order], length[order]
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate_range(self, axis: int, low: float, high: float) -> np.ndarray:
        if axis not in self._lists:
            unit = self.v[:, axis] / np.maximum(self.length, 1e-300)
            order = np.argsort(unit)
            self._lists[axis] = (unit[order], order)
        values, order = self._lists[axis]
        return order[np.searchsorted(values, low - 1e-9) : np.searchsorted(values, high + 1e-9, side="right")]


def _kth(found: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    return np.array([s[k - 1] if len(s) == k else -np.inf for _, s in found], dtype=float)


def _search(qid: np.ndarray, q: np.ndarray, q_length: np.ndarray, buckets: list[_Bucket], k: int, known: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of each query's k best; none below ``known``, a bound for each query, need be found."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in qid]
    for b in sorted(buckets, key=lambda b: -b.length[0]):
        theta = np.maximum(known, _kth(found, k))
        reach = q_length * b.length[0]
        cosine = np.where(reach > 0, theta / np.maximum(reach, 1e-300), np.where(theta > 0, np.inf, -np.inf))
        by_length = []
        for i in np.flatnonzero(cosine <= 1 + 1e-9):
            if cosine[i] < COORDINATE_COSINE:
                by_length.append(i)
                continue
            axis = int(np.argmax(np.abs(q[i])))
            angle, spread = np.arccos(np.clip(q[i, axis] / q_length[i], -1, 1)), np.arccos(min(1.0, cosine[i]))
            at = b.coordinate_range(axis, np.cos(min(np.pi, angle + spread)), np.cos(max(0.0, angle - spread)))
            at = at[b.ids[at] != qid[i]]
            scores = _products(b.v[at], q[i : i + 1])[0]
            found[i] = _best(np.append(found[i][0], b.ids[at]), np.append(found[i][1], scores), k)
        if by_length:
            need = np.where(theta[by_length] > 0, theta[by_length] / np.maximum(q_length[by_length], 1e-300) * (1 - 1e-12), 0.0)
            upto = len(b.ids) - np.searchsorted(b.length[::-1], need, side="left")
            scores = _products(b.v[: upto.max()], q[by_length])
            for row, i in enumerate(by_length):
                ids = b.ids[: upto[row]]
                mine = ids != qid[i]
                found[i] = _best(np.append(found[i][0], ids[mine]), np.append(found[i][1], scores[row, : upto[row]][mine]), k)
    return found


_PACKED = "dim int, longest double, payload binary, data binary"


def _attached(pairs: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """``pairs`` (q, g) with the columns of ``rows``, one for each ``key``; a key of many pairs is dealt over copies of its row."""
    copies = written(pairs.groupBy(key).agg(F.ceil(F.count("*") / PAIRS_PER_COPY).cast("int").alias("copies")))
    dealt = pairs.join(copies, key).withColumn("copy", F.pmod(F.xxhash64("q", "g"), "copies").cast("int")).drop("copies")
    copied = rows.join(copies, key).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    return dealt.join(copied, [key, "copy"]).drop("copy")


def _work(pairs: DataFrame, blocks: DataFrame, groups: DataFrame) -> DataFrame:
    b = blocks.select("q", "dim", "known", F.col("payload").alias("q_payload"), F.col("data").alias("q_data"))
    return _attached(_attached(pairs, "q", b), "g", groups.select("g", "payload", "data"))


def _pairs(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """(q, g) of the blocks (q, dim, need) and groups (g, dim, longest) that can't be left out; the key is dealt by salts on both sides."""
    salts = {c: max(1, -(-df.count() // META_SALT)) for c, df in (("q", blocks), ("g", groups))}
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(salts[c])).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.lit(salts[c] - 1)))
    b = blocks.select("q", "dim", "need", own("q").alias("sq"), every("g").alias("sg"))
    g = groups.select("g", "dim", "longest", every("q").alias("sq"), own("g").alias("sg"))
    return b.join(g, ["dim", "sq", "sg"]).where(F.col("longest") >= F.col("need") * (1 - 1e-9)).select("q", "g")


def _searched(k: int):
    """Rows (q, need, known, found) of pairs of a block and a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                c = {name: load_arrays(batch[name][r].as_buffer()) for name in ("q_payload", "q_data", "payload", "data")}
                dim, known = batch["dim"][r].as_py(), batch["known"][r]
                p, pid, pl = c["data"]["v"].reshape(-1, dim), c["payload"]["id"], c["payload"]["length"]
                buckets = [_Bucket(pid[a : a + BUCKET], p[a : a + BUCKET], pl[a : a + BUCKET]) for a in range(0, len(pid), BUCKET)]
                qid, length = c["q_payload"]["id"], c["q_payload"]["length"]
                bound = load_arrays(known.as_buffer())["b"] if known.is_valid else np.full(len(qid), -np.inf)
                found = _search(qid, c["q_data"]["v"].reshape(-1, dim), length, buckets, k, bound)
                keep = [s >= b for (_, s), b in zip(found, bound, strict=True)]
                best = np.maximum(bound, _kth(found, k))
                need = np.where(best > 0, best / np.maximum(length, 1e-300), 0.0)
                out = dump_arrays(
                    q=np.repeat(qid, [int(m.sum()) for m in keep]),
                    v=np.concatenate([ids[m] for (ids, _), m in zip(found, keep, strict=True)]),
                    s=np.concatenate([s[m] for (_, s), m in zip(found, keep, strict=True)]),
                )
                yield pa.RecordBatch.from_pydict({
                    "q": batch["q"].slice(r, 1),
                    "need": pa.array([float(need.min())]),
                    "known": pa.array([dump_arrays(b=best)], pa.binary()),
                    "found": pa.array([out], pa.binary()),
                })

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch["found"]:
            c = load_arrays(x.as_buffer())
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(c["q"], pa.int64()), "vec_id": pa.array(c["v"], pa.int64()), "score": pa.array(c["s"], pa.int64())})


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows."""
    whole = materialize(_scaled(vectors, is_query, id_col, vector_col, scale))
    n = max(1, whole.count() // (BUCKET * GROUP_BUCKETS))
    # vec_id breaks ties of length, so equal vectors don't meet in one partition
    ranged = whole.repartitionByRange(n, "dim", F.col("length").desc(), F.xxhash64("vec_id")).sortWithinPartitions("dim", F.col("length").desc(), "vec_id")
    groups = materialize(ranged.select("vec_id", "v", "dim", "length").mapInArrow(_packer(BUCKET * GROUP_BUCKETS), _PACKED).withColumn("g", F.monotonically_increasing_id()))
    queries = whole.where("asked").groupBy("vec_id", "dim").agg(F.min(F.struct("v", "length")).alias("x")).select("vec_id", "x.v", "dim", "x.length")
    blocks = queries.sortWithinPartitions("dim").mapInArrow(_packer(QUERY_BLOCK), _PACKED).withColumn("q", F.monotonically_increasing_id())
    blocks = materialize(blocks.withColumn("known", F.lit(None).cast("binary")))

    # a stated query set against all rows, in blocks: first with the longest vectors of its dimension
    head = groups.groupBy("dim").agg(F.max_by("g", F.struct("longest", -F.col("g"))).alias("g"))
    begun = written(blocks.select("q", "dim").join(head, "dim").select("q", "g"))
    searched = "q long, need double, known binary, found binary"
    first = materialize(_work(begun, blocks, groups).mapInArrow(_searched(k), searched))
    # then with all others that can still matter
    bounded = blocks.drop("known").join(first.select("q", "need", "known"), "q")
    open_pairs = written(_pairs(bounded.select("q", "dim", "need"), groups.select("g", "dim", "longest")).join(begun, ["q", "g"], "left_anti"))
    second = _work(open_pairs, bounded, groups).mapInArrow(_searched(k), searched)
    part = first.select("found").unionByName(second.select("found")).mapInArrow(_unpacked, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
