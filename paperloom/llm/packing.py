"""Lexical retrieval packing.

Documents are tokenised once, into a table in shared storage.  Document frequencies are
counted over all documents (one number for each vocabulary entry).  A document's route is the rarest of its
terms that still stands in about a shard's worth of documents, and the table is dealt by
route, so documents with a term in common come to lie in one shard however many input
partitions or rows there are; a route that very many documents may have is dealt over as many shards as
they fill.  A table that one shard holds needs no route.

A shard is at most ``SHARD_TOKENS`` tokens.  A BM25 inverted index over it answers each seed
document, by all of its terms, with its unused neighbours, best first, which fill the seed's window in
turn; if none that shares a term is left and the window still has room, the documents taken are asked in
turn, and only when none of them has a neighbour do the next documents in order follow.  The last
document is cut where the window ends and its rest stays in the index.  A document longer than a
window gives its full windows first and enters the index with the terms of the rest.  What does not fill a window at a
shard's end goes on into the partition's next one, and at a partition's end it is cut at powers of two, so
no sequence needs padding.

Defined cases: a null or empty text is the end token alone; repeated rows and equal doc_ids are
packed as rows of their own; a null doc_id stays null; neighbours of equal score come in the
shard's order; an empty table gives no pieces; extra columns are ignored; a long text is cut into as many
windows as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm._session import materialize
from paperloom.llm.bpe import Encoder, by_library

WINDOW = 4096
END_ID = 2
SHARD_TOKENS = 4 << 20
SHARD_ROWS = 1 << 16
PARTITIONS = 50_000  # a partition of a very large table holds more than one shard
DENSE = 8  # a term that one in so many documents has is kept as a column
FIRST_BLOCK = 64  # neighbours are put in order block by block
K1, B = 1.2, 0.75

_encoders: dict[str, Encoder] = {}


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = by_library(path)
        encoder, end = _encoders[path], np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                ids = [encoder.encode(x.as_py()) + end for x in piece["text"]]
                # two bytes hold the ids of most vocabularies; a batch with a larger one is stored in four
                flat = np.frombuffer(b"".join(ids), dtype="<u4")
                wide = bool(flat.max() >> 16)
                offsets = np.cumsum([0, *map(len, ids)]) // (1 if wide else 2)
                data = pa.py_buffer(flat if wide else flat.astype("<u2"))
                column = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int32)), data])
                yield pa.RecordBatch.from_pydict({"doc_id": piece["doc_id"], "wide": pa.array(np.full(len(ids), wide)), "ids": column})

    return run


def _ids(row_ids: pa.Scalar, wide: bool) -> np.ndarray:
    return np.frombuffer(row_ids.as_buffer(), dtype="<u4" if wide else "<u2")


class _Distinct:
    """The distinct values of small arrays of ids, without sorting."""

    def __init__(self) -> None:
        self.at = np.zeros(1 << 16, dtype=np.int64)

    def _last(self, x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each value comes last, for each place; and which places those are."""
        if top >= len(self.at):
            self.at = np.zeros(2 * top, dtype=np.int64)
        places = np.arange(len(x))
        self.at[x] = places
        last = self.at[x]
        return last, last == places

    def values(self, x: np.ndarray, top: int) -> np.ndarray:
        return x[self._last(x, top)[1]]

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values in the order in which each comes last, and how often each comes."""
        last, kept = self._last(x, int(x.max(initial=0)))
        return x[kept], np.bincount(last, minlength=len(x))[kept]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, distinct, size = np.zeros(0, dtype=np.int64), _Distinct(), 0
    for batch in batches:
        for x, w in zip(batch["ids"], batch["wide"].to_pylist(), strict=True):
            ids = _ids(x, w)
            size += len(ids)
            top = int(ids.max())
            if top >= len(total):
                total = np.pad(total, (0, top + 1 - len(total)))
            total[distinct.values(ids, top)] += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"token": pa.array([*at.tolist(), -1], pa.int64()), "df": pa.array([*total[at].tolist(), size], pa.int64())})


def _route(rank: np.ndarray, splits: np.ndarray):
    """Adds to each row its term of the highest rank, as that rank, and over how many shards its documents are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            route = np.array([rank[_ids(x, w)].max() for x, w in zip(batch["ids"], batch["wide"].to_pylist(), strict=True)], dtype=np.int64)
            columns = {c: batch[c] for c in ("doc_id", "wide", "ids")}
            yield pa.RecordBatch.from_pydict(columns | {"route": pa.array(route), "split": pa.array(splits[route])})

    return run


class _Shard:
    """The documents of one shard and the index over what is left of them.

    ``done`` says how much of each document earlier shards have packed.
    """

    def __init__(self, ids: list[np.ndarray], window: int, idf: np.ndarray, done: list[int] | None = None):
        self.ids, self.window, self.idf = ids, window, idf
        self.total = np.array([len(x) for x in ids], dtype=np.int64)
        self.start = np.array(done if done is not None else [0] * len(ids), dtype=np.int64)
        self.whole = [(i, at) for i, n in enumerate(self.total) for at in range(int(self.start[i]), int(n) - window + 1, window)]
        self.start += (self.total - self.start) // window * window
        self.left = self.total - self.start
        self._index()

    def _index(self) -> None:
        distinct = _Distinct()
        self.docs = np.flatnonzero(self.left)  # by slot
        found = [distinct(self.ids[i][self.start[i] :]) for i in self.docs]
        self.terms = {int(i): t.astype(np.int64) for i, (t, _) in zip(self.docs, found, strict=True)}
        t = np.concatenate([t for t, _ in found]).astype(np.int64) if found else np.zeros(0, np.int64)
        c = np.concatenate([c for _, c in found]).astype(float) if found else np.zeros(0)
        slot = np.repeat(np.arange(len(self.docs)), [len(t) for t, _ in found])
        size = self.left[self.docs] / max(1.0, float(self.left[self.docs].mean()) if found else 1.0)
        w = self.idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * size[slot]))
        scored = w > 0
        self.alive = np.bincount(t[scored], minlength=len(self.idf))
        # postings of terms that many documents have are columns of a table, those of the others are lists
        common = np.flatnonzero(self.alive * DENSE >= len(self.docs)) if found else t
        self.column = np.full(len(self.idf), -1, dtype=np.int64)
        self.column[common] = np.arange(len(common))
        in_table = scored & (self.column[t] >= 0)
        self.table = np.zeros((len(common), len(self.docs)), dtype=np.float32)
        self.table[self.column[t[in_table]], slot[in_table]] = w[in_table]
        in_list = scored & ~in_table
        order = np.argsort(t[in_list], kind="stable")
        self.slots, self.weights, self.by_term = slot[in_list][order], w[in_list][order], t[in_list][order]
        self._bounds()

    def _bounds(self) -> None:
        self.edges = np.searchsorted(self.by_term, np.arange(len(self.idf) + 1))

    def _drop_used(self) -> None:
        """Used documents leave the index each time that half of them are used, so a posting is moved a bounded number of times."""
        live = self.left[self.docs] > 0
        if 2 * int(np.count_nonzero(live)) >= len(self.docs):
            return
        new = np.cumsum(live) - 1
        keep = live[self.slots]
        self.slots, self.weights, self.by_term = new[self.slots[keep]], self.weights[keep], self.by_term[keep]
        self.docs, self.table = self.docs[live], np.ascontiguousarray(self.table[:, live])
        self._bounds()

    def scores(self, doc: int) -> np.ndarray:
        """The BM25 score of each document in ``docs`` for the terms of ``doc``; used ones have none."""
        terms = self.terms[doc]
        terms = terms[self.alive[terms] > 0]
        scores = np.zeros(len(self.docs))
        columns = self.column[terms]
        asked = columns[columns >= 0]
        if len(asked):
            wanted = np.zeros(len(self.table), dtype=np.float32)
            wanted[asked] = 1
            scores += wanted @ self.table
        listed = terms[columns < 0]
        at, n = self.edges[listed], self.edges[listed + 1] - self.edges[listed]
        total = int(n.sum())
        if total:
            places = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(total)
            scores += np.bincount(self.slots[places], self.weights[places], minlength=len(scores))
        scores[self.left[self.docs] == 0] = 0
        return scores

    def neighbours(self, seed: int) -> Iterator[int]:
        """The unused documents that share a term with a seed, best first, in growing blocks."""
        self._drop_used()
        scores = self.scores(seed)
        rest, block = np.flatnonzero(scores), FIRST_BLOCK
        while len(rest):
            if len(rest) > block:
                least = np.partition(scores[rest], len(rest) - block)[len(rest) - block]
                best, rest = rest[scores[rest] >= least], rest[scores[rest] < least]
            else:
                best, rest = rest, rest[:0]
            yield from self.docs[best[np.lexsort((best, -scores[best]))]].tolist()
            block *= 4

    def take(self, doc: int, room: int) -> tuple[int, int, int]:
        n = int(min(room, self.left[doc]))
        piece = (doc, int(self.start[doc]), n)
        self.start[doc] += n
        self.left[doc] -= n
        if not self.left[doc]:
            self.alive[self.terms[doc]] -= 1
        return piece

    def sequences(self) -> Iterator[list[tuple[int, int, int]]]:
        """Full windows of pieces (document, start, length); what is left goes to ``pending``."""
        for doc, at in self.whole:
            yield [(doc, at, self.window)]
        self.pending: list[tuple[int, int, int]] = []
        following, n = 0, len(self.ids)
        while True:
            while following < n and not self.left[following]:
                following += 1
            if following == n:
                return
            row = [self.take(following, self.window)]
            room = self.window - row[0][2]
            asked = 0
            while room and asked < len(row):  # the seed, then the documents taken
                for doc in self.neighbours(row[asked][0]):
                    if self.left[doc]:
                        row.append(self.take(doc, room))
                        room -= row[-1][2]
                        if not room:
                            break
                asked += 1
            after = following
            while room and after < n:  # none of them has a neighbour left
                if self.left[after]:
                    row.append(self.take(after, room))
                    room -= row[-1][2]
                    for doc in self.neighbours(after) if room else ():
                        if self.left[doc]:
                            row.append(self.take(doc, room))
                            room -= row[-1][2]
                            if not room:
                                break
                after += 1
            if room:
                self.pending = row
                return
            yield row


def _at_powers_of_two(row: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    total = sum(n for _, _, n in row)
    rest = list(row)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        out = []
        while size:
            doc, start, n = rest.pop(0)
            out.append((doc, start, min(n, size)))
            if n > size:
                rest.insert(0, (doc, start + size, n - size))
            size -= min(n, size)
        yield out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _routed(tokens: DataFrame, df: np.ndarray, n_docs: int, n_tokens: int, end_id: int) -> DataFrame:
    """``tokens`` dealt so that documents with a term in common lie together."""
    shards = n_tokens / SHARD_TOKENS
    if shards <= 1:
        return tokens.select("doc_id", "wide", "ids").coalesce(1)
    # the rarest term first, of those that stand in a good part of a shard's documents; rank 0 is none
    order = np.argsort(-df, kind="stable")
    rank = np.zeros(len(df), dtype=np.int64)
    rank[order] = np.arange(1, len(df) + 1)
    rank[df * 4 * shards < n_docs] = 0
    rank[end_id : end_id + 1] = 0
    # no route has more documents than its term stands in
    most = np.concatenate([[n_docs], df[order]])
    splits = np.maximum(1, np.ceil(most * shards / max(1, n_docs))).astype(np.int64)
    routed = tokens.select("doc_id", "wide", "ids").mapInArrow(_route(rank, splits), "doc_id long, wide boolean, ids binary, route long, split long")
    routed = routed.withColumn("salt", F.xxhash64("doc_id", "ids")).withColumn("part", F.pmod("salt", "split"))
    parts = int(min(PARTITIONS, np.ceil(shards)))
    return routed.repartition(parts, "route", "part").sortWithinPartitions("route", "part", "salt").select("doc_id", "wide", "ids")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    tokens = materialize(narrow.mapInArrow(_tokenize(path, end_id), "doc_id long, wide boolean, ids binary"))
    counted = tokens.select("wide", "ids").mapInArrow(_count, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))
    rows = counted.collect()  # at most one row for each entry of the vocabulary, and one for all tokens
    n_tokens = sum(r.df for r in rows if r.token < 0)
    df = np.zeros(max((r.token for r in rows), default=-1) + 1 or 1)
    for r in rows:
        if r.token >= 0:
            df[r.token] = r.df
    # the end token is in each document, so its count is the number of documents
    n_docs = df[end_id] if len(df) > end_id else 0.0
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    idf[end_id : end_id + 1] = 0  # the end token is no term
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        done: list[int] = []

        def written(rows: Iterator[list[tuple[int, int, int]]]) -> pa.RecordBatch | None:
            nonlocal sequence
            out = []
            for row in rows:
                offset = 0
                for doc, start, n in row:
                    crc = zlib.crc32(ids[doc][start : start + n].astype("<u4").tobytes())
                    out.append((names[doc], start, n, crc, len(ids[doc]), sequence, offset))
                    offset += n
                sequence += 1
            if not out:
                return None
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip([f.split()[0] for f in _PIECES.split(", ")], columns, strict=True)})

        def shard(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal names, ids, done
            s = _Shard(ids, window, shared.value, done)
            if (out := written(s.sequences())) is not None:
                yield out
            if last:
                if (out := written(_at_powers_of_two(s.pending))) is not None:
                    yield out
                return
            # the window that is not full yet is the beginning of the next shard; a document's last piece there ends it
            at = {doc: start for doc, start, _ in s.pending}
            names, ids, done = [names[d] for d in at], [ids[d] for d in at], list(at.values())

        size = 0
        for batch in batches:
            for name, x, w in zip(batch["doc_id"].to_pylist(), batch["ids"], batch["wide"].to_pylist(), strict=True):
                names.append(name)
                ids.append(_ids(x, w))
                done.append(0)
                size += len(ids[-1])
                if size >= SHARD_TOKENS or len(ids) >= SHARD_ROWS:
                    yield from shard(False)
                    size = sum(len(x) - d for x, d in zip(ids, done, strict=True))
        if ids:
            yield from shard(True)

    return _routed(tokens, df, n_docs, n_tokens, end_id).mapInArrow(run, _PIECES)
