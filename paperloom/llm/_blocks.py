"""Whole texts in blocks, and counts of their windows by a sliced count-min sketch.

A *block* is one row that holds a few megabytes of documents as a compressed Arrow stream.
The block table is written once to shared storage, so a block's number always means the
same documents, whichever executor reads it.

The sketch has one row of counters, at least ``LOAD`` counters for each window, and it is
never held as a whole: its counters are divided into slices by hash range.  Each block
sends every slice the counters it touches, each once with its count (1-2 bytes for a
sorted gap), a slice's merge adds them up and answers each block with one code for each
counter: the magnitude of the (over-)estimated count.  Nothing is broadcast, a window in a third of
all documents costs one entry for each block however often the block has it, and slices are bounded.

A block's number holds its input partition in the upper bits: 2^26 partitions of 2^24 blocks, and
with `ROW_BITS` more a row's number still fits 63 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paperloom.llm._session import materialize

BLOCK_BYTES = 2 << 20
ROW_BITS, MADE_BITS = 13, 24
BLOCK_ROWS = 1 << ROW_BITS
SLICE_WINDOWS = 2_000_000
MIN_SLICES = 64
LOAD = 32
CODE_BOUNDS = tuple(1 << b for b in range(1, 48))  # a count below the first has code 0, and so on
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def dump(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_ZSTD) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def load(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(data) as r:
        return r.read_all().combine_chunks()


def dump_arrays(**arrays: np.ndarray) -> bytes:
    return dump(pa.table({k: pa.array(v) for k, v in arrays.items()}))


def load_arrays(data: bytes) -> dict[str, np.ndarray]:
    t = load(data)
    return {k: (t[k].chunk(0).to_numpy(zero_copy_only=False) if t[k].num_chunks else np.zeros(0, t[k].type.to_pandas_dtype())) for k in t.column_names}


def _gaps(sorted_positions: np.ndarray, counts: np.ndarray) -> bytes:
    gaps = np.diff(sorted_positions, prepend=np.uint64(0))
    more = (counts - 1).astype(np.uint8 if counts.max(initial=1) <= 256 else np.uint64)
    return dump_arrays(a=(gaps & np.uint64(255)).astype(np.uint8), b=((gaps >> np.uint64(8)) & np.uint64(255)).astype(np.uint8), c=(gaps >> np.uint64(16)).astype(np.uint64), more=more)


def _ungaps(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = load_arrays(data)
    return np.cumsum(x["a"].astype(np.uint64) | (x["b"].astype(np.uint64) << np.uint64(8)) | (x["c"] << np.uint64(16)), dtype=np.uint64), x["more"].astype(np.int64) + 1


def block_number(partition: int, made: int) -> int:
    if made >> MADE_BITS:
        raise OverflowError(f"more than {1 << MADE_BITS} blocks in one partition")
    return partition << MADE_BITS | made


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    pending: list[pa.Table] = []
    size = rows = made = 0

    def block() -> pa.RecordBatch:
        nonlocal pending, size, rows, made
        table = pa.concat_tables(pending).combine_chunks()
        out = pa.RecordBatch.from_pydict({
            "block_id": pa.array([block_number(part, made)], pa.int64()),
            "n_bytes": pa.array([size], pa.int64()),
            "payload": pa.array([dump(table)], pa.large_binary()).cast(pa.binary()),
        })
        pending, size, rows, made = [], 0, 0, made + 1
        return out

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table.set_column(1, "text", table["text"].cast(pa.large_string()))
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(table["text"]), 0), dtype=np.int64))
        at = 0
        while at < len(table):
            done = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + BLOCK_BYTES - size, side="right")))
            upto = min(upto, at + BLOCK_ROWS - rows, len(table))
            pending.append(table.slice(at, upto - at))
            size += int(ends[upto - 1]) - done
            rows += upto - at
            at = upto
            if size >= BLOCK_BYTES or rows >= BLOCK_ROWS or at < len(table):
                yield block()
    if pending:
        yield block()


def write_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(block_id, n_bytes, payload) with all rows of ``docs``; a payload has doc_id and text, and with ``carry`` the other columns as ``row``."""
    narrow = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    if carry:
        narrow.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"))
    return materialize(docs.select(*narrow).mapInArrow(_pack_blocks, "block_id long, n_bytes long, payload binary"))


def carried(docs: DataFrame, text_col: str) -> StructType:
    """The type of what `write_blocks` carries."""
    return StructType([f for f in docs.schema.fields if f.name != text_col])


def as_before(docs: DataFrame, rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Carried rows (row, text) with the columns of ``docs`` again."""
    return rows.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


Kernel = Callable[[pa.Table], np.ndarray]


class Sketch:
    """Counters for the windows that ``kernel`` finds in the blocks' documents."""

    def __init__(self, blocks: DataFrame, kernel: Kernel, bounds: tuple[int, ...] = CODE_BOUNDS, windows_per_byte: float = 0.2):
        self.blocks, self.kernel, self.bounds = blocks, kernel, np.array(bounds)
        total = (blocks.agg(F.sum("n_bytes")).first()[0] or 0) * windows_per_byte
        self.bits = min(40, max(16, int(np.ceil(np.log2(max(1.0, LOAD * total))))))
        self.slice_bits = int(np.ceil(np.log2(max(MIN_SLICES, total / SLICE_WINDOWS))))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "blocks"}  # tasks need the rest alone

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def slice_edges(self, sorted_positions: np.ndarray) -> np.ndarray:
        edges = np.arange((1 << self.slice_bits) + 1, dtype=np.uint64) << np.uint64(self.bits - self.slice_bits)
        return np.searchsorted(sorted_positions, edges)

    def codes(self) -> DataFrame:
        """(block_id, slice, codes): the answer of each slice's merge to each block."""
        me = self

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block_id, payload in zip(batch["block_id"].to_pylist(), batch["payload"], strict=True):
                    at, counts = np.unique(me.positions(me.kernel(load(payload.as_buffer()))), return_counts=True)
                    edges = me.slice_edges(at)
                    keys = np.flatnonzero(np.diff(edges))
                    yield pa.RecordBatch.from_pydict({
                        "slice": pa.array(keys.astype(np.int32)),
                        "block_id": pa.array(np.full(len(keys), block_id, dtype=np.int64)),
                        "payload": pa.array([_gaps(at[edges[k] : edges[k + 1]], counts[edges[k] : edges[k + 1]]) for k in keys], pa.binary()),
                    })

        def merge(rows: pa.Table) -> pa.Table:
            parts = [_ungaps(x.as_buffer()) for x in rows["payload"]]
            _, inverse = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([n for _, n in parts]))
            code = np.searchsorted(me.bounds, total, side="right").astype(np.uint8)[inverse]
            ends = np.cumsum([len(p) for p, _ in parts])
            return pa.table({
                "block_id": rows["block_id"],
                "kind": pa.array(np.zeros(len(parts), np.int32)),
                "slice": rows["slice"],
                "answer": pa.array([dump_arrays(code=code[e - len(p) : e]) for (p, _), e in zip(parts, ends, strict=True)], pa.binary()),
            })

        sent = self.blocks.select("block_id", "payload").mapInArrow(send, "slice int, block_id long, payload binary")
        return sent.groupBy("slice").applyInArrow(merge, "block_id long, kind int, slice int, answer binary")

    def decode(self, hashes: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
        """The code of each hash of a block, in the hashes' own order."""
        at, inverse = np.unique(self.positions(hashes), return_inverse=True)
        edges = self.slice_edges(at)
        codes = np.zeros(len(at), dtype=np.uint8)
        for k in np.flatnonzero(np.diff(edges)):
            codes[edges[k] : edges[k + 1]] = load_arrays(answers[int(k)])["code"]
        return codes[inverse]


def with_answers(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """(block_id, payload, answers): each block beside what it was answered."""
    rows = answers[0]
    for more in answers[1:]:
        rows = rows.unionByName(more)
    per_block = rows.groupBy("block_id").agg(F.collect_list(F.struct("kind", "slice", "answer")).alias("answers"))
    return blocks.select("block_id", "payload").join(per_block, "block_id", "left")


def answers_of(value) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for a in value.as_py() or []:
        out.setdefault(a["kind"], {})[a["slice"]] = a["answer"]
    return out
