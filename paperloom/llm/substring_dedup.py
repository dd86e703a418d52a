"""Substring dedup by a count-min prefilter.

Pass 1 adds the 13-word windows of all documents to a count-min sketch whose partial
sketches are merged slice by slice (`_blocks.Sketch`); it can only overestimate, so a
window that it counts once is unique and is done with.  Pass 2 groups the windows that
are estimated as repeated exactly, by their word sequence: a 64-bit hash, checked by an
independent 32-bit one.  A word is removed if a window over it also starts in a document with
a smaller doc_id.

Defined cases: a null or empty text has no words; a null doc_id counts as larger than all
others; rows with the same doc_id don't remove each other's words, and each row is cut by
its own text; texts of any length are taken whole; an empty table gives an empty result; other
columns are ignored (`repeated_words`) or kept as they are (`cut_documents`), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from paperloom.llm._blocks import Sketch, answers_of, carried, dump_arrays, load, load_arrays, with_answers, write_blocks
from paperloom.llm._session import materialize
from paperloom.llm._words import buffers, mix, window_hashes, word_hashes, word_spans

WINDOW = 13
_LAST = np.iinfo(np.int64).max


class _Text:
    """A block's documents, their words and the windows that lie in one document."""

    def __init__(self, table: pa.Table, k: int):
        ids = table["doc_id"].combine_chunks()
        self.null_id = np.asarray(ids.is_null())
        self.doc_id = np.asarray(ids.fill_null(_LAST), dtype=np.int64)
        self.data, self.offs = buffers(table["text"])
        self.starts, self.ends, self.first = word_spans(self.data, self.offs)
        self.words = word_hashes(self.data, self.starts, self.ends)
        counts = np.diff(self.first)
        doc = np.repeat(np.arange(len(counts)), np.maximum(counts - k + 1, 0))
        inner = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(counts - k + 1, 0)) - np.maximum(counts - k + 1, 0), np.maximum(counts - k + 1, 0))
        self.window_at = self.first[doc] + inner
        self.window_doc = self.doc_id[doc]
        self.hashes = window_hashes(self.words, k)[self.window_at]

    def checks(self, k: int) -> np.ndarray:
        other = window_hashes(mix(self.words ^ np.uint64(0xA5A5A5A55A5A5A5A)), k)
        return (other[self.window_at] >> np.uint64(32)).astype(np.uint32)


def _entries(text: _Text, codes: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The block's distinct windows among those estimated as repeated, sorted, with each one's smallest doc_id."""
    kept = np.flatnonzero(codes)
    h, c, d = text.hashes[kept], text.checks(k)[kept], text.window_doc[kept]
    order = np.lexsort((c, h))
    h, c, d = h[order], c[order], d[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    heads = np.flatnonzero(new)
    group = np.empty(len(h), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(d, heads) if len(heads) else d
    return kept, group, h[heads], c[heads], least


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and text.

    ``text`` is the text without the removed words; each kept word keeps the white space
    after it.  ``kept_sha256`` is of the kept words joined by one space.
    """
    return _cut(write_blocks(docs, id_col, text_col), window, None)


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(columns of ``docs`` as the struct ``row``, text, n_words, n_removed): each row with its cut text; untouched null texts stay null."""
    return _cut(write_blocks(docs, id_col, text_col, carry=True), window, carried(docs, text_col))


def _cut(blocks: DataFrame, window: int, row: StructType | None) -> DataFrame:
    k = window
    # whether a window may stand twice is all that the prefilter has to say
    sketch = Sketch(blocks, lambda table: _Text(table, k).hashes, bounds=(2,))
    estimated = materialize(sketch.codes())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, payload, answers in zip(batch["block_id"].to_pylist(), batch["payload"], batch["answers"], strict=True):
                text = _Text(load(payload.as_buffer()), k)
                codes = sketch.decode(text.hashes, answers_of(answers).get(0, {}))
                _, _, h, c, d = _entries(text, codes, k)
                edges = sketch.slice_edges(sketch.positions(h))
                keys = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array(keys.astype(np.int32)),
                    "block_id": pa.array(np.full(len(keys), block_id, dtype=np.int64)),
                    "payload": pa.array([dump_arrays(h=h[a:b], c=c[a:b], d=d[a:b]) for a, b in zip(edges[keys], edges[keys + 1], strict=True)], pa.binary()),
                })

    def group(rows: pa.Table) -> pa.Table:
        parts = [load_arrays(x.as_buffer()) for x in rows["payload"]]
        h, c, d = (np.concatenate([p[x] for p in parts]) for x in "hcd")
        order = np.lexsort((c, h))
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
        least = np.minimum.reduceat(d[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        earlier = np.empty(len(h), dtype=bool)
        earlier[order] = least < d[order]
        ends = np.cumsum([len(p["h"]) for p in parts])
        return pa.table({
            "block_id": rows["block_id"],
            "kind": pa.array(np.ones(len(parts), np.int32)),
            "slice": rows["slice"],
            "answer": pa.array([np.packbits(earlier[e - len(p["h"]) : e]).tobytes() for p, e in zip(parts, ends, strict=True)], pa.binary()),
        })

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, answers in zip(batch["payload"], batch["answers"], strict=True):
                table = load(payload.as_buffer())
                text, by_kind = _Text(table, k), answers_of(answers)
                kept, member, h, _, least = _entries(text, sketch.decode(text.hashes, by_kind.get(0, {})), k)
                edges = sketch.slice_edges(sketch.positions(h))
                earlier = np.zeros(len(h), dtype=bool)
                for s in np.flatnonzero(np.diff(edges)):
                    n = int(edges[s + 1] - edges[s])
                    earlier[edges[s] : edges[s + 1]] = np.unpackbits(np.frombuffer(by_kind[1][int(s)], np.uint8), count=n)
                doc = text.window_doc[kept]
                gone = text.window_at[kept[earlier[member] | (least[member] < doc)]] if len(kept) else kept
                cover = np.zeros(len(text.starts) + k + 1, dtype=np.int32)
                np.add.at(cover, gone, 1)
                np.add.at(cover, gone + k, -1)
                out = _results(text, np.cumsum(cover)[: len(text.starts)] > 0)
                if row is not None:
                    whole = pa.array(out["text"].to_pylist(), pa.string(), mask=np.asarray(table["text"].combine_chunks().is_null()))
                    out = pa.RecordBatch.from_pydict({"row": table["row"].combine_chunks(), "text": whole, "n_words": out["n_words"], "n_removed": out["n_removed"]})
                yield out

    exact = with_answers(blocks, estimated).mapInArrow(send, "slice int, block_id long, payload binary")
    grouped = exact.groupBy("slice").applyInArrow(group, "block_id long, kind int, slice int, answer binary")
    shape = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"
    if row is not None:
        shape = StructType([StructField("row", row), StructField("text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    return with_answers(blocks, estimated, grouped).mapInArrow(cut, shape)


def _results(text: _Text, removed: np.ndarray) -> pa.RecordBatch:
    raw, first = text.data.tobytes(), text.first
    n_words = np.diff(first)
    lost = np.concatenate([[0], np.cumsum(removed)])
    n_removed = lost[first[1:]] - lost[first[:-1]]
    shas, texts = [], []
    for i in range(len(n_words)):
        a, b, lo, hi = first[i], first[i + 1], int(text.offs[i]), int(text.offs[i + 1])
        if not n_removed[i]:
            whole = raw[lo:hi]
            texts.append(whole.decode())
            shas.append(hashlib.sha256(b" ".join(whole.split())).hexdigest())
            continue
        keep = ~removed[a:b]
        # a run of kept words goes from its first word to the start of the next removed one
        edge = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
        starts = np.append(text.starts[a:b], hi)
        runs = [raw[starts[x] : starts[y]] for x, y in zip(edge[::2], edge[1::2], strict=True)]
        if keep.size and keep[0]:
            runs[0] = raw[lo : starts[0]] + runs[0]
        whole = b"".join(runs)
        texts.append(whole.decode())
        shas.append(hashlib.sha256(b" ".join(whole.split())).hexdigest())
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(text.doc_id, pa.int64(), mask=text.null_id),
        "n_words": pa.array(n_words.astype(np.int64)),
        "n_removed": pa.array(n_removed.astype(np.int64)),
        "kept_sha256": pa.array(shas, pa.string()),
        "text": pa.array(texts, pa.string()),
    })
