"""BPE encoding and decoding.

Encoding: an Aho-Corasick automaton over the vocabulary finds every token that matches
inside a word.  From the left, the longest match that is compatible with the token before
it is taken; where none fits, the encoder goes back one token and marks the position as a dead end,
so each position fails once at most and the work is linear.  Two tokens are compatible if
the merges that make them could not have joined across their border first, which is looked
up in a memoised pair table (kept up to a fixed number).  The result is exactly that of applying the merges in
order.  Encoded words are cached up to a fixed number.

Decoding gathers from one byte string through a table of token offsets.

Defined cases: a null text is empty and has no tokens; added tokens inside a text (such as
an end-of-text string) become their own ids, as the tokenizers library does by default;
rows, ties and repeated rows are independent of each other; an empty table gives an empty
result; extra columns are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

CACHED_WORDS = 1_000_000
CACHED_PAIRS = 1_000_000
_END = "</w>"
_LAST = 0x1000  # added to a byte's code point where the byte ends a word


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


_SYMBOLS = {b: s for b, s in enumerate(_byte_symbols())}

# The split pattern of the word vocabulary for texts whose code points all lie below U+0250;
# other texts are normalised and split by the tokenizers library, whose Unicode tables are
# the ones to match.
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
_LATIN_L = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_LATIN_N = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = r"\t-\r \x85\xa0"
# The branches differ in their first character, but for an apostrophe, so letters may come first.
_LATIN = re.compile(rf"[{_LATIN_L}]+|[{_LATIN_N}]|{_SUFFIXES}|[^{_SPACE}{_LATIN_L}{_LATIN_N}]+")
_ASCII = re.compile(rf"[a-z]+|[0-9]|{_SUFFIXES}|[^\t-\r a-z0-9]+")
_BEYOND = re.compile(r"[^\x00-ɏ]")


class Splitter:
    """Normalised text in the pieces that a vocabulary encodes one by one."""

    def __init__(self, path: str):
        own = Tokenizer.from_file(path)
        self.normalize = own.normalizer.normalize_str
        self.split = pre_tokenizers.Split(Regex(rf"{_SUFFIXES}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+"), "removed", invert=True).pre_tokenize_str

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return self.normalize(text) if _BEYOND.search(text) else unicodedata.normalize("NFC", text).lower()

    def words(self, normal: str) -> list[str]:
        if normal.isascii():
            return _ASCII.findall(normal)
        return [w for w, _ in self.split(normal)] if _BEYOND.search(normal) else _LATIN.findall(normal)


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != _END:
            raise ValueError(f"{path} is not a BPE vocabulary with word ends")
        self.ids: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.added.values()]) + 1
        names = [""] * size
        for name, i in [*self.ids.items(), *self.added.items()]:
            names[i] = name
        self.lengths = [0] * size
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.joined: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            inner = self._inner(name)
            self.lengths[i] = len(inner)
            self.automaton.add_word(inner, i)
        self.automaton.make_automaton()
        newest = -1
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            if max(x, y) >= z or self.parts[z] == (z, z) and z <= newest:
                raise ValueError(f"{path} does not number its tokens in the order of its merges")
            newest = max(newest, z)
            if self.joined.setdefault(x << 32 | y, z) == z and self.parts[z] == (z, z):
                self.parts[z] = (x, y)
        self.compatible: dict[int, bool] = {}
        blobs = [n.encode() + b" " for n in names]
        self.blob = np.frombuffer(b"".join(blobs), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])

    @staticmethod
    def _inner(name: str) -> str:
        if name.endswith(_END) and len(name) > len(_END):
            name = name[: -len(_END)]
            return name[:-1] + chr(ord(name[-1]) + _LAST)
        return name

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side."""
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= CACHED_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._fits(left, right)
        return known

    def _fits(self, a: int, b: int) -> bool:
        # Undo the later of the two tokens' merges, step by step; at each step the border's
        # pair must not have a merge of its own that would have come before the undone one.
        bound = 1 << 62
        while True:
            z = self.joined.get(a << 32 | b)
            if z is not None and z < bound:
                return False
            if a > b:
                bound, inner = a, self.parts[a][1]
                if inner == a:
                    return True
                a = inner
            else:
                bound, inner = b + 1, self.parts[b][0]
                if inner != b:
                    b = inner
                    continue
                bound, inner = a, self.parts[a][1]
                if inner == a:
                    return True
                a = inner

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode()
        text = raw.decode("latin-1").translate(_SYMBOLS)
        text = text[:-1] + chr(ord(text[-1]) + _LAST)
        n, lengths, fits = len(text), self.lengths, self.fits
        matches: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(text):
            matches[end - lengths[token] + 1].append(token)
        dead = bytearray(n + 1)
        tokens: list[int] = []
        pos = 0
        while pos < n:
            before = tokens[-1] if tokens else None
            for token in reversed(matches[pos]):
                if not dead[pos + lengths[token]] and (before is None or fits(before, token)):
                    tokens.append(token)
                    pos += lengths[token]
                    break
            else:
                if before is None:
                    raise ValueError(f"the vocabulary has no tokens for {word[:50]!r}")
                dead[pos] = 1
                pos -= lengths[tokens.pop()]
        return tokens

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings joined by one space, as a tokenizer without a decoder does."""
        if not len(ids):
            return b""
        lens = np.diff(self.offsets)[ids]
        ends = np.cumsum(lens)
        at = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - lens), lens)
        return self.blob[at[:-1]].tobytes()


def _pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder(dict):
    """Texts to ids as little-endian unsigned 32-bit integers.

    No piece reaches over white space, so a text is cut at its ASCII blanks, and the dict caches what stands between
    them, in UTF-8: a word, or several pieces such as a word and a full stop.
    """

    def __init__(self, path: str, added: dict[str, int], encode_word):
        super().__init__()
        self.splitter = Splitter(path)
        self.added, self.encode_word = added, encode_word
        self.cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def __missing__(self, run: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        words = self.splitter.words(run.decode())
        if len(words) == 1 and len(words[0].encode()) == len(run):
            out = _pack_ids(self.encode_word(words[0]))
        else:
            out = b"".join([self[w.encode()] for w in words])
        if len(run) <= 64:
            self[run] = out
        return out

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.splitter.normal(text).encode().split()))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not any(a in text for a in self.added):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.added[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])


_loaded: dict[str, tuple[Vocabulary, Encoder]] = {}


def backtracking(path: str) -> tuple[Vocabulary, Encoder]:
    """The vocabulary of a file and its encoder, loaded once in each process."""
    if path not in _loaded:
        v = Vocabulary(path)
        _loaded[path] = (v, Encoder(path, v.added, v.encode_word))
    return _loaded[path]


def by_library(path: str) -> Encoder:
    """The same, but the tokenizers library's model merges each word."""
    with open(path, encoding="utf-8") as f:
        added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    merge = Tokenizer.from_file(path).model.tokenize
    return Encoder(path, added, lambda w: [t.id for t in merge(w.encode().decode("latin-1").translate(_SYMBOLS))])


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (text) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, encoder = backtracking(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                ids = [encoder.encode(x.as_py()) for x in piece["text"]]
                decoded = [vocabulary.decode(np.frombuffer(x, dtype="<u4")) for x in ids]
                yield pa.RecordBatch.from_pydict({"doc_id": piece["doc_id"], "ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.binary()).cast(pa.string())})

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, made where they are encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, encoder = backtracking(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                ids = [encoder.encode(x.as_py()) for x in piece["text"]]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece["doc_id"],
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array(map(sha, ids), pa.string()),
                    "decoded_sha256": pa.array([sha(vocabulary.decode(np.frombuffer(x, dtype="<u4"))) for x in ids], pa.string()),
                })

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
