"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text.  A text is parsed from
left to right into the longest phrases that occur in that text; the fewer phrases it needs,
the closer the languages.  The number of phrases is normalised by the text's length and the
logarithm of the automaton's training length, and the lowest one wins.  The alphabet holds every letter of
the training texts, of any script; all other letters are one that no language has.

Parsing follows the automaton's transitions, and where there is none the phrase ends and the
next one starts.  That is a complete transition table (or, for a large alphabet, a sorted list
of transitions that gives the same answers), so many pieces of texts advance together, one vector step a
character.  A long text is parsed in pieces of ``PIECE`` characters at once, as if a phrase
began at each; then every piece is parsed again from the state in which its predecessor
really ends, until both parses are in the same state, from where on they agree.  So texts are parsed whole,
and no phrase ends at a piece's border.

Training takes ``SAMPLE_DOCS`` different documents a language, those with the smallest text hashes
among all labelled rows (copies count once, and don't change the sample), ``SAMPLE_CHARS`` characters of
each.  The bound makes the model's size independent of the corpus.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every
text if nothing is labelled; null labels and null texts are no training rows; ties go to the
label that sorts first; with one language learned the score is 1; repeated rows are judged alike; a row
with a null doc_id is judged like others, is no training row and is not held out; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
SAMPLE_DOCS = 96
SAMPLE_CHARS = 600
PIECE = 2048
_TABLE_CELLS = 1 << 24
_LANES_BYTES = 8 << 20


def labelled_sample(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """The training texts of each language, at most ``sample_docs`` times ``sample_chars`` characters."""
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    learned = F.coalesce(learn, F.lit(False)) & F.col(f"`{id_col}`").isNotNull() & lang.isNotNull() & text.isNotNull()
    rows = docs.where(learned).select(lang.cast("string").alias("lang"), F.xxhash64(text).alias("h"), text.cast("string").alias("t"))
    # How many different texts there are, roughly, says below which hash the wanted ones lie;
    # so no more than some times the sample is shuffled, however many copies there are.
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return {}
    share = {g: min(1.0, 3 * sample_docs / max(1, n)) for g, n in sizes.items()}
    found: dict[str, list[int]] = {}
    while share:
        below = [(F.col("lang") == g) & (F.col("h") <= int(-(1 << 63) + part * ((1 << 64) - 1)) if part < 1 else F.col("lang") == g) for g, part in share.items()]
        keys = rows.where(functools.reduce(lambda a, b: a | b, below)).select("lang", "h").distinct().collect()
        for g in list(share):
            hashes = sorted(r.h for r in keys if r.lang == g)
            if len(hashes) >= sample_docs or share[g] >= 1:
                found[g] = hashes[:sample_docs]
                del share[g]
            else:
                share[g] = min(1.0, 4 * share[g])
    wanted = sorted({h for hashes in found.values() for h in hashes})
    texts = rows.where(F.col("h").isin(wanted)).select("lang", "h", F.substring("t", 1, sample_chars).alias("t")).groupBy("lang", "h").agg(F.min("t").alias("t")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: (r.lang, r.h)):
        if r.h in found[r.lang]:
            out.setdefault(r.lang, []).append(r.t)
    return out


class _Automaton:
    """The suffix automaton of a sequence of codes."""

    def __init__(self, codes: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        last = 0
        for c in codes:
            cur = self._add(self.longest[last] + 1, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][c]
                if self.longest[q] == self.longest[p] + 1:
                    self.link[cur] = q
                else:
                    twin = self._add(self.longest[p] + 1, dict(self.next[q]))
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur

    def _add(self, longest: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.longest.append(longest)
        return len(self.next) - 1

    def edges(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (k times the state, plus the letter), the next state of each, and the states in which a phrase of one letter stands.

        A last state stands for a phrase of one letter that the training text lacks.
        """
        alone = len(self.next)
        keys = np.array([s * k + c for s, edges in enumerate(self.next) for c in sorted(edges)], dtype=np.int64)
        to = np.array([edges[c] for edges in self.next for c in sorted(edges)], dtype=np.int64)
        fresh = np.full(k, alone, dtype=np.int64)
        fresh[list(self.next[0])] = list(self.next[0].values())
        return keys, to, fresh


class _Steps:
    """One step of many parses: from k times the state, plus the letter, to k times the next state and whether a phrase ended."""

    def __init__(self, automaton: _Automaton, k: int):
        self.k = k
        self.keys, self.to, self.fresh = automaton.edges(k)
        states = len(automaton.next) + 1
        self.table = None
        if states * k <= _TABLE_CELLS:
            out = np.full(states * k, -1, dtype=np.int64)
            out[self.keys] = self.to
            out = out.reshape(states, k)
            full = np.where(out >= 0, out * k, ~(self.fresh * k)[None, :])
            full[0] = self.fresh * k
            self.table = full.astype(np.int32).ravel()

    def __call__(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.table is not None:
            new = self.table[at]
            sign = new >> 31
            return new ^ sign, -sign
        place = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        goes = self.keys[place] == at
        letter = at % self.k
        state = np.where(goes, self.to[place], self.fresh[letter]) * self.k
        return state, (~goes & (at >= self.k)).astype(np.int64)


class Model:
    def __init__(self, sample: dict[str, list[str]]):
        letters = sorted({c for texts in sample.values() for t in texts for c in t.lower() if c.isalpha()})
        self.k = len(letters) + 2
        other = self.k - 1
        code = {c: i + 1 for i, c in enumerate(letters)}
        self.codes = np.zeros(0x110000, dtype=np.int32)
        for cp in itertools.chain(range(0xD800), range(0xE000, 0x110000)):
            c = chr(cp)
            if c.isalpha():
                lower = c.lower()
                self.codes[cp] = code.get(lower if len(lower) == 1 else lower[0], other)
        self.langs = sorted(sample)
        self.steps, self.log_length = [], []
        for lang in self.langs:
            seq, _ = self.encode([" ".join(sample[lang])])
            self.steps.append(_Steps(_Automaton(seq.tolist()), self.k))
            self.log_length.append(np.log2(max(2, len(seq))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letter codes of all texts, runs of other characters as one 0, and each text's end."""
        cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = self.codes[cps]
        ends = np.cumsum([len(t) for t in texts])
        keep = code > 0
        keep[1:] |= code[:-1] > 0
        first = np.concatenate([[0], ends[:-1]])
        keep[first[first < len(code)]] = code[first[first < len(code)]] > 0
        kept = np.concatenate([[0], np.cumsum(keep)])
        return code[keep], kept[ends]

    def phrases(self, code: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases of each text in each language."""
        begins = np.concatenate([[0], ends[:-1]])
        sizes = ends - begins
        per = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(ends)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        at = begins[owner] + nth * PIECE
        size = np.minimum(PIECE, ends[owner] - at)
        last = nth == per[owner] - 1
        out = np.zeros((len(ends), len(self.langs)), dtype=np.int64)
        step = max(1, _LANES_BYTES // PIECE)
        padded = np.concatenate([code, np.zeros(PIECE, code.dtype)])
        carried = np.zeros(len(self.langs), dtype=np.int64)  # the state in which the lanes before end
        for a in range(0, len(owner), step):
            lanes = np.arange(a, min(a + step, len(owner)))
            lanes = lanes[np.argsort(-size[lanes], kind="stable")]
            grid = np.ascontiguousarray(padded[at[lanes][:, None] + np.arange(int(size[lanes[0]]))].T)
            place = np.empty(len(lanes), dtype=np.int64)  # of each piece among the lanes
            place[lanes - a] = np.arange(len(lanes))
            for g, steps in enumerate(self.steps):
                count, end = _parse(steps, grid, size[lanes], place, nth[a : a + len(lanes)] > 0, int(carried[g]))
                count += last[lanes] & (end > 0)
                np.add.at(out[:, g], owner[lanes], count)
                carried[g] = end[place[-1]]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        code, ends = self.encode(texts)
        sizes = np.diff(np.concatenate([[0], ends]))
        cost = self.phrases(code, ends) * np.array(self.log_length) / np.maximum(sizes, 1)[:, None]
        best = np.argmin(cost, axis=1)
        ordered = np.sort(cost, axis=1)
        score = np.ones(len(texts)) if len(self.langs) == 1 else 1 - ordered[:, 0] / np.maximum(ordered[:, 1], 1e-12)
        names = [self.langs[b] if n else UNKNOWN for b, n in zip(best, sizes, strict=True)]
        return names, np.where(sizes > 0, np.clip(score, 0, 1), 0.0)


def _parse(steps: _Steps, grid: np.ndarray, size: np.ndarray, place: np.ndarray, goes_on: np.ndarray, carried: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrases ended, state at the end) of each lane; lanes come by falling size.

    ``place`` has the lane of each piece, in the order of the texts, and ``goes_on`` says if the piece
    continues the one before it; ``carried`` is the state before the first piece.
    """
    n = len(size)
    longest = len(grid)
    alive = n - np.searchsorted(size[::-1], np.arange(longest), side="right")
    state, count = np.zeros(n, dtype=np.int32 if steps.table is not None else np.int64), np.zeros(n, dtype=np.int64)
    pieces = np.flatnonzero(goes_on)
    follow = place[pieces]  # the lanes that continue another piece
    width = int(follow.max(initial=-1)) + 1
    states, counts = np.zeros((longest, width), dtype=state.dtype), np.zeros((longest, width), dtype=np.int32)
    for j in range(longest):
        m = alive[j]
        state[:m], ended = steps(state[:m] + grid[j, :m])
        count[:m] += ended
        w = min(m, width)
        if w:
            states[j, :w], counts[j, :w] = state[:w], count[:w]
    if not len(follow):
        return count, state
    before = np.where(pieces > 0, place[np.maximum(pieces - 1, 0)], -1)
    entered = np.zeros(len(follow), dtype=state.dtype)  # as the parse so far began
    while True:
        entry = np.where(before >= 0, state[before], carried).astype(state.dtype)
        redo = np.flatnonzero(entry != entered)
        if not len(redo):
            return count, state
        entered[redo] = entry[redo]
        lane, s, ended_now = follow[redo], entry[redo], np.zeros(len(redo), dtype=np.int64)
        for j in range(longest):
            inside = j < size[lane]
            if not inside.all():  # these never met: their end is another one
                state[lane[~inside]], count[lane[~inside]] = s[~inside], ended_now[~inside]
                lane, s, ended_now = lane[inside], s[inside], ended_now[inside]
            if not len(lane):
                break
            s, ended = steps(s + grid[j, lane])
            ended_now = ended_now + ended
            met = s == states[j, lane]
            gain = ended_now - counts[j, lane]
            if met.any():  # from here on the parse is the same; what it counts shifts
                for x, more in zip(lane[met].tolist(), gain[met].tolist(), strict=True):
                    counts[j:, x] += more
                    count[x] += more
                lane, s, ended_now = lane[~met], s[~met], ended_now[~met]
            states[j, lane], counts[j, lane] = s, ended_now
        if len(lane):
            state[lane], count[lane] = s, ended_now


_models: dict[str, Model] = {}


def predict_language(docs: DataFrame, sample: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(sample)  # bounded by the sample's size
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _models.get(name)
        if model is None:
            _models.clear()
            model = _models[name] = Model(shared.value)
        for batch in batches:
            names: list[str] = []
            scores: list[np.ndarray] = []
            held: list[str] = []
            size = 0
            for i, x in enumerate(batch["text"]):
                held.append(x.as_py() or "")
                size += len(held[-1])
                if size >= _LANES_BYTES or i + 1 == batch.num_rows:
                    n, s = model.predict(held)
                    names += n
                    scores.append(s)
                    held, size = [], 0
            if names:
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "lang_pred": pa.array(names, pa.string()), "score": pa.array(np.concatenate(scores))})

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that training never sees: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))
