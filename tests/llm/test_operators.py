"""The operators against brute force on a fixture with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm import _blocks, bpe, chat_format, html_extract, language_id, line_dedup, ngram_join, packing, quality_rules, substring_dedup, topk_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, h long, n int, uid long"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def make_rows():
    r = random.Random(7)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 8))) for _ in range(400)]
    said = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared, line, out = said(60), "this very line stands on every site here", []
    for i in range(60):
        out.append(f"{line}\n{said(80)}\n{said(40)}.")
    base = said(120)
    for k in range(20):
        t = base.split()
        for _ in range(k % 4):
            t[r.randrange(len(t))] = "edit" + said(1)
        out.append(" ".join(t))
    out += [said(100) + " " + shared + " " + said(90), "x " + shared, shared, base, base, "", None, "a", "one two three", "ONE two\tthree", said(9000), "#*$ " * 80, "same word " * 80, "É à b\x0bc ~ <|endoftext|> 한글"]
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 13}" if i % 17 else None, len(t or ""), "x", i, 1, 5) for i, t in enumerate(out)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Repeated rows and null ids."""
    return spark.createDataFrame([*rows[:5], *rows[:5], (None, "text of no id " * 20, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language_id(spark, docs, odd, empty):
    r = random.Random(1)
    talk = {"aa": ["lo", "ra", "min", "tu"], "bb": ["zek", "wyx", "qu", "hop"]}
    rows = [(i, " ".join("".join(r.choice(talk[g]) for _ in range(3)) for _ in range(60)), g) for i, g in enumerate(["aa", "bb"] * 40)]
    df = spark.createDataFrame([*rows, (900, "", "aa"), (901, None, "aa"), (902, "12 3!", None)], "doc_id long, text string, lang string")
    sample = language_id.labelled_sample(df, ~language_id.held_out())
    got = {x.doc_id: x for x in language_id.predict_language(df, sample).collect()}
    assert all(got[i].lang_pred == g and 0 <= got[i].score <= 1 for i, _, g in rows)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    for other in (odd, empty):
        assert language_id.predict_language(other, sample).count() == other.count()
    assert language_id.labelled_sample(empty, F.lit(True)) == {}
    assert {x.lang_pred for x in language_id.predict_language(docs, {}).collect()} == {"und"}


def test_language_sample_does_not_depend_on_copies(spark):
    texts = [f"text {'abcdefghij'[i % 10] * (i // 10 + 1)} number" for i in range(300)]
    rows = [(i, t, "aa") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string"
    once = language_id.labelled_sample(spark.createDataFrame(rows, schema), F.lit(True))
    assert len(once["aa"]) == language_id.SAMPLE_DOCS
    again = [(1000 + i, once["aa"][0], "aa") for i in range(600)] + [(None, "no id", "aa"), (5000, "few", "bb")]
    more = language_id.labelled_sample(spark.createDataFrame(rows + again, schema), F.lit(True))
    assert more == once | {"bb": ["few"]}


def test_language_winner_and_score(spark):
    """The winner and score by a plain longest-match parse; a script of many letters keeps its letters apart."""
    r = random.Random(4)
    talk = {"aa": "abcde ", "ab": "abcdf ", "ko": "".join(map(chr, range(0xAC00, 0xAC00 + 400))) + " " * 80, "kp": "".join(map(chr, range(0xAC00 + 200, 0xAC00 + 600))) + " " * 80}
    sample = {g: ["".join(r.choices(letters, k=500)) for _ in range(4)] for g, letters in talk.items()}
    texts = ["".join(r.choices(talk[g], k=n)) for g in talk for n in (3, 40, 300, 5000)] + ["İ ŝ 漢字", "12", ""]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "abc")], "doc_id long, text string")
    got = {x.doc_id: x for x in language_id.predict_language(df, sample).collect()}
    letters = {c for ts in sample.values() for t in ts for c in t.lower() if c.isalpha()}

    def coded(t):
        t = "".join((c.lower()[0] if c.lower()[0] in letters else "?") if c.isalpha() else " " for c in t)
        return re.sub(" +", " ", t).lstrip(" ")

    for i, t in enumerate(texts):
        if not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        c, cost = coded(t), {}
        for g in sorted(sample):
            hay, n, at = coded(" ".join(sample[g])).replace("?", "!"), 0, 0
            while at < len(c):
                k = 1
                while at + k < len(c) and c[at : at + k + 1] in hay:
                    k += 1
                n, at = n + 1, at + k
            cost[g] = n * np.log2(len(hay)) / len(c)
        best, second = sorted(cost.values())[:2]
        assert got[i].lang_pred == min(cost, key=lambda g: (cost[g], g)) and abs(got[i].score - (1 - best / second)) < 1e-9


@pytest.mark.parametrize("cells", [1 << 24, 10])
@pytest.mark.parametrize("piece", [5, 64, 2048])
def test_phrases_are_longest_matches(monkeypatch, cells, piece):
    monkeypatch.setattr(language_id, "_TABLE_CELLS", cells)
    monkeypatch.setattr(language_id, "PIECE", piece)
    monkeypatch.setattr(language_id, "_LANES_BYTES", 3 * piece)
    r = random.Random(3)
    train = {"x": ["abracadabra and more of that"], "y": ["ababababab cdcdcd " + "".join(r.choice("abcd ") for _ in range(300))]}
    model = language_id.Model(train)
    texts = ["abrand that moreover cadabra zzz" * 9, "", "ab" * 100, "a", "".join(r.choice("abcdefz ") for _ in range(333)), "1 2", "abcd" * 77 + "zz"]
    as_text = lambda codes: "".join(chr(1000 + c) for c in codes)
    got = model.phrases(*model.encode(texts))
    for i, t in enumerate(texts):
        for g, lang in enumerate("xy"):
            code, hay = as_text(model.encode([t])[0]), as_text(model.encode(train[lang])[0])
            count = at = 0
            while at < len(code):
                n = 1
                while at + n < len(code) and code[at : at + n + 1] in hay:
                    n += 1
                count, at = count + 1, at + n
            assert got[i, g] == count


def test_line_dedup(spark, rows, docs, odd, empty):
    got = {x.doc_id: x for x in line_dedup.dedup_lines(docs).collect()}
    where, first = collections.defaultdict(set), {}
    for i, t, _, s, *_ in rows:
        for p, x in enumerate((t or "").split("\n")):
            k = x.strip(" \t\n\x0b\x0c\r")
            if k:
                first.setdefault(k, (i, p))
                where[k] |= {s} - {None}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        gone = [p for p, x in enumerate(lines) if len(where[x.strip(" \t\n\x0b\x0c\r")]) >= 10 and first[x.strip(" \t\n\x0b\x0c\r")] != (i, p)]
        assert (got[i].n_lines, got[i].n_lines_removed) == (len(lines), len(gone))
        assert (got[i].text or "") == "\n".join(x for p, x in enumerate(lines) if p not in gone)
    assert sum(x.n_lines_removed for x in got.values()) > 30
    kept = line_dedup.dedup_lines(odd)
    assert kept.columns == [*odd.columns, "n_lines", "n_lines_removed"]
    assert sorted(map(str, kept.select(*odd.columns).collect())) == sorted(map(str, odd.collect())) and line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_judges_rows_of_one_id_each_by_its_text(spark):
    rows = [(i, f"own {i}\nsaid by every site", f"s{i}", 0) for i in range(12)] + [(5, "other words\nsaid by every site\nlast", "s1", 1), (5, "own 5\nsaid by every site", "s9", 2), (None, "no id\nsaid by every site", "s2", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines long")
    got = sorted((x.doc_id if x.doc_id is not None else 99, x.text, x.n_lines, x.n_lines_removed) for x in line_dedup.dedup_lines(df).collect())
    want = [(i, f"own {i}" + ("\nsaid by every site" if i == 0 else ""), 2, int(i > 0)) for i in range(12)]
    assert got == sorted([*want, (5, "other words\nlast", 3, 1), (5, "own 5", 2, 1), (99, "no id", 2, 1)])


PAGES = [
    (1, "<html><head><title>t</title></head><body><nav>a b c</nav><article><h1>Head &amp; line</h1><p>One  two<p>three <b>four</b>.<div class='ad'>buy it now please</div><p>five six</article><footer>f g</footer>", "Head & line\n\nOne two\n\nthree four.\n\nfive six"),
    (2, "<body><article><p>only this one here</p><form>name it</form><div id=comments><p>no no no</p></div></article><aside>side words</aside>", "only this one here"),
    (3, "", ""),
    (4, None, ""),
    (5, "<article><p>never closed <!-- x", "never closed"),
]


def test_html_extraction(spark):
    df = spark.createDataFrame([(i, "u", h, 1) for i, h, _ in PAGES] + [(None, None, "<p>no name", 2)], "page_id long, url string, html string, text int").withColumn("n_chars", F.lit(-1))
    got = {x.page_id: x for x in html_extract.extract_text(df, [h for _, h, _ in PAGES if h]).collect()}
    for i, _, want in [*PAGES, (None, None, "no name")]:
        assert (got[i].text, got[i].n_chars) == (want, len(want))
    assert got[None].url is None
    assert html_extract.extract_text(df.limit(0), []).count() == 0 and html_extract.labelled_pages(df.limit(0)) == []
    assert {x.text for x in html_extract.extract_text(df.where("page_id = 4"), []).collect()} == {""}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><div class="post-header"><h1>The title</h1></div><p>body of the text here</article>', "The title\n\nbody of the text here"),
        ('<article><p>body of the text</p><div class="related-work"><p>earlier papers</p></div></article>', "body of the text\n\nearlier papers"),
        ("<article><p>energy <math><mi>E</mi></math> is kept</p></article>", "energy E is kept"),
        ('<div class="layout has-sidebar"><article><p>body of the text</article></div>', "body of the text"),
        ("<form><nav>a b</nav><article><p>one two three</article></form>", "one two three"),
        ('<article><p>said before</p><div class="comments-section"><p>a reader</p></div><div id="ad-slot">buy</div><form><label>name</label></form></article>', "said before"),
    ],
)
def test_html_parts_of_an_article(page, want):
    assert html_extract.Costs([h for _, h, _ in PAGES if h]).extract(page) == want


def test_html_region_is_the_best_contiguous_one():
    r = random.Random(9)
    costs = html_extract.Costs([])
    for _ in range(200):
        parts = [r.choice(["<p>", "</p>", "<b>", "</b>", "<nav>x y</nav>", "w ", "w w w ", "<br>"]) for _ in range(r.randrange(1, 25))]
        costs.cost = {"p": r.choice([0.5, 1.0, 3.0]), "b": 1.5, "br": 2.0, "nav": 4.0}
        page = html_extract.Page("".join(parts), {})
        gain = [0.0 if page.excluded[e] else float(n) if tag is None else -costs.cost.get(tag, costs.default) for tag, _, n, _, e in page.items]
        best = max((sum(gain[a:b]) for a in range(len(gain)) for b in range(a, len(gain) + 1)), default=0.0)
        a, b = costs.region(page)
        assert abs(sum(gain[a:b]) - best) < 1e-9


def test_html_of_a_million_unclosed_tags():
    for tags in ("<b>" * 1_000_000, "<b></i>" * 300_000, "<div class='x y'>" * 100_000):
        assert html_extract.Costs([]).extract(tags + "so many words that they outweigh it " * 60000).startswith("so many words")


@pytest.mark.parametrize("window", [64, 4096])
def test_packing(spark, rows, docs, odd, empty, window):
    got = packing.pack(docs, PATH, window=window).collect()
    t = Tokenizer.from_file(PATH)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for x in got:
        pieces[x.doc_id].append(x)
        sequences[x.sequence_id].append(x)
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for x in sorted(pieces[i], key=lambda x: x.start):
            assert (x.start, x.doc_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + x.length].tobytes()))
            at += x.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for x in sorted(s, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at == window or at & (at - 1) == 0
    assert packing.pack(empty, PATH).count() == 0
    assert packing.pack(odd, PATH).where("start = 0").count() == odd.count()


def test_packing_fills_windows_with_neighbours_of_a_large_group():
    r = np.random.default_rng(1)
    hot, odd = np.arange(3, 23), [r.integers(100, 9000, 20) for _ in range(3000)]
    ids = [x for pair in zip([hot] * 3000, odd, strict=True) for x in pair]
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=9000)
    shard = packing._Shard(ids, 2000, np.log1p((len(ids) - df + 0.5) / (df + 0.5)))
    first = next(shard.sequences())
    assert [d % 2 for d, _, _ in first] == [0] * 100


def _idf(ids, vocabulary):
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=vocabulary)
    return np.log1p((len(ids) - df + 0.5) / (df + 0.5))


@pytest.mark.parametrize("dense", [0, 8, 10**9])
def test_packing_neighbours_are_those_of_a_full_scan(monkeypatch, dense):
    monkeypatch.setattr(packing, "DENSE", dense)
    r = np.random.default_rng(3)
    ids = [(r.zipf(1.4, r.integers(1, 120)) % 700).astype(np.int64) for _ in range(250)]
    idf, window = _idf(ids, 700), 100
    shard = packing._Shard(ids, window, idf)
    rest = [x[len(x) // window * window :] for x in ids]
    count = [collections.Counter(x.tolist()) for x in rest]
    live = [len(x) for x in rest if len(x)]
    used = set()
    for seed in r.permutation([i for i, x in enumerate(rest) if len(x)])[:150].tolist():
        used.add(seed)
        shard.take(seed, window)
        scores = {}
        for i, c in enumerate(count):
            if i not in used and c:
                k = packing.K1 * (1 - packing.B + packing.B * len(rest[i]) / np.mean(live))
                scores[i] = sum(idf[t] * c[t] * (packing.K1 + 1) / (c[t] + k) for t in count[seed] if t in c)
        got = list(shard.neighbours(seed))
        assert sorted(got) == sorted(i for i, s in scores.items() if s > 0)
        assert all(scores[a] >= scores[b] - 1e-3 for a, b in zip(got, got[1:], strict=False))


def test_packing_keeps_vocabularies_apart():
    r = np.random.default_rng(5)
    ids = [r.integers(3, 400, 20) + 500 * (i % 2) for i in range(400)]
    rows = list(packing._Shard(ids, 2000, _idf(ids, 1000)).sequences())
    for row in rows[:1] + rows[2:3]:
        share = sum(n for d, _, n in row if d % 2 == row[0][0] % 2) / 2000
        assert share >= 0.95


def test_packing_routes_documents_with_common_terms_together(spark, monkeypatch):
    """Three topics, dealt over many partitions, in shards of a sixth of the table; windows hold one topic, and only one partial window is left for each partition."""
    monkeypatch.setattr(packing, "SHARD_TOKENS", 6000)
    r = random.Random(2)
    topics = [[f"{a}{b}{c}" for b in "bcdfg" for c in "aeiou"] for a in ("zor", "pli", "kuv")]
    rows = [(i, " ".join(r.choices(topics[i % 3], k=60)) + f" only{i}") for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    monkeypatch.setattr(packing, "_Shard", packing._Shard)
    got = packing.pack(df, PATH, window=512).collect()
    by = collections.defaultdict(collections.Counter)
    for x in got:
        by[x.sequence_id][x.doc_id % 3] += x.length
    full = [c for c in by.values() if sum(c.values()) == 512]
    assert len(full) > 40 and sum(max(c.values()) for c in full) >= 0.9 * sum(sum(c.values()) for c in full)


def shingles(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components_of(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_join(spark, rows, docs, odd, empty, monkeypatch):
    want = components_of(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.similar_components(docs).collect()} == want
    monkeypatch.setattr(ngram_join, "HOT", 1)
    monkeypatch.setattr(ngram_join, "HOT_BLOCK", 3)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.similar_components(docs).collect()} == want
    assert ngram_join.similar_components(odd).count() == odd.count() and ngram_join.similar_components(empty).count() == 0


def test_numbers_of_blocks_fit_a_large_table():
    block = _blocks.block_number(60_000_000, (1 << 24) - 1)
    assert int(ngram_join._uids(block, 1 << 13)[-1].as_py()) < 1 << 63
    assert ngram_join._uids(_blocks.block_number(300_000, 1), 1)[0].as_py() > ngram_join._uids(_blocks.block_number(299_999, 5000), 1 << 13)[-1].as_py()
    with pytest.raises(OverflowError):
        _blocks.block_number(1, 1 << 24)


def test_sketch_sends_a_window_once_a_block(spark):
    """A window that all documents have is one entry for each block, with its count."""
    at, counts = np.unique(np.array([7] * 5000 + [9, 1 << 40], dtype=np.uint64), return_counts=True)
    data = _blocks._gaps(at, counts)
    assert [x.tolist() for x in _blocks._ungaps(data)] == [[7, 9, 1 << 40], [5000, 1, 1]] and len(data) < 2000
    docs = spark.createDataFrame([(i, f"one and the same passage of words that all have {'x' * (i % 7)}") for i in range(3000)], "doc_id long, text string").repartition(4)
    blocks = _blocks.write_blocks(docs)
    sketch = _blocks.Sketch(blocks, lambda table: ngram_join._flat(ngram_join._shingle_sets(table, 5)))
    answers = sketch.codes().collect()
    n = sum(len(_blocks.load_arrays(x.answer)["code"]) for x in answers)
    assert n <= blocks.count() * 14


def test_first_of_each_chooses_by_row(spark):
    text = "the same sentence of quite some words stands here " * 3
    rows = [(3, text, 1, "a"), (3, text, 2, "b"), (3, "another text that has nothing in common with it at all", 3, "c"), (7, text, 4, "d"), (None, text, 5, "e"), (None, None, 6, "f"), (None, "alone without a number but with many words", 7, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid long, row string")
    got = ngram_join.first_of_each(df.coalesce(1))
    assert got.columns == df.columns
    kept = sorted((x.uid, x.doc_id, x.text) for x in got.collect())
    assert kept == sorted((u, d, t) for d, t, u, _ in rows if u in (1, 3, 6, 7))


@pytest.mark.parametrize("hot_pairs", [1024, 1])
def test_ngram_join_of_large_groups(spark, monkeypatch, hot_pairs):
    """Two groups of one prefix each whose first members don't link, though one pair of members does."""
    monkeypatch.setattr(ngram_join, "HOT_PAIRS", hot_pairs)
    monkeypatch.setattr(ngram_join, "HOT_BLOCK", 16)
    names = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    rare, x = names("r", 30), names("x", 70)
    texts = []
    for k in range(40):
        texts.append(rare + x[:58] + names(f"a{k % 20}v", 12))
        texts.append(rare[:28] + names("q", 2) + x[:58] + names(f"{'a' if k == 33 else 'b'}{k % 20}v", 12))
    texts += [x + names(f"own{k}w", 300) for k in range(6)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {}
    sets = [set(t) for t in texts]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    want = {i: find(i) for i in range(len(sets))}
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(docs.coalesce(1), shingle=1).collect()}
    assert got == want


def test_ngram_join_within_a_group_of_one_prefix(spark):
    """Members of one group that link with each other but not with its first one, and no other group holds their tokens."""
    names = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    rare, x, y = names("r", 12), names("x", 38), names("y", 39)
    texts = [rare + x, rare + y[:38], rare + y[1:]] + [x + y + names(f"own{k}w", 400) for k in range(20)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(docs.coalesce(1), shingle=1).collect()}
    assert got == {i: 1 if i == 2 else i for i in range(len(texts))}


def test_topk(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8)).astype("f4")
    x[50:90] = x[0]
    x[100] *= 1000
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(700, None), (701, [1.0, float("nan")] + [0.0] * 6), (702, [None] * 8), (750, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = sorted(tuple(y) for y in topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect())
    q = np.floor(256 * x.astype(float)).astype(np.int64)
    want = []
    for i in range(0, 300, 50):
        s = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:5]
        want += [(i, k + 1, j, -v) for k, (v, j) in enumerate(s)]
    assert got == sorted(want)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    twice = df.where("vec_id < 3").union(df.where("vec_id < 3"))
    assert topk_search.top_k(twice, F.col("vec_id") == 0).count() == 4


def test_topk_prunes_pairs_before_vectors_are_shipped(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BUCKET", 32)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk_search, "META_SALT", 3)
    monkeypatch.setattr(topk_search, "PAIRS_PER_COPY", 2)
    r = np.random.default_rng(8)
    x = r.normal(size=(1200, 6)) * np.exp(r.normal(size=(1200, 1)) * 2)
    x[300:900] = x[7]  # a long run of equal vectors, over many groups
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5000 + i, [float(i), 1.0]) for i in range(300)], "vec_id long, embedding array<double>")
    seen = []
    plain = topk_search._work

    def spied(pairs, blocks, groups):
        seen.append((pairs.count(), blocks.count() * groups.count()))
        return plain(pairs, blocks, groups)

    monkeypatch.setattr(topk_search, "_work", spied)
    got = sorted(tuple(y) for y in topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect())
    vectors = {i: np.floor(256 * v).astype(np.int64) for i, v in enumerate(x)} | {5000 + i: np.array([256 * i, 256]) for i in range(300)}
    want = []
    for i, q in vectors.items():
        if i % 50 == 0:
            s = sorted((-int(q @ v), j) for j, v in vectors.items() if j != i and len(v) == len(q))[:5]
            want += [(i, k + 1, j, -v) for k, (v, j) in enumerate(s)]
    assert got == sorted(want)
    assert seen[0][0] + seen[1][0] < 0.6 * seen[1][1]


def test_topk_clips_scores_beyond_64_bits(spark):
    big = [float(1 << 40)] * 4
    df = spark.createDataFrame([(0, big), (1, big), (2, [-c for c in big]), (3, [1.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk_search.top_k(df, F.col("vec_id") == 0).collect()}
    assert got == {(0, 1): (1, (1 << 63) - 1), (0, 2): (3, 1 << 56), (0, 3): (2, -(1 << 63) + 1)}


def test_bpe(spark, rows, docs, odd, empty):
    t = Tokenizer.from_file(PATH)
    got = {x.doc_id: x for x in bpe.encode_texts(docs, PATH).collect()}
    trips = {x.doc_id: x for x in bpe.round_trip(docs, PATH).collect()}
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, dtype="<u4").tobytes()
        assert (bytes(got[i].ids), got[i].decoded) == (raw, t.decode(ids, skip_special_tokens=False))
        assert (trips[i].n_tokens, trips[i].ids_sha256, trips[i].decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), sha(got[i].decoded))
    assert bpe.round_trip(empty, PATH).count() == 0 and bpe.round_trip(odd, PATH).count() == odd.count()


def test_bpe_random_words():
    t, (_, e), lib = Tokenizer.from_file(PATH), bpe.backtracking(PATH), bpe.by_library(PATH)
    r = random.Random(5)
    for _ in range(300):
        text = "".join(chr(r.choice([r.randrange(32, 127), r.randrange(97, 123), r.randrange(0xA0, 0x250), r.randrange(0x3A0, 0x3D0), r.randrange(0xAC00, 0xAD00)])) for _ in range(40))
        want = np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert e.encode(text) == want == lib.encode(text)


TALK = [
    (1, 0, "system", "be [INST] kind\\1"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "yo <s>\\0 [/INST]"), (1, 3, "user", None), (1, 4, "assistant", "bye " * 40),
    (2, 0, "assistant", ""), (2, 0, "tool] x", "[ROLE y]"), (2, 0, "tool] x", "[ROLE y]"), (3, None, None, "q"), (None, 1, "user", "w"),
    *[(4, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 7)) for i in range(60)],
]


@pytest.mark.parametrize(("budget", "history"), [(2048, 256), (60, 20), (10, 4)])
def test_chat_format(spark, budget, history):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    windows = chat_format.format_windows(df, budget, history)
    got = {x.conv_id: x for x in chat_format.digest(windows).collect()}
    by = collections.defaultdict(list)
    for c, turn, role, text in TALK:
        by[c].append((-1 if turn is None else turn, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        x = got[c]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    if budget == 60:
        assert max(x.n_repeated for x in windows.collect()) >= 1
    assert chat_format.digest(chat_format.format_windows(df.limit(0))).count() == 0


def test_chat_budget_counts_other_scripts_and_given_tokens(spark):
    from tokenizers import Tokenizer as T

    t = T.from_file(PATH)
    texts = ["한국어 문장은 글자마다 여러 토큰이 될 수 있습니다 " * 3, "1234567890!?", "漢字漢字漢字", "plain words are short here"]
    got = [x.n for x in spark.createDataFrame([(x,) for x in texts], "x string").select(chat_format.tokens(F.col("x")).alias("n")).collect()]
    for text, n in zip(texts, got, strict=True):
        assert n >= len(t.encode(text, add_special_tokens=False).ids)
    turns = spark.createDataFrame([(1, i, "user", "x", 30) for i in range(8)], "conv_id long, turn long, role string, text string, size int")
    given = chat_format.format_windows(turns, 100, 10, tokens_col="size")
    assert given.count() > chat_format.format_windows(turns, 100, 10).count() == 1
    assert max(len(x.text) for x in given.collect()) <= 3 * len("[INST] x [/INST]")


def test_substring_dedup(spark, rows, docs, odd, empty):
    first, words = {}, {i: WORD.findall(t or "") for i, t, *_ in rows}
    for i, w in words.items():
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    got = {x.doc_id: x for x in substring_dedup.repeated_words(docs).collect()}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), sha(" ".join(kept)))
        assert WORD.findall(got[i].text) == kept
    assert sum(x.n_removed for x in got.values()) > 100
    assert substring_dedup.repeated_words(odd).count() == odd.count() and substring_dedup.repeated_words(empty).count() == 0


def test_substring_dedup_keeps_rows_of_one_id_apart(spark):
    shared = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"start one {shared} end", 5), (2, f"start two {shared} tail", 6), (2, "quite another text of the same number", 7), (None, f"no id {shared} last", 8), (None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    got = sorted((x.row.n_words, x.row.doc_id, x.text, x.n_removed) for x in substring_dedup.cut_documents(docs).collect())
    assert got == [(5, 1, rows[0][1], 0), (6, 2, "start two tail", 20), (7, 2, rows[2][1], 0), (8, None, "no id last", 20), (9, None, None, 0)]


def test_quality_rules(spark, rows, docs, odd, empty):
    got = {x.doc_id: x for x in quality_rules.judge(docs).collect()}
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        count = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {k for j in range(len(w) - 2) if count[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert x.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (x.base_failed and x.kept)
    assert sum(x.kept for x in got.values()) >= 70
    assert quality_rules.judge(odd).count() == odd.count() and quality_rules.judge(empty).count() == 0
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.kept}


def test_quality_cutoffs_follow_the_spread_of_the_source(spark):
    r = random.Random(5)

    def text(mean):
        return " ".join("".join(r.choices("abcdefghij", k=mean + k % 3 - 1)) for k in range(300))

    rows = [(i, text(5), "en", "even") for i in range(450)] + [(500 + i, text(4 + i % 4), "en", "mixed") for i in range(450)]
    rows += [(1900, text(9), "en", "even"), (1901, text(9), "en", "mixed"), (1902, text(5) + " #", "en", "even")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {x.doc_id for x in quality_rules.judge(docs).where("NOT kept").collect()} == {1900}


def _quantile(values, p):
    """As a sketch that holds all values: the least whose rank is p of them or more."""
    s = sorted(values)
    return s[max(0, int(np.ceil(p * len(s))) - 1)]


def test_quality_verdicts_by_exact_quantiles(spark):
    r = random.Random(11)
    letters = "abcdefghij"

    def text(i):
        n = r.randrange(60, 200)
        words = ["".join(r.choices(letters, k=r.randrange(2, 8))) for _ in range(n)]
        for _ in range(r.choice([0, 0, 0, 0, 1, 2, 30])):
            words[r.randrange(n)] = "#$"
        if i % 40 == 0:
            words = [w.upper() for w in words]
        if i % 33 == 0:
            words = words[:30] + words[:30] + words
        lines = [" ".join(words[k : k + 15]) for k in range(0, n, 15)]
        return "\n".join(lines + lines[:1] * r.choice([0, 0, 0, 0, 0, 4]))

    rows = [(i, text(i), ["en", "fr"][i % 2], f"s{i % 3 if i % 7 else 9}") for i in range(700)]
    rows += [(900 + i, "few words only", "en", "s0") for i in range(20)] + [(950, text(1), None, None), (951, text(2), "de", "s1")]
    got = {x.doc_id: x for x in quality_rules._judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    values = collections.defaultdict(list)
    for i, _, lang, source in rows:
        if not got[i].base_failed:
            for m, (a, b, _) in quality_rules.METRICS.items():
                v = got[i][a] / max(got[i][b], 1)
                values[lang, source, m].append(v)
                values[lang, m].append(v)

    def limit(v, side):
        mid, (lo, hi), far = _quantile(v, 0.5), (_quantile(v, 0.25), _quantile(v, 0.75)), _quantile(v, 0.9 if side > 0 else 0.1)
        return mid + side * quality_rules.SPREADS * max(hi - lo, side * (far - mid))

    rejected = 0
    for i, _, lang, source in rows:
        x = got[i]
        if x.base_failed:
            assert not x.kept
            continue
        odd = False
        for m, (a, b, step) in quality_rules.METRICS.items():
            own, all_of = values[lang, source, m], values[lang, m]
            drawn = lambda side: (len(own) * limit(own, side) + quality_rules.SHRINK * limit(all_of, side)) / (len(own) + quality_rules.SHRINK)  # noqa: B023, E731
            most = x[b] * drawn(1)
            odd |= x[a] > most + quality_rules.NOISE * (step * (most + step)) ** 0.5
            if m == "word_length":
                least = x[b] * max(0.0, drawn(-1))
                odd |= x[a] < least - quality_rules.NOISE * (least + 1) ** 0.5
        assert x.kept == (not odd), (i, x)
        rejected += odd
    assert 10 < rejected < 250
