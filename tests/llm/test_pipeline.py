"""The corpus pipeline row by row against plain Python, on rows with repeated and missing ids."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import line_dedup, quality_rules
from tests.llm.test_operators import WORD, make_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `extra col` int, row string, n_removed long"
_LAST = 1 << 62


def cases():
    rows = [(i, t, lang, source, len(t or ""), i, "r", -1) for i, t, lang, source, *_ in make_rows()]
    long = " ".join(f"own{k}word" for k in range(90))
    passage = " ".join(f"pas{k}sage" for k in range(60))
    more = [
        (2, f"{long} start two {passage} tail", "en", "s1"),
        (2, "second text of number two " + " ".join(f"b{k}d" for k in range(80)), "en", "s2"),
        (500, f"{passage} " + " ".join(f"c{k}e" for k in range(80)), "en", "s3"),
        (None, "no id at all " + " ".join(f"d{k}f" for k in range(80)) + f" {passage}", "en", "s4"),
        (None, f"{long} start two {passage} tail", "en", "s4"),
        (600, "this very line stands on every site here\n" + " ".join(f"g{k}h" for k in range(80)), "en", "s5"),
        (600, "this very line stands on every site here\n" + " ".join(f"i{k}j" for k in range(80)), "en", "s6"),
    ]
    return rows + [(i, t, lang, s, len(t), 1000 + k, "r", -2) for k, (i, t, lang, s) in enumerate(more)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases(), SCHEMA).repartition(3)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def order(r):
    return (_LAST if r[0] is None else r[0],)


def without_lines(rows):
    sites, first = collections.defaultdict(set), {}
    lines = lambda t: (t or "").split("\n")
    for k, r in enumerate(rows):
        for p, x in enumerate(lines(r[1])):
            key = x.strip(" \t\n\x0b\x0c\r")
            if key:
                sites[key] |= {r[3]} - {None}
                first[key] = min(first.get(key, ((_LAST + 1,), 0, 0)), (order(r), k, p))
    out = []
    for k, r in enumerate(rows):
        gone = {p for p, x in enumerate(lines(r[1])) if len(sites[x.strip(" \t\n\x0b\x0c\r")]) >= line_dedup.MIN_SITES and first[x.strip(" \t\n\x0b\x0c\r")] != (order(r), k, p)}
        text = "\n".join(x for p, x in enumerate(lines(r[1])) if p not in gone) if gone else r[1]
        if not gone or WORD.search(text):
            out.append((r[0], text, *r[2:4], len(text) if gone else r[4], *r[5:]))
    return out


def without_passages(rows):
    first, words = {}, [[m for m in WORD.finditer(r[1] or "")] for r in rows]
    for r, w in zip(rows, words, strict=True):
        for j in range(len(w) - 12):
            key = tuple(m[0] for m in w[j : j + 13])
            first[key] = min(first.get(key, (_LAST + 1,)), order(r))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(m[0] for m in w[j : j + 13])] < order(r):
                gone[j : j + 13] = [True] * 13
        if not any(gone):
            out.append(r)
        elif not all(gone):
            ends = [m.start() for m in w[1:]] + [len(r[1])]
            text = (r[1][: w[0].start()] if not gone[0] else "") + "".join(r[1][m.start() : e] for m, e, g in zip(w, ends, gone, strict=True) if not g)
            out.append((r[0], text, *r[2:4], len(text), *r[5:]))
    return out


def test_line_stage(spark, docs):
    rows = cases()
    assert plain(corpus_pipeline.lines(spark, docs, "")) == sorted(without_lines(rows), key=str)


def test_substring_stage(spark, docs):
    assert plain(corpus_pipeline.substrings(spark, docs, "")) == sorted(without_passages(cases()), key=str)


def test_near_duplicate_stage(spark, docs):
    rows = cases()

    def shingles(t):
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k)].append(r)
    got = plain(corpus_pipeline.near_duplicates(spark, docs, ""))
    assert len(got) == len(groups)
    least = collections.Counter(min(order(r) for r in g) for g in groups.values())
    assert collections.Counter(order(r) for r in got) == least and set(got) <= set(rows)


def test_quality_stage(spark, docs):
    judged = quality_rules._judged(docs).select("doc_id", "text_key", "group_key", "kept").distinct().collect()
    assert len({(x.doc_id, x.text_key, x.group_key) for x in judged}) == len(judged)
    kept = collections.Counter((x.doc_id, x.text_key) for x in judged if x.kept)
    keyed = docs.withColumn("k", F.xxhash64(F.coalesce("text", F.lit(""))))
    want = [r for r in keyed.collect() if (r.doc_id, r.k) in kept]
    assert plain(corpus_pipeline.quality(spark, docs, "")) == sorted((tuple(r)[:-1] for r in want), key=str)
    texts = {r.text for r in want}
    assert any(t.startswith("second text") for t in texts) and any(t.startswith("no id") for t in texts)


def test_short_lines_of_many_sites_go(spark):
    rows = [(i, f"own words of number {i}\nAll rights reserved.\n\n版权所有\nonly {i % 9}", "en", f"s{i % 12}", 0) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x.text for x in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {i: t if i == 0 else f"own words of number {i}\n\nonly {i % 9}" for i, t, *_ in rows}


def test_whole_pipeline(spark, docs):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, "")
        if k < 4:
            assert docs.columns == before.columns and docs.count() > 20
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    packed = docs.collect()
    assert len({(x.doc_id, x.start) for x in packed}) > 20 and all(re.fullmatch(r"\d+", str(x.ids_crc32)) for x in packed)
    nothing = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, "")
    assert nothing.count() == 0
