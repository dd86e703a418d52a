"""Quality rules with adaptive thresholds; DataFrame functions only.

Every text gets shape metrics in one narrow pass.  KLL quantile sketches of the metrics are
built for each (lang, source) over the documents that pass the base rules, and merged into one for
each language.  A metric's threshold is ``median + SPREADS * max(q75 - q25, q90 - median)`` (for the mean word length
the mirrored bound below too, with q10); quantiles above q90 would be moved by the very texts that are to be found where
they are more than a few in a hundred.  A group's threshold is drawn towards its language's by weight, as if
``SHRINK`` more documents of the language stood in the group: a small group follows its language, a
large one its own spread, and there is no size at which one takes the other's place.

A metric is a count over a size, so a document is rejected if its count lies more than ``NOISE``
standard deviations of a count beyond what the threshold gives for its size: a short text is not
judged by one chance event, nor all that differ in a group without any spread.  Repeated words come six at
a time (a 3-word window, twice), and their count varies by as much more.  The base rules come first,
whatever the sketches say.

Defined cases: a null or empty text has no words and fails the base rules; null lang or
source is a group value of its own; null doc_id is kept as a row; rows that repeat a doc_id
are judged, and kept or not, each by their own text; a metric equal to its threshold passes; an
empty table gives an empty result; extra columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm._session import materialize

MIN_WORDS = 50
SHRINK = 100
SPREADS = 6.0
SKETCH_K = 2048
NOISE = 3.0
#: Each metric's count, its size, and how many the count grows by at once.
METRICS = {
    "symbol_ratio": ("n_symbols", "word_chars", 1),
    "repeat_ratio": ("n_repeat_words", "n_words", 6),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 1),
    "upper_ratio": ("n_upper", "word_chars", 1),
    "word_length": ("word_chars", "n_words", 1),
}
_BLANKS = "\t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _repeat_words(w: str = "w", n: str = "n_words") -> list[tuple[str, str]]:
    """Steps (column, SQL) that count the words in 3-word windows found twice or more.

    The windows' hashes are sorted to find repeated ones; a text with many repeated windows
    sorts (hash, position) pairs instead of testing each window against a list, so that
    the cost stays n log n for any text.
    """
    return [
        ("_h", f"IF({n} < 4, array(), transform(sequence(0, greatest({n}, 3) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2])))"),
        ("_s", "IF(size(_h) = size(array_distinct(_h)), array(), sort_array(_h))"),
        ("_d", "IF(size(_s) = 0, array(), array_distinct(filter(zip_with(_s, slice(_s, 2, greatest(size(_s) - 1, 1)), (a, b) -> IF(a = b, a, NULL)), x -> x IS NOT NULL)))"),
        ("_o", "IF(size(_d) <= 32, array(), sort_array(transform(_h, (x, i) -> struct(x AS x, i AS i))))"),
        (
            "_p",
            """CASE WHEN size(_d) = 0 THEN array()
                 WHEN size(_d) <= 32 THEN filter(sequence(0, size(_h) - 1), i -> array_contains(_d, _h[i]))
                 ELSE sort_array(filter(transform(_o, (o, j) -> IF((j > 0 AND o.x = _o[j - 1].x) OR (j + 1 < size(_o) AND o.x = _o[j + 1].x), o.i, NULL)), i -> i IS NOT NULL)) END""",
        ),
        ("n_repeat_words", "IF(size(_p) = 0, 0L, aggregate(zip_with(_p, concat(slice(_p, 2, greatest(size(_p) - 1, 1)), array(_p[size(_p) - 1] + 3)), (a, b) -> CASE WHEN b IS NULL OR b <= a THEN 0 ELSE least(3, b - a) END), 0L, (t, x) -> t + x))"),
    ]


def _key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-"))


def _group(lang_col: str, source_col: str) -> Column:
    return F.concat(_key(lang_col), F.lit("\x01"), _key(source_col))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, group keys, the counts and the ratios of every text."""
    x = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
        _key(lang_col).alias("lang_key"),
        _group(lang_col, source_col).alias("group_key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("t"),
    )
    blank = F.translate("t", _BLANKS, " " * len(_BLANKS))
    x = x.withColumn("w", F.filter(F.split(blank, " "), lambda v: v != ""))
    x = x.withColumn("lines", F.filter(F.split("t", "\n"), lambda v: F.translate(v, _BLANKS + " ", "") != ""))
    x = x.select(
        "doc_id", "text_key", "lang_key", "group_key", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", _BLANKS + " ", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.length(F.regexp_replace("t", r"\P{Lu}+", "")).alias("n_upper"),
    )
    x = x.withColumn("n_words_i", F.col("n_words").cast("int"))
    for name, sql in _repeat_words(n="n_words_i"):
        x = x.withColumn(name, F.expr(sql))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return x.select(
        "doc_id", "text_key", "lang_key", "group_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
        failed.alias("base_failed"),
    )


def _thresholds(metrics: DataFrame) -> DataFrame:
    ratio = [(F.col(a) / F.greatest(F.col(b), F.lit(1))).alias(m) for m, (a, b, _) in METRICS.items()]
    sketch = [F.kll_sketch_agg_double(F.col(m), F.lit(SKETCH_K)).alias(m) for m in METRICS]
    group = metrics.where("NOT base_failed").select("group_key", "lang_key", *ratio).groupBy("group_key", "lang_key").agg(F.count("*").alias("n"), *sketch)
    lang = group.groupBy("lang_key").agg(*[F.kll_merge_agg_double(F.col(m), F.lit(SKETCH_K)).alias(f"lang_{m}") for m in METRICS])
    both = group.join(lang, "lang_key")
    quantile = F.kll_sketch_get_quantile_double

    def limit(sketch: str, side: int) -> Column:
        """Where the tail above (side 1) or below (side -1) ends."""
        q = {p: quantile(F.col(sketch), F.lit(p if side > 0 else round(1 - p, 2))) for p in (0.25, 0.5, 0.75, 0.9)}
        return q[0.5] + side * F.lit(SPREADS) * F.greatest(F.abs(q[0.75] - q[0.25]), side * (q[0.9] - q[0.5]))

    def shrunk(metric: str, side: int) -> Column:
        return (F.col("n") * limit(metric, side) + F.lit(SHRINK) * limit(f"lang_{metric}", side)) / (F.col("n") + SHRINK)

    out: list[Column] = [F.col("group_key")]
    for m in METRICS:
        out += [shrunk(m, 1).alias(f"{m}_most"), F.greatest(shrunk(m, -1), F.lit(0.0)).alias(f"{m}_least")]
    return both.select(*out)


def _judged(docs: DataFrame, **columns: str) -> DataFrame:
    metrics = materialize(measure(docs, **columns))
    limits = _thresholds(metrics)
    # a left join that AQE may split: one source can hold a third of all rows
    x = metrics.join(limits, "group_key", "left")
    odd = F.lit(False)
    for m, (count, size, step) in METRICS.items():
        most = F.col(size) * F.col(f"{m}_most")
        odd = odd | (F.col(count) > most + NOISE * F.sqrt(step * (most + step)))
    least = F.col("n_words") * F.col("word_length_least")
    odd = odd | (F.col("word_chars") < least - NOISE * F.sqrt(least + 1))
    return x.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))


def judge(docs: DataFrame, **columns: str) -> DataFrame:
    """The counts of each row of ``docs`` with base_failed and kept."""
    return _judged(docs, **columns).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""
    judged = _judged(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col)
    # a verdict depends on no more than the text and its group
    key = F.struct(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), F.col("group_key").alias("g"))
    kept = judged.where("kept").select(key.alias("_kept")).distinct()
    own = F.struct(F.col(f"`{id_col}`").alias("d"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("t"), _group(lang_col, source_col).alias("g"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), own.alias("_own"))
    return whole.join(kept, F.col("_own").eqNullSafe(F.col("_kept")), "left_semi").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
