"""Headings, outlines and list kinds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import strip
from paperloom.sources.rows import nested_mark

#: The least ratio of a font size to the base size at each level.
RATIOS = ((1, 1.5), (2, 1.3), (3, 1.15))


def heading_level(text: Column, size: Column, base: Column) -> Column:
    """1 to 3, or null for no heading."""
    t = strip(text)
    ratio = F.when((base > 0) & (size > 0), size / base)
    by_size = None
    for level, least in RATIOS:
        by_size = F.when(ratio >= least, level) if by_size is None else by_size.when(ratio >= least, level)
    chapter = F.regexp_replace(t, r"(?U)\s+", "").rlike(r"^제\d+[조장절편]") & (F.length(t) <= 50)
    level = F.coalesce(by_size, F.when(chapter, 3))
    return F.when((t != "") & (F.length(t) <= 200) & ~t.rlike(r"(?U)^\d+$"), level)


def with_common_size(blocks: DataFrame, key: str, name: str) -> DataFrame:
    """Blocks (section, ord, font_size) with their document's most common size as ``name``, of equally common ones the first; by windows, so the blocks are read once."""
    place = F.col("section").cast("long") * (1 << 40) + F.col("ord")
    alike, whole = Window.partitionBy(key, "_size"), Window.partitionBy(key)
    # both windows and a later join by the key take this one exchange
    x = blocks.repartition(key).withColumn("_size", F.when(F.col("font_size") > 0, F.col("font_size"))).withColumn("_at", place)
    x = x.withColumn("_n", F.count("*").over(alike)).withColumn("_first", F.min("_at").over(alike))
    common = F.max(F.when(F.col("_size").isNotNull(), F.struct("_n", (-F.col("_first")).alias("_first"), "_size"))).over(whole)
    return x.withColumn(name, common["_size"]).drop("_size", "_at", "_n", "_first")


def styled_level(text: Column, size: Column, base: Column) -> Column:
    """1 to 3 by size, else 2 for a chapter's and 3 for an article's title; null for no heading and without a base."""
    t = strip(text)
    level = None
    for n, least in RATIOS:
        level = F.when(size / base >= least, n) if level is None else level.when(size / base >= least, n)
    chapter = t.rlike(r"(?U)^제\d+[장절편]\s") & (F.length(t) <= 50)
    article = t.rlike(r"(?U)^제\d+(?:조의?\d*)\s*[（(]") & (F.length(t) <= 80)
    level = F.coalesce(level, F.when(chapter, 2).when(article, 3))
    return F.when((base > 0) & (t != "") & (F.length(t) <= 200) & ~t.rlike(r"(?U)^\d+$"), level)


def with_headings(blocks: DataFrame, bases: DataFrame | None, key: str, sized: bool = True) -> DataFrame:
    """Blocks of all formats (with file_type, section) after their format's rule; ``bases`` (key, base) are sizes of named styles.

    Without ``sized`` no block has a font size, and without ``bases`` no style is named.
    """
    none = F.lit(None).cast("double")
    x = with_common_size(blocks, key, "_common") if sized else blocks.withColumn("_common", none)
    x = x.join(bases, key, "left") if bases is not None else x.withColumn("base", none)
    text = F.coalesce("text", F.lit(""))
    ratio = heading_level(text, F.col("font_size"), F.coalesce("_common", F.lit(0.0)))
    styled = styled_level(text, F.col("font_size"), F.coalesce("base", "_common"))
    level = F.when(F.col("type") == "paragraph", F.when(F.col("file_type") == "hwpx", ratio).when(F.col("file_type") == "hwp", styled))
    x = x.withColumn("_level", level).withColumn("level", F.coalesce("_level", "level"))
    return x.withColumn("type", F.when(F.col("_level").isNotNull(), "heading").otherwise(F.col("type"))).select(*blocks.columns)


def outline(blocks: DataFrame) -> DataFrame:
    return blocks.where("type = 'heading'")


def list_kind(formats: DataFrame, paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Paragraphs with list_type by their numbering's format (keys, fmt); one without a format is ordered."""
    x = paragraphs.join(formats, keys, "left")
    return x.withColumn("list_type", F.when(F.col("fmt") == "bullet", "unordered").otherwise("ordered")).drop("fmt")


def nested_marker(number: Column, hint: Column) -> Column:
    """The text that stands for a table inside of a cell."""
    return F.pandas_udf(_marks, "string")(number, hint)


def _marks(numbers: pd.Series, hints: pd.Series) -> pd.Series:
    return pd.Series([nested_mark(int(n), h or "") for n, h in zip(numbers, hints, strict=True)])
