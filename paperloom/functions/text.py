"""Text clean-up, references and error codes as Column functions; all stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The generated alternative texts of drawing objects.
SHAPE_NAMES = (
    "사각형|직사각형|정사각형|원|타원|삼각형|이등변 삼각형|직각 삼각형|선|직선|곡선|화살표|굵은 화살표|이중 화살표|오각형|육각형|팔각형|별|[4-8]점별|십자|십자형"
    "|구름|구름형|마름모|도넛|평행사변형|사다리꼴|부채꼴|호|반원|물결|번개|하트|빗금|블록 화살표|수식|표|그림|개체|그리기\\s?개체|묶음\\s?개체|글상자|수식\\s?개체|OLE\\s?개체"
)
SHAPE_TEXT = "(?:모서리가 둥근 |둥근 )?(?:" + SHAPE_NAMES + ")\\s?입니다\\.?"

#: White space that Python's str.strip removes.
_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
MAX_SPREAD = 30


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def sanitize_text(c: Column) -> Column:
    """Without private-use characters and shape texts, single spaces, evenly spaced Hangul joined."""
    x = F.regexp_replace(c, r"[\x{F0000}-\x{FFFFD}]", "")
    # few texts have the ending that every shape text has, and the names take long to look for
    x = _once(x, lambda v: F.when(F.contains(v, F.lit("입니다")), F.regexp_replace(v, SHAPE_TEXT, "")).otherwise(v))
    x = strip(F.regexp_replace(x, "  +", " "))

    def joined(v: Column) -> Column:
        parts = F.split(v, " ")
        single = F.size(F.filter(parts, lambda t: t.rlike("^[가-힯ㄱ-ㆎ]$")))
        return F.when((F.size(parts) >= 3) & (single >= F.lit(0.7) * F.size(parts)), F.array_join(parts, "")).otherwise(v)

    return _once(x, lambda v: F.when(F.length(v) <= MAX_SPREAD, joined(v)).otherwise(v))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is computed once, however often f uses it."""
    return F.transform(F.array(c), f)[0]


def escape_tilde(c: Column) -> Column:
    return F.replace(c, F.lit("~"), F.lit("\\~"))


#: A document type with its inner declarations.
DOCTYPE = r"(?i)<!DOCTYPE\s[^\[>]*(\[[\s\S]*?\])?\s*>"


def strip_doctype(c: Column) -> Column:
    return F.regexp_replace(c, DOCTYPE, "")


def safe_href(c: Column) -> Column:
    x = strip(c)
    return F.when(x.rlike(r"^(?i)(?:https?:|mailto:|tel:|#)"), x)


#: A path that leaves its folder: a NUL, a step up, an absolute path or a drive.
TRAVERSAL = r"\x00|(^|[\\/])\.\.([\\/]|$)|^[\\/]|^[A-Za-z]:"


def is_path_traversal(c: Column) -> Column:
    return c.rlike(TRAVERSAL)


#: Message parts that decide the error code, in this order.
ERROR_RULES: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = (
    ("ENCRYPTED", (("암호화",),)),
    ("DRM_PROTECTED", (("DRM",),)),
    ("ZIP_BOMB", (("ZIP bomb",), ("ZIP 비압축 크기 초과",), ("ZIP 엔트리 수 초과",))),
    ("DECOMPRESSION_BOMB", (("bomb",), ("크기 초과",), ("압축 해제",))),
    ("IMAGE_BASED_PDF", (("이미지 기반",),)),
    ("NO_SECTIONS", (("섹션", "찾을 수 없"), ("섹션", "없음"))),
    ("CORRUPTED", (("시그니처",), ("복구할 수 없",))),
)


def error_code(message: Column) -> Column:
    out = None
    for code, choices in ERROR_RULES:
        hit = F.lit(False)
        for parts in choices:
            every = F.lit(True)
            for p in parts:
                every = every & F.contains(message, F.lit(p))
            hit = hit | every
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise("PARSE_ERROR")


def a1(ref: str | None) -> tuple[int, int] | None:
    """Row and column of a reference such as AB12, from 0; None if it is none."""
    m = re.fullmatch(r"([A-Z]+)(\d+)", ref or "")
    if not m:
        return None
    col = 0
    for ch in m[1]:
        col = col * 26 + ord(ch) - 64
    return int(m[2]) - 1, col - 1


def cell_place(ref: Column) -> Column:
    """The same as a struct (r, c)."""
    return F.pandas_udf(_places, "r int, c int")(ref)


def _places(refs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([a1(x) or (None, None) for x in refs], columns=["r", "c"]).astype("Int32")


def clean_numeric(c: Column) -> Column:
    """A decimal by its 15 significant digits in the shortest form; other values stay."""
    return F.when(c.rlike(r"^-?\d+\.\d+$"), F.pandas_udf(_shortest, "string")(c)).otherwise(c)


def _shortest(values: pd.Series) -> pd.Series:
    """``%.15g`` and then the shortest digits that read back; Java prints doubles another way."""
    return values.map(lambda v: None if v is None else repr(float(f"{float(v):.15g}")) if _is_number(v) else v)


def _is_number(v: str) -> bool:
    try:
        float(v)
    except ValueError:
        return False
    return True


def page_list(pages: Column, max_pages: Column) -> Column:
    """The pages of a list of numbers, rounded half to even, sorted."""
    whole = F.transform(pages, lambda x: F.bround(x.cast("double"), 0).cast("int"))
    return F.array_sort(F.array_distinct(F.filter(whole, lambda x: x.between(F.lit(1), max_pages))))


def page_set(spec: Column, max_pages: Column) -> Column:
    """The pages that a range such as ``1,3,5-7`` selects, sorted; parts that are none are ignored."""
    parts = F.transform(F.split(spec, ","), strip)
    number = lambda x: F.when(strip(x).rlike(r"^[+-]?\d+$"), strip(x).cast("int"))

    def one(p: Column) -> Column:
        dash = F.instr(p, "-")
        low = F.greatest(F.lit(1), number(F.substring(p, F.lit(1), dash - 1)))
        high = F.least(max_pages, number(F.substring(p, dash + 1, F.length(p))))
        plain = number(p)
        low_ok, high_ok = number(F.substring(p, F.lit(1), dash - 1)).isNotNull(), number(F.substring(p, dash + 1, F.length(p))).isNotNull()
        nothing = F.array().cast("array<int>")
        return F.when(dash > 0, F.when(low_ok & high_ok & (low <= high), F.sequence(low, F.greatest(low, high))).otherwise(nothing)).otherwise(
            F.when(plain.between(F.lit(1), max_pages), F.array(plain)).otherwise(nothing)
        )

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, one))))
