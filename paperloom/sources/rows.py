"""The tagged row that every decoder yields."""

from __future__ import annotations

Row = dict


class Unreadable(ValueError):
    pass


def row(kind: str, section: int = 0, ord: int = 0, r: int | None = None, c: int | None = None, text: str | None = None, data: bytes | None = None, **attrs: object) -> Row:
    return {"kind": kind, "section": section, "ord": ord, "r": r, "c": c, "text": text, "attrs": {k: str(v) for k, v in attrs.items() if v is not None}, "data": data}


def truncated(section: int, cells: int) -> Row:
    """The warning that a sheet has cells beyond the limits of a table."""
    return row("warning", section, text=f"표 크기 제한 밖의 셀 {cells}개 생략", code="TRUNCATED_TABLE")


def nested_mark(number: int, hint: str = "") -> str:
    """What stands in a cell for a table inside of it."""
    short = hint[:60] + "…" if len(hint) > 60 else hint
    return f"[중첩 테이블 #{number}: {short}]" if short else f"[중첩 테이블 #{number}]"
