"""Compound files (OLE2): the streams by full path."""

from __future__ import annotations

import struct

_MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END = 0xFFFFFFFA  # and above: no sector
MAX_STREAM = 100 << 20


class BadCompoundFile(ValueError):
    pass


def _chain(table: list[int], start: int) -> list[int]:
    out, seen = [], set()
    while start < _END and start < len(table) and start not in seen:
        seen.add(start)
        out.append(start)
        start = table[start]
    return out


def streams(data: bytes) -> dict[str, bytes]:
    """Every stream of the file; sectors beyond its end are zero, and a cycle ends its chain."""
    if data[:8] != _MAGIC or len(data) < 512:
        raise BadCompoundFile("복구할 수 없는 OLE2 파일: 시그니처")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    if not 7 <= shift <= 16 or not 4 <= mini_shift <= 12:
        raise BadCompoundFile("복구할 수 없는 OLE2 파일: 섹터 크기")
    size = 1 << shift

    def sector(i: int) -> bytes:
        at = (i + 1) << shift
        return data[at : at + size].ljust(size, b"\0")

    n_fat, root_at, cutoff, mini_at = *struct.unpack_from("<I", data, 44), *struct.unpack_from("<I", data, 48), *struct.unpack_from("<I", data, 56), *struct.unpack_from("<I", data, 60)
    more = struct.unpack_from("<I", data, 68)[0]
    fat_sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < _END]
    seen: set[int] = set()
    while more < _END and more not in seen and len(seen) < 10_000:
        seen.add(more)
        entries = struct.unpack(f"<{size // 4}I", sector(more))
        fat_sectors += [s for s in entries[:-1] if s < _END]
        more = entries[-1]
    fat: list[int] = []
    for s in fat_sectors[: min(max(n_fat, 1), 10_000)]:
        fat += struct.unpack(f"<{size // 4}I", sector(s))
    read = lambda start: b"".join(map(sector, _chain(fat, start)))
    directory = read(root_at)
    nodes = []
    for at in range(0, len(directory) - 127, 128):
        e = directory[at : at + 128]
        n = min(struct.unpack_from("<H", e, 64)[0], 64)
        left, right, child = struct.unpack_from("<III", e, 68)
        start, length = struct.unpack_from("<IQ", e, 116)
        nodes.append((e[: max(0, n - 2)].decode("utf-16-le", "replace"), e[66], left, right, child, start, length & 0xFFFFFFFF if shift == 9 else length))
    if not nodes:
        raise BadCompoundFile("복구할 수 없는 OLE2 파일: 디렉터리 없음")
    mini_fat_raw = read(mini_at) if mini_at < _END else b""
    mini_fat = list(struct.unpack(f"<{len(mini_fat_raw) // 4}I", mini_fat_raw))
    mini = read(nodes[0][5])
    out: dict[str, bytes] = {}
    todo, visited = [(nodes[0][4], "")], set()
    while todo:
        i, prefix = todo.pop()
        if i >= len(nodes) or i in visited:
            continue
        visited.add(i)
        name, kind, left, right, child, start, length = nodes[i]
        todo += [(left, prefix), (right, prefix)]
        if kind == 1:
            todo.append((child, f"{prefix}{name}/"))
        elif kind == 2:
            if length > MAX_STREAM:
                raise BadCompoundFile("스트림 크기 초과")
            if length < cutoff:
                raw = b"".join(mini[s << mini_shift : (s + 1) << mini_shift] for s in _chain(mini_fat, start))
            else:
                raw = read(start)
            out[prefix + name] = raw[:length]
    return out
