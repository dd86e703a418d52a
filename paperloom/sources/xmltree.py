"""XML without namespaces, document types or failures on stray references."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from xml.etree import ElementTree as ET

from paperloom.functions.text import DOCTYPE

_DOCTYPE = re.compile(DOCTYPE)
_STRAY = re.compile(r"&(?!#\d+;|#x[0-9A-Fa-f]+;|amp;|lt;|gt;|quot;|apos;)")
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


@lru_cache(4096)
def _local(name: str) -> str:
    return name.rpartition("}")[2]


class Node:
    __slots__ = ("tag", "attrs", "text", "kids", "tail")

    def __init__(self, e: ET.Element):
        self.tag = _local(e.tag)
        self.attrs = {_local(k): v for k, v in e.attrib.items()} if e.attrib else {}
        self.text, self.tail = e.text or "", e.tail or ""
        self.kids = [Node(k) for k in e if isinstance(k.tag, str)] if len(e) else []

    def find(self, *path: str) -> Node | None:
        at: Node | None = self
        for tag in path:
            at = next((k for k in at.kids if k.tag == tag), None) if at else None
        return at

    def all(self, tag: str) -> list[Node]:
        return [k for k in self.kids if k.tag == tag]

    def walk(self) -> Iterator[Node]:
        path = [self]
        while path:
            n = path.pop()
            yield n
            path += n.kids[::-1]

    def full_text(self) -> str:
        return self.text if not self.kids else self.text + "".join(k.full_text() + k.tail for k in self.kids)


def _text(raw: bytes | str) -> str:
    text = raw.decode("utf-8", "replace").lstrip("\ufeff") if isinstance(raw, bytes) else raw
    return re.sub(r"^\s*<\?xml[^>]*\?>", "", _DOCTYPE.sub("", text))


def read(raw: bytes | str) -> Node:
    """Well-formed XML, but for stray references and characters that XML has not."""
    text = _text(raw)
    try:
        return Node(ET.fromstring(text))
    except ET.ParseError:
        return Node(ET.fromstring(_ILLEGAL.sub("", _STRAY.sub("&amp;", text))))


def parse(raw: bytes | str) -> Node:
    """The same, and of other text what can be made of it."""
    try:
        return read(raw)
    except ET.ParseError:
        return Node(_rebuilt(_ILLEGAL.sub("", _text(raw))))


_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<(?P<end>/?)(?P<name>[\w:.-]+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<alone>/?)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(\"[^\"]*\"|'[^']*')")


def _rebuilt(text: str) -> ET.Element:
    """The elements of text that is no well-formed XML: an end without a start is left out, and what is open ends with its parent."""
    root = ET.Element("_")
    path, opened, at = [root], {"_": 1}, 0
    local = lambda name: name.rpartition(":")[2]

    def said(piece: str) -> None:
        if len(path[-1]):
            path[-1][-1].tail = (path[-1][-1].tail or "") + piece
        else:
            path[-1].text = (path[-1].text or "") + piece

    for m in _MARKUP.finditer(text):
        if m.start() > at:
            said(unescape(text[at : m.start()]))
        at = m.end()
        if m["data"] is not None:
            said(m["data"])
        if m["name"] is None:
            continue
        name = local(m["name"])
        if m["end"]:
            while opened.get(name, 0):
                done = path.pop().tag
                opened[done] -= 1
                if done == name:
                    break
            continue
        e = ET.SubElement(path[-1], name, {local(k): unescape(v[1:-1]) for k, v in _ATTRIBUTE.findall(m["attrs"])})
        if not m["alone"]:
            path.append(e)
            opened[name] = opened.get(name, 0) + 1
    if at < len(text):
        said(unescape(text[at:]))
    if not len(root):
        raise ValueError("no XML element")
    return root[0] if len(root) == 1 else root
