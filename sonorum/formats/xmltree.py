"""Small helpers over the standard library's XML trees."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from ..errors import FormatError, ParseError

Tree = ET.Element


def tag(name: str, attributes: dict | None = None, *children: Tree, text: str | None = None) -> Tree:
    out = ET.Element(name, {k.replace("_", "-") if k.startswith("-") else k: str(v) for k, v in (attributes or {}).items() if v is not None})
    out.text = text
    out.extend(children)
    return out


def value(name: str, v) -> Tree:
    """<name Value="v"/>"""
    return tag(name, {"Value": v})


def document(root: Tree) -> str:
    ET.indent(root)
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode") + "\n"


def parse(text: str | bytes, name: str | None = None) -> Tree:
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ParseError(f"not well-formed XML: {e}") from e
    if name and root.tag != name:
        raise FormatError(f"the root is {root.tag}, not {name}")
    return root


def of(node: Tree | None, path: str, attribute: str = "Value", default=None):
    """An attribute of the first node on a path."""
    found = node.find(path) if node is not None else None
    return found.get(attribute, default) if found is not None else default


def number(text, what: str) -> float:
    try:
        return float(text)
    except (TypeError, ValueError):
        raise ParseError(f"{what} is no number: {text}") from None


class Ids:
    """id1, id2, ..."""

    def __init__(self, prefix: str = ""):
        self.prefix, self.n = prefix, 0

    def __call__(self) -> str:
        self.n += 1
        return f"{self.prefix}{self.n}"
