"""The rows that extractors give."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

UNITS = "path string, rec string, kind string, unit_type string, name string, qualname string, signature string, summary string, start_line int, end_line int, byte_start int, byte_end int, target string"
NAMES = [c.split()[0] for c in UNITS.split(", ")]


def row(path, rec, kind=None, unit_type=None, name=None, qualname=None, signature="", summary="", lines=(0, 0), span=(0, 0), target=None) -> tuple:
    return path, rec, kind, unit_type, name, qualname, signature, summary, *lines, *span, target


def collapse(s: str, n: int) -> str:
    return re.sub(r"\s+", " ", s).strip()[:n]


def valid_aliases(pairs: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Those of (alias, target) with an identifier and a target, the first of each alias."""
    seen = set()
    for alias, target in pairs:
        if re.fullmatch(r"[A-Za-z_$][\w$]*", alias or "") and target and alias not in seen:
            seen.add(alias)
            yield alias, target
