"""Units, calls and import aliases of files, each file parsed once.

Python by its own parser, with a scan for definitions where a file does not parse; Markdown by headings outside
fences; JSON, YAML, TOML, INI and env files by key paths. Spans are in UTF-8 bytes, lines count from 1.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import scanners
from .rows import NAMES, UNITS, collapse, row, valid_aliases

def python(path: str, text: str) -> Iterator[tuple]:
    starts, at = [], 0
    for line in text.splitlines(keepends=True) or [""]:
        starts.append(at)
        at += len(line.encode())
    raw = text.encode()

    def span(node) -> tuple[int, int]:
        return starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        for m in re.finditer(r"^([ \t]*)(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)[^\n]*", text, re.M):
            a, line = len(text[: m.start(2)].encode()), text.count("\n", 0, m.start()) + 1
            yield row(path, "unit", "symbol", "class" if m[2] == "class" else "function", m[3], m[3], collapse(m[0], 300), "", (line, line), (a, len(text[: m.end()].encode())))
        return

    aliases: list[tuple[str, str]] = []

    def walk(body, prefix: str, in_class: bool) -> Iterator[tuple]:
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                a, b = span(node)
                is_class = isinstance(node, ast.ClassDef)
                head = raw[a : span(node.body[0])[0]].decode("utf-8", "replace").rstrip()
                head = re.sub(r":\s*(#.*)?$", "", head.split('"""')[0].rstrip())
                kind = "class" if is_class else "method" if in_class else "function"
                qualname = prefix + node.name
                yield row(path, "unit", "symbol", kind, node.name, qualname, collapse(head, 300), collapse(ast.get_docstring(node) or "", 220), (node.lineno, node.end_lineno), (a, b))
                yield from walk(node.body, qualname + ".", is_class)
            elif isinstance(node, ast.Import | ast.ImportFrom):
                module = "." * getattr(node, "level", 0) + (getattr(node, "module", None) or "") if isinstance(node, ast.ImportFrom) else ""
                full = [(f"{module}.{n.name}" if module else n.name) for n in node.names]
                statement = ast.get_source_segment(text, node) or ""
                star = any(n.name == "*" for n in node.names)
                yield row(path, "unit", "symbol", "import", statement if star else node.names[0].name.split(".")[-1], statement if star else full[0], collapse(statement, 300), "", (node.lineno, node.end_lineno), span(node))
                aliases.extend((n.asname or n.name, target) for n, target in zip(node.names, full) if n.name != "*" and (n.asname or isinstance(node, ast.ImportFrom)))
            else:
                for field in ("body", "orelse", "finalbody", "handlers", "cases"):
                    for inner in getattr(node, field, None) or []:
                        yield from walk([inner] if isinstance(inner, ast.stmt) else inner.body, prefix, in_class)

    yield from walk(tree.body, "", False)
    for alias, target in valid_aliases(aliases):
        yield row(path, "alias", name=alias, target=target)
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            full = collapse(ast.get_source_segment(text, node.func) or "", 300)
            sep = next((s for s in (".", "::", "/") if s in full), None)
            yield row(path, "call", name=full.split(sep)[-1] if sep else full, qualname=full, lines=(node.lineno, node.end_lineno), span=span(node))


def markdown(path: str, text: str, most_lines: int = 150) -> Iterator[tuple]:
    lines = text.split("\n")
    parts, title, begin, fence = [], "", 0, False
    for i, line in enumerate(lines):
        if re.match(r"\s*(```|~~~)", line):
            fence = not fence
        elif not fence and re.match(r"#{1,6}\s+\S", line):
            if i > begin and (title or any(x.strip() for x in lines[begin:i])):
                parts.append((title, begin, i))
            title, begin = line.strip(), i
    parts.append((title, begin, len(lines)))
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line.encode()) + 1)
    for title, a, b in parts:
        for x in range(a, b, most_lines):
            y = min(b, x + most_lines)
            body = " ".join(s.strip() for s in lines[x:y] if s.strip())
            if body:
                yield row(path, "unit", "chunk", "doc_chunk", title or path, f"#{path}#{title.lstrip('#').strip()}", "", body[:220], (x + 1, y), (offsets[x], min(offsets[y], len(text.encode()))))


def _leaves(value, prefix: str) -> Iterator[tuple[str, str]]:
    for k, v in value.items():
        key = f"{prefix}.{k}" if prefix else str(k)
        if isinstance(v, dict) and v:
            yield from _leaves(v, key)
        else:
            yield key, json.dumps(v, ensure_ascii=False)


def config(path: str, text: str, language: str) -> Iterator[tuple]:
    found: list[tuple[str, str, int]] = []
    lines = text.split("\n")
    if language == "json":
        try:
            data = json.loads(text)
        except ValueError:
            data, language = None, "yaml"
        if isinstance(data, dict):
            seen: dict[str, int] = {}
            for key, value in _leaves(data, ""):
                last = key.split(".")[-1]
                nth = seen[last] = seen.get(last, 0) + 1
                at = [i for i, s in enumerate(lines, 1) if f'"{last}"' in s]
                found.append((key, value, at[min(nth, len(at)) - 1] if at else 1))
    if language == "yaml":
        stack: list[tuple[int, str]] = []
        for i, s in enumerate(lines, 1):
            m = re.match(r"""(\s*)["']?([A-Za-z_][\w.-]*)["']?\s*:(?:\s+|$)(.*)""", s)
            if not m or s.lstrip().startswith(("#", "- ")):
                continue
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), m[2]))
            value = m[3].strip().rstrip(",")
            if value and value not in ("{", "["):
                found.append((".".join(k for _, k in stack), value, i))
    elif language in ("toml", "ini"):
        section = ""
        for i, s in enumerate(lines, 1):
            s = re.split(r"#|;|//", s)[0].strip()
            if m := re.fullmatch(r"\[+\s*([^\]]+?)\s*\]+", s):
                section = m[1]
            elif m := re.match(r"([^=:\s][^=:]*?)\s*[=:]\s*(.*)", s):
                found.append((f"{section}.{m[1]}" if section else m[1], m[2], i))
    elif language == "env":
        for i, s in enumerate(lines, 1):
            if m := re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*)", s):
                found.append((m[1], m[2].strip(), i))
    for key, value, i in found:
        yield row(path, "unit", "symbol", "config_key", key.split(".")[-1], key, f"{key} = {value}"[:300], "", (i, i))


Extractor = Callable[[str, str, str], Iterator[tuple]]

#: By language: path, text and language to rows. register puts others in their place.
EXTRACTORS: dict[str, Extractor] = {
    "python": lambda path, text, _: python(path, text),
    "markdown": lambda path, text, _: markdown(path, text),
    **dict.fromkeys(("json", "yaml", "toml", "ini", "env"), config),
    **dict.fromkeys(scanners.LANGUAGES, scanners.scan),
}


def register(language: str, extractor: Extractor) -> None:
    EXTRACTORS[language] = extractor


def extract_one(path: str, language: str, text: str, extractors: dict[str, Extractor] | None = None) -> Iterator[tuple]:
    known = (EXTRACTORS if extractors is None else extractors).get(language)
    if known is not None:
        yield from known(path, text, language)


def slice_bytes(text: str, start: int, end: int) -> str:
    """The part of a text between two places in its UTF-8 bytes."""
    return text.encode("utf-8", "replace")[start:end].decode("utf-8", "replace")


def extract(files: DataFrame) -> DataFrame:
    """UNITS of files (path, language, text): rec is unit, call (name: last part, qualname: chain) or alias."""

    extractors = dict(EXTRACTORS)  # as registered here, also on the executors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, lang, t in zip(b["path"], b["language"], b["text"]) for r in extract_one(p, lang, t or "", extractors)]
            yield pd.DataFrame(rows, columns=NAMES)

    return files.select("path", "language", "text").mapInPandas(run, UNITS)
