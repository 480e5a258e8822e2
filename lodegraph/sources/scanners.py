"""Units, calls and import aliases of languages with braces: TypeScript and JavaScript, Go, Rust, Java, C, C++ and C#.

Comments and strings are blanked, places kept. Declarations are heads found by patterns; one counts if every pair of
braces around it is the body of a container (a class, an impl block, a namespace), whose name it is put behind. So
functions inside functions are no units of their own. Calls are chains of names before a parenthesis.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from .rows import collapse, row, valid_aliases

_NAME = r"[A-Za-z_$][\w$]*"
_BLANK = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|`(?:\\.|[^`\\])*`?|'(?:\\.|[^'\\\n]){1,8}'""", re.S)
_BLANK_JS = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|`(?:\\.|[^`\\])*`?|'(?:\\.|[^'\\\n])*'?""", re.S)
_CALL = re.compile(rf"(?<![\w$.]){_NAME}(?:\s*(?:\.|::|->|\?\.)\s*{_NAME})*(?=\s*(?:::)?(?:<[\w\s,<>:&]*>)?\()")
_NOT_CALLS = frozenset("if for while switch catch return function func fn sizeof match loop using lock foreach synchronized super when typeof await yield delete throw else do in of instanceof new case alignof decltype static_assert where nameof import export var let const def macro_rules pub".split())
_GO_WORDS = frozenset("go defer select range map chan".split())
_ARGS = r"\((?:[^(){}]|\([^(){}]*\))*\)"


@dataclass
class Head:
    """A declaration: its type, a pattern with the groups n (name) and, for some, r (receiver); where it may stand:
    "top" (no container or a namespace), "in" (a type's body) or "any"; and what its body is to those inside:
    "type", "space" (a prefix that is no unit, or a namespace) or nothing."""

    type: str
    pattern: str
    where: str = "any"
    body: str = ""
    unit: bool = True


_JAVA_TYPE = r"(?:[\w.]+(?:<[^(){};=]*>)?(?:\[\])*)"
LANGUAGES: dict[str, tuple[str, list[Head]]] = {
    "typescript": (
        ".",
        [
            Head("class", rf"(?:\bexport\s+)?(?:\bdefault\s+)?(?:\babstract\s+)?\bclass\s+(?P<n>{_NAME})", "top", "type"),
            Head("interface", rf"(?:\bexport\s+)?\binterface\s+(?P<n>{_NAME})", "top", "type"),
            Head("type_alias", rf"(?:\bexport\s+)?\btype\s+(?P<n>{_NAME})(?:<[^=]*>)?\s*=", "top"),
            Head("enum", rf"(?:\bexport\s+)?(?:\bconst\s+)?\benum\s+(?P<n>{_NAME})", "top"),
            Head("function", rf"(?:\bexport\s+)?(?:\bdefault\s+)?(?:\basync\s+)?\bfunction\s*\*?\s*(?P<n>{_NAME})", "top"),
            Head("function", rf"(?:\bexport\s+)?\b(?:const|let|var)\s+(?P<n>{_NAME})\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?:function\b|(?:{_ARGS}|{_NAME})\s*(?::[^=;{{}}\n]+)?=>)", "top"),
            Head("method", rf"(?<=[{{}};\n])[ \t]*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+|\*\s*)*(?P<n>#?{_NAME})\s*\??\s*(?:<[^<>()]*>)?{_ARGS}\s*(?::[^{{;=\n]+)?(?=[{{;\n])", "in"),
        ],
    ),
    "go": (
        ".",
        [
            Head("method", r"^func\s+\(\s*(?:\w+\s+)?\*?\s*(?P<r>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<n>\w+)", "top"),
            Head("function", r"^func\s+(?P<n>\w+)", "top"),
            Head("struct", r"^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+struct\b", "top"),
            Head("interface", r"^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+(?!struct\b)", "top"),
        ],
    ),
    "rust": (
        "::",
        [
            Head("impl", r"\bimpl\b(?:\s*<[^{}]*?>)?\s+(?:[\w:<>,'&\s]+?\s+for\s+)?(?P<n>\w+)", "top", "space", False),
            *(Head(k, rf"(?:\bpub(?:\([^)]*\))?\s+)?\b{k}\s+(?P<n>\w+)", "top") for k in ("struct", "enum", "trait")),
            Head("function", r"(?:\bpub(?:\([^)]*\))?\s+)?(?:\b(?:const|async|unsafe|extern)\s+)*\bfn\s+(?P<n>\w+)"),
        ],
    ),
    "java": (
        ".",
        [
            *(Head(k, rf"(?:\b(?:public|private|protected|static|final|abstract|sealed)\s+)*\b{k}\s+(?P<n>\w+)", "any", "" if k == "enum" else "type") for k in ("class", "interface", "enum", "record")),
            Head("method", rf"(?<=[{{}};\n])[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^(){{}}]*>\s*)?(?:{_JAVA_TYPE}\s+)?(?P<n>\w+)\s*{_ARGS}\s*(?:throws\s+[\w.,\s]+)?(?=[{{;])", "in"),
        ],
    ),
    "c": (
        "::",
        [
            Head("namespace", r"\bnamespace\s+(?P<n>\w+(?:::\w+)*)", "top", "space", False),
            *(Head(k, rf"(?<!enum )\b{k}\s+(?:class\s+)?(?P<n>\w+)(?=[^;(){{}}]*\{{)", "any", "" if k in ("enum", "union") else "type") for k in ("class", "struct", "union", "enum")),
            Head("typedef", r"\btypedef\b[^;{}]*?(?:\{[^{}]*\}\s*)?(?P<n>\w+)\s*(?=;)", "top"),
            Head("method", rf"(?<=[{{}};:\n])[ \t]*(?:(?:virtual|static|inline|explicit|constexpr|friend)\s+)*(?:[\w:<>,*&]+[\s*&]+)*?(?P<n>~?\w+|operator\s*\S{{1,2}})\s*{_ARGS}\s*(?:(?:const|noexcept|override|final)\s*)*(?::[^{{;]*)?(?=\{{)", "in"),
            Head("function", rf"^(?:template\s*<[^{{}};]*>\s*)?(?:[\w:<>,*&~]+[\s*&]+)*?(?P<n>(?:\w+::)*~?\w+)\s*{_ARGS}\s*(?:(?:const|noexcept|override)\s*)*(?::[^{{;]*)?(?=\{{)", "top"),
        ],
    ),
    "csharp": (
        ".",
        [
            Head("namespace", r"\bnamespace\s+(?P<n>[\w.]+)(?=\s*\{)", "top", "space", False),
            *(Head(k, rf"(?:\b(?:public|private|protected|internal|static|sealed|abstract|partial|readonly)\s+)*\b{k}\s+(?P<n>\w+)", "any", "" if k == "enum" else "type") for k in ("class", "interface", "struct", "enum", "record")),
            Head("method", rf"(?<=[{{}};\]\n])[ \t]*(?:(?:public|private|protected|internal|static|virtual|override|sealed|abstract|async|extern|new|partial|unsafe)\s+)*(?:[\w.]+(?:<[^(){{}};=]*>)?(?:\[,*\])*\??\s+)?(?P<n>\w+)\s*(?:<[^<>()]*>)?{_ARGS}\s*(?::\s*(?:base|this)\s*{_ARGS}\s*)?(?=\{{|;|=>)", "in"),
        ],
    ),
}
for _other, _same in (("javascript", "typescript"), ("tsx", "typescript"), ("cpp", "c")):
    LANGUAGES[_other] = LANGUAGES[_same]
_COMPILED = {k: [(h, re.compile(h.pattern, re.M)) for h in heads] for k, (_, heads) in LANGUAGES.items()}


def blank(text: str, language: str) -> str:
    """The text with comments and strings as spaces; line ends stay."""
    some = _BLANK_JS if language in ("typescript", "javascript", "tsx") else _BLANK
    return some.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def leading_comments(lines: list[str], start: int, most: int = 220) -> str:
    """The comment lines just above line start (from 0), blank lines within them passed over, without their marks."""
    found: list[str] = []
    i = start - 1
    while i >= 0:
        s = lines[i].strip()
        if re.match(r"//|/\*|\*|#(?!include|define|if|endif|pragma)", s):
            found.append(re.sub(r"^(?:/{2,}!?|/\*+!?|\*+/?|#+)\s?|\s*\*+/$", "", s).strip())
        elif s or not found:
            break
        i -= 1
    return collapse(" ".join(x for x in reversed(found) if x), most)


def _aliases(text: str, code: str, language: str) -> Iterator[tuple[str, str, int, int]]:
    """(alias or "", target, start, end) of each import; an alias of "" makes a unit only."""
    live = lambda m: code[m.start() : m.start() + 1].strip() != ""
    if language in ("typescript", "javascript", "tsx"):
        for m in re.finditer(r"""^[ \t]*import\s+(?:type\s+)?(?:([^;'"]*?)\s+from\s+)?["']([^"']+)["']""", text, re.M):
            if live(re.compile(r"\S").search(text, m.start())):
                module = m[2].lstrip("@").replace("/", ".")
                yield "", module, m.start(), m.end()
                clause = m[1] or ""
                if n := re.search(rf"\*\s+as\s+({_NAME})", clause):
                    yield n[1], module, m.start(), m.end()
                if n := re.match(rf"\s*({_NAME})\s*(?:,|$)", clause):
                    yield n[1], f"{module}.default", m.start(), m.end()
                for n in re.finditer(rf"({_NAME})(?:\s+as\s+({_NAME}))?", (re.search(r"\{([^}]*)\}", clause) or ["", ""])[1]):
                    if n[1] != "type":
                        yield n[2] or n[1], f"{module}.{n[1]}", m.start(), m.end()
    elif language == "go":
        for m in re.finditer(r"^import\s*(?:\(([^)]*)\)|[^\n]*)", text, re.M):
            if live(m):
                for n in re.finditer(r'(?:([\w.]+)\s+)?"([^"]+)"', m[0].removeprefix("import")):
                    yield (n[1] if n[1] and n[1] not in (".", "_") else ""), n[2].replace("/", "."), m.start(), m.end()
    elif language == "rust":
        for m in re.finditer(r"^[ \t]*(?:pub\s+)?use\s+([^;]+);", code, re.M):
            for path, name in _uses(re.sub(r"\s+", " ", m[1]).strip(), ""):
                yield name, path, m.start(), m.end()
    elif language == "java":
        for m in re.finditer(r"^[ \t]*import\s+(?:static\s+)?([\w.]+)(\.\*)?\s*;", code, re.M):
            yield ("" if m[2] else m[1].split(".")[-1]), m[1], m.start(), m.end()
    elif language in ("c", "cpp"):
        for m in re.finditer(r'^[ \t]*#\s*include\s*[<"]([^>"\n]+)[>"]', text, re.M):
            if live(re.compile(r"\S").search(text, m.start())):
                yield "", m[1], m.start(), m.end()
    elif language == "csharp":
        for m in re.finditer(r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;", code, re.M):
            yield m[1] or "", m[2], m.start(), m.end()


def _uses(part: str, prefix: str) -> Iterator[tuple[str, str]]:
    """(path, alias or "") of a use declaration, nested lists and all."""
    part = part.strip()
    if part.endswith("}"):
        head, _, inner = part.partition("{")
        depth, item = 0, ""
        for c in inner[:-1] + ",":
            if c == "," and not depth:
                if item.strip():
                    yield from _uses(item, prefix + head.strip())
                item = ""
                continue
            depth += (c == "{") - (c == "}")
            item += c
    else:
        path, _, name = part.partition(" as ")
        path = prefix + path.strip()
        path = path.removesuffix("::self")
        yield path, name.strip()


def scan(path: str, text: str, language: str) -> Iterator[tuple]:
    """Rows of units, aliases and calls."""
    sep, _ = LANGUAGES[language]
    code = blank(text, language)
    lines = text.split("\n")
    breaks = [-1, *(i for i, c in enumerate(text) if c == "\n")]
    line = lambda i: bisect_right(breaks, i - 1)
    sizes = None if text.isascii() else [0]
    if sizes is not None:
        for c in text:
            sizes.append(sizes[-1] + len(c.encode("utf-8", "replace")))
    byte = (lambda i: i) if sizes is None else sizes.__getitem__

    # Each brace's partner, and the innermost open brace after each one.
    partner, around, places, tops, stack = {}, {}, [], [], []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            around[m.start()] = stack[-1] if stack else None
            stack.append(m.start())
        elif stack:
            partner[stack.pop()] = m.start()
        places.append(m.start())
        tops.append(stack[-1] if stack else None)

    heads = sorted((m.start("n"), i, m) for i, (_, p) in enumerate(_COMPILED[language]) for m in p.finditer(code))
    containers: dict[int, tuple[str, str, str]] = {}  # by open brace: full name, last name, kind
    taken, found = set(), {}
    for at, i, m in heads:
        h, _ = _COMPILED[language][i]
        name = m["n"]
        if at in taken or name in _NOT_CALLS:
            continue
        k = bisect_right(places, at - 1) - 1
        inner = tops[k] if k >= 0 else None
        up = inner
        while up is not None and up in containers:
            up = around[up]
        kind = containers[inner][2] if inner in containers else "space"
        if up is not None or h.where == "top" and kind != "space" or h.where == "in" and kind != "type":
            continue
        end = m.end()
        body = re.compile(r"[{;]").search(code, end)
        if h.type == "type_alias":
            body = re.compile(r";|\n(?=\s*(?:\n|[\w@}]))").search(code, end)
        elif language in ("typescript", "javascript", "tsx") and h.type == "method" and not (body and code[body.start()] == "{" and not code[end : body.start()].strip()):
            body = re.compile(r"[;\n]").search(code, end)
        open_ = body.start() if body and code[body.start()] == "{" else None
        stop = (partner.get(open_, len(text) - 1) + 1) if open_ is not None else (body.end() if body else len(text))
        if language == "go" and h.type == "interface" and "interface" not in code[end : end + 10]:
            stop, open_ = (text.find("\n", end) + 1 or len(text)), None
        taken.add(at)
        prefix = containers[inner][0] + sep if inner in containers else ""
        if m.groupdict().get("r"):
            prefix = m["r"] + "."
        type_ = h.type
        if type_ == "method" and language in ("java", "csharp") and inner in containers and containers[inner][1] == name:
            type_ = "constructor"
        if language == "rust" and type_ == "function" and inner in containers:
            type_ = "method"
        if language in ("c", "cpp") and type_ == "function" and "::" in name:
            type_ = "method"
        if open_ is not None and h.body:
            containers[open_] = (prefix + name, name.split("::")[-1].split(".")[-1], h.body)
        if h.unit:
            first = m.start() + len(m[0]) - len(m[0].lstrip())
            signature = collapse(text[first : open_ if open_ is not None else stop].rstrip(" ;\n"), 300)
            args = collapse(code[m.end("n") : m.end()], 300) if language == "cpp" and type_ == "method" else str(at)
            unit = (stop - first, row(path, "unit", "symbol", type_, name.split("::")[-1] if language in ("c", "cpp") else name, prefix + name, signature, leading_comments(lines, line(first) - 1), (line(first), line(stop - 1)), (byte(first), byte(stop))))
            # Of declarations and definitions of one overload the longest stays.
            key = (prefix + name, args)
            if key not in found or found[key][0] < unit[0]:
                found[key] = unit
    yield from (u for _, u in found.values())

    pairs = []
    for alias, target, a, b in _aliases(text, code, language):
        statement = collapse(text[a:b], 300)
        if not alias or language not in ("typescript", "javascript", "tsx"):
            name = re.split(r"::|\.|/", target)[-1] if language not in ("c", "cpp") else target
            yield row(path, "unit", "symbol", "import", name or target, target, statement, "", (line(a + 1), line(b - 1)), (byte(a), byte(b)))
        if alias:
            pairs.append((alias, target))
    for alias, target in valid_aliases(pairs):
        yield row(path, "alias", name=alias, target=target)

    for m in _CALL.finditer(code):
        full = re.sub(r"\s+", "", text[m.start() : m.end()]).replace("?.", ".").replace("->", ".")
        last = re.split(r"\.|::", full)[-1]
        if m.start() in taken or m.end() - len(last) in taken or full.split(".")[0] in _NOT_CALLS and "." not in full:
            continue
        if language == "go" and full in _GO_WORDS:
            continue
        if re.search(r"\bnew\s+$", code[max(0, m.start() - 8) : m.start()]):
            continue
        yield row(path, "call", name=last, qualname=collapse(full, 300), lines=(line(m.start()), line(m.end() - 1)), span=(byte(m.start()), byte(m.end())))
