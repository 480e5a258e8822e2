"""Routing of queries: class, budgets and the symbol that an impact question asks about."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: class: (tokens of evidence, results)
BUDGETS = {"symbol": (800, 3), "local": (2000, 5), "debugging": (4000, 8), "impact": (6000, 10)}

DOTTED, SNAKE = r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+", r"[A-Za-z_]\w*_\w+"
CAMEL, UPPER = r"[A-Z][A-Za-z0-9]*(?:[a-z][A-Z]|[A-Z][a-z])[A-Za-z0-9]*", r"[A-Z][A-Z0-9_]+"
FILE = r"(?:^|[\s(])[\w\-./]+\.(?:tsx|jsx|hpp|cpp|java|py|ts|js|go|rs|cc|md|c|h)\b"
# Sorted phrases, tested anywhere in the lower-cased query.
IMPACT = "|".join(sorted({"blast radius", "callees", "callers", "dependencies", "depends on", "downstream", "impact", "imports", "invoked by", "referenced by", "used by", "what breaks", "wh(?:at|o) (?:calls|uses)"}))
DEBUG = "|".join(sorted({"across", "between", "broken", "crash", "cross-module", "debug", "error", "exception", "fail(?:s|ure)", "flow from", "hang", "not working", "segfault", "traceback", "why (?:does|is)"}))

_SKIP = frozenset(("a an are class code does file files for function i if in interface is it its method of on that the they this to what when where which who why " "add adding alter break breaking call change changed changes changing edit editing import invoke modify remove removed removing run update updating use").split())
_ASKS = frozenset("breaks calls depends imports invokes references touches uses".split())


def classify(query: Column) -> Column:
    """symbol, impact, debugging or local, by the first rule that fits. Word characters are ASCII ones."""
    q = F.trim(query)
    low = F.lower(q)
    words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    whole = lambda *p: q.rlike("^(?:" + "|".join(p) + ")$")
    some = F.exists(F.regexp_extract_all(q, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), lambda t: t.rlike("^(?:" + "|".join((SNAKE, CAMEL, UPPER)) + ")$"))
    return (
        F.when(F.length(q) < 2, "local")
        .when(whole(DOTTED, SNAKE, CAMEL) | F.element_at(words, 1).rlike(f"^{UPPER}$"), "symbol")
        .when(q.rlike(FILE), "symbol")
        .when(low.rlike(IMPACT), "impact")
        .when(low.rlike(DEBUG), "debugging")
        .when((F.size(words) <= 3) & some & ~low.rlike(CONCEPT), "symbol")
        .otherwise("local")
    )


CONCEPT = "|".join(sorted({"architecture", "design", "explain", "how (?:does|is)", "lifecycle", "mechanism", "module", "overview", "system", "understand", "works"}))


def budget(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, v[0]) for k, v in BUDGETS.items()), F.lit(BUDGETS["local"][0]))


def top_k(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, v[1]) for k, v in BUDGETS.items()), F.lit(BUDGETS["local"][1]))


def impact_symbol(query: str) -> str | None:
    """The first telling identifier after a word that asks for impact, else the last one of all."""
    words = [w.strip("?.,()[]") for w in query.split()]
    names = [(m.group() if (m := re.match(r"[A-Za-z_][\w.$:]*", w, re.A)) else "") for w in words]
    for i, w in enumerate(words):
        if w.lower() in _ASKS:
            for n in names[i + 1 :]:
                if n.lower() not in _SKIP:
                    return n
    left = [n for n in re.findall(r"[A-Za-z_][\w.$:]*", query, re.A) if n.lower() not in _SKIP]
    return left[-1] if left else None


def evidence_share(total: int, count: int) -> int:
    """Tokens of evidence for each of count results."""
    return total if count <= 1 else max(200, total // count)
