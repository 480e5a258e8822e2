"""A small code index, as rows: two packages with chains of calls, import aliases and a shadowed alias."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_FILES = ["core/chain.py", "core/utils.py", "core/http.py", "core/auth.py", "app/api.py", "app/auth.py", "app/local.py", "app/models.py", "tests/test_chain.py"]

# file, kind, unit_type, name, qualname, parent
_UNITS = [
    *((0, "symbol", "function", n, n, None) for n in ("entry", "stage1", "stage2", "stage3", "stop", "other_entry")),
    (1, "symbol", "import", "path", "os.path", None),
    (1, "symbol", "function", "is_file", "is_file", None),
    (1, "symbol", "function", "is_dir", "is_dir", None),
    (2, "symbol", "function", "fetch", "fetch", None),
    (3, "symbol", "function", "validate", "validate", None),
    (4, "symbol", "import", "fetch", "core.http.fetch", None),
    (4, "symbol", "function", "get_user", "get_user", None),
    (4, "symbol", "function", "get_item", "get_item", None),
    (5, "symbol", "import", "auth", "core.auth", None),
    (5, "symbol", "function", "login", "login", None),
    (6, "symbol", "import", "validate", "core.auth.validate", None),
    (6, "symbol", "function", "validate", "validate", None),
    (6, "symbol", "function", "check", "check", None),
    (7, "symbol", "class", "TokenValidator", "TokenValidator", None),
    (7, "symbol", "method", "validate", "TokenValidator.validate", "TokenValidator"),
    (7, "symbol", "method", "is_expired", "TokenValidator.is_expired", "TokenValidator"),
    (8, "symbol", "function", "test_stage2", "test_stage2", None),
]

# caller, callee_full
_CALLS = [
    ("entry", "stage1"), ("stage1", "stage2"), ("stage2", "stage3"), ("stage3", "stop"), ("other_entry", "stage2"),
    ("is_file", "opath.exists"), ("is_dir", "opath.isdir"), ("get_user", "http_fetch"), ("get_item", "http_fetch"),
    ("login", "auth.validate"), ("check", "validate"), ("is_expired", "self.check_clock"), ("test_stage2", "chain.stage2"), ("test_stage2", "stage2"),
]

# file, alias, target
_ALIASES = [(1, "opath", "os.path"), (4, "http_fetch", "core.http.fetch"), (5, "auth", "core.auth"), (6, "validate", "core.auth.validate"), (8, "chain", "core.chain")]

_SCHEMAS = {
    "units": "unit_id long, file_id long, kind string, unit_type string, name string, qualname string, file_path string, start_line int, start_col int, parent_id long",
    "edges": "edge_id long, caller_unit_id long, file_id long, callee string, callee_full string, line int, callee_unit_id long",
    "aliases": "file_id long, alias string, target string",
    "files": "file_id long, path string",
}


def unit(name: str) -> int:
    """The id of the first unit of that name which isn't an import."""
    return next(i for i, u in enumerate(_UNITS) if u[3] == name and u[2] != "import")


@lru_cache
def rows(name: str) -> list[tuple]:
    if name == "units":
        return [(i, f, kind, t, n, q, _FILES[f], i + 1, 0, unit(p) if p else None) for i, (f, kind, t, n, q, p) in enumerate(_UNITS)]
    if name == "edges":
        return [(i, unit(a), _UNITS[unit(a)][0], full.split(".")[-1], full, 10 + i, None) for i, (a, full) in enumerate(_CALLS)]
    return list(_ALIASES) if name == "aliases" else list(enumerate(_FILES))


def frames(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """units, edges, aliases, files"""
    return tuple(spark.createDataFrame(rows(n), s) for n, s in _SCHEMAS.items())


def sql(name: str) -> str:
    """A SELECT of the same rows."""
    kinds = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR"}
    columns = [c.split() for c in _SCHEMAS[name].split(", ")]
    quote = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    values = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows(name))
    return f"SELECT {', '.join(f'{c}::{kinds[k]} AS {c}' for c, k in columns)} FROM (VALUES {values}) v({', '.join(c for c, _ in columns)})"
