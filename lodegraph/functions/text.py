"""Tokens, folding and small string functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIRS = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.normalize("NFD", chr(c))[0].isascii() and chr(c).lower() == chr(c)]
FOLD_FROM, FOLD_TO = "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def fold(text: Column) -> Column:
    """Lower case, without the diacritics of Latin letters."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded, in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def query_phrases(query: str) -> list[list[str]]:
    """A query's terms, each a phrase of tokens. Terms without a token match nothing and are left out."""
    out = []
    for term in re.findall(r"[\w.$:#/+-]+", query):
        low = term.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))
        phrase = ["".join(x) for x in re.findall(r"[^\W_]+", low)]
        if phrase:
            out.append(phrase)
    return out


def occurrences(toks: Column, phrase: list[str]) -> Column:
    """How often the phrase stands in an array of tokens."""

    def at(x: Column, i: Column) -> Column:
        ok = x == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            ok = ok & F.coalesce(F.get(toks, i + k) == word, F.lit(False))
        return ok

    return F.size(F.filter(toks, at))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def collapse(text: Column, n: int) -> Column:
    """White space runs as one blank, trimmed and cut to n characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, n)


def last_segment(chain: Column) -> Column:
    """The last part of a chain by the first separator present: a dot, two colons, a slash."""
    part = lambda sep: F.element_at(F.split(chain, re.escape(sep)), -1)
    return F.when(F.contains(chain, F.lit(".")), part(".")).when(F.contains(chain, F.lit("::")), part("::")).when(F.contains(chain, F.lit("/")), part("/")).otherwise(chain)
