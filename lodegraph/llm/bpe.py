"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can end its encoding. It is the longest vocabulary suffix of
the prefix that forms a valid pair with the last token of what precedes it; a pair is valid if encoding its bytes
gives that pair back. Keeping each prefix's last token gives the encoding of every prefix, its token count, exact
appends and re-encoding near an edit, without running the merges again.

Texts are first cut into pieces by the vocabulary's pattern, and each distinct piece is solved once a worker.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import regex

from .common import BYTE_BASE, mix, powers, worker_cache

#: Pieces that a worker remembers, about 40 bytes each; beyond that it starts anew.
KNOWN_PIECES = 500_000

_SPACE = "\t-\r \x85\xa0  -     　"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WIDE = re.compile("[^\x00-ɏ]")
_NARROW_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def pieces(text: str) -> list[str]:
    """The matches of the public byte-level pattern; texts of Latin letters take a faster way to the same."""
    return (_PIECES if _WIDE.search(text) else _NARROW_PIECES).findall(text)


class PrefixBPE:
    """Encodes single pieces. rank gives the priority of merging two adjacent tokens, or None if they don't merge."""

    def __init__(self, vocabulary: dict[bytes, int], rank: Callable[[bytes, bytes], int | None], whole: bool):
        """whole: a piece that is itself in the vocabulary is one token, whatever the merges say."""
        self.vocabulary, self.rank, self.whole = vocabulary, rank, whole
        self.ends: dict[bytes, bool] | None = None
        self.bytes = {i: b for b, i in vocabulary.items()}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.splits: dict[bytes, tuple[bytes, bytes] | None] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """The encoding by running the merges, as a reference for short strings."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge, the last one, makes this token; None for single bytes and for tokens that
        the merges never make."""
        if token not in self.splits:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                ranks = [r for x in zip(parts, parts[1:]) if (r := self.rank(*x)) is not None]
                if not ranks:
                    break
                i = next(i for i, x in enumerate(zip(parts, parts[1:])) if self.rank(*x) == min(ranks))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.splits[token] = (parts[0], parts[1]) if len(parts) == 2 and self.rank(*parts) is not None else None
        return self.splits[token]

    def reachable(self, token: bytes) -> bool:
        return len(token) == 1 or self.split(token) is not None

    def valid(self, a: bytes, b: bytes) -> bool:
        """Whether the encoding of a+b is a, b. Undoes the two tokens' merges from the last one on. Each step
        shows the pair that faced each other across the border before a merge took one of them away; had that
        pair merged sooner, or as soon but further left, the border would not have lasted."""
        until = float("inf")
        while True:
            across = self.rank(a, b)
            if across is not None and across < until:
                return False
            left, right = (self.split(a) if len(a) > 1 else None), (self.split(b) if len(b) > 1 else None)
            if left is None and right is None:
                return True
            last_a, last_b = self.rank(*left) if left else -1, self.rank(*right) if right else -1
            if last_a > last_b:  # equal ranks: the left one merged first, so the right one is undone first
                a, until = left[1], last_a
            else:
                b, until = right[0], last_b + 0.5

    def _known_valid(self, a: bytes, b: bytes) -> bool:
        """valid, remembered for some pairs; about 200 bytes each."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= 50_000:
                self.pairs.clear()
            known = self.pairs[(a, b)] = self.valid(a, b)
        return known

    def last_tokens(self, piece: bytes, known: list[bytes] | None = None) -> list[bytes]:
        """Item i is the last token of the encoding of piece[:i+1]; known holds those of a prefix of it."""
        last = list(known or ())
        if self.ends is None:
            self.ends = dict.fromkeys((t[i:] for t in self.vocabulary for i in range(1, len(t))), False)
            self.ends.update(dict.fromkeys(self.vocabulary, True))
        ends = self.ends.get
        for end in range(len(last) + 1, len(piece) + 1):
            found = []  # suffixes of the prefix that are tokens, the longest last
            start = end - 1
            while start >= 0:
                token = piece[start:end]
                is_token = ends(token)
                if is_token:
                    found.append(token)
                elif is_token is None:
                    break
                start -= 1
            while True:
                token = found.pop()
                size = len(token)
                if size != end:
                    if not self._known_valid(last[end - size - 1], token):
                        continue
                if size == 1 or self.split(token):
                    break
            last.append(token)
        return last

    @staticmethod
    def counts(last: list[bytes]) -> list[int]:
        """Tokens of every prefix, the empty one first."""
        n = [0]
        for i, token in enumerate(last, 1):
            n.append(n[i - len(token)] + 1)
        return n

    @staticmethod
    def tokens(last: list[bytes]) -> list[bytes]:
        out, i = [], len(last)
        while i:
            out.append(last[i - 1])
            i -= len(last[i - 1])
        return out[::-1]

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Tokens of the library's encoding of each prefix of a piece, prefixes taken as pieces themselves."""
        n = self.counts(self.last_tokens(piece))
        if self.whole:
            for i in range(1, len(piece) + 1):
                if n[i] > 1 and piece[:i] in self.vocabulary:
                    n[i] = 1
        return n

    def encode(self, piece: bytes) -> list[int]:
        if self.whole and piece in self.vocabulary:
            return [self.vocabulary[piece]]
        return [self.vocabulary[t] for t in self.tokens(self.last_tokens(piece))]


def _byte_names() -> dict[str, int]:
    """The printable stand-ins that vocabulary files of this kind have for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> tuple[PrefixBPE, list[str]]:
    """The vocabulary in a .tiktoken or .json file, and the special strings that its library finds in texts."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return PrefixBPE(ranks, lambda a, b: ranks.get(a + b), True), []
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    model, names = content["model"], _byte_names()
    to_bytes = lambda s: bytes(names[c] for c in s)
    special = [t["content"] for t in content.get("added_tokens", [])]
    vocabulary = {to_bytes(k): v for k, v in model["vocab"].items() if k not in special}
    order = {}
    for i, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        order[(to_bytes(a), to_bytes(b))] = i
    return PrefixBPE(vocabulary, lambda a, b: order.get((a, b)), bool(model.get("ignore_merges"))), special


def _byte_values() -> np.ndarray:
    cache = worker_cache()
    if "byte values" not in cache:
        cache["byte values"] = np.random.default_rng(20240301).integers(1, 1 << 63, 256, np.uint64)
    return cache["byte values"]


class _Table:
    """Positive numbers by 64-bit keys, open addressing in numpy."""

    def __init__(self):
        self.bits, self.n = 12, 0
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The values, 0 where there is none."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.values[slot]
        todo = np.flatnonzero((self.keys[slot] != h) & (out != 0))
        out[todo] = 0
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            v, same = self.values[slot], self.keys[slot] == h[todo]
            out[todo[same]] = v[same]
            more = ~same & (v != 0)
            todo, slot = todo[more], slot[more]
        return out

    def add(self, h: np.ndarray, v: np.ndarray) -> None:
        """New keys, each once."""
        if 2 * (self.n + len(h)) > 1 << self.bits:
            full = np.flatnonzero(self.values)
            h, v = np.concatenate([self.keys[full], h]), np.concatenate([self.values[full], v])
            while 2 * len(h) > 1 << self.bits:
                self.bits += 1
            self.n = 0
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.n += len(h)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.values[slot] == 0
            self.keys[slot[free]], self.values[slot[free]] = h[free], v[free]
            rest = (self.keys[slot] != h) | (self.values[slot] != v)
            h, v, slot = h[rest], v[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From these, data[a:b] has the hash mix((total[b] - total[a]) * inverse[a]), wherever it lies."""
    p, q = powers(BYTE_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * p[:-1], out=total[1:])
    return total, q


class _Pieces:
    """Solved pieces by a 64-bit hash of their bytes."""

    #: Pieces up to this many bytes are solved side by side.
    SIDE = 48

    def __init__(self, bpe: PrefixBPE):
        self.bpe = bpe
        self.suffixes = self.pairs = None
        self.clear()

    def clear(self) -> None:
        self.table = _Table()
        self.ids = [np.zeros(0, np.int32)]
        self.start = [np.zeros(2, np.int64)]  # entry 0 is empty
        self.n, self.total = 1, 0

    def frozen(self) -> tuple[np.ndarray, np.ndarray]:
        """All entries' ids, and where each entry begins."""
        self.ids, self.start = [np.concatenate(self.ids)], [np.concatenate(self.start)]
        return self.ids[0], self.start[0]

    def entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, total: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The entry of each piece data[start:end]; unknown pieces are solved. total, q: prefix_hashes(data)."""
        h = mix((total[end] - total[start]) * q[start])
        out = self.table.find(h)
        new = np.flatnonzero(out == 0)
        if len(new):
            keys, first = np.unique(h[new], return_index=True)
            if self.n + len(keys) > KNOWN_PIECES and self.n > 1:
                self.clear()
                return self.entries(data, start, end, total, q)
            s, e = start[new[first]], end[new[first]]
            counts, ids = self.solve(data, s, e, total, q)
            self.table.add(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
            self.ids.append(ids)
            self.start.append(self.total + np.cumsum(counts))
            self.n, self.total = self.n + len(keys), self.total + len(ids)
            out[new] = self.table.find(h[new])
        return out

    def _suffixes(self) -> _Table:
        """All suffixes of tokens: the token's number plus 2, or 1 if the suffix is no token."""
        if self.suffixes is None:
            words = self.bpe.vocabulary
            known = dict.fromkeys((t[i:] for t in words for i in range(1, len(t))), 1)
            known.update((t, i + 2) for t, i in words.items() if self.bpe.reachable(t))
            some = list(known)
            at = np.zeros(len(some) + 1, np.int64)
            np.cumsum([len(x) for x in some], out=at[1:])
            total, q = prefix_hashes(np.frombuffer(b"".join(some), np.uint8))
            self.suffixes = _Table()
            self.suffixes.add(mix((total[at[1:]] - total[at[:-1]]) * q[at[:-1]]), np.fromiter(known.values(), np.int32, len(some)))
            self.pairs = _Table()
        return self.suffixes

    def _valid(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = mix((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
        out = self.pairs.find(h)
        new = np.flatnonzero(out == 0)
        if len(new):
            keys, first = np.unique(h[new], return_index=True)
            name = self.bpe.bytes
            ok = [1 + self.bpe.valid(name[x], name[y]) for x, y in zip(a[new[first]].tolist(), b[new[first]].tolist())]
            self.pairs.add(keys, np.array(ok, np.int32))
            out[new] = self.pairs.find(h[new])
        return out == 2

    def solve(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, total: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of pieces and their ids in a row: the same table of last tokens as PrefixBPE.last_tokens,
        filled for all short pieces at a time."""
        suffixes, m = self._suffixes(), len(start)
        size = end - start
        short = np.flatnonzero(size <= self.SIDE)
        widest = int(size[short].max(initial=0))
        last = np.full((m, widest + 1), -1, np.int32)
        back = np.zeros((m, widest + 1), np.int16)
        for k in range(1, widest + 1):
            live = short[size[short] >= k]
            e = start[live] + k
            found, some = [], np.arange(len(live))
            for n in range(1, k + 1):
                a = e[some] - n
                v = suffixes.find(mix((total[e[some]] - total[a]) * q[a]))
                some, v = some[v != 0], v[v != 0]
                if not len(some):
                    break
                token = np.flatnonzero(v > 1)
                found.append((n, some[token], v[token] - 2))
            open_ = np.ones(len(live), bool)
            for n, which, token in reversed(found):
                keep = open_[which]
                which, token = which[keep], token[keep]
                if n < k and len(which):
                    ok = self._valid(last[live[which], k - n], token)
                    which, token = which[ok], token[ok]
                open_[which] = False
                last[live[which], k], back[live[which], k] = token, n
        whole = np.zeros(m, bool)
        if self.bpe.whole:
            v = suffixes.find(mix((total[end] - total[start]) * q[start]))
            whole = (v > 1) & (size <= self.SIDE)
            last[np.flatnonzero(whole), size[whole]], back[np.flatnonzero(whole), size[whole]] = v[whole] - 2, size[whole]
        rest = np.flatnonzero(size > self.SIDE)
        long_ids = {i: self.bpe.encode(data[start[i] : end[i]].tobytes()) for i in rest.tolist()}
        counts = np.zeros(m, np.int64)
        at = np.where(size <= self.SIDE, size, 0)
        steps = []
        while (live := np.flatnonzero(at)).size:
            steps.append((live, last[live, at[live]]))
            counts[live] += 1
            at[live] -= back[live, at[live]]
        for i, x in long_ids.items():
            counts[i] = len(x)
        stop = np.cumsum(counts)
        ids = np.zeros(int(stop[-1]) if m else 0, np.int32)
        for k, (live, token) in enumerate(steps, 1):
            ids[stop[live] - k] = token
        for i, x in long_ids.items():
            ids[stop[i] - len(x) : stop[i]] = x
        return counts, ids


def _class_tables() -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache()
    if "piece classes" not in cache:
        kinds = np.full(0x280, 4, np.uint8)
        for c in range(0x280):
            if regex.match(r"\p{L}", chr(c)):
                kinds[c] = 1
            elif regex.match(r"\p{N}", chr(c)):
                kinds[c] = 2
            elif re.match(f"[{_SPACE}]", chr(c)):
                kinds[c] = 3
        wide = np.zeros(256, bool)
        wide[0xCA:] = True
        wide[0x27] = True  # an apostrophe may begin a contraction
        cache["piece classes"] = kinds, wide
    return cache["piece classes"]


def cut_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row of the pieces of all rows, and which rows were left out: those with an apostrophe or a
    character from U+0280 on, which the pattern itself has to cut."""
    kinds, wide = _class_tables()
    lo, hi = int(offsets[0]), int(offsets[-1])
    d, off = data[lo:hi], offsets - lo
    n, rows = hi - lo, len(offsets) - 1
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none, np.zeros(rows, bool)
    bad = np.flatnonzero(wide[d])
    left_out = np.zeros(rows, bool)
    left_out[np.searchsorted(off, bad, "right") - 1] = True
    cls = kinds[d]
    two = np.flatnonzero((d >= 0xC2) & (d < 0xCA))
    cls[two] = cls[np.minimum(two + 1, n - 1)] = kinds[((d[two].astype(np.int64) & 31) << 6) | (d[np.minimum(two + 1, n - 1)] & 63)]
    new = np.empty(n + 1, bool)
    new[0] = new[n] = True
    new[1:n] = cls[1:] != cls[:-1]
    border = np.zeros(n + 1, bool)
    border[off] = True
    new |= border
    runs = np.flatnonzero(new)
    first, last = runs[:-1], runs[1:]
    s = np.flatnonzero((cls[first] == 3) & ~border[last])
    last = last[s]
    blank = d[last - 1] == 0x20
    new[last[blank] - 1] = True
    new[last[blank]] = False
    other = last[~blank] - 1
    new[other - ((d[other] & 0xC0) == 0x80)] = True
    start = np.flatnonzero(new)
    row = np.searchsorted(off, start[:-1], "right") - 1
    keep = ~left_out[row] if left_out.any() else slice(None)
    return start[:-1][keep] + lo, start[1:][keep] + lo, row[keep], left_out


class TextCodec:
    """Whole texts by a vocabulary file. Special strings in texts become what the file's library makes of them."""

    def __init__(self, path: str):
        self.bpe, self.special = load(path)
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known = _Pieces(self.bpe)

    @classmethod
    def of(cls, path: str) -> TextCodec:
        """The worker's own, loaded once."""
        cache = worker_cache()
        if ("codec", path) not in cache:
            cache[("codec", path)] = cls(path)
        return cache[("codec", path)]

    def parts(self, text: str) -> tuple[list[str], int]:
        """The parts of a text between special strings, and how many of those there are."""
        if self.cut is None or not self.cut.search(text):
            return [text], 0
        parts = self.cut.split(text)
        return parts, len(parts) - 1

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Callable[[], np.ndarray]]:
        """Token counts of rows of UTF-8 bytes, and a function that gives all rows' ids in one array."""
        rows = len(offsets) - 1
        start, end, row, left_out = cut_pieces(data, offsets)
        extra = np.zeros(rows, np.int64)
        blob = data[offsets[0] : offsets[-1]].tobytes() if self.special else b""
        if left_out.any() or any(x.encode() in blob for x in self.special):
            add = []
            special_rows = np.zeros(rows, bool)
            for r in range(rows):
                if not left_out[r] and not self.special:
                    continue
                text = data[offsets[r] : offsets[r + 1]].tobytes().decode()
                parts, n = self.parts(text)
                if not n and not left_out[r]:
                    continue
                extra[r] = n
                special_rows[r] = not left_out[r]
                at = int(offsets[r])
                for k, part in enumerate(parts):
                    for p in pieces(part):
                        size = len(p.encode())
                        add.append((at, at + size, r))
                        at += size
                    if k < n:
                        at += len(self.cut.match(text, len(data[offsets[r] : at].tobytes().decode())).group().encode())
            if special_rows.any():
                keep = ~special_rows[row]
                start, end, row = start[keep], end[keep], row[keep]
            if add:
                more = np.array(add, np.int64).T
                start, end, row = (np.concatenate(x) for x in zip((start, end, row), more))
                order = np.argsort(start, kind="stable")
                start, end, row = start[order], end[order], row[order]
        if not len(start):
            return extra, lambda: np.zeros(0, np.int32)
        lo, hi = int(offsets[0]), int(offsets[-1])
        total, q = prefix_hashes(data[lo:hi])
        entry = self.known.entries(data[lo:hi], start - lo, end - lo, total, q)
        ids, at = self.known.frozen()
        size = at[entry + 1] - at[entry]
        count = extra + np.bincount(row, size, rows).astype(np.int64)

        def flat() -> np.ndarray:
            if extra.any():
                raise ValueError("ids are not offered for texts with special strings")
            places = np.arange(int(size.sum()))
            places += np.repeat(at[entry] - np.cumsum(size) + size, size)
            return ids[places]

        return count, flat

    def count(self, text: str) -> int:
        raw = np.frombuffer(text.encode(), np.uint8)
        return int(self.encode_rows(raw, np.array([0, len(raw)]))[0][0])

    def ids(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_rows(raw, np.array([0, len(raw)]))[1]().tolist()

    def _plain_prefixes(self, text: str, limit: float) -> Iterator[tuple[int, int]]:
        """Bytes and tokens of each prefix of a text without special strings that ends between characters, from one
        character on, until the tokens surely exceed the limit.

        A cut changes how the pattern cuts the text's last pieces only: white space before it may join the piece
        before, and a contraction falls apart. Those ends are cut again; else a piece's own table counts."""
        sizes = [len(c.encode()) for c in text]
        at = done = before = 0  # characters and tokens of the pieces so far, tokens without the last of these
        last = ""
        size = 0
        for p in pieces(text):
            if before > limit:
                return
            table = self.bpe.prefix_counts(p.encode())
            inside = 0
            for i in range(1, len(p) + 1):
                inside += sizes[at + i - 1]
                head = p[:i]
                again = head[0] == "'" or last != "" and last.isspace() and head.isspace()
                n = before + sum(self.bpe.prefix_counts(x.encode())[-1] for x in pieces(last + head)) if again else done + table[inside]
                yield size + inside, n
            at, size, last, before, done = at + len(p), size + inside, p, done, done + table[-1]

    def prefixes(self, text: str, limit: float = float("inf")) -> Iterator[tuple[int, int]]:
        """Bytes and tokens of each prefix of a text that ends between characters, the empty one first: exactly what
        the library counts for it. It ends where tokens surely exceed the limit."""
        yield 0, 0
        parts, n = self.parts(text)
        base = size = at = 0
        for k, part in enumerate(parts):
            at += len(part)
            special = self.cut.match(text, at).group() if k < n else ""
            at += len(special)
            end = len(part.encode())
            whole = 0 if not end else None
            for bytes_, count in self._plain_prefixes(part + special[:-1], limit - base):
                if bytes_ == end:
                    whole = count
                yield size + bytes_, base + count
            if whole is None:  # the limit came first
                return
            if special:
                base, size = base + whole + 1, size + len((part + special).encode())
                yield size, base
            if base > limit + 1:
                return

    def prefix_counts(self, text: str) -> list[int | None]:
        """Tokens of each prefix in bytes, 0 first; None where a character isn't complete."""
        out: list[int | None] = [None] * (len(text.encode()) + 1)
        for i, n in self.prefixes(text):
            out[i] = n
        return out

    def fits(self, text: str, limit: int) -> tuple[int, int]:
        """Bytes and tokens of the longest prefix, ending between characters, of at most so many tokens; read off the
        table of prefixes, without encoding the text again."""
        return max(x for x in self.prefixes(text, limit) if x[1] <= limit) if limit >= 0 else (0, 0)

    def edited(self, text: str, ids: list[int], start: int, end: int, new: str) -> tuple[str, list[int], int]:
        """The text with characters start to end replaced, its ids, and how many of the given ids were used again:
        those of pieces before the edit and from where the pieces fall together with the old ones after it."""
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        out = text[:start] + new + text[end:]
        if self.parts(text)[1] or self.parts(out)[1]:
            raise ValueError("ids are not offered for texts with special strings")
        # Pieces are cut without looking back, so they are the same from any common border on.
        borders = [0]
        for p in pieces(text):
            borders.append(borders[-1] + len(p))
            if borders[-1] > start:
                break
        keep = borders[max(0, len(borders) - 3)]
        old = self._borders(text, keep)
        shift = len(out) - len(text)
        middle, sync, known = [], None, next(old, None)
        for a, p in self._pieces_from(out, keep):
            if a >= start + len(new):
                while known is not None and known + shift < a:
                    known = next(old, None)
                if known is not None and known + shift == a:
                    sync = known
                    break
            middle.append(p)
        ends, total = {0: 0}, 0
        for i, t in enumerate(ids, 1):
            total += len(self.bpe.bytes[t])
            ends[total] = i
        head = list(ids[: ends[len(text[:keep].encode())]])
        tail = list(ids[ends[len(text[:sync].encode())] :]) if sync is not None else []
        return out, head + [t for p in middle for t in self.bpe.encode(p.encode())] + tail, len(head) + len(tail)

    @staticmethod
    def _pieces_from(text: str, at: int) -> Iterator[tuple[int, str]]:
        for m in _PIECES.finditer(text, at):
            yield m.start(), m.group()

    def _borders(self, text: str, at: int) -> Iterator[int]:
        for a, p in self._pieces_from(text, at):
            yield a
            at = a + len(p)
        yield at
