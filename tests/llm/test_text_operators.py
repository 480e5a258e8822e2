import base64
import hashlib
import random
import re

import numpy as np
import pytest

from lodegraph.llm import decontaminate, jaccard, pii, quality, sharding, tokens
from lodegraph.llm.bpe import TextCodec
from lodegraph.llm.common import Words

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " ", "a", "  x\n\n y\t\x1c\x1fz", "日本語 テキスト ½ ²", "don't I'LL we've", "​ 　 x", "🙂🙂 ok", "é́ à́", "!" * 60, "word " * 9000]


def lower(t):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")


def some_texts(n=60):
    rng = random.Random(3)
    return ["".join(rng.choice(["a", "th", "é", " ", "\n", "'s", "1", "ß", "漢", "́", "!!", "\x85", "Ǆ", "ª"]) for _ in range(50)) for _ in range(n)]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, "extra") for i, t in enumerate(ODD + some_texts())] + [(None, "no id", "x"), (3, "a", "again"), (3, "a", "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string")


def test_words_match_the_pattern():
    texts = [t or "" for t in ODD + some_texts()]
    raw = [t.encode() for t in texts]
    off = np.zeros(len(raw) + 1, np.int64)
    off[1:] = np.cumsum([len(r) for r in raw])
    for piece in (7, 100, 1 << 20):
        w = Words(np.frombuffer(b"".join(raw), np.uint8), off, piece)
        got = [[] for _ in texts]
        for k, r in enumerate(w.row.tolist()):
            got[r].append(w.text(k).decode())
        assert got == [WORD.findall(lower(t)) for t in texts]


@pytest.mark.parametrize("n", [3, 10])
def test_decontamination_against_brute_force(spark, odd_docs, n):
    items = [(1, "x y z a b c d e f g h"), (1, "more of it"), (22, "no id"), (3, ""), (4, None), (None, "word word"), (5, "again a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = spark.createDataFrame([(500, "so x Y z a b, c d e f g h more of it!", ""), (501, "x y z", "")], odd_docs.schema)
    docs = odd_docs.union(extra)
    got = decontaminate.score(docs, bench, n=n, keep=["doc_id", "n_words"]).toDF("doc_id", "extra", "n_words", "n_hit", "n_items", "sha", "bad").collect()

    def brute(text):
        w, hit, names = WORD.findall(lower(text)), set(), set()
        for i, t in items:
            x = WORD.findall(lower(t))
            k = min(n, len(x))
            for a in range(len(x) - k + 1 if k and i is not None else 0):
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == x[a : a + k]:
                        hit.update(range(b, b + k))
                        names.add(str(i))
        return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)

    want = sorted((repr(r.doc_id), *brute(r.text)) for r in docs.collect())
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.sha, r.bad) for r in got) == want


def test_decontamination_cuts_or_drops(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Zéro ONE, two three four", "a"), (2, "clean", "b"), (3, None, "c")], "doc_id long, text string, kept string")
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, action="cut").collect()}
    assert cut == {1: "Zéro  four", 2: "clean", 3: None}
    out = decontaminate.decontaminate(docs, bench)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]
    assert decontaminate.decontaminate(docs.limit(0), bench.limit(0)).count() == 0


def test_decontamination_by_a_table_of_windows_gives_the_same(spark, odd_docs, monkeypatch):
    rng = random.Random(14)
    word = lambda: rng.choice(["aa", "b", "É", "dd", "e7"])
    bench = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randrange(1, 9)))) for i in range(60)] + [(1, "aa b aa"), (None, "b b"), (7, None), (8, "")], "item_id long, text string")
    extra = spark.createDataFrame([(700 + i, ", ".join(word() for _ in range(rng.randrange(60))), "") for i in range(40)] + [(900, "aa b aa!", "")] * 30, odd_docs.schema)
    docs = odd_docs.union(extra)
    monkeypatch.setattr(decontaminate, "BITS", 20)
    for n in (3, 5):
        rows = [sorted(map(repr, decontaminate.score(docs, bench, n=n, spans=True, keep=["doc_id"], block_words=w).collect())) for w in (1_000_000, 1)]
        assert rows[0] == rows[1] and any("contaminated=True" in r for r in rows[0])
    cut = [sorted(map(repr, decontaminate.decontaminate(docs, bench, n=3, action="cut").collect()))]
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 1)
    assert cut == [sorted(map(repr, decontaminate.decontaminate(docs, bench, n=3, action="cut").collect()))]
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_jaccard_finds_copies_and_near_copies(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(40)]
    rows = list(enumerate(base))
    near = {}
    for k in range(20):
        w = base[k].split()
        w[rng.randrange(len(w))] = "changed"
        near[100 + k] = k
        rows.append((100 + k, " ".join(w)))
    rows += [(200, base[5]), (201, base[5]), (300, None), (301, ""), (302, "!!"), (None, base[1]), (200, base[5])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, class_id int")
    out = jaccard.join(docs).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out if r.doc_id is not None}
    assert all(got[a].class_id == b for a, b in near.items())
    assert got[200].text_class == got[201].text_class == 5 and got[5].n_links == got[201].n_links == 1
    assert got[30].class_id == 30 and got[30].n_links == 0 and got[300].class_id == 300 and got[302].n_links == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [*range(40), 300, 301, 302] and None in ids
    assert jaccard.join(docs.limit(0)).count() == 0


def test_jaccard_splits_hot_buckets_without_loss(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    out = jaccard.join(docs).collect()
    assert {r.class_id for r in out} == {0} and all(r.n_links == 59 for r in out)


def test_jaccard_meets_brute_force(spark):
    rng = random.Random(7)
    docs = []
    for k in range(30):
        w = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(40)]
        docs.append(" ".join(w))
        for _ in range(3):
            v = [x if rng.random() > 0.08 else "new" for x in w]
            docs.append(" ".join(v))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in docs]
    links = {(i, j) for i in range(len(docs)) for j in range(i) if docs[i] != docs[j] and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    out = jaccard.join(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    reps = {r.text_class for r in out}
    want = sum(1 for i, j in links if i in reps and j in reps)
    found = sum(r.n_links for r in out if r.doc_id == r.text_class) / 2
    assert found <= want and found >= 0.97 * want
    got = {r.doc_id: r.class_id for r in out}
    assert sum(got[i] == got[j] for i, j in links) >= 0.98 * len(links)


def test_jaccard_links_long_texts(spark):
    rng = random.Random(11)
    docs, size = [], 24_000
    for _ in range(8):
        w = [f"w{rng.randrange(1 << 30)}" for _ in range(size)]
        docs.append(" ".join(w))
        for k in range(2):
            docs.append(" ".join(w[: size - 1500 * (k + 1)] + [f"v{rng.randrange(1 << 30)}" for _ in range(2000)]))
    out = jaccard.join(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert len(out) == 24 and all(r.class_id == r.doc_id // 3 * 3 and r.n_links == 2 for r in out)


def test_jaccard_shortens_only_prefixes_that_hold_several_labels(spark, monkeypatch):
    """Copies that meet at long prefixes are not looked at below short ones; texts that only meet there are."""
    assert jaccard.depth(0.5) == 3 and jaccard.depth(0.9) == jaccard.MAX_DEPTH and jaccard.depth(0.5, recall=0.8) == 4
    rng = random.Random(21)
    sig = lambda: bytes(rng.randrange(256) for _ in range(6))
    one = sig()
    # Two trees of three hashes. Texts 0 and 1 share a long prefix; 2 shares a short one with both; 3 and 4 only a
    # short one with each other, by chance.
    rows = [(0, [7, 8], one), (1, [7, 8], one), (2, [7, 9], one), (3, [5, 1], sig()), (4, [5, 2], sig()), (5, [3, 4], one)]
    texts = spark.createDataFrame([(t, n, bytearray(s)) for t, n, s in rows], "t long, nodes array<long>, sig binary")
    seen = []
    real = jaccard._spread

    def spy(df, key):
        if key == "k":
            seen.extend((r.k, r.t) for r in df.collect())
        return real(df, key)

    monkeypatch.setattr(jaccard, "_spread", spy)
    got = {(r.a, r.b) for r in jaccard.candidates(texts, 2, 3, 6, 0.5).collect()}
    assert got == {(0, 1), (0, 2)}
    # Node 8 holds one label only and stays at its long prefix; nodes 7 and 5 are shortened.
    assert sorted(seen) == [(5, 3), (5, 4), (7, 0), (7, 1), (7, 2)]


def test_jaccard_one_id_with_several_texts(spark):
    rng = random.Random(12)
    text = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(50))
    a, b = text(), text()
    rows = [(1, a), (2, a + " more"), (3, b), (3, a), (4, b + " more"), (3, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id, r.text_class, r.class_id, r.n_links, r.n_copies) for r in jaccard.join(docs).collect())
    assert out == [(1, 1, 1, 1, 3), (2, 2, 1, 1, 1), (3, 1, 1, 1, 3), (3, 1, 1, 1, 3), (3, 3, 3, 1, 1), (4, 4, 3, 1, 1)]
    assert sorted((r.doc_id, r.text) for r in jaccard.keep_one(docs).collect()) == [(1, a), (3, b)]


def luhn(d):
    return sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def spans_of(t):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, (name, p) in enumerate(kinds.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if name == "email" or name == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or name == "card" and 12 <= len(d) <= 19 and luhn(d) or name == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end(), name))
    return ",".join(f"{n}:{a}:{e}" for a, _, e, n in sorted(out))


def test_pii_against_brute_force(spark, odd_docs):
    rng = random.Random(1)
    texts = ["a@b.c_d@e.f x", "foo@bar@baz.com", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004", "+1 (438) 555-5817 and +49 123 4567 890123", "4111 1111 1111 1111 4111-1111-1111-1112", "🙂é a.b+c@x-y.co.uk +123456789", "9" * 3000 + " 1.2.3.4", "x" * 20000 + "@"]
    texts += ["".join(rng.choice("a1 .@+-()é2%_") for _ in range(50)) for _ in range(150)]
    docs = spark.createDataFrame([(1000 + i, t, "") for i, t in enumerate(texts)], odd_docs.schema).union(odd_docs)
    got = pii.report(docs).collect()
    want = sorted((repr(r.doc_id), hashlib.sha256(spans_of(r.text).encode()).hexdigest()) for r in docs.collect())
    assert sorted((repr(r.doc_id), r.base_sha256) for r in got) == want


def test_pii_terms_that_reveal(spark):
    rows = [(i, f"Write to boss@firm.example about Zanzibar today, number {i}") for i in range(4)] + [(10 + i, f"today we write about nothing, number {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert got[0] == "email:9:26,term:33:41" and not got[11]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[1] == "Write to <EMAIL> about <NAME> today, number 1" and clean[12] == rows[6][1]
    assert pii.report(docs.limit(0)).count() == 0


def test_pii_terms_of_rare_values_in_whole_documents(spark):
    far = " ".join(["today we write"] * 20)
    rows = [(0, f"Write to boss@firm.example today. {far} about Zanzibar"), (1, f"today we write about Zanzibar {far}"), (2, f"we +49 123 4567 8901 today, {far} Quillon write about"), (3, "Boss@firm.example: Zanzibar")]
    rows += [(10 + i, "today we write about nothing") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert got[0] == f"Write to <EMAIL> today. {far} about <NAME>" and got[1] == f"today we write about <NAME> {far}"
    assert got[2] == f"we <PHONE> today, {far} <NAME> write about" and got[10] == rows[-1][1]
    # A term that mostly occurs without the value stays.
    often = docs.union(spark.createDataFrame([(100_000 + i, "Zanzibar") for i in range(8)], docs.schema))
    assert {r.text for r in pii.sanitise(often).filter("doc_id >= 100000").collect()} == {"Zanzibar"}


def terms_by_brute_force(rows, prior, disclosure):
    """(term, value) pairs whose smoothed pointwise mutual information is enough of the value's own information."""
    import math

    held, n_t, n = [], {}, len(rows)
    for t in rows:
        terms = set(re.findall(r"(?<![\w@.%+-])[^\W\d_]{4,}(?![\w@%+-])", (t or "").lower()))
        for x in terms:
            n_t[x] = n_t.get(x, 0) + 1
        values = {t[int(a) : int(b)].lower() for _, a, b in (s.split(":") for s in spans_of(t).split(",") if s)}
        if values:
            held.append((terms, values))
    n_v, n_tv = {}, {}
    for terms, values in held:
        for v in values:
            n_v[v] = n_v.get(v, 0) + 1
            for x in terms:
                n_tv[x, v] = n_tv.get((x, v), 0) + 1
    out = set()
    for (x, v), both in n_tv.items():
        p = n_v[v] / n
        if n_v[v] < n and math.log((both + prior * p) / (n_t[x] + prior) / p) >= disclosure * -math.log(p):
            out.add(x)
    return out


def test_pii_terms_are_those_of_brute_force(spark):
    rng = random.Random(31)
    words = [f"{a}{b}word" for a in "abcdefgh" for b in "abcdefgh"]
    emails = [f"u{i}@mail.example" for i in range(12)]
    rows = []
    for i in range(500):
        w = [rng.choice(words) for _ in range(6)]
        if i % 5 == 0:
            v = emails[i // 5 % 12]
            w += [v, f"secret{'abcdefghijkl'[i // 5 % 12] * 3}"] + ["zzzz", "+49 123 4567 890"[: 16 - i % 2]] * (i % 3 == 0)
        rows.append(" ".join(w))
    rows += rows[:40] + [rows[5]] * 30 + [None, ""]
    docs = spark.createDataFrame([(t,) for t in rows], "text string")
    for prior, disclosure in ((1.0, 0.9), (0.2, 0.7), (3.0, 0.6)):
        got = {r.term for r in pii.revealing(docs, prior=prior, disclosure=disclosure).collect()}
        assert got == terms_by_brute_force(rows, prior, disclosure)
    assert got


def test_pii_hot_texts_and_ways_of_sanitising(spark, monkeypatch):
    rows = [(i, f"Write to boss@firm.example about Zanzibar and zinc, number {i % 4}", None) for i in range(60)] + [(100 + i, f"we write about nothing and number {i}", "x") for i in range(40)] + [(None, None, None), (7, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string")
    kinds = {"disclosure": 0.5}
    want = sorted((repr(r.doc_id), r.spans) for r in pii.report(docs, **kinds).collect())
    assert any("term" in s for _, s in want)
    monkeypatch.setattr(pii, "HOT", 5)
    monkeypatch.setattr(pii, "small", lambda *a: False)
    assert sorted((repr(r.doc_id), r.spans) for r in pii.report(docs, **kinds).collect()) == want
    clean = pii.sanitise(docs, **kinds)
    assert clean.columns == docs.columns
    texts = {r.text for r in clean.collect()}
    assert {"Write to <EMAIL> about <NAME> and <TERM>, number 1", "we write about nothing and number 3", None, ""} <= texts
    assert "Write to <EMAIL> about  and , number 1" in {r.text for r in pii.sanitise(docs, terms="remove", **kinds).collect()}
    assert pii.sanitise(docs.limit(0)).count() == 0


def test_token_counts_are_the_library_s(spark, odd_docs):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    extra = spark.createDataFrame([(900, "<|endoftext|>", ""), (901, "a<|endoftext|> b<|endo", "")], odd_docs.schema)
    docs = odd_docs.union(extra)
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs, P.path("byte_bpe_50k.json")).collect())
    assert got == sorted((repr(r.doc_id), len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False))) for r in docs.collect())


def test_bpe_round_trip_is_the_library_s(spark, odd_docs):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = tokens.encode(odd_docs, path, with_ids=True)
    got = sorted((repr(r.doc_id), list(r.ids), r.n_tokens, r.decoded_sha256) for r in out.collect())
    want = []
    for r in odd_docs.collect():
        ids = lib.encode_ordinary(r.text or "")
        want.append((repr(r.doc_id), ids, len(ids), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert sorted(r.text for r in tokens.decode(out, path).collect()) == sorted(r.text or "" for r in odd_docs.collect())


def test_prefix_tables():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    codec = TextCodec(path)
    rng = random.Random(4)
    for _ in range(200):
        piece = "".join(rng.choice("thereandé") for _ in range(rng.randrange(1, 14))).encode()
        table = codec.bpe.prefix_counts(piece)
        for i in range(1, len(piece) + 1):
            want = 1 if piece[:i] in codec.bpe.vocabulary else len(codec.bpe.merged(piece[:i]))
            assert table[i] == want
        # Appending goes on from what is known.
        last = codec.bpe.last_tokens(piece)
        assert codec.bpe.last_tokens(piece, last[: len(piece) // 2]) == last
    text = "The other thing"
    for limit in range(6):
        cut, n = codec.fits(text, limit)
        assert codec.count(text.encode()[:cut].decode()) == n <= limit


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"])
def test_every_prefix_is_counted_as_the_library_does(name):
    codec = TextCodec(P.path(name))
    rng = random.Random(15)
    texts = ["".join(rng.choice(["a", "the", " ", "  ", "\n", "'s", "'ll", "'", "1", "é", "漢", "!!", "<|endoftext|>", "<|end"]) for _ in range(rng.randrange(12))) for _ in range(150)]
    for text in [*texts, "", "a  b", "we'll", "x \n\n y"]:
        for size, n in codec.prefixes(text):
            assert n == codec.count(text.encode()[:size].decode()), (text, size)
        table = codec.prefix_counts(text)
        assert sum(x is not None for x in table) == len(text) + 1
        for limit in (0, 1, 3, 7):
            best = max(i for i, x in enumerate(table) if x is not None and x <= limit)
            assert codec.fits(text, limit) == (best, table[best])


def test_edits_encode_again_only_what_is_near(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    codec = TextCodec(path)
    rng = random.Random(16)
    word = lambda: rng.choice(["the", " other", "  ", "\n", "'s", "1", "é", " 漢字", "!!", " x"])
    rows = []
    for i in range(300):
        text = "".join(word() for _ in range(rng.randrange(30)))
        a = rng.randrange(len(text) + 1)
        z = rng.randrange(a, len(text) + 1)
        new = "".join(word() for _ in range(rng.randrange(4)))
        out, ids, used = codec.edited(text, codec.ids(text), a, z, new)
        assert out == text[:a] + new + text[z:] and ids == codec.ids(out) and used <= len(ids)
        rows.append((i, text, codec.ids(text), a, z, new))
    long = " word" * 5000
    assert codec.edited(long, codec.ids(long), 12_000, 12_005, " other")[2] > 4990
    rows += [(400, None, None, None, None, None), (401, "abc", None, 3, None, " def"), (401, "abc", None, 99, 999, "!")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, ids array<int>, start int, end int, new string, n_reused string")
    got = {(r.doc_id, r.text): list(r.ids) for r in tokens.reencode(df, path).collect()}
    assert all(ids == codec.ids(text) for (_, text), ids in got.items()) and (400, "") in got and (401, "abc def") in got and (401, "abc!") in got
    assert tokens.reencode(df.limit(0), path).count() == 0


def test_truncation_of_tables(spark, odd_docs):
    path = P.path("byte_bpe_50k.json")
    codec = TextCodec(path)
    got = tokens.truncate(odd_docs, path, 5).collect()
    assert len(got) == odd_docs.count()
    whole = {}
    for r in odd_docs.collect():
        whole.setdefault(r.doc_id, set()).add(r.text or "")
    for r in got:
        assert any(t.startswith(r.text) and (t != r.text) == r.cut for t in whole[r.doc_id])
        assert r.n_tokens == codec.count(r.text) <= 5 and r.n_bytes == len(r.text.encode())
    assert tokens.truncate(odd_docs.limit(0), path, 5).count() == 0


def test_sharding(spark, odd_docs):
    out = sharding.assign(odd_docs, 8).collect()
    assert len(out) == odd_docs.count()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    many = spark.range(8000).selectExpr("id AS doc_id", "'t' AS text")
    n = sharding.assign(many, weights=[1, 1, 2]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 8000 for r in n}
    assert abs(share[2] - 0.5) < 0.03 and abs(share[0] - 0.25) < 0.03
    assert sharding.assign(odd_docs.limit(0)).count() == 0


def test_sharding_writes_and_spreads_equal_rows(spark, odd_docs, tmp_path, monkeypatch):
    docs = odd_docs.withColumnRenamed("n_words", "shard")
    sharding.write(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(back.columns) == {*docs.columns, "shard_number"}
    want = {r.doc_id: r.shard for r in sharding.assign(docs, 4).collect()}
    assert all(want[r.doc_id] == r.shard_number for r in back.collect())
    monkeypatch.setattr(sharding, "CHUNK", 7)
    same = spark.range(50).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'' AS text").union(spark.range(30).selectExpr("id AS doc_id", "'x' AS text"))
    slots = {}
    for r in sharding.assign(same, 3).collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, slots.values())) == 80 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_quality_learns_and_keeps_columns(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))
    rows = []
    for i in range(400):
        w = [word() for _ in range(60)]
        rows.append((i, " ".join(w) if i % 4 else " ".join(x + "$$$" for x in w), "s"))
    rows += [(None, "x", "s"), (1000, None, "s"), (1001, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert sum((r.score >= 0.5) == (r.doc_id % 4 > 0) for r in got if r.doc_id is not None and r.doc_id < 400) >= 396
    good = quality.keep_good(docs, model)
    assert good.columns == docs.columns and good.filter("doc_id % 4 = 0 AND doc_id < 400").count() == 0
    nothing = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}


def test_trees_against_a_plain_walk_and_a_plain_trainer():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 5)), 1)
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 1)).astype(float)
    model = quality.train(x, y, trees=6, levels=3)

    def walk(row):
        total = model.base
        for t in range(len(model.feature)):
            node = 0
            for _ in range(model.levels):
                node = 2 * node + (2 if row[model.feature[t][node]] > model.threshold[t][node] else 1)
            total += model.value[t][node - 7]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x), [walk(r) for r in x])
    # One stump: every statistic and every value is tried as the border.
    p = (y.sum() + 0.5) / 301
    g, h = p - y, np.full(300, p * (1 - p))
    best = max((sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (x[:, j] <= v, x[:, j] > v)), j, v) for j in range(5) for v in np.unique(x[:, j])[:-1] if 5 <= (x[:, j] <= v).sum() <= 295)
    stump = quality.train(x, y, trees=1, levels=1, bins=1000)
    left = x[:, best[1]] <= best[2]
    assert stump.feature[0, 0] == best[1] and ((x[:, best[1]] <= stump.threshold[0, 0]) == left).all()
    assert np.allclose(stump.value[0], [-0.15 * g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)])


def test_quality_of_one_id_with_several_texts_is_learnt_the_same(spark):
    docs = spark.createDataFrame([(i % 50, "good words here " * (i % 9 + 1) if i % 2 else "$$ %% " * (i % 7 + 1), "x") for i in range(300)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    a, b = quality.fit(docs, labels), quality.fit(docs.repartition(7, "text"), labels)
    assert np.array_equal(a.threshold, b.threshold) and np.array_equal(a.value, b.value)
    out = quality.score(docs, a)
    assert out.columns == ["doc_id", "score"] and out.count() == 300 and quality.score(docs.limit(0), a).count() == 0


def test_statistics_ignore_how_rows_are_grouped():
    raw = [(t or "").encode() for t in ODD + some_texts(10)]
    off = np.zeros(len(raw) + 1, np.int64)
    off[1:] = np.cumsum([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    whole = quality.statistics(data, off)
    assert np.array_equal(whole, np.concatenate([quality.statistics(data, off[i : i + 2]) for i in range(len(raw))]))
