import random

import pytest

from lodegraph.llm import html, topk, urlfilter
from lodegraph.llm.html import Page


def test_topk_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) * rng.choice([0.2, 1, 3]) for _ in range(8)]) for i in range(300)]
    rows += [(1000, None), (1001, [float("nan")] * 8), (1002, [None] * 8), (1003, []), (None, [1.0] * 8), (1005, [0.0] * 8), (1006, [1.0] * 3), (1020, [0.5] * 3), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.search(df, df.filter("vec_id % 20 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    import math

    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in good:
        if q % 20:
            continue
        s = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v)))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert topk.search(df.limit(0), df.limit(0), 5).count() == 0


def test_topk_prunes_nothing_it_needs(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 16)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) * (1 + 5 * (i % 7 == 0)) for _ in range(6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    import math

    ints = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    got = {}
    for r in topk.search(df, df.filter("vec_id % 20 = 0"), 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in range(0, 400, 20):
        s = sorted((-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in ints if i != q)[:3]
        assert sorted(got[q]) == [(k + 1, i) for k, (_, i) in enumerate(s)]


def best_of(rows, k):
    import math

    ints = [(i, [max(min(math.floor(64 * x), 2**63 - 1), -(2**63)) for x in v]) for i, v in rows]
    return {q: [(n + 1, i, -x) for n, (x, i) in enumerate(sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q)[:k])] for q, v in ints if q % 20 == 0}


def topk_of(out):
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def test_topk_skips_blocks_of_short_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_VALUES", 240)
    monkeypatch.setattr(topk, "QUERY_VALUES", 24)
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 1) * 0.5 ** (i % 6) for _ in range(6)]) for i in range(600)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    seen = []
    real = topk.pairs

    def spy(wanted, blocks, ranks):
        out = real(wanted, blocks, ranks)
        seen.append((out.count(), wanted.count() / 4, blocks.count()))
        return out

    monkeypatch.setattr(topk, "pairs", spy)
    assert topk_of(topk.search(df, df.filter("vec_id % 20 = 0"), 5)) == best_of(rows, 5)
    met, queries, blocks = seen[0]
    assert blocks >= 15 and met < 0.6 * queries * (blocks - 1)


def test_topk_of_huge_components(spark):
    rng = random.Random(12)
    rows = [(i, [rng.choice([1.0, -3.0, 1e12, -(2.0**57), 2.0**62, 1e300]) * rng.choice([1, -1]) for _ in range(3)]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clip = lambda x: max(min(x, 2**63 - 1), -(2**63))
    want = {q: [(n, i, clip(s)) for n, i, s in x] for q, x in best_of(rows, 5).items()}
    assert topk_of(topk.search(df, df.filter("vec_id % 20 = 0"), 5)) == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="top">Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>One  &amp; two</h1><p><b>First<br>line.<p>Second &lt;tag&gt;\n text&nbsp;here<div class="ad">Buy</div><form>Name<input></form>
<ul><li>a<li>b</ul><div id="comments"><p>Nice!</p></div><footer>by me</footer></article><aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_page_text():
    assert Page(PAGE).text() == "One & two\nFirst line.\nSecond <tag> text here\na\nb"
    assert Page("").text() == "" and Page("plain  text").text() == "plain text"
    assert Page("<article><p>cut &am").text() == "cut &am" and Page("<article><p>cut &amp").text() == "cut &"
    assert Page("<article><p>x</p><p").text() == "x" and Page("<p>1 < 2 and <3</p>").text() == "1 < 2 and <3"
    assert Page("<body><div class='post'><p>Body</p></div><script>never ends").text() == "Body"
    assert Page("<!-- a <p>b</p> --><main>m<!-- x").text() == "m"


def test_site_style_tree_removes_what_repeats(spark):
    page = "<body><div class='x1'>Same on every page of this site</div><div class='x2'><p>Own text number {0} is here</p></div></body>"
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(12)] + [(100, "http://b.example/", page.format(100)), (101, None, None), (102, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got[3] == "Own text number 3 is here"
    assert got[100] == "Same on every page of this site\nOwn text number 100 is here"
    assert got[101] == "" and got[102] == ""
    joined = {r.page_id: r.text for r in html.extract(pages, low_paths=0).collect()}
    assert joined == got
    copies = spark.createDataFrame([(i, f"http://c.example/{i}", page.format(1)) for i in range(12)], pages.schema)
    assert {r.text for r in html.extract(copies).collect()} == {"Same on every page of this site\nOwn text number 1 is here"}
    assert html.extract(pages.limit(0)).count() == 0


def test_tree_removes_a_branch_inside_articles_that_no_rule_knows(spark):
    page = "<body><form id=aspnetForm><article><h1>Title {0}</h1><p>Own text number {0} is here, and more of it</p><div class='zq'>Read our other pages of this house</div></article></form></body>"
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(12)] + [(50, "http://b.example/", page.format(50))]
    rows += [(60 + i, f"http://c.example/{i}", page.format("same")) for i in range(12)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    own, same = "Title {0}\nOwn text number {0} is here, and more of it", "\nRead our other pages of this house"
    for low_paths in (html.LOW_PATHS, 0):
        got = {r.page_id: r.text for r in html.extract(pages, low_paths=low_paths).collect()}
        assert got[3] == own.format(3) and got[50] == own.format(50) + same
        # Copies of one page: the tree says nothing.
        assert got[61] == own.format("same") + same


def test_names_remove_no_main_text():
    body = "<p>Long text of the article itself</p>"
    for tag in ("main class='no-sidebar'", "main class=search", "div class='content has-sidebar'><article", "article class='post legal'", "article id=forms", "form><main", "div class='search-form'><main"):
        assert Page(f"<body><{tag}>{body}</body>").text() == "Long text of the article itself"
    assert Page(f"<body><div class='search'>{body}</div><div>x</div></body>").text() == "Long text of the article itself\nx"
    assert Page(f"<article>{body}<div class='warning'>Mind</div></article>").text().startswith("Long text")
    assert Page(f"<article>{body}</article><div class=related><article class=card>Other</article></div><article class='comment'>Me too</article>").text() == "Long text of the article itself"
    assert Page(f"<body><div>{body}</div><div><a>Home</a> <a>News</a></div><ul><li><a>One source</a></ul></body>").text() == "Long text of the article itself\nOne source"


def test_hostile_pages_take_linear_time():
    import time

    for page in ("<div>x" * 100_000, "<div>" * 100_000 + "deep" + "</div>" * 100_000 + "<p>after", "<b><div>" + "<span>" * 50_000 + "</b>" * 50_000 + "end", "<i>" * 50_000 + "</u>" * 50_000 + "end", "<p class='" + "a " * 500_000 + "'>end"):
        began = time.time()
        p = Page(page)
        assert p.styles() and p.text()[-5:] in ("x\nx\nx"[-5:], "after", "end")
        assert time.time() - began < 10
    assert Page("<article>" + "<div>" * 2000 + "deep" + "</div>" * 2000 + "<p>in</article>out").text() == "deep\nin"


class Simple:
    """Another reader of pages with well-formed markup: keeps the blocks of article elements but for marked ones."""

    def __init__(self, source):
        from html.parser import HTMLParser

        out, block, state = [], [], {"main": 0, "gone": 0}
        blocks = {"p", "div", "h1", "h2", "ul", "li", "article", "nav", "footer", "aside", "section", "body"}

        def flush():
            if text := " ".join("".join(block).split()):
                out.append(text)
            block.clear()

        class Reader(HTMLParser):
            stack = []

            def handle_starttag(self, tag, attrs):
                if tag in blocks:
                    flush()
                gone = tag in ("nav", "footer", "aside", "script", "style") or dict(attrs).get("class") in ("ad", "comments", "share")
                self.stack.append((tag == "article", gone))
                state["main"] += tag == "article"
                state["gone"] += gone

            def handle_endtag(self, tag):
                if tag in blocks:
                    flush()
                main, gone = self.stack.pop()
                state["main"] -= main
                state["gone"] -= gone

            def handle_data(self, data):
                if state["main"] and not state["gone"]:
                    block.append(data)

        r = Reader()
        r.feed(source)
        r.close()
        flush()
        self.text = "\n".join(out)


def test_pages_against_another_reader():
    rng = random.Random(6)

    def some(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["word", "a &amp; b", " two\n lines ", "caf&eacute; &#233;", ""])
        tag = rng.choice(["p", "div", "div class=ad", "b", "a href=x", "ul", "li", "section", "aside", "nav", "i", "h2", "div class=comments", "script"])
        inner = "var x;" if tag == "script" else "".join(some(depth - 1) for _ in range(rng.randrange(4)))
        if tag in ("p", "h2", "li", "ul"):
            inner = f"<b>{rng.choice(['x', 'y z'])}</b>"
        if tag == "li":
            return f"<ul><li>{inner}</li></ul>"
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    for _ in range(300):
        source = "<body>" + some(2) + "<article><h1>T</h1>" + "".join(some(4) for _ in range(4)) + "</article>" + some(2) + "</body>"
        assert Page(source).text() == Simple(source).text, source


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_url_rules_and_mined_rules(spark):
    urls = {
        "http://A.com/x": ("a.com", "/x", "com/", "allow"),
        "http://example.com/en/1?q": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://m.WWW.example.com/en/": ("m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/1#f": ("x.net", "/es/1", "net/es/", "block"),
        "http://com": ("com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "http://spam.org/win/7": ("spam.org", "/win/7", None, "block"),
        "http://fine.org/win/7": ("fine.org", "/win/7", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate([*urls, None])], "page_id long, url string, host string")
    labelled = spark.createDataFrame([(f"http://spam.org/win/{i}", True) for i in range(20)] + [(f"http://fine.org/win/{i}", False) for i in range(40)] + [(None, None)], "url string, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, labelled, RULES).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values()) and got[len(urls)] == ("", "", None, "allow")
    none = urlfilter.judge(pages, labelled.limit(0), RULES).filter("verdict = 'block'").count()
    assert none == 2
    assert urlfilter.judge(pages.limit(0), labelled, RULES).count() == 0
    mined = urlfilter.mine(labelled)
    hits = lambda df: {r[0]: r.hit for r in df.collect()}
    assert hits(urlfilter.blocked(pages.select("url"), mined, "url")) == hits(urlfilter.blocked(pages.select("url"), mined, "url", most=0))


def mined_by_brute_force(rows, floor, confidence, alpha, support=urlfilter.SUPPORT):
    import itertools
    import math

    total, bad = len(rows), sum(b for _, b in rows)
    common = set.intersection(*(set(t) for t, _ in rows))
    n, c = {}, {}
    for t, b in rows:
        some = sorted(set(t) - common)
        for k in range(len(some) + 1):
            for x in itertools.combinations(some, k):
                n[x] = n.get(x, 0) + 1
                c[x] = c.get(x, 0) + b
    least = max(floor * confidence, support * total * confidence, 1)
    tested = [x for x in n if c[x] >= least - 1e-9]
    p, out = bad / total, {}
    for x in tested:
        q = c[x] / n[x]
        if x and q >= confidence and n[x] >= max(floor, support * total) and q > p:
            gap = q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0)
            if n[x] * gap >= math.log(len(tested) / alpha):
                out[x] = (n[x], c[x])
    return out


def test_mined_url_rules_are_all_itemsets_that_qualify(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        u = f"http://{rng.choice(['a', 'b', 'ads'])}.{rng.choice(['org', 'info'])}/{rng.choice(['x', 'win', 'y'])}/{rng.randrange(99)}" + rng.choice(["", "?id=1"])
        p = 0.9 if "ads" in u and "win" in u else 0.8 if "info/y" in u and "?" in u else 0.1
        rows.append((u, rng.random() < p))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    some = [(sorted(r[0]), int(r[1])) for r in df.select(urlfilter.tokens(df.url), "bad").collect()]
    for alpha in (0.01, 1e-9):
        got = {tuple(r.tokens): (r.n, r.n_bad) for r in urlfilter.mine(df, alpha=alpha).collect()}
        assert got == mined_by_brute_force(some, urlfilter.FLOOR, urlfilter.CONFIDENCE, alpha)
    assert ("host=ads", "path=win") in got


def test_no_url_rule_from_few_rows_or_from_chance(spark):
    rng = random.Random(4)
    few = [(f"http://h{i}.org/p{i}", i % 7 == 0) for i in range(86)]
    assert urlfilter.mine(spark.createDataFrame(few, "url string, bad boolean")).count() == 0
    noise = [(f"http://h{rng.randrange(30)}.org/p{rng.randrange(30)}/k{rng.randrange(5)}", rng.random() < 0.3) for _ in range(2000)]
    assert urlfilter.mine(spark.createDataFrame(noise, "url string, bad boolean")).count() == 0
    for bad in (True, False):
        same = spark.createDataFrame([(u, bad) for u, _ in few], "url string, bad boolean")
        assert urlfilter.mine(same).count() == 0
    odd = spark.createDataFrame([(None, True), ("", False), ("http://" + "a/" * 5000, True)] * 20, "url string, bad boolean")
    assert urlfilter.mine(odd, support=0.9).count() == 0
