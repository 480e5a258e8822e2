import math
import random
import sqlite3

import pytest

from lodegraph.functions.text import query_phrases
from lodegraph.operators import evaluate, graph, route, search, spans
from lodegraph.plans import catalogue, fixtures
from lodegraph.sources import extract, files
from lodegraph.streaming import coalesce

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")

    def plain(v):
        if isinstance(v, float):
            return round(v, 5) + 0.0
        return tuple(map(plain, v)) if isinstance(v, list | tuple) else v

    df = catalogue.QUERIES[name](spark, SF)
    rel = c.sql(catalogue.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(repr([plain(r[x]) for x in cols]) for r in df.collect())
    at = [rel.columns.index(x) for x in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_bm25_is_sqlite_s(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["parse", "token", "a_b", "Über", "x"]) for _ in range(rng.randrange(1, 9))), " ".join(rng.choice("abc") for _ in range(3))) for i in range(40)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(a, b, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t(rowid, a, b) VALUES (?, ?, ?)", [(i + 1, a, b) for i, a, b in rows])
    q = "parse_token uber c"
    want = dict(con.execute("SELECT rowid - 1, bm25(t, 10.0, 2.0) FROM t WHERE t MATCH ?", (" OR ".join('"' + " ".join(p) + '"' for p in query_phrases(q)),)).fetchall())
    got = {r.id: r.score for r in search.bm25(spark.createDataFrame(rows, "id int, a string, b string"), "id", {"a": 10.0, "b": 2.0}, q, None).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert search.bm25(spark.createDataFrame(rows, "id int, a string, b string"), "id", {"a": 1.0}, "!!", 3).count() == 0


def test_transitive_on_a_cycle(spark):
    units = spark.createDataFrame([(i, 0, "symbol", "function", n, n, "m.py") for i, n in enumerate("abcde")], "unit_id long, file_id long, kind string, unit_type string, name string, qualname string, file_path string")
    calls = [("a", "b"), ("b", "c"), ("c", "b"), ("d", "c")]
    edges = spark.createDataFrame([(i, "abcde".index(x), 0, y, y, i, None) for i, (x, y) in enumerate(calls)], "edge_id long, caller_unit_id long, file_id long, callee string, callee_full string, line int, callee_unit_id long")
    for depth in (2, 5):
        assert {"abcde"[r.unit_id]: r.hop for r in graph.transitive("c", edges, units, depth).collect()} == {"b": 1, "d": 1, "a": 2, "c": 2}
    for name in ("e", "", "unknown"):
        assert graph.transitive(name, edges, units, 2).count() == 0


def test_callers_through_aliases(spark):
    u, e, a, _ = fixtures.frames(spark)
    names = spark.createDataFrame([("os.path.exists",), ("core.auth.validate",), ("other.mod.fetch",)], "target string")
    got = {(r.target, r.unit_id): r.resolved_target for r in graph.callers(names, e, u, a).collect()}
    assert got == {("os.path.exists", fixtures.unit("is_file")): "os.path", ("core.auth.validate", fixtures.unit("login")): "core.auth"}


def test_routing(spark):
    some = {"parse_token": "symbol", "TokenValidator": "symbol", "Parser": "local", "what calls TokenValidator": "impact", "why does it fail": "debugging", "how does it work": "local", "x": "local"}
    got = {r.q: r.c for r in spark.createDataFrame([(q,) for q in some], "q string").select("q", route.classify(spans.F.col("q")).alias("c")).collect()}
    assert got == some
    assert route.impact_symbol("who uses validate") == "validate" and route.evidence_share(1500, 5) == 300 and route.evidence_share(100, 5) == 200


def test_asof_drops_what_the_latest_span_does_not_cover(spark):
    rng = random.Random(3)
    sp = [(0, s, s + rng.randrange(1, 30), i) for i, s in enumerate(rng.sample(range(200), 30))]
    pts = [(0, rng.randrange(210), i) for i in range(100)]
    got = {r.p: r.i for r in spans.asof_map(spark.createDataFrame(pts, "k int, t int, p int"), spark.createDataFrame(sp, "k int, s int, e int, i int"), "k", "t", "s", "e", "i").collect()}
    want = {}
    for _, t, p in pts:
        before = [x for x in sp if x[1] <= t]
        if before and t < (last := max(before, key=lambda x: x[1]))[2]:
            want[p] = last[3]
    assert got == want


def test_metrics(spark):
    runs = spark.createDataFrame([(1, [7, 8, 9], [7, 8, 1], {7: 1, 8: 2, 9: 3}), (2, [7], [5, 7], {}), (3, [], [1], {})], "query_id int, gold array<int>, hits array<int>, gold_hops map<int,int>")
    got = {r.query_id: r for r in evaluate.metrics(runs, 5).collect()}
    assert math.isclose(got[1].precision, 2 / 3) and got[1].indirect_recall == 0.5 and got[1].mrr == 1
    assert got[2].unit_recall == 1 and got[2].mrr == 0.5 and got[2].indirect_recall is None and got[3].unit_recall == 0


def test_extraction(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text('import os.path as opath\nfrom collections import defaultdict\n\n\nclass V(Base):\n    """Checks é."""\n\n    def go(self, x):\n        if x:\n            return self.run(opath.exists(x))\n')
    (tmp_path / "bad.py").write_text("def broken(:\n    pass\n")
    (tmp_path / "r.md").write_text("intro\n# Project\ntext\n```\n# not one\n```\n## Design\nmore\n")
    (tmp_path / "c.json").write_text('{"server": {"host": "h", "port": 1}, "on": true}')
    (tmp_path / "d.toml").write_text("[db]\nurl = 1 # x\n")
    (tmp_path / "skip.log").write_text("x")
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "x.py").write_text("def no(): pass\n")
    found = files.scan(spark, str(tmp_path), ignore=["build/", "# comment"])
    assert sorted(r.path for r in found.collect()) == ["bad.py", "c.json", "d.toml", "r.md", "src/a.py"]
    # Hidden files are not listed by file sources; they come as rows from elsewhere.
    env = spark.createDataFrame([(".env", "env", "export KEY=1\n")], "path string, language string, text string")
    rows = extract.extract(found.select("path", "language", "text").union(env)).collect()
    units = {(r.unit_type, r.qualname) for r in rows if r.rec == "unit"}
    assert {("class", "V"), ("method", "V.go"), ("import", "collections.defaultdict"), ("function", "broken"), ("config_key", "server.host"), ("config_key", "db.url"), ("config_key", "KEY"), ("doc_chunk", "#r.md#Design")} <= units
    assert {(r.name, r.qualname, r.start_line) for r in rows if r.rec == "call"} == {("run", "self.run", 10), ("exists", "opath.exists", 10)}
    assert {(r.name, r.target) for r in rows if r.rec == "alias"} == {("opath", "os.path"), ("defaultdict", "collections.defaultdict")}


def test_stream_goes_on_after_a_failing_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "ts timestamp, is_directory boolean, src_path string, dest_path string"
    rows = [(None, False, "/r/a.py", "/r/b.py"), (None, True, "/r/dir", None), (None, False, "/r/.git/x", None), (None, False, "/elsewhere/c.py", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    seen = []

    def index(paths, number):
        seen.extend(sorted(r.path for r in paths.collect()))
        raise ValueError("broken")

    events = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = coalesce.refresh(coalesce.changed_paths(events, "/r"), index, str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert seen == ["a.py", "b.py"] and q.exception() is None
