import json
import math

import pytest

from lodegraph.engine import Config, Engine, exact_words
from lodegraph.index import HashingEmbedder, Index, embed, valid_vector
from lodegraph.operators import spans

PY = """import os.path as opath
from util import parse_token as pt


class Reader:
    \"\"\"Reads tokens.\"\"\"

    def go(self, x):
        return pt(x)


def main():
    return Reader().go(opath.join("a", "b"))
"""
UTIL = """def parse_token(text):
    \"\"\"Splits a token.\"\"\"
    return helper(text)


def helper(t):
    return t
"""
TEST = "from util import parse_token\n\ndef test_it():\n    parse_token('x')\n"
KINDS = "path string, language string, kind string, size long, mtime timestamp, sha256 string, text string"


def files_of(spark, some):
    import hashlib

    rows = [(p, "typescript" if p.endswith(".ts") else "python", "source", len(t), None, hashlib.sha256(t.encode()).hexdigest(), t) for p, t in some.items()]
    return spark.createDataFrame(rows, KINDS)


SOURCES = {"app.py": PY, "util.py": UTIL, "tests/test_util.py": TEST, "web.ts": "// Renders a token.\nexport function renderToken(a) { return a }\n"}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    at = Index(spark, str(tmp_path_factory.mktemp("index")), 4)
    assert at.index_all(files_of(spark, SOURCES)) == {"files": 4, "changed": 4, "deleted": 0}
    at.embed(HashingEmbedder(64), "hash-64")
    return at


def ids(index):
    return {r.qualname: r.unit_id for r in index.table("units").filter("unit_type != 'import'").collect()}


def test_tables(index):
    u = ids(index)
    assert {"Reader", "Reader.go", "main", "parse_token", "helper", "test_it", "renderToken"} == set(u)
    by = {r.unit_id: r for r in index.table("units").collect()}
    assert by[u["Reader.go"]].parent_id == u["Reader"] and by[u["main"]].parent_id is None
    edges = {(r.caller_unit_id, r.callee_full): r.callee_unit_id for r in index.table("edges").collect()}
    assert edges[u["Reader.go"], "pt"] == u["parse_token"] and edges[u["parse_token"], "helper"] == u["helper"] and edges[u["main"], "opath.join"] is None
    one = index.stats().first()
    assert (one.files, one.units, one.embedded, one.by_language) == (4, 10, 10, {"python": 3, "typescript": 1}) and one.last_indexed_at


def test_engine(spark, index):
    e, u = Engine(index, HashingEmbedder(64)), ids(index)
    first = lambda df: df.first().qualname
    assert first(e.search("parse_token")) == "parse_token" and e.search("parse_token").first().mode == "lexical"
    assert first(e.search("splits a token", mode="hybrid")) == "parse_token"
    assert {r.qualname for r in e.search("token", mode="lexical", query_class="local", language="typescript").collect()} == {"renderToken"}
    hits = e.search("what calls parse_token").collect()
    assert {r.qualname for r in hits} == {"Reader.go", "test_it"} and hits[0].mode == "calls" and hits[0].budget_tokens == 1500
    assert {r.qualname for r in e.search("what breaks if I change helper").collect()} >= {"parse_token", "Reader.go"}
    packet = json.loads(Engine.packets(e.search("parse_token")).first().json)
    assert packet["qualname"] == "parse_token" and "hop" not in packet and packet["lines"] == [1, 3]
    assert [r.unit_id for r in e.callers("parse_token").collect()] == [u["Reader.go"], u["test_it"]]
    assert {(r.unit_id, r.hop) for r in e.callers("helper", 3).collect()} >= {(u["parse_token"], 1), (u["Reader.go"], 2)}
    assert [r.path for r in e.list_files("python").collect()] == ["app.py", "tests/test_util.py", "util.py"]
    assert [r.qualname for r in e.list_symbols("util.py").collect()] == ["parse_token", "helper"]
    assert e.read_file("util.py", 1, 1).first().text == "def parse_token(text):"
    for bad in ("/etc/passwd", "../x", "a/../../b"):
        with pytest.raises(ValueError):
            e.read_file(bad)
    got = e.get_many([u["helper"], 5, u["main"]], current=files_of(spark, {**SOURCES, "app.py": "changed\n" * 20})).collect()
    assert [(r.unit_id, r.stale) for r in got] == [(u["helper"], False), (u["main"], True)] and got[0].evidence == "def helper(t):\n    return t"
    assert e.dependents("util").count() == 2 and e.children(u["Reader"]).first().qualname == "Reader.go"
    assert e.resolve("go").first().qualname == "Reader.go" and e.callees(u["main"]).count() == 3
    assert Engine(index, None, Config(top_k=1)).search("token text", query_class="local").count() == 1
    with pytest.raises(ValueError):
        e.search("x y z w", mode="none", query_class="local")
    assert exact_words("where is Reader defined") == ["reader"] and exact_words("the os.path thing") == ["os.path", "os", "path"]


def test_updates_touch_only_what_changed(spark, tmp_path):
    at = Index(spark, str(tmp_path), 4)
    at.index_all(files_of(spark, SOURCES))
    at.embed(HashingEmbedder(8), "a")
    before, held = ids(at), {r.unit_id for r in at.table("vectors").collect()}
    now = {**SOURCES, "util.py": "X = 1\n" + UTIL.replace("def helper", "def other"), "new.py": "def parse(): pass\n"}
    del now["web.ts"]
    assert at.index_all(files_of(spark, now)) == {"files": 4, "changed": 2, "deleted": 1}
    after = ids(at)
    assert after["parse_token"] == before["parse_token"] and after["main"] == before["main"] and "helper" not in after and "renderToken" not in after and "parse" in after
    kept = {r.unit_id for r in at.table("vectors").collect()}
    assert after["parse_token"] in kept and before["renderToken"] not in kept and kept < held
    edges = {(r.caller_unit_id, r.callee): r.callee_unit_id for r in at.table("edges").collect()}
    assert edges[after["parse_token"], "helper"] is None
    at.embed(HashingEmbedder(8), "a")
    assert at.table("vectors").count() == at.table("units").count()
    at.embed(HashingEmbedder(16), "b")
    assert {len(r.embedding) for r in at.table("vectors").collect()} == {16}
    at.index_paths(files_of(spark, {"new.py": "def renamed(): pass\n"}), spark.createDataFrame([("new.py",), ("app.py",)], "path string"))
    assert "renamed" in ids(at) and "main" not in ids(at) and "parse_token" in ids(at)
    at.repair()
    at.delete(spark.createDataFrame([(p,) for p in now], "path string"))
    assert at.table("units").count() == at.table("vectors").count() == at.table("edges").count() == 0


def test_vectors_have_to_be_valid(spark):
    class Bad:
        dimension = 2

        def embed(self, texts):
            return [[1.0, math.nan]] * len(texts)

    texts = spark.createDataFrame([(1, "x")], "unit_id long, text string")
    with pytest.raises(Exception, match="finite vector"):
        embed(texts, Bad()).collect()
    some = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([1.0, math.inf],), ([1.0, None],), (None,)], "v array<double>")
    assert [r[0] for r in some.select(valid_vector(some.v, 2)).collect()] == [True, False, False, False, False]


def test_evidence_is_cut_with_a_note_if_that_fits(spark):
    rows = spark.createDataFrame([("short",), ("y" * 40 + "\n" + "z" * 40,), ("x" * 60 + "\n" + "w" * 60,), ("line\n" * 30,)], "t string")
    got = [r[0] for r in rows.select(spans.fit_evidence(rows.t, 17)).collect()]
    assert got == ["short", "y" * 40 + spans.NOTE, "x" * 60, "\n".join(["line"] * 13)]
