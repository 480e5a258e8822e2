import subprocess

import pytest

from lodegraph.operators import evaluate
from lodegraph.sources import files, git


def run(at, *args):
    subprocess.run(["git", "-C", str(at), "-c", "user.name=A", "-c", "user.email=a@b.c", *args], check=True, capture_output=True)


def test_git_rows(spark, tmp_path):
    at = tmp_path / "tree"
    at.mkdir()
    assert git.head(str(at)) == (None, None) and git.status(spark, str(at)).count() == 0 and git.recent(spark, str(at)).count() == 0
    run(at, "init", "-q", "-b", "main")
    for n in ("a b.py", "b.py", "c.py", "d.py"):
        (at / n).write_text(n * 20)
    run(at, "add", "-A")
    run(at, "commit", "-qm", "First: one")
    commit, branch = git.head(str(at))
    assert branch == "main" and len(commit) == 40
    (at / "a b.py").write_text("changed")
    (at / "b.py").unlink()
    run(at, "mv", "c.py", "e.py")
    (at / "é.py").write_text("new")
    now = git.status(spark, str(at))
    assert {(r.path, r.status) for r in now.collect()} == {("a b.py", "changed"), ("b.py", "deleted"), ("e.py", "changed"), ("c.py", "deleted"), ("é.py", "untracked")}
    known = spark.createDataFrame([("b.py",), ("d.py",)], "path string")
    assert [r.path for r in git.deleted_known(known, now).collect()] == ["b.py"]
    assert {"a b.py", "b.py", "e.py"} <= {r.path for r in git.since(spark, str(at), commit).collect()} and git.since(spark, str(at), "--bad").count() == 0
    run(at, "add", "-A")
    run(at, "commit", "-qm", "Second")
    log = {r.place: r for r in git.recent(spark, str(at), 5).collect()}
    assert log[0].subject == "Second" and log[1].subject == "First: one" and sorted(log[1].files) == ["a b.py", "b.py", "c.py", "d.py"] and log[1].commit == commit


def test_questions(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('# a comment\n{"question": "who?", "gold": [1, 2], "gold_file": "a.py", "gold_hops": {"1": 2}}\n\n{"question": "what?"}\n')
    rows = files.questions(spark, str(tmp_path / "q.jsonl")).orderBy("place").collect()
    assert [(r.place, r.question, r.gold_files) for r in rows] == [(1, "who?", ["a.py"]), (3, "what?", [])] and rows[0].gold_hops == {1: 2}
    (tmp_path / "bad.jsonl").write_text('{"question": "x"}\nnot json\n')
    with pytest.raises(Exception, match="bad.jsonl:2 is no question"):
        files.questions(spark, str(tmp_path / "bad.jsonl")).collect()


def test_roots_with_blanks_and_quotes(spark, tmp_path):
    at = tmp_path / "it's a+b root"
    at.mkdir()
    (at / "x y.py").write_text("pass")
    assert [r.path for r in files.scan(spark, str(at)).collect()] == ["x y.py"]


def test_file_recall_and_chunk_baseline(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "x", "a"]), ([], ["a"])], "gold array<string>, hits array<string>")
    assert [r[0] for r in rows.select(evaluate.file_recall(rows.gold, rows.hits, 2)).collect()] == [0.5, 0.0]
    from pyspark.sql import functions as F

    chunks = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.5, 2.0]), (2, 0, [0.0, 1.0])], "doc_id int, chunk int, v array<double>")
    got = evaluate.chunk_baseline(chunks, "v", F.array(F.lit(0.0), F.lit(1.0)), 2).collect()
    assert [(r.doc_id, r.chunk, r.score) for r in got] == [(1, 1, 2.0), (2, 0, 1.0)]
