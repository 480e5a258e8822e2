import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

STAGES = dict(pipeline.STAGES)
KINDS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "score double, class_id string, kept string, k string, spans string, c0 string, __key string"


def prose(rng, n=80):
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(3, 9))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with documents of every fate: id modulo 100 tells which."""
    at = tmp_path_factory.mktemp("tables")
    rng = random.Random(40)
    passage = prose(rng, 12)
    docs, labels = [], []
    for i in range(300):
        text = prose(rng) if i % 3 else "$$$ %%% " + " ".join(rng.choice(["$$$", "###", "%%%", "&&&"]) for _ in range(90))
        docs.append((i, text, "en", "a", len(text)))
        labels.append((i, int(i % 3 > 0), 0))
    near = docs[1][1].split()
    near[40] = "changed"
    docs += [(1001, docs[1][1], "en", "a", 0), (1002, " ".join(near), "en", "b", 0), (1003, prose(rng) + " " + passage + " " + prose(rng), "en", "a", 0), (1004, prose(rng) + " mail me@host.example now " + prose(rng), "en", "a", 0)]
    docs += [(1005, None, None, None, None), (1006, "", "en", "a", 0), (None, docs[2][1], "en", "a", 0), (2, docs[2][1], "en", "a", 0), (4, prose(rng), "en", "a", 0)]
    spark.createDataFrame(docs, KINDS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect() if r.doc_id is not None)


def test_stages_do_what_they_say_and_agree_with_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    fate = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        fate[name] = set(ids(docs)) - set(ids(out))
        docs = out
    junk = set(range(0, 300, 3))
    assert fate["quality classifier"] - {1005, 1006} == junk
    assert fate["n-gram Jaccard join"] == {1001, 1002}
    assert fate["benchmark decontamination"] == {1003}
    assert not fate["PII"]
    kept = {(r.doc_id, r.text) for r in docs.collect()}
    assert any(i == 1004 and "<EMAIL>" in t and "@" not in t for i, t in kept)
    assert sum(i == 2 for i, _ in kept) == 1 and sum(i == 4 for i, _ in kept) == 2 and any(i is None for i, _ in kept)
    out = pipeline.run(spark, folder)
    lib = pytest.importorskip("tiktoken")
    import base64

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = lib.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((repr(r.doc_id), lib.encode_ordinary(r.text or "")) for r in docs.collect())
    assert sorted((repr(r.doc_id), list(r.ids)) for r in out.collect()) == want
    assert {r.decoded_sha256 for r in out.collect()} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in kept}


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_with_odd_rows_clashing_columns_and_empty_tables(spark, folder, name):
    rng = random.Random(41)
    text = prose(rng, 30)
    long = prose(rng, 60_000)
    rows = [(i, t, None, "s", None, 0.5, "x", None, "k", "z", "c", "key") for i, t in [(1, text), (1, text), (2, text), (None, None), (None, text), (3, None), (4, ""), (5, " \n\t"), (6, "\U0001f642"), (7, long)]]
    docs = spark.createDataFrame(rows, f"{KINDS}, {EXTRA}")
    last = name == pipeline.STAGES[-1][0]
    for some in (docs, docs.limit(0), docs.select("doc_id", "text").limit(0)):
        out = STAGES[name](spark, some, folder)
        got = out.collect()
        if not last:
            assert out.schema.names == some.schema.names
            assert {(r.doc_id, r.text) for r in got} <= {(r.doc_id, r.text) for r in some.collect()}
        assert len(got) <= some.count()
    if last:
        assert STAGES[name](spark, docs, folder).count() == len(rows)


def test_pipeline_of_empty_tables(spark, tmp_path):
    for t, kinds in (("documents", KINDS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
