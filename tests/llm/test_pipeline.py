import pytest

import corpus_pipeline as pipeline
from graphloom.llm import mixing

from . import brute
from .test_operators import frame, made


def test_stages(spark, tmp_path):
    docs = made(2) + [(99_991, "12 34"), (99_992, None)]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = kept.columns, []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        if i < len(pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        kept = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(kept.collect())
    lettered = {i: t for i, t in docs if t and any(c.isalpha() for c in t)}
    assert {r.doc_id for r in seen[0]} == set(lettered)
    groups = brute.jaccard(list(lettered.items()))
    single = {i: t for i, t in lettered.items() if groups[i][1] == i}
    assert {r.doc_id for r in seen[1]} == set(single)
    cut = brute.substring_dedup(list(single.items()))
    assert {r.doc_id: r.text for r in seen[2]} == {i: (cut[i][2] if cut[i][1] else t) for i, t in single.items()}
    assert sorted((r.doc_id, r.text) for r in seen[3]) == sorted((r.doc_id, r.text) for r in seen[2])
    assert {r.doc_id for r in seen[4]} == set(single)
    whole = pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in whole) == sum(r.length for r in seen[4])


def test_nothing_comes_of_nothing(spark, tmp_path):
    frame(spark, made()).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_other_columns_come_along(spark):
    rows = [(1, "ein Haus und ein Baum", "de", "a", 21, 1, "x", True, 7, b"z", 0.5, "p"), (2, "ein Haus und ein Baum", "de", "a", 21, 2, "x", True, 7, b"z", 0.5, "p"), (3, "the cat sat on the mat", None, None, 22, 3, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, kept string, __maybe boolean, position int, tag binary, score double, lang_pred string")
    kept = docs
    for _, stage in pipeline.STAGES[:4]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.row, r.kept, r.position, r.score, r.lang_pred) for r in kept.collect()) == [(1, 1, "x", 7, 0.5, "p"), (3, 3, None, None, None, None)]


@pytest.mark.parametrize("name", ["op1_matroska", "op10_mixing"])
def test_registered(name):
    import __spark_entry__ as e

    assert name in e.queries() and "pipeline" in e.queries()


def test_sequences_follow_the_mixture(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline, "MIXED_PIECES", 100)
    rows = [(i, "word " * (300 if i % 2 else 20), "en", "long" if i % 2 else "short", 0) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    weights = {r.source: r.target_weight for r in mixing.mix(docs).collect()}
    place = {r.doc_id: r.position for r in mixing.mix(docs).collect()}
    pipeline.mix_sources(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    packed = pipeline.pack_sequences(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    assert len(packed) == len(rows)
    parts = {}
    for r in sorted(packed, key=lambda r: r.sequence_id):
        parts.setdefault(r.sequence_id >> 36, []).append(r.doc_id)
    blocks = [ids[i : i + 100] for _, ids in sorted(parts.items()) for i in range(0, len(ids), 100)]
    assert len(blocks) >= 12
    for one, two in zip(blocks, blocks[1:]):
        assert max(place[i] for i in one) < min(place[i] for i in two)
    for ids in blocks:
        for source, rest in (("long", 1), ("short", 0)):
            assert abs(sum(i % 2 == rest for i in ids) - weights[source] * len(ids)) <= 16


def test_languages_are_predicted_once(spark, tmp_path):
    frame(spark, made()).write.parquet(str(tmp_path / "documents.parquet"))
    found = pipeline.identify_language(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
