"""The corpus pipeline on small documents, stage by stage, and its registration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.test_text_operators import prose, slow_fingerprint


def test_registered():
    names = [name for name in __spark_entry__.queries() if name.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


def test_stages(spark, tmp_path):
    item = prose(99, 30)
    rng = np.random.default_rng(2)
    texts = [prose(i, int(rng.integers(20, 120))) for i in range(60)]
    texts += [texts[0], texts[1], f"{prose(500, 60)} {item} {prose(501, 60)}", "123 456", None, ""]
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, str(tmp_path))
        if at < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == docs.columns
        found.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append([r[0] for r in docs.select("doc_id").orderBy("doc_id").collect()])
    assert kept[0] == list(range(63))
    assert len({slow_fingerprint(texts[i]) for i in kept[1]}) == len(kept[1]) and not {60, 61} & set(kept[1])
    assert kept[2] == [i for i in kept[1] if i != 62]
    assert set(kept[3]) <= set(kept[2]) and max(map(kept[3].count, kept[3])) <= 3
    assert kept[4] == kept[3]
    assert docs.agg(F.countDistinct("start")).first()[0] == len(kept[4])


def _documents(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + more)


def test_null_and_repeated_ids(spark, tmp_path):
    """Rows are told apart by all they hold, so a copy goes whatever its id, and no other text goes with it."""
    rows = [(None, prose(1, 40), "en", "a", 0), (None, prose(1, 40), "en", "a", 0), (1, prose(2, 50), "en", None, 0), (1, prose(2, 50), "en", None, 0)]
    docs = _documents(spark, rows)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r["text"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted({r[1] for r in rows})
    assert corpus_pipeline.decontamination(spark, docs, str(tmp_path)).count() == 4
    assert set(corpus_pipeline.mixture(spark, docs, "").columns) == set(docs.columns)
    assert corpus_pipeline.token_files(spark, docs, "").count() == 4
    assert all(stage(spark, docs.limit(0), str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_a_different_text_under_the_same_id_stays(spark, tmp_path):
    item = prose(77, 30)
    rows = [(1, prose(1, 40), "en", "a", 0), (1, prose(2, 40), "en", "a", 0), (2, prose(2, 40), "en", "a", 0), (3, f"x {item}", "en", "a", 0), (3, prose(3, 40), "en", "a", 0)]
    docs = _documents(spark, rows)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted((i, t) for i, t, *_ in rows if i != 2)
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in clean) == sorted((i, t) for i, t, *_ in rows if item not in t)


def test_extra_columns_with_the_stages_own_names(spark, tmp_path):
    names = ["key", "row", "copies", "_copies", "_mixed_id", "id", "times", "fp", "component_id", "item_id"]
    docs = _documents(spark, [(i, prose(i, 40), "en", "ab"[i % 2], 0, *["x"] * len(names)) for i in range(12)], "".join(f", {n} string" for n in names))
    spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and kept.count() > 0, name
    assert corpus_pipeline.token_files(spark, docs, "").count() == 12


def test_engine_without_the_text_operators(monkeypatch):
    import builtins
    import importlib

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("no zstandard", name="zstandard")
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    try:
        found = importlib.reload(__spark_entry__).queries()
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
    assert "schedule_search" in found and "pipeline" not in found and not any(n.startswith("op1") for n in found)
