"""The stages one after another, each held to its operator on what the one before kept."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages(spark):
    from wirelake.llm import exact_dedup, mixing, ngram_join, quality
    from wirelake.session import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "encoding"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), f"test-{name}")
        if name != "encoding":
            assert out.columns == docs.columns
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        if name == "quality":
            want = [r.doc_id for r in quality.quality_scores(docs, labels).filter("predicted = 1").collect()]
        elif name == "exact_dedup":
            want = [r.doc_id for r in exact_dedup.exact_dedup(docs).filter("kept").collect()]
        elif name == "near_dedup":
            want = [r.doc_id for r in ngram_join.ngram_join(docs).filter("doc_id = class_id").collect()]
        elif name == "mixing":
            want = [r.doc_id for r in mixing.mix_sources(docs).collect() for _ in range(r.copies)]
        else:
            want = [r.doc_id for r in docs.select("doc_id").collect()]
        assert ids == sorted(want), name
        kept.append(len(ids))
        docs = out
    assert kept[0] > kept[1] >= kept[2] and corpus_pipeline.run(spark, SF).count() == kept[-1]


def test_null_and_reused_ids_lose_no_document(spark):
    """Distinct texts under one id, or under none, all come through; real copies go."""
    from wirelake.llm.exact_dedup import drop_copies
    from wirelake.llm.mixing import mixed_documents
    from wirelake.llm.ngram_join import drop_near_copies

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(0)), (None, text(1)), (7, text(2)), (7, text(3)), (8, text(3)), (None, text(3)), (None, text(1)), (9, text(4)), (None, text(4) + " more")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, source string")
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    once = sorted([(None, text(0)), (None, text(1)), (7, text(2)), (7, text(3)), (9, text(4)), (None, text(4) + " more")], key=str)
    kept = drop_copies(docs)
    assert pairs(kept) == once and kept.columns == docs.columns
    near = drop_near_copies(kept)
    assert pairs(near) == sorted(set(once) - {(None, text(4) + " more")}, key=str) and near.columns == docs.columns
    assert set(pairs(mixed_documents(near))) == set(pairs(near))


def test_stages_on_odd_rows(spark):
    """Empty tables, null texts, repeated rows and clashing extra columns in every stage that keeps documents."""
    from wirelake.llm.exact_dedup import drop_copies
    from wirelake.llm.mixing import mixed_documents
    from wirelake.llm.ngram_join import drop_near_copies
    from wirelake.llm.quality import keep_good

    text = " ".join(f"word{i}" for i in range(50))
    rows = [(1, text, "a", {"k": "v"}, 7), (1, text, "a", {"k": "v"}, 7), (2, None, None, None, 1), (2, "", "b", None, 1), (3, "x " * 30_000, "a", None, 2), (4, text + " end", "b", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, __key map<string,string>, copies int")
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1)], "doc_id bigint, quality int")
    for stage in (lambda d: keep_good(d, labels), drop_copies, drop_near_copies, mixed_documents):
        out = stage(docs)
        assert out.columns == docs.columns and 0 < out.count() <= 2 * len(rows)
        assert stage(docs.limit(0)).count() == 0
    assert sorted(r.doc_id for r in drop_copies(docs).collect()) == [1, 2, 3, 4]
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == [1, 2, 3]
