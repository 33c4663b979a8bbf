"""The pipeline's stages on the smallest documents, and on a table with nulls and on an empty one."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ripplegrid.llm import near_dedup  # noqa: E402
from ripplegrid.llm.common import written  # noqa: E402
from tests.llm.test_operators import WORD, brute_repeats, check_packing  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], SF), "test-stage"))
        assert kept[-1].columns == docs.columns
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[1] == ids[0]
    assert ids[2] == {r.group_id for r in near_dedup.groups(docs).collect()}
    want = brute_repeats([(r.doc_id, r.text) for r in kept[2].collect()])
    got = {r.doc_id: r.text for r in kept[3].collect()}
    assert {i: " ".join(WORD.findall(t)) for i, t in got.items()} == {i: x[2] for i, x in want.items() if x[2] or not x[0]}
    before = kept[3].agg(F.sum(F.regexp_count("text", F.lit(WORD.pattern)))).first()[0]
    after = kept[4].agg(F.sum(F.regexp_count("text", F.lit(WORD.pattern)))).first()[0]
    assert after == pytest.approx(1.5 * before, rel=0.02)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept[4], SF)
    assert pieces.agg(F.sum("length")).first()[0] > after
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids[4]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "the cat is here", "en", None, 15), (1, "the cat is here", "en", "a", 15), (None, "chat", "fr", "a", 4), (2, "", None, "b", 0)]])
def test_odd_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    assert (corpus_pipeline.run(spark, str(tmp_path)).count() > 0) == bool(rows)
