"""The pipeline's stages in order, each on what the one before kept."""

import corpus_pipeline
from quillspark.llm import queries

from ..conftest import DATA


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert docs.where("text rlike '[a-z0-9]@[a-z0-9]+[.][a-z]'").count() == 0


def test_registered():
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries()
    assert {f"op{i}" for i in range(1, 14)} | {"embedding"} == {n.split("_")[0] for n in queries.QUERIES}
