"""The pipeline's stages on odd rows, its near-duplicates against brute force and planted copies, and the whole run."""

import random

import pytest

import corpus_pipeline
from quillspark.llm import pipeline, simhash

DATA = "/root/testdata/sf0.001"
FILTERS = [(n, f) for n, f in pipeline.STAGES[:-1]]


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) > words else {tuple(w)} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def groups(texts, least=0.8):
    """The least position that each text is tied to, all pairs compared."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if root(i) != root(j) and min(len(sets[i]), len(sets[j])) >= least * max(len(sets[i]), len(sets[j])) and likeness(sets[i], sets[j]) >= least:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("name, stage", FILTERS)
def test_stages_on_odd_rows(spark, edge, empty, name, stage):
    """Columns stay, whatever their names; rows are of the input (personal data apart); an empty table gives an empty one."""
    kept = stage(spark, edge, DATA)
    assert kept.columns == edge.columns and kept.dtypes == edge.dtypes
    rows = kept.collect()
    assert 0 < len(rows) <= edge.count()
    before = [(r["doc_id"], r["lang"], r["score"], r["kind"]) for r in edge.collect()]
    assert all((r["doc_id"], r["lang"], r["score"], r["kind"]) in before for r in rows)
    if name != "PII":
        assert {r["text"] for r in rows} <= {r["text"] for r in edge.collect()}
    assert stage(spark, empty, DATA).collect() == []


def test_packing_of_odd_rows(spark, edge, empty):
    rows = pipeline.packing_stage(spark, edge, DATA).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in edge.collect()} and all(0 < r["length"] <= 2048 for r in rows)
    assert pipeline.packing_stage(spark, empty, DATA).collect() == []


def test_near_duplicates_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    label = groups([r["text"] for r in rows])
    want = sorted(r["doc_id"] for i, r in enumerate(rows) if label[i] == i)
    got = sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    assert got == want


def test_planted_near_copies(spark):
    """Copies with some words changed, beside each other or apart, repeated or left out: those with a likeness of 0.8 go."""
    r = random.Random(11)
    word = lambda: f"w{r.randrange(4000)}"
    texts, copies = [], 0
    for i in range(300):
        own = [word() for _ in range(r.randint(60, 400))]
        texts.append(" ".join(own))
        near = list(own)
        kind = i % 4
        if kind == 0:  # one run of words replaced
            at = r.randrange(len(near) - 5)
            near[at : at + r.randint(1, len(near) // 25 + 1)] = [word() for _ in range(2)]
        elif kind == 1:  # single words, far apart
            for _ in range(max(1, len(near) // 60)):
                near[r.randrange(len(near))] = word()
        elif kind == 2:  # a line said again at the end
            near += near[:12]
        else:  # the end left out
            near = near[: int(len(near) * 0.9)]
        texts.append(" ".join(near))
    label = groups(texts)
    want = {i for i in range(len(texts)) if label[i] == i}
    copies = len(texts) - len(want)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {row["doc_id"] for row in simhash.one_of_each(docs).collect()}
    caught = len(texts) - len(got)
    assert copies > 150 and want <= got  # nothing else goes
    assert caught / copies >= 0.99


def test_run(spark):
    """The whole run: pieces of documents that every stage kept, packed without gaps."""
    rows = corpus_pipeline.run(spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:3]:
        kept = stage(spark, kept, DATA)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in kept.select("doc_id").collect()}
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "SimHash near-dedup", "PII", "best-fit packing"] and corpus_pipeline.ORACLE_SQL is None
