import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillspark.llm.substrings import LENGTH, Rolling, drop_repeats, last_least, split, word_hashes


def brute(texts, length=LENGTH):
    """(n_words, n_removed, digest, kept) of each text, every window compared with every other."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(b" ".join(w[k : k + length]) for w in words for k in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = {j for k in range(len(w) - length + 1) if seen[b" ".join(w[k : k + length])] > 1 for j in range(k, k + length)}
        rest = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(rest).hexdigest(), rest.decode()))
    return out


def check(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in drop_repeats(docs, texts=True, **how).collect()}
    want = brute(texts, how.get("length", LENGTH))
    assert [got[i] for i in range(len(texts))] == want
    return want


def some(r, n, words=500):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def test_passages_at_the_edges(spark):
    r = random.Random(1)
    passage = {n: some(r, n) for n in (34, 35, 36, 50, 90)}
    texts = [f"{some(r, r.randint(0, 30))} {passage[n]} {some(r, r.randint(0, 30))}" for n in passage for _ in range(4)]
    inside = some(r, 40)
    texts += [f"{inside} between {inside}", passage[90][: len(passage[90]) // 2], passage[50] + "\t\n " + passage[36]]
    want = check(spark, texts)
    assert all(w[1] == 0 for w in want[:4]) and all(w[1] >= 35 for w in want[4:20])


def test_many_contexts_of_one_anchor(spark):
    """A passage too short to go stands in many texts, with other words around it; some pairs agree further, to one side or both."""
    r = random.Random(2)
    common = some(r, 20)
    texts = [f"{some(r, 40, 5)} {common} {some(r, 40, 5)}" for _ in range(60)]
    left, right = some(r, 10), some(r, 10)
    texts += [f"{some(r, 9)} {left} {common} {right} {some(r, 9)}" for _ in range(3)] + [f"{left} {common} {some(r, 30)}" for _ in range(3)]
    check(spark, texts)


def test_periodic_texts_and_copies(spark):
    texts = ["a b c " * 40, "a b c " * 12, "x " * 34, "y " * 36, "b c a " * 12, "same " * 3, "same " * 3, "x " * 35]
    r = random.Random(3)
    long = some(r, 400)
    near = long.split()
    near[200] = "other"
    check(spark, [*texts, long, long, " ".join(near), long.replace(" ", "\n\n"), "  " + long])


@pytest.mark.parametrize("length, seed", [(5, 2), (8, 8), (35, 12), (60, 10)])
def test_lengths(spark, length, seed):
    r = random.Random(length)
    check(spark, [some(r, r.randint(0, 150), 4 if i % 2 else 60) for i in range(40)] + [some(random.Random(9), 200)] * 2, length=length, seed=seed)


def test_odd_rows(spark, edge, empty):
    rows = drop_repeats(edge).collect()
    want = Counter()
    texts = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    for (i, _), w in zip(texts, brute([t for _, t in texts])):
        want[(i, *w[:3])] += 1
    assert Counter(tuple(r) for r in rows) == want and len(rows[0]) == 4
    assert drop_repeats(empty).collect() == []


def test_hashes():
    words = split("one two three four five one two three")
    h = word_hashes(words)
    got = Rolling(h[:, 0], 0x9E3779B97F4A7C15).runs(np.arange(6), 3)
    assert got[0] == got[5] and len(set(got.tolist())) == 5
    assert last_least(np.array([3, 1, 1, 5, 0, 2]), 3).tolist() == [2, 2, 4, 4] and len(last_least(np.array([1]), 3)) == 0


def test_bounds():
    with pytest.raises(ValueError):
        drop_repeats(None, length=100, seed=12)
