"""Operators 2, 3, 7 and 9 against brute force on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import bottom_k, language_model, personal_data, simhash

from .conftest import ROWS


def shingles(t, n=5):
    w = t.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_fingerprints(spark, edge, empty):
    rows = bottom_k.edited_fingerprints(edge).collect()
    assert len(rows) == len(ROWS)
    ring = sorted([(i, t or "") for i, t in ROWS if i is not None], key=lambda x: -x[0])
    after = {i: ring[(k + 1) % len(ring)][1] for k, (i, _) in enumerate(ring)}
    after[2] = None  # two rows: one is next to the other
    for r in rows:
        t = dict(ROWS)[r["doc_id"]] or ""
        assert r["n_chars"] == len(t)
        n = after.get(r["doc_id"], "")
        if n is not None:
            e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
            assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
    prints = {}
    for r in rows:
        prints.setdefault(dict(ROWS)[r["doc_id"]] or "", set()).add(tuple(r["sketch"]))
    assert all(len(p) == 1 for p in prints.values())
    assert bottom_k.edited_fingerprints(empty).count() == 0


def test_estimates(spark):
    a = " ".join(f"w{i}" for i in range(2000))
    b = " ".join(f"w{i}" for i in range(1000, 3000))
    s = bottom_k.sketch
    r = spark.createDataFrame([(a, b, a[:900], "")], "a string, b string, c string, e string").select(
        bottom_k.resemblance(s(F.col("a")), s(F.col("b"))).alias("ab"), bottom_k.containment(s(F.col("c")), s(F.col("a"))).alias("ca"), bottom_k.distinct_shingles(s(F.col("a"))).alias("n"),
        bottom_k.resemblance(s(F.col("e")), s(F.col("e"))).alias("ee"), bottom_k.resemblance(s(F.col("e")), s(F.col("a"))).alias("ea"),
    ).first()
    assert abs(r["ab"] - len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))) < 0.15
    assert r["ca"] > 0.6 and abs(r["n"] - 1996) < 500 and (r["ee"], r["ea"]) == (1.0, 0.0)


def test_merged_sketches(spark):
    a, b = " ".join(f"w{i}" for i in range(400)), " ".join(f"v{i}" for i in range(400))
    rows = spark.createDataFrame([("k", a), ("k", b), ("k", a)], "g string, t string").select("g", bottom_k.sketch(F.col("t")).alias("sketch"))
    r = rows.agg(F.collect_list("sketch").alias("x")).select(bottom_k.merge(F.col("x")[0], F.col("x")[1]).alias("m")).first()
    assert bottom_k.merge_all(rows, ["g"]).first()["sketch"] == r["m"]


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(t):
    out = []
    for kind, p in BASE:
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [t or "" for _, t in ROWS] + [
    "a@b.c+d@e.f @x.y a.b@c..d x@y", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 " + "9" * 400 + ".1.1.1", "4111-1111-1111-1111 4111111111111112 " + "4 " * 3000, "+1 (826) 555-4081 190.137.223.204 +12 34 + 5", "🙂 é a@b.co 🙂 +49 30 1234567",
    "jane (at) example (dot) com", "a." * 3000 + "@" + "b." * 3000 + "c", "card 4111 1111 1111 1112 here", "1 " * 4000,
]


def test_personal_data(spark, empty):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in personal_data.spans(docs).collect()}
    for i, t in enumerate(TEXTS):
        got = [(personal_data.KINDS[x["kind"]], x["b"], x["e"]) for x in rows[i]["base"]]
        assert got == base_spans(t), t[:80]
        assert set(map(tuple, rows[i]["base"])) <= set(map(tuple, rows[i]["spans"]))
    assert personal_data.spans(empty).count() == 0


def test_redaction(spark, edge, empty):
    out = personal_data.redact(edge)
    assert out.columns == edge.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[None] == "no id here, mail <EMAIL>" and texts[7] is None and texts[8] == ""
    assert "<IP>" in texts[12] and "<PHONE>" in texts[12] and "4111" not in texts[12]
    assert personal_data.redact(empty).count() == 0


def test_reliabilities():
    # three labelers that agree with each other and one that votes at random
    patterns = {(1, 1, 1, 1, -1): 40, (1, 1, 1, 0, -1): 40, (0, 0, 0, 1, -1): 10, (0, 0, 0, 0, -1): 10}
    share, rates, chance = personal_data.reliabilities(patterns)
    assert 0.7 < share < 0.9 and chance[(1, 1, 1, 0, -1)] > 0.95 and chance[(0, 0, 0, 1, -1)] < 0.05
    assert rates[0][0] - rates[0][1] > rates[3][0] - rates[3][1]


def test_language_model(spark, edge, empty, corpus):
    docs = edge.select("doc_id", "text").unionByName(corpus[0].withColumn("doc_id", F.col("doc_id") + 100))
    pairs = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, t.encode().lower().split() + [b"\n"]) for i, t in pairs]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in tokens)
    rows = language_model.score(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == want
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])
    assert all(r["score"] <= 0 for r in rows)
    assert language_model.score(empty).count() == 0


def test_model_sums_to_one(spark, corpus):
    """On the query's own path: in each averaged seating the probabilities of all words, the unknown one included, sum to one."""
    report = {}
    rows = language_model.score(corpus[0], report=report).collect()
    contexts, folder = report["contexts"], report["folder"]
    for turn, total in report["sampled"]:
        found, all0, known = {}, {}, 0
        for k in range(report["buckets"]):
            f = language_model._load(f"{folder}/buckets/{k}")
            seats = language_model._load(f"{folder}/seats/{turn}/{k}")
            b = language_model.Bucket(f["word"], f["context"], f["count"], contexts)
            t = [seats[f"t{i}"].astype(float) for i in range(3)]
            p = b.predict(t, total)
            words = f["word"][np.r_[0, np.flatnonzero(np.diff(f["word"])) + 1]] if len(f["word"]) else []
            all0 |= {int(w): x for w, x, c in zip(words, p[0], b.counts(total)) if c}
            for w, c, e, n, x, y in zip(f["word"].tolist(), f["context"].tolist(), contexts.parent[f["context"]].tolist(), f["count"].tolist(), p[2], p[1][b.up[2]]):
                if all0.get(w):
                    found[c, w] = (x, e, y)
        new0 = (language_model.STRENGTH + total.discount[0] * total.tables[0][0]) * total.unknown / (language_model.STRENGTH + total.customers[0][0])
        assert sum(all0.values()) + new0 == pytest.approx(1, abs=1e-9)
        rest = lambda level, k, p: (language_model.STRENGTH + total.discount[level] * total.tables[level][k]) * p / (language_model.STRENGTH + total.customers[level][k])
        one = {}
        for (c, w), (x, e, y) in found.items():
            one[e, w] = y
        for c in sorted({c for c, _ in found}):
            e = contexts.parent[c]
            level1 = {w: one.get((e, w), rest(1, e, p)) for w, p in all0.items()}
            level2 = sum(found[c, w][0] if (c, w) in found else rest(2, c, p) for w, p in level1.items())
            assert level2 + rest(2, c, rest(1, e, new0)) == pytest.approx(1, abs=1e-9)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_a_customer_sits_alone_as_often_as_in_enumerated_seatings():
    def seatings(c, d):
        """(tables' sizes, weight) of seatings of c customers."""
        if c == 1:
            return {(1,): 1.0}
        out = {}
        for sizes, w in seatings(c - 1, d).items():
            for i, n in enumerate(sizes):
                s = (*sizes[:i], n + 1, *sizes[i + 1 :])
                out[s] = out.get(s, 0) + w * (n - d)
            out[(*sizes, 1)] = out.get((*sizes, 1), 0) + w
        return out

    ratio = language_model.alone(0.4)
    for c in range(2, 7):
        for t in range(1, c + 1):
            some = [(sizes, w) for sizes, w in seatings(c, 0.4).items() if len(sizes) == t]
            want = sum(w * sum(n == 1 for n in sizes) / c for sizes, w in some) / sum(w for _, w in some)
            assert ratio[c, t] == pytest.approx(want)


def print_of(t, n=4):
    w = t.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h) and h)


def test_simhash(spark, edge, empty):
    base = [" ".join(f"t{(i * 37 + k * k) % 5000}" for k in range(200)) for i in range(40)]
    more = [(100 + i, t) for i, t in enumerate(base)] + [(200 + i, t + " tail") for i, t in enumerate(base[:20])] + [(300 + i, base[0] + f" {i}") for i in range(30)]
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    pairs = [(r["doc_id"], print_of(r["text"] or "")) for r in docs.collect()]
    label = {i: i for i, _ in pairs if i is not None}
    changed = True
    while changed:
        changed = False
        for a, x in pairs:
            for b, y in pairs:
                if a is not None and b is not None and (x ^ y).bit_count() <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    rows = simhash.near_duplicates(docs, shard=8).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in rows) == sorted((str(i), f"{p:016x}", label.get(i)) for i, p in pairs)
    assert simhash.near_duplicates(empty).count() == 0


def test_vantage_search_is_exact():
    r = np.random.default_rng(2)
    x = r.integers(0, 2**63, 3000, dtype=np.int64).view(np.uint64)
    near = [x[r.integers(0, 60)] ^ np.bitwise_or.reduce(np.uint64(1) << r.choice(64, r.integers(1, 7), replace=False).astype(np.uint64)) for _ in range(900)]
    x = np.unique(np.concatenate([x, np.array(near, np.uint64)]))
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 4)
    want = {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a < b}
    pair = lambda a, b: {(min(p, q), max(p, q)) for p, q in zip(a.tolist(), b.tolist())}
    assert set().union(*(pair(a, b) for a, b in simhash.near_pairs(x, np.ones(len(x), bool), 4))) == want
    tree, got = simhash.grow(x[::2], 5), set()
    for _, at, home in simhash.route(x, tree, 4):
        for a, b in simhash.near_pairs(x[at], home, 4):
            got |= pair(at[a], at[b])
    assert got == want


def test_one_of_each(spark, edge, empty):
    text = " ".join(f"t{i * i % 4001}" for i in range(300))
    near = text.replace("t4 ", "changed ")
    docs = edge.unionByName(spark.createDataFrame([(50, text), (51, near), (52, text)], "doc_id long, text string"), allowMissingColumns=True)
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 7, 11, 12, 13, 14, 50] and None in ids
    assert simhash.one_of_each(empty).count() == 0


def test_alike_is_exact(spark):
    """Groups by whole shingle sets, whatever the repeats in one copy, and near the threshold."""
    r = np.random.default_rng(2)
    texts = []
    for i in range(60):
        words = [f"w{i}x{k}" for k in range(250)]
        for k in r.choice(250, r.integers(1, 8), replace=False):
            words[k] = "other"
        texts += [" ".join(f"w{i}x{k}" for k in range(250)), " ".join(words)]
    texts += [texts[0] + "".join(" " + " ".join(f"w0x{k}" for k in range(40)) for _ in range(10))]  # a passage repeated in one copy
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    label = np.arange(len(sets))
    for _ in range(5):
        label = np.array([label[n].min() for n in near])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.one_of_each(docs).collect()) == sorted(set(label.tolist()))


def test_repeated_ids_with_different_texts(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(50)) for c in "abc")
    docs = spark.createDataFrame([(1, one), (1, two), (1, two), (0, one), (2, three)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"][0]) for r in simhash.one_of_each(docs).collect()) == [(0, "a"), (1, "b"), (2, "c")]


def test_clashing_names_stay(spark):
    rows = [(1, "mail ann.bell@example.com now", 5, 6, 7, 8), (2, None, 1, 2, 3, 4), (3, "plain words only here", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found int, mark int, id int, key int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == rows
    masked = {r["doc_id"]: r for r in personal_data.redact(docs).collect()}
    assert masked[1].asDict() == {"doc_id": 1, "text": "mail <EMAIL> now", "found": 5, "mark": 6, "id": 7, "key": 8} and tuple(masked[2]) == rows[1]
