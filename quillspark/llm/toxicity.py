"""Operator 6: toxicity by the nearest labelled examples under exact TF-IDF cosine.

1. Terms: every word of the examples, whatever its label or frequency.
2. Document frequencies of all terms are counted over all documents, a vector a
   task.  Chi-square over the examples raises the weight of
   words that depend on the label; it leaves out none.
3. The examples' unit vectors go into a block-max inverted index.  A block is 64
   examples.  Rare terms have postings, which are added up in full; of the
   commonest terms every block keeps the largest weights, which bound what they
   add to its cosines.  The most promising blocks are scored first, and then
   only those whose bound reaches the k-th nearest found.  All examples as near
   as the k-th vote.
4. Their votes, weighted by nearness, are put on a probability scale fitted on
   the quarter of the examples that chi-square didn't see, each without its own
   vote; then all examples weigh the words.

Examples are a bounded sample (MOST_EXAMPLES labelled rows, up to half of them
of either label; an example's vote counts for as many rows as it stands for, and
equal texts are one example with their mean label), so the index has a bound
too; every text is scored whole.  All words of a text are in its norm: those of
no example, which can't meet any, weigh there as words of a single document do.
Beside the cosines that vote, which chi-square weighs, the evidence has the
plain ones.

Defined results: a null text counts as the empty one; a text without any word
is as near to every example without words and gets their share of label 1, one
with unknown words only gets the share among all examples; ties at the k-th
cosine all vote, and evidence is ordered by cosine, then id; a null doc_id stays
null; repeated rows are scored each; without examples scores are 0; other
columns are ignored by ``score`` and kept by ``keep_clean``.  A batch is scored
in parts of at most 4 MB of text, a longer text by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import give_back, id_and_text, slices, staged
from .labelled import balanced_labels, held_out, learns, with_labels

#: The documented bound: labelled rows that vote.
MOST_EXAMPLES = 6_144
#: A term must be in so many examples for chi-square to weigh it; the weight is 1 + sqrt(chi / UNIT_CHI).
LEAST_DF, UNIT_CHI = 3, 2.0
#: Neighbours that vote, examples of a block, and blocks added up before any bound is known.
NEIGHBOURS, BLOCK, FIRST = 16, 64, 4
#: Terms that the index holds as a matrix, texts compared with it at once, and the nearness at which examples tie.
COMMON, TEXTS, TIE = 512, 128, 1e-9
#: Bytes of text taken at once, and slices in which the frequencies of the terms travel.
PART, SLICES = 4 << 20, 64

#: ASCII letters become lower case and other ASCII characters but digits become spaces.
_LETTERS = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(number of the text, word) of every word, in order."""
    lower = pc.utf8_lower(texts)
    _, offsets, data = lower.buffers()
    if data is None or not len(lower):
        return np.zeros(0, np.int64), pa.array([], pa.string()).dictionary_encode()
    plain = pa.StringArray.from_buffers(len(lower), offsets, pa.py_buffer(data.to_pybytes().translate(_LETTERS)))
    lists = pc.split_pattern(plain, " ")
    found, of = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    some = pc.greater(pc.binary_length(found), 0)
    return of[some.to_numpy(zero_copy_only=False)], found.filter(some).dictionary_encode()


class Vectors:
    """Terms of a text and their counts, by the places of the words in a list."""

    def __init__(self, terms: pa.Array):
        self.terms = terms

    def of(self, texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Terms in order and their counts for each text, and whether it has any word."""
        return self.all_of(texts)[:3]

    def all_of(self, texts: pa.Array):
        """``of``, and the sum of (1 + log(count))^2 over each text's words that aren't in the list."""
        n, (of, found) = len(texts), split_words(texts)
        if not len(of):
            none = [np.zeros(0, np.int64)] * n
            return none, none, np.zeros(n, bool), np.zeros(n)
        words = pc.fill_null(pc.index_in(found.dictionary, value_set=self.terms), -1).to_numpy().astype(np.int64)
        place = words[found.indices.to_numpy()]
        known = place >= 0
        other, times = np.unique(of[~known] * len(words) + found.indices.to_numpy()[~known].astype(np.int64), return_counts=True)
        rest = np.bincount(other // len(words), (1 + np.log(times)) ** 2, n)
        pairs, counts = np.unique(of[known] * len(self.terms) + place[known], return_counts=True)
        cuts = np.searchsorted(pairs, np.arange(1, n) * len(self.terms))
        return np.split(pairs % max(1, len(self.terms)), cuts), np.split(counts, cuts), np.bincount(of, minlength=n) > 0, rest


class BlockMaxIndex:
    """Exact cosine search over unit vectors given as (terms, weights) rows; weights are kept in single precision."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: np.ndarray, n_terms: int, stands_for: np.ndarray | None = None):
        self.n = len(rows)
        self.blocks = max(1, -(-self.n // BLOCK))
        at = np.repeat(np.arange(self.n), [len(t) for t, _ in rows])
        term = np.concatenate([t for t, _ in rows] or [np.zeros(0)]).astype(np.int64)
        weight = np.concatenate([w for _, w in rows] or [np.zeros(0)]).astype(np.float32)
        n_terms = max(1, n_terms)
        common = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:COMMON]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        dense = np.zeros((self.n, len(common)), np.float32)
        own = self.column[term] >= 0
        dense[at[own], self.column[term[own]]] = weight[own]
        # examples whose strongest common term is the same share blocks, so that bounds are tighter
        order = np.lexsort((ids, dense.argmax(1) if dense.size else ids))
        self.labels, self.ids, self.rows = labels[order], ids[order], order
        self.stands_for = np.ones(self.n) if stands_for is None else stands_for[order]
        self.dense = np.zeros((self.blocks, BLOCK, len(common)), np.float32)
        self.dense.reshape(-1, len(common))[: self.n] = dense[order]
        self.most = self.dense.max(1)
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        at, term, weight = place[at[~own]], term[~own], weight[~own]
        by = np.lexsort((at, term))
        self.at, self.weight = at[by].astype(np.int32), weight[by]
        self.of_term = np.r_[0, np.cumsum(np.bincount(term, minlength=n_terms))]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave_out: int = -1, ties: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(positions, cosines) of the k nearest with a cosine over 0; ``leave_out`` is a position that doesn't count."""
        return next(self.nearest_of([(terms, weights)], k, [leave_out], ties))

    def nearest_of(self, queries: list, k: int, leave_out: list[int] | None = None, ties: bool = False):
        """``nearest`` of each query; with ``ties`` all examples as near as the k-th."""
        for s in range(0, len(queries), TEXTS):
            yield from self._some(queries[s : s + TEXTS], k, [-1] * TEXTS if leave_out is None else leave_out[s : s + TEXTS], ties)

    def _rare(self, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The part of every cosine that comes from terms with postings."""
        own = self.column[t] < 0
        t, w = t[own], w[own]
        a = self.of_term[t]
        n = self.of_term[t + 1] - a
        posts = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.at[posts], np.repeat(w, n) * self.weight[posts], self.blocks * BLOCK)

    def _some(self, queries: list, k: int, leave_out: list[int], ties: bool):
        m, none = len(queries), (np.zeros(0, np.int64), np.zeros(0))
        if not self.n:
            yield from [none] * m
            return
        q = np.zeros((m, self.dense.shape[2]), np.float32)
        for i, (t, w) in enumerate(queries):
            c = self.column[t]
            q[i, c[c >= 0]] = w[c >= 0]
        rare = np.stack([self._rare(t, w) for t, w in queries])
        by_block = rare.astype(np.float32).reshape(m, self.blocks, BLOCK)
        bound = q @ self.most.T + by_block.max(2) + 1e-4
        near, least, known = np.full(by_block.shape, -1, np.float32), np.zeros(m), np.zeros((m, self.blocks), bool)
        first = np.argpartition(-bound, min(FIRST, self.blocks) - 1, axis=1)[:, :FIRST]
        for i in range(m):
            near[i, first[i]] = self.dense[first[i]] @ q[i] + by_block[i, first[i]]
            known[i, first[i]] = True
            if leave_out[i] >= 0 and known[i, leave_out[i] // BLOCK]:
                near[i, leave_out[i] // BLOCK, leave_out[i] % BLOCK] = -1
            some = near[i, first[i]].ravel()
            if len(some) >= k:
                least[i] = max(0.0, float(np.partition(some, len(some) - k)[len(some) - k]))
        # only blocks that may hold an example as near as the k-th so far
        todo = (bound >= least[:, None]) & ~known
        for b in np.flatnonzero(todo.any(0)):
            i = np.flatnonzero(todo[:, b])
            near[i, b] = q[i] @ self.dense[b].T + by_block[i, b]
        near = near.reshape(m, -1)
        dense = self.dense.reshape(-1, self.dense.shape[2])
        for i in range(m):
            if leave_out[i] >= 0:
                near[i, leave_out[i]] = -1
            found = np.flatnonzero((near[i] > 0) & (near[i] >= least[i] - 1e-4))
            if len(found) > 4 * k:
                some = near[i, found]
                found = found[some >= np.partition(some, len(found) - k)[len(found) - k] - 1e-4]
            exact = (dense[found] * q[i].astype(float)).sum(1) + rare[i, found]
            by = np.lexsort((self.ids[found], -exact))
            found, exact = found[by], exact[by]
            last = int((exact >= exact[k - 1] - TIE).sum()) if ties and len(found) > k else k
            yield found[:last], exact[:last]


def vote(near: np.ndarray, labels: np.ndarray, stands_for: np.ndarray, base: float) -> float:
    """Share of label 1 among the neighbours, the nearer the heavier, drawn a little to ``base``."""
    w = stands_for * near / (1.25 - np.minimum(near, 1.0))
    return float((w @ labels + base) / (w.sum() + 1))


class ToxicityModel:
    """Examples are (id, label, terms, counts, whether they have words, whether the scale is fitted on them, rows they stand for)."""

    def __init__(self, terms: pa.Array, idf: np.ndarray, examples: list[tuple], unseen: float = 1.0):
        """``unseen`` is the idf of a word of no example."""
        examples = sorted(examples, key=lambda e: (e[0], e[1]))
        y, ids = np.array([e[1] for e in examples], float), np.array([e[0] for e in examples], np.int64)
        some, fitted = np.array([e[4] for e in examples], bool), np.array([e[5] for e in examples], bool)
        w = np.array([e[6] for e in examples], float)
        self.vectors = Vectors(terms)
        self.base = float(np.average(y, weights=w)) if len(y) else 0.0
        self.blank = float(((y * w)[~some].sum() + self.base) / (w[~some].sum() + 1))
        self.slope, self.shift, self.idf, self.unseen = 1.0, 0.0, idf, unseen
        self.plain = [(e[2].astype(np.int32), self._unit(e[2], e[3], plain=True)[1].astype(np.float32)) for e, s in zip(examples, some) if s]

        def index(seen: np.ndarray) -> list:
            self.weight_of = idf * _label_weights([e[2] for e in examples], y, seen, len(terms))
            rows = [self._unit(e[2], e[3]) for e, s in zip(examples, some) if s]
            self.index = BlockMaxIndex(rows, y[some], ids[some], len(terms), w[some])
            return rows

        rows = index(~fitted)
        self._calibrate(rows, y[some], w[some], np.flatnonzero(fitted[some]))
        rows = self.index = None  # one index at a time
        index(np.ones(len(y), bool))

    def _unit(self, terms: np.ndarray, counts: np.ndarray, rest: float = 0.0, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the terms over the norm of all words; ``rest`` is what the words of no example have in it before their idf."""
        w = (1 + np.log(np.maximum(counts, 1))) * (self.idf if plain else self.weight_of)[terms] if len(terms) else np.zeros(0)
        n = np.sqrt((w**2).sum() + rest * self.unseen**2)
        return (terms, w / n) if n > 0 else (terms[:0], w[:0])

    def _vote(self, found: np.ndarray, near: np.ndarray) -> float:
        return min(max(vote(near, self.index.labels[found], self.index.stands_for[found], self.base), 1e-4), 1 - 1e-4)

    def _calibrate(self, rows, y, w, some) -> None:
        """Logistic scale over left-one-out votes, by Newton steps with a weak pull to the identity."""
        y, w = y[some], w[some]
        if len(np.unique(y)) < 2:
            return
        place = np.argsort(self.index.rows)
        near = self.index.nearest_of([rows[k] for k in some], NEIGHBOURS, place[some].tolist(), True)
        z = np.array([self._vote(found, c) for found, c in near])
        x = np.stack([np.log(z / (1 - z)), np.ones(len(z))], 1)
        b = np.array([1.0, 0.0])
        for _ in range(20):
            p = 1 / (1 + np.exp(-x @ b))
            b = b - np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + 10 * np.eye(2), x.T @ (w * (p - y)) + 10 * (b - [1.0, 0.0]))
            b = np.clip(b, [0.2, -4.0], [4.0, 4.0])  # steps from few examples mustn't run away
        self.slope, self.shift = float(b[0]), float(b[1])

    def score(self, texts: pa.Array) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        """(probability, first neighbours' ids, their cosines, their plain cosines) of each text."""
        terms, counts, some, rest = self.vectors.all_of(texts)
        queries = [self._unit(t, c, r) for t, c, r in zip(terms, counts, rest)]
        out, held = [], np.zeros(len(self.vectors.terms))
        for k, (found, near) in enumerate(self.index.nearest_of(queries, NEIGHBOURS, None, True)):
            if len(found):
                z = self._vote(found, near)
                p = 1 / (1 + np.exp(-(self.slope * np.log(z / (1 - z)) + self.shift)))
            else:
                p = self.base if some[k] else self.blank
            found = found[:NEIGHBOURS]
            own = terms[k]
            held[own] = self._unit(own, counts[k], rest[k], plain=True)[1]
            plain = np.array([held[t] @ w for t, w in (self.plain[r] for r in self.index.rows[found])]) if len(found) else np.zeros(0)
            held[own] = 0
            out.append((float(p), self.index.ids[found], near[:NEIGHBOURS], plain))
        return out


def _label_weights(terms: list[np.ndarray], y: np.ndarray, seen: np.ndarray, size: int) -> np.ndarray:
    """Weight of each term by chi-square over the examples that are ``seen``; labels may be means.

    Examples count as one each, whatever they stand for: the test is on the sample.
    """
    n1, n = np.zeros(size), np.zeros(size)
    for t, label in zip([t for t, s in zip(terms, seen) if s], y[seen]):
        n1[t] += label
        n[t] += 1
    all1, total = float(y[seen].sum()), int(seen.sum())
    all0 = total - all1
    sound = (n >= LEAST_DF) & (n < total)
    if not (all0 > 0 and all1 > 0 and sound.any()):
        return np.ones(size)
    chi = np.where(sound, total * (n1 * all0 - (n - n1) * all1) ** 2 / (all0 * all1 * np.maximum(n * (total - n), 1)), 0.0)
    return 1 + np.sqrt(chi / UNIT_CHI)


def _frequencies(texts: DataFrame, vectors: Vectors) -> tuple[int, np.ndarray]:
    """The number of documents, and that with each term; a task sends one vector in slices."""
    shared = texts.sparkSession.sparkContext.broadcast(vectors)  # the words of MOST_EXAMPLES texts
    size = len(vectors.terms)
    cuts = np.linspace(0, size, SLICES + 1).astype(int).tolist()

    def count(batches):
        vectors, df, n = shared.value, np.zeros(size, np.int64), 0
        for b in batches:
            for part in slices(b, PART):
                n += part.num_rows
                df += np.bincount(np.concatenate(vectors.of(part.column("text"))[0]).astype(np.int64), minlength=size)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([n] * SLICES, pa.int64()), pa.array([df[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["slice", "n", "df"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer() or b"", np.int64) for x in t.column("df"))
        return pa.table({"slice": t.column("slice")[:1], "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "df": pa.array([total.tobytes()], pa.binary())})

    schema = "slice int, n long, df binary"
    rows = sorted(tuple(r) for r in texts.select("text").mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema).collect())
    shared.destroy()
    return (rows[0][1], np.concatenate([np.frombuffer(r[2], np.int64) for r in rows])) if rows else (0, np.zeros(size, np.int64))


def _examples(chosen: DataFrame) -> tuple[pa.Array, list[tuple]]:
    """The distinct words of the examples, and the examples; both are bounded by the sample."""

    def split(batches):
        for b in batches:
            for part in slices(b, PART):
                yield pa.RecordBatch.from_arrays([split_words(part.column("text"))[1].dictionary], ["term"])

    terms = chosen.select("text").mapInArrow(split, "term string").distinct().toArrow().column("term").combine_chunks().sort()
    vectors = Vectors(terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms)

    def count(batches):
        for b in batches:
            for part in slices(b, PART):
                t, c, some = vectors.of(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label_id"), part.column("y"), pa.array([x.astype("<i4").tobytes() for x in t]), pa.array([x.astype("<i4").tobytes() for x in c]), pa.array(some), part.column("fitted"), part.column("w")], ["label_id", "y", "terms", "counts", "some", "fitted", "w"]
                )

    rows = chosen.mapInArrow(count, "label_id long, y double, terms binary, counts binary, some boolean, fitted boolean, w double").toLocalIterator()
    return vectors.terms, [(r["label_id"], r["y"], np.frombuffer(r["terms"], "<i4"), np.frombuffer(r["counts"], "<i4"), r["some"], r["fitted"], r["w"]) for r in rows]


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, most: int = MOST_EXAMPLES) -> tuple[ToxicityModel, DataFrame]:
    """The model, and (doc_id, text) of all documents for scoring."""
    texts, sample = id_and_text(docs), balanced_labels(labels, "toxic", learn_from, most)
    one_each = with_labels(texts, sample).groupBy("text").agg(F.min("label_id").alias("label_id"), F.avg("y").alias("y"), F.sum("w").alias("w"))
    # of an id's different texts one is an example, so that a repeated id doesn't lift the bound
    first = one_each.groupBy("label_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y", "w")).alias("r"))
    one_each = first.select("r.text", "label_id", "r.y", "r.w")
    chosen = staged(one_each.withColumn("fitted", F.pmod(F.xxhash64("label_id"), F.lit(4)) == 0), "examples")
    terms, examples = _examples(chosen)
    n, df = _frequencies(texts, Vectors(terms))
    model = ToxicityModel(terms, 1 + np.log((n + 1) / (df + 1)), examples, 1 + np.log((n + 1) / 2))
    del examples, df
    give_back()
    return model, texts


EVIDENCE = ", neighbours array<long>, cosines array<double>, plain_cosines array<double>"


def score(texts: DataFrame, model: ToxicityModel, evidence: bool = True) -> DataFrame:
    """doc_id, score, predicted and the first examples that voted, the nearest first."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_EXAMPLES
    schema = "doc_id long, score double, predicted int" + (EVIDENCE if evidence else "")

    def run(batches):
        model = shared.value
        for b in batches:
            for part in slices(b, PART):
                got = model.score(part.column("text"))
                s = np.array([g[0] for g in got], float)
                columns = [part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
                if evidence:
                    columns += [pa.array([g[i].tolist() for g in got], pa.list_(k)) for i, k in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "neighbours", "cosines", "plain_cosines"][: len(columns)])

    return texts.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: ToxicityModel, most: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``most``; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            for part in slices(b, PART):
                keep = [g[0] < most for g in model.score(part.column("text").fill_null(""))]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, most: int = MOST_EXAMPLES, evidence: bool = True) -> DataFrame:
    """Score all documents by examples whose labels aren't held out."""
    model, texts = learn(docs, labels, learns(modulus, held), most)
    scored = score(texts, model, evidence).withColumn("held_out", held_out(modulus, held))
    del model
    give_back()  # from here the broadcast holds it
    return scored
