"""Operator 1: quality classifier, a generalised additive model with pairwise interactions.

Features are counts and ratios of the text alone.  The model is learnt by cyclic
boosting: feature after feature, a shallow tree over the feature's bins is
fitted to the gradients and its leaves are added to the feature's lookup table;
then the strongest pairs of features get two-dimensional tables in the same
way.  A score is the logistic of a sum of table entries.

Learning uses at most about MOST_LABELS labelled rows, whose features (not
texts) come to the driver; scoring reads every text where it lies.

Defined results: a null text counts as the empty one and is scored; a null
doc_id stays null and isn't held out; repeated rows are scored each; without
labels of both kinds every score is the share of label 1, or 0.5 without any;
other columns are ignored by ``score`` and kept by ``keep_good``; an empty table
gives an empty result.  A score of exactly 0.5 is predicted 1.  512 rows are taken
at once, or what an Arrow batch holds where its bytes are bounded; a very long
text is read whole and costs memory in proportion.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import give_back, id_and_text
from .labelled import held_out, sample_labels, with_labels

#: The documented bound of rows to learn from.
MOST_LABELS = 40_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, AT_ONCE = 32, 8, 10, 80, 0.15, 512

FEATURES = (
    "chars words upper digit newline bang stars hashes dollars percents ampersands pipes stops commas quotes other_marks wide "
    "mean_word longest_word distinct_words top_word repeats short_words marked_words lines distinct_lines line_length"
).split()
_MARKS = [b"!", b"*", b"#", b"$", b"%", b"&", b"|", b".", b",", b"\"'"]


def _classes() -> np.ndarray:
    kind = np.full(256, 15, np.uint8)
    for c in range(256):
        x = bytes([c])
        kind[c] = 0 if x.isupper() else 1 if x.isdigit() else 2 if x == b"\n" else 13 if c >= 128 else 14 if x.isalpha() or x.isspace() else 15
    for k, marks in enumerate(_MARKS):
        for c in marks:
            kind[c] = 3 + k
    return kind


_CLASS = _classes()


def features(text: str) -> list[float]:
    raw = text.encode()
    size = max(1, len(raw))
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=16) / size
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    lengths = [len(w) for w in words] or [0]
    marked = sum([not w[-1].isalnum() for w in words])
    return [
        np.log1p(len(raw)), np.log1p(len(words)), *kinds[:3], *kinds[3:13], kinds[15], kinds[13],
        sum(lengths) / n, max(lengths), len(counts) / n, max(counts.values(), default=0) / n, sum([a == b for a, b in zip(words, words[1:])]) / n,
        sum([x <= 3 for x in lengths]) / n, marked / n, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), len(text) / max(1, len(lines)),
    ]


def _feature_batch(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best split of bins into [:k] and [k:]."""
    gs, hs = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gs):
        return 0.0, 0
    gain = gs**2 / (hs + ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """Leaf values, by bin, of the tree of so many leaves that is grown greedily over the bins."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, k, p = max(((*_best_cut(g[a:b], h[a:b], ridge), (a, b)) for a, b in parts), key=lambda x: x[0])
        if gain <= 0:
            break
        parts.remove(p)
        parts += [(p[0], p[0] + k), (p[0] + k, p[1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _shallow_pair(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """The same over a grid: one cut of an axis, then one of the other axis on each side."""
    best = None
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, k = _best_cut(a.sum(1), b.sum(1), ridge)
        out = np.zeros(a.shape)
        for rows in (slice(0, k), slice(k, None)):
            out[rows] = _shallow(a[rows].sum(0), b[rows].sum(0), 2, ridge)
        gain = float((out * a).sum())
        if best is None or gain > best[0]:
            best = (gain, out.T if turned else out)
    return best[1]


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if self.edges:
            b = self.bins(x)
            for f in range(b.shape[1]):
                total += self.tables[f, b[:, f]]
            c = b * PAIR_BINS // BINS
            for i, j, t in self.pairs:
                total += t[c[:, i], c[:, j]]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(share / (1 - share))), [], np.zeros((x.shape[1], BINS)), [])
    if len(np.unique(y)) < 2:
        return model
    model.edges = [np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for v in x.T]
    b = model.bins(x).astype(np.int64)
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    def sums(k: np.ndarray, n: int, g: np.ndarray, h: np.ndarray):
        return np.bincount(k, g, n), np.bincount(k, h, n)

    for _ in range(ROUNDS):
        for f in range(x.shape[1]):
            step = RATE * _shallow(*sums(b[:, f], BINS, *slopes()))
            model.tables[f] += step
            total += step[b[:, f]]
    c = b * PAIR_BINS // BINS
    g, h = slopes()
    cells = PAIR_BINS**2
    strength = []
    for i in range(x.shape[1]):
        for j in range(i):
            gs, hs = sums(c[:, i] * PAIR_BINS + c[:, j], cells, g, h)
            strength.append((float((gs * _shallow_pair(gs.reshape(PAIR_BINS, -1), hs.reshape(PAIR_BINS, -1)).ravel()).sum()), i, j))
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in sorted(strength, reverse=True)[:PAIRS]]
    for _ in range(ROUNDS // 2):
        for i, j, table in model.pairs:
            k = c[:, i] * PAIR_BINS + c[:, j]
            step = RATE * _shallow_pair(*[s.reshape(PAIR_BINS, -1) for s in sums(k, cells, *slopes())])
            table += step
            total += step.ravel()[k]
    return model


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, most: int = MOST_LABELS) -> AdditiveModel:
    """Fit on the labelled documents where ``learn_from`` (over labels) holds: of rows that repeat a labelled id one is learnt
    from, so what reaches the driver has the sample's bound."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                x = _feature_batch(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("label_id"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["label_id", "y", "x"])

    rows = with_labels(id_and_text(docs), sample_labels(labels, "quality", learn_from, most)).select("label_id", "y", "text")
    found = rows.mapInArrow(run, "label_id long, y int, x array<double>")
    t = found.groupBy("label_id").agg(F.min(F.struct("y", "x")).alias("r")).select("label_id", "r.y", "r.x").toArrow().combine_chunks()
    x = pc.list_flatten(t.column("x")).to_numpy().reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, t.column("label_id").to_numpy()])
    x, y = x[order], t.column("y").to_numpy()[order].astype(np.float64)
    del t
    model = fit(x, y)
    del x, y
    give_back()
    return model


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, score and predicted of every whole text."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                s = model.score(_feature_batch(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: AdditiveModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``least`` or more; nothing is shuffled."""

    def run(batches):
        for b in batches:
            texts = b.column("text").fill_null("")
            for at in range(0, b.num_rows, AT_ONCE):
                keep = model.score(_feature_batch(texts.slice(at, AT_ONCE).to_pylist())) >= least
                yield b.slice(at, AT_ONCE).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, most: int = MOST_LABELS) -> DataFrame:
    """Score all documents by a model that never saw the labels held out."""
    from .labelled import learns

    model = learn(docs, labels, learns(modulus, held), most)
    return score(docs, model).select("doc_id", held_out(modulus, held).alias("held_out"), "score", "predicted")
