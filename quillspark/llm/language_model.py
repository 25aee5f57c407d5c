"""Operator 7: a hierarchical Pitman-Yor language model, learnt and applied as Spark jobs.

A token is seated in the restaurant of its context, the word before it.  Words
with at least a share of 1/CONTEXTS of the training tokens have a restaurant of
their own; rarer ones share that of their ending (the last two characters).
Restaurants of both kinds hang below the one of their ending, and all of those
below the unigram restaurant, whose base gives a share to the unknown word,
estimated from the words that were drawn once there, and the rest evenly to the
known ones, hot or not.  Shares, not numbers, choose the contexts, so
there are at most CONTEXTS + ENDINGS restaurants whatever the table.

1. Blocks.  Each task splits its documents into words and keeps, per block of a
   bounded number of tokens, a file of word numbers.  A word's training count is
   added up over the blocks where it has a share of 2^-18 or more, which finds
   every frequent word.
2. Pairs.  A block's distinct (context, word) pairs with their training counts go
   to the word's bucket; a hot word's are spread over buckets by their ending, so
   that no task holds a word.  A pair travels once a block whatever its
   frequency, and its probability comes back the same way.
3. Seating.  Every sweep is a job over the buckets: it removes each customer of
   each dish and seats it again, given the parents' probabilities and the
   restaurants' totals before the sweep; the tables of a restaurant are its
   parent's customers.  The totals of the new seating are gathered after each
   sweep.  Dishes of more than 64 customers are seated anew, those beyond the
   64th in lots of a sixteenth of those seated; hot words' unigram dishes are
   seated by the driver.
4. Answers.  The probabilities of the last sweeps, each with its own seating's
   totals, so that they sum to one over the words of every context, are averaged
   and return to the blocks, which sum their documents.

Dishes of a sweep are reseated at the same time, as in other distributed Gibbs
samplers, and a dish's table sizes are integrated out: the chance that a customer
sits alone follows from the numbers of customers and tables.  Files have names
fixed by partition and place, so a task that runs again writes the same ones.

Defined results: a null text counts as the empty one and has its end token
alone; a null doc_id stays null, isn't held out and is learnt from; repeated
rows are learnt from and scored each; without training documents every token is
unknown and the model's probability of an unknown token is the base's; other
columns are ignored.  A block ends with the document that fills it, so a very
long text makes a block of its own size.
"""

from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_and_text, new_path, staged

#: Tokens of a block, and training tokens that a bucket is meant to seat.
BLOCK_TOKENS, BUCKET_TOKENS = 2_000_000, 1_000_000
#: Frequent contexts have at least 1/CONTEXTS of the tokens, hot words 1/HOT; hot words are spread by the ENDINGS before them.
CONTEXTS, ENDINGS, HOT = 1 << 15, 1 << 12, 2048
STRENGTH, BURN, SAMPLES = 1.0, 2, 3
#: Customers of a dish up to which they are removed and seated one by one.
SINGLY = 64
SEEN = "block long, word long, ending int, n long"
PACK = "bucket long, block long, words binary, runs binary, contexts binary, counts binary"
ANSWER = "block long, bucket long, logs binary, counts binary"
TOTAL = "path string, level int, place int, customers long, tables long"


def _io(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _save(uri: str, **arrays) -> None:
    """Write arrays as one compressed file that appears whole or not at all."""
    held = io.BytesIO()
    np.savez(held, **arrays)
    store, path = _io(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    from uuid import uuid4

    part = f"{path}.{uuid4().hex}"
    with store.open_output_stream(part, compression=None) as f:
        f.write(len(held.getvalue()).to_bytes(8, "little"))
        f.write(pa.compress(held.getvalue(), codec="zstd", asbytes=True))
    store.move(part, path)


def _load(uri: str) -> dict:
    store, path = _io(uri)
    with store.open_input_stream(path, compression=None) as f:
        raw = f.read()
    return dict(np.load(io.BytesIO(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True))))


def _ending(word: bytes) -> int:
    """The class of a word's last two characters."""
    end = word.decode()[-2:]
    return (ord(end[-1]) % 64) * 64 + (ord(end[-2]) % 64 if len(end) > 1 else 0)


def _squeeze(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(raw: bytes, kind: str) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


class Contexts:
    """The frequent words in order of their hashes with their endings, and the hot ones among them."""

    def __init__(self, rows: list[tuple[int, int, int]], tokens: int):
        """Rows of (hash, ending, training count)."""
        rows = sorted((int(np.int64(h).view(np.uint64)), e, n) for h, e, n in rows)
        self.words = np.array([h for h, _, _ in rows], np.uint64)
        self.parent = np.array([e for _, e, _ in rows] + list(range(ENDINGS)), np.int64)
        self.hot = np.array([h for h, _, n in rows if n * HOT >= tokens], np.uint64)

    def of(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        """The restaurant of each word as a context."""
        at = place(self.words, words)
        return np.where(at >= 0, at, len(self.words) + endings)

    def bucket(self, words: np.ndarray, contexts: np.ndarray, buckets: int) -> np.ndarray:
        salt = np.where(place(self.hot, words) >= 0, self.parent[contexts] + 1, 0).astype(np.uint64)
        with np.errstate(over="ignore"):
            return ((words + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)


def place(known: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Positions of words among sorted known ones, -1 for others."""
    if not len(known):
        return np.full(len(words), -1, np.int64)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, at, -1)


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables after seating each dish's customers; ``weight`` is what speaks for a new table."""
    tables = (customers > 0).astype(np.float64)
    at, seated = np.flatnonzero(customers > 1), 1
    while len(at) and seated < 64:
        t, w = tables[at], weight[at]
        tables[at] = t + (rng.random(len(at)) * (seated - discount * t + w) < w)
        seated += 1
        at = at[customers[at] > seated]
    n = np.full(len(at), 64, np.int64)
    while len(at):
        lot = np.minimum(customers[at] - n, n // 16)
        t, w = tables[at], weight[at]
        tables[at] = t + rng.binomial(lot, np.clip(w / (n - discount * t + w), 0, 1))
        n = n + lot
        left = n < customers[at]
        at, n = at[left], n[left]
    return tables


def alone(discount: float) -> np.ndarray:
    """By customers and tables of a dish, the chance that a customer sits alone: a ratio of generalised Stirling numbers."""
    s = np.zeros((SINGLY + 1, SINGLY + 1))
    s[0, 0] = 1
    t = np.arange(1, SINGLY + 1)
    for c in range(1, SINGLY + 1):
        s[c, 1:] = s[c - 1, :-1] + np.maximum(c - 1 - t * discount, 0) * s[c - 1, 1:]
    out = np.ones_like(s)
    out[1:, 1:] = np.divide(s[:-1, :-1], s[1:, 1:], out=np.ones((SINGLY, SINGLY)), where=s[1:, 1:] > 0)
    return out


def reseat(before: np.ndarray, tables: np.ndarray, customers: np.ndarray, own: np.ndarray, parent: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables of each dish after its customers, ``before`` of them seated at ``tables``, became ``customers`` and each was
    removed and seated again.  ``own`` are the restaurant's tables before, ``parent`` the parent's probability."""
    ratio, out = alone(discount), tables.astype(np.float64)
    big = np.maximum(before, customers) > SINGLY
    at = np.flatnonzero(big)
    out[at] = seat(customers[at], (STRENGTH + discount * own[at]) * parent[at], discount, rng)

    def leave(i, c, t):
        return t - (rng.random(len(i)) < ratio[c[i].astype(int), t.astype(int)])

    def enter(i, c, t, old):
        w = (STRENGTH + discount * (own[i] - old + t)) * parent[i]
        return np.where(c[i] == 0, 1, t + (rng.random(len(i)) * (c[i] - discount * t + w) < w))

    c = np.where(big, customers, before).astype(np.float64)
    while len(at := np.flatnonzero(c > customers)):
        out[at] = leave(at, c, out[at])
        c[at] -= 1
    while len(at := np.flatnonzero(c < customers)):
        out[at] = enter(at, c, out[at], tables[at])
        c[at] += 1
    at = np.flatnonzero(~big & (customers > 1))
    for turn in range(SINGLY):
        at = at[customers[at] > turn]
        if not len(at):
            break
        t = leave(at, c, out[at])
        c[at] -= 1
        out[at] = enter(at, c, t, tables[at])
        c[at] += 1
    return out


class Totals:
    """Customers and tables of every restaurant by level (2: context, 1: ending, 0: all), discounts, hot dishes, N and V."""

    def __init__(self, rows, contexts: Contexts, seed: int = 0):
        sizes = [1, ENDINGS, len(contexts.parent)]
        self.customers, self.tables = [np.zeros(n) for n in sizes], [np.zeros(n) for n in sizes]
        hot = len(contexts.hot)
        self.n, self.v, self.discount = 0, hot, [0.5, 0.5, 0.5]
        self.hot_customers, self.hot_count = np.zeros(hot, np.int64), np.zeros(hot, np.int64)
        once = 0
        for level, k, customers, tables in rows:
            if level == -1:
                self.n, self.v = customers, self.v + tables
            elif level == -2:  # dishes with one and with two customers
                self.discount[k] = min(0.95, max(0.05, (customers + 1) / (customers + 2 * tables + 2)))
                once = customers if k == 0 else once
            elif level == -3:
                self.hot_customers[k], self.hot_count[k] = customers, tables
            else:
                self.customers[level][k], self.tables[level][k] = customers, tables
        # a draw at the unigram restaurant brings a word that no other draw has about as often as its words were drawn once;
        # of the draws that reach the base, that share is the unknown word's
        drawn, tables = self.customers[0][0] + self.hot_customers.sum(), self.tables[0][0] + hot
        reach = (STRENGTH + self.discount[0] * tables) / (STRENGTH + drawn)
        self.unknown = float(np.clip(once / max(1, drawn) / reach, 0.01, 0.99)) if self.v else 1.0
        self.known = (1 - self.unknown) / max(1, self.v)
        # hot words' dishes have the same base as all others
        w = (STRENGTH + self.discount[0] * tables) * self.known
        self.hot_tables = seat(self.hot_customers, np.full(hot, w), self.discount[0], np.random.default_rng(seed))
        self.customers[0][0] += self.hot_customers.sum()
        self.tables[0][0] += self.hot_tables.sum()


class Bucket:
    """The dishes of one bucket at the three levels."""

    def __init__(self, word: np.ndarray, context: np.ndarray, count: np.ndarray, contexts: Contexts):
        """One entry per (word, context), sorted by word, the context's ending and the context."""
        ending = contexts.parent[context]
        self.place, self.count = [None, None, context.astype(np.int64)], count.astype(np.int64)
        new1 = np.r_[True, (word[1:] != word[:-1]) | (ending[1:] != ending[:-1])][: len(word)]
        new0 = np.r_[True, word[1:] != word[:-1]][: len(word)]
        self.of_word = np.cumsum(new0) - 1
        self.up = [None, self.of_word[new1], np.cumsum(new1) - 1]  # of level 1 to 0, of level 2 to 1
        self.place[1], self.place[0] = ending[new1], np.zeros(int(new0.sum()), np.int64)
        self.sizes = [int(new0.sum()), int(new1.sum()), len(word)]
        self.hot = place(contexts.hot, word[new0])
        self.own = self.hot < 0  # words whose unigram dish is in this bucket alone
        self.word_count = np.bincount(self.of_word, self.count, self.sizes[0]).astype(np.int64)

    def customers(self, tables: list[np.ndarray]) -> list[np.ndarray]:
        return [np.bincount(self.up[1], tables[1], self.sizes[0]), np.bincount(self.up[2], tables[2], self.sizes[1]), self.count]

    def minimal(self) -> list[np.ndarray]:
        """A table for each dish: the start of the seating."""
        two = (self.count > 0).astype(np.float64)
        one = (np.bincount(self.up[2], two, self.sizes[1]) > 0).astype(np.float64)
        return [(np.bincount(self.up[1], one, self.sizes[0]) > 0).astype(np.float64), one, two]

    def counts(self, total: Totals) -> np.ndarray:
        """Training tokens of each word."""
        return np.where(self.own, self.word_count, total.hot_count[self.hot] if len(total.hot_count) else 0)

    def predict(self, tables: list[np.ndarray], total: Totals) -> list[np.ndarray]:
        """Predictive probability of each dish at each level, given a seating and its totals."""
        customers, tables = self.customers(tables), list(tables)
        if len(total.hot_count):
            customers[0] = np.where(self.own, customers[0], total.hot_customers[self.hot])
            tables[0] = np.where(self.own, tables[0], total.hot_tables[self.hot])
        out, parent = [], np.where(self.counts(total) > 0, total.known, total.unknown)
        for level in (0, 1, 2):
            k, d = self.place[level], total.discount[level]
            parent = parent if level == 0 else out[-1][self.up[level]]
            own = np.maximum(customers[level] - d * tables[level], 0)
            out.append((own + (STRENGTH + d * total.tables[level][k]) * parent) / (STRENGTH + total.customers[level][k]))
        return out

    def sweep(self, tables: list[np.ndarray], total: Totals, rng) -> list[np.ndarray]:
        """Reseat all dishes from the bottom up, given the parents' probabilities and the totals before the sweep."""
        p, before, out = self.predict(tables, total), self.customers(tables), [None, None, None]
        for level in (2, 1, 0):
            customers = self.count if level == 2 else np.bincount(self.up[level + 1], out[level + 1], self.sizes[level])
            parent = p[level - 1][self.up[level]] if level else np.full(self.sizes[0], total.known)
            out[level] = reseat(before[level].astype(np.int64), tables[level], customers.astype(np.int64), total.tables[level][self.place[level]], parent, total.discount[level], rng)
        return out

    def totals(self, tables: list[np.ndarray]):
        """Rows (level, place, customers, tables) of this bucket's share."""
        customers = self.customers(tables)
        yield -1, 0, int(self.count.sum()), int((self.word_count[self.own] > 0).sum())
        for level in (0, 1, 2):
            c, t, k = customers[level], tables[level], self.place[level]
            if level == 0:
                for h, a, b in zip(self.hot[~self.own].tolist(), c[~self.own].tolist(), self.word_count[~self.own].tolist()):
                    yield -3, h, int(a), int(b)
                c, t, k = c[self.own], t[self.own], k[self.own]
            yield -2, level, int((c == 1).sum()), int((c == 2).sum())
            k, at = np.unique(k, return_inverse=True)
            for x, a, b in zip(k.tolist(), np.bincount(at, c, len(k)).tolist(), np.bincount(at, t, len(k)).tolist()):
                yield level, x, int(a), int(b)


def _gather(rows: DataFrame, contexts: Contexts, seed: int) -> Totals:
    """Sums over all buckets: at most one row per restaurant and hot word."""
    sums = rows.groupBy("level", "place").agg(F.sum("customers").alias("customers"), F.sum("tables").alias("tables")).collect()
    return Totals([tuple(r) for r in sums], contexts, seed)


def _batch(columns, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    names, types = zip(*[x.split() for x in schema.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], list(names))


def _block(docs: list, folder: str, block: int, modulus: int, held: int) -> pa.RecordBatch:
    """Write a block's file; the rows count its frequent words, and one without a word all its training tokens."""
    import xxhash

    numbers, words, lengths = {}, [], []
    for _, text in docs:
        ids = [numbers.setdefault(w, len(numbers)) for w in text.encode().lower().split()]
        words += ids
        words.append(-1)
        lengths.append(len(ids) + 1)
    names = [*numbers, b"\n"]
    token = np.array(words, np.int32)
    token[token < 0] = len(names) - 1
    learnt = np.array([d is None or zlib.crc32(str(d).encode()) % modulus != held for d, _ in docs])
    hashes, endings = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64), np.array([_ending(w) for w in names], np.int32)
    counts = np.bincount(token[np.repeat(learnt, lengths)], minlength=len(names))
    _save(f"{folder}/blocks/{block}", token=token, hashes=hashes, endings=endings, lengths=np.array(lengths, np.int32), learnt=learnt, ids=np.array([d or 0 for d, _ in docs], np.int64), missing=np.array([d is None for d, _ in docs]))
    own = np.flatnonzero((counts > 0) & (counts << 18 >= counts.sum()))
    return _batch([[block] * (len(own) + 1), [None, *hashes[own].view(np.int64).tolist()], [0, *endings[own].tolist()], [int(counts.sum()), *counts[own].tolist()]], SEEN)


def _pairs(f: dict, contexts: Contexts, buckets: int):
    """Distinct pairs of a block in order of bucket, word and context, and the pair of each token."""
    context = contexts.of(f["hashes"], f["endings"])
    before = np.r_[len(f["hashes"]) - 1, f["token"][:-1]]  # an end token precedes each document's first word
    pair, at = np.unique(f["token"].astype(np.int64) << 16 | context[before], return_inverse=True)
    word, context = f["hashes"][pair >> 16], pair & 0xFFFF
    bucket = contexts.bucket(word, context, buckets)
    order = np.lexsort((context, word, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return bucket[order], word[order], context[order].astype(np.uint16), rank[at]


def score(docs: DataFrame, modulus: int = 7, held: int = 2, report: dict | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity of every whole text.

    ``report`` gets the folder of the seatings, the contexts and the totals of the averaged sweeps.
    """
    spark, folder = docs.sparkSession, new_path(docs.sparkSession, "model")

    def split(batches):
        from pyspark import TaskContext

        task, n, tokens, held_docs = TaskContext.get().partitionId(), 0, 0, []
        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                held_docs.append((d, t))
                tokens += len(t) // 6 + 1
                if tokens > BLOCK_TOKENS:
                    yield _block(held_docs, folder, (task << 24) + n, modulus, held)
                    n, tokens, held_docs = n + 1, 0, []
        if held_docs:
            yield _block(held_docs, folder, (task << 24) + n, modulus, held)

    seen = staged(id_and_text(docs).mapInArrow(split, SEEN), "words")
    n_blocks, tokens = seen.where("word is null").agg(F.count("*"), F.sum("n")).first()
    buckets = max(1, -(-(tokens or 0) // BUCKET_TOKENS))
    frequent = seen.where("word is not null").groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("n")).where(F.col("n") * CONTEXTS >= (tokens or 0))
    contexts = Contexts([tuple(r) for r in frequent.collect()] if tokens else [], tokens or 0)  # at most CONTEXTS rows

    def send(batches):
        for b in batches:
            for block in b.column("block").to_pylist():
                f = _load(f"{folder}/blocks/{block}")
                bucket, word, context, at = _pairs(f, contexts, buckets)
                counts = np.bincount(at[np.repeat(f["learnt"], f["lengths"])], minlength=len(word)).astype(np.uint32)
                cuts = np.flatnonzero(np.r_[True, np.diff(bucket) != 0])
                rows = []
                for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
                    new = np.flatnonzero(np.r_[True, word[a + 1 : z] != word[a : z - 1]])
                    rows.append((int(bucket[a]), block, _squeeze(word[a:z][new]), _squeeze(np.diff(np.r_[new, z - a]).astype(np.uint32)), _squeeze(context[a:z]), _squeeze(counts[a:z])))
                yield _batch(zip(*rows), PACK)

    def totals(path: str, rows) -> pa.RecordBatch:
        rows = list(rows)
        return _batch([[path] * len(rows), *zip(*rows)], TOTAL)

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        name = f"{folder}/buckets/{t.column('bucket')[0].as_py()}"
        read = {c: [_unsqueeze(x, k) for x in t.column(c).to_pylist()] for c, k in (("words", "<u8"), ("runs", "<u4"), ("contexts", "<u2"), ("counts", "<u4"))}
        word = np.concatenate([np.repeat(w, r) for w, r in zip(read["words"], read["runs"])])
        context, sizes = np.concatenate(read["contexts"]), np.array([len(x) for x in read["contexts"]], np.int64)
        order = np.lexsort((context, contexts.parent[context], word))
        w, k = word[order], context[order]
        new = np.r_[True, (w[1:] != w[:-1]) | (k[1:] != k[:-1])]
        of = np.empty(len(order), np.int32)
        of[order] = np.cumsum(new) - 1
        count = np.bincount(of, np.concatenate(read["counts"]), int(new.sum())).astype(np.int64)
        _save(name, word=w[new], context=k[new], count=count, of=of, sizes=sizes, blocks=t.column("block").to_numpy())
        own = Bucket(w[new], k[new], count, contexts)
        return pa.Table.from_batches([totals(name, own.totals(own.minimal()))])

    def seating(path: str, turn: int) -> list[np.ndarray]:
        f = _load(path.replace("/buckets/", f"/seats/{turn}/"))
        return [f[f"t{k}"].astype(np.float64) for k in range(3)]

    def resit(total: Totals, turn: int):
        def run(batches):
            for b in batches:
                for path in b.column("path").to_pylist():
                    f = _load(path)
                    own = Bucket(f["word"], f["context"], f["count"], contexts)
                    rng = np.random.default_rng([zlib.crc32(path.rpartition("/")[2].encode()), turn])
                    tables = own.sweep(seating(path, turn - 1) if turn else own.minimal(), total, rng)
                    _save(path.replace("/buckets/", f"/seats/{turn}/"), **{f"t{k}": tables[k].astype(np.uint32) for k in range(3)})
                    yield totals(path, own.totals(tables))

        return run

    def answer(sampled: list[tuple[int, Totals]]):
        def run(batches):
            for b in batches:
                for path in b.column("path").to_pylist():
                    f = _load(path)
                    own = Bucket(f["word"], f["context"], f["count"], contexts)
                    p = sum(own.predict(seating(path, turn), total)[2] for turn, total in sampled) / len(sampled)
                    logs, c = np.log10(p)[f["of"]].astype("<f4"), own.counts(sampled[-1][1])[own.of_word][f["of"]].astype("<i8")
                    ends, bucket = np.cumsum(f["sizes"]), int(path.rpartition("/")[2])
                    spans = [slice(e - s, e) for e, s in zip(ends.tolist(), f["sizes"].tolist())]
                    for i in range(0, len(spans), 64):
                        part = spans[i : i + 64]
                        yield _batch([f["blocks"][i : i + 64], [bucket] * len(part), [_squeeze(logs[s]) for s in part], [_squeeze(c[s]) for s in part]], ANSWER)

        return run

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def finish(total: Totals):
        def run(t: pa.Table) -> pa.Table:
            f = _load(f"{folder}/blocks/{t.column('block')[0].as_py()}")
            bucket, _, _, at = _pairs(f, contexts, buckets)
            p, c = np.zeros(len(bucket)), np.zeros(len(bucket))
            for b, logs, counts in zip(*[t.column(x).to_pylist() for x in ("bucket", "logs", "counts")]):
                a, z = np.searchsorted(bucket, [b, b + 1])
                p[a:z], c[a:z] = _unsqueeze(logs, "<f4"), _unsqueeze(counts, "<i8")
            base = np.log10((c + 1) / (total.n + total.v + 1))
            starts = np.r_[0, np.cumsum(f["lengths"])[:-1]]
            sums = [np.add.reduceat(x[at], starts) for x in ((c > 0).astype(np.float64), base, p)]
            n = len(starts)
            return pa.table(
                [pa.array(f["ids"], mask=f["missing"]), pa.array(~f["learnt"]), pa.array(f["lengths"].astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(np.full(n, total.n, np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                names=[x.split()[0] for x in out.split(", ")],
            )

        return run

    blocks = seen.where("word is null").select("block").repartition(max(1, n_blocks))
    files = staged(blocks.mapInArrow(send, PACK).groupBy("bucket").applyInArrow(build, TOTAL), "totals")
    total, sampled = _gather(files, contexts, 0), []
    paths = files.where("level = -1").select("path").repartition(buckets)
    for turn in range(BURN + SAMPLES):
        total = _gather(paths.mapInArrow(resit(total, turn), TOTAL), contexts, turn + 1)
        if turn >= BURN:
            sampled.append((turn, total))
    if report is not None:
        report |= {"folder": folder, "contexts": contexts, "sampled": sampled, "buckets": buckets}
    scores = paths.mapInArrow(answer(sampled), ANSWER).groupBy("block").applyInArrow(finish(total), out)
    return scores.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
