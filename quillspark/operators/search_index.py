"""Indexes as partitioned tables: inverted lists of vectors, and postings of terms.

A search reads the partitions that its query names, which shows in the plan as
partition filters, and gives the rows that a scan of everything would give where
it is asked to be exact.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.predicates import all_of, current
from .listing import page
from .manifests import Log
from .vectors import cosine

#: Inverted lists of the vector index, and the constants of keyword ranking.
LISTS, K1, B = 128, 1.2, 0.75
#: Vectors that the centres of the lists are fitted on at most, for each list; rows of a file; partitions of the postings; documents of a block.
FIT, FILE_ROWS, BUCKETS, BLOCK_DOCS = 256, 200_000, 64, 4096
#: Rows of a part of a list, and queries of a block, that meet in one group.
PART, ASKED = 16_384, 4096
#: Bytes of words of a block of documents.
BLOCK_BYTES = 8 << 20


class VectorLists:
    """Vectors dealt to the lists of their nearest centres by cosine, a partition a list."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.meta = Log(spark, path).read()
        self.centres = np.array(self.meta["centres"], float).reshape(-1, self.meta["dim"])

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int = LISTS, column: str = "embedding", key: str = "vec_id") -> "VectorLists":
        """Index every row.  Centres are fitted on at most FIT x ``lists`` of them, chosen by a hash of their key; zero
        vectors, and those of another size than most, lie in list -1, as no query scores them."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = vectors.sparkSession
        sizes = vectors.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("dim")).agg(F.count("*").alias("n"))
        most = sizes.orderBy(F.desc("n"), "dim").first()
        dim, n = (most["dim"], most["n"]) if most else (0, 0)
        numbers = F.col(column).cast("array<double>")
        whole = (F.size(column) == dim) & ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(numbers, lambda x: x != 0)
        rows = vectors.withColumn("_whole", F.coalesce(whole, F.lit(False)))
        usable = rows.where("_whole").withColumn("_v", array_to_vector(numbers))
        chosen = usable.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(min(1.0, FIT * lists / max(n, 1)) * (1 << 30)))
        log = Log(spark, path)
        if not chosen.take(1):
            chosen = usable
        if usable.take(1):
            model = KMeans(k=lists, distanceMeasure="cosine", featuresCol="_v", predictionCol="list", seed=1, maxIter=10).fit(chosen.select("_v"))
            dealt = model.transform(usable).drop("_v").unionByName(rows.where("not _whole").withColumn("list", F.lit(-1)))
            centres = [c.tolist() for c in model.clusterCenters()]
        else:
            dealt, centres = rows.withColumn("list", F.lit(-1)), []
        folder = log.folder("lists")
        # a list of more rows than a file should have is dealt to several tasks
        parts = F.lit(max(1, -(-int(n) // (FILE_ROWS * max(1, len(centres))))))
        dealt = dealt.drop("_whole").repartition("list", F.pmod(F.xxhash64(key), parts))
        dealt.write.partitionBy("list").parquet(f"{path}/{folder}")
        log.commit(log.read() | {"folder": folder, "dim": dim, "centres": centres, "column": column, "key": key, "schema": vectors.schema.json()})
        return cls(spark, path)

    def rows(self) -> DataFrame:
        from pyspark.sql.types import IntegerType, StructType

        schema = StructType.fromJson(json.loads(self.meta["schema"])).add("list", IntegerType())
        return self.spark.read.schema(schema).parquet(f"{self.path}/{self.meta['folder']}")

    def nearest_lists(self, query: list[float], probes: int) -> list[int]:
        return _nearest(self.centres, np.array(query, float), probes) if len(query) == self.meta["dim"] else []

    def top_k(self, query: list[float], k: int, probes: int, where: Column | None = None) -> DataFrame:
        """The k nearest in the ``probes`` nearest lists under ``where``, as ``vectors.top_k`` gives them; with all lists exactly those."""
        column, key = self.meta["column"], self.meta["key"]
        rows = self.rows().where(F.col("list").isin(self.nearest_lists(query, probes)))
        rows = rows.where(all_of(current(rows), where)).withColumn("score", cosine(F.col(column), query)).where("score is not null")
        return page(rows.drop(column, "list"), [F.desc("score"), F.asc(key)], 1, k)

    def top_k_of_each(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query, key, score, place) of the k nearest of each query (query, q), ties to the lesser key.

        A list is dealt into parts of about PART rows and its queries into blocks of about ASKED; each part meets each block
        as two matrices, which leave k rows a query.  Pairs are never rows, and no group is larger than a part and a block.
        A query that is null, zero, of another size or holds a null or non-finite component is near to nothing.
        """
        column, key, dim, centres = self.meta["column"], self.meta["key"], self.meta["dim"], self.centres
        kinds = dict(self.rows().dtypes)
        q = F.col("q").cast("array<double>")
        sound = (F.size(q) == dim) & F.forall(q, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

        def near(batches):
            for batch in batches:
                found = [_nearest(centres, np.array(v), probes) for v in batch.column("q").to_pylist()]
                own = batch.take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([n for f in found for n in f], pa.int32())], ["query", "q", "list"])

        asked = queries.select("query", q.alias("q")).where(sound).mapInArrow(near, f"query {dict(queries.dtypes)['query']}, q array<double>, list int")
        sizes = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most a row per list
        held = {r["list"]: r["n"] for r in self.rows().where(F.col("list").isin(list(sizes))).groupBy("list").agg(F.count("*").alias("n")).collect()}
        many = self.spark.createDataFrame([(i, -(-n // PART), -(-sizes[i] // ASKED)) for i, n in held.items()], "list int, parts int, blocks int")
        deal = lambda of, n: F.pmod(F.xxhash64(*of), F.col(n)).cast("int")
        all_of_them = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = self.rows().select("list", F.col(key).alias("key"), F.col(column).alias("v")).join(F.broadcast(many), "list")
        rows = rows.select("list", deal(["key", "v"], "parts").alias("part"), all_of_them("blocks").alias("block"), "key", "v")
        asked = asked.join(F.broadcast(many), "list").select("list", all_of_them("parts").alias("part"), deal(["query"], "blocks").alias("block"), "query", "q")

        def look(asked: pa.Table, rows: pa.Table) -> pa.Table:
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("key", "ascending")], null_placement="at_start"))
            at, of, score = _k_nearest(_matrix(asked.column("q"), dim), _matrix(rows.column("v"), dim), k)
            return pa.table({"query": asked.column("query").take(pa.array(at)), key: rows.column("key").take(pa.array(of)), "score": score})

        by = ["list", "part", "block"]
        met = asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(look, f"query {dict(queries.dtypes)['query']}, {key} {kinds[key]}, score double")
        place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc(key))
        return met.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def _nearest(centres: np.ndarray, q: np.ndarray, probes: int) -> list[int]:
    if not q.any():
        return []
    norms = np.sqrt((centres**2).sum(1)) * np.sqrt(q @ q)
    return np.argsort(-(centres @ q) / np.where(norms > 0, norms, 1), kind="stable")[:probes].tolist()


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of ``dim`` components as rows in double precision, scaled by powers of two, which changes no cosine."""
    c = column.combine_chunks()
    x = c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def _k_nearest(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, cosine) of the k nearest rows of each row of ``q``, ties to the first rows.

    A matrix product, whose sums depend on how it is cut, only finds the rows that may be among them; their cosines are
    summed in the order of the components, so equal vectors have equal ones.
    """
    found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    qq, xx = (np.sqrt(_dots(v, v)) for v in (q, x))
    qu, xu = q / qq[:, None], x / xx[:, None]
    for s in range(0, len(q) if len(x) and k > 0 else 0, 128):
        sims = qu[s : s + 128] @ xu.T
        least = np.partition(sims, len(x) - k, axis=1)[:, len(x) - k] - 1e-9 if len(x) > k else np.full(len(sims), -2.0)
        qi, xi = np.nonzero(sims >= least[:, None])
        score = np.concatenate([_dots(q[s + qi[c : c + 65536]], x[xi[c : c + 65536]]) for c in range(0, len(qi), 65536)])
        score = score / (xx[xi] * qq[s + qi])
        order = np.lexsort((xi, -score, qi))
        starts = np.searchsorted(qi, np.arange(len(sims)))
        best = order[np.arange(len(order)) - starts[qi[order]] < k]
        found.append((s + qi[best], xi[best], score[best]))
    return tuple(np.concatenate(f) for f in zip(*found))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


_HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
_SCRIPTS = re.compile("([\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+)|[^\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+")


def terms(text: Column) -> Column:
    """Lower-case words; of runs of Chinese characters the pairs of neighbours, or the only one."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"[{_HAN}]+|[\p{{L}}\p{{N}}&&[^{_HAN}]]+"), F.lit(0))
    pairs = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))
    return F.flatten(F.transform(found, lambda x: F.when(x.rlike(f"^[{_HAN}]{{2,}}"), pairs(x)).otherwise(F.array(x))))


def _runs(text: Column) -> Column:
    """What ``terms`` finds, before Chinese characters are told from others; several times as fast."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}\p{{N}}{_HAN}]+"), F.lit(0))


def _terms_of_run(run: str) -> list[str]:
    parts = [m.group() for m in _SCRIPTS.finditer(run)]
    return [x for p in parts for x in ([p[i : i + 2] for i in range(len(p) - 1)] if len(p) > 1 and _SCRIPTS.match(p).group(1) else [p])]


def _inverted(batches: Iterator[pa.RecordBatch], most_docs: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Of rows (key, runs) the documents of each term, a block at a time, under a number that no other block has; a row
    without a term has the block's numbers of documents and words."""
    number, waiting, n, size = TaskContext.get().partitionId() << 32, [], 0, 0
    for batch in batches:
        ends = np.r_[0, np.cumsum(pc.list_value_length(batch.column("w")).to_numpy())]
        lengths = np.r_[0, np.cumsum(pc.binary_length(batch.column("w").flatten()).to_numpy())]
        at = 0
        for i, more in enumerate(np.diff(lengths[ends]).tolist()):
            if n and (n == most_docs or size + more > most_bytes):
                yield from _block(pa.Table.from_batches([*waiting, batch.slice(at, i - at)]), number)
                number, waiting, n, size, at = number + 1, [], 0, 0, i
            n, size = n + 1, size + more
        waiting.append(batch.slice(at))
    if n:
        yield from _block(pa.Table.from_batches(waiting), number)


def _block(rows: pa.Table, block: int) -> Iterator[pa.RecordBatch]:
    keys, runs = (rows.column(c).combine_chunks() for c in ("key", "w"))
    coded = runs.flatten().dictionary_encode()
    own = np.repeat(np.arange(len(runs)), pc.list_value_length(runs).to_numpy())
    # the terms of run i are numbers[first[i]:first[i + 1]]
    han = pc.match_substring_regex(coded.dictionary, f"[{_HAN}]").to_pylist()
    names = [_terms_of_run(x) if h else [x] for x, h in zip(coded.dictionary.to_pylist(), han)]
    named = pa.array([x for own_ in names for x in own_], pa.string()).dictionary_encode()
    numbers, times = named.indices.to_numpy().astype(np.int64), np.array([len(x) for x in names], np.int64)
    first, codes = np.cumsum(times) - times, coded.indices.to_numpy()
    each = times[codes]
    place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    words, own = numbers[np.repeat(first[codes], each) + place], np.repeat(own, each)
    n = np.bincount(own, minlength=len(runs))
    pairs, tf = np.unique(words * len(runs) + own, return_counts=True)
    term, doc = pairs // len(runs), pairs % len(runs)
    cuts = np.r_[np.flatnonzero(np.r_[True, term[1:] != term[:-1]]), len(term)] if len(term) else np.zeros(1, int)
    docs = pa.StructArray.from_arrays([keys.take(pa.array(doc)), *[pa.array(x, pa.int32()) for x in (n[doc], tf, doc)]], ["key", "n", "tf", "at"])
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), docs)
    held = len(lists)
    out = pa.table({"term": named.dictionary.take(pa.array(term[cuts[:-1]])), "block": np.full(held, block), "n_docs": np.diff(cuts), "n_words": np.zeros(held, np.int64), "docs": lists})
    sums = pa.table({"term": pa.nulls(1, pa.string()), "block": [block], "n_docs": [len(runs)], "n_words": [int(n.sum())], "docs": pa.nulls(1, lists.type)})
    yield from pa.concat_tables([out, sums]).to_batches(8192)


class Postings:
    """Terms with their documents, partitioned by a hash of the term; a row for each term and block of documents.

    A row has the documents of the block that hold the term, with counts and
    lengths, and the largest weight among them.  A search first reads the rows'
    heads alone and bounds what each block can score.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.meta = spark, path, Log(spark, path).read()

    @classmethod
    def build(cls, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> "Postings":
        """Index every row: texts are read once, a block is made of neighbouring rows where they lie, and what is shuffled
        is a row per term and block.  Repeated keys are documents of their own."""
        spark, log = docs.sparkSession, Log(docs.sparkSession, path)
        kind, sizes = dict(docs.dtypes)[key], (BLOCK_DOCS, BLOCK_BYTES)
        words = docs.select(F.col(key).alias("key"), _runs(F.coalesce(F.col(text), F.lit(""))).alias("w"))
        made = words.mapInArrow(lambda batches: _inverted(batches, *sizes), f"term string, block long, n_docs long, n_words long, docs array<struct<key:{kind},n:int,tf:int,at:int>>")
        held = log.write(made, "counted")
        counted = spark.read.schema(made.schema).parquet(f"{path}/{held}")
        s = counted.where("term is null").agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.sum("n_words").alias("words")).first()
        mean = (s["words"] or 0) / max(s["docs"], 1) or 1.0
        weight = lambda d: d["tf"] * (K1 + 1) / (d["tf"] + K1 * (1 - B + B * d["n"] / F.lit(mean)))
        rows = counted.where("term is not null").withColumn("docs", F.transform("docs", lambda d: F.struct(d["key"].alias("key"), weight(d).alias("w"), d["at"].alias("at"))))
        rows = rows.select("term", "block", "n_docs", F.array_max(F.col("docs")["w"]).alias("most"), "docs", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        folder = log.folder("postings")
        rows.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(max(1, s["blocks"] // 64)))).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/{folder}")
        log.commit(log.read() | {"folder": folder, "docs": s["docs"], "mean": mean, "key": key, "kind": kind})
        log.drop([held])
        return cls(spark, path)

    def _of(self, asked: list[str]) -> DataFrame:
        schema = f"term string, block long, n_docs long, most double, docs array<struct<key:{self.meta['kind']},w:double,at:int>>, bucket int"
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{self.meta['folder']}")
        buckets = self.spark.range(1).select(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(BUCKETS)).cast("int") for t in asked])).first()[0]
        return rows.where(F.col("bucket").isin(sorted(set(buckets))) & F.col("term").isin(asked))

    def terms_of(self, query: str) -> list[str]:
        return sorted(set(self.spark.range(1).select(terms(F.lit(query))).first()[0]))

    def top_k(self, query: str, k: int, first: int = 32) -> DataFrame:
        """The k best by BM25, ties to the lesser key: exactly those of a scan of all texts.

        The ``first`` blocks with the highest bounds are scored; blocks whose
        bound is under the k-th score found there aren't read.
        """
        asked = self.terms_of(query)
        key = self.meta["key"]
        if not asked or k < 1:
            return self.spark.createDataFrame([], f"{key} {self.meta['kind']}, score double")
        rows = self._of(asked)
        df = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n_docs").alias("n")).collect()}  # a row per term asked
        idf = F.lit(0.0)
        for t, n in df.items():
            idf = F.when(F.col("term") == t, float(np.log(1 + (self.meta["docs"] - n + 0.5) / (n + 0.5)))).otherwise(idf)
        bounds = rows.select("block", (idf * F.col("most")).alias("x")).groupBy("block").agg(F.sum("x").alias("bound"))
        best = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(first).collect()]

        def scored(part: DataFrame) -> DataFrame:
            each = part.select("block", idf.alias("idf"), F.explode("docs").alias("d"))
            return each.groupBy("block", "d.at", F.col("d.key").alias(key)).agg(F.sum(F.col("idf") * F.col("d.w")).alias("score")).select(key, "score")

        found = [r["score"] for r in page(scored(rows.where(F.col("block").isin(best))), [F.desc("score"), F.asc(key)], 1, k).collect()]
        if len(found) == k:
            # sums in another order may differ in their last digits
            reach = bounds.where((F.col("bound") >= found[-1] - 1e-9) & ~F.col("block").isin(best)).select("block")
            rows = rows.where(F.col("block").isin(best)).unionByName(rows.join(F.broadcast(reach) if self.meta["docs"] < BLOCK_DOCS * 100_000 else reach, "block", "left_semi").select(rows.columns))
        return page(scored(rows), [F.desc("score"), F.asc(key)], 1, k)
