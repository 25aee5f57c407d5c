"""Operator 10: near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors are one node with a multiplicity.
2. Centres are found on a bounded sample (spherical k-means); every node lives in
   the shards of its two nearest centres and visits a few more.
3. Each shard builds a pruned graph over its residents: of the nearest
   candidates, one is kept unless a kept one is nearer to it by the factor ALPHA
   than the node is.  The adjacency lists of a node from its shards are united.
4. Each shard searches every node that lives in or visits it: greedy search from
   the shard's medoid with a beam, then expansion over everything within range.
   Found pairs are verified in double precision.  A pair counts in the shard
   that is the found node's first home, so no pair counts twice; shards return
   counts and a spanning forest, never all pairs of a group.  A shard with more
   residents than PART is several parts with a graph each, dealt by a hash, and
   its visitors go to all of them, so a dense group doesn't sit in one task.
5. Audit: for a sample of nodes, links are counted by brute force over all rows.
   Recall is averaged over nodes within strata of link counts, so large groups
   don't hide single pairs, and the sample grows from AUDIT to at most
   MOST_AUDIT nodes until each stratum has ENOUGH of them.  Beside that, probes
   made from sampled nodes, at a cosine of just over the threshold in random
   directions, must find the node they were made from, so the audit says
   something where no sampled node has a link.  While the worst of these shares
   is under TARGET, the search is run again with twice the visits, up to all
   shards; if that isn't enough, shards compare all their visitors and residents.

Defined results: rows whose vector is null, empty, zero or holds a null or
non-finite component, or whose vec_id is null, link with nothing (their
component is their own id, a null id's is null and isn't kept); vectors link
only with those of as many components; repeated rows of one vec_id count as
other vectors each; other columns, labels included, are ignored; an empty table
gives an empty result.  A cosine of exactly the threshold links; equal nearness
in a search goes by position, which decides the order of visits, not the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, staged

SAMPLE, SHARD, HOMES, VISITS = 32_768, 512, 2, 6
CANDIDATES, DEGREE, ALPHA, BEAM, SLACK = 48, 20, 1.2, 32, 0.05
AUDIT, MOST_AUDIT, ENOUGH, TARGET = 512, 4096, 50, 0.97
#: Residents of a part of a shard, and how far over the threshold probes are.
PART, CLOSE = 4096, 0.005
#: Least link counts of the audit's strata.
STRATA = (1, 2, 16)


def unit(v: np.ndarray) -> np.ndarray:
    """Unit rows in double precision; scaling first keeps squares finite."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def rows_of(column) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if len(c) else np.zeros((0, 1))


def centres_of(x: np.ndarray, k: int, turns: int = 8) -> np.ndarray:
    """Spherical k-means from rows spread evenly over the sample."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(turns):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total**2).sum(1, keepdims=True))
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def pruned_graph(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency of each row: its robust-pruned candidates, and backward links while there is room."""
    n = len(x)
    width = min(CANDIDATES, n - 1)
    if width < 1:
        return [np.zeros(0, np.int64)] * n
    out: list[list[int]] = [[] for _ in range(n)]
    for s in range(0, n, 256):
        sims = x[s : s + 256] @ x.T
        rows = np.arange(len(sims))
        sims[rows, s + rows] = -2
        near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        away = 1 - np.take_along_axis(sims, near, 1)
        vectors, open_ = x[near], np.ones(near.shape, bool)
        for _ in range(min(DEGREE, width)):
            pick = open_.argmax(1)
            live = np.flatnonzero(open_[rows, pick])
            if not len(live):
                break
            for r in live:
                out[s + r].append(int(near[r, pick[r]]))
            between = 1 - np.einsum("rcd,rd->rc", vectors[live], vectors[live, pick[live]])
            keep = between * ALPHA > away[live]
            keep[np.arange(len(live)), pick[live]] = False
            open_[live] &= keep
    back: list[list[int]] = [[] for _ in range(n)]
    for i, near in enumerate(out):
        for j in near:
            if len(back[j]) < DEGREE:
                back[j].append(i)
    return [np.unique(a + b) for a, b in zip(out, back)]


def range_search(x: np.ndarray, links: np.ndarray, both: list[np.ndarray], start: np.ndarray, q: np.ndarray, least: float, own: np.ndarray):
    """(query, row) pairs with a cosine of ``least`` or more, found on the graph ``links`` (rows padded with -1);
    ``both`` has the links of each row in either direction, for the expansion.

    ``start`` are the entry rows of all queries, ``own`` each query's own row or -1.
    """
    n, m = len(x), len(q)
    pad = x.shape[0]
    table = np.where(links < 0, pad, links)
    seen = np.zeros((m, n + 1), bool)
    seen[:, pad] = True
    all_rows = np.arange(m)
    hits_q, hits_x = [], []

    def note(i, j, s):
        near = s >= least
        hits_q.append(i[near])
        hits_x.append(j[near])

    beam = np.full((m, BEAM), pad)
    score = np.full((m, BEAM), -2.0)
    done = np.ones((m, BEAM), bool)
    entry = np.concatenate([np.repeat(start[None], m, 0), np.where(own < 0, pad, own)[:, None]], axis=1)
    fresh = entry
    while True:
        fresh = np.where(np.take_along_axis(seen, fresh, 1), pad, fresh)
        fresh = np.sort(fresh, axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = pad
        i, j = np.nonzero(fresh < pad)
        if len(i):
            rows = fresh[i, j]
            seen[i, rows] = True
            s = np.einsum("nd,nd->n", q[i], x[rows])
            note(i, rows, s)
            sims = np.full(fresh.shape, -2.0)
            sims[i, j] = s
            b, s2, d = np.concatenate([beam, fresh], 1), np.concatenate([score, sims], 1), np.concatenate([done, fresh == pad], 1)
            best = np.argpartition(-s2, BEAM - 1, axis=1)[:, :BEAM]
            beam, score, done = (np.take_along_axis(a, best, 1) for a in (b, s2, d))
        left = np.where(done, -3.0, score)
        pick = left.argmax(1)
        go = left[all_rows, pick] > -2
        if not go.any():
            break
        done[all_rows[go], pick[go]] = True
        fresh = np.full((m, table.shape[1]), pad)
        fresh[go] = table[beam[all_rows[go], pick[go]]]
    # expand everything near enough, however much there is
    for k in np.unique(np.concatenate(hits_q)) if hits_q else []:
        front = np.flatnonzero(seen[k, :n])
        front = front[x[front] @ q[k] >= least - SLACK]
        while len(front):
            nxt = np.unique(np.concatenate([both[f] for f in front]))
            nxt = nxt[~seen[k, nxt]]
            seen[k, nxt] = True
            s = x[nxt] @ q[k]
            note(np.full(len(nxt), k), nxt, s)
            front = nxt[s >= least - SLACK]
    return np.concatenate(hits_q), np.concatenate(hits_x)


NODE = "vec long, v array<double>, copies long, probe boolean"


def _nodes(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors: the smallest vec_id, the vector, and how many rows have it."""
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.where(sound).groupBy("v").agg(F.min("id").alias("vec"), F.count("*").alias("copies")).select("vec", "v", "copies", F.lit(False).alias("probe"))


def _probes(nodes: DataFrame, least: float, n: int) -> DataFrame:
    """About AUDIT nodes turned in a random direction until their cosine with themselves is just over ``least``."""
    near = min(least + CLOSE, 1.0)

    def turn(batches):
        for b in batches:
            out = []
            for i, v in zip(b.column("vec").to_pylist(), b.column("v").to_pylist()):
                x = unit(np.array([v]))[0]
                r = np.random.default_rng([i & (2**63 - 1), 1]).standard_normal(len(x))
                r -= (r @ x) * x
                size = np.sqrt(r @ r)
                out.append((near * x + np.sqrt(1 - near * near) * r / size if size > 1e-9 else x).tolist())
            yield pa.RecordBatch.from_arrays([b.column("vec"), pa.array(out, pa.list_(pa.float64())), b.column("copies"), pa.array([True] * b.num_rows)], ["vec", "v", "copies", "probe"])

    return nodes.where(F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(1 << 30)) < int(min(1.0, AUDIT / max(n, 1)) * (1 << 30))).mapInArrow(turn, NODE)


def _search(nodes: DataFrame, merged: DataFrame, probes: DataFrame, deal, least: float, all_pairs: bool) -> DataFrame:
    """One row per (shard, node): links counted there and the node's place in the shard's forest; of probes whether they found their node."""

    def look(t: pa.Table) -> pa.Table:
        from .simhash import forest

        t = t.sort_by([("vec", "ascending"), ("probe", "ascending")])
        ids, x, copies, rank = t.column("vec").to_numpy(), unit(rows_of(t.column("v"))), t.column("copies").to_numpy(), t.column("rank").to_numpy()
        probe, home = t.column("probe").to_numpy(), t.column("home").to_numpy()
        live = np.flatnonzero(home)
        if not len(live):
            return pa.table({"vec": ids[:0], "probe": probe[:0], "n": copies[:0], "root": ids[:0]})
        r = x[live]
        if all_pairs:
            search = lambda s: np.nonzero(x[s : s + 256] @ r.T >= least)
        else:
            place = {int(i): k for k, i in enumerate(ids[live])}
            lists = [[place[j] for j in near if j in place] for near in t.column("near").take(pa.array(live)).to_pylist()]
            width = max(1, max(map(len, lists)))
            links = np.array([a + [-1] * (width - len(a)) for a in lists], np.int64)
            both = [set(a) for a in lists]
            for i, a in enumerate(lists):
                for j in a:
                    both[j].add(i)
            both = [np.array(sorted(a), np.int64) for a in both]
            start = np.array([(r @ r.mean(0)).argmax()])
            own = np.full(len(ids), -1)
            own[live] = np.arange(len(live))
            search = lambda s: range_search(r, links, both, start, x[s : s + 256], least, own[s : s + 256])
        count, edges = np.zeros(len(ids), np.int64), []
        for s in range(0, len(ids), 256):
            qi, xi = search(s)
            qi, xi = qi + s, live[xi]
            first = (rank[xi] == 0) & (qi != xi) & ~probe[qi]
            np.add.at(count, qi[first], copies[xi[first]])
            count[qi[probe[qi] & (ids[qi] == ids[xi])]] = 1
            other = (qi != xi) & ~probe[qi]
            edges.append((qi[other], xi[other]))
        label = forest(len(ids), edges)
        return pa.table({"vec": ids, "probe": probe, "n": count, "root": ids[label]})

    asked = nodes.join(merged, "vec").unionByName(probes.withColumn("near", F.array().cast("array<long>")))
    dealt = asked.mapInArrow(deal, f"shard long, rank int, home boolean, near array<long>, {NODE}")
    return staged(dealt.groupBy("shard").applyInArrow(look, "vec long, probe boolean, n long, root long"), "found")


def _recall(nodes: DataFrame, found: DataFrame, least: float, n: int) -> float:
    """The worst of the strata's mean shares of a node's true links that the search counted, and of the share of probes that
    found their node; 1 without any node."""
    size = AUDIT
    probes = found.where("probe").groupBy("vec").agg(F.max("n").alias("n")).agg(F.avg("n")).first()[0]
    found = found.where("not probe")
    while True:
        r = _audited(nodes, found, least, n, size)
        strata = [r[(r[:, 0] >= a) & (r[:, 0] < b), 1] for a, b in zip(STRATA, (*STRATA[1:], np.inf))]
        if size >= min(n, MOST_AUDIT) or all(len(x) >= ENOUGH for x in strata):
            return min([float(x.mean()) for x in strata if len(x)] + ([] if probes is None else [float(probes)]), default=1.0)
        size *= 8


def _audited(nodes: DataFrame, found: DataFrame, least: float, n: int, size: int) -> np.ndarray:
    """Rows of (true links, share of them counted) of about ``size`` nodes that have links."""
    sample = nodes.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int(min(1.0, size / max(n, 1)) * (1 << 30))).limit(2 * size).toArrow()
    if not sample.num_rows:
        return np.zeros((0, 2))
    ids = sample.column("vec").to_numpy()
    lists = [np.array(v) for v in sample.column("v").to_pylist()]

    def count(batches):
        total = np.zeros(len(ids), np.int64)
        groups = {d: np.flatnonzero([len(v) == d for v in lists]) for d in {len(v) for v in lists}}
        q = {d: unit(np.array([lists[i] for i in g])) for d, g in groups.items()}
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                by = part.column("v").value_lengths().to_numpy()
                for d, g in groups.items():
                    at = np.flatnonzero(by == d)
                    if len(at):
                        x, c = unit(rows_of(part.column("v").take(pa.array(at)))), part.column("copies").to_numpy()[at]
                        same = ids[g][:, None] == part.column("vec").to_numpy()[at][None]
                        total[g] += (((q[d] @ x.T >= least) & ~same) * c).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["vec", "true"])

    true = nodes.mapInArrow(count, "vec long, true long").groupBy("vec").agg(F.sum("true").alias("true"))
    got = found.groupBy("vec").agg(F.sum("n").alias("n"))
    rows = true.where(F.col("true") > 0).join(got, "vec", "left").select("true", (F.least("true", F.coalesce("n", F.lit(0))) / F.col("true")).alias("share")).collect()  # at most the sample
    return np.array([tuple(r) for r in rows], float).reshape(-1, 2)


def near_duplicates(vectors: DataFrame, least: float = 0.9, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; ``report`` gets the audited recall."""
    nodes = staged(_nodes(vectors), "nodes")
    n = nodes.count()
    sample = nodes.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))).orderBy("vec").limit(2 * SAMPLE).select("v").toArrow().column("v")
    lists = [np.array(v) for v in sample.to_pylist()]
    centres, base = {}, 0
    for d in sorted({len(v) for v in lists}):
        x = unit(np.array([v for v in lists if len(v) == d]))
        k = max(1, min(len(x) // 8, max(16, round(n * len(x) / len(lists) / SHARD))))
        centres[d] = (base, centres_of(x, k))
        base += k

    def ranked(b, visits: int):
        """(positions, shards by rank) of a batch's rows, for each number of components."""
        by = b.column("v").value_lengths().to_numpy()
        for d in np.unique(by).tolist():
            at = np.flatnonzero(by == d)
            first, c = centres.get(d, (base + d, np.ones((1, d))))
            sims = unit(rows_of(b.column("v").take(pa.array(at)))) @ c.T
            yield at, first + np.argsort(-sims, axis=1, kind="stable")[:, : min(visits, len(c))]

    def count(batches):
        for b in batches:
            shards = np.concatenate([near[:, :HOMES].ravel() for _, near in ranked(b, HOMES)])
            k, c = np.unique(shards, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(c, pa.int64())], ["shard", "n"])

    residents = nodes.mapInArrow(count, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).where(F.col("n") > PART).collect()
    parts = {r["shard"]: -(-r["n"] // PART) for r in residents}  # large shards only, at most all centres

    def dealer(visits: int, near: bool):
        """Rows (part of a shard, rank of the shard for the node, whether it lives there, ...) for the nearest centres."""
        names = [*(["near"] if near else []), "vec", "v", "copies", "probe"]

        def deal(batches):
            for b in batches:
                for at, shards in ranked(b, visits):
                    salt = (b.column("vec").to_numpy()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                    lives = ~b.column("probe").to_numpy(zero_copy_only=False)[at]
                    for rank in range(shards.shape[1]):
                        many = np.array([parts.get(k, 1) for k in shards[:, rank].tolist()])
                        row = np.repeat(np.arange(len(at)), many)
                        part = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                        home = (part == (salt % many.astype(np.uint64)).astype(np.int64)[row]) & lives[row] & (rank < HOMES)
                        if not near:
                            row, part, home = row[home], part[home], home[home]
                        own = b.take(pa.array(at[row]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array((shards[row, rank] << 24) + part, pa.int64()), pa.array(np.full(len(row), rank, np.int32)), pa.array(home), *[own.column(c) for c in names]], ["shard", "rank", "home", *names]
                        )

        return deal

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec")
        ids = t.column("vec").to_numpy()
        near = pruned_graph(unit(rows_of(t.column("v"))))
        return pa.table({"vec": ids, "near": pa.array([ids[a].tolist() for a in near], pa.list_(pa.int64()))})

    built = nodes.mapInArrow(dealer(HOMES, False), f"shard long, rank int, home boolean, {NODE}").groupBy("shard").applyInArrow(build, "vec long, near array<long>")
    merged = staged(built.groupBy("vec").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    visits, most, probes, all_pairs = VISITS, max([len(c) for _, c in centres.values()], default=1), staged(_probes(nodes, least, n), "probes"), False
    while True:
        found = _search(nodes, merged, probes, dealer(visits, True), least, all_pairs)
        recall = _recall(nodes, found, least, n)
        if recall >= TARGET or all_pairs:
            break
        all_pairs = visits >= most
        visits *= 2
    found = found.where("not probe")
    if report is not None:
        report |= {"recall": recall, "visits": visits, "all_pairs": all_pairs}
    linked = components(found.select(F.col("vec").alias("a"), F.col("root").alias("b")))
    count = found.groupBy("vec").agg(F.sum("n").alias("n"))
    named = (
        nodes.join(count, "vec").join(linked, F.col("vec") == F.col("node"), "left").select(F.col("v").alias("of"), (F.col("n") + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec").alias("component"))
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    out = rows.join(named, (F.col("v") == F.col("of")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
