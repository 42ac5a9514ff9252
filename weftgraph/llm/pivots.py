"""Exact top-k inner products by pivot-table elimination.

Vectors become integers. The distances to a table of pivots are computed for each vector, and candidates
are sorted by their nearest pivot, so that neighbours lie together. By the triangle inequality the gap
between d(q, p) and the range of d(x, p) in a group of candidates bounds d(q, x) from below for each pivot
p; the maximum over the pivots, turned into an inner product with the norms, bounds q.x from above. A group
whose bound is below a query's k-th best score so far cannot hold one of its results and is left out; the
others are evaluated, so the result is exact.

Queries are dealt into blocks and candidates into strips; a task holds one query block and reads one strip
row by row, so neither the driver nor a task holds more than a block. A strip gives at most k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import store

#: Pivots, and the vectors they are chosen from (those with the least hash).
PIVOTS, PIVOT_SAMPLE = 24, 2000
#: Most queries of a block, and the blocks that few queries are dealt into; most strips. Blocks times the candidates, and
#: strips times the queries and their results, are what is shuffled.
QUERY_BLOCK, FEW_BLOCKS, STRIPS = 131_072, 8, 8
#: Candidates of a group, candidates evaluated at a time, queries evaluated at a time.
GROUP, CHUNK, BATCH = 256, 4096, 512
KINDS = {1: np.dtype("i1"), 2: np.dtype("<i2"), 8: np.dtype("<f8")}
VECTOR = "vec_id long, v binary, kind byte"


def _encoded(v: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Whole-number vectors as bytes, each in the narrowest of KINDS that holds it, and the kinds."""
    most = np.abs(v)
    most = np.array([most[a:b].max(initial=0) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]) if len(offsets) > 1 else np.zeros(0)
    kinds = np.where(most <= 127, 1, np.where(most <= 32767, 2, 8)).astype(np.int8)
    with np.errstate(invalid="ignore"):
        forms = {k: v.astype(d) for k, d in KINDS.items() if (kinds == k).any()}
    return [forms[int(k)][a:b].tobytes() for k, a, b in zip(kinds, offsets[:-1], offsets[1:], strict=True)], kinds


def _matrix(blobs, kinds) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    lengths = [len(b) // k for b, k in zip(blobs, kinds, strict=True)]
    if blobs and len(set(lengths)) == 1 and len(set(kinds)) == 1:
        return np.frombuffer(b"".join(blobs), KINDS[kinds[0]]).reshape(len(blobs), -1).astype(float)
    out = np.zeros((len(blobs), max(lengths, default=0)))
    for i, b in enumerate(blobs):
        out[i, : lengths[i]] = np.frombuffer(b, KINDS[kinds[i]])
    return out


def _wider(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each next pivot is the sample vector farthest from those chosen."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax((sample**2).sum(1)))]
    least = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and least.max() > 0:
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to the pivots."""
    width = max(x.shape[1], pivots.shape[1])
    x, pivots = _wider(x, width), _wider(pivots, width)
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integers too large for doubles."""
    whole = [int(v) for v in q]
    return np.array([sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in x], object)


class Search:
    """The k best candidates so far of each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int):
        far = distances(queries, pivots)
        order = np.argsort(far.argmin(1), kind="stable")  # queries of one batch have near pivots
        self.ids, self.queries, self.far, self.k, self.pivots = ids[order], queries[order], far[order], k, pivots
        self.norm, self.most = (self.queries**2).sum(1), np.abs(queries).max(initial=0)
        self.score, self.found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.narrow, self.computed = self.queries.astype(np.float32), 0

    def bounds(self, part: slice, low: np.ndarray, high: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """No score of these queries with a candidate of a group is above."""
        lower = np.zeros((part.stop - part.start, len(norm)))
        for p in range(low.shape[1]):
            far = self.far[part, p, None]
            np.maximum(lower, np.maximum(low[None, :, p] - far, far - high[None, :, p]), out=lower)
        # rounding of the square roots must not lift a bound below the true score
        own = self.norm[part, None]
        bound = (own + norm - np.maximum(0, lower - 1e-6 * (1 + lower)) ** 2) / 2 + 1e-6 * (1 + own)
        bound[np.isnan(bound)] = np.inf  # components so large that squares overflow: no bound
        return bound

    def merge(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Pairs (query, score, id) join what is found; the k best of each query stay, ties to the smaller id."""
        at, row = np.unique(query, return_inverse=True)
        k = self.k
        rows = np.r_[np.repeat(np.arange(len(at)), k), row]
        scores, found = np.concatenate([self.score[at].ravel(), score]), np.r_[self.found[at].ravel(), ids]
        if scores.dtype == object:
            order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -scores[i], found[i])), np.int64)
        else:
            order = np.lexsort((found, -scores, rows))
        rows = rows[order]
        kept = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]
        self.score[at], self.found[at] = scores[kept].reshape(-1, k), found[kept].reshape(-1, k)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Meets candidates with all queries; neighbours among them should be near each other."""
        if not len(ids) or not len(self.ids):
            return
        width = max(rows.shape[1], self.queries.shape[1])
        if width > self.queries.shape[1]:
            self.queries, self.narrow = _wider(self.queries, width), _wider(self.narrow, width)
        rows = _wider(rows, width)
        far, start = distances(rows, self.pivots), np.arange(0, len(ids), GROUP)
        low, high = np.minimum.reduceat(far, start), np.maximum.reduceat(far, start)
        norm = np.maximum.reduceat((rows**2).sum(1), start)
        with np.errstate(over="ignore"):
            largest = self.most * np.abs(rows).max(initial=0) * max(width, 1)
        exact = largest < 2.0**53
        if not exact and self.score.dtype != object:  # from now on all scores are Python's integers
            whole = [[int(x) if np.isfinite(x) else x for x in r] for r in self.score]
            self.score = np.array(whole, object).reshape(self.score.shape)
        narrow = rows.astype(np.float32) if largest < 2.0**24 else None
        by_id = np.argsort(ids, kind="stable")
        sorted_ids = ids[by_id]
        for a in range(0, len(self.ids), BATCH):
            part = slice(a, min(a + BATCH, len(self.ids)))
            bound = self.bounds(part, low, high, norm)
            least = lambda: self.score[part, -1].astype(float)[:, None]  # noqa: B023, E731
            own_from, own_to = (np.searchsorted(sorted_ids, self.ids[part], side) for side in ("left", "right"))
            groups = np.argsort(-bound.mean(0), kind="stable")  # the best first: they lift what others must reach
            for g in range(0, len(groups), CHUNK // GROUP):
                some = groups[g : g + CHUNK // GROUP]
                some = some[(bound[:, some] >= least()).any(0)]
                if not len(some):
                    continue
                cols = np.concatenate([np.arange(i * GROUP, min((i + 1) * GROUP, len(ids))) for i in some])
                if not exact:
                    for i in range(part.start, part.stop):
                        other = cols[ids[cols] != self.ids[i]]
                        self.computed += len(other)
                        self.merge(np.full(len(other), i), _scores(self.queries[i], rows[other]), ids[other])
                    continue
                scores = self.narrow[part] @ narrow[cols].T if narrow is not None else self.queries[part] @ rows[cols].T
                self.computed += scores.size
                for i in np.flatnonzero(own_to > own_from):
                    scores[i, np.isin(cols, by_id[own_from[i] : own_to[i]])] = -np.inf
                reach = np.maximum(least(), -1.7e308)  # nor the query's own row
                reach = np.where(reach > -1.7e308, reach, np.finfo(scores.dtype).min)
                if self.score.dtype != object:
                    reach = reach.astype(scores.dtype)
                passed = scores >= reach
                if len(cols) > self.k and np.count_nonzero(passed) > 4 * self.k * len(scores):
                    passed &= scores >= np.partition(scores, len(cols) - self.k, axis=1)[:, len(cols) - self.k, None]
                query, col = np.nonzero(passed)
                if len(query):
                    values = scores[query, col].astype(float)
                    if self.score.dtype == object:
                        values = np.array([int(v) for v in values], object)
                    self.merge(query + a, values, ids[cols[col]])

    def results(self):
        """(query, candidate, score) arrays in pieces; scores outside a long are cut to its range."""
        for a in range(0, len(self.ids), BATCH):
            score, found = self.score[a : a + BATCH], self.found[a : a + BATCH]
            there = score.astype(float) > -np.inf
            query = np.repeat(self.ids[a : a + BATCH], self.k).reshape(there.shape)[there]
            yield query, found[there], [max(-(2**63), min(2**63 - 1, int(s))) for s in score[there]]


def top_k(vectors: DataFrame, k: int = 20, scale: float = 64.0, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all other rows.

    vectors has vec_id and embedding; each component x becomes floor(scale * x), x as double. Queries are
    the rows whose vec_id every divides. Ties go to the smaller vec_id. Rows with a null vec_id or
    vector, or a null or non-finite component, take no part. Missing components of shorter vectors count
    as zero. Rows of equal vec_id are all candidates, none for a query of that id; a repeated query row
    gives its result once. Scores outside a long are cut to its range. Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(fine)

    def whole(batches):
        for batch in batches:
            at = batch.column("v")
            flat, offsets = at.flatten().to_numpy(zero_copy_only=False), at.offsets.to_numpy()
            blobs, kinds = _encoded(np.floor(scale * flat), offsets - offsets[0] if len(offsets) else offsets)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(blobs, pa.binary()), pa.array(kinds, pa.int8())], names=["vec_id", "v", "kind"])

    table = store.save(rows.mapInArrow(whole, VECTOR), store.scratch(spark, "vectors"))
    counts = table.agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q")).first()
    n, q = int(counts["n"] or 0), int(counts["q"] or 0)
    pivots = spark.sparkContext.broadcast(choose_pivots(_sample(table, n), PIVOTS))
    blocks = max(1, -(-q // QUERY_BLOCK), min(FEW_BLOCKS, -(-q // 64)))
    strips = max(1, min(STRIPS, -(-n // CHUNK), -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)))

    def near(batches):
        for batch in batches:
            m = _matrix(batch.column("v").to_pylist(), batch.column("kind").to_pylist())
            at = distances(m, pivots.value).argmin(1) if len(m) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=["vec_id", "v", "kind", "near"])

    placed = lambda i: F.explode(F.transform(F.sequence(F.lit(0), F.lit((strips if i else blocks) - 1)), lambda j: ((F.col("at") * strips + j) if i else (j * strips + F.col("at"))).cast("int"))).alias("cell")
    dealt = lambda parts, *by: F.pmod(F.xxhash64(*by, F.lit(3)), F.lit(parts)).cast("int").alias("at")
    # a task is a query block and a strip; its queries come first
    queries = table.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).select("vec_id", "v", "kind", F.lit(-1).alias("near"), dealt(blocks, "vec_id"))
    candidates = table.mapInArrow(near, VECTOR + ", near int").select("vec_id", "v", "kind", "near", dealt(strips, "vec_id", "v"))
    met = queries.select("vec_id", "v", "kind", "near", placed(True)).unionByName(candidates.select("vec_id", "v", "kind", "near", placed(False)))
    met = met.repartitionById(blocks * strips, F.col("cell")).sortWithinPartitions("near").select("vec_id", "v", "kind", "near")

    def search(batches):
        ids, blobs, kinds, found = [], [], [], None
        for batch in batches:
            first = int(np.count_nonzero(batch.column("near").to_numpy() < 0))
            own, others = batch.slice(0, first), batch.slice(first)
            if first:
                ids.append(own.column("vec_id").to_numpy())
                blobs += own.column("v").to_pylist()
                kinds += own.column("kind").to_pylist()
            if others.num_rows and ids:
                found = found or Search(np.concatenate(ids), _matrix(blobs, kinds), pivots.value, k)
                blobs, kinds = [], []
                found.add(others.column("vec_id").to_numpy(), _matrix(others.column("v").to_pylist(), others.column("kind").to_pylist()))
        for query, candidate, score in found.results() if found else ():
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(candidate, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(store.freed(search), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sample(table: DataFrame, n: int) -> np.ndarray:
    """The PIVOT_SAMPLE different rows of least hash. Only rows below a hash that about twice as many reach are sorted: a task would else send as many as are wanted."""
    share, place = 2 * PIVOT_SAMPLE / max(n, 1), F.xxhash64("vec_id", "v")
    while True:
        near = table if share >= 1 else table.filter(place < int((share - 0.5) * 2**64))
        found = near.distinct().orderBy(place, "vec_id", "v").limit(PIVOT_SAMPLE).collect()
        if len(found) == PIVOT_SAMPLE or share >= 1:
            return _matrix([r["v"] for r in found], [r["kind"] for r in found])
        share *= 4
