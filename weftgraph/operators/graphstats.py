"""Statistics of undirected graphs: degrees, components, clustering, path lengths, walks.

Edges are pairs (a, b). Steps that repeat are written to the shared folder between rounds.
"""

from __future__ import annotations

import collections

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import shared


def undirected(graph: DataFrame) -> DataFrame:
    """Distinct undirected edges of the IRI objects of a triple table; a self-loop stays one edge."""
    iri = graph.filter("o_kind = 'iri'")
    return iri.select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct()


def degrees(edges: DataFrame, count_self_loops: bool = True) -> DataFrame:
    """node, degree; a self-loop adds two (or nothing)."""
    kept = edges if count_self_loops else edges.filter("a <> b")
    ends = kept.select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """node, degree, centrality: the degree over the number of other nodes."""
    d = degrees(edges)
    n = d.agg(F.count("*").alias("n"))
    return d.join(F.broadcast(n)).select("node", "degree", F.round(F.col("degree") / (F.col("n") - 1), 9).alias("centrality"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its least node) by alternating large-star and small-star steps.

    The steps end when every node points to a node that points nowhere; if that takes more than rounds,
    it is an error, never an unfinished result.
    """
    spark = edges.sparkSession
    path = shared.scratch(spark, "graph")
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    now, before = shared.saved(ends.distinct(), f"{path}/start"), None
    for i in range(rounds):
        roles = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = shared.saved(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{path}/large{i}")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = shared.saved(small.filter("u <> v").distinct(), f"{path}/small{i}")
        shared.remove(spark, before or f"{path}/start")
        shared.remove(spark, f"{path}/large{i}")
        shared.release(spark)  # else the shuffle files of all rounds stay
        before = f"{path}/small{i}"
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def named_components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node of edges (a, b), which are strings; also of those with self-loops only.

    The steps move 64-bit hashes of the names, not the names. Whether each hash has one name is checked; if not, the
    names themselves are taken. Edges may repeat.
    """
    spark = edges.sparkSession
    path = shared.scratch(spark, "named")
    edges = shared.saved(edges.select("a", "b").filter("a is not null and b is not null"), f"{path}/edges")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    nodes = shared.saved(ends.groupBy(F.xxhash64("node").alias("id")).agg(F.min("node").alias("node"), F.max("node").alias("other")), f"{path}/nodes")
    shared.release(spark)
    if not nodes.filter("node <> other").isEmpty():
        found = components(edges)
        return found.unionByName(ends.distinct().join(found, "node", "left_anti").withColumn("component", F.col("node")))
    hashed = shared.saved(edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).filter("a <> b").distinct(), f"{path}/hashed")
    shared.remove(spark, f"{path}/edges")
    shared.release(spark)
    found = components(hashed).toDF("id", "root")
    placed = shared.saved(nodes.select("id", "node").join(found, "id", "left").select("node", F.coalesce("root", "id").alias("root")), f"{path}/placed")
    for done in ("hashed", "nodes"):
        shared.remove(spark, f"{path}/{done}")
    shared.release(spark)
    least = placed.groupBy("root").agg(F.min("node").alias("component"))
    return placed.join(least, "root").select("node", "component")


CHUNK_EDGES = 4_000_000  # a task joins so many edges at a time, in arrays
CHUNK_BYTES = 256 << 20  # or names of so many bytes
MERGE_ROWS = 1_000_000  # rows of a task that compares the chunks' results


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, for nodes 0 to n - 1 and edges (u, v)."""
    root = np.arange(n)
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root = up
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return root


def _slices(table: pa.Table, rows: int = 100_000):
    return table.combine_chunks().to_batches(max_chunksize=rows)


def _join_chunks(batches):
    """node, root, lead of the stars of a task, joined chunk by chunk: nodes of one root are connected.

    A root is a number of its own for each component of a chunk, smaller for larger components. Its least node comes
    again, as lead.
    """
    task, made = TaskContext.get().partitionId(), 0

    def joined(chunk):
        nonlocal made
        heads, flat = pa.concat_arrays([b.column(0) for b in chunk]), pa.concat_arrays([b.column(1).flatten() for b in chunk])
        size = np.concatenate([pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False) for b in chunk])
        owner = np.repeat(np.arange(len(heads)), size)
        if flat.null_count or heads.null_count:
            full = flat.is_valid().to_numpy(zero_copy_only=False) & heads.is_valid().to_numpy(zero_copy_only=False)[owner]
            flat, owner = flat.filter(pa.array(full)), owner[full]
        used = np.bincount(owner, minlength=len(heads)) > 0
        if not used.all():
            heads, owner = heads.filter(pa.array(used)), (np.cumsum(used) - 1)[owner]
        known = pa.concat_arrays([heads, flat]).dictionary_encode()
        code, nodes = known.indices.to_numpy(), known.dictionary
        root = _roots(code[owner], code[len(heads) :], len(nodes))
        least, at, count = np.unique(root, return_inverse=True, return_counts=True)
        place = 63 - np.frexp(count.astype(float))[1].astype(np.int64)  # fewer for more nodes
        number = (place << 57) | (task << 35) | (made + np.arange(len(least)))
        made += len(least)
        table = pa.table({"node": nodes, "root": pa.array(number[at])})
        leads = table.group_by("root").aggregate([("node", "min")])
        yield from _slices(table.append_column("lead", pa.array(np.zeros(len(nodes), bool))))
        yield from _slices(pa.table({"node": leads.column("node_min"), "root": leads.column("root"), "lead": pa.array(np.ones(len(leads), bool))}))

    chunk, edges, size = [], 0, 0
    for batch in batches:
        chunk.append(batch)
        edges, size = edges + len(batch.column(1).flatten()), size + batch.nbytes
        if edges >= CHUNK_EDGES or size >= CHUNK_BYTES:
            yield from joined(chunk)
            chunk, edges, size = [], 0, 0
    if chunk:
        yield from joined(chunk)


def _compare_chunks(batches):
    """node and its least root, for all rows (node, root) of a node; and, with other, the roots that a node says are one."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    known = pa.concat_arrays([b.column(0) for b in rows]).dictionary_encode()
    code, nodes = known.indices.to_numpy(), known.dictionary
    root = np.concatenate([b.column(1).to_numpy() for b in rows])
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, code, root)
    yield from _slices(pa.table({"node": nodes, "root": pa.array(least), "other": pa.nulls(len(nodes), pa.int64())}))
    apart = least[code] != root
    if apart.any():
        one, other = np.unique(np.stack([least[code][apart], root[apart]]), axis=1)
        yield from _slices(pa.table({"node": pa.nulls(len(one), nodes.type), "root": pa.array(one), "other": pa.array(other)}))


def linked_components(stars: DataFrame) -> DataFrame:
    """node and component (its least node) of every node of stars (node, near), near being an array of its neighbours.

    Stars may repeat; nulls are no nodes, and a node without neighbours is left out.
    Tasks join what they read in chunks, and only a node with its chunk's root moves to where all rows of the node meet;
    they say which roots are one. Roots are then joined in the same way, few links in one task; where that leaves more than
    half as many links as there were rows, by large-star and small-star steps. Nodes are compared whole, not by hashes.
    """
    spark = stars.sparkSession
    path, kind = shared.scratch(spark, "linked"), stars.schema["node"].dataType.simpleString()
    local = shared.saved(stars.mapInArrow(_join_chunks, f"node {kind}, root long, lead boolean"), f"{path}/local")
    rows = local.filter("not lead").select("node", "root")
    n = rows.count()
    shared.release(spark)  # after a job: until then the listeners can hold the plan that was saved, with its shuffles
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // MERGE_ROWS))
    both = shared.saved(rows.repartition(parts, "node").mapInArrow(_compare_chunks, f"node {kind}, root long, other long"), f"{path}/placed")
    placed = both.filter("other is null").select("node", "root")
    same = shared.saved(both.filter("other is not null").select("root", "other").distinct(), f"{path}/same")
    leads = shared.saved(local.filter("lead").select("root", "node"), f"{path}/leads")
    shared.remove(spark, f"{path}/local")
    shared.release(spark)
    if links := same.count():
        near = same.select(F.col("root").alias("node"), F.array("other").alias("near"))
        if links < CHUNK_EDGES:  # one chunk
            found = linked_components(near.coalesce(1))
        else:
            found = linked_components(near) if links * 2 < n else components(same.toDF("a", "b"))
        ends = leads.join(found.toDF("root", "final"), "root", "left").select("root", "node", F.coalesce("final", "root").alias("final"))
        least = ends.groupBy("final").agg(F.min("node").alias("component"))
        leads = ends.join(least, "final").select("root", "component")
    used = shared.saved(leads.toDF("root", "component").join(placed.select("root").distinct(), "root", "left_semi"), f"{path}/used")
    for done in ("same", "leads"):
        shared.remove(spark, f"{path}/{done}")
    shared.release(spark)
    return placed.join(F.broadcast(used) if used.count() <= 1_000_000 else used, "root").select("node", "component")


def clustering(pairs: DataFrame) -> DataFrame:
    """node and the share of its neighbour pairs that are linked. Each triangle is found once, from its end of least degree."""
    e = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    d = degrees(e)
    key = lambda n, k: F.struct(F.col(k), F.col(n))
    ranked = e.join(d.toDF("a", "da"), "a").join(d.toDF("b", "db"), "b")
    low = F.when(key("a", "da") < key("b", "db"), F.struct(F.col("a").alias("x"), F.col("b").alias("y"))).otherwise(F.struct(F.col("b").alias("x"), F.col("a").alias("y")))
    out = ranked.select(low.alias("e")).select("e.x", "e.y")
    wedge = out.join(out.select("x", F.col("y").alias("z")), "x").filter("y < z")
    closed = wedge.join(e.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"])
    links = closed.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    k = F.col("degree")
    ratio = F.when(k < 2, F.lit(0.0)).otherwise(2.0 * F.coalesce("links", F.lit(0)) / (k * (k - 1)))
    return d.join(links, "node", "left").select("node", F.round(ratio, 6).alias("clustering"))


def path_lengths(edges: DataFrame) -> DataFrame:
    """Shortest distances d of all connected pairs (a, b), for small graphs: breadth-first joins until nothing new is reached.

    The result has a row for each pair of nodes of a component, so it grows with its square.
    """
    spark = edges.sparkSession
    path = shared.scratch(spark, "paths")
    step = shared.saved(edges.union(edges.select("b", "a")).filter("a <> b").distinct(), f"{path}/step")
    known = front = step.withColumn("d", F.lit(1))
    d = 1
    while not front.isEmpty():
        d += 1
        reached = front.select("a", F.col("b").alias("m")).join(step.select(F.col("a").alias("m"), "b"), "m").filter("a <> b").select("a", "b").distinct()
        front = shared.saved(reached.join(known, ["a", "b"], "left_anti").withColumn("d", F.lit(d)), f"{path}/{d}")
        known = known.unionByName(front)
    return known


def _core(edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The graph with the leaves of a node drawn together: edges (a, b), and kin (node, rep, parent, weight) of the leaves.

    Leaves of one node have the same distances to all others and lie on no path, so one of them, the least,
    stands for all; weight is their number. Of an edge between two leaves both stay, without a row in kin.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    step = shared.saved(both, f"{path}/step")
    degree = step.groupBy("a").agg(F.count("*").alias("k"), F.min("b").alias("parent"))
    single = degree.filter("k = 1").select(F.col("a").alias("node"), "parent")
    single = shared.saved(single, f"{path}/single")
    pair = single.select(F.col("node").alias("parent"), F.col("parent").alias("node"))
    leaves = single.join(pair, ["node", "parent"], "left_anti")
    group = leaves.groupBy("parent").agg(F.min("node").alias("rep"), F.count("*").alias("weight"))
    kin = shared.saved(leaves.join(group, "parent").select("node", "rep", "parent", "weight"), f"{path}/kin")
    rest = step.filter("a < b").join(kin.select(F.col("node").alias("a")), "a", "left_anti").join(kin.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b")
    return shared.saved(rest.unionByName(kin.filter("node = rep").select(F.col("parent").alias("a"), F.col("rep").alias("b"))), f"{path}/core"), kin


class _Paths:
    """Breadth-first searches over the core in one task, as arrays: nodes are numbered, neighbours lie together."""

    def __init__(self, a: np.ndarray, b: np.ndarray, weight: np.ndarray):
        tail, head = np.r_[a, b], np.r_[b, a]
        order = np.argsort(tail, kind="stable")
        self.head, self.weight, n = head[order], weight, len(weight)
        self.start = np.searchsorted(tail[order], np.arange(n + 1))
        self.far = np.full(n, -1, np.int64)

    def levels(self, source: int):
        """Of each distance from 1 on: its nodes, and the edges (from the distance before, place of the end in nodes)."""
        front, seen, d = np.array([source]), [np.array([source])], 0
        self.far[source] = 0
        while True:
            d += 1
            size = self.start[front + 1] - self.start[front]
            tail = np.repeat(front, size)
            head = self.head[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[front], size)]
            new = self.far[head] < 0
            tail, head = tail[new], head[new]
            if not len(head):
                break
            front = np.unique(head)
            self.far[front] = d
            seen.append(front)
            yield d, front, tail, head
        self.far[np.concatenate(seen)] = -1


def _spread(edges: DataFrame, kin: DataFrame):
    """The core as broadcast arrays, its nodes' names, and a table of its nodes' numbers."""
    spark = edges.sparkSession
    got, lead = edges.toArrow(), kin.filter("node = rep").select("node", "weight").toArrow()
    ends = [got.column(c).to_numpy(zero_copy_only=False).astype(object) for c in "ab"]
    names, at = np.unique(np.concatenate(ends), return_inverse=True) if got.num_rows else (np.zeros(0, object), np.zeros(0, np.int64))
    weight = np.ones(len(names), np.int64)
    weight[np.searchsorted(names, lead.column("node").to_numpy(zero_copy_only=False).astype(object))] = lead.column("weight").to_numpy()
    parts = max(1, min(-(-len(names) // 16), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.sparkContext.broadcast((at[: got.num_rows], at[got.num_rows :], weight)), names, spark.range(0, len(names), 1, parts)


def distance_counts(edges: DataFrame) -> DataFrame:
    """d, pairs: how many ordered pairs of nodes have each shortest distance, without a row for a pair.

    The leaves of a node count through one of them. What is left of the graph comes to the driver and to
    every task, and each of its nodes searches it, so work grows with nodes times edges of that rest.
    """
    core, kin = _core(edges, shared.scratch(edges.sparkSession, "distances"))
    graph, _, sources = _spread(core, kin)

    def run(batches):
        paths, total = _Paths(*graph.value), collections.Counter()
        for batch in batches:
            for source in batch.column("id").to_pylist():
                w = int(paths.weight[source])
                if w > 1:
                    total[2] += w * (w - 1)
                for d, front, _, _ in paths.levels(source):
                    total[d] += w * int(paths.weight[front].sum())
        yield pa.RecordBatch.from_pydict({"d": pa.array(total.keys(), pa.int32()), "pairs": pa.array(total.values(), pa.int64())})

    return sources.mapInArrow(run, "d int, pairs long").groupBy("d").agg(F.sum("pairs").alias("pairs"))


def centralities(edges: DataFrame) -> DataFrame:
    """node, closeness, radiality, betweenness and stress of an undirected graph, within each component.

    closeness is the number of other nodes reached over the sum of their distances; radiality the mean of
    diameter + 1 - distance over the diameter; stress counts the shortest paths through a node, and
    betweenness the share of each pair's shortest paths, pairs counted once.

    The leaves of a node are searched from through one of them. What is left of the graph comes to the driver and to
    every task, and each of its nodes searches it, so work grows with nodes times edges of that rest; no pair
    of nodes is a row. Shares are summed back from the farthest nodes (Brandes).
    """
    path = shared.scratch(edges.sparkSession, "central")
    core, kin = _core(edges, path)
    graph, names, sources = _spread(core, kin)
    spark = edges.sparkSession

    def run(batches):
        paths = _Paths(*graph.value)
        n, weight = len(paths.weight), paths.weight
        between, stress, rows = np.zeros(n), np.zeros(n), []
        ways, share, onward = np.zeros(n), np.zeros(n), np.zeros(n)
        for batch in batches:
            for source in batch.column("id").to_pylist():
                w, levels = int(weight[source]), list(paths.levels(source))
                reached, total, most = w - 1, 2 * (w - 1), 2 * (w > 1)
                ways[:], share[:], onward[:] = 0, 0, 0
                ways[source] = 1
                for d, front, tail, head in levels:
                    np.add.at(ways, head, ways[tail])
                    here = int(weight[front].sum())
                    reached, total, most = reached + here, total + d * here, max(most, d)
                for _, _, tail, head in reversed(levels):
                    np.add.at(share, tail, ways[tail] / ways[head] * (weight[head] + share[head]))
                    np.add.at(onward, tail, weight[head] + onward[head])
                share[source] = onward[source] = 0
                between += w * share
                stress += w * ways * onward
                if w > 1:  # two leaves of one node meet in it
                    (parent,) = paths.head[paths.start[source] : paths.start[source + 1]]
                    between[parent] += w * (w - 1)
                    stress[parent] += w * (w - 1)
                rows.append((source, reached, total, most))
        at = [r[0] for r in rows]
        yield _central(at, [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], np.zeros(len(at)), np.zeros(len(at)))
        some = np.flatnonzero((between > 0) | (stress > 0))
        none = np.zeros(len(some), np.int64)
        yield _central(some, none, none, none, between[some] / 2, stress[some] / 2)

    found = sources.mapInArrow(run, "id long, reached long, total long, most int, betweenness double, stress double")
    found = found.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("reached", "total", "betweenness", "stress")), F.max("most").alias("most"))
    found = shared.saved(found, f"{path}/found")
    name = spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(names)), pa.int64()), "node": pa.array(names, pa.string())}))
    diameter = found.agg(F.max("most").cast("double").alias("diameter"))
    own = found.join(name.withColumn("node", F.col("node").cast(edges.schema["a"].dataType)), "id").crossJoin(F.broadcast(diameter)).drop("id")
    alike = kin.filter("node <> rep").select(F.col("node").alias("other"), F.col("rep").alias("node"))
    every = own.unionByName(own.join(alike, "node").drop("node").withColumnRenamed("other", "node"))
    near = every.withColumn("closeness", F.col("reached") / F.col("total"))
    near = near.withColumn("radiality", ((F.col("diameter") + 1) * F.col("reached") - F.col("total")) / F.col("reached") / F.col("diameter"))
    r = lambda c: F.round(F.col(c), 6).alias(c)
    return near.select("node", r("closeness"), r("radiality"), r("betweenness"), r("stress"))


def _central(ids, reached, total, most, betweenness, stress) -> pa.RecordBatch:
    kinds = {"id": pa.int64(), "reached": pa.int64(), "total": pa.int64(), "most": pa.int32(), "betweenness": pa.float64(), "stress": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, reached, total, most, betweenness, stress), kinds.values(), strict=True)], names=list(kinds))


def walks(edges: DataFrame, steps: int, seed: int) -> DataFrame:
    """Self-avoiding walks from every source node: start, path, length, negative.

    The next edge of a walk is the one of least hash among those that lead to new nodes; length is how far
    a walk came. negative is a hash-chosen node that the start has no edge to.
    """
    ranked = F.md5(F.concat_ws(":", F.lit(str(seed)), "start", "last", "b"))
    now = edges.select(F.col("a").alias("start")).distinct().select("start", F.array("start").alias("path"), F.col("start").alias("last"))
    for _ in range(steps):
        moves = now.join(edges.select(F.col("a").alias("last"), "b"), "last").filter(~F.array_contains("path", F.col("b")))
        best = moves.groupBy("start").agg(F.min_by("b", ranked).alias("next"))
        now = now.join(best, "start", "left").select("start", F.when(F.col("next").isNotNull(), F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"), F.coalesce("next", "last").alias("last"))
    return now.join(negatives(edges, seed), "start", "left").select("start", "path", (F.size("path") - 1).alias("length"), "negative")


def negatives(edges: DataFrame, seed: int, tries: int = 8) -> DataFrame:
    """start, negative: for every source node a hash-chosen tail that it has no edge to and is not itself; null where there is none.

    Tails are numbered in the order of a hash. A start draws tries numbers; one whose draws are all its
    neighbours takes the least number that none of its neighbours has, which exists unless it is linked
    with every tail.
    """
    from weftgraph.operators.datasets import global_rank

    path = shared.scratch(edges.sparkSession, "negatives")
    links = shared.saved(edges.select(F.col("a").alias("start"), F.col("b").alias("tail")).distinct(), f"{path}/links")
    tails = shared.saved(global_rank(links.select("tail").distinct(), [F.md5(F.concat_ws(":", F.lit(str(seed)), "tail")), F.col("tail")], "k"), f"{path}/tails")
    total = tails.count()
    starts = links.select("start").distinct()
    draw = lambda i: (F.pmod(F.xxhash64("start", F.lit(seed), i), F.lit(max(total, 1))) + 1).cast("long")
    drawn = starts.select("start", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), draw)).alias("i", "k")).join(tails, "k").filter("tail <> start")
    fine = drawn.join(links, ["start", "tail"], "left_anti").groupBy("start").agg(F.min_by("tail", "i").alias("negative"))
    fine = shared.saved(fine, f"{path}/drawn")
    # the others: the first gap in the numbers of the tails that are taken (the start itself is taken too)
    rest = starts.join(fine, "start", "left_anti")
    taken = links.union(starts.select("start", F.col("start").alias("tail"))).distinct().join(rest, "start", "left_semi").join(tails, "tail").select("start", "k")
    from pyspark.sql import Window

    gap = taken.withColumn("place", F.row_number().over(Window.partitionBy("start").orderBy("k"))).filter("k = place").groupBy("start").agg((F.max("place") + 1).cast("long").alias("k"))
    first = rest.join(gap, "start", "left").select("start", F.coalesce("k", F.lit(1).cast("long")).alias("k")).join(tails, "k").select("start", F.col("tail").alias("negative"))
    return fine.unionByName(first)
