"""Exact Jaccard join on word shingles: size-banded tiles, bitmap bounds, sorted-array intersection.

1. Documents with equal shingle sets form one class; only classes go on.
2. Size bands. Sets whose sizes lie in one band are cut by hash into the same number of parts, one
   more than the elements in which two linked sets can differ, so two linked sets agree in some part.
   The hash of a part's elements is a signature. Sets near a band's edge take part in the next band too.
3. Tiles. Signatures are range-sorted by Spark, a slice of them at a time; classes with the same one form blocks of bounded size,
   and a block alone or a pair of blocks of one signature is a tile. A hot signature makes many tiles.
4. In a tile, each set is hashed into a bitmap. Sets that differ in d bits differ in d elements at
   least, which bounds their overlap from above. All tiles meet with small bitmaps; what these leave, as
   pairs or as smaller tiles, meets with larger ones, and only pairs that pass both are intersected
   exactly. Pairs that are connected already are skipped. A tile gives stars of components, not all pairs.
5. Connected components of the classes by alternating large-star and small-star steps.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import bytescan as bs
from weftgraph.llm import store
from weftgraph.llm.graph import components

U64 = np.uint64
#: Classes in one block of a tile.
BLOCK = 1024
#: Bits of a bitmap for each element at least, and the least bitmap: of the first sifting, and of the later ones.
SMALL_MAP, LARGE_MAP = (4, 256), (16, 1024)
#: Columns into which signatures are dealt, which are then sorted one after the other.
SLICES = 3
#: Pairs for each set of a tile up to which they go on one by one; beyond, the tile goes on as it is.
FEW_PAIRS = 2
#: Ids that may be broadcast (16 MB); beyond, the same join shuffles.
BROADCAST_IDS = 1_000_000


def bands(n: int, num: int, den: int) -> list[tuple[int, int, bool]]:
    """(band, parts, whether empty parts are needed) of a set of n elements at similarity num/den."""
    level = lambda s: max(0, math.ceil(round(2 * math.log2(max(s, 1)), 9)))
    largest = n * den // num
    out = []
    for band in range(level(n), level(largest) + 1):
        top = int(2 ** (band / 2) + 1e-9)
        parts = int(1.1 * (2 * top * (den - num) // (den + num) + 1)) + 1
        differ = (n + min(top, largest)) * (den - num) // (den + num)
        out.append((band, parts, differ))
    return out


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """One 64-bit signature for each part of each band."""
    out = []
    spread = bs.mix(s ^ U64(0xA5A5))
    for band, parts, differ in bands(len(s), num, den):
        part = ((spread >> U64(32)) * U64(parts)) >> U64(32)
        order = np.argsort(part, kind="stable")
        at, value = part[order], bs.mix(s[order] + U64(band))
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(value, first)
        which = at[first]
        out.append(bs.join_hash(sums, which, 1000 + band))
        if parts - len(first) >= parts - differ:  # all that agree may be empty parts
            empty = np.setdiff1d(np.arange(parts, dtype=U64), which)
            out.append(bs.join_hash(np.zeros(len(empty), U64), empty, 1000 + band))
    return np.concatenate(out)


def _sets(batch: pa.RecordBatch, k: int):
    """doc_id and the sorted distinct shingle hashes of each row."""
    data, offsets = bs.utf8(batch.column("text"))
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    for a, b in bs.pieces(offsets):
        part = offsets[a : b + 1] - offsets[a]
        words = bs.Words(data[offsets[a] : offsets[b]], part)
        h, text = bs.shingle_hashes(words, k)
        at, first = np.searchsorted(text, np.arange(b - a + 1)), words.first(b - a)
        for i in range(b - a):
            if at[i + 1] > at[i]:
                s = np.unique(h[at[i] : at[i + 1]])
            else:  # fewer than k words: all of them as one
                s = words.hash[first[i] : first[i + 1]]
                for j in range(1, len(s)):
                    s = np.r_[bs.join_hash(s[:1], s[1:2], 77 + j), s[2:]]
            yield int(ids[a + i]), s


def _class_key(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        return int(np.add.reduce(bs.mix(s)).view(np.int64)), int(np.add.reduce(bs.mix(s ^ bs.M1)).view(np.int64))


FEATURES = "doc_id long, n long, k1 long, k2 long, " + ", ".join(f"sigs{i} array<long>" for i in range(SLICES))


def _features(k: int, num: int, den: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), *((f"sigs{i}", pa.list_(pa.int64())) for i in range(SLICES))])

    def run(batches):
        for batch in batches:
            seen, rows, sigs, size = set(), [], [], 0

            def flush():
                columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
                ends = np.cumsum([0, *map(len, sigs)])
                values = np.concatenate([np.zeros(0, U64), *sigs])
                for i in range(SLICES):
                    own = values % U64(SLICES) == U64(i)
                    before = np.r_[0, np.cumsum(own)][ends]
                    columns.append(pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(values[own].view(np.int64))))
                return pa.RecordBatch.from_arrays(columns, schema=schema)

            for doc_id, s in _sets(batch, k):
                key = _class_key(s)
                new = len(s) and key not in seen
                seen.add(key)
                rows.append((doc_id, len(s), *key))
                sigs.append(signatures(s, num, den) if new else np.zeros(0, U64))
                size += len(sigs[-1])
                if size > 1 << 20:
                    yield flush()
                    rows, sigs, size = [], [], 0
            if rows:
                yield flush()

    return run


def _blocks(batches):
    """Classes of one signature, in blocks. Alone ones stay only at the ends of a partition, where a signature may go on."""
    schema = pa.schema([("sig", pa.int64()), ("members", pa.list_(pa.int64()))])

    def out(groups):
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in groups], pa.int64()), pa.array([m for _, m in groups], pa.list_(pa.int64()))], schema=schema)

    held_sig, held, first, cut = None, np.zeros(0, np.int64), True, False  # cut: blocks of the held signature went out before
    ready = []
    for batch in batches:
        sig = batch.column("sig").to_numpy(zero_copy_only=False)
        key = batch.column("k1").to_numpy(zero_copy_only=False)
        if not len(sig):
            continue
        new = np.r_[True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])]
        sig, key = sig[new], key[new]
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        end = np.r_[start[1:], len(sig)]
        for j in np.flatnonzero((end - start > 1) | (start == 0) | (end == len(sig))):
            s, members = sig[start[j]], key[start[j] : end[j]]
            if held_sig is not None and s == held_sig:
                held = np.unique(np.r_[held, members])
            else:
                if held_sig is not None and (first or cut or len(held) > 1):
                    ready.append((held_sig, held))
                    first = False
                held_sig, held, cut = s, members, False
            while len(held) > BLOCK:
                ready.append((held_sig, held[:BLOCK]))
                held, first, cut = held[BLOCK:], False, True
        if ready:
            yield out(ready)
            ready = []
    if held_sig is not None and len(held):
        yield out([(held_sig, held)])


def _bitmap(s: np.ndarray, each: int = LARGE_MAP[0], least: int = LARGE_MAP[1]) -> np.ndarray:
    """A bitmap of each to 2 * each bits for each element (fewer for very large sets); the size is a power of two, least at least."""
    bits = max(least, 1 << min(18, (each * len(s)).bit_length()))
    out = np.zeros(bits // 64, U64)
    b = bs.mix(s ^ U64(0x5EED)) & U64(bits - 1)
    np.bitwise_or.at(out, (b >> U64(6)).astype(np.int64), U64(1) << (b & U64(63)))
    return out


def _folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps cut to the least size among them by joining their halves."""
    least, out = min(map(len, maps)), []
    for m in maps:
        while len(m) > least:
            m = m[: len(m) // 2] | m[len(m) // 2 :]
        out.append(m)
    return np.stack(out)


def _bounded(i: int, n: np.ndarray, maps: np.ndarray, other: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of the sets other, those whose overlap with set i the bitmaps do not rule out. n ascends, i is the smaller."""
    differ = np.bitwise_count(maps[other] ^ maps[i]).sum(axis=1, dtype=np.int64)
    most = np.minimum((n[i] + n[other] - differ) // 2, n[i])
    return other[(num + den) * most >= num * (n[i] + n[other])]


def sieve(n: np.ndarray, maps: list[np.ndarray], label: np.ndarray, num: int, den: int, sparse: bool) -> tuple[np.ndarray, list[tuple[int, int]] | None]:
    """Pairs of a tile that the bitmaps do not rule out and whose labels (components so far) differ.

    Gives the sets that occur in any such pair, and the pairs themselves if they are few. If sparse, only
    pairs that would join the labels to a forest are given; the others wait for what these turn out to be.
    """
    order = np.argsort(n, kind="stable")
    n, folded, keep, pairs = n[order], _folded([maps[i] for i in order]), np.zeros(len(n), bool), []
    root = np.unique(label[order], return_inverse=True)[1]
    for i in range(len(n)):
        stop = int(np.searchsorted(n, n[i] * den // num, "right"))
        found = _bounded(i, n, folded, i + 1 + np.flatnonzero(root[i + 1 : stop] != root[i]), num, den)
        if sparse:
            for j in found:
                if root[j] != root[i]:
                    pairs.append((int(order[i]), int(order[j])))
                    root[root == root[j]] = root[i]
        elif len(found):
            keep[i] = True
            keep[found] = True
            if pairs is not None:
                pairs += [(int(order[i]), int(order[j])) for j in found]
                if len(pairs) > FEW_PAIRS * len(n):
                    pairs = None
    return order[keep], pairs


def forest(sets: list[np.ndarray], label: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Edges (u, v) between the labels that links of this tile connect: all of one group to its least label."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    label, sets = label[order], [sets[i] for i in order]
    n = np.array([len(s) for s in sets], np.int64)
    maps, root = _folded([_bitmap(s) for s in sets]), np.unique(label, return_inverse=True)[1]
    for i in range(len(sets)):
        stop = int(np.searchsorted(n, n[i] * den // num, "right"))  # the size band of i
        other = i + 1 + np.flatnonzero(root[i + 1 : stop] != root[i])
        for j in _bounded(i, n, maps, other, num, den):
            if root[j] == root[i]:
                continue
            small, large = sets[i], sets[j]
            where = np.minimum(np.searchsorted(large, small), len(large) - 1)
            common = int((large[where] == small).sum())
            if (num + den) * common >= num * int(n[i] + n[j]):
                root[root == root[j]] = root[i]
    least = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(least, root, label)
    return sorted({(int(u), int(v)) for u, v in zip(label, least[root]) if u != v})


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, base: str | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    Two documents link when den * |intersection| >= num * |union| of their sets of k-word shingles (A-Z
    lower-cased; with fewer words the whole sequence is the only shingle). component_id is the least
    doc_id that links reach. Null or wordless texts have the empty set and link with nothing. Rows
    without doc_id are left out; repeated rows give repeated rows. Other columns are ignored. An empty
    table gives no rows. Intermediate tables are in the folder base; it may go when the result is written.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    base = base or store.scratch(spark, "jaccard")
    feats = store.save(texts.mapInArrow(store.freed(_features(k, num, den)), FEATURES), f"{base}/features")

    rows = store.save(feats.select("doc_id", "n", "k1", "k2"), f"{base}/rows")
    classes = store.save(rows.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("id")), f"{base}/classes")
    # a class is named by its key k1; its least doc_id tells where to read its text, and may be that of other classes too
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = []
    for i in range(SLICES):  # all of one signature are in one slice
        pairs = feats.select(F.explode(f"sigs{i}").alias("sig"), "k1")
        ordered = pairs.repartitionByRange(parts, "sig", "k1").sortWithinPartitions("sig", "k1")
        sliced.append(store.save(ordered.mapInArrow(store.freed(_blocks), "sig long, members array<long>"), f"{base}/blocks/{i}"))
    blocks = functools.reduce(DataFrame.unionByName, sliced)
    store.remove(spark, f"{base}/features")

    cut = blocks.withColumn("at", F.element_at("members", 1))
    many = cut.groupBy("sig").agg(F.count("*").alias("blocks")).filter("blocks > 1")
    hot = cut.join(many, "sig", "left_semi")
    other = hot.select("sig", F.col("members").alias("others"), F.col("at").alias("other_at"))
    across = hot.join(other, "sig").filter("at < other_at").select(F.array_sort(F.array_union("members", "others")).alias("members"))
    tiles = blocks.select("members").unionByName(across).filter("size(members) > 1")
    tiles = tiles.withColumn("tile", F.xxhash64("members")).dropDuplicates(["tile"])
    tiles = store.save(tiles, f"{base}/tiles")
    member = tiles.select("tile", F.explode("members").alias("id"))
    member = store.save(member, f"{base}/members")
    for done in ("blocks", "tiles"):
        store.remove(spark, f"{base}/{done}")

    def of_classes(ids: DataFrame, render) -> DataFrame:
        """render(sorted shingles) of the classes with these ids, as column items, with their size n (and of others that share a document's id)."""

        def run(batches):
            for batch in batches:
                found, size = [], 0
                for _, s in _sets(batch, k):
                    found.append((_class_key(s)[0], len(s), render(s).tobytes()))
                    size += len(found[-1][2])
                    if size > 1 << 23:
                        yield out(found)
                        found, size = [], 0
                if found:
                    yield out(found)

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.binary())], names=["id", "n", "items"])

        ids = ids.select(F.col("id").alias("k1")).distinct().join(classes.select("k1", F.col("id").alias("doc_id")), "k1").select("doc_id").distinct()
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        return texts.join(ids, "doc_id", "left_semi").mapInArrow(store.freed(run), "id long, n long, items binary").dropDuplicates(["id"])

    def sift(sparse: bool):
        def run(table: pa.Table) -> pa.Table:
            maps = [np.frombuffer(x, U64) for x in table.column("items").to_pylist()]
            ids, tile = table.column("id").to_numpy(), table.column("tile")[0].as_py()
            keep, pairs = sieve(table.column("n").to_numpy(), maps, table.column("label").to_numpy(), num, den, sparse)
            if pairs is None:
                return pa.table({"tile": pa.array([tile] * len(keep), pa.int64()), "id": pa.array(ids[keep]), "origin": pa.array([tile] * len(keep), pa.int64())})
            pair = np.sort(ids[np.array(pairs, np.int64).reshape(-1, 2)], axis=1)  # a pair is a tile of two, the same from any tile
            name = bs.join_hash(pair[:, 0].view(U64), pair[:, 1].view(U64), 11).view(np.int64)
            return pa.table({"tile": pa.array(np.repeat(name, 2), pa.int64()), "id": pa.array(pair.reshape(-1), pa.int64()), "origin": pa.array([tile] * (2 * len(pair)), pa.int64())})

        return store.freed_group(run)

    sifted_columns = "tile long, id long, origin long"

    def link(table: pa.Table) -> pa.Table:
        items = [np.frombuffer(x, U64) for x in table.column("items").to_pylist()]
        edges = forest(items, table.column("label").to_numpy(), num, den)
        return pa.table({"u": pa.array([a for a, _ in edges], pa.int64()), "v": pa.array([b for _, b in edges], pa.int64())})

    joins: list[DataFrame] = []  # label to component, each over the components of those before

    def with_label(part: DataFrame) -> DataFrame:
        part = part.withColumn("label", F.col("id"))
        for label in joins:
            part = part.join(label.withColumnRenamed("node", "label"), "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")
        return part

    def verify(part: DataFrame, name: str) -> None:
        """Joins the components that links within the tiles of part connect."""
        sets = of_classes(part, lambda s: s)
        found = with_label(part).join(sets, "id").groupBy("tile").applyInArrow(store.freed_group(link), "u long, v long").distinct()
        edges = store.save(found, f"{base}/edges-{name}")
        if not edges.isEmpty():
            joins.append(components(edges, f"{base}/components-{name}"))

    # first, small bitmaps thin out all tiles: most hold no pair that could link, and only what is left moves larger
    # items. Then each class in its largest tile only; then, between the components so far, a forest of the pairs
    # that the bitmaps leave; then all pairs that are left between components
    maps = store.save(of_classes(member, lambda s: _bitmap(s, *SMALL_MAP)), f"{base}/small", "uncompressed")
    thin = member.withColumn("label", F.col("id")).join(maps, "id").groupBy("tile").applyInArrow(sift(False), sifted_columns)
    member = store.save(thin.select("tile", "id").distinct(), f"{base}/thin")
    for done in ("small", "members"):
        store.remove(spark, f"{base}/{done}")
    size = member.groupBy("tile").agg(F.count("*").alias("size"))
    home = member.join(size, "tile").groupBy("id").agg(F.max_by("tile", F.struct("size", "tile")).alias("tile"))
    verify(home, "home")
    maps = store.save(of_classes(member, _bitmap), f"{base}/bitmaps", "uncompressed")
    sifted = member
    for name, sparse in (("sparse", True), ("all", False)):
        # only tiles between components move their bitmaps; after the first sifting, only those that gave a pair: the others have none at all
        labelled = store.save(with_label(sifted), f"{base}/labelled-{name}")
        across = labelled.groupBy("tile").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("tile")
        met = labelled.join(across, "tile", "left_semi").join(maps, "id")
        left = store.save(met.groupBy("tile").applyInArrow(sift(sparse), sifted_columns), f"{base}/sifted-{name}")
        store.remove(spark, f"{base}/labelled-{name}")
        if left.isEmpty():
            break  # no pair between components is left
        verify(left.select("tile", "id").distinct(), name)
        sifted = member.join(left.select(F.col("origin").alias("tile")).distinct(), "tile", "left_semi")
    for done in ("bitmaps", "thin"):
        store.remove(spark, f"{base}/{done}")
    named = with_label(classes.withColumnRenamed("id", "least").withColumn("id", F.col("k1")))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.select("k1", "k2", "n", "label").join(least, "label")
    joined = rows.join(named, ["k1", "k2", "n"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
