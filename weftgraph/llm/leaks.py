"""Benchmark decontamination by latent semantic retrieval, then subsequence and answer checks.

1. One pass reads the texts: of each document it keeps the places of the words that the benchmark has too
   (other words can neither match nor lie in the latent space), and counts in how many documents each occurs.
2. Randomised SVD of the passages' TF-IDF rows, those of all documents and of the benchmark: a distributed
   pass adds every row, with a random sign, to one of SKETCH columns; the columns' orthonormal basis is the
   range; a second pass projects every row on it and adds up the small Gram matrix, whose eigenvectors give
   the right singular vectors and values. The space is cut to RANK dimensions, fewer than items.
   Partial sums are added in a tree of fixed fan-in.
3. Passages (WINDOW / 2 and WINDOW words, at every STRIDE) and items are folded into the latent space
   (divided by the singular values) and compared there; the cosine makes candidates. Beside it, items that
   share SHORT_RUN words in a row are candidates, so a verbatim copy is found among whatever words.
4. Each candidate is checked exactly: the longest common subsequence of the item's words and the words
   around the passage, and that of the item's last sentence (its answer).

Items are taken in blocks of bounded size, so what is collected and broadcast is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import bytescan as bs
from weftgraph.llm import store

U64 = np.uint64
#: Words between two passages, of a passage, of a piece of a long item; items of a block.
STRIDE, WINDOW, PIECE, ITEM_BLOCK = 24, 48, 48, 4096
#: Columns of the sketch, dimensions of the latent space (at most half the items' pieces), and terms of the latent space at most (more are hashed together).
SKETCH, RANK, LATENT_TERMS = 64, 48, 1 << 15
#: Least latent cosine of a candidate; least share of an item's words that suffices alone; the same and the answer's share where both are asked for.
COSINE, COVERED, PARTLY, ANSWER = 0.5, 0.75, 0.5, 0.6
#: Where both are asked for: least share of the item's squared TF-IDF weight in shared words, or least latent cosine.
WEIGHT, NEAR = 0.25, 0.7
#: Words in a row that make a candidate, and that suffice alone.
SHORT_RUN, RUN = 6, 48
#: Partial sums that one task adds.
FAN = 16
STOPS = np.zeros(256, bool)
STOPS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence (bit-parallel over b)."""
    if not len(a) or not len(b):
        return 0
    where: dict[int, int] = {}
    for i, w in enumerate(b.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for w in a.tolist():
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def has_run(a: np.ndarray, b: np.ndarray, n: int) -> bool:
    """Whether a and b have n words in a row in common."""
    known = {a[i : i + n].tobytes() for i in range(len(a) - n + 1)}
    return any(b[i : i + n].tobytes() in known for i in range(len(b) - n + 1))


def _run_keys(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, U64)
    out = bs.mix(words[:size].astype(U64) + U64(n))
    for i in range(1, n):
        out = bs.join_hash(out, words[i : size + i].astype(U64), i)
    return out


class Items:
    """Benchmark items as numbers of their words in the block's vocabulary, with answers, pieces and short runs."""

    def __init__(self, rows: list):
        self.ids, hashes, tails = [], [], []
        for row in rows:
            data, offsets = bs.utf8(pa.array([row["text"]]))
            found = bs.Words(data, offsets, separator=STOPS)
            if not len(found.hash):
                continue
            stop = np.concatenate([[0], np.cumsum(np.isin(data, (0x2E, 0x21, 0x3F, 0x0A)))])[found.start]
            tail = int(np.searchsorted(stop, stop[-1]))
            if len(found.hash) - tail < 3:  # the answer is the last sentence, of at least three words
                tail = max(0, len(found.hash) - 5)
            self.ids.append(row["item_id"])
            hashes.append(found.hash)
            tails.append(tail)
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, U64)
        self.words = [np.searchsorted(self.vocabulary, h).astype(np.int32) for h in hashes]
        self.answers = [w[t:] for w, t in zip(self.words, tails, strict=True)]
        self.terms = len(self.vocabulary)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.vocabulary >> U64(44)).astype(np.int64)] = True
        parts = [(j, p) for j, w in enumerate(self.words) for p in np.array_split(w, -(-len(w) // PIECE))]
        self.piece_of, self.pieces = np.array([j for j, _ in parts], np.int64), [p for _, p in parts]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        runs = {n: [] for n in sorted({min(SHORT_RUN, len(w)) for w in self.words})}
        for j, w in enumerate(self.words):
            n = min(SHORT_RUN, len(w))
            runs[n].append((_run_keys(w, n), j))
        self.runs = []
        for n, some in runs.items():
            key, item = np.concatenate([k for k, _ in some]), np.concatenate([np.full(len(k), j) for k, j in some])
            order = np.lexsort((item, key))
            seen = np.zeros(1 << 20, bool)
            seen[(key >> U64(44)).astype(np.int64)] = True
            self.runs.append((n, key[order], item[order], seen))
        pairs = [np.unique(w, return_counts=True) for w in self.words]
        self.member = np.concatenate([j * self.terms + w.astype(np.int64) for j, (w, _) in enumerate(pairs)]) if pairs else np.zeros(0, np.int64)
        self.member_n = np.concatenate([n for _, n in pairs]) if pairs else np.zeros(0, np.int64)

    def number(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are in the vocabulary, and their numbers."""
        maybe = np.flatnonzero(self.filter[(hashes >> U64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), max(self.terms - 1, 0))
        good = self.vocabulary[at] == hashes[maybe]
        return maybe[good], at[good].astype(np.int32)

    def columns(self) -> np.ndarray:
        """The latent column of each term."""
        n = np.arange(self.terms)
        return n if self.terms <= LATENT_TERMS else (bs.mix(n.astype(U64)) % U64(LATENT_TERMS)).astype(np.int64)


KEPT = "ids binary, first binary, at binary, word binary, counts array<struct<token:int,n:bigint>>"


def _keep(items):
    """Of each few documents: their ids, the numbers of their first words, and place and number of each word of the
    vocabulary; at the end of a partition, how many documents hold each term, and their number as term -1."""
    counted = pa.list_(pa.struct([("token", pa.int32()), ("n", pa.int64())]))

    def run(batches):
        known = items.value
        total, documents = np.zeros(known.terms, np.int64), 0
        for batch in batches:
            data, offsets = bs.utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b in bs.pieces(offsets):
                words = bs.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], separator=STOPS)
                at, word = known.number(words.hash)
                first = words.first(b - a)
                total += np.bincount(np.unique(words.text[at] * known.terms + word) % known.terms, minlength=known.terms)
                documents += b - a
                blobs = [x.tobytes() for x in (ids[a:b].astype("<i8"), first.astype("<i8"), at.astype("<u4"), word.astype("<i4"))]
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in blobs), pa.nulls(1, counted)], names=["ids", "first", "at", "word", "counts"])
        seen = np.flatnonzero(total)
        pairs = pa.StructArray.from_arrays([pa.array(np.r_[-1, seen], pa.int32()), pa.array(np.r_[documents, total[seen]], pa.int64())], names=["token", "n"])
        yield pa.RecordBatch.from_arrays([*(pa.array([None], pa.binary()) for _ in range(4)), pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)], names=["ids", "first", "at", "word", "counts"])

    return run


class Kept:
    """A row of the kept words: ids, first, at (number of a word in the row), word, text (of each word) and place (in its text)."""

    def __init__(self, row: dict):
        self.ids, self.first = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["first"], "<i8")
        self.at, self.word = np.frombuffer(row["at"], "<u4").astype(np.int64), np.frombuffer(row["word"], "<i4")
        self.text = np.searchsorted(self.first, self.at, "right") - 1
        self.place = self.at - self.first[self.text]

    def rows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the row of width words that each word is in, and of each text's first row, and of all rows."""
        n = -(-np.diff(self.first) // width)
        base = np.r_[0, np.cumsum(n)]
        return base[self.text] + self.place // width, base[:-1], base[-1]


def _each(batches):
    for batch in batches:
        for i in range(len(batch)):
            yield Kept(batch.slice(i, 1).to_pylist()[0])


def _tree_sum(parts: DataFrame, path: str, kind: str) -> np.ndarray | None:
    """Sum of the vectors of all rows (part, vector), FAN at a time."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for blob in table.column("vector"):
            v = np.frombuffer(blob.as_py(), kind).astype(np.float64)
            total = v if total is None else total + v
        return pa.table({"part": table.column("part").slice(0, 1), "vector": pa.array([total.astype(kind).tobytes()], pa.binary())})

    now, level = store.save(parts, f"{path}/0"), 0
    most = now.agg(F.max("part")).first()[0]
    while most:
        level, most = level + 1, most // FAN
        grouped = now.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part").applyInArrow(store.freed_group(add), "part int, vector binary")
        now = store.save(grouped, f"{path}/{level}")
    rows = now.collect()
    return np.frombuffer(rows[0]["vector"], kind).astype(np.float64) if rows else None


def _vector(total: np.ndarray, kind: str):
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.astype(kind).tobytes()], pa.binary())], names=["part", "vector"])


def _row_values(kept: Kept, weight: np.ndarray):
    """Row and weight of each word in the matrix, whose rows are scaled by the root of their words' squared weights; ids of the rows."""
    row, base, n = kept.rows(WINDOW)
    value = weight[kept.word]
    value = value / np.sqrt(np.bincount(row, value**2, n))[row]
    text = np.repeat(np.arange(len(base)), np.diff(np.r_[base, n]))
    name = bs.mix(kept.ids[text].astype(U64) ^ bs.mix((np.arange(n) - base[text]).astype(U64)))
    return row, value, name, n


def _folded(rows: np.ndarray, values: np.ndarray, basis: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
    """Sums of the basis rows of each row's words, times their values. rows ascend."""
    out = np.zeros((n, basis.shape[1]), np.float32)
    for a in range(0, len(rows), 1 << 15):
        b = min(a + (1 << 15), len(rows))
        part = rows[a:b]
        new = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        out[part[new]] += np.add.reduceat(basis[column[a:b]] * values[a:b, None].astype(np.float32), new, axis=0)
    return out


def latent_space(table: DataFrame, items: Items, idf: np.ndarray, path: str) -> np.ndarray:
    """One row for each latent column: the right singular vectors over their singular values, cut to the rank."""
    spark, column = table.sparkSession, items.columns()
    terms = int(column.max()) + 1
    weights = spark.sparkContext.broadcast((idf, column))

    def sketch(batches):
        (weight, col), total, mass = weights.value, np.zeros(terms * SKETCH + 1), 0
        for kept in _each(batches):
            row, value, name, _ = _row_values(kept, weight)
            slot, sign = (name & U64(SKETCH - 1)).astype(np.int64), np.where(name >> U64(63), 1.0, -1.0)
            total[:-1] += np.bincount(col[kept.word] * SKETCH + slot[row], sign[row] * value, terms * SKETCH)
            mass += len(np.unique(row))
        total[-1] = mass
        yield _vector(total, "<f4")

    found = _tree_sum(table.mapInArrow(store.freed(sketch), "part int, vector binary"), f"{path}/sketch", "<f4")
    y, mass = found[:-1].reshape(terms, SKETCH), max(found[-1], 1.0)
    own = np.zeros((terms, len(items.pieces)))  # the benchmark's passages are rows too, together as heavy as the documents'
    for j, piece in enumerate(items.pieces):
        np.add.at(own[:, j], column[piece], idf[piece])
    own *= np.sqrt(mass / own.shape[1]) / np.linalg.norm(own, axis=0)
    rnd = np.random.default_rng(1)
    y = y + own @ rnd.choice([-1.0, 1.0], (own.shape[1], SKETCH)) / np.sqrt(SKETCH) if own.shape[1] > SKETCH else np.concatenate([y, own], 1)
    q, _ = np.linalg.qr(y)
    basis = spark.sparkContext.broadcast(q.astype(np.float32))

    def gram(batches):
        (weight, col), range_ = weights.value, basis.value
        total = np.zeros((range_.shape[1], range_.shape[1]))
        for kept in _each(batches):
            row, value, _, n = _row_values(kept, weight)
            b = _folded(row, value, range_, col[kept.word], n)
            total += b.T @ b
        yield _vector(total.reshape(-1), "<f8")

    g = _tree_sum(table.mapInArrow(store.freed(gram), "part int, vector binary"), f"{path}/gram", "<f8").reshape(q.shape[1], q.shape[1])
    g = g + (q.T @ own) @ (q.T @ own).T
    square, vectors = np.linalg.eigh(g)
    rank = min(RANK, max(2, len(items.pieces) // 2), len(square))
    top = np.argsort(-square)[:rank]
    top = top[square[top] > 1e-9 * square.max()]
    return (q @ vectors[:, top] / np.sqrt(square[top])).astype(np.float32)


FOUND = "doc_id long, item_id long, cosine double, coverage double, answer double, n_words long, contaminated boolean"


def _bounded_overlap(kept: Kept, items: Items, lo: np.ndarray, hi: np.ndarray, item: np.ndarray) -> np.ndarray:
    """For ranges of kept words and items: how many of the item's words the range's words can be at most."""
    out = np.zeros(len(item), np.int64)
    for a in range(0, len(item), 1 << 12):
        some = slice(a, min(a + (1 << 12), len(item)))
        size = hi[some] - lo[some]
        owner = np.repeat(np.arange(len(size)), size)
        word = kept.word[np.repeat(lo[some] - np.cumsum(size) + size, size) + np.arange(len(owner))]
        key = item[some][owner] * items.terms + word
        place = np.minimum(np.searchsorted(items.member, key), len(items.member) - 1)
        has = items.member[place] == key
        pair = np.unique(owner[has] * len(items.member) + place[has])
        out[some] = np.bincount(pair // len(items.member), items.member_n[pair % len(items.member)], len(size)).astype(np.int64)
    return out


def _search(shared, space):
    """Pairs of documents and items that pass the exact checks, from kept words."""

    def run(batches):
        items, idf = shared.value
        basis, latent, column = space.value
        squares = idf.astype(np.float64) ** 2
        for kept in _each(batches):
            if not len(kept.at):
                continue
            segment, base, n = kept.rows(STRIDE)
            single = _folded(segment, idf[kept.word], basis, column[kept.word], n)
            text_of = np.repeat(np.arange(len(base)), np.diff(np.r_[base, n]))
            pair = single.copy()
            inner = np.flatnonzero(text_of[1:] == text_of[:-1])
            pair[inner] += single[inner + 1]
            hits: dict[tuple[int, int], float] = {}
            for a in range(0, n, 4096):
                best = np.full((min(4096, n - a), len(items.ids)), -1, np.float32)
                for folded in (single, pair):
                    part = folded[a : a + 4096]
                    size = np.linalg.norm(part, axis=1)
                    cosine = (part / np.maximum(size, 1e-9)[:, None]) @ latent
                    if len(items.pieces) == len(items.ids):
                        best = np.maximum(best, cosine)
                    else:
                        starts = np.flatnonzero(np.r_[True, items.piece_of[1:] != items.piece_of[:-1]])
                        best = np.maximum(best, np.maximum.reduceat(cosine, starts, axis=1))
                for r, j in zip(*np.nonzero(best >= COSINE), strict=True):
                    hits[a + int(r), int(j)] = float(best[r, j])
            for length, keys, owner, seen in items.runs:  # words in a row
                key = _run_keys(kept.word, length)
                same = np.flatnonzero(seen[(key >> U64(44)).astype(np.int64)])
                same = same[(kept.at[same + length - 1] - kept.at[same] == length - 1) & (kept.text[same + length - 1] == kept.text[same])]
                left, right = np.searchsorted(keys, key[same], "left"), np.searchsorted(keys, key[same], "right")
                for i, x, y in zip(same[right > left].tolist(), left[right > left].tolist(), right[right > left].tolist(), strict=True):
                    for j in owner[x:y].tolist():
                        hits.setdefault((int(segment[i]), j), -1.0)
            if not hits:
                continue
            where = np.array(list(hits), np.int64)
            cosines = np.array(list(hits.values()))
            s, item = where[:, 0], where[:, 1]
            t = text_of[s]
            begin = kept.first[t] + (s - base[t]) * STRIDE
            first = np.maximum(kept.first[t], begin - items.lengths[item])
            last = np.minimum(kept.first[t + 1], begin + WINDOW + items.lengths[item])
            lo, hi = np.searchsorted(kept.at, first), np.searchsorted(kept.at, last)
            good = np.flatnonzero(_bounded_overlap(kept, items, lo, hi, item) >= np.minimum(PARTLY * items.lengths[item], RUN))
            found: dict[tuple[int, int], tuple] = {}
            for c in good.tolist():
                j, near = int(item[c]), kept.word[lo[c] : hi[c]]
                words = items.words[j]
                coverage = lcs(words, near) / len(words)
                run_found = False
                if coverage < COVERED and len(words) > RUN:
                    whole = np.full(int(last[c] - first[c]), -1, np.int32)
                    whole[kept.at[lo[c] : hi[c]] - first[c]] = near
                    run_found = has_run(words, whole, RUN)
                if coverage < PARTLY and not run_found:
                    continue
                answer = lcs(items.answers[j], near) / len(items.answers[j])
                cosine = cosines[c]
                if cosine < 0:
                    own = pair[s[c]]
                    cosine = float((own @ latent[:, items.piece_of == j]).max() / max(float(np.linalg.norm(own)), 1e-9))
                seen_words, tf = np.unique(words, return_counts=True)
                value = squares[seen_words] * tf**2
                same = value[np.isin(seen_words, near)].sum() >= WEIGHT * value.sum() or cosine >= NEAR
                contaminated = coverage >= COVERED or run_found or (coverage >= PARTLY and answer >= ANSWER and bool(same))
                key, row = (int(kept.ids[t[c]]), items.ids[j]), (contaminated, coverage, answer, cosine, len(words))
                found[key] = max(found.get(key, row), row)
            if found:
                keys, values = list(found), list(found.values())
                columns = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)] + [pa.array([float(v[i]) for v in values], pa.float64()) for i in (3, 1, 2)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([v[4] for v in values], pa.int64()), pa.array([bool(v[0]) for v in values], pa.bool_())], names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK) -> DataFrame:
    """Pairs of a document and a benchmark item it holds: doc_id, item_id, cosine (latent), coverage, answer, n_words.

    docs has doc_id and text, benchmark has item_id and text. coverage and answer are the shares of the
    item's words, and of its last sentence's, in the longest common subsequence with the document's words
    around the best passage. A pair is given if coverage reaches 0.75, or 0.5 with an answer of 0.6 and
    either a latent cosine of 0.7 or a quarter of the item's squared TF-IDF weight in these words, or if 48
    of its words stand there in a row. Case (A-Z) and ASCII punctuation do not count. Null, empty and
    wordless texts match nothing; texts may be of any length; rows without doc_id or item_id are left out;
    repeated rows give one pair. Other columns are ignored. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    path = store.scratch(spark, "leaks")
    blocks = -(-given.count() // item_block)
    found = spark.createDataFrame([], FOUND)
    for block in range(blocks):
        part = given.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text")
        items = Items(part.collect())
        if items.ids:
            found = found.unionByName(_leaks_of(texts, items, f"{path}/{block}"))
    result = store.save(found.filter("contaminated"), f"{path}/found")
    for block in range(blocks):
        store.remove(spark, f"{path}/{block}")
    best = F.max(F.struct("coverage", "answer", "cosine", "n_words")).alias("b")
    return result.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.coverage", "b.answer", "b.n_words")


def _leaks_of(texts: DataFrame, items: Items, path: str) -> DataFrame:
    spark = texts.sparkSession
    table = store.save(texts.mapInArrow(store.freed(_keep(spark.sparkContext.broadcast(items))), KEPT), f"{path}/kept")
    counts = table.select(F.explode("counts").alias("c")).groupBy("c.token").agg(F.sum("c.n").alias("n")).collect()  # a row for each term
    n = {r["token"]: r["n"] for r in counts}
    documents = n.pop(-1, 0)
    if not documents:
        return spark.createDataFrame([], FOUND)
    df = np.zeros(items.terms)
    df[list(n)] = list(n.values())
    idf = (np.log((1 + documents) / (1 + df)) + 0.1).astype(np.float32)
    kept = table.filter("ids is not null").select("ids", "first", "at", "word")
    shared = spark.sparkContext.broadcast((items, idf))
    basis = latent_space(kept, items, idf.astype(np.float64), path)
    column = items.columns()
    latent = np.stack([(basis[column[p]] * idf[p, None]).sum(0) for p in items.pieces], 1)
    latent /= np.maximum(np.linalg.norm(latent, axis=0), 1e-9)
    space = spark.sparkContext.broadcast((basis, latent.astype(np.float32), column))
    return kept.mapInArrow(store.freed(_search(shared, space)), FOUND)
