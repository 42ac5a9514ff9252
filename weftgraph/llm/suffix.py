"""Removal of repeated byte strings by distributed prefix doubling over sampled suffixes.

A byte goes if a string of THRESHOLD bytes that covers it also starts in a document with a smaller
doc_id. All strings are judged on the input; matches never cross documents.

1. Whole copies. Documents are grouped by their 128-bit digest; only the least doc_id of each group
   goes on, so a hot group of copies is settled by an aggregation that combines before its shuffle.
2. Round 0, offset 16. Each window of THRESHOLD bytes is led by the position in it whose 16-byte
   prefix has the least hash (equal windows have equal leaders, about one position in 18 leads any).
   Spark groups the leaders' prefixes; leaders whose prefix is unique, and their windows, are settled.
3. Whole contexts. A surviving leader's context is all windows it leads. Contexts are sorted by prefix and
   content; those that a smaller doc_id has too are settled, and so are those that are alone with their
   prefix. Of the rest, one context of each content goes on with its bytes.
4. Doubling, offsets 8, 16 and 18 (to lengths 16, 32 and 50). These bytes are sent to the task that owns
   their prefix (of a prefix with very many contents, each window goes to the task that owns the window).
   There, prefix by prefix in slices of bounded size, the positions' (rank, rank at the offset) pairs are sorted
   and reranked at each offset; positions that become unique drop out. Windows of equal rank at the
   threshold are equal strings: all but those of the least doc_id go. These ranks come from sorting
   the bytes themselves, not from hashes.
5. Each batch of documents applies the marks that come back.

The batches' texts are written dealt out by batch, each task into one bucket, so they are not shuffled
again; what is joined with them later moves, not they.
Positions are packed into arrays, a row for each batch and bucket, so Spark moves few large rows. Equal
contexts within a batch are sent once, with the least doc_id. A prefix that many batches hold is hot:
its windows are dealt out by their whole THRESHOLD bytes instead.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftgraph.llm import bytescan as bs
from weftgraph.llm import store

U64 = np.uint64
#: Bytes that a removed string has at least, and bytes of the first prefix.
THRESHOLD, SEED = 50, 16
#: Bytes of text in one batch, and batches that must hold a prefix before it counts as hot.
BATCH_BYTES, HOT_BATCHES = 1 << 20, 4000
#: Contents of one prefix up to which one task compares them; bytes of contexts that are ranked at a time.
HOT_CONTENTS, SLICE_BYTES = 20_000, 1 << 19
HIGH = U64(0xFFFFFFFF00000000)
LOW = U64(0xFFFFFFFF)


# --- batches -----------------------------------------------------------------------------------------


def _pack(obj) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(obj, 5))


def _unpack(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _make_batches(batches, limit: int, carry: list[str], buckets: int):
    """Rows (doc_id, text, original, carried columns) into one row per batch; whole copies keep only their length."""
    ids, texts, first, size = [], [], [], 0
    rest = [[] for _ in carry]
    numbers = store.keys_in_bucket(TaskContext.get().partitionId(), buckets)

    def out():
        blob = _pack((np.array(ids, np.int64), np.array(first, bool), texts, rest))
        return pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), pa.array([blob], pa.binary())], names=["batch", "blob"])

    for batch in batches:
        data, offsets = bs.utf8(batch.column("text"))
        raw = data.tobytes()
        others = [batch.column(f"carry{j}").to_pylist() for j in range(len(carry))]
        for i, (doc_id, original) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("original").to_pylist(), strict=True)):
            text = raw[offsets[i] : offsets[i + 1]]
            ids.append(doc_id)
            first.append(original)
            for values, column in zip(rest, others, strict=True):
                values.append(column[i])
            texts.append(text if original or len(text) < THRESHOLD else len(text))
            size += len(text) + 64 if original else 64
            if size >= limit:
                yield out()
                ids, texts, first, size = [], [], [], 0
                rest = [[] for _ in carry]
    if ids:
        yield out()


class Leaders:
    """Runs of windows with the same leader, over the original documents of one batch."""

    def __init__(self, ids, original, texts, _=None):
        self.which = np.array([i for i in range(len(ids)) if original[i] and len(texts[i]) >= THRESHOLD], np.int64)
        kept = [texts[i] for i in self.which]
        self.ids = ids[self.which]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in kept])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(kept), np.uint8)
        n = len(self.data)
        if n < THRESHOLD:
            self.start = self.last = self.at = self.doc = np.zeros(0, np.int64)
            self.prefix = np.zeros(0, U64)
            return
        h, step, salt = bs.BYTE_VALUE[self.data], 1, 1
        while step < SEED:
            more = min(step, SEED - step)
            h = bs.join_hash(h[:-more], h[more:], salt)
            step, salt = step + more, salt + 1
        low = (h & HIGH) | np.arange(len(h), dtype=U64)
        width, span = THRESHOLD - SEED + 1, 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        leader = (low & LOW).astype(np.int64)  # of the window at each position
        inside = np.zeros(n + 1, np.int32)
        np.add.at(inside, self.offsets[:-1], 1)
        np.add.at(inside, self.offsets[1:] - THRESHOLD + 1, -1)
        window = np.flatnonzero(np.cumsum(inside[:-1])[: len(leader)] > 0)
        doc = np.searchsorted(self.offsets, window, "right") - 1
        lead = leader[window]
        new = np.flatnonzero(np.r_[True, (lead[1:] != lead[:-1]) | (doc[1:] != doc[:-1])])
        self.start = window[new]
        self.last = window[np.r_[new[1:] - 1, len(window) - 1]]
        self.at, self.doc = lead[new], doc[new]
        self.prefix = h[self.at]


# --- round 0 -----------------------------------------------------------------------------------------


def _bucket(prefix: np.ndarray, buckets: int) -> np.ndarray:
    """Even buckets: leaders have small hashes, so the hash itself is not even."""
    return ((bs.mix(prefix) >> U64(40)) * U64(buckets)) >> U64(24)


def _round0(buckets: int):
    def run(batches):
        for batch in batches:
            for number, blob in zip(batch.column("batch").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                found = Leaders(*_unpack(blob))
                prefix = np.unique(found.prefix)
                bucket = _bucket(prefix, buckets)
                order = np.argsort(bucket, kind="stable")
                prefix, bucket = prefix[order], bucket[order]
                edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(prefix) else np.zeros(0, np.int64)
                ends = np.r_[edge[1:], len(prefix)]
                rows = [(int(bucket[a]), prefix[a:b].tobytes()) for a, b in zip(edge, ends, strict=True)] if len(prefix) else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "batch", "prefixes"])

    return run


def _repeated(table: pa.Table, hot_batches: int) -> pa.Table:
    """Of the prefixes of one bucket, those that several batches hold, and those that very many hold."""
    lists = [np.frombuffer(x, U64) for x in table.column("prefixes").to_pylist()]
    value, count = np.unique(np.concatenate(lists), return_counts=True)
    many, hot = value[count > 1], value[count > hot_batches]
    return pa.table(
        {
            "batch": table.column("batch"),
            "many": pa.array([np.intersect1d(x, many, assume_unique=True).tobytes() for x in lists], pa.binary()),
            "hot": pa.array([np.intersect1d(x, hot, assume_unique=True).tobytes() for x in lists], pa.binary()),
        }
    )


# --- doubling ----------------------------------------------------------------------------------------

CONTEXT = np.dtype([("owner", "u8"), ("content", "u8"), ("doc_id", "i8"), ("doc", "i4"), ("start", "i4"), ("lead", "i2"), ("length", "i2")])
MARK = np.dtype([("doc", "i4"), ("start", "i4"), ("bits", "u8")])


def _contexts(buckets: int):
    """Of each batch: marks that it can set alone (kind 0), and the contexts that other batches may repeat (kind 1)."""

    def rows_of(number, found, many, hot):
        alive = np.isin(found.prefix, many)
        value, count = np.unique(found.prefix, return_counts=True)
        alive |= np.isin(found.prefix, value[count > 1])
        if not alive.any():
            return []
        start, last, at, doc, prefix = (x[alive] for x in (found.start, found.last, found.at, found.doc, found.prefix))
        sums = bs.prefix_sums(found.data)
        is_hot = np.isin(prefix, hot)
        if is_hot.any():  # one context for each window, owned by the window's bytes
            reps = np.where(is_hot, last - start + 1, 1)
            each = np.repeat(np.arange(len(start)), reps)
            step = np.arange(len(each)) - np.repeat(np.cumsum(reps) - reps, reps)
            warm = is_hot[each]
            start, last, at, doc, prefix = np.where(warm, start[each] + step, start[each]), np.where(warm, start[each] + step, last[each]), at[each], doc[each], prefix[each].copy()
            prefix[warm] = bs.span_hash(sums, start[warm], start[warm] + THRESHOLD)
        content = bs.join_hash(bs.span_hash(sums, start, last + THRESHOLD), (at - start).astype(U64), 9)
        order = np.lexsort((found.ids[doc], content, prefix))
        same = np.r_[False, (content[order][1:] == content[order][:-1]) & (prefix[order][1:] == prefix[order][:-1])]
        lead_of = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        copy = same & (found.ids[doc[order]] > found.ids[doc[lead_of]])
        # equal contexts of one batch: all but the least doc_id are settled here; the others of that doc_id go too
        gone = order[copy]
        marks = np.zeros(len(gone), MARK)
        marks["doc"], marks["start"] = found.which[doc[gone]], start[gone] - found.offsets[doc[gone]]
        marks["bits"] = (U64(1) << (last[gone] - start[gone] + 1).astype(U64)) - U64(1)
        out = [(number % buckets, number, 0, marks.tobytes())] if len(marks) else []
        send = order[~copy]
        bucket = _bucket(prefix[send], buckets)
        rank = np.argsort(bucket, kind="stable")
        send, bucket = send[rank], bucket[rank]
        if not len(send):
            return out
        head = np.zeros(len(send), CONTEXT)
        head["owner"], head["content"], head["doc_id"], head["doc"] = prefix[send], content[send], found.ids[doc[send]], found.which[doc[send]]
        head["start"], head["lead"], head["length"] = start[send] - found.offsets[doc[send]], at[send] - start[send], last[send] + THRESHOLD - start[send]
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        return out + [(int(bucket[a]), number, 1, head[a:b].tobytes()) for a, b in zip(edge, np.r_[edge[1:], len(send)], strict=True)]

    def run(batches):
        for batch in batches:
            for number, blob, many, hot in zip(*(batch.column(c).to_pylist() for c in ("batch", "blob", "many", "hot")), strict=True):
                join = lambda lists: np.frombuffer(b"".join(lists or []), U64)
                rows = rows_of(number, Leaders(*_unpack(blob)), join(many), join(hot))
                if rows:
                    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["bucket", "batch", "kind", "head"])

    return run


def _settle(table: pa.Table, hot_contents: int) -> pa.Table:
    """Whole contexts of one bucket: those that a smaller doc_id has too are marked; of prefixes with several
    contents, one context of each content is asked for (kind 1; kind 2 where there are very many contents). Marks
    that batches have set stay marks."""
    is_head = pc.equal(table.column("kind"), 1)
    set_before = table.filter(pc.invert(is_head)).select(["batch", "kind", "head"])
    table = table.filter(is_head)
    if not len(table):
        return set_before
    heads = [np.frombuffer(x, CONTEXT) for x in table.column("head").to_pylist()]
    rows = np.repeat(np.arange(len(heads)), [len(x) for x in heads])
    head = np.concatenate(heads)
    order = np.lexsort((head["doc_id"], head["content"], head["owner"]))
    h = head[order]
    other = np.r_[True, h["owner"][1:] != h["owner"][:-1]]
    new = other | np.r_[True, h["content"][1:] != h["content"][:-1]]
    least = h["doc_id"][np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    contents = np.bincount(np.cumsum(other) - 1, new)[np.cumsum(other) - 1]
    full = np.zeros(len(head), bool)
    full[order] = h["doc_id"] > least
    ask = np.zeros(len(head), bool)
    ask[order] = (h["doc_id"] == least) & (contents > 1)
    hot = np.zeros(len(head), bool)
    hot[order] = contents > hot_contents
    marks = np.zeros(len(head), MARK)
    marks["doc"], marks["start"] = head["doc"], head["start"]
    marks["bits"] = (U64(1) << (head["length"] - THRESHOLD + 1).astype(U64)) - U64(1)
    edge = np.cumsum([0, *map(len, heads)])
    out = []
    for number, a, b in zip(table.column("batch").to_pylist(), edge[:-1], edge[1:], strict=True):
        for kind, what, chosen in ((0, marks, full), (1, head, ask & ~hot), (2, head, ask & hot)):
            if chosen[a:b].any():
                out.append((number, kind, what[a:b][chosen[a:b]].tobytes()))
    found = pa.table({"batch": pa.array([r[0] for r in out], pa.int64()), "kind": pa.array([r[1] for r in out], pa.int32()), "head": pa.array([r[2] for r in out], pa.binary())})
    return pa.concat_tables([set_before.cast(found.schema), found])


def _windows(head: np.ndarray, texts: list) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Each window of some contexts as a context of its own, owned by its bytes; equal ones once, and marks for the others of a larger doc_id."""
    each = (head["length"] - THRESHOLD + 1).astype(np.int64)
    out = np.repeat(head, each)
    out["start"] += (np.arange(len(out)) - np.repeat(np.cumsum(each) - each, each)).astype(np.int32)
    out["length"], out["lead"] = THRESHOLD, 0
    bodies = [texts[d][a : a + THRESHOLD] for d, a in zip(out["doc"].tolist(), out["start"].tolist(), strict=True)]
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    at = np.arange(len(out)) * THRESHOLD
    out["owner"] = bs.span_hash(bs.prefix_sums(flat), at, at + THRESHOLD)
    _, same = np.unique(flat.reshape(-1, THRESHOLD).view(f"V{THRESHOLD}")[:, 0], return_inverse=True)
    order = np.lexsort((out["start"], out["doc_id"], same))
    new = np.r_[True, same[order][1:] != same[order][:-1]]
    least = out["doc_id"][order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    gone = order[out["doc_id"][order] > least]
    marks = np.zeros(len(gone), MARK)
    marks["doc"], marks["start"], marks["bits"] = out["doc"][gone], out["start"][gone], 1
    kept = np.sort(order[out["doc_id"][order] == least])  # a repeat within one document may go to other documents' marks too
    return out[kept], marks, [bodies[i] for i in kept.tolist()]


def _cut(buckets: int):
    """Bytes of the contexts that a batch is asked for, dealt out by their owners; marks that it can set alone have no body."""

    def run(batches):
        for batch in batches:
            for number, blob, asked, hot in zip(*(batch.column(c).to_pylist() for c in ("batch", "blob", "asked", "hot")), strict=True):
                texts = _unpack(blob)[2]
                head = np.frombuffer(b"".join(asked or []), CONTEXT)
                bodies = [texts[d][a : a + n] for d, a, n in zip(head["doc"].tolist(), head["start"].tolist(), head["length"].tolist(), strict=True)]
                rows = []
                if warm := b"".join(hot or []):
                    more, marks, more_bodies = _windows(np.frombuffer(warm, CONTEXT), texts)
                    head, bodies = np.concatenate([head, more]), bodies + more_bodies
                    if len(marks):
                        rows.append((number % buckets, marks.tobytes(), None))
                bucket = _bucket(head["owner"], buckets)
                order = np.argsort(bucket, kind="stable")
                head, bucket = head[order], bucket[order]
                bodies = [bodies[i] for i in order.tolist()]
                edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(head) else np.zeros(0, np.int64)
                ends = np.r_[edge[1:], len(head)]
                rows += [(int(bucket[a]), head[a:b].tobytes(), b"".join(bodies[a:b])) for a, b in zip(edge, ends, strict=True)] if len(head) else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["bucket", "batch", "head", "body"])

    return run


def _rerank(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the pairs (a, b) in sorted order, and the number of positions that share each one's rank."""
    _, rank, count = np.unique((a.astype(U64) << U64(32)) | b.astype(U64), return_inverse=True, return_counts=True)
    return rank, count[rank]


def _ranked(head: np.ndarray, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sorts rank pairs of the positions of some contexts at growing offsets; for each context the bits of its
    windows that a smaller doc_id holds. Contexts of one owner must all be among them."""
    marks = np.zeros(len(head), U64)
    length = head["length"].astype(np.int64)
    ends = np.cumsum(length)
    of = np.repeat(np.arange(len(head)), length)
    step = np.arange(ends[-1]) - (ends - length)[of]
    left = length[of] - step
    data = data[begin[of] + step]
    number = np.zeros(len(data), U64)  # eight bytes as one number are their own rank
    for i in range(8):
        number[: len(data) - i] |= data[i:].astype(U64) << U64(8 * (7 - i))
    _, rank8 = np.unique(number, return_inverse=True)
    at = np.flatnonzero(left >= 16)
    rank = np.zeros(len(data), np.int64)
    rank[at], size = _rerank(rank8[at], rank8[at + 8])
    window = left[at] >= THRESHOLD
    window = at[window & (size > 1)]  # unique positions drop out, here and below
    if len(window):
        at = np.unique(np.concatenate([window, window + THRESHOLD - 32]))
        rank32 = np.zeros(len(data), np.int64)
        rank32[at], size = _rerank(rank[at], rank[at + 16])
        window = window[size[np.searchsorted(at, window)] > 1]
    if len(window):
        rank, size = _rerank(rank32[window], rank32[window + THRESHOLD - 32])
        least = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
        ids = head["doc_id"][of[window]]
        np.minimum.at(least, rank, ids)
        gone = least[rank] < ids
        np.bitwise_or.at(marks, of[window[gone]], U64(1) << step[window[gone]].astype(U64))
    return marks


def _double(table: pa.Table) -> pa.Table:
    """Marks of the windows of one bucket's contexts that a smaller doc_id holds, a slice of owners at a time. Marks
    that batches have set stay marks."""
    is_mark = pc.is_null(table.column("body"))
    set_before = table.filter(is_mark).select(["batch", "head"])
    table = table.filter(pc.invert(is_mark))
    if not len(table):
        return set_before
    heads = [np.frombuffer(x, CONTEXT) for x in table.column("head").to_pylist()]
    rows = np.repeat(np.arange(len(heads)), [len(x) for x in heads])
    head = np.concatenate(heads)
    data = np.frombuffer(b"".join(table.column("body").to_pylist()), np.uint8)
    length = head["length"].astype(np.int64)
    begin = np.cumsum(length) - length
    _, back, count = np.unique(head["owner"], return_inverse=True, return_counts=True)
    live = np.flatnonzero(count[back] > 1)  # contexts whose owner is alone here are settled
    live = live[np.argsort(back[live], kind="stable")]
    marks = np.zeros(len(head), U64)
    size = np.cumsum(length[live])
    last = np.flatnonzero(np.r_[back[live][1:] != back[live][:-1], True]) + 1 if len(live) else np.zeros(0, np.int64)
    first = 0
    while first < len(live):
        fits = np.searchsorted(size[last - 1], (size[first - 1] if first else 0) + SLICE_BYTES, "right")
        stop = int(last[max(fits - 1, np.searchsorted(last, first, "right"))])
        some = live[first:stop]
        marks[some] = _ranked(head[some], data, begin[some])
        first = stop
    hit = np.flatnonzero(marks)
    found = np.zeros(len(hit), MARK)
    found["doc"], found["start"], found["bits"] = head["doc"][hit], head["start"][hit], marks[hit]
    edge = np.searchsorted(rows[hit], np.arange(len(heads) + 1))
    each = [found[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    keep = [i for i, x in enumerate(each) if x]
    batches = table.column("batch").to_pylist()
    marked = pa.table({"batch": pa.array([batches[i] for i in keep], pa.int64()), "head": pa.array([each[i] for i in keep], pa.binary())})
    return pa.concat_tables([set_before.cast(marked.schema), marked])


# --- result ------------------------------------------------------------------------------------------


def _apply(batches, schema: pa.Schema):
    """Marks of a batch onto its documents. schema: of the result, from the sixth column on what was carried.

    Where the fifth column is a string, characters of which only a part stayed go too."""
    as_text = pa.types.is_string(schema[4].type)
    for batch in batches:
        for blob, marks in zip(batch.column("blob").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            ids, _, texts, rest = _unpack(blob)
            mark = np.frombuffer(b"".join(marks or []), MARK)
            mark = mark[np.argsort(mark["doc"], kind="stable")]
            edge = np.searchsorted(mark["doc"], np.arange(len(ids) + 1))
            rows = []
            for i, text in enumerate(texts):
                if isinstance(text, int):  # a whole copy of a smaller doc_id
                    rows.append((int(ids[i]), text, text, 1, b""))
                elif edge[i] == edge[i + 1]:
                    rows.append((int(ids[i]), len(text), 0, 0, text))
                else:
                    some = mark[edge[i] : edge[i + 1]]
                    bit = (some["bits"][:, None] >> np.arange(64, dtype=U64)) & U64(1)
                    row, step = np.nonzero(bit)
                    start = np.unique(some["start"][row].astype(np.int64) + step)
                    delta = np.zeros(len(text) + 1, np.int64)
                    np.add.at(delta, start, 1)
                    np.add.at(delta, start + THRESHOLD, -1)
                    gone = np.cumsum(delta[:-1]) > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    rows.append((int(ids[i]), len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
            for a in range(0, len(rows), 2000):
                some = rows[a : a + 2000]
                columns = [[r[i] for r in some] for i in range(4)] + [[r[4].decode("utf-8", "ignore") if as_text else r[4] for r in some]] + [values[a : a + 2000] for values in rest]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def dedup_substrings(docs: DataFrame, carry: tuple[str, ...] = (), batch_bytes: int = BATCH_BYTES, hot_batches: int = HOT_BATCHES, hot_contents: int = HOT_CONTENTS, as_text: bool = False, base: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary: the remaining bytes) of every row of docs (doc_id, text).

    With as_text, kept is a string, without characters of which only a part stayed. Null texts are empty.
    Texts of under 50 bytes never lose a byte; texts may be of any length. Rows without doc_id are left out.
    Repeated rows (equal doc_id) do not remove each other. Columns named in carry follow the result's own;
    other columns are ignored. An empty table gives no rows. Intermediate tables are in the folder base; it may go when the result is written.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    others = [F.col(c).alias(f"carry{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *others).filter("doc_id is not null")
    rows = rows.withColumn("digest", F.md5(F.encode("text", "utf-8")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    base = base or store.scratch(spark, "suffix")
    marked = rows.join(first, ["doc_id", "digest"], "left").select("doc_id", "text", F.coalesce("first", F.lit(False)).alias("original"), *(f"carry{i}" for i in range(len(carry))))
    result = T.StructType([*(T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *(T.StructField(c, docs.schema[c].dataType) for c in carry)])
    arrow = to_arrow_schema(result)
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches = marked.mapInArrow(store.freed(lambda rows: _make_batches(rows, batch_bytes, carry, dealt)), "batch long, blob binary")
    batches = store.save_bucketed(batches, f"{base}/batches", "batch", dealt)

    size = batches.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    buckets = store.parts_for(spark, 2 * size, 4 << 20) * 2
    prefixes = batches.mapInArrow(store.freed(_round0(buckets)), "bucket int, batch long, prefixes binary")
    repeated = prefixes.groupBy("bucket").applyInArrow(store.freed_group(lambda t: _repeated(t, hot_batches)), "batch long, many binary, hot binary").filter("octet_length(many) > 0")
    repeated = store.save(repeated, f"{base}/round0", "uncompressed")

    answers = repeated.groupBy("batch").agg(F.collect_list("many").alias("many"), F.collect_list("hot").alias("hot"))
    contexts = batches.join(answers, "batch", "left").mapInArrow(store.freed(_contexts(buckets)), "bucket int, batch long, kind int, head binary")
    settled = contexts.groupBy("bucket").applyInArrow(store.freed_group(lambda t: _settle(t, hot_contents)), "batch long, kind int, head binary")
    settled = store.save(settled, f"{base}/settled")
    store.remove(spark, f"{base}/round0")

    heads = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("head")))
    asked = settled.filter("kind > 0").groupBy("batch").agg(heads(1).alias("asked"), heads(2).alias("hot"))
    sent = batches.join(asked, "batch").mapInArrow(store.freed(_cut(buckets)), "bucket int, batch long, head binary, body binary")
    doubled = sent.groupBy("bucket").applyInArrow(store.freed_group(_double), "batch long, head binary")
    marks = store.save(doubled.unionByName(settled.filter("kind = 0").select("batch", "head")), f"{base}/marks")
    store.remove(spark, f"{base}/settled")
    marks = marks.groupBy("batch").agg(F.collect_list("head").alias("marks"))
    return batches.join(marks, "batch", "left").mapInArrow(store.freed(lambda rows: _apply(rows, arrow)), result)


def digest(found: DataFrame) -> DataFrame:
    """The kept bytes as their SHA-256."""
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def removed_by_brute_force(rows: list[tuple[int, bytes]]) -> dict[int, tuple[int, int, int, str]]:
    """The same by definition, for tests."""
    least: dict[bytes, int] = {}
    for doc_id, text in rows:
        for i in range(len(text) - THRESHOLD + 1):
            s = text[i : i + THRESHOLD]
            least[s] = min(least.get(s, doc_id), doc_id)
    out = {}
    for doc_id, text in rows:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - THRESHOLD + 1):
            if least[text[i : i + THRESHOLD]] < doc_id:
                gone[i : i + THRESHOLD] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(text) else 0
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out[doc_id] = (len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out
