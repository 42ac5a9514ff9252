"""Hierarchical packing of token ids into context windows of several lengths.

Tiers are powers of two up to the longest window. A document gives whole longest windows first; its rest
goes to the smallest tier that holds it. Each tier is packed best-fit-decreasing into windows of its
length; what a window lacks is filled from shorter tiers, cutting a piece if need be, until it is full
or nothing shorter is left. Full windows of any tier need no padding; what is not full after that is
merged into longest windows. The windows of a chunk are dealt to step groups so that each group gets the
same number of every tier, but for one. All of this is local to a task, in chunks of bounded size, with no shuffle; a task leaves
at most one window with padding for each chunk.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import bytescan as bs
from weftgraph.llm import store
from weftgraph.llm.tokens import CHUNK_BYTES, Encoder, tokenizer_file, with_end

#: Ids that a task holds before it packs them, and windows (in longest ones) of a step group.
CHUNK_IDS, GROUP = 2 << 20, 64
PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def tiers_of(longest: int, smallest: int) -> list[int]:
    out = [longest]
    while out[-1] // 2 >= smallest:
        out.append(out[-1] // 2)
    return out[::-1]


def pack(rests: list[tuple[int, int, int]], longest: int, smallest: int = 128) -> list[list[tuple[int, int, int]]]:
    """Windows, each a list of pieces (document, start, length), of rests shorter than longest.

    Every window but at most one is filled to its tier's length exactly.
    """
    tiers = tiers_of(longest, smallest)
    pool = {t: [] for t in tiers}  # of each tier: (length, document, start), sorted
    for doc, start, length in rests:
        pool[next(t for t in tiers if t >= length)].append((length, doc, start))
    for pieces in pool.values():
        pieces.sort()
    windows, loose = [], []

    def best(tier: int, room: int):
        """Removes the longest piece of this or a shorter tier that fits."""
        for t in reversed([t for t in tiers if t <= tier]):
            pieces = pool[t]
            at = bisect.bisect_right(pieces, (room, 1 << 62, 1 << 62)) - 1
            if at >= 0:
                return pieces.pop(at)
        return None

    def cut(tier: int, room: int):
        """Cuts room ids off the shortest piece of a shorter tier that is longer; its rest goes back."""
        for t in (t for t in tiers if t < tier):
            pieces = pool[t]
            at = bisect.bisect_right(pieces, (room, 1 << 62, 1 << 62))
            if at < len(pieces):
                length, doc, start = pieces.pop(at)
                rest = length - room
                bisect.insort(pool[next(t for t in tiers if t >= rest)], (rest, doc, start + room))
                return (room, doc, start)
        return None

    for tier in reversed(tiers):
        while pool[tier]:
            length, doc, start = pool[tier].pop()
            window, room = [(doc, start, length)], tier - length
            while room:
                piece = best(tier, room) or cut(tier, room)
                if piece is None:
                    break
                window.append((piece[1], piece[2], piece[0]))
                room -= piece[0]
            if room:
                loose.append(window)
            else:
                windows.append(window)
    # windows that could not be filled (no shorter piece was left): their pieces run on into longest windows
    window, room = [], longest
    for doc, start, length in (piece for w in loose for piece in w):
        while length:
            take = min(room, length)
            window.append((doc, start, take))
            start, length, room = start + take, length - take, room - take
            if not room:
                windows.append(window)
                window, room = [], longest
    if window:
        windows.append(window)
    return windows


def step_groups(windows: np.ndarray, longest: int) -> np.ndarray:
    """A step group for each window (given by its tier): as many groups as hold GROUP longest windows each,
    and each of them gets the same number of windows of every tier, but for one."""
    groups = max(1, -(-int(windows.sum()) // (GROUP * longest)))
    out, first = np.zeros(len(windows), np.int64), 0
    for tier in np.unique(windows)[::-1]:
        which = np.flatnonzero(windows == tier)
        out[which] = (first + np.arange(len(which))) % groups  # the next tier goes on where this one ended
        first = (first + len(which)) % groups
    return out


def _pieces(tokenizer: str, end_id: int, longest: int, smallest: int, chunk_ids: int, special_as_text: bool):
    names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]

    def run(batches):
        encoder, part = Encoder.of(tokenizer_file(tokenizer), special_as_text), TaskContext.get().partitionId()
        sequence, group = 0, 0
        doc_ids, held, sizes, size = [], [], [], 0

        def out():
            nonlocal sequence, group
            flat, names_of, length = np.concatenate(held), np.concatenate(doc_ids), np.concatenate(sizes)
            begin = np.cumsum(length) - length
            whole = length // longest
            each = np.repeat(np.arange(len(length)), whole)
            step = np.arange(len(each)) - np.repeat(np.cumsum(whole) - whole, whole)
            rest = np.flatnonzero(length % longest)
            made = pack([(int(i), int(whole[i] * longest), int(length[i] % longest)) for i in rest], longest, smallest)
            pieces = np.array([p for w in made for p in w], np.int64).reshape(-1, 3)
            of = np.repeat(np.arange(len(made)), [len(w) for w in made]) + len(each)
            doc, start = np.concatenate([each, pieces[:, 0]]), np.concatenate([step * longest, pieces[:, 1]])
            n, of = np.concatenate([np.full(len(each), longest), pieces[:, 2]]), np.concatenate([np.arange(len(each)), of])
            total = np.bincount(of, n).astype(np.int64)
            tier = np.where(total & (total - 1) == 0, total, longest)
            dealt = step_groups(tier, longest)
            offset = np.cumsum(n) - n
            offset -= offset[np.searchsorted(of, of)]
            for a in range(0, len(doc), 4000):
                b = min(a + 4000, len(doc))
                d, w, size = doc[a:b], of[a:b], n[a:b]
                ends = np.cumsum(size)
                ids = flat[np.repeat(begin[d] + start[a:b] - ends + size, size) + np.arange(ends[-1])]
                columns = [names_of[d], start[a:b], size, None, length[d], (part << 36) | (sequence + w), offset[a:b], tier[w].astype(np.int32), (part << 36) | (group + dealt[w])]
                yield pa.RecordBatch.from_arrays([bs.binary(ids, np.r_[0, ends]) if c is None else pa.array(c) for c in columns], names=names)
            sequence += len(total)
            group += int(dealt.max()) + 1

        for batch in batches:
            data, offsets = bs.utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b in bs.pieces(offsets, CHUNK_BYTES):
                found, at = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                found, at = with_end(found, at, end_id)
                doc_ids.append(ids[a:b])
                held.append(found)
                sizes.append(np.diff(at))
                size += len(found)
                if size >= chunk_ids:
                    yield from out()
                    doc_ids, held, sizes, size = [], [], [], 0
        if held:
            yield from out()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, longest: int = 2048, smallest: int = 128, chunk_ids: int = CHUNK_IDS, special_as_text: bool = False) -> DataFrame:
    """Pieces of every row of docs (doc_id, text): doc_id, start, length, ids (little-endian u32 bytes),
    doc_tokens, sequence_id, offset, tier (the window's length) and step_group.

    Each id of each document, and the end id after it, lies in exactly one piece. A sequence is a window
    of a tier's length; one that is not full is padded to the longest. The string of a special token in a
    text gives that token's id, as the library does by default, or is ordinary text if special_as_text. Null texts are empty (only the end
    id). Texts may be of any length. Rows without doc_id are left out; repeated rows are packed as they come. Other columns are
    ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
    return rows.mapInArrow(store.freed(_pieces(tokenizer, end_id, longest, smallest, chunk_ids, special_as_text)), PIECE_SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The ids of each piece as their CRC-32."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
