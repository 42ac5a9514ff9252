"""Token ids as interleaved static rANS: one shared frequency table, independent blocks.

File format: a Parquet dataset with one row per block, in the shared folder, and a dataset with the
frequency table. A block holds whole documents; its payload is

    "WRNS" version u16, log2 of the table's total u16, lanes u32, tokens u64, documents u32, words u64,
    checkpoints u32, crc32 of the ids u32, crc32 of everything after this header u32
    doc_ids i64[documents], tokens of each u64[documents], final states u64[lanes],
    checkpoints (step u64, word u64, states u64[lanes]) each, words u32[words]

Token i is coded by lane i % lanes. A state is in [2**31, 2**63) and gives 32-bit words off. A decoder
can start at the first step or at any checkpoint. All lanes take one vectorised step at a time, and a whole
block is decoded from all of its checkpoints at once, so each step serves the lanes of all its parts.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bytescan as bs
from weftgraph.llm import store
from weftgraph.llm.tokens import CHUNK_BYTES, Encoder, tokenizer_file, with_end

U64 = np.uint64
HEADER = struct.Struct("<4sHHIQIQIII")
LEAST = U64(1) << U64(31)
#: Tokens of a block (a longer document is a block by itself), steps between checkpoints, most lanes.
BLOCK_TOKENS, CHECKPOINT_STEPS, MOST_LANES = 1 << 20, 128, 2048


class Table:
    """Frequencies of all tokens, scaled to a total of 2**bits; every token that occurs keeps at least 1."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens, kind="stable")
        self.total = int(np.sum(counts)) if len(counts) else 0
        self.tokens, counts = np.asarray(tokens, np.int64)[order], np.asarray(counts, np.float64)[order]
        self.bits = max(8, min(20, len(counts).bit_length() + 3))
        total = 1 << self.bits
        if len(counts) > total // 2:
            raise ValueError("more distinct tokens than the table can hold")
        if len(counts):
            freq = np.maximum(1, np.floor(counts / counts.sum() * total)).astype(np.int64)
            extra = total - int(freq.sum())
            if extra >= 0:
                freq[int(np.argmax(freq))] += extra
            while (over := int(freq.sum()) - total) > 0:  # take from the largest ones
                big = np.argsort(-freq, kind="stable")[: max(1, min(over, (freq > 1).sum() // 2 or 1))]
                take = np.minimum(freq[big] - 1, max(1, over // len(big)))
                cut = np.minimum(np.cumsum(take), over)
                freq[big] -= np.diff(cut, prepend=0)
        else:
            freq = np.zeros(0, np.int64)
        self.freq = freq.astype(U64)
        self.start = (np.cumsum(freq) - freq).astype(U64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
        width = int(self.tokens[-1]) + 1 if len(self.tokens) else 0
        self.index = np.full(width, -1, np.int32)
        self.index[self.tokens] = np.arange(len(self.tokens), dtype=np.int32)


def encode_block(table: Table, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The payload of one block."""
    n = len(ids)
    lanes = max(1, min(MOST_LANES, n // 512))
    shift, states = U64(table.bits), np.full(lanes, LEAST, U64)
    symbol = table.index[ids]
    if n and symbol.min() < 0:
        raise ValueError("a token is missing in the frequency table")
    freq, start = table.freq[symbol], table.start[symbol]
    limit = freq << (U64(63) - shift)
    out, checkpoints, steps = [], [], -(-n // lanes)
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x, f = states[: b - a], freq[a:b]
        over = x >= limit[a:b]
        if over.any():
            out.append((x[over] & U64(0xFFFFFFFF)).astype("<u4"))
            x[over] >>= U64(32)
        else:
            out.append(np.zeros(0, "<u4"))
        quotient, rest = np.divmod(x, f)
        states[: b - a] = (quotient << shift) + rest + start[a:b]
        if step and step % CHECKPOINT_STEPS == 0:
            checkpoints.append((step, states.copy()))
    sizes = np.array([len(w) for w in out[::-1]], np.int64)
    before = np.concatenate([[0], np.cumsum(sizes)])
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    body = [doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), states.astype("<u8").tobytes()]
    body += [struct.pack("<QQ", step, int(before[step])) + kept.astype("<u8").tobytes() for step, kept in checkpoints[::-1]]
    body = b"".join([*body, words.tobytes()])
    head = (b"WRNS", 1, table.bits, lanes, n, len(doc_ids), len(words), len(checkpoints), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body))
    return HEADER.pack(*head) + body


class Block:
    """A payload, read: doc_ids, lengths, and decode()."""

    def __init__(self, table: Table, payload: bytes):
        magic, version, bits, self.lanes, self.n, docs, words, checkpoints, self.crc, crc = HEADER.unpack_from(payload)
        body = memoryview(payload)[HEADER.size :]
        if magic != b"WRNS" or version != 1 or bits != table.bits or zlib.crc32(body) != crc:
            raise ValueError("damaged block")
        self.table, at = table, 0

        def read(kind, count):
            nonlocal at
            found = np.frombuffer(body, kind, count, at)
            at += found.nbytes
            return found

        self.doc_ids, self.lengths = read("<i8", docs), read("<u8", docs).astype(np.int64)
        self.entry = {0: (0, read("<u8", self.lanes))}
        for _ in range(checkpoints):
            step, word = (int(v) for v in read("<u8", 2))
            self.entry[step] = (word, read("<u8", self.lanes))
        self.words = read("<u4", words)

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the steps from a checkpoint (or 0) up to another one (or the end), from all checkpoints between at once."""
        table, lanes, n = self.table, self.lanes, self.n
        steps = -(-n // lanes)
        last = steps if last is None else last
        begins = np.array(sorted(step for step in self.entry if first <= step < max(last, first + 1)), np.int64)
        ends = np.append(begins[1:], last)
        word = np.array([self.entry[step][0] for step in begins], np.int64)
        states = np.stack([self.entry[step][1] for step in begins])
        shift, mask = U64(table.bits), (U64(1) << U64(table.bits)) - U64(1)
        longest = int((ends - begins).max(initial=0))
        out = np.zeros((len(begins), longest, lanes), np.int32)
        for j in range(longest):
            live = int(np.count_nonzero(begins + j < ends))  # only the last part can be shorter
            x = states[:live]
            slot = x & mask
            symbol = table.symbol[slot]
            out[:live, j] = symbol
            x = table.freq[symbol] * (x >> shift) + slot - table.start[symbol]
            under = x < LEAST
            if begins[live - 1] + j == steps - 1 and n % lanes:
                under[-1, n % lanes :] = False  # lanes that the last step does not have
            taken = np.cumsum(under, axis=1)
            x[under] = (x[under] << U64(32)) | self.words[(word[:live, None] + taken - 1)[under]]
            word[:live] += taken[:, -1]
            states[:live] = x
        flat = np.concatenate([out[i, : e - b].reshape(-1) for i, (b, e) in enumerate(zip(begins, ends, strict=True))]) if len(begins) else out.reshape(-1)
        ids = table.tokens[flat[: min(n, last * lanes) - first * lanes]].astype("<u4")
        if first == 0 and last == steps and zlib.crc32(ids.tobytes()) != self.crc:
            raise ValueError("the ids of a block do not match their checksum")
        return ids


TOKENS = "doc_id long, ids binary, counts array<struct<token:int,n:bigint>>"


def _tokenise(tokenizer: str, end_id: int, kind: str):
    """Ids of each row; at the end of a partition, a row without doc_id with the occurrences of each id in it."""
    counted = pa.list_(pa.struct([("token", pa.int32()), ("n", pa.int64())]))

    def run(batches):
        encoder, total = Encoder.of(tokenizer_file(tokenizer)), np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = bs.utf8(batch.column("text"))
            for a, b in bs.pieces(offsets, 2 * CHUNK_BYTES):
                ids, at = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids, at = with_end(ids, at, end_id)
                found = np.bincount(ids, minlength=len(total))
                found[: len(total)] += total
                total = found
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), bs.binary(ids.astype(kind), at), pa.nulls(b - a, counted)], names=["doc_id", "ids", "counts"])
        seen = np.flatnonzero(total)
        if len(seen):
            pairs = pa.StructArray.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["token", "n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([b""], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(seen)], pa.int32()), pairs)], names=["doc_id", "ids", "counts"])

    return run


def _encode(table, block_tokens: int, kind: str):
    width = np.dtype(kind).itemsize
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("start", pa.int64()), ("tokens", pa.int64()), ("documents", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        frequencies, part = table.value, TaskContext.get().partitionId()
        doc_ids, held, size, block, start = [], [], 0, 0, 0

        def out():
            lengths = np.array([len(x) // width for x in held], np.int64)
            payload = encode_block(frequencies, np.array(doc_ids, np.int64), lengths, np.frombuffer(b"".join(held), kind).astype("<u4"))
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in (part, block, start, size, len(held))), pa.array([payload], pa.binary())], schema=schema)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if held and size + len(ids) // width > block_tokens:
                    yield out()
                    doc_ids, held, size, block, start = [], [], 0, block + 1, start + size
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids) // width
        if held:
            yield out()

    return run


def encode(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes the ids of every text of docs (doc_id, text), and end_id after each, in ascending doc_id order to path.

    The library encodes each text with add_special_tokens=False; the string of a special token in a text
    gives that token's id, as it does by default there. Null texts are empty (only the end id). Texts may
    be of any length: a long one is a block by itself. Rows without doc_id are left out; rows of equal doc_id follow
    one another in the order of a hash of their ids. An empty table gives an empty dataset.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
    kind = "<u2" if max(end_id + 1, Encoder.of(tokenizer_file(tokenizer)).tokenizer.get_vocab_size()) <= 1 << 16 else "<u4"
    base = store.scratch(spark, "tokens")
    tokens = store.save(rows.mapInArrow(store.freed(_tokenise(tokenizer, end_id, kind)), TOKENS), base)
    pairs = tokens.select(F.explode("counts").alias("c"))
    pairs.groupBy(F.col("c.token").cast("long").alias("token")).agg(F.sum("c.n").alias("n")).write.parquet(f"{path}/frequencies")
    found = read_table(spark, path)
    table = spark.sparkContext.broadcast(found)
    parts = store.parts_for(spark, np.dtype(kind).itemsize * found.total)
    keyed = tokens.filter("doc_id is not null").select("doc_id", "ids", F.xxhash64("ids").alias("tie"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    blocks = ordered.mapInArrow(store.freed(_encode(table, block_tokens, kind)), "part long, block long, start long, tokens long, documents long, payload binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    del keyed, ordered, blocks, tokens, pairs
    store.release(spark)
    store.remove(spark, base)


def read_table(spark: SparkSession, path: str) -> Table:
    """The shared frequency table: at most one row per entry of the vocabulary, whatever the corpus."""
    found = spark.read.parquet(f"{path}/frequencies").toPandas()
    return Table(found["token"].to_numpy(np.int64), found["n"].to_numpy(np.int64))


def decode(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian u32 bytes) of every document at path."""
    table = spark.sparkContext.broadcast(read_table(spark, path))
    blocks = spark.read.schema("part long, block long, start long, tokens long, documents long, payload binary").parquet(f"{path}/blocks")
    per_part = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens")).orderBy("part").collect()  # a row for each partition written
    before, total = [], 0
    for row in per_part:
        before.append((row["part"], total))
        total += row["tokens"]
    offsets = spark.sparkContext.broadcast(dict(before))

    def run(batches):
        for batch in batches:
            for part, start, payload in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                block = Block(table.value, payload)
                ids, at = block.decode(), np.r_[0, np.cumsum(block.lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array(offsets.value[part] + start + at[:-1], pa.int64()), bs.binary(ids, at)], names=["doc_id", "start", "ids"])

    return blocks.mapInArrow(store.freed(run), "doc_id long, start long, ids binary")


def digest(decoded: DataFrame) -> DataFrame:
    """The ids of each document as their number and CRC-32."""
    return decoded.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
