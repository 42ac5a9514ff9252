"""Toxicity by multiple-instance learning: a document is a bag of sentences joined by noisy-or.

A sentence's probability is a logistic function of its words' features (hashed whole words and their
beginnings and ends, so inflected forms share evidence). A document is toxic unless all of its sentences
are clean: p = 1 - prod(1 - p_s). Only document labels are known; the gradient of the document's loss
flows to each sentence in proportion to its own probability, which is how offending sentences are found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import bytescan as bs
from weftgraph.llm import store

U64 = np.uint64
#: Bits of the feature space; labelled documents that the model is fitted on at most (in order of a hash of doc_id).
FEATURE_BITS, TRAINING_ROWS = 18, 5000
#: Lengths in bytes of word beginnings, and of word ends.
BEGINNINGS, ENDINGS = (5, 6, 7), (5,)
SEPARATES = np.ones(256, bool)
SEPARATES[[*range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x30, 0x3A), 0x27, *range(0x80, 0x100)]] = False
ENDS = np.zeros(256, bool)
ENDS[[0x2E, 0x21, 0x3F, 0x0A]] = True


class Bags:
    """Features of all words of some texts, with the sentence of each and the text of each sentence."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = bs.Words(data, offsets, separator=SEPARATES)
        start, end = words.start, words.end
        stop = np.concatenate([[0], np.cumsum(ENDS[data])])[start] if len(data) else np.zeros(0, np.int64)
        new = np.r_[True, (stop[1:] != stop[:-1]) | (words.text[1:] != words.text[:-1])] if len(start) else np.zeros(0, bool)
        sentence = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.text = words.text[first]
        self.begin = start[first] - offsets[self.text]
        self.end = end[np.r_[first[1:] - 1, len(start) - 1]] - offsets[self.text] if len(first) else self.begin
        keys, of = [words.hash], [sentence]
        for n in BEGINNINGS:
            fits = end - start > n
            keys.append(bs.span_hash(words.sums, start[fits], start[fits] + n) ^ bs.M2)
            of.append(sentence[fits])
        for n in ENDINGS:
            fits = end - start > n
            keys.append(bs.span_hash(words.sums, end[fits] - n, end[fits]) ^ bs.M3)
            of.append(sentence[fits])
        self.feature = (np.concatenate(keys) >> U64(64 - FEATURE_BITS)).astype(np.int64)
        self.sentence = np.concatenate(of)


def noisy_or(log_clean: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """1 - product of the sentences' clean probabilities, for each of n texts."""
    return -np.expm1(np.bincount(text, log_clean, n)[:n])


def probabilities(bags: Bags, n: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n texts, and of each sentence."""
    k = len(bags.text)
    pair = np.unique(bags.sentence.astype(np.int64) << FEATURE_BITS | bags.feature)
    z = np.clip(weights[-1] + np.bincount(pair >> FEATURE_BITS, weights[pair & ((1 << FEATURE_BITS) - 1)], k)[:k], -30, 30)
    return np.clip(noisy_or(-np.logaddexp(0, z), bags.text, n), 0, 1), 1 / (1 + np.exp(-z))


def fit(texts: pa.Array, labels: np.ndarray, rounds: int = 120, rate: float = 0.5, decay: float = 2e-3) -> np.ndarray:
    """Weights of the features, and the bias as the last one, by full-batch Adagrad on the documents' loss."""
    data, offsets = bs.utf8(texts)
    feature, sentence, owner, n_sentences = [], [], [], 0
    for a, b in bs.pieces(offsets):
        bags = Bags(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        pair = np.unique(bags.sentence.astype(np.int64) << FEATURE_BITS | bags.feature)  # once per sentence
        feature.append((pair & ((1 << FEATURE_BITS) - 1)).astype(np.int32))
        sentence.append(((pair >> FEATURE_BITS) + n_sentences).astype(np.int32))
        owner.append(bags.text + a)
        n_sentences += len(bags.text)
    feature, sentence, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (feature, sentence, owner))
    weights, n, y = np.zeros((1 << FEATURE_BITS) + 1), len(labels), labels.astype(bool)
    if not len(feature) or not y.any():
        weights[-1] = -20.0
        return weights
    # evidence of a feature: documents of either label that hold it; rare ones say nothing
    seen = np.unique(owner[sentence].astype(np.int64) << FEATURE_BITS | feature)
    held, label = seen & ((1 << FEATURE_BITS) - 1), y[seen >> FEATURE_BITS]
    toxic = np.bincount(held[label], minlength=1 << FEATURE_BITS)
    clean = np.bincount(held[~label], minlength=1 << FEATURE_BITS)
    odds = np.log((toxic + 0.1) / (y.sum() + 0.2)) - np.log((clean + 0.1) / ((~y).sum() + 0.2))
    use = (toxic >= 3) & (odds > 1.0)
    weights[:-1] = np.where(use, odds, 0)
    weights[-1] = -6.0
    keep = use[feature]
    feature, sentence = feature[keep], sentence[keep]
    squares = np.full(len(weights), 1e-2)
    for _ in range(rounds):
        z = np.clip(weights[-1] + np.bincount(sentence, weights[feature], n_sentences), -30, 30)
        p_sentence = 1 / (1 + np.exp(-z))
        p = np.clip(noisy_or(-np.logaddexp(0, z), owner, n), 1e-9, 1 - 1e-9)
        pull = np.where(y, -(1 - p) / p, 1.0)[owner] * p_sentence / n * 100
        gradient = np.append(np.bincount(feature, pull[sentence], 1 << FEATURE_BITS), pull.sum()) + np.append(np.where(use, decay, 0), 0)
        squares += gradient**2
        weights -= rate * gradient / np.sqrt(squares) * np.append(use, True)
        np.maximum(weights[:-1], 0, out=weights[:-1])  # words can offend, but none excuses another
    return weights


def is_held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> np.ndarray:
    """Fits the weights on at most rows labelled documents that are not held out.

    Rows with a null doc_id, label or text do not count; of several labels of a document the largest holds,
    of several texts of a doc_id the least one is learned from, so that retried tasks give the same model.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("doc_id is not null and toxic is not null").filter(~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded: at most rows ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).orderBy("doc_id").toArrow()
    return fit(sample.column("text").combine_chunks() if sample.num_rows else pa.array([], pa.string()), sample.column("toxic").to_numpy())


SCORED = "doc_id long, score double, offending array<struct<begin:int,end:int,score:double>>"


def score(docs: DataFrame, weights: np.ndarray, offending: float = 0.1) -> DataFrame:
    """doc_id, score and offending of every row of docs (doc_id, text).

    score is the noisy-or of the sentences (0 for null or wordless texts); offending lists the sentences
    (byte ranges of the text, with their probability) of at least the given probability. Null doc_ids
    stay; repeated rows are scored alike. Other columns are ignored. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    spans = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        w = shared.value
        for batch in batches:
            data, offsets = bs.utf8(batch.column("text"))
            for a, b in bs.pieces(offsets):
                bags = Bags(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                p, each = probabilities(bags, b - a, w)
                found = [[] for _ in range(b - a)]
                for i in np.flatnonzero(each >= offending):
                    found[bags.text[i]].append({"begin": int(bags.begin[i]), "end": int(bags.end[i]), "score": float(each[i])})
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(p), pa.array(found, spans)], names=["doc_id", "score", "offending"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(store.freed(run), SCORED)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score by a model fitted on labels is below threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels).astype(np.float32))

    def run(batches):
        for batch in batches:
            data, offsets = bs.utf8(batch.column("text"))
            for a, b in bs.pieces(offsets):
                p = probabilities(Bags(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a, shared.value)[0]
                yield batch.slice(a, b - a).filter(pa.array(p < threshold))

    return docs.mapInArrow(store.freed(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending of every row of docs, by a model fitted on labels."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
