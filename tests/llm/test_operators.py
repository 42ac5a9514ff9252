"""Operators against brute force, exact round trips and held-out accuracy, with nulls, ties, empty and clashing inputs."""

import collections
import functools
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import bytescan, chat, graph, html, jaccard, leaks, packing, pivots, rans, store, suffix, tokens, toxicity, urls

DOC = "doc_id long, text string, lang string, sigs int, batch string"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, None, 1, "x") for i, t in enumerate(texts)], DOC)


def words(rnd, n, alphabet="abcdefgh"):
    return " ".join("".join(rnd.choices(alphabet, k=rnd.randint(2, 6))) for _ in range(n))


# --- 1 and 10 ----------------------------------------------------------------------------------------


@functools.cache
def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_file(name))  # as it comes, without settings of its own


def ids_of(name, text):
    return tokenizer(name).encode(text, add_special_tokens=False).ids


def encoded(encoder, texts):
    import pyarrow as pa

    ids, at = encoder.encode(*bytescan.utf8(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", NAMES)
def test_token_table_equals_the_tokenizer(name):
    rnd = random.Random(1)
    signs = list("ab C0.,!'s  \t\n\r\x85\xa0 　\x1céÉßσΣ1٣中#*|×÷İį\u200b\u2003") + ["<|endoftext|>", "̈", "\n\n", "word", " longer word"]
    texts = ["".join(rnd.choices(signs, k=rnd.randint(0, 40))) for _ in range(4000)] + ["", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|startoftext|>", "<|endoftext", "x" * 5000, "|>"]
    encoder = tokens.Encoder(tokens.tokenizer_file(name))
    for _ in range(2):  # the second time all pieces are known
        assert encoded(encoder, texts) == [ids_of(name, t) for t in texts]
    assert encoded(encoder, [None, *texts[:3]])[0] == []


@pytest.mark.parametrize("name", NAMES)
def test_letters_before_punctuation(name):
    letters = [chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)]]
    texts = [f"{letter}{sign}" for letter in letters for sign in tokens.PUNCTUATION] + [f"a\n{letter}b" for letter in letters]
    assert encoded(tokens.Encoder(tokens.tokenizer_file(name)), texts) == [ids_of(name, t) for t in texts]


def test_special_strings_as_text():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.tokenizer_file(NAMES[0]))
    plain.encode_special_tokens = True
    text = "a <|endoftext|> b"
    assert encoded(tokens.Encoder(tokens.tokenizer_file(NAMES[0]), special_as_text=True), [text]) == [plain.encode(text, add_special_tokens=False).ids] != [ids_of(NAMES[0], text)]


def test_long_texts_and_a_full_table(monkeypatch):
    rnd = random.Random(2)
    texts = [words(rnd, 4000), "y" * 9000, words(rnd, 50), " ".join("é" * 9 for _ in range(1500)), words(rnd, 3000, "xyz") + "<|endoftext|>"]
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(tokens, "REMEMBERED", 300)
    encoder = tokens.Encoder(tokens.tokenizer_file(NAMES[0]))
    for _ in range(2):
        assert encoded(encoder, texts) == [ids_of(NAMES[0], t) for t in texts]


def test_rans_blocks():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 5, 700, 300_000):
        ids = np.minimum(rnd.zipf(1.3, n), 40_000).astype("<u4")
        values, counts = np.unique(ids, return_counts=True)
        table = rans.Table(values, counts)
        payload = rans.encode_block(table, np.array([7, 9]), np.array([n // 2, n - n // 2]), ids)
        block = rans.Block(table, payload)
        assert np.array_equal(block.decode(), ids) and block.doc_ids.tolist() == [7, 9]
        for step in block.entry:  # every checkpoint is an entry of its own
            assert np.array_equal(block.decode(step), ids[step * block.lanes :])
            assert np.array_equal(block.decode(0, step), ids[: step * block.lanes])
        assert n < 300_000 or len(block.entry) > 3
        with pytest.raises(ValueError):
            rans.Block(table, payload[:-1] + bytes([payload[-1] ^ 1]))


def test_rans_files(spark):
    rows = docs_of(spark, ["one two", None, "", "three " * 50, "one two"], 5).union(docs_of(spark, ["tie"], 5)).repartition(3)
    path = store.scratch(spark, "test")
    rans.encode(rows, path, "byte_bpe_50k.json", 2, block_tokens=40)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rans.digest(rans.decode(spark, path)).collect())
    assert [g[0] for g in got] == [5, 5, 6, 7, 8, 9]
    at = 0
    for doc_id, start, n, crc in sorted(got, key=lambda g: g[1]):
        assert start == at
        at += n
    assert got[2][2:] == got[3][2:] == (1, zlib.crc32(np.array([2], "<u4").tobytes()))
    empty = store.scratch(spark, "test")
    rans.encode(rows.limit(0), empty, "byte_bpe_50k.json", 2)
    assert rans.decode(spark, empty).count() == 0


def test_packing(spark):
    rnd = random.Random(3)
    texts = [words(rnd, rnd.choice([0, 1, 5, 40, 300, 3000])) for _ in range(120)] + [None, ""]
    pieces = packing.pack_documents(docs_of(spark, texts).repartition(2), "word_bpe_49k.json", 1).collect()
    covered, windows = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        covered[p.doc_id].append((p.start, p.length, bytes(p.ids)))
        windows[p.sequence_id].append((p.offset, p.length))
    for i, t in enumerate(texts):
        want = np.array([*ids_of("word_bpe_49k.json", t or ""), 1], "<u4").tobytes()
        assert b"".join(x for _, _, x in sorted(covered[i])) == want
    dealt = collections.Counter((p.step_group, p.sequence_id, p.tier) for p in pieces)
    by_group = collections.defaultdict(collections.Counter)
    for group, _, tier in dealt:
        by_group[group >> 36, tier][group] += 1
    assert all(max(c.values()) - min(c.values()) <= 1 for c in by_group.values())
    assert packing.step_groups(np.repeat([2048, 512], [65, 3]), 2048).tolist() == [*([0, 1] * 33)[:65], 1, 0, 1]
    padded = 0
    for w in windows.values():
        end = 0
        for offset, length in sorted(w):
            assert offset == end
            end += length
        assert end <= 2048
        padded += 0 if end & (end - 1) == 0 else 2048 - end
    assert padded <= 2 * 2048
    assert packing.pack_documents(docs_of(spark, []), "word_bpe_49k.json", 1).count() == 0


# --- 2 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("batch_bytes", "hot", "contents"), [(1 << 20, 4000, 9999), (3000, 4000, 9999), (3000, 1, 9999), (3000, 4000, 1)])
def test_suffix_dedup(spark, batch_bytes, hot, contents):
    rnd = random.Random(4)
    passages = [words(rnd, 30) for _ in range(4)]
    texts = []
    for _ in range(60):
        t = words(rnd, rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            t += p[a : a + rnd.randint(30, 160)] + rnd.choice(["", " é "]) + words(rnd, 3)
        texts.append(t)
    texts += [f"{words(rnd, 9)} {passages[0]} {words(rnd, 9)}" for _ in range(25)]  # one passage among ever new words
    texts += [texts[3], texts[3], "a" * 300, "a" * 49, "a" * 50, "short", "short", "", None]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digest(suffix.dedup_substrings(docs_of(spark, texts).repartition(3), batch_bytes=batch_bytes, hot_batches=hot, hot_contents=contents)).collect()}
    assert got == suffix.removed_by_brute_force([(i, (t or "").encode()) for i, t in enumerate(texts)])


def test_ranks_of_slices_equal_those_of_all(monkeypatch):
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    base = [bytes(rnd.integers(97, 99, 83, np.uint8)) for _ in range(40)]  # equal windows have equal owners
    head, bodies = np.zeros(300, suffix.CONTEXT), []
    for i in range(300):
        owner, length = rnd.integers(0, 40), int(rnd.integers(50, 84))
        bodies.append(base[owner][: length - 5] + bytes(rnd.integers(97, 99, 5, np.uint8)))
        head[i] = (owner, i, rnd.integers(0, 50), i, 0, 0, length)
    table = pa.table({"batch": [1, 2], "head": [head[:150].tobytes(), head[150:].tobytes()], "body": [b"".join(bodies[:150]), b"".join(bodies[150:])]})
    whole = suffix._double(table)
    monkeypatch.setattr(suffix, "SLICE_BYTES", 500)
    assert suffix._double(table).equals(whole) and whole.num_rows == 2
    found = {int(m["doc"]): int(m["bits"]) for x in whole.column("head").to_pylist() for m in np.frombuffer(x, suffix.MARK)}
    for i in range(300):
        windows = [bodies[i][j : j + 50] for j in range(len(bodies[i]) - 49)]
        others = {bodies[k][j : j + 50] for k in range(300) if head["owner"][k] == head["owner"][i] and head["doc_id"][k] < head["doc_id"][i] for j in range(len(bodies[k]) - 49)}
        assert found.get(i, 0) == sum(1 << j for j, w in enumerate(windows) if w in others)


def test_suffix_dedup_carries_columns_and_keeps_repeated_rows(spark):
    rows = docs_of(spark, ["x" * 80]).union(docs_of(spark, ["x" * 80]))
    got = suffix.dedup_substrings(rows, carry=("lang", "sigs")).collect()
    assert [(r.n_removed, r.lang, r.sigs) for r in got] == [(0, None, 1)] * 2
    assert suffix.dedup_substrings(docs_of(spark, [])).count() == 0


# --- 9 -----------------------------------------------------------------------------------------------


def jaccard_by_brute_force(texts, k, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * (len(a) + len(sets[j]) - both):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return {i: (len(s), root[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_jaccard_components(spark, k, num, den):
    rnd = random.Random(k)
    texts = [None, "", "one", "One", "one two", "\t"]
    for size in (4, 12, 60, 200):
        base = words(rnd, size, "abcdefghijklmnop").split()
        for _ in range(30):  # a dense group and a chain of ever more distant copies
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, size // 25))):
                copy[rnd.randrange(size)] = words(rnd, 1)
            texts.append(" ".join(copy))
            if rnd.random() < 0.3:
                base = copy
    texts += texts[10:14]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, texts), k, num, den).collect()}
    assert got == jaccard_by_brute_force(texts, k, num, den)


def test_jaccard_with_repeated_ids(spark):
    rnd = random.Random(21)
    a, b, c = (words(rnd, 60) for _ in range(3))
    rows = [(1, a), (1, b), (3, f"{b} more"), (4, c), (4, c), (2, f"{c} more"), (9, None), (9, ""), (5, a)]
    got = sorted(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect())
    assert got == sorted([(1, 58, 1), (1, 58, 1), (3, 59, 1), (4, 58, 2), (4, 58, 2), (2, 59, 2), (9, 0, 9), (9, 0, 9), (5, 58, 1)])


def test_jaccard_tiles_and_blocks():
    import pyarrow as pa

    sig = np.repeat([5, 7, 9], [1, 3000, 2])
    batch = pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.arange(len(sig)))], names=["sig", "k1"])
    blocks = [b for out in jaccard._blocks(iter([batch.slice(0, 1000), batch.slice(1000)])) for b in out.to_pylist()]
    assert max(len(b["members"]) for b in blocks) <= jaccard.BLOCK
    assert sorted(m for b in blocks if b["sig"] == 7 for m in b["members"]) == list(range(1, 3001))


@pytest.mark.parametrize("n", [1024, 1025, 2049])
@pytest.mark.parametrize("before", [0, 2])
def test_jaccard_blocks_keep_a_single_leftover(n, before):
    import pyarrow as pa

    sig = np.repeat([5, 7, 9], [before, n, 2])
    batch = pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.arange(len(sig)))], names=["sig", "k1"])
    blocks = [b for out in jaccard._blocks(iter([batch.slice(0, 700), batch.slice(700)])) for b in out.to_pylist()]
    assert sorted(m for b in blocks if b["sig"] == 7 for m in b["members"]) == list(range(before, before + n))


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (102, 101)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long"), store.scratch(spark, "test")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 100: 100, 101: 100, 102: 100}


def test_components_of_stars_and_of_nothing(spark):
    edges = lambda rows: spark.createDataFrame(rows, "u long, v long")
    assert graph.is_stars(edges([(2, 1), (3, 1), (5, 4)]))
    assert graph.is_stars(edges([]))
    assert not graph.is_stars(edges([(2, 1), (3, 2)]))
    assert not graph.is_stars(edges([(3, 1), (3, 2)]))
    assert graph.components(edges([]), store.scratch(spark, "test")).count() == 0


def test_bitmaps_never_rule_out_a_link():
    rnd = np.random.default_rng(5)
    for n in (1, 3, 40, 500, 9000, 40_000):
        base = rnd.integers(0, 1 << 62, n, dtype=np.uint64)
        for _ in range(5):
            other = np.unique(np.concatenate([base[rnd.random(n) < 0.95], rnd.integers(0, 1 << 62, n // 20, dtype=np.uint64)]))
            sets = sorted((np.unique(base), other), key=len)
            if not len(sets[0]):
                continue
            common = len(np.intersect1d(*sets))
            size = np.array([len(x) for x in sets], np.int64)
            maps = jaccard._folded([jaccard._bitmap(x) for x in sets])
            left = jaccard._bounded(0, size, maps, np.array([1]), 9, 10)
            assert len(left) or 19 * common < 9 * size.sum()


@pytest.mark.parametrize(("each", "least"), [jaccard.SMALL_MAP, jaccard.LARGE_MAP])
def test_bitmaps_of_either_size_keep_links(each, least):
    rnd = np.random.default_rng(6)
    for n in (1, 9, 70, 900, 70_000):
        base = np.unique(rnd.integers(0, 1 << 62, n, dtype=np.uint64))
        other = base[: max(1, len(base) * 9 // 10)]  # the least similarity that links at 9 of 10
        sets = sorted((base, other), key=len)
        size = np.array([len(x) for x in sets], np.int64)
        maps = [jaccard._bitmap(x, each, least) for x in sets]
        assert all(least <= 64 * len(m) <= max(least, 2 * each * n) for m in maps)
        left = jaccard._bounded(0, size, jaccard._folded(maps), np.array([1]), 9, 10)
        assert len(left) or 10 * len(other) < 9 * len(base)


def test_jaccard_moves_large_items_of_few(spark, monkeypatch):
    rnd = random.Random(8)
    common = words(rnd, 170)
    far = [f"{common} {words(rnd, 50)}" for _ in range(40)]  # they share parts, so tiles, but not nine tenths
    near = words(rnd, 200)
    texts = [*far, near, f"{near} more"]
    rows, save = {}, store.save

    def counted(df, path, *rest, **named):
        out = save(df, path, *rest, **named)
        rows[path.rsplit("/", 1)[1]] = out.count()
        return out

    monkeypatch.setattr(store, "save", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, texts), 3, 9, 10).collect()}
    assert got == jaccard_by_brute_force(texts, 3, 9, 10)
    assert rows["small"] > 30 and rows["bitmaps"] == rows["thin"] == 2


def test_forest_gives_stars_between_labels():
    one, far = np.arange(100, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)
    sets = [one, one[:99], far, one[1:], far[:98]]
    assert jaccard.forest(sets, np.array([7, 3, 20, 5, 20]), 9, 10) == [(5, 3), (7, 3)]


# --- 3, 4, 5 -------------------------------------------------------------------------------------------


def test_leaks(spark):
    rnd = random.Random(5)
    items = [f"{words(rnd, 14, 'klmnopqrst').capitalize()}. {words(rnd, 9, 'klmnopqrst').capitalize()}." for _ in range(12)]
    paraphrase = items[2].split()
    for i in range(0, len(paraphrase), 7):
        paraphrase[i] = "changed"
    texts = [words(rnd, 200) for _ in range(60)] + [f"{words(rnd, 50)} {items[0]} {words(rnd, 50)}", items[1].upper().replace(".", " !"), f"{words(rnd, 30)} {' '.join(paraphrase)}", "", None, " ".join(items[3].split()[:5])]
    benchmark = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (None, "x y z")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs_of(spark, texts), benchmark).collect()}
    assert found == {(60, 0), (61, 1), (62, 2)}
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs_of(spark, texts), benchmark, item_block=5).collect()} == found
    assert leaks.find_leaks(docs_of(spark, []), benchmark).count() == 0
    assert leaks.find_leaks(docs_of(spark, texts), benchmark.limit(0)).count() == 0


def test_leaks_that_many_documents_hold(spark):
    rnd = random.Random(12)
    items = [words(rnd, n, "klmnopqrst") for n in (15, 24, 40, 59)]
    texts, want = [], set()
    for i in range(240):
        text = words(rnd, rnd.choice([8, 30, 60, 200]))
        if i % 3 == 0:  # a third of the documents hold an item word for word, among words that no other document has
            j = i // 3 % len(items)
            text = f"{text} {words(rnd, rnd.randint(0, 40))} {items[j]} {words(rnd, 40)}"
            want.add((i, j))
        texts.append(text)
    for share in (items, items[:1]):  # the second time: one item that all these documents hold
        held = [" ".join(t.replace(x, share[0]) if len(share) == 1 and x in t else t for x in [next((x for x in items if x in t), "-")]) for t in texts]
        expected = want if len(share) > 1 else {(i, 0) for i, _ in want}
        benchmark = spark.createDataFrame(list(enumerate(share)), "item_id long, text string")
        found = leaks.find_leaks(docs_of(spark, held), benchmark).collect()
        assert {(r.doc_id, r.item_id) for r in found} == expected
        assert all(r.coverage == 1 for r in found)


def test_leaks_of_long_items(spark):
    rnd = random.Random(13)
    items = [words(rnd, n, "klmnopqrst") for n in (100, 800, 1200)]
    long = items[2].split()
    texts = [words(rnd, 300) for _ in range(30)] + items + [f"{words(rnd, 90)} {' '.join(long[a : a + n])} {words(rnd, 90)}" for a, n in ((333, 48), (700, 200), (500, 30))]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (leaks.ITEM_BLOCK, 20):
        found = {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs_of(spark, texts), benchmark, item_block=block).collect()}
        assert found == {(30, 0), (31, 1), (32, 2), (33, 2), (34, 2)}


def paraphrase(rnd, text, kind):
    """The words of an item with some changed, left out or put in."""
    w = text.split()
    if kind == 0:
        return [words(rnd, 1) if i % 5 == 2 else x for i, x in enumerate(w)]
    if kind == 1:
        return [x for i, x in enumerate(w) if i % 6 != 1]
    return [y for i, x in enumerate(w) for y in ([x] if i % 5 else [x, words(rnd, 1)])]


def test_leaks_against_brute_force_on_paraphrases(spark):
    rnd = random.Random(14)
    common = words(rnd, 40, "mnopqr").split()
    item = lambda: " ".join(rnd.choice(common) if rnd.random() < 0.5 else words(rnd, 1, "klmnopqrst") for _ in range(rnd.randint(15, 57)))
    items = [f"{item()}. {item()}" if i % 4 == 0 else item() for i in range(60)]
    texts, want = [], set()
    for i in range(360):
        host = [rnd.choice(common) if rnd.random() < 0.4 else words(rnd, 1) for _ in range(rnd.randint(0, 150))]
        if i % 2:
            at, j = rnd.randint(0, len(host)), i // 2 % len(items)
            host[at:at] = paraphrase(rnd, items[j], i % 3)
            want.add((i, j))
        texts.append(" ".join(host))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = leaks.find_leaks(docs_of(spark, texts), benchmark).collect()
    got = {(r.doc_id, r.item_id): r for r in found}
    # by definition: the common subsequence of each item with every whole document
    plain = lambda t: np.array([hash(w) for w in re.findall(r"[a-z]+", t)])
    hashes = [plain(t) for t in texts]
    most = {(i, j): leaks.lcs(plain(items[j]), h) / len(plain(items[j])) for i, h in enumerate(hashes) for j in range(len(items)) if len(h)}
    assert all(most[k] >= leaks.PARTLY for k in got)  # nothing but what the definition allows
    certain = {k for k, v in most.items() if v >= leaks.COVERED and k in want}
    assert len(certain) > 150 and len(certain & set(got)) >= 0.97 * len(certain)
    assert len([k for k in got if k not in want]) <= 2
    assert np.mean([r.cosine >= leaks.COSINE for r in found]) >= 0.9  # the latent space finds them, not the runs


def test_the_latent_space_finds_what_shares_few_rare_words(spark):
    rnd = random.Random(15)
    common = [f"c{i}" for i in range(30)]
    topic = lambda j, side: [f"{side}{j}x{i}" for i in range(6)]
    texts = []
    for i in range(600):  # either word of a pair stands in the same surroundings
        j = i % 8
        pairs = list(zip(topic(j, "a"), topic(j, "b"), strict=True))
        texts.append(" ".join(rnd.choice(common) if rnd.random() < 0.5 else rnd.choice(rnd.choice(pairs)) for _ in range(45)))
    items = [" ".join(x for k in range(6) for x in (*rnd.sample(common, 2), topic(j, side)[k])) for j in range(8) for side in "ab"]
    told = [" ".join("b" + w[1:] if w[0] == "a" else w for w in items[2 * j].split()) for j in range(8)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.cosine for r in leaks.find_leaks(docs_of(spark, [*texts, *told]), benchmark).collect()}
    idf = lambda w: 0.1 if w[0] == "c" else 3.0
    for j in range(8):
        a, b = collections.Counter(items[2 * j].split()), collections.Counter(told[j].split())
        dot = sum(a[w] * b[w] * idf(w) ** 2 for w in a)
        size = lambda x: sum(n * n * idf(w) ** 2 for w, n in x.items()) ** 0.5
        assert dot / (size(a) * size(b)) < 0.1  # the plain cosine misses it
        assert found[600 + j, 2 * j] > 0.7


def test_the_latent_space_is_smaller_than_the_benchmark(spark):
    import pyspark.sql.functions as f

    rnd = random.Random(16)
    items = leaks.Items([{"item_id": i, "text": words(rnd, 30, "klmnopqrst")} for i in range(20)])
    docs = docs_of(spark, [words(rnd, 100, "klmno") for _ in range(50)]).select("doc_id", "text")
    kept = docs.mapInArrow(leaks._keep(spark.sparkContext.broadcast(items)), leaks.KEPT).filter(f.col("ids").isNotNull()).select("ids", "first", "at", "word")
    basis = leaks.latent_space(kept, items, np.ones(items.terms), store.scratch(spark, "test"))
    assert basis.shape == (items.terms, 10)


def test_longest_common_subsequence():
    rnd = random.Random(6)
    for _ in range(50):
        a, b = [np.array(rnd.choices(range(5), k=rnd.randint(0, 30))) for _ in range(2)]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        assert leaks.lcs(a, b) == row[-1]


def test_html_on_unseen_layouts():
    odds, trees = html.train()
    rnd, right, total = random.Random(999), 0, 0
    for _ in range(120):
        page = html.Page(html.generated_page(rnd))
        y = html.labelled(page)
        kept = page.decode(trees.predict(page.features(odds)))
        assert all(kept[page.parent[i]] or not kept[i] for i in range(1, len(kept)))
        for i, tag in enumerate(page.tag):
            if tag == "#text":
                right += len(page.text[i]) * (kept[i] == bool(y[i]))
                total += len(page.text[i])
    assert right / total > 0.98


def test_html_markup():
    texts = lambda source: [t for t in html.Page(source).text if t and not t.isspace()]
    assert texts("<p title=it's>First paragraph</p><p>it's <b class='a>b'>second</b> 1 < 2 & 3 <4") == ["First paragraph", "it's ", "second", " 1 < 2 & 3 <4"]
    assert texts("<a href=\"x>y\" data-x='\"' >one</a><script>if (a<b) '</p>'</script >two<!-- <p>no --><![CDATA[x]]>three<br/>four<p/>five") == ["one", "two", "three", "four", "five"]
    assert texts("kept<a href='unclosed") == ["kept"]
    assert html.Page('<p class="A-b cD" id=e>x').tokens[1] == ("a", "b", "c", "d", "e")
    assert len(html.Page(f'<p class="{" ".join(["word"] * 40)}">x').tokens[1]) == 40


def test_html_hostile_pages():
    import time

    odds, trees = html.train()
    begun = time.time()
    for source in ("<a 'x " * 40_000, "<a b=\"'" * 40_000, "<b>" * 20_000 + "x" + "</i>" * 20_000, "<div>" * 20_000 + "deep" + "</div>" * 20_000, "<" * 100_000, "<!" * 100_000, "<li><b>" * 20_000):
        page = html.Page(source)
        page.render(page.decode(trees.predict(page.features(odds))))
    assert time.time() - begun < 60
    assert max(html.Page("<div>" * 3000).parent) == 2999


def test_html_of_the_corpus_pages(spark, sf_small):
    from html.parser import HTMLParser

    class Article(HTMLParser):  # pages of an independent source: their article element is the main text
        def __init__(self):
            super().__init__()
            self.inside, self.lines = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag in html.BLOCK:
                self.lines.append("")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            if tag in html.BLOCK:
                self.lines.append("")

        def handle_data(self, data):
            if self.inside:
                self.lines[-1] += data

    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    source = {r.page_id: r.html or "" for r in pages.collect()}
    same = 0
    for r in html.extract(pages).collect():
        article = Article()
        article.feed(source[r.page_id])
        same += r.text == "\n".join(x for x in (" ".join(line.split()) for line in article.lines) if x)
    assert same >= 0.98 * len(source)


def test_html_rows(spark):
    page = '<html><body><nav><a href="/">menu item</a></nav><article><h1>A  title</h1><p>Some main text, with a lot of words &amp; signs.<p>More <b>bold\n text</b> here, for the reader.</article><footer>&copy; me</footer>'
    rows = spark.createDataFrame([(1, "u", page, 3), (2, None, None, 3), (None, "u", "", 3)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in html.digest(html.extract(rows)).collect()}
    assert got == {1: "A title\nSome main text, with a lot of words & signs.\nMore bold text here, for the reader.", 2: "", None: ""}
    assert html.extract(rows.limit(0)).count() == 0


def test_toxicity(spark):
    rnd = random.Random(8)
    texts, labels = [], []
    for i in range(600):
        toxic = rnd.random() < 0.2
        t = [words(rnd, 8) + "." for _ in range(rnd.randint(1, 12))]
        if toxic:
            t[rnd.randrange(len(t))] = f"you {rnd.choice(['scumbag', 'idiotic', 'moronic'])} thing."
        texts.append(" ".join(t))
        labels.append((i, int(toxic)))
    rows = docs_of(spark, [*texts, "", None])
    got = {r.doc_id: r for r in toxicity.classify(rows, spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95
    assert got[600].score == got[601].score == 0
    weights = toxicity.train(rows, spark.createDataFrame(labels, "doc_id long, toxic int"))
    one = toxicity.score(docs_of(spark, ["Fine words here. You idiotic thing. Fine again."]), weights).first()
    assert len(one.offending) == 1 and "Fine words here. You idiotic thing. Fine again."[one.offending[0]["begin"] : one.offending[0]["end"]] == "You idiotic thing"
    assert toxicity.reject(rows, spark.createDataFrame([], "doc_id long, toxic int")).count() == 602
    again = rows.unionByName(rows.withColumn("text", F.lit("zz other text.")).filter("doc_id < 300"))  # ids with two texts
    labelled = spark.createDataFrame([*labels, *labels], "doc_id long, toxic int")
    assert np.array_equal(toxicity.train(again, labelled), toxicity.train(again.orderBy("text"), labelled))
    assert np.array_equal(toxicity.train(rows.unionByName(rows), labelled), weights)


# --- 6, 7, 8 -------------------------------------------------------------------------------------------


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "EXAMPLE.com", "/en/x/")]


def test_urls(spark):
    given = {
        "http://www.Example.com/en/a?b#c": ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "https://m.example.com/en/x/y": ("m.example.com", "/en/x/y", "example.com/en/x/", "block"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "http://example-a.com/": ("example-a.com", "/", "com/", "allow"),
        "http://com": ("com", "", None, "allow"),
        "http://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"),
        "http://a.net/de/1": ("a.net", "/de/1", None, "allow"),
        "no scheme.com/en/": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "://?x": ("", "", None, "allow"),
        "http://x.com:80/": ("x.com:80", "/", None, "allow"),
    }
    rows = spark.createDataFrame([(i, u, "z") for i, u in enumerate(given)], "page_id long, url string, stack string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(rows, RULES).collect()}
    assert [got[i] for i in range(len(given))] == list(given.values())
    assert urls.judge(rows, []).filter("verdict <> 'allow' or rule is not null").count() == 0
    assert urls.judge(rows.limit(0), RULES).count() == 0
    twice = [("allow", "com", "/"), ("block", "COM", "/")]
    page = spark.createDataFrame([(1, "http://a.com/x")] * 2, "page_id long, url string")
    for rules in (twice, twice[::-1]):  # whatever their order, and for repeated rows
        assert [(r.rule, r.verdict) for r in urls.judge(page, rules).collect()] == [("com/", "block")] * 2


def test_chat(spark):
    import hashlib

    control = "\\### Assistant: </turn> ok\\t\\\\h ####</turn></turn>\n"
    turns = [(1, 0, "system", "s"), (1, 1, "user", control), (1, 2, "assistant", control), (1, 3, "user", None), (1, 3, "assistant", "tie"), (2, 0, "us:er\n", "no reply"), (None, None, None, None)]
    turns += [(3, t, "assistant" if t % 2 else "user", f"turn {t} é") for t in range(700)]
    rows = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, chunk int")
    rendered = chat.render(rows)
    got = {r.conv_id: r for r in chat.read_back(rendered, chat.expand(rendered)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for conv in (1, 2, 3, None):
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in turns if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(loss), sha(loss))
    made = chat.whole_texts(rendered.filter("conv_id = 1")).orderBy("target").collect()
    assert len(made) == 2 and made[1].text.startswith(made[0].text) and made[1].text[made[1].loss_start :].startswith("tie")
    rows_of_turns = chat.expand(rendered).collect()  # an assistant turn, a row
    assert sorted((r.conv_id, r.target) for r in rows_of_turns) == [(1, 2), (1, 3), *((3, t) for t in range(1, 700, 2))]
    assert all(r.context_chars < r.loss_start and len(r.reply) == r.loss_chars for r in rows_of_turns)
    empty = chat.render(rows.limit(0))
    assert chat.read_back(empty, chat.expand(empty)).count() == 0


def test_top_k(spark):
    rnd = np.random.default_rng(9)
    vectors = [rnd.normal(0, 0.3, 8).tolist() for _ in range(300)]
    vectors[40:60] = [vectors[40]] * 20  # ties
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(300, None, 1), (320, [1.0, None], 1), (340, [float("nan")] * 8, 1), (None, vectors[0], 1), (360, [0.5], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = collections.defaultdict(list)
    for r in sorted(pivots.top_k(df, k=7).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    ints = {i: np.pad(np.floor(64 * np.array(v)), (0, 8 - len(v))).astype(int) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    assert set(got) == {i for i in ints if i % 20 == 0}
    for q, found in got.items():
        assert found == sorted(((i, int(v @ ints[q])) for i, v in ints.items() if i != q), key=lambda x: (-x[1], x[0]))[:7]
    assert pivots.top_k(df.limit(0)).count() == 0


def test_top_k_sends_few_rows_to_the_driver(spark):
    n, parts = 40_000, 16
    rows = spark.range(0, n, 1, parts).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(1000)) / 1000.0).alias("embedding"))
    frame, sizes = type(rows), []
    collect = frame.collect

    def counted(self):
        plan = self._jdf.queryExecution().optimizedPlan()
        if plan.nodeName() == "GlobalLimit" and plan.maxRows().get() == pivots.PIVOT_SAMPLE:
            under = plan.children().head().children().head()  # what the sort below the limit reads
            sizes.append(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.sparkSession._jsparkSession, under).count())
        return collect(self)

    frame.collect = counted
    try:
        got = pivots.top_k(rows, k=3, every=4000)
    finally:
        frame.collect = collect
    assert sizes and max(sizes) <= 3 * pivots.PIVOT_SAMPLE
    ints = {r.vec_id: np.floor(64 * np.array(r.embedding)).astype(int) for r in rows.collect()}
    ids, m = np.array(list(ints)), np.stack(list(ints.values()))
    found = collections.defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == set(range(0, n, 4000))
    for q, some in found.items():
        score = m @ ints[q]
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:3]
        assert some == [(ids[i], score[i]) for i in best]


def test_search_leaves_out_groups_and_keeps_large_integers():
    rnd = np.random.default_rng(5)
    centres = rnd.integers(-100, 100, (8, 16))
    rows = np.concatenate([c + rnd.integers(-3, 4, (1024, 16)) for c in centres]).astype(float)
    ids, queries = np.arange(len(rows)), np.arange(0, 1024, 8)
    search = pivots.Search(ids[queries], rows[queries], pivots.choose_pivots(rows[::8], 12), 5)
    search.add(ids, rows)
    assert search.computed <= len(queries) * len(rows) / 2
    large = np.concatenate([rows[:3] * 2.0**60, rows[3:5] * 2.0**40])
    search.add(np.arange(10_000, 10_005), large)
    whole = {**{int(i): r for i, r in zip(ids, rows)}, **{10_000 + i: r for i, r in enumerate(large)}}
    whole = {i: [int(x) for x in r] for i, r in whole.items()}
    found = collections.defaultdict(list)
    for query, candidate, score in search.results():
        for q, c, s in zip(query, candidate, score, strict=True):
            found[int(q)].append((int(c), s))
    for q in queries[:4]:
        every = sorted(((i, sum(a * b for a, b in zip(v, whole[int(q)], strict=True))) for i, v in whole.items() if i != q), key=lambda x: (-x[1], x[0]))[:5]
        assert found[int(q)] == [(i, max(-(2**63), min(2**63 - 1, s))) for i, s in every]


def test_buckets_are_those_of_spark(spark):
    keys = [0, 1, -1, 7 << 32, (3 << 32) | 12345, -(2**63), 2**63 - 1]
    for n in (1, 8, 211):
        want = [r.b for r in spark.createDataFrame([(k,) for k in keys], "k long").select(F.expr(f"pmod(hash(k), {n})").alias("b")).collect()]
        assert store.bucket_of(np.array(keys), n).tolist() == want
        own = list(itertools.islice(store.keys_in_bucket(300, n), 500))
        assert len(set(own)) == 500 and {k >> 32 for k in own} == {300} and set(store.bucket_of(np.array(own), n).tolist()) == {300 % n}


def test_batches_are_written_without_a_shuffle(spark, monkeypatch, tmp_path):
    rnd = random.Random(9)
    texts = [words(rnd, 60) for _ in range(200)] + [None, ""]
    saved = []
    monkeypatch.setattr(store, "save_bucketed", lambda df, *rest, save=store.save_bucketed: saved.append((df, save(df, *rest))) or saved[0][1])
    got = suffix.dedup_substrings(docs_of(spark, texts), batch_bytes=2000, base=f"file://{tmp_path}/suffix")
    assert got.count() == len(texts)
    batches = saved[0][1]
    files = list((tmp_path / "suffix/batches").glob("*.parquet"))
    assert batches.count() > 2 * len(files) and len(files) <= 8  # a file for each task, which is one bucket
    assert "Exchange" not in batches.groupBy("batch").count()._jdf.queryExecution().executedPlan().toString()


def test_stages_leave_no_intermediate_tables(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, "en"), (2, text, "en"), (3, "other " + text[:120], "en"), (4, None, "en")], "doc_id long, text string, lang string")
    monkeypatch.setattr(store, "scratch", lambda spark, tag: f"file://{tmp_path}/weft-{tag}-{random.randrange(2**60)}")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    cut = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, kept, "").collect()}
    assert cut == {1: text, 3: "other ", 4: ""}
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if any(p.rglob("*.parquet"))}
    assert left == {"weft-groups", "weft-kept"}


def test_word_scan():
    import pyarrow as pa

    data, offsets = bytescan.utf8(pa.array(["Ab  cd", None, "", "\tx\ny "]).slice(0, 4))
    w = bytescan.Words(data, offsets)
    assert [(int(t), bytes(w.data[a:b])) for t, a, b in zip(w.text, w.start, w.end, strict=True)] == [(0, b"ab"), (0, b"cd"), (3, b"x"), (3, b"y")]


def test_pipeline(spark, sf_small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    near = corpus_pipeline.drop_near_copies(spark, docs, sf_small)
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts)
    want = jaccard_by_brute_force([texts[i] for i in order], 5, 4, 5)
    assert {r.doc_id for r in near.collect()} == {order[i] for i, (_, root) in want.items() if root == i}
    cut = corpus_pipeline.cut_repeats(spark, docs, sf_small)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.filter(F.length("text") != F.col("n_chars")).count() == 0
    out = corpus_pipeline.run(spark, sf_small)
    assert out.select("doc_id").distinct().count() > 0.5 * docs.count()
