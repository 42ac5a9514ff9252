"""Token ids by a public tokenizer, with an exact table of piece encodings, in numpy.

A text is cut only where the tokenizer's own pre-tokenizer always cuts: before white space that follows
something else, between a letter and one of a few ASCII punctuation marks, and between a line end and a
letter. Each distinct piece is encoded by the tokenizers library once; after that its bytes are looked up
in a hash table whose keys are the whole bytes, so a hit is exact. Longer pieces are not remembered.
"""

from __future__ import annotations

import os
import re

import numpy as np

from weftgraph.llm import bytescan as bs

U64 = np.uint64
#: White space as Unicode's White_Space property has it (fixed values).
WHITE = "\t-\r \x85\xa0  -     　"
#: Latin letters after which punctuation always begins a new token. U+0130 is none: its lower case ends in a combining dot, which joins with punctuation.
LETTER = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
PUNCTUATION = ",.!?;:#$%&*|"
#: Pieces that can be encoded together, with a separator between them that is always one token.
SEPARATORS = ("\n", " 0 ")
#: Pieces that a worker remembers before it starts anew (about 100 MB), and bytes of the longest one kept.
REMEMBERED, LONGEST = 700_000, 32
#: Bytes of text that are worked on at a time.
CHUNK_BYTES = 2 << 20

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in PUNCTUATION]] = True
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)


def _is_white_end(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each position (of a byte of 0x80 or more) is white space."""
    b1, b2, b3 = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    white = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    white |= (b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80)
    white |= (b3 == 0xE2) & (b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF))
    return white | ((b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F)) | ((b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80))


def _is_letter(lead: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether two bytes are a letter of LETTER beyond ASCII."""
    found = (lead == 0xC3) & (low >= 0x80) & (low != 0x97) & (low != 0xB7)
    found |= (lead == 0xC4) & (low >= 0x80) & (low != 0xB0)
    return found | ((lead >= 0xC5) & (lead <= 0xC8) & (low >= 0x80)) | ((lead == 0xC9) & (low >= 0x80) & (low <= 0x8F))


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin, in ascending order; every text that is not empty begins with one."""
    n = len(data)
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    if n > 1:
        before, here = data[:-1], data[1:]
        blank = BLANK[data]
        at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        high = data[at - 1] >= 0x80
        fine = ~high & (data[at - 1] > 0x20) & (data[at - 1] < 0x7F)
        fine[high] = ~_is_white_end(data, at[high])
        begins[at[fine]] = True
        at = np.flatnonzero(MARK[here]) + 1
        last = data[at - 1]
        begins[at[ASCII_LETTER[last] | ((at > 1) & (last >= 0x80) & _is_letter(data[at - 2], last))]] = True
        at = np.flatnonzero((before == 0x0A) & ((here >= 0xC3) | ASCII_LETTER[here])) + 1
        at = at[begins[at - 1]]
        then = np.minimum(at + 1, n - 1)
        begins[at[ASCII_LETTER[data[at]] | _is_letter(data[at], data[then])]] = True
    begins[offsets[offsets < n]] = True
    return np.flatnonzero(begins[:n])


class Table:
    """Pieces of up to LONGEST bytes, as four words and a length, with the place of their ids. Open addressing."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.slot = np.full(1 << 16, -1, np.int32)
        self.key = np.zeros((1 << 14, 5), U64)
        self.size = 0

    @staticmethod
    def hashes(key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (key[:, 0] ^ key[:, 4]) * bs.M1 ^ key[:, 1] * bs.M2 ^ key[:, 2] * bs.M3 ^ (key[:, 3] + bs.M2) * bs.M1
        return bs.mix(h)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Number of each key, or -1."""
        out = np.full(len(key), -1, np.int32)
        left, at, mask = np.arange(len(key)), self.hashes(key), U64(len(self.slot) - 1)
        while len(left):
            some = self.slot[(at & mask).astype(np.int64)]
            there = some >= 0
            if not there.all():
                left, at, some = left[there], at[there], some[there]
            differ = self.key[some] ^ (key if len(left) == len(key) else key[left])
            same = (differ[:, 0] | differ[:, 1] | differ[:, 2] | differ[:, 3] | differ[:, 4]) == 0
            out[left[same]] = some[same]
            left, at = left[~same], at[~same] + U64(1)
        return out

    def add(self, key: np.ndarray) -> None:
        """New, distinct keys; they get the next numbers."""
        first, self.size = self.size, self.size + len(key)
        if self.size > len(self.key):
            self.key = np.concatenate([self.key, np.zeros((max(len(self.key), self.size - len(self.key)), 5), U64)])
        self.key[first : self.size] = key
        number = np.arange(first, self.size, dtype=np.int32)
        if 2 * self.size > len(self.slot):
            self.slot = np.full(1 << (4 * self.size).bit_length(), -1, np.int32)
            number = np.arange(self.size, dtype=np.int32)
        at, mask = self.hashes(self.key[number]), U64(len(self.slot) - 1)
        while len(number):
            place = (at & mask).astype(np.int64)
            free = self.slot[place] < 0
            self.slot[place[free]] = number[free]
            lost = self.slot[place] != number
            number, at = number[lost], at[lost] + U64(1)


class Encoder:
    """Texts to token ids; made on the worker that uses it.

    If special_as_text, the strings of the vocabulary's special tokens are ordinary text; else a text that
    holds one is encoded as the library does by default, which gives the special token's id.
    """

    _open: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, file: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content.encode() for t in added] if not special_as_text else []
        self.table = Table()
        self.ids, self.first, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = 0
        left, right = self._ids("a"), self._ids("b")
        self.separator, self.mark = None, None
        for text in SEPARATORS:
            ids = self._ids(f"a{text}b")
            if len(ids) == len(left) + len(right) + 1 and [*left, ids[len(left)], *right] == ids:
                self.separator, self.mark = text, ids[len(left)]
                break
        word = f" ?[^{WHITE}0]+"
        self.plain = re.compile(word)
        self.plain_line = re.compile(f"{word}(?:{re.escape(self.separator)}{word})*+") if self.separator else None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encoded(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece. Plain ones go in long strings, cut again at the separator's token."""
        out: list = [None] * len(pieces)
        alone = []
        lines, members = [], []
        for a in range(0, len(pieces), 128):
            some = range(a, min(a + 128, len(pieces)))
            line = self.separator.join(pieces[a : a + 128]) if self.separator else ""
            if not self.plain_line or not self.plain_line.fullmatch(line):
                good = [i for i in some if self.separator and self.plain.fullmatch(pieces[i])]
                alone += sorted({*some}.difference(good))
                some, line = good, self.separator.join(pieces[i] for i in good) if good else ""
            if some:
                lines.append(line)
                members.append(some)
        for which, found in zip(members, self.tokenizer.encode_batch_fast(lines, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != len(which) - 1:
                raise ValueError("the separator is not one token here")
            start = 0
            for i, end in zip(which, [*cut.tolist(), len(ids)], strict=True):
                out[i] = ids[start:end]
                start = end + 1
        for a in range(0, len(alone), 4096):
            some = alone[a : a + 4096]
            for i, found in zip(some, self.tokenizer.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = np.array(found.ids, np.uint32)
        return out

    @classmethod
    def of(cls, file: str, special_as_text: bool = False) -> Encoder:
        if (file, special_as_text) not in cls._open:
            cls._open[file, special_as_text] = cls(file, special_as_text)
        return cls._open[file, special_as_text]

    def _put(self, number: int, ids: list[np.ndarray]) -> None:
        """Ids of the pieces from number on."""
        sizes = np.array([len(x) for x in ids], np.int32)
        total = int(sizes.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.uint32)])
        last = number + len(ids)
        if last > len(self.first):
            more = max(len(self.first), len(ids))
            self.first, self.count = np.concatenate([self.first, np.zeros(more, np.int64)]), np.concatenate([self.count, np.zeros(more, np.int32)])
        if total:
            self.ids[self.used : self.used + total] = np.concatenate(ids)
        self.first[number:last] = self.used + np.cumsum(sizes) - sizes
        self.count[number:last] = sizes
        self.used += total

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts one after another, and where each text's begin."""
        texts = len(offsets) - 1
        start = cuts(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64)
        if self.table.size > REMEMBERED:
            self.table.clear()
            self.used = 0
        end = np.r_[start[1:], len(data)]
        size = end - start
        window = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(LONGEST + 8, np.uint8)]), 8)
        key = np.zeros((len(start), 5), U64)
        key[:, 0] = window[start].view("<u8")[:, 0] & LOW_BYTES[np.minimum(size, 8)]
        key[:, 4] = size.astype(U64)
        for word in (1, 2, 3):
            some = np.flatnonzero((size > 8 * word) & (size <= LONGEST))
            key[some, word] = window[start[some] + 8 * word].view("<u8")[:, 0] & LOW_BYTES[np.minimum(size[some] - 8 * word, 8)]
        short = size <= LONGEST
        number = np.full(len(start), -1, np.int32)
        number[short] = self.table.find(key[short])
        missing = np.flatnonzero(number < 0)
        used, known = self.used, self.table.size
        if len(missing):
            raw = data.tobytes()
            new: dict[bytes, int] = {}
            which = np.array([new.setdefault(raw[a:b], len(new)) for a, b in zip(start[missing].tolist(), end[missing].tolist(), strict=True)])
            example = np.zeros(len(new), np.int64)
            example[which[::-1]] = missing[::-1]
            kept = short[example]
            order = np.argsort(~kept, kind="stable")  # those that stay come first
            place = np.empty(len(new), np.int64)
            place[order] = np.arange(len(new))
            pieces = list(new)
            self._put(known, self._encoded([pieces[i].decode("utf-8", "replace") for i in order.tolist()]))
            number[missing] = known + place[which]
            self.table.add(key[example[order[: int(kept.sum())]]])
        count = self.count[number].astype(np.int64)
        ends = np.cumsum(count)
        total = int(ends[-1])
        out = self.ids[np.repeat(self.first[number] - ends + count, count) + np.arange(total)]
        if len(missing):  # ids of long pieces are not kept
            kept_ids = int(self.count[known : self.table.size].sum())
            self.used = used + kept_ids
        at = np.searchsorted(start, offsets)
        return out, np.r_[0, ends][at]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of texts in UTF-8, one after another, and the n + 1 offsets of the texts into them."""
        out, lengths = [], np.zeros(len(offsets) - 1, np.int64)
        whole = self._with_special(data, offsets)
        for a, b in bs.pieces(offsets, CHUNK_BYTES):
            lo, hi = int(offsets[a]), int(offsets[b])
            if b == a + 1 and a in whole:
                ids = np.array(self._ids(data[lo:hi].tobytes().decode("utf-8", "replace")), np.uint32)
                out.append(ids)
                lengths[a] = len(ids)
            elif hi - lo > 2 * CHUNK_BYTES and b == a + 1:  # a long text, cut at sure places
                for x, y in self._parts(data[lo:hi]):
                    ids, _ = self._chunk(data[lo + x : lo + y], np.array([0, y - x]))
                    out.append(ids)
                    lengths[a] += len(ids)
            else:
                ids, at = self._chunk(data[lo:hi], offsets[a : b + 1] - lo)
                size = np.diff(at)
                for i in whole.intersection(range(a, b)) if whole else ():
                    own = np.array(self._ids(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")), np.uint32)
                    shift = int(size[: i - a].sum())
                    ids = np.concatenate([ids[:shift], own, ids[shift + size[i - a] :]])
                    size[i - a] = len(own)
                out.append(ids)
                lengths[a:b] = size
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.r_[0, np.cumsum(lengths)]

    def _with_special(self, data: np.ndarray, offsets: np.ndarray) -> set[int]:
        """Texts that hold the string of a special token."""
        found: set[int] = set()
        raw = data.tobytes() if self.special else b""
        for text in self.special:
            at = raw.find(text)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(text) <= offsets[i + 1]:
                    found.add(i)
                at = raw.find(text, max(at + 1, int(offsets[i + 1]) if i in found else 0))
        return found

    @staticmethod
    def _parts(data: np.ndarray):
        """Ranges of a long text, cut before blanks that follow an ASCII letter; without such a place it stays whole."""
        first = 0
        while first < len(data):
            last = first + CHUNK_BYTES
            if last < len(data):
                while True:
                    near = data[first + 1 : last]
                    sure = np.flatnonzero(BLANK[near] & ASCII_LETTER[data[first : last - 1]])
                    if len(sure) or last >= len(data):
                        last = first + 1 + int(sure[-1]) if len(sure) and last < len(data) else len(data)
                        break
                    last = min(len(data), 2 * last - first)
            else:
                last = len(data)
            yield first, last
            first = last


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    n = len(at) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    ends = at + np.arange(n + 1)
    inner = np.ones(len(out), bool)
    inner[ends[1:] - 1] = False
    out[inner] = ids
    return out, ends


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer on this machine; a full path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
