"""Byte-level BPE in batched numpy merge rounds, and its decoding.

A run of texts is cut into words on flat arrays: each code point has a class (letter, number, space, other), and where a word starts
follows from neighbouring classes, as the tokenizer's pattern has it. Words not met before are encoded together: the symbols of all
of them lie in one flat array; the rank of each adjacent pair comes from a binary search over the sorted pair keys; in a round every
word merges its lowest-ranked pair wherever it occurs, left to right; finished words leave the array; only pairs beside a merge are
looked up again. Words of more than ``LONG`` bytes (one unbroken run) would need a round for each of their ranks, so they merge through a heap.

Memory: texts are taken in runs of ``RUN_BYTES``; a worker remembers words that take ``REMEMBERED`` bytes in all (a word's own and
``ENTRY`` for what is kept of it), then starts anew.

Defined cases: null or empty text gives no ids (the digests of nothing); the added token's string in a text becomes its id; pairs of equal
rank merge left to right; null ids, repeated rows and texts of any length pass through; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_batches, slices, texts, tokenizer_file

LONG, RUN_BYTES, REMEMBERED, ENTRY = 512, 2 << 20, 64 << 20, 200
NONE = np.int32(0x7FFFFFFF)
OTHER, LETTER, NUMBER, SPACE = range(4)
#: The pattern's contractions, and the white space of Unicode.
SHORT_ENDS, LONG_ENDS = "stmd", ("re", "ve", "ll")
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers that Unicode 16 has beyond version 15.1, which Python's tables follow; the tokenizer knows them.
LATER_LETTERS = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0"
LATER_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"


def classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        major = unicodedata.category(chr(code))[0]
        if major in "LN":
            table[code] = LETTER if major == "L" else NUMBER
    for ranges, kind in ((LATER_LETTERS, LETTER), (LATER_NUMBERS, NUMBER)):
        for part in ranges.split():
            first, _, last = part.partition("-")
            table[int(first, 16) : int(last or first, 16) + 1] = kind
    table[SPACES] = SPACE
    return table


def shown_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, byte_of = spec["model"]["vocab"], shown_bytes()
        self.size = 1 + max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])) if spec["added_tokens"] else 1 + max(vocab.values())
        self.bytes_of: list[bytes] = [b""] * self.size
        self.first = np.zeros(256, np.int32)
        for token, number in vocab.items():
            self.bytes_of[number] = bytes(byte_of[c] for c in token)
            if len(token) == 1:
                self.first[byte_of[token]] = number
        self.added = [(t["content"].encode(), t["id"]) for t in spec["added_tokens"]]
        for content, number in self.added:
            self.bytes_of[number] = content
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.table = classes()
        self.forget()

    def forget(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.ids_of: list[list[int]] = []
        self.held = 0

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def word_starts(self, code: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """True where a word starts. ``fresh``: True where a text starts."""
        kind = self.table[code]
        start = fresh.copy()
        start[1:] |= kind[1:] != kind[:-1]
        turn = np.flatnonzero(start[1:] & ~fresh[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
        start[turn - 1] = True  # the last space of a run stands apart ...
        start[turn[code[turn - 1] == 32]] = False  # ... and belongs to what follows if it is a plain one
        quote = np.flatnonzero((code[:-1] == 39) & start[:-1] & ~fresh[1:] & (kind[1:] == LETTER))
        if len(quote):
            limit = len(code)
            second = code[quote + 1]
            whole = quote + 2 < limit
            third = np.where(whole & ~fresh[np.minimum(quote + 2, limit - 1)], code[np.minimum(quote + 2, limit - 1)], 0)
            size = np.where(np.isin(second, [ord(c) for c in SHORT_ENDS]), 2, 0)
            for a, b in LONG_ENDS:
                size = np.where((second == ord(a)) & (third == ord(b)), 3, size)
            quote, size = quote[size > 0], size[size > 0]
            start[quote + 1] = False
            after = quote + size
            start[after[after < limit]] = True
        return start

    def words(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """All words of the pieces, and each piece's first word."""
        whole = b"".join(pieces)
        if not whole:
            return [], np.zeros(len(pieces) + 1, np.int64)
        code = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        at = np.append(np.flatnonzero((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80), len(whole))
        edges = np.cumsum([0, *map(len, pieces)])
        fresh = np.zeros(len(code) + 1, bool)
        fresh[np.searchsorted(at, edges)] = True
        start = np.flatnonzero(self.word_starts(code, fresh[:-1]))
        cuts = np.append(at[start], len(whole))
        spots = cuts.tolist()
        return [whole[a:b] for a, b in zip(spots, spots[1:], strict=False)], np.searchsorted(cuts[:-1], edges)

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, by merge rounds over one flat array."""
        out: list[list[int]] = [[]] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(size > LONG):
            out[i] = self.long_word(words[i])
        short = np.flatnonzero((size <= LONG) & (size > 0))
        if not len(short):
            return out
        symbol = self.first[np.frombuffer(b"".join([words[i] for i in short]), np.uint8)]
        word = np.repeat(np.arange(len(short)), size[short])
        rank = np.full(len(symbol), NONE, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            length = np.diff(np.append(first, len(word)))
            low = np.minimum.reduceat(rank, first)
            if (over := low == NONE).any():
                gone = np.repeat(over, length)
                done.append((word[gone], symbol[gone]))
                stay = ~gone
                symbol, word, rank = symbol[stay], word[stay], rank[stay]
                low, length = low[~over], length[~over]
                if not len(symbol):
                    break
            hit = rank == np.repeat(low, length)
            spot = np.flatnonzero(hit)
            apart = np.append(True, np.diff(spot) != 1)  # "aaa" holds its pair twice; the left one is merged
            run = np.maximum.accumulate(np.where(apart, np.arange(len(spot)), 0))
            spot = spot[(np.arange(len(spot)) - run) % 2 == 0]
            symbol[spot] = self.made[rank[spot]]
            alive = np.ones(len(symbol), bool)
            alive[spot + 1] = False
            near = np.zeros(len(symbol), bool)
            near[spot] = True
            symbol, word, rank, near = symbol[alive], word[alive], rank[alive], near[alive]
            near[:-1] |= near[1:].copy()
            redo = np.flatnonzero(near)
            rank[redo] = NONE
            redo = redo[redo + 1 < len(symbol)]
            redo = redo[word[redo] == word[redo + 1]]
            rank[redo] = self.rank(symbol[redo], symbol[redo + 1])
        word, symbol = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        order = np.argsort(word, kind="stable")
        symbol = symbol[order].tolist()
        ends = np.cumsum(np.bincount(word, minlength=len(short))).tolist()
        begin = 0
        for i, end in zip(short.tolist(), ends, strict=True):
            out[i] = symbol[begin:end]
            begin = end
        return out

    def long_word(self, word: bytes) -> list[int]:
        symbol = self.first[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(symbol)), -1], [*range(-1, len(symbol) - 1)]
        lookup = self.pair_ranks()
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbol, symbol[1:], strict=False)) if (r := lookup.get(a * self.size + b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if symbol[i] == a else -1
            if j < 0 or symbol[j] != b:
                continue
            symbol[i], symbol[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := lookup.get(symbol[left] * self.size + symbol[right])) is not None:
                    heapq.heappush(heap, (r, left, symbol[left], symbol[right]))
        return [s for s in symbol if s >= 0]

    def pair_ranks(self) -> dict[int, int]:
        if not hasattr(self, "_pair_ranks"):
            self._pair_ranks = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        return self._pair_ranks

    def encode(self, batch: list[bytes]) -> list[list[int]]:
        """Ids of each text."""
        pieces: list[bytes] = []
        plan: list[list[int]] = []  # a text's pieces by number, added tokens as -1 - id
        for text in batch:
            parts: list[bytes | int] = [text]
            for content, number in self.added:
                parts = [x for part in parts for x in (self.cut(part, content, number) if isinstance(part, bytes) else [part])]
            own = []
            for part in parts:
                if isinstance(part, int):
                    own.append(-1 - part)
                elif part:
                    own.append(len(pieces))
                    pieces.append(part)
            plan.append(own)
        words, first = self.words(pieces)
        if self.held > REMEMBERED:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in self.seen]
        self.held += sum(map(len, new)) + ENTRY * len(new)
        base = len(self.ids_of)
        self.seen.update(zip(new, range(base, base + len(new)), strict=True))
        self.ids_of += self.merged(new)
        seen, ids_of = self.seen, self.ids_of
        spots = first.tolist()
        out = []
        for own in plan:
            ids: list[int] = []
            for number in own:
                if number < 0:
                    ids.append(-1 - number)
                else:
                    for w in words[spots[number] : spots[number + 1]]:
                        ids += ids_of[seen[w]]
            out.append(ids)
        return out

    @staticmethod
    def cut(text: bytes, content: bytes, number: int) -> list[bytes | int]:
        out: list[bytes | int] = []
        for i, part in enumerate(text.split(content)):
            out += [number, part] if i else [part]
        return out

    def decode(self, ids: list[int]) -> str:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[i] for i in ids]).decode("utf-8", "replace")


_ENCODERS: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """One for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, name: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """Encode each text, decode its ids, and give the digests of both."""

    def make():
        bpe = encoder(tokenizer_file(name, folder))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, decoded = [], [], []
            for part in slices(batch, "text", RUN_BYTES):
                for ids in bpe.encode(texts(part)):
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return each

    return map_batches(docs.select("doc_id", "text"), make, ENCODED)


def token_ids(docs: DataFrame, name: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """doc_id and the array of ids of each text."""

    def make():
        bpe = encoder(tokenizer_file(name, folder))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [i for part in slices(batch, "text", RUN_BYTES) for i in bpe.encode(texts(part))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

        return each

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, ids array<int>")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
