"""n-gram language model in an Elias-Fano trie, trained on the corpus and scoring all of it.

Words are 64-bit hashes, taken from flat arrays: a word of up to 16 bytes is two masked 64-bit loads, mixed; a longer one goes through
XXH64. The vocabulary is dealt over shards by the hash's top bits; ids interleave the shards' frequency ranks, so frequent words have
small ids.

Shards: their number follows from the training text's bytes (``SHARD_BYTES`` each), so a shard doesn't grow with the corpus. An n-gram
lives in the shard of its first word, but where that word is frequent (its id is below ``hot``, a bound that a count of more than
1 / (8 x shards) of all words sets) in one that its first two words give. So no shard holds all grams of "the" or of the text start, and a shard
still holds whole subtries. Of a frequent word's grams every shard has a part; how many kinds of successors it has is summed over them.

A level is two monotone sequences. Pointers: where each context's successors begin. Nodes: a context's successor ids, ascending, shifted by
the last value before them, so that the whole level ascends. A look-up reads the context's pointers, takes the value before its
range as base, and finds the successor of base + id; it must lie in the range and be equal. Look-ups of a run of texts are made
once for each different n-gram, in the trie's order. Each node keeps its discounted probability and its back-off weight, both as 16-bit
codes of -log10 in steps of 1/4096; a value below 10^-15.99, which takes a count of some 10^15, is stored as that. A probability is

    P(w | h) = max(count - D, 0) / count(h) + D * types(h) / count(h) * P(w | shorter h),   P(w) = (c + 0.1) / (N + 0.1 (V + 1)).

Files lie in the shared folder; workers map them, nothing is broadcast or collected but one number for each frequent word. Counting emits, for
each run of ``FLUSH_TOKENS`` and shard, sorted keys as compressed byte planes of their differences.

Defined cases: null, empty or blank texts score the end token alone; texts and words of any length count whole (a text longer than a run is a
run of its own); a null id counts as training; repeated rows count and score each, and equal texts get equal scores; an empty table
gives an empty result; with no training text every probability is that of an unknown token (N = V = 0 leaves 0.1 / 0.1 = 1, a score of 0); other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep, map_batches, shared_dir, slices, texts
from .mapped import EliasFano, Held, Shelf, returned

ORDER, DISCOUNT, ADDED = 3, 0.75, 0.1
START, END, UNKNOWN, FIRST_WORD = range(4)
FLUSH_WORDS, FLUSH_TOKENS, RUN_BYTES = 400_000, 1_000_000, 4 << 20
SHARD_BYTES, LEAST_SHARDS, HOT_SHARE = 12 << 20, 8, 8
CODES = 4096  # codes a unit of -log10
BLOB = "shard int, level int, n long, blob binary"

BLANK = np.zeros(256, bool)
BLANK[[*range(9, 14), 32]] = True
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LENGTH_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(value: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of MurmurHash3)."""
    value = (value ^ (value >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    value = (value ^ (value >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return value ^ (value >> np.uint64(33))


def word_hashes(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word (A-Z lowered, ASCII white space between), and the number of words of each text."""
    whole = b"\n".join([*own, b"\n" * 16]).lower()  # on bytes, ASCII only
    blank = BLANK[np.frombuffer(whole, np.uint8)]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.append(0, edge)
    start, size = edge[::2], edge[1::2] - edge[::2]
    texts_at = np.cumsum([0, *(len(t) + 1 for t in own)])
    number = np.diff(np.searchsorted(start, texts_at))
    view = np.ndarray((len(whole) - 7,), np.dtype("<u8"), whole, 0, (1,))
    rest = size.astype(np.uint64) * LENGTH_MIX
    more = np.flatnonzero(size > 8)
    rest[more] += view[start[more] + 8] & LOW_BYTES[np.minimum(size[more] - 8, 8)]
    out = mixed((view[start] & LOW_BYTES[np.minimum(size, 8)]) ^ mixed(rest))
    for i in np.flatnonzero(size > 16).tolist():
        out[i] = xxhash.xxh64_intdigest(whole[start[i] : start[i] + size[i]])
    return out, number


def planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(data, kind: type, count: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, count * size).reshape(size, count).T).view(kind).ravel()


def deltas(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def top_shard(hashed: np.ndarray, shards: int) -> np.ndarray:
    return ((hashed >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pressed(parts: list[bytes]) -> bytes:
    return pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def opened(blob: pa.Buffer, size: int) -> pa.Buffer:
    return pa.decompress(blob, decompressed_size=size, codec="zstd")


def table(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "level", "n", "blob"])


def emitted(docs: DataFrame, make) -> DataFrame:
    """``mapInArrow`` where ``make`` gives (add, flush): ``add`` may and ``flush`` does return rows of ``BLOB``."""

    def run(batches):
        add, flush = make()
        for batch in batches:
            for part in slices(batch, "text", RUN_BYTES):
                if rows := add(texts(part)):
                    yield table(rows)
                    returned()
        yield table(flush())
        returned()

    return docs.select("text").mapInArrow(run, BLOB)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate(keys)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.concatenate(counts)[order].astype(np.uint64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def word_counts(docs: DataFrame, shards: int) -> DataFrame:
    def make():
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush() -> list[tuple]:
            if not keys:
                return []
            key, number = summed(keys, counts)
            keys.clear()
            counts.clear()
            edges = np.searchsorted(top_shard(key, shards), np.arange(shards + 1))
            return [(s, 0, int(b - a), pressed([planes(deltas(key[a:b])), planes(number[a:b])])) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]

        def add(own: list[bytes]) -> list[tuple]:
            key, number = np.unique(word_hashes(own)[0], return_counts=True)
            keys.append(key)
            counts.append(number)
            if sum(map(len, keys)) <= FLUSH_WORDS:
                return []
            key, number = summed(keys, counts)
            keys[:], counts[:] = [key], [number]
            return flush() if len(key) > FLUSH_WORDS // 2 else []

        return add, flush

    return emitted(docs, make)


def blobs_of(part: pa.Table) -> list[tuple[int, int, pa.Buffer]]:
    """(level, n, blob) of each row; the blobs stay where Arrow has them."""
    held = [b.as_buffer() for chunk in part["blob"].chunks for b in chunk]
    return list(zip(part["level"].to_pylist(), part["n"].to_pylist(), held, strict=True))


def build_vocabulary(blobs: DataFrame, uri: str, shards: int) -> tuple[int, int]:
    """Write the vocabulary's shards; give the numbers of distinct words and of words."""

    def build(key: tuple, part: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys, counts = [], []
        for _, n, blob in blobs_of(part):
            blob = opened(blob, 16 * n)
            keys.append(np.cumsum(from_planes(blob, np.uint64, n), dtype=np.uint64))
            counts.append(from_planes(blob[8 * n :], np.uint64, n))
        hashed, count = summed(keys, counts)
        if (len(count) + 1) * shards + FIRST_WORD >= 1 << 32:
            raise ValueError("more words than 32-bit ids; take fewer shards")
        rank = np.empty(len(count), np.int64)
        by_rank = np.lexsort((hashed, -count.astype(np.int64)))
        rank[by_rank] = np.arange(len(count))
        Shelf(uri).put(f"words-{shard}", {"hash": hashed, "id": (rank * shards + shard + FIRST_WORD).astype(np.uint32), "count": count, "by_rank": by_rank})
        return pa.table({"types": pa.array([len(count)], pa.int64()), "words": pa.array([int(count.sum())], pa.int64())})

    totals = blobs.groupBy("shard").applyInArrow(build, "types long, words long").agg(F.sum("types"), F.sum("words")).first()
    return int(totals[0] or 0), int(totals[1] or 0)


def frequent(spark: SparkSession, uri: str, shards: int, words: int, trained: int) -> np.ndarray:
    """How often each id below ``hot`` is a context. ``hot`` is the least bound on whole ranks above all words with more than
    1 / (``HOT_SHARE`` x shards) of all words: at most ``HOT_SHARE`` x shards words have that, dealt over the shards by their hash."""
    least = max(1, words // (HOT_SHARE * shards))

    def ranks(batches):
        shelf = Shelf(uri)
        present = set(shelf.names())
        for batch in batches:
            own = [s for s in batch.column(0).to_pylist() if f"words-{s}" in present]
            depth = []
            for s in own:
                raw = shelf.get(f"words-{s}")
                depth.append(int(np.searchsorted(-raw["count"][raw["by_rank"]].astype(np.int64), -least, side="right")))
            yield pa.RecordBatch.from_arrays([pa.array(depth, pa.int64())], names=["depth"])

    depth = spark.range(shards).mapInArrow(ranks, "depth long").agg(F.max("depth")).first()[0] or 0

    def tops(batches):
        shelf = Shelf(uri)
        present = set(shelf.names())
        for batch in batches:
            ids: list[int] = []
            counts: list[int] = []
            for s in batch.column(0).to_pylist():
                if f"words-{s}" in present:
                    raw = shelf.get(f"words-{s}")
                    top = raw["by_rank"][:depth]
                    ids += raw["id"][top].tolist()
                    counts += raw["count"][top].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=["id", "n"])

    out = np.zeros(FIRST_WORD + depth * shards, np.int64)
    out[START] = trained
    if depth:
        for number, count in spark.range(shards).mapInArrow(tops, "id long, n long").collect():  # depth x shards rows
            out[number] = count
    return out


class Vocabulary:
    """Ids and training counts of words, from the mapped shards."""

    def __init__(self, uri: str, shards: int) -> None:
        self.shards, self.parts = shards, Held(Shelf(uri), lambda raw: raw)

    def __call__(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of each word; each different one is looked up once, in the order of the shards."""
        key, where = distinct(hashed)
        ids, counts = np.full(len(key), UNKNOWN, np.int64), np.zeros(len(key))
        edges = np.searchsorted(top_shard(key, self.shards), np.arange(self.shards + 1))
        for shard in np.flatnonzero(np.diff(edges)):
            part = self.parts[f"words-{shard}"]
            if part is None:
                continue
            run = slice(edges[shard], edges[shard + 1])
            at = np.minimum(np.searchsorted(part["hash"], key[run]), len(part["hash"]) - 1)
            hit = np.flatnonzero(part["hash"][at] == key[run])
            at = at[hit]
            ids[run][hit], counts[run][hit] = part["id"][at], part["count"][at]
        return ids[where], counts[where]


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, ascending, and where each value is among them."""
    order = np.argsort(key)
    ascending = key[order]
    first = np.append(True, ascending[1:] != ascending[:-1])[: len(key)]
    where = np.empty(len(key), np.int64)
    where[order] = np.cumsum(first) - 1
    return ascending[first], where


def stream(own: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, each between START and END; counts beside them; each token's place in its text; where texts start."""
    hashed, number = word_hashes(own)
    ids, counts = vocabulary(hashed)
    size = number + 2
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    full, beside = np.full(len(place), START, np.int64), np.zeros(len(place))
    full[first + size - 1] = END
    inner = (place > 0) & (full != END)
    full[inner], beside[inner] = ids, counts
    return full, beside, place, first


def home_of(first: np.ndarray, second: np.ndarray, hot: int, shards: int) -> np.ndarray:
    """The shard of n-grams by their first two ids."""
    spread = mixed((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)) >> np.uint64(33)
    return np.where(first < hot, spread.astype(np.int64) % shards, first % shards).astype(np.uint16 if shards <= 1 << 16 else np.int64)  # sixteen bits sort by radix


def context_of(first: np.ndarray, hot: int, shards: int) -> np.ndarray:
    """Number of a first word among the contexts of its shard; ascends with the id."""
    return np.where(first < hot, first, hot + (first - hot) // shards)


def ngram_counts(docs: DataFrame, uri: str, shards: int, hot: int, order: int) -> DataFrame:
    """Blobs for each shard and level: the first word's context number and the second word's id as differences, further ids, counts."""

    def make():
        vocabulary = Vocabulary(uri, shards)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> list[tuple]:
            out: list[tuple] = []
            if not held:
                return out
            ids, place = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held.clear()
            number = ids.astype(np.uint64)  # of the gram that ends here; a unigram's is its id
            head = home = np.zeros(0)
            rest: list[np.ndarray] = []  # the ids behind the second
            for level in range(2, order + 1):
                here = np.flatnonzero(place >= level - 1)
                if not len(here):
                    break
                key, where = distinct((number[here - 1] << np.uint64(32)) | ids[here].astype(np.uint64))
                count = np.bincount(where, minlength=len(key)).astype(np.uint32)
                first, last = (key >> np.uint64(32)).astype(np.int64), key & np.uint64(0xFFFFFFFF)
                if level == 2:
                    home = home_of(first, last, hot, shards)
                    head = (context_of(first, hot, shards).astype(np.uint64) << np.uint64(32)) | last
                else:
                    home, head = home[first], head[first]
                    rest = [*(r[first] for r in rest), last.astype(np.uint32)]
                by_home = np.argsort(home, kind="stable")
                edges = np.append(0, np.cumsum(np.bincount(home, minlength=shards)))
                for s in np.flatnonzero(np.diff(edges)):
                    rows = by_home[edges[s] : edges[s + 1]]
                    out.append((int(s), level, len(rows), pressed([planes(deltas(head[rows])), *(planes(r[rows]) for r in rest), planes(count[rows])])))
                number = np.zeros(len(ids), np.uint64)
                number[here] = where.astype(np.uint64)
            return out

        def add(own: list[bytes]) -> list[tuple]:
            ids, _, place, _ = stream(own, vocabulary)
            held.append((ids, place))
            return flush() if sum(len(h[0]) for h in held) > FLUSH_TOKENS else []

        return add, flush

    return emitted(docs, make)


def coded(value: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(value) * CODES), 0, 0xFFFF).astype(np.uint16)


#: The value of each code.
VALUES = 10.0 ** (np.arange(1 << 16) / -CODES)


def build_tries(blobs: DataFrame, uri: str, shards: int, often: np.ndarray, discount: float, folder: str) -> int:
    """Write each shard's levels and the frequent words' back-off weights; give the number of n-grams. ``often``: from ``frequent``."""
    hot = len(often)

    def build(key: tuple, part: pa.Table) -> pa.Table:
        shard, total = key[0].as_py(), 0
        arrays: dict[str, np.ndarray] = {}
        rows = blobs_of(part)
        keys_of: dict[int, np.ndarray] = {}  # (context node, id) of each node
        kinds = np.zeros(hot, np.int64)
        for level in sorted({r[0] for r in rows}):
            keys, counts = [], []
            for own, n, blob in rows:
                if own != level:
                    continue
                blob = opened(blob, (8 + 4 * (level - 2) + 4) * n)
                head = np.cumsum(from_planes(blob, np.uint64, n), dtype=np.uint64)
                at = 8 * n
                for deeper in range(3, level + 1):
                    node = np.searchsorted(keys_of[deeper - 1], head).astype(np.uint64)
                    head = (node << np.uint64(32)) | from_planes(blob[at:], np.uint32, n).astype(np.uint64)
                    at += 4 * n
                keys.append(head)
                counts.append(from_planes(blob[at:], np.uint32, n))
            node_keys, count = summed(keys, counts)
            del keys, counts
            keys_of[level] = node_keys
            context, last = (node_keys >> np.uint64(32)).astype(np.int64), node_keys & np.uint64(0xFFFFFFFF)
            contexts = int(context[-1]) + 1 if level == 2 else len(keys_of[level - 1])
            types = np.bincount(context, minlength=contexts)
            sums = np.bincount(context, count.astype(np.float64), contexts)
            if level == 2:  # a frequent word's successors are dealt over all shards
                known = min(hot, contexts)
                kinds[:known] = types[:known]
                sums[:known] = often[:known]
            begin = np.append(0, np.cumsum(types))
            span = np.zeros(contexts, np.uint64)
            used = types > 0
            span[used] = last[begin[1:][used] - 1]
            base = np.cumsum(span) - span
            arrays |= EliasFano.build(begin, f"{level}.begin") | EliasFano.build(base[context] + last, f"{level}.node")
            arrays[f"{level}.part"] = coded((count - discount) / sums[context])
            arrays[f"{level}.rest"] = coded(np.where(used, discount * types / np.maximum(sums, 1), 1.0))
            total += len(node_keys)
        Shelf(uri).put(f"trie-{shard}", arrays)
        arrays.clear()
        keys_of.clear()
        returned()
        some = np.flatnonzero(kinds)
        return pa.table({"hot": pa.array([-1, *some.tolist()], pa.int64()), "n": pa.array([total, *kinds[some].tolist()], pa.int64())})

    built = keep(blobs.groupBy("shard").applyInArrow(build, "hot long, n long"), folder, "built")
    kinds = np.zeros(hot, np.int64)
    total = 0
    for number, n in built.groupBy("hot").agg(F.sum("n")).collect():  # one row for each frequent word
        if number < 0:
            total = n
        else:
            kinds[number] = n
    Shelf(uri).put("hot", {"rest": coded(np.where(kinds > 0, discount * np.maximum(kinds, 1) / np.maximum(often, 1), 1.0))})
    return int(total)


class Trie:
    """Look-ups in the mapped shards."""

    def __init__(self, uri: str, shards: int, order: int) -> None:
        self.shards, self.order = shards, order
        self.parts = Held(Shelf(uri), self.levels)
        hot = self.parts["hot"]
        self.hot_rest = np.ones(FIRST_WORD) if hot is None else VALUES[hot["rest"]]

    @property
    def hot(self) -> int:
        return len(self.hot_rest)

    def levels(self, raw: dict[str, np.ndarray]) -> dict:
        """A shard's levels; another bundle as it is."""
        if "rest" in raw:
            return raw
        found = [level for level in range(2, self.order + 1) if f"{level}.part" in raw]
        return {n: (EliasFano(raw, f"{n}.begin"), EliasFano(raw, f"{n}.node"), raw[f"{n}.part"], raw[f"{n}.rest"]) for n in found}

    def look_up(self, level: int, home: np.ndarray, context: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each (shard, context number in it, id), ascending: node number or -1, discounted probability or 0, the context's back-off weight."""
        node, part, rest = np.full(len(last), -1, np.int64), np.zeros(len(last)), np.ones(len(last))
        edges = np.append(0, np.cumsum(np.bincount(home, minlength=self.shards)))
        for s in np.flatnonzero(np.diff(edges)):
            own = (self.parts[f"trie-{s}"] or {}).get(level)
            if own is None:
                continue
            begin, nodes, parts, rests = own
            a, b = int(edges[s]), int(edges[s + 1])
            b = a + int(np.searchsorted(context[a:b], len(rests)))  # contexts behind the last one with successors
            if a == b:
                continue
            new = np.flatnonzero(np.append(True, context[a + 1 : b] != context[a : b - 1]))
            times = np.diff(np.append(new, b - a))
            at = context[a:b][new]
            mark = begin.select(at, True)
            low, high = begin.value(at, mark).astype(np.int64), begin.after(at, mark).astype(np.int64)
            rest[a:b] = np.repeat(VALUES[rests[at]], times)
            base = np.zeros(len(at), np.uint64)
            some = np.flatnonzero((low > 0) & (low < high))
            base[some] = nodes.access(low[some] - 1)
            rows = np.arange(a, b)
            if (dry := low >= high).any():  # without successors
                asked = np.repeat(~dry, times)
                rows = rows[asked]
                low, high, base, times = low[~dry], high[~dry], base[~dry], times[~dry]
            spot, equal = nodes.successor(np.repeat(base, times) + last[rows].astype(np.uint64))
            equal &= (spot >= np.repeat(low, times)) & (spot < np.repeat(high, times))
            rows, spot = rows[equal], spot[equal]
            node[rows], part[rows] = spot, VALUES[parts[spot]]
        return node, part, rest


def probabilities(ids: np.ndarray, place: np.ndarray, alone: np.ndarray, trie: Trie) -> np.ndarray:
    """P of every token given those before it in its text; START has 1. ``alone``: the unigram probabilities."""
    out = alone.copy()
    gram = np.where(ids == UNKNOWN, -1, ids)  # number of the gram that ends here, -1 if training hasn't it; a unigram's is its id
    home = node = np.zeros(0, np.int64)  # of the level's grams by number
    for level in range(2, trie.order + 1):
        here = np.flatnonzero((place >= level - 1) & (np.append(-1, gram[:-1]) >= 0))
        if not len(here):
            break
        key, where = distinct((gram[here - 1].astype(np.uint64) << np.uint64(32)) | ids[here].astype(np.uint64))
        first, last = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if level == 2:
            own = home_of(first, last, trie.hot, trie.shards)
            by_home = np.argsort(own, kind="stable")
            back = np.empty(len(by_home), np.int64)
            back[by_home] = np.arange(len(by_home))
            home, first, last, where = own[by_home], first[by_home], last[by_home], back[where]
            node, part, rest = trie.look_up(level, home, context_of(first, trie.hot, trie.shards), last)
            hot = first < trie.hot
            rest[hot] = trie.hot_rest[first[hot]]
        else:
            found, part, rest = trie.look_up(level, home[first], node[first], last)
            home, node = home[first], found
        out[here] = part[where] + rest[where] * out[here]
        gram = np.full(len(ids), -1, np.int64)
        gram[here] = np.where(node[where] >= 0, where, -1)
    out[place == 0] = 1.0
    return out


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def scored(docs: DataFrame, uri: str, shards: int, order: int, types: int, words: int, trained: int) -> DataFrame:
    ends = trained
    n, v = words + ends, types + (ends > 0)
    whole = n + ADDED * (v + 1)

    def make():
        vocabulary, trie = Vocabulary(uri, shards), Trie(uri, shards, order)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sums: list[np.ndarray] = []
            for run in slices(batch, "text", RUN_BYTES):
                ids, counts, place, first = stream(texts(run), vocabulary)
                counts[ids == END] = ends
                alone = (counts + ADDED) / whole
                inner = place > 0
                base = np.where(inner, np.log10(alone), 0.0)
                own = np.where(inner, np.log10(probabilities(ids, place, alone, trie)), 0.0)
                known = inner & (counts > 0)
                sums.append(np.stack([np.add.reduceat(x.astype(np.float64), first) for x in (inner, known, base, own)]))
            returned()
            n_tokens, n_known, base, own = np.concatenate(sums, axis=1)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(own)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

        return each

    return map_batches(docs.select("doc_id", "text"), make, SCORED)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def train_and_score(docs: DataFrame, held: Column, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """Train on the rows where ``held`` is false, score all rows."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    uri = f"{folder}/model"
    training = docs.filter(~held)
    trained, size = training.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(LEAST_SHARDS, -(-size // SHARD_BYTES))
    types, words = build_vocabulary(word_counts(training, shards), uri, shards)
    often = frequent(spark, uri, shards, words, trained)
    build_tries(ngram_counts(training, uri, shards, len(often), order), uri, shards, often, discount, folder)
    out = keep(scored(docs, uri, shards, order, types, words, trained), folder, "scores")
    Shelf(uri).clear()
    return out.withColumn("train_tokens", F.lit(words + trained).cast("long"))


def op8_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = train_and_score(docs, held_out(F.col("doc_id")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
