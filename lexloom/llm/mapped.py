"""Files of plain arrays in the shared folder, memory-mapped by readers, and Elias-Fano sequences over such arrays."""

from __future__ import annotations

import json
import mmap
import os
import uuid
from collections.abc import Callable

import numpy as np


def returned() -> None:
    """Give freed memory back to the system; workers live on between tasks, and the allocators would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def local_path(uri: str) -> str | None:
    """The path of a folder that every machine has mounted, None for any other store."""
    if uri.startswith("file:"):
        return uri[5:] if not uri.startswith("file://") else uri[7:]
    return uri if "://" not in uri else None


class Shelf:
    """Named bundles of arrays below one folder. Writing is atomic and may be repeated: the last writer of equal content wins."""

    def __init__(self, uri: str) -> None:
        self.uri, self.path = uri.rstrip("/"), local_path(uri.rstrip("/"))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def put(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        head, at, parts = {}, 0, []
        for key, value in arrays.items():
            value = np.ascontiguousarray(value)
            head[key] = (value.dtype.str, len(value), at)
            gap = -value.nbytes % 8
            parts += [value.tobytes(), b"\0" * gap]
            at += value.nbytes + gap
        text = json.dumps(head).encode()
        text += b" " * (-(len(text) + 8) % 8)
        whole = [len(text).to_bytes(8, "little"), text, *parts]
        part = f"{name}.{uuid.uuid4().hex}"
        if self.path is not None:
            os.makedirs(self.path, exist_ok=True)
            with open(f"{self.path}/{part}", "wb") as file:
                file.writelines(whole)
            os.replace(f"{self.path}/{part}", f"{self.path}/{name}")
            return
        store, root = self._store()
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{part}") as file:
            for p in whole:
                file.write(p)
        store.move(f"{root}/{part}", f"{root}/{name}")

    def get(self, name: str) -> dict[str, np.ndarray]:
        """The arrays as views of a memory map; from a store that isn't mounted, of a copy in memory."""
        if self.path is not None:
            with open(f"{self.path}/{name}", "rb") as file:
                view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            store, root = self._store()
            with store.open_input_stream(f"{root}/{name}") as remote:
                view = remote.read()
        size = int.from_bytes(view[:8], "little")
        head = json.loads(view[8 : 8 + size])
        return {key: np.frombuffer(view, np.dtype(kind), count, 8 + size + at) for key, (kind, count, at) in head.items()}

    def names(self) -> list[str]:
        if self.path is not None:
            return sorted(os.listdir(self.path)) if os.path.isdir(self.path) else []
        from pyarrow import fs

        store, root = self._store()
        return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)))

    def clear(self) -> None:
        if self.path is not None:
            import shutil

            shutil.rmtree(self.path, ignore_errors=True)
            return
        store, root = self._store()
        store.delete_dir(root)


class Held:
    """Bundles of a shelf by name, made into what ``use`` gives as they are met. Maps cost no memory of their own; of copies, those read last
    stay, ``MOST`` bytes of them."""

    MOST = 512 << 20

    def __init__(self, shelf: Shelf, use: Callable[[dict[str, np.ndarray]], object]) -> None:
        self.shelf, self.use = shelf, use
        self.present = set(shelf.names())
        self.ready: dict[str, tuple[object, int]] = {}
        self.size = 0

    def __getitem__(self, name: str):
        """None for a name that the shelf hasn't."""
        if name not in self.ready:
            if name not in self.present:
                return None
            raw = self.shelf.get(name)
            size = sum(a.nbytes for a in raw.values()) if self.shelf.path is None else 0
            while self.ready and self.size + size > self.MOST:
                self.size -= self.ready.pop(next(iter(self.ready)))[1]
            self.ready[name] = (self.use(raw), size)
            self.size += size
        return self.ready[name][0]


ONE = np.uint64(1)


def put_bits(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value, side by side in 64-bit words; one spare word at the end."""
    words = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width and len(values):
        spot = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, shift = (spot >> np.uint64(6)).astype(np.int64), spot & np.uint64(63)
        np.bitwise_or.at(words, word, values << shift)
        over = shift + np.uint64(width) > 64
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return words


def every_byte(words: np.ndarray) -> np.ndarray:
    """A view of the words with a 64-bit number from each byte on, so that a value needs one read wherever it starts."""
    return np.ndarray((words.nbytes - 7,), np.dtype("<u8"), words, 0, (1,))


def get_bits(view: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Values of up to 57 bits from such a view."""
    if not width:
        return np.zeros(len(at), np.uint64)
    spot = at * width
    return (view[spot >> 3] >> (spot & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)


BYTES, TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Position of the one of each rank in each byte.
IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[:8] for byte in range(256)], np.uint8).ravel()


def nth_one(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the one of this rank (from 0) in each word: ones are counted for all eight bytes at once, the byte is the first
    whose running count exceeds the rank, and a table has the place in it."""
    count = word - ((word >> np.uint64(1)) & np.uint64(0x5555555555555555))
    count = (count & np.uint64(0x3333333333333333)) + ((count >> np.uint64(2)) & np.uint64(0x3333333333333333))
    count = ((count + (count >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * BYTES
    rank = rank.astype(np.uint64)
    shift = np.bitwise_count(((rank * BYTES | TOPS) - count) & TOPS).astype(np.uint64) << np.uint64(3)
    rest = rank - (((count << np.uint64(8)) >> shift) & np.uint64(0xFF))
    return (shift + IN_BYTE[(((word >> shift) & np.uint64(0xFF)) << np.uint64(3)) | rest]).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence: low bits side by side, high parts in unary (a one for each value, a zero after each bucket), and counts
    of ones and zeros before each word to select from."""

    KEYS = ("low", "high", "ones", "zeros", "ones_hint", "zeros_hint", "shape")
    SAMPLE = 5  # a hint for each 32 ones or zeros: the word that holds it

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str) -> None:
        low, self.high, self.ones, self.zeros, self.ones_hint, self.zeros_hint, shape = (arrays[f"{prefix}.{k}"] for k in self.KEYS)
        self.low, self.bits = every_byte(low), every_byte(self.high)
        self.size, self.width, self.top = (int(x) for x in shape)

    @staticmethod
    def build(values: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        size = len(values)
        most = int(values[-1]) if size else 0
        width = max(0, (most // max(1, size)).bit_length() - 1)
        bucket = (values >> np.uint64(width)).astype(np.int64)
        top = int(bucket[-1]) if size else 0
        bits = np.zeros((-(-(size + top + 2) // 64) + 1) * 64, np.uint8)
        bits[bucket + np.arange(size)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.append(0, np.cumsum(np.bitwise_count(high).astype(np.int64)))
        zeros = np.arange(len(ones)) * 64 - ones
        low = put_bits(values & np.uint64((1 << width) - 1), width)
        if width > 57:
            raise ValueError("values too far apart")
        hints = [np.searchsorted(c, np.arange(0, c[-1] + 1, 1 << EliasFano.SAMPLE), side="right").astype(np.uint32) - 1 for c in (ones, zeros)]
        made = (low, high, ones.astype(np.uint32), zeros.astype(np.uint32), *hints, np.array([size, width, top], np.int64))
        return {f"{prefix}.{k}": v for k, v in zip(EliasFano.KEYS, made, strict=True)}

    def select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        before, hint = (self.ones, self.ones_hint) if ones else (self.zeros, self.zeros_hint)
        word = hint[rank >> self.SAMPLE].astype(np.int64)
        later = np.flatnonzero(before[word + 1] <= rank)
        for _ in range(4):  # most are a word or two away
            if not later.size:
                break
            word[later] += 1
            later = later[before[word[later] + 1] <= rank[later]]
        if later.size:
            word[later] = np.searchsorted(before, rank[later].astype(before.dtype), side="right") - 1
        return word * 64 + nth_one(self.high[word] if ones else ~self.high[word], rank - before[word])

    def value(self, at: np.ndarray, spot: np.ndarray) -> np.ndarray:
        return ((spot - at).astype(np.uint64) << np.uint64(self.width)) | get_bits(self.low, at, self.width)

    def access(self, at: np.ndarray) -> np.ndarray:
        return self.value(at, self.select(at, True))

    def run(self, spot: np.ndarray, ones: bool) -> np.ndarray:
        """Length of the run of ones (zeros) from each position on; 57 means that or more."""
        word = self.bits[spot >> 3] >> (spot & 7).astype(np.uint64)
        word = word if not ones else ~word
        return np.minimum(np.bitwise_count((word & (~word + ONE)) - ONE), 57).astype(np.int64)

    def after(self, at: np.ndarray, spot: np.ndarray) -> np.ndarray:
        """The values behind those at ``at``, whose ones are at ``spot``."""
        gap = self.run(spot + 1, False)
        nearby = spot + 1 + gap
        if (far := np.flatnonzero(gap >= 57 - 7)).size:
            nearby[far] = self.select(at[far] + 1, True)
        return self.value(at + 1, nearby)

    def successor(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element that is at least ``value`` (the size if there is none), and whether it is equal."""
        out, equal = np.full(len(value), self.size, np.int64), np.zeros(len(value), bool)
        bucket = (value >> np.uint64(self.width)).astype(np.int64)
        inside = np.flatnonzero(bucket <= self.top)
        if not len(inside) or not self.size:
            return out, equal
        bucket, rest = bucket[inside], value[inside] & np.uint64((1 << self.width) - 1)
        spot = np.where(bucket > 0, self.select(np.maximum(bucket - 1, 0), False) + 1, 0)
        start, held = spot - bucket, self.run(spot, True)
        stop = start + held
        if (far := np.flatnonzero(held >= 57 - 7)).size:
            stop[far] = self.select(bucket[far], False) - bucket[far]
        some = np.flatnonzero(start < stop)  # the others' buckets are empty
        row, low, high, want, last = some, start[some], stop[some], rest[some], stop[some]
        while row.size:
            middle = (low + high) >> 1
            less = get_bits(self.low, middle, self.width) < want
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
            over = low >= high
            done = np.flatnonzero(over)
            start[row[done]] = low[done]
            found = done[low[done] < last[done]]
            equal[inside[row[found]]] = get_bits(self.low, low[found], self.width) == want[found]
            open_ = np.flatnonzero(~over)
            row, low, high, want, last = row[open_], low[open_], high[open_], want[open_], last[open_]
        out[inside] = start
        return out, equal
