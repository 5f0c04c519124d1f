"""Arrow text columns as flat byte arrays: words, hashes of words and windows, and sorted group streams.

Everything works on slices of a few megabytes, whatever the size of an Arrow batch, so that a Python
worker holds a small multiple of :data:`SLICE_BYTES` (or of the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
U64 = np.uint64
_MASK = (1 << 64) - 1
#: White space of a word: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class _Powers:
    """Powers of :data:`BASE` and of its inverse modulo 2**64, as long as has been asked for."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U64), np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, value in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, value & _MASK, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


POWERS = _Powers(BASE)


class Block:
    """Texts as one array of UTF-8 bytes: text ``i`` is ``data[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    @classmethod
    def of(cls, texts: pa.Array) -> "Block":
        """Null texts become empty."""
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        wide = pa.types.is_large_string(texts.type)
        _, offsets, data = texts.buffers()
        if not len(texts) or data is None:
            return cls(np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64))
        at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
        return cls(np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0])

    @classmethod
    def of_list(cls, texts: list[str]) -> "Block":
        return cls.of(pa.array(texts, pa.string()))

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def code_points(self) -> np.ndarray:
        """For each byte position (and the end), the code points that start before it."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out

    def words(self, breaks: np.ndarray = WHITE) -> "Words":
        inside = ~breaks[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.bounds] = True
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= ~inside[:-1]
        after[:-1] |= ~inside[1:]
        starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
        return Words(self, starts, ends, np.searchsorted(starts, self.bounds))

    def prefix_hashes(self, kind: int = 0) -> np.ndarray:
        """Polynomial hashes of all prefixes of ``data``, modulo 2**64."""
        up, _ = POWERS(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_BYTE_CODES[kind][self.data] * up[:len(self.data)], out=out[1:])
        return out

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        prefix = self.prefix_hashes() if prefix is None else prefix
        _, down = POWERS(len(self.data) + 1)
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


class Words:
    """Words of a block; those of text ``i`` are numbers ``of[i]`` to ``of[i + 1]``."""

    def __init__(self, block: Block, starts: np.ndarray, ends: np.ndarray, of: np.ndarray):
        self.block, self.starts, self.ends, self.of = block, starts, ends, of

    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def texts(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.of) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        return self.block.span_hashes(self.starts, self.ends)


def windows(hashes: np.ndarray, of: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` words: (hash, first word, bounds by text).

    A text of fewer words has one window of all its words if ``short``, and none without words.
    """
    n, counts = len(hashes), np.diff(of)
    total = np.zeros(max(n - k + 1, 0), U64)
    for j in range(k):
        total += hashes[j:j + len(total)] * U64(pow(BASE, j + 1, 1 << 64))
    lengths = np.maximum(counts - k + 1, 0)
    first = np.repeat(of[:-1] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum()) if len(counts) else np.zeros(0, np.int64)
    found = mix(total[first])
    if short:
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):
            whole = np.array([sum(int(x) * pow(BASE, j + 1, 1 << 64) for j, x in enumerate(hashes[of[i]:of[i + 1]])) & _MASK for i in few], U64)
            at = np.searchsorted(first, of[few])
            found, first = np.insert(found, at, mix(whole + U64(k) - counts[few].astype(U64))), np.insert(first, at, of[few])
    return found, first, np.searchsorted(first, of)


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = SLICE_BYTES) -> Iterator:
    """The batch in row ranges of about ``limit`` bytes of text (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(lengths), 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end
    # A worker lives on between tasks: what Arrow's pool keeps of a batch would add up over queries.
    pa.default_memory_pool().release_unused()


def column(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy() if isinstance(batch, pa.Table) else batch.column(name).to_numpy(zero_copy_only=False)


def text_array(batch, name: str = "text") -> pa.Array:
    array = batch.column(name)
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from a stream that is sorted by ``keys`` (integers, not null)."""
    held: list[pa.RecordBatch] = []

    def last(batch) -> tuple:
        return tuple(batch.column(k)[-1].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            values = column(batch, k)
            same &= values == values[-1]
        cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            if held and last(held[-1]) != last(batch):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Starts of the groups of a table of whole groups, and its end."""
    change = np.zeros(table.num_rows + 1, bool)
    change[[0, -1]] = True
    for k in keys:
        values = column(table, k)
        change[1:-1] |= values[1:] != values[:-1]
    return np.flatnonzero(change)
