"""Vectorised text kernels shared by the operators of this package.

Everything works on one ``Batch``: the texts of some rows as one byte buffer
with offsets, in an order that depends on the rows' content only.  No hash
depends on the machine, the process or the order of arrival.

Words are told apart by chained scrambling of their bytes, eight at a time,
which no structure of a text can cancel; passages by 128-bit digests of their
bytes.  The polynomial ``prefix_hash`` can be cancelled, so it only picks anchors:
equal contents get equal anchors, and that is all an anchor has to promise.
"""

from __future__ import annotations

import ctypes
import inspect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: Arithmetic modulo 2**64 wraps on purpose.
np.seterr(over="ignore")

_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
#: Bytes worked on at once, so that intermediate arrays stay in the cache.
CHUNK = 1 << 18
#: Bytes of text whose counts are held at once.
PORTION = 1 << 22
#: A null doc_id sorts before every other.
NULL_ID = np.iinfo(np.int64).min
LONE = U(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the SplitMix64 finaliser)."""
    x = np.asarray(x, dtype=np.uint64) + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(256, dtype=np.uint64) + U(1000))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The first n bytes of a little-endian 64-bit value.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Longer words are hashed one by one.
LONG_WORD = 64
_powers: dict[str, np.ndarray] = {}
#: What one kind of work keeps for its next task in the same worker, under (kind, name).
KEPT: dict[tuple[str, str], object] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK * 2)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums H of values[i] * base**i, with a leading 0."""
    up, _ = powers(len(values))
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * up, out=out[1:])
    return out


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of a byte buffer; lanes are independent of each other."""
    size, odd = end - start, U(0x9FB21C651E98DF25 + 2 * lane)
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix((eight[start] & _FIRST[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * U(0xD6E8FEB86659FD93) + U(lane)))
    more = np.flatnonzero(size > 8)
    for done in range(8, LONG_WORD, 8):
        more = more[size[more] > done]
        if not len(more):
            break
        out[more] = mix(out[more] * odd ^ (eight[start[more] + done] & _FIRST[np.minimum(size[more] - done, 8)]))
    if len(more):
        more = more[size[more] > LONG_WORD]
        view = memoryview(np.ascontiguousarray(data))
        out[more] = [xxhash.xxh3_64_intdigest(view[a:b], lane) for a, b in zip(start[more].tolist(), end[more].tolist())]
    return out


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, 2) values: the 128-bit digests of the bytes of the spans [start, end)."""
    view, one = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([one(view[a:b]) for a, b in zip(start.tolist(), end.tolist())]), np.uint64).reshape(-1, 2)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each ``width`` consecutive values, by scrambled doubling."""
    out, at, level, span = None, 0, mix(values + U(width)), 1
    while True:
        if width & span:
            part = level[at : at + len(values) - width + 1]
            out = part if out is None else mix(out * U(0x9FB21C651E98DF25) ^ part)
            at += span
        if span * 2 > width:
            return out
        level = mix(level[: len(level) - span] * U(0x9E3779B97F4A7C15) ^ level[span:])
        span *= 2


def release() -> None:
    """Gives memory that finished work no longer needs back to the machine, which JVM and workers share."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def drop_kept(kind: str | None = None) -> None:
    """Drops what other kinds of work have kept: a worker that takes up something else shares its memory with it."""
    for key in [k for k in KEPT if k[0] != kind]:
        del KEPT[key]


def thrifty(work, kind: str | None = None):
    """A function of one table for groups, or of an iterator of batches, that releases memory when it is done, and at first what other kinds of work have kept."""
    if inspect.isgeneratorfunction(work):

        def run(batches):
            drop_kept(kind)
            yield from work(batches)
            release()
    else:

        def run(table):
            drop_kept(kind)
            out = work(table)
            release()
            return out

    return run


def thrifty_pair(work):
    """The same for a function of two tables."""

    def run(left, right):
        drop_kept()
        out = work(left, right)
        release()
        return out

    return run


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library
    _libc = None


def portions(record: pa.RecordBatch, text_col: str, most: int = PORTION):
    """Slices of a record batch with about ``most`` bytes of text; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(record.column(text_col)), 0).to_numpy(zero_copy_only=False)
    ends, row = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), 0
    while row < record.num_rows:
        to = max(int(np.searchsorted(ends, ends[row] + most, side="right")) - 1, row + 1)
        yield record.slice(row, to - row)
        row = to


class Batch:
    """Rows of a table with their whole texts; null texts are empty.

    The rows are ordered by id, then by text, so that two reads of the same rows
    give the same order whatever order a shuffle delivered them in.
    """

    def __init__(self, table: pa.Table, id_col: str = "doc_id", text_col: str = "text"):
        ids = table.column(id_col)
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        keys = ids.fill_null(NULL_ID).to_numpy().astype(np.int64)
        texts = table.column(text_col).cast(pa.large_binary()).combine_chunks()
        texts = texts.fill_null(b"") if texts.null_count else texts
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.large_binary())
        order = np.argsort(keys, kind="stable")
        same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
        if len(same):
            values = texts.to_pylist()
            order = np.array(sorted(range(len(keys)), key=lambda i: (keys[i], values[i])), dtype=np.int64)
        self.order = order
        self.ids = keys[order]
        self.null = self.null[order]
        self.moved = bool((order[1:] < order[:-1]).any())
        if self.moved:
            texts = texts.take(pa.array(order))
        self.n = len(order)
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if self.n and texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
        self.data = data[ends[0] : ends[-1]]
        self.ends = ends - ends[0]

    def text(self, row: int) -> bytes:
        return self.data[self.ends[row] : self.ends[row + 1]].tobytes()

    def chunks(self, row: int = 0, end: int | None = None, most: int = CHUNK):
        """Ranges of rows of about ``most`` bytes; a longer text stands alone."""
        end = self.n if end is None else end
        while row < end:
            to = int(np.searchsorted(self.ends, self.ends[row] + most, side="right")) - 1
            to = min(max(to, row + 1), end)
            yield row, to
            row = to

    def id_array(self, type_=pa.int64()) -> pa.Array:
        return pa.array(self.ids, type_, mask=self.null)


class Words:
    """The words (runs of bytes other than ASCII white space) of rows ``row`` to ``to`` of a batch.

    ``hash`` has one value per word (``other`` a second, independent one if asked
    for), ``first[i]:first[i + 1]`` the words of the i-th row, ``start`` and ``end``
    their byte places in the batch's buffer.
    """

    def __init__(self, batch: Batch, lower: bool = False, places: bool = True, other: bool = False, row: int = 0, to: int | None = None):
        lanes, starts, ends, counts = ([], []), [], [], [np.zeros(1, np.int64)]
        for row, to in batch.chunks(row, to):
            at = batch.ends[row]
            cut = batch.ends[row : to + 1] - at
            data = batch.data[at : batch.ends[to]]
            if lower:
                data = _LOWER[data]
            inside = ~_SPACE[data]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            bounds = cut[:-1][cut[:-1] < len(data)]
            begins[bounds] = inside[bounds]
            finish = np.zeros(len(data) + 1, dtype=bool)
            finish[1:] = inside
            finish[1:-1] &= ~inside[1:]
            marks = cut[1:][cut[1:] > 0]
            finish[marks] = inside[marks - 1]
            s, e = np.flatnonzero(begins), np.flatnonzero(finish)
            for lane in range(1 + other):
                lanes[lane].append(word_hashes(data, s, e, lane))
            counts.append(np.searchsorted(s, cut[1:], side="left") - np.searchsorted(s, cut[:-1], side="left"))
            if places:
                starts.append(s + at)
                ends.append(e + at)
        self.hash = np.concatenate(lanes[0]) if lanes[0] else np.zeros(0, np.uint64)
        self.other = np.concatenate(lanes[1]) if lanes[1] else np.zeros(0, np.uint64)
        self.first = np.cumsum(np.concatenate(counts))
        if places:
            self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
            self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + length), one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def union_length(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges spans of each row that overlap or touch; returns row, start, end, sorted."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    # Lift each row's places above those of the rows before it; one running maximum then does.
    lift = np.int64(max(1, int(end.max()) + 2))
    far = np.maximum.accumulate(end + row * lift)
    new = np.ones(len(row), bool)
    new[1:] = start[1:] + row[1:] * lift > far[:-1]
    at = np.flatnonzero(new)
    return row[at], start[at], far[np.append(at[1:], len(row)) - 1] - row[at] * lift


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string: dtype, length and bytes of each."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [a.dtype.str.encode().ljust(4), np.int64(len(a)).tobytes(), a.tobytes()]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        dtype = np.dtype(data[at : at + 4].decode().strip())
        n = int(np.frombuffer(data, np.int64, 1, at + 4)[0])
        out.append(np.frombuffer(data, dtype, n, at + 12))
        at += 12 + n * dtype.itemsize
    return out


def planes(rising: np.ndarray) -> np.ndarray:
    """Steps between rising 64-bit values, all lowest bytes first: the high bytes are mostly 0 and compress away."""
    return np.ascontiguousarray(np.diff(rising, prepend=U(0)).view(np.uint8).reshape(-1, 8).T).ravel()


def from_planes(data: np.ndarray) -> np.ndarray:
    steps = np.ascontiguousarray(data.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest unsigned type that holds them."""
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)
