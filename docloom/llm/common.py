"""Shared pieces of the training-data operators: scratch tables, Arrow helpers, hashing kernels."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word is a maximal run of characters other than these bytes; UTF-8's other bytes are all word bytes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The same in the regular expressions of Spark and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a kernel works on at once; a longer text is worked on alone.
BLOCK = 1 << 21

U = np.uint64


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's; only a local master may do without."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        ctx = spark.sparkContext
        held = ctx._jsc.sc().getCheckpointDir()
        if held.isDefined():
            at = held.get()
        elif ctx.master.startswith("local"):
            at = _LOCAL.setdefault(ctx.applicationId, tempfile.mkdtemp(prefix="docloom-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at.rstrip("/")


_LOCAL: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"


_RECORDS: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that are written meanwhile."""
    _RECORDS.append([])
    try:
        yield _RECORDS[-1]
    finally:
        _RECORDS.pop()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    for own in _RECORDS:
        own.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes written() tables that nothing reads any more."""
    for df in tables:
        for path in folders(df):
            if "/docloom/" in path:
                deleted(df.sparkSession, path)


def folders(df: DataFrame) -> set[str]:
    """The folders of the files that df reads."""
    return {x.rsplit("/", 1)[0] for x in df.inputFiles()}


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def rests_on_files(df: DataFrame) -> bool:
    """Does df read files and nothing else, no cached table and no rows in memory?"""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    names = [leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())]
    cached = df.sparkSession._jsparkSession.sharedState().cacheManager()
    return all(n == "LogicalRelation" for n in names) and cached.isEmpty()


def released(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that no live plan refers to; only timing depends on it."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Returns freed memory to the system, which allocators otherwise keep for a worker's next task."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


_CACHES: weakref.WeakSet[Cache] = weakref.WeakSet()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], caches: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives freed memory back when a task begins and ends: workers of earlier stages stay alive beside the JVM.

    caches: run looks strings up in a Cache; a task that doesn't empties those that other tasks have filled.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not caches:
            for x in list(_CACHES):
                x.forget()
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the offsets where each begins (one more at the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch of about `most` bytes of text, each with texts() of that column."""
    n = batch.num_rows
    data, at = texts(batch.column(batch.schema.get_field_index(text)))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


BASE = 0x9E3779B97F4A7C55
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if (held := _POWERS.get(base)) is None or len(held) < n:
        held = np.full(n, base, U)
        held[0] = 1
        _POWERS[base] = np.multiply.accumulate(held)
    return _POWERS[base]


class Rolling:
    """Polynomial hashes of short substrings of an array of symbols, from prefix sums modulo 2**64.

    Long strings can be made that collide (Thue-Morse words of 1024 symbols and more), so this serves only to choose
    among short strings and to find candidates whose symbols are compared afterwards.
    """

    def __init__(self, symbols: np.ndarray, base: int = BASE):
        n = len(symbols)
        self.back = _powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, U)
        values = _byte_values(base)[symbols] if symbols.dtype == np.uint8 else mixed(symbols.astype(U) + U(base >> 3))
        np.cumsum(values * _powers(base, n + 1)[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])


_BYTES: dict[int, np.ndarray] = {}


def _byte_values(base: int) -> np.ndarray:
    if base not in _BYTES:
        _BYTES[base] = mixed(np.arange(256, dtype=U) + U(base >> 3))
    return _BYTES[base]


#: The lowest k bytes of an integer.
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_STEP, _SIZE = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one integer, zeros behind the end; a view, not a copy for each position."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _chunks(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of strings cut into pieces of eight bytes: where each one's pieces begin in a flat list, the pieces' owners and numbers."""
    n = np.maximum(size + 7 >> 3, 1)
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    return first, owner, np.arange(len(owner)) - first[owner]


class Spans:
    """Substrings data[start:end]: a 64-bit key of each, and what it takes to compare their bytes.

    Eight bytes at a time are mixed with their place and added up, so a key isn't linear in its string and no
    family of colliding strings is known. Keys of strings of equal size of up to eight bytes differ always.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.windows, self.start, self.size = windows(data), start, end - start
        self.first = self.windows[start] & MASK[np.minimum(self.size, 8)]
        self.keys = mixed(self.first ^ mixed(np.zeros(1, U) + _STEP))
        long = np.flatnonzero(self.size > 8)
        for part in _slices(self.size[long]):
            own = long[part]
            first, owner, k = _chunks(self.size[own])
            values = self.windows[start[own][owner] + 8 * k] & MASK[np.minimum(self.size[own][owner] - 8 * k, 8)]
            self.keys[own] = np.add.reduceat(mixed(values ^ mixed(k.astype(U) * _SIZE + _STEP)), first)
        self.keys = mixed(self.keys + self.size.astype(U) * _SIZE)

    def equal(self, i: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Do the strings i, of more than eight bytes, agree with the bytes from `at` on in windows `other`."""
        same = np.ones(len(i), bool)
        for part in _slices(self.size[i]):
            own = i[part]
            first, owner, k = _chunks(self.size[own])
            mask = MASK[np.minimum(self.size[own][owner] - 8 * k, 8)]
            agree = (self.windows[self.start[own][owner] + 8 * k] & mask) == (other[at[part][owner] + 8 * k] & mask)
            same[part] = np.logical_and.reduceat(agree, first)
        return same


def _slices(size: np.ndarray, most: int = BLOCK) -> Iterator[slice]:
    """Slices of strings that hold about `most` bytes together; a longer string stands alone."""
    upto = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
        yield slice(i, j)
        i = j


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    word = np.zeros(n + 1, bool)
    word[:n] = ~SPACE[data]
    first, last = word[:n].copy(), word[:n].copy()
    first[1:] &= ~word[: n - 1]
    last &= ~word[1:]
    edges = at[(at > 0) & (at < n)]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    up = (data >= 65) & (data <= 90)
    return data + (up.astype(np.uint8) << 5)


def shingles(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles of `width` words (A-Z lower-cased; a shorter sequence of words is one shingle), and the offsets of each text's."""
    data = lower_ascii(data)
    start, end, of = word_spans(data, at)
    words = Spans(data, start, end).keys
    n = len(words)
    whole = np.zeros(n, U)
    held = np.zeros(n, bool)
    if n >= width:
        m = n - width + 1
        for j in range(width):
            whole[:m] += words[j : j + m] * U((2 * j + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)
        whole[:m] = mixed(whole[:m] + U(width))
        held[:m] = True
    counts = np.diff(of)
    for j in range(1, width):  # no shingle begins at a text's last words
        held[(of[1:] - j)[counts >= j]] = False
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i, c in enumerate(counts.tolist()):
        if not c:
            continue
        a, b = of[i], of[i + 1]
        if c < width:
            h = sum((int(w) * ((2 * j + 1) * 0xA0761D6478BD642F) for j, w in enumerate(words[a:b])), c)
            own = mixed(np.array([h & (1 << 64) - 1], U))
        else:
            own = np.unique(whole[a : b - width + 1])
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out) if out else np.zeros(0, U), np.concatenate([[0], np.cumsum(sizes)])


class Cache:
    """What each distinct string stands for, a few numbers, kept in sorted tables of growing size.

    A string is found by its key and taken only if its bytes agree with those that are kept; one whose key belongs
    to another string is worked out anew each time.
    """

    def __init__(self, most: int = 3_000_000):
        self.most = most
        self.forget()
        _CACHES.add(self)

    def forget(self) -> None:
        self.tables: list[tuple[np.ndarray, ...]] = []  # sorted keys; place and count of numbers; first eight bytes, size, place of all bytes if longer
        self.flat, self.known, self.raw, self.held = np.zeros(0, np.uint32), 0, np.zeros(8, np.uint8), 0

    def _keep(self, spans: Spans, own: np.ndarray) -> np.ndarray:
        """Keeps the bytes of long strings; where each begins."""
        place, long = np.zeros(len(own), np.int64), np.flatnonzero(spans.size[own] > 8)
        if len(long):
            first, owner, k = _chunks(spans.size[own[long]])
            bytes_ = np.ascontiguousarray(spans.windows[spans.start[own[long]][owner] + 8 * k]).view(np.uint8)
            place[long] = self.held + 8 * first
            if self.held + len(bytes_) + 8 > len(self.raw):
                self.raw = np.concatenate([self.raw[: self.held], np.zeros(self.held + len(bytes_) + 8, np.uint8)])
            self.raw[self.held : self.held + len(bytes_)] = bytes_
            self.held += len(bytes_)
        return place

    def find(self, spans: Spans, make) -> tuple[np.ndarray, np.ndarray]:
        """For each string the place of its numbers in `flat` and how many. make(indexes) gives the numbers of new strings, one index of each."""
        if self.known > self.most or self.held > 64 * self.most:
            self.forget()
        keys = spans.keys
        place, count = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        other: list[np.ndarray] = []

        def look(missing: np.ndarray, table: tuple) -> np.ndarray:
            held, offset, numbers, first, size, begin = table
            at = np.searchsorted(held, keys[missing])
            at[at == len(held)] = 0
            hit = held[at] == keys[missing]
            own, at = missing[hit], at[hit]
            same = (first[at] == spans.first[own]) & (size[at] == spans.size[own])
            long = np.flatnonzero(same & (spans.size[own] > 8))
            if len(long):
                raw = np.ndarray((len(self.raw) - 7,), "<u8", self.raw, strides=(1,))
                same[long] = spans.equal(own[long], raw, begin[at[long]])
            place[own[same]], count[own[same]] = offset[at[same]], numbers[at[same]]
            if not same.all():
                other.append(own[~same])
            return missing[~hit]

        missing = np.arange(len(keys))
        for table in self.tables:
            if len(missing):
                missing = look(missing, table)
        if len(missing):
            new, where = np.unique(keys[missing], return_index=True)
            index = missing[where]
            offset, numbers = self._made(index, make)
            table = (new, offset, numbers, spans.first[index], spans.size[index], self._keep(spans, index))
            self.known += len(new)
            look(missing, table)
            self.tables.append(table)
            while len(self.tables) > 1 and len(self.tables[-1][0]) * 4 > len(self.tables[-2][0]):
                one, two = self.tables.pop(), self.tables.pop()
                joined = [np.concatenate(x) for x in zip(one, two, strict=True)]
                order = np.argsort(joined[0], kind="stable")
                self.tables.append(tuple(x[order] for x in joined))
        if other:
            own = np.concatenate(other)
            place[own], count[own] = self._made(own, make)
        return place, count

    def _made(self, index: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        own = make(index)
        numbers = np.array([len(x) for x in own], np.int64)
        offset = len(self.flat) + np.cumsum(numbers) - numbers
        self.flat = np.concatenate([self.flat, *own]).astype(np.uint32)
        return offset, numbers


def ragged(flat: np.ndarray, place: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers flat[place : place + count] of all entries one after another, and the entries' offsets (one more at the end)."""
    total = np.concatenate([[0], np.cumsum(count)])
    return (flat[np.repeat(place - total[:-1], count) + np.arange(total[-1])] if len(count) else flat[:0]), total
