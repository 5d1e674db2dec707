"""Token ids in binary files with Elias-Fano encoded document boundaries."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import U, pieces, scratch_path, shuffle_partitions, written
from docloom.llm.encoder import REMEMBERED, encoder
from docloom.llm.files import Whole, size, span

MAGIC = b"DLEF0001"
#: A file is closed once it holds so many ids; the documents that follow go to the next file of the same task.
FILE_IDS = 1 << 25
#: Ids that a reader holds at once, about.
READ_IDS = 1 << 22
#: Bytes of ids of one range partition, about.
PARTITION_BYTES = 256 << 20
#: Bits of the upper half that one entry of the select directory covers.
SPAN = 512


class EliasFano:
    """A non-decreasing sequence of n numbers up to u in about n * (2 + log2(u / n)) bits.

    The low bits are packed; the high parts are written in unary, the i-th number as a one at place
    high(i) + i. A directory of 32-bit counts, one for each SPAN bits and stored with the sequence, makes
    select a search in it and a scan of SPAN bits.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ranks = n, low_bits, low, high, ranks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, U)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        high = np.zeros(-(-((n + (top >> bits)) // 8 + 1) // (SPAN // 8)) * (SPAN // 8), np.uint8)
        at = (values >> U(bits)).astype(np.int64) + np.arange(n)
        np.bitwise_or.at(high, at >> 3, (1 << (at & 7)).astype(np.uint8))
        low = np.zeros(0, np.uint8)
        if bits:
            low = np.packbits(((values[:, None] >> np.arange(bits, dtype=U)) & U(1)).astype(np.uint8).reshape(-1), bitorder="little")
        ones = np.bitwise_count(high.reshape(-1, SPAN // 8)).sum(1)
        return cls(n, bits, low, high, np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th number."""
        return int(self.selected(i, i + 1)[0])

    def selected(self, i: int, j: int) -> np.ndarray:
        """The i-th to (j-1)-th numbers: selects over only those blocks of the high bits in which they lie."""
        if j <= i:
            return np.zeros(0, np.int64)
        block, last = (int(x) for x in np.searchsorted(self.ranks, [i, j - 1], "right") - 1)
        bits = np.unpackbits(self.high[block * SPAN // 8 : (last + 1) * SPAN // 8], bitorder="little")
        skip = i - int(self.ranks[block])
        at = np.flatnonzero(bits)[skip : skip + j - i] + block * SPAN
        out = (at - np.arange(i, j)) << self.low_bits
        if self.low_bits:
            first, end = i * self.low_bits, j * self.low_bits
            own = np.unpackbits(self.low[first // 8 : -(-end // 8)], bitorder="little")[first % 8 : first % 8 + end - first]
            out |= (own.reshape(-1, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(1)
        return out

    def all(self) -> np.ndarray:
        return self.selected(0, self.n).astype(U)

    def dumped(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u8").tobytes()
        return head + self.low.tobytes() + self.high.tobytes() + self.ranks.astype("<u4").tobytes()

    @classmethod
    def loaded(cls, data: bytes) -> EliasFano:
        n, bits, low, high = np.frombuffer(data, "<u8", 4).tolist()
        body = np.frombuffer(data, np.uint8, low + high, 32)
        return cls(n, bits, body[:low], body[low:], np.frombuffer(data, "<u4", high // (SPAN // 8) + 1, 32 + low + high))


class TokenFile:
    """Reads a file: ids of all documents one after another, then boundaries, ids of documents, a JSON footer, its length, magic."""

    def __init__(self, path: str):
        self.path, total = path, size(path)
        tail = span(path, total - 16, total)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} isn't a complete token file")
        length = int.from_bytes(tail[:8], "little")
        self.meta = json.loads(span(path, total - 16 - length, total - 16))
        at = self.meta["ids_bytes"]
        ends = span(path, at, at + self.meta["ends_bytes"])
        self.ends = EliasFano.loaded(ends)
        at += self.meta["ends_bytes"]
        self.names = EliasFano.loaded(span(path, at, at + self.meta["names_bytes"]))
        self.dtype = np.dtype(self.meta["dtype"])

    def __len__(self) -> int:
        return self.meta["documents"]

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        """Ids of documents i to j - 1; those without an id stand at the end."""
        known = self.names.n
        own = (self.names.selected(min(i, known), min(j, known)).astype(U) + U(self.meta["least_name"] % (1 << 64))).view(np.int64).tolist()
        return own + [None] * (j - i - len(own))

    def bounds(self, i: int, j: int) -> np.ndarray:
        """Where documents i to j - 1 begin, and where the last one ends."""
        own = self.ends.selected(max(i - 1, 0), j)
        return own if i else np.concatenate([[0], own])

    def ids(self, i: int, j: int | None = None) -> np.ndarray:
        """Ids of document i, or of documents i to j - 1."""
        a, b = self.bounds(i, j or i + 1)[[0, -1]].tolist()
        return np.frombuffer(span(self.path, a * self.dtype.itemsize, b * self.dtype.itemsize), self.dtype)


class _Writer:
    def __init__(self, path: str, dtype: str):
        self.path, self.dtype, self.out = path, np.dtype(dtype), Whole(path)
        self.ends: list[int] = []
        self.names: list[int | None] = []
        self.total = 0

    def add(self, name: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.total += len(ids) // self.dtype.itemsize
        self.ends.append(self.total)
        self.names.append(name)

    def close(self) -> tuple[str, int, int]:
        known = [x for x in self.names if x is not None]  # ascending, null last
        least = known[0] if known else 0
        ends = EliasFano.of(np.array(self.ends, U)).dumped()
        names = EliasFano.of(np.array(known, np.int64).view(U) - U(least % (1 << 64))).dumped()
        meta = {"documents": len(self.ends), "ids": self.total, "dtype": self.dtype.str, "ids_bytes": self.out.size, "ends_bytes": len(ends), "names_bytes": len(names), "least_name": least}
        foot = json.dumps(meta).encode()
        for x in (ends, names, foot, len(foot).to_bytes(8, "little"), MAGIC):
            self.out.write(x)
        self.out.close()
        return self.path, len(self.ends), self.total


def tokenized(documents: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2", remembered: int = REMEMBERED, special_as_text: bool = False) -> DataFrame:
    """(id, ids): the binary ids of each whole text (null: empty), with end_id behind them, rows in their order; no shuffle."""
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, remembered, special_as_text)
        for batch in batches:
            for part, data, at in pieces(batch, "text"):
                ids, of = encode(data, at)
                own = ids.astype(dtype)
                if len(own) and int(ids.max()) != int(own.max()):
                    raise ValueError(f"ids don't fit into {dtype}")
                end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
                packed = [own[a:b].tobytes() + end for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["id", "ids"])

    return docs.mapInArrow(run, "id long, ids binary")


def in_order(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(id, text), range-partitioned and sorted by id (null last); rows of one id by a hash of their text, so none is a hot key.

    Texts are put in order before they are encoded: the sort samples its input, which would encode everything twice.
    The number of partitions grows with the bytes of all texts.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    return docs.repartitionByRange(max(shuffle_partitions(docs.sparkSession), -(-total // partition_bytes)), *keys).sortWithinPartitions(*keys)


def write_files(rows: DataFrame, folder: str, dtype: str = "<u2", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes in_order() rows to token files; returns (part, number, path, documents, ids), one row per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, done = TaskContext.get().partitionId(), None, []
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, ids in zip(names, batch.column(1), strict=True):
                if out is None:
                    out = _Writer(f"{folder}/part-{part:06d}-{len(done):04d}.ids", dtype)
                out.add(name, ids.as_buffer().to_pybytes())
                if out.total >= file_ids:
                    done.append(out.close())
                    out = None
        if out is not None:
            done.append(out.close())
        yield pa.RecordBatch.from_pylist([{"part": part, "number": k, "path": p, "documents": n, "ids": m} for k, (p, n, m) in enumerate(done)], pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    return written(rows.mapInArrow(run, "part int, number int, path string, documents long, ids long"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """One row per document of the files, in file order: doc_id, start, n_tokens, ids_crc32 (of its ids as 32-bit integers)."""
    spark = files.sparkSession
    base, table = 0, []
    for f in files.orderBy("part", "number").collect():  # one row per file of up to FILE_IDS ids
        table.append((f.path, base))
        base += f.ids
    n = max(1, min(len(table), 100_000))
    own = spark.createDataFrame(table, "path string, base long").repartition(n, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = TokenFile(path)
                i = 0
                while i < len(held):
                    j = min(i + 4096, len(held))
                    at = held.bounds(i, j)
                    j = i + max(1, int(np.searchsorted(at, at[0] + READ_IDS, "right")) - 1)  # long documents: fewer of them
                    at = at[: j - i + 1]
                    first = int(at[0])
                    ids, names = held.ids(i, j).astype("<u4"), held.doc_ids(i, j)
                    crc = [zlib.crc32(ids[a - first : b - first].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j

    return own.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(documents: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2", file_ids: int = FILE_IDS) -> tuple[DataFrame, DataFrame]:
    """Writes the documents' ids to files in ascending order of doc_id and reads them back: (files, documents).

    Null and empty texts have the end id alone; texts of any length are encoded whole. Null ids come last; rows
    that share an id stand in the order of a hash of their text, repeated rows one after another. Other
    columns aren't read. An empty table gives no file and an empty result.
    """
    spark = documents.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    files = write_files(tokenized(in_order(documents, id_col, text_col), tokenizer, end_id, "id", "text", dtype), folder, dtype, file_ids)
    return files, read_files(files)
