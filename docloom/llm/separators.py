"""Token counts from flat, unindexed token files, by scanning for the end-of-document id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import scratch_path, written
from docloom.llm.files import Whole, size, span
from docloom.llm.tokenfiles import tokenized

#: Pre-tokens that a worker remembers here: fewer than elsewhere, as writers and scanners share its memory.
REMEMBERED = 1_000_000
#: Ids of a block, the unit of scanning.
BLOCK_IDS = 1 << 20
#: Ids after which a task begins a new flat file.
FILE_IDS = 1 << 25


def write_flat(rows: DataFrame, folder: str, dtype: str = "<u2", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes rows (id, ids with a separator at the end) to files of ids and nothing else; each task its own files, in its rows' order.

    Returns (path, ordinal, doc_id): which document is the n-th of a file, a list kept beside the files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, number, k = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            paths, ordinals = [], []
            for ids in batch.column(1):
                if out is None:
                    out, k = Whole(path := f"{folder}/flat-{part:06d}-{number:04d}.bin"), 0
                out.write(ids.as_buffer().to_pybytes())
                paths.append(path)
                ordinals.append(k)
                k += 1
                if out.size >= file_ids * np.dtype(dtype).itemsize:
                    out.close()
                    out, number = None, number + 1
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(ordinals, pa.int64()), batch.column(0)], ["path", "ordinal", "doc_id"])
        if out is not None:
            out.close()

    return written(rows.select("id", "ids").mapInArrow(run, "path string, ordinal long, doc_id long"), "flat-order")


def count_flat(paths: DataFrame, separator: int, dtype: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """(path, ordinal, start, n_tokens) of every document in the flat files named in column `path`.

    Blocks are scanned independently. A prefix scan over each file's blocks (sums of separator counts, the
    last separator so far) numbers the documents and gives where one that began in an earlier block starts.
    n_tokens counts the separator; ids after a file's last separator are a document without one. Empty files
    have no documents. An empty file list gives an empty result.
    """
    width = np.dtype(dtype).itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                n = size(path) // width
                blocks = -(-n // block_ids)
                yield pa.RecordBatch.from_arrays([pa.array([path] * blocks, pa.string()), pa.array(range(blocks), pa.int64()), pa.array([n] * blocks, pa.int64())], ["path", "block", "total"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, total in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                first, end = block * block_ids, min(total, (block + 1) * block_ids)
                ids = np.frombuffer(span(path, first * width, end * width), dtype)
                at = np.flatnonzero(ids == separator).astype(np.int64) + first
                ends = at + 1
                if end == total and (not len(at) or at[-1] != total - 1):
                    ends = np.append(ends, total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))],
                    ["path", "block", "n", "last", "ends"],
                )

    blocks = written(paths.select("path").distinct().mapInArrow(cut, "path string, block long, total long"), "blocks")
    spread = blocks.repartition(max(1, min(100_000, blocks.count())), "path", "block")
    scanned = written(spread.mapInArrow(scan, "path string, block long, n long, last long, ends array<long>"), "scanned")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    prefix = scanned.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinals"), F.coalesce(F.max("last").over(before), F.lit(0)).alias("begun"))
    found = scanned.select("path", "block", "ends").join(prefix, ["path", "block"]).select("path", "ordinals", "begun", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("begun")).otherwise(F.element_at("ends", F.greatest(F.col("k"), F.lit(1))))
    return found.select("path", (F.col("ordinals") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def count_tokens(documents: DataFrame, tokenizer: str, separator: int, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2", folder: str | None = None, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes flat files of the documents' ids, each with the separator at its end, and counts them by scanning. Ids aren't shuffled.

    Returns per document doc_id and n_tokens (with the separator). A text that spells an added token such as
    <|endoftext|> is encoded as plain text here, so that no text holds the separator's id. Null and empty
    texts have the separator alone, texts of any length are encoded whole. Null ids and rows that share
    an id or are equal are documents of their own; order doesn't matter, so there are no ties. Other columns
    aren't read. An empty table gives an empty result.
    """
    folder = folder or scratch_path(documents.sparkSession, "flat")
    order = write_flat(tokenized(documents, tokenizer, separator, id_col, text_col, dtype, REMEMBERED, special_as_text=True), folder, dtype, file_ids)
    counted = count_flat(order, separator, dtype, block_ids)
    return order.join(counted, ["path", "ordinal"]).select("doc_id", "n_tokens")
