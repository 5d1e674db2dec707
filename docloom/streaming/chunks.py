"""Documents that arrive in chunks: collected by key until their end, then parsed.

A stream of (key, seq, chunk, last) gives the nodes of each document once all its chunks up to the last one are there, in
whatever order they came. Chunks after the end are ignored. State is kept by key, so documents are spread over tasks; a
document that never ends is dropped after `patience` without a chunk.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.core import html as H

NODES = "key string, node_id int, parent_id int, last_id int, depth int, pos int, kind string, name string, data string"
_COLUMNS = [x.split()[0] for x in NODES.split(", ")]


def node_frame(key: str, html: str) -> pd.DataFrame:
    rows = H.node_rows(html)
    return pd.DataFrame([[key, *(r[c] for c in _COLUMNS[1:])] for r in rows], columns=_COLUMNS)


def _collect(patience: str | None):
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts, end, done = pickle.loads(state.get[0]) if state.exists else ({}, None, False)
        for batch in batches:
            for seq, chunk, last in zip(batch["seq"], batch["chunk"], batch["last"], strict=True):
                if not done:
                    parts.setdefault(int(seq), chunk or "")
                    end = int(seq) if last else end
        if not done and end is not None and all(i in parts for i in range(end + 1)):
            yield node_frame(key[0], "".join(parts[i] for i in range(end + 1)))
            parts, done = {}, True
        state.update((pickle.dumps((parts, end, done)),))
        if patience:
            state.setTimeoutDuration(patience)

    return run


def documents(chunks: DataFrame, patience: str | None = None) -> DataFrame:
    """The nodes of documents in a stream of (key string, seq from 0, chunk string, last boolean)."""
    rows = chunks.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("chunk").cast("string").alias("chunk"), F.col("last").cast("boolean").alias("last"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if patience else GroupStateTimeout.NoTimeout
    return rows.groupBy("key").applyInPandasWithState(_collect(patience), NODES, "held binary", "append", timeout)


def documents_of_table(chunks: DataFrame) -> DataFrame:
    """The same of a table that is there already: chunks in order of seq up to the last one. One row per document: key, html."""
    ends = F.min(F.when(F.col("last"), F.col("seq"))).alias("end")
    parts = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("chunk", F.lit("")).alias("chunk"))))
    held = chunks.groupBy("key").agg(ends, parts.alias("parts")).filter("end is not null")
    own = F.filter("parts", lambda p: p["seq"] <= F.col("end"))
    whole = F.array_join(F.transform(own, lambda p: p["chunk"]), "")
    return held.filter(F.size(own) == F.col("end") + 1).select("key", whole.alias("html"))
