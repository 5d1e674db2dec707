"""Sharding on a consistent-hash ring with virtual nodes and bounded loads; DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import written

#: Places on the ring. Keys and virtual nodes both stand at places; keys at a place go to the next node clockwise.
PLACES = 4096
#: Rows of one place are numbered in parts of about this many.
PART_ROWS = 50_000


def ring(shards: int, nodes: int = 64, places: int = PLACES) -> list[int]:
    """The shard at each virtual node, and where it stands: for every place, the list index of the first node at or after it.

    Returns owners in clockwise order as (place, shard) pairs, sorted.
    """
    points = []
    for shard in range(shards):
        for v in range(nodes):
            at = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big")
            points.append((at % places, at, shard))
    return [(place, shard) for place, _, shard in sorted(points)]


def walk(counts: dict[int, int], room: list[int], nodes: int = 64, places: int = PLACES) -> list[tuple[int, int, int, int, int]]:
    """Deals the keys at each place clockwise to shards that still have room.

    counts: keys at each place. room: the most keys each shard may hold; together at least all keys.
    Returns runs (place, first, end, shard, slot): the keys at place numbered first..end-1 go to shard,
    the first of them into slot. There are at most places + shards runs.
    """
    points, load, runs = ring(len(room), nodes, places), [0] * len(room), []
    k = 0
    for place in range(places):
        while k < len(points) and points[k][0] < place:
            k += 1
        left, first, v = counts.get(place, 0), 0, k
        while left:
            shard = points[v % len(points)][1]
            if take := min(left, room[shard] - load[shard]):
                runs.append((place, first, first + take, shard, load[shard]))
                load[shard] += take
                first += take
                left -= take
            v += 1
    return runs


def place_of(key: Column, places: int = PLACES) -> Column:
    return F.pmod(key, F.lit(places)).cast("int")


def sharded(keys: DataFrame, shards: int, nodes: int = 64, places: int = PLACES, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 within each shard) to `keys`, which must have a long column `key`, the ring position's hash, and orderable other columns.

    Law `rows`: every shard holds floor(n / shards) rows or one more, the first n % shards shards the larger
    number. A key goes to the first virtual node clockwise whose shard isn't full. The driver sees only the
    counts of the ring's places (at most `places` numbers) and returns runs of places, a table of at most
    places + shards rows, which alone is broadcast. Equal rows are interchangeable, so any of them may get
    any of their slots. An empty table gives an empty result.
    """
    spark = keys.sparkSession
    columns = keys.columns
    base = keys.withColumn("_place", place_of(F.col("key"), places))
    base = written(base, "ring")
    n = base.count()
    parts = 1
    while n / (places * parts) > part_rows:
        parts *= 2
    base = base.withColumn("_part", F.pmod(F.xxhash64("key", F.lit("part")), F.lit(parts)).cast("int"))
    cells = base.groupBy("_place", "_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r[0]: r[1] for r in cells.groupBy("_place").agg(F.sum("_n")).collect()}  # at most `places` rows
    room = [n // shards + (s < n % shards) for s in range(shards)]
    runs = walk(counts, room, nodes, places)
    table = spark.createDataFrame(runs, "_place int, _first long, _end long, shard int, _slot long")
    before = Window.partitionBy("_place").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("_place", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_place", "_part").orderBy(*columns)
    ranked = base.withColumn("_rank", F.row_number().over(within).cast("long") - 1)
    if parts > 1:
        ranked = ranked.join(offsets, ["_place", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    hit = (ranked["_place"] == table["_place"]) & (ranked["_rank"] >= table["_first"]) & (ranked["_rank"] < table["_end"])
    return ranked.join(F.broadcast(table), hit).select(*[ranked[c] for c in columns], "shard", (F.col("_slot") + F.col("_rank") - F.col("_first")).alias("slot"))


def shard_documents(documents: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", nodes: int = 64) -> DataFrame:
    """Deals documents to shards by the ring; one row per document.

    A document's key on the ring is its id together with its text's length and checksum, so rows that share
    an id (or have none) still spread. Null text counts as empty (size 1, checksum 0), null ids are keys like
    any other, repeated rows each get a slot of their own, ties are broken by id, size and checksum. Other
    columns of the input aren't read. Columns: doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keys = rows.withColumn("key", F.xxhash64("doc_id", "size", "text_crc32"))
    out = sharded(keys, shards, nodes)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
