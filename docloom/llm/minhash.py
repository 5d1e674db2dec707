"""Near-duplicate groups by b-bit MinHash with band candidates and exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import U, dropped, mixed, pieces, released, shingles, tidy, written

#: 32 bands of 5 rows: a pair of similarity 0.8 shares no band with probability 0.000003.
BANDS, ROWS = 32, 5
#: Low bits of each minimum that a signature keeps.
BITS = 2
#: Two bits agree by chance with probability 1/4; at similarity 0.8 the corrected estimate's standard deviation is
#: 0.038, so that it falls below similarity - SLACK with probability 0.00002 or less, and only for pairs on the limit.
SLACK = 0.16
#: Members of a band's bucket that are compared at once, and bytes of their sets; larger buckets are compared chunk by chunk.
CHUNK, CHUNK_BYTES = 1024, 64 << 20

_RANDOM = np.random.default_rng(20240229)
FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)
TERMS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def signatures(hashes: np.ndarray, at: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n x bands, unsigned 64 bits) and packed b-bit signatures (n x words) of n non-empty sets."""
    n, k = len(at) - 1, bands * rows
    minima = np.empty((k, n), U)
    for i in range(k):
        minima[i] = np.minimum.reduceat(hashes * FACTORS[i] + TERMS[i], at[:-1])
    keys = np.empty((n, bands), U)
    for b in range(bands):
        h = np.full(n, b + 1, U)
        for r in range(rows):
            h = mixed(h * U(0x9E3779B97F4A7C15) + minima[b * rows + r])
        keys[:, b] = h
    low = (mixed(minima) & U((1 << BITS) - 1)).astype(np.uint8)  # k x n
    per = 64 // BITS
    packed = np.zeros((n, -(-k // per)), U)
    for i in range(k):
        packed[:, i // per] |= low[i].astype(U) << U(BITS * (i % per))
    return keys, packed


def estimated(one: np.ndarray, others: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """Similarity of one packed signature to others: agreeing minima by bit counts, corrected for chance agreement."""
    differ = one ^ others
    differ = (differ | differ >> U(1)) & U(0x5555555555555555)
    agree = 1 - np.bitwise_count(differ).sum(axis=-1) / k
    chance = 1 / (1 << BITS)
    return (agree - chance) / (1 - chance)


def _base(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in pieces(batch, "text"):
                hashes, of = shingles(data, at, width)
                n, counts = part.num_rows, np.diff(of)
                full = np.flatnonzero(counts)
                h1, h2 = np.zeros(n, U), np.zeros(n, U)
                keys, packed = np.zeros((n, BANDS), U), np.zeros((n, -(-BANDS * ROWS * BITS // 64)), U)
                if len(full):
                    starts = of[full]
                    h1[full] = np.add.reduceat(mixed(hashes), starts)
                    h2[full] = np.add.reduceat(mixed(hashes ^ U(0x5851F42D4C957F2D)), starts)
                    keys[full], packed[full] = signatures(hashes, np.append(starts, len(hashes)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), flat, pa.array([x.tobytes() for x in packed], pa.binary())],
                    ["id", "n", "h1", "h2", "bands", "sig"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in pieces(batch, "text"):
                hashes, of = shingles(data, at, width)
                own = pa.array([hashes[a:b].tobytes() for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)], pa.large_binary())
                yield pa.RecordBatch.from_arrays([part.column(0), own.cast(pa.binary())], ["rep", "set"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, keep = batch.column(2), batch.column(3), []
            for i in range(batch.num_rows):
                a, b = np.frombuffer(left[i].as_buffer(), U), np.frombuffer(right[i].as_buffer(), U)
                if len(a) > len(b):
                    a, b = b, a
                ok = 100 * len(a) >= percent * len(b)
                if ok:
                    at = np.searchsorted(b, a)
                    at[at == len(b)] = 0
                    both = int((b[at] == a).sum())
                    ok = 100 * both >= percent * (len(a) + len(b) - both)
                keep.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Bucket:
    """Members of one bucket, or of two chunks of it: those of rows are compared with those of cols."""

    def __init__(self, table: pa.Table, least: float):
        order = np.argsort(table.column("rep").to_numpy(), kind="stable")
        self.order, self.least = order, least
        self.rep, self.comp, side = (table.column(x).to_numpy()[order] for x in ("rep", "comp", "side"))
        self.comp = self.comp.copy()
        n = len(order)
        self.band = int(table.column("band")[0].as_py())
        self.bands = np.ascontiguousarray(table.column("bands").combine_chunks().flatten().to_numpy().reshape(n, -1)[order])
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), U).reshape(n, -1)[order]
        if (side < 2).any():
            self.rows, self.cols = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        else:  # within a chunk: whoever isn't in the largest component, with all
            names, sizes = np.unique(self.comp, return_counts=True)
            self.rows, self.cols = np.flatnonzero(self.comp != names[sizes.argmax()]), np.arange(n)

    def open(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Members of other components that may be similar to member i and share no earlier band with it, and their estimates."""
        cols = self.cols[self.comp[self.cols] != self.comp[i]]
        est = estimated(self.sig[i], self.sig[cols])
        likely = est >= self.least
        cols, est = cols[likely], est[likely]
        first = (self.bands[cols, : self.band] == self.bands[i, : self.band]).any(1)
        return cols[~first], est[~first]


def _involved(least: float):
    """The members that have someone to be compared with."""

    def run(table: pa.Table) -> pa.Table:
        held = _Bucket(table, least)
        hit = np.zeros(len(held.rep), bool)
        for i in held.rows.tolist():
            cols, _ = held.open(i)
            if len(cols):
                hit[i] = True
                hit[cols] = True
        keep = np.zeros(len(hit), bool)
        keep[held.order[hit]] = True
        return table.filter(pa.array(keep))

    return run


def _settled(least: float, percent: int):
    """Links between components within a bucket, by full sets; what a link joins isn't compared further."""

    def run(table: pa.Table) -> pa.Table:
        held = _Bucket(table, least)
        raw = table.column("set").to_pylist()
        sets = [np.frombuffer(raw[k], U) for k in held.order.tolist()]
        sizes = np.array([len(x) for x in sets])
        found: list[tuple[int, int]] = []
        for i in held.rows.tolist():
            cols, est = held.open(i)
            cols = cols[np.argsort(-est, kind="stable")]
            step = 8
            while len(cols):
                now, cols = cols[:step], cols[step:]
                flat = np.concatenate([sets[k] for k in now.tolist()])
                at = np.searchsorted(sets[i], flat)
                at[at == len(sets[i])] = 0
                both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.cumsum(sizes[now]) - sizes[now])
                for k in now[100 * both >= percent * (sizes[i] + sizes[now] - both)].tolist():
                    if held.comp[k] != held.comp[i]:
                        found.append((int(held.rep[i]), int(held.rep[k])))
                        held.comp[held.comp == held.comp[k]] = held.comp[i]
                cols = cols[held.comp[cols] != held.comp[i]]
                step = min(256, 4 * step)
        return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """(rep, comp): for each end of a link (a, b), the smallest id that links lead to.

    Each round gives every id the least label among its neighbours, then the label of its label; rounds are
    tables in the shared folder. Star-shaped and dense groups take two or three rounds, a chain the logarithm
    of its length or somewhat more.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "rep"), "labels")
    while True:
        near = both.join(labels.select(F.col("rep").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["rep"] == near["a"]).select("rep", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("rep").alias("comp"), F.col("comp").alias("next"))
        # a label is the id of a node, so it has a label itself
        step = written(step.join(jump, "comp", "left").select("rep", "was", F.least("comp", F.coalesce("next", "comp")).alias("comp")), "labels")
        dropped(labels)
        labels = step.select("rep", "comp")
        if not step.filter("was <> comp").limit(1).count():
            dropped(both)
            return labels


def near_duplicates(documents: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups documents whose sets of word shingles have a Jaccard similarity of at least `similarity`, directly or through others.

    Returns one row per document: doc_id, n_shingles, component_id (the smallest id reachable), kept.

    Equal sets are one class; classes that share a band are candidates; b-bit estimates weed out; full sets
    decide. In each bucket all classes are compared with the least one first; buckets that then still hold
    several components compare these with each other inside one task (chunk by chunk if they are large), the
    most similar first, so that no link between components is missed that the bands show. That task returns
    links, not pairs; members of one component and copies aren't compared.

    Sets hold 64-bit hashes of shingles, which are no linear function of their letters (common.Spans). Empty or null
    text and text without words: n_shingles 0, a group of its own. Texts of any length are taken whole. Null ids take no part:
    component_id null, kept true. Rows that share an id are one node with several sets; links of each
    count. Other columns aren't read; an empty table gives an empty result. Ties don't matter.
    """
    percent = round(similarity * 100)
    least = similarity - SLACK
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = written(docs.mapInArrow(tidy(_base(width)), "id long, n long, h1 long, h2 long, bands array<long>, sig binary"), "minhash")
    sets = base.filter("n > 0 and id is not null")
    reps = written(sets.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    keys = reps.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    hubs = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.min("rep").alias("hub")).filter("m > 1"), "hubs")
    members = written(keys.drop("n").join(hubs, "key"), "buckets")
    released(documents.sparkSession)
    some = members.select("rep").distinct()
    small = written(reps.join(some, "rep", "left_semi").select("rep", "sig", "bands"), "sigs")
    texts = docs.join(some.withColumnRenamed("rep", "id"), "id", "left_semi")
    held = written(texts.mapInArrow(tidy(_sets(width)), "rep long, set binary").filter(F.length("set") > 0), "sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        one, other = held.select(F.col("rep").alias("a"), F.col("set").alias("left")), held.select(F.col("rep").alias("b"), F.col("set").alias("right"))
        joined = pairs.join(one, "a").join(other, "b").select("a", "b", "left", "right")
        return written(joined.mapInArrow(tidy(_confirm(percent)), "a long, b long").distinct(), name)

    def likely(pairs: DataFrame) -> DataFrame:
        one, other = small.select(F.col("rep").alias("a"), F.col("sig").alias("x")), small.select(F.col("rep").alias("b"), F.col("sig").alias("y"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), U).reshape(n, -1) if n else np.zeros((0, 1), U) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(estimated(x, y) >= least))

        return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")

    links = confirmed(likely(members.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()), "links")
    labels = components(links)
    released(documents.sparkSession)
    now = members.join(labels, "rep", "left").select("key", "band", "rep", "m", "total", F.coalesce("comp", "rep").alias("comp"))
    split = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    chunked = now.join(split, "key").withColumn("c", F.ceil(F.greatest(F.col("m") / CHUNK, 8 * F.col("total") / CHUNK_BYTES)).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("c")).cast("int"))
    placed = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).select(
        "key", "band", "rep", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), F.lit(2)).when(F.col("own") < F.col("other"), F.lit(0)).otherwise(F.lit(1)).alias("side")
    )
    columns = "key long, band int, rep long, comp long, i int, j int, side int, sig binary, bands array<long>"
    compared = placed.join(small, "rep").select(*[x.split()[0] for x in columns.split(", ")])
    involved = written(compared.groupBy("key", "i", "j").applyInArrow(_involved(least), columns), "open")
    more = involved.join(held, "rep").groupBy("key", "i", "j").applyInArrow(_settled(least, percent), "a long, b long")
    links = written(links.unionByName(more), "links")
    labels = components(links)
    dropped(hubs, members, small, held, involved, links)
    classes = reps.select("h1", "h2", "n", "rep").join(labels, "rep", "left").select("h1", "h2", "n", F.coalesce("comp", "rep").alias("comp"))
    own = base.select("id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"], "left")
    out = own.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"))
    out = written(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "groups")
    dropped(base, reps, labels)
    released(documents.sparkSession)
    return out
