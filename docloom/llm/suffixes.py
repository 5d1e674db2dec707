"""Removal of byte strings that occur twice, by a logarithmic family of suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import Rolling, U, dropped, pieces, released, shuffle_partitions, tidy, written

#: Bytes of the grams among which each window's anchor is chosen.
GRAM = 50
#: An anchor that occurs more often than this has its windows dealt out by what they share.
HOT = 512
#: Windows of a hot anchor are dealt in groups of so many neighbouring ones.
GROUP = 8
#: Stretches that one task indexes, about.
TASK_STRETCHES = 4000
#: Suffixes of one batch, each for one suffix array of the lowest level.
BATCH_SUFFIXES = 1 << 15
#: Windows of a long text are anchored in parts of so many starts.
PART = 1 << 20
#: Sizes within a run of windows have to fit into so many bits.
_BITS = 16


class Level:
    """A suffix array cut at the match length: the suffixes' first bytes in order, their owners, and which are matched.

    Suffixes with the same first bytes are stored once; the others are known to be matched already.
    """

    def __init__(self, keys: np.ndarray, owners: np.ndarray, matched: np.ndarray):
        self.keys, self.owners, self.matched = keys, owners, matched

    def __len__(self) -> int:
        return len(self.keys)


class SuffixFamily:
    """Suffix arrays of geometrically growing sizes.

    add() builds the suffix array of a batch, merge-scans it against every level for suffixes that agree in
    their first `length` bytes, and puts it in as a level; levels of equal size class merge. A suffix takes
    part in logarithmically many merges.
    """

    def __init__(self, length: int):
        self.length = length
        self.levels: list[Level | None] = []
        self.found = [np.zeros(0, np.int64)]  # owners of matched suffixes
        self.added = 0

    def add(self, data: np.ndarray, starts: np.ndarray, owners: np.ndarray) -> None:
        """Suffixes of data at starts, each with at least `length` bytes."""
        if not len(starts):
            return
        windows = np.lib.stride_tricks.sliding_window_view(data, self.length)[starts]
        keys = np.ascontiguousarray(windows).view(f"S{self.length}").reshape(-1)
        order = np.argsort(keys, kind="stable")
        new = self._unique(keys[order], owners[order])
        for level in self.levels:
            if level is not None:
                at = np.searchsorted(level.keys, new.keys)
                at[at == len(level)] = 0
                same = level.keys[at] == new.keys
                self._report(level, at[same])
                self._report(new, np.flatnonzero(same))
        k = 0
        while True:  # a binary counter: two of one size class make one of the next
            while k < len(self.levels) and self.levels[k] is not None and len(self.levels[k]) < 2 * len(new):
                new = self._merged(self.levels[k], new)
                self.levels[k] = None
            k = max(0, (len(new) // BATCH_SUFFIXES).bit_length())
            self.levels += [None] * (k + 1 - len(self.levels))
            if self.levels[k] is None:
                self.levels[k] = new
                return
            new = self._merged(self.levels[k], new)
            self.levels[k] = None

    def _report(self, level: Level, at: np.ndarray) -> None:
        at = at[~level.matched[at]]
        level.matched[at] = True
        self.found.append(level.owners[at])

    def _unique(self, keys: np.ndarray, owners: np.ndarray) -> Level:
        """One entry for each run of equal keys; a run of several is matched."""
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        run = np.flatnonzero(first)
        many = np.diff(np.append(run, len(keys))) > 1
        self.found.append(owners[np.repeat(many, np.diff(np.append(run, len(keys))))])
        return Level(keys[run], owners[run], many)

    def _merged(self, one: Level, other: Level) -> Level:
        keys = np.concatenate([one.keys, other.keys])
        order = np.argsort(keys, kind="stable")  # two sorted runs
        keys = keys[order]
        owners, matched = np.concatenate([one.owners, other.owners])[order], np.concatenate([one.matched, other.matched])[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]  # equal keys of two levels were reported when they met
        run = np.flatnonzero(first)
        return Level(keys[run], owners[run], np.logical_or.reduceat(matched, run))

    def matched(self) -> np.ndarray:
        return np.unique(np.concatenate(self.found))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, by running minima from both ends of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, ~U(0), U)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window of `length` bytes has one anchor, its gram with the least hash (the last of equal ones).

    Equal windows, wherever they stand, have the same anchor at the same place in them. Returns runs of
    neighbouring windows with one anchor: the first window's start, how many, the anchor's position and hash.
    """
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U)
    out = []
    for first in range(0, n, PART):
        own = data[first : min(first + PART, n) + length - 1]
        at = np.arange(len(own) - gram + 1)
        last = U((1 << 22) - 1)
        grams = Rolling(own)(at, at + gram)
        values = (grams & ~last) | (last - at.astype(U))
        pos = (last - (_least(values, length - gram + 1) & last)).astype(np.int64)
        run = np.flatnonzero(np.append(True, pos[1:] != pos[:-1]))
        out.append((run + first, np.diff(np.append(run, len(pos))), pos[run] + first, grams[pos[run]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _digests(raw: memoryview, start: np.ndarray, end: np.ndarray) -> bytes:
    digest = hashlib.blake2b
    return b"".join([digest(raw[s:e], digest_size=8).digest() for s, e in zip(start.tolist(), end.tolist(), strict=True)])


def _anchor_rows(length: int, gram: int):
    """(anchor's hash, digest of all bytes of its run of windows, place): place packs start, number of windows, anchor's distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in pieces(batch, "text"):
                raw, rows, a, n, place = memoryview(data), [], [], [], []
                for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    start, count, pos, key = anchors(data[lo:hi], length, gram)
                    if len(start):
                        a.append(key)
                        n.append(_digests(raw[lo:hi], start, start + count + length - 1))
                        place.append(start << 2 * _BITS | count << _BITS | pos - start)
                        rows.append(np.full(len(start), i))
                if not rows:
                    continue
                rows = np.concatenate(rows)
                keys = [part.column(k).take(pa.array(rows)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate(a).view(np.int64)), pa.array(np.frombuffer(b"".join(n), "<i8")), pa.array(np.concatenate(place))], ["id", "tie", "a", "n", "place"])

    return run


def unpacked(place: int) -> tuple[int, int, int]:
    return place >> 2 * _BITS, place >> _BITS & (1 << _BITS) - 1, place & (1 << _BITS) - 1


def _stretches(length: int):
    """Bytes of the asked runs of windows: (key, a, n, second, skip, ends, bytes).

    ends: of the run only the first and the last window are asked, which cover all its bytes. Runs of hot anchors
    are cut in groups of windows, keyed by what the group's windows share; skip is where a group begins in its run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "a", "n", "second", "skip", "ends", "bytes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            for part, data, at in pieces(batch, "text"):
                asked, out = part.column(part.schema.get_field_index("asked")).to_pylist(), []
                for i, own in enumerate(asked):
                    text = data[at[i] : at[i + 1]]
                    roll = Rolling(text) if any(x["hot"] for x in own) else None
                    for x in own:
                        start, count, back = unpacked(x["place"])
                        cuts = [(start, count, x["a"])]
                        if x["hot"]:
                            cuts, pos = [], start + back
                            wanted = [(start, start), (start + count - 1,) * 2][: min(count, 2)] if x["ends"] else [(start, start + count - 1)]
                            for one, last in wanted:
                                for g in range((pos - last) // GROUP, (pos - one) // GROUP + 1):
                                    lo, hi = max(one, pos - g * GROUP - GROUP + 1), min(last, pos - g * GROUP)
                                    s, e = pos - g * GROUP, pos - g * GROUP - GROUP + 1 + length
                                    core = int(roll(np.array([s]), np.array([e]))[0])  # part of every window of the group, so within the text
                                    cuts.append((lo, hi - lo + 1, int(np.array([(core + g * 0x9E3779B97F4A7C15 + x["a"]) & (1 << 64) - 1], U).view(np.int64)[0])))
                        for s, c, key in cuts:
                            out.append((key, x["a"], x["n"], x["second"], s - start, x["ends"], text[s : s + c + length - 1].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names)

    return run


def _matches(length: int):
    """Feeds a task's stretches to a family, batch by batch, and returns the matched windows as spans (a, n, s, e) within their run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, tables, begun = SuffixFamily(length), [], [0]
        wait: list[tuple] = []
        waiting = 0

        def flush() -> None:
            nonlocal wait, waiting
            if not wait:
                return
            data = np.concatenate([w[0] for w in wait])
            offset, starts, owners = 0, [], []
            for d, base, ends in wait:
                c = len(d) - length + 1
                at = np.unique([0, c - 1]) if ends else np.arange(c)
                starts.append(offset + at)
                owners.append(base + at)
                offset += len(d)
            family.add(data, np.concatenate(starts), np.concatenate(owners))
            wait, waiting = [], 0

        for batch in batches:
            tables.append(batch.select(["a", "n", "second", "skip"]))
            ends = batch.column(5).to_pylist()
            for own, flag in zip(batch.column(6), ends, strict=True):
                d = np.frombuffer(own.as_buffer(), np.uint8)
                wait.append((d, begun[-1], flag))
                begun.append(begun[-1] + len(d) - length + 1)
                waiting += 2 if flag else len(d) - length + 1
                if waiting >= BATCH_SUFFIXES:
                    flush()
        flush()
        if not tables:
            return
        rows = pa.Table.from_batches(tables)
        hit = family.matched()
        if not len(hit):
            return
        begun = np.array(begun)
        row = np.searchsorted(begun, hit, "right") - 1
        first = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (row[1:] != row[:-1])))
        last = np.append(first[1:], len(hit)) - 1
        own = row[first]
        skip = rows.column("skip").to_numpy()[own]
        s, e = skip + hit[first] - begun[own], skip + hit[last] - begun[own] + length
        take = pa.array(own)
        got = pa.table({"a": rows.column("a").take(take), "n": rows.column("n").take(take), "s": s, "e": e})
        yield from got.filter(pa.array(~rows.column("second").to_numpy()[own])).combine_chunks().to_batches()

    return run


def _removed():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("spans"))
            text = batch.column(batch.schema.get_field_index("text"))
            names, removed, counts, kept = [], [], [], []
            for i in range(batch.num_rows):
                raw = (text[i].as_py() or "").encode()
                gone, at, left = 0, 0, hashlib.sha256()
                runs = merged([(x["s"], x["e"]) for x in spans[i].as_py() or []])
                for s, e in runs:
                    left.update(raw[at:s])
                    at, gone = e, gone + e - s
                left.update(raw[at:])
                names.append(len(raw))
                removed.append(gone)
                counts.append(len(runs))
                kept.append(left.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as maximal runs, in order; touching ones become one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def repeated_spans(documents: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(docs, spans): documents as (id, tie, text), and for those with repeats (id, tie, spans as array of (s, e) in bytes).

    A window of `length` bytes has one anchor (see anchors()), so equal windows meet under the anchor's hash.
    Anchors that occur once are settled. Under the others, runs of windows with equal bytes (by a 64-bit
    BLAKE2 digest under one anchor) are a class, which is brought to the index once or, if it has several runs,
    by two of them: the first with all its windows (or, if the anchor has no other class, with the two at its ends,
    which cover all its bytes), the second with its ends. All classes of an anchor meet in one task's
    SuffixFamily, which decides window by window; what it reports of a class holds for each of its runs.
    Classes of an anchor that occurs more than HOT times are dealt out in groups of windows by the bytes the
    group shares, so that only runs that agree in nearly `length` bytes meet.
    """
    if not gram <= length < 1 << _BITS:
        raise ValueError(f"length has to be at least {gram} and less than {1 << _BITS}")
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select("id", F.xxhash64("id", "text").alias("tie"), "text")
    rows = written(docs.mapInArrow(tidy(_anchor_rows(length, gram)), "id long, tie long, a long, n long, place long"), "windows")
    # both sides of the join are tables, so that a hot anchor's partition can be split
    often = written(rows.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("lo"), F.max("n").alias("hi")).filter("m > 1").select("a", "m", (F.col("lo") < F.col("hi")).alias("several")), "anchors")
    released(spark)
    twice = written(rows.join(often, "a"), "repeated")
    dropped(rows, often)
    released(spark)
    one = F.struct("id", "tie", "place")
    classes = written(twice.groupBy("a", "n").agg(F.count(F.lit(1)).alias("c"), F.max("m").alias("m"), F.max("several").alias("several"), F.min(one).alias("one"), F.max(one).alias("two")), "classes")
    first = classes.select("one.*", "a", "n", F.lit(False).alias("second"), (~F.col("several")).alias("ends"), (F.col("m") > HOT).alias("hot"))
    second = classes.filter("c > 1").select("two.*", "a", "n", F.lit(True).alias("second"), F.lit(True).alias("ends"), (F.col("m") > HOT).alias("hot"))
    asked = first.unionByName(second).groupBy("id", "tie").agg(F.collect_list(F.struct("a", "n", "place", "second", "ends", "hot")).alias("asked"))
    to_cut = docs.join(asked, docs["id"].eqNullSafe(asked["id"]) & (docs["tie"] == asked["tie"])).select(docs["id"], docs["tie"], "text", "asked")
    n = max(shuffle_partitions(spark), -(-classes.count() // TASK_STRETCHES))
    stretches = to_cut.mapInArrow(tidy(_stretches(length)), "key long, a long, n long, second boolean, skip long, ends boolean, bytes binary")
    found = written(stretches.repartition(n, "key").mapInArrow(tidy(_matches(length)), "a long, n long, s long, e long").distinct(), "matches")
    released(spark)
    start = F.shiftright("place", 2 * _BITS)
    hit = twice.join(found, ["a", "n"]).select("id", "tie", (start + F.col("s")).alias("s"), (start + F.col("e")).alias("e"))
    spans = written(hit.groupBy("id", "tie").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    dropped(twice, classes, found)
    released(spark)
    return docs, spans


def _joined(documents: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    docs, spans = repeated_spans(documents, length, id_col, text_col)
    return docs.join(spans, docs["id"].eqNullSafe(spans["id"]) & (docs["tie"] == spans["tie"]), "left").select(docs["id"], "text", "spans")


def deduplicate(documents: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every byte that a string of `length` bytes covers which also starts anywhere else, in any document.

    Returns per document doc_id, n_bytes, n_removed, n_spans, kept_sha256. Null text counts as empty; texts
    shorter than `length` lose nothing; repeated rows and null ids are documents like others (of two equal
    long rows both lose everything). Other columns aren't read. An empty table gives an empty result.
    """
    return _joined(documents, length, id_col, text_col).mapInArrow(tidy(_removed()), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(documents: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the bytes that deduplicate() removes; all other columns as they are.

    A character of which only some bytes would stay goes whole. Documents of which nothing is left go, others
    that were empty before stay.
    """
    columns = documents.columns
    _, spans = repeated_spans(documents, length, id_col, text_col)
    rows = documents.select(F.struct(*[f"`{c}`" for c in columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("tie"))
    joined = rows.join(spans, rows["id"].eqNullSafe(spans["id"]) & (rows["tie"] == spans["tie"]), "left").select("row", F.col(f"row.`{text_col}`").alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in pieces(batch, "text"):
                text, out, keep = part.column(1), [], []
                for i, own in enumerate(part.column(2).to_pylist()):
                    if not own:
                        out.append(text[i].as_py())
                        keep.append(True)
                        continue
                    raw, end, left = data[at[i] : at[i + 1]].tobytes(), 0, []
                    for s, e in merged([(x["s"], x["e"]) for x in own]):
                        left.append(raw[end:s].decode("utf-8", "ignore"))
                        end = e
                    left.append(raw[end:].decode("utf-8", "ignore"))
                    out.append("".join(left))
                    keep.append(bool(out[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["row", "text"]).filter(pa.array(keep, pa.bool_()))

    new = joined.mapInArrow(tidy(run), T.StructType([joined.schema["row"], T.StructField("text", T.StringType())]))
    return new.select(*[(F.col("text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in columns])
