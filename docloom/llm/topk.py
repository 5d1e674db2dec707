"""Exact top-k inner products by threshold aggregation without random access."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import written

#: Components of the candidates of one cell, the unit of work, whose lists are sorted once for all its queries; and those queries.
CELL, QUERIES = 1 << 22, 1 << 13
#: A list is cut in so many batches at most; so many queries read the lists together, fewer at first.
BATCHES, TOGETHER, FIRST = 4, 256, 16
#: Bounds are compared whenever what the unread parts of the lists can add has fallen to this part.
FALL = 0.85
#: Numbers of a block of candidates whose read entries are summed up in one product.
BLOCK = 1 << 20
#: So many sums, or cursors' steps, of queries that read together at most.
ROOM = 1 << 24
#: Whole numbers below these are exact doubles, and exact floats.
_EXACT, _NARROW = float(1 << 53), float(1 << 24)


class Lists:
    """The sorted lists of a cell's candidates: for each dimension, its values in descending and in ascending order.

    A query reads a dimension's list from the end where its weight makes the values count most. Lists are cut in
    batches of equal size; a cursor says how many batches of a list have been read.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors, (n, d) = vectors, vectors.shape
        batch = max(1, -(-n // BATCHES))
        self.batches = -(-n // batch)
        order = np.argsort(-vectors.T, 1, kind="stable")
        values = np.take_along_axis(vectors.T, order, 1)
        place = np.empty((d, n), np.int64)
        np.put_along_axis(place, order, np.arange(n)[None, :], 1)
        self.head = np.stack([np.concatenate([x[:, ::batch], x[:, -1:]], 1) for x in (values, values[:, ::-1])])  # the first value of each batch, and the last of all
        self.step = np.stack([place // batch, (n - 1 - place) // batch]).astype(np.uint8)  # in which batch a candidate stands
        self.sizes = np.diff(np.minimum(np.arange(self.batches + 1) * batch, n))
        self.left = np.abs(self.head - self.head[:, :, -1:])  # above the list's last value
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        steep = lambda i, b: np.max([(self.left[:, :, i] - self.left[:, :, j]) / (ends[j] - ends[i]) for j in range(b + 1, len(ends))], 0)
        self.slope = np.stack([np.min([steep(i, b) for i in range(b + 1)], 0) for b in range(self.batches)], 2)  # fall an entry, where a steep batch shares its fall with those before it: never rises along a list
        self.entries_read = 0

    def read(self, weights: np.ndarray, seen: np.ndarray) -> None:
        """Adds to seen (queries, candidates) what the entries of the batches count that have a weight: (queries, sides, dimensions, batches)."""
        n, d = self.vectors.shape
        wide = weights.reshape(len(weights), -1).astype(seen.dtype)
        asked = np.flatnonzero(wide.any(0))
        wide = np.ascontiguousarray(wide[:, asked])
        side, each, batch = np.unravel_index(asked, weights.shape[1:])
        each, lowest, size = side * d + each, self.head[:, :, -1], max(64, BLOCK // max(2 * d, len(asked)))
        for at in range(0, n, size):
            step = self.step[:, :, at : at + size].reshape(2 * d, -1)
            rise = np.abs(self.vectors[at : at + size].T - lowest[:, :, None]).astype(seen.dtype).reshape(2 * d, -1)
            seen[:, at : at + size] += wide @ (rise[each] * (step[each] == batch[:, None].astype(np.uint8)))

    def finalists(self, queries: np.ndarray, k: int, own: list[int | None], slack: float = 0.0, kind: type = np.float64) -> Iterator[tuple[int, np.ndarray]]:
        """For each query (its index) the candidates that can be among its k best, by sequential reads alone.

        A candidate's score lies between what has been seen of it and that plus, for each list in which it hasn't been
        seen, what the next unread entry counts there. Lists are read where weight times fall is largest; queries that
        read together have cursors of their own, and the entries that they read between two looks at the bounds are
        summed up together. A query stops once no more than a few candidates (4 k, or a sixteenth) have an upper bound
        that reaches the k-th best lower bound: nobody else, seen or not, can qualify. The first look of later queries
        is where half of the first ones had stopped. slack: how far sums may be off; kind: of the sums.
        """
        stopped: list[float] = []
        start, (n, d) = 0, self.vectors.shape
        few, each, most = max(4 * k, n // 16), np.arange(d), max(1, min(TOGETHER, ROOM // (d * self.batches), ROOM // n))
        while start < len(queries):
            group = np.arange(start, min(len(queries), start + (most if start else min(most, FIRST))))
            start += len(group)
            side, weight = (queries[group] < 0).astype(np.int64), np.abs(queries[group])
            left = weight[:, :, None] * self.left[side, each]  # what a list can still add, by cursor
            order = np.argsort(-(weight[:, :, None] * self.slope[side, each]).reshape(len(group), -1), 1, kind="stable")
            fall = np.take_along_axis((left[:, :, :-1] - left[:, :, 1:]).reshape(len(group), -1), order, 1)
            rest = np.concatenate([np.cumsum(fall[:, ::-1], 1)[:, ::-1], np.zeros((len(group), 1))], 1)  # by batches read
            turn = np.empty_like(order)
            np.put_along_axis(turn, order, np.arange(order.shape[1])[None, :], 1)
            turn = turn.reshape(len(group), d, -1)
            done, seen = np.zeros(len(group), np.int64), np.zeros((len(group), n), kind)
            goal, active = rest[:, 0] * (float(np.median(stopped)) if stopped else FALL), np.arange(len(group))
            while len(active):
                upto = np.maximum((rest[active] > goal[active, None]).sum(1), np.minimum(done[active] + 1, (rest[active] > 0).sum(1)))
                fresh = (turn[active] >= done[active, None, None]) & (turn[active] < upto[:, None, None])
                self.entries_read += int((fresh * self.sizes).sum())
                now = fresh * weight[active, :, None]
                self.read(np.stack([now * (side[active] == s)[:, :, None] for s in (0, 1)], 1), seen)
                done[active] = upto
                going = []
                for i, q in enumerate(active.tolist()):
                    unread, mine = float(rest[q, done[q]]), own[group[q]]
                    if mine is not None:
                        seen[i, mine] = -math.inf
                    bound = float(np.partition(seen[i], n - k)[n - k]) - 2 * slack if n >= k else -math.inf
                    alive = np.flatnonzero(seen[i] >= bound - unread)
                    if unread and few < len(alive) <= n // 4:
                        cursor = (turn[q] < done[q]).sum(1)
                        unseen = self.step[side[q], each][:, alive] >= cursor[:, None]
                        alive = alive[seen[i, alive] + left[q, each, cursor] @ unseen >= bound]
                    if len(alive) <= few or not unread:
                        if group[0] == 0:
                            stopped.append(unread / max(float(rest[q, 0]), 1e-300))
                        yield int(group[q]), alive if mine is None else alive[alive != mine]
                    else:
                        going.append(i)
                        goal[q] = unread * FALL
                if len(going) < len(active):
                    active, seen = active[going], seen[going]


def search(lists: Lists, ids: np.ndarray, queries: np.ndarray, own: list[int | None], k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """For each query (its index), in any order, the k best of the cell: places in it and exact scores, ties to the smaller id.

    Components are whole numbers. Sums are floats where those are exact, else doubles. Where products can leave the
    exact doubles, bounds are taken from vectors scaled by powers of two, with slack for their rounding, and the
    finalists' scores are summed up in Python's integers.
    """
    vectors = lists.vectors
    most = [float(np.abs(x).max()) if x.size else 0.0 for x in (vectors, queries)]
    exact = math.frexp(most[0])[1] + math.frexp(most[1])[1] + max(1, vectors.shape[1]).bit_length() <= 52
    if exact:
        narrow = 2 * most[0] * most[1] * vectors.shape[1] < _NARROW
        for q, found in lists.finalists(queries, k, own, kind=np.float32 if narrow else np.float64):
            scores = vectors[found] @ queries[q]  # finalists in the order of the cell's rows
            if len(found) > k:
                first = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
                found, scores = found[first], scores[first]
            best = np.lexsort((ids[found], -scores))[:k]
            yield q, found[best], scores[best].astype(np.int64).tolist()
        return
    scale = [math.ldexp(1.0, -max(-1000, min(1000, math.frexp(x)[1]))) for x in most]
    for q, found in Lists(vectors * scale[0]).finalists(queries * scale[1], k, own, slack=8e-16 * BATCHES * vectors.shape[1] ** 2):
        whole = [int(x) for x in queries[q]]
        scores = [sum(a * int(b) for a, b in zip(whole, v, strict=True)) for v in vectors[found].tolist()]
        best = sorted(range(len(found)), key=lambda i: (-scores[i], ids[found[i]]))[:k]
        yield q, found[best], [scores[i] for i in best]


def sortable(score: int) -> bytes:
    """Bytes that sort like integers of any size."""
    size = (abs(score).bit_length() + 7) // 8
    own = abs(score).to_bytes(size, "big")
    return (0x8000 + size).to_bytes(2, "big") + own if score >= 0 else (0x8000 - size).to_bytes(2, "big") + bytes(255 - x for x in own)


_RESULT = "query_row long, query_id long, vec_id long, row long, score long, rank_key binary"


def _cell(k: int):
    def run(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        rows, ids, vectors = _arrays(candidates)
        query_rows, query_ids, wanted = _arrays(queries)
        out: list[list] = [[], [], [], [], [], []]
        if len(ids) and len(query_ids):
            width = max(1, vectors.shape[1], wanted.shape[1])
            vectors, wanted = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (vectors, wanted))
            order = np.lexsort((rows, ids))
            rows, ids, vectors = rows[order], ids[order], vectors[order]
            place = {r: i for i, r in enumerate(rows.tolist())}
            for q, found, scores in search(Lists(vectors), ids, wanted, [place.get(r) for r in query_rows.tolist()], k):
                own = [[int(query_rows[q])] * len(found), [int(query_ids[q])] * len(found), ids[found].tolist(), rows[found].tolist()]
                for held, new in zip(out, [*own, [max(-(1 << 63), min((1 << 63) - 1, s)) for s in scores], [sortable(s) for s in scores]], strict=True):
                    held += new
        return pa.table([pa.array(x, pa.binary() if i == 5 else pa.int64()) for i, x in enumerate(out)], [x.split()[0] for x in _RESULT.split(", ")])

    return run


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = table.column("vector").combine_chunks()
    lengths = vectors.value_lengths().to_numpy() if len(vectors) else np.zeros(0, np.int64)
    flat = vectors.flatten().to_numpy()
    out = np.zeros((len(lengths), int(lengths.max()) if len(lengths) else 0))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return table.column("row").to_numpy(), table.column("vec_id").to_numpy(), out


def scaled(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector of whole doubles): floor(scale * x); without null ids, and vectors that are null or of which a component, or its `scale`-fold, is null or not finite."""
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    rows = rows.select("vec_id", F.transform("x", lambda v: v * F.lit(float(scale))).alias("x")).filter(finite_of("x"))
    return rows.select("vec_id", F.transform("x", rounded_down).alias("vector"))


def finite_of(name: str):
    return F.forall(F.col(name), lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))


def rounded_down(v):
    """floor as a double, also beyond the range of a long."""
    return F.when(F.abs(v) < F.lit(_EXACT), F.floor(v).cast("double")).otherwise(v)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k candidates with the highest inner products for each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by `every`, candidates all rows but the query's own. Ties go to
    the smaller id; a query with fewer candidates gets all. Vectors that are null, or hold components that are null
    or not finite (before or after scaling), and null ids take no part; rows that share an id, or are equal, are
    queries and candidates of their own; shorter vectors count as if filled up with zeros, empty ones score 0.
    Ranks are by exact scores; a score beyond the range of a long is shown as that range's end. Other columns aren't
    read; an empty table gives an empty result.

    Queries and candidates are dealt to a grid of cells of at most about QUERIES queries and candidates of CELL components, each of which
    returns k rows a query.
    """
    rows = written(scaled(vectors, scale, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = F.pmod("vec_id", F.lit(every)) == 0
    n, q, width = rows.agg(F.count(F.lit(1)), F.count_if(asked), F.max(F.size("vector"))).first()
    across = max(1, -(-n * (width or 1) // CELL))
    down = max(1, -(-q // QUERIES), min(-(-q // 64), -(-rows.sparkSession.sparkContext.defaultParallelism // across)))
    one = rows.filter(asked).withColumn("r", F.pmod(F.xxhash64("row"), F.lit(down)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    other = rows.withColumn("c", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(across)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    found = one.groupBy("r", "c").cogroup(other.groupBy("r", "c")).applyInArrow(_cell(k), _RESULT)
    order = Window.partitionBy("query_row").orderBy(F.col("rank_key").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
