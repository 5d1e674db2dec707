"""Quality rules: base counts, and a linear-chain conditional random field over lines that marks content or boilerplate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import SPACE, Spans, U, mixed, pieces, tidy, word_spans

CONTENT, BOILERPLATE = 0, 1
#: The field is fitted on so many labelled documents at most (chosen by a hash of their ids), each with all its lines.
#: This bounds the fitting alone; every line of every document is decoded.
TRAIN_DOCUMENTS = 2000
#: A document is kept if at least this share of its words stands in content lines.
LEAST_SHARE = 0.5

MIN_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[0xC3:0xCA] = True  # first bytes of Latin letters with marks
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[list(b"!?")] = True
_BARE = np.zeros(256, bool)
_BARE[list(b"|=_/\\{}[]~^")] = True
_CODEPOINT = np.ones(256, bool)
_CODEPOINT[0x80:0xC0] = False
FEATURES = ("bias", "symbols", "upper", "digits", "shouts", "bars", "repeated", "duplicate", "one_word", "short", "long_words", "ends_sentence", "symbol_words")


def _sum(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.int64)
    padded = np.append(mask, mask.dtype.type(0))
    out = np.add.reduceat(padded, np.stack([start, end], 1).reshape(-1), dtype=np.int64)[::2]
    return np.where(end > start, out, 0)


def _again(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash: does it occur twice or more in its owner; does it occur there earlier."""
    n = len(hashes)
    key = mixed(hashes ^ mixed(owner.astype(U) + U(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, earlier = np.zeros(n, bool), np.zeros(n, bool)
    earlier[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, earlier


@dataclass
class Measured:
    """Of a block of texts: base counts by text; lines with words (owner, words, features), in text order."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_of: np.ndarray  # index of each text's first line, one more at the end
    line_words: np.ndarray
    features: np.ndarray


def measured(data: np.ndarray, at: np.ndarray) -> Measured:
    n = len(at) - 1
    start, end, of = word_spans(data, at)
    n_words = np.diff(of)
    owner = np.repeat(np.arange(n), n_words)
    # words in 8-word windows that occur twice or more
    covered = np.zeros(len(start), bool)
    if len(start) >= WINDOW:
        words, m = Spans(data, start, end).keys, len(start) - WINDOW + 1
        h = np.zeros(m, U)
        for j in range(WINDOW):
            h += words[j : j + m] * U((2 * j + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)
        inside = np.flatnonzero(owner[:m] == owner[WINDOW - 1 :])
        twice = inside[_again(mixed(h[inside]), owner[inside])[0]]
        mark = np.zeros(len(start) + 1, np.int64)
        np.add.at(mark, twice, 1)
        np.add.at(mark, twice + WINDOW, -1)
        covered = np.cumsum(mark)[:-1] > 0
    n_repeat = _sum(covered, of[:-1], of[1:])
    # lines
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([at[:-1][n_words >= 0], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    text_of = np.searchsorted(at, line_start, "right") - 1
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - ((line_end > line_start) & (data[line_end - 1] == 10))
    first_word = np.searchsorted(start, line_start)
    line_words = np.searchsorted(start, line_end) - first_word
    keep = line_words > 0
    line_start, line_end, text_of, first_word, line_words = (x[keep] for x in (line_start, line_end, text_of, first_word, line_words))
    earlier = _again(Spans(data, line_start, line_end).keys, text_of)[1]
    n_dup = np.bincount(text_of[earlier], minlength=n)
    # features of lines
    size = np.maximum(line_end - line_start, 1)
    letters = np.maximum(_sum(_LETTER[data], line_start, line_end), 1)
    symbols = _sum(_SYMBOLS[data], line_start, line_end)
    word_size = _sum(_CODEPOINT[data] & ~SPACE[data], line_start, line_end) / np.maximum(line_words, 1)
    last = data[np.maximum(line_end - 1, 0)] if len(line_end) else np.zeros(0, np.uint8)
    odd_words = np.zeros(len(start), bool)
    if len(start):
        odd_words = _sum(_SYMBOLS[data], start, end) > 0
    columns = [
        np.ones(len(line_start)),
        np.minimum(symbols / size * 10, 1),
        _sum(_UPPER[data], line_start, line_end) / letters,
        np.minimum(_sum(_DIGIT[data], line_start, line_end) / size * 4, 1),
        np.minimum(_sum(_SHOUT[data], line_start, line_end) / np.maximum(line_words, 1), 1),
        np.minimum(_sum(_BARE[data], line_start, line_end) / np.maximum(line_words, 1) * 2, 1),
        _sum(covered, first_word, first_word + line_words) / np.maximum(line_words, 1),
        earlier.astype(float),
        (line_words == 1).astype(float),
        (line_words < 5).astype(float),
        (word_size > 14).astype(float),
        np.isin(last, list(b".!?:;\"'")).astype(float),
        _sum(odd_words, first_word, first_word + line_words) / np.maximum(line_words, 1),
    ]
    return Measured(
        n_words, _sum(_CODEPOINT[data] & ~SPACE[data], at[:-1], at[1:]), _sum(_SYMBOLS[data], at[:-1], at[1:]), n_dup, n_repeat,
        np.searchsorted(text_of, np.arange(n + 1)), line_words, np.stack(columns, 1) if len(line_start) else np.zeros((0, len(FEATURES))),
    )


@dataclass
class Field:
    """Weights of the conditional random field: by state and feature, by pair of states, by first state."""

    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def decoded(self, features: np.ndarray, line_of: np.ndarray, extra: np.ndarray | float = 0.0) -> np.ndarray:
        """The most probable states of each sequence of lines (ties: content), `extra` being added to the states' scores. Sequences advance together, line by line."""
        scores = features @ self.emit.T + extra
        n = len(scores)
        back, states = np.zeros((n, 2), np.int8), np.zeros(n, np.int8)
        lengths = np.diff(line_of)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = line_of[:-1][order], lengths[order]
        alive = int((lengths > 0).sum())
        if not alive:
            return states
        best = self.first + scores[begin[:alive]]
        ends = np.zeros((alive, 2))
        for t in range(1, int(lengths[0])):
            now = int(np.searchsorted(-lengths, -t, "left"))  # sequences longer than t
            ends[now:alive] = best[now:alive]
            best = best[:now]
            via = best[:, :, None] + self.move[None]
            pick = via.argmax(1)
            back[begin[:now] + t] = pick
            best = np.take_along_axis(via, pick[:, None, :], 1)[:, 0] + scores[begin[:now] + t]
            alive = now
        ends[:alive] = best
        state = ends.argmax(1).astype(np.int8)
        for t in range(int(lengths[0]) - 1, -1, -1):
            now = int(np.searchsorted(-lengths, -t, "left"))
            at = begin[:now] + t
            states[at] = state[:now]
            state[:now] = back[at, state[:now]]
        return states


#: Biases among which the least is sought that lets a labelled document's lines agree with its label.
BIASES = (0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 1e6)


def _climbed(params: list[np.ndarray], gradient, steps: int, rate: float, penalty: float) -> list[np.ndarray]:
    """Gradient steps (Adam) upward."""
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        for i, g in enumerate(gradient(*params)):
            g = g - penalty * params[i]
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.999 * m2[i] + 0.001 * g * g
            params[i] = params[i] + rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    return params


def _pseudo_likelihood(x: np.ndarray, states: np.ndarray, line_of: np.ndarray, weight: np.ndarray):
    """The gradient of the sum over lines of log P(state | features, states of the lines before and after)."""
    n, each = len(x), np.arange(len(x))
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    is_first[line_of[:-1]] = True
    is_last[line_of[1:] - 1] = True
    before, after = np.roll(states, 1), np.roll(states, -1)

    def gradient(emit: np.ndarray, move: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        score = x @ emit.T
        score += np.where(is_first[:, None], first, move.T[:, before].T)
        score += np.where(is_last[:, None], 0, move[:, after].T)
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        gap = -p / p.sum(1, keepdims=True)
        gap[each, states] += 1
        gap *= weight[:, None]
        pair = np.zeros((2, 2))
        for s in (0, 1):
            pair[s] += gap[~is_first & (before == s)].sum(0)
            pair[:, s] += gap[~is_last & (after == s)].sum(0)
        return [gap.T @ x, pair, gap[is_first].sum(0)]

    return gradient


def agreeing(field: Field, x: np.ndarray, line_of: np.ndarray, words: np.ndarray, labels: np.ndarray, least: float = LEAST_SHARE) -> np.ndarray:
    """The best states of each document's lines under which its label holds.

    A good document has at least the share `least` of its words in content lines, a bad one less: the state that
    a document lacks gets the least bias that brings the share about. The other lines keep what the field says.
    """
    of = np.repeat(np.arange(len(labels)), np.diff(line_of))
    total = np.add.reduceat(words, line_of[:-1])
    states, open_ = np.zeros(len(x), np.int8), np.ones(len(labels), bool)
    lacking = np.where(labels == CONTENT, CONTENT, BOILERPLATE)[of]
    for bias in BIASES:
        extra = np.zeros((len(x), 2))
        extra[np.arange(len(x)), lacking] = bias
        got = field.decoded(x, line_of, extra)
        share = np.add.reduceat(np.where(got == CONTENT, words, 0), line_of[:-1]) / total
        now = open_ & ((share >= least) == (labels == CONTENT))
        states[now[of]] = got[now[of]]
        open_ &= ~now
    return states


def fitted(sequences: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 4, steps: int = 60, rate: float = 0.1, penalty: float = 1e-3) -> Field:
    """Fits the field to documents (features of the lines, words of the lines, label), whose lines have no labels.

    A label bounds a document's share of content words, no more. It starts from single lines: what tells the lines of
    bad documents from those of good ones. Then, in turn, each document's lines get the states that the field prefers
    among those that agree with its label (agreeing()), and the field is fitted to these states by gradient steps on
    their pseudo-likelihood, good and bad documents weighing the same. Without documents of both kinds all lines
    are content.
    """
    sequences = [s for s in sequences if len(s[0])]
    width = len(FEATURES)
    if len({y for _, _, y in sequences}) < 2:
        return Field(np.stack([np.eye(width)[0], np.zeros(width)]), np.zeros((2, 2)), np.zeros(2))
    x, words = np.concatenate([s[0] for s in sequences]), np.concatenate([s[1] for s in sequences])
    labels = np.array([s[2] for s in sequences])
    line_of = np.concatenate([[0], np.cumsum([len(s[0]) for s in sequences])])
    sizes = np.diff(line_of)
    kind = np.repeat(labels, sizes)
    # each kind of documents, and each document of a kind, weighs the same
    weight = np.repeat(np.where(labels == BOILERPLATE, 0.5 / (labels == BOILERPLATE).sum(), 0.5 / (labels == CONTENT).sum()) / sizes, sizes)
    params = [np.zeros((2, width)), np.zeros((2, 2)), np.zeros(2)]
    alone = np.arange(len(x) + 1)  # every line a sequence of its own
    line_gradient = _pseudo_likelihood(x, kind, alone, weight)
    params = _climbed(params, lambda e, m, f: [line_gradient(e, m, f)[0], np.zeros((2, 2)), np.zeros(2)], steps, rate, penalty)
    for _ in range(rounds):
        states = agreeing(Field(*params), x, line_of, words, labels)
        params = _climbed(params, _pseudo_likelihood(x, states, line_of, weight), steps, rate, penalty)
    return Field(*params)


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCUMENTS) -> Field:
    """Fits the field on at most `most` labelled documents, chosen by a hash of their ids, each with all its lines; labels are 1 (good) and 0 (bad).

    Other labels, null ids, and labelled ids without a document are ignored; of rows that share an id one counts (of
    labels the least). Without labels or documents of both kinds the field calls all lines content.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(most)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = docs.join(F.broadcast(chosen), "id").select("id", "y", "text")  # at most `most` rows are broadcast
    # of rows that share an id one, the least by its text's hash, so that what reaches the driver is bounded too
    rows = rows.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "y", "text")).alias("one")).select("id", "one.y", "one.text")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in pieces(batch, "text"):
                got = measured(data, at)
                of = list(zip(got.line_of[:-1].tolist(), got.line_of[1:].tolist(), strict=True))
                own, words = ([x[a:b].tobytes() for a, b in of] for x in (got.features.astype("<f8"), got.line_words.astype("<i8")))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.binary()), pa.array(words, pa.binary())], ["id", "y", "lines", "words"])

    got = rows.mapInArrow(tidy(lines), "id long, y int, lines binary, words binary").collect()
    got.sort(key=lambda r: r.id)
    return fitted([(np.frombuffer(r.lines, "<f8").reshape(-1, len(FEATURES)), np.frombuffer(r.words, "<i8"), CONTENT if r.y else BOILERPLATE) for r in got])


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long, base_failed boolean, kept boolean"


def judged(data: np.ndarray, at: np.ndarray, field: Field) -> list[pa.Array]:
    got = measured(data, at)
    states = field.decoded(got.features, got.line_of)
    content = _sum(np.where(states == CONTENT, got.line_words, 0), got.line_of[:-1], got.line_of[1:])
    failed = (got.n_words < MIN_WORDS) | (100 * got.n_repeat_words > MOST_REPEATED * got.n_words)
    kept = ~failed & (content >= LEAST_SHARE * got.n_words)
    return [pa.array(np.asarray(x, np.int64)) for x in (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words, content)] + [pa.array(failed), pa.array(kept)]


def rate(documents: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts and verdict of every document: doc_id and COLUMNS. No shuffle.

    Null and empty texts have no words and fail the base rule; texts of any length are read whole. Null ids and
    repeated rows are rows like others; of states with equal scores content counts; other columns aren't read.
    An empty table gives an empty result.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), *judged(data, at, field)], ["doc_id", *(x.split()[0] for x in COLUMNS.split(", "))])

    return docs.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def keep_good(documents: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, all columns as they are, whatever their names; no shuffle.

    Null and empty texts fail the base rule and go; texts of any length are judged whole; null ids and repeated
    rows are judged like others; there are no ties; an empty table gives an empty one.
    """
    columns = [f"`{c}`" for c in documents.columns]
    rows = documents.select(F.struct(*columns).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in pieces(batch, "text"):
                yield part.select(["row"]).filter(judged(data, at, field)[-1])

    return rows.mapInArrow(tidy(run), T.StructType([rows.schema["row"]])).select(*[F.col(f"row.{c}") for c in columns])
