"""SentencePiece encoding and decoding by a batched Viterbi search over a model's pieces."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Cache, Rolling, Spans, U, pieces, ragged, tidy

_MARK = 0x2581
#: A mark that stands in the text itself; no piece has it, so it is written as bytes and read back as it was.
_LITERAL = 0x110000
#: Words longer than this are cut first where no piece spans the cut; the parts are searched like words.
UNCUT = 64
#: Scores that a search holds at once, about: words of one length advance through them a stretch of ends at a time.
STRETCH = 1 << 20
#: Words that a worker remembers, in some 100 MB; beyond them it forgets all and starts again. Bytes of text that it encodes at once.
REMEMBERED, BLOCK = 300_000, 1 << 19


def default_model() -> str:
    """The path of the public SentencePiece model, as the package of public tokenizers names it."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """A model's pieces and scores, and the best segmentation of words under them.

    A segmentation's score is the sum of its pieces' scores (ties: longer last pieces). A character that is
    no piece costs 10 more than the least score and is written as its UTF-8 bytes. Spaces become marks, one
    mark is put before a non-empty text, and words begin at marks after other characters; no piece spans
    a word's begin, so words are searched by themselves, each distinct one once.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        import sentencepiece

        held = sentencepiece.SentencePieceProcessor(model_file=path)
        size = held.get_piece_size()
        names = [held.id_to_piece(i) for i in range(size)]
        self.bytes = np.zeros(256, np.uint32)
        normal, spelled = [], [b""] * size
        for i, name in enumerate(names):
            if held.is_byte(i):
                self.bytes[int(name[3:5], 16)] = i
                spelled[i] = bytes([int(name[3:5], 16)])
            elif not (held.is_control(i) or held.is_unknown(i) or held.is_unused(i)):
                normal.append(i)
                spelled[i] = name.replace("▁", " ").encode()
        scores = np.array([held.get_score(i) for i in normal])
        usual = scores[scores > -1e8]
        scores = np.maximum(scores, usual.min())  # marks alone have no rank in the model; they count as its last piece
        self.unknown = float(usual.min()) - 10
        points = [np.frombuffer(names[i].encode("utf-32-le"), "<u4") for i in normal]
        lengths = np.array([len(p) for p in points])
        ends = np.cumsum(lengths)
        keys = Rolling(np.concatenate(points).astype(np.int64))(ends - lengths, ends) ^ lengths.astype(U)
        order = np.argsort(keys)
        self.keys, self.scores, self.ids = keys[order], scores[order], np.array(normal, np.uint32)[order]
        self.points = np.full((len(normal), int(lengths.max())), -1, np.int32)  # a piece's characters, to compare with
        for row, k in enumerate(order.tolist()):
            self.points[row, : lengths[k]] = points[k]
        self.sizes = np.array(sorted(set(lengths.tolist()), reverse=True))
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_size = np.array([len(x) for x in spelled], np.int64)
        self.spelled_at = np.cumsum(self.spelled_size) - self.spelled_size
        self.cache = Cache(most)

    def _probe(self, points: np.ndarray, roll: Rolling, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Score and entry of the piece at each start; minus infinity where there is none. Characters are compared on a hit."""
        keys = roll(start, start + size) ^ U(size)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys
        own = np.flatnonzero(hit)
        for k in range(size):
            own = own[points[start[own] + k] == self.points[at[own], k]]
        if size < self.points.shape[1]:
            own = own[self.points[at[own], size] == -1]
        score = np.full(len(start), -np.inf)
        score[own] = self.scores[at[own]]
        return score, at

    def _spelled_out(self, point: int) -> list[int]:
        return [int(self.bytes[b]) for b in chr(_MARK if point == _LITERAL else point).encode()]

    def cut(self, points: np.ndarray, roll: Rolling, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words points[at[i]:at[i + 1]] as parts: where each begins, and its word. No piece spans two parts, so the best segmentations of a word's parts make the word's."""
        size = np.diff(at)
        owner = np.repeat(np.arange(len(size)), size)
        begins = np.zeros(len(points), bool)
        begins[at[:-1]] = True
        inside = np.flatnonzero((size > UNCUT)[owner]) if len(size) else np.zeros(0, np.int64)
        if len(inside):
            spanned = np.zeros(len(points) + 1, np.int32)
            for length in self.sizes[self.sizes > 1].tolist():
                own = inside[inside + length <= at[1:][owner[inside]]]
                for part in np.split(own, range(STRETCH, len(own), STRETCH)):
                    hit = part[self._probe(points, roll, part, length)[0] > -np.inf]
                    spanned[hit + 1] += 1
                    spanned[hit + length] -= 1
            begins[inside[np.cumsum(spanned)[inside] == 0]] = True
        begin = np.flatnonzero(begins)
        return begin, owner[begin]

    def searched(self, points: np.ndarray, roll: Rolling, start: np.ndarray, size: int) -> list[np.ndarray]:
        """Ids of words of one length, advancing together: at each end, the best of all pieces that end there.

        Pieces are probed for a stretch of ends at once, so a long word takes no more memory than many short ones.
        """
        n, most = len(start), int(self.sizes[0])
        best = np.full((n, most + size + 1), -np.inf)  # `most` columns stand before the words
        best[:, most] = 0
        back, entry = np.ones((n, size + 1), np.int16), np.full((n, size + 1), -1, np.int32)
        stretch, each = max(1, STRETCH // (n * len(self.sizes))), np.arange(n)
        for first in range(1, size + 1, stretch):
            ends = np.arange(first, min(first + stretch, size + 1))
            scores = np.full((n, len(ends), len(self.sizes)), -np.inf)
            found = np.zeros(scores.shape, np.int32)
            for k, length in enumerate(self.sizes.tolist()):  # longest first
                lo = max(0, length - first)
                if lo < len(ends):
                    own = (start[:, None] + ends[None, lo:] - length).reshape(-1)
                    score, at = self._probe(points, roll, own, length)
                    scores[:, lo:, k], found[:, lo:, k] = score.reshape(n, -1), at.reshape(n, -1)
            for j, end in enumerate(ends.tolist()):
                total = best[:, most + end - self.sizes] + scores[:, j]
                pick = total.argmax(1)
                beaten, top = total[each, pick], best[:, most + end - 1] + self.unknown
                known = beaten > top
                best[:, most + end] = np.where(known, beaten, top)
                back[known, end], entry[known, end] = self.sizes[pick[known]], found[known, j, pick[known]]
        out = []
        for k, begin in enumerate(start.tolist()):
            own, end, steps, entries = [], size, back[k].tolist(), entry[k].tolist()
            while end:
                if entries[end] < 0:
                    own.extend(reversed(self._spelled_out(int(points[begin + end - 1]))))
                else:
                    own.append(int(self.ids[entries[end]]))
                end -= steps[end]
            out.append(np.array(own[::-1], np.uint32))
        return out

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts one after another, and the texts' offsets."""
        n = len(at) - 1
        full = np.flatnonzero(np.diff(at))
        if not len(full):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        inside = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=inside[1:])
        begin = inside[at[full]] + np.arange(len(full))  # one mark goes before each full text
        raw = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
        points = np.insert(np.where(raw == _MARK, _LITERAL, np.where(raw == 32, _MARK, raw)), inside[at[full]], _MARK)
        mark = points == _MARK
        first = mark.copy()
        first[1:] &= ~mark[:-1]
        first[begin] = True
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(points)))
        points = points.astype("<i4")

        def make(new: np.ndarray) -> list[np.ndarray]:
            own, at = ragged(points, start[new], size[new])  # the new words alone, one after another
            roll = Rolling(own)
            begin, owner = self.cut(own, roll, at)
            length, out = np.diff(np.append(begin, len(own))), [None] * len(begin)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                for many in np.split(group, range(4096, len(group), 4096)):
                    for k, ids in zip(many.tolist(), self.searched(own, roll, begin[many], int(length[group[0]])), strict=True):
                        out[k] = ids
            if len(begin) == len(new):
                return out
            edges = np.searchsorted(owner, np.arange(len(new) + 1)).tolist()
            return [np.concatenate(out[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

        place, count = self.cache.find(Spans(points.view(np.uint8), 4 * start, 4 * (start + size)), make)
        ids, total = ragged(self.cache.flat, place, count)
        offsets = np.zeros(n + 1, np.int64)
        offsets[full + 1] = total[np.searchsorted(start, np.append(begin[1:], len(points)))]
        return ids, np.maximum.accumulate(offsets)

    def decode(self, ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 texts of ids, one after another, and the texts' offsets; the mark before each text goes."""
        flat, total = ragged(self.spelled, self.spelled_at[ids], self.spelled_size[ids])
        at = total[of]
        keep = np.ones(len(flat), bool)
        keep[at[:-1][np.diff(at) > 0]] = False
        return flat[keep], at - np.concatenate([[0], np.cumsum(np.diff(at) > 0)])


_HELD: dict[str, Model] = {}


def model(path: str) -> Model:
    """One model for each Python worker."""
    if path not in _HELD:
        _HELD[path] = Model(path)
    return _HELD[path]


def encode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document doc_id, n_ids, ids (binary, little-endian unsigned 16 or 32 bits by the model's size), ids_crc32 (of 32-bit integers), round_trip. No shuffle.

    round_trip says whether the ids decode to the text again. Null and empty texts have no ids (round_trip
    true). Texts and words of any length are searched whole, in the same way. Null ids and repeated rows are
    rows like others; of segmentations with equal scores the one with the longer last piece counts. Other
    columns aren't read. An empty table gives an empty result.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model(path)
        kind = "<u2" if len(held.spelled_size) <= 1 << 16 else "<u4"
        for batch in batches:
            for part, data, at in pieces(batch, "text", BLOCK):
                ids, of = held.encode(data, at)
                back, ends = held.decode(ids, of)
                raw, again = data.tobytes(), back.tobytes()
                wide, own = ids.astype("<u4"), ids.astype(kind)
                rows = list(zip(of[:-1].tolist(), of[1:].tolist(), strict=True))
                same = [raw[a:b] == again[c:d] for a, b, c, d in zip(at[:-1].tolist(), at[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(of)), pa.array([own[a:b].tobytes() for a, b in rows], pa.binary()), pa.array([zlib.crc32(wide[a:b].tobytes()) for a, b in rows], pa.int64()), pa.array(same, pa.bool_())],
                    ["doc_id", "n_ids", "ids", "ids_crc32", "round_trip"],
                )

    return docs.mapInArrow(tidy(run, caches=True), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_ids long, ids binary, ids_crc32 long, round_trip boolean")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """Per row doc_id and the text of its binary ids. Null ids give a null text, none an empty one; repeated rows and null doc_ids are rows like others; other columns aren't read; an empty table gives an empty result."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model(path)
        kind = "<u2" if len(held.spelled_size) <= 1 << 16 else "<u4"
        for batch in batches:
            own = [None if x is None else np.frombuffer(x, kind) for x in batch.column(1).to_pylist()]
            of = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in own])]).astype(np.int64)
            flat, at = held.decode(np.concatenate([np.zeros(0, np.int64), *(x for x in own if x is not None)]).astype(np.int64), of)
            raw = flat.tobytes()
            texts = [None if x is None else raw[a:b].decode() for x, a, b in zip(own, at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(tidy(run, caches=True), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
