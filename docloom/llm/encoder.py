"""Byte-level BPE by the tokenizers library, with pre-tokens found by array operations and looked up in a cache."""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from docloom.llm.common import Cache, Spans, ragged

#: Pre-tokens that a worker remembers, in some 350 MB; beyond them it forgets all and starts again.
REMEMBERED = 700_000
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def default_tokenizer() -> str:
    """The path of the public byte-level vocabulary, as the package of public tokenizers names it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _classes() -> np.ndarray:
    """The class of each code point below U+0250 in the pre-tokenizer's pattern; 255 where texts go to the library whole."""
    out = np.full(0x250, 255, np.uint8)
    for c in range(0x250):
        kind = unicodedata.category(chr(c))
        if c in (9, 10, 11, 12, 13, 32):
            out[c] = _SPACE
        elif 0x20 < c < 0x7F or 0xA1 <= c:
            out[c] = _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _OTHER
    return out


class Encoder:
    """Ids of texts, equal to what the library's encode_batch(add_special_tokens=False) gives.

    The pre-tokenizer of a byte-level vocabulary (pattern: contractions, letters, numbers or other characters
    with a space before them, white space) cuts texts where character classes change; that is done on the
    bytes of a whole block. Each distinct pre-token is encoded once by the library. Texts with characters from
    U+0250 on, control characters or an added token (<|endoftext|>) go to the library whole.

    special_as_text: added tokens in a text are spelled like other text, so that no text gives their ids.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        #: Texts that hold one of these go to the library whole, which cuts them there first.
        self.added = [] if special_as_text else [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        held = getattr(self.tokenizer.pre_tokenizer, "__class__", type(None)).__name__
        self.cuts = held == "ByteLevel" and self.tokenizer.normalizer is None and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.classes = _classes()
        self.cache = Cache(remembered)

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _starts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pre-tokens start, and which texts aren't cut."""
        n = len(data)
        kind = np.full(n + 1, 255, np.uint8)
        ascii_ = data < 0x80
        kind[:n][ascii_] = self.classes[data[ascii_]]
        lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
        lead = lead[lead + 1 < n]
        code = ((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
        kind[lead] = kind[lead + 1] = np.where(code < 0x250, self.classes[np.minimum(code, 0x24F)], 255)
        odd = np.flatnonzero(kind[:n] == 255)
        odd = [odd, *(self._places(data, x) for x in self.added)]
        odd_texts = np.unique(np.searchsorted(at, np.concatenate(odd), "right") - 1)
        first = np.zeros(n + 1, bool)
        first[1:n] = kind[1:n] != kind[: n - 1]
        first[at[:-1][at[:-1] < n]] = True
        text_start = np.zeros(n + 1, bool)
        text_start[at] = True
        run = np.flatnonzero(first[:n])  # starts of runs of one class
        after = np.append(run[1:], n)
        white = kind[run] == _SPACE
        # the last of several white characters before something else stands alone, or goes before it if it is a space
        last = after[white] - 1
        last = last[~text_start[after[white]]]
        starts = first
        starts[last] = True
        blank_before = np.zeros(n + 1, bool)
        blank_before[1:] = data == 32
        joined = run[~white]
        joined = joined[blank_before[joined] & ~text_start[joined]]
        starts[joined] = False
        # contractions: an apostrophe that begins a pre-token takes one or two letters
        quote = np.flatnonzero((data == 39) & starts[:n])
        if len(quote):
            padded = np.append(data, np.zeros(3, np.uint8))
            ended = np.searchsorted(at, quote, "right")
            room = at[ended] - quote
            one, two = padded[quote + 1], padded[quote + 2]
            single = np.isin(one, list(b"stmd")) & (room > 1)
            double = (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))) & (room > 2)
            for hit, k in ((quote[single], 2), (quote[double], 3)):
                starts[hit + 1] = False
                ends = hit + k
                starts[ends[ends < n]] = True
        return np.flatnonzero(starts[:n]), odd_texts

    @staticmethod
    def _places(data: np.ndarray, token: bytes) -> np.ndarray:
        raw, found, i = data.tobytes(), [], -1
        while (i := raw.find(token, i + 1)) >= 0:
            found.append(i)
        return np.array(found, np.int64)

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of each text's."""
        n = len(at) - 1
        raw = data.tobytes()
        if not self.cuts:
            own = self.library([raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            return np.concatenate([np.zeros(0, np.uint32), *own]), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        start, odd = self._starts(data, at)
        end = np.append(start[1:], len(data))
        if len(odd):
            skip = np.zeros(n + 1, bool)
            skip[odd] = True
            keep = ~skip[np.searchsorted(at, start, "right") - 1]
            start, end = start[keep], end[keep]
        found = self.cache.find(Spans(data, start, end), lambda new: self.library([raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]))
        ids, total = ragged(self.cache.flat, *found)
        offsets = total[np.searchsorted(start, at)] if len(start) else np.zeros(n + 1, np.int64)
        if not len(odd):
            return ids, offsets
        sizes = np.diff(offsets)
        parts, whole = [], dict(zip(odd.tolist(), self.library([raw[at[i] : at[i + 1]].decode() for i in odd.tolist()]), strict=True))
        for i in range(n):
            parts.append(whole[i] if i in whole else ids[offsets[i] : offsets[i + 1]])
            sizes[i] = len(parts[-1])
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum(sizes)])


_HELD: dict[tuple, Encoder] = {}


def encoder(path: str, remembered: int = REMEMBERED, special_as_text: bool = False) -> Encoder:
    """One encoder for each Python worker."""
    key = path, remembered, special_as_text
    if key not in _HELD:
        _HELD[key] = Encoder(*key)
    return _HELD[key]
