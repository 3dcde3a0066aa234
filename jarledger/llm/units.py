"""Texts cut at places where every tokenizer in use must cut, and ids gathered by distinct unit.

A unit runs from one such place to the next: a single space with no white
space beside it begins one, a lone line feed between other characters is one,
and one of ``MARKS`` behind a letter begins one.  What a tokenizer makes of a
unit then doesn't depend on its neighbours, so a slice's texts are cut with
array operations, each distinct unit is looked up once, and its ids are
gathered for all its places.  Which cuts hold for a vocabulary is its user's
to check (:func:`crosses_nothing` does that for pieces).

White space is a superset of what tokenizers call so, and letters are a subset:
a cut that isn't certain is not made, which only makes a unit longer.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from jarledger.llm.common import byte_view

MARKS = ".,;:!?|$%&*#"
_NARROW = np.zeros(256, bool)
_NARROW[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True
_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
#: White space beyond ASCII, fixed values of Unicode.
WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE_LEADS = sorted({c[0] for c in WIDE_SPACES})
#: First bytes of two-byte characters that are all letters but for × and ÷.
_LETTER_LEADS = (0xC3, 0xC4, 0xC5, 0xD0, 0xD1)


def crosses_nothing(pieces: Iterable[str]) -> bool:
    """Whether no piece reaches across a cut that :func:`cut` makes."""
    return not any("\n" in p[:-1] or "\n" in p[1:] or
                   any((a != " " and b == " ") or (a.isalpha() and b in MARKS) for a, b in zip(p, p[1:])) for p in pieces)


def white_bytes(buf: np.ndarray) -> np.ndarray:
    """Marks the bytes of white space."""
    white = _NARROW[buf]
    for lead in _WIDE_LEADS:
        at = np.flatnonzero(buf == lead)
        for space in (s for s in WIDE_SPACES if s[0] == lead):
            some = at[at + len(space) <= len(buf)]
            for i, b in enumerate(space[1:], 1):
                some = some[buf[some + i] == b]
            for i in range(len(space)):
                white[some + i] = True
    return white


def cut(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units begin; ``starts`` are the texts' first bytes and the end of the last."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    white = white_bytes(buf)
    before = np.concatenate(([True], white[:-1])) | edge[:-1]
    after = np.concatenate((white[1:], [True])) | edge[1:]
    alone = ~before & ~after
    fresh = edge[:-1].copy()
    fresh |= alone & (buf == 32)
    line = np.flatnonzero(alone & (buf == 10))
    fresh[line] = True
    fresh[line + 1] = True
    mark = np.flatnonzero(_MARK[buf] & ~before)
    last = buf[mark - 1]
    letter = _LETTER[last]
    wide = np.flatnonzero((last >= 0x80) & (mark >= 2))
    lead = buf[mark[wide] - 2]
    letter[wide] = np.isin(lead, _LETTER_LEADS) & ~((lead == 0xC3) & ((last[wide] == 0x97) | (last[wide] == 0xB7)))
    fresh[mark[letter]] = True
    return np.flatnonzero(fresh)


def pieces_of(buf: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw, at = buf.tobytes(), ends.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


class Units:
    """The units of a slice of texts: distinct ones, and which of them follow each other in each text."""

    def __init__(self, texts: pa.Array):
        buf, offsets = byte_view(texts)
        begins = cut(buf, offsets)
        self.text_starts = np.searchsorted(begins, offsets)  # each text's first unit, and the end
        ends = np.append(begins, len(buf)).astype(np.int64)
        if len(begins):
            whole = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf))])
            coded = whole.dictionary_encode()
            self.distinct, self.codes = pieces_of(*byte_view(coded.dictionary)), coded.indices.to_numpy()
        else:
            self.distinct, self.codes = [], np.zeros(0, np.int32)

    def gather(self, values: list[bytes], dtype) -> tuple[np.ndarray, np.ndarray]:
        """The values of all units one after another, and where each text's begin (and the end).

        ``values`` has an array of ``dtype`` as bytes for each distinct unit.
        """
        width = np.dtype(dtype).itemsize
        flat = np.frombuffer(b"".join(values), dtype)
        size = np.fromiter(map(len, values), np.int64, len(values)) // width
        begin = np.cumsum(size) - size
        size = size[self.codes]
        ends = np.concatenate(([0], np.cumsum(size)))
        place = np.repeat(begin[self.codes] - ends[:-1], size)
        place += np.arange(len(place))
        return flat[place], ends[self.text_starts]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of its units' values."""
        ends = np.concatenate(([0], np.cumsum(values[self.codes], dtype=np.int64)))[self.text_starts]
        return np.diff(ends)
