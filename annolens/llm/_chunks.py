"""Cutting texts where no pre-token crosses, and encoding the pieces once per worker or group of texts.

In the pre-token pattern a match holds a space only at its start or inside a
run of white space, and a white-space run gives up its last character to a
following non-space. So a text may be cut before every space that a non-space
follows, and each piece encodes alike wherever it stands.
"""

from __future__ import annotations

from collections.abc import Callable
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

ROOM = 24 << 20
CHARS = 64
LAST_LATIN = "\u024f"
MARKS = frozenset(",.;:!?")


class Table(dict):
    """What ``of`` gives for a short key; it starts anew when its entries take about ``room`` bytes."""

    def __init__(self, of=None, room: int = ROOM):
        self.of, self.room = of, room
        self.release()

    def __missing__(self, key: str):
        return self.keep(key, self.of(key))

    def keep(self, key: str, value):
        if len(key) <= CHARS:
            self.free -= getsizeof(key) + getsizeof(value) + 90  # its share of the table
            if self.free < 0:
                self.release()
            self[key] = value
        return value

    def release(self) -> None:
        self.clear()
        self.free = self.room


class _Odd(Exception):
    """Some space of a text has no word behind it."""


class ChunkEncoder(Table):
    """Maps the part after a cut's space to its packed ids; its two tables have ``room`` bytes together.

    ``pretoken(str) -> bytes`` packs the ids of one match of the pattern.
    """

    def __init__(self, pattern: str, pretoken, room: int = 2 * ROOM):
        self.findall = regex.compile(pattern).findall
        self.tokens = Table(pretoken, room // 8)
        super().__init__(pretoken, room - room // 8)

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace():
            raise _Odd
        if part.isalpha() and (part.isascii() or max(part) <= LAST_LATIN):  # letters are one match, kept in one table
            packed = self.of(" " + part)
        elif part[-1] in MARKS and (word := part[:-1]).isalpha() and (word.isascii() or max(word) <= LAST_LATIN):  # and the mark another
            packed = self[word] + self.tokens[part[-1]]
        else:
            packed = b"".join(map(self.tokens.__getitem__, self.findall(" " + part)))
        return self.keep(part, packed)

    def release(self) -> None:
        super().release()
        self.tokens.release()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        head, *parts = text.split(" ")
        try:
            rest = b"".join(map(self.__getitem__, parts))
        except _Odd:
            return b"".join(map(self.tokens.__getitem__, self.findall(text)))
        return b"".join(map(self.tokens.__getitem__, self.findall(head))) + rest


def encode_together(texts: pa.Array, findall: Callable[[str], list[str]], encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all ``texts`` (not null) in one array, and their number for each text.

    Each distinct piece between cuts is matched once and each distinct match encoded once. ``findall`` gives the matches
    of a text, ``encode`` the ids of distinct matches in one array and their number for each.
    """
    parts = pc.split_pattern(texts, " ")
    first = parts.offsets.to_numpy()
    heads, rest = first[:-1], np.diff(first) - 1
    coded = parts.values.dictionary_encode()
    follows = np.ones(first[-1], bool)
    follows[heads] = False  # no space stands before a text's head
    no_word = pc.or_(pc.equal(pc.binary_length(coded.dictionary), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(coded.dictionary, 0, 1))).to_numpy(zero_copy_only=False)
    lead = parts.values.take(pa.array(heads)).to_pylist()
    # a space without a word behind it is no cut: such texts are matched whole
    for k in (np.unique(np.searchsorted(heads, np.flatnonzero(follows & no_word[coded.indices.to_numpy()]), "right")) - 1).tolist():
        follows[first[k] : first[k + 1]], rest[k], lead[k] = False, 0, texts[k].as_py()
    which = coded.indices.to_numpy()[follows]
    used = np.flatnonzero(np.bincount(which, minlength=len(coded.dictionary)))
    pieces = coded.dictionary.take(pa.array(used))
    del parts, coded, follows

    matches = findall("".join([" ", pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), " ")[0].as_py()])) if len(pieces) else []
    of_text = list(map(findall, lead))
    n_lead = np.array([len(x) for x in of_text], np.int64)
    known = pa.array([*matches, *(m for x in of_text for m in x)], pa.string()).dictionary_encode()
    place, words = known.indices.to_numpy(), known.dictionary
    # a piece's first match takes the space, and no other has one
    begins = np.flatnonzero(pc.starts_with(known.dictionary, " ").to_numpy(zero_copy_only=False)[place[: len(matches)]])
    of_texts, place = place[len(matches) :], place[: len(matches)]
    del matches, of_text, known

    ids, sizes = encode(words)
    more, each = _gather(ids, sizes, place)
    each = np.diff(np.append(0, np.cumsum(each))[np.append(begins, len(place))])
    ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, each])
    row = np.zeros(used[-1] + 1 if len(used) else 0, np.int64)
    row[used] = np.arange(len(words), len(sizes))
    ids, sizes = _gather(ids, sizes, np.insert(row[which], np.repeat(np.cumsum(rest) - rest, n_lead), of_texts))
    return ids, np.diff(np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(n_lead + rest))])


def _gather(ids: np.ndarray, sizes: np.ndarray, rows: np.ndarray, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The ids of ``rows``, where row k has ``sizes[k]`` of ``ids``, and their number for each of ``rows``; ``step`` rows at a time."""
    starts, n = np.cumsum(sizes) - sizes, sizes[rows]
    out, to = np.empty(n.sum(), ids.dtype), 0
    for k in range(0, len(rows), step):
        size = n[k : k + step]
        ends = np.cumsum(size)
        at = np.repeat(starts[rows[k : k + step]] - ends + size, size)
        at += np.arange(len(at))
        out[to : to + len(at)] = ids[at]
        to += len(at)
    return out, n


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out
