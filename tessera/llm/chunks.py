"""Exact byte-level BPE encoding by cached chunks of a text.

The split pattern of byte-level BPE never lets a token run across a place where a non-space character
is followed by white space.  So a text cut at such places may be encoded chunk by chunk, and as most
chunks are words seen before, a worker keeps their ids.  ``ChunkEncoder`` takes Python strings;
``ColumnEncoder`` cuts the bytes of an Arrow column, so that only the distinct chunks of a batch become
Python objects.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable
from itertools import islice, repeat

import numpy as np
import pyarrow as pa

from tessera.llm.common import utf8

_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
_ASCII_RUNS = [a + b for a in _SPACES if a < "\x80" for b in " \n"]
_OTHER_RUNS = [a + b for a in _SPACES if a >= "\x80" for b in " \n"]
_CUT = re.compile(r"(?<=\S)(?=[ \n])")

#: Chunks a worker keeps.  Those met first, the frequent ones as a rule, outlive a clearing.
KEPT_CHUNKS = 300_000


def pack_ids(ids: Iterable[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()


class ChunkEncoder:
    """Ids of whole texts from an encoder of single chunks; ``encode_chunks`` gets distinct strings."""

    def __init__(self, encode_chunks: Callable[[list[str]], list[bytes]], kept: int = KEPT_CHUNKS):
        self.encode_chunks, self.kept = encode_chunks, kept
        self.raw: dict[str, bytes] = {}  # by the chunk itself
        self.spaced: dict[str, bytes] = {}  # by the chunk without the one space before it
        self.marks = dict(zip(".,;:!?", encode_chunks(list(".,;:!?")), strict=True))

    def _learn(self, cache: dict[str, bytes], missing: set[str], before: str) -> None:
        """Encode the missing chunks.  A mark after a letter is a token run of its own, so it is added to the ids of the rest."""
        marked = [k for k in missing if k[-1:] in self.marks and k[-2:-1].isalpha()]
        keys = list({k[:-1] for k in marked}.difference(cache) | missing.difference(marked))
        chunks = [k if before and k[:1] == "\n" else before + k for k in keys]
        cache.update(zip(keys, self.encode_chunks(chunks), strict=True))
        for k in marked:
            cache[k] = cache[k[:-1]] + self.marks[k[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        for name in ("raw", "spaced"):
            cache = getattr(self, name)
            if len(cache) > self.kept:
                setattr(self, name, dict(islice(cache.items(), self.kept // 2)))
        raw, spaced = self.raw, self.spaced
        plans, new_raw, new_spaced = [], set(), set()
        for text in texts:
            runs = _ASCII_RUNS if text.isascii() else _ASCII_RUNS + _OTHER_RUNS
            if any(run in text for run in runs):
                pieces = _CUT.split(text)
                new_raw.update(set(pieces).difference(raw))
                plans.append((None, pieces))
            else:
                pieces = text.replace("\n", " \n").split(" ")
                first = pieces.pop(0)
                if first not in raw:
                    new_raw.add(first)
                new_spaced.update(set(pieces).difference(spaced))
                plans.append((first, pieces))
        if new_raw:
            self._learn(raw, new_raw, "")
        if new_spaced:
            self._learn(spaced, new_spaced, " ")
        of_raw, of_spaced = raw.__getitem__, spaced.__getitem__
        return [
            b"".join(map(of_raw, pieces)) if first is None else raw[first] + b"".join(map(of_spaced, pieces))
            for first, pieces in plans
        ]


# ---- Arrow columns -----------------------------------------------------------------------------------

_MARKS = b".,;:!?"
_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True

#: What may begin a chunk: a space or line feed after a character that is no white space, a mark after a letter.
_first = np.zeros(256, np.uint8)
_first[[0x20, 0x0A]] = 1
_first[list(_MARKS)] = 2

#: By the last two bytes of a character, whether it may be white space.  A cut left out does no harm.
_white = np.zeros((256, 256), bool)
_white[:, [ord(c) for c in _SPACES if c < "\x80"]] = True
for _c in _SPACES:
    if _c >= "\x80":
        _white[_c.encode()[-2], _c.encode()[-1]] = True

#: Chunks a worker keeps by a column's bytes, and the bytes of the longest that it keeps.
KEPT_COLUMN_CHUNKS, LONGEST_KEPT = 400_000, 64


def chunk_offsets(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of consecutive UTF-8 texts begin, in bytes, and the end of the last.  No chunk is empty."""
    begins = np.zeros(len(raw) + 1, bool)
    kinds = _first[raw]
    at = np.flatnonzero(kinds[1:]) + 1  # the first byte begins a text
    before = raw[at - 1]
    begins[at[np.where(kinds[at] == 1, ~_white[raw[at - 2], before], _letter[before])]] = True
    begins[offsets] = True
    return np.flatnonzero(begins)


class ColumnEncoder:
    """Ids of the texts of a column, an end id after each, from an encoder of distinct chunks.

    ``encode_chunks`` gives the ids of all its chunks in a row, and their number for each chunk.  With ``whole``
    texts are not cut, as a tokenizer needs whose tokens run across the cuts.
    """

    def __init__(self, encode_chunks: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], end: int, whole: bool = False, kept: int = KEPT_COLUMN_CHUNKS):
        self.encode_chunks, self.whole, self.kept = encode_chunks, whole, kept
        self.places: dict[bytes, int] = {}  # of chunks in ids
        self.ids = pa.array([[end]], pa.list_(pa.int32()))

    def _learn(self, chunks: list[bytes]) -> pa.ListArray:
        ids, counts = self.encode_chunks([c.decode() for c in chunks])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """array<int> of each text; a null is an empty text."""
        raw, offsets = utf8(texts)
        begins = np.unique(offsets) if self.whole else chunk_offsets(raw, offsets)
        coded = pa.BinaryArray.from_buffers(
            pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))]
        ).dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = np.fromiter(map(self.places.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing, ids = np.flatnonzero(places < 0), self.ids
        if len(missing):
            new = [chunks[k] for k in missing.tolist()]
            found = self._learn(new)
            places[missing] = len(ids) + np.arange(len(new))
            ids = pa.concat_arrays([ids, found])
            self._keep(new, found)
        first = np.searchsorted(begins, offsets)  # each text's chunk
        lists = ids.take(pa.array(np.insert(places[coded.indices.to_numpy()], first[1:], 0)))
        return pa.ListArray.from_arrays(lists.offsets.take(pa.array(first + np.arange(len(first)))), lists.values)

    def _keep(self, chunks: list[bytes], found: pa.ListArray) -> None:
        """Keep new chunks; when they are too many, those met first, the frequent ones as a rule, outlive a clearing."""
        if len(self.places) > self.kept:
            self.places = dict(islice(self.places.items(), self.kept // 2))
            self.ids = self.ids[: len(self.places) + 1]
        short = np.fromiter(map(len, chunks), np.int64, len(chunks)) <= LONGEST_KEPT
        kept = [chunks[k] for k in np.flatnonzero(short).tolist()]
        self.places.update(zip(kept, range(len(self.ids), len(self.ids) + len(kept)), strict=True))
        self.ids = pa.concat_arrays([self.ids, found.filter(pa.array(short))])
