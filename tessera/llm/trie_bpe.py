"""BPE with word ends, by a depth-first walk over a trie of the distinct words.

For each prefix of a word the walk keeps one state: the last token of that prefix's encoding.  The last
token t of a prefix is the one token that ends there and stands next to the last token of what is before
it, that is, whose encoding together with that token is the two of them.  So the states of a word give its
encoding, from its end backwards, and the state of a prefix that many words share is found once.

The trie is its words in order, each with the length of the prefix that it shares with the word before:
one node for each character beyond it.  The path from the root is the stack of states, cut back to the
shared length at every word, which visits all nodes depth first and holds one path only.  The last
character of a word with its end mark is an edge of its own.

A text is cut at ASCII white space, which no token holds.  The pieces that a worker has not met are
normalised, cut by the vocabulary's own rules and encoded together, so a batch's distinct words share one
trie; ids of pieces met before are kept, up to a bound.  Strings of added tokens in a text are these
tokens.  Decoding puts the tokens side by side with one space between, as a vocabulary without a decoder does.

Null and empty texts have no tokens.  Rows that repeat, doc_ids that repeat or are null, and texts of any
length are encoded one by one.  An empty table gives an empty result.  Rows keep their other columns;
existing columns ids, n_tokens or decoded are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.chunks import pack_ids
from tessera.llm.common import bounded_batches, slices

#: Pieces of text and words a worker keeps with their ids, and pairs of tokens it keeps with what was found of them.
KEPT_PIECES, KEPT_PAIRS = 300_000, 1_000_000

#: Bytes of texts whose new words share one trie.
_TOGETHER = 4_000_000

#: The file's rule for cutting text, as it must be.
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Below this code point all characters are composed, and this pattern cuts lower-case text by the rule; other pieces go through the library's.
_LATIN = "\u0250"
_kind = lambda first: "".join(chr(c) for c in range(0x80, ord(_LATIN)) if unicodedata.category(chr(c))[0] == first)
_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_kind('L')}]+|[0-9{_kind('N')}]|[^a-z0-9\x20\x09-\x0D\x85\xA0{_kind('L')}{_kind('N')}]+")


class WordBpe:
    """Words to token ids: ``merges`` in order of rank, each of two tokens; ``end`` marks the last character of a word."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        self.plain = {t: k for t, k in vocab.items() if not t.endswith(end)}
        self.ends = {t[: -len(end)]: k for t, k in vocab.items() if t.endswith(end)}
        self.length = {k: len(t) for t, k in self.plain.items()} | {k: len(t) for t, k in self.ends.items()}
        self.rank: dict[tuple[int, int], int] = {}  # of a pair of tokens
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank of its merge, left part, right part
        for rank, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            if self.rank.setdefault(pair, rank) != rank or self.made.setdefault(vocab[a + b], (rank, *pair))[0] != rank:
                raise ValueError("a token must come from one merge")
            if any(p in self.made and self.made[p][0] > rank for p in pair):
                raise ValueError("a token must come after its parts")
        #: Tokens that are the encoding of their own characters; no other can be the last of anything.
        whole = {t for t in vocab.values() if t not in self.made}
        for token, (rank, a, b) in self.made.items():
            if a in whole and b in whole and self._beside(a, b, rank):
                whole.add(token)
        #: All ends of tokens without and with the mark, with the token that is the whole of it or -1.
        self.plain_tails, self.end_tails = (
            {t[k:]: -1 for t in tokens for k in range(len(t))} | {t: k for t, k in tokens.items() if k in whole} for tokens in (self.plain, self.ends)
        )
        self.pairs: dict[int, bool] = {}

    def _beside(self, a: int, b: int, until: float = float("inf")) -> bool:
        """Whether the encoding, by merges of ranks under ``until``, of a's and b's characters is a, b: no merge across them comes before those that make them.

        Both are taken apart, latest merge first; what meets across the border at any time must merge too late to matter.
        Of merges of one rank the left one comes first.
        """
        before = until  # a merge across the border with a rank under this would have come
        while True:
            across = self.rank.get((a, b))
            if across is not None and across < before:
                return False
            left, right = self.made.get(a), self.made.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and left[0] > right[0]:
                before, a = left[0], left[2]
            else:
                before, b = right[0] + 1, right[1]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Token ids of each of the distinct words, none empty."""
        plain, ends, length, pairs = self.plain_tails, self.end_tails, self.length, self.pairs
        if len(pairs) > KEPT_PAIRS:
            pairs.clear()
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list[list[int]] = [[]] * len(words)
        path, states = "", [-1]  # states[d]: the last token of path[:d]

        def last(word: str, to: int, tails: dict[str, int]) -> int:
            at, found = to - 1, []
            while at >= 0 and (token := tails.get(word[at:to])) is not None:
                if token >= 0:
                    found.append((at, token))
                at -= 1
            for at, token in reversed(found):
                if not at:
                    return token
                key = states[at] << 32 | token
                good = pairs.get(key)
                if good is None:
                    good = pairs[key] = self._beside(states[at], token)
                if good:
                    return token
            raise ValueError(f"no token for {word[to - 1]!r}")

        for k in order:
            word = words[k]
            most, shared = min(len(path), len(word) - 1), 0
            if path[:most] == word[:most]:
                shared = most
            else:
                while path[shared] == word[shared]:
                    shared += 1
            del states[shared + 1 :]
            for to in range(shared + 1, len(word)):
                states.append(last(word, to, plain))
            path = word[:-1]
            token, at, ids = last(word, len(word), ends), len(word), []
            while True:
                ids.append(token)
                at -= length[token]
                if not at:
                    break
                token = states[at]
            ids.reverse()
            out[k] = ids
        return out


class Codec:
    """Texts to ids and back, by the content of a tokenizer file of this kind."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(content)
        model = spec["model"]
        plain = not any(model.get(k) for k in ("unk_token", "dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        lower = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        cuts = [(p["type"], p.get("pattern"), p.get("behavior"), p.get("invert"), p.get("add_prefix_space"), p.get("use_regex")) for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        known = [("Split", {"Regex": _RULE}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
        bare = not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if not (plain and lower and cuts == known and bare and model["end_of_word_suffix"] and spec["decoder"] is None and spec["post_processor"] is None):
            raise ValueError("not a lower-case BPE vocabulary with word ends")
        rules = Tokenizer.from_str(content)
        self.normal, self.cut = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.bpe = WordBpe(model["vocab"], (m if isinstance(m, list) else m.split(" ") for m in model["merges"]), model["end_of_word_suffix"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda piece: [piece]
        tokens = {k: t for t, k in model["vocab"].items()} | {k: t for t, k in self.added.items()}
        self.tokens = [tokens.get(k, "").encode() for k in range(max(tokens) + 1)]
        #: A byte as the vocabulary writes it, from characters in which all bytes of UTF-8 occur.
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        shown = "".join(map(chr, [*range(0x800), *range(0x800, 0xD800, 0x800), *range(0xE000, 0x110000, 0x1000)]))
        self.as_written = dict(zip(shown.encode(), level(shown)[0][0], strict=True))
        self.marks = {ord(m): pack_ids(self.bpe.encode([m])[0]) for m in ".,;:!?"}
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _cut(self, piece: bytes) -> list[str | int]:
        """The words of a piece, and ids of added tokens."""
        text = piece.decode()
        if "<|" in text:
            parts = [p for p in self.split_added(text) if p]
            if len(parts) > 1 or parts[0] in self.added:
                return [x for p in parts for x in ([self.added[p]] if p in self.added else self._cut(p.encode()))]
        if text.isascii():
            return [w.translate(self.as_written) for w in _CUT.findall(text.lower())]
        if max(text) < _LATIN:
            return [w.encode().decode("latin-1").translate(self.as_written) for w in _CUT.findall(text.lower())]
        return [w for w, _ in self.cut(self.normal(text))]

    def _learn(self, pieces: set[bytes]) -> None:
        """Encode pieces not met before.  A mark after a letter is a word of its own, so its id follows those of the rest."""
        marked = [p for p in pieces if p[-1] in self.marks and p[:-1].isalpha()]
        cut = {p: self._cut(p) for p in {p[:-1] for p in marked}.union(pieces).difference(self.pieces, marked)}
        if len(self.words) > KEPT_PIECES:
            self.words = dict(islice(self.words.items(), KEPT_PIECES // 2))
        words = self.words
        new = list({w for parts in cut.values() for w in parts if w not in words and not isinstance(w, int)})
        words.update(zip(new, map(pack_ids, self.bpe.encode(new)), strict=True))
        for piece, parts in cut.items():
            self.pieces[piece] = words[parts[0]] if len(parts) == 1 and parts[0] in words else b"".join(pack_ids([w]) if isinstance(w, int) else words[w] for w in parts)
        for piece in marked:
            self.pieces[piece] = self.pieces[piece[:-1]] + self.marks[piece[-1]]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        if len(self.pieces) > KEPT_PIECES:
            self.pieces = dict(islice(self.pieces.items(), KEPT_PIECES // 2))
        cut = [(t or b"").split() for t in texts]
        if new := set().union(*cut).difference(self.pieces):
            self._learn(new)
        return [b"".join(map(self.pieces.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_loaded: dict[str, Codec] = {}


def _codec(content: str) -> Codec:
    """One for each worker process and vocabulary, kept between tasks."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Codec(content)
    return _loaded[key]


def _shipped(docs: DataFrame, path: str):
    """The vocabulary's file for the workers: under two megabytes, whatever the input."""
    bounded_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with ``ids`` (array<int>) of the whole text, ``n_tokens``, and ``decoded`` (string) from the ids."""
    content = _shipped(docs, path)
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "n_tokens", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value)
        for batch in slices(batches, text_col, _TOGETHER):
            coded = codec.encode(_texts(batch, text_col))
            n = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            decoded = pa.array([codec.decode(x) for x in coded], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), ids, pa.array(n), decoded], names=[*(f.name for f in kept), "ids", "n_tokens", "decoded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "ids array<int>, n_tokens long, decoded string"])
    return docs.select(*(f"`{f.name}`" for f in kept)).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode, and hash both where they are made."""
    content = _shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value)
        for batch in slices(batches, most=_TOGETHER):
            coded = codec.encode(_texts(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in coded], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
