"""BPE encoding and decoding with forced-boundary splitting.

A pair of adjacent byte symbols that stands inside no vocabulary token can
never be merged across, so every such pair marks a certain cut.  Words are cut
there, each fragment is merged on its own (and remembered, as fragments repeat
far more often than words do), and the ids are concatenated.

The tokenizer file is a parameter; workers load it by its path, which has to
be installed on every machine, and keep it for the life of the process.

Defined results: a null text counts as empty and has no ids; texts of any
length are encoded whole; repeated rows are encoded each; an empty table gives
an empty table.  Other columns pass through, whatever their names; the output
columns replace columns of the same name.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded_batches

#: Entries of a generation of a worker's memory of words; of fragments, all.
CACHE_ENTRIES = 1 << 17
#: Longer fragments are merged over a heap, so that their time isn't square.
HEAP_SYMBOLS = 48
#: Longer words and fragments are not remembered.
CACHE_LENGTH = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols, spare = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in symbols:
            symbols[b] = chr(spare)
            spare += 1
    return [symbols[b] for b in range(256)]


class WordBPE:
    """A word-end BPE vocabulary: normalise, split, cut, merge.

    Symbols are handled as numbers, a token's id or a number beyond all ids for
    what is no token by itself; a pair is one number, ``left * base + right``.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.symbols = byte_symbols()
        self.no_id = max(self.tokens) + 1
        self.codes = dict(self.vocab)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        for s in (*self.symbols, *(s + self.end for s in self.symbols), *(part for m in merges for part in (*m, "".join(m)))):
            self.codes.setdefault(s, self.no_id + len(self.codes))
        self.base = max(self.codes.values()) + 1
        self.ranks = {self.codes[left] * self.base + self.codes[right]: rank for rank, (left, right) in enumerate(merges)}
        self.made = [self.codes["".join(m)] for m in merges]
        self.inner = [self.codes[s] for s in self.symbols]
        self.last = [self.codes[s + self.end] for s in self.symbols]
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.space = regex.compile(r"\s+")
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.openers = tuple({t[0] for t in self.added})
        self.joined = self._joined_pairs()
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fragments: dict[tuple[int, ...], tuple[int, ...]] = {}

    def pieces(self, token: str) -> list[str]:
        """The symbols of a token or word; the last carries the word end."""
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _joined_pairs(self) -> set[int]:
        """Pairs that some vocabulary token holds side by side."""
        codes, base = self.codes, self.base
        every = ([codes.get(p) for p in self.pieces(token)] for token in self.vocab)
        return {a * base + b for own in every for a, b in zip(own, own[1:]) if a is not None and b is not None}

    def normalise(self, text: str) -> str:
        if not text.isascii():
            # one character at a time, so no final form of sigma
            return self.space.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()
        return self.space.sub(" ", text).lower()

    def merge(self, codes: tuple[int, ...]) -> tuple[int, ...]:
        """The ids of a fragment: lowest rank first, then leftmost."""
        parts = self._merged_long(codes) if len(codes) > HEAP_SYMBOLS else self._merged(codes)
        return tuple(parts) if max(parts) < self.no_id else tuple(p for p in parts if p < self.no_id)

    def _merged_long(self, codes: tuple[int, ...]) -> list[int]:
        """Parts in a chain; a heap has each pair's rank and place, old ones too."""
        ranks, base, parts = self.ranks, self.base, list(codes)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap = [(r, k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get(a * base + b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            right = after[k]
            # a part that is gone is -1; a pair that has changed has another rank
            if parts[k] < 0 or right < 0 or ranks.get(parts[k] * base + parts[right]) != rank:
                continue
            parts[k] = self.made[rank]
            parts[right] = -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
                if (r := ranks.get(parts[k] * base + parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k))
            if before[k] >= 0 and (r := ranks.get(parts[before[k]] * base + parts[k])) is not None:
                heapq.heappush(heap, (r, before[k]))
        return [p for p in parts if p >= 0]

    def _merged(self, codes: tuple[int, ...]) -> list[int]:
        parts, get, base, none = list(codes), self.ranks.get, self.base, len(self.ranks)
        score = [get(a * base + b, none) for a, b in zip(parts, parts[1:])]
        while score:
            best = min(score)
            if best == none:
                break
            at = score.index(best)
            parts[at : at + 2] = [self.made[best]]
            del score[at]
            if at:
                score[at - 1] = get(parts[at - 1] * base + parts[at], none)
            if at < len(score):
                score[at] = get(parts[at] * base + parts[at + 1], none)
        return parts

    def fragment(self, codes: tuple[int, ...]) -> tuple[int, ...]:
        """``merge`` of a part of a word, remembered if it is short."""
        ids = self.fragments.get(codes)
        if ids is None:
            ids = self.merge(codes)
            if len(codes) <= CACHE_LENGTH:
                if len(self.fragments) >= CACHE_ENTRIES:
                    self.fragments.clear()
                self.fragments[codes] = ids
        return ids

    def word(self, word: str) -> bytes:
        """Little-endian 32-bit ids of one word, fragment by fragment.

        Words are remembered in two generations, so that frequent ones stay.
        """
        out = self.older.get(word)
        if out is None:
            out = self._word(word)
        if len(word) <= CACHE_LENGTH:
            if len(self.words) >= CACHE_ENTRIES:
                self.older = self.words.copy()
                self.words.clear()
            self.words[word] = out
        return out

    def coded(self, word: str) -> list[int]:
        """The symbols of a word's bytes; the last carries the word end."""
        data, inner = word.encode(), self.inner
        codes = [inner[b] for b in data]
        codes[-1] = self.last[data[-1]]
        return codes

    def _word(self, word: str) -> bytes:
        codes, joined, base = self.coded(word), self.joined, self.base
        cuts = [k for k, (a, b) in enumerate(zip(codes, codes[1:]), 1) if a * base + b not in joined]
        if not cuts:
            ids = self.merge(tuple(codes))
        else:
            ids = [i for a, b in zip([0, *cuts], [*cuts, len(codes)]) for i in self.fragment(tuple(codes[a:b]))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        out: list[bytes] = []
        get, word = self.words.get, self.word
        parts = self.specials.split(text) if any(c in text for c in self.openers) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(struct.pack("<I", self.added[part]))
            elif part:
                out += [get(w) or word(w) for w in self.split.findall(self.normalise(part))]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, as a file without decoder joins them: by spaces."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist() if i in tokens])


_loaded: dict[str, WordBPE] = {}


def tokenizer(path: str) -> WordBPE:
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def encode(text: Column, path: str) -> Column:
    """Ids of each text as little-endian unsigned 32-bit integers."""

    @arrow_udf("binary")
    def encode_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path)
        for texts in batches:
            yield pa.array([bpe.encode(t.as_py() or "") for t in texts], pa.binary())

    return encode_texts(text)


def decode(ids: Column, path: str) -> Column:
    """The text of ids that ``encode`` made; null ids decode to the empty text."""

    @arrow_udf("string")
    def decode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path)
        for rows in batches:
            yield pa.array([bpe.decode(r.as_py() or b"") for r in rows], pa.string())

    return decode_ids(ids)


def round_trip(text: Column, path: str) -> Column:
    """``ids`` of each text and what they decode to (``decoded``), in one pass."""

    @arrow_udf("ids binary, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path)
        for texts in batches:
            ids = [bpe.encode(t.as_py() or "") for t in texts]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], ["ids", "decoded"])

    return both(text)


def encode_documents(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """``df`` with the ids of every whole text and, if named, their decoding."""
    bounded_batches(df.sparkSession)
    text = F.col(f"`{text_col}`")
    if decoded_col is None:
        return df.withColumn(ids_col, encode(text, path))
    payload = [c for c in df.columns if c not in (ids_col, decoded_col)]
    both = df.select(F.struct(*[F.col(f"`{c}`") for c in payload]).alias("rest"), round_trip(text, path).alias("both"))
    out = {c: F.col("rest").getField(c) for c in payload} | {ids_col: F.col("both.ids"), decoded_col: F.col("both.decoded")}
    # columns that are replaced keep their place, as with withColumn
    return both.select(*[out[c].alias(c) for c in dict.fromkeys([*df.columns, ids_col, decoded_col])])
