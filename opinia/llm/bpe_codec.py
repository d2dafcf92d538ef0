"""BPE encoding with a backtracking encoder, decoding with an offset table.

The encoder writes a word as a string of symbols (bytes, the last one marked as the
end of the word).  An Aho-Corasick automaton over the vocabulary gives the longest
token at every position.  Tokens are taken greedily, and a token may follow another
only if merging by rank would leave the two side by side; where no token fits, the
last one is taken back and its longest proper prefix tried.  A position that led
nowhere is never tried again, so a word takes linear time, and the result is that
of merging pair by pair.

Whether two tokens are compatible is kept in a table, filled as pairs turn up: the
right edge of the first and the left edge of the second are undone merge by merge,
and no earlier merge may exist across.

Decoding gathers slices of one buffer that holds all token strings one after
another.  Texts are cut at white space and the pieces of a task's recent chunks are
remembered, within a bound; the memory changes no result.

Defined results: NULL and empty texts have no tokens; special strings inside a text
become their special token; texts of any length are encoded whole; rows of equal
doc_id are all returned.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opinia.llm.common import bounded_batches, in_small_batches, resident, table

#: Unicode white space, and the four separators that only Python adds to it.
SPACE = re.compile("[\t-\r \u0085   -     　]+")
NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Below this character every letter is composed, and lower-casing needs no context.
LAST_SIMPLE = "\u0250"
#: The pre-tokenizer's pattern, and how it shows the 256 bytes.
SIMPLE_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_ALPHABET = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
#: Chunks, words (of each generation) and token pairs that a task remembers.
REMEMBERED = 1 << 17
ENCODED = "doc_id long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Tokens of a BPE file as symbol strings, with their merges and prefixes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as source:
            file = json.load(source)
        model = file["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.shown = {i: token for token, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        symbols = {self._symbols(token): i for token, i in model["vocab"].items()}
        self.length = {i: len(s) for s, i in symbols.items()}
        self.rank, self.parts, self.made = {}, {}, {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (symbols[self._symbols(t)] for t in (pair if isinstance(pair, list) else pair.split(" ")))
            made = symbols[self._join(left, right)]
            self.rank.setdefault((left, right), rank)
            self.parts.setdefault(made, (left, right))
            self.made.setdefault(made, rank)
        self.automaton = ahocorasick.Automaton()
        for string, i in symbols.items():
            if i in self.parts or len(string) == 1:
                self.automaton.add_word(string, (i, len(string)))
        self.automaton.make_automaton()
        self.shorter = {i: self._prefix(string) for string, i in symbols.items()}

    def _symbols(self, token: str) -> str:
        """One character per symbol; the last one of a word moves to a private range."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            return self.ended(token[:-len(self.suffix)])
        return token

    def ended(self, word: str) -> str:
        """A word in the byte alphabet as symbols."""
        return word[:-1] + chr(0xE000 + ord(word[-1])) if self.suffix else word

    def _join(self, left: int, right: int) -> str:
        return self._symbols(self.shown[left] + self.shown[right])

    def _prefix(self, string: str) -> int | None:
        """The longest token that is a proper prefix."""
        found = [value[0] for end, value in self.automaton.iter(string[:-1]) if end + 1 == value[1]]
        return found[-1] if found else None


class Remembered(dict):
    """Recent results of a function of short strings, in two generations.

    When the younger one is full it becomes the older one, so what is in frequent
    use stays.
    """

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        made = self.older.get(key)
        if made is None:
            made = tuple(self.make(key))
        if len(key) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = made
        return made


class Encoder:
    """The backtracking encoder over a vocabulary, and its decoder."""

    def __init__(self, path: str) -> None:
        self.words = Vocabulary(path)
        self.library = Tokenizer.from_file(path)  # its normaliser and pre-tokenizer only
        longest = sorted(self.words.special, key=len, reverse=True)
        self.finder = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.compatible: dict[tuple[int, int], bool] = {}
        self.of_word = Remembered(lambda word: self.word(self.words.ended(word)))
        self.of_chunk = Remembered(self.chunk)
        count = max(self.words.shown) + 1
        self.shown = OffsetTable([self.words.shown.get(i, "") for i in range(count)])
        self.decimals = OffsetTable([str(i) for i in range(count)])

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two strings by rank ends with these two tokens."""
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= REMEMBERED:
                self.compatible.clear()
            known = self.compatible[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        words = self.words
        before = len(words.rank)  # a merge across must not come before this rank
        while True:
            across = words.rank.get((left, right))
            if across is not None and across < before:
                return False
            made_left, made_right = words.made.get(left, -1), words.made.get(right, -1)
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:  # undo the later merge; of equal ones the right
                before, left = made_left, words.parts[left][1]
            else:
                # Of one rank the leftmost pair merges first: here the one across.
                before, right = made_right + 1, words.parts[right][0]

    def word(self, symbols: str) -> list[int]:
        """The tokens of one word."""
        words, size = self.words, len(symbols)
        longest: list[int | None] = [None] * size
        for end, (i, length) in words.automaton.iter(symbols):
            longest[end - length + 1] = i  # later ends are longer
        tokens: list[int] = []
        dead = bytearray(size + 1)
        at = 0
        token = longest[0] if size else None
        while token is not None:
            end = at + words.length[token]
            if not dead[end] and (not tokens or self.fits(tokens[-1], token)):
                tokens.append(token)
                at = end
                token = longest[at] if at < size else None
                continue
            token = words.shorter[token]
            while token is None:  # nothing fits here: take the last token back
                dead[at] = 1
                last = tokens.pop()
                at -= words.length[last]
                token = words.shorter[last]
        return tokens

    def chunk(self, chunk: str) -> list[int]:
        """The tokens of a piece of text between white space."""
        if max(chunk) < LAST_SIMPLE:
            # Composed Latin letters: lower-casing is all there is to normalise.
            words = [w.encode().decode("latin-1").translate(BYTE_ALPHABET)
                     for w in SIMPLE_WORDS.findall(chunk.lower())]
        else:
            words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(
                self.library.normalizer.normalize_str(chunk))]
        tokens: list[int] = []
        for word in words:
            tokens += self.of_word[word]
        return tokens

    def _plain(self, text: str) -> np.ndarray:
        chunks = [c for c in SPACE.split(text) if c] if NOT_SPACE.search(text) else text.split()
        return np.fromiter(chain.from_iterable(map(self.of_chunk.__getitem__, chunks)), np.int32)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if not self.finder or not self.finder.search(text):
            return self._plain(text)
        return np.concatenate([
            np.array([self.words.special[part]], np.int32) if part in self.words.special else self._plain(part)
            for part in self.finder.split(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens joined by spaces, as the file has no decoder, in UTF-8."""
        return self.shown.joined(ids)


class OffsetTable:
    """Strings one after another in one buffer, each followed by a space."""

    def __init__(self, strings: list[str]) -> None:
        encoded = [s.encode() + b" " for s in strings]
        self.buffer = np.frombuffer(b"".join(encoded), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64)

    def joined(self, ids: np.ndarray, most: int = 1 << 18) -> bytes:
        """The strings of the ids, joined by single spaces."""
        parts = []
        for at in range(0, len(ids), most):
            part = ids[at:at + most]
            starts = self.starts[part]
            sizes = self.starts[part + 1] - starts
            ends = np.cumsum(sizes)
            index = np.repeat(starts - ends + sizes, sizes)
            index += np.arange(ends[-1])
            parts.append(self.buffer[index].tobytes())
        return b"".join(parts)[:-1]


def encoder(path: str) -> Encoder:
    return resident(("bpe", path), lambda: Encoder(path))


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in bounded_batches(batches, "text"):
            ids = [codec.encode(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([codec.decode(i).decode() for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return run


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in bounded_batches(batches, "text"):
            ids = [codec.encode(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()),
                 pa.array([sha(codec.decimals.joined(i)) for i in ids]),
                 pa.array([sha(codec.decode(i)) for i in ids]), *batch.columns[2:]],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *batch.schema.names[2:]])

    return run


def _columns(docs: DataFrame, id_column: str, text_column: str, *carried: Column) -> DataFrame:
    return in_small_batches(
        docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), *carried))


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, its ids and the decoded text."""
    return _columns(docs, id_column, text_column).mapInArrow(_encoded(path), ENCODED)


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
            source_column: str | None = None) -> DataFrame:
    """The same encoding and decoding with digests in place of ids and texts; the source, if named, is carried along."""
    if source_column is None:
        return _columns(docs, id_column, text_column).mapInArrow(_digests(path), DIGESTS)
    source = F.col(source_column).cast("string").alias("source")
    return _columns(docs, id_column, text_column, source).mapInArrow(_digests(path), DIGESTS + ", source string")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the tokenizer of 49,408 ids."""
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
