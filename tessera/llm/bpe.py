"""BPE encoding and decoding with a pair occurrence index.

The texts of a batch are cut into pre-tokens as the vocabulary file states; each distinct pre-token is encoded once. For the ones not met yet, all symbols of the batch stand in one row, and an
index maps every mergeable pair to all places where it occurs. The active merge ranks are taken in ascending order;
a rank is applied at all its places at once, and the lists of the pairs to the left and right of each place are
updated. That gives what merging each pre-token on its own gives, because a merge can only bring about pairs of a
higher rank, which `Vocabulary` verifies when it loads a file.

Defined results: a null text counts as empty, and an empty text has no ids and decodes to the empty string. Strings
of added tokens within a text become their ids, as the tokenizers library has it by default. Repeated rows are
encoded alike. Very long texts are encoded whole; one that has more than a slice's characters is a slice of its own.
Ties: of one rank's places that overlap, the leftmost is merged. An empty table gives an empty result. Extra columns are
left out of `encoded`, whatever they are called, and a key called like a result column gives that a longer name.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from typing import Generic, TypeVar

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import fresh, quoted, table

#: Distinct strings that a worker remembers since its memory last turned; those of the turn before are kept beside.
REMEMBERED = 250_000
#: Strings of more characters are not remembered.
LONG = 100
#: Characters of text that are encoded and handed on together, unless one text alone has more.
SLICE_CHARS = 2_000_000
#: White space as Unicode defines it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The normalizer and pre-tokenizer that this module has code for, as a vocabulary file states them.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_RUN = re.compile(f"[{_SPACE}]+")
#: str.split() takes these for white space; Unicode does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WORDS = regex.compile(_PATTERN.replace(r"\s", _SPACE))


#: Bits of the right symbol in the number of a pair; vocabularies have fewer symbols.
_SHIFT = 20

V = TypeVar("V")


class Vocabulary:
    """Symbols, merges and added tokens of a BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError("a BPE file without dropout, subword prefix and decoder is needed")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.added.items()]}
        #: Rank by pair, a pair being written as one number.
        self.merges: dict[int, int] = {}
        self.rules: list[tuple[int, int, int]] = []
        made: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, new = self.ids[a], self.ids[b], self.ids[a + b]
            if made.setdefault(new, rank) != rank or max(made.get(left, -1), made.get(right, -1)) >= rank:
                raise ValueError(f"merge {rank} comes before its parts or makes a symbol again")
            self.merges[left << _SHIFT | right] = rank
            self.rules.append((left, right, new))
        if any(x in made for x in (self.ids.get(c) for c in self.ids if len(c) == 1)):
            raise ValueError("a single symbol is made by a merge")
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if (spec["normalizer"] or {}).get("normalizers") != _NORMALIZER or steps[0].get("pattern") != {"Regex": _PATTERN} or not steps[0]["invert"] or steps[1]["type"] != "ByteLevel" or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            raise ValueError("the file states another normalizer or pre-tokenizer")
        #: Ids of single bytes, within a word and at its end.
        self.inner = [self.ids[c] for c in byte_symbols()]
        self.final = [self.ids[c + self.suffix] for c in byte_symbols()]
        self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        #: Letters and digits so new that the library may not know them; it cuts texts with these itself.
        self.library = Tokenizer.from_file(path)
        self.newer = newer_letters()
        self.added_pattern = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")") if self.added else None

    def words(self, text: str, by_library: bool = False) -> list[str]:
        """The pre-tokens of `text`, strings of added tokens among them."""
        if self.added_pattern is not None and "<" in text and self.added_pattern.search(text):
            return [w for part in self.added_pattern.split(text) for w in ([part] if part in self.added else self._words(part, by_library))]
        return self._words(text, by_library)

    def _words(self, text: str, by_library: bool) -> list[str]:
        if by_library:
            library = self.library
            return [self.text_of(w) for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
        # The library lowers each character on its own, so a capital sigma has one small form.
        return _WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def text_of(self, symbols: str) -> str:
        return bytes(self.byte_of[c] for c in symbols).decode()

    def start(self, word: str) -> list[int]:
        """The symbols a word has before any merge: its bytes."""
        encoded = word.encode()
        inner = self.inner
        out = [inner[b] for b in encoded]
        out[-1] = self.final[encoded[-1]]
        return out


@cache
def newer_letters() -> frozenset[str]:
    """Letters and digits that `regex` knows and Python's own Unicode tables don't."""
    every = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    return frozenset(regex.findall(r"[\p{L}\p{N}\p{M}]", every))


def byte_symbols() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def merge_all(words: list[str], vocabulary: Vocabulary) -> list[list[int]]:
    """The ids of each of the non-empty `words`, by a pair occurrence index over all of them."""
    if not words:
        return []
    merges, rules = vocabulary.merges, vocabulary.rules
    symbol: list[int] = []
    before: list[int] = []
    after: list[int] = []
    places: dict[int, list[int]] = defaultdict(list)
    begins = []
    for word in words:
        first = len(symbol)
        begins.append(first)
        symbol += vocabulary.start(word)
        last = len(symbol) - 1
        before += [-1, *range(first, last)]
        after += [*range(first + 1, last + 1), -1]
        for i in range(first, last):
            rank = merges.get(symbol[i] << _SHIFT | symbol[i + 1])
            if rank is not None:
                places[rank].append(i)
    active = list(places)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        left, right, new = rules[rank]
        for i in sorted(places.pop(rank)):
            j = after[i]
            if j < 0 or symbol[i] != left or symbol[j] != right:
                continue  # an overlapping place to the left took one of the two
            k = after[j]
            symbol[i], symbol[j], after[i] = new, -1, k
            h = before[i]
            if k >= 0:
                before[k] = i
                beside = merges.get(new << _SHIFT | symbol[k])
                if beside is not None:
                    if beside not in places:
                        heapq.heappush(active, beside)
                    places[beside].append(i)
            if h >= 0:
                beside = merges.get(symbol[h] << _SHIFT | new)
                if beside is not None:
                    if beside not in places:
                        heapq.heappush(active, beside)
                    places[beside].append(h)
    out = []
    for first, end in zip(begins, [*begins[1:], len(symbol)], strict=True):
        own = symbol[first:end]
        out.append([x for x in own if x >= 0] if -1 in own else own)
    return out


class Memory(Generic[V]):
    """What was found for strings, of this turn and the turn before; a turn ends when it has `limit` strings."""

    def __init__(self, limit: int):
        self.limit = limit
        self.now: dict[str, V] = {}
        self.past: dict[str, V] = {}

    def turn(self) -> None:
        if len(self.now) > self.limit:
            self.past, self.now = self.now, {}

    def missing(self, strings: Iterable[str]) -> list[str]:
        """Those of the distinct `strings` that are not known; the others are of this turn from now on."""
        now, past, out = self.now, self.past, []
        for x in strings:
            if x not in now:
                found = past.get(x)
                if found is None:
                    out.append(x)
                else:
                    now[x] = found
        return out


class Encoder:
    """Encodes texts to ids (little-endian, four bytes each) and to their decoded string.

    A text is cut at white space, and each distinct piece is looked up; pieces not met yet are cut into pre-tokens,
    and those not met yet are merged. No pre-token holds white space, so pieces are independent.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words: Memory[tuple[bytes, str]] = Memory(REMEMBERED)
        self.pieces: Memory[tuple[bytes, str]] = Memory(REMEMBERED)

    def _cut(self, text: str) -> list[str]:
        """Pieces of `text` at white space, which Python's separators U+001C to U+001F are not to Unicode."""
        return text.split() if not _SEPARATORS.search(text) else _RUN.split(text)

    def _learn(self, pieces: list[str]) -> None:
        v, words = self.vocabulary, self.words
        newer = v.newer
        cut = {p: v.words(p, not p.isascii() and not newer.isdisjoint(p)) for p in pieces}
        words.turn()
        unknown = words.missing(set().union(*cut.values()))
        ordinary = [w for w in unknown if w not in v.added]
        for w, ids in zip(ordinary, merge_all(ordinary, v), strict=True):
            words.now[w] = struct.pack(f"<{len(ids)}I", *ids), " ".join([v.tokens[i] for i in ids])
        for w in unknown:
            if w in v.added:
                words.now[w] = struct.pack("<I", v.added[w]), w
        known = words.now
        for p, own in cut.items():
            if len(own) == 1:
                self.pieces.now[p] = known[own[0]]
            else:
                found = [known[w] for w in own]
                self.pieces.now[p] = b"".join([x for x, _ in found]), " ".join([x for _, x in found])

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        self.pieces.turn()
        cut = [self._cut(t) if t else [] for t in texts]
        unknown = self.pieces.missing(set().union(*cut))
        if unknown:
            self._learn(unknown)
        known, out = self.pieces.now, []
        for own in cut:
            found = [known[p] for p in own]
            out.append((b"".join([x for x, _ in found]), " ".join([x for _, x in found if x])))
        for p in unknown:
            if len(p) > LONG:
                del known[p]
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this worker process, which its tasks share."""
    if path not in _encoders:
        _encoders[path] = Encoder(Vocabulary(path))
    return _encoders[path]


def slices(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with `limit` characters together, or with one text that has more."""
    begin = held = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def encoded(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `ids` (binary: little-endian unsigned 32-bit) and `decoded` (string) of every row."""
    kind, ids_name, decoded_name = df.schema[key].dataType.simpleString(), fresh("ids", [key]), fresh("decoded", [key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE_CHARS):
                ids, decoded = zip(*encoder.encode(texts[a:b]), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[key, ids_name, decoded_name])

    return df.select(quoted(key).alias(key), quoted(text).alias(fresh("_text", [key]))).mapInArrow(run, f"`{key}` {kind}, {ids_name} binary, {decoded_name} string")


def digests(df: DataFrame, path: str) -> DataFrame:
    """`doc_id`, number of ids and the SHA-256 of ids and decoded text."""
    return encoded(df, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
