"""Token-id files with a minimal perfect hash index.

Documents are encoded where they lie; ids, not texts, are then dealt into ranges of the key, in ascending order, whose
bounds come from the keys alone. A range is written as one or more shards of `SHARD_BYTES` of ids at most, or of one
document that has more. Every shard is one binary file:

    raw ids of all documents, one after the other, little-endian
    offsets   documents + 1 unsigned 64-bit: where each document's ids begin, in ids
    keys      one signed 64-bit per document, and a byte each that is 1 where the key is null
    hash      a bit array per level: a key's place is the number of set bits up to its own (ranks are stored)
    prints    an unsigned 32-bit fingerprint per distinct key, by hash place
    rows      an unsigned 64-bit number of the key's first document, by hash place
    last, magic, version, bytes per id, number of documents, ids, keys, and bytes of the hash

A lookup hashes the key level by level to the first set bit, compares the fingerprint, and reads offsets and ids at
computed positions: constant time, whatever the size of the file. The manifest (one row per shard, with the least and
greatest key) is a table beside it, so the shards that can hold a key are known without opening any; `find` looks keys
up over a whole corpus, and `read_back` finds every document of every shard through the hash. `start` of a shard is
the number of ids in the shards before it.

A task writes under a name of its own, so a task that is run again or twice leaves files that no manifest names; the
manifest is settled once, readers go by it alone, and such files go with the folder. A folder without a scheme is one
of Spark's default file system; its scheme must be one that pyarrow reads.

Defined results: a null text counts as empty; every document ends with the end id, so an empty one has one id. Very
long texts are encoded whole. Rows that repeat a key are all stored, next to each other in any order; a lookup in a
shard gives the first, `find` gives all. A key with more rows than a range takes is dealt over several. A null key sorts
first, is stored and read back, and can't be looked up. Keys must be whole numbers of 64 bits at most, else an error
says so. An empty table gives no files and an empty manifest. Extra columns are not stored, whatever they are called.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.bpe import LONG, byte_symbols, newer_letters, slices
from tessera.llm.common import quoted, settled, table, work_dir

MAGIC = b"TIDS"
_HEADER = struct.Struct("<4sHHQQQQ")
#: Bytes of text to a range of keys, about, while there are no more than `MAX_RANGES` of them.
RANGE_BYTES = 32_000_000
MAX_RANGES = 4000
#: Bytes of ids to a shard, at most.
SHARD_BYTES = 256_000_000
SLICE_CHARS = 1_000_000
#: Distinct pre-tokens that a worker remembers since its memory last turned; those of the turn before are kept beside.
REMEMBERED = 100_000
_BYTE_SYMBOLS = dict(enumerate(byte_symbols()))
_SPACE_SYMBOL = _BYTE_SYMBOLS[32]
#: Bits per key in each level of the hash.
GAMMA = 2
_MANIFEST = "range int, part int, path string, n_docs bigint, n_ids bigint, least bigint, greatest bigint"


# --- the hash -----------------------------------------------------------------------------------------------------


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mix of every key; another one for each salt."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys.

    Level by level, a key takes the bit that it hashes to if no other key of that level wants it; the rest go on to
    the next level. A key's place is the number of set bits before its own, over all levels.
    """

    levels: list[np.ndarray]  # bits, one byte each while in memory

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.astype(np.int64).view(np.uint64), []
        while len(left):
            size = max(8, GAMMA * len(left))
            at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            wanted = np.bincount(at, minlength=size)
            levels.append(wanted == 1)
            left = left[wanted[at] != 1]
        return cls(levels)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key of the set; any place, or -1, for others."""
        keys = keys.astype(np.int64).view(np.uint64)
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for k, bits in enumerate(self.levels):
            at = (mixed(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            rank = np.cumsum(bits) - 1
            hit = bits[at]
            out[open_[hit]] = base + rank[at[hit]]
            base += int(bits.sum())
            open_ = open_[~hit]
        return out

    def packed(self) -> bytes:
        """Per level: size, set bits before it, and 64-bit words each followed by the set bits before it."""
        out, before = [], 0
        for bits in self.levels:
            words = np.zeros(-(-len(bits) // 64) * 64, bool)
            words[: len(bits)] = bits
            values = np.packbits(words, bitorder="little").view("<u8")
            counts = np.bitwise_count(values).astype(np.uint64)
            ranks = before + np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.uint64)
            out.append(struct.pack("<Q", len(bits)) + np.stack([values, ranks.astype(np.uint64)], axis=1).astype("<u8").tobytes())
            before += int(counts.sum())
        return b"".join(out)


def places_in(packed: bytes, keys: np.ndarray) -> np.ndarray:
    """`PerfectHash.places` by the packed form alone."""
    keys = keys.astype(np.int64).view(np.uint64)
    out, open_, at, level = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0, 0
    while at < len(packed) and len(open_):
        (size,) = struct.unpack_from("<Q", packed, at)
        words = np.frombuffer(packed, "<u8", 2 * -(-size // 64), at + 8).reshape(-1, 2)
        bit = mixed(keys[open_], level) % np.uint64(size)
        word, rank = words[(bit >> np.uint64(6)).astype(np.int64)].T
        below = bit & np.uint64(63)
        hit = (word >> below & np.uint64(1)).astype(bool)
        place = rank + np.bitwise_count(word & ((np.uint64(1) << below) - np.uint64(1)))
        out[open_[hit]] = place[hit].astype(np.int64)
        open_, at, level = open_[~hit], at + 8 + words.nbytes, level + 1
    return out


def print_of(keys: np.ndarray) -> np.ndarray:
    """The 32-bit fingerprint that is stored of each key."""
    return (mixed(keys.astype(np.int64).view(np.uint64), 0xF1) >> np.uint64(32)).astype("<u4")


# --- files --------------------------------------------------------------------------------------------------------


def qualified(spark: SparkSession, folder: str) -> str:
    """`folder` with its scheme, which is that of Spark's default file system if it has none."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", full)


class ShardWriter:
    """Writes one shard: ids as they come, the index at the end."""

    def __init__(self, folder: str, id_bytes: int):
        self.uri, self.id_bytes = f"{folder}/{uuid.uuid4().hex}.tids", id_bytes
        fs, at = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(at)
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, key: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.keys.append(key)
        self.lengths.append(len(ids) // self.id_bytes)
        self.size += len(ids)

    def close(self) -> dict:
        """What the manifest says of the shard."""
        offsets = np.concatenate(([0], np.cumsum(np.array(self.lengths, np.uint64)))).astype("<u8")
        nulls = np.array([k is None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        distinct, first = np.unique(keys[nulls == 0], return_index=True)
        first = np.flatnonzero(nulls == 0)[first] if len(first) else first
        hashed = PerfectHash.build(distinct)
        prints, rows = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u8")
        if len(distinct):
            at = hashed.places(distinct)
            prints[at] = print_of(distinct)
            rows[at] = first
        hash_bytes = hashed.packed()
        for section in (offsets.tobytes(), keys.tobytes(), nulls.tobytes(), hash_bytes, prints.tobytes(), rows.tobytes()):
            self.out.write(section)
        n_ids = int(offsets[-1])
        self.out.write(_HEADER.pack(MAGIC, 1, self.id_bytes, len(keys), n_ids, len(distinct), len(hash_bytes)))
        self.out.close()
        least, greatest = (int(distinct[0]), int(distinct[-1])) if len(distinct) else (None, None)
        return {"path": self.uri, "n_docs": len(keys), "n_ids": n_ids, "least": least, "greatest": greatest}


class Shard:
    """Reads one shard file."""

    def __init__(self, uri: str):
        fs, at = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        magic, version, self.id_bytes, self.n_docs, self.n_ids, self.n_keys, hash_bytes = _HEADER.unpack(self._at(size - _HEADER.size, _HEADER.size))
        if magic != MAGIC or version != 1:
            raise ValueError(f"{uri} is not a token-id file of version 1")
        self.offsets_at = self.n_ids * self.id_bytes
        self.keys_at = self.offsets_at + 8 * (self.n_docs + 1)
        self.nulls_at = self.keys_at + 8 * self.n_docs
        self.hash_at = self.nulls_at + self.n_docs
        self.prints_at = self.hash_at + hash_bytes
        self.rows_at = self.prints_at + 4 * self.n_keys

    def _at(self, position: int, n: int) -> bytes:
        return self.file.read_at(n, position)

    def ids(self, begin: int, n: int) -> np.ndarray:
        return np.frombuffer(self._at(begin * self.id_bytes, n * self.id_bytes), f"<u{self.id_bytes}").astype("<u4")

    def _column(self, at: int, kind: str, n: int) -> np.ndarray:
        return np.frombuffer(self._at(at, n * np.dtype(kind).itemsize), kind)

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's first document, found through the hash; -1 for keys that the shard hasn't."""
        if not self.n_keys:
            return np.full(len(keys), -1, np.int64)
        place = places_in(self._at(self.hash_at, self.prints_at - self.hash_at), keys)
        prints, rows = self._column(self.prints_at, "<u4", self.n_keys), self._column(self.rows_at, "<u8", self.n_keys).astype(np.int64)
        found = np.where(place >= 0, rows[place], -1)
        found[(found >= 0) & (prints[place] != print_of(keys))] = -1
        # A fingerprint of 32 bits may agree by chance; the stored key doesn't.
        stored = self._column(self.keys_at, "<i8", self.n_docs)
        return np.where((found >= 0) & (stored[found] == keys), found, -1)

    def documents(self, keys: np.ndarray | None = None, block: int = 4_000_000) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Key, start and ids of the documents of `keys`, each found through the hash, in file order; of all documents,
        those without a key first, if None. Ids are read in blocks of about `block`.
        """
        stored, nulls = self._column(self.keys_at, "<i8", self.n_docs), self._column(self.nulls_at, "u1", self.n_docs).astype(bool)
        offsets = self._column(self.offsets_at, "<u8", self.n_docs + 1).astype(np.int64)
        # Documents of a key are a run that ends where the next begins.
        edges = np.flatnonzero(np.concatenate(([True], (stored[1:] != stored[:-1]) | nulls[:-1] & ~nulls[1:], [True])))
        runs = edges[:-1][~nulls[edges[:-1]]] if self.n_docs else edges[:0]
        wanted = stored[runs] if keys is None else keys
        first = self.rows_of(wanted)
        if keys is None and not np.array_equal(first, runs):
            raise ValueError("the index of a token-id file does not lead to its documents")
        first = np.unique(first[first >= 0])
        ends = edges[np.searchsorted(edges, first, "right")] if len(first) else first
        rows = np.repeat(first - np.cumsum(ends - first) + ends - first, ends - first) + np.arange(int((ends - first).sum()))
        if keys is None:
            rows = np.concatenate((np.flatnonzero(nulls), rows))
        i = 0
        while i < len(rows):
            # As many documents that follow each other as a block takes.
            limit = min(len(rows), i + max(1, int(np.searchsorted(offsets, offsets[rows[i]] + block, "right")) - 1 - int(rows[i])))
            together = np.flatnonzero(np.diff(rows[i:limit]) != 1)
            j = i + int(together[0]) + 1 if len(together) else limit
            held = self.ids(int(offsets[rows[i]]), int(offsets[rows[j - 1] + 1] - offsets[rows[i]]))
            for k in rows[i:j].tolist():
                begin = int(offsets[k] - offsets[rows[i]])
                yield None if nulls[k] else int(stored[k]), int(offsets[k]), held[begin : begin + int(offsets[k + 1] - offsets[k])]
            i = j

    def lookup(self, key: int) -> np.ndarray | None:
        """The ids of the first document with this key, by a bounded number of small reads; None if there is none."""
        if not self.n_keys:
            return None
        k = np.array([key], np.int64).view(np.uint64)
        at, level = self.hash_at, 0
        while at < self.prints_at:
            (size,) = struct.unpack("<Q", self._at(at, 8))
            bit = int(mixed(k, level)[0] % np.uint64(size))
            word, rank = struct.unpack("<QQ", self._at(at + 8 + 16 * (bit // 64), 16))
            if word >> (bit % 64) & 1:
                place = rank + (word & ((1 << (bit % 64)) - 1)).bit_count()
                (stored,) = struct.unpack("<I", self._at(self.prints_at + 4 * place, 4))
                if stored != int(mixed(k, 0xF1)[0] >> np.uint64(32)):
                    return None
                (row,) = struct.unpack("<Q", self._at(self.rows_at + 8 * place, 8))
                (found,) = struct.unpack("<q", self._at(self.keys_at + 8 * row, 8))
                begin, end = struct.unpack("<QQ", self._at(self.offsets_at + 8 * row, 16))
                return self.ids(begin, end - begin) if found == key else None
            at, level = at + 8 + 16 * -(-size // 64), level + 1
        return None


# --- encoding -----------------------------------------------------------------------------------------------------


@cache
def _unsure_characters() -> frozenset[str]:
    """Characters that `re` may class in another way than the library: separators, old kinds of spaces, numbers that are no decimal digits, and letters that are newer than its tables."""
    numbers = {c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No")}
    return newer_letters() | numbers | set("\x1c\x1d\x1e\x1f\u180e\u200b\ufeff")


class _Unsure(Exception):
    """A pre-token holds a character by which the library may cut in another way."""


class _Known(dict):
    """Ids of pre-tokens; what is missing is taken from the turn before or encoded by the library's model."""

    def __init__(self, model, code: str, past: dict[str, bytes]):
        self.tokenize, self.past = model.tokenize, past
        self.packers = [struct.Struct(f"<{n}{code}").pack for n in range(LONG + 1)]
        self.code, self.unsure = code, _unsure_characters()

    def __missing__(self, word: str) -> bytes:
        found = self.past.get(word)
        if found is None:
            # Printable ASCII but the space is written as itself.
            if word.isascii() and word.isprintable():
                written = word.replace(" ", _SPACE_SYMBOL)
            elif not self.unsure.isdisjoint(word):
                raise _Unsure
            else:
                written = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_BYTE_SYMBOLS)
            ids = [t.id for t in self.tokenize(written)]
            found = self.packers[len(ids)](*ids) if len(ids) <= LONG else struct.pack(f"<{len(ids)}{self.code}", *ids)
        if len(word) <= LONG:
            self[word] = found
        return found


class ByteEncoder:
    """Encodes with the tokenizers library, whose model is asked once for each distinct pre-token.

    Texts that hold an added token, or a character that the library may class in another way, go to the library whole;
    such characters are looked for only in pre-tokens not met before, and a pre-token with one is never remembered. Remembers the pre-tokens of the present turn and the turn before.
    """

    #: The pre-tokens of byte-level vocabularies as `re` can state them, letters first as they are the most frequent.
    _PRE_TOKENS = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    def __init__(self, path: str, id_bytes: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.code = {2: "H", 4: "I"}[id_bytes]
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        step = spec["pre_tokenizer"]
        self.own_cut = spec["normalizer"] is None and step["type"] == "ByteLevel" and step["use_regex"] and not step["add_prefix_space"]
        self.known = _Known(self.library.model, self.code, {})

    def _encode(self, text: str) -> bytes:
        if self.own_cut and not any(x in text for x in self.added):
            with suppress(_Unsure):
                return b"".join(map(self.known.__getitem__, self._PRE_TOKENS.findall(text)))
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = _Known(self.library.model, self.code, dict(self.known))
        return [self._encode(t) if t else b"" for t in texts]


_encoders: dict[tuple[str, int], ByteEncoder] = {}


def encoder_of(path: str, id_bytes: int) -> ByteEncoder:
    """The encoder of this worker process, which its tasks share."""
    if (path, id_bytes) not in _encoders:
        _encoders[path, id_bytes] = ByteEncoder(path, id_bytes)
    return _encoders[path, id_bytes]


def _bounds(df: DataFrame, n: int) -> np.ndarray:
    """Keys that cut the rows of `df` (`key`) into `n` ranges of about as many rows each; nulls count as the least."""
    if n == 1:
        return np.empty(0, np.int64)
    least = F.coalesce("key", F.lit(-(2**63)).cast("bigint"))
    found = df.agg(F.percentile_approx(least, [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0]
    return np.array(found or [], np.int64)


def written(df: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes the shards of `df` into `folder` and returns their manifest.

    Columns: `range` and `part`, which order the shards, `path`, `n_docs`, `n_ids`, and `least` and `greatest` key.
    """
    spark = df.sparkSession
    if df.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"keys must be whole numbers, and {key} is {df.schema[key].dataType.simpleString()}")
    folder = qualified(spark, folder)
    id_bytes = 2 if Tokenizer.from_file(path).get_vocab_size() <= 65_536 and end_id < 65_536 else 4
    chosen = df.select(quoted(key).cast("bigint").alias("key"), quoted(text).alias("text"))
    total = chosen.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    n = min(MAX_RANGES, max(1, -(-total // range_bytes)))
    bounds = _bounds(chosen.select("key"), n)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, seen = encoder_of(path, id_bytes), np.array([end_id], f"<u{id_bytes}").tobytes(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE_CHARS):
                ids = [x + end for x in encoder.encode(texts[a:b])]
                keys = batch.column(0).slice(a, b - a)
                known = keys.fill_null(-(2**63)).to_numpy()
                # A key that is a bound more than once has that many ranges to itself.
                low, high = np.searchsorted(bounds, known, "left"), np.searchsorted(bounds, known, "right")
                at = low + (np.arange(seen, seen + len(ids)) % np.maximum(1, high - low))
                seen += len(ids)
                yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), pa.array(at.astype(np.int32))], names=["key", "ids", "range"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ("range", "part", "path", "n_docs", "n_ids", "least", "greatest"), (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4)
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        writer, name = None, (-1, 0)
        closed = lambda: pa.RecordBatch.from_pylist([{"range": name[0], "part": name[1], **writer.close()}], schema=schema)
        for batch in batches:
            for k, ids, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer and (at != name[0] or writer.size + len(ids) > shard_bytes):
                    yield closed()
                    writer, name = None, (at, name[1] + 1 if at == name[0] else 0)
                if not writer:
                    writer, name = ShardWriter(folder, id_bytes), (at, name[1] if at == name[0] else 0)
                writer.add(k, ids)
        if writer:
            yield closed()

    encoded = chosen.mapInArrow(encode, "key bigint, ids binary, range int")
    ordered = encoded.repartitionById(n, "range").sortWithinPartitions("range", "key")
    return settled(ordered.mapInArrow(write, _MANIFEST))


def _placed(manifest: DataFrame) -> DataFrame:
    """The manifest with `base`, the number of ids before each shard; its rows are shards, not documents."""
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("*", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))


_FOUND = "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _emitted(base: int, documents: Iterator[tuple[int | None, int, np.ndarray]], with_ids: bool) -> Iterator[pa.RecordBatch]:
    names = ["key", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [*[pa.int64()] * 4, *([pa.binary()] if with_ids else [])]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    for key, start, ids in documents:
        raw = ids.tobytes()
        held.append((key, base + start, len(ids), zlib.crc32(raw), *((raw,) if with_ids else ())))
        size += 64 + len(raw) * with_ids
        if size > 8_000_000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def read_back(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """`key`, `start`, `n_tokens`, `ids_crc32` and, if wanted, `ids` (binary, four bytes each) of every stored document,
    each but those without a key found through the hash of its shard.
    """
    placed = settled(_placed(manifest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _emitted(row["base"], Shard(row["path"]).documents(), with_ids)

    shards = placed.select("path", "base", F.row_number().over(Window.orderBy("range", "part")).alias("at"))
    n = max(1, placed.count())
    return shards.repartitionById(n, F.col("at").cast("int") - 1).select("path", "base").mapInArrow(run, _FOUND + (", ids binary" if with_ids else ""))


def find(manifest: DataFrame, keys: DataFrame, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """What `read_back` gives, for the documents of the `keys` (column `key`) alone.

    The manifest says which shards can hold a key; those alone are opened, and each key is found through the hash.
    """
    placed = settled(_placed(manifest))
    # At most `MAX_RANGES` rows; ranges lie one after the other and share at most a key at their ends.
    ranges = placed.groupBy("range").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest")).filter("least IS NOT NULL").orderBy("range").collect()
    numbers, least, greatest = (np.array([r[c] for r in ranges], np.int64) for c in ("range", "least", "greatest"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            low, high = np.searchsorted(greatest, own, "left"), np.searchsorted(least, own, "right")
            n = np.maximum(0, high - low)
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(numbers[at].astype(np.int32))], names=["wanted", "range"])

    wanted = keys.select(quoted(key).cast("bigint").alias("wanted")).filter("wanted IS NOT NULL").distinct().mapInArrow(deal, "wanted bigint, range int")
    dealt = wanted.join(placed.select("range", "path", "base", "least", "greatest"), "range").filter("wanted BETWEEN least AND greatest")

    def run(group: pa.Table) -> pa.Table:
        found = Shard(group.column("path")[0].as_py()).documents(np.sort(group.column("wanted").to_numpy()))
        kinds = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])
        return pa.Table.from_batches(_emitted(group.column("base")[0].as_py(), found, with_ids), schema=kinds)

    return dealt.groupBy("path").applyInArrow(run, _FOUND + (", ids binary" if with_ids else ""))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "token-files")
    manifest = written(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_back(manifest, with_ids=False).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
