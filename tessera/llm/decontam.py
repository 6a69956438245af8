"""Benchmark decontamination by the q-gram lemma.

Texts are reduced to lower-case letters and digits with one space between runs. A benchmark item is cut into
segments of `SEGMENT` characters that start at every word, and the last (a shorter item is one). A document is
contaminated by an item if it holds one of the item's segments within an edit distance of `share` of the segment's
length, so an excerpt counts wherever it begins and ends. Items with fewer than `LEAST` characters count where the
document holds them as whole words.

A stretch that is within k edits of a segment of m characters shares at least ``m - q + 1 - k * q`` of its q-grams,
all on at most k + 1 neighbouring diagonals. So, in this order and with no candidate lost:

1. q-grams of the document that occur in no item are passed over (one bit per hash first, then the hash itself).
2. Where no window as long as the longest stretch holds the bound's number of the others, the document is done with.
3. In what is left, shared q-grams are counted by item in two neighbouring bands of k + 1 diagonals; in bands that
   reach the bound, segments that reach it are retained.
4. Each retained region is verified by a banded alignment of the whole segment, the costs of many at once first.

Hashes only nominate; the alignment decides. Documents are searched many at once, with gaps between them that no
stretch can cross. The benchmark is read in blocks of `BLOCK_CHARS` characters, and each block is one pass over the
documents, so that what a task holds doesn't grow with the benchmark; a block travels as text, and a worker process
makes its index once. Documents never move: there is no shuffle.

Defined results: null and empty texts are clean. Very long texts are searched whole, in overlapping pieces. Items
without letters and digits, null ones included, match nothing. Items of one text are searched once and each reported;
repeated rows are each reported. Of regions of one segment, the one with the fewest edits counts, then the first. An
empty benchmark leaves every document clean; an empty table gives an empty result. Extra columns pass through `clean`
and are left out of `contaminated`, whose item column gets a longer name if the key is called like it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import fresh, quoted, table

Q = 7
SEGMENT = 60
SHARE = 0.1
#: Items with fewer characters are looked for exactly, as whole words.
LEAST = 40
#: Characters of a block of the benchmark; its index takes some 20 bytes for each.
BLOCK_CHARS = 4_000_000
#: Characters that are searched at once: of a long text, or of several.
PIECE = 65_536
#: Regions that are verified together.
TOGETHER = 4096
_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_NO_WORD = re.compile(r"[\W_]+")


def reduced(text: str | None) -> str:
    return _NO_WORD.sub(" ", text).strip().lower() if text else ""


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


#: Characters below this are reduced by table; texts with others, or with one whose small form isn't one character
#: that is known without its neighbours, go through `reduced`.
_TABLED = 0x3000


@cache
def _small_forms() -> np.ndarray:
    """By code: the code of its small form, a space for what is no letter or digit, or `_TABLED` for none known."""
    chars = [chr(i) for i in range(_TABLED)]
    return np.array([32 if _NO_WORD.match(c) else ord(c.lower()) if len(c.lower()) == 1 and c != "\u03a3" else _TABLED for c in chars], np.uint32)


def reduced_codes(text: str | None) -> np.ndarray:
    """The codes of `reduced(text)`."""
    codes = codes_of(text or "")
    if len(codes) and int(codes.max()) < _TABLED:
        small = _small_forms()[codes]
        if int(small.max()) < _TABLED:
            kept = small != 32
            kept[1:] |= kept[:-1]
            small = small[kept]
            small = small[1:] if len(small) and small[0] == 32 else small
            return small[:-1] if len(small) and small[-1] == 32 else small
    return codes_of(reduced(text))


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(q):
            out *= _BASE
            out += codes[k : k + n]
        return out * _MULTIPLIER


@dataclass(frozen=True)
class Segments:
    """Texts of a block of items cut into segments, and where each q-gram occurs in the texts.

    Texts are numbered, first those that are cut into segments; segments are numbered in the order of their texts, and
    each text that is too short for one follows with a number of its own.
    """

    items: list[list]  # of each text
    text: np.ndarray  # of each segment
    begin: np.ndarray  # of each segment, in its text
    first: np.ndarray  # by text: the first segment, and those after the last
    joined: np.ndarray  # codes of all texts
    starts: np.ndarray  # of each text in `joined`
    grams: np.ndarray  # sorted and distinct
    gram_first: np.ndarray  # by gram: its first occurrence, and those after the last
    gram_text: np.ndarray
    gram_at: np.ndarray
    bits: np.ndarray
    share: float
    length: np.ndarray  # characters of a segment of each text
    most: np.ndarray  # edits of a segment of each text
    bounds: np.ndarray  # shared q-grams of a segment of each text, at least
    phrases: dict[int, dict[str, int]]  # short texts by number of words

    @classmethod
    def of(cls, items: list[tuple[object, str]], share: float = SHARE) -> Segments:
        by_text: dict[str, list] = {}
        for item, t in items:
            if t:
                by_text.setdefault(t, []).append(item)
        long, short = [t for t in by_text if len(t) >= LEAST], [t for t in by_text if len(t) < LEAST]
        owner, begin, first = [], [], [0]
        whole = [codes_of(t) for t in long]
        for n, c in enumerate(whole):
            last = max(len(c) - SEGMENT, 0)
            cuts = sorted({last, *(w for w in [0, *(np.flatnonzero(c == 32) + 1).tolist()] if w < last)})
            owner += [n] * len(cuts)
            begin += cuts
            first.append(len(owner))
        hashes = [gram_hashes(c) for c in whole]
        none = np.empty(0, np.uint64)
        occurrences = np.concatenate([none, *hashes])
        order = np.argsort(occurrences, kind="stable")
        grams, gram_first = np.unique(occurrences[order], return_index=True)
        bits = np.zeros(1 << _BITS, bool)
        bits[(grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        length = np.array([min(len(c), SEGMENT) for c in whole], np.int64)
        most = (length * share).astype(np.int64)
        phrases: dict[int, dict[str, int]] = {}
        for k, t in enumerate(short):
            phrases.setdefault(t.count(" ") + 1, {})[t] = len(owner) + k
        return cls(
            items=[by_text[t] for t in (*long, *short)],
            text=np.array(owner + list(range(len(long), len(long) + len(short))), np.int64),
            begin=np.array(begin, np.int64),
            first=np.array(first, np.int64),
            joined=np.concatenate([np.empty(0, np.uint32), *whole]).astype(np.uint32),
            starts=np.cumsum([0, *map(len, whole)]),
            grams=grams,
            gram_first=np.append(gram_first, len(occurrences)),
            gram_text=np.repeat(np.arange(len(whole), dtype=np.int32), [len(h) for h in hashes])[order],
            gram_at=np.concatenate([np.empty(0, np.int32), *(np.arange(len(h), dtype=np.int32) for h in hashes)])[order],
            bits=bits,
            share=share,
            length=length,
            most=most,
            bounds=np.maximum(1, length - Q + 1 - most * Q),
            phrases=phrases,
        )

    @property
    def codes(self) -> list[np.ndarray]:
        """The characters of each segment."""
        return [self.codes_of(s) for s in range(int(self.first[-1]))]

    def codes_of(self, segment: int) -> np.ndarray:
        at = int(self.starts[self.text[segment]] + self.begin[segment])
        return self.joined[at : at + int(self.length[self.text[segment]])]

    def edits(self, segment: int) -> int:
        return int(self.most[self.text[segment]])


def banded_alignment(segment: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """The fewest edits, `most` at most, that turn `segment` into a stretch of `text`, with its begin and end.

    Considers alignments in which character i of the segment meets characters i + low to i + high of the text.
    """
    m, n, width = len(segment), len(text), high - low + 1
    for d in range(max(low, 0), min(high, n - m) + 1):
        if np.array_equal(segment, text[d : d + m]):
            return 0, d, d + m
    beyond = most + 1
    # Row i, column d: text position i + low + d is the next to be read.
    row = [(0, low + d) if 0 <= low + d <= n else (beyond, 0) for d in range(width)]
    s, t = segment.tolist(), text.tolist()
    for i in range(m):
        new = []
        for d in range(width):
            at = i + low + d  # the character that would be matched
            best = (beyond, 0)
            if 0 <= at < n and row[d][0] <= most:
                best = (row[d][0] + (s[i] != t[at]), row[d][1])
            if d + 1 < width and row[d + 1][0] + 1 < best[0]:
                best = (row[d + 1][0] + 1, row[d + 1][1])  # the segment's character is missing in the text
            if d and 0 <= at < n + 1 and new[d - 1][0] + 1 < best[0] and at >= 1:
                best = (new[d - 1][0] + 1, new[d - 1][1])  # the text has a character more
            new.append(best)
        row = new
        if min(x[0] for x in row) > most:
            return None
    cost, begin, d = min((x[0], x[1], d) for d, x in enumerate(row))
    return (cost, begin, m + low + d) if cost <= most else None


def matches(text: str, segments: Segments) -> list[tuple[int, int, int, int]]:
    """Segment, begin, end and edits of every verified region of a reduced text, one for each segment: the best."""
    return matches_of([codes_of(text)], segments)[0]


def matches_of(texts: list[np.ndarray], segments: Segments) -> list[list[tuple[int, int, int, int]]]:
    """`matches` of each of many reduced texts, given as codes."""
    best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
    if len(segments.length):
        parts, size = [], 0
        for which, text in enumerate(texts):
            # Pieces overlap by the longest stretch, so each stretch lies whole in one.
            for at in range(0, len(text), PIECE):
                if size + min(PIECE, len(text) - at) > PIECE and parts:
                    _search(parts, texts, segments, best)
                    parts, size = [], 0
                parts.append((which, at, text[at : at + PIECE + 2 * SEGMENT]))
                size += len(parts[-1][2])
        if parts:
            _search(parts, texts, segments, best)
    found = [[(seg, begin, end, edits) for seg, (edits, begin, end) in sorted(own.items())] for own in best]
    if segments.phrases:
        found = [own + _exact(text.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), segments.phrases) for own, text in zip(found, texts, strict=True)]
    return found


def _search(parts: list[tuple[int, int, np.ndarray]], texts: list[np.ndarray], segments: Segments, best: list[dict[int, tuple[int, int, int]]]) -> None:
    """Adds the verified regions of the `parts` (number of the text, offset, codes) to the `best` of each text."""
    # No region reaches over a gap, and no q-gram with a gap in it occurs in an item.
    gap = np.full(SEGMENT + 4 * int(segments.most.max()) + 2, 2**32 - 1, np.uint32)
    joined = np.concatenate([gap, *(x for _, _, codes in parts for x in (codes, gap))])
    starts = np.cumsum([len(gap), *(len(codes) + len(gap) for _, _, codes in parts[:-1])])
    seg, low = _near(joined, segments)
    if not len(seg):
        return
    own = segments.text[seg]
    for m in np.unique(segments.length[own]).tolist():
        some = np.flatnonzero(segments.length[own] == m)
        k = int(segments.most[own[some[0]]])
        for at in range(0, len(some), TOGETHER):
            part = some[at : at + TOGETHER]
            costs = _costs(joined, low[part] - k, segments.joined, segments.starts[own[part]] + segments.begin[seg[part]], m, 4 * k + 2)
            for g in part[costs <= k].tolist():
                s, begin = int(seg[g]), int(low[g]) - k
                found = banded_alignment(segments.codes_of(s), joined[begin : begin + m + 4 * k + 1], 0, 4 * k + 1, k)
                # The middle of a region lies in every stretch that it can hold.
                unit = int(np.searchsorted(starts, begin + k + m // 2, "right")) - 1
                if found and unit >= 0:
                    which, offset, _ = parts[unit]
                    shift, end = begin - int(starts[unit]) + offset, len(texts[which])
                    found = (found[0], min(max(found[1] + shift, 0), end), min(found[2] + shift, end))
                    if s not in best[which] or found < best[which][s]:
                        best[which][s] = found


def _costs(joined: np.ndarray, low: np.ndarray, items: np.ndarray, at: np.ndarray, m: int, width: int) -> np.ndarray:
    """The fewest edits of each segment (`m` codes of `items` from `at`) against `width` diagonals of `joined` from `low`."""
    text = np.ascontiguousarray(joined[low[:, None] + np.arange(m + width - 1)].T)
    item = np.ascontiguousarray(items[at[:, None] + np.arange(m)].T)
    cost = np.zeros((width, len(low)), np.int8 if m + width < 120 else np.int32)
    for i in range(m):
        new = cost + (text[i : i + width] != item[i])
        np.minimum(new[:-1], cost[1:] + 1, out=new[:-1])
        # Characters that the text has more: the least of all diagonals before, by steps that double.
        step = 1
        while step < width:
            new[step:] = np.minimum(new[step:], new[:-step] + new.dtype.type(step))
            step *= 2
        cost = new
    return cost.min(axis=0)


def _exact(text: str, phrases: dict[int, dict[str, int]]) -> list[tuple[int, int, int, int]]:
    """The first place of every short text that the text holds as whole words."""
    if not text:
        return []
    words, at = text.split(" "), [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    found: dict[int, tuple[int, int, int, int]] = {}
    for n, known in phrases.items():
        for i in range(len(words) - n + 1):
            k = known.get(text[at[i] : at[i + n] - 1])
            if k is not None:
                found.setdefault(k, (k, at[i], at[i + n] - 1, 0))
    return sorted(found.values())


def _near(codes: np.ndarray, segments: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Segments with enough q-grams in two neighbouring bands of diagonals, and where on the lowest each would begin."""
    nothing = np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = gram_hashes(codes)
    hit = segments.bits[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)]
    # A stretch has at most `span` q-grams; only positions in a window with enough hits can be part of one.
    span = max(1, SEGMENT + int(segments.most.max()) - Q + 1)
    before = np.concatenate(([0], np.cumsum(hit, dtype=np.int32)))
    inner = len(hit) - span + 1
    if inner <= 0:
        return nothing
    full = before[span:] - before[:inner] >= int(segments.bounds.min())
    if not full.any():
        return nothing
    # A position is in a full window if one starts at it or up to span - 1 before; gaps lie at both ends.
    starts = np.concatenate((np.zeros(span, np.int32), np.cumsum(full, dtype=np.int32), np.full(span - 1, full.sum(), np.int32)))
    positions = np.flatnonzero(hit & (starts[span : span + len(hit)] > starts[: len(hit)]))
    gram = np.searchsorted(segments.grams, hashes[positions])
    known = np.flatnonzero(segments.grams[np.minimum(gram, len(segments.grams) - 1)] == hashes[positions])
    positions, gram = positions[known], gram[known]
    left, counts = segments.gram_first[gram], segments.gram_first[gram + 1] - segments.gram_first[gram]
    which = np.repeat(left - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    if not len(which):
        return nothing
    text, at = segments.gram_text[which].astype(np.int64), segments.gram_at[which]
    # Two bands of k + 1 diagonals each hold any k + 1 neighbours.
    band = (np.repeat(positions, counts) - at) // (segments.most[text] + 1)
    lowest, long = int(band.min()), int(np.diff(segments.starts).max()) + 1
    wide = int(band.max()) - lowest + 2
    packed = np.sort((text * wide + band - lowest) * long + at)
    name = packed // long
    cuts = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1], [True])))
    names, counts = name[cuts[:-1]], np.diff(cuts)
    both = counts.copy()
    both[:-1] += np.where(names[1:] == names[:-1] + 1, counts[1:], 0)
    # The least of two bands may be empty of hits itself, but then the one above counts alone.
    names = names[both >= segments.bounds[names // wide]]
    text, number = names // wide, segments.first[names // wide + 1] - segments.first[names // wide]
    seg = np.repeat(segments.first[text] - np.cumsum(number) + number, number) + np.arange(number.sum())
    names, text = np.repeat(names, number), np.repeat(text, number)
    lower = names * long + segments.begin[seg]
    upper = lower + segments.length[text] - Q
    within = lambda a, b: np.searchsorted(packed, b, "right") - np.searchsorted(packed, a, "left")
    enough = within(lower, upper) + within(lower + long, upper + long) >= segments.bounds[text]
    return seg[enough], ((names % wide + lowest) * (segments.most[text] + 1) + segments.begin[seg])[enough]


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of `BLOCK_CHARS` reduced characters, or of one item that has more."""
    held, size = [], 0
    for row in benchmark.select(quoted(item), quoted(text)).toLocalIterator():
        reduced_text = reduced(row[1])
        if held and size + len(reduced_text) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((row[0], reduced_text))
        size += len(reduced_text)
    if held:
        yield held


_held: dict[int, Segments] = {}


def _index(items: list[tuple[object, str]], share: float) -> Segments:
    """The index of a block, made once in a worker process; one is held at a time."""
    name = zlib.crc32(repr((items, share)).encode("utf-8", "surrogatepass"))
    if name not in _held:
        _held.clear()
        _held[name] = Segments.of(items, share)
    return _held[name]


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE, item: str = "item_id") -> DataFrame:
    """A row for each document and item of which it holds segments.

    `key`, `item`, `n_segments` (of the item, found), `text_begin` and `text_end` (in the reduced text, around all
    of them) and `edits` (of the best).
    """
    chosen = docs.select(quoted(key).alias(key), quoted(text).alias(fresh("_text", [key])))
    kind = benchmark.schema[item].dataType
    names = [key]
    for c in (item, "n_segments", "text_begin", "text_end", "edits"):
        names.append(fresh(c, names))
    types = [docs.schema[key].dataType.simpleString(), kind.simpleString(), *["bigint"] * 4]
    schema = ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in zip(names, types, strict=True))
    out = None
    for items in blocks(benchmark, item):
        part = chosen.mapInArrow(_reporter(items, share, names, to_arrow_type(kind)), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _reporter(items: list[tuple[object, str]], share: float, names: list[str], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = _index(items, share)
        for batch in (some for whole in batches for some in _slices(whole)):
            rows, values = [], []
            for i, found_in in enumerate(matches_of([reduced_codes(t.as_py()) for t in batch.column(1)], segments)):
                by_text: dict[int, list[tuple[int, int, int]]] = {}
                for seg, begin, end, edits in found_in:
                    by_text.setdefault(int(segments.text[seg]), []).append((begin, end, edits))
                for t, found in sorted(by_text.items()):
                    for item in segments.items[t]:
                        rows.append(i)
                        values.append((item, len(found), min(f[0] for f in found), max(f[1] for f in found), min(f[2] for f in found)))
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*values, strict=True), [kind, *[pa.int64()] * 4], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], names=names)

    return run


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, 500):
        yield batch.slice(at, 500)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", share: float = SHARE, item: str = "item_id") -> DataFrame:
    """The rows of `docs` that hold no segment of any item, and no short item."""
    at = docs.columns.index(text)
    for items in blocks(benchmark, item):

        def run(batches: Iterator[pa.RecordBatch], items: list[tuple[object, str]] = items) -> Iterator[pa.RecordBatch]:
            segments = _index(items, share)
            for batch in batches:
                for some in _slices(batch):
                    yield some.filter(pa.array([not m for m in matches_of([reduced_codes(t.as_py()) for t in some.column(at)], segments)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return contaminated(docs, table(spark, sf_dir, "benchmark")).withColumn("contaminated", F.lit(True))
