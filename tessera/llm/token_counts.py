"""Numbers of unigram tokens by a Viterbi that keeps no tokens.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each character. The dynamic programme
carries, for each position, the best score of a segmentation that ends there and its number of tokens, nothing else.
Pieces that end at one position are tried from the earliest beginning on and only a strictly better score replaces
the best so far, which is the tie rule of the tokenizers library. A character without a piece of its own costs the
least score of the vocabulary less ten, and counts as its bytes where the vocabulary has byte pieces, else a run of
such characters counts as one.

Spaces are written as the word mark and a text is cut before each mark, as that library's Metaspace does, so each
distinct word is counted once and remembered (`REMEMBERED` words since the memory last turned, and those before).

Defined results: a null text counts as empty and has no tokens. Very long texts are counted whole, with one score and
count held for each character of a word. Ties go as said above. Repeated rows count alike. An empty table gives an
empty result; extra columns are left out of `counted`, whatever they are called, and a key called like the result gives
that a longer name.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import SentencePieceProcessor

from tessera.llm.common import fresh, quoted, table

REMEMBERED = 300_000
MARK = "▁"
#: What an unknown character costs beside the worst piece.
UNKNOWN = 10.0


def pieces_of(path: str) -> list[tuple[str, float]]:
    """Pieces and scores as a sentencepiece file states them, in the order of their ids."""
    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts the tokens of texts under a unigram vocabulary, of which one piece stands for the unknown."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN
        have = {p for p, _ in pieces}
        self.byte_fallback = byte_fallback and all(f"<0x{b:02X}>" in have for b in range(256))
        self.now: dict[str, int] = {}
        self.past: dict[str, int] = {}

    def word(self, word: str) -> int:
        """The number of tokens of a string without spaces."""
        n = len(word)
        best: list[float] = [0.0] * (n + 1)
        tokens = [0] * (n + 1)
        open_run = [False] * (n + 1)  # whether the best segmentation ends in an unknown character
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(word):
            ends[end].append(found)
        for end in range(n):
            score, count, run = None, 0, False
            single = False
            for length, piece in ends[end]:  # the longest, so the earliest beginning, comes first
                option = best[end + 1 - length] + piece
                single |= length == 1
                if score is None or option > score:
                    score, count, run = option, tokens[end + 1 - length] + 1, False
            if not single:
                option = best[end] + self.unknown
                if score is None or option > score:
                    size = len(word[end].encode("utf-8", "surrogatepass")) if self.byte_fallback else int(not open_run[end])
                    score, count, run = option, tokens[end] + size, True
            best[end + 1], tokens[end + 1], open_run[end + 1] = score, count, run
        return tokens[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.now) > REMEMBERED:
            self.past, self.now = self.now, {}
        marked = text.replace(" ", MARK)
        first, *rest = marked.split(MARK)
        words = [MARK + first, *[MARK + w for w in rest]] if first else [MARK + w for w in rest]
        now, total = self.now, 0
        for w in words:
            n = now.get(w)
            if n is None:
                n = self.past.get(w)
                if n is None:
                    n = self.word(w)
                if len(w) <= 64:
                    now[w] = n
            total += n
        return total


_counters: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """The counter of this worker process, which its tasks share."""
    if path not in _counters:
        _counters[path] = Counter(pieces_of(path))
    return _counters[path]


def counted(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `n_tokens` of every row."""
    kind, name = df.schema[key].dataType.simpleString(), fresh("n_tokens", [key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            n = pa.array([counter.text(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=[key, name])

    return df.select(quoted(key).alias(key), quoted(text).alias(fresh("_text", [key]))).mapInArrow(run, f"`{key}` {kind}, {name} bigint")


def op5_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
