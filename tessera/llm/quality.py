"""Weakly supervised document quality: rules vote or abstain, EM learns how far to trust each.

Every rule reads a few counts of a text and votes *good*, *bad* or abstains. The corpus is reduced to the
number of documents per vote pattern (at most ``3 ** len(RULES)`` rows, whatever the corpus size); an
expectation-maximisation over these counts estimates the share of good documents and, for every rule, how often
it is right on good and on bad documents. A document's posterior probability of being good then replaces
"all rules must pass". All per-row work is built-in Spark expressions; nothing shuffles but the pattern counts.

Defined results: a null text counts as empty. A very long text is read whole; one of over a million words compares its
windows as strings from the start. Ties: equal patterns are one row of the fit, and even odds are kept. An empty text has zero counts, every rule abstains on it and its
posterior is the estimated share of good documents; it fails the base test, so it is not kept. An empty table
gives an empty result. Repeated rows are judged alike, each on its own. Null ids and extra columns pass through;
columns of the result that clash with columns of the input are replaced by the result's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, fresh, quoted, settled, table, words

#: Positions that fit beside a hash in one sortable long.
_POSITION_BITS = 20


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_unique_words")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(2)


def rules() -> dict[str, Column]:
    """Name to vote (0 bad, 1 good, 2 abstains) over the counts of `features`."""
    some = F.col("n_words") > 0
    per = lambda top, percent: F.col(top) * 100 > F.col("n_words") * percent
    return {
        "symbols": _vote(some & per("n_symbols", 10), some & ~per("n_symbols", 3)),
        "repeats": _vote(some & per("n_repeat_words", 25), some & ~per("n_repeat_words", 8)),
        "dup_lines": _vote(F.col("n_dup_lines") * 2 > F.col("n_lines"), (F.col("n_lines") > 2) & (F.col("n_dup_lines") * 20 <= F.col("n_lines"))),
        "word_length": _vote(some & (per("word_chars", 720) | ~per("word_chars", 280)), some & per("word_chars", 350) & ~per("word_chars", 680)),
        "capitals": _vote(some & (F.col("n_upper") * 10 > F.col("n_letters") * 3), (F.col("n_letters") > 0) & (F.col("n_upper") * 10 <= F.col("n_letters"))),
        "letters": _vote(some & (F.col("n_letters") * 100 < F.col("word_chars") * 88), some & (F.col("n_letters") * 100 >= F.col("word_chars") * 92)),
        "variety": _vote((F.col("n_words") >= 50) & ~per("n_unique_words", 15), (F.col("n_words") >= 50) & per("n_unique_words", 30)),
    }


RESULT = {*COUNTS, *(f"vote_{k}" for k in ("symbols", "repeats", "dup_lines", "word_length", "capitals", "letters", "variety")), "quality", "base_failed", "kept"}


def _repeat_words(w: Column, n: Column, hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Equal hashes only nominate windows: a text without two equal hashes has no repeated window, and the windows
    nominated in other texts are compared as strings.
    """
    window = lambda i: F.array(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    high = lambda x: F.shiftright(x, _POSITION_BITS)
    packed = F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(high(h), _POSITION_BITS).bitwiseOR(i.cast("long"))))

    def paired(a: Column, same) -> Column:
        beside = lambda x, i: F.coalesce(same(x, F.get(a, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(a, i - 1)), F.lit(False))
        return F.filter(a, beside)

    # Sorted once as an array held by a lambda variable, for `paired` reads it by index.
    held = lambda a, f: F.get(F.transform(F.array(a), f), F.lit(0))
    position = F.lit((1 << _POSITION_BITS) - 1).cast("long")
    nominated = F.when(n > F.lit(1 << _POSITION_BITS), F.sequence(F.lit(0), n - 3)).otherwise(
        held(packed, lambda a: F.transform(paired(a, lambda x, y: high(x) == high(y)), lambda x: x.bitwiseAND(position).cast("int")))
    )
    exact = F.sort_array(F.transform(nominated, lambda i: F.struct(window(i).alias("w"), i.alias("i"))))
    repeated = held(exact, lambda a: F.transform(paired(a, lambda x, y: x["w"] == y["w"]), lambda x: x["i"]))
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda i: F.array(i, i + 1, i + 2))))
    return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), 0).otherwise(F.size(covered))


def features(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `df` (all, if None) and the counts the rules read."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in RESULT]
    t, w, h, n, ls = (fresh(x, [*df.columns, *RESULT]) for x in ("_text", "_words", "_hashes", "_n", "_lines"))
    carried = [quoted(c) for c in keep]
    out = df.select(*carried, F.coalesce(quoted(text), F.lit("")).alias(t))
    out = out.select(*carried, t, words(F.col(t)).alias(w))
    out = out.select(*carried, t, w, F.size(w).alias(n))
    grams = F.when(F.col(n) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.col(n) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    )
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    out = out.select(*carried, t, w, n, F.coalesce(grams, F.array().cast("array<bigint>")).alias(h), lines.alias(ls))
    count = lambda pattern: F.length(F.regexp_replace(F.col(t), pattern, ""))
    counts = {
        "n_words": F.col(n),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": count(r"[^#*$%&|<>]+"),
        "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
        "n_repeat_words": _repeat_words(F.col(w), F.col(n), F.col(h)),
        "n_lines": F.size(ls),
        "n_letters": count(r"[^\p{L}]+"),
        "n_upper": count(r"[^\p{Lu}]+"),
        "n_unique_words": F.size(F.array_distinct(w)),
    }
    # A generator keeps later filters above the counts; pushed below, they would compute them many times over.
    return out.select(*carried, F.inline(F.array(F.struct(*(v.cast("long").alias(k) for k, v in counts.items())))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


@dataclass(frozen=True)
class VoteModel:
    """The share of good documents and, by rule, how often its votes are right on good and on bad documents."""

    prior: float
    accuracy: dict[str, tuple[float, float]]

    def posterior(self) -> Column:
        """The probability that a document is good, over columns `vote_<rule>`."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, (good, bad) in self.accuracy.items():
            v = F.col(f"vote_{name}")
            odds = odds + F.when(v == 1, math.log(good / (1 - bad))).when(v == 0, math.log((1 - good) / bad)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def em(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 200, tolerance: float = 1e-9) -> VoteModel:
    """Fits a `VoteModel` to numbers of documents by vote pattern.

    Starts from rules that are right four times in five and ends when no parameter moves by `tolerance`. Each
    estimate is smoothed by two right votes and one wrong one, so no rule is ever believed without limit and none
    that the data say nothing about counts against its own meaning.
    """
    prior, acc = 0.5, {j: (0.8, 0.8) for j in range(len(names))}
    patterns = sorted(patterns)
    for _ in range(rounds if patterns else 0):
        good_all = total = 0.0
        sums = {j: [2.0, 3.0, 2.0, 3.0] for j in acc}  # right and all on good, right and all on bad
        for votes, n in patterns:
            odds = math.log(prior / (1 - prior))
            for j, v in enumerate(votes):
                good, bad = acc[j]
                odds += math.log(good / (1 - bad)) if v == 1 else math.log((1 - good) / bad) if v == 0 else 0.0
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            good_all, total = good_all + n * p, total + n
            for j, v in enumerate(votes):
                if v != 2:
                    s = sums[j]
                    s[0] += n * p * (v == 1)
                    s[1] += n * p
                    s[2] += n * (1 - p) * (v == 0)
                    s[3] += n * (1 - p)
        new = {j: (s[0] / s[1], s[2] / s[3]) for j, s in sums.items()}
        new_prior = (good_all + 1) / (total + 2)
        moved = max([abs(new_prior - prior), *(abs(a - b) for j in acc for a, b in zip(acc[j], new[j], strict=True))])
        prior, acc = new_prior, new
        if moved < tolerance:
            break
    return VoteModel(prior, {name: acc[j] for j, name in enumerate(names)})


def votes(counts: DataFrame) -> DataFrame:
    return counts.select("*", *(v.alias(f"vote_{k}") for k, v in rules().items()))


def fit(voted: DataFrame) -> VoteModel:
    """The model of a corpus with columns `vote_<rule>`. Collects at most ``3 ** len(rules)`` rows."""
    names = list(rules())
    rows = voted.groupBy(*(f"vote_{k}" for k in names)).count().collect()
    return em([(tuple(r[:-1]), r[-1]) for r in rows], names)


def judged(voted: DataFrame, model: VoteModel) -> DataFrame:
    p = model.posterior()
    return voted.select("*", p.alias("quality"), base_failed().alias("base_failed"), (~base_failed() & (p >= 0.5)).alias("kept"))


def assess(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`features` of `df`, the votes, the posterior `quality`, `base_failed` and `kept`.

    The counts are computed once and settled in the shared folder (numbers only, no texts unless `keep` has them).
    """
    voted = settled(votes(features(df, text, keep)))
    return judged(voted, fit(voted))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `df` that are kept, with the columns of `df` alone.

    Two passes over the texts, one to fit and one to apply, so that no text is stored or shuffled.
    """
    taken = fresh("_text", df.columns)
    model = fit(votes(features(df, text, keep=[])))
    row = fresh("_row", [taken, *df.columns])
    packed = df.select(F.struct(*(quoted(c) for c in df.columns)).alias(row), quoted(text).alias(taken))
    return judged(votes(features(packed, taken, keep=[row])), model).filter("kept").select(F.col(f"{row}.*"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assess(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
