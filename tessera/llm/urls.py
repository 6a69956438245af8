"""URL filtering: rules first, then words in the host and path judged by naive Bayes.

Rules name a host (with all its subdomains) and a beginning of the path; the longest that fits decides. Where none
fits, every run of letters in host and path is split into words by a unigram Viterbi, so that names written together
come apart, and a multinomial naive Bayes over the words decides.

Both models are learned from the table at hand:

* The unigrams are the words of all pages' texts with their counts, over the whole table (`unigrams`). The model
  holds the `VOCABULARY` most frequent; a name that is none of them is a word of unknown probability, of any length.
* The classifier is fitted to labelled addresses: those that a rule decides, of which `MAX_EXAMPLES` are taken by the
  hash of the address (`rule_labels`), and the fixed ones in `examples`, so that it carries the rules' judgement over
  to the words of other hosts. `fit` takes any labelled sample instead, such as one made by hand.

Words that the sample doesn't have carry no evidence; without evidence the share of unwanted addresses in the sample
decides. Numbers are no words.

Defined results: a null url, and one without ``://``, has an empty host and path, and no words; no rule fits the empty
host. Very long addresses are split whole. Repeated rows are judged alike; an empty table gives an empty result; extra
columns pass through `judged`, where a column of the input called like one of the result is replaced. Ties between
splits go to the one with fewer words, then to the longer last word; between rules of one length, to the lesser name.
Even odds are allowed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, quoted, settled, table

#: Labelled addresses that a classifier is fitted to, at most, and words that the unigram model holds.
MAX_EXAMPLES = 20_000
VOCABULARY = 50_000
#: Splits and scores that a worker remembers.
REMEMBERED = 100_000

# Words of addresses that are unwanted, and words of ordinary ones.
UNWANTED = "adult ads banner bets bet betting bonus buy cam cams cash casino cheap cialis click clicks clickbait crack credit dating deals debt discount drugs escort fake farm free gambling hack hot jackpot keygen lender link loan loans lottery malware meds miracle money nude payday pharmacy phishing pills poker popup porn promo replica rich scam seo sex sexy slots spam spy steroids torrent track tracker tracking traffic trick viagra viral warez weight win winner xxx".split()
ORDINARY = "academy archive art article astronomy atlas biology blog book books bridge camera chemistry city code college company cooking culture daily data design docs education energy family forest forum garden geography green guide health help history home journal kitchen language law learn letters library local magazine mail maps market math medicine museum music nature network news ocean office open paper people photo physics planet press project recipes research river school science shop society software sport sports state stories street studio study support sun team technology theatre times tools travel university village water weather wiki wild wind women work world".split()
_RUN = re.compile(r"[^\W\d_]+")


def examples() -> list[tuple[str, bool]]:
    """Labelled addresses (True: unwanted) made of the fixed words: pairs with a hyphen and single words."""
    out = []
    for words, label in ((UNWANTED, True), (ORDINARY, False)):
        for i, a in enumerate(words):
            b = words[(i * 7 + 3) % len(words)]
            out += [(f"http://{a}-{b}/{i}", label), (f"https://{a}/{b}", label)]
    return out


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark, hash or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class RuleIndex:
    """Rules by host, then by length of the path: a lookup for each ending of a host, however many rules there are."""

    def __init__(self, rules: Iterable[Rule]):
        self.by_host: dict[str, dict[int, dict[str, Rule]]] = {}
        for r in rules:
            self.by_host.setdefault(r.host, {}).setdefault(len(r.path), {}).setdefault(r.path, r)

    def longest(self, host: str, path: str) -> Rule | None:
        best, ending = None, host
        while ending:
            paths = self.by_host.get(ending, {})
            for n in sorted(paths, reverse=True):
                found = paths[n].get(path[:n]) if n <= len(path) else None
                if found:
                    best = min(best or found, found, key=lambda r: (-len(r.name), r.name))
                    break
            ending = ending.partition(".")[2]
        return best


@dataclass
class UrlModel:
    """Unigram costs for splitting and word counts of unwanted and ordinary addresses for judging."""

    costs: dict[str, float]  # by word: minus the logarithm of its probability
    unknown: float  # cost of a word that is none of these, to which a factor of ten for each letter comes
    unwanted: dict[str, int] = field(default_factory=dict)
    ordinary: dict[str, int] = field(default_factory=dict)
    prior: float = 0.5

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.costs), default=0)
        size = len(self.unwanted.keys() | self.ordinary.keys())
        bad, good = sum(self.unwanted.values()) + size, sum(self.ordinary.values()) + size
        self.evidence = {w: math.log((self.unwanted.get(w, 0) + 1) / bad) - math.log((self.ordinary.get(w, 0) + 1) / good) for w in self.unwanted.keys() | self.ordinary.keys()}

    def cost(self, word: str) -> float:
        """What a word costs in a split; the least cost of all words of a run is taken."""
        return min(self.costs.get(word, math.inf), self.unknown + len(word) * math.log(10))

    def segment(self, name: str) -> list[str]:
        """The likeliest split of a run of letters."""
        each = math.log(10)
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        # The least of all ways to begin an unknown word, with the letters before it taken off.
        begun = (0.0, 0, 0)
        for end in range(1, len(name) + 1):
            found = (begun[0] + self.unknown + end * each, begun[1] + 1, begun[2])
            for begin in range(max(0, end - self.longest), end):
                known = self.costs.get(name[begin:end])
                if known is not None:
                    found = min(found, (best[begin][0] + known, best[begin][1] + 1, begin))
            best.append(found)
            begun = min(begun, (found[0] - end * each, found[1], end))
        out, end = [], len(name)
        while end:
            begin = best[end][2]
            out.append(name[begin:end])
            end = begin
        return out[::-1]

    def words(self, host: str, path: str, known: dict[str, list[str]] | None = None) -> list[str]:
        """The words of an address; `known` remembers splits."""
        known = {} if known is None else known
        out = []
        for run in _RUN.findall(f"{host} {path}".lower()):
            if run not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[run] = self.segment(run)
            out += known[run]
        return out

    def score(self, host: str, path: str, known: dict[str, list[str]] | None = None) -> tuple[float, int]:
        """Log odds that an address is unwanted, and the number of its words that say anything about it."""
        found = [self.evidence[w] for w in self.words(host, path, known) if w in self.evidence]
        return math.log(self.prior / (1 - self.prior)) + sum(found), len(found)


def unigrams(pages: DataFrame, html: str = "html", size: int = VOCABULARY) -> dict[str, int]:
    """The `size` most frequent words of all texts, outside tags and in small letters, with their counts; ties by word."""
    text = F.lower(F.regexp_replace(F.coalesce(quoted(html), F.lit("")), "<[^<>]*>", " "))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).filter("word != ''")
    counts = settled(words.groupBy("word").agg(F.count("*").alias("n")))
    # Of counts of one size (an eighth of a doubling), all or none are sorted, so that no task sends words that can't be
    # among the most frequent. There are some hundred sizes.
    of = F.floor(F.log2("n") * 8)
    least = held = 0
    for r in counts.groupBy(of.alias("of")).agg(F.count("*").alias("words")).orderBy(F.desc("of")).collect():
        least, held = r["of"], held + r["words"]
        if held >= size:
            break
    # Settled first: a plan that ends in a limit would send as many rows from each task to the driver.
    most = settled(counts.filter(of >= least).orderBy(F.desc("n"), "word").limit(size), 1)
    return {r["word"]: r["n"] for r in most.collect()}


def fit(sample: Iterable[tuple[str, bool]], counts: dict[str, int] | None = None, limit: int = MAX_EXAMPLES + 1000) -> UrlModel:
    """The model of a labelled sample of addresses, of which `limit` at most are allowed, over the unigram `counts`.

    The fixed words count as often as the word in the middle of `counts`, if they aren't more frequent there.
    """
    counts = dict(counts or {})
    middle = sorted(counts.values())[len(counts) // 2] if counts else 1
    for w in (*UNWANTED, *ORDINARY):
        counts[w] = max(counts.get(w, 0), middle)
    total = sum(counts.values())
    costs = {w: -math.log(n / total) for w, n in counts.items()}
    splitter = UrlModel(costs, -math.log(10 / (10 * total)))
    seen, rows, known = {True: Counter(), False: Counter()}, Counter(), {}
    for i, (url, label) in enumerate(sample):
        if i >= limit:
            raise ValueError(f"the sample has more than {limit} rows")
        host, path = address(url)
        rows[bool(label)] += 1
        seen[bool(label)].update(splitter.words(host, path, known))
    return UrlModel(costs, splitter.unknown, dict(seen[True]), dict(seen[False]), (rows[True] + 1) / (rows.total() + 2))


def address(url: str | None) -> tuple[str, str]:
    """Host and path of one url, as `host_of` and `path_of` have them."""
    rest = (url or "").partition("://")[2]
    cut = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = cut.partition("/")
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path


def judged(df: DataFrame, model: UrlModel | None = None, rules: Iterable[Rule] = RULES, url: str = "url") -> DataFrame:
    """`df` with `host`, `path`, `rule`, `verdict`, `score` (log odds of being unwanted) and `n_evidence` (words that say
    anything); the last two are null where a rule decides. Without a `model`, one of the fixed examples alone is used.
    """
    model, index = model or fit(examples()), RuleIndex(rules)
    result = ["host", "path", "rule", "verdict", "score", "n_evidence"]
    keep = [c for c in df.columns if c.lower() not in result]
    source = fresh("_url", [*keep, *result])
    chosen = df.select(*(quoted(c) for c in keep), quoted(url).alias(source))
    cut = chosen.select(*(quoted(c) for c in keep), host_of(F.col(source)).alias("host"), path_of(F.col(source)).alias("path"))
    schema = cut.select("*", *(F.lit(None).cast(t).alias(c) for c, t in zip(result[2:], ("string", "string", "double", "int"), strict=True))).schema
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits: dict[str, list[str]] = {}
        for batch in batches:
            rows = []
            for host, path in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                if rule := index.longest(host, path):
                    rows.append((rule.name, rule.verdict, None, None))
                else:
                    score, evidence = model.score(host, path, splits)
                    rows.append((None, "block" if score > 0 else "allow", score, evidence))
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*keep, *result])

    return cut.mapInArrow(run, schema)


def rule_labels(df: DataFrame, rules: Iterable[Rule] = RULES, url: str = "url", limit: int = MAX_EXAMPLES) -> list[tuple[str, bool]]:
    """Addresses that a rule decides, with whether it blocks them: `limit` at most, those with the least hashes."""
    own = judged(df.select(quoted(url).alias("address"), quoted(url).alias("source")), UrlModel({}, 0.0), rules, "source").filter("rule IS NOT NULL")
    own = own.select("address", "verdict", F.xxhash64("address").alias("hash"))
    share = 2 * limit / max(1, own.count())
    if share < 1:
        # Twice as many as are wanted are below this hash, but for a chance that is tested.
        some = own.filter(F.col("hash") < int(-(2**63) + share * 2**64))
        own = some if some.count() >= limit else own
    rows = settled(own.orderBy("hash", "address").limit(limit), 1).orderBy("hash", "address").collect()
    return [(r["address"], r["verdict"] == "block") for r in rows]


def learned(pages: DataFrame, rules: Iterable[Rule] = RULES, url: str = "url", html: str = "html") -> UrlModel:
    """The model of a table of pages: its words, and addresses that its rules decide beside the fixed ones."""
    return fit([*rule_labels(pages, rules, url), *examples()], unigrams(pages, html))


def op3_url_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judged(pages.select("page_id", "url"), learned(pages)).select("page_id", "host", "path", "rule", "verdict", "n_evidence")
