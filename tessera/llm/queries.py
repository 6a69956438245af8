"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import quality, urls
from tessera.llm.bpe import op6_pair_index_bpe
from tessera.llm.common import table
from tessera.llm.decontam import op7_qgram_decontamination
from tessera.llm.html_text import op4_composite_density
from tessera.llm.pii import op8_feistel_pii
from tessera.llm.quality import op1_quality_rules
from tessera.llm.sharding import op2_slot_sharding
from tessera.llm.simhash import op9_simhash_vptree
from tessera.llm.token_counts import op5_viterbi_counts
from tessera.llm.token_files import op10_token_files
from tessera.llm.urls import op3_url_bayes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_slot_sharding": op2_slot_sharding,
    "op3_url_bayes": op3_url_bayes,
    "op4_composite_density": op4_composite_density,
    "op5_viterbi_counts": op5_viterbi_counts,
    "op6_pair_index_bpe": op6_pair_index_bpe,
    "op7_qgram_decontamination": op7_qgram_decontamination,
    "op8_feistel_pii": op8_feistel_pii,
    "op9_simhash_vptree": op9_simhash_vptree,
    "op10_token_files": op10_token_files,
}



def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of `op1_quality_rules` and whether the base fails: what SQL can say of it."""
    counts = quality.features(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("base_failed"))


def slot_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of `op2_slot_sharding`, and whether every shard's places are gapless and no shard is over its share by a tenth."""
    out = op2_slot_sharding(spark, sf_dir)
    shards = out.groupBy("shard").agg(F.sum("size").alias("bytes"), ((F.min("slot") == 0) & (F.max("slot") == F.count("*") - 1) & (F.countDistinct("slot") == F.count("*"))).alias("gapless"))
    total = out.agg(F.sum("size").alias("total"))
    shards = shards.join(F.broadcast(total)).select("shard", "gapless", (F.col("bytes") * 24 * 10 < F.col("total") * 11).alias("near_equal"))  # a single row
    return out.join(shards, "shard").select("doc_id", "size", "law", "gapless", "near_equal")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of `op3_url_bayes`, and the verdict where a rule gives it."""
    out = urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), urls.fit(urls.examples()))
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


QUERIES |= {"quality_base_counts": quality_base_counts, "slot_sizes": slot_sizes, "url_rules": url_rules}

_WORD = r"[^\x20\x09-\x0D]+"
_RULES_SQL = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in urls.RULES)
ORACLES: dict[str, str] = {
    "quality_base_counts": f"""with t as (select row_number() over () r, doc_id, coalesce(text, '') x from documents),
w as (select r, doc_id, x, regexp_extract_all(x, '{_WORD}') w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) l from t),
g as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] gram from (select r, w, unnest(range(1, len(w) - 1)) i from w)),
d as (select r, count(distinct p) n from (select r, unnest([i, i + 1, i + 2]) p from (select r, i, count(*) over (partition by r, gram) c from g) where c > 1) group by r)
select doc_id, len(w) n_words, cast(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) as bigint) word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines,
coalesce(d.n, 0) n_repeat_words, len(w) < 50 or 100 * coalesce(d.n, 0) > 50 * len(w) base_failed from w left join d on d.r = w.r""",
    "slot_sizes": "select doc_id, cast(strlen(coalesce(text, '')) + 8 as bigint) size, 'bytes' law, true gapless, true near_equal from documents",
    "url_rules": f"""with u as (select page_id, row_number() over () r, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
c as (select page_id, r, regexp_extract(rest, '(?s)^[^/?#]*') host_, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) path from u),
h as (select page_id, r, translate(host_, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, path from c),
f as (select h.r, max_by(x.a || x.b, length(x.a || x.b)) rule, max_by(x.v, length(x.a || x.b)) v from h join (values {_RULES_SQL}) x(a, b, v) on (h.host = x.a or ends_with(h.host, '.' || x.a)) and starts_with(h.path, x.b) group by h.r)
select page_id, host, path, rule, v rule_verdict from h left join f on f.r = h.r""",
}
