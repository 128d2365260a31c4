"""One query for each operator of this subpackage, over its whole table, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lacuna.llm.conversation_repair import repair_digest
from lacuna.llm.conversation_sql import REPAIR, TRIE
from lacuna.llm.exact_topk import neighbour_digest
from lacuna.llm.language_evidence import identified
from lacuna.llm.minhash_dedup import near_duplicates
from lacuna.llm.mixing import mix_digest
from lacuna.llm.packing import packed
from lacuna.llm.page_crf import extracted
from lacuna.llm.prefix_trie import trie_digest
from lacuna.llm.pseudonyms import pii_report
from lacuna.llm.quality_rules import MEASURES, RULES, STOP_WORDS, rule_digest
from lacuna.llm.quality_trees import score_digest
from lacuna.llm.sharding import shard_digest
from lacuna.llm.suffix_dedup import suffix_digest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(_table(spark, sf_dir, "pages"))


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(_table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_digest(_table(spark, sf_dir, "embeddings"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_digest(_table(spark, sf_dir, "documents"))


def op8_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(_table(spark, sf_dir, "documents"))


def op9_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op10_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_earley_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(_table(spark, sf_dir, "conversations"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digest(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_digest(_table(spark, sf_dir, "conversations"))


QUERIES = {
    q.__name__: q
    for q in (op1_html_crf, op2_pareto_mix, op3_best_fit_packing, op4_minhash_dedup, op5_pseudonyms, op6_exact_topk, op7_quality_rules, op8_stratified_shards, op9_language_evidence, op10_quality_trees, op11_earley_repair, op12_suffix_dedup, op13_prefix_trie)
}

_SQL_MIX = r"""with w as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size, ('0x' || substr(md5('mix-1|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE u from documents),
s as (select source, sum(size)::BIGINT source_size from w group by 1),
r as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 weight, source_size * 3 cap from s),
f as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::BIGINT rest, (sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following))::BIGINT of_ from r),
l as (select rest level_rest, of_ level_of from f where rest * weight <= cap * of_ order by cap / weight, rest, of_ limit 1),
t as (select source, source_size, least(cap::DOUBLE, (level_rest * weight)::DOUBLE / level_of::DOUBLE) target from f, l),
o as (select w.*, case when size >= 500 then 4.0 when size >= 50 then 2.0 else 1.0 end::DOUBLE odds from w),
g as (select source, odds, sum(size)::DOUBLE words from o group by 1, 2),
h as (select g.source, odds, (target - 3 * coalesce(sum(words) over (partition by g.source order by odds desc rows between unbounded preceding and 1 preceding), 0)) / nullif(sum(odds * words) over (partition by g.source order by odds desc rows between current row and unbounded following), 0) as level from g join t on t.source is not distinct from g.source),
v as (select source, coalesce(arg_max(level, odds) filter (level * odds <= 3), case when max(level) > 0 then 'inf'::DOUBLE end, 0) as level from h group by 1),
x as (select o.*, source_size, target, least(level * odds, 3.0::DOUBLE) times from o join t on t.source is not distinct from o.source join v on v.source is not distinct from o.source),
y as (select *, floor(times)::BIGINT whole, times - floor(times) p from x),
z as (select *, case when p > 0 then (u * (1 - p)) / (u * (1 - p) + p * (1 - u)) else u end rank_odds, sum(whole * size) over (partition by source) certain from y),
b as (select *, coalesce(sum(case when p > 0 then size else 0 end) over (partition by source order by rank_odds, doc_id rows between unbounded preceding and 1 preceding), 0) before from z),
c as (select *, whole + case when p > 0 and before + size / 2 <= target - certain then 1 else 0 end copies from b)
select doc_id, size, source_size, target, (copies * size)::BIGINT taken, odds, copies::BIGINT copies from c"""

_SQL_TOP = """with v as (select vec_id id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) v from embeddings where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.id query_id, q.v own, c.id vec_id, list_dot_product(q.v, c.v)::BIGINT score from (select distinct id, v from v) q join v c on q.id % 50 = 0 and c.id <> q.id and len(c.v) = len(q.v)),
r as (select *, row_number() over (partition by query_id, own order by score desc, vec_id)::INT k from p)
select query_id, k as rank, vec_id, score from r where k <= 5"""

_SQL_RULES = (
    r"""with d as (select doc_id, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') plain from d),
u as (select doc_id, i, w[i] a, w[i + 1] b, w[i + 2] c from (select doc_id, w, unnest(range(1, len(w) - 1)) i from w)),
rep as (select doc_id, count(distinct j) n from (select doc_id, unnest([i, i + 1, i + 2]) j from (select *, count(*) over (partition by doc_id, a, b, c) k from u) where k > 1) group by 1),
m as (select w.doc_id, len(w)::BIGINT n_words, length(plain)::BIGINT word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, len(l)::BIGINT n_lines, (len(l) - len(list_distinct(l)))::BIGINT n_dup_lines, coalesce(rep.n, 0)::BIGINT n_repeat_words,
  len(list_filter(w, lambda x: regexp_matches(lower(x), '^(?:"""
    + "|".join(STOP_WORDS)
    + r""")(?:[.,;:]|$)')))::BIGINT n_stop_words, length(regexp_replace(t, '[^!?]', '', 'g'))::BIGINT n_shouts, length(regexp_replace(plain, '[^0-9.,;:!?_=+/\\()\[\]{}''"@~^`#*$%&|<>-]', '', 'g'))::BIGINT n_other_chars from w left join rep using (doc_id)),
j as (select *, list_filter(["""
    + ", ".join(f"case when not ({MEASURES[m].replace('try_divide(', 'div0(').replace('0D', '0').replace('cast(n_words as double)', 'n_words')} {keeps} {bound}) then '{name}' end" for name, m, keeps, bound in RULES)
    + r"""], lambda x: x is not null) failed, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and len(failed) = 0 kept, coalesce(array_to_string(failed, ','), '') failed from j"""
)
_SQL_RULES = re.sub(r"div0\((\w+), (\w+)\)", r"(\1 / nullif(\2, 0))", _SQL_RULES)

#: The other operators have no SQL form (trained models, searches that depend on order, keyed hashes, CRC-32); tests/llm has their
#: brute-force versions.
ORACLE_SQL: dict[str, str] = {"op2_pareto_mix": _SQL_MIX, "op6_exact_topk": _SQL_TOP, "op7_quality_rules": _SQL_RULES, "op11_earley_repair": REPAIR, "op13_prefix_trie": TRIE}
