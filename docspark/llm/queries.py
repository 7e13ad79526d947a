"""The operators as queries on the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import (
    decontamination,
    divergence,
    html_text,
    language,
    licences,
    mixing,
    passages,
    quality,
    resampling,
    simhash,
    tokens,
    vectors,
    wordpieces,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.token_counts(_table(spark, sf_dir, "documents"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files three folders deep: every tenth is a licence file, in one of these folders by its id."""
    is_licence = F.col("doc_id") % 10 == 0
    above = F.when(is_licence, F.expr("doc_id div 10 % 3")).otherwise(0)  # folders it stands above the others
    name = F.when(is_licence, F.lit("LICENSE")).otherwise(F.col("doc_id").cast("string"))
    thousands, hundreds = F.expr("doc_id div 1000").cast("string"), F.expr("doc_id div 100 % 10").cast("string")
    folders = [F.col("source"), F.when(above < 2, thousands), F.when(above < 1, hundreds)]
    files = _table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("/", *folders, F.concat_ws("-", name, F.col("doc_id"))).alias("path"), "text"
    )
    return licences.scan(files).drop("text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", fingerprint.alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontamination.leaks(docs, items)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).drop("html")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenized(_table(spark, sf_dir, "documents").select("doc_id", "text"))


MIX_WEIGHTS = {
    "domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 2},
    "source": {"src0": 2},
}


def mix_levels() -> dict:
    """Sources are grouped to four domains by their number."""
    number = F.regexp_extract(F.col("source"), "[0-9]+", 0).try_cast("int")
    domain = F.concat(F.lit("domain"), (number % 4).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mixing.select(docs, mix_levels(), MIX_WEIGHTS, F.expr("total * 4 div 5")).drop("text")


def _share_sql(name: str, nodes: str, by: str, child: str, weight: str, given: str) -> str:
    """One level of the budget tree, as mixing.share_out() does it."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
    {name}_w AS (SELECT *, {weight} AS weight FROM ({nodes})),
    {name}_b AS (
        SELECT *, coalesce(sum(capacity) OVER ({part} ORDER BY capacity / weight, {child}
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
               sum(weight) OVER ({part} ORDER BY capacity / weight, {child}
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_
        FROM {name}_w),
    {name}_f AS (SELECT *, {given} - before_ AS left_,
        capacity::HUGEINT * weights_ <= weight::HUGEINT * greatest({given} - before_, 0) AS full_ FROM {name}_b),
    {name}_r AS (SELECT *, max(CASE WHEN NOT full_ THEN weights_ END) OVER ({part}) AS rw,
        max(CASE WHEN NOT full_ THEN greatest(left_, 0) END) OVER ({part}) AS rr,
        sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER ({part} ORDER BY capacity / weight, {child}
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM {name}_f),
    {name} AS (SELECT * EXCLUDE (before_, weights_, left_, full_, rw, rr, upto),
        CASE WHEN full_ THEN capacity ELSE (rr * upto) // rw - (rr * (upto - weight)) // rw END AS budget FROM {name}_r)"""


def _weight_sql(level: str) -> str:
    cases = " ".join(f"WHEN '{n}' THEN {w}" for n, w in MIX_WEIGHTS[level].items())
    return f"CASE {level} {cases} ELSE 1 END"


MIX_SQL = f"""
WITH sized AS (
    SELECT doc_id, lang, source,
           'domain' || (regexp_extract(source, '[0-9]+')::INT % 4)::VARCHAR AS domain,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
    FROM documents),
docs AS (SELECT * FROM sized WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM docs GROUP BY ALL),
total AS (SELECT sum(tokens) * 4 // 5 AS given FROM leaf),
{_share_sql("a", "SELECT domain, sum(tokens) AS tokens, sum(tokens) * 3 AS capacity, any_value(given) AS given FROM leaf, total GROUP BY domain", "", "domain", _weight_sql("domain"), "given")},
{_share_sql("b", "SELECT leaf.domain, lang, sum(leaf.tokens) AS tokens, sum(leaf.tokens) * 3 AS capacity, any_value(a.budget) AS given FROM leaf JOIN a ON leaf.domain = a.domain GROUP BY ALL", "domain", "lang", _weight_sql("lang"), "given")},
{_share_sql("c", "SELECT leaf.domain, leaf.lang, source, leaf.tokens AS tokens, leaf.tokens * 3 AS capacity, b.budget AS given FROM leaf JOIN b ON leaf.domain = b.domain AND leaf.lang = b.lang", "domain, lang", "source", _weight_sql("source"), "given")},
keyed AS (
    SELECT docs.*, budget // tokens AS full_epochs, budget % tokens AS rest,
           md5('{mixing.SEED}:' || (budget // tokens + 1)::VARCHAR || ':' || doc_id::VARCHAR) AS k
    FROM docs JOIN c USING (domain, lang, source)),
placed AS (
    SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) - n_tokens < rest AS extra FROM keyed)
SELECT doc_id, lang, source, unnest(range(1, (full_epochs + extra::INT + 1)::BIGINT))::INT AS epoch, n_tokens FROM placed
"""


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_passages": op1_passages,
    "op2_quality": op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_licences": op4_licences,
    "op5_simhash": op5_simhash,
    "op6_decontamination": op6_decontamination,
    "op7_html_text": op7_html_text,
    "op8_language": op8_language,
    "op9_tokens": op9_tokens,
    "op10_mixing": op10_mixing,
    "op11_divergence": op11_divergence,
    "op12_resampling": op12_resampling,
    "op13_vectors": op13_vectors,
}

ORACLE = {
    "op2_quality": quality.SQL,
    "op10_mixing": MIX_SQL,
    "op11_divergence": divergence.SQL,
    "op12_resampling": resampling.SQL,
    "op13_vectors": vectors.SQL,
}
