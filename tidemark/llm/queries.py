"""The queries opN_<name> over the whole tables, and their DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, html_text, lm, minhash, mixing, quality, sharding, simhash, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents; nulls, empties and repeats as mixing.account() says."""
    return mixing.account(_table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renders every page; a null or empty page gives an empty text."""
    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document with a classifier fitted on at most quality.PER_CLASS labelled documents of each class; an empty table gives an empty result."""
    return quality.account(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links all documents at 85 percent of shared shingles; nulls, empties and repeats as minhash.classes() says."""
    return minhash.classes(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints every document and its edited text; nulls and repeats as simhash.account() says."""
    return simhash.account(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents; nulls and repeats as exact_dedup.annotate() says."""
    return exact_dedup.annotate(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards by the law of rows; nulls and repeats as sharding.account() says."""
    return sharding.account(_table(spark, sf_dir, "documents"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; nulls, empties and repeats as lm.account() says."""
    return lm.account(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document with the public 50k byte-level vocabulary; a null text is empty."""
    return bpe.account(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page's url; labels of the same id are the pages' outcomes: low quality is bad. Nulls and repeats as url_filter.judge() says."""
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_filter.judge(_table(spark, sf_dir, "pages"), outcomes).withColumn("reputation", F.round("reputation", 9))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def _strength(name: str, level: str) -> str:
    return f"""{name} AS (SELECT CASE WHEN m > 1 AND p * (1 - p) > 0 AND (bb - n * p * p - (m - 1) * p * (1 - p)) / (n - nn / n) > 0
  THEN least(greatest((1 - (bb - n * p * p - (m - 1) * p * (1 - p)) / (n - nn / n) / (p * (1 - p))) / ((bb - n * p * p - (m - 1) * p * (1 - p)) / (n - nn / n) / (p * (1 - p))), {url_filter.WEAKEST}), {url_filter.STRONGEST}) ELSE {url_filter.STRONGEST} END AS k
  FROM (SELECT CAST(sum(n) AS DOUBLE) AS n, sum(bad) / CAST(sum(n) AS DOUBLE) AS p, count(*) AS m, CAST(sum(n * n) AS DOUBLE) AS nn, sum(bad * bad / CAST(n AS DOUBLE)) AS bb FROM {level}))"""


_RULES = sorted(url_filter.RULES, key=lambda r: (-len(r[1]), r[1]))


def _case(said: int) -> str:
    fits = [f"WHEN (host = '{r[1][: r[1].index('/')]}' OR ends_with(host, '.{r[1][: r[1].index('/')]}')) AND starts_with(path, '{r[1][r[1].index('/') :]}') THEN '{r[said]}'" for r in _RULES]
    return "CASE " + " ".join(fits) + " END"


_TWO = "array_to_string(string_split(host, '.')[-2:], '.')"
_IN_TABLE = f"{_TWO} IN ({', '.join(repr(x) for x in url_filter.TWO_LABEL_SUFFIXES)})"
_DOMAIN = f"CASE WHEN {_IN_TABLE} THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE {_TWO} END"
_SUFFIX = f"CASE WHEN {_IN_TABLE} THEN {_TWO} ELSE string_split(host, '.')[-1] END"

OP10_SQL = rf"""
WITH parsed AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hosts AS (SELECT host, count(*) AS n, sum(1 - quality) AS bad, {_DOMAIN} AS domain, {_SUFFIX} AS suffix
  FROM parsed JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL GROUP BY host),
domains AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM domains GROUP BY suffix),
{_strength("ks", "suffixes")}, {_strength("kd", "domains")}, {_strength("kh", "hosts")},
top AS (SELECT (sum(bad) + 0.5) / CAST(sum(n) + 1 AS DOUBLE) AS rate FROM suffixes),
by_suffix AS (SELECT suffix, (bad + k * rate) / (n + k) AS rate FROM suffixes, ks, top),
by_domain AS (SELECT domain, (bad + k * rate) / (n + k) AS rate FROM domains JOIN by_suffix USING (suffix), kd),
by_host AS (SELECT host, n + k + 1 AS size, (bad + k * rate) / (n + k) AS mean FROM hosts JOIN by_domain USING (domain), kh),
known AS (SELECT host, mean - {url_filter.Z} * sqrt(mean * (1 - mean) / size) AS reputation FROM by_host)
SELECT page_id, host, path, {_case(1)} AS rule, coalesce({_case(0)}, CASE WHEN reputation > {url_filter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, round(reputation, 9) AS reputation
FROM parsed LEFT JOIN known USING (host)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_html, op3_quality, op4_minhash, op5_simhash, op6_exact_dedup, op7_sharding, op8_lm, op9_bpe, op10_url_filter)}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op10_url_filter": OP10_SQL}
