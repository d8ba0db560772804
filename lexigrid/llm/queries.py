"""Thin queries over the operators of this package, one for each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, spread, table
from . import bpe, mixing, quality, secrets, sharding, simhash, tokencount, topk, toxicity, urlfilter
from .common import word_count

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of all documents; dealt over the cores where the file has few parts."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", word_count("text").alias("size"))
    found = mixing.mix(materialize(docs, "mix-sizes"), size="size")
    return found.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir, "doc_id", "text"))
    counts = [F.expr(f"CAST(size(filter(base, m -> m.kind = {i})) AS BIGINT)").alias(f"n_{k}") for i, k in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = bpe.encode_decode(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(documents(spark, sf_dir, "doc_id", "text"), model)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = tokencount.count_tokens(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("*", (F.col("n_tokens") > 2048).alias("over_limit"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(documents(spark, sf_dir, "doc_id", "text"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_HASH = "CAST(('0x' || substr(md5({}), 1, 15)) AS BIGINT)"

OP1 = rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
hashed AS (SELECT *, {_HASH.format("'mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size")} AS h FROM docs),
summed AS (SELECT source, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS words FROM hashed GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM summed),
weighed AS (SELECT *, [5, 2, 1][s % 3 + 1] AS weight, 2.0::DOUBLE * words AS cap, 1.5::DOUBLE * CAST(sum(words) OVER () AS BIGINT) AS everything FROM numbered),
levels AS (
  SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY cap / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(weight) OVER (ORDER BY cap / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM weighed),
aimed AS (SELECT *, least(cap, weight * coalesce(max(CASE WHEN level <= cap / weight THEN level END) OVER (), 'infinity'::DOUBLE)) AS target FROM levels),
sharded AS (
  SELECT *, CAST(CASE WHEN ceil(n_rows / 256) <= 1 THEN 1 ELSE pow(2, length(bin(CAST(ceil(n_rows / 256) AS BIGINT) - 1))) END AS BIGINT) AS shards,
    CAST(floor(sum(target) OVER () / 16 + 0.5) AS BIGINT) AS seats FROM aimed),
source_tries AS (
  SELECT s, seats, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, s, k) AS place
  FROM (SELECT s, seats, target, unnest(range(0, seats + 1)) AS k FROM sharded WHERE target > 0)),
source_blocks AS (SELECT s, count(*) AS blocks FROM source_tries WHERE place <= seats GROUP BY s),
placed AS (SELECT doc_id, h, size, d.source, a.s, words, target, h % shards AS shard FROM hashed d JOIN sharded a ON d.source IS NOT DISTINCT FROM a.source),
by_shard AS (
  SELECT s, shard, CAST(sum(size) AS BIGINT) AS n, any_value(blocks) AS blocks, CAST(floor(any_value(target) + 0.5) AS BIGINT) AS due
  FROM placed LEFT JOIN source_blocks USING (s) GROUP BY s, shard),
shard_tries AS (
  SELECT s, shard, blocks, row_number() OVER (PARTITION BY s ORDER BY n / (2 * k + 1) DESC, shard, k) AS place
  FROM (SELECT s, shard, n, blocks, unnest(range(0, blocks + 1)) AS k FROM by_shard WHERE n > 0)),
dealt AS (
  SELECT s, shard, n, due, coalesce(blocks, 0) AS blocks, coalesce(won, 0) AS won, CAST(ceil(n / 16) AS BIGINT) AS m, {_HASH.format("'mix-1:' || s || ':' || shard")} AS draw
  FROM by_shard LEFT JOIN (SELECT s, shard, count(*) AS won FROM shard_tries WHERE place <= blocks GROUP BY s, shard) USING (s, shard) WHERE n > 0),
quotas AS (
  SELECT *, draw % m AS c, [1000000007, 1500000001, 1900000043, 2147483647][draw % 4 + 1] AS p, least(2 * n, greatest(0, 16 * won
    + CASE WHEN row_number() OVER (PARTITION BY s ORDER BY won DESC, shard) = 1 THEN due - 16 * blocks ELSE 0 END)) AS quota FROM dealt),
lined AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY s, shard ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS o FROM placed),
drawn AS (
  SELECT l.*, q.m, q.c, q.p, q.quota // q.n AS base, q.quota % q.n AS extra, ((q.m - 1) * q.p + q.c) % q.m AS last, q.m * 16 - q.n AS lacks
  FROM lined l LEFT JOIN quotas q USING (s, shard)),
runs AS (
  SELECT *, CASE WHEN size = 0 THEN [] ELSE list_transform(range(o // 16, (o + size - 1) // 16 + 1), lambda j: {{'low': greatest(j * 16, o), 'high': least((j + 1) * 16, o + size),
    'upto': j * 16 + greatest(0, least(16, extra - 16 * ((j * p + c) % m) + CASE WHEN last < (j * p + c) % m THEN lacks ELSE 0 END))}}) END AS blocks FROM drawn)
SELECT doc_id, size, words AS source_size, target, CASE WHEN size = 0 THEN 0 ELSE
  CAST(size * base + list_sum(list_transform(blocks, lambda x: greatest(0, least(x.upto, x.high) - x.low))) AS BIGINT) END AS taken
FROM runs
"""


def _located(kind: int, pattern: str) -> str:
    """SQL list of (start, kind, stop, whole match, group 1) of a pattern's matches."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""list_transform(range(1, len(regexp_extract_all(t, {p}, 0)) + 1), lambda i: {{
      'start': coalesce(CAST(list_sum(list_transform(regexp_split_to_array(t, {p})[1:i], lambda g: length(g))) AS BIGINT), 0)
        + coalesce(CAST(list_sum(list_transform(regexp_extract_all(t, {p}, 0)[1:i - 1], lambda g: length(g))) AS BIGINT), 0),
      'kind': {kind}, 'whole': regexp_extract_all(t, {p}, 0)[i], 'value': regexp_extract_all(t, {p}, 1)[i]}})"""


def _op2() -> str:
    names = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    joined = f"array_to_string(list_transform({{}}, lambda m: {names}[m.kind + 1] || ':' || m.start || ':' || m.stop), ',')"
    full = "list_transform({}, lambda m: {{'start': m.start, 'kind': m.kind, 'stop': m.start + length(m.whole), 'whole': m.whole}})"
    allow = " OR ".join("regexp_matches(m.whole, '" + p.replace("'", "''").replace("++", "+") + "')" for p in secrets.ALLOW)
    held = f"'[{secrets.PART}]*(?i:{secrets.PLACEHOLDERS})[{secrets.PART}]*'"
    bits = " ".join(f"WHEN regexp_matches(m.whole, '{p}') THEN {b}" for _, p, b in secrets.CLASSES[:-1])
    window = """list_max(list_transform(range(1, length(m.whole) - 18), lambda i: list_sum(list_transform(list_distinct(string_split(substr(m.whole, i, 20), '')),
      lambda ch: -(20 - length(replace(substr(m.whole, i, 20), ch, ''))) / 20 * log2((20 - length(replace(substr(m.whole, i, 20), ch, ''))) / 20)))))"""
    token = f"([{secrets.TOKEN}]+)"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id, t AS whole_text, {full.format('list_filter(' + _located(0, secrets.ASSIGN) + ', lambda m: length(m.value) >= 6)')} AS a,
    {full.format('list_filter(' + _located(1, secrets.ACCESS) + ', lambda m: length(m.whole) >= 20)')} AS b,
    {full.format(_located(2, secrets.HEX))} AS h
  FROM texts),
based AS (
  SELECT *, list_sort(list_transform(a || b || h, lambda m: {{'start': m.start, 'kind': m.kind, 'stop': m.stop}})) AS base FROM found),
lettered AS (SELECT *, CASE WHEN len(base) = 0 THEN [] ELSE regexp_extract_all(whole_text, '(?s).') END AS letters FROM based),
masked AS (
  SELECT *, CASE WHEN len(base) = 0 THEN whole_text ELSE array_to_string(list_transform(range(1, len(letters) + 1),
    lambda i: CASE WHEN len(list_filter(base, lambda x: x.start < i AND i <= x.stop)) > 0 THEN ' ' ELSE letters[i] END), '') END AS free FROM lettered),
parted AS (SELECT *, regexp_split_to_array(free, {held}) AS gaps, regexp_extract_all(free, {held}) AS helds FROM masked),
blank AS (
  SELECT *, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || CASE WHEN i <= len(helds) THEN repeat(' ', length(helds[i])) ELSE '' END), '') AS t FROM parted),
tried AS (
  SELECT *, CASE WHEN regexp_matches(t, '[{secrets.TOKEN}]{{20,}}') THEN {full.format('list_filter(' + _located(3, token) + ", lambda m: length(m.whole) >= 20 AND regexp_matches(m.whole, '[0-9]'))")} ELSE [] END AS c
  FROM blank),
added AS (
  SELECT *, list_transform(list_filter(c, lambda m: NOT ({allow})
    AND {window} >= CASE {bits} ELSE {secrets.CLASSES[-1][2]} END), lambda m: {{'start': m.start, 'kind': m.kind, 'stop': m.stop}}) AS more FROM tried)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_assign, CAST(len(b) AS BIGINT) AS n_access, CAST(len(h) AS BIGINT) AS n_hex,
  sha256({joined.format('base')}) AS base_sha256, {joined.format('list_sort(base || more)')} AS spans FROM added
"""


OP5 = r"""
WITH parts AS (
  SELECT page_id,
    translate(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

OP10 = """
WITH ints AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.r AS query, q.vec_id AS query_id, c.r, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND c.r <> q.r AND len(q.v) = len(c.v)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST, r) AS INTEGER) AS rank, vec_id, score FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1, "op2_secret_scan": _op2(), "op5_url_filter": OP5, "op10_top_k": OP10}
