"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workers_import
from . import chat_repair, exact_dedup, hard_negatives, mixing, ngram_join, packing, pairwise, quality, sharding, suffix_dedup, token_store, toxicity, whitening


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return workers_import(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer(), width=2048, end_id=1, added=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = token_store.write(docs, tokenizer(), end_id=2, added=True)
    found = token_store.locate(spark, store, docs, "doc_id")
    return found.join(token_store.read_digests(spark, store), ["part", "block", "offset"]).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), limit=1 << 20)


OP4_SQL = r"""
WITH a AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
  array_to_string(list_transform(string_split(substr(md5(doc_id::VARCHAR), 1, 15), ''), lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), '') AS bits FROM documents),
s AS (SELECT d::INT AS depth, substr(bits, 1, d::INT) AS shard, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM a, range(0, 41) t(d) GROUP BY ALL),
f AS (SELECT * FROM s WHERE shard_bytes <= 1048576 OR shard_docs = 1)
SELECT doc_id, bytes AS doc_bytes, shard, depth, shard_bytes, shard_docs FROM a JOIN f ON substr(bits, 1, depth) = shard
QUALIFY depth = min(depth) OVER (PARTITION BY doc_id)
"""


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, substr(md5(doc_id::VARCHAR), 1, 7) AS place FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM t),
r AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - (coalesce(sum(source_size) OVER b, 0) * 2)::DOUBLE) / (sum(weight) OVER a)::DOUBLE AS rate FROM w
  WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         a AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT *, max(CASE WHEN rate * weight <= source_size * 2 THEN rate END) OVER () AS level FROM r),
g AS (SELECT source, source_size, CASE WHEN level IS NULL OR source_size * 2 < level * weight THEN (source_size * 2)::DOUBLE ELSE level * weight END AS target FROM l),
h AS (SELECT *, floor(target)::BIGINT AS need, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM g),
k AS (SELECT least(1024, greatest(16, sum(need)::BIGINT // 262144)) AS block FROM h),
p AS (SELECT doc_id, size, source_size, target, need, sid,
  coalesce(sum(size) OVER (PARTITION BY sid ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
n AS (SELECT sum(ceil(need / block))::BIGINT AS slots FROM h, k WHERE need > 0),
b AS (SELECT sid, ceil(need / block)::BIGINT AS blocks, ((upto - need)::BIGINT / share::BIGINT) * 1836311903 AS lo, (upto::BIGINT / share::BIGINT) * 1836311903 AS hi
  FROM (SELECT sid, need, sum(need) OVER (ORDER BY sid) AS upto, sum(need) OVER () AS share FROM h WHERE need > 0), k),
u AS (SELECT i AS slot, ((i % 1836311903) * 1134903170) % 1836311903 AS u FROM (SELECT unnest(range(slots)) AS i FROM n)),
v AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank, blocks FROM u JOIN b ON u >= lo AND u < hi),
y AS (SELECT slot, sid, rank FROM v WHERE rank < blocks
  UNION ALL SELECT slots, sid, unnest(range(have, blocks)) FROM (SELECT b.sid, b.blocks, count(slot) AS have FROM b LEFT JOIN v USING (sid) GROUP BY ALL), n WHERE have < blocks),
e AS (SELECT doc_id, sid, unnest(range(lo // block, (hi - 1) // block + 1)) AS rank
  FROM (SELECT doc_id, sid, pos + t * source_size AS lo, least(pos + t * source_size + size, need) AS hi FROM p, range(2) r(t) WHERE size > 0 AND pos + t * source_size < need), k),
z AS (SELECT doc_id, min(slot) AS first_slot, max(slot) AS last_slot FROM e JOIN y USING (sid, rank) GROUP BY doc_id)
SELECT p.doc_id, size, source_size, target,
  (greatest(0, least(pos + size, need) - pos) + greatest(0, least(pos + source_size + size, need) - pos - source_size))::BIGINT AS taken, first_slot, last_slot
FROM p LEFT JOIN z ON p.doc_id = z.doc_id
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
WINDOW g AS (PARTITION BY h)
"""


def op9_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(table(spark, sf_dir, "conversations"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)
    return out.withColumn("deviation", F.col("deviation").cast("long"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.build(table(spark, sf_dir, "embeddings"), label=label), spark)


OP12_SQL = r"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other))::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""


def op13_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op4_shard": OP4_SQL, "op5_mix": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op12_hard_negatives": OP12_SQL}
