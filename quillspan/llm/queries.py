"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, jaccard, linededup, neighbours, packing, quality, secretscan, sharding, suffixes
from .store import table, written

SHARDS = 16


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = secretscan.count
    return secretscan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", c("base", 0).alias("n_assign"), c("base", 1).alias("n_access"), c("base", 2).alias("n_hex"),
        F.sha2(secretscan.named("base"), 256).alias("base_sha256"), secretscan.named("spans").alias("spans"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_recurring(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = quality.scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(quality.fold() == quality.HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


#: The conversation that op7 adds: both rows hold the template's own control strings.
CONTROL = "\\### Assistant: </turn> ok"


def op7_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    turned, tokenizer = written(chat.turns(rows)), tokenizer_path("byte_bpe_50k.json")
    return chat.read_back(turned, written(chat.tree(turned, tokenizer)), tokenizer)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(neighbours.usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))
    return neighbours.search(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_packing, op3_secrets, op4_line_dedup, op5_quality, op6_jaccard_join, op7_chat_tree, op8_sharding, op9_neighbours, op10_suffix_dedup)}

_WORDS = r"list_filter(regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda t: t <> '')"
ORACLES: dict[str, str] = {
    "op1_decontamination": f"""WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format('text')} AS w FROM benchmark), d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
bi AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0), bw AS (SELECT DISTINCT item, n, array_to_string(w[i + 1:i + n], ' ') AS g FROM bi), ns AS (SELECT DISTINCT n FROM bw),
di AS (SELECT r, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS i FROM d, ns), dw AS (SELECT r, n, i, array_to_string(w[i + 1:i + n], ' ') AS g FROM di), h AS (SELECT * FROM dw SEMI JOIN bw USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r), own AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM h JOIN bw USING (n, g) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)""",
}
