"""The registered queries of the text operators, and their oracles where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidegate.llm import (
    byte_bpe, collocate, convrepair, decontam, langid, licences, orderminhash, ordinal, piece_bpe, reshard, simhash, superkmer,
    tokencount,
)

MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), F.col("_component").alias("component_id")
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    return langid.identify(docs, model).select(
        F.col("_id").alias("doc_id"), langid.held_out(F.col("_id")).alias("held_out"), "lang_pred", "score"
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("_id").alias("doc_id"), F.col("_item").alias("item_id"), "n_item", "n_shared", "containment")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from the labels: 0 toxic, 1 of low quality, 2 good. A document is selected if it is likely
    to be good; `held_out` rows took no part in fitting."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    rated = labels.where(~langid.held_out(F.col("doc_id"))).select("doc_id", grade.alias("grade"))
    made = ordinal.grade(docs, ordinal.fit(docs, rated, "grade", 3))
    return made.select(
        F.col("_id").alias("doc_id"), langid.held_out(F.col("_id")).alias("held_out"), "expected_grade",
        F.get("tails", F.lit(0)).alias("p_not_toxic"), F.get("tails", F.lit(1)).alias("p_good"), (F.get("tails", F.lit(0)) < 0.5).alias("toxic"),
        (F.get("tails", F.lit(1)) >= 0.5).alias("selected"),
    )


def op5_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From six shards by a hash of the id to eight of equal bytes."""
    docs = _table(spark, sf_dir, "documents")
    docs = docs.withColumn("_old", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(6)).cast("int"))
    made = reshard.placement(docs, "_old", 8)
    return made.select(
        F.col("_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard", "block",
    )


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = licences.scan(_table(spark, sf_dir, "documents"))
    return made.select(F.col("_id").alias("doc_id"), *(c for c in made.columns if c not in ("_id", "expressions")))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = superkmer.remove_repeats(_table(spark, sf_dir, "documents"))
    return made.select(F.col("_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tokencount.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return made.withColumnRenamed("_id", "doc_id")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = piece_bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return made.withColumnRenamed("_id", "doc_id")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = orderminhash.neighbour_edits(_table(spark, sf_dir, "documents"))
    return made.select(
        F.col("_id").alias("doc_id"), "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        orderminhash.text_of(F.col("_sig")).alias("fingerprint"), orderminhash.text_of(F.col("_edited_sig")).alias("edited_fingerprint"),
        orderminhash.likeness(F.col("_sig"), F.col("_edited_sig")).alias("near_edited"),
        orderminhash.likeness(F.col("_sig"), F.col("_next_sig")).alias("near_next"),
    )


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.report(convrepair.repair(convrepair.damage(_table(spark, sf_dir, "conversations"))))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = byte_bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_MODEL))
    return made.withColumnRenamed("_id", "doc_id")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocate.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_language, op3_decontamination, op4_quality, op5_reshard, op6_licences, op7_substrings, op8_token_counts,
        op9_sentencepiece, op10_order_minhash, op11_conversations, op12_byte_bpe, op13_collocations,
    )
} | {"pipeline": corpus_pipeline.run}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op3_decontamination": """
        WITH item_words AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
        item AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s
                 FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM item_words)),
        total AS (SELECT item_id, count(*) AS n_item FROM item GROUP BY item_id),
        doc_words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
        doc AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s
                FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM doc_words)),
        shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc JOIN item USING (s) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
        FROM shared JOIN total USING (item_id) WHERE n_shared * 10 >= n_item * 8""",
    "op7_substrings": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS s
                FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d)),
        later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
        gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(i, i + 19)) AS p FROM later)),
        word AS (SELECT doc_id, unnest(w) AS t, unnest(generate_series(1, len(w))) AS p FROM d),
        kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS k, count(*) AS n
                 FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op13_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        piece AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
        run AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM piece),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM run GROUP BY lang),
        place AS (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM run, generate_series(1, 5) AS s(k)),
        gram AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, any_value(w[i:i + k - 1]) AS w, count(*) AS a
                 FROM place GROUP BY 1, 2 HAVING count(*) >= 100),
        cand AS (SELECT * FROM gram WHERE len(w) > 1),
        part AS (SELECT lang, a, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM cand, generate_series(2, 4) AS s(k) WHERE k < len(w)),
        most AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS most FROM part GROUP BY 1, 2),
        kept AS (SELECT cand.* FROM cand LEFT JOIN most USING (lang, phrase) WHERE most IS NULL OR most * 100 < a * 100),
        cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
                FROM kept, generate_series(1, 4) AS s(k) WHERE k < len(w)),
        scored AS (SELECT cut.lang, cut.phrase, cut.a, k, f.a AS l, g.a AS r, n,
                   CAST((1000::HUGEINT * cut.a * n) // (f.a::HUGEINT * g.a) AS BIGINT) AS score
                   FROM cut JOIN gram f ON f.lang = cut.lang AND f.phrase = x JOIN gram g ON g.lang = cut.lang AND g.phrase = y
                   JOIN total ON total.lang = cut.lang),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM best QUALIFY rank <= 2000""",
}
