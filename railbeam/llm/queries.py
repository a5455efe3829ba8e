"""The registered queries of the text operators, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbeam.llm import byte_cnn, ctw, decontam, langid, line_blocks, mixing, packing, quality_rules, rans, resampling, secret_scan, simhash, vector_codes
from railbeam.llm.common import fold_of, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)
    return found.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id", F.col("copies").alias("copies"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_copies=3)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    rans.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return rans.read_digests(spark, path)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extract(_table(spark, sf_dir, "pages"))


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    net = byte_cnn.fit(docs, labels, fold_of(F.col("own"), 3) != 1)
    return byte_cnn.scored(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ctw.score(_table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold_of(F.col("doc_id"), 4) != 2, "doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    return langid.languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.encode(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    rows = vector_codes.label_errors(codes.rows)
    return rows.select("vec_id", "code", "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = resampling.resample(docs, target, percent=5, least_words=20, seed=42)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_token_files": op3_token_files,
    "op4_quality_rules": op4_quality_rules,
    "op5_line_blocks": op5_line_blocks,
    "op6_byte_cnn": op6_byte_cnn,
    "op7_secret_scan": op7_secret_scan,
    "op8_context_tree": op8_context_tree,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_packing": op11_packing,
    "op12_vector_codes": op12_vector_codes,
    "op13_resampling": op13_resampling,
}


def _vector_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """Every part against every entry, in each round."""
    distance = "list_sum([(a.x[i] - c.x[i]) * (a.x[i] - c.x[i]) for i in range(1, len(a.x) + 1)])"
    nearest = f"SELECT a.vec_id, a.p, a.x, min(struct_pack(d := {distance}, e := c.e)) AS best FROM cut a JOIN books{{r}} c ON a.p = c.p GROUP BY ALL"
    steps = [
        f"""kept AS (SELECT vec_id, label, [CAST(floor({scale} * CAST(y AS DOUBLE)) AS BIGINT) for y in embedding] AS v FROM embeddings
             WHERE len(embedding) > 0 AND len([y for y in embedding if y IS NULL OR NOT isfinite(y)]) = 0)""",
        f"""cut AS (SELECT vec_id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) AS _(p))""",
        f"books0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM cut QUALIFY e < {entries})",
    ]
    for r in range(rounds):
        steps += [
            f"near{r} AS ({nearest.format(r=r)})",
            f"""means{r} AS (SELECT p, best.e AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m
                FROM near{r}, range(1, (SELECT max(len(x)) FROM cut) + 1) AS _(i) GROUP BY ALL)""",
            f"""books{r + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM books{r} b
                LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS x FROM means{r} GROUP BY ALL) m ON b.p = m.p AND b.e = m.e)""",
        ]
    steps += [
        f"last AS ({nearest.format(r=rounds)})",
        "rows AS (SELECT vec_id, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM last GROUP BY vec_id)",
        f"said AS (SELECT sha256(string_agg(CAST(x[i] AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM books{rounds}, range(1, len(x) + 1) AS _(i))",
    ]
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM rows JOIN kept USING (vec_id), said"""


def _quality_rules_sql() -> str:
    """Windows as rows instead of sorted hashes; the thresholds are written out, apart from the operator's table."""
    stop_words = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
    return rf"""WITH texts AS MATERIALIZED (
          SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
            [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
          FROM documents),
        windows AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest([w[j] || ' ' || w[j + 1] || ' ' || w[j + 2] for j in range(1, len(w) - 1)]) AS win FROM texts),
        twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
        covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) AS _(k) GROUP BY r),
        counts AS (
          SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
            CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
            CAST(len(regexp_extract_all(text, '!')) AS BIGINT) AS n_shouts,
            len(list_intersect(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), [{stop_words}])) AS n_stop_words,
            len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
            CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
          FROM texts LEFT JOIN covered USING (r)),
        judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS whole FROM counts)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT base_failed AND word_chars / whole BETWEEN 3 AND 10 AND n_symbols / whole <= 0.1 AND n_shouts / whole <= 0.3
            AND n_stop_words >= 2 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_repeat_words / whole <= 0.5 AS kept
        FROM judged"""


#: The others have no SQL form: trained models, tokenizers, iterations, or searches that SQL can't end in time.
ORACLES: dict[str, str] = {"op4_quality_rules": _quality_rules_sql(), "op12_vector_codes": _vector_codes_sql()}
