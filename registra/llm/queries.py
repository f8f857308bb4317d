"""One thin query per operator over its whole table, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registra.llm import decontaminate, language_model, merkle, mixing, prefix_trie, quality_model, quality_rules, secrets, sharding, simhash, substring, token_counts, token_file
from registra.llm.quality_rules import STOP_WORDS
from registra.operators.held import held

TOKEN_LIMIT = 1024
QUALITY_SCORE = 0.7
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(language_model.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(~held_out)
    scored = quality_model.scores(docs, quality_model.fit(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_SCORE).cast("int").alias("predicted"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("base")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secrets.scan(_documents(spark, sf_dir)).select(
        "row.doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(language_model.fold(F.col("doc_id"), 7) == 2, F.lit(False))
    model = language_model.fit(docs.filter(~held_out))
    return language_model.scores(docs, model).withColumn("held_out", held_out)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_documents(spark, sf_dir))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("row.doc_id", *[f"counts.{c}" for c in base], "base_failed", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    counts = token_counts.token_counts(_documents(spark, sf_dir), path, TOKEN_LIMIT)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The text itself is not carried: its size, checksum and hash are enough.
    rows = sharding.prepared(_documents(spark, sf_dir)).withColumn("doc_id", F.col("row.doc_id")).drop("row")
    return sharding.assign_shards(rows).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = held(simhash.fingerprints(_documents(spark, sf_dir), F.col("doc_id"), F.col("text")), "prints")
    found = prints.join(simhash.near_duplicates(prints), "bits")
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removals(_documents(spark, sf_dir))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "row.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = held(mixing.measured(docs).select(F.col("row.doc_id").alias("doc_id"), "source", "size", "place"), "measured")
    mixed = mixing.mix(rows, mixing.plan_mixture(rows))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op11_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"), merkle.tampered_text())


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_model": op1_quality_model,
    "op2_secrets": op2_secrets,
    "op3_language_model": op3_language_model,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_counts": op5_token_counts,
    "op6_sharding": op6_sharding,
    "op7_simhash": op7_simhash,
    "op8_substring": op8_substring,
    "op9_decontaminate": op9_decontaminate,
    "op10_mixing": op10_mixing,
    "op11_token_file": op11_token_file,
    "op12_merkle": op12_merkle,
    "op13_prefix_trie": op13_prefix_trie,
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP4 = f"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS body, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS seen
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
covered AS (
  SELECT r, count(DISTINCT i + d) AS n
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, seen) AS c FROM windows), (SELECT unnest([0, 1, 2]) AS d)
  WHERE c > 1 GROUP BY r),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         len(ls) AS n_lines, len(regexp_replace(body, '[^!]', '', 'g')) AS bangs, len(regexp_replace(body, '[^A-Z]', '', 'g')) AS capitals,
         len(list_filter(w, lambda x: list_contains([{", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}], lower(x)))) AS stops,
         len(list_filter(ls, lambda x: regexp_matches(x, '^ *([-*•]|[0-9]+[.)])\\s'))) AS listed,
         len(list_filter(ls, lambda x: ends_with(rtrim(x), '...') OR ends_with(rtrim(x), '…'))) AS dots
  FROM split LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2.0 * n_words AND 15.0 * n_words AND n_symbols <= 0.25 * n_words
  AND bangs <= 0.35 * n_words AND capitals <= 0.40 * word_chars AND stops >= 0.02 * n_words
  AND n_dup_lines <= 0.40 * n_lines AND listed <= 0.90 * n_lines AND dots <= 0.30 * n_lines AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
"""

_OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS seen FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY seen) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, list(DISTINCT k) AS ks FROM (SELECT r, unnest(range(i, i + 35)) AS k FROM again) GROUP BY r),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
gone AS (SELECT r, unnest(ks) AS k FROM covered),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN covered USING (r) LEFT JOIN kept USING (r)
"""

# Only A-Z are lower-cased by the operator; lower() would change other letters too.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"list_filter(regexp_split_to_array({_LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ALNUM} AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM phrases),
windows AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT r, i, size, item_id FROM windows JOIN phrases USING (size, phrase)),
hit AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + size)) AS k FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

_OP10 = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS place
  FROM documents),
weighed AS (
  SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap,
         sum(source_size) OVER () AS total
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
levels AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST)),
targets AS (
  SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), weight * water), CAST(cap AS DOUBLE)) AS target
  FROM (SELECT *, max(CASE WHEN level <= CAST(cap AS DOUBLE) / weight THEN level END) OVER () AS water FROM levels)),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
running AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.whole, s.target - s.whole * s.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN split s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN 2 * upto - size < 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running
"""

CHECKS: dict[str, str] = {
    "op4_quality_rules": _OP4,
    "op8_substring": _OP8,
    "op9_decontaminate": _OP9,
    "op10_mixing": _OP10,
}
