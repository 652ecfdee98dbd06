"""The corpus operators as queries over the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from stockledger.llm import bpe, chunks, collocations, decontaminate, html, lm, mixing, ngram_join, periodic, quality, rules, suffixes, toxicity
from stockledger.llm.common import table

_WORD = r"[^\x20\x09-\x0D]+"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), corpus_pipeline.VOCABULARY, public_tokenizers.PATTERN).drop("ids")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rules.judged(table(spark, sf_dir, "documents")).select(*columns)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), carried=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """The words of each text; where the hash of the id ends in 0, those from some place on made periodic. Only ids and texts are kept."""
    words = docs.select(
        "doc_id", F.col("text").alias("whole"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h")
    ).withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("whole", F.lit(f"({_WORD})"))))
    sizes = words.withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("IF(n > 0, g % n, 0)"))
    periods = sizes.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("array_join(transform(sequence(0, n - 1), i -> w[CAST(IF(i >= a, a + (i - a) % p, i) AS INT)]), ' ')")
    return periods.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("whole")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic(with_planted_periods(table(spark, sf_dir, "documents")))
    greatest = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS s, -r.period AS p)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    named = found.withColumn("most", greatest).withColumn("lines", lines)
    return named.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("most.s")).alias("start"),
        F.col("most.length").alias("length"),
        (-F.col("most.p")).alias("period"),
        F.expr("1000 * most.length div -most.p").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_decontamination": op10_decontamination,
    "op11_collocations": op11_collocations,
    "op12_source_mix": op12_source_mix,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

# The others learn, sort suffixes, walk trees of tags or merge bytes: tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
items AS (SELECT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win
          FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM b)),
places AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
           FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i
                 FROM d, (SELECT DISTINCT size FROM items) WHERE len(w) >= size)),
found AS (SELECT DISTINCT doc_id, i, size, item_id FROM places JOIN items USING (size, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM found) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op11_collocations": rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, size, w[i:i + size - 1] AS p, CAST(count(*) AS HUGEINT) AS f
      FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS size))
      GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT c.lang, c.size, c.p, c.f AS a, k, x.f AS l, y.f AS r, n, 1000 * c.f * n // (x.f * y.f) AS score
         FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) c
         JOIN totals USING (lang)
         JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k]
         JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT lang, part FROM
             (SELECT lang, f, p[i:i + m - 1] AS part FROM
                (SELECT *, unnest(range(1, size - m + 2)) AS i FROM f, (SELECT unnest(range(2, 5)) AS m) WHERE size > m)) o
           JOIN (SELECT lang, p AS part, f AS own FROM f) c USING (lang, part) WHERE 100 * o.f >= 100 * own),
kept AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.part = b.p WHERE i.part IS NULL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a,
       CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000""",
    "op12_source_mix": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS part, coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS key
  FROM documents),
s AS (SELECT part, source_size, 1 + (row_number() OVER (ORDER BY part = '', part) - 1) % 3 AS weight
      FROM (SELECT part, CAST(sum(size) AS HUGEINT) AS source_size FROM d GROUP BY part)),
total AS (SELECT sum(source_size) AS words FROM s),
-- Round by round, all sources above their limit are set to it and the rest is shared anew.
rounds AS (
  SELECT 0 AS round, part, source_size, weight, false AS at_limit FROM s
  UNION ALL
  SELECT round + 1, part, source_size, weight,
         at_limit OR 3 * source_size * open < weight * (words - given)
  FROM (SELECT r.*, words, coalesce(sum(CASE WHEN at_limit THEN 3 * source_size END) OVER (), 0) AS given,
               coalesce(sum(CASE WHEN NOT at_limit THEN weight END) OVER (), 0) AS open
        FROM rounds r, total)
  WHERE round < (SELECT count(*) FROM s)),
final AS (SELECT part, source_size, at_limit, weight * (words - given) AS num, open
          FROM (SELECT r.*, words, coalesce(sum(CASE WHEN at_limit THEN 3 * source_size END) OVER (), 0) AS given,
                       coalesce(sum(CASE WHEN NOT at_limit THEN weight END) OVER (), 0) AS open
                FROM rounds r, total WHERE round = (SELECT count(*) FROM s))),
t AS (SELECT part, source_size,
             CASE WHEN at_limit THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(num AS DOUBLE) / CAST(open AS DOUBLE) END AS target,
             CASE WHEN at_limit THEN 3 * source_size ELSE num // open END AS words FROM final),
p AS (SELECT d.*, t.source_size, t.target, t.words,
             sum(size) OVER (PARTITION BY part ORDER BY key, id, size ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN t USING (part))
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size
            + least(greatest(words % source_size - start, 0), size) END AS BIGINT) AS taken
FROM p""",
}
