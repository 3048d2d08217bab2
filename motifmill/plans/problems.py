"""Queries of the general data problems (1 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill.functions.columns import computed_once
from motifmill.functions.motifs import canonical_motif
from motifmill.operators.intervals import gaps, periods
from motifmill.operators.skew import skew_free_aggregate
from motifmill.plans.sql import CANONICAL_SQL
from motifmill.sources.tables import table

MIN_SHARE = 0.02
MAX_GAP = 1_000_000


def _calls_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """Two rows for each call: by its chrom and by its canonical motif."""
    calls = table(spark, folder, "tandem_repeats").select("rec_id", "chrom", "length", "start_pos", F.col("motif"))
    keyed = F.array(
        F.struct(F.lit("chrom").alias("key_kind"), F.col("chrom").alias("key_value")),
        F.struct(F.lit("motif").alias("key_kind"), canonical_motif(F.col("motif")).alias("key_value")),
    )
    return calls.select("rec_id", "length", "start_pos", F.inline(keyed)).where("key_value is not null")


def _reference_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Matching side: bases on file for each chrom, unit length of each dictionary motif."""
    chroms = table(spark, folder, "fasta").groupBy("chrom").agg(F.sum(F.length("seq")).cast("bigint").alias("reference_size")).select(F.lit("chrom").alias("key_kind"), F.col("chrom").alias("key_value"), "reference_size")
    motifs = table(spark, folder, "motif_dictionary").select(F.lit("motif").alias("key_kind"), F.col("motif").alias("key_value"), F.col("k").cast("bigint").alias("reference_size"))
    return chroms.unionByName(motifs)


def _loads(spark: SparkSession, folder: str) -> DataFrame:
    """Calls by key: motifs are counted as they are spelled, and only each spelling is made canonical."""
    calls = table(spark, folder, "tandem_repeats")
    chroms = calls.where("chrom is not null").groupBy("chrom").agg(F.count(F.lit(1)).alias("_n")).select(F.lit("chrom").alias("key_kind"), F.col("chrom").alias("key_value"), F.col("_n").alias("_mm_load"))
    spellings = calls.groupBy("motif").agg(F.count(F.lit(1)).alias("_n"))
    motifs = computed_once(spellings, key_value=canonical_motif(F.col("motif"))).where("key_value is not null").groupBy("key_value").agg(F.sum("_n").alias("_mm_load"))
    return chroms.unionByName(motifs.select(F.lit("motif").alias("key_kind"), "key_value", "_mm_load"))


def _key_stats(spark: SparkSession, folder: str, total: int) -> DataFrame:
    return skew_free_aggregate(
        _calls_by_key(spark, folder),
        ["key_kind", "key_value"],
        F.col("rec_id"),
        [F.count(F.lit(1)).alias("n_calls"), F.sum(F.when(F.col("length") > 0, F.col("length"))).alias("called_bases"), F.min("start_pos").alias("first_start"), F.max("reference_size").alias("reference_size")],
        [F.sum("n_calls").alias("n_calls"), F.sum("called_bases").alias("called_bases"), F.min("first_start").alias("first_start"), F.max("reference_size").alias("reference_size")],
        2 * total,
        _reference_sizes(spark, folder),
        loads=_loads(spark, folder),
    )


def p1_key_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Per chrom and per canonical motif: calls, called bases, first position, and the matching reference size."""
    return _key_stats(spark, folder, table(spark, folder, "tandem_repeats").count())


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chroms and canonical motifs that hold 2 percent or more of all calls."""
    total = table(spark, folder, "tandem_repeats").count()
    return _key_stats(spark, folder, total).where(F.col("n_calls") >= F.lit(MIN_SHARE * total)).select("key_kind", "key_value")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Uncovered stretches of 1 to 1,000,000 bases between the calls of a chrom."""
    return gaps(table(spark, folder, "tandem_repeats"), "chrom", "start_pos", "end_pos", 1, MAX_GAP)


def p5_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Covered periods of each chrom."""
    return periods(table(spark, folder, "tandem_repeats"), "chrom", "start_pos", "end_pos")


QUERIES = {"p1_found": p1_found, "p1_key_stats": p1_key_stats, "p5_found": p5_found, "p5_periods": p5_periods}

_KEYED = f"""
WITH calls AS (SELECT rec_id, chrom, length, start_pos, {CANONICAL_SQL} AS cm FROM tandem_repeats),
keyed AS (
  SELECT 'chrom' AS key_kind, chrom AS key_value, length, start_pos FROM calls WHERE chrom IS NOT NULL
  UNION ALL SELECT 'motif', cm, length, start_pos FROM calls WHERE cm IS NOT NULL
)"""

_MERGED = """
WITH valid AS (SELECT chrom, start_pos AS s, end_pos AS e FROM tandem_repeats WHERE chrom IS NOT NULL AND end_pos > start_pos),
flagged AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
  FROM valid
),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY s, e, new DESC ROWS UNBOUNDED PRECEDING) AS grp FROM flagged),
merged AS (SELECT chrom, min(s) AS period_start, max(e) AS period_end FROM numbered GROUP BY chrom, grp)"""

SQL = {
    "p1_found": f"{_KEYED} SELECT key_kind, key_value FROM keyed GROUP BY ALL HAVING count(*) >= {MIN_SHARE} * (SELECT count(*) FROM tandem_repeats)",
    "p1_key_stats": f"""{_KEYED},
sizes AS (
  SELECT 'chrom' AS key_kind, chrom AS key_value, CAST(sum(length(seq)) AS BIGINT) AS reference_size FROM fasta GROUP BY chrom
  UNION ALL SELECT 'motif', motif, CAST(k AS BIGINT) FROM motif_dictionary
),
stats AS (
  SELECT key_kind, key_value, count(*) AS n_calls, CAST(sum(CASE WHEN length > 0 THEN length END) AS BIGINT) AS called_bases, min(start_pos) AS first_start
  FROM keyed GROUP BY ALL
)
SELECT stats.*, reference_size FROM stats LEFT JOIN sizes USING (key_kind, key_value)""",
    "p5_found": f"""{_MERGED},
ends AS (SELECT chrom, lag(period_end) OVER (PARTITION BY chrom ORDER BY period_start) AS gap_start, period_start AS gap_end FROM merged)
SELECT * FROM ends WHERE gap_end - gap_start BETWEEN 1 AND {MAX_GAP}""",
    "p5_periods": f"{_MERGED} SELECT * FROM merged",
}
