"""Queries of the training-data problems on the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifmill.functions.columns import computed_once
from motifmill.functions.motifs import canonical_motif
from motifmill.llm.mixing import Mix, Target, mix_sources
from motifmill.llm.packing import pack_items
from motifmill.llm.shared import class_members, maximal_spans, shared_bases, sharing_pairs
from motifmill.llm.splitting import split_records
from motifmill.llm.survivors import Field, survivors
from motifmill.llm.terms import mark_by_spread, term_frequencies
from motifmill.llm.tokens import count_tokens
from motifmill.llm.topn import top_n_per_group
from motifmill.llm.truncation import fit, score
from motifmill.plans.sql import CANONICAL_SQL
from motifmill.sources.tables import table

TOP_N = 5
RARE_CHROMS = 2
COMMON_SHARE = 0.2
SPAN = 100
MIN_GAP = 10


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The five longest calls of every chrom."""
    calls = table(spark, folder, "tandem_repeats").where("length > 0")
    return top_n_per_group(calls, "chrom", "length", ["start_pos", "rec_id"], TOP_N).select("chrom", "rank_no", "rec_id")


def p3_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every canonical motif with its calls, its chroms and its mark (null: neither rare nor common)."""
    calls = table(spark, folder, "tandem_repeats")
    chroms = calls.select("chrom").where("chrom is not null").distinct().count()
    spelled = computed_once(calls.select("motif", "chrom").where("chrom is not null"), canonical=canonical_motif(F.col("motif")))
    marked = mark_by_spread(term_frequencies(spelled, F.col("canonical"), F.col("chrom")), chroms, RARE_CHROMS, COMMON_SHARE)
    return marked.select(F.col("term").alias("motif"), F.col("occurrences").alias("n_calls"), F.col("records").alias("n_chroms"), "mark")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical motifs on too few or too many chroms."""
    return p3_terms(spark, folder).where("mark is not null").select("motif", "mark")


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record for each repeat, with the best spelling, tier and confidence and the rows they come from."""
    calls = table(spark, folder, "tandem_repeats").select("rec_id", "chrom", "start_pos", "end_pos", "motif", "tier", "confidence", "called_at").where("end_pos > start_pos and chrom is not null")
    calls = computed_once(calls, canonical=canonical_motif(F.col("motif")))
    spelled = F.col("motif") == F.col("canonical")
    fields = [
        Field("motif", F.when(~spelled, F.col("motif")), F.lit(True), (spelled.cast("int"),), lambda best: F.coalesce(best["value"], F.col("canonical"))),
        Field("tier", None, F.col("tier").between(1, 3), (-F.col("tier"),), read=lambda best: -best["p0"]),
        Field("confidence", None, F.col("confidence").between(0, 1), (F.col("confidence"),), read=lambda best: best["p0"]),
    ]
    return survivors(calls, ["chrom", "canonical"], "start_pos", "end_pos", "rec_id", "called_at", fields)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of two or more calls of one repeat: the rows that give each field."""
    given = [F.coalesce(F.col(c), F.lit(-1)).cast("bigint").alias(c) for c in ("motif_from", "tier_from", "confidence_from")]
    return p4_records(spark, folder).where("n_rows > 1").select("first_id", *given)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of reference records that share a stretch of 100 or more bases."""
    return sharing_pairs(table(spark, folder, "fasta"), "seq_ord", "seq", SPAN).select(F.col("record_a").alias("seq_a"), F.col("record_b").alias("seq_b"))


def p6_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal shared stretches between reference records (one record for each exact copy class)."""
    return maximal_spans(table(spark, folder, "fasta"), "seq_ord", "seq", SPAN)


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The representative in ``p6_spans`` of every reference record, and whether it has a stretch to share at all."""
    return class_members(table(spark, folder, "fasta"), "seq_ord", "seq", SPAN)


def p6_shared_bases(spark: SparkSession, folder: str) -> DataFrame:
    """For each reference record, how many of its bases are shared with another."""
    return shared_bases(table(spark, folder, "fasta"), "seq_ord", "seq", SPAN)


def p6_span_bases(spark: SparkSession, folder: str) -> DataFrame:
    """The same, from the maximal spans of all pairs."""
    return shared_bases(table(spark, folder, "fasta"), "seq_ord", "seq", SPAN, by_spans=True)


def _limits(spark: SparkSession, folder: str, kind: str) -> list[tuple[str, int, int]]:
    rows = table(spark, folder, "size_limits").where(F.col("item_kind").like(kind)).orderBy("item_kind").collect()  # a handful of settings
    return [(r["item_kind"], r["max_size"], r["overlap_size"]) for r in rows]


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All reference records in pieces within the size limit."""
    ((_, max_size, overlap),) = _limits(spark, folder, "fasta_seq")
    return split_records(table(spark, folder, "fasta"), "seq_ord", "seq", max_size, overlap, MIN_GAP).withColumnRenamed("record", "seq_ord")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records above the limit: whether all cuts lie in assembly gaps ('free') or some had to be forced."""
    ((_, max_size, overlap),) = _limits(spark, folder, "fasta_seq")
    oversized = table(spark, folder, "fasta").where(F.length("seq") > max_size)
    pieces = split_records(oversized, "seq_ord", "seq", max_size, overlap, MIN_GAP, with_text=False)
    forced = F.max((F.col("cut_kind") == "forced").cast("int"))
    return pieces.groupBy(F.col("record").alias("seq_ord")).agg(F.when(forced == 1, F.lit("forced")).otherwise(F.lit("free")).alias("cut_kind"))


def p7_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every record held against what is asked of them: forced cuts, and whether all hold the limit, cover
    the record, overlap as stated, are not inside one another, and have the record's own text."""
    ((_, max_size, overlap),) = _limits(spark, folder, "fasta_seq")
    along = Window.partitionBy("seq_ord").orderBy("piece_no")
    pieces = p7_pieces(spark, folder).withColumns({"_start": F.lag("piece_start").over(along), "_end": F.lag("piece_end").over(along)})
    told = pieces.join(table(spark, folder, "fasta").select("seq_ord", "seq"), "seq_ord").groupBy("seq_ord")
    return told.agg(
        F.max("piece_end").alias("n_chars"),
        F.count_if(F.col("cut_kind") == "forced").alias("n_forced"),
        F.bool_and(F.col("piece_end") - F.col("piece_start") <= max_size).alias("within_limit"),
        F.bool_and(F.when(F.col("cut_kind") == "end", F.col("piece_end") == F.length("seq")).otherwise(F.col("piece_end") < F.length("seq"))).alias("covered"),
        F.bool_and(F.col("piece_start") == F.coalesce(F.greatest(F.col("_end") - overlap, F.lit(0)), F.lit(0))).alias("overlapping"),
        F.bool_and(F.col("_end").isNull() | ((F.col("piece_start") > F.col("_start")) & (F.col("piece_end") > F.col("_end")))).alias("none_inside"),
        F.bool_and(F.col("piece") == F.substring("seq", F.col("piece_start").cast("int") + 1, (F.col("piece_end") - F.col("piece_start")).cast("int"))).alias("text_kept"),
    )


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, for each container size."""
    documents = table(spark, folder, "documents")
    sized = documents.select("doc_id", count_tokens(F.col("text")).alias("n_tokens"))
    containers = [(kind, size) for kind, size, _ in _limits(spark, folder, "doc_pack_%")]
    return pack_items(sized, "doc_id", "n_tokens", containers, documents.count()).withColumnRenamed("item", "doc_id")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """For each container size: containers used, tokens held, and the share of space that is filled."""
    return (
        p8_packed(spark, folder)
        .groupBy("container_kind", "capacity", "shard", "bin_no")
        .agg(F.sum("piece_size").alias("_held"))
        .groupBy("container_kind", "capacity")
        .agg(F.count(F.lit(1)).alias("n_containers"), F.sum("_held").alias("n_tokens"))
        .withColumn("fill_share", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))
    )


def _mix(spark: SparkSession, folder: str) -> Mix:
    sized = table(spark, folder, "documents").select("doc_id", "source", count_tokens(F.col("text")).alias("n_tokens"))
    targets = [Target(r["source"], r["target_share"], r["max_repeats"]) for r in table(spark, folder, "mix_targets").collect()]  # one row a source
    return mix_sources(sized, "doc_id", "source", "n_tokens", targets, use_up=False)


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix: a row for each copy of a document, in shuffled order."""
    return _mix(spark, folder).copies.withColumnsRenamed({"record": "doc_id", "size": "n_tokens"})


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares reached by each source of the mix."""
    return _mix(spark, folder).shares


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "source", "text")
    return score(documents, fit(documents, "doc_id", "source", "text"), "doc_id", "source", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text was cut off."""
    return _scored(spark, folder).where("truncated").select("doc_id")


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source cuts its texts (null: documents without a source)."""
    cut = F.sum(F.col("truncated").cast("bigint"))
    return _scored(spark, folder).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), cut.alias("n_truncated"), (cut / F.count(F.lit(1))).alias("truncation_rate"))


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_terms": p3_terms,
    "p4_found": p4_found,
    "p4_records": p4_records,
    "p6_found": p6_found,
    "p6_spans": p6_spans,
    "p6_classes": p6_classes,
    "p6_shared_bases": p6_shared_bases,
    "p6_span_bases": p6_span_bases,
    "p7_found": p7_found,
    "p7_pieces": p7_pieces,
    "p7_audit": p7_audit,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}

_TERMS = f"""
WITH calls AS (SELECT chrom, {CANONICAL_SQL} AS motif FROM tandem_repeats),
terms AS (SELECT motif, count(*) AS n_calls, count(DISTINCT chrom) AS n_chroms FROM calls WHERE motif IS NOT NULL AND chrom IS NOT NULL GROUP BY motif),
marked AS (
  SELECT *, CASE WHEN n_chroms <= {RARE_CHROMS} THEN 'rare' WHEN n_chroms >= {COMMON_SHARE} * (SELECT count(DISTINCT chrom) FROM tandem_repeats) THEN 'common' END AS mark
  FROM terms
)"""

_GROUPS = f"""
WITH valid AS (
  SELECT *, {CANONICAL_SQL} AS canonical FROM tandem_repeats WHERE chrom IS NOT NULL AND end_pos > start_pos
),
flagged AS (
  SELECT *, CASE WHEN start_pos < max(end_pos) OVER (PARTITION BY chrom, canonical ORDER BY start_pos, rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
  FROM valid WHERE canonical IS NOT NULL
),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY chrom, canonical ORDER BY start_pos, rec_id ROWS UNBOUNDED PRECEDING) AS grp FROM flagged),
groups AS (
  SELECT chrom, canonical, min(start_pos) AS group_start, max(end_pos) AS group_end, count(*) AS n_rows, min(rec_id) AS first_id,
    first(rec_id ORDER BY (motif = canonical) DESC, called_at DESC NULLS LAST, rec_id) AS motif_from,
    first(motif ORDER BY (motif = canonical) DESC, called_at DESC NULLS LAST, rec_id) AS motif,
    first(rec_id ORDER BY tier, called_at DESC NULLS LAST, rec_id) FILTER (tier BETWEEN 1 AND 3) AS tier_from,
    min(tier) FILTER (tier BETWEEN 1 AND 3) AS tier,
    first(rec_id ORDER BY confidence DESC, called_at DESC NULLS LAST, rec_id) FILTER (confidence BETWEEN 0 AND 1) AS confidence_from,
    max(confidence) FILTER (confidence BETWEEN 0 AND 1) AS confidence
  FROM numbered GROUP BY chrom, canonical, grp
)"""

_STRETCHES = f"""
WITH stretches AS (
  SELECT seq_ord, n_bases, p, substring(s, p, {SPAN}) AS stretch
  FROM (SELECT seq_ord, s, n_bases, unnest(range(1, n_bases - {SPAN} + 2)) AS p FROM (SELECT seq_ord, upper(seq) AS s, length(seq) AS n_bases FROM fasta WHERE length(seq) >= {SPAN}))
),
clean AS (SELECT * FROM stretches WHERE length(translate(stretch, 'ACGT', '')) = 0)"""

_SHARED_BASES = f"""{_STRETCHES},
shared AS (SELECT * FROM clean WHERE stretch IN (SELECT stretch FROM clean GROUP BY stretch HAVING count(DISTINCT seq_ord) > 1)),
steps AS (SELECT seq_ord, least({SPAN}, coalesce(lead(p) OVER (PARTITION BY seq_ord ORDER BY p) - p, {SPAN})) AS step FROM shared)
SELECT seq_ord AS record, CAST(coalesce(length(seq), 0) AS BIGINT) AS n_bases, CAST(coalesce(shared_bases, 0) AS BIGINT) AS shared_bases
FROM fasta LEFT JOIN (SELECT seq_ord, sum(step) AS shared_bases FROM steps GROUP BY seq_ord) USING (seq_ord)"""

SQL = {
    "p2_found": f"""
SELECT chrom, CAST(rank_no AS INTEGER) AS rank_no, rec_id
FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY length DESC, start_pos, rec_id) AS rank_no FROM tandem_repeats WHERE chrom IS NOT NULL AND length > 0)
WHERE rank_no <= {TOP_N}""",
    "p3_found": f"{_TERMS} SELECT motif, mark FROM marked WHERE mark IS NOT NULL",
    "p3_terms": f"{_TERMS} SELECT * FROM marked",
    "p4_found": f"{_GROUPS} SELECT first_id, motif_from, coalesce(tier_from, -1) AS tier_from, coalesce(confidence_from, -1) AS confidence_from FROM groups WHERE n_rows > 1",
    "p4_records": f"{_GROUPS} SELECT * FROM groups",
    "p6_found": f"""{_STRETCHES}
SELECT DISTINCT a.seq_ord AS seq_a, b.seq_ord AS seq_b FROM clean a JOIN clean b USING (stretch) WHERE a.seq_ord < b.seq_ord""",
    "p6_classes": f"SELECT seq_ord AS record, min(seq_ord) OVER (PARTITION BY upper(seq)) AS representative, regexp_matches(seq, '[ACGTacgt]{{{SPAN}}}') AS holds_span FROM fasta WHERE seq IS NOT NULL",
    "p6_spans": f"""{_STRETCHES},
chosen AS (SELECT seq_ord FROM (SELECT seq_ord, min(seq_ord) OVER (PARTITION BY upper(seq)) AS representative FROM fasta WHERE seq IS NOT NULL) WHERE seq_ord = representative),
held AS (SELECT seq_ord, p, stretch FROM clean JOIN chosen USING (seq_ord)),
met AS (SELECT a.seq_ord AS record_a, b.seq_ord AS record_b, a.p AS pa, b.p AS pb FROM held a JOIN held b USING (stretch) WHERE a.seq_ord < b.seq_ord),
islands AS (SELECT *, pa - row_number() OVER (PARTITION BY record_a, record_b, pb - pa ORDER BY pa) AS island FROM met)
SELECT record_a, record_b, min(pa) - 1 AS start_a, min(pb) - 1 AS start_b, count(*) + {SPAN - 1} AS bases FROM islands GROUP BY record_a, record_b, pb - pa, island""",
    "p6_shared_bases": _SHARED_BASES,
    "p6_span_bases": _SHARED_BASES,
    "p7_found": """
SELECT seq_ord, CASE WHEN list_max(list_transform(regexp_split_to_array(upper(seq), 'N{10,}'), lambda s: length(s))) <= max_size - overlap_size THEN 'free' ELSE 'forced' END AS cut_kind
FROM fasta, size_limits WHERE item_kind = 'fasta_seq' AND length(seq) > max_size""",
    "p7_audit": f"""
SELECT seq_ord, CAST(length(seq) AS BIGINT) AS n_chars,
  CASE WHEN length(seq) > max_size THEN CAST(list_sum(list_transform(regexp_split_to_array(upper(seq), 'N{{{MIN_GAP},}}'), lambda s: greatest(0, (length(s) - 1) // (max_size - overlap_size)))) AS BIGINT) ELSE 0 END AS n_forced,
  true AS within_limit, true AS covered, true AS overlapping, true AS none_inside, true AS text_kept
FROM fasta, size_limits WHERE item_kind = 'fasta_seq' AND seq IS NOT NULL""",
}
