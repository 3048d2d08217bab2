"""FASTA and FASTQ files as DataFrames.

FASTA files are read as records, not lines: the separator of the text reader is the line break before a header,
so a record is one row whatever its length, and files are split over tasks as usual. Where lines must be
numbered (FASTQ), each block of a file counts its own lines and only the counts are added up over the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifmill.operators.ordering import number_rows
from motifmill.session import small

_EDGES = r"^[ \t\r\f\x0b]+|[ \t\r\f\x0b]+$"


def _read(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(value, file, block, at): ``at`` grows along a block of a file."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(record, file, block, at): records without '>'; text before the first header of a file is left out."""
    raw = _read(spark, path, "\n>")
    first = raw.groupBy("file").agg(F.min(F.struct("block", "at")).alias("_first")).select("file", F.col("_first.at").alias("_first"))
    # only the first record of a file still has its sign; without one it is text before any header
    signed = F.col("value").startswith(">") & (F.col("at") == F.col("_first"))
    kept = raw.join(first, "file").where((F.col("at") != F.col("_first")) | signed)
    return kept.select(F.when(signed, F.expr("substring(value, 2)")).otherwise(F.col("value")).alias("record"), "file", "block", "at")


def _bases(record: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(record, r"^[^\n]*\n?", ""), rf"(?md){_EDGES}|\n", "")


def read_fasta(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """(seq_ord, chrom, descr, seq) of every record of FASTA files, numbered from 0 in file order.

    The name is the first word behind '>'. Lines are stripped and joined; blank lines and anything before the first
    header are dropped; a record without lines has an empty sequence. A name that comes again keeps its first
    place and its last sequence. A header without a name is an error: it raises when read.
    """
    name = F.regexp_extract("record", r"^[ \t]*([^\s]+)", 1)
    head = F.trim(F.regexp_extract("record", r"^([^\n]*)", 1), F.lit(" \t\r"))
    sequence = _bases(F.col("record"))
    parsed = _records(spark, path).select(
        F.when(F.length(name) > 0, name).otherwise(F.raise_error(F.lit("a FASTA header without a name"))).alias("chrom"),
        F.regexp_extract(head, r"^[^\s]+\s+(.*)$", 1).alias("descr"),
        (F.upper(sequence) if upper else sequence).alias("seq"),
        F.struct("file", "block", "at").alias("_place"),
    )
    # names and places alone decide which records are kept and how they are numbered; sequences are read for those only
    names = parsed.groupBy("chrom").agg(F.min("_place").alias("_first"), F.max("_place").alias("_place"))
    numbered = number_rows(names, ["_first"], "seq_ord").select("_place", "seq_ord")
    return parsed.join(small(numbered), "_place").select("seq_ord", "chrom", "descr", "seq")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, line_no, block, headers_before): stripped lines, numbered from 0 in each file."""
    lines = _read(spark, path).withColumn("line", F.regexp_replace("value", _EDGES, ""))
    header = F.col("line").rlike("^[>@]").cast("int")
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"), F.sum(header).alias("_headers"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", "_first", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(a) for c, a in (("_n", "_lines_before"), ("_headers", "headers_before"))))
    return lines.join(offsets, ["file", "block"]).select("line", "file", "block", (F.col("at") - F.col("_first") + F.col("_lines_before")).alias("line_no"), "headers_before")


def read_long_reads(spark: SparkSession, path: str, form: str = "fasta", compat: bool = False) -> DataFrame:
    """(read_idx, read_seq): reads of FASTA or FASTQ files, upper case, numbered in file order; empty reads are dropped.

    FASTQ (``form='fastq'``): records of four lines, of which the second is the read. With ``compat`` the lines are
    taken as they come: '>' or '@' at the start of a line begins a read, '+' lines are skipped, and all others,
    FASTQ's quality lines too, are bases; lines before the first header then make a read of their own.
    """
    if compat:
        lines = _numbered_lines(spark, path)
        here = Window.partitionBy("file", "block").orderBy("line_no")
        begun = F.sum(F.col("line").rlike("^[>@]").cast("int")).over(here) + F.col("headers_before")
        bases = lines.withColumn("_read", begun).where(~F.col("line").rlike("^[>@+]") & (F.col("line") != ""))
        parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda p: p["line"])
        reads = bases.groupBy("file", "_read").agg(F.array_join(parts, "").alias("_bases"))
        placed = reads.select(F.struct("file", "_read").alias("_place"), F.upper("_bases").alias("read_seq"))
    elif form == "fastq":
        placed = _numbered_lines(spark, path).where("line_no % 4 = 1").select(F.struct("file", "line_no").alias("_place"), F.upper("line").alias("read_seq"))
    elif form == "fasta":
        placed = _records(spark, path).select(F.struct("file", "block", "at").alias("_place"), F.upper(_bases(F.col("record"))).alias("read_seq"))
    else:
        raise ValueError(f"unknown format {form!r}: fasta or fastq")
    return number_rows(placed.where("read_seq != ''"), ["_place"], "read_idx").select("read_idx", "read_seq")


def split_fasta(spark: SparkSession, path: str, target: str) -> None:
    """Writes each record of FASTA files, header and case kept, below ``target`` in a folder chrom=<name>.

    A name that comes again leaves only its last record.
    """
    records = read_fasta(spark, path, upper=False)
    header = F.concat_ws(" ", F.concat(F.lit(">"), F.col("chrom")), F.nullif("descr", F.lit("")))
    records.select("chrom", F.concat_ws("\n", header, F.nullif("seq", F.lit(""))).alias("value")).write.mode("overwrite").partitionBy("chrom").text(target)
