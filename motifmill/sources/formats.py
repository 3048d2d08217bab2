"""BED and VCF lines of repeats, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifmill.operators.ordering import first_within, number_rows, number_within
from motifmill.operators.tiers import EMISSION

#: The header lines of both formats.
BED_HEADER = ["# Tandem Repeats (BED format)", "# chrom\tstart\tend\tmotif\tcopies\ttier"]
VCF_HEADER = [
    "##fileformat=VCFv4.2",
    '##INFO=<ID=MOTIF,Number=1,Type=String,Description="Repeat motif">',
    '##INFO=<ID=COPIES,Number=1,Type=Float,Description="Number of copies">',
    '##INFO=<ID=TIER,Number=1,Type=Integer,Description="Detection tier">',
    '##INFO=<ID=CONF,Number=1,Type=Float,Description="Confidence score">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",
]


def fixed(value: Column, digits: int) -> Column:
    """A number with ``digits`` decimals, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def bed_line() -> Column:
    return F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "motif", fixed(F.col("copies"), 1), F.col("tier").cast("string"))


def vcf_info() -> Column:
    return F.concat(F.lit("MOTIF="), "motif", F.lit(";COPIES="), fixed(F.col("copies"), 1), F.lit(";TIER="), F.col("tier").cast("string"), F.lit(";CONF="), fixed(F.col("confidence"), 2))


def vcf_line(number: Column) -> Column:
    return F.concat_ws("\t", "chrom", (F.col("start") + 1).cast("string"), F.concat(F.lit("TR"), number.cast("string")), F.lit("."), F.lit("<TR>"), F.lit("."), F.lit("PASS"), vcf_info())


def _numbered(repeats: DataFrame, per: list[str] | None) -> DataFrame:
    if per:
        return number_within(repeats, per, EMISSION[:-1], EMISSION[-1:], "_no")
    return number_rows(repeats, list(EMISSION), "_no")


def longest(repeats: DataFrame, n: int | None, per: list[str]) -> DataFrame:
    """The ``n`` longest repeats of each group, ties in order of emission, with their place ``_no`` from 0.

    Null, 0 or a negative ``n`` keeps all, in order of emission.
    """
    if n is None or n <= 0:
        return _numbered(repeats, per)
    return first_within(repeats, per, [F.desc("length"), *EMISSION], n, "_no")


def lines(repeats: DataFrame, form: str, order: list[Column | str] | None = None, per: list[str] | None = None) -> DataFrame:
    """(per..., line_no, line) of a BED or VCF file, headers included with negative numbers; other formats raise.

    Lines are in the order of ``_no`` where the repeats have it (from 0 in each group), else of ``order`` (over all
    groups), else of emission.
    """
    if form not in ("bed", "vcf"):
        raise ValueError(f"unknown format {form!r}: bed or vcf")
    keys = per or []
    rows = repeats if "_no" in repeats.columns else number_rows(repeats, order, "_no") if order else _numbered(repeats, per)
    body = rows.select(*keys, F.col("_no").cast("bigint").alias("line_no"), (bed_line() if form == "bed" else vcf_line(F.col("_no"))).alias("line"))
    texts = BED_HEADER if form == "bed" else VCF_HEADER
    header = F.array(*(F.struct(F.lit(i - len(texts)).cast("bigint").alias("line_no"), F.lit(t).alias("line")) for i, t in enumerate(texts)))
    spark = repeats.sparkSession
    owners = rows.select(*keys).distinct() if keys else spark.range(1).select()
    return owners.select(*keys, F.inline(header)).unionByName(body)


def write_lines(repeats: DataFrame, form: str, path: str, per: list[str] | None = None) -> None:
    """Writes a BED or VCF file as ordered parts below ``path``, or below one folder for each value of ``per``.

    The parts, in order of their names, are the file; the header begins the first.
    """
    made = lines(repeats, form, per=per).orderBy(*(per or []), "line_no").select(*(per or []), "line").write.mode("overwrite")
    (made.partitionBy(*per) if per else made).text(path)
