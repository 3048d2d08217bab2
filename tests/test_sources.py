import glob

import pytest
from pyspark.sql import functions as F

from motifmill.operators import tiers
from motifmill.operators.kmers import sequences
from motifmill.plans.repeats import enumerate_motifs
from motifmill.sources.fasta import read_fasta, read_long_reads, split_fasta
from motifmill.sources.formats import BED_HEADER, VCF_HEADER, fixed, lines, longest, write_lines


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def records(df):
    return [(r["seq_ord"], r["chrom"], r["descr"], r["seq"]) for r in df.orderBy("seq_ord").collect()]


def test_fasta_records(spark, tmp_path):
    path = write(tmp_path / "a.fa", "dropped\n>c1 first one\r\nACgt\r\n  ACGT \n\n>c2\n>c3 x\nNNNN\n>c1 again\nTTTT$\n")
    assert records(read_fasta(spark, path)) == [(0, "c1", "again", "TTTT$"), (1, "c2", "", ""), (2, "c3", "x", "NNNN")]
    assert records(read_fasta(spark, write(tmp_path / "b.fa", ">x\nac\nGT"), upper=False)) == [(0, "x", "", "acGT")]
    assert records(read_fasta(spark, write(tmp_path / "none.fa", "no header\nACGT\n"))) == []
    with pytest.raises(Exception, match="without a name"):
        read_fasta(spark, write(tmp_path / "bare.fa", ">\nACGT\n")).collect()


def test_fasta_over_many_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        text = "".join(f">c{i} d{i}\n{'ACGT' * (i % 40)}\n{'TT' * i}\n" for i in range(200))
        got = records(read_fasta(spark, write(tmp_path / "many.fa", text)))
        fastq = "".join(f"@r{i}\n{'ACGT' * (i + 1)}\n+\n@{'I' * (4 * i + 3)}\n" for i in range(150))
        reads = read_long_reads(spark, write(tmp_path / "many.fq", fastq), "fastq").orderBy("read_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(i, f"c{i}", f"d{i}", "ACGT" * (i % 40) + "TT" * i) for i in range(200)]
    assert [(r["read_idx"], r["read_seq"]) for r in reads] == [(i, "ACGT" * (i + 1)) for i in range(150)]


def test_reads(spark, tmp_path):
    path = write(tmp_path / "r.fq", "@r1\nacgt\n+\n>III\n@r2\nGG\n+\nAB\n")
    strict = read_long_reads(spark, path, "fastq").orderBy("read_idx").collect()
    assert [r["read_seq"] for r in strict] == ["ACGT", "GG"]
    compat = read_long_reads(spark, path, compat=True).orderBy("read_idx").collect()
    assert [r["read_seq"] for r in compat] == ["ACGT", "GGAB"]
    fasta = write(tmp_path / "r.fa", ">a\nAC\nGT\n>b\n\n>a\ntt\n")
    assert [r["read_seq"] for r in read_long_reads(spark, fasta).orderBy("read_idx").collect()] == ["ACGT", "TT"]
    with pytest.raises(ValueError):
        read_long_reads(spark, path, "bam")


def test_split_into_files(spark, tmp_path):
    path = write(tmp_path / "a.fa", ">c1 one two\nACgt\nAA\n>c2\nTT\n")
    split_fasta(spark, path, str(tmp_path / "out"))
    (one,) = glob.glob(str(tmp_path / "out/chrom=c1/part-*"))
    assert open(one).read() == ">c1 one two\nACgtAA\n"


def test_fixed_decimals_round_ties_to_even(spark):
    got = spark.createDataFrame([(7.25,), (7.35,), (0.125,), (11.0,)], "x double").select(fixed(F.col("x"), 1), fixed(F.col("x"), 2)).collect()
    assert [tuple(r) for r in got] == [("7.2", "7.25"), ("7.4", "7.35"), ("0.1", "0.12"), ("11.0", "11.00")]


def test_bed_and_vcf(spark, tmp_path):
    df = spark.createDataFrame([(0, "c", "A" * 5 + "CG" * 4 + "TTT"), (1, "d", "ACGT")], "seq_ord bigint, chrom string, seq string")
    repeats = tiers.all_repeats(sequences(df), enumerate_motifs(spark, [1, 2, 3]))
    bed = [r["line"] for r in lines(repeats, "bed").orderBy("line_no").collect()]
    assert bed == [*BED_HEADER, "c\t0\t5\tA\t5.0\t1", "c\t13\t16\tT\t3.0\t1", "c\t5\t13\tCG\t4.0\t1"]
    vcf = [r["line"] for r in lines(longest(repeats, 2, ["seq_ord"]), "vcf", per=["seq_ord"]).orderBy("line_no").collect()]
    assert vcf == [*VCF_HEADER, "c\t6\tTR0\t.\t<TR>\t.\tPASS\tMOTIF=CG;COPIES=4.0;TIER=1;CONF=1.00", "c\t1\tTR1\t.\t<TR>\t.\tPASS\tMOTIF=A;COPIES=5.0;TIER=1;CONF=1.00"]
    assert longest(repeats, 0, ["seq_ord"]).count() == 3
    write_lines(repeats, "bed", str(tmp_path / "out"))
    (part,) = glob.glob(str(tmp_path / "out/part-*"))
    assert open(part).read().splitlines() == bed
    with pytest.raises(ValueError):
        lines(repeats, "gff")
