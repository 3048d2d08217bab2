import glob

from motifmill import cli


def read(pattern):
    return [line for f in sorted(glob.glob(pattern)) for line in open(f).read().splitlines()]


def test_find_and_split(spark, tmp_path, capsys):
    fasta = tmp_path / "ref.fa"
    fasta.write_text(">c1 x\nAAAAACGCGCGCGTT\n>c2\n" + "TCATCGG" * 5 + "\n")
    cli.run(["find", str(fasta), "-o", str(tmp_path / "out"), "--format", "both"])
    bed = read(str(tmp_path / "out.bed/part-*"))
    assert bed[2:4] == ["c1\t0\t5\tA\t5.0\t1", "c1\t13\t15\tT\t2.0\t1"] and "c2\t0\t35\tTCATCGG\t5.0\t2" in bed
    assert len(read(str(tmp_path / "out.vcf/part-*"))) == len(bed) + 4
    assert "tier 2: 1 repeats" in capsys.readouterr().out
    cli.run(["find", str(fasta), "-o", str(tmp_path / "per"), "--format", "vcf", "--tier1", "--per-sequence", "--vcf-top", "1"])
    assert len(read(str(tmp_path / "per.vcf/chrom=c1/part-*"))) == 7
    cli.run(["find", str(fasta), "-o", str(tmp_path / "none"), "--tier3"])
    assert len(read(str(tmp_path / "none.bed/part-*"))) == 2
    cli.run(["split", str(fasta), "-o", str(tmp_path / "seqs")])
    assert read(str(tmp_path / "seqs/chrom=c2/part-*"))[0] == ">c2"


def test_longest_come_first_in_vcf(spark, tmp_path):
    fasta = tmp_path / "ref.fa"
    fasta.write_text(">c1\nGGACACTTTATATATATATATATATGCGCGCGCTA\n>c2\nCCCCCAGG\n")
    cli.run(["run", str(fasta), "-o", str(tmp_path / "run"), "--vcf-top", "2"])
    rows = [line.split("\t") for line in read(str(tmp_path / "run.vcf/chrom=c1/part-*"))[6:]]
    assert [r[2] for r in rows] == ["TR0", "TR1"]
    lengths = [len(m) * float(c) for m, c in ((x.split("=")[1] for x in r[7].split(";")[:2]) for r in rows)]
    assert lengths == sorted(lengths, reverse=True) and lengths[0] > lengths[1]
    assert [r.split("\t")[2] for r in read(str(tmp_path / "run.vcf/chrom=c2/part-*"))[6:]] == ["TR0", "TR1"]
    bed = read(str(tmp_path / "run.bed/chrom=c1/part-*"))
    assert len(bed) > 4 and all(line.endswith("\t1") for line in bed[2:])
    cli.run(["find", str(fasta), "-o", str(tmp_path / "one"), "--format", "vcf", "--tier1", "--vcf-top", "2"])
    whole = [line.split("\t") for line in read(str(tmp_path / "one.vcf/part-*"))[6:]]
    assert [(r[0], r[2]) for r in whole] == [("c1", "TR0"), ("c1", "TR1"), ("c2", "TR2"), ("c2", "TR3")]


def test_lifted_cap_and_synthetic(spark, tmp_path, capsys):
    fasta = tmp_path / "ref.fa"
    unit = "ACGTTGCAAGCTAGGATCCATTGCAGTACCGATTAGCCATGACTTGACCAGTTACGGATACTTGCA"
    unit += "GGATC"
    fasta.write_text(f">c1\n{unit * 3}\n")
    for flags, n in (([], 0), (["--lift-cap"], 1)):
        cli.run(["find", str(fasta), "-o", str(tmp_path / "out"), "--tier2", *flags])
        assert sum(line.split("\t")[3] == unit for line in read(str(tmp_path / "out.bed/part-*"))[2:]) == n
    cli.run(["synthetic", "-o", str(tmp_path / "syn")])
    assert "122-142: (ATGC) x 5.0, tier 1" in capsys.readouterr().out
    assert len(read(str(tmp_path / "syn/synthetic.bed/part-*"))) == 9
