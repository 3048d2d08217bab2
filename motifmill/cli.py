"""Command line: ``python -m motifmill.cli find REF.fa -o OUT``; likewise ``run``, ``split`` and ``synthetic``."""

from __future__ import annotations

import argparse
import os

from motifmill.operators import tiers
from motifmill.operators.kmers import sequences
from motifmill.operators.ordering import number_rows
from motifmill.plans.repeats import enumerate_motifs
from motifmill.session import build_session, ship_package
from motifmill.sources.fasta import read_fasta, read_long_reads, split_fasta
from motifmill.sources.formats import longest, write_lines

#: The blocks of the synthetic sequence.
SYNTHETIC = [("A", 10), ("AT", 8), ("G", 10), ("CA", 9), ("T", 10), ("AGC", 6), ("C", 10), ("AGTC", 5), ("N", 10), ("ATGC", 5)]


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="motifmill")
    commands = main.add_subparsers(dest="command", required=True)
    find = commands.add_parser("find", help="find tandem repeats and write BED or VCF")
    per_file = commands.add_parser("run", help="the same for each sequence by itself: tier 1 unless told otherwise, the 20 longest in VCF")
    for command in (find, per_file):
        command.add_argument("reference", help="FASTA files, a path or pattern")
        command.add_argument("-o", "--output", default="tandem_repeats")
        command.add_argument("--format", choices=["bed", "vcf", "both"], default="bed" if command is find else "both")
        for n in (1, 2, 3):
            command.add_argument(f"--tier{n}", action=argparse.BooleanOptionalAction, default=command is per_file and n == 1)
        command.add_argument("--long-reads", help="FASTA or FASTQ reads for tier 3")
        command.add_argument("--reads-format", choices=["fasta", "fastq", "compat"], default="fasta")
        command.add_argument("--per-sequence", action="store_true", default=command is per_file, help="one folder for each sequence")
        command.add_argument("--vcf-top", type=int, default=0 if command is find else 20, help="longest repeats of each sequence in VCF; 0 keeps all")
        command.add_argument("--max-motif", type=int, default=6)
        command.add_argument("--min-period", type=int, default=10)
        command.add_argument("--max-period", type=int, default=1000)
        command.add_argument("--lift-cap", action="store_true", help="let tier 2 go beyond periods of 64, up to --max-period")
    synthetic = commands.add_parser("synthetic", help="write a sequence of known repeats, find them and print them")
    synthetic.add_argument("-o", "--output", default="synthetic")
    split = commands.add_parser("split", help="write each record of a FASTA file by itself")
    split.add_argument("reference")
    split.add_argument("-o", "--output", default="sequences")
    return main


def run(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session()
    ship_package(spark)
    if args.command == "split":
        split_fasta(spark, args.reference, args.output)
        return
    if args.command == "synthetic":
        os.makedirs(args.output, exist_ok=True)
        path = os.path.join(args.output, "synthetic.fa")
        with open(path, "w") as out:
            out.write(">synthetic_chromosome\n" + "".join(unit * copies for unit, copies in SYNTHETIC) + "$\n")
        found = tiers.all_repeats(sequences(read_fasta(spark, path)), enumerate_motifs(spark, list(range(1, 7)))).persist()
        write_lines(found, "bed", os.path.join(args.output, "synthetic.bed"))
        for row in found.orderBy("start", "end").collect():  # a handful
            print(f"{row['start']}-{row['end']}: ({row['motif']}) x {row['copies']:.1f}, tier {row['tier']}")
        found.unpersist()
        return
    use = [args.tier1, args.tier2, args.tier3]
    if not any(use) and args.command == "find":
        use = [True, True, False]
    seqs = sequences(read_fasta(spark, args.reference))
    reads = None
    if use[2] and args.long_reads:
        reads = read_long_reads(spark, args.long_reads, "fasta" if args.reads_format == "compat" else args.reads_format, compat=args.reads_format == "compat")
    motifs = enumerate_motifs(spark, list(range(1, args.max_motif + 1)))
    found = tiers.all_repeats(seqs, motifs, reads, *use, max_k=args.max_motif, min_period=args.min_period, max_period=args.max_period, lift_cap=args.lift_cap).persist()
    per = ["chrom"] if args.per_sequence else None
    if args.format in ("bed", "both"):
        write_lines(found, "bed", f"{args.output}.bed", per)
    if args.format in ("vcf", "both"):
        kept = found
        if args.vcf_top > 0:
            kept = longest(found, args.vcf_top, ["seq_ord"])  # in order of length, which is also the order of the lines
            kept = kept if per else number_rows(kept.withColumnRenamed("_no", "_place"), ["seq_ord", "_place"], "_no")
        write_lines(kept, "vcf", f"{args.output}.vcf", per)
    for row in found.groupBy("tier").count().orderBy("tier").collect():
        print(f"tier {row['tier']}: {row['count']} repeats")
    found.unpersist()


if __name__ == "__main__":
    run()
