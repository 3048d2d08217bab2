import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as contract  # noqa: E402

CORE = [
    "sequence_stats", "char_cumulative", "motif_usage", "canonical_motifs", "primitive_flag", "primitive_roots", "pattern_count", "pattern_locate", "tier1_str", "tier1_unfiltered_runs", "tier2_runs",
    "tier2_repeats", "read_windows", "window_periodicity", "anchor_map", "tier3_calls", "tier3_consolidated", "all_repeats", "tier_summary", "top_repeats_by_length", "bed_lines", "vcf_lines",
    "suffix_array", "sa_interval", "occ_rank", "lcp_array", "lcp_plateaus", "sa_progressions_10", "tier3_other_reads", "called_motif_count", "called_motif_interval", "left_bases", "vcf_lines_all", "fasta_file", "fastq_file", "p1_found", "p1_key_stats", "p5_found", "p5_periods",
]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def compare(spark, folder, name):
    frame = contract.queries()[name](spark, folder)
    columns = sorted(frame.columns)
    ours = sorted([tuple(plain(x) for x in r) for r in frame.select(columns).collect()], key=repr)
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"create view {file.split('.')[0]} as select * from '{folder}/{file}'")
    result = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted([tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()], key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", CORE)
def test_core_query_agrees_with_sql(spark, data, name):
    compare(spark, data, name)


def test_entry_and_names(spark, data):
    assert contract.entry(spark).limit(5).count() == 5
    assert set(contract.oracle_sql()) <= set(contract.queries())
