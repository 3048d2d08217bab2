from test_entry import compare

import __spark_entry__ as contract
from motifmill.sources.tables import table


def test_all_motifs_are_located(spark, data):
    compare(spark, data, "pattern_locate_all")
    motifs = [r["motif"] for r in table(spark, data, "motif_dictionary").collect()]
    texts = {r["seq_ord"]: (r["seq"] or "").upper() for r in table(spark, data, "fasta").orderBy("seq_ord").limit(20).collect()}
    want = {(i, m, p) for i, t in texts.items() for m in motifs for p in range(len(t)) if t.startswith(m, p)}
    got = contract.queries()["pattern_locate_all"](spark, data).where(f"seq_ord in ({', '.join(map(str, texts))})").select("seq_ord", "motif", "pos").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {len(m) for _, m, _ in want} >= {1, 2, 3}


def test_every_repeat_has_a_vcf_line(spark, data):
    compare(spark, data, "vcf_lines_all")
    run = contract.queries()
    lines, bed = (run[n](spark, data).where("line_no >= 0").groupBy("seq_ord").count() for n in ("vcf_lines_all", "bed_lines"))
    assert {tuple(r) for r in lines.collect()} == {tuple(r) for r in bed.collect()}
    assert lines.where("count > 20").count() > 0
