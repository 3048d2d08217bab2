import random

import pytest
from pyspark.sql import functions as F

from motifmill.operators import tiers
from motifmill.operators.kmers import chunks, kmers, sequences
from motifmill.operators.runs import period_runs
from motifmill.plans.repeats import enumerate_motifs


@pytest.fixture(scope="module")
def motifs(spark):
    return enumerate_motifs(spark, [1, 2, 3, 4, 5, 6]).cache()


def seqs(spark, texts):
    return sequences(spark.createDataFrame([(i, f"c{i}", t) for i, t in enumerate(texts)], "seq_ord bigint, chrom string, seq string"))


def random_texts(n, seed, alphabet="ACGTN$R"):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 6)):
            unit = "".join(rng.choice(alphabet[:4] if rng.random() < 0.8 else alphabet) for _ in range(rng.randint(1, 14)))
            parts.append(unit * rng.randint(1, 5) + unit[: rng.randint(0, len(unit))])
        out.append("".join(parts))
    return out


def naive_tier1(text, words):
    full, out = text + "$", []
    for m in words:
        k, places = len(m), [i for i in range(len(full) - len(m) + 1) if full.startswith(m, i)]
        held = set(places)
        for i in places:
            if i - k in held:
                continue
            copies = 1
            while i + copies * k in held:
                copies += 1
            end = i + copies * k
            if copies >= 2 and not (i > 0 and full[i - 1] == m[-1]) and full[end] != m[0]:
                out.append((i, end, m, float(copies)))
    return sorted(out)


def naive_tier2(text, low, high):
    n, out, seen = len(text), [], set()
    for p in range(low, min(high, max(64, low), max(1, n // 2)) + 1):
        i = 0
        while i + 2 * p <= n:
            unit = text[i : i + p]
            j = i + p
            if set(unit) & set("N$"):
                i += 1
                continue
            while text[j : j + p] == unit:
                j += p
            if j - i < 2 * p:
                i += 1
                continue
            q = next(d for d in range(1, p + 1) if p % d == 0 and unit[:d] * (p // d) == unit)
            root, start, end = unit[:q], i, j
            while start >= q and text[start - q : start] == root:
                start -= q
            while text[end : end + q] == root:
                end += q
            if (start, end, root) not in seen:
                seen.add((start, end, root))
                out.append((start, end, root, float((end - start) // q)))
            i = end
    return sorted(out)


def test_golden_short_repeats_in_order(spark, motifs):
    text = "A" * 10 + "AT" * 8 + "G" * 10 + "CA" * 9 + "T" * 10 + "AGC" * 6 + "C" * 10 + "AGTC" * 5 + "N" * 10 + "ATGC" * 5 + "$"
    got = tiers.all_repeats(seqs(spark, [text]), motifs).orderBy(*tiers.EMISSION).collect()
    assert [(r["start"], r["end"], r["motif"], r["copies"], r["tier"], r["confidence"]) for r in got] == [
        (0, 11, "A", 11.0, 1, 1.0),
        (81, 92, "C", 11.0, 1, 1.0),
        (26, 36, "G", 10.0, 1, 1.0),
        (54, 64, "T", 10.0, 1, 1.0),
        (10, 26, "AT", 8.0, 1, 1.0),
        (64, 82, "AGC", 6.0, 1, 1.0),
        (122, 142, "ATGC", 5.0, 1, 1.0),
    ]


@pytest.mark.parametrize("unit, copies", [("TCATCGG", 5), ("ACCCCTCAGGGT", 7), ("TGACTATATCCGCAAATGAAGGCTGTTCTCTGACA", 35)])
def test_golden_medium_repeats(spark, unit, copies):
    got = tiers.tier2(seqs(spark, [unit * copies])).collect()
    assert [(r["start"], r["end"], r["motif"], r["copies"], r["length"], r["tier"], r["confidence"]) for r in got] == [(0, len(unit) * copies, unit, float(copies), len(unit) * copies, 2, 0.95)]


def test_tier1_agrees_with_naive_scan(spark, motifs):
    texts = [*random_texts(60, 1), "", None, "A", "acacacNNNN"]
    words = [r["motif"] for r in motifs.collect()]
    got = {}
    for r in tiers.tier1(seqs(spark, texts), motifs).collect():
        got.setdefault(r["seq_ord"], []).append((r["start"], r["end"], r["motif"], r["copies"]))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == naive_tier1((t or "").upper(), words), t


def test_tier2_agrees_with_naive_scan(spark):
    texts = [*random_texts(80, 2), *random_texts(40, 5, "ACACAC"), "", None, "N" * 80]
    for low, high in ((2, 12), (10, 1000)):
        got = {}
        for r in tiers.tier2(seqs(spark, texts), low, high).collect():
            got.setdefault(r["seq_ord"], []).append((r["start"], r["end"], r["motif"], r["copies"]))
        for i, t in enumerate(texts):
            assert sorted(got.get(i, [])) == naive_tier2((t or "").upper(), low, high), t


def test_runs_are_stitched_over_chunks(spark):
    texts = ["ACGT" * 50 + "TTTTT" + "AC" * 70, "A" * 300, *random_texts(10, 9)]
    s = seqs(spark, texts)
    whole = {tuple(r) for r in period_runs(s, 1, 8).collect()}
    cut = period_runs(s, 1, 8, chunk=16).collect()
    assert len(cut) == len(whole) and {tuple(r) for r in cut} == whole


def test_chunks_and_kmers_cover_every_place(spark):
    s = seqs(spark, ["ACGTACGTACG", "", None])
    assert [(r["base"], r["left"], r["chunk"], r["body_len"]) for r in chunks(s, 2, 4).orderBy("base").collect()] == [(0, "", "ACGTAC", 4), (4, "T", "ACGTAC", 4), (8, "T", "ACG", 3)]
    got = {(r["pos"], r["kmer"]) for r in kmers(s, 2, 3, size=4).collect()}
    assert got == {(i, "ACGTACGTACG"[i : i + k]) for k in (2, 3) for i in range(12 - k)}


def naive_period(window):
    best, found = 0, None
    for p in range(10, len(window) // 3):
        score = sum(window[i] == window[i % p] for i in range(len(window))) / len(window)
        if score > best and score > 0.7:
            best, found = score, (window[:p], len(window) // p, score)
    return found


def long_reads():
    rng = random.Random(4)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    unit, left, right = base(23), base(300), base(700)
    array = "".join(c if rng.random() > 0.03 else rng.choice("ACGT") for c in unit * 40)
    locus = left + array + right
    return [locus, base(100) + locus, locus[:999], locus.lower(), base(1500), None, ""], base(50) + locus + base(50)


def test_windows_and_periods(spark):
    reads, _ = long_reads()
    df = spark.createDataFrame(list(enumerate(reads)), "read_idx bigint, read_seq string")
    got = {(r["read_idx"], r["win_start"]): (r["motif"], r["copies"], round(r["confidence"], 9)) for r in tiers.window_periodicity(df).collect()}
    want = {}
    for i, read in enumerate(reads):
        read = (read or "").upper()
        for start in range(0, len(read) - 500, 100) if len(read) >= 1000 else ():
            found = naive_period(read[start : start + 500])
            if found:
                want[i, start] = (found[0], found[1], round(found[2], 9))
    assert got == want and len(want) > 3


def naive_tier3(reads, text):
    calls = []
    for i, read in enumerate(reads):
        read = (read or "").upper()
        for start in range(0, len(read) - 500, 100) if len(read) >= 1000 else ():
            found, anchor = naive_period(read[start : start + 500]), read[max(0, start - 50) : start]
            if found and len(anchor) >= 20:
                hits = [j for j in range(len(text)) if text.startswith(anchor, j)]
                if len(hits) == 1:
                    at = hits[0] + len(anchor)
                    calls.append((at, at + len(found[0]) * found[1], i, start, *found))
    out = []
    for s, e, _, _, motif, copies, score in sorted(calls):
        if out and s <= out[-1][1] and motif == out[-1][2]:
            a = out[-1]
            out[-1] = (min(a[0], s), max(a[1], e), motif, (a[3] + copies) / 2, min(a[4], score))
        else:
            out.append((s, e, motif, float(copies), score))
    return sorted((s, e, m, round(c, 9), round(f, 9)) for s, e, m, c, f in out)


def test_tier3_agrees_with_naive_scan(spark):
    reads, text = long_reads()
    df = spark.createDataFrame(list(enumerate(reads)), "read_idx bigint, read_seq string")
    got = tiers.tier3(seqs(spark, [text, "ACGT" * 30, ""]), df).where("seq_ord = 0").collect()
    assert sorted((r["start"], r["end"], r["motif"], round(r["copies"], 9), round(r["confidence"], 9)) for r in got) == naive_tier3(reads, text)
    assert got


def test_merge_halves_copies_pairwise(spark):
    rows = [(0, 0, 0, 0, 100, "AC", 4.0, 0.9), (0, 1, 0, 50, 120, "AC", 8.0, 0.8), (0, 2, 0, 120, 130, "AC", 2.0, 0.95), (0, 3, 0, 125, 140, "AG", 2.0, 0.9), (0, 4, 0, 126, 150, "AC", 2.0, 0.7)]
    calls = spark.createDataFrame(rows, "seq_ord bigint, read_idx bigint, win_start bigint, start bigint, end bigint, motif string, copies double, confidence double")
    got = [(r["start"], r["end"], r["motif"], r["copies"], r["confidence"], r["length"]) for r in tiers.consolidate(calls).orderBy("start").collect()]
    assert got == [(0, 130, "AC", 4.0, 0.8, 130), (125, 140, "AG", 2.0, 0.9, 15), (126, 150, "AC", 2.0, 0.7, 24)]


def test_no_tier_and_no_rows(spark, motifs):
    s = seqs(spark, ["ACACAC"])
    assert tiers.all_repeats(s, motifs, use_tier1=False, use_tier2=False).count() == 0
    assert tiers.all_repeats(s.where(F.lit(False)), motifs).count() == 0
