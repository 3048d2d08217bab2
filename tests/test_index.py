import random

from pyspark.sql import functions as F

from motifmill.operators import index, patterns
from motifmill.operators.kmers import sequences

TEXTS = ["", None, "A", "ACACACACACAC", "N" * 70 + "ACGT", "".join(random.Random(1).choice("ACGT") for _ in range(300)), "ACGTTGCAAC" * 12, "AC$GT", "T" + "GAAGTTTATACGAAATCGGT" * 6 + "CC", ("GATTACAGATTACAGGCAT" * 5 + "TT") * 3]


def seqs(spark):
    return sequences(spark.createDataFrame([(i, f"c{i}", t) for i, t in enumerate(TEXTS)], "seq_ord bigint, chrom string, seq string"))


def suffixes(text):
    full = (text or "") + "$"
    return full, sorted(range(len(full)), key=lambda i: full[i:])


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_suffix_array_bwt_and_ranks(spark):
    s = seqs(spark)
    sa = {(r["seq_ord"], r["rank"]): r["pos"] for r in index.suffix_array(s).collect()}
    last = {(r["seq_ord"], r["rank"]): (r["ch"], r["occ"], r["lf"]) for r in index.occurrence_ranks(s).collect()}
    for i, t in enumerate(TEXTS):
        full, order = suffixes(t)
        assert [sa[i, k] for k in range(len(full))] == order
        row = {p: k for k, p in enumerate(order)}
        chars = [full[p - 1] for p in order]
        for k, p in enumerate(order):
            ch, occ, lf = last[i, k]
            assert ch == chars[k] and occ == chars[:k].count(ch)
            if full.count("$") == 1:
                assert lf == row[(p - 1) % len(full)]


def test_checkpoints_and_samples(spark):
    s = seqs(spark)
    got = {(r["seq_ord"], r["ch"], r["prefix"]): r["occ"] for r in index.occurrence_checkpoints(s, 16).collect()}
    want = {}
    for i, t in enumerate(TEXTS):
        full, order = suffixes(t)
        chars = [full[p - 1] for p in order]
        for prefix in {*range(0, len(full), 16), len(full)}:
            for ch in set(full):
                want[i, ch, prefix] = chars[:prefix].count(ch)
    assert got == want
    assert {(r["seq_ord"], r["rank"], r["pos"]) for r in index.sampled(s, 32).collect()} == {(i, k, p) for i, t in enumerate(TEXTS) for k, p in enumerate(suffixes(t)[1]) if k % 32 == 0}


def test_lcp_and_plateaus(spark):
    s = seqs(spark)
    got = {(r["seq_ord"], r["rank"]): r["lcp"] for r in index.lcp_array(s).collect()}
    plateaus = {(r["seq_ord"], r["threshold"], r["first_rank"], r["last_rank"]) for r in index.lcp_plateaus(s).collect()}
    chains = sorted((r["seq_ord"], r["start"], r["end"], r["motif"], r["copies"]) for r in index.plateau_progressions(s).collect())
    want, want_chains = set(), []
    for i, t in enumerate(TEXTS):
        full, order = suffixes(t)
        lcp = [0, *(common(full[a:], full[b:]) for a, b in zip(order, order[1:]))]
        assert [got[i, k] for k in range(len(full))] == lcp
        if max(lcp) < 10:
            continue
        level, k = max(10, min(1000, max(lcp), 20)), 0
        while k < len(lcp):
            if lcp[k] < level:
                k += 1
                continue
            end = k
            while end < len(lcp) and lcp[end] >= level:
                end += 1
            want.add((i, level, k, end - 1))
            places = sorted(order[k:end])
            for j, p in enumerate(places):
                copies = 1
                while j + copies < len(places) and places[j + copies] == p + copies * level:
                    copies += 1
                if copies >= 2:
                    want_chains.append((i, p, p + copies * level, full[p : p + level], float(copies)))
            k = end
    assert plateaus == want and want
    assert chains == sorted(want_chains) and want_chains


def test_intervals_counts_and_places(spark):
    s = seqs(spark)
    motifs = spark.createDataFrame([("AC", 2), ("A", 1), ("GATTAC", 6), ("TTTTT", 5)], "motif string, k int")
    ranges = {(r["seq_ord"], r["motif"]): (r["first_rank"], r["last_rank"]) for r in index.motif_intervals(s, motifs).collect()}
    counts = {(r["seq_ord"], r["motif"]): r["n"] for r in patterns.motif_counts(s, motifs).collect()}
    places = {(r["seq_ord"], r["motif"], r["pos"]) for r in patterns.motif_places(s, motifs).collect()}
    for i, t in enumerate(TEXTS):
        full, order = suffixes(t)
        for m in ("AC", "A", "GATTAC", "TTTTT"):
            hits = [k for k, p in enumerate(order) if full.startswith(m, p)]
            assert ranges.get((i, m)) == ((hits[0], hits[-1]) if hits else None)
            assert counts.get((i, m), 0) == len(hits)
            assert {p for a, b, p in places if (a, b) == (i, m)} == {order[k] for k in hits}
    assert patterns.motif_places(s, motifs.where("false")).count() == 0


def test_character_counts(spark):
    got = {(r["seq_ord"], r["ch"]): (r["total"], r["cumulative"]) for r in index.char_counts(index.indexed_text(seqs(spark))).collect()}
    assert got == {(i, ch): ((t or "").count(ch) + (ch == "$"), sum(x < ch for x in (t or "") + "$")) for i, t in enumerate(TEXTS) for ch in set((t or "") + "$")}


def test_ranks_of_any_character_at_any_place(spark):
    s = seqs(spark)
    asked = [(i, ch, place) for i in range(len(TEXTS)) for ch in ("A", "N", "$", "Q") for place in (-3, 0, 1, 5, 64, 5000)] + [(0, None, 3), (None, "A", 3), (1, "A", None), (1, "A", 2), (1, "A", 2)]
    wanted = spark.createDataFrame(asked, "seq_ord bigint, ch string, place bigint")
    got = sorted(((r["seq_ord"], r["ch"], r["place"], r["occ"]) for r in index.rank_lookups(s, wanted).collect()), key=repr)
    want = []
    for i, ch, place in asked:
        n = 0
        if None not in (i, ch, place):
            full, order = suffixes(TEXTS[i])
            n = [full[p - 1] for p in order][: max(place, 0)].count(ch)
        want.append((i, ch, place, n))
    assert got == sorted(want, key=repr)


def test_characters_before_motifs(spark):
    s = seqs(spark)
    motifs = spark.createDataFrame([("AC",), ("GATTAC",), ("G",)], "motif string")
    built = index.build(s)
    got = {(r["seq_ord"], r["motif"], r["ch"]): r["n"] for r in index.preceding_characters(built, index.motif_intervals(s, motifs, built)).collect()}
    want = {}
    for i, t in enumerate(TEXTS):
        full = "$" + (t or "")
        for m in ("AC", "GATTAC", "G"):
            for p in range(1, len(full)):
                if full.startswith(m, p):
                    want[i, m, full[p - 1]] = want.get((i, m, full[p - 1]), 0) + 1
    assert got == want


def test_long_patterns(spark, monkeypatch):
    s = seqs(spark)
    long = [TEXTS[5][40:140], "ACGTTGCAAC" * 5, "N" * 33, "GATTACAGATTACAGGCAT", "AC$G", "TTT", "", None]
    motifs = spark.createDataFrame([(m,) for m in [*long, "TTT"]], "motif string")

    def check():
        places = sorted((r["seq_ord"], r["motif"], r["pos"]) for r in patterns.motif_places(s, motifs).collect())
        assert places == sorted((i, m, p) for i, t in enumerate(TEXTS) for m in long if m for p in range(len(t or "")) if t.startswith(m, p))
        counts = {(r["seq_ord"], r["motif"]): r["n"] for r in patterns.motif_counts(s, motifs).collect()}
        assert sum(counts.values()) == len(places) and set(counts) == {p[:2] for p in places}
        return places

    places = check()
    ranges = {(r["seq_ord"], r["motif"]): (r["first_rank"], r["last_rank"]) for r in index.motif_intervals(s, motifs).collect()}
    assert set(ranges) == {p[:2] for p in places} | {(7, "AC$G")}
    for (i, m), (low, high) in ranges.items():
        full, order = suffixes(TEXTS[i])
        assert [k for k, p in enumerate(order) if full.startswith(m, p)] == list(range(low, high + 1))
    monkeypatch.setattr(patterns, "DICTIONARY", 3)
    check()


def test_runs_of_a_million_leave_no_ties_and_no_large_task(spark):
    n = 1_000_000
    table = sequences(spark.createDataFrame([(0, "c", "AC" + "N" * n + "GT"), (1, "d", "GA" * 30_000 + "C")], "seq_ord bigint, chrom string, seq string"))
    built = index.build(table)
    assert not built.levels
    ranks = {r["pos"]: r["rank"] for r in built.table.where("seq_ord = 0 and pos in (0, 1, 2, 3, 500000, 1000001, 1000002, 1000003, 1000004)").collect()}
    # '$' < A < C < G < N, and of two runs of N the shorter is the lesser, as G ends it; then T
    assert ranks == {1000004: 0, 0: 1, 1: 2, 1000002: 3, 1000001: 4, 500000: 4 + 500001, 3: 4 + 999998, 2: 4 + 999999, 1000003: n + 4}
    sizes = [r["count"] for r in built.table.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes)
    lcp = {(r["seq_ord"], r["pos"]): r["lcp"] for r in index.lcp_array(built).where("pos in (2, 3, 500000)").collect()}
    assert lcp[0, 2] == n - 1 and lcp[0, 500000] == 1000002 - 500001


def test_long_repeats_are_told_apart(spark):
    rng = random.Random(12)
    block, other = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (1500, 400))
    texts = [block + "T" + block + other + block[:700] + other, other * 4, (block[:90] * 9 + "G") * 2]
    built = index.build(sequences(spark.createDataFrame([(i, "c", t) for i, t in enumerate(texts)], "seq_ord bigint, chrom string, seq string")))
    assert len(built.levels) >= 3
    sa = {(r["seq_ord"], r["rank"]): r["pos"] for r in index.suffix_array(built).collect()}
    lcp = {(r["seq_ord"], r["rank"]): r["lcp"] for r in index.lcp_array(built).collect()}
    for i, t in enumerate(texts):
        full, order = suffixes(t)
        assert [sa[i, k] for k in range(len(full))] == order
        assert [lcp[i, k] for k in range(len(full))] == [0, *(common(full[a:], full[b:]) for a, b in zip(order, order[1:]))]


def test_many_patterns_are_counted_without_exploding_texts(spark, monkeypatch):
    rng = random.Random(5)
    texts = [*TEXTS, "".join(rng.choice("ACGT") for _ in range(3000)), "CAG" * 100]
    words = sorted({t[i : i + k] for t in texts if t for k in (1, 2, 6, 9, 13, 30, 70) for i in range(0, len(t) - k + 1, 7)} | {"ACGTACGTACGTACGTT", "Q", "N" * 200})
    motifs = spark.createDataFrame([(w,) for w in words], "motif string")
    s = sequences(spark.createDataFrame([(i, "c", t) for i, t in enumerate([*texts, texts[5]])], "seq_ord bigint, chrom string, seq string"))
    twice = s.withColumn("seq_ord", F.when(F.col("seq_ord") == len(texts), 5).otherwise(F.col("seq_ord")))
    want = {(i, w): n for i, t in enumerate(texts) for w in words if (n := sum((t or "").startswith(w, p) for p in range(len(t or ""))))}

    def check(rows, times=1):
        got = [(r["seq_ord"], r["motif"], r["n"]) for r in rows.collect() if r["seq_ord"] < len(texts)]
        assert len(got) == len(want) and {g[:2]: g[2] for g in got} == {k: n * (times if k[0] == 5 else 1) for k, n in want.items()}

    check(patterns.motif_counts(s, motifs))
    check(patterns.motif_counts(twice, motifs), 2)
    monkeypatch.setattr(patterns, "DICTIONARY", 100)
    monkeypatch.setattr(patterns, "CHUNK", 128)
    counts = patterns.motif_counts(s, motifs)
    check(counts)
    assert "Generate" not in counts._jdf.queryExecution().toString()


def test_intervals_of_whole_texts_need_no_index(spark, monkeypatch):
    rng = random.Random(8)
    texts = [*TEXTS, "".join(rng.choice("ACGTRYKMSW") for _ in range(500)), "ACG" * 200 + "AC", "N" * 900, "\0A\0\0AC!", "".join(rng.choice("AC") for _ in range(700))]
    words = sorted({t[i : i + k] for t in texts if t for k in (1, 2, 5, 8, 9, 13, 40) for i in range(0, len(t) - k + 1, 5)} | {"T$", "$", "Q"})
    s = sequences(spark.createDataFrame([(i, "c", t) for i, t in enumerate(texts)], "seq_ord bigint, chrom string, seq string")).repartition(1)
    motifs = spark.createDataFrame([(w,) for w in words], "motif string")
    want = {}
    for i, t in enumerate(texts):
        full, order = suffixes(t)
        for k, p in enumerate(order):
            for w in words:
                if full.startswith(w, p) and p + len(w) < len(full):
                    want.setdefault((i, w), []).append(k)
    want = {x: (ks[0], ks[-1]) for x, ks in want.items()}
    build = index.build
    monkeypatch.setattr(index, "build", None)
    got = index.motif_intervals(s, motifs).collect()
    assert len(got) == len(want) and {(r["seq_ord"], r["motif"]): (r["first_rank"], r["last_rank"]) for r in got} == want
    monkeypatch.setattr(index, "build", build)
    monkeypatch.setattr(index, "WHOLE", 300)
    acgt = [i for i, t in enumerate(texts) if t and "\0" not in t]
    got = index.motif_intervals(s.where(F.col("seq_ord").isin(acgt)), motifs.where("not contains(motif, '$')")).collect()
    assert {(r["seq_ord"], r["motif"]): (r["first_rank"], r["last_rank"]) for r in got} == {x: r for x, r in want.items() if x[0] in acgt and "$" not in x[1]}


def test_characters_before_motifs_need_no_index(spark, monkeypatch):
    texts = [*TEXTS, "".join(random.Random(9).choice("ACGTN") for _ in range(2000)), "GAC" * 150]
    s = sequences(spark.createDataFrame([(i, "c", t) for i, t in enumerate(texts)], "seq_ord bigint, chrom string, seq string"))
    words = ["A", "AC", "GATTAC", "G", "ACGTTGCAACACG", "NNN", "", None, "Q"]
    motifs = spark.createDataFrame([(w,) for w in words], "motif string")
    want = {}
    for i, t in enumerate(texts):
        full = "$" + (t or "")
        for m in filter(None, words):
            for p in range(1, len(full)):
                if full.startswith(m, p):
                    want[i, m, full[p - 1]] = want.get((i, m, full[p - 1]), 0) + 1
    for size in (patterns.CHUNK, 64):
        monkeypatch.setattr(patterns, "CHUNK", size)
        got = patterns.preceding_characters(s, motifs).collect()
        assert len(got) == len(want) and {(r["seq_ord"], r["motif"], r["ch"]): r["n"] for r in got} == want


def test_left_bases_builds_no_index(spark, data, monkeypatch):
    from motifmill.plans import repeats

    monkeypatch.setattr(index, "build", None)
    monkeypatch.setattr(repeats, "_INDEXES", {})
    assert not repeats.left_bases(spark, data).isEmpty()
