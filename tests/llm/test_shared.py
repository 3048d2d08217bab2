import random

from motifmill.llm.shared import maximal_spans, shared_bases, sharing_classes, sharing_pairs

SPAN, K = 30, 12


def texts():
    rng = random.Random(8)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    common, long = base(45), base(150)
    out = [base(80) + common + base(60), common + base(20), base(10) + common[:29] + base(30), long, base(33) + long[20:120].lower() + "N" + long[121:] + base(5), long, "n" * 40, "", None, "ACG", base(40) + "AC" * 40, "AC" * 25 + base(20)]
    out += [common[:SPAN], common[3 : 3 + SPAN], "R".join([common[:20], common[20:]]), "ac" * 15, long + "$"]
    for _ in range(12):
        parts = [rng.choice([common, long, base(25)]) for _ in range(rng.randint(1, 3))]
        cut = "".join(p[rng.randint(0, 20) : len(p) - rng.randint(0, 20)] for p in parts)
        i = rng.randrange(len(cut))
        out.append(cut[:i] + rng.choice("ACGTN") + cut[i + 1 :])
    return out


def windows(text):
    t = (text or "").upper()
    return {t[i : i + SPAN]: None for i in range(len(t) - SPAN + 1) if not set(t[i : i + SPAN]) - set("ACGT")}


def frame(spark, rows):
    return spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, record bigint, representative string")


def test_pairs_agree_with_all_windows(spark):
    rows = list(enumerate(texts()))
    held = {i: set(windows(t)) for i, t in rows}
    want = {(a, b) for a in held for b in held if a < b and held[a] & held[b]}
    got = sharing_pairs(frame(spark, rows), "record", "text", SPAN, K).collect()
    assert len(got) == len(want) and {(r["record_a"], r["record_b"]) for r in got} == want


def test_shared_bases_agree_with_all_windows(spark):
    rows = list(enumerate(texts()))
    holders = {}
    for i, t in rows:
        for w in windows(t):
            holders.setdefault(w, set()).add(i)
    got = {r["record"]: (r["n_bases"], r["shared_bases"]) for r in shared_bases(frame(spark, rows), "record", "text", SPAN, K).collect()}
    for i, t in rows:
        u, covered = (t or "").upper(), set()
        for p in range(len(u) - SPAN + 1):
            if len(holders.get(u[p : p + SPAN], ())) > 1:
                covered |= set(range(p, p + SPAN))
        assert got[i] == (len(u), len(covered)), t


def test_spans_are_maximal_and_complete(spark):
    rows = list(enumerate(texts()))
    text = {i: (t or "").upper() for i, t in rows}
    pairs, classes = sharing_classes(frame(spark, rows), "record", "text", SPAN, K)
    chosen = {r["record"] for r in classes.collect() if r["record"] == r["representative"]}
    clean = lambda c: c in "ACGT"
    want = set()
    for a in chosen:
        for b in chosen:
            if a >= b:
                continue
            for shift in range(-len(text[a]), len(text[b])):
                run = 0
                for i in range(len(text[a]) + 1):
                    j = i + shift
                    if i < len(text[a]) and 0 <= j < len(text[b]) and text[a][i] == text[b][j] and clean(text[a][i]):
                        run += 1
                        continue
                    if run >= SPAN:
                        want.add((a, b, i - run, j - run, run))
                    run = 0
    got = {tuple(r) for r in maximal_spans(frame(spark, rows), "record", "text", SPAN, K).collect()}
    assert got == want
    assert {(r["record_a"], r["record_b"]) for r in pairs.collect()} == {w[:2] for w in want}


def test_empty(spark):
    df = frame(spark, [])
    assert sharing_pairs(df, "record", "text").count() == 0 and shared_bases(df, "record", "text").count() == 0
