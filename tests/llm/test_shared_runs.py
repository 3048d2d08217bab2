import random

from motifmill.llm.shared import maximal_spans, seed_matches, seed_rows, sharing_pairs

SPAN, K = 30, 12


def texts():
    rng = random.Random(3)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    unit, long, wide = "ACGGT", base(23), base(41)
    return [base(40) + unit * 60 + base(40), unit * 35 + base(20), base(9) + unit * 50 + "N" + unit * 20, base(15) + long * 9 + base(8), long * 6 + "T", wide * 5 + base(4), base(5) + wide * 4, (unit * 4 + "AC" + unit * 9) * 4]


def frame(spark):
    return spark.createDataFrame(list(enumerate(texts())), "record bigint, text string")


def want(t):
    out = set()
    for a in range(len(t)):
        for b in range(a + 1, len(t)):
            for shift in range(-len(t[a]), len(t[b])):
                run = 0
                for i in range(len(t[a]) + 1):
                    j = i + shift
                    if i < len(t[a]) and 0 <= j < len(t[b]) and t[a][i] == t[b][j] != "N":
                        run += 1
                        continue
                    if run >= SPAN:
                        out.add((a, b, i - run, j - run, run))
                    run = 0
    return out


def test_spans_of_arrays_are_whole(spark):
    expected = want(texts())
    got = [tuple(r) for r in maximal_spans(frame(spark), "record", "text", SPAN, K).collect()]
    assert len(got) == len(expected) and set(got) == expected
    pairs = [tuple(r) for r in sharing_pairs(frame(spark), "record", "text", SPAN, K).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {w[:2] for w in expected}


def test_copies_in_arrays_are_not_paired_one_by_one(spark):
    two = spark.createDataFrame([(0, "ACGGT" * 600), (1, "ACGGT" * 500)], "record bigint, text string")
    assert seed_matches(two, "record", "text", SPAN, K).count() < 600 * 500 / 10
    assert seed_rows(two, "record", "text", SPAN, K).count() < 40
    assert seed_matches(two, "record", "text", SPAN, K, places=False).count() < 400
