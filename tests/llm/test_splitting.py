import random
import re

from motifmill.llm.splitting import cuts, split_records

GAP = re.compile(r"[Nn]{10,}")


def sequences(n):
    rng = random.Random(6)
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 9)):
            parts.append("A" * rng.choice([0, 5, 50, 79, 80, 81, 90, 170, 300]))
            parts.append(rng.choice(["N", "n"]) * rng.choice([0, 9, 10, 12, 40, 200]))
        yield "".join(parts)


def test_cuts_keep_the_limit_and_are_free_where_possible():
    max_size, overlap = 100, 20
    own = max_size - overlap
    for text in [*sequences(600), "", "A" * 101, "N" * 1000, "A" * 100]:
        found = cuts(text, max_size, overlap, GAP)
        places = [0, *(c for c, _ in found), len(text)]
        if len(text) <= max_size:
            assert found == []
            continue
        assert places == sorted(set(places))
        assert all(b - a <= own for a, b in zip(places, places[1:])), text
        spans = [m.span() for m in GAP.finditer(text)]
        for c, kind in found:
            assert (kind == "gap") == any(s <= c <= e for s, e in spans) or kind == "forced"
        free = max(map(len, GAP.split(text))) <= own
        assert all(kind == "gap" for _, kind in found) == free, text


def least(text, own):
    """(forced cuts, pieces): as few forced cuts as can be, then as few pieces."""
    n, in_gap = len(text), set()
    for m in GAP.finditer(text):
        in_gap.update(range(m.start(), m.end() + 1))
    best = [(0, 0)]
    for i in range(1, n + 1):
        forced, pieces = min(best[max(0, i - own) : i])
        best.append((forced + (i < n and i not in in_gap), pieces + 1))
    return best[n]


def test_no_cut_is_forced_and_no_piece_made_without_need():
    for text in [*sequences(400), "A" * 5 + "N" * 10 + "C" * 500, "N" * 1000]:
        if len(text) > 100:
            found = cuts(text, 100, 20, GAP)
            assert (sum(kind == "forced" for _, kind in found), len(found) + 1) == least(text, 80), text


def test_many_gaps_take_linear_time():
    text = ("ACGT" * 30 + "N" * 12) * 30_000
    assert len(cuts(text, 5000, 200, GAP)) < len(text) / (4800 - 120)


def test_free_cuts_are_few_and_balanced():
    text = ("A" * 30 + "N" * 10) * 40
    found = cuts(text, 420, 20, GAP)
    assert len(found) == 3 and {k for _, k in found} == {"gap"}


def test_pieces_cover_and_overlap(spark):
    rows = [(i, t, "x") for i, t in enumerate([*sequences(60), "", "ACGT"])] + [(999, None, "x")]
    df = spark.createDataFrame(rows, "record bigint, text string, piece_no string")
    pieces = {}
    for r in split_records(df, "record", "text", 100, 20).collect():
        pieces.setdefault(r["record"], []).append(r)
    assert set(pieces) == {r[0] for r in rows} - {999}
    for record, text, _ in rows[:-1]:
        own = sorted(pieces[record], key=lambda r: r["piece_no"])
        assert all(r["piece"] == text[r["piece_start"] : r["piece_end"]] and len(r["piece"]) <= 100 for r in own)
        assert own[0]["piece_start"] == 0 and own[-1]["piece_end"] == len(text) and own[-1]["cut_kind"] == "end"
        for a, b in zip(own, own[1:]):
            assert b["piece_start"] == max(0, a["piece_end"] - 20)
            assert a["piece_start"] < b["piece_start"] and a["piece_end"] < b["piece_end"], text
