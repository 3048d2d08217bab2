from test_entry import compare
from test_shared import K, SPAN, frame, texts, windows

from motifmill.llm.shared import class_members, maximal_spans


def test_classes_agree_with_sql(spark, data):
    compare(spark, data, "p6_classes")


def test_spans_and_classes_give_every_pair(spark):
    rows = list(enumerate(texts()))
    held = {i: set(windows(t)) for i, t in rows}
    want = {(a, b) for a in held for b in held if a < b and held[a] & held[b]}
    members = class_members(frame(spark, rows), "record", "text", SPAN).collect()
    of = {}
    for r in members:
        of.setdefault(r["representative"], []).append(r["record"])
    spans = {(r["record_a"], r["record_b"]) for r in maximal_spans(frame(spark, rows), "record", "text", SPAN, K).collect()}
    got = {(min(a, b), max(a, b)) for x, y in spans for a in of[x] for b in of[y]}
    got |= {(a, r["record"]) for r in members if r["holds_span"] for a in of[r["representative"]] if a < r["record"]}
    assert got == want and len(members) == sum(t is not None for _, t in rows)
    assert any(r["representative"] != r["record"] and r["holds_span"] for r in members)
