import random

import pytest

from motifmill.llm.truncation import fit, length_limits, score

NOUNS = "rotor housing spring nozzle damper gasket clamp coil spindle bearing valve sensor plate filter shaft".split()
VERBS = "carries limits holds moves heats cools covers supports turns measures".split()


def sentence(rng):
    return f"The {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} by {rng.randint(2, 90)}.{rng.randint(1, 9)} mm as shown in FIG. {rng.randint(1, 9)}."


def text(rng):
    body = "Title of the part\nABSTRACT\n" + " ".join(sentence(rng) for _ in range(rng.randint(3, 9))) + "\nCLAIMS\n"
    body += "\n".join(f"{i + 1}. {sentence(rng)}" for i in range(rng.randint(1, 6)))
    kind = rng.random()
    if kind < 0.08:
        body += "\nREFERENCE SIGNS\n" + ", ".join(f"{10 + 2 * i} {rng.choice(NOUNS)}" for i in range(5))
    elif kind < 0.14:
        body += "\n[END]"
    elif kind < 0.2:
        body += f"\nFig. {rng.randint(1, 5)}"
    return body + rng.choice(["", "", "\n", "  "])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    rows, cut = [], set()
    for i in range(1500):
        t, source = text(rng), rng.choice(["form", "feed", None])
        if source == "form" and len(t.rstrip()) > 400:
            whole, t = t, t[:400]
            shown = t.rstrip()
            inside = not shown.endswith(".") or shown.endswith("FIG.") or whole[len(shown)].isdigit() or shown[shown.rfind("\n") + 1 : -1].isdigit()
            if inside and whole[400] != "\n":
                cut.add(i)
        elif rng.random() < 0.06:
            at = rng.randint(40, len(t) - 30)
            if t[at - 1] not in ". \n" and t[at] != "\n":
                t = t[:at] + rng.choice(["", "...", " […]", "   "])
                cut.add(i)
        rows.append((i, source, t, "x"))
    rows += [(2000, "feed", None, ""), (2001, "feed", "", ""), (2002, None, " \n ", "")]
    return rows, cut


def test_limits_are_found(spark, corpus):
    df = spark.createDataFrame(corpus[0], "id bigint, source string, text string, probability string")
    assert ("form", "chars", 400) in {tuple(r) for r in length_limits(df, "source", "text").collect()}


def test_held_out_texts_are_told_apart(spark, corpus):
    rows, cut = corpus
    schema = "id bigint, source string, text string, label string"
    train = spark.createDataFrame([r for r in rows if r[0] % 2 == 0], schema)
    rest = [r for r in rows if r[0] % 2 == 1 or r[0] >= 2000]
    found = score(spark.createDataFrame(rest, schema), fit(train, "id", "source", "text"), "id", "source", "text").collect()
    assert len(found) == len(rest)
    said = {r["id"] for r in found if r["truncated"]}
    true = {r[0] for r in rest} & cut
    assert not said & {2000, 2001, 2002}
    assert len(said & true) / len(true) > 0.93 and len(said & true) / len(said) > 0.93


@pytest.mark.parametrize("rows", [[], [(1, None, None, "")], [(1, "a", "", ""), (2, "a", "One full sentence stands here.", "")]])
def test_hardly_any_text(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, source string, text string, label string")
    found = score(df, fit(df, "id", "source", "text"), "id", "source", "text").collect()
    assert len(found) == len(rows) and not any(r["truncated"] for r in found)
