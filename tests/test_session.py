from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from motifmill import session
from motifmill.functions.columns import computed_once
from motifmill.operators.ordering import first_within, number_rows, number_within


def test_a_cluster_needs_a_shared_folder():
    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))


def test_only_small_tables_are_broadcast(spark):
    plan = lambda df: spark.range(10).join(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(session.small(spark.range(5), 5)) and "broadcast" not in plan(session.small(spark.range(6), 5))


def test_filters_do_not_repeat_a_column(spark):
    df = computed_once(spark.range(5), x=F.col("id") * 2).where("x > 2").select("x")
    assert sorted(r["x"] for r in df.collect()) == [4, 6, 8]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("* 2") == 1


def test_numbers(spark):
    rows = [(g, b, v) for g in "abc" for b in (2, 1) for v in (5, 3, 9, 3)]
    df = spark.createDataFrame(rows, "g string, b int, v int")
    order = sorted(rows)
    assert [tuple(r)[:3] for r in sorted(number_rows(df, ["g", "b", "v"], "no").collect(), key=lambda r: r["no"])] == order
    within = sorted(number_within(df, ["g"], ["g", "b"], ["v"], "no").collect(), key=lambda r: (r["g"], r["no"]))
    assert [tuple(r)[:3] for r in within] == order and [r["no"] for r in within] == [*range(8)] * 3
    first = first_within(df, ["g"], [F.desc("v"), "b"], 3, "no").collect()
    assert sorted(tuple(r) for r in first) == [(g, *x) for g in "abc" for x in ((1, 5, 2), (1, 9, 0), (2, 9, 1))]
    assert number_rows(df.where("false"), ["g"], "no").count() == 0 == number_within(df.where("false"), ["g"], ["b"], ["v"], "no").count()
