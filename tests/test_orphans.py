import datetime as dt

from seqsys.operators.orphans import orphan_report, orphan_rows


def day(n):
    return None if n is None else dt.datetime(2031, 1, 1) + dt.timedelta(days=n)


def run(spark, child, parent):
    c = spark.createDataFrame([(e, k, day(t), "x") for e, k, t in child], "entry long, k long, at timestamp, kind string")
    p = spark.createDataFrame([(k, day(f), day(t), 1) for k, f, t in parent], "k long, f timestamp, t timestamp, at int")
    return c, orphan_rows(c, p, row="entry", key="k", at="at", parent_key="k", valid_from="f", valid_to="t", table="c")


def test_kinds_nulls_and_repeats(spark):
    child = [(1, 10, 5), (1, 10, 5), (2, 11, 5), (3, 12, 5), (4, 13, 5), (5, None, 5), (6, 0, 5), (7, -3, 5), (8, 14, None), (9, 15, 5), (10, 16, 5)]
    parent = [(11, 6, None), (12, 1, 4), (13, 1, 4), (13, 4, None), (15, 5, 6), (None, 1, None), (16, None, None), (13, 4, None)]
    _, o = run(spark, child, parent)
    assert {(r.row, r.kind) for r in o.collect()} == {(1, "missing"), (2, "late"), (3, "withdrawn"), (10, "late")}
    assert o.count() == 4


def test_empty_tables(spark):
    _, o = run(spark, [], [(1, 1, None)])
    assert o.count() == 0
    _, o = run(spark, [(1, 5, 1)], [])
    assert [(r.row, r.kind) for r in o.collect()] == [(1, "missing")]


def test_report(spark):
    c, o = run(spark, [(1, 10, 5), (2, 10, 6), (3, 12, 40)], [(12, 1, None)])
    got = [tuple(r) for r in orphan_report(o, c, key="k", at="at", table="c").collect()]
    assert got == [("c", "2031-01", "missing", 2, 1, 2)]
