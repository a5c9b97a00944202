"""Golden cases of charts."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import charts as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def row(*x):
    return F.array(*map(F.lit, x))


@pytest.mark.parametrize("x,want", [(0.0, "0"), (3.0000001, "3"), (3.14159, "3.14"), (-2.50, "-2.5"), (0.125, "0.125"), (0.02, "0.02"), (0.00012, "0.00012"), (1234567.0, "1234567"), (1e-9, "0.000000001")])
def test_axis_numbers(spark, x, want):
    assert one(spark, C.axis_number(F.lit(x))) == want


@pytest.mark.parametrize("x,up,down,back", [(37.0, 40.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (1.05, 1.1, 0.0, 0.0), (-37.0, 1.0, -40.0, -35.0), (-9.5, 1.0, -10.0, -9.0)])
def test_nice(spark, x, up, down, back):
    got = spark.range(1).select(C.nice_ceil(F.lit(x)).alias("u"), C.nice_floor(F.lit(x)).alias("d"), C.nice_towards_zero(F.lit(x)).alias("b")).first()
    assert (got.u, got.d, got.b) == pytest.approx((up, down, back))


@pytest.mark.parametrize(
    "values,kind,want",
    [([0.0, 0.0], "bar", (0, 1)), ([-5.0, 5.0], "bar", (-5, 5)), ([-10.0, -4.0], "line", (-10, -3.5)), ([1.0, 10.0, 5.0], "bar", (0, 10.8)), ([100.0, 104.0, 102.0], "bar", (99.2, 104.8)), ([7.0, 7.0], "line", (6.93, 7.035))],
)
def test_ranges(spark, values, kind, want):
    got = one(spark, C.y_range(row(*values), F.lit(kind)))
    assert (got.low, got.high) == pytest.approx(want)


def test_charts_as_text(spark):
    xy = one(spark, C.mermaid_xy(F.lit("bar"), F.lit("km"), row('a"b', " "), row(1.0, 10.5)))
    assert xy.splitlines()[1:4] == ["config:", "    horizontal: false", "    width: 360"] and xy.splitlines()[-4] == "xychart-beta"
    assert xy.splitlines()[-3] == '    x-axis ["a\'b", "Item"]' and xy.splitlines()[-1] == "    bar [1, 10.5]" and '    y-axis "km" 0 --> ' in xy
    assert "xychart-beta horizontal" in one(spark, C.mermaid_xy(F.lit("bar"), F.lit(""), row("长" * 30, "b"), row(1.0, 2.0)))
    assert one(spark, C.mermaid_xy(F.lit("bar"), F.lit("km/h"), row("a", "b"), row(1.0, 2.0))) is None
    assert one(spark, C.mermaid_pie(F.lit("%"), row("a", "b"), row(20.0, 45.5))) == 'pie\n    "b (45.5%)" : 45.5\n    "a (20%)" : 20\n    "other (34.5%)" : 34.5'
    assert one(spark, C.mermaid_pie(F.lit("%"), row("a", "b"), row(60.0, 45.5))) is None and one(spark, C.mermaid_pie(F.lit("t"), row("a", "b"), row(-1.0, 2.0))) is None
    assert one(spark, C.mermaid_timeline(row("2001 ", "2002"), row("a\nb", "c"))) == "timeline\n        2001 : a<br>b\n        2002 : c"
    assert one(spark, C.mermaid_timeline(row("2001"), row(" "))) is None
    assert not one(spark, C.valid_extraction(F.lit("bar"), F.lit("km/h"), F.array(*[row("a", "1", "u")] * 3)))
