"""Chart payloads: validation, nice axes and Mermaid text, as Column expressions over arrays of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chart kinds, nice multipliers of a power of ten, and what separates mixed units.
KINDS = ("bar", "line", "pie", "timeline")
LADDER = (1.0, 1.1, 1.2, 1.25, 1.5, 1.6, 1.8, 2.0, 2.2, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 10.5, 11.0, 12.0, 15.0)
MIXED_UNIT = "[或/|,;]|(?i: and )"

#: Fixed values of the axes: padding shares, share of its padding above, gap that a bar's axis bridges to zero, headroom of negatives.
TIGHT, LOOSE, UP, ZERO_GAP, HEADROOM = 0.08, 0.12, 0.5, 2.5, 0.95

#: Fixed values of the drawing: widths, height, label space, color.
WIDTH_LEAST, WIDTH_MOST, WIDTH_BASE, WIDTH_EACH, HEIGHT, LABEL_SPACE, COLOR = 360, 960, 220, 70, 360, 80.0, "#7c3aed"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mixed_unit(unit: Column) -> Column:
    return F.coalesce(unit.rlike(MIXED_UNIT), F.lit(False))


def valid_extraction(kind: Column, unit: Column, records: Column) -> Column:
    """Rows of three non-blank strings, a known kind, 3 to 12 rows, and one unit unless it is a timeline."""
    rows = F.forall(records, lambda r: (F.size(r) == 3) & F.forall(r, lambda x: F.length(F.trim(x)) > 0))
    units = (kind == "timeline") | ((F.length(F.trim(unit)) > 0) & ~mixed_unit(unit))
    return F.coalesce(kind.isin(*KINDS) & rows & F.size(records).between(3, 12) & units, F.lit(False))


def valid_values(kind: Column, values: Column) -> Column:
    """Finite numbers, none negative in a pie; bars and lines need three different ones."""
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    varied = ~kind.isin("bar", "line") | (F.size(F.array_distinct(values)) >= 3)
    return F.coalesce(finite & varied & ((kind != "pie") | F.forall(values, lambda v: v >= 0)), F.lit(False))


def _rungs(x: Column) -> Column:
    return let(F.pow(F.lit(10.0), F.floor(F.log10(x))), lambda scale: F.transform(F.array(*map(F.lit, LADDER)), lambda s: s * scale))


def nice_ceil(x: Column) -> Column:
    """The first rung of the ladder, times a power of ten, that isn't under x; 1 where x is not positive."""
    return let(x, lambda x: F.when(x > 0, F.get(F.filter(_rungs(x), lambda s: s >= x), F.lit(0))).otherwise(1.0))


def nice_floor(x: Column) -> Column:
    """Of a negative number the like rung below it; else 0."""
    return F.when(x < 0, -nice_ceil(-x)).otherwise(0.0)


def nice_towards_zero(x: Column) -> Column:
    """Of a negative number the largest rung, up to ten, that is no further from zero; else 0."""
    return F.when(x < 0, -F.array_max(F.slice(F.filter(F.slice(_rungs(-x), 1, 20), lambda s: s <= -x + 1e-12), 1, 20))).otherwise(0.0)


def y_range(values: Column, kind: Column) -> Column:
    """struct<low,high> of the axis: nice bounds where there are negatives, else padded to whole steps, from 0 for bars near it."""
    pair = lambda a, b: F.struct(a.cast("double").alias("low"), b.cast("double").alias("high"))

    def negative(a: Column, b: Column) -> Column:
        top = F.greatest(nice_towards_zero(b * HEADROOM), b)
        return F.when(b > 0, pair(nice_floor(a), nice_ceil(b))).otherwise(pair(nice_floor(a), F.when(top <= nice_floor(a), b).otherwise(top)))

    def padded(a: Column, b: Column) -> Column:
        span = F.when(b > a, b - a).otherwise(F.greatest(b, F.lit(1.0)) * 0.1)
        zero = (kind == "bar") & ((a <= 0) | (a <= span * ZERO_GAP))
        pad = span * F.when(span / F.greatest(b, F.lit(1e-9)) < 0.25, TIGHT).otherwise(LOOSE)

        def stepped(v: Column) -> Column:
            low = lambda step: F.greatest(F.least(F.floor(v["lo"] / step) * step, a), F.lit(0.0))
            return let(nice_ceil((v["hi"] - v["lo"]) / 6.0), lambda step: pair(low(step), F.greatest(F.ceil(v["hi"] / step) * step, b)))

        return let(F.struct(F.when(zero, 0.0).otherwise(a - pad).alias("lo"), (b + pad * UP).alias("hi")), stepped)

    def choose(v: Column) -> Column:
        a, b = v["a"], v["b"]
        return F.when(a.isNull() | ((a == 0) & (b == 0)), pair(F.lit(0.0), F.lit(1.0))).when(a < 0, negative(a, b)).otherwise(padded(a, b))

    return let(F.struct(F.array_min(values).alias("a"), F.array_max(values).alias("b")), choose)


def _bare(number: Column) -> Column:
    """Without zeros at the end of a fraction."""
    cut = F.regexp_replace(F.regexp_replace(number, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    return F.when(cut == "-0", "0").otherwise(cut)


def axis_number(x: Column) -> Column:
    """A number without exponent: whole ones as such, from 1 two places, from 0.01 three, below as many as it needs.

    Halves round up by their decimal form.
    """
    size = F.abs(x)
    places = F.greatest(F.lit(6), (2 - F.floor(F.log10(size))).cast("int"))
    whole = (F.abs(x - F.rint(x)) < 1e-6) & (size >= 1)
    fixed = lambda n: F.format_string(f"%.{n}f", x)
    small = F.printf(F.concat(F.lit("%."), places.cast("string"), F.lit("f")), x)
    return F.when(size == 0, "0").when(whole, F.rint(x).cast("long").cast("string")).when(size >= 1, _bare(fixed(2))).when(size >= 0.01, _bare(fixed(3))).otherwise(_bare(small))


def plain_number(x: Column) -> Column:
    """A number as it is, without exponent or zeros at the end."""
    return _bare(x.cast("decimal(38,12)").cast("string"))


def label_shown(label: Column, default: str) -> Column:
    bare = F.replace(F.trim(label), F.lit('"'), F.lit("'"))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, default).otherwise(bare)


def horizontal(labels: Column) -> Column:
    """Whether labels (a Chinese character counts two) are too wide, together or one of its share, to stand side by side."""
    from tessera.functions.text import label_weight

    weights = F.transform(labels, lambda x: label_weight(x).cast("double"))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    return (F.size(labels) > 0) & ((total > LABEL_SPACE) | (F.array_max(weights) > LABEL_SPACE / F.greatest(F.size(labels), F.lit(1))))


def mermaid_xy(kind: Column, unit: Column, labels: Column, values: Column) -> Column:
    """A bar or line chart; null for another kind, mixed units, fewer than two records or lists of different sizes."""
    return let(F.struct(labels.alias("a"), values.alias("v"), y_range(values, kind).alias("axis")), lambda x: _xy(kind, unit, x["a"], x["v"], x["axis"]))


def _xy(kind: Column, unit: Column, labels: Column, values: Column, axis: Column) -> Column:
    names = F.transform(labels, lambda x: label_shown(x, "Item"))
    across = (kind == "bar") & horizontal(names)
    width = F.greatest(F.lit(WIDTH_LEAST), F.least(F.lit(WIDTH_MOST), WIDTH_BASE + F.size(values) * WIDTH_EACH))
    title = F.when(F.coalesce(F.length(F.trim(unit)), F.lit(0)) > 0, F.trim(unit)).otherwise("Value")
    number = lambda x: let(x, axis_number)
    parts = [
        F.lit("---\nconfig:\n    horizontal: "), across.cast("string"), F.lit("\n    width: "), width.cast("string"), F.lit(f"\n    height: {HEIGHT}\n    showDataLabel: true\n    themeVariables:\n        xyChart:\n            plotColorPalette: '{COLOR}'\n---\nxychart-beta"),
        F.when(across, " horizontal").otherwise(""), F.lit('\n    x-axis ["'), F.array_join(names, '", "'), F.lit('"]\n    y-axis "'), title, F.lit('" '),
        number(axis["low"]), F.lit(" --> "), number(axis["high"]), F.lit("\n    "), kind, F.lit(" ["), F.array_join(F.transform(values, axis_number), ", "), F.lit("]"),
    ]
    return F.when(kind.isin("bar", "line") & ~mixed_unit(unit) & (F.size(values) >= 2) & (F.size(values) == F.size(labels)), F.concat(*parts))


def pie_rest(values: Column) -> Column:
    """What a pie of percents lacks to 100; null if it has more than that."""
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.when(total <= 100.0 + 1e-6, F.greatest(100.0 - total, F.lit(0.0)))


def mermaid_pie(unit: Column, labels: Column, values: Column) -> Column:
    """Slices by size, equal ones in their order; of percents the rest comes last as `other`.

    Null for percents over 100, negative values, blank labels or fewer than two records.
    """
    percent = F.coalesce(unit.rlike("%|百分比"), F.lit(False))
    mark = F.coalesce(F.trim(unit), F.lit(""))
    name = lambda x: F.regexp_replace(label_shown(x, "label"), "\\s+", " ")
    slices = F.transform(F.arrays_zip(labels.alias("a"), values.alias("v")), lambda x, i: F.struct((-x["v"]).alias("k"), i.alias("i"), name(x["a"]).alias("a"), plain_number(x["v"]).alias("n")))
    line = lambda a, n: F.concat(F.lit('\n    "'), a, F.lit(" ("), n, mark, F.lit(')" : '), n)
    body = F.array_join(F.transform(F.array_sort(slices), lambda s: line(s["a"], s["n"])), "")
    rest = pie_rest(values)
    other = F.when(percent & (rest > 1e-6), line(F.lit("other"), plain_number(F.round(rest, 3)))).otherwise("")
    sound = (F.size(values) >= 2) & (F.size(values) == F.size(labels)) & F.forall(values, lambda v: v >= 0) & F.forall(labels, lambda x: F.length(F.trim(x)) > 0) & (~percent | rest.isNotNull())
    return F.when(sound, F.concat(F.lit("pie"), body, other))


def mermaid_timeline(times: Column, events: Column) -> Column:
    """One line for each event, line breaks as <br>; null where a time or an event is blank or there are none."""
    shown = lambda e: F.regexp_replace(F.trim(e), "\\r\\n|\\r|\\n", "<br>")
    lines = F.zip_with(times, events, lambda a, e: F.concat(F.lit("\n        "), F.trim(a), F.lit(" : "), shown(e)))
    full = lambda xs: F.forall(xs, lambda x: F.length(F.trim(x)) > 0)
    return F.when((F.size(times) > 0) & (F.size(times) == F.size(events)) & full(times) & full(events), F.concat(F.lit("timeline"), F.array_join(lines, "")))
