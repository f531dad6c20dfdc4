"""Hand-computed cases and edges: empty inputs, nulls, ties, odd lengths, zero totals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lattica.functions import dates as D
from lattica.functions import numbers as N
from lattica.functions import predicates as P
from lattica.functions import text as X
from lattica.operators import aggregates as A
from lattica.operators import changes as C
from lattica.operators import joins as J
from lattica.operators import ordering as O
from lattica.operators import timescale as T
from lattica.operators import windows as W


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def series(spark, xs, ys, key="k"):
    return spark.createDataFrame([(1, float(x), None if y is None else float(y), i) for i, (x, y) in enumerate(zip(xs, ys, strict=True))], f"{key} long, x double, y double, pos long")


def test_stack_totals_of_the_worked_example(spark):
    data = [[32, 33, 43, 12], [2, 3, 5, 1]]
    df = spark.createDataFrame([(s, i, float(v)) for s, vs in enumerate(data) for i, v in enumerate(vs)], "s long, i long, v double")
    assert [t for _, t in rows(A.totals_by(df, ["i"], "v"))] == [34, 36, 48, 13]
    assert [t for _, t in rows(A.totals_by(df, ["s"], "v"))] == [120, 11]
    assert rows(A.percent_of(df, ["i"], "v"), "s", "i", "percent")[0][2] == pytest.approx(94.11, abs=0.01)


def test_percent_of_a_zero_total(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.0)], "i long, v double")
    assert [r.percent for r in A.percent_of(df, ["i"], "v").collect()] == [0.0, 0.0]


@pytest.mark.parametrize(("asked", "page", "keys"), [(1, 1, [0, 1, 2]), ("x", 1, [0, 1, 2]), (None, 1, [0, 1, 2]), (3, 3, [6]), (99, 3, [6]), (0, 3, [6]), (-4, 3, [6]), ("2", 2, [3, 4, 5])])
def test_pages(spark, asked, page, keys):
    df = spark.range(7)
    for reverse in (None, [F.col("id").desc()]):
        got = O.page(df, [F.col("id")], asked, 3, reverse).orderBy("pos").collect()
        assert [r.id for r in got] == keys and [r.pos for r in got] == keys and {(r.page, r.n_pages) for r in got} == {(page, 3)}


def test_pages_of_nothing(spark):
    assert O.page(spark.range(0), [F.col("id")], 5).collect() == []
    assert [r.id for r in O.grid_page(spark.range(50), [F.col("id")], 9, 20).collect()] == list(range(20))


def test_global_positions(spark):
    df = spark.range(1000).repartition(7).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = O.global_position(df, ["v", "id"]).collect()
    want = {r.id: n for n, r in enumerate(sorted(df.collect(), key=lambda r: (r.v, r.id)))}
    assert {r.id: r.pos for r in got} == want
    assert O.global_position(spark.range(0), ["id"]).collect() == []


def test_zip_of_unequal_lengths_and_reversal(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "z")], "k long, x string")
    b = spark.createDataFrame([(1, "q"), (1, "p"), (3, "r")], "k long, y string")
    assert rows(J.zip_join(a, b, ["k"], ["x"], ["y"])) == [(1, 0, "a", "p"), (1, 1, "b", "q")]
    assert rows(J.zip_join(a, b, ["k"], ["x"], [F.col("y").desc()])) == [(1, 0, "a", "q"), (1, 1, "b", "p")]


def test_adjacent_pairs_drop_an_odd_tail(spark):
    df = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 9)], "k long, v long")
    assert rows(J.adjacent_pairs(df, ["k"], ["v"], ["v"])) == [(1, 0, 0, 1), (1, 1, 2, 3)]


def test_outer_align_modes(spark):
    a = spark.createDataFrame([(1, 1.0, 0), (1, 5.0, 1), (2, None, 2), (4, 4.0, 3)], "x long, y double, pos long")
    b = spark.createDataFrame([(3, 7.0, 0), (4, 8.0, 1), (4, None, 2)], "x long, y double, pos long")
    assert rows(J.outer_align([(a, "a"), (b, "b")])) == [(1, 5.0, None), (2, None, None), (3, None, 7.0), (4, 4.0, None)]
    assert rows(J.outer_align([(a, "a"), (b, "b")], mode="remove")) == [(1, 5.0, None), (3, None, 7.0), (4, 4.0, 8.0)]
    expanded = {r.x: (r.gap_a, r.gap_b) for r in J.outer_align([(a, "a"), (b, "b")], mode="expand").collect()}
    assert expanded == {1: (False, False), 2: (True, False), 3: (True, False), 4: (False, True)}


def test_nearest_prefers_the_lower_on_a_tie(spark):
    left = spark.createDataFrame([(1, 5, "l"), (1, 0, "m"), (1, 99, "n"), (2, 1, "o")], "k long, x long, name string")
    right = spark.createDataFrame([(1, 4, 10), (1, 6, 11), (1, 5 + 90, 12)], "k long, x long, id long")
    assert rows(J.nearest(left, right, ["k"], "x", "id"), "name", "near_x", "near_id") == [("l", 4, 10), ("m", 4, 10), ("n", 95, 12), ("o", None, None)]


def test_overlaps_once_each_ends_included(spark):
    df = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 12), (1, 3, 11, 500), (1, 4, 600, 700), (2, 5, 0, 900)], "k long, id long, a long, b long")
    assert rows(J.overlaps(df, ["k"], "id", "a", "b", 7)) == [(1, 1, 2), (1, 2, 3)]


def test_stacked_interpolates_inside_only(spark):
    base, other = series(spark, [0, 10], [0, 100]).drop("pos"), series(spark, [-5, 5, 10], [1, 2, 3]).drop("pos")
    assert rows(J.stacked(base, other, ["k"])) == [(1, -5.0, 0.0, 1.0), (1, 0.0, 0.0, 1.5), (1, 10.0, 100.0, 103.0), (1, 5.0, 50.0, 52.0)]
    assert (1, 0.0, 0.0, 1.5) in rows(J.filled_between(other, base, ["k"]))


def test_overlaid_timelines_of_unequal_length(spark):
    a = spark.createDataFrame([(1, "a", 0, 2), (1, "b", 2, 4)], "k long, clip string, start long, end long")
    b = spark.createDataFrame([(1, "x", 0, 3)], "k long, clip string, start long, end long")
    assert rows(J.overlaid(a, b, ["k"])) == [(1, "a", "x", 0, 2), (1, "b", "x", 2, 3)]


def test_runs_and_headers(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "a"])], "k long, i long, v string")
    got = W.runs(df, ["k"], ["i"], "v")
    assert [(r.group_no, r.group) for r in got.orderBy("i").collect()] == [(1, "a"), (1, "a"), (2, "No group"), (2, "No group"), (3, "a")]
    heads = W.with_headers(got, ["k"], ["i"]).where("level = 0")
    assert rows(heads, "group_no", "group", "n") == [(1, "a", 2), (2, "No group", 2), (3, "a", 1)]


def test_crossings_touching_the_threshold(spark):
    df = series(spark, [0, 1, 2, 3], [0, 10, 5, 9]).drop("pos")
    got = rows(W.crossings(df, ["k"], 5))
    assert (1, 0.5, 5.0, "crossing") in got and len(got) == 5 and (1, 2.0, 5.0, "over") in got


def test_dictionary_goes_on_after_presets(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "p"), (4, None)], "pos long, v string")
    assert rows(W.encoded(df, "v", "pos", ["p"])) == [("a", 2), ("b", 1), ("p", 0)]


def test_downsampling_with_gaps(spark):
    df = spark.createDataFrame([(1, 0, None, 0), (1, 1, 5.0, 1), (1, 2, 1.0, 2), (1, 3, None, 3), (1, 10, None, 4)], "k long, x long, y double, id long")
    assert rows(W.downsampled(df, ["k"], "x", "y", "id", 0, 10)) == [(1, 0, 5.0, 1.0, 5.0, 1.0, False, 4), (1, 1, None, None, None, None, True, 1)]


def test_small_slices_need_two(spark):
    df = spark.createDataFrame([("p", "a", 98.0), ("p", "b", 1.0), ("p", "c", 1.0), ("q", "a", 99.0), ("q", "b", 1.0), ("z", "a", None), ("z", "b", -3.0)], "k string, s string, v double")
    got = {(r.k, r.label): (r.value, r.percent) for r in A.combined_slices(df, ["k"], "s", "v", 0.02).collect()}
    assert got == {("p", "a"): (98.0, 98.0), ("p", "Other"): (2.0, 2.0), ("q", "a"): (99.0, 99.0), ("q", "b"): (1.0, 1.0), ("z", "Other"): (0.0, 0.0)}


def test_log_range_defaults_and_gaps(spark):
    df = spark.createDataFrame([(1, -1.0), (1, 0.0), (2, 3.0), (2, 3.0)], "k long, y double")
    assert rows(A.log_range(df, ["k"], "y")) == [(1, 1.0, 10.0), (2, 3.0, 3.0)]
    assert rows(A.least_gap(df, ["k"], "y")) == [(1, 1.0), (2, 0.5)]


def test_facets(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), (None, ["y"]), ("a", [])], "v string, vs array<string>")
    assert rows(A.facet_counts(df, "v")) == [("", 1), ("a", 2)]
    assert rows(A.facet_counts(df, "vs", array=True)) == [("x", 1), ("y", 2)]
    assert df.where(P.facet(F.col("v"), [""])).count() == 1 and df.where(P.facet(F.col("v"), [])).count() == 3
    assert df.where(P.facet_array(F.col("vs"), ["x", "q"])).count() == 1
    assert rows(A.shown_total(df, "v", F.size("vs") > 1)) == [("a", 1, 2)]
    assert {r.column: r.hidden for r in A.unique_ratio(df.select("v", F.lit(1).alias("w")), ["v", "w"]).collect()} == {"v": True, "w": True}


def test_two_phase_delete(spark):
    need = spark.createDataFrame([(1, " /a"), (1, "b"), (2, "c"), (2, ""), (2, None), (3, "d")], "g long, key string")
    out = spark.createDataFrame([("a", "deleted"), ("b", "missing"), ("c", "failed"), ("d", "deleted"), ("extra", "deleted")], "key string, status string")
    assert rows(C.two_phase(need, out, "g", "key")) == [(1, 2, 2, True), (2, 1, 0, False), (3, 1, 1, True)]


def test_sets_and_changes(spark):
    a, b = spark.createDataFrame([(1,), (1,), (None,)], "v long"), spark.createDataFrame([(None,), (1,)], "v long")
    assert C.same_set(a.where("v is not null"), b.where("v is not null")).first().same
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, n string, m string")
    assert rows(C.merged(t, spark.createDataFrame([(2, "c"), (3, "d")], "id long, n string"), ["id"])) == [(1, "a", "x"), (2, "c", "y")]
    assert rows(C.updated(t, F.col("id") > 1, {"n": F.lit("z")})) == [(1, "a", "x"), (2, "z", "y")]
    assert rows(C.deleted(t, spark.createDataFrame([(1,)], "id long"), ["id"])) == [(2, "b", "y")]
    assert len(rows(C.get_or_created(t, spark.createDataFrame([(2, "b"), (5, "e"), (5, "f")], "id long, n string"), ["id"]))) == 3


def test_text_functions(spark):
    assert value(spark, X.join_url(F.lit("http://h//"), F.lit("//s"))) == "http://h/s" and value(spark, X.join_url(F.lit(""), F.lit("s"))) is None
    assert value(spark, X.plain_text(F.lit("  <p>a &amp;lt; b</p>\n<script>x<y</script><!-- n -->c "))) == "a &lt; b c"
    assert value(spark, X.leading_number(F.lit("12px"))) == 12.0 and value(spark, X.leading_number(F.lit("px"))) is None
    assert value(spark, X.plain_number(F.lit(1e-7))) == "0.0000001" and value(spark, X.plain_number(F.lit(1e15))) == "1000000000000000"
    numbers = {"007": "7", "1.500": "1.5", "-0.50": "-0.5", "1.5E3": "1500", "-12e-1": "-1.2", "0E-10": "0", "12E+2": "1200", "1.25E1": "12.5", "abc.0": "abc.0", "NaN": "NaN", "": ""}
    held = spark.createDataFrame(list(numbers.items()), "v string, want string").select("want", X.plain_number(F.col("v")).alias("got"))
    assert all(r.got == r.want for r in held.collect()) and value(spark, X.plain_number(F.lit(None).cast("double"))) is None
    assert value(spark, X.base_name(F.lit("a/b.c/D.JPG"))) == "D.JPG" and value(spark, X.extension(F.lit("a/b.c/D.JPG"))) == ".jpg" and value(spark, X.extension(F.lit("a.b/c"))) == ""
    assert value(spark, X.csv_field(F.lit('a"b'))) == '"a""b"' and value(spark, X.csv_field(F.lit(None).cast("string"))) == '""'


def test_number_functions(spark):
    assert [value(spark, N.even(F.lit(n))) for n in (3, 4)] == [4, 4]
    assert value(spark, N.crop_start(F.lit(2001), 1920)) == 40 and value(spark, N.crop_start(F.lit(100), 1920)) == 0
    assert value(spark, N.power_below(F.lit(1000.0), 10)) == 1000.0 and value(spark, N.power_below(F.lit(999.0), 10)) == 100.0
    assert value(spark, N.scaled(F.lit(3.0), F.lit(3.0), F.lit(3.0))) == 0.5
    assert value(spark, N.first_class(F.lit(10), [(None, 10, "a"), (10, None, "b")])) == "a" and value(spark, N.last_class(F.lit(10), [(0, 10, "a"), (10, 20, "b")])) == "b"
    assert value(spark, N.first_class(F.lit(99), [(0, 1, "a")])) is None
    low, high = N.bar_ends(F.lit(5.0), F.lit(None).cast("double"), F.lit(2.0))
    assert (value(spark, low), value(spark, high)) == (3.0, 7.0)


def test_date_functions(spark):
    at = F.to_timestamp_ntz(F.lit("2024-02-29 00:05:09"))
    assert value(spark, D.strftime(at, "%Y-%m-%d %l:%M%p %P %q %w %e")) == "2024-02-29 12:05am AM 1 4 29"
    assert value(spark, D.template(at, "{DD}.{M}.{YY} {h}{aa} {WWW}")) == "29.2.24 12am Thu"
    assert value(spark, D.token_format(at, "yyyy/MM/dd hh:mm TT")) == "2024/02/29 12:05 AM"
    assert [value(spark, D.leap_year(F.lit(y))) for y in (1900, 2000, 2023, 2024)] == [False, True, False, True]
    assert value(spark, D.from_epoch(F.lit(1), "seconds")) == dt.datetime(1970, 1, 1, 0, 0, 1)


def test_time_units(spark):
    spans = {6 * 365 * 86400: "years", 900 * 86400: "half_year", 200 * 86400: "months", 3 * 86400: "days", 86400: "hours", 1000: "minutes_fives", 400: "minutes", 100: "seconds_tens", 30: "seconds_fives", 20: "seconds"}
    assert {s: value(spark, T.unit_of(F.lit(float(s)))) for s in spans} == spans


def test_validators(spark):
    df = spark.createDataFrame([("abc", 5), ("", 10), (None, None)], "s string, n long")
    told = df.select(P.required(F.col("s")).alias("r"), P.length_range(F.col("s"), 2, 3).alias("l"), P.pattern(F.col("s"), "a|abc").alias("p"), P.number_range(F.col("n"), 5, 9).alias("n"))
    assert [tuple(r) for r in told.collect()] == [(True, True, True, True), (False, False, False, False), (False, True, True, True)]
    assert df.where(P.grid_text(F.col("s"), "")).count() == 3 and df.where(P.grid_text(F.col("s"), "B")).count() == 0
