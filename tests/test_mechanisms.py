"""Hot keys, closures, gaps, zones, steps, nested merges, mixed series, derived scales."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from lattica.functions import dates as D
from lattica.functions import numbers as N
from lattica.functions import predicates as P
from lattica.operators import aggregates as A
from lattica.operators import changes as C
from lattica.operators import joins as J
from lattica.operators import ordering as O
from lattica.operators import timescale as T
from lattica.operators import windows as W
from lattica.plans.registry import QUERIES
from lattica.sources import listing, sinks

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def plan_of(df):
    return df._jdf.queryExecution().toString()


# positions within a hot key


def test_positions_of_a_key_that_holds_most_rows(spark):
    hot = F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 < 9, F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    df = spark.range(20_000).select(hot.alias("key"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("v"), "id").repartition(6)
    got = O.keyed_position(df, ["key"], ["v", "id"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.key, []).append((r.v, r.id, r.pos))
    assert set(groups) == {"hot", None} | {f"k{i}" for i in range(50) if i % 10 in (7, 8)}
    for rows in groups.values():
        assert [p for _, _, p in sorted(rows)] == list(range(len(rows)))


def test_no_window_is_partitioned_by_a_hot_key_alone(spark):
    for name in ("numbered_frames", "generated_labels", "alternating_split", "multi_bucket_scan", "composition_plan", "composition_composites"):
        windows = re.findall(r"windowspecdefinition\((.*?) ASC", plan_of(QUERIES[name](spark, SF)))
        assert windows and all("_cell" in w for w in windows), name


def test_positions_of_nothing_and_of_one_key(spark):
    empty = spark.createDataFrame([], "k long, v long")
    assert O.keyed_position(empty, ["k"], ["v"]).collect() == []
    one = spark.createDataFrame([(1, 5), (1, 3), (1, 9)], "k long, v long")
    assert sorted((r.v, r.pos) for r in O.keyed_position(one, ["k"], [F.col("v").desc()]).collect()) == [(3, 2), (5, 1), (9, 0)]


def test_hot_pairs_are_those_of_the_window(spark):
    df = spark.range(301).select((F.col("id") % 3 == 0).alias("k"), F.col("id").alias("v"), (F.col("id") * 2).alias("w"))
    for columns in (["v"], ["v", "w"]):
        plain, hot = (sorted(tuple(r) for r in J.adjacent_pairs(df, ["k"], ["v"], columns, hot=h).collect()) for h in (False, True))
        assert plain == hot and len(hot) == 150
    left, right = df.select("k", "v"), df.select("k", F.col("v").alias("z")).where("z > 10")
    plain, hot = (sorted(tuple(r) for r in J.zip_join(left, right, ["k"], ["v"], [F.col("z").desc()], hot=h).collect()) for h in (False, True))
    assert plain == hot


def test_alternation_of_a_hot_key(spark):
    df = spark.range(101).select(F.lit("s").alias("k"), "id")
    got = {r.id: (r.side, r.side_pos) for r in W.alternating(df, ["k"], ["id"]).collect()}
    assert got == {i: ("a" if i % 2 == 0 else "b", i // 2) for i in range(101)}


# cascading deletes


def cascaded(spark, tables, links, root, doomed):
    stays, counts = C.cascade(tables, links, root, doomed)
    return {t: sorted(tuple(r) for r in df.collect()) for t, df in stays.items()}, {r["table"]: r.deleted for r in counts.collect()}


def test_cascade_through_a_diamond(spark):
    tables = {
        "a": spark.createDataFrame([(1,), (2,)], "id long"),
        "b": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, a long"),
        "c": spark.createDataFrame([(20, 1), (21, 2)], "id long, a long"),
        "d": spark.createDataFrame([(30, 10, 20), (31, 11, 20), (32, 10, 21), (33, 11, 21), (34, None, None)], "id long, b long, c long"),
        "e": spark.createDataFrame([(1,)], "id long"),
    }
    links = [("b", ["a"], "a", ["id"]), ("c", ["a"], "a", ["id"]), ("d", ["b"], "b", ["id"]), ("d", ["c"], "c", ["id"])]
    stays, counts = cascaded(spark, tables, links, "a", spark.createDataFrame([(1,), (1,), (99,)], "id long"))
    assert counts == {"a": 1, "b": 1, "c": 1, "d": 3, "e": 0}
    assert stays["d"] == [(33, 11, 21), (34, None, None)] and stays["b"] == [(11, 2), (12, None)] and stays["e"] == [(1,)]


def test_cascade_in_trees_and_rings(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 5), (7, 4), (7, 4)], "id long, up long")
    leaf = spark.createDataFrame([(1, 7), (2, 6), (3, None)], "id long, node long")
    stays, counts = cascaded(spark, {"tree": tree, "leaf": leaf}, [("tree", ["up"], "tree", ["id"]), ("leaf", ["node"], "tree", ["id"])], "tree", spark.createDataFrame([(2,)], "id long"))
    assert counts == {"tree": 5, "leaf": 1}
    assert [r[0] for r in stays["tree"]] == [1, 5, 6] and [r[0] for r in stays["leaf"]] == [2, 3]
    a = spark.createDataFrame([(1, 11), (2, 12), (3, None)], "id long, b long")
    b = spark.createDataFrame([(10, 1), (11, 3), (12, 1)], "id long, a long")
    links = [("a", ["b"], "b", ["id"]), ("b", ["a"], "a", ["id"])]
    stays, counts = cascaded(spark, {"a": a, "b": b}, links, "a", spark.createDataFrame([(1,)], "id long"))
    assert counts == {"a": 2, "b": 2} and stays == {"a": [(3, None)], "b": [(11, 3)]}


def test_cascade_of_nothing(spark):
    tables = {"a": spark.createDataFrame([(1,)], "id long"), "b": spark.createDataFrame([(1, 1)], "id long, a long")}
    stays, counts = cascaded(spark, tables, [("b", ["a"], "a", ["id"])], "a", spark.createDataFrame([], "id long"))
    assert counts == {"a": 0, "b": 0} and stays == {"a": [(1,)], "b": [(1, 1)]}


def test_updates_tell_how_many_rows_they_meet(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    assert C.changed_rows(df, F.col("id") >= 2).first().changed == 1


# gaps and steps


def points(spark, *xys):
    return spark.createDataFrame([(1, float(x), None if y is None else float(y)) for x, y in xys], "k long, x double, y double")


def lines(df):
    return sorted([(r.x, r.seq, r.bottom, r.top) for r in df.collect()], key=lambda r: r[:2])


def test_stacked_lines_break_at_gaps_of_either(spark):
    base = points(spark, (0, 10), (4, 14), (5, None), (6, 20), (8, 22), (20, None))
    other = points(spark, (1, 1), (2, 2), (3, None), (4, 4), (7, 7), (9, 9))
    got = lines(J.stacked_lines(base, other, ["k"]))
    # 3 and 5 are gaps; at 6 the other lies on its line from 4 to 7; 9 is beyond the base, 20 beyond the other
    assert [(x, b, t if t is None else round(t, 6)) for x, _, b, t in got] == [(1, 11.0, 12.0), (2, 12.0, 14.0), (3, None, None), (4, 14.0, 18.0), (5, None, None), (6, 20.0, 26.0), (7, 21.0, 28.0), (8, 22.0, 30.0)]


def test_nothing_is_interpolated_across_a_gap(spark):
    base, other = points(spark, (0, 0), (1, None), (2, 2), (3, 3)), points(spark, (0, 1), (1.5, 1), (2.5, 1))
    assert lines(J.stacked_lines(base, other, ["k"])) == [(0, 1, 0, 1), (1, 1, None, None), (2, 1, 2, 3), (2.5, 1, 2.5, 3.5)]
    assert lines(J.stacked_lines(base, other, ["k"], add=False))[-1] == (2.5, 1, 2.5, 1)


def test_steps_keep_the_height_and_begin_anew_after_a_gap(spark):
    base, other = points(spark, (0, 0), (4, 0)), points(spark, (0, 1), (1, 1), (2, 3), (3, None), (4, 5))
    assert lines(J.stacked_lines(base, other, ["k"], steps=True)) == [(0, 1, 0, 1), (1, 1, 0, 1), (2, 0, 0, 1), (2, 1, 0, 3), (3, 1, None, None), (4, 1, 0, 5)]


def test_bars_meet_at_equal_x_only(spark):
    got = J.stacked_bars(points(spark, (1, 5), (2, None)), points(spark, (1, 1), (2, 2), (3, None), (4, 4)), ["k"])
    assert sorted([(r.x, r.bottom, r.top) for r in got.collect()], key=lambda r: r[0]) == [(1, 5, 6), (2, 0, 2), (3, None, None), (4, 0, 4)]


# sorting


def test_strings_in_the_order_of_a_locale(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "A", "a", "é", "e", "Z", "f", None, "ä"]], "v string")
    order = lambda **k: [r.v for r in df.orderBy(O.sort_key(F.col("v"), "string", **k)).collect()]
    assert order(locale="UNICODE") == [None, "a", "A", "ä", "b", "e", "é", "f", "Z"]
    assert order(locale="UNICODE", descending=True) == ["Z", "f", "é", "e", "b", "ä", "A", "a", None]
    assert order()[:4] == [None, "A", "Z", "a"]
    assert order(locale="sv")[-1] == "ä"  # in Swedish a letter of its own, after z


@pytest.mark.parametrize(("kind", "values", "up"), [("number", ["3", None, "-2", "10"], ["-2", None, "3", "10"]), ("numberAsString", ["3px", "x", "-2", "10"], ["-2", "3px", "10", "x"])])
def test_other_kinds_in_both_directions(spark, kind, values, up):
    df = spark.createDataFrame([(x,) for x in values], "v string")
    order = lambda down: [r.v for r in df.orderBy(O.sort_key(F.col("v"), kind, down)).collect()]
    assert order(False) == up
    assert order(True) == ([*reversed(up)] if kind == "number" else ["10", "3px", "-2", "x"])
    assert [O.toggled("a", "a", False), O.toggled("a", "a", True), O.toggled("a", "b", True), O.toggled("a", None, True)] == [True, False, False, False]


# time


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Kathmandu"])
def zoned(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


def ntz(text):
    return F.to_timestamp_ntz(F.lit(text))


def test_times_without_zone_do_not_know_the_sessions_zone(zoned):
    # these hours do not exist, or exist twice, on clocks of New York
    for text in ("2024-03-10 02:30:00.123456", "2024-11-03 01:30:00", "1969-12-31 23:59:59.999999", "0001-01-02 00:00:00"):
        want = round((dt.datetime.fromisoformat(text) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
        assert value(zoned, D.epoch_micros(ntz(text))) == want
        assert value(zoned, D.from_micros(F.lit(want).cast("long"))) == dt.datetime.fromisoformat(text)
    at = ntz("2024-03-10 02:34:56.789")
    assert [str(value(zoned, D.truncated_to(at, p))) for p in ("second", "minute", "hour", "day", "month", "quarter", "year")] == ["2024-03-10 02:34:56", "2024-03-10 02:34:00", "2024-03-10 02:00:00", "2024-03-10 00:00:00", "2024-03-01 00:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00"]
    assert value(zoned, D.strftime(at, "%H:%M:%S")) == "02:34:56" and value(zoned, D.template(at, "{HH}:{mm} {fff}")) == "02:34 789"
    assert str(value(zoned, T.truncated(at, F.lit("minutes_fives")))) == "2024-03-10 02:30:00"
    assert str(value(zoned, T.truncated(ntz("2024-08-10 02:34:56"), F.lit("half_year")))) == "2024-07-01 00:00:00"


def test_offsets_of_zones_and_tokens(zoned):
    shows = lambda text, zone, pattern="yyyy-MM-dd HH:mm K": value(zoned, D.token_format(ntz(text), pattern, zone))
    assert shows("2024-03-10 06:59:00", "America/New_York") == "2024-03-10 01:59 -05:00"
    assert shows("2024-03-10 07:00:00", "America/New_York") == "2024-03-10 03:00 -04:00"
    assert shows("2024-01-01 00:00:00", "Asia/Kathmandu") == "2024-01-01 05:45 +05:45"
    assert shows("2024-01-01 00:00:00", "Europe/London") == "2024-01-01 00:00 Z" and shows("2024-01-01 00:00:00", None) == "2024-01-01 00:00 Z"
    assert shows("2024-01-05 15:04:09.068", None, "y M d H h m s f ff fff T t \\K\\y") == "2024 1 5 15 3 4 9 1 07 068 P p Ky"
    assert str(value(zoned, D.out_of_zone(ntz("2024-03-31 02:30:00"), "Europe/Berlin"))) == "2024-03-31 01:30:00"


def ticks(spark, low, high, size, unit):
    df = spark.createDataFrame([(dt.datetime.fromisoformat(low), dt.datetime.fromisoformat(high), float(size), unit)], "a timestamp_ntz, b timestamp_ntz, n double, u string")
    return [str(r.tick) for r in T.stepped_ticks(df, "a", "b", "n", "u").orderBy("tick").collect()]


@pytest.mark.parametrize(
    ("low", "high", "size", "unit", "want"),
    [
        ("2024-01-01 10:00:07", "2024-01-01 10:00:31", 10, "second", ["2024-01-01 10:00:00", "2024-01-01 10:00:10", "2024-01-01 10:00:20", "2024-01-01 10:00:30"]),
        ("2024-03-09 21:10:00", "2024-03-10 05:00:00", 4, "hour", ["2024-03-09 20:00:00", "2024-03-10 00:00:00", "2024-03-10 04:00:00"]),
        ("2024-02-27 12:00:00", "2024-03-02 00:00:00", 2, "day", ["2024-02-27 00:00:00", "2024-02-29 00:00:00", "2024-03-02 00:00:00"]),
        ("2024-01-20 00:00:00", "2024-02-10 00:00:00", 0.25, "month", ["2024-01-01 00:00:00", "2024-01-08 00:00:00", "2024-01-16 00:00:00", "2024-01-24 00:00:00", "2024-02-01 00:00:00", "2024-02-08 00:00:00"]),
        ("2023-02-03 00:00:00", "2023-03-20 00:00:00", 0.5, "month", ["2023-02-01 00:00:00", "2023-02-15 00:00:00", "2023-03-01 00:00:00", "2023-03-16 00:00:00"]),
        ("2024-02-20 00:00:00", "2024-08-01 00:00:00", 2, "month", ["2024-01-01 00:00:00", "2024-03-01 00:00:00", "2024-05-01 00:00:00", "2024-07-01 00:00:00"]),
        ("2024-05-20 00:00:00", "2025-02-01 00:00:00", 1, "quarter", ["2024-04-01 00:00:00", "2024-07-01 00:00:00", "2024-10-01 00:00:00", "2025-01-01 00:00:00"]),
        ("2024-11-20 00:00:00", "2025-08-01 00:00:00", 2, "quarter", ["2024-07-01 00:00:00", "2025-01-01 00:00:00", "2025-07-01 00:00:00"]),
        ("1993-05-20 00:00:00", "2004-01-01 00:00:00", 5, "year", ["1990-01-01 00:00:00", "1995-01-01 00:00:00", "2000-01-01 00:00:00"]),
        ("2024-01-01 00:00:00", "2024-01-01 00:00:00", 1, "second", ["2024-01-01 00:00:00"]),
    ],
)
def test_ticks_by_steps(zoned, low, high, size, unit, want):
    assert ticks(zoned, low, high, size, unit) == want


def test_steps_of_many_years_are_the_nearest_nice_ones(spark):
    sizes = {1.4: 1, 2.2: 2, 2.9: 2, 4: 5, 7: 5, 8: 10, 14: 10, 16: 20}
    for years, want in sizes.items():
        step = value(spark, T.chosen_step(F.lit(years * 365.2425 * 86400 * 8), 8))
        assert (step["size"], step["unit"]) == (want, "year")


def test_increments(spark):
    assert [value(spark, T.least_increment(F.lit(s), 10)) for s in (0.0, 0.011, 10.0, 86400.0 * 40, 1e12)] == [1, 2, 1000, 345_600_000, None]


# nested merges


def test_deep_merge_of_structs_arrays_and_maps(spark):
    old = spark.sql("select 1 as id, named_struct('b', named_struct('c', 1, 'd', 2), 'e', 'x') as a, array(named_struct('p', 1, 'q', 2), named_struct('p', 3, 'q', 4)) as l, map('k', named_struct('p', 1, 'q', 2)) as m")
    new = spark.sql("select 1 as id, named_struct('b', named_struct('c', 9, 'f', 7), 'g', true) as a, array(named_struct('p', 8), cast(null as struct<p:int>), named_struct('p', 6)) as l, map('k', named_struct('q', 5), 'n', named_struct('q', 3)) as m, 'new' as extra")
    r = C.deep_merged(old, new, ["id"]).first()
    assert r.a.asDict(True) == {"b": {"c": 9, "d": 2, "f": 7}, "e": "x", "g": True}
    assert [x.asDict() for x in r.l] == [{"p": 8, "q": 2}, {"p": 3, "q": 4}, {"p": 6, "q": None}]
    assert {k: v.asDict() for k, v in r.m.items()} == {"k": {"p": 1, "q": 5}, "n": {"p": None, "q": 3}} and r.extra == "new"


def test_deep_merge_keeps_items_without_edits_and_refuses_other_kinds(spark):
    old = spark.sql("select explode(array(1, 2)) as id, named_struct('c', 1) as a, array(1, 2, 3) as l, cast(null as map<string,int>) as m")
    new = spark.sql("select 1 as id, cast(null as struct<c:int>) as a, array(9) as l, map('k', 1) as m")
    got = {r.id: (r.a, r.l, r.m) for r in C.deep_merged(old, new, ["id"]).collect()}
    assert got[1] == ((1,), [9, 2, 3], {"k": 1}) and got[2] == ((1,), [1, 2, 3], None)
    with pytest.raises(TypeError):
        C.deep_merged(old, spark.sql("select 1 as id, 5 as a"), ["id"])


# series


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('[{"x": 1, "y": 2}, {"x": "3", "y": "4px"}, {"x": "Jan", "y": null}]', [(0, 1.0, None, 2.0), (1, 3.0, None, 4.0), (2, None, "Jan", None)]),
        ('[{"x": 1, "y": [5, 6, 7]}, {"x": 2}, {"y": 3}]', [(0, 1.0, None, 7.0), (1, 2.0, None, None), (2, None, None, 3.0)]),
        ('[[1, 2], ["3", "x"], [4, null], [5]]', [(0, 1.0, None, 2.0), (1, 3.0, None, None), (2, 4.0, None, None), (3, 5.0, None, None)]),
        ('[1, null, "3.5kg", "x", -2e3]', [(0, 10.0, None, 1.0), (1, 12.0, None, None), (2, 14.0, None, 3.5), (3, 16.0, None, None), (4, 18.0, None, -2000.0)]),
        ("[]", []), ("{}", []), ("no json", []), (None, []),
    ],
)
def test_series_in_every_form(spark, text, want):
    df = spark.createDataFrame([("s", text)], "name string, data string")
    got = listing.parsed_series(df, "data", 10, 2)
    assert got.columns == ["name", "pos", "x", "label", "y"]
    assert sorted((r.pos, r.x, r.label, r.y) for r in got.collect()) == want


# listings and databases


def test_failing_buckets_are_told_and_skipped(spark, tmp_path):
    for bucket, names in {"one": ["b.png", "a.PNG", "c.txt", "sub/d.png"], "two": ["z.png"]}.items():
        for n in names:
            (tmp_path / bucket / n).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / bucket / n).write_text(n)
    roots = {"two": str(tmp_path / "two"), "gone": str(tmp_path / "gone"), "odd": "nostore://x/y", "one": str(tmp_path / "one")}
    files, told = listing.isolated(spark, roots, [".png"])
    assert {r.bucket: r.ok for r in told.collect()} == {"two": True, "gone": False, "odd": False, "one": True}
    assert {r.bucket for r in told.where("error is null").collect()} == {"two", "one"}
    assert sorted((r.bucket_pos, r.pos, r.key) for r in files.collect()) == [(0, 0, "z.png"), (3, 0, "a.PNG"), (3, 1, "b.png"), (3, 2, "sub/d.png")]


def test_no_bucket_can_be_listed(spark, tmp_path):
    files, told = listing.isolated(spark, {"gone": str(tmp_path / "gone")})
    assert files.collect() == [] and [r.ok for r in told.collect()] == [False]


def test_a_database_is_read_in_ranges_with_the_filter_pushed_down(spark):
    url = "jdbc:derby:memory:ranges;create=true"
    spark.range(1000).selectExpr("id", "id % 7 as v").write.format("jdbc").option("url", url).option("dbtable", "t").save()
    got = listing.jdbc_parts(spark, url, "t", "id", 4)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 1000
    some = got.where('v = 3 and id > 500').select("id")
    assert some.count() == sum(i % 7 == 3 for i in range(501, 1000))
    text = plan_of(some)
    assert "PushedFilters" in text and "EqualTo" in text and "GreaterThan" in text
    spark.range(0).selectExpr("id", "id as v").write.format("jdbc").option("url", url).option("dbtable", "empty").save()
    assert listing.jdbc_parts(spark, url, "empty", "id", 4).count() == 0


# scales


def test_scales_derive_in_the_order_of_their_dependence(spark):
    own = spark.createDataFrame([("a", 1.0, 2.0), ("b", -1.0, 5.0)], "scale string, y_min double, y_max double")
    rules = {"c": ("d", lambda a, b: (a - 1, b + 1)), "d": ("a", lambda a, b: (a * 10, b * 10)), "e": ("none", lambda a, b: (a, b)), "f": ("b", lambda a, b: (-b, -a))}
    got = {r.scale: (r.y_min, r.y_max) for r in T.derived_scales(own, rules).collect()}
    assert got == {"a": (1, 2), "b": (-1, 5), "c": (9, 21), "d": (10, 20), "f": (-5, 1)}
    with pytest.raises(ValueError, match="derive from each other"):
        T.derived_scales(own, {"x": ("y", lambda a, b: (a, b)), "y": ("x", lambda a, b: (a, b))})


def test_hard_limits_hold_what_soft_ones_let_through(spark):
    a, b = T.padded_limits(F.lit(-5.0), F.lit(100.0), soft_low=0.0, hard_low=-8.0, hard_high=100.0)
    assert (value(spark, a), value(spark, b)) == (-8.0, 100.0)


# intervals of very different lengths


def test_long_intervals_meet_in_wider_cells(spark):
    import random

    rng = random.Random(4)
    spans = [(i, 1, rng.randrange(0, 4000), rng.choice((0, 1, 5, 60, 700, 9000, 2_000_000, 10**9))) for i in range(160)]
    df = spark.createDataFrame([(i, k, a, a + n) for i, k, a, n in spans], "id long, k long, a long, b long")
    got = sorted((r.a_id, r.b_id) for r in J.overlaps(df, ["k"], "id", "a", "b", 2).collect())
    assert got == sorted((x[0], y[0]) for x in spans for y in spans if x[0] < y[0] and x[2] <= y[2] + y[3] and y[2] <= x[2] + x[3])
    assert J._celled(df, "a", "b", 2).count() < 160 * 4 * 66 + 160 * 2000


def test_long_clips_overlay_short_ones(spark):
    import random

    rng = random.Random(5)
    side = lambda name, n: [(f"{name}{i}", 1, float(a), float(a + d)) for i in range(n) for a, d in [(rng.randrange(0, 3000), rng.choice((1, 7, 900, 50_000, 8_000_000)))]]
    bg, fg = side("b", 60), side("f", 50)
    frame = lambda rows: spark.createDataFrame(rows, "clip string, k long, start double, end double")
    got = sorted((r.bg_clip, r.fg_clip, r.start, r.end) for r in J.overlaid(frame(bg), frame(fg), ["k"], 3).collect())
    assert got == sorted((x[0], y[0], max(x[2], y[2]), min(x[3], y[3])) for x in bg for y in fg if x[2] < y[3] and y[2] < x[3])


# values


def test_pies_without_positive_values_have_no_angles(spark):
    df = spark.createDataFrame([(1, 3.0), (1, -1.0), (1, 1.0), (2, -4.0), (2, 0.0), (3, None)], "k long, v double")
    got = sorted((r.k, r.angle, r.polar_angle, r.radius) for r in A.pie_angles(df, ["k"], "v").fillna(-9.0, ["radius"]).collect())
    assert got == [(1, 0.0, 120.0, -1 / 3), (1, 90.0, 120.0, 1 / 3), (1, 270.0, 120.0, 1.0), (2, 0.0, 180.0, -9.0), (2, 0.0, 180.0, -9.0), (3, 0.0, 360.0, -9.0)]


def test_boxes_range_over_their_first_and_last_part(spark):
    df = spark.createDataFrame([("box", None, 1.0, 5.0, 2.0, 4.0, None), ("line", 3.0, 0.0, 99.0, 0.0, 99.0, [8.0])], "kind string, y double, o double, c double, lo double, hi double, goals array<double>")
    r = A.y_range(df, [], "kind", "y", {"box": ("o", "c"), "candle": ("lo", "hi")}, "goals").first()
    assert (r.y_min, r.y_max) == (1.0, 8.0)


def test_groups_have_footers_with_their_aggregates(spark):
    df = spark.createDataFrame([(1, 1, "a", 2.0), (1, 1, "a", 3.0), (1, 2, "b", 7.0)], "k long, group_no long, group string, v double")
    got = sorted((r.group_no, r.level, r.n, r.total) for r in W.with_headers(df, ["k"], ["v"], {"total": F.sum("v")}).where("level <> 1").fillna(-1.0, ["total"]).collect())
    assert got == [(1, 0, 2, -1.0), (1, 2, 2, 5.0), (2, 0, 1, -1.0), (2, 2, 1, 7.0)]


def test_numbers_on_axes(spark):
    assert [value(spark, N.decimals_of(F.lit(x))) for x in (3.0, 2.5, 0.125, 1e-12)] == [0, 1, 3, 0]
    label = lambda x, d, span: value(spark, N.axis_label(F.lit(x), F.lit(d), F.lit(span)))
    assert [label(2.25, 2, 100.0), label(2.25, 0, 4.9), label(2.75, 0, 5.0)] == ["2.25", "2.3", "3"]
    height = lambda x, a, b: round(value(spark, N.log_height(F.lit(x), F.lit(a), F.lit(b), 10)), 9)
    assert [height(0.0, 1.0, 1000.0), height(100.0, 1.0, 1000.0), height(0.5, 1.0, 100.0), height(10.0, 0.0, 100.0)] == [0.0, round(2 / 3, 9), 0.25, round(2 / 3, 9)]
    assert value(spark, N.percent_of_ends(F.lit(0.0), F.lit(0.0), F.lit(0.0))) == 0.0 and value(spark, N.percent_of_ends(F.lit(5.0), F.lit(-10.0), F.lit(10.0))) == 25.0
    assert value(spark, N.class_percent(F.lit(5.0), [(0, 10, "a"), (4, 6, "b")], F.lit(0.0), F.lit(100.0))) == 50.0


def test_colours_of_a_scale(spark):
    colour = lambda x: value(spark, N.colour_of(F.lit(x).cast("double"), F.lit(0.0), F.lit(10.0), ["#000000", "#640000", "#64c800"], "#ffffff"))
    assert [colour(x) for x in (0.0, 10.0, 20.0, None, float("nan"))] == ["#000000", "#64c800", "#64c800", "#ffffff", "#ffffff"]
    assert colour(10 / 3) == "#640000" and colour(5 / 3) == "#320000"


def test_registrations_one_after_the_other(spark):
    import random

    rng = random.Random(8)
    users = [(10, "u0", "m0"), (12, "u1", "m9")]
    wanted = [(s, f"u{rng.randrange(25)}", f"m{rng.randrange(25)}", rng.random() < 0.9) for s in range(120)]
    outcomes, created, profiles = C.registered(spark.createDataFrame(wanted, "seq long, username string, email string, password_ok boolean"), spark.createDataFrame(users, "id long, username string, email string"))
    names, mails, want, new = {u for _, u, _ in users}, {m for _, _, m in users}, {}, []
    for s, u, m, ok in wanted:
        want[s] = "password mismatch" if not ok else "username taken" if u in names else "email taken" if m in mails else "created"
        if want[s] == "created":
            names.add(u)
            mails.add(m)
            new.append((13 + len(new), u, m))
    assert {r.seq: r.outcome for r in outcomes.collect()} == want
    assert sorted(tuple(r) for r in created.collect()) == new and sorted(r.user_id for r in profiles.collect()) == [i for i, _, _ in new]
    nothing = C.registered(spark.createDataFrame([], "seq long, username string, email string, password_ok boolean"), spark.createDataFrame(users, "id long, username string, email string"))
    assert all(df.collect() == [] for df in nothing)


def test_whole_exports(spark):
    df = spark.createDataFrame([(2, 'b"x'), (1, None)], "id long, name string")
    lines = lambda **k: [r.line for r in sinks.delimited_lines(df, ["id"], **k).orderBy("line_no").collect()]
    assert lines() == ['"id","name"', '"1",""', '"2","b""x"']
    assert lines(sep="\t", columns=["name"], footer={"name": F.count("name")}) == ['"name"', '""', '"b""x"', '"1"']


def test_the_last_clip_is_held(spark):
    df = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 5, 9), (2, "c", 0, 1)], "k long, clip string, start long, end long")
    assert sorted((r.k, r.clip, r.start, r.end) for r in W.held_last(df, ["k"], hold=3).where("held").collect()) == [(1, "b", 9, 12), (2, "c", 1, 4)]


def test_images_are_whole_to_their_ends(spark):
    png = bytes.fromhex(listing.SIGNATURES["png"] + "0000000D49484452" + "00000010" + "00000020") + b"..."
    gif, jpeg = bytes.fromhex(listing.SIGNATURES["gif"] + "3961" + "4001" + "0700") + b"...", bytes.fromhex(listing.SIGNATURES["jpeg"]) + b"..."
    end = {k: bytes.fromhex(v) for k, v in listing.ENDS.items()}
    files = {1: png + end["png"], 2: png, 3: gif + end["gif"] + b"\0\0", 4: gif, 5: jpeg + end["jpeg"], 6: jpeg, 7: b"GIF8", 8: b"", 9: None, 10: b"text;"}
    got = listing.whole_images(spark.createDataFrame(list(files.items()), "id long, content binary")).collect()
    assert sorted((r.id, r.kind, r.width, r.height) for r in got) == [(1, "png", 16, 32), (3, "gif", 320, 7), (5, "jpeg", None, None)]
    assert value(spark, P.media_kind(F.lit(".mkv"))) == "video"


# written tables


def test_written_tables_go_with_their_process(spark, tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
from pyspark.sql import SparkSession
from lattica.sources.written import written
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}").getOrCreate()
assert written(s.range(5)).count() == 5
import os
assert len([f for f in os.listdir("{tmp_path}") if f.startswith("lattica-")]) == 1
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], capture_output=True, timeout=120)
    assert not list(tmp_path.glob("lattica-*"))
