"""Segments: golden values, edge semantics and errors."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella import CompilationError, Segments, jit
from tessella.functions import ieee_divide
from tessella.operators import arrays, blocks, schedule
from tessella.operators.offsets import bounds_of, offsets, require, violations
from tessella.plans import region_type
from tessella.report import report
from tessella.sources import write_aligned

INF = math.inf
#: Lengths of segments that stand for a shape each.
SHAPES = {
    "nothing": [0],
    "one value": [1],
    "alike": [40] * 5,
    "a chunk and a bit": [4096, 1],
    "lopsided": [3, 900, 1, 5200, 0],
    "holes": [0, 0, 4, 0, 7, 0],
    "falling": list(range(60, 0, -7)),
}


def value(i):
    """Eighths, so sums are exact in any order."""
    return (i * 7 % 23 - 9) / 8


def ends(lengths):
    out = [0]
    for n in lengths:
        out.append(out[-1] + n)
    return out


def csr(spark, values, offs, kind="float"):
    flat = spark.createDataFrame(list(enumerate(values)) or [], f"pos bigint, v {kind}")
    return Segments.from_csr(flat, bounds_of(spark, offs))


def by_sid(df, column="out"):
    return [r[column] for r in df.orderBy("sid").collect()]


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(spark, name):
    offs = ends(SHAPES[name])
    values = [value(i) for i in range(offs[-1])]
    held = [values[a:b] for a, b in zip(offs, offs[1:])]
    s = csr(spark, values, offs)
    for kind, fold, empty in (("sum", sum, 0), ("max", max, -INF), ("min", min, INF)):
        want = [fold(x) if x else empty for x in held]
        assert by_sid(s.reduce(kind)) == want
        assert by_sid(schedule.split_merge(s, kind, F.col("at"))) == want
        assert by_sid(schedule.mixed(s, kind, F.col("at"), limit=100)) == want
    assert by_sid(s.extent(), "extent") == SHAPES[name]


def test_values_that_no_segment_holds(spark):
    assert by_sid(csr(spark, [6.0, 0.5, 8.0], [0, 0, 2, 2]).reduce("sum")) == [0, 6.5, 0]


def test_nan_wins(spark):
    s = csr(spark, [math.nan, 2.5, 7.0, 6.0], [0, 2, 2, 4])
    for kind, empty, last in (("max", -INF, 7.0), ("min", INF, 6.0), ("sum", 0.0, 13.0)):
        for out in (by_sid(s.reduce(kind)), by_sid(schedule.split_merge(s, kind, F.col("at")))):
            assert math.isnan(out[0]) and out[1:] == [empty, last]


@pytest.mark.parametrize("kind,low,high", [("int", -(2**31), 2**31 - 1), ("bigint", -(2**63), 2**63 - 1), ("smallint", -(2**15), 2**15 - 1), ("tinyint", -128, 127)])
def test_integer_identities(spark, kind, low, high):
    s = csr(spark, [], [0, 0], kind)
    assert by_sid(s.reduce("max")) == [low] and by_sid(s.reduce("min")) == [high] and by_sid(s.reduce("sum")) == [0]


def test_no_segments(spark):
    s = csr(spark, [], [0])
    assert s.reduce("sum").count() == 0 and s.extent().count() == 0


def test_repeatable(spark):
    s = csr(spark, [value(i) for i in range(300)], ends([250, 0, 50]))
    assert by_sid(s.reduce("sum")) == by_sid(s.reduce("sum"))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 6), min_size=1, max_size=8))
def test_softmax_sums_to_one(spark, lengths):
    offs = ends(lengths)
    s = csr(spark, [value(i) * 400 for i in range(offs[-1])], offs, "double")
    out = s.softmax().groupBy("sid").agg(F.sum("out").alias("p")).collect()
    assert len(out) == sum(n > 0 for n in lengths)
    assert all(abs(r["p"] - 1) < 1e-9 for r in out)


def test_array_and_long_forms_agree(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0, 700.0]), (1, []), (2, [-3.5])], "sid bigint, xs array<double>")
    a = sorted(map(tuple, arrays.softmax(rows, "sid", "xs").collect()))
    b = sorted(map(tuple, Segments.from_arrays(rows, "sid", "xs").softmax().select("sid", "pos", "out").collect()))
    assert [x[:2] for x in a] == [x[:2] for x in b] and all(abs(x[2] - y[2]) < 1e-12 for x, y in zip(a, b))
    got = rows.select("sid", arrays.fold("sum", F.col("xs")).alias("s"), arrays.fold("max", F.col("xs")).alias("m"), arrays.fold("min", F.col("xs")).alias("l")).orderBy("sid").collect()
    assert [tuple(r) for r in got] == [(0, 703.0, 700.0, 1.0), (1, 0.0, -INF, INF), (2, -3.5, -3.5, -3.5)]
    cut = rows.select(arrays.slice_of(F.col("xs"), F.lit(0), F.size("xs")).alias("x")).collect()
    assert [r["x"] for r in cut] == [[1.0, 2.0, 700.0], [], [-3.5]]


def test_captures_share_one_shuffle(spark):
    s = Segments.from_keys(spark.range(3).select(F.col("id").alias("k")), spark.range(10).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v")), "k", "k", "v", ("v",))
    plan = s.softmax()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_null_values_raise(spark):
    rows = spark.createDataFrame([(1, None)], "k int, v double")
    with pytest.raises(Exception, match="must not be null"):
        Segments.from_keys(rows, rows, "k", "k", "v").reduce("sum").collect()


def test_region_errors(spark):
    s = csr(spark, [1.0], [0, 1]).capture("m", "max")
    for bad, text in (
        (lambda: s.map(lambda x: F.col("m")), "nothing but"),  # a column that is not captured
        (lambda: s.map(lambda x, m: x), "captures"),
        (lambda: s.map(lambda x: x, ["m"]), "captures"),
        (lambda: s.map(lambda x, q: x, ["q"]), "unknown capture"),
        (lambda: s.map(lambda x: x.cast("string")), "must yield"),
        (lambda: s.map(lambda x: F.sum(x)), "nothing but"),
        (lambda: s.map(lambda x: x + F.rand()), "deterministic"),
        (lambda: s.map(lambda x: 3), "must return a column"),
        (lambda: s.reduce("mul"), "unknown reduction kind"),
        (lambda: schedule.split_merge(s, "mul", F.col("at")), "unknown reduction kind"),
        (lambda: csr(spark, ["a"], [0, 1], "string"), "element type"),
    ):
        with pytest.raises(CompilationError, match=text):
            bad()
    assert region_type(spark, lambda x: x.cast("int"), s.kind).simpleString() == "int"


def test_zip(spark):
    a, b = csr(spark, [1.0, 2.0, 3.0], [0, 1, 3]), csr(spark, [4.0, 5.0, 6.0], [0, 1, 3])
    assert sorted(r["out"] for r in a.zip(b, lambda x, y: x * y).collect()) == [4, 10, 18]
    with pytest.raises(Exception, match="equal extents"):
        a.zip(csr(spark, [4.0, 5.0, 6.0], [0, 2, 3]), lambda x, y: x * y).collect()


@pytest.mark.parametrize("offs,values,outputs,text", [([2, 3], 3, 1, "late_start: 1"), ([0, -4], 1, 1, "negative: 1; backward: 1"), ([0, 5, 3], 5, 2, "backward: 1"), ([0, 7, 9], 8, 2, "beyond: 1"), ([0, 1, 2], 2, 1, "2 segments for 1 outputs"), ([0], -1, 0, "sizes"), ([0], 0, 1 << 31, "sizes"), ([0, 1 << 32], 5, 1, "wide: 1")])
def test_broken_offsets(spark, offs, values, outputs, text):
    with pytest.raises(CompilationError, match=text):
        require(bounds_of(spark, offs), values, outputs)


def test_good_offsets(spark):
    require(bounds_of(spark, [0, 0, 4, 9]), 9, 3)
    require(bounds_of(spark, [0]), 0)
    with pytest.raises(CompilationError, match="at least one"):
        bounds_of(spark, [])


def test_offsets_and_violations(spark):
    lengths = [3, 0, 2, 5, 0, 1]
    for ids in (range(6), [-5, 0, 1, 2, 10**12, 10**15]):  # dense, and far apart
        extents = spark.createDataFrame(list(zip(ids, lengths)), "sid bigint, extent bigint")
        for buckets in (1, 2, 100):
            out = offsets(extents, buckets=buckets)
            got = [(r["lo"], r["hi"]) for r in out.orderBy("sid").collect()]
            assert got == list(zip(ends(lengths), ends(lengths)[1:]))
            assert set(violations(out, 11, buckets).drop("segments").first()) == {0}
            torn = out.where(F.col("sid") != ids[2])  # its two positions are now a gap
            assert violations(torn, 11, buckets).first()["gap"] == 1
    assert offsets(extents.limit(0)).count() == 0
    bad = spark.createDataFrame([(0, -1, 2), (1, 2, 1), (2, 0, 9)], "sid bigint, lo bigint, hi bigint")
    for buckets in (1, 3):
        assert violations(bad, 8, buckets).first().asDict() == {"segments": 3, "negative": 1, "backward": 1, "beyond": 1, "late_start": 1, "gap": 0, "overlap": 1, "wide": 0}


def test_spread_captures(spark):
    """A segment with most elements gets its captures in parts, with the window's results."""
    offs = ends([2000, 3, 0, 40])
    s = csr(spark, [value(i) for i in range(offs[-1])], offs, "double")
    key = lambda df: sorted((r["sid"], r["pos"], round(r["out"], 12)) for r in df.collect())
    wide = s.spread(100).softmax()
    assert key(wide) == key(s.softmax()) and "Window" not in wide._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 4097])
def test_vector_add(spark, n):
    data = spark.range(5000).select(F.col("id").alias("pos"), F.col("id").cast("float").alias("x"), (F.col("id") * 2).cast("float").alias("y"))
    blocks.validate_launch(n, 5000, 128, -(-n // 128))
    out = blocks.vector_add(data, "x", "y", n).orderBy("pos").collect()
    assert [r["out"] for r in out] == [3.0 * i for i in range(n)]
    lanes = blocks.grid(spark, n, 128)
    assert lanes.count() == -(-n // 128) * 128 and lanes.where("active").count() == n


@pytest.mark.parametrize("args,text", [((1, 1, 0, 1), "BLOCK"), ((1, 1, True, 1), "BLOCK"), ((2, 1, 128, 1), "element count"), ((-1, 1, 128, 0), "element count"), ((1, 1, 128, 2), "grid")])
def test_launch_errors(args, text):
    with pytest.raises(CompilationError, match=text):
        blocks.validate_launch(*args)


def test_ieee_division(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (math.nan, 0.0)], "n double, d double")
    out = [r[0] for r in rows.select(ieee_divide(F.col("n"), F.col("d"))).collect()]
    assert out[0] == INF and out[1] == -INF and math.isnan(out[2]) and out[3] == 0.25 and math.isnan(out[4])


def test_programs(spark, tmp_path):
    @jit
    def add(data, BLOCK, n):
        return blocks.vector_add(data, "x", "y", n)

    data = spark.createDataFrame([(0, 1.0, 2.0)], "pos bigint, x float, y float")
    with pytest.raises(CompilationError, match="plan"):
        add(data)
    with pytest.raises(CompilationError, match="missing constants"):
        add.plan(data, {"n": 1})
    with pytest.raises(CompilationError, match="signature"):
        add.plan(data, {"n": 1, "BLOCK": 128}, schema=spark.range(1).schema)
    with pytest.raises(CompilationError, match=r"test_segments.py:\d+:\d+: add"):
        add.plan(spark.range(1), {"n": 1, "BLOCK": 128})
    assert add.plan(data, {"n": 1, "BLOCK": 128}, schema=data.schema).first()["out"] == 3.0
    add.run(data, str(tmp_path / "out"), {"n": 1, "BLOCK": 128})
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(CompilationError, match="plain names"):
        jit(lambda *data: None)


def test_aligned_write(spark, tmp_path):
    s = csr(spark, [1.0, 2.0, 3.0], [0, 1, 3])
    write_aligned(s.map_store(lambda x: x * 2), str(tmp_path / "w"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "w")).collect())) == [(0, 0, 2.0), (1, 0, 4.0), (1, 1, 6.0)]


def test_report_never_fails(spark):
    assert "pyspark" in report(spark) and "python" in report(object())
