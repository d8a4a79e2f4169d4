"""Named queries over the test tables, and the SQL that gives the same rows.

Segments are order lines of an order (key o_orderkey, value l_quantity) unless the
name says otherwise.  Quotients and exponentials are rounded to six places, as
sums in another order differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import float32, ieee_divide, to_int
from .operators import arrays, blocks, schedule
from .operators.offsets import RULES, bounds_of, offsets, violations
from .plans import Segments, jit
from .sources import read_table

#: A total order of the lines of an order.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
BLOCK = 128

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LINES = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1"
EXTENTS = "SELECT o_orderkey AS sid, count(l_orderkey) AS extent FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
BOUNDS = f"SELECT sid, CAST(sum(extent) OVER (ORDER BY sid) - extent AS BIGINT) AS lo, CAST(sum(extent) OVER (ORDER BY sid) AS BIGINT) AS hi FROM ({EXTENTS})"


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, sf_dir: str, ordered: bool = False, value: str = "l_quantity") -> Segments:
    return Segments.from_keys(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", value, LINE_ORDER if ordered else ())


def events(spark: SparkSession, sf_dir: str, ordered: bool = False) -> Segments:
    rows = read_table(spark, sf_dir, "events")
    return Segments.from_keys(rows.select("user_id").distinct(), rows, "user_id", "user_id", "value", ("event_id",) if ordered else ())


@query(f"{EXTENTS}")
def segment_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).extent()


@query(BOUNDS)
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offsets(lines(spark, sf_dir).extent())


@query(f"SELECT l_orderkey AS sid, CAST({LINES} AS BIGINT) AS pos, l_quantity AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def segment_make(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binds a flat column of values, laid out by order, to segments by their offsets."""
    ordered = lines(spark, sf_dir, ordered=True)
    bounds = offsets(lines(spark, sf_dir).extent())
    flat = ordered.elements.join(bounds, "sid").select((F.col("lo") + F.col("pos")).alias("pos"), "v")
    return Segments.from_csr(flat, bounds).elements.select("sid", "pos", "v")


def _reduce_sql(kind: str, empty: str) -> str:
    return f"SELECT o_orderkey AS sid, coalesce({kind}(l_quantity), {empty}) AS out FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"


@query(_reduce_sql("sum", "0.0::DOUBLE"))
def reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).reduce("sum")


@query(_reduce_sql("max", "'-infinity'::DOUBLE"))
def reduce_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).reduce("max")


@query(_reduce_sql("min", "'infinity'::DOUBLE"))
def reduce_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).reduce("min")


@query("""
SELECT o_orderkey AS sid, coalesce(max(CAST(l_linenumber AS INTEGER)), -2147483648) AS top, coalesce(min(CAST(l_linenumber AS INTEGER)), 2147483647) AS low
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
""")
def reduce_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lines(spark, sf_dir, value="l_linenumber")
    return s.reduce("max", name="top").join(s.reduce("min", name="low"), "sid")


@query("""
WITH e AS (SELECT l_orderkey AS sid, CASE WHEN l_linenumber = 3 THEN 'nan'::DOUBLE ELSE l_quantity END AS v FROM lineitem)
SELECT o_orderkey AS sid, coalesce(bool_or(isnan(v)), false) AS max_is_nan, coalesce(bool_or(isnan(v)), false) AS min_is_nan, coalesce(bool_or(isnan(v)), false) AS sum_is_nan,
       CASE WHEN coalesce(bool_or(isnan(v)), false) THEN 0.0 ELSE coalesce(max(v), '-infinity'::DOUBLE) END AS finite_max
FROM orders LEFT JOIN e ON sid = o_orderkey GROUP BY 1
""")
def reduce_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN in a segment wins in every reduction."""
    value = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    s = lines(spark, sf_dir, value=value)
    # left joins, as a null sid equals none: its segment is empty, so nothing in it is NaN
    out = s.reduce("max", name="a").join(s.reduce("min", name="b"), "sid", "left").join(s.reduce("sum", name="c"), "sid", "left")
    return out.select("sid", F.isnan("a").alias("max_is_nan"), F.isnan("b").alias("min_is_nan"), F.isnan("c").alias("sum_is_nan"), F.when(F.isnan("a"), F.lit(0.0)).otherwise(F.col("a")).alias("finite_max"))


@query("""
WITH e AS (SELECT l_orderkey AS sid, l_quantity AS v, max(l_quantity) OVER (PARTITION BY l_orderkey) AS m FROM lineitem)
SELECT o_orderkey AS sid, round(coalesce(sum(exp(v - m)), 0.0), 6) AS out FROM orders LEFT JOIN e ON sid = o_orderkey GROUP BY 1
""")
def reduce_captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines(spark, sf_dir).capture("m", "max").reduce("sum", lambda x, m: F.exp(x - m), ["m"])
    return out.select("sid", F.round("out", 6).alias("out"))


@query(f"SELECT l_orderkey AS sid, CAST({LINES} AS BIGINT) AS pos, round(exp(-l_quantity / 10), 6) AS out FROM lineitem")
def map_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, ordered=True).map(lambda x: F.exp(-x / 10)).map_store(lambda x: F.round(x, 6))


@query(f"SELECT l_orderkey AS sid, CAST({LINES} AS BIGINT) AS pos, round(l_quantity * o_totalprice, 6) AS out FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def map_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value times a scalar of its segment."""
    scale = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sid"), F.col("o_totalprice").alias("scale"))
    s = lines(spark, sf_dir, ordered=True).with_scalars(scale)
    return s.map_store(lambda x, k: F.round(x * k, 6), ["scale"])


@query(f"SELECT l_orderkey AS sid, CAST({LINES} AS BIGINT) AS pos, CAST(trunc(l_extendedprice / -7) AS INTEGER) AS out FROM lineitem")
def map_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element type changes: float to integer, towards zero."""
    return lines(spark, sf_dir, ordered=True, value="l_extendedprice").map(lambda x: to_int(x / -7)).map_store(lambda x: x)


@query(f"""
SELECT l_orderkey AS sid, CAST({LINES} AS BIGINT) AS pos,
       CASE WHEN l_linenumber = 1 THEN CASE WHEN l_quantity > 25 THEN 'infinity' WHEN l_quantity < 25 THEN '-infinity' ELSE 'zero' END ELSE 'finite' END AS kind FROM lineitem
""")
def divide_ieee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division by zero gives infinities and NaN (shown as kinds) instead of an error."""
    rows = read_table(spark, sf_dir, "lineitem")
    q = ieee_divide(F.col("l_quantity") - 25, F.col("l_linenumber") - 1)
    s = Segments.from_keys(rows.select("l_orderkey").distinct(), rows, "l_orderkey", "l_orderkey", q, LINE_ORDER)
    kind = F.when(F.isnan("v"), "zero").when(F.col("v") == float("inf"), "infinity").when(F.col("v") == float("-inf"), "-infinity").otherwise("finite")
    return s.elements.select("sid", "pos", kind.alias("kind"))


@query(f"SELECT l_orderkey AS sid, CAST({LINES} AS BIGINT) AS pos, l_quantity * 2 + 1 AS out FROM lineitem")
def map_store_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, ordered=True).map_store(lambda x: x * 2 + 1)


def _softmax_sql(table: str, sid: str, pos: str, value: str) -> str:
    return f"""
WITH e AS (SELECT {sid} AS sid, CAST({pos} AS BIGINT) AS pos, {value} AS v, max({value}) OVER (PARTITION BY {sid}) AS m FROM {table})
SELECT sid, pos, round(exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY sid), 6) AS out FROM e
"""


@query(_softmax_sql("lineitem", "l_orderkey", LINES, "l_quantity"))
def softmax_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, ordered=True).softmax().withColumn("out", F.round("out", 6))


@query(_softmax_sql("events", "user_id", "row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1", "value"))
def softmax_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, ordered=True).softmax().withColumn("out", F.round("out", 6))


@query(_softmax_sql("(SELECT event_id, CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS sid_, value FROM events)", "sid_", "row_number() OVER (PARTITION BY sid_ ORDER BY event_id) - 1", "value"))
def softmax_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment holds half of all elements: its scalars are reduced in parts."""
    rows = read_table(spark, sf_dir, "events").withColumn("user_id", F.when(F.col("event_id") % 2 == 0, F.lit(-1)).otherwise(F.col("user_id")))
    s = Segments.from_keys(rows.select("user_id").distinct(), rows, "user_id", "user_id", "value", ("event_id",))
    return s.spread(400).softmax().withColumn("out", F.round("out", 6))


@query("""
WITH e AS (SELECT vec_id AS sid, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
     t AS (SELECT sid, pos, v, max(v) OVER (PARTITION BY sid) AS m FROM e)
SELECT sid, CAST(pos AS BIGINT) AS pos, round(exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY sid), 6) AS out FROM t
""")
def softmax_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array form: no shuffle."""
    return arrays.softmax(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("out", F.round("out", 6))


@query(f"""
WITH e AS (SELECT l_orderkey AS sid, CAST({LINES} AS BIGINT) AS pos, l_quantity * 0.5 AS v FROM lineitem),
     c AS (SELECT *, sum(v) OVER w AS s, max(v) OVER w AS t, min(v) OVER w AS l FROM e WINDOW w AS (PARTITION BY sid))
SELECT sid, pos, round((v - l) / (t - l + 1) + s, 6) AS out FROM c
""")
def compose_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map, three reductions and a store with three captures, in one shuffle."""
    s = lines(spark, sf_dir, ordered=True).map(lambda x: x * 0.5)
    s = s.capture("s", "sum").capture("t", "max").capture("l", "min")
    return s.map_store(lambda x, s, t, low: F.round((x - low) / (t - low + 1) + s, 6), ["s", "t", "l"])


@query(f"SELECT pos // {BLOCK} AS pid, count(*) AS lanes, count(*) FILTER (pos < n) AS active FROM (SELECT unnest(range(CAST(ceil(n / {BLOCK}.0) AS BIGINT) * {BLOCK})) AS pos, n FROM (SELECT count(*) AS n FROM events)) GROUP BY 1")
def block_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "events").count()
    blocks.validate_launch(n, n, BLOCK, -(-n // BLOCK))
    return blocks.grid(spark, n, BLOCK).groupBy("pid").agg(F.count("*").alias("lanes"), F.count_if("active").alias("active"))


@query("SELECT event_id AS pos, CAST(CAST(value AS FLOAT) + CAST(value * 0.5 AS FLOAT) AS DOUBLE) AS out FROM events")
def block_vector_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("value").alias("x"), (F.col("value") * 0.5).alias("y"))
    n = rows.count()
    return blocks.vector_add(rows, "x", "y", n).select("pos", F.col("out").cast("double").alias("out"))


@query(f"""
WITH g AS (SELECT unnest(range(CAST(ceil(n / {BLOCK}.0) AS BIGINT) * {BLOCK})) AS pos, n FROM (SELECT count(*) AS n FROM events))
SELECT pos, pos // {BLOCK} AS pid, pos % {BLOCK} AS lane, CASE WHEN pos < n AND pos % {BLOCK} % 3 <> 0 THEN value ELSE 7.0 END AS x FROM g LEFT JOIN events ON event_id = pos
""")
def block_masked_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask made of two conditions; lanes outside get the given value."""
    data = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), "value")
    n = data.count()
    mask = blocks.bounds_mask(F.col("pos"), n) & (F.col("lane") % 3 != 0)
    return blocks.load(blocks.grid(spark, n, BLOCK), data, "value", mask, other=7.0).select("pos", "pid", "lane", "x")


@query(f"SELECT event_id AS pos, event_id // {BLOCK} AS pid, CAST(CAST(value AS FLOAT) AS DOUBLE) AS out FROM events WHERE event_id < (SELECT count(*) FROM events) - 5 AND event_id % {BLOCK} < 100")
def block_masked_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that store the first hundred lanes of all but the last five elements."""
    rows = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), float32(F.col("value")).alias("x"))
    n = rows.count()
    mask = blocks.bounds_mask(F.col("pos"), n - 5) & (blocks.lane(F.col("pos"), BLOCK) < 100)
    out = blocks.store(rows, F.col("x"), mask)
    return out.select("pos", blocks.program_id(F.col("pos"), BLOCK).alias("pid"), F.col("out").cast("double").alias("out"))


@jit
def scaled_sum(data: DataFrame, SCALE: int, n: int = 0) -> DataFrame:
    """(sid, out): sums of scaled values whose positions are under n, as a program."""
    held = Segments(data.select("sid").distinct(), data.where(F.col("pos") < n).select("sid", "v"))
    return held.reduce("sum", lambda x: x * SCALE)


@query("SELECT user_id AS sid, coalesce(sum(CAST(round(value * 100) AS BIGINT) * 3) FILTER (event_id < (SELECT count(*) FROM events) // 2), 0)::BIGINT AS out FROM events GROUP BY 1")
def program_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deferred program, planned with its constants and the schema its input must have."""
    rows = read_table(spark, sf_dir, "events")
    data = rows.select(F.col("user_id").alias("sid"), F.col("event_id").alias("pos"), F.round(F.col("value") * 100).cast("bigint").alias("v"))
    return scaled_sum.plan(data, {"SCALE": 3, "n": rows.count() // 2}, schema=data.schema)


@query(f"SELECT l_orderkey AS sid, CAST({LINES} AS BIGINT) AS pos, CAST(CAST(l_extendedprice / 3 AS FLOAT) AS DOUBLE) AS out FROM lineitem")
def map_float32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element type narrows to single precision."""
    s = lines(spark, sf_dir, ordered=True, value="l_extendedprice").map(lambda x: float32(x / 3))
    return s.map_store(lambda x: x.cast("double"))


@query(f"""
WITH b AS ({BOUNDS}), n AS (SELECT count(*) AS c FROM lineitem),
     bad AS (SELECT sid, CASE WHEN sid % 10 = 3 THEN lo + 1 ELSE lo END + 2 AS lo, hi + 2 AS hi FROM b),
     r AS (SELECT *, lag(hi) OVER (ORDER BY sid) AS before FROM bad)
SELECT 'bad' AS offsets, count(*) AS segments, count(*) FILTER (lo < 0 OR hi < 0) AS negative, count(*) FILTER (hi < lo) AS backward, count(*) FILTER (hi > c) AS beyond,
       count(*) FILTER (before IS NULL AND lo <> 0) AS late_start, count(*) FILTER (lo > before) AS gap, count(*) FILTER (lo < before) AS overlap, count(*) FILTER (abs(lo) > 2147483647 OR abs(hi) > 2147483647) AS wide FROM r, n
UNION ALL SELECT 'good', count(*), 0, 0, 0, 0, 0, 0, 0 FROM b
UNION ALL SELECT 'list', 4, 0, 1, 1, 1, 0, 0, 0
""")
def validate_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many segments break each rule: of good offsets, of shifted ones with holes, and of a list."""
    bounds, n = segment_offsets(spark, sf_dir), read_table(spark, sf_dir, "lineitem").count()
    moved = F.col("lo") + F.when(F.col("sid") % 10 == 3, 3).otherwise(2)
    bad = bounds.select("sid", moved.alias("lo"), (F.col("hi") + 2).alias("hi"))
    cases = {"good": (bounds, n), "bad": (bad, n), "list": (bounds_of(spark, [1, 4, 3, 5, 9]), 8)}
    found = [violations(b, most).select(F.lit(name).alias("offsets"), "segments", *RULES) for name, (b, most) in cases.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"SELECT CAST(lo // 128 AS BIGINT) AS task, count(*) AS segments, CAST(sum(hi - lo) AS BIGINT) AS elements FROM ({BOUNDS}) GROUP BY 1")
def schedule_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = schedule.pack(segment_offsets(spark, sf_dir))
    return packed.groupBy("task").agg(F.count("*").alias("segments"), F.sum(F.col("hi") - F.col("lo")).alias("elements"))


@query(f"SELECT CASE WHEN extent = 0 THEN 'empty' WHEN extent <= 3 THEN 'short' WHEN extent <= 6 THEN 'medium' ELSE 'long' END AS class, count(*) AS segments, CAST(sum(extent) AS BIGINT) AS elements FROM ({EXTENTS}) GROUP BY 1")
def schedule_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    extents = lines(spark, sf_dir).extent().withColumn("class", schedule.length_class(F.col("extent"), 3, 6))
    return extents.groupBy("class").agg(F.count("*").alias("segments"), F.sum("extent").alias("elements"))


@query("SELECT user_id AS sid, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS out FROM events GROUP BY 1")
def schedule_split_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events")
    elements = rows.select(F.col("user_id").alias("sid"), F.round(F.col("value") * 100).cast("bigint").alias("v"), "event_id")
    return schedule.split_merge(Segments(rows.select(F.col("user_id").alias("sid")).distinct(), elements), "sum", F.col("event_id"))


@query(_reduce_sql("sum", "0.0::DOUBLE"))
def schedule_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer segments split and merged, the others at once."""
    orders, rows = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    elements = rows.select(F.col("l_orderkey").alias("sid"), F.col("l_quantity").alias("v"), "l_partkey")
    return schedule.mixed(Segments(orders.select(F.col("o_orderkey").alias("sid")), elements), "sum", F.col("l_partkey"), limit=6)


@query("SELECT vec_id AS sid, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total, CAST(list_max(embedding) AS DOUBLE) AS top, CAST(list_min(embedding) AS DOUBLE) AS low FROM embeddings")
def sequential_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding")
    rows = read_table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("sid"), F.round(arrays.fold("sum", x), 5).alias("total"), arrays.fold("max", x).alias("top"), arrays.fold("min", x).alias("low"))


@query("""
WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents)
SELECT doc_id AS sid, count(*) AS extent, CAST(max(length(token)) AS INTEGER) AS longest FROM t GROUP BY 1
""")
def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of a text's tokens as a segment."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", " "), F.length).alias("lengths"))
    return rows.select(F.col("doc_id").alias("sid"), F.size("lengths").cast("bigint").alias("extent"), arrays.fold("max", F.col("lengths"), "int").alias("longest"))


@query(f"SELECT l_orderkey AS sid, CAST({LINES} AS BIGINT) AS pos, round(l_quantity * l_discount, 6) AS out FROM lineitem")
def zip_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map over two segments of equal extent."""
    a, b = lines(spark, sf_dir, ordered=True), lines(spark, sf_dir, ordered=True, value="l_discount")
    return a.zip(b, lambda x, y: F.round(x * y, 6))


@query("""
SELECT conv_id AS sid, turn AS pos, length(text) - min(length(text)) OVER (PARTITION BY conv_id) AS out FROM conversations
""")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn lengths above the shortest of the conversation."""
    rows = read_table(spark, sf_dir, "conversations").withColumn("n", F.length("text").cast("bigint"))
    s = Segments.from_keys(rows.select("conv_id").distinct(), rows, "conv_id", "conv_id", "n", ("turn",))
    return s.capture("low", "min").map_store(lambda x, low: x - low, ["low"])
