"""Sharding by balanced label propagation.  Native: DataFrame functions only.

Documents with equal texts are linked.  Every document starts in a shard that its
id's hash names; the parts of a text too frequent for one atom (below) start in as
many shards in a row as they fill.  In each round linked documents move towards the shard that
holds most of their neighbours and has room; a shard takes in no larger share of
those that ask than its quota of rows, with those that leave, allows.  Documents
move in atoms, the documents of one text, or a hashed part of them where the text
has more than 1 / (shards * ``PARTS``) of all rows, so that a text with a third of
all rows fills shard after shard and no task ever holds it whole.

Then the law ``rows`` is made exact: documents are lined up by label, in each label
unlinked ones on both sides of the linked ones, and the line is cut into shards
whose sizes are at most one row apart, so that a label that is a little too large
or small gives or takes unlinked documents.  Ranks come from counts of buckets.

Only sums by shard (16 rows a round) reach the driver.

Results for odd input: a null text counts as an empty one, of size 1, and equals it.
Repeated rows are documents of their own.  Null doc_ids hash like any value.  With
fewer rows than shards some shards are empty; an empty table gives no rows; more
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

SHARDS = 16
PARTS = 32
ROUNDS = 8
#: Room above the mean that a shard may use while labels move.
SLACK = 1.02


def _propagate(atoms: DataFrame, alone: dict[int, int], rows: int, shards: int, rounds: int) -> DataFrame:
    """``atoms`` (g, part, shard, n: rows of the atom in the shard) after moving; at most one row for each settled atom."""
    most = rows / shards * SLACK
    for turn in range(rounds):
        load = dict(alone)
        for s, n in atoms.groupBy("shard").agg(F.sum("n")).collect():  # one row a shard
            load[s] = load.get(s, 0) + n
        room = {s: most - load.get(s, 0) for s in range(shards)}
        least = 0.002 * rows / shards
        mine = atoms.groupBy("g", "part").agg(F.sum("n").alias("all"), F.count("*").alias("places"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("own"))  # at most one entry a shard
        near = atoms.groupBy("g", "shard").agg(F.sum("n").alias("votes"))
        full = [s for s in room if room[s] < least]
        choice = F.struct(F.when(F.col("shard").isin(full), 0).otherwise(1).alias("free"), "votes", F.xxhash64("g", "shard").alias("tie"), "shard")
        asked = mine.where("places > 1").join(near, "g").groupBy("g", "part").agg(F.max(choice).alias("to"), F.first("all").alias("all"), F.first("own").alias("own"))
        asked = asked.select("g", "part", "all", "own", F.col("to.shard").alias("to"), (F.col("all") - F.coalesce(F.element_at("own", F.col("to.shard")), F.lit(0))).alias("incoming"))
        asked = materialise(asked, "asked")
        comes = dict(asked.groupBy("to").agg(F.sum("incoming")).collect())
        if not comes:
            break
        goes = dict(asked.select("to", F.explode("own").alias("shard", "n")).where("shard <> to").groupBy("shard").agg(F.sum("n")).collect())
        share = {s: min(1.0, max(0.0, (max(room[s], 0) + goes.get(s, 0)) / n)) for s, n in comes.items() if n}
        chance = F.element_at(F.create_map(*(x for s, v in sorted(share.items()) for x in (F.lit(s), F.lit(v)))), F.col("to")) if share else F.lit(1.0)
        draw = F.pmod(F.xxhash64(F.lit(turn), "g", "part"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        moved = asked.where(draw < F.coalesce(chance, F.lit(1.0))).select("g", "part", F.col("to").alias("shard"), F.col("all").alias("n"))
        atoms = materialise(atoms.join(moved.select("g", "part"), ["g", "part"], "left_anti").unionByName(moved), "atoms")
    return atoms


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = materialise(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("g")), "sizes")
    rows = base.count()
    linked = materialise(base.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "linked")
    most = max(1, min(64, rows // (shards * 4)), rows // (shards * PARTS))
    part = F.when(F.col("n") > most, F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.ceil(F.col("n") / most))).otherwise(0).cast("int")
    labelled = base.join(linked, "g", "left").select(*base.columns, "n", F.col("n").isNotNull().alias("bound"), F.coalesce(part, F.lit(0)).alias("part"))
    turn = F.floor(F.col("part") * most / F.lit(max(1.0, rows / shards)))
    shard = F.when(F.col("n") > most, F.pmod(F.pmod(F.xxhash64("g"), F.lit(shards)) + turn, F.lit(shards))).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(shards))).cast("int")
    labelled = labelled.withColumn("shard", shard).drop("n")
    labelled = materialise(labelled, "labelled")
    alone = {s: n for s, n in labelled.where("not bound").groupBy("shard").count().collect()}
    atoms = materialise(labelled.where("bound").groupBy("g", "part", "shard").agg(F.count("*").alias("n")), "atoms")
    settled = _propagate(atoms, alone, rows, shards, rounds).groupBy("g", "part").agg(F.count("*").alias("places"), F.min("shard").alias("to")).where("places = 1")
    settled = materialise(settled.select("g", "part", "to"), "settled")

    spread = min(4096, max(64, rows // (shards * 20_000)))
    placed = labelled.join(settled, ["g", "part"], "left").withColumn("label", F.coalesce("to", "shard"))
    side = F.when(F.col("bound"), 1).otherwise(F.pmod(F.xxhash64(F.lit("side"), "doc_id"), F.lit(2)) * 2).cast("int")
    bucket = F.pmod(F.xxhash64(F.when(F.col("bound"), F.xxhash64("g", "part")).otherwise(F.xxhash64("doc_id"))), F.lit(spread)).cast("int")
    lined = materialise(placed.select("doc_id", "size", "text_crc32", "g", "part", "label", side.alias("side"), bucket.alias("bucket")), "lined")
    place = ["label", "side", "bucket"]
    # at most shards * 3 * spread rows in one task
    starts = lined.groupBy(*place).agg(F.count("*").alias("n"))
    starts = materialise(starts.withColumn("start", F.sum("n").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).select(*place, "start"), "starts")
    within = F.row_number().over(Window.partitionBy(*place).orderBy("g", "part", "doc_id")) - 1
    at = lined.withColumn("within", within).join(starts, place).withColumn("p", F.col("start") + F.col("within"))
    out = at.withColumn("shard", F.expr(f"cast((p * {shards}) div {max(rows, 1)} as int)"))
    first = F.expr(f"(shard * {rows}L + {shards - 1}) div {shards}")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("p") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
