"""Exact dedup by deterministic block naming.  Native: DataFrame functions only.

A normalised text is cut into blocks of ``block_bytes`` bytes.  Distinct blocks
get names, then adjacent pairs of names get names, until one name is left for
each text.  Texts are equal if and only if number of blocks and name are equal.

A name has two integers, (bucket, rank): blocks are dealt to 2^64 buckets by a
hash of their content and ranked inside the bucket in sorted order.  Nearly all
buckets hold one block, whose rank is 0, so ranks travel back to rows only for
buckets with more; a row computes its bucket itself.  Thus the bytes of the
blocks move once, reduced on the map side (a hot group of copies sends one row
per task), and there is never a global order in one task.

Results for odd input: a null text counts as empty; an empty text is one empty
block.  Rows that repeat (same doc_id and text) each get a row of the result and
count in the group's size.  A null doc_id is kept if it has no other.  An empty
table gives no rows; more columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

BLOCK_BYTES = 16384
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _bucket(cols: list[str], buckets: int | None) -> Column:
    h = F.xxhash64(*cols)
    return h if buckets is None else F.pmod(h, F.lit(buckets))


def _named(rows: DataFrame, ids: list[str], key: list[str], buckets: int | None, tag: str) -> DataFrame:
    """``rows`` (ids + key) with the key replaced by its name (h, rk)."""
    rows = rows.withColumn("h", _bucket(key, buckets))
    distinct = rows.select("h", *key).distinct()
    crowded = materialise(distinct.groupBy("h").count().where("count > 1").select("h"), f"{tag}-crowded")
    out = rows.select(*ids, "h", F.lit(0).alias("rk"))
    if crowded.isEmpty():
        return out
    ranked = distinct.join(crowded, "h", "left_semi").withColumn("rk", F.row_number().over(Window.partitionBy("h").orderBy(*key)) - 1)
    ranked = materialise(ranked, f"{tag}-ranks")
    same = [rows["h"] == ranked["h"], *(rows[k].eqNullSafe(ranked[k]) for k in key)]
    return rows.join(ranked, same, "left").select(*(rows[c] for c in ids), rows["h"], F.coalesce(ranked["rk"], F.lit(0)).alias("rk"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """One row per different (doc_id, text): doc_id, sha, copies, nb, h, rk; (nb, h, rk) names the text.

    ``buckets`` makes the hash weaker, for tests of crowded buckets.
    """
    text = docs.select("doc_id", normalised(F.col("text")).alias("t"))
    whole = text.select("doc_id", F.unhex(F.sha2("t", 256)).alias("sha"), F.encode("t", "UTF-8").alias("b"))
    whole = whole.withColumn("nb", F.greatest(F.ceil(F.octet_length("b") / F.lit(block_bytes)), F.lit(1)).cast("int"))
    first = whole.select(
        "doc_id", "sha", "nb",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: F.substring("b", i * block_bytes + 1, F.lit(block_bytes)))).alias("i", "block"),
    )
    row = ["doc_id", "sha", "nb", "i"]
    names = _named(first, row, ["block"], buckets, "blocks")
    names = materialise(names.groupBy(*row, "h", "rk").agg(F.count("*").alias("copies")), "names0")
    longest = names.agg(F.max("nb")).first()[0] or 1
    done = names.where("nb = 1")
    width, level = 1, 0
    rest = names.where("nb > 1")
    while width < longest:
        level, width = level + 1, width * 2
        own = [*row[:-1], F.floor(F.col("i") / 2).cast("int").alias("i")]
        side = lambda c, odd: F.max(F.when(F.col("i") % 2 == odd, F.col(c)))
        pairs = rest.groupBy(*own).agg(side("h", 0).alias("lh"), side("rk", 0).alias("lr"), side("h", 1).alias("rh"), side("rk", 1).alias("rr"), F.max("copies").alias("copies"))
        rest = materialise(_named(pairs, [*row, "copies"], ["lh", "lr", "rh", "rr"], buckets, f"pairs{level}"), f"names{level}")
        done = done.unionByName(rest.where((F.col("nb") > width // 2) & (F.col("nb") <= width)))
        rest = rest.where(F.col("nb") > width)
    return materialise(done.select("doc_id", "sha", "copies", "nb", "h", "rk"), "identities")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """For each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    ids = identities(docs, block_bytes, buckets)
    name = ["nb", "h", "rk"]
    groups = materialise(ids.groupBy(*name).agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    rows = ids.join(groups, name).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "copies",
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the row with the smallest doc_id stays (repeated rows of it, and rows without doc_id, all stay)."""
    dropped = exact_dedup(docs).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
