"""Best-fit packing: pattern packing by non-negative least squares.

Documents become token ids plus one end id; pieces of at most ``capacity``
tokens go into sequences.  Only the histogram of piece lengths (at most
``capacity`` counts, whatever the size of the corpus) reaches the driver.  There,
patterns of one to three lengths that fill a sequence exactly are enumerated,
non-negative least squares fits how often each repeats, the fits are rounded
to what is there, and what is left is packed best fit, longest first, still as
runs of equal lengths.  Pieces then find their place by their rank among the
pieces of their length; the rank comes from counts by (length, salt), with more salts
the more pieces there are, so a length that a third of all pieces share is ranked in
many tasks.  Pieces that fill a sequence need neither plan nor rank.

Results for odd input: a null or empty text is one piece of one token (the end
id); repeated rows are packed each by itself, and ties between pieces of one length go
by doc_id and piece; an empty table gives no rows; a null doc_id is carried; more
columns are ignored.  Texts are read whole, of any length.  The string of a special
token is that token, as ``tokenizers`` has it by default.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

CAPACITY = 2048
END = 0
#: Salts at least, and pieces for each salt.
SALTS = 256
SALT_ROWS = 1 << 21
#: Rows of starts that are sent to all tasks; more are joined by shuffle.
SENT = 1 << 20
#: The one special token of the vocabulary.
SPECIAL = "<|endoftext|>"
#: Choices of a second length that are tried for each first one.
TRIPLES = 6
#: Shares of the fit that are tried, the first that needs the fewest sequences wins.
SHARES = (1.0, 0.95, 0.85, 0.7, 0.5, 0.25, 0.1)
#: Texts with other characters go through ``tokenizers`` itself.
PLAIN = re.compile("[^\\x00-ɏ‐-‧]")


@lru_cache(maxsize=2)
def _encoder(json_path: str, rank_path: str):
    """A function from text to ids (uint32).

    The rank file holds the vocabulary of the JSON file.  The libraries can differ only in
    which characters they count as letters, numbers or spaces; on ``PLAIN`` ones they agree,
    each by itself and each pair (tests/llm/test_packing.py, exhaustively), and
    ranks are five times as fast.  Any other text, and one with the string of the special
    token, is encoded by ``tokenizers`` as a whole.
    """
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole: list = []

    def encode(text: str) -> np.ndarray:
        if (text.isascii() or not PLAIN.search(text)) and SPECIAL not in text:
            return np.asarray(quick.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        if not whole:
            from tokenizers import Tokenizer

            whole.append(Tokenizer.from_file(json_path))
        return np.array(whole[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def pieces(docs: DataFrame, capacity: int = CAPACITY, json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's tokens, cut where longer than ``capacity``."""
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    rank_path = rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(json_path, rank_path)
        for batch in batches:
            of, out = [], ([], [], [], [])
            for row, text in enumerate(batch["text"]):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                raw, n = memoryview(ids.tobytes()), len(ids)
                start, end, k = 0, (n - 1) % capacity + 1, 0
                while start < n:
                    of.append(row)
                    for column, value in zip(out, (k, start, end - start, zlib.crc32(raw[4 * start : 4 * end]))):
                        column.append(value)
                    start, end, k = end, end + capacity, k + 1
            yield pa.record_batch(
                [batch["doc_id"].take(pa.array(of, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {key}, piece int, start long, length long, ids_crc32 long")


def _patterns(counts: np.ndarray) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill a sequence exactly, of lengths that occur."""
    cap = len(counts) - 1
    there = np.flatnonzero(counts)
    out = [(cap, 0, 0)] if counts[cap] else []
    out += [(a, cap - a, 0) for a in there if cap / 2 <= a < cap and counts[cap - a]]
    common = there[np.argsort(-counts[there], kind="stable")]
    for a in there:
        left, found = cap - a, 0
        for b in common:
            c = left - b
            if found == TRIPLES or left < 2:
                break
            if a >= b >= c > 0 and counts[c]:
                out.append((a, b, c))
                found += 1
    return np.array(sorted(set(out)), dtype=np.int64).reshape(-1, 3)


def _least_squares(patterns: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared distance of the lengths used from ``counts``."""
    size = len(counts)
    used = lambda x: np.bincount(patterns.ravel(), np.repeat(x, 3), size)
    hit = patterns > 0
    back = lambda r: (r[patterns] * hit).sum(1)
    goal = counts.astype(float)
    v = np.ones(len(patterns))
    for _ in range(30):
        u = used(v)
        u[0] = 0
        v = back(u)
        norm = np.linalg.norm(v)
        v /= norm
    x, y, t = np.zeros(len(patterns)), np.zeros(len(patterns)), 1.0
    for _ in range(rounds):
        r = goal - used(y)
        r[0] = 0
        new = np.maximum(y + back(r) / norm, 0)
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (was - 1) / t * (new - x), new
    return x


def plan(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Sequences for a histogram of lengths: ([(length, how many), ...], repeats).

    The fit says nothing of how far to round it down, so several shares of it are
    rounded and packed, and the plan with the fewest sequences is taken.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    least = -(-int(left @ np.arange(len(left))) // (len(left) - 1))
    patterns = _patterns(left)
    fit = _least_squares(patterns, left) if len(patterns) else np.zeros(0)
    best, fewest = [], 0
    for share in SHARES:
        groups = _pack_plan(left.copy(), patterns, np.rint(fit * share).astype(np.int64))
        n = sum(repeats for _, repeats in groups)
        if not best or n < fewest:
            best, fewest = groups, n
        if fewest == least:
            break
    return best


def _pack_plan(left: np.ndarray, patterns: np.ndarray, fit: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns repeated as often as ``fit`` says and the lengths allow, then the rest best fit."""
    cap, out = len(left) - 1, []
    for i in np.argsort(-fit, kind="stable"):
        if fit[i] < 1:
            break
        need: dict[int, int] = {}
        for a in patterns[i][patterns[i] > 0].tolist():
            need[a] = need.get(a, 0) + 1
        n = min(int(fit[i]), *(int(left[a]) // m for a, m in need.items()))
        if n > 0:
            for a, m in need.items():
                left[a] -= n * m
            out.append((list(need.items()), n))
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {cap: []}
    for a in range(cap, 0, -1):
        c = int(left[a])
        while c:
            free = min((f for f in open_ if f >= a and open_[f]), default=cap)
            if open_[free]:
                have, bins = open_[free].pop()
            else:
                have, bins = [], c
            m = min(free // a, c)
            full = min(bins, c // m)
            if full < bins and have:
                open_[free].append((have, bins - full))
            open_.setdefault(free - m * a, []).append(([*have, (a, m)], full))
            c -= full * m
    return out + [group for groups in open_.values() for group in groups if group[0]]


def _places(groups: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """For each run of a length in a group: first rank of that length, first sequence, offset, how many to a sequence."""
    rows, next_rank, sequence = [], {}, 0
    for items, repeats in groups:
        offset = 0
        for a, m in items:
            rank = next_rank.get(a, 0)
            rows.append((a, rank, sequence, offset, m))
            next_rank[a], offset = rank + m * repeats, offset + a * m
        sequence += repeats
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 48) + a[:, 1], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3], "m": a[:, 4]}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``cut`` (rows of :func:`pieces`, written).

    Sequences of several pieces are numbered from 0, those of one full piece downwards from -1.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in cut.where(F.col("length") < capacity).groupBy("length").count().collect():  # under ``capacity`` rows
        counts[length] = n
    places, columns = _places(plan(counts)), cut.columns
    salts = max(SALTS, -(-int(counts.sum()) // SALT_ROWS))
    full = cut.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    salted = cut.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # at most ``salts`` rows
    starts = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    if capacity * salts <= SENT:  # rows of 20 bytes
        starts = F.broadcast(starts)
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("within", within).join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            i = np.searchsorted(places["key"], (length << 48) + rank, side="right") - 1
            q, m = rank - places["rank"][i], places["m"][i]
            at = [pa.array(places["sequence"][i] + q // m), pa.array(places["offset"][i] + q % m * length)]
            yield pa.record_batch([*(batch[c] for c in columns), *at], names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.select(*columns, "rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long").unionByName(full)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialise(pieces(docs, capacity), "pieces"), capacity)


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: pieces of the documents and their places in sequences."""
    return pack_documents(docs)
