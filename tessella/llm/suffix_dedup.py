"""Repeated passages by a sparse suffix array.

A text is a sequence of words.  Of all suffixes those at content-selected
positions are retained: where the hash of ``K`` words is the least of ``window``
neighbours (a minimiser).  Any passage of ``min_words`` holds a minimiser within its
first ``window`` positions, so with part = min_words - window + 1 the first ``part``
words of a retained suffix stand wholly in it, wherever the passage repeats.

Suffixes are named by a 64-bit hash of their first ``part`` words, and names that
several documents hold are shared.  A window of ``min_words`` words can only repeat
if the name at its first minimiser is shared: of those windows, and no others, the
whole words are hashed, and each is looked up among all documents' windows.  One that an earlier
document holds is reported, overlapping and touching ones as one passage.

So a word is reported if and only if it stands in a passage of ``min_words`` words that
a document with a smaller doc_id holds, whichever that is (but for collisions of
64-bit hashes).  A document is compared with all others, not with one that stands for
them.  Comparing sorted suffixes with their neighbours only would not do: a neighbour may hold
part of a passage that another document holds whole.  So equal suffixes are brought
together by name, and matches are extended to both sides by looking the windows around
them up.  Repeats inside one document don't count.

Results for odd input: null and empty texts have no passages.  Texts are searched
whole, of any length.  Rows of one doc_id count as one document.  Of several documents
that hold a passage the one with the smallest doc_id is named.  Rows without doc_id are neither
searched nor cut.  More columns are carried by :func:`cut`; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import grams, materialise, slices, table, utf8, word_hashes, words

MIN_WORDS = 50
K = 8
WINDOW = 26
CHUNK = 4 << 20
#: Rows from which a name may be frequent, and names that can be.
FREQUENT = 1 << 10
PLACES = "name long, doc_id long, start int"


def _sliding(x: np.ndarray, size: int, least) -> np.ndarray:
    """Least (or greatest) of each ``size`` consecutive entries."""
    have = 1
    n = len(x) - size + 1
    while have * 2 <= size:
        x = least(x[:-have], x[have:])
        have *= 2
    return least(x[:n], x[size - have : size - have + n])


def suffixes(h: np.ndarray, first: np.ndarray, min_words: int, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, text numbers and start words of retained suffixes; ``h`` word hashes, ``first`` each text's first word (n + 1)."""
    part = min_words - window + 1
    none = np.zeros(0, np.int64)
    if len(h) < min_words:
        return none.view(np.uint64), none, none
    kg, names = grams(h, k), grams(h, part)
    end_of = np.repeat(first[1:], np.diff(first))  # for each word, where its text ends
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low = _sliding(kg, window, np.minimum)
    low = np.where(np.arange(len(low)) + window + k - 1 <= end_of[: len(low)], low, 0)
    pad = np.zeros(window - 1, np.uint64)
    p = np.flatnonzero(_sliding(np.concatenate((pad, low, pad)), window, np.maximum)[: len(kg)] == kg)
    start = p[p < len(names)]
    text = text_of[start]
    ok = (start + part <= end_of[start]) & (np.diff(first)[text] >= min_words)
    start, text = start[ok], text[ok]
    return names[start], text, start - first[text]


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K, window: int = WINDOW) -> DataFrame:
    """Repeated passages: doc_id, start_word, end_word (exclusive), first_doc_id (the smallest that holds a part of it)."""
    part = min_words - window + 1
    if part < k or window < 1:
        raise ValueError("min_words must be at least window + k - 1")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for a, b in slices(offsets, CHUNK):
                starts, ends, first = words(data, offsets[a : b + 1])
                name, text, start = suffixes(word_hashes(data, starts, ends), first, min_words, k, window)
                yield _places(name, ids[a:b][text], start)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            ids, counts = batch["doc_id"].to_numpy(), pc.list_value_length(batch["asked"]).to_numpy()
            asked, bound = batch["asked"].flatten().to_numpy(), np.append(0, np.cumsum(counts))
            for a, b in slices(offsets, CHUNK):
                starts, ends, first = words(data, offsets[a : b + 1])
                h = word_hashes(data, starts, ends)
                name = grams(h, min_words)
                if not len(name):
                    continue
                kg, shared = grams(h, k), np.repeat(first[:-1], counts[a:b]) + asked[bound[a] : bound[b]]
                least = np.full(len(kg), np.iinfo(np.uint64).max)
                shared = shared[shared < len(kg)]
                least[shared] = kg[shared]
                same = (_sliding(least, window, np.minimum) == _sliding(kg, window, np.minimum))[: len(name)]
                text_of = np.repeat(np.arange(b - a), np.diff(first))[: len(name)]
                s = np.flatnonzero(same & (np.arange(len(name)) + min_words <= first[1:][text_of]))
                yield _places(name[s], ids[a:b][text_of[s]], s - first[text_of[s]])

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = materialise(rows.mapInArrow(select, PLACES), "suffixes")
    few, hot = _shared(names)
    asked = _cold(names, few, hot).drop("first_doc_id").unionByName(names.where(_among(hot)))
    asked = asked.groupBy("doc_id").agg(F.collect_list("start").alias("asked"))  # at most one for each word of the document
    held = materialise(rows.join(asked, "doc_id").mapInArrow(windows, PLACES), "windows")
    few, hot = _shared(held)
    found = _cold(held, few, hot).where("first_doc_id < doc_id").select("doc_id", "start", (F.col("start") + min_words).alias("end"), "first_doc_id")
    spans = _merged(found.unionByName(_hot_stretches(held, hot, min_words)), ["doc_id"], F.min("first_doc_id").alias("first_doc_id"))
    return spans.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "first_doc_id")


def _places(name: np.ndarray, doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(name.view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int32))], names=["name", "doc_id", "start"])


def _shared(places: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Names of ``places`` that several documents hold, with the first of these: a table, and those of very frequent names.

    Rows of a very frequent name stay where they are: these names, at most ``FREQUENT`` of
    them, are sent to all tasks, and the rows of the others are shuffled by name.
    """
    held = places.groupBy("name").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    held = materialise(held.where("first_doc_id < last").drop("last"), "shared")
    most = max(FREQUENT, (held.agg(F.sum("n")).first()[0] or 0) // FREQUENT)
    hot = {r["name"]: r["first_doc_id"] for r in held.where(F.col("n") > most).select("name", "first_doc_id").collect()}
    return held.where(F.col("n") <= most).select("name", "first_doc_id"), hot


def _among(hot: dict[int, int]) -> Column:
    return F.col("name").isin(sorted(hot)) if hot else F.lit(False)


def _cold(places: DataFrame, few: DataFrame, hot: dict[int, int]) -> DataFrame:
    """Those of ``places`` whose names several documents hold, with the first of these; without very frequent names."""
    return places.where(~_among(hot)).join(few, "name")


def _hot_stretches(places: DataFrame, hot: dict[int, int], min_words: int) -> DataFrame:
    """doc_id, start, end, first_doc_id of the windows of very frequent names that an earlier document holds, those that follow each other in a document as one."""
    name = np.array(sorted(hot), np.int64)
    first_of = np.array([hot[x] for x in name.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, doc, start = first_of[np.searchsorted(name, batch["name"].to_numpy())], batch["doc_id"].to_numpy(), batch["start"].to_numpy()
            later = first < doc
            first, doc, start = first[later], doc[later], start[later]
            if len(doc):
                step = np.diff(start)
                begin = np.append(0, np.flatnonzero((doc[1:] != doc[:-1]) | (step < 0) | (step > min_words)) + 1)
                end = start[np.append(begin[1:], len(doc)) - 1] + np.int32(min_words)
                yield pa.record_batch([pa.array(doc[begin]), pa.array(start[begin]), pa.array(end), pa.array(np.minimum.reduceat(first, begin))], names=["doc_id", "start", "end", "first_doc_id"])

    return places.where(_among(hot)).mapInArrow(run, "doc_id long, start int, end int, first_doc_id long")


def _merged(pieces: DataFrame, key: list[str], *aggregates: Column) -> DataFrame:
    """Stretches (start, end) of a key that touch become one."""
    order = Window.partitionBy(*key).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("start") > before, F.lit(True)).cast("int")
    runs = pieces.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *aggregates).drop("run")


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the words of ``spans`` and the white space after them; n_chars follows, where there is one."""
    held = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("__spans"))
    columns, schema = docs.columns, docs.schema

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            texts, spans_of = batch["text"].to_pylist(), batch["__spans"].to_pylist()
            for i, found in enumerate(spans_of):
                if found:
                    own = data[offsets[i] : offsets[i + 1]]
                    starts, _, _ = words(own, np.array([0, len(own)]))
                    edge, raw, at, kept = np.append(starts, len(own)).tolist(), own.tobytes(), 0, []
                    for x in found:
                        kept.append(raw[at : edge[x["start_word"]]])
                        at = edge[x["end_word"]]
                    texts[i] = b"".join([*kept, raw[at:]]).decode()
            out = {c: batch[c] for c in columns} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                out["n_chars"] = pa.array([n if not f else len(t) for n, f, t in zip(batch["n_chars"].to_pylist(), spans_of, texts)], batch["n_chars"].type)
            yield pa.record_batch([out[c] for c in columns], names=columns)

    return docs.join(held, "doc_id", "left").select(*columns, "__spans").mapInArrow(remove, schema)


def op6_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: passages that an earlier document holds are cut; the documents stay."""
    return cut(docs, repeats(docs))
