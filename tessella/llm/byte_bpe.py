"""Byte-level BPE: every distinct pre-token is encoded once, globally.

Texts are split into pre-tokens and dealt to blocks of about ``BLOCK_BYTES``.  A
block sends each pre-token that occurs in it once, to the task that its hash
names, many to a row and compressed.  Equal pre-tokens of all blocks meet there,
bucket by bucket, and each distinct one is encoded once.  Its ids are joined back to
the blocks that asked for it, and there documents are put together by position.  So what is
shuffled for words is one entry per block and distinct word instead of one per
occurrence, and a very frequent word has one entry per block.  For decoding the ids
of a block's words are joined with the token-byte table, whose size is the
vocabulary's and which every task gets.  There are as many buckets as
``BUCKET_BYTES`` of text need, so a task holds the words of one bucket however large the input.

The texts are read twice, once for words and once for positions, and both must
see the same blocks.  That holds for a table of files; pass ``stable=False`` for
any other input, which is then written to the shared folder first.  The bytes
decoded in a block are compared with the checksum of its words, so a difference
would stop the job instead of giving wrong ids.

Results for odd input: a null text counts as empty, which has no ids (the digest
of no bytes).  Special tokens' strings are ordinary text.  Repeated rows give a
row each, also in :func:`decode`; a null doc_id is carried; texts of any length are
encoded whole; more columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table, utf8

BLOCK_BYTES = 16 << 20
#: Buckets of words for each shuffle partition, and characters of text for one bucket.
BUCKETS = 4
BUCKET_BYTES = 64 << 20
CHANGED = "the texts changed between two reads; pass stable=False"


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _merger(path: str, pattern: str):
    """A function from one pre-token to its ids."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def token_bytes(path: str) -> pa.Table:
    """The token-byte table: id, piece."""
    pieces, ids = zip(*load_ranks(path).items())
    return pa.table([pa.array(ids, pa.int64()), pa.array(pieces, pa.binary())], names=["id", "piece"])


def _pieces(path: str, ids: np.ndarray) -> list[bytes]:
    """Bytes of each of ``ids``, by a join with the token-byte table; an id outside it raises."""
    asked = pa.table([pa.array(ids.astype(np.int64)), pa.array(np.arange(len(ids)))], names=["id", "at"])
    joined = asked.join(token_bytes(path), "id", join_type="inner").sort_by("at")
    if len(joined) != len(ids):
        raise RuntimeError("an id is not in the token-byte table")
    return joined["piece"].to_pylist()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Numbers of blocks and their rows, of which there is at least one."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        _, offsets = utf8(batch["text"])
        for start, end in slices(offsets, BLOCK_BYTES):
            yield block, batch.slice(start, end - start)
            block += 1


def encode(docs: DataFrame, rank_path: str | None = None, pattern: str = public_tokenizers.PATTERN, stable: bool = False, emit: str = "ids") -> DataFrame:
    """Rows (doc_id, ids array<int>), or with ``emit="digest"`` (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    rank_path = rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    key = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", "text")
    if not stable:
        docs = materialise(docs, "texts")

    small = np.dtype("<u2" if max(load_ranks(rank_path).values()) < 1 << 16 else "<u4")

    whole = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-whole // BUCKET_BYTES))

    def bucket_of(seen: Iterable[str]) -> tuple[np.ndarray, list[bytes]]:
        raw = [w.encode() for w in seen]
        return np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) % np.uint32(buckets), raw

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        for block, rows in _blocks(batches):
            seen: dict[str, None] = {}
            for text in rows["text"]:
                seen.update(dict.fromkeys(split(text.as_py() or "")))
            of, raw = bucket_of(seen)
            order = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1))
            lengths, sorted_ = np.fromiter(map(len, raw), np.uint32, len(raw))[order], [raw[i] for i in order.tolist()]
            parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if len(raw) else []
            yield pa.record_batch(
                [
                    pa.array([block] * len(parts), pa.int64()), pa.array([int(of[order[i]]) for i, _ in parts], pa.int32()),
                    pa.array([zstandard.compress(lengths[i:j].tobytes()) for i, j in parts], pa.binary()), pa.array([zstandard.compress(b"".join(sorted_[i:j])) for i, j in parts], pa.binary()),
                ],
                names=["block", "bucket", "lengths", "words"],
            )

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        for block, rows in _blocks(batches):
            numbers: defaultdict[str, int] = defaultdict(count().__next__)
            number, at, sizes = numbers.__getitem__, [], []
            for text in rows["text"]:
                found = split(text.as_py() or "")
                at.append(np.fromiter(map(number, found), np.uint32, len(found)))
                sizes.append(len(found))
            sent = [
                pa.array([block], pa.int64()),
                pa.array([rows["doc_id"].to_pylist()], pa.list_(rows["doc_id"].type)),
                pa.array([sizes], pa.list_(pa.int32())),
                pa.array([zstandard.compress(np.concatenate(at).tobytes(), 1)], pa.binary()),
                pa.array([zstandard.compress(bucket_of(numbers)[0].tobytes(), 1)], pa.binary()),
                pa.array([zlib.crc32("".join(numbers).encode())], pa.int64()),
            ]
            yield pa.record_batch(sent, names=["block", "doc_ids", "sizes", "at", "buckets", "checksum"])

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, known, last = _merger(rank_path, pattern), {}, None
        for batch in batches:
            sizes, out = [], []
            for bucket, lengths, words in zip(*(batch[c].to_pylist() for c in ("bucket", "lengths", "words"))):
                if bucket != last:  # rows come bucket by bucket, and a word is in one
                    known, last = {}, bucket
                text, at, ids = zstandard.decompress(words), 0, []
                for n in np.frombuffer(zstandard.decompress(lengths), np.uint32).tolist():
                    word = text[at : at + n]
                    at += n
                    found = known.get(word)
                    if found is None:
                        known[word] = found = np.array(ids_of(word.decode()), small).tobytes()
                    ids.append(found)
                sizes.append(zstandard.compress(np.fromiter(map(len, ids), np.uint32, len(ids)).tobytes()))
                out.append(zstandard.compress(b"".join(ids)))
            yield pa.record_batch([batch["block"], batch["bucket"], pa.array(sizes, pa.binary()), pa.array(out, pa.binary())], names=["block", "bucket", "sizes", "ids"])

    def assemble(block: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("bucket")
        of = np.frombuffer(zstandard.decompress(block["buckets"][0].as_py()), np.uint32)
        flat = np.frombuffer(b"".join(map(zstandard.decompress, found["ids"].to_pylist())), small)
        ends = np.cumsum(np.frombuffer(b"".join(map(zstandard.decompress, found["sizes"].to_pylist())), np.uint32).astype(np.int64) // small.itemsize)
        if len(ends) != len(of):
            raise RuntimeError(CHANGED)
        ids: list[list[int]] = [[]] * len(of)
        decoded = [b""] * len(of)
        pieces = _pieces(rank_path, flat)
        for number, a, b in zip(np.argsort(of, kind="stable").tolist(), np.append(0, ends[:-1]).tolist(), ends.tolist()):
            ids[number], decoded[number] = flat[a:b].tolist(), b"".join(pieces[a:b])
        if block.num_rows != 1 or zlib.crc32(b"".join(decoded)) != block["checksum"][0].as_py():
            raise RuntimeError(CHANGED)
        sizes, names = block["sizes"][0].as_py(), block["doc_ids"].chunk(0)[0].values
        at, start = np.frombuffer(zstandard.decompress(block["at"][0].as_py()), np.uint32), 0
        if emit == "ids":
            flat = np.fromiter((i for x in ids for i in x), np.int32)  # by number
            lengths = np.array([len(x) for x in ids] or [0])
            first = np.concatenate(([0], np.cumsum(lengths)))
            out, bounds = [], [0]
            for n in sizes:
                out += [flat[first[w] : first[w + 1]] for w in at[start : start + n]]
                bounds.append(bounds[-1] + int(lengths[at[start : start + n]].sum()) if n else bounds[-1])
                start += n
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32)))
            return pa.table([names, lists], names=["doc_id", "ids"])
        digits = [b" ".join([b"%d" % i for i in x]) for x in ids]
        lengths = np.array([len(x) for x in ids] or [0])
        rows: tuple[list, list, list] = ([], [], [])
        for n in sizes:
            own = at[start : start + n]
            listed, start = own.tolist(), start + n
            rows[0].append(int(lengths[own].sum()))
            rows[1].append(hashlib.sha256(b" ".join([digits[w] for w in listed])).hexdigest())
            rows[2].append(hashlib.sha256(b"".join([decoded[w] for w in listed])).hexdigest())
        return pa.table([names, pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = key.simpleString()
    asked = docs.mapInArrow(words, "block long, bucket int, lengths binary, words binary")
    found = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(encode_words, "block long, bucket int, sizes binary, ids binary")
    blocks = docs.mapInArrow(positions, f"block long, doc_ids array<{kind}>, sizes array<int>, at binary, buckets binary, checksum long")
    shape = f"doc_id {kind}, ids array<int>" if emit == "ids" else f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(assemble, shape)


def decode(encoded: DataFrame, rank_path: str | None = None) -> DataFrame:
    """Rows (doc_id, bytes) from rows (doc_id, ids), one for each: tokens are joined with the token-byte table, which has the vocabulary's size.

    Rows are told apart by number, so doc_id may repeat or be null; one without ids has no bytes.
    """
    spark = encoded.sparkSession
    ranks = load_ranks(rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = spark.createDataFrame([(r, bytearray(b)) for b, r in ranks.items()], "id int, piece binary")
    numbered = materialise(encoded.select("doc_id", "ids", F.monotonically_increasing_id().alias("row")), "encoded")
    each = numbered.select("row", "doc_id", F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(tokens), "id", "left")
    ordered = F.sort_array(F.collect_list(F.struct("at", F.hex("piece").alias("piece"))))  # of one document
    out = each.groupBy("row", "doc_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["piece"]), "")).alias("bytes"))
    return out.select("doc_id", "bytes")


def op9_word_shuffle_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), stable=True, emit="digest")
