"""Language-model scores by a probabilistic suffix tree over words.

Contexts are the last 1 to ``MAX_DEPTH`` words before a token, with the start of the text as a
word; each is a table entry keyed by a hash, so the tree grows with the corpus.  A context
is a candidate if it occurs at least ``LEAST`` times, less often than its suffix (the context
without its first word), and if none of its suffixes is followed by one word only: else its
distribution is its suffix's.  That is what ends a branch; ``MAX_DEPTH`` bounds all of them.
A candidate s is retained if its next-word distribution diverges from its suffix's:

    sum over words w of c(s w) ln( c(s w) / n(s) / P'(w | suffix) )  >  k(s) / 2 ln N

with n(s) the occurrences, k(s) the number of different next words and N all training tokens.
P' is smoothed along all suffixes, P along the retained ones, from the add-one estimate over
words, so that probabilities sum to one over all words and one unknown word:

    P(w | s) = (c(s w) + WEIGHT P(w | suffix)) / (n(s) + WEIGHT)

A token is scored in the longest retained context; score sums log10 P.

All counts cover all training texts and nothing is sampled.  Texts are split into words
once, into blocks of ``BLOCK_BYTES``, which send every distinct n-gram once, with its count,
to the task that its hash names, and get the total back, as sorted and compressed
lists; contexts whose counts alone prove that they can't be retained are not tested, and
not followed where that holds for all longer ones.  Two words that occur once, in no text
held out, or never, tell the counts of all longer n-grams that end with them, so these are
not asked for.  So there is one entry per block and n-gram, however frequent, and no list of what
follows a word exists anywhere.  Six exchanges follow each other: counts of 1 and 2 words, in two halves;
tests of contexts of 1 word, and counts of 3 words for the tokens whose contexts go on;
tests of 2 words, and counts of 4; tests of 3 words, and counts of longer n-grams, again only for
tokens whose contexts go on, as most n-grams of 4 words occur once; tests of the longer contexts.
Of blocks' work only the tokens that wait for tests of over 2 words are written, and all
answers, dealt like the blocks once the questions' files are gone, so that they move once; a block works out again what it asked before.  A test
sums over the tokens of all blocks, as k(s) is the sum of 1 / c(s w) over tokens.  Tasks
hold about ``ENTRIES`` entries, whatever the input, and the blocks themselves never move.

Hashes have ``BITS`` bits of each word and n-gram; colliding ones would share a count.

Results for odd input: a null or empty text is the end token alone.  If nothing is
left to train on, all counts are 0 and score equals base_score.  Texts of any length are
scored whole.  Repeated rows give a row each, and are learned from as often; a null doc_id
counts as held out nowhere (its crc32 is null) and is trained on; more columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bucketed, discard, distinct, materialise, mix, slices, table, utf8, word_hashes, words

MAX_DEPTH = 5
#: Occurrences of a candidate.
LEAST = 2
#: A state counts as this many observations of its suffix's distribution.
WEIGHT = 4.0
#: Texts of a block, and texts that are hashed at a time.
BLOCK_BYTES = 5 << 20
CHUNK = 2 << 20
#: N-grams that a task adds up.
ENTRIES = 2 << 20
BITS = 52
#: Entries from which an array's bytes are compressed one by one.
LONG = 4096
#: Stand for the end and the start of a text among word hashes.
END, START = np.uint64(1), np.uint64(2)
ODD = np.uint64(0x9E3779B97F4A7C15)


def tokenised(docs: DataFrame) -> DataFrame:
    """Blocks of tokens, written: ids, held-out flags and numbers of tokens of the texts, the place of each token in words (packed), distinct words' hashes, those of frequent words first, as small places pack well."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for start, end in slices(offsets, BLOCK_BYTES):
                known, places, sizes = [], [], []
                for a, b in slices(offsets[start : end + 1], CHUNK):
                    lo, hi = offsets[start + a], offsets[start + b]
                    starts, ends, first = words(data[lo:hi], offsets[start + a : start + b + 1] - lo)
                    n = np.diff(first)
                    h = np.full(len(starts) + len(n), END, np.uint64)  # an end after each text
                    h[np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)] = word_hashes(data[lo:hi], starts, ends, lower=True) >> np.uint64(64 - BITS)
                    for column, x in zip((known, places), np.unique(h, return_inverse=True)):
                        column.append(x)
                    sizes.append(n + 1)
                u = distinct(np.concatenate(known))[0]
                at = np.concatenate([np.searchsorted(u, k).astype(np.uint32)[i] for k, i in zip(known, places)])
                order = np.argsort(-np.bincount(at, minlength=len(u)), kind="stable")  # equally frequent ones by hash
                place = np.empty(len(u), np.uint32)
                place[order] = np.arange(len(u), dtype=np.uint32)
                part = batch.slice(start, end - start)
                held = part["held"].to_numpy(zero_copy_only=False).astype(bool)
                yield _row(block, -1, part["doc_id"], _packed(held, np.concatenate(sizes), place[at], u[order]))
                block += 1

    rows = docs.select("doc_id", F.coalesce("held", F.lit(False)).alias("held"), "text")
    whole = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(100_000, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), whole // (4 * BLOCK_BYTES)))
    return bucketed(rows.mapInArrow(blocks, _shape(kind)), "block", buckets, "blocks")


def _shape(kind: str) -> str:
    return f"block long, part int, doc_ids array<{kind}>, data binary"


def _row(block: int, part: int, ids: pa.Array, data: bytes) -> pa.RecordBatch:
    listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.record_batch([pa.array([block], pa.int64()), pa.array([part], pa.int32()), listed, pa.array([data], pa.binary())], names=["block", "part", "doc_ids", "data"])


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, byte by byte, those of 64 bits without sign as differences, which are small where they are sorted; of long arrays each byte is compressed by itself, as its own frequencies tell more."""
    squeeze = zstandard.ZstdCompressor(level=1).compress

    def one(x: np.ndarray) -> tuple[str, bytes | list[bytes]]:
        y = np.diff(x, prepend=np.uint64(0)) if x.dtype == np.uint64 else x
        planes = np.ascontiguousarray(y.view(np.uint8).reshape(-1, x.itemsize).T)
        return x.dtype.str, [squeeze(plane) for plane in planes] if len(x) >= LONG else planes.tobytes()

    return squeeze(pickle.dumps([one(np.ascontiguousarray(x)) for x in arrays], protocol=5))


def _unpacked(data: bytes) -> list[np.ndarray]:
    spread = zstandard.ZstdDecompressor().decompress

    def back(kind: str, planes: bytes | list[bytes]) -> np.ndarray:
        found = np.frombuffer(planes if isinstance(planes, bytes) else b"".join(map(spread, planes)), np.uint8)
        y = found.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()
        return np.cumsum(y, dtype=np.uint64) if y.dtype == np.uint64 else y

    return [back(*x) for x in pickle.loads(spread(data))]


def _key(h: np.ndarray, single: bool = False) -> np.ndarray:
    """``BITS`` bits of a hash; the last one tells single words."""
    return h >> np.uint64(64 - BITS) | np.uint64(1) if single else h >> np.uint64(64 - BITS) & ~np.uint64(1)


class Tokens:
    """Words of a block's texts in a row, each text with a start before and an end after it."""

    def __init__(self, held: np.ndarray, sizes: np.ndarray, at: np.ndarray, u: np.ndarray) -> None:
        self.held, self.sizes, self.u = held, sizes, u
        length = sizes + 1
        self.text = np.repeat(np.arange(len(sizes), dtype=np.int32), length)
        self.age = (np.arange(len(self.text)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)  # 0 at a start
        self.place = np.full(len(self.text), len(u), np.uint32)  # among the words, of which a start is the last
        self.place[self.age > 0] = at
        self.words = np.append(u, START)[self.place]
        self.single = mix(np.append(u, START) * ODD + np.uint64(1))
        self.train = ~held[self.text]

    def keys(self, orders: range, only: np.ndarray | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each order, positions where that many words end and these n-grams' keys; ``only`` some positions."""
        p = np.arange(len(self.words)) if only is None else only
        g, out = self.single[self.place[p]], {}
        for n in range(1, orders[-1] + 1):
            ok = self.age[p] >= n - 1
            if not ok.all():
                p, g = p[ok], g[ok]
            if n > 1:
                g = mix(g * ODD + self.words[p - n + 1] + np.uint64(n))
            if n in orders:
                out[n] = p, _key(g, n == 1)
        return out


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the place of each key among them, by one sort: of numbers made of a key's first bits and its position, if they fit."""
    bits = max(len(keys) - 1, 1).bit_length()
    lost = np.uint64(max(0, BITS + bits - 64))
    order = (np.sort(keys >> lost << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    ordered = keys[order]
    if (ordered[1:] < ordered[:-1]).any():  # keys that differ in their last bits only
        order = np.argsort(keys)
        ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], at


def _marked(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the distinct ``keys`` in order that are at ``places``, and the place of each among them."""
    mark = np.zeros(len(keys), bool)
    mark[places] = True
    return keys[mark], (np.cumsum(mark, dtype=np.int32) - 1)[places]


def _dealt(parts: int, keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted keys."""
    bounds = np.searchsorted(keys, (np.arange(parts + 1, dtype=object) * (1 << BITS) // parts).astype(np.uint64))
    return [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]


def _asks(block: int, parts: int, ids: pa.Array, counted: tuple, tested: tuple) -> Iterator[pa.RecordBatch]:
    """Rows that ask for totals of n-grams (keys, counts) and for tests of contexts (keys, what divergence exceeds its threshold by)."""
    a, b = ({i: (x, y) for i, x, y in _dealt(parts, keys)} for keys in (counted[0], tested[0]))
    for i in sorted({*a, *b}):
        (x, y), (v, w) = a.get(i, (0, 0)), b.get(i, (0, 0))
        yield _row(block, i, ids[:0], _packed(counted[0][x:y], counted[1][x:y].astype(np.uint32), tested[0][v:w], tested[1][v:w].astype(np.float32)))


def _added(rows: pa.Table, alone: bool) -> pa.Table:
    """Answers the asks of one part: totals (if ``alone``, 1 only where one block alone asks, else one more than there are), and which contexts are retained."""
    rows = rows.sort_by("block").combine_chunks()  # sums in the same order whenever a task runs again
    asked = [_unpacked(x) for x in rows["data"].to_pylist()]
    every = [[x[j] for x in asked] for j in range(4)]
    u, back = _ranks(np.concatenate(every[0]))
    totals = np.bincount(back, np.concatenate(every[1]), len(u)).astype(np.int64)
    if alone:
        totals += (totals > 1) | (totals == 1) & (np.bincount(back, minlength=len(u)) > 1)
    totals = totals[back]
    u, back = _ranks(np.concatenate(every[2]))
    kept = (np.bincount(back, np.concatenate(every[3]), len(u)) > 1e-9)[back]
    first, second = (np.append(0, np.cumsum([len(x) for x in every[j]])) for j in (0, 2))
    data = [_packed(totals[a:b], kept[c:d]) for a, b, c, d in zip(first, first[1:], second, second[1:])]
    words_ = np.full(len(data), 0)
    words_[:1] = len(distinct(np.concatenate(every[0])[(totals > 0) & (np.concatenate(every[0]) & np.uint64(1) > 0)])[0])
    return pa.table([rows["block"], rows["part"], pa.array(data, pa.binary()), pa.array(words_)], names=["block", "part", "data", "words"])


def _answers(found: pa.Table, turn: int, counted: int, tested: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals of a block's n-grams and which of its contexts are retained, by the answers to what it asked at a turn."""
    rows = zip(*(found[c].to_pylist() for c in ("turn", "part", "data")))
    parts = [_unpacked(data) for _, _, data in sorted((r for r in rows if r[0] == turn), key=lambda r: r[1])]
    totals, kept = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in parts)]), np.concatenate([np.zeros(0, bool), *(x[1] for x in parts)])
    if (len(totals), len(kept)) != (counted, tested):
        raise RuntimeError("a block's answers don't fit its questions")
    return totals, kept


def _alone(totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals, and which n-grams occur once and are asked for by this block alone, of answers that tell these apart."""
    return totals - (totals > 1), totals == 1


def _smoothed(c: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (c + WEIGHT * p) / (n + WEIGHT)


def _may_diverge(n: np.ndarray, c: np.ndarray, suffix: np.ndarray, tokens: int) -> np.ndarray:
    """Which contexts can be retained that occur ``n`` times, ``c`` times before one word, and whose suffixes occur ``suffix`` times.

    P'(w | suffix) is at least c(s w) / (n(suffix) + WEIGHT), so the sum over words is at most n ln((n(suffix) + WEIGHT) / n); k is at least 2 if a word follows, but not always.
    """
    return n * np.log((suffix + WEIGHT) / n) > 0.5 * np.log(max(tokens, 2)) * (1 + ((c > 0) & (c < n)))


def _may_deepen(n: np.ndarray, tokens: int) -> np.ndarray:
    """Which contexts that occur ``n`` times can have longer ones that :func:`_may_diverge`: m ln((n + WEIGHT) / m) is at most (n + WEIGHT) / e."""
    return n + WEIGHT > 0.5 * np.e * np.log(max(tokens, 2))


class Levels:
    """Counts along the contexts of some tokens, one depth after the other."""

    def __init__(self, p: np.ndarray, root: np.ndarray, all_: int) -> None:
        self.at, self.chain, self.p = p, root, root  # P' and P
        self.open = np.ones(len(p), bool)  # no shorter context has one next word only
        self.n = np.full(len(p), all_)
        self.steps: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def step(self, n: np.ndarray, c: np.ndarray, tokens: int = 0) -> np.ndarray:
        """To contexts of one word more that occur ``n`` times, ``c`` times before the token; which are asked for: of those with a suffix, with the number of ``tokens``, only what :func:`_may_diverge`."""
        asked = (n >= LEAST) & (n < self.n) & self.open
        if tokens:
            asked[asked] = _may_diverge(n[asked], c[asked], self.n[asked], tokens)
        self.steps.append((n, c, asked, self.chain))
        self.chain = np.where(n >= LEAST, _smoothed(c, n, self.chain), self.chain)
        self.open = self.open & (c < n) & (n >= LEAST)
        self.n = n
        return asked

    def over(self, depth: int, train: np.ndarray, tokens: int) -> np.ndarray:
        """Of contexts that were asked for, each token's part of the divergence less its part of the threshold (1 / c sums to k); 0 unless it is trained on."""
        n, c, asked, chain = self.steps[depth]
        n, c = np.maximum(n[asked], 1), np.maximum(c[asked], 1)
        return np.where(train[asked], np.log(c / n) - np.log(chain[asked]) - 0.5 * np.log(max(tokens, 2)) / c, 0)

    def use(self, depth: int, kept: np.ndarray) -> None:
        n, c, _, _ = self.steps[depth]
        self.p = np.where(kept, _smoothed(c, n, self.p), self.p)


def _kept(kept: np.ndarray, asked: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which tokens' contexts are retained; those ``asked`` for are at the places ``at``."""
    out = np.zeros(len(asked), bool)
    out[asked] = kept[at]
    return out


def score_blocks(blocks: DataFrame, depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """doc_id, held_out, n_tokens, n_known, base_score, score for each text of ``blocks``, and the number of training tokens."""
    if depth < 3:
        raise ValueError("contexts of at least three words")
    spark, kind = blocks.sparkSession, blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def opened(batch) -> Iterator[tuple[int, pa.Array, Tokens]]:
        for i in range(len(batch["block"])):
            yield batch["block"][i].as_py(), batch["doc_ids"][i].values, Tokens(*_unpacked(batch["data"][i].as_py()))

    def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [x[1][~x[0]] for x in map(_unpacked, batch["data"].to_pylist())]
            yield pa.record_batch([pa.array([int(x.sum()) for x in n], pa.int64()), pa.array(list(map(len, n)), pa.int64())], names=["tokens", "texts"])

    zero = F.lit(0).cast("long")
    total, texts = blocks.select("data").mapInArrow(count_tokens, "tokens long, texts long").agg(F.coalesce(F.sum("tokens"), zero), F.coalesce(F.sum("texts"), zero)).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ENTRIES))

    def asked_keys(x: Tokens, orders: range, only: np.ndarray | None = None) -> tuple[dict, np.ndarray, np.ndarray]:
        """n-grams of ``orders``: positions, keys and places among the distinct keys; these in order; and the places of single words, which belong to all positions."""
        found = x.keys(orders, only) if orders and (only is None or len(only)) else {}
        one = _key(x.single, True) if only is None else np.zeros(0, np.uint64)
        u, at = _ranks(np.concatenate([one, *(k for _, k in found.values())]))
        single, *places = np.split(at, np.cumsum([len(one), *(len(p) for p, _ in found.values())])[:-1])
        return {n: (p, k, a) for (n, (p, k)), a in zip(found.items(), places)}, u, single

    def counted(x: Tokens, found: dict, u: np.ndarray) -> np.ndarray:
        """How often each distinct key stands in the training texts of the block."""
        return np.bincount(np.concatenate([np.zeros(0, np.int32), *(at[x.train[p]] for p, _, at in found.values())]), minlength=len(u))

    def spread(x: Tokens, found: dict, totals: np.ndarray) -> list[np.ndarray]:
        """Counts by position of each order."""
        out = []
        for p, _, at in found.values():
            out.append(np.zeros(len(x.words), np.int64))
            out[-1][p] = totals[at]
        return out

    def on(x: Tokens, p: np.ndarray, levels: Levels, mine: np.ndarray, d: int) -> np.ndarray:
        """Those of the tokens ``p`` whose contexts of ``d`` words, which occur ``mine`` times where they end, go on: they or longer ones can be retained."""
        n = mine[p - 1]
        out = levels.open & (x.age[p] >= d) & (n >= LEAST)
        out[out] = _may_deepen(n[out], total) | _may_diverge(n[out], np.zeros(1), levels.n[out], total)
        return out

    def looked_up(x: Tokens, found: dict, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By position, counts of the n-grams asked for (of one order), their places, and where these stand once in all texts, held-out ones included."""
        totals, alone = _alone(totals)
        c, at = np.zeros(len(x.words), np.int64), np.full(len(x.words), -1, np.int32)
        for p, _, place in found.values():
            c[p], at[p] = totals[place], place
            alone[place[~x.train[p]]] = False
        return c, at, np.append(alone, False)[at]

    def known(x: Tokens, p: np.ndarray, c: np.ndarray, once: np.ndarray) -> np.ndarray:
        """At which tokens ``p`` longer n-grams are as often as those counted: once, in no text held out, or never."""
        return np.where(x.train[p], once[p], c[p] == 0)

    def ends(x: Tokens, own: np.ndarray, sure: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The tokens ``own`` but where counts are ``sure``, and those right before some of them: where their n-grams and contexts end."""
        there = np.zeros(len(x.words), bool)
        there[own[~sure]] = True
        there[own[before] - 1] = True
        return np.flatnonzero(there)

    def ask(half: int):
        """Counts of one and two words: half of all keys at a time, as these questions are the most."""
        low, middle, high = ((1 << BITS) * (i * parts // 2) // parts for i in range(3))
        low, high = (np.uint64(x) for x in ((low, middle), (middle, high))[half])

        def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = (np.zeros(0, np.uint64), np.zeros(0))
            for batch in batches:
                for block, ids, x in opened(batch):
                    (p, keys), one = x.keys(range(2, 3))[2], _key(x.single, True)
                    ones = np.bincount(x.place[x.train], minlength=len(one))
                    here, there = ((k >= low) & (k < high) for k in (one, keys))
                    u, at = _ranks(np.concatenate([one[here], keys[there]]))
                    n = np.bincount(at, np.concatenate([ones[here], x.train[p[there]]]), len(u)).astype(np.int64)
                    yield from _asks(block, parts, ids, (u, n), none)

        return asks

    def to_two(x: Tokens, found: pa.Table) -> tuple[list[np.ndarray], np.ndarray, Levels, list[np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Counts of one and two words by position, what is known of each token's context of one word, its key and the token's, tokens that go on whose 3-grams are sure, and which 3-grams to count."""
        two, u, single = asked_keys(x, range(2, 3))
        totals, _ = _answers(found, 0, len(u), 0)
        p, one = np.flatnonzero(x.age > 0), _alone(totals)[0][single][x.place]
        c2, at, once = looked_up(x, two, totals)
        levels = Levels(p, (one[p].astype(float) + 1) / (total + vocabulary + 1), total)
        levels.step(one[p - 1], c2[p])
        own = p[on(x, p, levels, c2, 2)]
        sure = known(x, own, c2, once)
        return [one, c2], p, levels, [u, single[x.place[p - 1]], at[p - 1]], own[sure], ends(x, own, sure, (x.age[own] >= 3) & (c2[own - 2] >= LEAST) & _may_deepen(c2[own - 1], total))

    def to_three(x: Tokens, found: pa.Table) -> tuple[list[np.ndarray], np.ndarray, Levels, tuple[np.ndarray, np.ndarray], np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """The same up to three words; contexts of two words to test; which of one word are retained; and of tokens that go on the contexts of three words, at which the 4-grams are sure, and which to count."""
        counts, p, levels, (u, first, second), sure, there = to_two(x, found)
        three, u3, _ = asked_keys(x, range(3, 4), there)
        asked = levels.steps[0][2]
        tested, at = _marked(u, first[asked])
        totals, kept = _answers(found, 1, len(u3), len(tested))
        c3, at3, _ = looked_up(x, three, totals)
        c3[sure] = x.train[sure]
        again = levels.step(np.where(x.age[p] >= 2, counts[1][p - 1], 0), c3[p], total)
        goes_on = on(x, p, levels, c3, 3)
        own = p[goes_on]
        sure = np.isin(own, sure)
        there = ends(x, own, sure, (x.age[own] >= 4) & _may_deepen(c3[own - 1], total) & (counts[1][own - 3] >= LEAST) & (c3[own - 2] != 1))  # no context of four words that occurs once
        return [*counts, c3], p, levels, _marked(u, second[again]), _kept(kept, asked, at), (u3, at3[own - 1]), goes_on, sure, there

    def ask_three(block: pa.Table, found: pa.Table) -> pa.Table:
        """Tests contexts of one word, counts three words."""
        (number, ids, x), = opened(block)
        _, p, levels, (u, first, _), _, there = to_two(x, found)
        tested, at = _marked(u, first[levels.steps[0][2]])
        three, u, _ = asked_keys(x, range(3, 4), there)
        return table_of(_asks(number, parts, ids, (u, counted(x, three, u)), (tested, np.bincount(at, levels.over(0, x.train[p], total), len(tested)))))

    def ask_four(block: pa.Table, found: pa.Table) -> pa.Table:
        """Tests contexts of two words, counts four words."""
        (number, ids, x), = opened(block)
        _, p, levels, (tested, at), _, _, _, _, there = to_three(x, found)
        four, u, _ = asked_keys(x, range(4, 5), there)
        return table_of(_asks(number, parts, ids, (u, counted(x, four, u)), (tested, np.bincount(at, levels.over(1, x.train[p], total), len(tested)))))

    def table_of(rows: Iterator[pa.RecordBatch]) -> pa.Table:
        return pa.Table.from_batches([_row(-1, -2, pa.array([], ids_kind), b"").slice(0, 0), *rows])

    def at_positions(x: Tokens, n: int, p: np.ndarray) -> np.ndarray:
        """Keys of the n-grams of ``n`` words that end at ``p``; 0 where there is none."""
        out = np.zeros(len(p), np.uint64)
        if len(p):
            out[x.age[p] >= n - 1] = x.keys(range(n, n + 1), p)[n][1]
        return out

    def long_keys(x: Tokens, own: np.ndarray, sure: np.ndarray, before: np.ndarray) -> tuple[dict, np.ndarray]:
        """n-grams of over four words as of :func:`asked_keys`: those that end at the tokens ``own`` but where counts are ``sure``, and contexts that may occur twice, ``before`` some tokens."""
        found = {}
        for n in range(5, depth + 2) if len(own) else ():
            there = np.zeros(len(x.words), bool)
            there[own[~sure if n == 5 else before & ~sure]] = True
            if n <= depth:
                there[own[before] - 1] = True
            found[n] = x.keys(range(n, n + 1), np.flatnonzero(there))[n]
        u, at = _ranks(np.concatenate([np.zeros(0, np.uint64), *(k for _, k in found.values())]))
        places = np.split(at, np.cumsum([len(k) for _, k in found.values()])[:-1]) if found else []
        return {n: (p, k, a) for (n, (p, k)), a in zip(found.items(), places)}, u

    def settle(block: pa.Table, found: pa.Table) -> pa.Table:
        """Sums the tokens without longer contexts, tests those of three words of the others and counts n-grams of over four."""
        (number, ids, x), = opened(block)
        counts, p, levels, (tested, at), first, (u3, at3), goes_on, sure, there = to_three(x, found)
        four, u, _ = asked_keys(x, range(4, 5), there)
        totals, kept = _answers(found, 2, len(u), len(tested))
        levels.use(0, first)
        levels.use(1, _kept(kept, levels.steps[1][2], at))
        own = p[goes_on]
        c4, _, once = looked_up(x, four, totals)
        c4[own[sure]], once[own[sure]] = x.train[own[sure]], x.train[own[sure]]
        sure = known(x, own, c4, once)
        deep = Levels(own, levels.p[goes_on], 0)
        deep.chain, deep.n = levels.chain[goes_on], levels.n[goes_on]
        n, c = counts[2][own - 1], c4[own]
        asked = deep.step(n, c, total)
        tested, at = _marked(u3, at3[asked])
        over = np.bincount(at, deep.over(0, x.train[own], total), len(tested))
        place = np.full(len(own), -1, np.int32)
        place[asked] = at
        further = on(x, own, deep, c4, 4) if depth > 3 else np.zeros(len(own), bool)
        far, sure = own[further], sure[further]
        before = (x.age[far] >= 5) & _may_deepen(c4[far - 1], total) & (counts[1][far - 4] >= LEAST) & (counts[2][far - 3] != 1) & (c4[far - 2] != 1)
        long, u = long_keys(x, far, sure, before)
        wait = asked | further
        waits = np.zeros(len(p), bool)
        waits[np.flatnonzero(goes_on)[wait]] = True
        done, text, c1 = levels.p, x.text[p], counts[0][p]
        sums = [np.bincount(text, v, len(x.sizes)) for v in (np.log10(c1 + 1) - np.log10(total + vocabulary + 1), c1 > 0, np.where(waits, 0, np.log10(done)))]
        waiting = text[waits], done[waits], n[wait].astype(np.uint32), c[wait].astype(np.uint32), place[wait], np.array([len(tested)])
        rest = _packed(*sums, *waiting, np.flatnonzero(further[wait]).astype(np.int32), far.astype(np.int32), sure, before, deep.chain[further], c4[far - 1].astype(np.uint32))
        return pa.Table.from_batches([_row(number, -2, ids[:0], rest), *_asks(number, parts, ids, (u, counted(x, long, u)), (tested, over))])

    def deepened(x: Tokens, waiting: list[np.ndarray], found: pa.Table) -> tuple[np.ndarray, np.ndarray, Levels, np.ndarray, list[np.ndarray]]:
        """Probabilities of the tokens that wait by contexts of up to three words; which of them have longer ones, these; keys to test, and the places of the tokens' among them."""
        p, n, c, place, waited, further, own, sure, before, chain, n4 = waiting
        long, u = long_keys(x, own, sure, before)
        totals, kept = _answers(found, 3, len(u), int(waited[0]))
        n, c, n4 = n.astype(np.int64), c.astype(np.int64), n4.astype(np.int64)
        p = np.where(np.append(kept, False)[place], _smoothed(c, n, p), p)
        deep, keys = Levels(own, p[further], 0), []
        deep.chain, deep.n = chain, n[further]
        known = dict(zip(long, spread(x, long, totals)))
        for d in range(4, depth + 1):
            mine = n4 if d == 4 else known[d][own - 1] if d in known else np.zeros(len(own), np.int64)
            after = np.where(sure, x.train[own], known[d + 1][own]) if d + 1 in known else np.zeros(len(own), np.int64)
            asked = deep.step(np.where(x.age[own] >= d, mine, 0), after, total)
            keys.append(at_positions(x, d, own - 1)[asked])
        tested, at = _ranks(np.concatenate([np.zeros(0, np.uint64), *keys]))
        return p, further, deep, tested, np.split(at, np.cumsum(list(map(len, keys)))[:-1]) if keys else []

    def reopened(block: pa.Table) -> tuple[int, pa.Array, Tokens, list[np.ndarray]]:
        """A block and what it wrote when it settled."""
        (number, ids, x), = opened(block.filter(pc.equal(block["part"], -1)))
        return number, ids, x, _unpacked(block.filter(pc.equal(block["part"], -2))["data"][0].as_py())

    def ask_last(block: pa.Table, found: pa.Table) -> pa.Table:
        """Tests contexts of over three words."""
        number, ids, x, (_, _, _, _, *waiting) = reopened(block)
        _, _, deep, tested, places = deepened(x, waiting, found)
        none, sums = np.zeros(0, np.uint64), np.zeros(len(tested))
        for i, at in enumerate(places):
            sums += np.bincount(at, deep.over(i, x.train[deep.at], total), len(tested))
        return table_of(_asks(number, parts, ids, (none, none), (tested, sums)))

    def finish(block: pa.Table, found: pa.Table) -> pa.Table:
        _, ids, x, (base, known, score, text, *waiting) = reopened(block)
        p, further, deep, tested, places = deepened(x, waiting, found)
        _, kept = _answers(found, 4, 0, len(tested))
        for i, at in enumerate(places):
            deep.use(i, _kept(kept, deep.steps[i][2], at))
        p[further] = deep.p
        score = score + np.bincount(text, np.log10(p), len(x.sizes))
        columns = [ids, pa.array(x.held), pa.array(x.sizes), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def answered(asks: DataFrame, turn: int) -> DataFrame:
        rows = asks.where("part >= 0").select("block", "part", "data").groupBy("part")

        def added(rows: pa.Table) -> pa.Table:
            return _added(rows, turn < 3)

        by_part = materialise(rows.applyInArrow(added, "block long, part int, data binary, words long").withColumn("turn", F.lit(turn)), "answers")
        by_block = bucketed(by_part.repartition(blocks._buckets, "block"), "block", blocks._buckets, "answers")  # when the questions are gone; no later turn moves them
        discard(by_part)
        return by_block

    def onward(blocks: DataFrame, found: list[DataFrame], then, shape: str) -> DataFrame:
        every, *others = (x.select("block", "part", "data", "turn").where("part >= 0") for x in found)  # all; a union of scans without a filter would not keep their buckets
        for more in others:
            every = every.unionByName(more)
        return blocks.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(then, shape)

    shape = _shape(kind)
    ids_kind = to_arrow_type(blocks.schema["doc_ids"].dataType.elementType)
    found = [answered(blocks.mapInArrow(ask(half), shape), 0) for half in range(2)]
    vocabulary = max(sum(x.agg(F.sum("words")).first()[0] or 0 for x in found) - (texts > 0), 0)  # without the start of texts
    found.append(answered(onward(blocks, found, ask_three, shape), 1))
    found.append(answered(onward(blocks, found, ask_four, shape), 2))
    deep = bucketed(onward(blocks, found, settle, shape), "block", blocks._buckets, "deep")
    discard(*found)
    every = blocks.unionByName(deep.where("part = -2"))  # alike in buckets: neither side moves
    found = [answered(deep, 3)]
    if depth > 3:
        found.append(answered(onward(every, found, ask_last, shape), 4))
    return onward(every, found, finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"), total


def score_documents(docs: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Learns from the rows outside the held-out fold and scores all rows."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scored, total = score_blocks(tokenised(docs.select("doc_id", held.alias("held"), "text")), depth)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
