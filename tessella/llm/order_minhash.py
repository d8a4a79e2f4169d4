"""Near duplicates by Order MinHash, verified by banded alignment.

K-mers of words are labelled with their occurrence number, so a k-mer that stands
twice is two elements.  Each of ``SKETCHES`` sketches takes the few elements with the
least seeded hashes and names them in the order in which they stand in the text;
texts collide in a sketch more often the smaller their edit distance, and reordered texts
don't.  K-mers have five words, two to a sketch.  Edits destroy too many of these in texts of
at most 62 words, whose sketches take three k-mers of two words (both for 51 to 62
words, so any two texts of similar lengths have sketches in common); and texts of at
most nine words, which one edit at most may tell apart, list all their ordered words but
one, which finds every such pair.

A pair is a link if 1 - (edit distance in words) / (words of the longer) is at least
``SIMILARITY``, by a banded bit-parallel alignment of the whole texts.  Texts with the same
words are one class from the start and one of them stands for all.  Then pairs
are tested in these steps; after each, only pairs of different components are asked for:

1. all members of a bucket (sketch, name) with one leader: a pair for each member (here and
   below, but for pairs whose numbers of words alone put them below the similarity);
2. all pairs of a bucket of at most ``CROWD`` members;
3. all texts of larger buckets that still hold several components (texts that share a
   template, say) by an exact join.  A link has at least ``SIMILARITY`` of the longer text's
   labelled words in common, so the rarest words of both texts, one more than may differ, share
   one: texts meet in lists by these.  Pairs of a list are left out only if their numbers of words, the
   places of the shared word or parities of their words prove them no links.  Lists of over
   ``BLOCK`` texts are compared block by block, in several tasks.

No bucket is capped and no row is left out; what can be missed is a pair that collides
in no sketch.  Words are parted by ASCII white space throughout.

Results for odd input: null and empty texts, and those without a word, link with
nothing.  Texts of any length are sketched and aligned whole.  Repeated rows give a row
each; rows of one doc_id with different texts share a class, the least of theirs, and each of these
texts is compared.  Rows
with a null doc_id are their own class, which is null.  Ties go to the smaller doc_id;
more columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, grams, materialise, mix, slices, table, utf8, word_hashes, words

#: Words of a k-mer, k-mers of a sketch, and the texts that have such sketches, by least and most words.
FAMILIES = ((5, 2, 51, 1 << 62), (2, 3, 8, 62))
#: Texts of so many words list all their words but one.
SHORT = (4, 9)
SKETCHES = 96
SIMILARITY = 0.8
#: Members of a bucket that are compared with each other as they are; larger ones go through the exact join.
CROWD = 32
#: Buckets of the numbers that words are ordered by, bits of a text's parities, entries of a task, texts of a list in one block, pairs at a time.
COUNTS, PARITIES, ENTRIES, BLOCK, PAIRS = 1 << 18, 256, 1 << 20, 1 << 12, 1 << 20
#: A text in the list of one of its rarest words: ``at`` places before it, ``side`` 0 in a block compared with itself, else 1 or 2.
ENTRY = np.dtype([("name", "u8"), ("doc", "i8"), ("c", "i8"), ("n", "i8"), ("at", "i4"), ("side", "i4"), ("parity", "u8", PARITIES // 64)])
CHUNK = 4 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0x2545F4914F6CDD1D)


def elements(h: np.ndarray, first: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled k-mers of the texts ``rows`` (of at least k words each), one text after the other, and where each text's begin (n + 1)."""
    n = first[rows + 1] - first[rows] - k + 1
    at = np.append(0, np.cumsum(n))
    of = np.repeat(np.arange(len(rows)), n)
    g = grams(h, k)[np.arange(at[-1]) - at[of] + first[rows][of]]
    own = mix(g + of.astype(np.uint64) * STEP)  # the same k-mers of a text are neighbours in this order
    order = np.argsort(own, kind="stable")
    new = np.append(True, own[order][1:] != own[order][:-1])
    label = np.empty(len(g), np.uint64)
    label[order] = np.arange(len(g)) - np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    return mix(g + label * ODD), at


def _sketches(e: np.ndarray, at: np.ndarray, kept: int, sketches: int, salt: int) -> np.ndarray:
    """Names of the sketches (a row for each text) of elements in text order; text i has those from ``at[i]`` on, at least ``kept``."""
    begins, last, texts = at[:-1], np.iinfo(np.uint64).max, len(at) - 1
    out = np.empty((texts, sketches), np.uint64)
    of = np.repeat(np.arange(texts), np.diff(at))
    for i in range(sketches):
        x = (e ^ mix(np.array([i + 1], np.uint64) * ODD)) * STEP
        x ^= x >> np.uint64(32)
        x *= ODD
        places = np.empty((kept, texts), np.int64)
        for j in range(kept):
            least = np.minimum.reduceat(x, begins)
            found = np.flatnonzero(x == least[of])
            places[j] = found if len(found) == texts else found[np.searchsorted(of[found], np.arange(texts))]
            x[places[j]] = last
        places.sort(axis=0)
        name = np.full(texts, (i + 1) * salt, np.uint64)
        for j in range(kept):
            name = name * STEP + e[places[j]]
        out[:, i] = mix(name)
    return out


def order_sketches(h: np.ndarray, first: np.ndarray, rows: np.ndarray, k: int, kept: int, sketches: int = SKETCHES) -> np.ndarray:
    """Names of the sketches (a row for each text) of the texts ``rows``; ``h`` word hashes, ``first`` each text's first word (n + 1)."""
    return _sketches(*elements(h, first, rows, k), kept, sketches, kept * k) if len(rows) else np.empty((0, sketches), np.uint64)


def _all_but_one(h: np.ndarray) -> np.ndarray:
    """Names of a short text: of all its words, and of all but each one."""
    out = [h, *(np.delete(h, i) for i in range(len(h)))]
    return np.unique(mix(np.array([int(grams(x, len(x))[0]) for x in out], np.uint64)))


def distance_within(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``: bit-parallel, in a band of 2 * most + 1 diagonals."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    start = 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < len(b) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    n, m = len(a), len(b)
    if not m:
        return n if n <= most else None
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << 2 * most + 1) - 1
    top, on, dist = 1 << 2 * most, 1 << most + n - m, n - m
    # bit t of the window at column j is row j - most + t; rows below 1 stay 0
    vp, vn = full >> most + 1 << most + 1, 0
    for j, x in enumerate(b, 1):
        vp, vn = vp >> 1 | top, vn >> 1
        rows = where.get(x, 0)
        s = j - most - 1
        eq = (rows >> s if s >= 0 else rows << -s) & full
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = vn | ~(d0 | vp) & full
        hn = d0 & vp
        if not d0 & on:
            dist += 1
            if dist > most:
                return None
        hp, hn = (hp << 1 | 1) & full, hn << 1 & full
        vp, vn = hn | ~(d0 | hp) & full, d0 & hp
    return dist


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    x, y = a.encode().split(), b.encode().split()  # at the white space of the sketches
    longest = max(len(x), len(y))
    most = int((1 - least) * longest + 1e-9)
    if not longest or longest - min(len(x), len(y)) > most or longest - (Counter(x) & Counter(y)).total() > most:
        return False
    return distance_within(x, y, most) is not None


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _lists(names: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([np.zeros(0, np.uint64), *names]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in names])).astype(np.int32)), pa.array(flat))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, number of words, two hashes of them, the sketches' names; texts without a word are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for a, b in slices(offsets, CHUNK):
                starts, ends, first = words(data, offsets[a : b + 1])
                h, n = word_hashes(data, starts, ends), np.diff(first)
                rows = np.flatnonzero(n)
                names: list[list[np.ndarray]] = [[] for _ in range(b - a)]
                for k, kept, low, high in FAMILIES:
                    some = np.flatnonzero((n >= low) & (n <= high))
                    for i, x in zip(some.tolist(), order_sketches(h, first, some, k, kept)):
                        names[i].append(x)
                for i in np.flatnonzero((n >= SHORT[0]) & (n <= SHORT[1])).tolist():
                    names[i].append(_all_but_one(h[first[i] : first[i + 1]]))
                at = mix(np.arange(len(h), dtype=np.uint64) - np.repeat(first[:-1], n).astype(np.uint64))
                f1, f2 = (np.add.reduceat(mix(x), first[:-1][rows]) if len(rows) else np.zeros(0, np.uint64) for x in (h ^ at, h + at))
                columns = [batch["doc_id"].take(pa.array(a + rows)), pa.array(n[rows]), pa.array(f1.view(np.int64)), pa.array((f2 + n[rows].astype(np.uint64)).view(np.int64))]
                yield pa.record_batch([*columns, _lists([np.concatenate([np.zeros(0, np.uint64), *names[i]]) for i in rows.tolist()])], names=["doc_id", "words", "f1", "f2", "names"])

    return _texts(docs).mapInArrow(run, "doc_id long, words long, f1 long, f2 long, names array<long>")


def _counts(texts: DataFrame) -> np.ndarray:
    """How often labelled words of ``texts`` occur, by ``COUNTS`` buckets of their hashes."""
    size = COUNTS // 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTS, np.int64)
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for a, b in slices(offsets, CHUNK):
                starts, ends, first = words(data, offsets[a : b + 1])
                n += np.bincount(_bucket(elements(word_hashes(data, starts, ends), first, np.flatnonzero(np.diff(first)), 1)[0]), minlength=COUNTS)
        if n.any():
            yield pa.record_batch([pa.array(range(16), pa.int32()), pa.array([x.tobytes() for x in n.reshape(16, size)], pa.binary())], names=["part", "n"])

    def add(rows: pa.Table) -> pa.Table:
        n = np.zeros(size, np.int64)
        for x in rows["n"]:
            n += np.frombuffer(x.as_py(), np.int64)
        return pa.table([rows["part"][:1], pa.array([n.tobytes()], pa.binary())], names=["part", "n"])

    out = np.zeros((16, size), np.int64)
    for r in texts.select("text").mapInArrow(run, "part int, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect():
        out[r["part"]] = np.frombuffer(r["n"], np.int64)
    return out.ravel()


def _bucket(e: np.ndarray) -> np.ndarray:
    return (e >> np.uint64(32)).astype(np.int64) % COUNTS


def _common(longest: np.ndarray) -> np.ndarray:
    """Labelled words that a link has in common at least, by the words of the longer text."""
    return longest - ((1 - SIMILARITY) * longest + 1e-9).astype(np.int64)


def _entries(ids: np.ndarray, c: np.ndarray, h: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries of texts of at least a word each in the lists of their rarest words."""
    n, texts = np.diff(first), np.arange(len(first) - 1)
    e, at = elements(h, first, texts, 1)
    of = np.repeat(texts, n)
    parity, bit = np.zeros(len(texts) * (PARITIES // 64), np.uint64), (e % np.uint64(PARITIES)).astype(np.int64)
    np.bitwise_xor.at(parity, of * (PARITIES // 64) + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
    f = counts[_bucket(e)]
    order = np.lexsort((e, f, of))
    place = np.arange(len(e)) - np.repeat(at[:-1], n)
    least = np.min([_common(n + i) for i in range(5)], axis=0)  # a longer text may allow less: the edits grow by one in five words
    some = (place <= (n - least)[of]) & (f[order] > 1)
    e, f, place, of = e[order[some]], f[order[some]], place[some], of[some]  # ``order`` keeps texts in order
    blocks = 1 + f // BLOCK
    i = np.repeat(np.arange(len(e)), blocks)
    other = np.arange(len(i)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = (mix(ids.astype(np.uint64) * ODD)[of] % blocks.astype(np.uint64)).astype(np.int64)[i]
    low, high = np.minimum(own, other), np.maximum(own, other)
    out = np.empty(len(i), ENTRY)
    out["name"] = mix(e[i] + (low * blocks[i] + high).astype(np.uint64) * ODD)
    out["side"] = np.where(low == high, 0, np.where(own == low, 1, 2))
    out["doc"], out["c"], out["n"], out["at"], out["parity"] = ids[of][i], c[of][i], n[of][i], place[i], parity.reshape(len(texts), -1)[of][i]
    return out


def _candidates(x: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs (u, v) of different components in the lists of entries ``x`` that may be links, maybe several times."""
    x = x[np.lexsort((x["c"], x["name"]))]
    new = x["name"][1:] != x["name"][:-1]
    edges = np.append(np.flatnonzero(new) + 1, len(x)), np.append(np.flatnonzero(new | (x["c"][1:] != x["c"][:-1])) + 1, len(x))
    stop, start = (b[np.searchsorted(b, np.arange(len(x)), side="right")] for b in edges)  # where an entry's partners end and begin
    todo = np.flatnonzero(stop > start)
    n = (stop - start)[todo]
    sums, lo = np.append(0, np.cumsum(n)), 0
    while lo < len(todo):
        hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + PAIRS, side="right")) - 1)
        a = np.repeat(todo[lo:hi], n[lo:hi])
        b = start[a] + np.arange(len(a)) - np.repeat(sums[lo:hi] - sums[lo], n[lo:hi])
        na, nb = x["n"][a], x["n"][b]
        common = _common(np.maximum(na, nb))
        may = (np.minimum(na - x["at"][a], nb - x["at"][b]) >= common) & ((x["side"][a] == 0) | (x["side"][a] != x["side"][b]))
        a, b, differ = a[may], b[may], (na + nb - 2 * common)[may]
        may = np.bitwise_count(x["parity"][a] ^ x["parity"][b]).sum(1, dtype=np.int64) <= differ
        u, v = x["doc"][a[may]], x["doc"][b[may]]
        yield np.stack((np.minimum(u, v), np.maximum(u, v)), axis=1)
        lo = hi


def _distinct(pairs: list[np.ndarray]) -> np.ndarray:
    """Rows (u, v) of all ``pairs``, each once."""
    every = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
    every = every[np.lexsort((every[:, 1], every[:, 0]))]
    return every[np.append(True, (every[1:] != every[:-1]).any(axis=1))] if len(every) else every


def crowd_pairs(held: DataFrame) -> DataFrame:
    """(u, v): all pairs of different components of ``held`` (doc_id, c, text) that may be links."""
    counts = _counts(held)
    parts = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // (4 * ENTRIES))

    def dealt(x: np.ndarray, part: np.ndarray) -> pa.Table:
        x, edge = x[np.argsort(part, kind="stable")], np.append(0, np.cumsum(np.bincount(part, minlength=parts)))
        full = np.flatnonzero(np.diff(edge))
        return pa.table([pa.array(full.astype(np.int32)), pa.array([x[edge[i] : edge[i + 1]].tobytes() for i in full.tolist()], pa.binary())], names=["part", "data"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            ids, c = batch["doc_id"].to_numpy(), batch["c"].to_numpy()
            for a, b in slices(offsets, CHUNK):
                starts, ends, first = words(data, offsets[a : b + 1])
                x = _entries(ids[a:b], c[a:b], word_hashes(data, starts, ends), first, counts)
                yield from dealt(x, (x["name"] % np.uint64(parts)).astype(np.int64)).to_batches()

    def compare(rows: pa.Table) -> pa.Table:
        pairs = _distinct(list(_candidates(np.frombuffer(b"".join(rows["data"].to_pylist()), ENTRY))))
        return dealt(pairs, (mix(pairs[:, 0].astype(np.uint64) * ODD + pairs[:, 1].astype(np.uint64)) % np.uint64(parts)).astype(np.int64))

    def once(rows: pa.Table) -> pa.Table:
        pairs = _distinct([np.frombuffer(x, np.int64).reshape(-1, 2) for x in rows["data"].to_pylist()])
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    shape = "part int, data binary"
    found = held.select("doc_id", "c", "text").mapInArrow(deal, shape).groupBy("part").applyInArrow(compare, shape)
    return found.groupBy("part").applyInArrow(once, "u long, v long")  # a pair has several words in common, so several lists


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) of which any two texts are similar, maybe several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(a, b) for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist())]
            yield pa.record_batch([batch["u"], batch["v"]], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v").join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


class _Classes:
    """Components of the links found so far, and the pairs tested."""

    def __init__(self, texts: DataFrame) -> None:
        self.texts, self.tested, self.of = texts, None, None

    def named(self, members: DataFrame) -> DataFrame:
        """``members`` (doc_id, ...) with the component c of each."""
        if self.of is None:
            return members.withColumn("c", F.col("doc_id"))
        return members.join(self.of.select(F.col("v").alias("doc_id"), "c"), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))

    def test(self, pairs: DataFrame) -> bool:
        """Tests ``pairs`` (u, v) that weren't tested, and joins the components of links; whether there were any."""
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["u", "v"], "left_anti")
        pairs = materialise(pairs, "pairs")
        links = materialise(_verified(pairs, self.texts), "links")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        if links.isEmpty():
            return False
        if self.of is None:
            self.of = components(links, "classes")
            return True
        of_u, of_v = (self.of.select(F.col("v").alias(x), F.col("c").alias(f"c{x}")) for x in "uv")
        joined = components(links.join(of_u, "u", "left").join(of_v, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")), "joined")
        moved = self.of.join(joined.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", "left").select("v", F.coalesce("to", "c").alias("c"))
        new = materialise(moved.union(joined.join(self.of, "v", "left_anti").select("v", "c")), "classes")
        discard(self.of, joined, links)
        self.of = new
        return True


def _near(a: Column, b: Column) -> Column:
    """Whether texts of ``a`` and ``b`` words can be similar."""
    return F.greatest(a, b) * SIMILARITY <= F.least(a, b) + 1e-6


def _all_pairs(members: DataFrame) -> DataFrame:
    """(u, v) of different components in each bucket of ``members`` (name, doc_id, words, c), of at most ``CROWD`` members."""
    several = members.groupBy("name").agg(F.collect_list(F.struct("doc_id", "words", "c")).alias("m"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    first = several.select("m", F.explode("m").alias("a"))
    both = first.select("a", F.explode(F.filter("m", lambda x: (x["doc_id"] > F.col("a.doc_id")) & (x["c"] != F.col("a.c")) & _near(x["words"], F.col("a.words")))).alias("b"))
    return both.select(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v"))


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), kept, for each row of ``docs``."""
    sketched = materialise(sketch(docs).distinct(), "sketches")
    copies = materialise(sketched.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "copies")
    rep_of = materialise(sketched.select("doc_id", "f1", "f2").join(copies, ["f1", "f2"]).select("doc_id", "rep"), "reps")
    buckets = sketched.join(copies.select("f1", "f2", F.col("rep").alias("doc_id")), ["f1", "f2", "doc_id"], "left_semi").select("doc_id", "words", F.explode("names").alias("name"))
    shared = materialise(buckets.groupBy("name").agg(F.min(F.struct("doc_id", "words")).alias("lead"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = materialise(buckets.join(shared, "name").select("name", "n", "lead", "doc_id", "words"), "members")
    every = _texts(docs).repartition("doc_id").dropDuplicates(["doc_id", "text"])  # all texts of a doc_id; dealt by it once, for the join too
    texts = materialise(every.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")
    classes = _Classes(texts)
    stars = members.where((F.col("lead.doc_id") != F.col("doc_id")) & _near(F.col("lead.words"), F.col("words")))
    classes.test(stars.select(F.col("lead.doc_id").alias("u"), F.col("doc_id").alias("v")))
    classes.test(_all_pairs(classes.named(members.where((F.col("n") > 2) & (F.col("n") <= CROWD)).select("name", "doc_id", "words"))))

    crowds = materialise(classes.named(members.where(F.col("n") > CROWD).select("name", "doc_id")), "crowds")
    mixed = crowds.groupBy("name").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("name")
    crowds = crowds.join(mixed, "name", "left_semi")
    if not crowds.isEmpty():
        held = materialise(crowds.select("doc_id", "c").distinct().join(texts, "doc_id"), "crowded")
        classes.test(crowd_pairs(held))
        discard(held)
    of = rep_of.withColumnRenamed("doc_id", "own").withColumnRenamed("rep", "doc_id")
    of = materialise(classes.named(of).groupBy(F.col("own").alias("doc_id")).agg(F.min("c").alias("class_id")), "class-of")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(of, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of near duplicates the document with the smallest doc_id stays (all rows of it, and rows without doc_id)."""
    dropped = near_classes(docs).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
