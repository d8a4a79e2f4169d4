"""Near-duplicate embeddings by product quantisation.

Equal vectors are merged first and counted.  Vectors of each length (number of
components) have an index of their own; lengths of at most ``BLOCK`` vectors are compared
whole.  Coarse centroids and subspace codebooks are fitted on a sample, the vectors whose
ids hash lowest, of 32 times the square root of all (``SAMPLE`` at most).  Then every vector
goes to the inverted list of its nearest centroid, as the codes of its residual, and
visits the other lists whose border is no farther than a margin.

A link cannot cross a border that is farther than the links' length, so that
length is a margin that misses none.  Where the ``PROBES`` vectors whose ids hash lowest,
compared with all vectors, have at least ``PROVEN`` links, the margin is ``SLACK`` times
the farthest border that these links cross, if that is less: then fewer than 3 in
``PROVEN`` links are beyond even the farthest border seen, at 95 % confidence.  Of several
numbers of lists, up to twice the square root of the vectors, the one with the
least estimated cost is taken.  Each pair of lists is searched from one side.

In a list, queries compare with members by asymmetric table lookups; pairs that the
code's known error leaves possible are reranked by exact cosine in double
precision.  Lists are cut into units of ``BLOCK`` members and ``BLOCK`` queries, so a
crowded list is many tasks.  A unit returns sums of links for each vector and a
spanning star for each connected part, never pairs, and components of the stars
give the classes.

Results for odd input: vectors that are null, empty, zero or hold null or non-finite
components link with nothing.  Vectors of different lengths don't link.  Repeated rows
are vectors of their own and link with each other.  A null vec_id is carried and links
with nothing.  Cosines that tie with the threshold link.  More columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, materialise, table

COSINE = 0.9
#: Vectors that the index is fitted on, and lists, at most.
SAMPLE = 1 << 18
LISTS = 1 << 14
SUBSPACES = 16
CODES = 256
BLOCK = 1024
#: Vectors whose links with all others set the margin; links that must be seen for it; its factor.
PROBES = 2048
PROVEN = 1000
SLACK = 1.5
#: What sending a vector to a list costs, in comparisons.
ROW = 500
#: Numbers in a matrix of distances at a time.
CELLS = 1 << 22


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    own, norms, step = np.empty(len(x), np.int64), (c * c).sum(1), max(1, CELLS // len(c))
    for i in range(0, len(x), step):
        own[i : i + step] = (norms - 2 * x[i : i + step] @ c.T).argmin(1)
    return own


def _kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=k)
        new = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        c[n > 0] = new[n > 0] / n[n > 0, None]
    return c


class Lists:
    """Coarse centroids, and how far beyond a list's border its links may be."""

    def __init__(self, coarse: np.ndarray, margin: float) -> None:
        self.coarse, self.margin = coarse, margin

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(1)[:, None] + (self.coarse**2).sum(1) - 2 * x @ self.coarse.T, 0)

    def borders(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Parts of ``x``: first row, own list of each, distance from the border of every list."""
        step = max(1, CELLS // len(self.coarse))
        for i in range(0, len(x), step):
            d = self.distances(x[i : i + step])
            own = d.argmin(1)
            some, at = np.unique(own, return_inverse=True)
            apart = np.sqrt(np.maximum(self.distances(self.coarse[some]), 1e-12))[at]
            yield i, own, (d - d[np.arange(len(d)), own][:, None]) / (2 * apart)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own list of each vector; rows and lists of visits to lists of higher number."""
        owns, rows, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, own, border in self.borders(x):
            a, b = np.nonzero((border <= self.margin) & (np.arange(len(self.coarse)) > own[:, None]))
            for column, value in zip((owns, rows, lists), (own, a + i, b)):
                column.append(value)
        return tuple(map(np.concatenate, (owns, rows, lists)))


class Index(Lists):
    """Lists and the codebooks of residuals."""

    def __init__(self, lists: Lists, sample: np.ndarray, cosine: float) -> None:
        super().__init__(lists.coarse, lists.margin)
        self.dim, self.cosine, self.length = sample.shape[1], cosine, (2 - 2 * cosine) ** 0.5
        self.cuts = np.linspace(0, self.dim, min(SUBSPACES, self.dim) + 1).astype(int)
        sample = sample[:16384]
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.books = [_kmeans(rest[:, a:b], min(CODES, len(rest)), 8) for a, b in zip(self.cuts, self.cuts[1:])]

    def codes(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and each one's error."""
        out, error = np.empty((len(self.books), len(rest)), np.uint8), np.zeros(len(rest))
        for m, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            out[m] = ((book**2).sum(1) - 2 * rest[:, a:b] @ book.T).argmin(1)
            error += ((rest[:, a:b] - book[out[m]]) ** 2).sum(1)
        return out, np.sqrt(error)

    def links(self, list_: int, queries: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Which queries link with which members of a list (boolean matrix); unit vectors."""
        codes, error = self.codes(members - self.coarse[list_])
        rest, near = queries - self.coarse[list_], np.zeros((len(members), len(queries)), np.float32)
        for m, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            lookup = ((rest[:, a:b] ** 2).sum(1) + (book**2).sum(1)[:, None] - 2 * book @ rest[:, a:b].T).astype(np.float32)
            near += lookup[codes[m]]  # a row of the table for each member
        maybe = (near <= ((self.length + error) ** 2 + 1e-4).astype(np.float32)[:, None]).T
        if maybe.mean() > 0.05:
            return maybe & (queries @ members.T >= self.cosine)
        q, x = np.nonzero(maybe)
        out = np.zeros(maybe.shape, bool)
        for i in range(0, len(q), CELLS // self.dim + 1):
            own = slice(i, i + CELLS // self.dim + 1)
            ok = np.einsum("ij,ij->i", queries[q[own]], members[x[own]]) >= self.cosine
            out[q[own][ok], x[own][ok]] = True
        return out


def _parts(links: np.ndarray) -> np.ndarray:
    """Smallest index connected with each (queries first, then members)."""
    q, m = links.shape
    label = np.arange(q + m)
    a, b = np.nonzero(links)
    b = b + q
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind: type) -> np.ndarray:
    """Unit vectors in double precision, of binary cells."""
    return _unit(np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim))


def _listed(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding)."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    numbers = F.col("embedding").cast("array<double>")
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists(numbers, lambda x: x != 0)
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    rows = vectors.select("vec_id", F.coalesce(good, F.lit(False)).alias("good"), (F.col("embedding") if single else numbers).alias("x"))
    rows = rows.select("vec_id", "good", F.when(F.col("good"), F.xxhash64("x")).alias("k1"), F.when(F.col("good"), F.xxhash64(F.lit(1), "x", F.lit(2))).alias("k2"), "x")
    base = materialise(rows.drop("x"), "vectors")
    merged = rows.where("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("x").alias("x"))
    merged = materialise(merged.withColumn("dim", F.size("x")), "distinct")
    sizes = dict(merged.groupBy("dim").count().collect())  # a row for each length that occurs
    found = [_whole(merged.where(F.col("dim").isin([d for d, n in sizes.items() if n <= BLOCK])), cosine)]
    for dim, n in sorted(sizes.items()):
        if n > BLOCK:
            found.append(_indexed(merged.where(F.col("dim") == dim), dim, n, cosine))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    every = materialise(every, "found")
    links = every.groupBy("id").agg(F.sum("links").alias("links"))
    stars = components(every.where("id <> part").select(F.col("part").alias("u"), F.col("id").alias("v")), "vectors")
    linked = merged.drop("x").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(stars.select(F.col("v").alias("rep"), "c"), "rep", "left")
    known = materialise(linked.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("c", "rep").cast(kind).alias("component_id")), "known")
    discard(every, stars)
    out = base.join(known, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


RESULT = "id long, links long, part long"


def _result(links: np.ndarray, q_id: np.ndarray, q_n: np.ndarray, m_id: np.ndarray, m_n: np.ndarray) -> pa.Table:
    """Links of each vector in a unit and the smallest id of its connected part."""
    sums, ids = np.concatenate((links @ m_n, links.T @ q_n)), np.concatenate((q_id, m_id))
    part, touched = _parts(links), sums > 0
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, part, ids)
    return pa.table([pa.array(ids[touched]), pa.array(sums[touched]), pa.array(least[part][touched])], names=["id", "links", "part"])


def _whole(vectors: DataFrame, cosine: float) -> DataFrame:
    """The links of vectors of rare lengths, of at most ``BLOCK`` vectors each."""

    def compare(unit: pa.Table) -> pa.Table:
        unit = unit.combine_chunks()
        x = _unit(unit["x"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(len(unit), -1))
        ids, n = unit["rep"].to_numpy(), unit["n"].to_numpy()
        return _result((x @ x.T >= cosine) & (ids[:, None] < ids[None]), ids, n, ids, n)

    return vectors.select(F.col("rep").cast("long").alias("rep"), "n", "x", "dim").groupBy("dim").applyInArrow(compare, RESULT)


def _fit(vectors: DataFrame, dim: int, count: int, cosine: float) -> Index:
    """An index of ``count`` vectors: fitted on a sample, with the margin and the number of lists that all vectors give."""
    spark = vectors.sparkSession
    most = min(SAMPLE, max(4096, int(32 * count**0.5)))
    picked = vectors.orderBy(F.xxhash64("rep"), "rep").limit(most).select("x").toArrow().combine_chunks()  # at most SAMPLE rows
    sample = _unit(picked["x"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
    length, tried, k = (2 - 2 * cosine) ** 0.5, [], max(1, min(LISTS, len(sample) // 8, int(2 * count**0.5)))
    while k:
        tried.append(Lists(_kmeans(sample, k, 8), length + 1e-6))
        k //= 4
    probes = spark.sparkContext.broadcast((sample[:PROBES], tried))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each number of lists, the links of the probes and the farthest border that one crosses."""
        q, lists = probes.value
        found, far = 0, np.zeros(len(lists))
        own = [_nearest(q, a.coarse) for a in lists]
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, len(batch), 2048)):
                x = _unit(_listed(part, dim))
                near = x @ q.T
                near[near > 1 - 1e-12] = 0  # itself
                i, j = np.nonzero(near >= cosine)
                found += len(i)
                some = np.unique(i)
                for at, a in enumerate(lists):
                    theirs = np.full(len(x), -1)
                    theirs[some] = _nearest(x[some], a.coarse)
                    cross = theirs[i] != own[at][j]
                    low = np.where((theirs[i] < own[at][j])[:, None], x[i], q[j])[cross]  # the side that visits
                    c, d = (np.where(theirs[i] < own[at][j], u, v)[cross] for u, v in ((theirs[i], own[at][j]), (own[at][j], theirs[i])))
                    if len(low):
                        c, d = a.coarse[c], a.coarse[d]
                        border = (((low - d) ** 2).sum(1) - ((low - c) ** 2).sum(1)) / (2 * np.sqrt(np.maximum(((c - d) ** 2).sum(1), 1e-12)))
                        far[at] = max(far[at], border.max())
        yield pa.record_batch([pa.array(np.arange(len(lists))), pa.array(np.full(len(lists), found)), pa.array(far)], names=["at", "found", "far"])

    rows = vectors.select("x").mapInArrow(needed, "at long, found long, far double").groupBy("at").agg(F.sum("found").alias("found"), F.max("far").alias("far")).collect()
    for r in rows:
        if r["found"] >= PROVEN:
            tried[r["at"]].margin = min(length, SLACK * r["far"]) + 1e-6

    def cost(a: Lists) -> float:
        visits, k = 1 + len(a.visits(sample[:1024])[1]) / len(sample[:1024]), len(a.coarse)
        return visits * (ROW * -(-count // (k * BLOCK)) + count / k) + k

    return Index(min(tried, key=cost), sample, cosine)


def _indexed(vectors: DataFrame, dim: int, count: int, cosine: float) -> DataFrame:
    """(id, links, part): links of each vector in each unit and the smallest id of its connected part there."""
    spark = vectors.sparkSession
    index = spark.sparkContext.broadcast(_fit(vectors, dim, count, cosine))
    number = np.float32 if vectors.schema["x"].dataType.elementType.typeName() == "float" else np.float64

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_n = visit_n = np.zeros(len(index.value.coarse), np.int64)
        for batch in batches:
            own, _, lists = index.value.visits(_unit(_listed(batch, dim)))
            own_n, visit_n = own_n + np.bincount(own, minlength=len(own_n)), visit_n + np.bincount(lists, minlength=len(visit_n))
        yield pa.record_batch([pa.array(np.arange(len(own_n))), pa.array(own_n), pa.array(visit_n)], names=["list", "own", "visits"])

    rows = vectors.select("x").mapInArrow(sizes, "list long, own long, visits long").groupBy("list").agg(F.sum("own"), F.sum("visits")).collect()  # at most LISTS rows
    members, asking = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for i, own, visits in rows:
        members[i], asking[i] = -(-own // BLOCK), -(-(own + visits) // BLOCK)

    def spelled(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each i, n[i] times: i and the numbers under n[i]."""
        at = np.repeat(np.arange(len(n)), n)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, len(b), 1024)):
            raw = _listed(batch, dim).astype(number)
            ids, n = batch["rep"].to_numpy().astype(np.int64), batch["n"].to_numpy().astype(np.int64)
            own, rows, lists = index.value.visits(_unit(raw))
            h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            block = (h % np.maximum(members[own], 1).astype(np.uint64)).astype(np.int64)
            asker, of = np.concatenate((np.arange(len(ids)), rows)), np.concatenate((own, lists))
            turn = (h[asker] // np.uint64(4093) % np.maximum(asking[of], 1).astype(np.uint64)).astype(np.int64)
            mine, k = spelled(asking[own])
            ask, m = spelled(members[of])
            who = np.concatenate((mine, asker[ask]))
            cells = [x.tobytes() for x in raw]
            columns = [np.concatenate(x).astype(np.int32) for x in ((own[mine], of[ask]), (block[mine], m), (k, turn[ask]))]
            out = [*map(pa.array, columns), pa.array(np.arange(len(who)) < len(mine)), pa.array(ids[who]), pa.array(n[who]), pa.array(own[who].astype(np.int32)), pa.array([cells[i] for i in who], pa.binary())]
            whole = pa.record_batch(out, names=["list", "mblock", "qblock", "member", "id", "n", "own", "x"])
            yield from (whole.slice(i, 1 << 16) for i in range(0, len(whole), 1 << 16))

    def compare(unit: pa.Table) -> pa.Table:
        member = unit["member"].to_numpy(zero_copy_only=False).astype(bool)
        held, asked = (unit.filter(pa.array(x)).combine_chunks() for x in (member, ~member))
        empty = pa.table([pa.array([], pa.int64())] * 3, names=["id", "links", "part"])
        if not len(held) or not len(asked):
            return empty
        list_ = unit["list"][0].as_py()
        (q_id, m_id), (q_n, m_n) = ([t[c].to_numpy() for t in (asked, held)] for c in ("id", "n"))
        links = index.value.links(list_, _matrix(asked["x"], dim, number), _matrix(held["x"], dim, number))
        links &= (asked["own"].to_numpy() != list_)[:, None] | (q_id[:, None] < m_id[None])
        return _result(links, q_id, q_n, m_id, m_n) if links.any() else empty

    dealt = vectors.select(F.col("rep").cast("long").alias("rep"), "n", "x").mapInArrow(deal, "list int, mblock int, qblock int, member boolean, id long, n long, own int, x binary")
    return dealt.groupBy("list", "mblock", "qblock").applyInArrow(compare, RESULT)


def op4_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
