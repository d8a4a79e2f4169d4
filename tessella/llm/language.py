"""Language identification as a mixture of languages, by expectation-maximisation.

Every language has a distribution over hashed byte trigrams of lower-cased text
(anything but letters is a gap), counted over all labelled training rows.  A
document is a mixture: from its best single language, languages are added while
the gain in log-likelihood at the proportions that EM finds exceeds a penalty
that grows with the log of the number of trigrams.  The predicted language is the
one with the largest proportion; the score is that proportion times the posterior
of the language among single ones.

Results for odd input: a null text, an empty text and one without a letter give
``und`` with score 0; so does every text if there are no labelled rows.  Ties go
to the language that sorts first.  Texts are read whole, of any length.  A row without
doc_id is in no held-out fold: it is learned from, and predicted.  Repeated rows are
scored alike, one row each; more columns are ignored; an empty table gives no rows.

The model has ``LANGUAGES * 65536`` numbers of 8 bytes at most: if there are more
distinct labels (a dirty column), those with the most labelled rows are learned, the first ones of equal ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8

BITS = 16
ALPHA = 0.05
#: A language must gain this times the log of the number of trigrams.
PENALTY = 4.0
ROUNDS = 30
#: Most languages that a model tells apart.
LANGUAGES = 128
CHUNK = 4 << 20
UND = "und"
_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Hashed trigrams of one text or of several in a row."""
    b = _FOLD[data]
    if len(b) < 3:
        return np.zeros(0, np.int64)
    key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)[(b[1:-1] != 32)]


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with a gap before and after each."""
    low = pc.utf8_lower(column.fill_null(""))
    return utf8(pc.binary_join_element_wise(pa.scalar(" "), low, pa.scalar(" "), pa.scalar("")))


def held_out(doc_id, folds: int, which: int):
    """Whether a row is held out; one without doc_id isn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == which, F.lit(False))


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        """counts: a row for each language."""
        self.languages = languages
        p = (counts + ALPHA) / (counts.sum(1, keepdims=True) + ALPHA * counts.shape[1])
        self.log_p = np.ascontiguousarray(np.log(p).T)

    def mixture(self, data: np.ndarray) -> tuple[list[int], np.ndarray, float]:
        """Languages, their proportions, and the posterior of the best single language."""
        grams = _trigrams(data)
        if len(grams) < 8192:
            u, c = np.unique(grams, return_counts=True)
        else:
            c = np.bincount(grams, minlength=1 << BITS)
            u = np.flatnonzero(c)
            c = c[u]
        log_p, n = self.log_p[u], max(int(c.sum()), 1)
        single = c @ log_p
        best = int(np.argmax(single))
        sure = 1 / np.exp(np.maximum(single - single[best], -700)).sum()
        p = np.exp(log_p - log_p.max(1, keepdims=True))
        chosen, share = [best], np.ones(1)
        now, cost = float(c @ np.log(p[:, best])), PENALTY * np.log(n + 1)
        while len(chosen) < p.shape[1]:
            blend = p[:, chosen] @ share
            slope = (c / blend) @ p  # over n: the gain's derivative at proportion 0; the gain is concave
            options = []
            for k in np.flatnonzero(slope > n):
                if k in chosen:
                    continue
                q, w = p[:, [*chosen, k]], np.append(share * 0.8, 0.2)
                for _ in range(ROUNDS):
                    w = w * ((c / (q @ w)) @ q) / n
                options.append((float(c @ np.log(q @ w)), -k, w))
            if not options or max(options, key=lambda x: x[:2])[0] - now <= cost:
                break
            now, k, share = max(options, key=lambda x: x[:2])
            chosen.append(-k)
        return chosen, share, float(sure)


def train(labelled: DataFrame, most: int = LANGUAGES) -> Model:
    """Trigram counts by language over all rows of ``labelled`` (text, lang), for at most ``most`` languages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = _padded(batch["text"])
            names = np.array(batch["lang"].to_pylist(), dtype=object)
            for start, end in slices(offsets, CHUNK):
                for name in dict.fromkeys(names[start:end]):
                    rows = [data[offsets[i] : offsets[i + 1]] for i in range(start, end) if names[i] == name]
                    total.setdefault(name, np.zeros(1 << BITS, np.int64))
                    total[name] += np.bincount(_trigrams(np.concatenate(rows)), minlength=1 << BITS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "gram", "n"])

    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    languages = sorted(r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect())
    rows = rows.where(F.col("lang").isin(languages))
    found = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # at most ``most`` * 65536 rows
    languages = sorted(found["lang"].unique())
    counts = np.zeros((len(languages), 1 << BITS))
    counts[np.searchsorted(languages, found["lang"]) if len(found) else [], found["gram"]] = found["n"]
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, mixture (such as ``en:0.71 fr:0.29``) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = _padded(batch["text"])
            letter = pc.match_substring_regex(batch["text"].fill_null(""), r"\p{L}").to_pylist()
            rows = []
            for i in range(len(batch)):
                if not letter[i] or not own.languages:
                    rows.append((UND, 0.0, ""))
                    continue
                chosen, share, sure = own.mixture(data[offsets[i] : offsets[i + 1]])
                order = sorted(range(len(chosen)), key=lambda j: (-share[j], chosen[j]))
                rows.append((own.languages[chosen[order[0]]], float(min(1.0, max(0.0, share[order[0]] * (sure if len(chosen) == 1 else 1.0)))), " ".join(f"{own.languages[chosen[j]]}:{share[j]:.2f}" for j in order)))
            names, scores, mixes = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([batch["doc_id"], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, pa.string())], names=["doc_id", "lang_pred", "score", "mixture"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {key}, lang_pred string, score double, mixture string")


def identify(docs: DataFrame) -> DataFrame:
    """Trains on the rows outside the held-out fold and predicts all rows."""
    model = train(docs.where(~held_out("doc_id", 5, 0)))
    return predict(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "mixture")


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a language (``und``) go; a row without doc_id stays.

    Rows of one doc_id go only if none of them has a language.
    """
    unknown = identify(docs).groupBy("doc_id").agg(F.bool_and(F.col("lang_pred") == UND).alias("none")).where("none").select("doc_id")
    return docs.join(unknown, "doc_id", "left_anti").select(*docs.columns)
