import hashlib
import re

import pytest

from tessella.llm.exact_dedup import exact_dedup, keep_first


def expected(rows):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in rows]
    groups = {}
    for d, t in norm:
        groups.setdefault(t, []).append(d)
    low = {t: min((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return sorted((str(d), low[t], len(groups[t]), d == low[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in norm)


def actual(df):
    return sorted((str(r[0]), *r[1:]) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


@pytest.mark.parametrize("block_bytes,buckets", [(16384, None), (64, None), (100, 3), (7, 1)])
def test_names_tell_texts_apart(spark, block_bytes, buckets):
    """Short blocks make many levels, few buckets make crowded ones."""
    texts = ["a" * 7, "a" * 8, "a" * 14, "a" * 21, "b" * 7, "ab" * 50, "ab" * 49 + "ba", "", None, "x y", "x\n\ty", "é" * 40, "é" * 39 + "e"]
    rows = [(i, t) for i, t in enumerate(texts + texts[:9])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert actual(exact_dedup(df, block_bytes, buckets)) == expected(rows)


def test_odd_input(odd_docs, no_docs, spark):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert actual(exact_dedup(odd_docs, 1024)) == expected(rows)
    assert exact_dedup(no_docs).count() == 0
    kept = keep_first(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns
    # 9 and 5 have different texts only until white space is normalised; a row without doc_id can't be dropped by id
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "5", "7", "8", "None"]


def test_table(documents, texts):
    assert actual(exact_dedup(documents)) == expected(list(texts.items()))
