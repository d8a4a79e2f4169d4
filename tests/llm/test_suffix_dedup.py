import random

import numpy as np
import pytest

from tessella.llm.suffix_dedup import cut, cut_repeats, repeats, suffixes


def windows(texts, n):
    """Words of documents in an n-word window that an earlier document holds."""
    first, out = {}, {}
    for d in sorted(texts):
        w = texts[d].split()
        for p in range(len(w) - n + 1):
            if first.setdefault(tuple(w[p : p + n]), d) != d:
                out.setdefault(d, set()).update(range(p, p + n))
    return out


def spans(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    return {d: sorted(s) for d, s in out.items()}


def test_every_passage_holds_a_suffix_at_both_ends():
    rng = np.random.default_rng(0)
    for n in (50, 51, 77, 300):
        h = rng.integers(0, 1 << 63, n).astype(np.uint64)
        _, _, start = suffixes(h, np.array([0, n]), 50, 8, 26)
        for s in range(n - 49):
            inside = [x for x in start if s <= x and x + 25 <= s + 50]
            assert inside


@pytest.mark.parametrize("seed", range(3))
def test_planted_passages(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(100000)}"
    passages = [[word() for _ in range(n)] for n in (50, 51, 60, 90, 200, 49, 30)]
    texts, want = {}, {}
    seen = set()
    for d in range(60):
        parts, at = [], 0
        for _ in range(rng.randrange(1, 4)):
            fill = [word() for _ in range(rng.randrange(5, 120))]
            parts, at = parts + fill, at + len(fill)
            k = rng.randrange(7)
            if (k, d) in seen:
                continue
            if any(s[0] == k for s in seen) and len(passages[k]) >= 50:
                want.setdefault(d, []).append((at, at + len(passages[k])))
            seen.add((k, d))
            parts, at = parts + passages[k], at + len(passages[k])
        texts[d] = " ".join(parts)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    found = repeats(df)
    assert spans(found) == want
    after = {r["doc_id"]: r["text"].split() for r in cut(df, found).collect()}
    for d, t in texts.items():
        gone = {i for a, b in want.get(d, []) for i in range(a, b)}
        assert after[d] == [w for i, w in enumerate(t.split()) if i not in gone]


@pytest.mark.parametrize("tasks", (1, 40, 211))
def test_any_number_of_tasks(spark, tasks, monkeypatch):
    """The same rows however they are dealt; the document named is one that keeps the passage."""
    from tessella.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "FREQUENT", 16)  # so some names are frequent
    common = " ".join(f"c{i}" for i in range(60))
    texts = {d: f"a{d} b{d} {common} " + " ".join(f"e{d // 2}x{i}" for i in range(55)) for d in range(120)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(r) for r in repeats(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(tasks)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted([(d, 2, 117, 0) for d in range(3, 120, 2)] + [(1, 2, 117, 0)] + [(d, 2, 62, 0) for d in range(2, 120, 2)])


def test_a_very_common_passage(spark):
    """One passage in every document, over more tasks than documents hold it in."""
    common = " ".join(f"c{i}" for i in range(70))
    df = spark.createDataFrame([(d, f"{' '.join(f'a{d}x{i}' for i in range(20))} {common} {' '.join(f'b{d}x{i}' for i in range(20))}") for d in range(200)], "doc_id bigint, text string").repartition(7)
    assert spans(repeats(df)) == {d: [(20, 90)] for d in range(1, 200)}


def test_windows_of_a_very_common_passage_move_as_one(spark, monkeypatch):
    """A document sends a stretch of the passage that all hold, not each of its windows."""
    from tessella.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "FREQUENT", 64)
    merged, pieces = suffix_dedup._merged, []
    monkeypatch.setattr(suffix_dedup, "_merged", lambda df, *rest: (pieces.append(df.count()), merged(df, *rest))[1])
    common = " ".join(f"c{i}" for i in range(100))
    df = spark.createDataFrame([(d, f"a{d} b{d} {common} e{d} {common} f{d}") for d in range(200)], "doc_id bigint, text string").repartition(3)
    assert spans(repeats(df)) == {d: [(2, 102), (103, 203)] for d in range(1, 200)}
    assert pieces[0] <= 2 * 199 + 20  # a batch may end inside a stretch


@pytest.mark.parametrize("seed", range(2))
def test_a_later_document_holds_the_whole_passage(spark, seed):
    """The first document of a passage holds only part of it, and passages come in many versions."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(100000)}"
    fill = lambda: [word() for _ in range(rng.randrange(5, 40))]
    docs = []
    for n in (52, 55, 60, 90):
        for _ in range(5):
            passage = [word() for _ in range(n)]
            cut_ = rng.randrange(n - 48)
            docs += [fill() + passage[cut_ : cut_ + 49] + fill(), fill() + passage + fill(), fill() + passage + fill()]
    version = [word() for _ in range(100)]
    for _ in range(60):
        own = list(version)
        for i in rng.sample(range(100), 2):
            own[i] = word()
        docs.append(fill() + own + fill())
    texts = {d: " ".join(x) for d, x in enumerate(docs)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    got = {d: {i for a, b in s for i in range(a, b)} for d, s in spans(repeats(df)).items()}
    assert got == windows(texts, 50)


def test_table(documents, texts):
    want = windows(texts, 50)
    got = {d: {i for a, b in s for i in range(a, b)} for d, s in spans(repeats(documents)).items()}
    assert set(got) == set(want)
    total = sum(map(len, want.values()))
    assert total and got == want


def test_odd_input(spark, odd_docs, no_docs):
    assert repeats(odd_docs).count() == 0  # repeats inside one document and repeated rows don't count
    assert repeats(no_docs).count() == 0
    out = cut_repeats(spark, odd_docs, "")
    assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes
    key = lambda df: sorted(map(str, df.collect()))
    assert key(out) == key(odd_docs)
    with pytest.raises(ValueError):
        repeats(odd_docs, min_words=20)
