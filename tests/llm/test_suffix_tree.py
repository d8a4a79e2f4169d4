import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessella.llm.suffix_tree import LEAST, MAX_DEPTH, WEIGHT, score_documents

LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["\0end"]


def check(df, rows):
    train = [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for t in train for w in tokens(t))
    total, distinct = sum(c.values()), len(c)
    got = score_documents(df).collect()
    want = sorted((str(d), d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), total, sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in tokens(t))) for d, t in rows)
    have = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in have], [x[5] for x in want], rtol=1e-9)
    return got


def test_table(documents, texts):
    got = check(documents, list(texts.items()))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


class Brute:
    """The model by dictionaries, as the docstring has it."""

    def __init__(self, texts, depth=MAX_DEPTH):
        self.depth, rows = depth, [["\0start", *tokens(t)] for t in texts]
        self.c = Counter(tuple(r[i - n + 1 : i + 1]) for r in rows for i in range(len(r)) for n in range(1, min(i, depth) + 2))
        one = {k[0]: v for k, v in self.c.items() if len(k) == 1 and k[0] != "\0start"}
        self.words, self.total, self.distinct = one, sum(one.values()), len(one)
        self.next = {}
        for g in self.c:
            if len(g) > 1 or g[0] != "\0start":
                self.next.setdefault(g[:-1], []).append(g[-1])
        self.n = {s: sum(self.c[(*s, w)] for w in ws) for s, ws in self.next.items()}
        self.kept = {s for s in self.next if s and self.retained(s)}

    def root(self, w):
        return (self.words.get(w, 0) + 1) / (self.total + self.distinct + 1)

    def chain(self, s, w, only=None):
        p = self.root(w)
        for i in range(len(s) - 1, -1, -1):
            t = s[i:]
            if self.n.get(t, 0) >= LEAST and (only is None or t in only):
                p = (self.c[(*t, w)] + WEIGHT * p) / (self.n[t] + WEIGHT)
        return p

    def retained(self, s):
        n, ws = self.n[s], self.next[s]
        if n < LEAST or n >= self.n[s[1:]] or any(len(self.next[s[i:]]) == 1 for i in range(1, len(s))):
            return False
        gain = sum(self.c[(*s, w)] * math.log(self.c[(*s, w)] / n / self.chain(s[1:], w)) for w in ws)
        return gain > 0.5 * len(ws) * math.log(max(self.total, 2)) + 1e-9

    def score(self, text):
        r = ["\0start", *tokens(text)]
        return sum(math.log10(self.chain(tuple(r[max(0, i - self.depth) : i]), r[i], self.kept)) for i in range(1, len(r)))


def brute_check(df, rows, depth=MAX_DEPTH):
    model = Brute([t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2], depth)
    got = sorted((str(r["doc_id"]), r["score"]) for r in score_documents(df, depth).collect())
    want = sorted((str(d), model.score(t)) for d, t in rows)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-9, atol=1e-9)
    return model


def test_scores_are_those_of_brute_force(spark):
    """Random texts of few words, near copies among them, so contexts of every depth are retained."""
    rng = random.Random(3)
    rows, base = [], [f"w{rng.randrange(30)}" for _ in range(120)]
    for i in range(60):
        text = [w if rng.random() < 0.9 else f"w{rng.randrange(30)}" for w in base] if i % 3 else [f"W{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(80))]
        rows.append((i, " ".join(text)))
    phrases = ["A m n o k 1", "B m n o k 2", "C g h i 3", "D g h i 4"]  # only the first word tells the last
    rows += [(100 + i, " ".join(rng.choice(phrases) for _ in range(30))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    model = brute_check(df, rows)
    assert {len(s) for s in model.kept} == {1, 2, 3, 4, 5}
    brute_check(df, rows, 3)
    s = max(model.kept, key=len)
    assert abs(sum(model.chain(s, w, model.kept) for w in [*model.words, "an unknown word"]) - 1) < 1e-9


def test_table_against_brute_force(documents, texts):
    rows = list(texts.items())
    model = brute_check(documents, rows)
    few = Brute([t for d, t in rows if d % 4 == 0])
    assert len(few.kept) < len(model.kept) / 2  # the tree grows with the corpus


def test_blocks_and_parts_change_nothing(spark, documents, monkeypatch):
    from tessella.llm import suffix_tree

    key = lambda df: {r["doc_id"]: r["score"] for r in df.collect()}
    one = key(score_documents(documents.coalesce(1)))
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 20000)
    monkeypatch.setattr(suffix_tree, "ENTRIES", 5000)
    many = key(score_documents(documents.repartition(3)))
    assert one.keys() == many.keys() and all(abs(one[d] - many[d]) < 1e-6 for d in one)


def test_documents_that_occur_twice_score_apart(spark):
    rng = random.Random(5)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 2000}"
    rows = [(i, " ".join(word() for _ in range(150))) for i in range(200)]
    rows += [(200 + i, rows[i][1]) for i in range(20)]
    rows = [(d, t) for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    n = Counter(t for _, t in rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["score"] - r["base_score"]) / r["n_tokens"] for r in score_documents(df).collect()}
    twice, once = ([got[d] for d, t in rows if (n[t] > 1) is x] for x in (True, False))
    assert min(twice) > max(once)


def test_odd_input(spark, odd_docs, no_docs):
    check(odd_docs, [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert score_documents(no_docs).count() == 0
    alone = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2)
    held = spark.createDataFrame([(alone, "some words")], "doc_id bigint, text string")
    row = score_documents(held).first()
    assert (row["train_tokens"], row["n_known"], row["score"]) == (0, 0, pytest.approx(row["base_score"]))


def test_only_contexts_that_may_be_retained_are_tested(documents, texts, monkeypatch):
    """Few of the contexts that could be asked for are; n-grams of over four words only where those of four occur twice and go on."""
    from tessella.llm import suffix_tree

    rows, write = [], suffix_tree.materialise
    monkeypatch.setattr(suffix_tree, "materialise", lambda df, tag: _noted(write(df, tag), rows))
    suffix_tree.score_documents(documents).count()
    counted, tested = ([sum(len(suffix_tree._unpacked(r["data"])[j]) for r in rows if r["turn"] == t) for t in range(5)] for j in range(2))
    model = Brute([t for d, t in texts.items() if zlib.crc32(str(d).encode()) % 7 != 2])
    asked = {n: sum(len(s) == n and model.n[s] >= LEAST and model.n[s] < model.n[s[1:]] and all(len(model.next[s[i:]]) > 1 for i in range(1, n)) for s in model.next if s) for n in (2, 3)}
    assert tested[2] < asked[2] / 2 and tested[3] < asked[3] / 2 and counted[3] < counted[2] / 2


def _noted(df, rows):
    rows += df.collect()
    return df


def test_counts_that_two_words_tell_are_not_asked_for(spark, monkeypatch):
    """Two words that occur once, in no text held out, or never, tell the counts of longer n-grams; those that a text held out has too don't."""
    from tessella.llm import suffix_tree

    rows, write = [], suffix_tree.materialise
    monkeypatch.setattr(suffix_tree, "materialise", lambda df, tag: _noted(write(df, tag), rows))
    held = {d for d in range(300) if zlib.crc32(str(d).encode()) % 7 == 2}
    learned = min({*range(300)} - held)
    docs = [(d, f"{'a' if d % 2 else 'c'} a b x{learned if d == min(held) else d}") for d in range(300)]
    brute_check(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1), docs)
    asked = [sum(len(suffix_tree._unpacked(r["data"])[0]) for r in rows if r["turn"] == t) for t in range(3)]
    assert 0 < asked[1] < 20 and asked[2] < 20  # of 300 that end with an x


def test_answers_do_not_move_again(documents, monkeypatch):
    """Blocks and the answers to them lie in the same buckets, so what settles them needs no exchange."""
    from tessella.llm import suffix_tree

    plans, write = {}, suffix_tree.bucketed
    monkeypatch.setattr(suffix_tree, "bucketed", lambda df, key, buckets, tag: plans.setdefault(tag, df._jdf.queryExecution().executedPlan().toString()) and write(df, key, buckets, tag))
    suffix_tree.score_documents(documents).count()
    assert "FlatMapCoGroupsInArrow" in plans["deep"] and "Exchange" not in plans["deep"]


def test_packed_arrays_come_back_and_take_few_bytes(documents):
    from tessella.llm import suffix_tree

    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 46, 12000, dtype=np.uint64))  # a part's share of the keys of a block
    arrays = [keys, np.minimum(rng.zipf(3, len(keys)), 1000).astype(np.uint32), rng.normal(size=len(keys)), np.arange(3), np.zeros(0, np.uint64), np.array([True, False])]
    for x, y in zip(arrays, suffix_tree._unpacked(suffix_tree._packed(*arrays)), strict=True):
        assert x.dtype == y.dtype and np.array_equal(x, y)
    bits = np.log2(np.e * (1 << 46) / len(keys))  # what differences of sorted random numbers tell
    assert len(suffix_tree._packed(keys)) < 1.03 * len(keys) * bits / 8
    _, _, at, u = suffix_tree._unpacked(suffix_tree.tokenised(documents.selectExpr("doc_id", "false AS held", "text")).first()["data"])
    times = np.bincount(at, minlength=len(u))
    assert (times[1:] <= times[:-1]).all()  # frequent words have small places
