import random
from collections import Counter

import numpy as np
import pytest

from tessella.llm.common import components
from tessella.llm.order_minhash import SIMILARITY, distance_within, elements, keep_one, near_classes, order_sketches, similar


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(16))] for _ in range(2))
        most, d = rng.randrange(10), distance(a, b)
        assert distance_within(a, b, most) == (d if d <= most else None)


def one(h, k=5, kept=2):
    return order_sketches(h, np.array([0, len(h)]), np.array([0]), k, kept)[0]


def test_sketches_see_order():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    swapped = np.concatenate((h[100:], h[:100]))
    edited = h.copy()
    edited[50] = 1
    same = lambda x: (one(h) == one(x)).mean()
    assert same(h.copy()) == 1 and same(edited) > 0.7 > same(swapped)
    both = order_sketches(np.concatenate((h, edited)), np.array([0, 200, 400]), np.array([0, 1]), 5, 2)
    assert (both[0] == one(h)).all() and (both[1] == one(edited)).all()  # texts of a chunk don't mix


def test_repeated_kmers_are_labelled():
    h = np.array([7, 8] * 30, np.uint64)
    e, at = elements(h, np.array([0, 60]), np.array([0]), 2)
    assert len(set(e.tolist())) == 59 and at.tolist() == [0, 59]


def parents(n, links):
    up = {i: i for i in n}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 60
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([0, 25, 60]))] + ([(i, i + 1) for i in range(20, 40)] if seed % 2 else [])
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    want = parents(range(n), links)
    assert all(got.get(i, i) == want[i] for i in range(n))


def lost(df, rows):
    """Of all pairs of ``rows`` the links that ``near_classes`` parts, all links, and whether it joins nothing else."""
    rows = [(d, t) for d, t in rows if t.split()]
    bags = {d: Counter(t.split()) for d, t in rows}
    size = {d: b.total() for d, b in bags.items()}
    order = sorted(rows, key=lambda r: size[r[0]])
    links = []
    for i, (a, x) in enumerate(order):
        for b, y in order[i + 1 :]:
            if size[b] * SIMILARITY > size[a] + 1e-9:
                break
            if (bags[a] & bags[b]).total() >= SIMILARITY * size[b] - 1e-9 and similar(x, y):
                links.append((a, b))
    want = parents([d for d, _ in rows], links)
    got = {r["doc_id"]: r["class_id"] for r in near_classes(df).collect()}
    return sum(got[a] != got[b] for a, b in links), len(links), all(want[d] == want[got[d]] for d, _ in rows)


def test_against_all_pairs(spark, documents, texts):
    parted, links, clean = lost(documents, texts.items())
    assert links and parted <= 0.01 * links and clean


@pytest.mark.parametrize("scattered", (True, False))
def test_a_template_that_many_texts_share(spark, scattered):
    """A hundred groups of three: 200 words of all texts, and 60 others that agree in half inside a group only."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    template, rows = [word() for _ in range(200)], []
    for g in range(100):
        own = [word() for _ in range(60)]
        for i in range(3):
            rest = [w if (rng.random() < 0.66 if scattered else j < 38) else word() for j, w in enumerate(own)]
            rows.append((3 * g + i, " ".join(template + rest)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    parted, links, clean = lost(df, rows)
    assert links > 150 and parted <= 0.05 * links and clean


def test_scattered_edits_at_the_threshold(spark):
    """Texts of every length, with words changed, dropped and put in, just inside the similarity."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for n in [*range(5, 70, 2), 80, 120, 200, 300, 500] * 4:
        base = [word() for _ in range(n)]
        new = list(base)
        edits = max(1, int(n * 0.19)) if n > 9 else 1
        for p in rng.sample(range(n), edits):
            new[p] = rng.choice([word(), "", f"{new[p]} {word()}"])
        rows += [(2 * len(rows), " ".join(base)), (2 * len(rows) + 1, " ".join(new))]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    parted, links, clean = lost(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)
    assert links > 120 and parted <= 0.02 * links and clean


def test_edits(spark):
    rng = random.Random(1)
    pool = [f"w{i}" for i in range(500)]
    base = [rng.choice(pool) for _ in range(300)]
    rows = [(0, base)]
    for i in range(1, 12):
        new = list(base)
        for _ in range(2 * i):
            new[rng.randrange(300)] = rng.choice(pool)
        rows.append((i, new))
    rows += [(100 + i, [rng.choice(pool) for _ in range(300)]) for i in range(20)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_classes(df).collect()}
    assert all(got[i] == 0 for i in range(12)) and all(got[100 + i] == 100 + i for i in range(20))
    assert SIMILARITY == 0.8


def test_odd_input(spark, odd_docs, no_docs):
    got = [(r["doc_id"], r["class_id"], r["kept"]) for r in near_classes(odd_docs).collect()]
    assert len(got) == odd_docs.count()
    assert {d: c for d, c, _ in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, None: None, 7: 7, 8: 8, 9: 5}
    assert near_classes(no_docs).count() == 0
    two = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f"), (3, "g h i j k l")], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["class_id"]) for r in near_classes(two).collect()) == [(1, 1), (2, 2), (3, 1), (3, 1)]
    kept = keep_one(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "5", "7", "8", "None"]


@pytest.mark.parametrize("block", (7, 1 << 12))
def test_the_join_of_crowds_leaves_out_no_link(spark, documents, texts, block, monkeypatch):
    """All links among the table's texts, as if they were one crowd of one-text components; some lists in several blocks."""
    from tessella.llm import order_minhash

    monkeypatch.setattr(order_minhash, "BLOCK", block)
    held = documents.where("trim(text) <> ''").selectExpr("doc_id", "doc_id c", "text")
    got = {(r["u"], r["v"]) for r in order_minhash.crowd_pairs(held).collect()}
    bags = {d: Counter(t.encode().split()) for d, t in texts.items() if t}
    size = {d: b.total() for d, b in bags.items()}
    pairs = [(a, b) for a in bags for b in bags if a < b and min(size[a], size[b]) >= SIMILARITY * max(size[a], size[b]) - 1e-9]
    want = {(a, b) for a, b in pairs if (bags[a] & bags[b]).total() >= SIMILARITY * max(size[a], size[b]) - 1e-9 and similar(texts[a], texts[b])}
    assert len(want) > 20 and want <= got and len(got) < len(pairs) / 10


def test_crowds_without_rare_words(spark):
    """1,200 texts of 44 places with five words each that half of the texts have, and 50 words that all have: every bucket is crowded, every k-mer frequent."""
    rng = random.Random(5)
    template = [f"t{i}" for i in range(50)]
    codes = [rng.getrandbits(44) for _ in range(1100)]
    for i in range(100):
        codes.append(codes[i] ^ sum(1 << p for p in rng.sample(range(44), 10)))
    rows = [(d, " ".join(template + [f"p{p}v{x >> p & 1}w{i}" for p in range(44) for i in range(5)])) for d, x in enumerate(codes)]
    links = [(a, b) for b, y in enumerate(codes) for a, x in enumerate(codes[:b]) if 5 * (x ^ y).bit_count() <= 54]  # of 270 words
    want = parents(range(len(codes)), links)
    got = {r["doc_id"]: r["class_id"] for r in near_classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert len(links) >= 100 and got == want


def test_white_space_of_sketches_and_alignment_is_one():
    """No-break spaces part no words, so one word of ten differs."""
    base = [f"w{i}" for i in range(9)]
    assert similar(" ".join([*base, "q"]), "\t".join([*base, "q\u00a0r\u00a0s\u00a0t\u00a0u"]))


def test_each_text_of_a_doc_id_is_compared(spark):
    """Rows of one doc_id with two texts, one near to each of two other documents."""
    base = [[f"{x}{i}" for i in range(100)] for x in "ab"]
    near = [" ".join([*b[:50], "changed", *b[51:]]) for b in base]
    rows = [(1, " ".join(base[0])), (2, " ".join(base[1])), (3, near[0]), (3, near[1]), (4, "no link of these")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id bigint, text string").coalesce(1)
        assert sorted((r["doc_id"], r["class_id"]) for r in near_classes(df).collect()) == [(1, 1), (2, 1), (3, 1), (3, 1), (4, 4)]
        assert sorted(r["doc_id"] for r in keep_one(spark, df, "").collect()) == [1, 4]
