import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tessella.llm.packing import PLAIN, _encoder, _least_squares, _patterns, pack_documents, plan


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_ids_are_those_of_the_library(reference, texts):
    encode = _encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(5)
    pool = [chr(i) for i in range(1, 0x250)] + list("‐–—‘’“”… 漢字きʰΩя🙂‍") + [" ", "  ", "\n", "'s", "'ll", "<|endoftext|>"]
    odd = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(1500)]
    for text in [*odd, *texts.values()]:
        assert encode(text).tolist() == reference(text), repr(text)


def test_plain_characters_agree_one_by_one_and_in_pairs(reference):
    """Every pair of the characters that go by ranks is in one of these texts, alone and after letters, numbers and spaces."""
    plain = [c for c in map(chr, range(0x2030)) if not PLAIN.search(c)]
    assert len(plain) > 500
    encode = _encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for a in plain:
        for text in (f"x{a}1{a} {a}{a}\n{a}", "".join(a + b for b in plain)):
            assert encode(text).tolist() == reference(text), repr(a)


def check(rows, want, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    for d, ids in want.items():
        raw, at = np.array([*ids, 0], "<u4"), 0
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == capacity)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(raw[r["start"] : at].tobytes())
        assert at == len(raw)
    return len(by_seq)


def test_table(documents, texts, reference):
    rows = pack_documents(documents).collect()
    n = check(rows, {d: reference(t) for d, t in texts.items()}, 2048)
    assert n <= math.ceil(sum(r["length"] for r in rows) / 2048) * 1.02 + 1


def test_odd_input(odd_docs, no_docs, reference):
    rows = pack_documents(odd_docs, 64).collect()
    one = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert sum(r["length"] for r in rows) == sum(len(reference(r["text"] or "")) + 1 for r in odd_docs.collect())
    assert len([r for r in rows if r["doc_id"] == 5]) == 2
    assert [r["length"] for r in rows if r["doc_id"] == 1] == [1]
    assert set(one) == {r["doc_id"] for r in rows}
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for a, b in zip(places, places[1:]):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)
    assert pack_documents(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_every_length_once(seed):
    rng = np.random.default_rng(seed)
    cap = [8, 64, 2048][seed % 3]
    counts = np.zeros(cap + 1, np.int64)
    np.add.at(counts, rng.integers(1, cap + 1, 3000) if seed % 2 else np.minimum(cap, rng.geometric(4 / cap, 3000)), 1)
    used, sequences = np.zeros(cap + 1, np.int64), 0
    for items, n in plan(counts):
        assert sum(a * m for a, m in items) <= cap and n > 0
        sequences += n
        for a, m in items:
            used[a] += m * n
    assert (used == counts).all()
    items = sorted((a for a in range(cap, 0, -1) for _ in range(counts[a])), reverse=True)
    bins = []  # best fit, longest first, one by one
    for a in items:
        fits = [f for f in bins if f >= a]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - a)
        else:
            bins.append(cap - a)
    assert sequences <= len(bins) * 1.02 + 1


def test_least_squares_finds_an_exact_fit():
    counts = np.zeros(11, np.int64)
    for pattern, n in (((7, 3), 40), ((5, 5), 10), ((10,), 6)):
        for a in pattern:
            counts[a] += n
    patterns = _patterns(counts)
    x = _least_squares(patterns, counts)
    used = np.bincount(patterns.ravel(), np.repeat(x, 3), 11)
    assert (x >= 0).all() and np.abs(used[1:] - counts[1:]).max() < 0.5
