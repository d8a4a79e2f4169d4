import hashlib
import random

import public_tokenizers
import pytest

from tessella.llm.byte_bpe import _pieces, decode, encode, load_ranks


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def check(df, texts, library, **options):
    rows = encode(df, emit="digest", **options).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows)
    want = []
    for d, t in texts:
        ids = library(t or "")
        want.append((str(d), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_table(documents, texts, library):
    check(documents, texts.items(), library, stable=True)


def test_odd_input(odd_docs, no_docs, library):
    check(odd_docs, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], library)
    assert encode(no_docs).count() == 0


def test_random_text_round_trip(spark, library):
    rng = random.Random(2)
    pool = [chr(i) for i in range(0, 0x180)] + list("漢字きʰΩя🙂‍  ") + ["  ", "\n\n", "'s", "'Re", "\x00", "123"]
    texts = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(400)] + [(400, "x" * 5000), (401, " " * 3000)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    encoded = encode(df)
    ids = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    assert ids == {d: library(t) for d, t in texts}
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in decode(encoded).collect()} == dict(texts)


def test_decode_keeps_repeated_rows(spark):
    rows = [(1, "ab cd"), (1, "ab cd"), (None, "x"), (2, ""), (3, None)]
    out = decode(encode(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    assert sorted((str(r["doc_id"]), bytes(r["bytes"]).decode()) for r in out) == sorted((str(d), t or "") for d, t in rows)


def test_an_unknown_id_raises():
    import numpy as np

    with pytest.raises(RuntimeError, match="token-byte"):
        _pieces(public_tokenizers.path("byte_bpe_50k.tiktoken"), np.array([5, 60000]))
