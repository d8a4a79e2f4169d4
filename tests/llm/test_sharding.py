import zlib
from collections import Counter, defaultdict

import pytest

from tessella.llm.sharding import shard_documents


def check(rows, texts, shards):
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d) for d, _ in texts)
    text = {}
    for d, t in texts:
        text.setdefault(d, t or "")
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        assert 0 <= r["shard"] < shards
        sizes[r["shard"]] += 1
        slots[r["shard"]].append(r["slot"])
    counts = [sizes[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def cut_groups(rows, texts):
    text, at = dict(texts), defaultdict(set)
    for r in rows:
        at[text[r["doc_id"]]].add(r["shard"])
    return at


def test_groups_stay_together(spark):
    texts = [(i, f"group {i // 3 % 700}" if i % 2 else f"alone {i}") for i in range(12000)]
    rows = shard_documents(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    check(rows, texts, 16)
    at = cut_groups(rows, texts)
    assert sum(len(s) > 1 for s in at.values()) <= 16


def test_a_text_with_a_third_of_all_rows(spark):
    texts = [(i, "common" if i % 3 == 0 else f"pair {i // 2 % 3000}") for i in range(9000)]
    rows = shard_documents(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    check(rows, texts, 16)
    at = cut_groups(rows, texts)
    assert len(at["common"]) <= 12 and sum(len(s) > 1 for s in at.values()) <= 100


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_odd_input(odd_docs, no_docs, shards):
    check(shard_documents(odd_docs, shards).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()], shards)
    assert shard_documents(no_docs, shards).count() == 0


def test_table(documents, texts):
    check(shard_documents(documents).collect(), list(texts.items()), 16)
