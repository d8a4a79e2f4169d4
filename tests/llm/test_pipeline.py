import random

import corpus_pipeline
from tessella.llm import registry


def test_stages_feed_each_other(spark, documents, sf_dir):
    docs, counts = documents, [documents.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == documents.columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[2] < counts[1]
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}


def test_empty_table(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_odd_input(spark, odd_docs):
    """Rows without a language go; of equal and near texts one stays; rows without doc_id and repeated rows pass."""
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == odd_docs.columns
    left = docs.collect()
    assert sorted(str(r["doc_id"]) for r in left) == ["4", "5", "5", "8", "None"]
    text = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert all(r["text"] == text[r["doc_id"]] for r in left)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in left}


def test_queries(spark, sf_dir):
    assert sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES) == list(range(1, 11))
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_sql(spark, sf_dir, duck):
    for name, sql in registry.SQL.items():
        got = registry.QUERIES[name](spark, sf_dir).toPandas()
        want = duck.execute(sql).df()
        columns = sorted(want.columns)
        key = lambda x: sorted(map(str, x[columns].itertuples(index=False, name=None)))
        assert sorted(got.columns) == columns and key(got) == key(want)


def test_near_dedup_loses_no_link_of_a_crowd(spark):
    """1,200 texts whose buckets are all crowded and whose k-mers are all frequent: 44 places of five words that half of the texts have."""
    rng = random.Random(5)
    codes = [rng.getrandbits(44) for _ in range(1100)]
    codes += [x ^ sum(1 << p for p in rng.sample(range(44), 10)) for x in codes[:100]]
    rows = [(d, " ".join([f"t{i}" for i in range(50)] + [f"p{p}v{x >> p & 1}w{i}" for p in range(44) for i in range(5)])) for d, x in enumerate(codes)]
    near = {d: [e for e, y in enumerate(codes) if 5 * (x ^ y).bit_count() <= 54] for d, x in enumerate(codes)}  # of 270 words
    least, before = {d: d for d in near}, None
    while least != before:
        least, before = {d: min(least[e] for e in near[d]) for d in near}, least
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    kept = {r["doc_id"] for r in stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "").collect()}
    assert len(kept) <= 1100 and kept == {d for d in least if least[d] == d}
