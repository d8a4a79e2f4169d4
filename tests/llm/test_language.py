import zlib

import numpy as np

from tessella.llm.language import UND, _trigrams, identify, known_language, predict, train


def test_held_out_accuracy(documents):
    langs = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = identify(documents).collect()
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) >= 0.97


def test_mixtures_are_found(spark, documents, texts):
    model = train(documents)
    langs = {r["doc_id"]: r["lang"] for r in documents.collect()}
    by = {}
    for d, t in sorted(texts.items()):
        if len(t) > 1500:
            by.setdefault(langs[d], t[:1500])
    a, b = sorted(by)[:2]
    rows = spark.createDataFrame([(1, by[a] + " " + by[b]), (2, by[a]), (3, by[a] + " " + by[b][:500])], "doc_id bigint, text string")
    got = {r["doc_id"]: r["mixture"] for r in predict(rows, model).collect()}
    share = {k: {p.split(":")[0]: float(p.split(":")[1]) for p in m.split()} for k, m in got.items()}
    assert set(share[1]) == {a, b} and abs(share[1][a] - 0.5) < 0.15
    assert set(share[2]) == {a}
    assert set(share[3]) == {a, b} and share[3][a] > share[3][b]


def test_odd_input(spark, odd_docs, no_docs):
    rows = identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r["doc_id"] in (1, 2, 3, 7):
            assert (r["lang_pred"], r["score"]) == (UND, 0.0)
        else:
            assert r["lang_pred"] in ("en", "fr")
    assert identify(no_docs).count() == 0
    unlabelled = odd_docs.where("doc_id = 4").selectExpr("doc_id", "text", "cast(null as string) lang")
    assert [r["lang_pred"] for r in identify(unlabelled).collect()] == [UND]
    kept = known_language(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, None, 8, 9}


def test_labels_of_held_out_rows_are_not_used(spark, documents):
    from pyspark.sql import functions as F

    from tessella.llm.language import held_out

    changed = documents.withColumn("lang", F.when(held_out("doc_id", 5, 0), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    key = lambda df: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in df.collect())
    assert key(identify(documents)) == key(identify(changed))


def test_proportions_are_the_likeliest(documents, texts):
    """EM's proportions and the set of languages against a search of a grid."""
    model = train(documents)
    langs = {r["doc_id"]: r["lang"] for r in documents.collect()}
    by = {}
    for d, t in sorted(texts.items()):
        if len(t) > 1500:
            by.setdefault(langs[d], t[:1500])
    a, b = sorted(by)[:2]
    text = np.frombuffer(f" {by[a][:900]} {by[b][:500]} ".lower().encode(), np.uint8)
    chosen, share, _ = model.mixture(text)
    u, c = np.unique(_trigrams(text), return_counts=True)
    p = np.exp(model.log_p[u])
    value = lambda ks, w: float(c @ np.log(p[:, ks] @ w))
    grid = np.linspace(0.001, 0.999, 999)
    best = max(((value([i, j], np.array([g, 1 - g])), i, j, g) for i in range(p.shape[1]) for j in range(i) for g in grid[::20]), key=lambda x: x[0])
    assert {best[1], best[2]} == set(chosen)
    i, j = chosen
    fine = max(grid, key=lambda g: value([i, j], np.array([g, 1 - g])))
    assert abs(share[0] - fine) < 0.01


def test_rows_without_doc_id_and_many_labels(spark):
    rows = [(None, "aaa bbb ccc", "en"), (None, "aaa bbb", "en"), (1, "xyz uvw", "fr"), *((i, f"word{i}", f"l{i}") for i in range(2, 30))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = identify(df).collect()
    assert len(got) == len(rows) and all(r["held_out"] is not None for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] is None} == {"en"}  # learned from rows without doc_id
    assert train(df, most=2).languages[0] == "en" and len(train(df, most=2).languages) == 2
