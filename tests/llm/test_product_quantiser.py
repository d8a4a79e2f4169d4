import numpy as np
import pytest

from tessella.llm.product_quantiser import near_vectors


def brute(ids, x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    label, (a, b) = np.arange(len(x)), np.nonzero(links)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        if (new == label).all():
            break
        label = new
    return links.sum(1), {i: min(ids[label == label[k]]) for k, i in enumerate(ids)}


def check(spark, ids, x, recall):
    df = spark.createDataFrame([(int(i), v.tolist(), int(i) % 3) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>, label int")
    n, part = brute(ids, np.array(x, np.float32).astype(float))
    got = {r["vec_id"]: r for r in near_vectors(df).collect()}
    assert len(got) == len(ids)
    have = np.array([got[i]["n_links"] for i in ids])
    assert (have <= n).all() and have.sum() >= recall * n.sum()
    if have.sum() == n.sum():
        assert all(got[i]["component_id"] == part[i] and got[i]["kept"] == (part[i] == i) for i in ids)


def test_planted(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 64))
    for i in range(0, 600, 6):  # groups of copies at several cosines, and equal vectors
        for k, noise in enumerate((0.02, 0.2, 0.35, 0.45)):
            d = rng.normal(size=64)
            x[i + k + 1] = x[i] + noise * np.linalg.norm(x[i]) * d / np.linalg.norm(d)
        x[i + 5] = x[i] * 2 if i % 12 else x[i]
    ids = rng.permutation(5000)[:1500]
    check(spark, ids, x, 0.97)


@pytest.mark.parametrize("inner", (2, 4, 8))
def test_vectors_of_few_inner_dimensions(spark, inner):
    rng = np.random.default_rng(inner)
    x = rng.normal(size=(1200, inner)) @ rng.normal(size=(inner, 384 if inner == 4 else 64))
    check(spark, np.arange(len(x)), x, 1)


def test_a_crowded_group(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(size=(300, 16)), rng.normal(size=16) * 5 + rng.normal(size=(2600, 16)) * 0.3, np.repeat(rng.normal(size=(1, 16)), 400, 0)))
    check(spark, np.arange(len(x)), x, 0.99)


def test_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    check(spark, np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows]), 1)


def test_vectors_of_several_lengths(spark):
    """Rare lengths are compared whole, a frequent one has an index; none is left out."""
    rng = np.random.default_rng(7)
    rows, at = [], 0
    want = {}
    for dim, groups in ((3, 5), (2, 40), (16, 900)):
        for _ in range(groups):
            v = rng.normal(size=dim) * 3
            group = [v, v * 2, v + 0.01 * rng.normal(size=dim)] if dim == 16 or groups == 5 else [v]
            rows += [(at + i, x.tolist()) for i, x in enumerate(group)]
            at += len(group)
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    for i, a in x.items():
        want[i] = sum(len(a) == len(b) and i != j and a @ b >= 0.9 for j, b in x.items() if len(a) == len(b))
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == want


def test_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (10, [-1.0, -2.0])]
    df = spark.createDataFrame([(*r, 1, 0, True) for r in rows], "vec_id bigint, embedding array<double>, label int, n int, kept boolean")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect())
    alone = [(str(i), 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10)]
    assert got == sorted([*alone, ("7", 2, 7, True), ("7", 2, 7, True), ("8", 2, 7, False), ("None", 0, None, True)])
    assert near_vectors(df.limit(0)).count() == 0
    assert [r["n_links"] for r in near_vectors(df.where("vec_id < 4")).collect()] == [0, 0, 0]
