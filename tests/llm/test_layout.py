"""Places in groups, sharding, whitening and the Merkle manifest."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourmark.llm import merkle, ranks, sharding, whitening
from hourmark.runtime import cut, new_path
from tests.llm import brute, cases
from tests.llm.cases import frame, ordered, rows_of


@pytest.mark.parametrize("partitions", [1, 7])
def test_places_of_a_group_that_holds_most_rows(spark, partitions):
    rows = [("hot", k % 50) for k in range(3000)] + [(None, k) for k in range(20)] + [(f"g{k}", 1) for k in range(40)]
    df = cut(spark.createDataFrame(rows, "g string, v bigint").repartition(partitions))
    got = ranks.ranked(df, ["g"], ["v"])
    assert got.columns == ["g", "v", "rank", "members"]
    by_group = {}
    for r in got.collect():
        by_group.setdefault((r.g, r.members), []).append((r.rank, r.v))
    assert {g: n for g, n in by_group} == {"hot": 3000, None: 20, **{f"g{k}": 1 for k in range(40)}}
    for (_, n), placed in by_group.items():
        assert [r for r, _ in sorted(placed)] == list(range(n)) and [v for _, v in sorted(placed)] == sorted(v for _, v in placed)


def test_a_group_is_dealt_to_several_tasks(spark, monkeypatch):
    df = cut(spark.range(40_000, numPartitions=8).select(F.lit("one").alias("g"), F.lit(None).cast("bigint").alias("v")))
    widest = []
    monkeypatch.setattr(ranks, "cut", lambda made: widest.append(made) or cut(made))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows are few
    try:
        ranks.ranked(df, ["g"], ["v"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = [r["n"] for r in cut(widest[0]).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(held) == 40_000 and max(held) < 20_000


# -- sharding


@pytest.mark.parametrize("shards, grown", [(1, 1), (1, 2), (24, 25), (3, 200), (1000, 5000)])
def test_the_published_function(spark, shards, grown):
    keys = [0, 1, 2, -1, -5, 2**63 - 1, -(2**63), 12345678901, *range(100, 400)]
    got = sharding.place(spark.createDataFrame([(k,) for k in keys], "key bigint"), "key", shards, grown).collect()
    assert {r.key: (r.shard, r.grown_shard) for r in got} == {k: (brute.jump(k, shards), brute.jump(k, grown)) for k in keys}


def test_keys_that_need_many_steps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_STEPS", 2)
    got = sharding.place(spark.range(500), "id", 64).collect()
    assert {r.id: r.shard for r in got} == {k: brute.jump(k, 64) for k in range(500)}


def test_layout_like_brute_force(spark):
    docs = cases.documents() + [(None, None, None, None, None)] * 40
    df = frame(spark, docs, cases.DOCS, [c for c in cases.CLASHING if c != "size"] + ["slot", "grown_shard", "text_crc32", "law"])
    by_shard = {}
    for d in docs:
        data = (d[1] or "").encode()
        by_shard.setdefault(brute.jump(d[0] or 0, 24), []).append((d[0], len(data) + 8, zlib.crc32(data), brute.jump(d[0] or 0, 25)))
    want = []
    for shard, rows in by_shard.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        want += [(*r[:3], shard, slot, r[3]) for slot, r in enumerate(rows)]
    columns = "doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"
    for n in (1, 6):
        assert rows_of(sharding.layout(df.repartition(n)), *columns) == ordered(want)
    assert sharding.layout(df.limit(0)).count() == 0


def test_only_the_needed_share_moves(spark):
    rows = spark.range(20_000).withColumn("shard", F.lit("mine"))
    gone = sharding.moved(rows, "id", 24, 26).collect()
    assert all(r.grown_shard >= 24 and r.shard < 24 for r in gone)
    assert math.isclose(len(gone) / 20_000, 2 / 26, rel_tol=0.1)
    sizes = [r["count"] for r in sharding.place(rows, "id", 24).groupBy("shard").count().collect()]
    assert len(sizes) == 24 and max(sizes) < 1.1 * 20_000 / 24
    with pytest.raises(ValueError):
        sharding.moved(rows, "id", 24, 3)


def test_any_key_and_written_shards(spark):
    rows = spark.range(900).select(F.concat(F.lit("k"), F.col("id") % 300).alias("a.key"), "id")
    path = new_path(spark, "shards")
    sharding.write_shards(rows, path, "a.key", 5, spread=2)
    back = spark.read.parquet(path)
    assert back.count() == 900 and back.select("`a.key`", "shard").distinct().count() == 300
    again = sharding.place(rows, "a.key", 5).select("id", "shard")
    assert rows_of(back, "id", "shard") == rows_of(again, "id", "shard")


def test_no_python_on_the_way(spark):
    df = frame(spark, cases.documents(), cases.DOCS)
    for made in (sharding.layout(df), sharding.place(df, "doc_id", 24, 25)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# -- whitening


@pytest.mark.parametrize(
    "matrix",
    [np.eye(20), np.diag(np.arange(20.0)), np.ones((20, 20)), np.diag([5.0, 5, 5, 1, 1, 0, 0, 0]), np.zeros((5, 5)), np.array([[3.0]]), np.array([[1.0, 2], [2, 1]])],
)
def test_components_of_special_matrices(matrix):
    _components_hold(matrix, min(16, len(matrix)))


@pytest.mark.parametrize("size, close", [(3, 0), (17, 0), (64, 0), (64, 1e-10), (64, 1e-15), (130, 1e-4)])
def test_components_like_another_solver(size, close):
    rng = np.random.default_rng(size)
    basis = np.linalg.qr(rng.standard_normal((size, size)))[0]
    values = np.concatenate([7 + close * np.arange(size // 3), rng.random(size - size // 3)])
    _components_hold(basis @ np.diag(values) @ basis.T, min(16, size))


def _components_hold(matrix, many):
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading_components(matrix, many)
    largest = max(np.abs(np.linalg.eigvalsh(matrix)).max(), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][:many]).max() <= 1e-13 * largest
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * largest
    assert np.abs(vectors.T @ vectors - np.eye(many)).max() <= 1e-12


def test_sums_of_products_are_exact():
    rng = np.random.default_rng(1)
    for largest in (10, 2**20, 2**27, 2**40):
        y = rng.integers(-largest, largest, (300, 3))
        exact = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(3)] for i in range(3)]
        assert whitening.products(y).tolist() == exact


VECTORS = "vec_id bigint, embedding array<float>, label int"


def vectors(n, size, seed=3):
    rng = random.Random(seed)
    return [(k, [rng.gauss(0, 1 + j % 4) for j in range(size)], None) for k in range(n)]


def plain(rows):
    """{(vec_id, x)}: what is expected of each row, by another solver."""
    x = np.floor(64 * np.array([r[1] for r in rows], dtype=np.float32).astype(float)).astype(np.int64) + 10**6
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    many = min(16, x.shape[1])
    values, basis = values[::-1][:many], basis[:, ::-1][:, :many]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ basis / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("size", [1, 2, 24])
def test_whitening_like_another_solver(spark, size):
    rows = vectors(400, size)
    rows += [(400 + k, rows[5][1], None) for k in range(150)] + [(None, rows[6][1], None), (2**62 + 1, rows[7][1], 1), rows[8], rows[8]]
    junk = [(901, None, None), (902, [], None), (903, [None, *rows[0][1][1:]], None), (904, [math.nan, *rows[0][1][1:]], None), (905, [math.inf, *rows[0][1][1:]], None), (906, [1.0] * (size + 1), None)]
    df = frame(spark, rows + junk, VECTORS, ["x", "component", "n", "i", "row", "k"]).repartition(5)
    got = whitening.judge(df).collect()
    n, deviation, whitened, explained = plain(rows)
    many = whitened.shape[1]
    assert len(got) == len(rows) * many and {r.n for r in got} == {n}
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    made = {}
    for r in got:
        made.setdefault((r.vec_id, r.deviation), {})[r.component] = (r.whitened, r.explained)
    signs = np.sign([made[rows[0][0], int(deviation[0])][k + 1][0] / whitened[0, k] for k in range(many)])
    for row, d, w in zip(rows, deviation, whitened):
        parts = made[row[0], int(d)]
        assert sorted(parts) == list(range(1, many + 1))
        assert np.allclose([parts[k + 1][0] for k in range(many)], w * signs, rtol=0, atol=1e-8)
        assert np.allclose([parts[k + 1][1] for k in range(many)], explained, rtol=1e-9)


def test_whitening_does_not_depend_on_the_layout(spark):
    df = frame(spark, vectors(300, 8), VECTORS)
    models = [whitening.fit_whitening(whitening.quantised(whitening.usable(df.repartition(n)))) for n in (1, 6)]
    assert models[0].sums == models[1].sums and (models[0].values == models[1].values).all()
    assert (models[0].components == models[1].components).all()


def test_directions_without_variance(spark):
    rows = [(k, [float(k), 5.0, -float(k), 5.0], None) for k in range(9)]
    got = whitening.judge(frame(spark, rows, VECTORS))
    assert {(r.component, r.n, round(r.explained, 12)) for r in got.collect()} == {(1, 9, 1.0)}
    same = frame(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], VECTORS)
    assert whitening.judge(same).collect() == [] and whitening.judge(same.limit(0)).count() == 0
    assert whitening.judge(same).columns == got.columns


def test_huge_entries(spark):
    rows = [(1, [3e38, 0.0], None), (2, [-3e38, 1.0], None), (3, [0.5, 2.0], None)]
    got = whitening.judge(frame(spark, rows, VECTORS)).collect()
    assert all(math.isfinite(r.whitened) for r in got) and {r.deviation for r in got if r.vec_id == 1} == {None}


# -- manifest

MERKLE = "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"


def test_proofs_like_brute_force(spark):
    docs = cases.documents()
    df = frame(spark, docs, cases.DOCS, [*cases.CLASHING, "group", "digest", "rank", "members", "path", "leaf"]).repartition(4)
    got = rows_of(merkle.judge(df), *MERKLE)
    assert got == brute.merkle(docs)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 17, 300])
def test_proofs_of_any_number_of_leaves(spark, n):
    rng = random.Random(n)
    docs = [(rng.choice([None, *range(n)]), rng.choice(["", "x", None, "é"]), rng.choice([None, "en", "en", "en", "", "z"]), None, rng.choice([None, 3])) for _ in range(n)]
    assert rows_of(merkle.judge(frame(spark, docs, cases.DOCS)), *MERKLE) == brute.merkle(docs)


def test_only_every_few_levels_are_kept(spark):
    docs = [(k, f"text {k}", "en", None, 1) for k in range(300)]
    path = new_path(spark, "merkle")
    root = merkle.manifest(spark, merkle.document_leaves(frame(spark, docs, cases.DOCS)), path).first().root
    want = brute.merkle(docs)
    assert {r[3] for r in want} == {root}
    levels = merkle.kept_levels(spark.read.parquet(f"{path}/leaves"))
    assert levels == [0, 4, 8, 12]
    sizes = [merkle.read_level(spark, f"{path}/tree", level).count() for level in levels]
    assert sizes[:3] == [300, 19, 2] and sizes[3] == 1
    proofs = merkle.proofs(spark, path).collect()
    assert len(proofs) == 300 and all(len(r.path) == 9 for r in proofs)
    # a changed row, and a proof with one digest exchanged, do not lead to the root
    made = spark.createDataFrame(proofs[:5], merkle.proofs(spark, path).schema)
    bad = F.transform("path", lambda s, k: F.when(k == 3, s.withField("digest", F.unhex(F.lit("0" * 64)))).otherwise(s))
    both = made.select(merkle.folded(F.col("digest"), F.col("path")).alias("good"), merkle.folded(F.col("digest"), bad).alias("bad"))
    assert {r.good for r in both.collect()} == {root} and root not in {r.bad for r in both.collect()}
