import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallystone.operators import ordered
from tallystone.operators.skew import hot_hashes, salted_join


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most of the rows, one has a single row, one key is NULL."""
    rng = np.random.default_rng(3)
    n = 3000
    group = np.where(rng.random(n) < 0.6, "big", np.array([f"g{i}" for i in rng.integers(0, 40, n)]))
    pdf = pd.DataFrame({"g": group, "k": np.arange(n), "o": rng.integers(0, 9, n), "v": rng.integers(-50, 50, n)})
    rows = [(g, int(k), int(o), None if v % 4 == 0 else int(v)) for g, k, o, v in pdf.itertuples(index=False)]
    rows += [("solo", 10_000, 1, 7), (None, 10_001, 1, 3), (None, 10_002, 0, None), ("empty", 10_003, 2, None)]
    return spark.createDataFrame(rows, "g string, k long, o long, v long"), rows


def by_group(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_row_numbers_and_running_sums(spark, skewed):
    df, rows = skewed
    order = [F.col("o").asc(), F.col("k").asc()]
    got = ordered.running(df, ["g"], order, number="n", sums={"s": F.col("v")}, fills={"f": F.col("v")})
    have = {r.k: (r.n, r.s, r.f) for r in got.collect()}
    assert len(have) == len(rows)
    for members in by_group(rows).values():
        total, known = None, None
        for i, (_, k, _, v) in enumerate(members, 1):
            if v is not None:
                total, known = (total or 0) + v, v
            assert have[k] == (i, total, known)


def test_global_numbers_without_group(spark, skewed):
    df, rows = skewed
    got = ordered.number_rows(df, [F.col("o").desc(), F.col("k").asc()], "n").collect()
    want = sorted(rows, key=lambda r: (-r[2], r[1]))
    assert [r.k for r in sorted(got, key=lambda r: r.n)] == [r[1] for r in want]


def test_forward_fill_keeps_leading_nulls(spark):
    df = spark.createDataFrame([(i, "x" if i == 5 else None) for i in range(20)], "k int, v string")
    got = {r.k: r.f for r in ordered.forward_fill(df, [], [F.col("k").asc()], {"f": F.col("v")}).collect()}
    assert got == {i: ("x" if i >= 5 else None) for i in range(20)}


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, k long, v long")
    assert ordered.running(df, ["g"], [F.col("k").asc()], number="n", sums={"s": F.col("v")}).count() == 0


def test_quantiles_match_numpy(spark, skewed):
    df, rows = skewed
    got = {r.g: r for r in ordered.quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()}
    for g, members in by_group(rows).items():
        vals = [r[3] for r in members if r[3] is not None]
        if not vals:
            assert g not in got
            continue
        want = np.quantile(vals, [0.25, 0.5, 0.75])
        assert got[g].n_values == len(vals)
        assert np.allclose([got[g].q1, got[g].q2, got[g].q3], want)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, skewed, how):
    df, rows = skewed
    right = spark.createDataFrame([("big", 1), ("big", 2), ("g3", 3), (None, 4)], "g string, w int")
    assert hot_hashes(df, ["g"])
    got = salted_join(df, right, ["g"], ["k"], how, always=True)
    want = df.join(right, ["g"], how)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_salted_join_spreads_the_hot_key(spark, skewed):
    df, _ = skewed
    right = spark.createDataFrame([("big", 1)], "g string, w int")
    plan = salted_join(df, right, ["g"], ["k"], always=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "sequence" in plan
