"""One small test for each finding of the fourth round that was right."""

import random

import pytest
from pyspark.sql import functions as F

from plotwise.operators import relate


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(4))
def test_mutual_nearest_is_mutual_best_of_all_pairs(spark, seed):
    """with ties, nulls, ids that come more than once and keys that only one side has."""
    rng = random.Random(seed)
    some = lambda: None if rng.random() < (0.1, 0.0, 0.5, 0.1)[seed] else rng.randrange(-5, 5)
    times = (1, 1, 1, 3)[seed]
    side = lambda n, first: list(dict.fromkeys((k // times or first, rng.choice(["a", "b", "c"][: 2 + n % 2] + [None]), rng.randrange(3), some(), some()) for k in range(n)))
    left, right = side(60, 0), side(71, None)
    names = "string, w long, x long, y long"
    got = relate.mutual_nearest(spark.createDataFrame(left, f"l long, u {names}"), spark.createDataFrame(right, f"r long, u {names}"), ["u", "w"], "l", "r", ["x", "y"])
    gap = lambda a, b: None if None in (a, b) else abs(a - b)
    rank = lambda *values: tuple((v is None, v or 0) for v in values)
    pairs = {(a[0], b[0], gap(a[3], b[3]), gap(a[4], b[4])) for a in left for b in right if a[1] is not None and a[1:3] == b[1:3]}
    of_left, of_right = ({p[k]: min((q for q in pairs if q[k] == p[k]), key=lambda q: rank(q[2], q[3], q[1 - k])) for p in pairs} for k in (0, 1))
    want = {p for p in pairs if of_left[p[0]] == p == of_right[p[1]]}
    assert got.columns == ["l", "r", "d_x", "d_y"] and len(want) > 2
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_mutual_best_makes_no_pairs(spark, sf):
    """rows of equal keys aren't joined, and are dealt by them once."""
    from plotwise import plans

    plan = _plan(plans.QUERIES["w1_mutual_best"](spark, sf))
    assert "Join" not in plan and plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange") == 4


@pytest.mark.parametrize("most", [10_000, 2])
def test_equal_rows_meet_once_and_all_pairs_come(spark, monkeypatch, most):
    """with nulls in ids, differences and keys, and more equal rows than a list may hold."""
    left = [(k, "a", k % 2, 5) for k in range(9)] + [(20, None, 1, 1), (21, "b", None, 2), (22, "b", 3, 3), (22, "b", 3, 3)]
    right = [(k if k % 4 else None, "a", k % 3, None if k == 5 else 7) for k in range(12)] + [(30, None, 1, 1), (31, "b", 4, 1), (32, "c", 1, 1)]
    monkeypatch.setattr(relate, "GATHERED", most)
    kept, plain = [], relate.gathered
    monkeypatch.setattr(relate, "gathered", lambda *a: kept.append(plain(*a)) or kept[-1])
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, u string, x long, y long")
    got = relate.keyed_pairs(frame(left, "l"), frame(right, "r"), ["u"], "l", "r", ["x", "y"])
    gap = lambda a, b: None if None in (a, b) else abs(a - b)
    want = [(a[0], b[0], gap(a[2], b[2]), gap(a[3], b[3])) for a in left for b in right if a[1] == b[1] is not None]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert [df.where("u = 'a'").count() for df in kept] == ([2, 4] if most > 2 else [5, 7])


def test_files_of_pairs_are_small(spark, tmp_path):
    """of pairs of equal rows all columns but one stay the same from row to row."""
    from plotwise import plans

    n = 600
    spark.range(n).selectExpr("id * 15 AS o_orderkey", "id * 15 AS o_custkey", "'O' AS o_orderstatus", "1000.0D * pmod(hash(id), 40) AS o_totalprice", "timestamp'1995-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(n).selectExpr("id * 15 AS l_orderkey", "1.0D * pmod(hash(-id), 40) AS l_quantity", "777.0D * pmod(hash(-id), 40) AS l_extendedprice", "timestamp'1995-01-01' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    plans.QUERIES["j2_three_key_join"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").distinct().count() == n * n
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < n * n


@pytest.mark.parametrize("kind", ["date", "timestamp"])
def test_alike_sales_meet_once_and_all_pairs_come(spark, monkeypatch, kind):
    """sales of one day and price are one row until they met, also without an id."""
    rows = [(k if k % 50 else None, f"1995-01-{1 + k % 7 * 4:02d}", (10.0, 25.0, 29.5, 700.0)[k % 4]) for k in range(140)] + [(900, None, 10.0), (901, "1995-01-01", None), (902, "1995-01-01", float("nan"))]
    sales = spark.createDataFrame(rows, "obs_id long, purchase_date string, price double").withColumn("purchase_date", F.col("purchase_date").cast(kind))
    met, plain = [], relate.band_pairs
    monkeypatch.setattr(relate, "band_pairs", lambda df, *a, **k: met.append(df) or plain(df, *a, **k))
    got = relate.interval_choice_set(sales, window_days=5, value_band=5)
    assert {c: t for c, t in got.dtypes} == {"obs_main": "bigint", "obs_id": "bigint", "is_main": "boolean", "purchase_date": kind, "price": "double"}
    known = [(i, int(d[-2:]), p) for i, d, p in rows[:140]]
    want = [(a[0], b[0], None if None in (a[0], b[0]) else a[0] == b[0], b[1], b[2]) for a in known for b in known if abs(a[1] - b[1]) <= 5 and abs(a[2] - b[2]) < 5]
    assert sorted(map(str, ((r.obs_main, r.obs_id, r.is_main, r.purchase_date.day, r.price) for r in got.collect()))) == sorted(map(str, want))
    assert met[0].where("price < 1000 and day is not null").count() == 28
