"""Ranks, quantiles and gap tiers stay exact when groups are really cut into buckets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from periodica.functions import ordered
from periodica.functions.ordered import Rank, add_ranks, group_quantiles, spearman
from periodica.operators.rankings import gap_tiers


@pytest.fixture(params=[1, 23], ids=["one range", "many ranges"])
def cuts(request, monkeypatch):
    monkeypatch.setattr(ordered, "PARTS", request.param)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({
        "id": np.arange(n), "g": rng.choice(["a", "b", "hot"], n, p=[.2, .1, .7]),
        "v": np.where(rng.random(n) < 0.4, 0.0, rng.integers(0, 80, n) / 4.0),
        "w": rng.normal(size=n).round(2),
    })
    pdf.loc[rng.random(n) < 0.05, "v"] = np.nan
    return pdf


def frame(spark, pdf):
    rows = [tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r)
            for r in pdf.itertuples(index=False)]
    return spark.createDataFrame([(int(a), b, c, float(d)) for a, b, c, d in rows],
                                 "id bigint, g string, v double, w double")


def test_ranks(spark, data, cuts):
    got = add_ranks(frame(spark, data), ["id"], [
        Rank("mn", "v", ("g",)), Rank("av", "v", ("g",), "average", False), Rank("pc", "v", ("g",), "pct", False),
        Rank("fr", "v", ("g",), "first")]).toPandas().sort_values("id").reset_index(drop=True)
    g = data.groupby("g")["v"]
    for col, want in (("mn", g.rank(ascending=False, method="min")), ("av", g.rank()), ("pc", g.rank(pct=True)),
                      ("fr", g.rank(ascending=False, method="first"))):
        np.testing.assert_allclose(got[col].astype(float), want, err_msg=col)


def test_rank_of_one_value(spark, monkeypatch):
    """A value shared by all rows of a group is cut by id, and its places are shared all the same."""
    monkeypatch.setattr(ordered, "PARTS", 9)
    df = spark.range(900).selectExpr("id", "id % 2 AS g", "if(id < 890, 5.0, double(id)) AS v", "cast(null AS string) AS k")
    got = add_ranks(df, ["id"], [Rank("mn", "v", ("g",)), Rank("av", "v", ("g", "k"), "average", False),
                                 Rank("pc", "v", (), "pct", False), Rank("fr", "v", (), "first", False)]).toPandas()
    pdf = df.toPandas()
    by = pdf.groupby("g")["v"]
    for col, want in (("mn", by.rank(ascending=False, method="min")), ("av", by.rank()), ("pc", pdf["v"].rank(pct=True)),
                      ("fr", pdf["v"].rank(method="first"))):
        np.testing.assert_allclose(got.sort_values("id")[col].astype(float), want, err_msg=col)


def test_quantiles(spark, data, cuts):
    got = group_quantiles(frame(spark, data), ["g"], "v", {"a": 0.1, "m": 0.5, "z": 1.0}).toPandas().set_index("g")
    want = data.groupby("g")["v"].quantile([0.1, 0.5, 1.0]).unstack()
    np.testing.assert_allclose(got.loc[want.index, ["a", "m", "z"]].to_numpy(), want.to_numpy())


def test_spearman(spark, data, cuts):
    got = spearman(frame(spark, data), ["id"], ["g"], "v", "w").toPandas().set_index("g")["spearman_r"]
    for g, part in data.dropna().groupby("g"):
        assert got[g] == pytest.approx(part["v"].rank().corr(part["w"].rank()), abs=1e-12)


def test_spearman_constant_is_null(spark):
    df = spark.createDataFrame([(i, 1.0, float(i)) for i in range(5)], "id int, v double, w double").selectExpr("*", "'x' AS g")
    assert spearman(df, ["id"], ["g"], "v", "w").first()["spearman_r"] is None


def test_gap_tiers(spark, data, cuts, monkeypatch):
    got = gap_tiers(frame(spark, data), ["g"], "v", 0.5, ["id"]).toPandas().sort_values("id").reset_index(drop=True)
    want = pd.Series(np.nan, index=data.index)
    for _, part in data.dropna().groupby("g"):
        ordered_v = part["v"].sort_values(ascending=False)
        want[ordered_v.index] = 1 + (ordered_v.shift() - ordered_v >= 0.5).cumsum()
    np.testing.assert_allclose(got["tier"].astype(float), want)


def test_gap_tiers_fixture(spark):
    df = spark.createDataFrame([(i, "x", v) for i, v in enumerate([20.0, 19.8, 19.7, 12.0, 11.9])], "id int, g string, v double")
    tiers = gap_tiers(df, ["g"], "v", 1.5, ["id"]).orderBy("id").collect()
    assert [r["tier"] for r in tiers] == [1, 1, 1, 2, 2]


def test_top_rows_beyond_the_map_side_cut(spark, cuts):
    """A top n above Spark's cut gives the rows of the plain window, ties, nulls and NaN included."""
    df = spark.range(6000).selectExpr("id", "id % 2 AS season", "if(id % 97 = 0, null, if(id = 5, double('NaN'), "
                                      "double(pmod(xxhash64(id), 700)))) AS value")
    plain = Window.partitionBy("season").orderBy(F.col("value").desc_nulls_last(), "id")
    for n in (1500, 2990):
        want = df.withColumn("row_rank", F.row_number().over(plain)).where(F.col("row_rank") <= n)
        got = ordered.top_rows(df, ["season"], "value", n, ["id"])
        assert got.columns == want.columns
        key = ["season", "row_rank", "id"]
        assert got.select(key).orderBy(key).collect() == want.select(key).orderBy(key).collect()


def test_ranks_hold_no_whole_range(spark, data, monkeypatch):
    """One range, counted some rows at a time: groups, values and single rows cross the cuts."""
    monkeypatch.setattr(ordered, "PARTS", 1)
    monkeypatch.setattr(ordered, "CHUNK", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = add_ranks(frame(spark, data), ["id"], [
            Rank("mn", "v", ("g",)), Rank("av", "v", ("g",), "average", False), Rank("pc", "v", (), "pct", False),
            Rank("fr", "v", ("g",), "first")]).toPandas().sort_values("id").reset_index(drop=True)
        long, keys = ordered._long(frame(spark, data), ["id"], [Rank("mn", "v", ("g",))])
        sizes = [r["count"] for r in ordered._placed(long, ["id"], keys).groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(sizes) > 50 and max(sizes) <= 7 + 5
    g, v = data.groupby("g")["v"], data["v"]
    for col, want in (("mn", g.rank(ascending=False, method="min")), ("av", g.rank()), ("pc", v.rank(pct=True)),
                      ("fr", g.rank(ascending=False, method="first"))):
        np.testing.assert_allclose(got[col].astype(float), want, err_msg=col)
