"""Hand-computed values: schema, point-in-time features, form, bands, models."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica.functions.stats import T_TABLE, normal_crps
from periodica.models import closed, pooled, ridge
from periodica.operators import leagues as lg
from periodica.operators import panel as p
from periodica.operators import tiers as t
from periodica.operators import weekly as w
from periodica.settings import FOOTBALL, Settings
from periodica.sources import export, scans, schema


def panel(spark, season=2024, **extra):
    cols = {"entity": "p1", "season": season, "entity_name": "One", "grp": "WR", "team": "A", **extra}
    return spark.createDataFrame([tuple(cols.values())], list(cols)).withColumn("season", F.col("season").cast("int"))


def test_standardize(spark):
    raw = spark.createDataFrame([("x", "low", "High", "QB", 2024, 1.0, 2.0, "keep")],
                                ["player_id", "player_name", "player_display_name", "position", "season",
                                 "fantasy_points", "fantasy_points_ppr", "other"])
    out = schema.standardize(raw)
    assert out.columns.count("entity_name") == 1 and out.first()["entity_name"] == "High"
    assert "other" in out.columns and "player_name" not in out.columns
    with pytest.raises(KeyError):
        schema.standardize(spark.createDataFrame([(1, "A")], ["week", "team"]))
    assert schema.coerce_numeric(out).first()["carries"] == 0.0
    with pytest.raises(ValueError):
        scans.load_season_totals(out, "spring")


def test_table_ready(spark):
    rows = export.table_ready(spark.createDataFrame([("=cmd()",), ("Normal Name",), (None,)], ["entity_name"])).collect()
    assert [r["Name"] for r in rows] == ["'=cmd()", "Normal Name", ""]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.234), ("b", None)], "entity_name string, ppg double")
    out = export.export_boards({"top n": df, "skip": df}, str(tmp_path), only=["top n"])
    (path, count), = out.items()
    assert count == 2 and path.endswith("top_n")
    back = spark.read.csv(path, header=True).orderBy("Name").collect()
    assert back[0]["PPG"] == "1.23" and back[1]["PPG"] is None


def test_exports_count_what_they_write(spark, tmp_path):
    """Rows are counted on their way; panels open by season, leagues lie in a folder each."""
    seasons = spark.range(10).selectExpr("id AS entity", "cast(2000 + id % 3 AS int) AS season", "id * 1.5D AS value")
    boards = {"Overall": seasons, "RB top": seasons.where("season = 2001")}
    assert sorted(export.export_boards(boards, f"{tmp_path}/all", whole=("Overall",)).values()) == [3, 10]
    listed = {r["board"]: r["rows"] for r in spark.read.json(f"{tmp_path}/all/_manifest").collect()}
    assert listed == {"overall": 10, "rb_top": 3}
    for name, rows in listed.items():
        assert spark.read.csv(f"{tmp_path}/all/{name}", header=True).count() == rows
    assert export.write_panel(seasons, f"{tmp_path}/panel") == 10
    back = spark.read.parquet(f"{tmp_path}/panel").where("season = 2001")
    assert back.count() == 3 and all("season=2001" in f for f in back.select("_metadata.file_path").distinct().toPandas().iloc[:, 0])
    leagues = spark.createDataFrame([("one", "QB", "Ann, A."), ("one", "RB", None), ("two", "QB", "Bo")],
                                    "slug string, slot string, entity_name string")
    assert export.write_by_slug(leagues, f"{tmp_path}/leagues") == 3
    one = spark.read.csv(f"{tmp_path}/leagues/slug=one", header=True).orderBy("slot").collect()
    assert [tuple(r) for r in one] == [("QB", "Ann, A."), ("RB", None)]


def test_readers(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(str(tmp_path / "x.parquet"))
    spark.createDataFrame([(1, 3)], "a int, c int").write.parquet(str(tmp_path / "y.parquet"))
    both = scans.read_any(spark, [str(tmp_path / "x.parquet"), str(tmp_path / "y.parquet")])
    assert sorted(both.columns) == ["a", "b", "c"] and both.count() == 2
    (tmp_path / "z.csv").write_text("a,b\n1,2\n")
    (tmp_path / "z.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert scans.read_any(spark, str(tmp_path / "z.csv"), "a int, b int").first()["b"] == 2
    assert scans.read_any(spark, str(tmp_path / "z.json")).count() == 2


def test_missing_indicators(spark):
    df = spark.createDataFrame([(180.0, None, None)], "value_lag1 double, value_lag2 double, value_lag3 double")
    r = p.missing_indicators(df).first()
    assert (r["lag1_missing"], r["lag2_missing"], r["lag3_missing"]) == (0, 1, 1)


def test_snap_features(spark):
    s = spark.createDataFrame([("p1", 2023, 1, .4), ("p1", 2023, 10, .8), ("p1", 2024, 1, 1.0), ("p1", 2024, 2, 1.0)],
                              "player_id string, season int, period int, offense_pct double")
    r = t.snap_features(panel(spark), s).first()
    assert r["snap_share_lag1"] == pytest.approx(.6) and r["periods_above_75"] == 1
    assert r["snap_share_trend"] == pytest.approx(.4)


def test_depth_position_cutoff(spark):
    d = spark.createDataFrame([("p1", 2024, "2024-07-15", 2), ("p1", 2024, "2024-10-01", 1)],
                              "player_id string, season int, date string, depth_team int")
    assert t.depth_position(panel(spark), d).first()["depth_position"] == 2
    on_day = spark.createDataFrame([("p1", 2024, "2024-08-01", 3)], d.schema)
    assert t.depth_position(panel(spark), d.unionByName(on_day)).first()["depth_position"] == 3


def test_event_shares(spark):
    plays = spark.createDataFrame([("p1", None, 2023, "A", 100.0, 10), ("p2", None, 2023, "A", 100.0, 40),
                                   ("p1", None, 2024, "A", 9999.0, 5)],
                                  "receiver_id string, rusher_id string, season int, team string, air_yards double, yardline_100 int")
    r = t.event_share_features(panel(spark), plays).first()
    assert r["air_yards_share"] == .5 and r["rz_target_share"] == 1.0


def test_tracking_and_participation(spark):
    s = spark.createDataFrame([("p1", 2023, 3.1, .7), ("p1", 2024, 99.0, 1.0)],
                              "player_id string, season int, avg_separation double, participation double")
    r = t.participation_features(t.tracking_features(panel(spark), [s]), s).first()
    assert r["separation_avg"] == 3.1 and r["participation_rate"] == .7
    assert t.participation_features(panel(spark), s.drop("participation")).columns == panel(spark).columns


def test_injuries(spark):
    s = spark.createDataFrame([("p1", 2023, "2023-10-01", "Out"), ("p1", 2024, "2024-07-01", "Out")],
                              "player_id string, season int, report_date string, report_status string")
    assert t.injury_features(panel(spark), s).first()["games_missed_lag1"] == 1
    late = spark.createDataFrame([("p1", 2023, "2024-08-01", "Out")], s.schema)
    assert t.injury_features(panel(spark), late).first()["games_missed_lag1"] is None


def test_contracts(spark):
    s = spark.createDataFrame([("p1", "2024-03-01", 10.0, 2026), ("p1", "2024-10-01", 100.0, 2028)],
                              "player_id string, signed_date string, guaranteed double, end_year int")
    r = t.contract_features(panel(spark), s).first()
    assert r["contract_guaranteed"] == 10.0 and r["contract_years_left"] == 2
    assert t.contract_features(panel(spark), s.drop("signed_date")).columns == panel(spark).columns


def test_contract_end_as_date_text_or_year(spark):
    for kind, end in (("date", "DATE'2026-03-01'"), ("timestamp", "TIMESTAMP'2026-03-01 00:00:00'"),
                      ("text", "'2026-03-01'"), ("year as text", "'2026'"), ("year", "2026"), ("real", "2026.0D")):
        s = spark.sql(f"SELECT 'p1' AS player_id, '2023-05-01' AS signed_date, 10.0D AS guaranteed, {end} AS contract_end")
        assert t.contract_features(panel(spark), s).first()["contract_years_left"] == 2, kind


def test_dates_under_other_names(spark):
    d = spark.createDataFrame([("p1", 2024, "2024-07-15", 2, "A"), ("p1", 2024, "2024-10-01", 1, "B")],
                              "player_id string, season int, date string, depth_team int, team string")
    for name in ("dt", "timestamp", "as_of"):
        assert t.depth_position(panel(spark), d.withColumnRenamed("date", name)).first()["depth_position"] == 2
        assert "changed_team" in t.situation_features(panel(spark), d.withColumnRenamed("date", name)).columns
    assert t.depth_position(panel(spark), d.drop("date")).columns == panel(spark).columns
    assert t.situation_features(panel(spark), d.drop("date")).columns == panel(spark).columns


def test_folds_with_many_periods(spark):
    """Period 366 of one season and period 66 of the third after it are different folds."""
    from periodica.plans.weekly import fold_key

    rows = spark.createDataFrame([(2020, 366), (2023, 66), (2021, 1), (2020, 1)], "season int, period int")
    order = [tuple(r) for r in rows.orderBy(fold_key()).collect()]
    assert order == sorted(order) and rows.select(fold_key()).distinct().count() == 4


def test_values_of_any_size_stay(spark):
    h = spark.createDataFrame([("One", 1990, "WR", 900.0, 16.0)], "entity_name string, season int, grp string, value double, games double")
    recent = h.where("season > 2000")
    assert scans.historical_union(h, recent).count() == 1
    assert scans.historical_union(h, recent, value_below=502.0).count() == 0


def test_consensus_rank_single_pool(spark):
    s = spark.createDataFrame([("One Jr.", "WR", "2024-08-01", 2.0, "redraft-overall"), ("One Jr.", "WR", "2024-07-01", 9.0, "redraft-overall"),
                               ("Idp", "LB", "2024-08-01", 1.0, "redraft-idp"), ("Other", "WR", "2024-08-01", 5.0, "redraft-overall"),
                               ("Late", "WR", "2024-09-11", 1.0, "redraft-overall")],
                              "player string, pos string, scrape_date string, ecr double, page_type string")
    r = t.consensus_rank(panel(spark), s).collect()
    assert len(r) == 1 and r[0]["consensus_rank"] == 1


def test_lag_panel_is_point_in_time(spark):
    rows = [(e, s, "n", "WR", "A", float(e * 10 + s % 7), 1.0, 10) for e in range(6) for s in range(2018, 2024)]
    cols = "entity int, season int, entity_name string, grp string, team string, value double, value_base double, games int"
    a = p.lag_panel(spark.createDataFrame(rows, cols), FOOTBALL)
    changed = [r[:5] + (r[5] + 1000,) + r[6:] if r[1] >= 2022 else r for r in rows]
    b = p.lag_panel(spark.createDataFrame(changed, cols), FOOTBALL)
    old = lambda d: sorted(map(tuple, d.where("season < 2022").collect()))
    assert old(a) == old(b)
    assert a.where("season = 2018").count() == 0
    f = p.forecast_rows(spark.createDataFrame(rows, cols), 2024, FOOTBALL).where("entity = 1").first()
    assert f["career_season"] == 6 and f["value_lag1"] == 10 + 2023 % 7 and f["grp_code"] == 2


def log(spark, values, grp="WR"):
    return spark.createDataFrame([(1, "n", grp, "A", "B", 2024, i + 1, float(v)) for i, v in enumerate(values)],
                                 "entity int, entity_name string, grp string, team string, opponent string, season int, period int, value double")


def test_matchup_is_true_prior_mean(spark):
    got = [r["opp_allowed_avg"] for r in w.matchup_table(log(spark, [10, 20, 30, 40])).orderBy("period").collect()]
    assert got == [None, 10, 15, 20]


def test_windows_see_the_first_game(spark):
    rows = w.weekly_panel(log(spark, [30, 10, 20]), FOOTBALL).orderBy("period").collect()
    assert [r["period"] for r in rows] == [2, 3]
    assert rows[0]["std5"] == 0 and rows[0]["boom_rate5"] == 1.0
    assert rows[1]["std5"] == pytest.approx(np.std([30, 10], ddof=1)) and rows[1]["ma5"] == 20


def test_variance_snapshot(spark):
    r = w.variance_snapshot(log(spark, [5, 30, 2, 28, 4]), 2024, 6, FOOTBALL).first()
    assert r["std5"] == pytest.approx(np.std([5, 30, 2, 28, 4], ddof=1))
    assert r["boom_rate5"] == pytest.approx(.4) and r["bust_rate5"] == pytest.approx(.6)
    assert w.variance_snapshot(log(spark, [5]), 2024, 1, FOOTBALL).count() == 0


def test_regression_to_mean_anchor(spark):
    rows = [(i, 2020, x, y, 2) for i, (x, y) in enumerate([(100., 80.), (200., 130.), (300., 180.)])]
    df = spark.createDataFrame([*rows, (9, 2021, 200., 0., 2)],
                               "entity int, season int, value_lag1 double, target double, grp_code int")
    got = closed.forecasts(df, ("regression_to_mean",)).where("season = 2021").first()["f_regression_to_mean"]
    assert got == pytest.approx(130)


def test_ridge_equals_closed_form_per_fold(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(2018, 2023):
        for e in range(30):
            x = rng.normal(size=3) * [1, 5, 20]
            rows.append((e, s, *map(float, x), int(e % 3), float(50 + x @ [2, 1, .3] + rng.normal())))
    df = spark.createDataFrame(rows, "entity int, season int, a double, b double, c double, grp_code int, target double")
    x, names = ridge.design(df, ["a", "b", "c"], [0, 1, 2])
    fits = ridge.fold_fits(ridge.moments(x, "season"), 10.0)
    assert names[-1] == "grp_code_2" and 2018 not in fits
    arr = np.array(rows, dtype=float)
    for fold, fit in fits.items():
        tr = arr[arr[:, 1] < fold]
        m = np.column_stack([tr[:, 2:5], tr[:, 5] == 1, tr[:, 5] == 2]).astype(float)
        z = (m - m.mean(0)) / m.std(0)
        beta = np.linalg.solve(z.T @ z + 10 * np.eye(5), z.T @ (tr[:, 6] - tr[:, 6].mean()))
        np.testing.assert_allclose(fit["beta"], beta, rtol=1e-8)


def test_partial_pooling_shrinks(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g, n in ((0, 200), (1, 200), (2, 4)):
        lag = rng.uniform(50, 250, n)
        rows += [(g, float(v), float(v / 16), float(40 + 20 * g + .7 * v + rng.normal(0, 20))) for v in lag]
    df = spark.createDataFrame(rows, "grp_code int, value_lag1 double, ppg_lag1 double, target double")
    fit = pooled.fit(pooled.group_sums(df))
    assert fit["sigma"] == pytest.approx(20, rel=.15)
    assert all(.5 < b < .9 for b in fit["beta"]) and fit["alpha"][0] < fit["alpha"][1]


def test_crps_and_t_table(spark):
    df = spark.createDataFrame([(10.0, 12.0, 20.0), (1.0, 1.0, None)], "a double, m double, s double")
    got = [r[0] for r in df.select(normal_crps("a", "m", "s")).collect()]
    z = -0.1
    want = 20 * (z * math.erf(z / math.sqrt(2)) + 2 * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))
    assert got[0] == pytest.approx(want) and (got[1] is None or math.isnan(got[1]))
    assert T_TABLE[0] == pytest.approx(12.7062, abs=1e-4) and T_TABLE[9] == pytest.approx(2.228139, abs=1e-6)
    assert T_TABLE[29] == pytest.approx(2.042272, abs=1e-6)


def lineup(spark, players, slots):
    c = spark.createDataFrame([("L", f"{g}{i}", g, float(s)) for i, (g, s) in enumerate(players)],
                              "league_id string, foreign_id string, grp string, proj_points double")
    return lg.best_lineup(c, spark.createDataFrame([("L", slots)], "league_id string, slots array<string>")).collect()


def test_lineup_fixtures(spark):
    rows = lineup(spark, [("RB", 20), ("RB", 15), ("RB", 10), ("WR", 12), ("WR", 8)], ["RB", "RB", "WR", "WR", "FLEX"])
    assert sum(r["proj_points"] for r in rows) == 65 and not [r for r in rows if r["status"] != "starter"]
    assert {r["slot"]: r["foreign_id"] for r in rows}["FLEX"] == "RB2"
    rows = lineup(spark, [("QB", 20)], ["QB", "TE"])
    assert {(r["slot"], r["status"]) for r in rows} == {("QB", "starter"), ("TE", "empty")}
    rows = lineup(spark, [("QB", 99), ("RB", 5)], ["RB"])
    assert {(r["foreign_id"], r["status"]) for r in rows} == {("RB1", "starter"), ("QB0", "bench")}


def test_lineup_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    slots = ["QB", "RB", "WR", "WRRB_FLEX", "WRTE_FLEX", "SUPER_FLEX"]
    players, leagues = [], []
    for k in range(25):
        leagues.append((f"L{k}", slots))
        for i in range(int(rng.integers(3, 8))):
            players.append((f"L{k}", f"p{i}", str(rng.choice(["QB", "RB", "WR", "TE"])), float(rng.integers(-3, 30))))
    c = spark.createDataFrame(players, "league_id string, foreign_id string, grp string, proj_points double")
    got = lg.best_lineup(c, spark.createDataFrame(leagues, "league_id string, slots array<string>"))
    got = {r[0]: (r[1], r[2]) for r in got.where("status = 'starter'").groupBy("league_id").agg(
        F.count("*"), F.sum("proj_points")).collect()}

    def best(pool, left):
        if not left:
            return (0, 0.0)
        options = [best(pool, left[1:])]
        for i, (g, s) in enumerate(pool):
            if g in lg.accepts(left[0]):
                n, v = best(pool[:i] + pool[i + 1:], left[1:])
                options.append((n + 1, v + s))
        return max(options)

    for k in range(25):
        pool = [(g, s) for lid, _, g, s in players if lid == f"L{k}"]
        assert got[f"L{k}"] == pytest.approx(best(pool, slots)), k


def test_scoring_adjust(spark):
    df = spark.createDataFrame([(10.0, 5.0, 15.0, 4.0, .5), (10.0, 5.0, 15.0, 4.0, 1.0), (1.0, 0.0, 2.0, 9.0, 0.0)],
                               "proj_points double, floor double, ceiling double, receptions_ma3 double, rec double")
    got = [tuple(r)[:3] for r in lg.scoring_adjust(df).collect()]
    assert got == [(8, 3, 13), (10, 5, 15), (0, 0, 0)]


def test_rosters_from_json(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"league_id":"L1","roster_id":1,"owner_id":"111","players":["1001","2001"],"starters":["1001"],"reserve":[],"taxi":["2001"]}\n'
        '{"league_id":"L2","roster_id":2,"owner_id":"111","players":[],"starters":[],"reserve":[],"taxi":[]}\n')
    arr = "array<string>"
    rosters = scans.read_any(spark, str(tmp_path / "r.json"),
                             f"league_id string, roster_id int, owner_id string, players {arr}, starters {arr}, reserve {arr}, taxi {arr}")
    leagues = spark.createDataFrame([("L1", "One", ["QB", "K", "BN"], {"rec": .5}), ("L2", "Two", ["QB"], {})],
                                    f"league_id string, name string, roster_positions {arr}, scoring_settings map<string,double>")
    users = spark.createDataFrame([("L1", "111", "T", ("The Testers",))],
                                  "league_id string, user_id string, display_name string, metadata struct<team_name:string>")
    players = spark.createDataFrame([("1001", "raw", "QB", "AAA"), ("2001", "Kicker One", "K", "HHH")],
                                    "foreign_id string, full_name string, position string, team string")
    cross = spark.createDataFrame([("00-1001", "1001", "QB One", "QB", "AAA")],
                                  "entity string, foreign_id string, name string, grp string, team string")
    rows = {r["foreign_id"]: r for r in lg.league_rosters(leagues, rosters, users, players, cross, "111").collect()}
    assert rows["1001"]["entity_name"] == "QB One" and rows["1001"]["is_starter"] and rows["1001"]["slots"] == ["QB", "K"]
    assert rows["2001"]["entity_name"] == "Kicker One" and rows["2001"]["entity"] is None and rows["2001"]["is_taxi"]
    assert rows[None]["league_id"] == "L2" and rows[None]["rec"] == 1.0 and rows["1001"]["team_name"] == "The Testers"


def test_registry():
    assert [p.tier_first_season(k) for k in range(5)] == [1999, 2021, 2021, 2021, 2022]
    assert len(p.REGISTRY) == 63 and Settings().min_games == 4


def test_evaluate_with_learned_models(spark):
    """Trees and pooling run per fold beside the closed forms, and pooling carries its spread."""
    from periodica.operators.scoring import score_predictions
    from periodica.plans.backtest import walk_forward_evaluate

    rng = np.random.default_rng(7)
    rows = []
    for e in range(48):
        lag = float(rng.uniform(20, 250))
        for s in range(2018, 2023):
            target = max(0.0, 0.7 * lag + float(rng.normal(0, 35)))
            rows.append((e, s, "n", "WR" if e % 2 else "RB", 2 - e % 2, lag, lag / 16, target))
            lag = target
    df = spark.createDataFrame(rows, "entity int, season int, entity_name string, grp string, grp_code int, "
                                     "value_lag1 double, ppg_lag1 double, target double")
    out = walk_forward_evaluate(df, models=("random_walk", "ridge", "trees", "partial_pooling"), codes=[1, 2], tree_rounds=5).cache()
    assert {r[0] for r in out.select("model").distinct().collect()} == {"random_walk", "ridge", "trees", "partial_pooling"}
    assert sorted(r[0] for r in out.select("eval_season").distinct().collect()) == [2021, 2022]
    assert out.groupBy("model").count().where("count <> 96").count() == 0
    scores = {(r["model"], r["eval_season"]): r for r in score_predictions(out).collect()}
    assert scores["partial_pooling", 2022]["crps"] > 0 and scores["random_walk", 2022]["crps"] is None
    mae = {m: np.mean([r["mae"] for (k, _), r in scores.items() if k == m]) for m, _ in scores}
    assert mae["ridge"] < mae["random_walk"] and mae["partial_pooling"] < mae["random_walk"]


def test_shuffled_target_has_no_skill(spark):
    from periodica.plans.backtest import shuffled_target_r2

    rng = np.random.default_rng(2)
    rows = [(e, s, 0, float(rng.normal()), float(rng.normal())) for e in range(80) for s in range(2018, 2022)]
    df = spark.createDataFrame([(e, s, c, a, 10 * a + b) for e, s, c, a, b in rows],
                               "entity int, season int, grp_code int, a double, target double")
    assert shuffled_target_r2(df, ["a"], [0], 2021, repeats=2) < 0.1


def test_dealt_targets_travel_without_features(spark):
    from periodica.operators.scoring import dealt_targets, permutations

    rng = np.random.default_rng(6)
    rows = [(f"e{i}", 2020, float(i) if i % 9 else None, [float(v) for v in rng.normal(size=2)]) for i in range(50)]
    df = spark.createDataFrame(rows, "entity string, season int, target double, x array<double>")
    dealt = dealt_targets(df, 4, 42)
    got = dealt.collect()
    assert len(got) == 50
    for k in range(4):
        assert sorted((r["_dealt"][k] for r in got), key=str) == sorted((r[2] for r in rows), key=str)
    assert len({tuple(r["_dealt"]) for r in got}) > 40
    # as each deal on its own: row number i gets the target of number a * i + b
    number = {e: i for i, (e,) in enumerate(df.orderBy(F.xxhash64("entity", "season", F.lit(42)).cast("double").desc()).select(
        "entity").collect())}
    target = {number[e]: y for e, _, y, _ in rows}
    by_x = {tuple(x): number[e] for e, _, _, x in rows}
    maps = permutations(50, 4, 42)
    assert all(r["_dealt"][k] == target[(a * by_x[tuple(r["x"])] + b) % 50] for r in got for k, a, b in maps)
    many = ridge.dealt_moments(dealt)
    for k in range(4):
        one = ridge.moments(dealt.select("x", F.lit(0).alias("f"), F.col("_dealt")[k].alias("y")), "f", "y")[0]
        np.testing.assert_allclose(many[k], one)


def _ablation_panel(spark):
    rng = np.random.default_rng(11)
    rows = []
    for e in range(40):
        lag = float(rng.uniform(20, 250))
        for s in range(2016, 2022):
            target = max(0.0, 0.7 * lag + float(rng.normal(0, 35)))
            grp = (None, "WR", "RB", "TE")[e % 4] if e < 4 else ("WR", "RB", "TE")[e % 3]
            rows.append((e, s, "n", grp, e % 3, lag, lag / 16, float(rng.normal()), target))
            lag = target
    return spark.createDataFrame(rows, "entity int, season int, entity_name string, grp string, grp_code int, "
                                       "value_lag1 double, ppg_lag1 double, exp_ppg double, target double").selectExpr(
        "*", "value_lag1 AS value_lag2", "value_lag1 AS value_lag3")


def test_ablation_writes_no_copies_of_the_panel(spark):
    """Tiers read the one staged panel; what they write has no features, and the rows are those of each tier alone."""
    from periodica.functions.records import stage, staged_tables
    from periodica.plans.backtest import run_ablation, walk_forward_evaluate

    def first(tier):
        return 2016 + tier

    panel = stage(_ablation_panel(spark))
    before = set(staged_tables(spark))
    raw, scores = run_ablation(panel, (0, 1, 2), 3, first, codes=[0, 1, 2])
    written = [t for t in staged_tables(spark) if t not in before]
    assert written and not any("exp_ppg" in spark.read.parquet(t).columns for t in written)
    cols = ["model", "max_tier", "eval_season", "entity", "grp", "actual", "predicted", "abs_error", "lag1_abs_error"]

    def rows_of(df):
        return sorted(map(tuple, df.select(cols).collect()), key=str)

    want = []
    for tier in (0, 1, 2):
        cut = panel.where(F.col("season") >= first(tier))
        want += rows_of(walk_forward_evaluate(cut, tier, None, 3, codes=[0, 1, 2]))
        if tier:
            control = walk_forward_evaluate(cut, 0, None, 3, ("ridge",), [0, 1, 2])
            want += rows_of(control.withColumns({"model": F.lit("ridge_tier0_control"), "max_tier": F.lit(tier)}))
    got, want = rows_of(raw), sorted(want, key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want] and len(got) == 40 * (5 * 3 + 6 * 2 + 6)
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want])
    assert scores.count() == 5 * 3 + 6 * 2 + 6


def test_scores_rank_in_batches(spark, monkeypatch):
    """However few rows are ranked at a time, scores are the same, and what a batch wrote is removed."""
    from periodica.functions.records import staged_tables
    from periodica.operators import scoring
    from periodica.plans.backtest import walk_forward_evaluate

    out = walk_forward_evaluate(_ablation_panel(spark), models=("random_walk", "group_mean", "ridge"), codes=[0, 1, 2])

    def scored():
        before = len(staged_tables(spark))
        rows = sorted(map(tuple, scoring.score_predictions(out).select(
            "model", "eval_season", "mae", "rmse", "spearman_within_group", "top_precision", "vor_weighted_mae").collect()))
        return rows, len(staged_tables(spark)) - before

    whole, tables = scored()
    batches = []
    rank = scoring.spearman
    monkeypatch.setattr(scoring, "spearman", lambda df, *more: batches.append(df.count()) or rank(df, *more))
    monkeypatch.setattr(scoring, "RANKED", 90)
    few, more = scored()
    assert batches == [80, 80, 80, 80, 40] and more == tables + len(batches) - 1
    assert [r[:2] for r in few] == [r[:2] for r in whole]
    np.testing.assert_allclose([r[2:] for r in few], [r[2:] for r in whole])
    pdf = out.where("model = 'ridge' AND eval_season = 2021 AND grp IS NOT NULL").toPandas()
    want = np.mean([g.actual.rank().corr(g.predicted.rank()) for _, g in pdf.groupby("grp")])
    ridge_2021 = [r for r in scoring.score_predictions(out.where("grp IS NOT NULL")).collect()
                  if r["model"] == "ridge" and r["eval_season"] == 2021]
    assert abs(ridge_2021[0]["spearman_within_group"] - want) < 1e-9


def test_staging_keeps_no_shuffle_files(spark):
    """Shuffle files behind a staged table are gone once it is written."""
    import time

    from periodica.functions.records import stage

    disk = spark._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    before = files()
    got = stage(spark.range(5000).repartition(6, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        left = {f for f in files() - before if f.startswith("shuffle_") and f.endswith(".data")}
        if not left:
            break
        time.sleep(0.1)
    assert not left and got.count() == 7
