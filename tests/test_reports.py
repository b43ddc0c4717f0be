"""Order of report tables (O2, O3), which an order-blind check can't see."""

from conftest import SF_SMALL
from pyspark.sql import functions as F


def test_pivot_is_sorted_by_the_first_approach(spark):
    from canopy.plans.queries_select import q_pivot
    rows = q_pivot(spark, SF_SMALL).collect()
    shares = [r["baseline"] for r in rows]
    assert len(rows) == 3 and shares == sorted(shares, reverse=True)
    assert [r["progressive"] for r in rows if r["feature"] == "N"] == [0.0]


def test_importance_is_sorted_within_a_model(spark):
    from canopy.operators.explain import gain_importance
    table = spark.createDataFrame(
        [("m", "b", False, 1.0), ("m", "a", False, 3.0), ("m", "a", True, 9.0), ("k", "c", False, 2.0)],
        "model string, feature string, is_leaf boolean, gain double")
    got = [(r["model"], r["feature"], r["pct"]) for r in gain_importance(table, ["a", "b", "c"]).collect()]
    assert got == [("k", "c", 100.0), ("k", "a", 0.0), ("k", "b", 0.0), ("m", "a", 75.0), ("m", "b", 25.0), ("m", "c", 0.0)]


def _rows(spark, n=240):
    return spark.range(n).selectExpr("id as key", "cast(id % 6 + 1 as int) as fold", "cast(id % 7 as double) as x",
                                     "cast(10 + id % 7 + (id * 37 % 11) / 10.0 as double) as y")


def test_run_all_writes_results_and_a_summary_in_config_order(spark, tmp_path):
    from canopy.operators.boost.fit import BoostParams
    from canopy.plans.study import run_all
    cfg = spark.createDataFrame(
        [("zeta", "y", {"x": 1}, "reg:squarederror", 0.3), ("bad", "y", {}, "no:such", 0.1),
         ("alpha", "y", {"x": 1}, "reg:squarederror", 0.3)],
        "dataset string, target string, monotonic map<string,int>, objective string, lr double").coalesce(1)
    status, summary = run_all(
        spark, cfg, lambda name: (_rows(spark), "key"), [1],
        lambda c: BoostParams(objective=c["objective"], learning_rate=c["lr"], max_trees=2, early_stopping_rounds=1),
        out_path=str(tmp_path))
    assert [r["status"] for r in status.collect()] == ["ok", "failed", "ok"]
    got = [(r["dataset"], r["approach"]) for r in spark.read.parquet(f"{tmp_path}/summary").collect()]
    assert got == [(d, a) for d in ("zeta", "alpha") for a in ("baseline", "monotonic", "progressive")]
    assert summary.count() == 6 and (tmp_path / "importance" / "zeta").is_dir()


def test_only_committed_rows_are_read_back(spark, tmp_path):
    from canopy.operators.select import RESULT_SCHEMA
    from canopy.sources.sinks import ROWS, write_results
    from canopy.sources.text import read_results

    def rows(dataset, mape):
        return spark.createDataFrame([(dataset, "baseline", 1, mape, mape, 1, None, None, True, 0)], RESULT_SCHEMA)

    path = str(tmp_path / "r")
    first = write_results(rows("a", 0.1).union(rows("b", 0.2)), path)
    second = write_results(rows("a", 0.3), path)
    (rows("b", 0.9).withColumn("run", F.lit("zz")).withColumn("version", F.lit("zz"))      # a run that died before its commit
     .write.mode("append").partitionBy("dataset", "run", "version").parquet(f"{path}/{ROWS}"))
    assert {(r.dataset, r.cv_mape) for r in read_results(spark, path).collect()} == {("a", 0.3), ("b", 0.2)}
    assert {(r.dataset, r.cv_mape) for r in read_results(spark, path, run=first).collect()} == {("a", 0.1), ("b", 0.2)}
    assert {(r.dataset, r.cv_mape) for r in read_results(spark, path, ["a", "b"], second).collect()} == {("a", 0.3)}
    assert read_results(spark, path, ["none"]).count() == 0 and read_results(spark, path, []).count() == 0
    write_results(rows("b", 0.5), path, second)
    write_results(rows("b", 0.6), path, second)              # written twice in a run: the last rows
    assert {(r.dataset, r.cv_mape) for r in read_results(spark, path).collect()} == {("a", 0.3), ("b", 0.6)}


def test_cross_validation_hook_sees_training_rows_only(spark):
    from pyspark.sql import functions as F

    from canopy.operators.boost.fit import BoostParams
    from canopy.plans.study import cross_validate
    p = BoostParams(objective="reg:squarederror", learning_rate=0.5, max_trees=2, subsample=1.0, colsample_bytree=1.0)
    rows = _rows(spark)
    plain = cross_validate(rows, "key", "y", ["x"], 1, p).groups["cv"]
    same = cross_validate(rows, "key", "y", ["x"], 1, p, train_transform=lambda d: d).groups["cv"]
    assert same["cv_trees"] == plain["cv_trees"] and abs(same["cv_mape"] - plain["cv_mape"]) < 1e-9
    assert abs(same["test_mape"] - plain["test_mape"]) < 1e-9
    seen = []
    def shifted(d):
        seen.append({r[0] for r in d.select("fold").distinct().collect()})
        return d.withColumn("y", F.col("y") + 100.0)
    worse = cross_validate(rows, "key", "y", ["x"], 1, p, train_transform=shifted).groups["cv"]
    assert worse["cv_mape"] > 1.0
    assert [sorted(s) for s in seen] == [sorted({1, 2, 3, 4, 5} - {k}) for k in range(1, 6)] + [[1, 2, 3, 4, 5]]


def test_processed_table_with_test_label_loads(spark, tmp_path):
    from canopy.functions.scalar import fold_label
    from canopy.sources.sinks import write_processed
    from canopy.sources.text import read_processed
    write_processed(_rows(spark).withColumn("fold", fold_label("fold", 6)), str(tmp_path / "p"))
    got = read_processed(spark, str(tmp_path / "p"))
    assert sorted(r[0] for r in got.select("fold").distinct().collect()) == [1, 2, 3, 4, 5, 6]
    assert got.count() == 240


def test_run_all_query_trains_past_its_warm_up(spark, monkeypatch):
    """m22: several warm-up sizes, each with trees left that may use the constrained features."""
    from canopy.plans import queries_boost, study

    sizes = []

    def asked(df, key, target, dataset, constraints, max_depths, params, phase1_pcts=study.PHASE1_PERCENTAGES):
        sizes.append((params.max_trees, [study.phase1_trees(params.max_trees, p) for p in phase1_pcts]))
        raise ValueError("asked is enough")

    monkeypatch.setattr(study, "run_grid_search", asked)
    queries_boost.q_m22(spark, "/root/testdata/sf0.001").collect()
    assert len(sizes) == 3
    for trees, warm in sizes:
        assert len(set(warm)) > 1 and max(warm) < trees


def test_curves_of_all_winners_look_their_rows_up_once(spark, monkeypatch):
    from canopy.operators import explain
    from canopy.operators.boost.fit import BoostParams
    from canopy.plans import study
    df = _rows(spark)
    st = study.run_grid_search(df, "key", "y", "d", {"x": 1}, [1], BoostParams(max_trees=2, early_stopping_rounds=1), phase1_pcts=[0.5])
    looked, ends = [], explain.min_max
    monkeypatch.setattr(explain, "min_max", lambda d, c: looked.append(c) or ends(d, c))
    test = df.where("fold = 6")
    found = study.diagnostics(spark, test, "key", st, 5, 3)
    assert looked == ["x"] and set(st.winners) == {"baseline", "monotonic", "progressive"}
    for approach in st.winners:
        pdp, ice = study.curves(test, "key", st, approach, "x", 5, 3)
        for kind, alone in (("pdp", pdp), ("ice", ice)):
            got = found[kind].where(F.col("approach") == approach).drop("approach", "feature")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, alone.select(got.columns).collect()))


def test_orders_are_prepared_once_for_a_run(spark, monkeypatch):
    from canopy.plans import queries_boost, study
    seen = []

    def run_all(spark, cfg, load, *more, **named):
        df, key = load("orders")
        seen.append(df.inputFiles())
        return (spark.createDataFrame([("orders", "ok", None)], "dataset string, status string, error string"),
                spark.createDataFrame([("orders",)], "dataset string"))

    monkeypatch.setattr(study, "run_all", run_all)
    queries_boost.q_m22(spark, SF_SMALL).collect()
    assert all("prepared-orders" in f for f in seen[0]) and seen[0]
