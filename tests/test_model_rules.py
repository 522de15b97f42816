"""Compiled rules against Spark ML, in Spark and in DuckDB over the SQL twin of the features."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from panelytics.catalog import experiments
from panelytics.catalog.registry import SQL
from panelytics.operators import model_rules, models
from panelytics.plans.views import TABLES, Tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    t = Tables(spark, SF)
    train, test = experiments.sets(t)
    train = train.cache()
    forest = models.fit_forest(train, depths=(3, 6), trees=(4, 7), folds=2)
    logistic = models.fit_logistic(train, penalties=(0.0, 0.1), mixing=(0.0,), folds=2)
    return t, test, {"forest": forest, "logistic": logistic}


def rule_of(spark, models_by_name, name):
    model = models_by_name[name]
    return model_rules.forest_sql(model_rules.forest_table(spark, model)) if name == "forest" else model_rules.logistic_sql(model)


@pytest.mark.parametrize("name", ["forest", "logistic"])
def test_rule_predicts_as_the_model_does(spark, fitted, name):
    t, test, by_name = fitted
    rule = rule_of(spark, by_name, name)
    want = {(r.page_id, r.is_core): r.prediction for r in by_name[name].transform(test).select("page_id", "is_core", "prediction").collect()}
    own = model_rules.predict(test.drop("features"), rule)
    assert {(r.page_id, r.is_core): r.prediction for r in own.collect()} == want and len(set(want.values())) == 2
    assert own.transform(models.evaluate).collect() == by_name[name].transform(test).transform(models.evaluate).collect()
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    twin = con.execute(f"SELECT page_id, is_core, {rule} FROM ({SQL['x1_feature_table']}) q").fetchall()
    tested = {(i, y): float(p) for i, y, p in twin if (i, y) in want}
    assert tested == want


def test_equal_shares_are_class_zero_and_ends_go_left(spark):
    nodes = [(0, 0, 1, 2, 0, 0.5, None, None), (0, 1, -1, -1, -1, None, 0.25, 0.75), (0, 2, -1, -1, -1, None, 0.5, 0.5)]
    table = spark.createDataFrame(nodes, "tree int, node int, left int, right int, feature int, threshold double, share_0 double, share_1 double")
    rows = spark.createDataFrame([(0.5,), (0.1 + 0.4000000000000001,), (-1.0,)], "x double")
    got = model_rules.predict(rows, model_rules.forest_sql(table, ["x"])).collect()
    assert [r.prediction for r in got] == [1.0, 0.0, 1.0]


def test_numbers_keep_their_bits(spark):
    values = [0.1, -0.1, 1 / 3, 1e-300, -2.5e17, 0.0]
    row = spark.range(1).select(*[F.expr(model_rules.number(v)).alias(f"v{i}") for i, v in enumerate(values)])
    assert list(row.first()) == values and {d for _, d in row.dtypes} == {"double"}
    assert list(duckdb.sql("SELECT " + ", ".join(map(model_rules.number, values))).fetchall()[0]) == values
