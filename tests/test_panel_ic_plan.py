"""Where panel_ic sorts."""

from __future__ import annotations

from tickloom.operators import ic


def test_panel_ic_sorts_rows_before_it_unpivots_them(spark):
    df = spark.range(200).selectExpr("date_add(date '2024-01-01', cast(id % 4 as int)) as trade_date", "rand(1) as a", "rand(2) as b", "rand(3) as y")
    plan = ic.panel_ic(df, ["a", "b"], {1: "y"}, 50, 10, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Generate") < plan.index("Window")
