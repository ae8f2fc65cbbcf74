"""Results do not depend on how rows are split or ordered, and totals add up."""

import os

import pytest
from pyspark.sql import functions as F

from tillroll.operators import aggregates as A
from tillroll.operators import chunks as CH
from tillroll.operators import etl
from tillroll.operators import experiments as X
from tillroll.operators import rfm as R
from tillroll.operators import series as S
from tillroll.sources import star

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

OPERATORS = {
    "daily_sales": A.daily_sales,
    "product_dim": A.product_dim,
    "customer_analysis": A.customer_analysis,
    "rfm_scores": lambda tx: R.rfm_scores(R.rfm_features(etl.sales_only(etl.registered(tx)))),
    "sequences": lambda tx: S.sequences(tx, "Customer_ID", "Revenue", star.LINE_ORDER, block=16),
    "transaction_chunks": lambda tx: CH.transaction_chunks(tx, star.LINE_ORDER),
    "lag_features": lambda tx: S.lag_features(
        S.date_spine(S.daily_series(etl.sales_only(tx)).select("Date", "Daily_Revenue"), "Date"), "Daily_Revenue", "Date"
    ).select("Date", "Daily_Revenue", "Daily_Revenue_lag_7", "Daily_Revenue_rolling_mean_7"),
    "quartiles": lambda tx: X.quartile_segment(A.customer_analysis(tx, ordered=False), "Total_Spent"),
}


@pytest.fixture(scope="module")
def tx(spark):
    return star.transactions(spark, SF).cache()


@pytest.fixture(scope="module")
def plain(tx):
    return {name: sorted(map(str, run(tx.repartition(1)).collect())) for name, run in OPERATORS.items()}


@pytest.mark.parametrize("parts", [7, 64])
@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_same_result_under_any_partitioning(tx, plain, name, parts):
    shuffled = tx.repartition(parts, F.xxhash64(*star.LINE_ORDER, F.lit(parts)))
    assert sorted(map(str, OPERATORS[name](shuffled).collect())) == plain[name]


def test_totals_of_aggregates_equal_totals_of_the_fact(tx):
    total, rows = tx.agg(F.sum("Revenue"), F.count(F.lit(1))).first()
    for table, count in (
        (A.daily_sales(tx), "Total_Transactions"), (A.product_performance(tx), "Total_Orders"),
        (A.country_performance(tx), "Total_Transactions"), (A.monthly_trends(tx), "Total_Transactions"),
    ):
        assert tuple(table.agg(F.sum("Total_Revenue"), F.sum(count)).first()) == (total, rows)
    known = etl.registered(tx).agg(F.sum("Revenue")).first()[0]
    assert A.customer_analysis(tx).agg(F.sum("Total_Spent")).first()[0] == known
    chunks = CH.transaction_chunks(tx, star.LINE_ORDER).agg(F.sum("revenue"), F.sum("rows")).first()
    assert tuple(chunks) == (total, rows)
