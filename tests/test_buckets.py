"""The star in buckets: same lines, no exchange in join and grouping."""

import pytest

from tillroll.sources import star, warehouse

SF = "/root/testdata/sf0.001"
NAMES = ("lineitem", "orders", "part", "customer", "nation")


@pytest.fixture()
def frames(spark):
    return [star.table(spark, SF, n) for n in NAMES]


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("per_bucket", [1_000_000, 1500])
def test_join_and_grouping_move_no_row(spark, frames, monkeypatch, per_bucket):
    monkeypatch.setattr(warehouse, "BUCKET_ROWS", per_bucket)
    assert warehouse.store_star(*frames, namespace="bucket_test") == (1 if per_bucket > 6000 else 4)
    lines = warehouse.stored_lines(spark, "bucket_test")
    raw = star.raw_lines(spark, SF)
    assert rows(lines.select(*raw.columns)) == rows(raw)
    assert "Exchange" not in plan_of(lines)
    totals = warehouse.invoice_totals(lines)
    assert "Exchange" not in plan_of(totals)
    want = raw.selectExpr("cast(replace(Invoice, 'INV', '') AS bigint) AS order_key", "Quantity", "Price")
    assert rows(totals) == rows(warehouse.invoice_totals(want))


def test_stored_again_with_other_rows(spark, frames):
    warehouse.store_star(*frames, namespace="bucket_again")
    line, *rest = frames
    warehouse.store_star(line.filter("l_orderkey % 2 = 0"), *rest, namespace="bucket_again")
    odd = warehouse.stored_lines(spark, "bucket_again").filter("order_key % 2 = 1")
    assert odd.count() == 0 and warehouse.stored_lines(spark, "bucket_again").count() > 0


def test_no_lines(spark, frames):
    line, *rest = frames
    assert warehouse.store_star(line.filter("false"), *rest, namespace="bucket_none") == 1
    assert warehouse.invoice_totals(warehouse.stored_lines(spark, "bucket_none")).count() == 0


def test_files_of_an_earlier_session_are_no_hindrance(spark, frames):
    """A session whose catalog is new finds the folders of tables that an earlier one left in the warehouse."""
    for name in (warehouse.LINES, warehouse.INVOICES, *warehouse.WAREHOUSE):
        spark.range(3).write.parquet(f"{spark.conf.get('spark.sql.warehouse.dir')}/bucket_left.db/{name}")
    warehouse.store_star(*frames, namespace="bucket_left")
    lines = warehouse.stored_lines(spark, "bucket_left")
    n = lines.count()
    assert n > 0
    warehouse.create_tables(spark, "bucket_left")
    line, *rest = frames
    warehouse.store_star(line.filter("false"), *rest, namespace="bucket_left")
    assert lines.count() == n and warehouse.stored_lines(spark, "bucket_left").count() == 0
