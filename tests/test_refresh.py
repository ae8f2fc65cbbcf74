"""Incremental refresh: parts against one load, what a load reads, replaced batches, published states."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tillroll.operators import aggregates as A
from tillroll.operators import day_state
from tillroll.operators.etl import add_features, clean
from tillroll.plans import refresh
from tillroll.plans.marts import aggregate_tables
from tillroll.schemas import RAW_LINES
from tillroll.sources import versions


def lines(seed, n, start, days, guests=0.2):
    r = random.Random(seed)
    at = datetime.datetime(*start)
    return [
        (
            f"I{r.randint(1, n)}", f"P{r.randint(1, 9)}", r.choice(["MUG", "LAMP", None, " mug "]), r.choice([1, 2, 5, -3, 0, None]),
            at + datetime.timedelta(days=r.randrange(days), hours=r.randrange(24)), None if r.random() < 0.05 else round(r.random() * 90, 2),
            None if r.random() < guests else r.randint(1, 12), r.choice(["Norway", "Chile", None]),
        )
        for _ in range(n)
    ]


def frame(spark, rows):
    rows = [(*x[:5], None if x[5] is None else __import__("decimal").Decimal(str(x[5])), *x[6:]) for x in rows]
    return spark.createDataFrame(rows, RAW_LINES).repartition(3)


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def check_whole(spark, root, raw_rows):
    """Every table of the store equals the operators over all lines at once."""
    tx = add_features(clean(frame(spark, raw_rows)))
    want = {**aggregate_tables(tx, ordered=False), "processing_summary": A.processing_summary(tx)}
    for name, df in want.items():
        got = refresh.read(spark, root, name).drop("processing_date")
        assert rows_of(got) == rows_of(df), name
    assert refresh.read(spark, root, refresh.FACT).count() == tx.count()


@pytest.fixture()
def root(tmp_path):
    return f"file://{tmp_path}/store"


PART_1, PART_2 = lines(1, 150, (2020, 1, 5), 80), lines(2, 150, (2020, 3, 20), 60)
#: New days, late lines of the first part's days, and a month of guests only.
PART_3 = lines(3, 80, (2020, 6, 1), 20) + lines(4, 30, (2020, 1, 5), 80) + lines(5, 20, (2021, 1, 1), 20, guests=1.0)


def test_three_parts_equal_one_load(spark, root, tmp_path):
    parts = [PART_1, PART_2, PART_3]
    for k, rows in enumerate(parts):
        refresh.load(frame(spark, rows), root, f"part {k}")
    check_whole(spark, root, PART_1 + PART_2 + PART_3)
    other = f"file://{tmp_path}/other"
    refresh.load(frame(spark, PART_1 + PART_2 + PART_3), other, "all")
    for name in ("daily_sales", "product_performance", "customer_analysis", "country_performance", "monthly_trends"):
        assert rows_of(refresh.read(spark, root, name)) == rows_of(refresh.read(spark, other, name))
    manifest = versions.latest(spark, root)[1]
    assert sum(r["rows"] for r in refresh.days_done(spark, manifest).collect()) == refresh.read(spark, root, refresh.FACT).count()


def test_a_load_reads_its_own_lines_and_touched_months_only(spark, root, tmp_path):
    """Lines of earlier batches, and all of a batch whose months stay untouched, can be gone."""
    first = refresh.load(frame(spark, lines(6, 90, (2020, 1, 1), 25)), root, "january")
    second = refresh.load(frame(spark, lines(7, 90, (2020, 2, 1), 25)), root, "february")
    assert second["months"]["2020-01"] == first["months"]["2020-01"]
    late = lines(8, 40, (2020, 2, 1), 50)
    before = rows_of(refresh.read(spark, root, "daily_sales").filter("Date < '2020-02-01'"))

    def drop(path):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        assert place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    drop(first["batches"]["january"]["folder"])
    drop(f"{second['batches']['february']['folder']}/{refresh.FACT}")
    third = refresh.load(frame(spark, late), root, "late")
    assert third["months"]["2020-01"] == first["months"]["2020-01"]
    assert third["months"]["2020-02"] != second["months"]["2020-02"]
    assert rows_of(refresh.read(spark, root, "daily_sales").filter("Date < '2020-02-01'")) == before
    tx = add_features(clean(frame(spark, lines(6, 90, (2020, 1, 1), 25) + lines(7, 90, (2020, 2, 1), 25) + late)))
    assert rows_of(refresh.read(spark, root, "product_performance")) == rows_of(A.product_performance(tx, ordered=False))
    # The plan over the batch's lines scans the batch's folder and nothing else.
    stored = refresh.read(spark, root, refresh.FACT, {"batches": {"late": third["batches"]["late"]}})
    assert all(third["batches"]["late"]["folder"].removeprefix("file://") in f for f in stored.inputFiles())


def test_loading_a_batch_again_replaces_it(spark, root):
    refresh.load(frame(spark, PART_1), root, "a")
    refresh.load(frame(spark, PART_3), root, "b")
    refresh.load(frame(spark, PART_2), root, "b")
    check_whole(spark, root, PART_1 + PART_2)
    assert "2021-01" not in versions.latest(spark, root)[1]["months"]
    refresh.load(frame(spark, PART_2), root, "b")
    check_whole(spark, root, PART_1 + PART_2)
    left = refresh.left_over(spark, root)
    named = str(versions.latest(spark, root)[1])
    assert left and not any(f in named for f in left)


def test_batch_without_valid_lines(spark, root):
    bad = [("I1", "P1", "x", 0, datetime.datetime(2020, 1, 1), 1.0, 1, "Chile")]
    refresh.load(frame(spark, bad), root, "bad")
    assert refresh.read(spark, root, "daily_sales").count() == 0
    assert refresh.read(spark, root, "processing_summary").first()["total_records"] == 0
    refresh.load(frame(spark, PART_1), root, "good")
    check_whole(spark, root, PART_1)


def test_a_reader_sees_one_whole_state(spark, root):
    refresh.load(frame(spark, PART_1), root, "a")
    number, manifest = versions.latest(spark, root)
    old = rows_of(refresh.read(spark, root, "product_performance", manifest))
    refresh.load(frame(spark, PART_2), root, "b")
    assert rows_of(refresh.read(spark, root, "product_performance", manifest)) == old
    assert versions.latest(spark, root)[0] == number + 1
    assert versions.document(spark, root, number) == manifest


def test_a_load_that_dies_changes_nothing(spark, root, monkeypatch):
    refresh.load(frame(spark, PART_1), root, "a")
    state = versions.latest(spark, root)
    with monkeypatch.context() as m:
        m.setattr(refresh, "_tables", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            refresh.load(frame(spark, PART_2), root, "b")
    assert versions.latest(spark, root) == state
    check_whole(spark, root, PART_1)
    assert refresh.left_over(spark, root)


def test_publishing_twice_after_one_state(spark, root):
    assert versions.latest(spark, root) == (0, {})
    assert versions.publish(spark, root, 0, {"a": 1}) == 1
    with pytest.raises(versions.StoreChanged):
        versions.publish(spark, root, 0, {"a": 2})
    assert versions.latest(spark, root) == (1, {"a": 1})
    assert versions.publish(spark, root, 1, {"a": "ü"}) == 2
    assert versions.latest(spark, root) == (2, {"a": "ü"})


def test_states_are_compacted_where_they_lie(spark, tmp_path):
    """Products and pairs of a batch need no exchange, by day or by month; sums and keys with nulls add up."""
    tx = add_features(clean(frame(spark, lines(11, 400, (2020, 1, 1), 40)))).cache()
    for name in day_state.COMPACTED:
        state = day_state.day_states(tx)[name]
        for step in (state, day_state.compacted(state, name, ("Date",))):
            assert "Exchange" not in step._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        keys, merges = day_state.STATES[name]
        source = tx.filter("Customer_ID is not null") if "Customer_ID" in keys else tx
        measures = {"revenue": "sum(Revenue)", "quantity": "sum(Absolute_Quantity)", "price": "sum(Price)", "lines": "count(Invoice)"}
        rows = [F.expr(measures[m]).cast(state.schema[m].dataType).alias(m) for m in merges] or [F.count(F.lit(1)).alias("n")]
        want = source.groupBy("Date", *keys).agg(*rows).drop("n")
        assert rows_of(day_state.merged(state, name, ("Date",))) == rows_of(want)
    one = tx.coalesce(1)
    assert day_state.day_states(one)["products"].count() == one.groupBy("Date", *day_state.PRODUCT).count().count()


def test_month_of_one_batch_is_not_written_again(spark, tmp_path):
    root = str(tmp_path / "store")
    first = refresh.load(frame(spark, lines(6, 90, (2020, 1, 1), 25)), root, "january")
    assert not (tmp_path / "store" / "months" / first["months"]["2020-01"].split("/")[-1] / "pairs").exists()
    late = lines(8, 30, (2020, 1, 1), 25)
    second = refresh.load(frame(spark, late), root, "late")
    assert (tmp_path / "store" / "months" / second["months"]["2020-01"].split("/")[-1] / "pairs").exists()
    check_whole(spark, root, lines(6, 90, (2020, 1, 1), 25) + late)
