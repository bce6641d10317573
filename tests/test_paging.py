"""Key-set pages against slices of the whole order."""

import random

import pytest
from pyspark.sql import functions as F

from listenlake.operators import ordered, paging
from listenlake.operators.ordered import order_columns

ORDERS = [["t", "s", "id"], ["-t", "s", "id"], ["-s", "-t", "-id"], ["s", "-t", "id"], ["-id"]]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    data = [(draw.choice([None, 1, 2, 3, 4]), draw.choice([None, "a", "b", "é"]), i) for i in range(83)]
    return spark.createDataFrame(data, "t int, s string, id int").repartition(4).cache()


def _whole(rows, order):
    return [r["id"] for r in rows.orderBy(*order_columns(order)).collect()]


@pytest.mark.parametrize("order", ORDERS)
def test_walking_by_cursor_gives_the_order(rows, order):
    seen, cursor = [], None
    while found := paging.next_page(rows, order, cursor, 17).collect():
        seen += [r["id"] for r in found]
        cursor = found[-1].asDict()
    assert seen == _whole(rows, order)


@pytest.mark.parametrize("most", [1 << 20, 10])
@pytest.mark.parametrize("order", ORDERS[:3])
def test_pages_by_number(rows, monkeypatch, order, most):
    monkeypatch.setattr(ordered, "MOST_ROWS", most)  # 10: the whole order is cut
    pages, whole = paging.PageStarts.of(rows, order, 20), _whole(rows, order)
    for n in (1, 2, 5, 6):
        assert [r["id"] for r in pages.page(n).collect()] == whole[20 * (n - 1) : 20 * n]
    assert pages.starts.count() == 5
    assert paging.PageStarts.of(rows.limit(0), order, 20).page(1).isEmpty()
    with pytest.raises(ValueError):
        pages.page(0)


def test_a_page_is_a_range_of_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select("id", (F.col("id") % 7).alias("t")).write.parquet(path)
    stored = spark.read.parquet(path)
    plan = paging.next_page(stored, ["-id", "t"], {"id": 500, "t": 3}, 10)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(id,500)" in plan and "TakeOrderedAndProject" in plan and "offset" not in plan.lower()
