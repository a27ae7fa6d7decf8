"""Order and search indexes: equal to the sort and to the scan, few files opened."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from functools import cmp_to_key

import pytest
from pyspark.sql import functions as F

from siftline.operators import order_index, search_index, views
from siftline.plans.scratch import scratch_dir

VIEW = "id string, match struct<score:int>, prescore double, posted_at timestamp, last_seen_at timestamp, title string, company string, source string, tags array<string>"


def listings(n=300):
    rng, start = random.Random(4), datetime(2026, 1, 1)
    rows = []
    for i in range(n):
        # A third of all rows share their score, prescore and dates.
        common = i % 3 == 0
        score = None if i % 7 == 0 else (50,) if common else (rng.randrange(100),)
        prescore = None if i % 11 == 0 else 0.5 if common else round(rng.random(), 2)
        posted = None if i % 5 == 0 else start + timedelta(days=1 if common else rng.randrange(40))
        title = rng.choice(["Data Engineer", "engineer II", "Ärztin 😀 Berlin", "", None, "aaaa", "C++"])
        tags = rng.choice([["spark", "python"], [], None, [None, "go"]])
        rows.append((f"id{i:04d}", score, prescore, posted, start + timedelta(days=i % 4), title, rng.choice([None, "Acme 😀", "Data"]), "src", tags))
    return rows


@pytest.fixture(scope="module")
def view(spark):
    return spark.createDataFrame(listings(), VIEW).repartition(3)


@pytest.mark.parametrize("order", views.ORDERS)
def test_pages_equal_the_sorted_view(spark, view, order):
    want = [r["id"] for r in view.orderBy(*views.order_columns(order)).select("id").collect()]
    path = scratch_dir(spark)
    order_index.build_order_index(view, order, path, files=12)
    deep = order_index.page_at(spark, path, limit=20, offset=200)
    assert [(r["id"], r["position"]) for r in deep.collect()] == [(i, k + 201) for k, i in enumerate(want[200:220])]
    assert len(deep.inputFiles()) <= 3
    assert order_index.page_at(spark, path, limit=20, offset=len(want)).count() == 0
    seen, key = [], tuple(order_index.page_at(spark, path, limit=1).first()["key"])
    while True:
        following = order_index.page_following(spark, path, key, limit=140)
        rows = following.collect()
        if not rows:
            break
        seen += [r["id"] for r in rows]
        key = tuple(rows[-1]["key"])
    assert seen == want[1:]


def test_order_index_of_nothing_and_limits(spark, view):
    path = scratch_dir(spark)
    order_index.build_order_index(view.limit(0), "prescore", path)
    assert order_index.page_at(spark, path).count() == 0
    assert order_index.page_following(spark, path, (False, -0.5, "id")).count() == 0
    for bad in ({"limit": 0}, {"limit": views.MAX_PAGE + 1}, {"offset": -1}):
        with pytest.raises(ValueError):
            order_index.page_at(spark, path, **bad)
    with pytest.raises(ValueError):
        order_index.order_key("size")


def test_search_equals_the_scan(spark, view):
    path = scratch_dir(spark)
    search_index.build_search_index(view, path, buckets=8)
    texts = {r["id"]: r["h"] for r in view.select("id", views.haystack().alias("h")).collect()}
    for needle in ["  Engineer", "ärztin 😀 b", "aaa", "aaaaa", "c++", "data src", "spark python", "go", "", "zzz", "eng%neer", "😀 src"]:
        got = sorted(r["id"] for r in search_index.search(spark, path, needle).collect())
        assert got == sorted(i for i, h in texts.items() if needle.strip().lower() in h), needle


def test_search_opens_the_rarest_lists_only(spark, view):
    path = scratch_dir(spark)
    search_index.build_search_index(view, path, buckets=16)
    lists = search_index.rarest(spark, path, "data engineer")
    assert len(lists) == search_index.LISTS
    sizes = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/grams").collect()}
    assert max(sizes[g] for g, _ in lists) <= min(sizes[g] for g in {"data engineer"[i : i + 3] for i in range(11)} - {g for g, _ in lists})
    for gram, bucket in lists:
        opened = search_index.postings(spark, path, gram, bucket).inputFiles()
        assert opened and all(f"/bucket={bucket}/" in name for name in opened)


def test_search_index_of_nothing(spark, view):
    path = scratch_dir(spark)
    search_index.build_search_index(view.limit(0), path)
    assert search_index.search(spark, path, "engineer").count() == 0
    assert search_index.search(spark, path, "en").count() == 0


def test_ordering_reads_its_input_once(spark, view):
    """Dealing out by range looks at its input twice; the view is worked out once."""
    counted = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(i):
        counted.add(1)
        return i

    watched = view.withColumn("id", seen.asNondeterministic()("id"))
    order_index.build_order_index(watched, "posted_at", scratch_dir(spark), files=4)
    assert counted.value == view.count()
    placed = views.ordered_positions(watched.select("id", "prescore"), views.order_columns("prescore"), scratch_dir(spark))
    assert placed.count() == view.count() and counted.value == 2 * view.count()
