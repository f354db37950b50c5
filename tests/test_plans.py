"""Lanes against packing one by one, numbers against hand-judged readings, counters under replays."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.functions import numbers
from plumbline.operators import lanes
from plumbline.streaming import sinks


def plain_lanes(rows):
    out, by = {}, {}
    for k, i, a, b in sorted((r for r in rows if r[2] is not None and r[3] is not None), key=lambda r: (r[2], r[1])):
        ends = by.setdefault(k, [])
        lane = next((n for n, end in enumerate(ends) if end <= a), len(ends))
        ends[lane : lane + 1] = [max(a, b)]
        out[k, i] = lane
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lanes_equal_packing_one_by_one(spark, seed):
    draw, day, rows = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(600):
        key = draw.choice(["hot", "hot", "b", None, "c"])
        start = day + timedelta(days=draw.randrange(400))
        rows.append((key, i, start if draw.random() < 0.97 else None, start + timedelta(days=draw.randrange(-2, 12)) if draw.random() < 0.97 else None))
    df = spark.createDataFrame(rows, "k string, i int, a timestamp, b timestamp").repartition(5)
    got = {(r["k"], r["i"]): r["lane"] for r in lanes.packed(df, "k", "a", "b", "i").collect()}
    want = plain_lanes(rows)
    assert {x: n for x, n in got.items() if n is not None} == want and len(got) == len(rows)
    # As many lanes as overlap at once.
    for key in {r[0] for r in rows}:
        own = [(a, max(a, b)) for k, _, a, b in rows if k == key and a and b and b > a]
        most = max((sum(a <= t < b for a, b in own) for t, _ in own), default=0)
        assert max((n for (k, _), n in want.items() if k == key), default=-1) + 1 >= most
    assert lanes.packed(df.limit(0), "k", "a", "b", "i").collect() == []


NUMBERS = [
    # number, home, read, country, national, valid, domestic
    ("07911 123456", "GB", "national", "GG", "7911123456", True, True), ("020 7946 0000", "GB", "national", "GB", "2079460000", True, True), ("+44 20 7946 0000", "AU", "international", "GB", "2079460000", True, False), ("0044 20 7946 0000", "DE", "international", "GB", "2079460000", True, False),
    ("1-900-555-1212", "US", "national", "US", "9005551212", True, True), ("1-900-555-1212", "CA", "national", "US", "9005551212", True, True), ("+1 416 555 0199", "US", "international", "CA", "4165550199", True, True), ("+1 876 555 0101", "US", "international", "JM", "8765550101", True, False),
    ("447911123456", "US", "bare", "GG", "7911123456", True, False), ("0412 345 678", "AU", "national", "AU", "412345678", True, True), ("61412345678", "AU", "bare", "AU", "412345678", True, True), ("+61 8 9162 1234", "AU", "international", "CC", "891621234", True, True),
    ("+7 701 123 4567", "RU", "international", "KZ", "7011234567", True, False), ("8 495 123 4567", "RU", "national", "RU", "4951234567", True, True), ("612 345 678", "ES", "national", "ES", "612345678", True, True), ("+999 123", "GB", "international", None, None, False, False),
    ("12", "AU", "national", "AU", "12", False, True), (None, "FR", "national", "FR", "", False, True),
]


def test_numbers_are_read_by_the_longest_prefix(spark):
    df = spark.createDataFrame([(i, n[0], n[1]) for i, n in enumerate(NUMBERS)], "i int, number string, home string")
    got = {r["i"]: (r["read"], r["country"], r["national"], r["valid"], r["domestic"]) for r in numbers.parsed(df, ["i"], "number", F.col("home")).collect()}
    assert got == {i: n[2:] for i, n in enumerate(NUMBERS)}


def test_plans_are_a_table_without_doubles():
    rows = numbers.plan_rows()
    assert len({p for p, *_ in rows}) == len(rows) and all(len(p) <= numbers.LONGEST and low <= high for p, _, _, low, high in rows)


def test_replayed_batches_count_once(spark, tmp_path):
    rows = [("d1", "click"), ("d1", "odd"), ("d2", None), ("d1", "click")]
    batch = sinks.bucketed(spark.createDataFrame(rows, "day string, outcome string"), "outcome", ("click",))
    path, merged = str(tmp_path / "t"), []

    class Stream:  # what a stream hands over, batch by batch
        writeStream = property(lambda self: self)

        def foreachBatch(self, merge):
            merged.append(merge)

    sinks.counted_into(Stream(), path, ["day", "outcome"])
    for number in (0, 1, 1, 0):
        merged[0](batch, number)
    want = {("d1", "click"): 4, ("d1", "other"): 2, ("d2", "other"): 2}
    assert {(r["day"], r["outcome"]): r["value"] for r in sinks.counters(spark, path, ["day", "outcome"]).collect()} == want
    sinks.compacted(spark, path, str(tmp_path / "u"), ["day", "outcome"])
    assert {(r["day"], r["outcome"]): r["value"] for r in sinks.counters(spark, str(tmp_path / "u"), ["day", "outcome"]).collect()} == want
