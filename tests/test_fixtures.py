"""Exact cases of FIXTURES.md."""

from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.operators import boxes as B
from pagewright.operators import cost, store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def box(*b):
    return G.box(*[F.lit(v) for v in b])


def test_calendar(spark):
    now = F.lit("2026-09-17 04:30:00").cast("timestamp")
    got = [one(spark, F.date_format(cost.period_start(p, now, "Australia/Sydney"), "yyyy-MM-dd HH")) for p in cost.PERIODS]
    assert got == ["2026-09-16 14", "2026-09-13 14", "2026-08-31 14", "2025-12-31 13"]


def test_offpeak_wraps(spark):
    at = lambda s: one(spark, cost.is_offpeak(F.lit("16:30"), F.lit("00:30"), F.lit(f"2026-01-01 {s}").cast("timestamp")))
    assert [at("23:00:00"), at("00:15:00"), at("10:00:00")] == [True, True, False]
    assert one(spark, cost.is_offpeak(F.lit("01:00"), F.lit("01:00"), F.lit("2026-01-01 01:00:00").cast("timestamp"))) is False


def test_prices(spark):
    models = spark.createDataFrame([(0, 2.0, 8.0, 1.0, 4.0, "00:30", "16:30")], "id int, price_in double, price_out double, offpeak_in double, offpeak_out double, offpeak_start string, offpeak_end string")
    usage = spark.createDataFrame([(0, "2026-01-01 12:00:00", 10**6, 10**6), (0, "2026-01-01 20:00:00", 10**6, 10**6), (5, "2026-01-01 20:00:00", 1, 1)], "model int, t string, prompt_tokens long, completion_tokens long").withColumn("ts", F.col("t").cast("timestamp"))
    assert [r["cost"] for r in cost.priced(usage, models).orderBy("t", "model").collect()] == [5.0, 10.0, 0.0]


def test_orientation(spark):
    got = [one(spark, G.orientation(F.lit(w), F.lit(h))) for w, h in ((100, 30), (50, 60), (40, 200), (10, 40))]
    assert got == ["horizontal", "horizontal", "vertical", "furigana"]


def test_containment(spark):
    assert one(spark, G.containment(box(0, 0, 100, 100), box(10, 10, 20, 20))) == 1.0
    assert one(spark, G.containment(box(0, 0, 10, 10), box(50, 50, 10, 10))) == 0.0
    assert one(spark, G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0


def test_inset(spark):
    b = one(spark, G.inset(box(100, 100, 200, 200)))
    assert (b["w"], b["h"]) == (140, 152)


def _boxes(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "page_id long, ix int, x int, y int, w int, h int").withColumn("bbox", G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def test_dedup(spark):
    kept = lambda f, rows: sorted(r["ix"] for r in f(_boxes(spark, rows)).collect())
    assert kept(B.dedup_largest, [(10, 10, 20, 200), (10, 30, 20, 120), (12, 12, 16, 80), (10, 10, 20, 50)]) == [0]
    assert kept(B.dedup_smallest, [(0, 0, 400, 300), (10, 10, 200, 40), (10, 60, 200, 40), (10, 110, 150, 40)]) == [1, 2, 3]


def test_confidence(spark):
    got = [one(spark, B.confident(F.lit(c).cast("double"))) for c in (None, 0.999, 0.51, 0.5, 0.37, 0.473)]
    assert got == [True, True, True, True, False, False]


def test_final_status(spark):
    pages = spark.createDataFrame([(1, "done"), (1, "done"), (2, "done"), (2, "failed"), (3, "failed")], "job_id long, status string")
    assert {r["job_id"]: r["status"] for r in store.final_status(pages).collect()} == {1: "done", 2: "partial", 3: "failed"}


def test_mask(spark):
    assert [one(spark, T.mask_key(F.lit(k))) for k in ("sk-abcdef123456789", "", "short")] == ["sk-abc…6789", "", "•••••"]
    assert one(spark, T.is_masked(F.lit(" "))) and one(spark, T.is_masked(F.lit("a…b"))) and not one(spark, T.is_masked(F.lit("ab")))
