"""Exact cases of FIXTURES.md for merges, captions, duplicates, archives, logs and streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.operators import boxes as B
from pagewright.operators import cost, folds, store
from pagewright.sources import archives
from pagewright.streaming import worker


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def rows(spark, boxes):
    table = [(1, i, *b, t, 0.9, 0.0) for i, (b, t) in enumerate(boxes)]
    return spark.createDataFrame(table, "page_id long, ix int, x int, y int, w int, h int, text string, conf double, angle double")


def texts(df):
    return [r["text"] for r in df.orderBy("y", "x").collect()]


def test_words(spark):
    got = folds.merge_words(rows(spark, [((524, 1255, 101, 52), "않아?"), ((450, 1256, 80, 50), "좋지"), ((425, 1308, 231, 52), "도시사람들은")]))
    assert texts(got) == ["좋지 않아?", "도시사람들은"]


def test_stacked(spark):
    got = folds.merge_stacked(rows(spark, [((100, 100, 200, 40), "line1"), ((100, 145, 200, 40), "line2"), ((100, 190, 200, 40), "line3"), ((400, 100, 200, 40), "other")]))
    assert texts(got) == ["line1line2line3", "other"]
    far = [((100, y, 200, 40), t) for y, t in ((100, "a1"), (145, "a2"), (190, "a3"), (235, "a4"), (280, "a5"), (420, "b1"))]
    assert texts(folds.merge_stacked(rows(spark, far))) == ["a1a2a3a4a5", "b1"]


def test_columns(spark):
    got = folds.merge_columns(rows(spark, [((100, 10, 30, 200), "左"), ((135, 12, 30, 200), "右"), ((400, 10, 30, 200), "x")]))
    assert texts(got) == ["右左", "x"]


def test_clusters(spark):
    got = folds.caption_clusters(rows(spark, [((723, 211, 124, 64), "a"), ((854, 215, 62, 53), "b"), ((699, 271, 426, 37), "c"), ((10, 900, 50, 30), "d")]))
    assert {r["ix"]: r["cluster"] for r in got.collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


@pytest.mark.parametrize(("boxes", "kept"), [
    ([((989, 52, 66, 314), "あってますけど！！"), ((900, 61, 148, 292), "あってますけど！！なんでそれはわかるかなあ！")], [1]),
    ([((0, 0, 50, 50), "ふる"), ((500, 500, 50, 50), "ふる")], [0, 1]),
    ([((100 + 8 * i, 100, 40, 120), "そういえば" + "、．。！"[i % 4]) for i in range(5)] + [((140, 100, 40, 120), "そういうことで、")], []),
    ([((0, 0, 60, 200), "こんにちは"), ((50, 0, 60, 200), "さようなら")], [0, 1]),
])
def test_duplicates(spark, boxes, kept):
    assert sorted(r["ix"] for r in folds.collapse_duplicates(rows(spark, boxes)).collect()) == kept


def test_bullets(spark):
    df = rows(spark, [((100, 100, 200, 120), "●筋力Ｂ＋●持久力Ｂ●防御技術Ｂ")]).withColumn("bbox", G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))).withColumn("kind", F.lit("vertical"))
    got = B.bullets(df).orderBy("part").collect()
    assert [(r["text"], r["bbox"]["y"], r["bbox"]["h"], r["kind"]) for r in got] == [("筋力Ｂ＋", 100, 40, "horizontal"), ("持久力Ｂ", 140, 40, "horizontal"), ("防御技術Ｂ", 180, 40, "horizontal")]


def test_handover(spark):
    of = lambda b, i: spark.createDataFrame([(1, i, *b)], "page_id long, ix int, x int, y int, w int, h int").select("page_id", "ix", G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("bbox"))
    kept = lambda a, b: [r["ix"] for r in B.handover(of(a, 0), of(b, 1), 400).collect()]
    assert kept((100, 10, 50, 20), (10, 101, 50, 20)) == [0, 1]
    assert kept((10, 100, 50, 20), (10, 101, 50, 20)) == [0]
    assert kept((100, 200, 200, 200), (100, 200, 200, 400)) == [1]


def test_text_rules(spark):
    get = lambda f, values: [one(spark, f(F.lit(v))) for v in values]
    assert get(T.ascii_form, ["Pokémon 力", "……", "...AWAY. ......"]) == ["Pokemon", "...", "...AWAY. ..."]
    assert get(T.echoes, ["1이르다리고이느", "대한민국매출규모", "One, get up and move!", "", "1"]) == [True, True, False, False, False]
    assert get(T.clean_reply, ["[Untranslatable]", "こんにちは", "STRENGTH: B+ 力"]) == ["", "", "STRENGTH: B+"]
    assert get(T.is_chapter_heading, ["第百五話", "第105話", "第1章", "原作 あずみ圭"]) == [True, True, True, False]
    assert get(T.width_glyphs, ["【給仕 キーマ】", "「あ」"]) == [5, 1]
    assert get(T.mask_key, [" sk-abcdef123456789\n", "　", "short"]) == ["sk-abc…6789", "", "•••••"]
    assert get(T.ascii_share, ["2024 第1話", "!?"]) == [pytest.approx(5 / 7), 0.0]
    assert [json.loads(x) if x else x for x in get(T.json_object, ['```json\n{"a": 1}\n```', 'so: {"b": 2} there', "none", ""])] == [{"a": 1}, {"b": 2}, None, None]
    assert one(spark, T.numbered_reply(F.lit("1. a\n2) “b”\n3: c\n1."), F.lit(3))) == ["a", "b", "c"]
    names = ["b.jpg", "a10.jpg", "10.jpg", "a2.jpg", "9.jpg", "a" + "1" * 45 + ".jpg"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_key(F.col("n"))).collect()
    assert [r["n"] for r in got] == ["9.jpg", "10.jpg", "a2.jpg", "a10.jpg", names[-1], "b.jpg"]


def test_boxes(spark):
    noise = [one(spark, G.is_noise(F.lit(w), F.lit(h), F.lit(c).cast("double"))) for w, h, c in ((39, 42, 0.707), (50, 51, 0.86), (49, 49, 0.949), (63, 58, 0.5), (30, 30, None))]
    assert noise == [True, True, False, False, False]
    tone = [one(spark, G.is_screentone(F.lit(w), F.lit(h), F.lit(c).cast("double"))) for w, h, c in ((48, 80, 0.439), (48, 80, 0.44), (49, 80, 0.1), (48, 79, 0.1), (20, 300, None))]
    assert tone == [True, False, False, False, False]


def test_zone(spark):
    """Times and prices do not move with the session's zone."""
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        now = F.lit("2026-09-17T04:30:00Z").cast("timestamp")
        starts = [one(spark, F.date_format(cost.utc(cost.period_start(p, now, "Australia/Sydney")), "yyyy-MM-dd HH")) for p in cost.PERIODS]
        assert starts == ["2026-09-16 14", "2026-09-13 14", "2026-08-31 14", "2025-12-31 13"]
        assert one(spark, F.unix_timestamp(cost.instant(F.lit("1970-01-02 00:00:00")))) == 86400
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert cost.resolve_zone(None, "No/Where", "Europe/Berlin") == "Europe/Berlin" and cost.resolve_zone("") == "UTC"


def test_retention(spark):
    jobs = spark.createDataFrame([(1, "2026-01-01", "2026-01-20"), (2, "2026-01-19", None), (3, "soon", None)], "id long, created_at string, finished_at string")
    assert sorted(r["id"] for r in store.purge(jobs, F.lit("2026-01-20T00:00:00Z").cast("timestamp")).collect()) == [2, 3]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "book.cbz", "w") as z:
        for name, data in (("p/page-10.jpg", b"ten"), ("p/page-2.JPG", b"two"), ("notes.txt", b"no"), ("q/page-10.jpg", b"later")):
            z.writestr(name, data)
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (tmp_path / "x.png").write_bytes(b"image")
    got = archives.archive_pages(spark, str(tmp_path)).orderBy("index").collect()
    assert [(r["kind"], r["name"], r["index"], bytes(r["content"])) for r in got] == [("cbz", "page-2.JPG", 0, b"two"), ("cbz", "page-10.jpg", 1, b"later")]
    assert [r["name"] for r in archives.images(spark, str(tmp_path)).collect()] == ["x.png"]
    packed = archives.pack(archives.archive_pages(spark, str(tmp_path)).withColumn("job_id", F.lit(1))).first()
    assert zipfile.ZipFile(io.BytesIO(bytes(packed["archive"]))).namelist() == ["page-2.JPG", "page-10.jpg"]
    (tmp_path / "a.log").write_text("\n".join(f"line {i}" for i in range(50)) + "\n")
    assert archives.tail(spark, str(tmp_path / "a.log"), 3).first()["text"] == "line 47\nline 48\nline 49"
    assert {r["name"]: r["size"] for r in archives.files(spark, str(tmp_path / "x.png")).collect()} == {"x.png": 5}


def test_worker(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id": 2, "status": "queued"}\n{"id": 1, "status": "queued"}\n{"id": 3, "status": "done"}\n')
    run = lambda: worker.run_jobs(spark, str(tmp_path / "in"), "id long, status string", lambda rows: rows, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (tmp_path / "in" / "2.json").write_text('{"id": 4, "status": "queued"}\n')
    run()
    assert sorted((r["id"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "running"), (2, "running"), (4, "running")]
