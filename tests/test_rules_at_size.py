"""Rules that were made cheaper: equal to their plain reading, and computed once a row."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.operators import lettering
from pagewright.plans import page_queries, pixel_queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quad_angle_once(spark):
    """The corners are put together once for the angle and once for the box."""
    assert plan(page_queries.quad_angle(spark, SF)).count("array(struct(x, ") <= 2


def test_quad_angle(spark):
    rows = [(1, [(0, 0), (10, 10), (5, 15), (-5, 5)]), (2, [(0, 0), (0, 9), (4, 9), (4, 0)]), (3, [(1, 1)]), (4, None), (5, [(0, 0), (-10, 3), (-11, 1), (-1, -2)])]
    df = spark.createDataFrame(rows, "id int, p array<struct<x:int,y:int>>").orderBy("id")
    got = df.select(F.round(G.quad_angle(F.col("p")), 6).alias("a"), G.polygon_box(F.col("p")).alias("b")).collect()
    assert [r["a"] for r in got] == [45.0, 0.0, 0.0, None, pytest.approx(-16.699244)]
    assert [r["b"] and tuple(r["b"]) for r in got[:4]] == [(-5, 0, 15, 15), (0, 0, 4, 9), (1, 1, 0, 0), (None,) * 4]


def test_verdicts_stay_in_the_jvm(spark):
    assert "Python" not in plan(pixel_queries.caption_verdicts(spark, SF))
    assert plan(page_queries.caption_candidates(spark, SF)).lower().count("regexp_replace") <= 1


def test_unusable(spark):
    """Every character: nothing of a reply is left where its ASCII form is empty."""
    chars = [chr(i) for i in itertools.chain(range(1, 0x3400), range(0xA000, 0xAC10), range(0xD7A0, 0xD800), range(0xF900, 0x11000), range(0x1D400, 0x1D800), range(0x1F100, 0x1F300), range(0x2F800, 0x2F810))]
    texts = [*chars, "á", " 　", "", None, "[Untranslatable]", "x Illegible", "İllegible", "GARBLED text", "garbled  text"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wrong = df.where(T.is_unusable(F.col("t")) != (T.clean_reply(F.col("t")) == ""))
    assert [r["t"] for r in wrong.collect()] == []


def test_credits_and_refusals(spark):
    texts = [None, "", "原作 x", "(C) y", "(c", "CopyRight", "isbn 3", "İSBN", "翻訳", "a★", "キャラクター原案", "[Unable to Translate]", "GIBBERISH", "ocr  corruption"]
    plain = lambda t, marks: any(m.lower() in (t or "").lower() for m in marks)
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.has_credit(F.col("t")).alias("c"), T.is_refusal(F.col("t")).alias("r")).orderBy("i").collect()
    assert [(r["c"], r["r"]) for r in got] == [(plain(t, T.CREDITS), plain(t, T.REFUSALS)) for t in texts]


def test_few_breaks_as_many(monkeypatch):
    rng = np.random.default_rng(9)
    for _ in range(500):
        n, room = int(rng.integers(2, 14)), float(rng.integers(1, 90))
        words, joints = rng.integers(1, 60, n).astype(float), rng.random(n - 1) * 5 - 1
        monkeypatch.setattr(lettering, "FEW", 48)
        few = lettering.best_breaks(words, joints, room)
        monkeypatch.setattr(lettering, "FEW", 0)
        assert few == lettering.best_breaks(words, joints, room)


def test_pieces(spark):
    """Words are cut in Python as the column rule cuts them, and texts into words."""
    draw = random.Random(10)
    words = ["".join(draw.choice("ab-.．…é") for _ in range(draw.randrange(8))) for _ in range(400)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", lettering.word_parts(F.col("w")).alias("p")).collect()
    assert [(r["w"], r["p"]) for r in got] == [(w, lettering.pieces(w)) for w in words]
    spaced = "a\x85b\xa0c　d\x1ce᠎f  g\n"
    df = spark.createDataFrame([(spaced, 1000.0)], "text string, room double")
    assert lettering.wrap(df, lambda t: 1.0).first()["lines"] == ["a b c d\x1ce᠎f g"]
    assert "split" not in plan(lettering.wrap(df, lambda t: 1.0))
