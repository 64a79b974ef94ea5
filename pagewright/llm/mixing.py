"""Mixing sources to target weights by the cube method.

A source with target r times its size takes each document floor(r) times; the fractional rest of r is an inclusion
probability that the cube method turns into 0 or 1: it moves the probabilities along the null space of two constraints
(documents and words) until each move has fixed one of three documents.  Blocks of a source run side by side; each leaves
at most two undecided documents, which meet in ever fewer blocks of the same fan-in.  What is left at the end, two
documents of a source at most, is the landing problem: of the four ways to decide them the one with least error in words.

Random numbers come from a hash of (seed, id, size) and blocks from a hash of the id, so reruns agree whatever the partitioning.

Defined results: a null or empty text has size 0 and is taken floor(r) or floor(r)+1 times 0 words; a source whose words
are all 0 has target 0; a null source is a source of its own; repeated rows are units of their own; an empty table gives
an empty table; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import table
from pagewright.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a block on the first pass, and undecided documents of a block on later passes.
BLOCK = 512
_EPS = 1e-9


def words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target of each source: share of all sizes by weight, none above most times its own size, the excess reshared.

    Sources go by code point, null last; weights repeat in that order.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, out, free = share * sum(size.values()), {}, list(size)
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > most * size[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: most * float(size[s]) for s in full}
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in full]
    return out


def _flight(p: list[float], z: list[float], u: list[float]) -> list[float]:
    """Moves p along the null space of (1, z) until at most two are strictly between 0 and 1; u has three random numbers a unit."""
    window, k, n, x = [], 0, len(p), 0
    while True:
        window = [i for i in window if _EPS < p[i] < 1 - _EPS]
        while len(window) < 3 and k < n:
            if _EPS < p[k] < 1 - _EPS:
                window.append(k)
            k += 1
        if len(window) < 2 or len(window) == 2 and z[window[0]] != z[window[1]]:
            return p
        if len(window) == 3:
            a, b, c = window
            move = [z[c] - z[b], z[a] - z[c], z[b] - z[a]]
            if not any(move):
                move = [1.0, -1.0, 0.0]
        else:
            move = [1.0, -1.0]
        up = min((1 - p[i]) / m if m > 0 else -p[i] / m for i, m in zip(window, move, strict=True) if m)
        down = min(p[i] / m if m > 0 else (p[i] - 1) / m for i, m in zip(window, move, strict=True) if m)
        step = up if u[x % len(u)] * (up + down) < down else -down
        x += 1
        for i, m in zip(window, move, strict=True):
            q = p[i] + step * m
            p[i] = 0.0 if q < _EPS else 1.0 if q > 1 - _EPS else q


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["h", "id", "size"], kind="stable")
    u = ((pdf["h"].to_numpy().astype("uint64") >> np.uint64(11)) * 2.0**-53).tolist()
    return pdf.assign(p=_flight(pdf["p"].tolist(), pdf["size"].astype(float).tolist(), u))


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    """Decides what the last flight leaves: the four ways are tried, least error in words first, then in documents."""
    pdf = _block(pdf)
    p, z = pdf["p"].to_numpy().copy(), pdf["size"].to_numpy().astype(float)
    rest = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    if len(rest):
        ways = [[(w >> i) & 1 for i in range(len(rest))] for w in range(1 << len(rest))]
        p[rest] = min(ways, key=lambda w: (abs(float(np.dot(np.array(w) - p[rest], z[rest]))), abs(sum(w) - p[rest].sum()), w))
    return pdf.assign(p=p)


def mix(docs: DataFrame, text: str = "text", id_: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """id_, size, source_size, target, copies and taken = copies * size, one row for each row of docs.

    The driver holds one number for each source, as the weights need the rank of every source.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.cut(docs.select(F.col(id_).alias("id"), F.col(source).alias("source"), words(F.col(text)).alias("size")))
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")).collect()
    target = targets([(r["source"], r["source_size"]) for r in found], weights, share, most)
    ratio = {r["source"]: target[r["source"]] / r["source_size"] if r["source_size"] else 0.0 for r in found}
    plan = [(r["source"], r["source_size"], target[r["source"]], int(ratio[r["source"]] + _EPS), max(0.0, ratio[r["source"]] - int(ratio[r["source"]] + _EPS)), -(-r["rows"] // BLOCK)) for r in found]
    kinds = {"s": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "whole": pa.int32(), "p": pa.float64(), "blocks": pa.int64()}
    plan_df = table(docs.sparkSession, **{k: pa.array([x[i] for x in plan], kind) for i, (k, kind) in enumerate(kinds.items())})
    known = sized.join(F.broadcast(plan_df), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")  # one row for each source
    known = known.withColumn("h", F.xxhash64(F.lit(seed), "id", "size")).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "id", "size"), "blocks"))
    schema = "id long, source string, size long, source_size long, target double, whole int, p double, blocks long, h long, block long"
    known = known.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")])

    blocks, done = max([1, *(x[-1] for x in plan)]), []
    open_ = known
    while blocks > 1:
        moved = scratch.cut(open_.groupBy("source", "block").applyInPandas(_block, schema))
        done.append(moved.where((F.col("p") <= _EPS) | (F.col("p") >= 1 - _EPS)))
        blocks = -(-blocks // (BLOCK // 2))
        open_ = moved.where((F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)).withColumn("block", F.floor(F.col("block") / (BLOCK // 2)))
    done.append(open_.groupBy("source").applyInPandas(_land, schema))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.round("p").cast("int")).cast("int")
    return out.select(F.col("id").alias(id_), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
