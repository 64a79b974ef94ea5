"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine at least c lie within squared distance 2 - 2c.  A fixed rotation spreads what the vectors have in
common over all coordinates; the coordinates are then split into blocks, each with a share of that budget in proportion to
its dimensions.  A linked pair is within budget in one block at least, so each block is joined on its own: its first two
coordinates lie on a grid twice as wide as the block's radius, a vector lives in one cell and is sent to the neighbouring
cells that its radius reaches (half of them: the other half sends to it).  Pairs within a block's budget are candidates;
each is verified by its cosine in double precision in the first block that proposes it.

Equal vectors of one label are compared once, with their count.  A cell above BLOCK vectors is dealt as pairs of blocks
to tasks of their own; counts of links and a spanning star of them leave a task, never a list of pairs.

Defined results: a vector that is null, empty, zero or has a null or non-finite component, or a null label, links with
nothing, as do vectors of different lengths; rows that share an id count as vectors of their own; an empty table gives an
empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import one_thread
from pagewright.llm.components import components, star_forest
from pagewright.llm.scratch import Scratch

BLOCK = 1_024
#: Dimensions of a block.
WIDTH = 8
#: Added to budgets so that rounding never loses a pair; candidates are verified exactly.
_SLACK = 1e-9


def rotation(d: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _blocks(d: int) -> list[np.ndarray]:
    return np.array_split(np.arange(d), max(1, d // WIDTH))


def _units(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])  # exact, so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cells(budget: float):
    """(label, block, x, y, home, id, vector): where a vector lives in each block, and which further cells its radius reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                turned = _units([vectors[i] for i in own]) @ rotation(int(d))
                for k, block in enumerate(_blocks(int(d))):
                    r = np.sqrt(budget * len(block) / d) + _SLACK
                    c = turned[:, block[:2]] if len(block) > 1 else np.hstack([turned[:, block], np.zeros((len(own), 1))])
                    cell = np.floor(c / (2 * r)).astype(np.int64)
                    low = c - cell * 2 * r  # from the lower border; the upper one is at 2 r
                    right, up, down = low[:, 0] >= r - _SLACK, low[:, 1] >= r - _SLACK, low[:, 1] <= r + _SLACK
                    for at, dx, dy, home in ((np.ones(len(own), bool), 0, 0, 1), (right, 1, 0, 0), (up, 0, 1, 0), (right & up, 1, 1, 0), (right & down, 1, -1, 0)):
                        i = np.flatnonzero(at)
                        take = pa.array(own[i])
                        n = len(i)
                        yield pa.RecordBatch.from_arrays([batch.column(1).take(take), pa.array(np.full(n, k, np.int32)), pa.array(cell[i, 0] + dx), pa.array(cell[i, 1] + dy), pa.array(np.full(n, home, np.int32)), batch.column(0).take(take), batch.column(3).take(take), batch.column(2).take(take)], names=["label", "block", "x", "y", "home", "id", "n", "v"])

    return run


def _verify(budget: float, least: float):
    """(id, links, other): how many vectors a row links with here, and a spanning star of the links (links 0)."""

    def cell(rows: list[tuple], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links (u, v, their counts) of a cell, or between its blocks lo and hi."""
        by: dict[int, list[tuple]] = {}
        for row in rows:
            by.setdefault(len(row[5]), []).append(row)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64))]
        for d, own in by.items():
            x, ids, n = _units([r[5] for r in own]), np.array([r[3] for r in own]), np.array([r[4] for r in own])
            part, home, k = np.array([r[1] for r in own]), np.array([r[2] for r in own]) == 1, own[0][0]
            turned, blocks = x @ rotation(d), _blocks(d)
            # each pair with a resident once: residents of lo with all of hi, and between two blocks visitors of lo with residents of hi
            sides = [(np.flatnonzero(home & (part == lo)), np.flatnonzero(part == hi))]
            if lo < hi:
                sides.append((np.flatnonzero(~home & (part == lo)), np.flatnonzero(home & (part == hi))))
            for left, right in sides:
                for at in range(0, len(left), 256):
                    a = left[at : at + 256]
                    near = np.ones((len(a), len(right)), bool) if lo < hi else ~home[right][None] | (right[None] > a[:, None])
                    for j in range(k + 1):  # k is the first block whose budget the pair keeps
                        y = turned[:, blocks[j]]
                        dist = (y[a] ** 2).sum(1)[:, None] + (y[right] ** 2).sum(1)[None] - 2 * y[a] @ y[right].T
                        keeps = dist <= budget * len(blocks[j]) / d + _SLACK
                        near &= keeps if j == k else ~keeps
                    i, j = np.nonzero(near)
                    i, j = a[i], right[j]
                    ok = np.einsum("ij,ij->i", x[i], x[j]) >= least
                    i, j = i[ok], j[ok]
                    out.append((ids[i], ids[j], np.stack([n[i], n[j]], 1)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def told(groups: list[tuple[list[tuple], int, int]]) -> pa.RecordBatch:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for rows, lo, hi in groups:
            if len(rows) < 2:
                continue
            u, v, n = cell(rows, lo, hi)
            if not len(u):
                continue
            ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            links = np.bincount(at, weights=np.concatenate([n[:, 1], n[:, 0]])).astype(np.int64)
            node, root = star_forest(u, v)
            out.append((np.concatenate([ids, node]), np.concatenate([links, np.zeros(len(node), np.int64)]), np.concatenate([ids, root])))
        a, b, c = (np.concatenate([np.zeros(0, np.int64), *[x[i] for x in out]]) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["id", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        held, key = [], None  # one cell, or a pair of blocks of it
        for batch in batches:  # sorted by the cell
            full: list[tuple[list[tuple], int, int]] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:6] != key and held:
                    full.append((held, *key[4:]))
                    held = []
                key = row[:6]
                held.append((row[1], row[6], *row[7:]))
            if full:
                yield told(full)
        if held:
            yield told([(held, *key[4:])])

    return run


def embedding_dedup(vectors: DataFrame, least: float = 0.98, vector: str = "embedding", label: str = "label", id_: str = "vec_id") -> DataFrame:
    """id_, n_links, component_id, one row for each row of vectors."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    budget = 2 - 2 * least
    rows = scratch.cut(vectors.select(F.col(id_).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v")))
    whole = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    valid = rows.where(F.col("label").isNotNull() & whole)
    distinct = scratch.cut(valid.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("rep is not null"))
    cells = scratch.cut(distinct.select(F.col("rep").alias("id"), "label", "v", "n").mapInArrow(_cells(budget), "label string, block int, x long, y long, home int, id long, n long, v array<float>" if "float" in dict(vectors.dtypes)[vector] else "label string, block int, x long, y long, home int, id long, n long, v array<double>"))
    key = ["label", "block", "x", "y"]
    large = scratch.cut(cells.groupBy(*key).count().where(F.col("count") > BLOCK).select(*key, F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")))
    dealt = cells.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    dealt = dealt.select(*key, "lo", "hi", F.col("own").alias("part"), "home", "id", "n", "v")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(shards, *key, "lo", "hi").sortWithinPartitions(*key, "lo", "hi", "id", "home")
    found = scratch.cut(sorted_.mapInArrow(_verify(budget, least), "id long, links long, other long"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.where("id <> other").select(F.col("id").alias("u"), F.col("other").alias("v")))
    reps = distinct.select("label", "v", "rep", "n").join(counts, distinct["rep"] == counts["id"], "left").drop("id").join(roots, F.col("rep") == F.col("node"), "left")
    reps = scratch.cut(reps.select(F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    out = rows.join(reps, (rows["label"] == reps["l"]) & (rows["v"] == reps["w"]), "left")
    # vectors that link with nothing are in no group of equal ones
    scratch.drop(cells, large)
    return out.select(F.col("id").alias(id_), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
