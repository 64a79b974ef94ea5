"""SimHash near-duplicates: fingerprints in vantage-point trees, linked at a few differing bits.

A fingerprint has a bit for each of 64, set where more than half the hashes of the text's shingles have it.

Search.  Distinct fingerprints only are compared.  A tree holds a vantage point and a distance at each node; a fingerprint
x lives on the near side if d(x, vantage) <= cut, else on the far side, and is also sent over the border wherever the
triangle bound cannot exclude a partner within the radius (``cut - radius < d <= cut + radius``).  A leaf is a shard; what
lives there is compared exactly with all that reached it.

Distances of unrelated 64-bit fingerprints lie within a few bits of each other, so one tree with radius 4 prunes little
(work grows as about N^1.75).  The default is therefore a forest: each tree measures distance on a block of bits of its
own, and radii are chosen so that a pair at 4 bits must be within the radius in one block at least (five trees: radius 0).
``trees=1`` gives the plain tree; results are equal, which the tests check.

Shards above BLOCK fingerprints are compared block against block in tasks of their own, all pairs of blocks, so no case is
dropped.  Within a task, links become a spanning star at once; no pair list leaves it.

Defined results: a null or empty text has fingerprint zero and is linked like any other; rows that share an id share its
links; the component of a row with null id is the smallest id in reach, null if there is none; an empty table gives an
empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import binary, pieces, small_batches
from pagewright.llm.components import components, star_forest
from pagewright.llm.scratch import Scratch

#: Fingerprints on which the trees are fitted, those of least hash; all of them are then indexed.
SAMPLE = 16_384
#: Fingerprints of a shard, or of a block of a larger shard, that are compared at once.
BLOCK = 2_048
#: Sampled fingerprints below which a node is a leaf.
LEAF = 4
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a UTF-8 text, repeats included; none for a text without words."""
    words = text.lower().split()  # of bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-shingle] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def majority(found: np.ndarray) -> int:
    """A bit for each of 64, set where over half the hashes have it."""
    if not len(found):
        return 0
    seen = found.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(seen) < 256:
        ones = np.unpackbits(seen, axis=1).sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(seen[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(seen)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int) -> int:
    """Fingerprint of a UTF-8 text, unsigned."""
    return majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id and fp (the fingerprint's bits as a signed long), one row for each row of docs."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            fp = np.array([fingerprint(t, shingle) for t in binary(batch.column(1)).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, fp long")


class Tree:
    """A vantage-point tree over the bits of mask, as arrays; leaves are numbered."""

    def __init__(self, sample: np.ndarray, mask: int, radius: int, seed: int, deepest: int = 13):
        self.mask, self.radius = np.uint64(mask), radius
        self.point, self.cut, self.kids, self.leaf = [], [], [], []
        self.rng, self.leaves = np.random.default_rng(seed), 0
        self._grow(sample & self.mask, deepest)
        self.point, self.cut, self.kids, self.leaf = np.array(self.point, np.uint64), np.array(self.cut, np.int64), np.array(self.kids, np.int64).reshape(-1, 2), np.array(self.leaf, np.int64)
        del self.rng

    def _grow(self, own: np.ndarray, deepest: int) -> int:
        at = len(self.point)
        self.point.append(0), self.cut.append(0), self.kids.append((-1, -1)), self.leaf.append(-1)
        if deepest and len(own) >= 2 * LEAF:
            for _ in range(3):  # a vantage point that splits
                point = self.rng.integers(0, 1 << 64, dtype=np.uint64) & self.mask
                d = np.bitwise_count(own ^ point).astype(np.int64)
                cut = int(np.median(d))
                cut -= abs(np.mean(d < cut) - 0.5) < abs(np.mean(d <= cut) - 0.5)
                near = d <= cut
                if 0 < near.sum() < len(own):
                    self.point[at], self.cut[at] = point, cut
                    self.kids[at] = (self._grow(own[near], deepest - 1), self._grow(own[~near], deepest - 1))
                    return at
        self.leaf[at] = self.leaves
        self.leaves += 1
        return at

    def route(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into fp, leaf, whether it lives there) for every leaf that a partner within the radius may live in."""
        at, home, node, out = np.arange(len(fp)), np.ones(len(fp), bool), np.zeros(len(fp), np.int64), []
        while len(at):
            leaf = self.leaf[node]
            out.append((at[leaf >= 0], leaf[leaf >= 0], home[leaf >= 0]))
            at, home, node = at[leaf < 0], home[leaf < 0], node[leaf < 0]
            d = np.bitwise_count((fp[at] ^ self.point[node]) & self.mask).astype(np.int64) - self.cut[node]
            near, far = d <= self.radius, d > -self.radius
            at, home, node = np.concatenate([at[near], at[far]]), np.concatenate([(home & (d <= 0))[near], (home & (d > 0))[far]]), np.concatenate([self.kids[node, 0][near], self.kids[node, 1][far]])
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def forest(sample: np.ndarray, bits: int, trees: int, seed: int = 7) -> list[Tree]:
    """Trees over disjoint blocks of the 64 bits whose radii leave no pair within ``bits`` bits out: sum(radius + 1) > bits."""
    place = np.random.default_rng(seed).permutation(64)
    radii = [(bits + 1) // trees - 1 + (i < (bits + 1) % trees) for i in range(trees)]
    radii = [r for r in radii if r >= 0]
    blocks = np.array_split(place, len(radii))
    return [Tree(sample, sum(1 << int(b) for b in block), r, seed + i) for i, (block, r) in enumerate(zip(blocks, radii, strict=True))]


def near_links(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star (node, root) of the links between a and b at ``bits`` bits or fewer."""
    us, vs = [], []
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= bits)
        us.append(a[at + i])
        vs.append(b[j])
        if sum(map(len, us)) > 1_000_000:
            u, v = star_forest(np.concatenate(us), np.concatenate(vs))
            us, vs = [u], [v]
    u, v = np.concatenate(us), np.concatenate(vs)
    off = u != v
    return star_forest(u[off], v[off]) if off.any() else (u[:0], v[:0])


def _shard(tab: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task: rows of (part, home, fp); part 0 and 1 are the two blocks, which may be one."""
    fp = tab[:, 2].view(np.uint64)
    home = fp[tab[:, 1] == 1]
    other = fp[tab[:, 1] == 0]
    return near_links(home, np.concatenate([home, other]), bits)


def _compare(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 4), np.int64)

        def links(tab: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(np.diff(tab[:, 0])) + 1
            got = [_shard(x[:, 1:].copy(), bits) for x in np.split(tab, at) if len(x) > 1]
            u = np.concatenate([np.zeros(0, np.uint64), *[x[0] for x in got]]).view(np.int64)
            v = np.concatenate([np.zeros(0, np.uint64), *[x[1] for x in got]]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:  # sorted by key
            if not batch.num_rows:
                continue
            tab = np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns], 1)])
            last = int(np.searchsorted(tab[:, 0], tab[-1, 0]))
            if last:
                yield links(tab[:last])
            rest = tab[last:]
        if len(rest):
            yield links(rest)

    return run


def _routing(trees: list[Tree], large: dict[tuple[int, int], int] | None):
    """Rows (key, part, home, fp); with large (blocks of each shard that has several), those shards are dealt as pairs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k, tree in enumerate(trees):
                at, leaf, home = tree.route(fp)
                n = np.array([(large or {}).get((k, x), 1) for x in leaf.tolist()], np.int64) if large else np.ones(len(leaf), np.int64)
                block = ((fp[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % n
                rep = np.repeat(np.arange(len(at)), n)
                other = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
                own = block[rep]
                low, high = np.minimum(own, other), np.maximum(own, other)
                key = ((np.int64(k) << 58) | (leaf[rep] << 40) | (low << 20) | high).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(rep), np.int64)), pa.array(home[rep].astype(np.int64)), pa.array(fp[at][rep].view(np.int64))], names=["key", "part", "home", "fp"])

    return run


def near_components(fps: DataFrame, bits: int = 4, trees: int = 5) -> DataFrame:
    """fps: id, fp.  Returns fp, component_id (smallest id in reach) for every distinct fp."""
    spark, scratch = fps.sparkSession, Scratch(fps.sparkSession)
    distinct = scratch.cut(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    sample = np.array([r[0] for r in distinct.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    grown = forest(sample, bits, trees)
    routed = distinct.select("fp").mapInArrow(_routing(grown, None), "key long, part long, home long, fp long")
    counts = routed.where("home = 1").groupBy("key").count().where(F.col("count") > BLOCK).collect()  # at most the trees' leaves
    large = {(r[0] >> 58, (r[0] >> 40) & 0x3FFFF): -(-r[1] // BLOCK) for r in counts}
    dealt = distinct.select("fp").mapInArrow(_routing(grown, large), "key long, part long, home long, fp long")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = scratch.cut(dealt.repartition(shards, "key").sortWithinPartitions("key").mapInArrow(_compare(bits), "u long, v long"))  # else tasks run two workers each
    joined = scratch.cut(components(links))
    known = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    known = scratch.cut(known)
    roots = scratch.cut(known.groupBy("root").agg(F.min("rep").alias("component_id")))
    out = scratch.cut(known.join(roots, "root").select("fp", "component_id"))
    scratch.drop(distinct, links, joined, known, roots)
    return out


def simhash_dedup(docs: DataFrame, shingle: int = 4, bits: int = 4, trees: int = 5, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id_, fp (signed long), component_id, one row for each row of docs."""
    scratch = Scratch(docs.sparkSession)
    fps = scratch.cut(fingerprints(docs, shingle, text, id_))
    return fps.join(near_components(fps, bits, trees), "fp", "left").select(F.col("id").alias(id_), "fp", "component_id")
