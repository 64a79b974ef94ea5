"""Removal of passages that an earlier document has, by suffix sorting of what repeats.

A byte goes if a string of WINDOW bytes that covers it also starts in a document with a smaller id.

1. Exact copies of a whole text are found by hash; only the first of each group goes on.  The others are removed whole.
2. Anchors: in every window the run of GRAM bytes with least hash.  Equal windows have equal anchors, so an anchor that
   one document alone has needs no more work.  Buckets of documents send their distinct anchors, shards of anchors answer
   which are in two documents or more.
3. Around each such anchor a bucket sends the distinct snippets that hold all windows of the anchor; a shard sorts the
   suffixes of the snippets that share anchors but differ (``gsaca``), reads equal windows off neighbouring suffixes and
   answers with a bit for each window that an earlier document has.
4. Anchors in more than HOT documents (a passage that a third of all documents share has different surroundings in each)
   would bring unbounded groups together.  Their windows go by a 128-bit hash of their bytes instead, the smallest id of
   each bucket only, which spreads what differs and combines what is equal.

What moves is packed in arrays, one row for each pair of bucket and shard.  Texts move once, into a table bucketed by id
that all passes read without a further exchange.

Defined results: a null text is empty; rows that share an id don't remove each other's bytes; a row with null id counts as
later than all others; texts under WINDOW bytes lose nothing; an empty table gives an empty table; other columns are never
read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import binary
from pagewright.llm.gsaca import suffix_array
from pagewright.llm.scratch import Scratch

WINDOW, GRAM = 50, 24
#: Starts of windows that can share an anchor; bytes of a snippet: those before and from the anchor on.
REACH = WINDOW - GRAM + 1
#: Ranges of the place of the gram in a window, each of which has a test of its own before sorting.
STEPS = 4
LEFT, SNIP = REACH - 1, REACH - 1 + WINDOW
HOT = 256
#: Bytes that are scanned at once, and snippets that are sorted at once.
CHUNK, SORTED = 1 << 18, 500
BUCKET_BYTES = 8 << 20
_NO_ID = (1 << 63) - 1
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_ENTRY = np.dtype([("low", "<u4"), ("doc", "<i8"), ("l", "u1"), ("r", "u1"), ("snip", f"V{SNIP}")])
_WINDOWED = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8")])
_ANSWER = np.dtype([("low", "<u4"), ("hot", "u1")])


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of width."""
    have, out = 1, x
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


class Scan:
    """Anchors of some texts put end to end."""

    def __init__(self, texts: list[bytes], shards: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(b"".join(texts) + bytes(SNIP), np.uint8)
        n = int(self.start[-1])
        h = _TABLE[self.data]
        for i, have in enumerate((1, 2, 4)):
            h = h[:-have] * _TIMES[i] + h[have:]
        h = (h[:-16] * _TIMES[3] + h[8:-8]) * _TIMES[3] + h[16:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        self.hash = h
        lows = _slide(h, REACH, np.minimum)[:n]
        edge = np.zeros(n + 1, np.int64)
        long = sizes >= WINDOW
        np.add.at(edge, self.start[:-1][long], 1)
        np.add.at(edge, self.start[1:][long] - WINDOW + 1, -1)
        self.valid = np.cumsum(edge[:n]) > 0
        self.low = np.where(self.valid, lows, np.uint64(0))
        back = np.concatenate([np.zeros(REACH - 1, np.uint64), self.low])
        most = _slide(back, REACH, np.maximum) if n else back[:0]
        self.at = np.flatnonzero((most == h[:n]) & (most > 0))
        self.key = self.keys(h[self.at], shards)
        self.doc = np.searchsorted(self.start, self.at, side="right") - 1

    @staticmethod
    def keys(h: np.ndarray, shards: int) -> np.ndarray:
        """Shard in the upper half, what tells anchors of a shard apart in the lower."""
        return ((h >> np.uint64(32)) % np.uint64(shards)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))

    def snippets(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Entries (without ids) of anchors; bytes beyond the text are zero."""
        out = np.zeros(len(at), _ENTRY)
        left = np.minimum(at - self.start[doc], LEFT)
        right = np.minimum(self.start[doc + 1] - at, WINDOW)
        place = np.arange(SNIP) - LEFT
        inside = (place[None] >= -left[:, None]) & (place[None] < right[:, None])
        got = self.data[np.clip(at[:, None] + place[None], 0, len(self.data) - 1)] * inside
        out["l"], out["r"], out["snip"] = left, right, np.ascontiguousarray(got.astype(np.uint8)).view(f"V{SNIP}")[:, 0]
        return out

    def windows(self, at: np.ndarray) -> np.ndarray:
        """Starts of the windows whose least hash is that of an anchor at one of these places, without repeats."""
        starts = (at[:, None] - np.arange(REACH)[None]).ravel()
        own = np.repeat(self.hash[at], REACH)
        ok = (starts >= 0) & (self.low[np.maximum(starts, 0)] == own)
        return np.unique(starts[ok])

    def content(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of hash of each window's bytes."""
        parts = [self.hash[starts + o] for o in (0, GRAM, WINDOW - GRAM)]
        a, b = parts[0].copy(), parts[2].copy()
        for p, q in zip(parts[1:], parts[1::-1], strict=True):
            a = (a ^ (a >> np.uint64(31))) * _TIMES[0] + p
            b = (b ^ (b >> np.uint64(29))) * _TIMES[1] + q
        return a, b


class Bucket:
    """Documents of a bucket in scans; copies of earlier texts are left out."""

    def __init__(self, left: pa.Table, right: pa.Table | None, shards: int):
        self.shards = shards
        self.id = left.column("id").to_numpy()
        self.texts = binary(left.column("text").combine_chunks()).to_pylist()
        kind, shard = (right.column("kind").to_numpy(), right.column("shard").to_numpy()) if right is not None else (np.zeros(0), np.zeros(0))
        self.blobs = {(k, s): b for k, s, b in zip(kind.tolist(), shard.tolist(), right.column("blob").to_pylist(), strict=True)} if right is not None else {}
        copies = np.sort(np.frombuffer(self.blobs.get((0, 0), b""), "<i8"))
        self.copy = np.isin(self.id, copies)
        answers = [(s, np.frombuffer(b, _ANSWER)) for (k, s), b in sorted(self.blobs.items()) if k == 1]
        keys = [np.uint64(s) << np.uint64(32) | a["low"].astype(np.uint64) for s, a in answers]
        self.repeated = np.concatenate([np.zeros(0, np.uint64), *keys])
        self.hot = np.concatenate([np.zeros(0, np.uint8), *[a["hot"] for _, a in answers]])  # both in order of keys

    def scans(self) -> Iterator[tuple[np.ndarray, Scan]]:
        own, size = [], 0
        for i in np.flatnonzero(~self.copy).tolist():
            if len(self.texts[i]) < WINDOW:
                continue
            if own and size + len(self.texts[i]) > CHUNK:
                yield np.array(own), Scan([self.texts[k] for k in own], self.shards)
                own, size = [], 0
            own.append(i)
            size += len(self.texts[i])
        if own:
            yield np.array(own), Scan([self.texts[k] for k in own], self.shards)

    def found(self, scan: Scan) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the scan's anchors that repeat: the common ones, the hot ones."""
        if not len(self.repeated):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.repeated, scan.key), len(self.repeated) - 1)
        yes, hot = self.repeated[at] == scan.key, self.hot[at] > 0
        return np.flatnonzero(yes & ~hot), np.flatnonzero(yes & hot)


def _table(bucket: list, kind: list, shard: list, blob: list) -> pa.Table:
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "kind": pa.array(kind, pa.int32()), "shard": pa.array(shard, pa.int32()), "blob": pa.array(blob, pa.binary())})


_BLOBS = "bucket int, kind int, shard int, blob binary"


def _by_shard(keys: np.ndarray) -> list[tuple[int, slice]]:
    """Shards of sorted keys with their rows."""
    shard = (keys >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.diff(shard)) + 1
    return [(int(shard[a]), slice(int(a), int(b))) for a, b in zip([0, *at], [*at, len(keys)], strict=True)] if len(keys) else []


def _send_anchors(shards: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        """Distinct anchors of a bucket with the number of documents that have them."""
        if not left.num_rows:
            return _table([], [], [], [])
        own = Bucket(left, right, shards)
        pairs = [np.unique(np.stack([s.key, docs[s.doc].astype(np.uint64)], 1).view("V16")) for docs, s in own.scans()]
        flat = np.concatenate([np.zeros((0, 2), np.uint64), *[p.view(np.uint64).reshape(-1, 2) for p in pairs]])
        keys, n = np.unique(flat[:, 0], return_counts=True)
        n = np.minimum(n, 60_000).astype("<u2")
        out = [(s, keys[at].astype("<u4").tobytes() + n[at].tobytes()) for s, at in _by_shard(keys)]
        return _table([key[0].as_py()] * len(out), [1] * len(out), [s for s, _ in out], [b for _, b in out])

    return run


def _answer_anchors(hot: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Which anchors of a shard are in two documents or more, to each bucket that has them."""
        blobs = [(b, np.frombuffer(x, "<u4", len(x) // 6), np.frombuffer(x, "<u2", len(x) // 6, len(x) // 6 * 4)) for b, x in zip(rows.column("bucket").to_pylist(), rows.column("blob").to_pylist(), strict=True)]
        keys, at = np.unique(np.concatenate([k for _, k, _ in blobs]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([c for _, _, c in blobs]).astype(float))
        out, begin = [], 0
        for bucket, own, _ in blobs:
            total = n[at[begin : begin + len(own)]]
            begin += len(own)
            told = np.zeros(int((total >= 2).sum()), _ANSWER)
            told["low"], told["hot"] = own[total >= 2], (total > hot)[total >= 2]
            if len(told):
                out.append((bucket, told.tobytes()))
        shard = key[0].as_py()
        return _table([b for b, _ in out], [1] * len(out), [shard] * len(out), [x for _, x in out])

    return run


def _entries(own: Bucket) -> tuple[list, list, list, list]:
    """Snippets of the common anchors and windows of the hot ones, scan by scan.

    ([(documents, scan, anchors)], their snippets, their documents' ids, [(documents, scan, starts, document, hash, hash)])
    """
    metas, raws, ids, wins = [], [], [], []
    for docs, scan in own.scans():
        common, hot = own.found(scan)
        if len(common):
            e = scan.snippets(scan.at[common], scan.doc[common])
            raw = np.zeros(len(e), np.dtype([("key", ">u8"), ("l", "u1"), ("r", "u1"), ("snip", f"V{SNIP}")]))
            raw["key"], raw["l"], raw["r"], raw["snip"] = scan.key[common], e["l"], e["r"], e["snip"]
            raws.append(raw.view(f"V{raw.dtype.itemsize}"))
            ids.append(own.id[docs[scan.doc[common]]])
            metas.append((docs, scan, common))
        if len(hot):
            starts = scan.windows(scan.at[hot])
            a, b = scan.content(starts)
            wins.append((docs, scan, starts, np.searchsorted(scan.start, starts, side="right") - 1, a, b))
    return metas, raws, ids, wins


def _distinct(raws: list, ids: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, entries, which entry each occurrence is); entries in order of key and contents, with their smallest id."""
    kind = np.dtype([("key", ">u8"), ("l", "u1"), ("r", "u1"), ("snip", f"V{SNIP}")])
    if not raws:
        return np.zeros(0, np.uint64), np.zeros(0, _ENTRY), np.zeros(0, np.int64)
    rows, at = np.unique(np.concatenate(raws), return_inverse=True)
    rows = rows.view(kind)
    out = np.zeros(len(rows), _ENTRY)
    out["l"], out["r"], out["snip"], out["low"] = rows["l"], rows["r"], rows["snip"], (rows["key"].astype(np.uint64) & np.uint64(0xFFFFFFFF)).astype("<u4")
    doc = np.full(len(rows), _NO_ID, np.int64)
    np.minimum.at(doc, at, np.concatenate(ids))
    out["doc"] = doc
    return rows["key"].astype(np.uint64), out, at


def _distinct_windows(own: Bucket, wins: list) -> tuple[np.ndarray, np.ndarray]:
    """(rows in order of contents with their smallest id, which row each start is)."""
    if not wins:
        return np.zeros(0, _WINDOWED), np.zeros(0, np.int64)
    ab = np.stack([np.concatenate([w[4] for w in wins]), np.concatenate([w[5] for w in wins])], 1)
    rows, at = np.unique(ab.astype(">u8").view("V16")[:, 0], return_inverse=True)
    rows = rows.view(">u8").reshape(-1, 2)
    out = np.zeros(len(rows), _WINDOWED)
    doc = np.full(len(rows), _NO_ID, np.int64)
    np.minimum.at(doc, at, np.concatenate([own.id[w[0][w[3]]] for w in wins]))
    out["a"], out["b"], out["doc"] = rows[:, 0], rows[:, 1], doc
    return out, at


def _window_shards(rows: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """(order by shard, shards with their places in that order)."""
    shard = (rows["a"] >> np.uint64(20)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    return order, _by_shard(shard[order] << np.uint64(32))


def _send_snippets(shards: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], [], [], [])
        own = Bucket(left, right, shards)
        _, raws, ids, wins = _entries(own)
        keys, entries, _ = _distinct(raws, ids)
        out = [(2, s, entries[at].tobytes()) for s, at in _by_shard(keys)]
        rows, _ = _distinct_windows(own, wins)
        order, split = _window_shards(rows, shards)
        out += [(3, s, rows[order[at]].tobytes()) for s, at in split]
        return _table([key[0].as_py()] * len(out), [k for k, _, _ in out], [s for _, s, _ in out], [b for _, _, b in out])

    return run


def _sorted_windows(low: np.ndarray, snip: np.ndarray, l_: np.ndarray, r_: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A bit for each offset of each snippet whose window an entry with a smaller id has; by suffix sorting.

    All windows of a snippet hold its whole gram, which goes as one symbol, so equal windows stay equal and others differ.
    """
    n = len(low)
    _, gram = np.unique(np.ascontiguousarray(snip[:, LEFT : LEFT + GRAM]).view(f"V{GRAM}")[:, 0], return_inverse=True)
    text = np.ones((n, SNIP - GRAM + 2), np.int64)
    text[:, :LEFT] = snip[:, :LEFT].astype(np.int64) + 2
    text[:, LEFT] = gram + 258
    text[:, LEFT + 1 : -1] = snip[:, LEFT + GRAM :].astype(np.int64) + 2
    order = np.array(suffix_array([*text.ravel().tolist(), 0]))
    v, t = order // text.shape[1], order % text.shape[1]
    ok = (v < n) & (t < REACH)
    v, t = v[ok], t[ok]
    o = LEFT - t
    ok = (o <= l_[v]) & (WINDOW - o <= r_[v])
    v, t, o = v[ok], t[ok], o[ok]
    mask = np.zeros(n, np.uint64)
    if not len(v):
        return mask
    seen = np.lib.stride_tricks.sliding_window_view(snip, WINDOW, axis=1)
    rows = np.ascontiguousarray(seen[v, t])
    begin = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])
    first = np.minimum.reduceat(doc[v], np.flatnonzero(begin))[np.cumsum(begin) - 1]
    hit = first < doc[v]
    np.bitwise_or.at(mask, v[hit], np.uint64(1) << o[hit].astype(np.uint64))
    return mask


def _alike(low: np.ndarray, snip: np.ndarray) -> np.ndarray:
    """Snippets that can share a window with another of their anchor.

    A shared window has k bytes before the gram and the rest behind it; for k in each of STEPS ranges, what all of them need agrees.
    """
    out = np.zeros(len(low), bool)
    key = np.ascontiguousarray(low.astype(">u4")).view(np.uint8).reshape(-1, 4)
    edges = np.linspace(0, REACH, STEPS + 1).astype(int).tolist()
    for least, most in zip(edges[:-1], edges[1:], strict=True):
        at = np.flatnonzero(~out)  # the others are in already; their partners, too
        raw = np.concatenate([key, snip[:, LEFT - least : LEFT + GRAM + REACH - most]], 1)
        _, group, n = np.unique(np.ascontiguousarray(raw).view(f"V{raw.shape[1]}")[:, 0], return_inverse=True, return_counts=True)
        out[at] = n[group[at]] > 1
    return out


def covered_masks(entries: np.ndarray) -> np.ndarray:
    """For each entry of a shard, a bit for each window (by its distance to the anchor) that a document with a smaller id has."""
    full = np.uint64((1 << REACH) - 1)
    kind = np.dtype([("low", ">u4"), ("l", "u1"), ("r", "u1"), ("snip", f"V{SNIP}")])
    raw = np.zeros(len(entries), kind)
    for k in kind.names:
        raw[k] = entries[k]
    rows, at = np.unique(raw.view(f"V{kind.itemsize}"), return_inverse=True)
    rows = rows.view(kind)
    first = np.full(len(rows), _NO_ID, np.int64)
    np.minimum.at(first, at, entries["doc"])
    begin = np.flatnonzero(np.concatenate([[True], rows["low"][1:] != rows["low"][:-1]]))
    size = np.diff([*begin, len(rows)])
    own = np.zeros(len(rows), np.uint64)
    many = np.flatnonzero(np.repeat(size > 1, size))
    snip = np.frombuffer(rows["snip"].tobytes(), np.uint8).reshape(-1, SNIP)
    many = many[_alike(rows["low"][many], snip[many])]
    low = rows["low"][many].astype(np.int64)
    a = 0
    while a < len(many):
        b = min(len(many), a + SORTED)
        while b < len(many) and low[b] == low[b - 1]:
            b += 1  # snippets of an anchor stay together
        i = many[a:b]
        own[i] = _sorted_windows(low[a:b], snip[i], rows["l"][i].astype(np.int64), rows["r"][i].astype(np.int64), first[i])
        a = b
    return np.where(entries["doc"] > first[at], full, own[at])


def _answer_snippets(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    out = []
    for kind in (2, 3):
        own = rows.filter(pa.compute.equal(rows.column("kind"), kind))
        if not own.num_rows:
            continue
        parts = [np.frombuffer(b, _ENTRY if kind == 2 else _WINDOWED) for b in own.column("blob").to_pylist()]
        whole = np.concatenate(parts)
        if kind == 2:
            answer = covered_masks(whole).astype("<u8")
        else:
            _, at = np.unique(np.stack([whole["a"], whole["b"]], 1).astype(">u8").view("V16")[:, 0], return_inverse=True)
            first = np.full(at.max() + 1, _NO_ID, np.int64)
            np.minimum.at(first, at, whole["doc"])
            answer = first[at].astype("<i8")
        ends = np.cumsum([len(p) for p in parts])
        out += [(b, kind, answer[e - len(p) : e].tobytes()) for b, p, e in zip(own.column("bucket").to_pylist(), parts, ends.tolist(), strict=True)]
    shard = key[0].as_py()
    return _table([b for b, _, _ in out], [k for _, k, _ in out], [shard] * len(out), [x for _, _, x in out])


def _removed(own: Bucket) -> dict[int, np.ndarray]:
    """For each document with removed bytes, which of its bytes those are."""
    metas, raws, ids, wins = _entries(own)
    keys, entries, at = _distinct(raws, ids)
    full = np.uint64((1 << REACH) - 1)
    masks = np.zeros(len(entries), np.uint64)
    for s, place in _by_shard(keys):
        masks[place] = np.frombuffer(own.blobs[2, s], "<u8")
    rows, which = _distinct_windows(own, wins)
    first = np.full(len(rows), _NO_ID, np.int64)
    order, split = _window_shards(rows, own.shards)
    for s, place in split:
        first[order[place]] = np.frombuffer(own.blobs[3, s], "<i8")
    edges: dict[int, np.ndarray] = {}

    def cover(docs: np.ndarray, scan: Scan, starts: np.ndarray) -> None:
        doc = np.searchsorted(scan.start, starts, side="right") - 1
        inside = starts + WINDOW <= scan.start[doc + 1]
        starts, doc = starts[inside], doc[inside]
        for d in np.unique(doc).tolist():
            i = int(docs[d])
            edge = edges.setdefault(i, np.zeros(len(own.texts[i]) + 1, np.int32))
            s = starts[doc == d] - scan.start[d]
            np.add.at(edge, s, 1)
            np.add.at(edge, s + WINDOW, -1)

    begin = 0
    for docs, scan, common in metas:
        e = at[begin : begin + len(common)]
        begin += len(common)
        doc = scan.doc[common]
        mask = np.where(own.id[docs[doc]] > entries["doc"][e], full, masks[e])
        live = np.flatnonzero(mask)
        bits = (mask[live][:, None] >> np.arange(REACH, dtype=np.uint64)[None]) & np.uint64(1)
        i, o = np.nonzero(bits)
        starts = scan.at[common][live][i] - o
        ok = starts >= scan.start[doc[live][i]]
        cover(docs, scan, np.unique(starts[ok]))
    begin = 0
    for docs, scan, starts, doc, _, _ in wins:
        w = which[begin : begin + len(starts)]
        begin += len(starts)
        cover(docs, scan, starts[first[w] < own.id[docs[doc]]])
    return {i: np.cumsum(e[:-1]) > 0 for i, e in edges.items()}


def _finish(shards: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        own = Bucket(left, right, shards)
        gone = _removed(own)
        n, lost, spans, kept = [], [], [], []
        for i, text in enumerate(own.texts):
            n.append(len(text))
            if own.copy[i] and len(text) >= WINDOW:
                lost.append(len(text)), spans.append(1), kept.append(b"")
            elif i in gone:
                g = gone[i]
                lost.append(int(g.sum())), spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum())), kept.append(np.frombuffer(text, np.uint8)[~g].tobytes())
            else:
                lost.append(0), spans.append(0), kept.append(text)
        id_ = pa.array([None if x == _NO_ID else x for x in own.id.tolist()], pa.int64())
        return pa.table({"id": id_, "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return run


def suffix_dedup(docs: DataFrame, text: str = "text", id_: str = "doc_id", hot: int = HOT) -> DataFrame:
    """id_, n_bytes, n_removed, n_spans and kept (the remaining bytes), one row for each row of docs."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    raw = docs.select(F.coalesce(F.col(id_).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    told = scratch.cut(raw.select("id", F.concat_ws(":", F.octet_length("text"), F.sha2("text", 256)).alias("key"), F.octet_length("text").cast("long").alias("n")))
    size = told.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    bucket = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("bucket")

    groups = scratch.cut(told.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "first"))
    copies = told.join(groups, "key").where("id > first").select(bucket, "id")
    copies = copies.groupBy("bucket").agg(F.collect_list("id").alias("ids")).select("bucket", F.lit(0).alias("kind"), F.lit(0).alias("shard"), F.col("ids"))  # ids of one bucket

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([np.array(x, "<i8").tobytes() for x in b.column(3).to_pylist()], pa.binary())], names=["bucket", "kind", "shard", "blob"])

    copies = scratch.cut(copies.mapInArrow(packed, _BLOBS))
    name = f"pagewright_{uuid.uuid4().hex}"
    try:
        raw.withColumn("bucket", bucket).repartition(parts, "bucket").write.bucketBy(parts, "bucket").format("parquet").saveAsTable(name)
        texts = spark.table(name)

        def with_texts(right: DataFrame, f, schema: str) -> DataFrame:
            return texts.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(f, schema)

        answers = scratch.cut(with_texts(copies, _send_anchors(parts), _BLOBS).groupBy("shard").applyInArrow(_answer_anchors(hot), _BLOBS))
        known = scratch.cut(answers.unionByName(copies))
        masks = scratch.cut(with_texts(known, _send_snippets(parts), _BLOBS).groupBy("shard").applyInArrow(_answer_snippets, _BLOBS))
        out = scratch.cut(with_texts(known.unionByName(masks), _finish(parts), "id long, n_bytes long, n_removed long, n_spans long, kept binary"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    scratch.drop(told, groups, copies, answers, known, masks)
    return out.withColumnRenamed("id", id_)
