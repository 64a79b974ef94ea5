"""Toxicity by nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

Terms are words and word beginnings, all that the labelled sample has.  A term weighs by its inverse document frequency,
and more where toxic examples hold it more often than others beyond chance (times the standard deviations, 1 at least).
Labelled examples with equal vectors are one entry with counts; alike entries lie in one block.  A block keeps the weights of
the terms that many of its entries hold as rows, all else is postings.  Postings are added up for a batch of alike documents;
what the rows can add is bounded by the greatest weight of each.  The most promising blocks of a document are completed first and give the k-th best score; then every block whose bound reaches
it.  Sums are taken in single precision with a slack above their rounding, and all entries within the slack of the k-th are
recomputed in double, so the k nearest are exact (to 12 decimals, by which they are ranked).

The vote of the nearest weighs by closeness and count, drawn towards the share of toxic examples by PRIOR votes.  A
logistic curve, fitted to the votes of CALIBRATED labelled examples of which each is left out of its own vote, turns votes
into scores; the nearest are returned as evidence.  A document without a vocabulary term is nearest to the examples without
one and gets their share.

Bounds: at most ``max_labelled`` labelled rows (those of least hash of the id) are learned from.

Defined results: a null text counts as empty; an example labelled more than once counts as toxic if any label is 1; rows
without a label or id, or whose text is missing from docs, are not learned from; without examples every score is 0; ties in
similarity go to the entry of smaller id; rows are never merged; an empty table gives an empty table; other columns are
never read.  Ids of docs and labels are integers.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.arrow import one_thread, pieces, small_batches, table, tidy
from pagewright.llm.scratch import Scratch

MAX_LABELLED = 20_000
#: Labelled rows of least hash on which the curve from votes to scores is fitted.
CALIBRATED = 2_048
#: Share of entries above which a term tells alike entries from others.
COMMON = 0.05
PREFIX = 5
BLOCK = 256
NEAREST = 16
PRIOR = 0.5
#: A term of this share of entries has a row of weights, instead of postings, in each block of which so many entries hold it.
OFTEN = 0.02
HELD = 18
#: Documents that are looked up together.
BATCH = 256
#: Postings that are added up at once, and those of one term more.
POSTINGS = 1 << 17
#: Blocks of a document that are completed first.
FIRST = 2
#: Directions in which alike entries are told from others.
DIRECTIONS = 24
#: Text bytes whose terms are held at once.
PIECE_BYTES = 2 << 20
#: The index that a worker has built, by its fit.
_BUILT: dict[str, tuple[BlockMaxIndex, Names]] = {}
_WORD = re.compile(r"\w+")


def _hashes(words: pa.Array) -> np.ndarray:
    """Python's hashes, the same within a process alone."""
    return np.fromiter(chain.from_iterable(map(hash, words[i : i + 65_536].to_numpy(zero_copy_only=False)) for i in range(0, len(words), 65_536)), np.int64, len(words))


class Names:
    """Known terms, found by hashes that are sorted once; a term found so is compared."""

    def __init__(self, known: pa.Array):
        own = _hashes(known)
        order = np.argsort(own, kind="stable")
        self.known, self.order, self.hash = known, order.astype(np.int32), own[order]
        self.clash = bool((self.hash[1:] == self.hash[:-1]).any())

    def __len__(self) -> int:
        return len(self.known)

    def find(self, words: pa.Array) -> np.ndarray:
        """Place of each word among the known terms, -1 for null and others."""
        if self.clash:
            return pc.fill_null(pc.index_in(words, value_set=self.known, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.full(len(words), -1, np.int64)
        if len(self) and len(words):
            own = _hashes(words)
            at = np.minimum(np.searchsorted(self.hash, own), len(self) - 1)
            hit = np.flatnonzero(self.hash[at] == own)
            at = self.order[at[hit]]
            same = pc.fill_null(pc.equal(self.known.take(pa.array(at)), words.take(pa.array(hit))), False).to_numpy(zero_copy_only=False)
            out[hit[same]] = at[same]
        return out


@lru_cache(1)
def _worded() -> np.ndarray:
    """Whether _WORD takes each code point, which its neighbours don't change."""
    out = np.zeros(0x110000, bool)
    for first in range(0, len(out), 1 << 16):
        for m in _WORD.finditer("".join(map(chr, range(first, first + (1 << 16))))):
            out[first + m.start() : first + m.end()] = True
    return out


def _words(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """All that _WORD finds in the texts in small letters, one after another, and the place of each one's text."""
    own = [t.lower().encode() for t in texts]
    data = b"\n".join([*own, b""])
    taken = _worded()[np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)]
    data = np.frombuffer(data, np.uint8)
    if len(taken) < len(data):
        taken = np.repeat(taken, np.diff(np.flatnonzero((data & 0xC0) != 0x80), append=len(data)))
    edges = np.flatnonzero(np.diff(taken.view(np.int8), prepend=np.int8(0)))
    ends = np.concatenate([[0], np.cumsum(edges[1::2] - edges[::2])]).astype(np.int32)
    row = np.searchsorted(np.cumsum([len(o) + 1 for o in own]), edges[::2], side="right")
    return row, pa.StringArray.from_buffers(len(row), pa.py_buffer(ends), pa.py_buffer(data[taken]))


def _starts(words: pa.Array) -> pa.Array:
    """With a mark, the first letters of longer words; null for the others."""
    return pc.if_else(pc.greater(pc.utf8_length(words), PREFIX), pc.binary_join_element_wise("^", pc.utf8_slice_codeunits(words, 0, PREFIX), ""), None)


def term_counts(texts: list[str], names: Names) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, term, n): the known terms of each text in ascending order with their counts, from begin[i] to begin[i + 1]."""
    row, said = _words(texts)
    said = said.dictionary_encode()
    words = said.dictionary
    row, at = row * (len(names) + 1), []
    for kind in (words, _starts(words)):
        kind = kind.dictionary_encode(null_encoding="encode")
        known = names.find(kind.dictionary)[kind.indices.to_numpy()]
        found = known[said.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
        at.append((row + found)[found >= 0])
    key, n = np.unique(np.concatenate(at), return_counts=True)
    return np.searchsorted(key, np.arange(len(texts) + 1) * (len(names) + 1)), key % (len(names) + 1), n


def _rows(begin: np.ndarray, at: np.ndarray, n: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the texts (as term_counts gives them) at the places which, in that order."""
    many = begin[which + 1] - begin[which]
    ends = np.concatenate([[0], np.cumsum(many)])
    place = np.repeat(begin[which] - ends[:-1], many) + np.arange(ends[-1])
    return ends, at[place], n[place]


class BlockMaxIndex:
    """Labelled vectors: weight of each term, entries with their counts, postings of rare terms, blocks of the common ones."""

    def __init__(self, idf: np.ndarray, begin: np.ndarray, at: np.ndarray, n: np.ndarray, ids: np.ndarray, toxic: np.ndarray):
        """Example i has id ids[i], label toxic[i] and the terms at[begin[i]:begin[i + 1]], ascending, n times."""
        self.idf, found = idf, {}
        slices = [slice(a, b) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        digests = [hashlib.sha256(at[s].tobytes() + n[s].tobytes()).digest() for s in slices]
        for i in sorted(range(len(ids)), key=lambda i: (int(ids[i]), digests[i])):
            e = found.setdefault(digests[i], [0, 0, int(ids[i]), slices[i]])
            e[0] += 1
            e[1] += int(toxic[i])
        none = found.pop(hashlib.sha256(b"").digest(), [0, 0])
        self.share = float(toxic.mean()) if len(ids) else 0.0
        self.empty = none
        own = list(found.values())
        del found, digests
        self.column = self._columns(np.bincount(at, minlength=len(idf)), len(own))
        own = [own[i] for i in self._alike([at[e[3]] for e in own])]
        self.count, self.toxic, self.id = (np.array([e[i] for e in own], np.int64) for i in range(3))
        self.begin = np.concatenate([[0], np.cumsum([e[3].stop - e[3].start for e in own])]).astype(np.int64)
        self.at = np.concatenate([np.zeros(0, np.int32), *[at[e[3]] for e in own]]).astype(np.int32, copy=False)
        times = 1 + np.log(np.maximum(np.arange(int(n.max(initial=1)) + 1), 1))
        self.unit = np.empty(len(self.at))
        for a, b, e in zip(self.begin[:-1].tolist(), self.begin[1:].tolist(), own, strict=True):
            w = times[n[e[3]]] * idf[self.at[a:b]]
            self.unit[a:b] = w / math.sqrt(float(w @ w))
        del own, at, n
        self.blocks = -(-len(self.id) // BLOCK)
        self._post(self._dense())

    def _columns(self, df: np.ndarray, entries: int) -> np.ndarray:
        """The column of each common term, -1 for the others."""
        common = np.flatnonzero(df > max(BLOCK, COMMON * entries))
        out = np.full(len(self.idf), -1, np.int32)
        out[common] = np.arange(len(common))
        return out

    def _alike(self, own: list[np.ndarray]) -> list[int]:
        """Entries (their terms) in an order that puts alike ones next to each other; any order gives the same results."""
        common = np.flatnonzero(self.column >= 0)
        signs = np.random.default_rng(3).choice([-1.0, 1.0], (len(common), DIRECTIONS)) * self.idf[common][:, None]
        x = np.zeros((len(own), DIRECTIONS))
        for i, at in enumerate(own):
            c = self.column[at]
            x[i] = signs[c[c >= 0]].sum(0)
        out, open_ = [], [np.arange(len(own))]
        while open_:
            part = open_.pop()
            if len(part) <= BLOCK:
                out += part.tolist()
                continue
            y = x[part] - x[part].mean(0)
            axis = y[np.abs(y).sum(1).argmax()]
            for _ in range(8):
                axis = y.T @ (y @ axis)
                axis = axis / (np.sqrt(axis @ axis) or 1.0)
            part = part[np.argsort(np.round(y @ axis, 9), kind="stable")]
            half = (-(-len(part) // BLOCK) + 1) // 2 * BLOCK
            open_ += [part[half:], part[:half]]
        return out

    def _dense(self) -> np.ndarray:
        """Rows of weights of each block, for terms that it holds often; which of all entries' terms are in them."""
        held, own = np.zeros(len(self.at), bool), []
        few = np.bincount(self.at, minlength=len(self.idf)) <= OFTEN * len(self.id)
        ends = self.begin[np.minimum(np.arange(self.blocks + 1) * BLOCK, len(self.id))].tolist()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            n = np.bincount(self.at[a:b], minlength=len(self.idf))
            n[few] = 0
            own.append(np.flatnonzero(n >= HELD))
            held[a:b] = n[self.at[a:b]] >= HELD
        self.column = np.full(len(self.idf), -1, np.int32)
        some = np.unique(np.concatenate([np.zeros(0, np.int64), *own]))
        self.column[some] = np.arange(len(some))
        self.columns = [self.column[o] for o in own]
        self.row = np.concatenate([[0], np.cumsum([len(o) for o in own])]).astype(np.int64).tolist()
        self.whole = np.zeros((self.row[-1], BLOCK), np.float32)
        self.most = np.zeros((len(some), self.blocks), np.float32)
        place = np.zeros(len(self.idf), np.int64)
        for i, (a, b, terms_) in enumerate(zip(ends[:-1], ends[1:], own, strict=True)):
            place[terms_] = np.arange(len(terms_))
            part, first = self.whole[self.row[i] : self.row[i + 1]], i * BLOCK
            entry = np.repeat(np.arange(min(BLOCK, len(self.id) - first)), np.diff(self.begin[first : first + BLOCK + 1]))
            part[place[self.at[a:b][held[a:b]]], entry[held[a:b]]] = self.unit[a:b][held[a:b]]
            self.most[self.columns[i], i] = part.max(1)
        return held

    def _post(self, held: np.ndarray) -> None:
        """Postings of all that is not held in rows of a block."""
        rare = np.flatnonzero(~held)
        rare = rare[np.argsort(self.at[rare], kind="stable")]
        self.post = np.empty(len(rare), [("entry", np.int32), ("weight", np.float32)])
        self.entry, self.weight = self.post["entry"], self.post["weight"]
        self.entry[:] = np.repeat(np.arange(len(self.id), dtype=np.int32), np.diff(self.begin))[rare]
        self.weight[:] = self.unit[rare]
        n = np.bincount(self.at[rare], minlength=len(self.idf))
        self.start = np.concatenate([[0], np.cumsum(n)])
        self.steps = np.arange(min(len(rare), POSTINGS + int(n.max(initial=0))))
        self.room = [np.empty(len(self.steps), kind) for kind in (np.int64, np.int64, np.float32)]

    def nearest(self, begin: np.ndarray, at: np.ndarray, n: np.ndarray, k: int = NEAREST) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text (as term_counts gives them) the k entries of greatest cosine above 0, exactly: (entries, cosines).  Alike texts are looked up together."""
        texts, n = len(begin) - 1, 1 + np.log(n)
        some = [slice(a, min(a + BATCH, texts)) for a in range(0, texts, BATCH)]
        best = [self._asked(*_rows(begin, at, n, np.arange(s.start, s.stop)))[2] @ self.most for s in some] if self.blocks else []
        order = np.argsort(np.concatenate([x.argmax(1) for x in best]), kind="stable") if best else np.arange(texts)
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * texts
        for s in some:
            for text, found in zip(order[s].tolist(), self._batch(*_rows(begin, at, n, order[s]), k), strict=True):
                out[text] = found
        return out

    def _asked(self, begin: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text and weight of each term, and a row of weights by column for each text."""
        texts = len(begin) - 1
        row = np.repeat(np.arange(texts), np.diff(begin))
        q = n * self.idf[at]
        q /= np.sqrt(np.bincount(row, q * q, minlength=texts))[row]
        column = self.column[at]
        full = np.zeros((texts, len(self.most)), np.float32)
        full[row[column >= 0], column[column >= 0]] = q[column >= 0]
        return row, q, full

    def _batch(self, begin: np.ndarray, at: np.ndarray, n: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        texts = len(begin) - 1
        row, q, full = self._asked(begin, at, n)
        score = self._rare(texts, row, at, q)
        slack = (2 * (np.bincount(row, minlength=texts) + 8) * 2.0**-24).astype(np.float32)[:, None]  # above the rounding of sums of so many terms, 1 at most in all

        bound = score.reshape(texts, self.blocks, BLOCK).max(2) + full @ self.most + slack
        done = np.zeros((texts, self.blocks), bool)
        first = np.argpartition(-bound, min(FIRST, self.blocks - 1), 1)[:, :FIRST] if self.blocks else np.zeros((texts, 0), np.int64)
        np.put_along_axis(done, first, True, 1)
        self._complete(score, full, done)
        part = np.take_along_axis(score.reshape(texts, self.blocks, BLOCK), first[:, :, None], 1).reshape(texts, -1)
        kth = np.partition(part, part.shape[1] - k, 1)[:, part.shape[1] - k] if part.shape[1] >= k else np.zeros(texts, np.float32)
        more = (bound >= kth[:, None] - 2 * slack) & ~done
        self._complete(score, full, more)
        near = score >= kth[:, None] - 2 * slack
        near.reshape(texts, self.blocks, BLOCK)[~(done | more)] = False
        i, e = np.nonzero(near[:, : len(self.id)])
        s = score[i, e]
        cut = np.searchsorted(i, np.arange(texts + 1)).tolist()
        for text, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b - a >= k:
                kth[text] = max(kth[text], np.partition(s[a:b], b - a - k)[b - a - k])
        near = s >= kth[i] - 2 * slack[i, 0]
        i, e = i[near], e[near]
        got = self._cosines(begin, at, q, i, e)
        at_ = np.searchsorted(i, np.arange(texts + 1))
        out = []
        for a, b in zip(at_[:-1].tolist(), at_[1:].tolist(), strict=True):
            own, s = e[a:b], got[a:b]
            best = np.lexsort((own, self.id[own], -s))[:k]
            best = best[s[best] > 0]
            out.append((own[best], s[best]))
        return out

    def _rare(self, texts: int, row: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """What postings add to each entry's score; a row for each text."""
        out = np.zeros((texts, self.blocks * BLOCK), np.float32)
        cut, post = np.searchsorted(row, np.arange(texts + 1)).tolist(), self.post.view(np.int64)
        begin, q = self.start[at], q.astype(np.float32)
        many = self.start[at + 1] - begin
        for a, b, told in zip(cut[:-1], cut[1:], out, strict=True):
            cuts = [a, *(np.flatnonzero(np.diff(np.cumsum(many[a:b]) // POSTINGS)) + a + 1).tolist(), b]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                n = many[x:y]
                ends = np.cumsum(n)
                size = int(ends[-1]) if y > x else 0
                place, found, value = (r[:size] for r in self.room)
                np.add(np.repeat(begin[x:y] - ends + n, n), self.steps[:size], out=place)
                post.take(place, out=found, mode="clip")
                place[:] = found.view(np.int32)[::2]
                np.multiply(found.view(np.float32)[1::2], np.repeat(q[x:y], n), out=value)
                np.add.at(told, place, value)
        return out

    def _complete(self, score: np.ndarray, full: np.ndarray, which: np.ndarray) -> None:
        """Adds the terms that a block holds often to the scores of the marked blocks of each text."""
        for b in np.flatnonzero(which.any(0)).tolist():
            rows = np.flatnonzero(which[:, b])
            score[rows, b * BLOCK : (b + 1) * BLOCK] += full[rows].take(self.columns[b], 1) @ self.whole[self.row[b] : self.row[b + 1]]

    def _cosines(self, begin: np.ndarray, at: np.ndarray, q: np.ndarray, i: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Cosine of text i and entry e in double precision, pair by pair, to 12 decimals; i ascends."""
        out, mine = np.zeros(len(i)), np.zeros(len(self.idf))
        cut = np.searchsorted(i, np.arange(len(begin)))
        for text in range(len(begin) - 1):
            own = e[cut[text] : cut[text + 1]]
            if not len(own):
                continue
            t = slice(begin[text], begin[text + 1])
            mine[at[t]] = q[t]
            runs = [slice(a, b) for a, b in zip(self.begin[own].tolist(), self.begin[own + 1].tolist(), strict=True)]
            n = np.cumsum([0, *[x.stop - x.start for x in runs[:-1]]])
            unit, mine_ = np.concatenate([self.unit[x] for x in runs]), mine.take(np.concatenate([self.at[x] for x in runs]))
            out[cut[text] : cut[text + 1]] = np.round(np.add.reduceat(unit * mine_, n), 12)
            mine[at[t]] = 0.0
        return out

    def vote(self, own: np.ndarray, cosine: np.ndarray, without: int | None = None) -> float:
        """Vote of entries; without: the label of an example, among the equal ones, that does not count."""
        count, toxic = self.count[own].astype(float), self.toxic[own].astype(float)
        if without is not None and len(own) and cosine[0] > 1 - 1e-9:
            count[0] -= 1
            toxic[0] -= without
        if not len(own):
            count, toxic, cosine = np.array([self.empty[0]], float), np.array([self.empty[1]], float), np.ones(1)
            if without is not None:
                count, toxic = np.maximum(count - 1, 0), np.maximum(toxic - without, 0)
            return float((toxic[0] + PRIOR * self.share) / (count[0] + PRIOR))
        w = cosine / (0.05 + 1 - np.minimum(cosine, 1))
        return float((w @ toxic + PRIOR * self.share) / (w @ count + PRIOR))

    def votes(self, texts: list[str], names: Names, labels: list[int] | None = None) -> tuple[list[float], list[tuple[np.ndarray, np.ndarray]]]:
        """Vote and nearest entries of each text; labels: those of examples, each left out of its own vote."""
        if not len(self.id) and not self.share:
            return [0.0] * len(texts), [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        found = self.nearest(*term_counts(texts, names), NEAREST + (labels is not None))
        return [self.vote(own, s, labels[i] if labels is not None else None) for i, (own, s) in enumerate(found)], found

    def evidence(self, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
        """Lists of (id of an example, cosine, how many examples, how many of them toxic)."""
        ends = np.concatenate([[0], np.cumsum([len(e) for e, _ in found])]).astype(np.int32)
        own = np.concatenate([np.zeros(0, np.int64), *[e for e, _ in found]]).astype(np.int64)
        cosine = np.concatenate([np.zeros(0), *[s for _, s in found]])
        parts = [pa.array(self.id[own]), pa.array(cosine), pa.array(self.count[own]), pa.array(self.toxic[own])]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, ["id", "cosine", "examples", "toxic"]))


def curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(a, b) of the score 1 / (1 + exp(-(a + b * logit(vote)))), by Newton steps with a weak pull towards (0, 1)."""
    a = np.array([0.0, 1.0])
    if not labels.any() or labels.all():
        return 0.0, 1.0
    x = np.stack([np.ones(len(votes)), _logit(votes)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ a))
        grad = x.T @ (labels - p) - (a - [0.0, 1.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), grad)
        a = a + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-10:
            break
    return float(a[0]), max(float(a[1]), 1e-3)


def _logit(votes: np.ndarray) -> np.ndarray:
    v = np.clip(votes, 1e-6, 1 - 1e-6)
    return np.log(v / (1 - v))


def _planes(*numbers: np.ndarray) -> bytes:
    """32-bit numbers in few bytes: by place of their bytes, which puts alike ones together."""
    flat = np.concatenate([x.astype("<i4") for x in numbers])
    return zstandard.compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<i4")[:, 0]


def _named(names: pa.Array) -> bytes:
    return zstandard.compress(pickle.dumps(names), 3)


class Fitted:
    """What an index is built of, in few bytes and sent once to each executor; each worker builds it once."""

    def __init__(self, spark: SparkSession, names: bytes, idf: np.ndarray, rows: pa.Table):
        """rows: id, y and terms (the steps between an example's terms, then how often it has each)."""
        self.uid, self.curve, self.toxic = uuid.uuid4().hex, (0.0, 1.0), bool(pc.any(pc.greater(rows.column(1), 0)).as_py())
        self.shared = spark.sparkContext.broadcast((names, idf, rows))

    def index(self) -> tuple[BlockMaxIndex, Names]:
        """The index and the names of its terms."""
        if self.uid not in _BUILT:
            one_thread()
            _BUILT.clear()
            names, idf, rows = self.shared.value
            own = [_numbers(x) for x in rows.column(2).to_pylist()]
            begin = np.concatenate([[0], np.cumsum([len(x) // 2 for x in own])]).astype(np.int64)
            at, n = (np.concatenate([np.zeros(0, "<i4"), *part]) for part in ([np.cumsum(x[: len(x) // 2], dtype="<i4") for x in own], [x[len(x) // 2 :] for x in own]))
            del own
            ids, toxic = (rows.column(i).to_numpy().astype(np.int64) for i in range(2))
            _BUILT[self.uid] = BlockMaxIndex(idf, begin, at, n, ids, toxic), Names(pickle.loads(zstandard.decompress(names)))
            tidy()
        return _BUILT[self.uid]

    def score(self, vote: float) -> float:
        if not self.toxic:
            return 0.0
        return 1 / (1 + math.exp(-(self.curve[0] + self.curve[1] * float(_logit(np.array(vote))))))


def _term_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, examples, toxic ones) of a partition of the labelled sample."""
    for batch in pieces(batches, 2, PIECE_BYTES):
        row, said = _words(batch.column(2).to_pylist())
        said = said.dictionary_encode()
        for kind in (said.dictionary, _starts(said.dictionary)):
            kind = kind.dictionary_encode()
            own = pc.fill_null(kind.indices, len(kind.dictionary)).to_numpy(zero_copy_only=False)[said.indices.to_numpy()] if len(said) else np.zeros(0, np.int64)
            text, term = np.divmod(np.unique(row * (len(kind.dictionary) + 1) + own), len(kind.dictionary) + 1)
            n, toxic = (np.bincount(term, y, minlength=len(kind.dictionary) + 1)[:-1].astype(np.int64) for y in (None, batch.column(1).to_numpy()[text]))
            yield pa.RecordBatch.from_arrays([kind.dictionary, pa.array(n), pa.array(toxic)], names=["term", "n", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, text: str = "text", id_: str = "doc_id", label: str = "toxic") -> Fitted:
    """labels: id_ and label, already limited to what may be learned from."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    told = labels.select(F.col(id_).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    told = told.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_labelled).collect()
    small = table(spark, id=pa.array([r["id"] for r in told], pa.int64()), y=pa.array([int(r["y"] > 0) for r in told], pa.int32()))
    own = docs.select(F.col(id_).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(small), "id").select("id", "y", "t")  # max_labelled rows at most
    own = scratch.cut(own)
    n, n1 = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    found = own.mapInArrow(_term_frequencies, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow()
    found = found.take(pc.sort_indices(found, [("term", "ascending")]))  # bytewise, which is the order of code points
    share, df, toxic = n1 / n if n else 0.0, found.column("n").to_numpy(), found.column("toxic").to_numpy()
    z = (toxic - df * share) / np.sqrt((df + 1) * (share * (1 - share) + 1e-9))
    weight = np.log((2 + n) / (1 + df)) * np.maximum(1, z)
    names = found.column("term").combine_chunks()
    names = names if isinstance(names, pa.Array) else pa.concat_arrays(names.chunks)
    del found
    packed = _named(names)
    del names

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(pickle.loads(zstandard.decompress(packed)))
        for batch in pieces(batches, 2, PIECE_BYTES):
            begin, at, n = term_counts(batch.column(2).to_pylist(), names)
            own = [_planes(np.diff(at[a:b], prepend=0), n[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], names=["id", "y", "terms"])

    out = Fitted(spark, packed, weight, own.mapInArrow(vectors, "id long, y int, terms binary").toArrow())
    tidy()

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names = out.index()
        for batch in pieces(batches, 2, PIECE_BYTES):
            votes, _ = index.votes(batch.column(2).to_pylist(), names, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(votes, pa.float64())], names=["id", "y", "vote"])

    if n1:
        some = table(spark, id=pa.array([r["id"] for r in told[:CALIBRATED]], pa.int64()))
        some = own.join(F.broadcast(some), "id").select("id", "y", "t")
        seen = sorted((r["vote"], r["y"]) for r in some.mapInArrow(left_out, "id long, y int, vote double").collect())  # CALIBRATED rows and those that share their ids
        out.curve = curve(np.array([v for v, _ in seen]), np.array([y for _, y in seen], float))
    scratch.drop(own)
    return out


def score(docs: DataFrame, fitted: Fitted, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id_, score and evidence, one row for each row of docs."""
    kind = dict(docs.dtypes)[id_]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names = fitted.index()
        for batch in pieces(batches, 1, PIECE_BYTES):
            votes, found = index.votes([t or "" for t in batch.column(1).to_pylist()], names)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fitted.score(v) for v in votes], pa.float64()), index.evidence(found)], names=["id", "score", "evidence"])

    out = docs.select(F.col(id_).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, score double, evidence array<struct<id:long,cosine:double,examples:long,toxic:long>>")
    return out.withColumnRenamed("id", id_)
