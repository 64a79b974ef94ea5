"""Language identification by multilingual mixture inference.

A language is a distribution over hashed character trigrams, counted over all labelled training rows.  A document is a
mixture of languages: expectation-maximisation finds the proportions that make its trigrams likeliest.  Languages join the
set one at a time, the one of steepest likelihood first, as long as the gain exceeds a penalty for each language that
grows with the logarithm of the document's length.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text when no training row has
a label; ties go to the smaller label; rows are never merged; the table's other columns are not inputs of a prediction.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import pieces, small_batches, tidy

CELLS = 1 << 15
SMOOTH = 0.5
#: Times the logarithm of the number of trigrams that a further language must gain.
PENALTY = 3.0
ROUNDS = 25
UNKNOWN = "und"


def _fold() -> np.ndarray:
    """A symbol of 6 bits for each code point: 0 for all but letters, a to z apart, other letters hashed."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + c * 31 % 37
    return out


_FOLD: list[np.ndarray] = []


def trigrams(text: str) -> np.ndarray:
    """Cells of the trigrams of a text that hold a letter; empty if it has no letter."""
    if not _FOLD:
        _FOLD.append(_fold())
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    s = np.zeros(len(codes) + 2, np.uint32)
    s[1:-1] = _FOLD[0][codes]
    tri = s[:-2] << 12 | s[1:-1] << 6 | s[2:]
    return (tri[tri > 0] * np.uint32(2654435761)) >> np.uint32(17)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cell, n): one row for each cell of a language that the partition has."""
    seen: dict[str, np.ndarray] = {}
    for batch in pieces(batches, 1):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in seen:
                seen[lang] = np.zeros(CELLS, np.int64)
            seen[lang] += np.bincount(trigrams(text), minlength=CELLS)
    for lang, n in seen.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "cell", "n"])


class Mixture:
    """Languages in order of their labels and their cells' probabilities."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.p = ((counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * CELLS)).T.copy() if langs else np.zeros((CELLS, 0))
        self.log = np.log(self.p)

    def proportions(self, text: str | None) -> dict[str, float]:
        """Languages of the chosen set with their proportions; empty if there is no letter or nothing learned."""
        cells = trigrams(text or "")
        if not len(cells) or not self.langs:
            return {}
        count = np.bincount(cells, minlength=CELLS)
        at = np.flatnonzero(count)
        c, n = count[at].astype(float), float(len(cells))
        p, like = self.p[at], c @ self.log[at]
        chosen, share = [int(like.argmax())], np.ones(1)
        best, mixed = float(like[chosen[0]]), p[:, chosen[0]]
        while len(chosen) < len(self.langs):
            steep = (c / mixed) @ p / n  # over 1: the likelihood, concave in the shares, rises with this language
            steep[chosen] = 0
            new = int(steep.argmax())
            if steep[new] <= 1:
                break
            own = p[:, [*chosen, new]]
            theta = np.append(share * 0.75, 0.25)
            for _ in range(ROUNDS):
                moved = theta * ((c / (own @ theta)) @ own) / n
                theta, change = moved, float(np.abs(moved - theta).max())
                if change < 1e-4:
                    break
            mix = own @ theta
            got = float(c @ np.log(mix))
            if got - best <= PENALTY * np.log(n + 1):
                break
            chosen, share, best, mixed = [*chosen, new], theta, got, mix
        return {self.langs[k]: float(min(1.0, s)) for k, s in zip(chosen, share, strict=True)}


def fit(docs: DataFrame, label: str = "lang", text: str = "text") -> Mixture:
    """Counts every row of docs whose label and text aren't null; the driver gets CELLS numbers a language."""
    counted = docs.select(F.col(label).alias("lang"), F.col(text).alias("t")).where("lang is not null and t is not null").mapInArrow(_count, "lang string, cell int, n long")
    rows = counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((len(langs), CELLS))
    counts[np.searchsorted(langs, rows.column("lang").to_pylist()) if langs else [], rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return Mixture(langs, counts)


def training(id_: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id as text is not 2 modulo 4."""
    return F.crc32(F.col(id_).cast("string")) % 4 != 2


def predicted(text: Column, model: Mixture) -> Column:
    """lang_pred as a column: only the text goes to Python, and only the label comes back."""

    @F.arrow_udf("string")
    def label(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in column:
            found = [model.proportions(t) for batch in pieces(iter([pa.RecordBatch.from_arrays([texts], names=["t"])]), 0) for t in batch.column(0).to_pylist()]
            yield pa.array([max(f.items(), key=lambda x: x[1])[0] if f else UNKNOWN for f in found], pa.string())
        tidy()

    return label(text)


def identify(docs: DataFrame, model: Mixture, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id_, lang_pred, score (its proportion) and mixture (language to proportion), one row for each row of docs."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            found = [model.proportions(t) for t in batch.column(1).to_pylist()]
            top = [max(f.items(), key=lambda x: x[1]) if f else (UNKNOWN, 0.0) for f in found]
            mixed = pa.array([list(f.items()) for f in found], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t[0] for t in top], pa.string()), pa.array([t[1] for t in top], pa.float64()), mixed], names=["id", "lang_pred", "score", "mixture"])

    out = docs.select(F.col(id_).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, lang_pred string, score double, mixture map<string,double>")
    return out.withColumnRenamed("id", id_)
