"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a prefix of a word is known from its last token alone: what stands before that token is the encoding of the
shorter prefix.  A token is the last one exactly if it and the last token before it, joined, encode to just these two.  The
distinct words of a batch go through their trie depth first (in sorted order, with the states of the current path on a
stack), so each shared prefix is worked out once; a word's tokens are then read back along its states.

The vocabulary is a file in the tokenizers library's JSON format with an end-of-word suffix; its path is a parameter.
Results equal the library's ``encode(text, add_special_tokens=False)`` and ``decode(ids, skip_special_tokens=False)``,
truncation and padding unused.

Defined results: a null text counts as empty, and has no ids and an empty decoded text; rows keep their ids whether or not
these repeat; other columns are never read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm.arrow import pieces, small_batches, tidy

#: Chunks in each of a worker's two cache generations; what neither holds is worked out anew, which changes no result.
CACHE_WORDS = 100_000
#: Text bytes whose distinct words go through one trie.
PIECE_BYTES = 2 << 20
#: Letters at the end of a token that tell how long a token may be.
ENDING = 3
#: Pairs of tokens whose fit a worker keeps.
CACHE_PAIRS = 250_000


_NEVER = 1 << 60
#: The byte-level alphabet: bytes that Latin-1 prints stand for themselves, the others for what follows it, in order.
_SHOWN = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD}
_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class TrieEncoder:
    """Encodes distinct words with one vocabulary; holds no state of the corpus but bounded caches."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.pairs = list(self.rank)
        self.made: dict[str, int] = {}
        for (a, b), i in self.rank.items():
            self.made.setdefault(a + b, i)
        self.reach: dict[str, int] = {}
        for token in self.vocab:
            tail = self.end if token.endswith(self.end) else ""
            body = token[: len(token) - len(tail)]
            ends = body[-ENDING:] + tail
            self.reach[ends] = max(len(body), self.reach.get(ends, 0))
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.library = Tokenizer.from_file(path)
        self.split = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")") if self.special else None
        self.word = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.plain = re.compile("[\x21-\x7E\u00A1-\u012F\u0131-\u017F]+").fullmatch  # composed as they stand, each with one lower-case letter
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.seen = Recent()  # ids of texts without white space
        known = self.vocab | self.special
        self.code = {t: i.to_bytes(4, "little") for t, i in known.items()}
        shown = [""] * (max(known.values()) + 1)
        for t, i in known.items():
            shown[i] = t
        self.shown = pa.array(shown, pa.string())

    def _merged(self, symbols: list[str]) -> list[str]:
        """The plain merge loop; used only to learn whether a token encodes to itself."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            pair = (symbols[best], symbols[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at one end of token while it is merged, each with the rank at which it goes into the next."""
        out, goes = [], _NEVER
        while True:
            out.append((token, goes))
            if token not in self.made:
                return out[::-1]
            goes = self.made[token]
            token = self.pairs[goes][side]

    def _fit(self, before: str, token: str) -> bool:
        """Whether token can follow before (empty: stand first): no merge across the border comes before those inside."""
        known = self.fits.get((before, token))
        if known is not None:
            return known
        if len(self.fits) >= CACHE_PAIRS:
            self.fits.clear()
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self._merged(self._symbols(token)) == [token]
        if before and known:
            left, right, i, j = self._edge(before, 1), self._edge(token, 0), 0, 0
            while known:
                (x, x_goes), (y, y_goes) = left[i], right[j]
                across = self.rank.get((x, y), _NEVER)
                known = not (across < x_goes and across <= y_goes and across < _NEVER)
                if x_goes == y_goes == _NEVER:
                    break
                if x_goes <= y_goes:
                    i += 1
                else:
                    j += 1
        self.fits[before, token] = known
        return known

    def _last(self, letters: str, at: int, last: list[str], tail: str) -> str:
        """Last token of letters[:at] + tail; last[k] is that of the prefix of k letters."""
        vocab, fits = self.vocab, self.fits
        letters = letters[:at] + tail
        reach = self.reach.get(letters[max(0, at - ENDING) :], ENDING - 1)  # shorter tokens end in fewer letters
        for start in range(max(0, at - reach), at):
            token = letters[start:]
            if token in vocab:
                known = fits.get((last[start], token))
                if known or known is None and self._fit(last[start], token):
                    return token
        raise ValueError(f"no token ends {letters!r}")

    def words(self, words: list[str]) -> dict[str, list[str]]:
        """Tokens of each distinct word, in the byte-level alphabet."""
        out, last, path = {}, [""], ""
        for word in sorted(words):
            shared, most = 0, min(len(last) - 1, len(word) - 1)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for at in range(shared + 1, len(word)):
                last.append(self._last(word, at, last, ""))
            path, at = word, len(word)
            tokens = [self._last(word, at, last, self.end)]
            at -= len(tokens[0]) - len(self.end)
            while at:
                tokens.append(last[at])
                at -= len(last[at])
            out[word] = tokens[::-1]
        return out

    def _other(self, piece: str) -> list[str]:
        """Words of a text with letters beyond Latin: the file's normaliser and splitter, whose Unicode tables are the library's own."""
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))]

    def _words_of(self, chunk: bytes) -> list[str | bytes]:
        """Words of a text without white space, and special tokens (as bytes)."""
        if chunk.isalpha():  # ASCII letters alone
            return [chunk.lower().decode()]
        out: list[str | bytes] = []
        text = chunk.decode("utf-8", "replace")
        for i, piece in enumerate(self.split.split(text) if self.split else [text]):
            if i % 2:
                out.append(piece.encode())
            elif not piece:
                continue
            elif self.plain(piece):
                words = self.word.findall(piece.lower())
                out += words if piece.isascii() else [w.encode().decode("latin-1").translate(_ALPHABET) for w in words]
            else:
                out += self._other(piece)
        return out

    def chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids (four bytes each) of texts without ASCII white space, in their order."""
        parts = [self._words_of(c) for c in chunks]
        code = self.code.__getitem__
        known = {word: b"".join(map(code, tokens)) for word, tokens in self.words(list({w for own in parts for w in own if isinstance(w, str)})).items()}
        return [b"".join([known[w] if isinstance(w, str) else code(w.decode()) for w in own]) for own in parts]


class Recent:
    """A dict of bounded size: two generations, of which the older goes when the younger is full."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        """Brings keys of the older generation into the younger; returns those in neither."""
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        out, old, young = [], self.old, self.young
        for k in keys.difference(young):
            if k in old:
                young[k] = old[k]
            else:
                out.append(k)
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(where each text's chunks begin, which distinct chunk each is, the distinct chunks); chunks have no ASCII white space."""
    rows = pc.ascii_split_whitespace(texts)
    chunks = rows.flatten()
    early = pc.and_(pc.string_is_ascii(chunks), pc.invert(pc.match_substring(chunks, "<|")))  # others are composed before; a special token has its own case
    chunks = pc.if_else(early, pc.ascii_lower(chunks), chunks).dictionary_encode()
    return rows.offsets.to_numpy(), chunks.indices.to_numpy(), chunks.dictionary.cast(pa.large_binary())


def _joined(encoder: TrieEncoder, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Ids and decoded text of each of texts."""
    seen = encoder.seen
    begin, which, chunks = _split(texts)
    chunks = chunks.to_pylist()
    new = seen.missing(set(chunks))
    seen.young.update(zip(new, encoder.chunks(new), strict=True))
    got = list(map(seen.young.__getitem__, chunks))
    n = np.array([len(ids) // 4 for ids in got], np.int64)
    pool = np.frombuffer(b"".join(got), "<i4")

    count = n[which]
    end = np.concatenate([[0], np.cumsum(count)])
    ids = pa.array(pool[np.repeat((np.cumsum(n) - n)[which] - end[:-1], count) + np.arange(end[-1])])
    begin = pa.array(end[begin].astype(np.int32))
    return pa.ListArray.from_arrays(begin, ids), pc.binary_join(pa.ListArray.from_arrays(begin, encoder.shown.take(ids)), " ")


def _encoding(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in pieces(batches, 1, PIECE_BYTES):
            ids, decoded = _joined(encoder, batch.column(1).cast(pa.string()).fill_null(""))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, decoded], names=["id", "ids", "decoded"])
        encoder.seen = Recent()
        encoder.fits.clear()
        tidy()

    return run


def encode_decode(docs: DataFrame, path: str, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id_, ids (array of int) and decoded (the text that the ids stand for), one row for each row of docs."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_]
    rows = docs.select(F.col(id_).alias("id"), F.col(text).alias("text")).mapInArrow(_encoding(path), f"id {kind}, ids array<int>, decoded string")
    return rows.withColumnRenamed("id", id_)
