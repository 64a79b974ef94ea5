"""Secret scan with structural confirmation.

Three patterns give the base spans.  Encoded runs are then decoded and reported only if what they hold has the structure
of a key or token: a DER sequence whose nested lengths add up, an OpenSSH key whose length-prefixed fields fill it, or a
signed token whose header is a JSON object that names an algorithm.

Defined results: a null text counts as empty and gives no spans; spans are code points, end exclusive, of the whole text
however long; rows are never merged; other columns are never read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import pieces

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "der", "openssh", "jwt")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of 20 or more; a shorter run has no longer one inside
_HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_ANY = re.compile(r"(?:[0-9A-Fa-f]{2}){24,}")
_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: Base64 with line breaks, as keys are wrapped: an encoded DER sequence begins with M, an OpenSSH key or field with A or b3BlbnNzaC.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-Za-z0-9_-]|AAAA|b3BlbnNzaC)[A-Za-z0-9+/_-]{22,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+(?:\r?\n(?!-----)[A-Za-z0-9+/_-]+)*")
_PAD = re.compile(r"(?:\r?\n)?=")
_MORE = re.compile(r"={0,2}(?!-----)[A-Za-z0-9+/_=-]")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def is_der(data: bytes, depth: int = 0) -> bool:
    """Whether data is exactly one DER sequence of two or more whole elements; nested constructed ones are checked too."""
    if len(data) < 2 or depth > 16 or depth == 0 and data[0] != 0x30:
        return False
    at, n = 0, 0
    if depth == 0:
        head = _der_length(data, 1)
        if head is None or head[0] + head[1] != len(data):
            return False
        return is_der(data[head[0] :], 1)
    while at < len(data):
        head = _der_length(data, at + 1) if at + 1 < len(data) else None
        if head is None or head[0] + head[1] > len(data):
            return False
        if data[at] & 0x20 and head[1] and not is_der(data[head[0] : head[0] + head[1]], depth + 1):
            return False
        at, n = head[0] + head[1], n + 1
    return n >= (2 if depth == 1 else 1)


def _der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(where the contents start, how many bytes they have), or None if the length isn't in its shortest form."""
    first = data[at]
    if first < 0x80:
        return at + 1, first
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    size = int.from_bytes(data[at + 1 : at + 1 + n], "big")
    return (at + 1 + n, size) if size >= 0x80 and size >> 8 * (n - 1) else None


def is_openssh(data: bytes) -> bool:
    """Whether data is an OpenSSH private key, or a public key whose fields fill it exactly."""
    if data.startswith(b"openssh-key-v1\0"):
        fields = _fields(data[15:], 3, whole=False)
        return fields is not None and all(f.isalnum() or not f or b"-" in f for f in fields[:2])
    fields = _fields(data, 2, whole=True)
    return fields is not None and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", fields[0]) is not None


def _fields(data: bytes, least: int, whole: bool) -> list[bytes] | None:
    out, at = [], 0
    while at + 4 <= len(data) and (whole or len(out) < least):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out if len(out) >= least and (at == len(data) or not whole) else None


def _decoded(run: str) -> bytes:
    run = re.sub(r"[\r\n=]", "", run).replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _kind(data: bytes) -> str | None:
    return "der" if len(data) >= 16 and is_der(data) else "openssh" if len(data) >= 16 and is_openssh(data) else None


def _encoded(text: str, start: int) -> tuple[int, str] | None:
    """(end, kind) of the key whose Base64 begins at start; its own lengths say how far it goes, over line ends."""
    head = _decoded(text[start : start + 24])
    if text[start] == "M":
        size = _der_length(head, 1)
        sizes = [sum(size)] if head[0] == 0x30 and size else []
        run = _RUN.match(text, start, start + 4 * sizes[0] + 8)[0] if sizes else ""
    elif re.match(rb"\0\0\0[\x04-\x60](?:ssh|ecdsa|sk)-|openssh-key-v1\0", head):
        run = _RUN.match(text, start)[0].rstrip("\r\n-")
        sizes = _openssh_sizes(_decoded(run))
    else:
        return None
    lines, at, ends = [], 0, []  # where each line begins in run, and how many symbols come before it
    for line in re.finditer(r"[^\r\n]+", run):
        lines.append(line[0])
        ends.append((at, line.start()))
        at += len(line[0])
    symbols = "".join(lines)
    for size in reversed(sizes):
        n = (4 * size + 2) // 3
        if size < 16 or n > len(symbols):
            continue
        before, begin = next(x for x in reversed(ends) if x[0] < n)
        end = start + begin + n - before
        if _MORE.match(text, end) and not (n % 4 and re.match(rf"={{{-n % 4}}}(?![A-Za-z0-9+/_=])", text[end : end + 4])):
            continue
        if kind := _kind(_decoded(symbols[:n])):
            while n % 4 and (pad := _PAD.match(text, end)):
                n, end = n + 1, pad.end()
            return end, kind
    return None


def _openssh_sizes(data: bytes) -> list[int]:
    """Numbers of bytes after which an OpenSSH key may end: a private key's own, or after any field of a public key."""
    private = data.startswith(b"openssh-key-v1\0")
    at, out, fields = 15 if private else 0, [], 0
    most = 1 << 30
    while at + 4 <= len(data) and fields < most:
        size = int.from_bytes(data[at : at + 4], "big")
        if private and fields == 3 and most == 1 << 30:
            most, at = 3 + min(size, 1 << 20) + 1, at + 4  # how many public keys follow, then the private part
            continue
        if at + 4 + size > len(data):
            break
        at, fields = at + 4 + size, fields + 1
        out.append(at)
    return (out[-1:] if fields == most else [len(data)]) if private else out


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans whose decoded contents have the structure of a key or signed token."""
    out = []
    if "eyJ" in text:
        for m in _TOKEN.finditer(text):
            try:
                head = json.loads(_decoded(m[0].split(".")[0]))
            except (ValueError, RecursionError):
                continue
            if isinstance(head, dict) and isinstance(head.get("alg"), str):
                out.append((m.start(), m.end(), "jwt"))
    done = 0
    for m in _BASE64.finditer(text):
        if m.start() >= done and (found := _encoded(text, m.start())):
            out.append((m.start(), *found))
            done = found[0]
    for m in _HEX_ANY.finditer(text):
        if text.startswith(("30", "00", "6f"), m.start()) and (kind := _kind(bytes.fromhex(m[0]))):
            out.append((m.start(), m.end(), kind))
    return out


def secret_spans(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind."""
    return sorted(set(base_spans(text) + confirmed_spans(text)), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in pieces(batches, 1):
        found = [[{"kind": k, "start": a, "end": b} for a, b, k in secret_spans(t or "")] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["id", "spans"])


def scan_secrets(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id_ and spans (kind, start, end; by start, then kind), one row for each row of docs."""
    kind = dict(docs.dtypes)[id_]
    rows = docs.select(F.col(id_).alias("id"), F.col(text).alias("text")).mapInArrow(_scan, f"id {kind}, spans array<struct<kind:string,start:int,end:int>>")
    return rows.withColumnRenamed("id", id_)
