"""Secret scans with structural confirmation.

Base patterns give spans by form alone. Structural ones are reported only if what they encode parses: base64 or hex is
decoded and must be a DER key (nested lengths that fill their parents exactly), an OpenSSH private key or public key line (nested
length-prefixed strings), or a signed token whose header is a JSON object with an algorithm.

A block of texts is first searched for runs of candidate bytes without a Python step for each text; only texts with a run long
enough, or with an assignment mark, are searched by regular expressions, as a whole. Offsets count code points; ends are
exclusive. A null text is an empty one and has no span. Each row is searched by itself, so rows that repeat an id or a text have the
same spans; spans that start together are listed by kind and then end. Of other columns only n_chars is changed, by redact().
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as k

#: In the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "der_hex", "openssh", "sshpub")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{2}){24,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:[0-9A-F]{2}){24,}(?![0-9A-Za-z])")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,30}KEY)-----\s*([A-Za-z0-9+/=\s]+?)-----END \1-----")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}(?![A-Za-z0-9+/=])")

_HEX_BYTES, _B64_BYTES = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_HEX_BYTES[list(b"0123456789abcdef")] = 1
_B64_BYTES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = 1


def decode64(text: str) -> bytes | None:
    """Standard or URL-safe base64 with or without padding; None if it isn't."""
    text = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def der_tree(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list[tuple[int, int]] | None:
    """(tag, size) of the elements in data[at:end]; None unless they fill it exactly, at all levels of sequences and sets."""
    end = len(data) if end is None else end
    out: list[tuple[int, int]] = []
    while at < end:
        if end - at < 2 or depth > 16:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n]), at + n
            if size < 0x80:
                return None  # not the shortest form
        if at + size > end:
            return None
        if tag in (0x30, 0x31) and der_tree(data, at, at + size, depth + 1) is None:
            return None
        out.append((tag, size))
        at += size
    return out


def is_der_key(data: bytes | None) -> bool:
    """One outer sequence of at least 32 bytes that holds integers, algorithm identifiers or key strings."""
    if not data or data[0] != 0x30 or len(data) < 32:
        return False
    top = der_tree(data)
    if top is None or len(top) != 1:
        return False
    inner = der_tree(data, len(data) - top[0][1])
    tags = [t for t, _ in inner or ()]
    return len(tags) >= 2 and tags[0] in (0x02, 0x30) and all(t in (0x02, 0x03, 0x04, 0x30, 0xA0, 0xA1) for t in tags) and any(size >= 16 for _, size in inner or ())


def _strings(data: bytes, at: int, most: int) -> tuple[list[bytes], int]:
    """Up to `most` strings with a length of four bytes before each, and where they end."""
    out = []
    while len(out) < most and at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4])
        if at + 4 + size > len(data):
            break
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def is_openssh_key(data: bytes | None) -> bool:
    """The private key container: magic, cipher, kdf, options, count, then public keys and a private part."""
    magic = b"openssh-key-v1\0"
    if not data or not data.startswith(magic):
        return False
    head, at = _strings(data, len(magic), 3)
    if len(head) < 3 or at + 4 > len(data):
        return False
    count = int.from_bytes(data[at : at + 4])
    body, end = _strings(data, at + 4, count + 1) if 1 <= count <= 16 else ([], 0)
    return len(body) == count + 1 and end == len(data) and is_ssh_public(body[0])


def is_ssh_public(data: bytes | None) -> bool:
    """Strings that fill the data exactly, the first of them a key type."""
    if not data or len(data) < 20:
        return False
    parts, end = _strings(data, 0, 8)
    return end == len(data) and len(parts) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{2,40}", parts[0]) is not None


def is_signed_token(header: str, payload: str) -> bool:
    """The header is a JSON object that names an algorithm, and the payload is a JSON object or opaque but decodable."""
    raw = decode64(header)
    try:
        head = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and bool(decode64(payload))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of its kind, end) by the three base patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]


def structural_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of its kind, end) of what decodes and parses."""
    out = [(m.start(), 3, m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[1], m[2])] if "." in text else []
    if "-----BEGIN" in text:
        out += [(m.start(), 4, m.end()) for m in ARMOUR.finditer(text) if is_der_key(d := decode64(m[2])) or is_openssh_key(d)]
    for m in BASE64.finditer(text):
        data = decode64(m[0])
        for rank, holds in ((5, is_der_key), (7, is_openssh_key), (8, is_ssh_public)):
            if holds(data):
                out.append((m.start(), rank, m.end()))
    out += [(m.start(), 6, m.end()) for m in LONG_HEX.finditer(text) if is_der_key(bytes.fromhex(m[0]))]
    return out


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    """All spans of a text, sorted by start and then kind."""
    return sorted(base_spans(text or "") + structural_spans(text or ""), key=lambda s: (s[0], s[1], s[2]))


def _runs(block: k.Block, classes: np.ndarray, least: int) -> np.ndarray:
    """Offsets of runs of a class of at least so many bytes; a row's end also ends a run."""
    runs = k.tokenise(block, classes)
    return runs.start[runs.end - runs.start >= least]


def candidates(block: k.Block) -> np.ndarray:
    """Rows of a block that may hold a span: a run of 16 hex digits or of 40 token bytes, an assignment, a dot within a token, or a mark."""
    data, rows = block.data, [np.empty(0, np.int64)]
    if not data.size:
        return rows[0]
    whole = data.tobytes()
    hits = [_runs(block, _HEX_BYTES, 16), _runs(block, _B64_BYTES, 40)]
    hits += [np.flatnonzero((data == 61) | (data == 58))]
    for mark in (b"AKIA", b"-----BEGIN", b"eyJ", b"ewo", b"eyA", b"ewk"):
        # looked ahead for, so that one over a row's end doesn't hide one that begins within it
        hits.append(np.array([m.start() for m in re.finditer(b"(?=" + mark + b")", whole)], np.int64))
    found = np.concatenate(hits)
    dots = np.flatnonzero((data[1:-1] == 46) & (_B64_BYTES[data[:-2]] == 1) & (_B64_BYTES[data[2:]] == 1))
    return np.unique(np.searchsorted(block.offsets, np.concatenate([found, dots]), side="right") - 1)


SPAN_LIST = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def spans_in(column: pa.Array) -> pa.Array:
    """The spans of each text of a column, as lists of structs."""
    spans: list[list[dict]] = [[] for _ in range(len(column))]
    for block in k.blocks(column):
        for i in candidates(block):
            at = int(block.first + i)
            spans[at] = [{"kind": KINDS[rank], "start": a, "end": b} for a, rank, b in spans_of(column[at].as_py())]
    return pa.array(spans, SPAN_LIST)


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (kind, start, end) in column secret_spans, one row for each row of docs."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(k.trimmed(_without_text), f"doc_id long, secret_spans {SPANS}")


def _without_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column("doc_id"), spans_in(batch.column("text"))], ["doc_id", "secret_spans"])


def masked(text: str, spans: list[dict], mask: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping or touching spans replaced."""
    out, at, until = [], 0, -1
    for s in sorted(spans, key=lambda s: s["start"]):
        if s["start"] > until:
            out += [text[at : s["start"]], mask]
        until = max(until, s["end"])
        at = until
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret in column text masked and n_chars, where there is one, set to the new length; other columns stay."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            spans = spans_in(texts)
            hit = np.flatnonzero(np.diff(spans.offsets.to_numpy()))
            columns = {n: batch.column(n) for n in names}
            if len(hit):
                new = texts.to_pylist()
                sizes = columns["n_chars"].to_pylist() if "n_chars" in columns else None
                for i in hit:
                    new[i] = masked(new[i], spans[int(i)].as_py())
                    if sizes is not None:
                        sizes[i] = len(new[i])
                columns["text"] = pa.array(new, texts.type)
                if sizes is not None:
                    columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(k.trimmed(run), schema)
