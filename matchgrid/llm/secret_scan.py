"""Secret scan with structural confirmation.

Textual rules find assignments, access keys and hexadecimal strings. Candidates that claim a structure are decoded and
parsed before they are reported: base64 or hexadecimal text must hold a private key in DER form whose nested lengths fill
their parents exactly, an OpenSSH private key whose length-prefixed fields add up, or the three parts of a signed token
whose header names an algorithm. Public keys and certificates pass the parser but are not reported.

Spans are code points, end exclusive. Null text counts as empty; repeated rows are scanned one by one; a text of any
length is scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrid.llm.common import map_batches

KINDS = ("assign", "access", "hex", "jwt", "key", "pem", "ssh")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ANY_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
SIGNED = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
ARMOUR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----(.*?)-----END \1PRIVATE KEY-----", re.DOTALL)
#: No structural or plain candidate is shorter than this without white space.
SHORTEST = 20
OPENSSH = b"openssh-key-v1\x00"


def unbase64(text: str) -> bytes | None:
    """Strict decoding of either alphabet, padding optional."""
    body = text.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(raw: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of consecutive DER elements that fill ``raw`` exactly, else None."""
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        tag, size = raw[at], raw[at + 1]
        at += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(raw):
                return None
            size = int.from_bytes(raw[at : at + width], "big")
            if size < 128 or size >> 8 * (width - 1) == 0:
                return None  # DER writes lengths as short as possible
            at += width
        if at + size > len(raw):
            return None
        out.append((tag, raw[at : at + size]))
        at += size
    return out


def is_private_key(raw: bytes | None) -> bool:
    """A DER private key: RSA numbers, an elliptic-curve scalar, or either wrapped with its algorithm."""
    if not raw or raw[0] != 0x30:
        return False
    top = elements(raw)
    if not top or len(top) != 1:
        return False
    parts = elements(top[0][1])
    if not parts or parts[0][0] != 0x02 or len(parts[0][1]) != 1:
        return False
    version, tags = parts[0][1][0], [t for t, _ in parts]
    if version in (0, 1) and len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True
    if version == 1 and len(tags) >= 2 and tags[1] == 0x04 and len(parts[1][1]) >= 16:
        return all(elements(body) is not None for tag, body in parts[2:] if tag & 0x20)
    if version in (0, 1) and len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
        algorithm = elements(parts[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def is_openssh_key(raw: bytes | None) -> bool:
    """``openssh-key-v1``: cipher, kdf, options, count, public keys and the private block, all length-prefixed."""
    if not raw or not raw.startswith(OPENSSH):
        return False
    at = len(OPENSSH)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(raw):
            return None
        size = int.from_bytes(raw[at : at + 4], "big")
        at += 4
        if at + size > len(raw):
            return None
        at += size
        return raw[at - size : at]

    if any(field() is None for _ in range(3)) or at + 4 > len(raw):
        return False
    count = int.from_bytes(raw[at : at + 4], "big")
    at += 4
    if not 1 <= count <= 16 or any(field() is None for _ in range(count)):
        return False
    return bool(field()) and at == len(raw)


def is_signed_token(text: str) -> bool:
    """Header and payload are JSON objects and the header names an algorithm; ``none`` needs no signature."""
    head, body, tail = text.split(".")
    try:
        header, payload = json.loads(unbase64(head) or b""), json.loads(unbase64(body) or b"")
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(payload, dict) or not isinstance(header.get("alg"), str):
        return False
    return header["alg"].lower() == "none" or unbase64(tail) not in (None, b"")


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of every finding, by start, then in the order of ``KINDS``, then by end."""
    text = text or ""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if any(len(w) >= SHORTEST for w in text.split()):
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        found += [("jwt", m.start(), m.end()) for m in SIGNED.finditer(text) if is_signed_token(m[0])]
        for m in ANY_HEX.finditer(text):
            if len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0])):
                found.append(("key", m.start(), m.end()))
        for m in BASE64.finditer(text):
            raw = unbase64(m[0])
            if is_private_key(raw):
                found.append(("key", m.start(), m.end()))
            elif is_openssh_key(raw):
                found.append(("ssh", m.start(), m.end()))
        if "-----BEGIN " in text:
            for m in ARMOUR.finditer(text):
                lines = [x.strip() for x in m[2].strip().splitlines()]
                raw = unbase64("".join(x for x in lines if ":" not in x))
                sealed = any(x.startswith("Proc-Type: 4,ENCRYPTED") for x in lines) or m[1] == "ENCRYPTED "
                if raw and (is_private_key(raw) or sealed):
                    found.append(("pem", m.start(), m.end()))
                elif is_openssh_key(raw):
                    found.append(("ssh", m.start(), m.end()))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(found), key=lambda s: (s[1], order[s[0]], s[2]))


def redact(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str | None:
    """Text with every maximal run of covered characters replaced by ``mark``."""
    if text is None or not spans:
        return text
    out, stop = [], 0
    for _, a, b in spans:
        if not out or a > stop:
            out += [text[stop:a], mark]
        stop = max(stop, b)
    return "".join(out) + text[stop:]


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, spans``: an array of ``kind, start, stop`` per row, empty where nothing was found."""
    kind = docs.schema[key].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [[{"kind": k, "start": s, "stop": e} for k, s, e in scan(t.as_py())] for t in b.column(1)]
            return pa.record_batch([b.column(0), pa.array(rows, pa.list_(span))], names=[key, "spans"])

        return step

    return map_batches(docs.select(F.col(key), F.col(text)), make, f"`{key}` {kind}, spans array<struct<kind:string,start:long,stop:long>>")


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """All columns of ``docs``, with the secrets in ``text`` replaced by ``mark``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def make():
        def step(b: pa.RecordBatch) -> pa.Table:
            at = b.schema.get_field_index(text)
            rows = [redact(t.as_py(), scan(t.as_py()), mark) for t in b.column(at)]
            cols = [pa.array(rows, pa.string()) if i == at else b.column(i) for i in range(b.num_columns)]
            return pa.table(cols, names=b.schema.names)

        return step

    return map_batches(docs, make, schema)


def span_text(kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans (of the given kinds), comma-joined."""
    spans = F.col("spans")
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

