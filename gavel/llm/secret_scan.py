"""Secret scan with structural confirmation.

Three base patterns are reported as found. Further spans are reported only after their content
has been decoded and parsed: signed tokens (``jwt``) need a JSON header that names an algorithm,
armoured keys (``pem``) and bare base64 or hex blobs (``key``) need a DER structure whose nested
lengths add up, or the length-prefixed fields of an OpenSSH key.

Defined results: a null text counts as empty and has no spans; a very long text is scanned whole; spans
of several kinds at one place all stay; repeated rows are scanned each on
its own; an empty table gives an empty result; other columns of the input are ignored. Offsets
are in code points, the end exclusive.
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
from pyspark.sql import types as T

from gavel.llm.common import batch, texts

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 24 and more: the same spans as all runs, without the shorter ones.
HEX = re.compile(r"[0-9a-f]{24,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{48,}+={0,2}")
KINDS = ("assign", "access", "hex", "jwt", "pem", "key")
OPENSSH = b"openssh-key-v1\0"

Span = tuple[str, int, int]


def der_fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of consecutive DER values that fill ``data`` exactly, else None."""
    fields, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n]), at + n
        if at + size > len(data):
            return None
        fields.append((tag, data[at : at + size]))
        at += size
    return fields


def is_der_key(data: bytes) -> bool:
    """A private key of PKCS#1, PKCS#8 or SEC1: one sequence that starts with a version number."""
    outer = der_fields(data)
    if outer is None or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_fields(outer[0][1])
    if inner is None or len(inner) < 2 or inner[0][0] != 0x02 or len(inner[0][1]) != 1 or inner[0][1][0] > 1:
        return False
    tags = [tag for tag, _ in inner]
    if len(inner) >= 9 and set(tags) == {0x02}:  # PKCS#1: modulus, exponents, primes
        return True
    if tags[1] == 0x30 and len(inner) >= 3 and tags[2] == 0x04:  # PKCS#8: algorithm, key
        algorithm = der_fields(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return tags[1] == 0x04 and len(inner[1][1]) >= 16 and len(inner) >= 2  # SEC1


def is_openssh_key(data: bytes) -> bool:
    """The magic, then cipher, key derivation and options as length-prefixed strings."""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4])
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4]) <= 16


def is_key(data: bytes) -> bool:
    return is_openssh_key(data) or is_der_key(data)


def from_base64(text: str) -> bytes | None:
    text = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, payload: str) -> bool:
    """Header and claims are JSON objects, and the header names an algorithm."""
    parts = []
    for part in (header, payload):
        try:
            parts.append(json.loads(from_base64(part) or b""))
        except (ValueError, RecursionError):
            return False
    return all(isinstance(x, dict) for x in parts) and isinstance(parts[0].get("alg"), str)


def base_spans(text: str) -> list[Span]:
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def confirmed_spans(text: str) -> list[Span]:
    """Spans whose decoded content has the structure of a key or of a signed token."""
    found = []
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in JWT.finditer(text) if is_signed_token(m[1], m[2])]
    if "-----BEGIN" in text:
        found += [("pem", *m.span()) for m in PEM.finditer(text) if is_key(from_base64(m[2]) or b"")]
    for m in BLOB.finditer(text):
        blob = m[0].rstrip("=")
        decoded = None
        if len(blob) % 2 == 0 and re.fullmatch("[0-9a-fA-F]+", blob):
            decoded = bytes.fromhex(blob)
        if not (decoded and is_key(decoded)):
            decoded = from_base64(blob)
        if decoded and is_key(decoded):
            found.append(("key", *m.span()))
    return found


def joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, counts of the base kinds, base and all spans as text.

    A map over the rows without any shuffle; memory is bounded by one Arrow batch.
    """
    out = T.StructType().add(id_col, docs.schema[id_col].dataType)
    for name in ("n_assign", "n_access", "n_hex", "n_confirmed"):
        out = out.add(name, T.LongType())
    out = out.add("base_spans", T.StringType()).add("spans", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [(base_spans(t), confirmed_spans(t)) for t in texts(rows.column(1))]
            count = lambda kind: [sum(x[0] == kind for x in base) for base, _ in found]
            whole = [sorted(b + c, key=lambda x: (x[1], KINDS.index(x[0]))) for b, c in found]
            fields = [pa.field(id_col, rows.column(0).type), *(pa.field(n, pa.int64()) for n in ("n_assign", "n_access", "n_hex", "n_confirmed")), pa.field("base_spans", pa.string()), pa.field("spans", pa.string())]
            yield batch(
                pa.schema(fields), rows.column(0), count("assign"), count("access"), count("hex"),
                [len(c) for _, c in found], [joined(b) for b, _ in found], [joined(x) for x in whole],
            )

    return docs.select(F.col(f"`{id_col}`"), text_col).mapInArrow(run, out)
