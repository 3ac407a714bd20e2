"""Confirmed spans against secrets that are built field by field: what was built is found where it stands, what was spoilt isn't."""

from __future__ import annotations

import base64
import json
import random

from gavel.llm.secret_scan import confirmed_spans


def der(tag, body):
    """A DER value, its length in the short or the long form."""
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 | (n := (size.bit_length() + 7) // 8)]) + size.to_bytes(n)
    return bytes([tag]) + head + body


def number(rng, n):
    return der(0x02, bytes([rng.randrange(1, 128)]) + rng.randbytes(n - 1))


def built(kind, rng):
    if kind == "pkcs1":
        return der(0x30, der(0x02, b"\0") + b"".join(number(rng, n) for n in (128, 3, 128, 64, 64, 64, 64, 64)))
    if kind == "pkcs8":
        return der(0x30, der(0x02, b"\0") + der(0x30, der(0x06, bytes.fromhex("2b6570"))) + der(0x04, der(0x04, rng.randbytes(32))))
    if kind == "sec1":
        return der(0x30, der(0x02, b"\1") + der(0x04, rng.randbytes(32)))
    field = lambda x: len(x).to_bytes(4) + x
    return b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4) + field(rng.randbytes(51)) + field(rng.randbytes(200))


def spoilt(key, rng):
    """The same length and nearly the same bytes, but the lengths no longer add up."""
    key = bytearray(key)
    key[1 if key[0] == 0x30 else 18] ^= 0x15
    return bytes(key)


def token(rng, whole):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    header = {"alg": "HS256", "typ": "JWT"} if whole else {"typ": "JWT", "kid": rng.randrange(100)}
    return f"{part(header)}.{part({'sub': str(rng.randrange(10**6))})}.{base64.urlsafe_b64encode(rng.randbytes(32)).decode().rstrip('=')}"


def test_built_secrets_are_found_where_they_stand():
    rng = random.Random(31)
    found_kinds = set()
    for turn in range(400):
        text, want = "é filler words " * rng.randrange(3), []
        for _ in range(rng.randrange(1, 4)):
            whole = rng.random() < 0.6
            shape = rng.choice(["base64", "urlsafe", "hex", "pem", "token"])
            if shape == "token":
                body, kind = token(rng, whole), "jwt"
            else:
                source = rng.choice(["pkcs1", "pkcs8", "sec1", "openssh"])
                key = built(source, rng)
                key = key if whole else spoilt(key, rng)
                encode = base64.urlsafe_b64encode if shape == "urlsafe" else base64.b64encode
                body, kind = (key.hex() if shape == "hex" else encode(key).decode()), "key"
                if shape == "pem":
                    lines = "\n".join(body[k : k + 64] for k in range(0, len(body), 64))
                    body, kind = f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----", "pem"
                found_kinds.add((source, shape))
            if whole:
                want.append((kind, len(text), len(text) + len(body)))
            text += body + rng.choice([" and ", "\n", ", then "])
        got = [s for s in confirmed_spans(text) if s[0] != "key" or not any(w[0] == "pem" and w[1] < s[1] < w[2] for w in want)]
        assert sorted(got) == sorted(want), (turn, text)
    assert len(found_kinds) == 16
