"""Cryptographic assets of files: X.509 certificates in PEM, DER and Java keystores, and whether a private key is there.

Of a private key nothing but its presence is told.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Algorithms and curves by object identifier, and the bits of curves.
KEYS = {"1.2.840.113549.1.1.1": "rsa", "1.2.840.10045.2.1": "ec", "1.2.840.10040.4.1": "dsa", "1.3.101.112": "ed25519", "1.3.101.113": "ed448"}
SIGNATURES = {
    "1.2.840.113549.1.1.4": "md5-rsa", "1.2.840.113549.1.1.5": "sha1-rsa", "1.2.840.113549.1.1.10": "rsa-pss", "1.2.840.113549.1.1.11": "sha256-rsa", "1.2.840.113549.1.1.12": "sha384-rsa", "1.2.840.113549.1.1.13": "sha512-rsa",
    "1.2.840.10045.4.1": "sha1-ecdsa", "1.2.840.10045.4.3.2": "sha256-ecdsa", "1.2.840.10045.4.3.3": "sha384-ecdsa", "1.2.840.10045.4.3.4": "sha512-ecdsa", "1.3.101.112": "ed25519", "1.3.101.113": "ed448",
}
CURVES = {"1.2.840.10045.3.1.7": 256, "1.3.132.0.34": 384, "1.3.132.0.35": 521, "1.3.132.0.10": 256}
#: Parts of a name.
NAMES = {"2.5.4.3": "CN", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.10": "O", "2.5.4.11": "OU"}
#: How files with private keys look, and file names that are read.
KEY_MARK = re.compile(rb"-----BEGIN (?:RSA |EC |DSA |ENCRYPTED |OPENSSH )?PRIVATE KEY-----")
JKS = b"\xfe\xed\xfe\xed"
FILES = r"\.(pem|crt|cer|der|jks|keystore|key)$"
MIN_RSA = 2048

ASSETS = "path string, kind string, subject string, issuer string, serial string, not_before timestamp, not_after timestamp, key_type string, key_bits int, signature string, sha256 string, weak boolean, error string"


def items(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(tag, begin, end) of each DER element between two places; raises ValueError where one reaches beyond."""
    end = len(data) if end is None else end
    while at < end:
        tag, n, at = data[at], data[at + 1] if at + 1 < end else -1, at + 2
        if n < 0 or tag & 0x1F == 0x1F:
            raise ValueError("no such element")
        if n & 0x80:
            width = n & 0x7F
            if not 0 < width <= 4 or at + width > end:
                raise ValueError("no such length")
            n, at = int.from_bytes(data[at : at + width]), at + width
        if at + n > end:
            raise ValueError("an element reaches beyond its place")
        yield tag, at, at + n
        at += n


def oid(raw: bytes) -> str:
    parts, value = [], 0
    for b in raw:
        value = value << 7 | b & 0x7F
        if not b & 0x80:
            parts.append(value)
            value = 0
    first = min(parts[0] // 40, 2)
    return ".".join(map(str, [first, parts[0] - 40 * first, *parts[1:]]))


def _name(data: bytes, a: int, b: int) -> str:
    out = []
    for _, x, y in items(data, a, b):
        for _, p, q in items(data, x, y):
            (_, i, j), (tag, k, n) = list(items(data, p, q))[:2]
            known = NAMES.get(oid(data[i:j]))
            if known:
                out.append(f"{known}={data[k:n].decode('utf-16-be' if tag == 0x1E else 'utf-8', 'replace')}")
    return ",".join(out)


def _time(tag: int, raw: bytes) -> datetime:
    text = raw.decode("ascii")
    if tag == 0x17:  # two digits of the year, 50 and up are of the last century
        text = ("19" if int(text[:2]) >= 50 else "20") + text
    return datetime.strptime(text[:14], "%Y%m%d%H%M%S").replace(tzinfo=UTC)


def certificate(data: bytes) -> tuple:
    """The fields of ASSETS between kind and error of one DER certificate."""
    (_, a, b), *_ = items(data)
    (_, x, y), (_, sa, sb), *_ = items(data, a, b)
    fields = list(items(data, x, y))
    if fields[0][0] == 0xA0:  # the version
        fields = fields[1:]
    serial, _, issuer, validity, subject, key = fields[:6]
    before, after = (_time(t, data[i:j]) for t, i, j in items(data, validity[1], validity[2]))
    (_, ka, kb), (_, pa, pb) = list(items(data, key[1], key[2]))[:2]
    algorithm = list(items(data, ka, kb))
    kind = KEYS.get(oid(data[algorithm[0][1] : algorithm[0][2]]), "other")
    bits = None
    if kind in ("rsa", "dsa"):
        place = next(items(data, pa + 1, pb)) if kind == "rsa" else algorithm[1]
        modulus = next(items(data, place[1], place[2]))
        bits = int.from_bytes(data[modulus[1] : modulus[2]]).bit_length()
    elif kind == "ec" and len(algorithm) > 1 and algorithm[1][0] == 0x06:
        bits = CURVES.get(oid(data[algorithm[1][1] : algorithm[1][2]]))
    elif kind.startswith("ed"):
        bits = {"ed25519": 256, "ed448": 456}[kind]
    first = next(items(data, sa, sb))
    signed = SIGNATURES.get(oid(data[first[1] : first[2]]), "other")
    weak = kind in ("rsa", "dsa") and bits < MIN_RSA or signed.startswith(("md5", "sha1"))
    return _name(data, subject[1], subject[2]), _name(data, issuer[1], issuer[2]), f"{int.from_bytes(data[serial[1] : serial[2]], signed=True):x}", before, after, kind, bits, signed, hashlib.sha256(data[: b]).hexdigest(), bool(weak)


def _keystore(data: bytes) -> tuple[list[bytes], bool]:
    """Certificates of a Java keystore, and whether it holds a private key."""
    version, count = struct.unpack(">II", data[4:12])
    at, found, private = 12, [], False

    def text() -> bytes:
        nonlocal at
        n = struct.unpack(">H", data[at : at + 2])[0]
        at += 2 + n
        return data[at - n : at]

    def block() -> bytes:
        nonlocal at
        n = struct.unpack(">I", data[at : at + 4])[0]
        if at + 4 + n > len(data):
            raise ValueError("a block reaches beyond the file")
        at += 4 + n
        return data[at - n : at]

    for _ in range(count):
        kind = struct.unpack(">I", data[at : at + 4])[0]
        at += 4
        text()
        at += 8
        chain = 1
        if kind == 1:
            private = True
            block()
            chain = struct.unpack(">I", data[at : at + 4])[0]
            at += 4
        elif kind != 2:
            raise ValueError("no such entry")
        for _ in range(chain):
            if version == 2:
                text()
            found.append(block())
    return found, private


def assets_of(data: bytes) -> Iterator[tuple]:
    """(kind, fields…, error) of one file's certificates and private key."""
    none = (None,) * 9 + (False,)
    private, error, ders = bool(KEY_MARK.search(data)), None, []
    try:
        if data.startswith(JKS):
            ders, private = _keystore(data)
        elif b"-----BEGIN CERTIFICATE-----" in data:
            ders = [base64.b64decode(re.sub(rb"\s", b"", m)) for m in re.findall(rb"-----BEGIN CERTIFICATE-----(.*?)-----END CERTIFICATE-----", data, re.S)]
        elif data[:1] == b"\x30":
            ders = [data]
    except (ValueError, struct.error) as e:
        error = f"{type(e).__name__}: {e}"
        yield "certificate", *none, error
    for der in ders:
        try:
            yield "certificate", *certificate(der), None
        except (ValueError, IndexError, StopIteration, RuntimeError) as e:
            yield "certificate", *none, f"{type(e).__name__}: {e}"
    if private:
        yield "private-key", *none, None


def assets(files: DataFrame) -> DataFrame:
    """ASSETS of the files (path, content) that may hold some; what can't be read is a row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *row) for path, content in zip(frame["path"], frame["content"], strict=True) for row in assets_of(bytes(content))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ASSETS.split(", ")]).astype({"key_bits": "Int32"})

    head = F.substring("content", 1, 4)
    wanted = F.lower("path").rlike(FILES) | (head == F.lit(bytearray(JKS))) | F.coalesce(F.substring("content", 1, 64).cast("string").contains("-----BEGIN"), F.lit(False))
    return files.where(wanted).select("path", "content").mapInPandas(run, ASSETS)
