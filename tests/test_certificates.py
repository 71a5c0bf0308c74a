"""Certificates that the test writes itself, element by element."""

import base64
import struct
from datetime import datetime

from quillgraph.sources import certificates as C


def tlv(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8)) + body


def oid(text):
    a, b, *rest = map(int, text.split("."))
    out = []
    for v in (40 * a + b, *rest):
        part = [v & 0x7F]
        while v := v >> 7:
            part.append(0x80 | v & 0x7F)
        out += part[::-1]
    return tlv(6, bytes(out))


def integer(v):
    return tlv(2, v.to_bytes(v.bit_length() // 8 + 1))


def name(**parts):
    back = {v: k for k, v in C.NAMES.items()}
    return tlv(0x30, *(tlv(0x31, tlv(0x30, oid(back[k]), tlv(0x0C, v.encode()))) for k, v in parts.items()))


def made(key, signature, years=(b"200101000000Z", b"20550101000000Z"), version=True):
    signed = tlv(0x30, oid(signature), tlv(5))
    validity = tlv(0x30, tlv(0x17, years[0]), tlv(0x18, years[1]))
    tbs = tlv(0x30, *([tlv(0xA0, integer(2))] if version else []), integer(0xBEEF), signed, name(O="Root", CN="ca"), validity, name(CN="host.example", OU="x"), key)
    return tlv(0x30, tbs, signed, tlv(3, b"\0sig"))


def rsa(bits):
    return tlv(0x30, tlv(0x30, oid("1.2.840.113549.1.1.1"), tlv(5)), tlv(3, b"\0", tlv(0x30, integer((1 << bits - 1) | 1), integer(65537))))


EC = tlv(0x30, tlv(0x30, oid("1.2.840.10045.2.1"), oid("1.3.132.0.34")), tlv(3, b"\0\4xy"))
ED = tlv(0x30, tlv(0x30, oid("1.3.101.112")), tlv(3, b"\0" + b"k" * 32))


def pem(der, what="CERTIFICATE"):
    return f"-----BEGIN {what}-----\n".encode() + base64.encodebytes(der) + f"-----END {what}-----\n".encode()


def test_assets(spark):
    good, short, old = made(rsa(2048), "1.2.840.113549.1.1.11"), made(rsa(1024), "1.2.840.113549.1.1.11", version=False), made(EC, "1.2.840.10045.4.1")
    store = C.JKS + struct.pack(">II", 2, 2) + struct.pack(">I", 2) + b"\0\1a" + b"\0" * 8 + b"\0\5X.509" + struct.pack(">I", len(good)) + good
    store += struct.pack(">I", 1) + b"\0\1b" + b"\0" * 8 + struct.pack(">I", 3) + b"key" + struct.pack(">I", 1) + b"\0\5X.509" + struct.pack(">I", len(old)) + old + b"digest"
    files = {
        "a/ca.pem": b"text\n" + pem(good) + pem(short) + pem(b"key", "RSA PRIVATE KEY"),
        "b.der": old,
        "c.crt": pem(made(ED, "1.3.101.112")),
        "d.jks": store,
        "e.pem": pem(good[:-40]) + pem(b"\x30\x82\xff\xff"),
        "f.key": pem(b"x", "PRIVATE KEY"),
        "g.txt": b"nothing",
        "noname": pem(good),
        "h.jks": C.JKS + struct.pack(">II", 2, 9),
        "i.cer": b"",
    }
    rows = C.assets(spark.createDataFrame([(p, bytearray(b)) for p, b in files.items()], "path string, content binary")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.path, []).append((r.kind, r.key_type, r.key_bits, r.signature, r.weak, r.error is None))
    assert got == {
        "a/ca.pem": [("certificate", "rsa", 2048, "sha256-rsa", False, True), ("certificate", "rsa", 1024, "sha256-rsa", True, True), ("private-key", None, None, None, False, True)],
        "b.der": [("certificate", "ec", 384, "sha1-ecdsa", True, True)],
        "c.crt": [("certificate", "ed25519", 256, "ed25519", False, True)],
        "d.jks": [("certificate", "rsa", 2048, "sha256-rsa", False, True), ("certificate", "ec", 384, "sha1-ecdsa", True, True), ("private-key", None, None, None, False, True)],
        "e.pem": [("certificate", None, None, None, False, False)] * 2,
        "f.key": [("private-key", None, None, None, False, True)],
        "noname": [("certificate", "rsa", 2048, "sha256-rsa", False, True)],
        "h.jks": [("certificate", None, None, None, False, False)],
    }
    one = next(r for r in rows if r.path == "b.der")
    assert (one.subject, one.issuer, one.serial) == ("CN=host.example,OU=x", "O=Root,CN=ca", "beef")
    assert C.certificate(old)[3].replace(tzinfo=None) == datetime(2020, 1, 1) and C.certificate(old)[4].year == 2055
    assert len({r.sha256 for r in rows if r.path in ("a/ca.pem", "d.jks", "noname") and r.key_bits == 2048}) == 1
