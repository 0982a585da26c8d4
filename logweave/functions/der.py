"""What a DER-encoded certificate or public key says."""

from __future__ import annotations

import hashlib
from datetime import datetime

# fixed values of the public standards: tags, object identifiers and their usual names
INTEGER, BITS, OID, SEQUENCE, SET, UTC, GENERAL_TIME = 0x02, 0x03, 0x06, 0x30, 0x31, 0x17, 0x18
NAMES = {
    "2.5.4.3": "CN", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "S", "2.5.4.10": "O", "2.5.4.11": "OU", "1.2.840.113549.1.9.1": "E", "0.9.2342.19200300.100.1.25": "DC",
    "1.2.840.113549.1.1.1": "RSA", "1.2.840.10045.2.1": "ECC", "1.2.840.113549.1.1.5": "sha1RSA", "1.2.840.113549.1.1.11": "sha256RSA", "1.2.840.113549.1.1.12": "sha384RSA",
    "1.2.840.113549.1.1.13": "sha512RSA", "1.2.840.10045.4.3.2": "sha256ECDSA", "1.2.840.10045.4.3.3": "sha384ECDSA", "1.2.840.10045.4.3.4": "sha512ECDSA",
}
CURVES = {"1.2.840.10045.3.1.7": 256, "1.3.132.0.34": 384, "1.3.132.0.35": 521}
OTHER_NAMES = "2.5.29.17"


def items(data: bytes) -> list[tuple[int, bytes, bytes]]:
    """Tag, content and whole encoding of the elements that follow each other."""
    out, at = [], 0
    while at < len(data):
        tag, n, start = data[at], data[at + 1], at + 2
        if n & 0x80:
            start += n & 0x7F
            n = int.from_bytes(data[at + 2 : start])
        if start + n > len(data):
            raise ValueError("cut short")
        out.append((tag, data[start : start + n], data[at : start + n]))
        at = start + n
    return out


def _oid(data: bytes) -> str:
    numbers, value = [], 0
    for b in data:
        value = value << 7 | b & 0x7F
        if not b & 0x80:
            numbers.append(value)
            value = 0
    first = min(numbers[0] // 40, 2)
    return ".".join(map(str, [first, numbers[0] - 40 * first, *numbers[1:]]))


def _named(data: bytes) -> str:
    oid = _oid(data)
    return NAMES.get(oid, oid)


def _who(data: bytes) -> str:
    """A name, its most specific part first."""
    parts = []
    for _, one, _ in items(data):
        for _, pair, _ in items(one):
            (_, kind, _), (tag, value, _) = items(pair)
            parts.append(f"{_named(kind)}={value.decode('utf-16-be' if tag == 0x1E else 'utf-8')}")
    return ", ".join(reversed(parts))


def _when(tag: int, data: bytes) -> str:
    text = data.decode("ascii")
    if tag == UTC:  # two digits of the year, from 1950 on
        text = ("19" if text >= "50" else "20") + text
    return datetime.strptime(text, "%Y%m%d%H%M%SZ").strftime("%Y-%m-%d %H:%M:%S UTC")


def public_key(data: bytes) -> dict:
    """algorithm, bits and exponent of the content of a SubjectPublicKeyInfo."""
    (tag, algorithm, _), (last, key, _) = items(data)
    if tag != SEQUENCE or last != BITS:
        raise ValueError("no public key")
    (kind, oid, _), *parameters = items(algorithm)
    if kind != OID:
        raise ValueError("no algorithm")
    name, bits, exponent = _named(oid), None, None
    if name == "RSA":
        numbers = items(items(key[1:])[0][1])
        bits, exponent = int.from_bytes(numbers[0][1]).bit_length(), int.from_bytes(numbers[1][1])
    elif name == "ECC" and parameters and parameters[0][0] == OID:
        bits = CURVES.get(_oid(parameters[0][1]))
    return {"algorithm": name, "bits": bits, "exponent": exponent}


def certificate(data: bytes, whole: bytes) -> dict:
    """The fields of the content of a certificate."""
    (_, body, _), (_, signed, _), _ = items(data)
    fields = items(body)
    if fields[0][0] == 0xA0:  # the version
        fields = fields[1:]
    (tag, serial, _), _, (_, issuer, _), (_, valid, _), (_, subject, _), (_, key, _), *more = fields
    if tag != INTEGER:
        raise ValueError("no serial number")
    first, last = (_when(t, d) for t, d, _ in items(valid))
    others = []
    for t, extensions, _ in more:
        for _, e, _ in items(items(extensions)[0][1]) if t == 0xA3 else []:
            parts = items(e)
            if _oid(parts[0][1]) == OTHER_NAMES:
                for kind, name, _ in items(items(parts[-1][1])[0][1]):
                    if kind == 0x82:
                        others.append(name.decode("ascii"))
                    elif kind == 0x87 and len(name) == 4:
                        others.append(".".join(map(str, name)))
    said = {"subject": _who(subject), "issuer": _who(issuer), "serial": serial.hex().upper(), "not_before": first, "not_after": last, "thumbprint": hashlib.sha1(whole).hexdigest().upper()}
    return said | {"signature": _named(items(signed)[0][1]), "names": others} | public_key(key)


def describe(data: bytes) -> dict | None:
    """kind (certificate or public key) and its fields, or None. What follows a certificate is ignored, what follows a key is not."""
    try:
        (tag, content, whole), *rest = items(data)
        if tag != SEQUENCE:
            return None
        if len(items(content)) == 3:
            return {"kind": "certificate"} | certificate(content, whole)
        return None if rest else {"kind": "public key"} | public_key(content)
    except (ValueError, IndexError, TypeError):
        return None
