"""Secret scan with structural confirmation (operator 8).

Pattern matches alone decide the three base kinds (assign, access, hex). Candidates for the
confirmed kinds are decoded first (base64, base64url or hex) and reported only if their bytes
parse: a private-key encoding, plain or encrypted, whose nested lengths fill their parents, an
OpenSSH key whose length-prefixed fields fill it, a PEM block with encryption headers around whole
cipher blocks, or a signed token whose header is JSON with an ``alg`` and whose payload is JSON.

Defined cases: null and empty texts give zero counts, the hash of the empty string and no
spans; repeated rows give repeated results; texts of any length are scanned whole, in linear time;
an empty table gives none; other columns of the input are ignored, whatever their names. Spans
that begin at one place are ordered by kind as listed, then by end.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from octofold.llm.common import map_rows, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
PEM_LINE = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*)PRIVATE KEY-----")
PEM_BODY = re.compile(r"((?:\s*+[A-Za-z][A-Za-z0-9-]*+: [^\n]*+\n)*+)([A-Za-z0-9+/=\s\\]++)")
BLOB = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
URL_BLOB = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{40,}={0,2}")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "key64", "keyhex")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: No hex run of the base and no encoded key is shorter than this many characters.
LONG_WORD = 32


def der_fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) fields that fill ``data`` exactly; None if lengths do not nest."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n >= 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


MAGIC = b"openssh-key-v1\x00"


def is_openssh(data: bytes) -> bool:
    """Its magic, then cipher, key derivation and options, the number of keys, so many public
    keys, and the private part, all length-prefixed, to the end of the bytes."""
    at, keys, k = len(MAGIC), 1, 0
    while k < 4 + keys:
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if k == 3:
            keys = n
            if not 1 <= keys <= 64:
                return False
            k += 1
            continue
        at += n
        k += 1
    n = int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data) and n > 0 and at + 4 + n == len(data)


def is_private_key(data: bytes) -> bool:
    """A DER private key: one SEQUENCE fills the bytes and opens with a version INTEGER of 0 or 1,
    followed by integers (RSA, DSA), an octet string (EC) or an algorithm SEQUENCE with an OID and
    an octet string (PKCS 8); an encrypted one: an algorithm SEQUENCE and an octet string; or an
    OpenSSH key."""
    if data.startswith(MAGIC):
        return is_openssh(data)
    top = der_fields(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = der_fields(top[0][1])
    if inner and len(inner) == 2 and inner[0][0] == 0x30 and inner[1][0] == 0x04:
        algorithm = der_fields(inner[0][1])
        return bool(algorithm) and len(algorithm) == 2 and algorithm[0][0] == 0x06 and algorithm[1][0] == 0x30 and len(inner[1][1]) >= 16
    if not inner or len(inner) < 3 or inner[0][0] != 0x02 or inner[0][1] not in (b"\x00", b"\x01"):
        return False
    if inner[1][0] == 0x30:
        algorithm = der_fields(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and inner[2][0] == 0x04
    if inner[1][0] == 0x04:
        return len(inner[1][1]) >= 16
    return len(inner) >= 5 and all(tag == 0x02 for tag, _ in inner)


def unbase64(text: str, url: bool = False) -> bytes:
    """The decoded bytes; empty if the text is no base64."""
    body = text.rstrip("=")
    body += "=" * (-len(body) % 4)
    try:
        return base64.urlsafe_b64decode(body) if url else base64.b64decode(body, validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_token(head: str, payload: str) -> bool:
    try:
        head, payload = (json.loads(unbase64(x, url=True)) for x in (head, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(payload, dict)


def pem_blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and content of each BEGIN line that the END line of its name follows next: every
    character is read once, however many BEGIN lines never end."""
    begin = None
    for m in PEM_LINE.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin and begin[2] == m[2]:
            yield begin.start(), m.end(), text[begin.end() : m.start()]
            begin = None
        else:
            begin = None


def is_pem(headers: str, body: str) -> bool:
    data = unbase64(re.sub(r"\\[nr]|\s", "", body))
    if "ENCRYPTED" in headers and "DEK-Info:" in headers:
        return len(data) >= 64 and len(data) % 8 == 0
    return is_private_key(data)


def spans_of(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret, in no order; code points, end exclusive."""
    out: list[tuple[int, str, int]] = []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if b"-----BEGIN " in raw:
        for start, end, content in pem_blocks(text):
            m = PEM_BODY.fullmatch(content)
            if m and is_pem(m[1], m[2]):
                out.append((start, "pem", end))
    if max(map(len, raw.split()), default=0) >= LONG_WORD:
        out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
        out += [(m.start(), "keyhex", m.end()) for m in HEX_ANY.finditer(text) if is_private_key(bytes.fromhex(m[0]))]
        out += [(m.start(), "key64", m.end()) for m in BLOB.finditer(text) if is_private_key(unbase64(m[0]))]
        out += [(m.start(), "key64", m.end()) for m in URL_BLOB.finditer(text) if ("-" in m[0] or "_" in m[0]) and is_private_key(unbase64(m[0], url=True))]
        if b"eyJ" in raw:
            out += [(m.start(), "jwt", m.end()) for m in JWT.finditer(text) if is_token(m[1], m[2])]
    return out


def joined(spans: list[tuple[int, str, int]], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed."""
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], kinds.index(x[1]), x[2])))


def digest(doc_id: int | None, text: str | None) -> tuple:
    spans = spans_of(text) if text else []
    base = [x for x in spans if x[1] in BASE_KINDS]
    n = [sum(x[1] == k for x in base) for k in BASE_KINDS]
    sha = hashlib.sha256(joined(base, KINDS).encode()).hexdigest()
    return (doc_id, *n, sha, joined(spans, KINDS), len(spans) - len(base))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts by base kind, the hash of its base spans, all its spans
    and how many of them the decoders confirmed. No shuffle: rows stay where they were read."""
    schema = f"{id_col} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
    return map_rows(docs, [id_col, text_col], schema, lambda: digest)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op8_secret_scan": op8_secret_scan}
