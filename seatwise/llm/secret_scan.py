"""Secret scans with structural confirmation.

Three base kinds are plain patterns: ``assign`` (a secret's name, ``:`` or ``=``, six characters or more), ``access``
(``AKIA`` and 20 characters or more) and ``hex`` (24 lower-case hex digits or more). The other kinds are reported only when a
base64 or hex candidate decodes into bytes whose own structure is that of a secret:

* ``rsa dsa ec pkcs8 encrypted``: DER whose nested lengths all fit, in base64 (over several lines, or with escaped line
  breaks) or hex; an RSA key's modulus is the product of its primes, a DSA key's order divides its group, the private
  part of a PKCS#8 key is that of its algorithm. Public keys and certificates have other members and are none.
* ``openssh``: ``openssh-key-v1`` and its length-prefixed fields, which must end together.
* ``jwt``: three base64url parts whose header names a signing algorithm, whose payload is a JSON object, and whose signature
  has that algorithm's length.
* base64 of a PEM file is decoded and searched again, ``DEPTH`` times at most; the kind is that of the first key inside, and the
  span ends with that key's footer.

A first line of base64 has at least 24 characters and begins where no base64 character precedes it.
"""

from __future__ import annotations

import base64
import json
import re
from bisect import bisect_right

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "rsa", "dsa", "ec", "pkcs8", "encrypted", "openssh", "jwt")
DEPTH = 2
SCHEMA = "row struct<doc_id:long>, spans array<struct<kind:string,start:long,end:long>>"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(f"(?:{'|'.join(map(_either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")

_OWN = "(?:(?<![A-Za-z0-9+/_-])|(?<=\\\\n))"  # nothing of base64 before it, or an escaped line break
ANCHOR = re.compile(_OWN + "(?:M[A-Za-z0-9+/_-]{23}|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi)")
LINE = re.compile("[A-Za-z0-9+/_-]+")
BREAK = re.compile("\r?\n[ \t]*|(?:\\\\r)?\\\\n")
DIGITS = re.compile("(?<![0-9A-Fa-f])30[0-9A-Fa-f]{78,}")
FOOTER = re.compile("\\s*-----END[^\n-]*-----\r?\n?")
TOKEN = re.compile("(?<![A-Za-z0-9_-])(e[A-Za-z0-9_-]+)\\.([A-Za-z0-9_-]+)\\.([A-Za-z0-9_-]+)")
#: RE2: texts without a match have no span
MAYBE = ("(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|M[A-Za-z0-9+/_-]{23}|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi"
         "|30[0-9A-Fa-f]{78}|e[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]")

# DER tags, object identifiers, signature sizes in bytes (RS and PS: any size from 128).
INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
RSA_OID, EC_OID, DSA_OID = "2a864886f70d010101", "2a8648ce3d0201", "2a8648ce380401"
RAW_OIDS = {"2b656e": 32, "2b656f": 56, "2b6570": 32, "2b6571": 57}  # X25519, X448, Ed25519, Ed448
SEALED_OIDS = ("2a864886f70d0105", "2a864886f70d010c01")
SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}


def _header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, first byte of the content, one past the last) of the DER value at ``at``; it may end past ``data``."""
    if at + 2 > len(data):
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        more = size & 0x7F
        if not 1 <= more <= 4 or at + more > len(data) or not data[at]:
            return None
        size, at = int.from_bytes(data[at:at + more], "big"), at + more
        if size < 128:
            return None
    return tag, at, at + size


def _members(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the values that fill ``data`` exactly."""
    out, at = [], 0
    while at < len(data):
        head = _header(data, at)
        if not head or head[2] > len(data):
            return None
        out.append((head[0], data[head[1]:head[2]]))
        at = head[2]
    return out


def _whole(data: bytes) -> list[tuple[int, bytes]] | None:
    """Members of a sequence that is all of ``data``."""
    head = _header(data, 0)
    return _members(data[head[1]:]) if head and head[0] == SEQUENCE and head[2] == len(data) else None


def key_kind(data: bytes) -> str | None:
    """The kind of private key whose DER is all of ``data``."""
    members = _whole(data)
    if not members or len(members) < 2:
        return None
    tags = [t for t, _ in members]
    if tags[:2] == [SEQUENCE, OCTETS] and len(members) == 2:
        own = _members(members[0][1])
        sealed = own and own[0][0] == OID and own[0][1].hex().startswith(SEALED_OIDS)
        return "encrypted" if sealed and len(members[1][1]) >= 16 else None
    if tags[0] != INTEGER or len(members[0][1]) != 1:
        return None
    version = members[0][1][0]
    if set(tags[:6]) == {INTEGER}:
        n = [int.from_bytes(x, "big") for t, x in members if t == INTEGER]
        if len(n) >= 9 and version <= 1 and n[1] > 1 and n[4] > 1 and n[1] == n[4] * n[5] * (n[9] if version and len(n) > 9 else 1):
            return "rsa"
        if len(n) == 6 and len(members) == 6 and version == 0 and n[2] > 1 and n[1] % n[2] == 1 and 0 < n[5] < n[2]:
            return "dsa"
        return None
    if tags[1] == OCTETS and version == 1 and 16 <= len(members[1][1]) <= 72 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "ec"
    if tags[1:3] == [SEQUENCE, OCTETS] and version <= 1 and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:]):
        own = _members(members[1][1])
        if not own or own[0][0] != OID or not own[0][1]:
            return None
        oid, key = own[0][1].hex(), members[2][1]
        if oid in (RSA_OID, EC_OID):
            return "pkcs8" if key_kind(key) == ("rsa" if oid == RSA_OID else "ec") else None
        head = _header(key, 0)
        whole = head is not None and head[2] == len(key)
        if oid in RAW_OIDS:
            return "pkcs8" if whole and head[0] == OCTETS and head[2] - head[1] == RAW_OIDS[oid] else None
        return "pkcs8" if whole and (oid != DSA_OID or head[0] == INTEGER) else None
    return None


def openssh_size(data: bytes) -> int | None:
    """Bytes of the OpenSSH private key that ``data`` begins with."""
    def field(at):
        size = int.from_bytes(data[at:at + 4], "big")
        return at + 4 + size if at + 4 + size <= len(data) else None

    if not data.startswith(b"openssh-key-v1\0"):
        return None
    at = 15
    for _ in range(3):  # cipher, key derivation, its options
        at = field(at)
        if at is None:
            return None
    keys, at = int.from_bytes(data[at:at + 4], "big"), at + 4
    if not 1 <= keys <= len(data):
        return None
    for _ in range(keys + 1):  # public keys, then the private part
        last, at = at, field(at)
        if at is None:
            return None
    return at if at - last - 4 >= 8 and (at - last - 4) % 8 == 0 else None


def signed(header: str, payload: str, signature: str) -> int | None:
    """Characters of the signature that belong to a signed token with these parts."""
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in (header, payload))
    except (ValueError, RecursionError):
        return None
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return None
    alg, size = head["alg"], len(signature) * 3 // 4
    right = size >= 128 if alg[:2] in ("RS", "PS") and alg[2:] in ("256", "384", "512") else size == SIGNATURES.get(alg)
    return len(signature) if right and len(signature) % 4 != 1 else None


def _decode(body: str) -> bytes:
    body = body[:len(body) - (len(body) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(body + "=" * (-len(body) % 4))


class _Region:
    """Base64 characters from a place on over line breaks, and where each stands in the text."""

    def __init__(self, text: str, start: int):
        self.offsets, self.places, lines, size, at = [], [], [], 0, start
        while m := LINE.match(text, at):
            self.offsets.append(size)
            self.places.append(at)
            lines.append(m.group())
            size += len(lines[-1])
            self.end = at = m.end()
            gap = BREAK.match(text, at)
            if not gap:
                break
            at = gap.end()
        self.body = "".join(lines)

    def offset(self, place: int) -> int:
        k = bisect_right(self.places, place) - 1
        return self.offsets[k] + place - self.places[k]

    def place(self, offset: int) -> int:
        """One past the place of the character before ``offset``."""
        k = bisect_right(self.offsets, offset - 1) - 1
        return self.places[k] + offset - self.offsets[k]


def _padded(text: str, end: int, chars: int) -> int:
    """``end`` moved over the padding of so many base64 characters."""
    for _ in range(-chars % 4):
        if text[end:end + 1] == "=":
            end += 1
    return end


def structures(text: str, depth: int = DEPTH):
    """(kind, start, end) of each candidate whose decoded bytes confirm it."""
    region = None
    for m in ANCHOR.finditer(text):
        start = m.start()
        if region is None or start >= region.end:
            region = _Region(text, start)
        o = region.offset(start)
        kind, chars = None, 0
        if m.group()[0] == "M":
            head = _header(_decode(region.body[o:o + 8]), 0)
            chars = (head[2] * 4 + 2) // 3 if head else 0
            if head and o + chars <= len(region.body):
                kind = key_kind(_decode(region.body[o:o + chars])[:head[2]])
        elif m.group()[0] == "b":
            size = openssh_size(_decode(region.body[o:]))
            kind, chars = size and "openssh", (size or 0) * 4 // 3 + bool((size or 0) % 3)
        elif depth:
            inner = _decode(region.body[o:]).decode("latin-1")  # a character a byte
            kind, _, end = next(structures(inner, depth - 1), (None, 0, 0))
            footer = FOOTER.match(inner, end)
            chars = ((footer.end() if footer else end) * 4 + 2) // 3
        if kind:
            yield kind, start, _padded(text, region.place(o + chars), chars)
    for m in DIGITS.finditer(text):
        head = _header(bytes.fromhex(m.group()[:12]), 0)
        if head and 2 * head[2] <= len(m.group()) and (kind := key_kind(bytes.fromhex(m.group()[:2 * head[2]]))):
            yield kind, m.start(), m.start() + 2 * head[2]
    for m in TOKEN.finditer(text):
        if size := signed(*m.groups()):
            yield "jwt", m.start(), m.start(3) + size


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind as listed; code points, end exclusive."""
    spans = {("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6}
    spans |= {(kind, m.start(), m.end()) for kind, p in (("access", ACCESS), ("hex", HEX)) for m in p.finditer(text)}
    return sorted(spans | set(structures(text)), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan(batches):
    for batch in batches:
        ids, texts = batch.columns
        some = pc.fill_null(pc.match_substring_regex(texts, MAYBE), False)
        found = [find(x.as_py()) if hit.as_py() else [] for x, hit in zip(texts, some, strict=True)]
        flat = [s for own in found for s in own]
        ends = [0]
        for own in found:
            ends.append(ends[-1] + len(own))
        spans = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.string()), *(pa.array([s[k] for s in flat], pa.int64()) for k in (1, 2))], ["kind", "start", "end"])
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], ["row", "spans"])


def secret_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of ``docs`` (doc_id, text): array of (kind, start, end), by start, then kind.

    Places are code points of the whole text. Null and empty texts have no spans; rows with a null or
    repeated doc_id are kept, each by itself; other columns are ignored, and empty tables stay empty.
    """
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, SCHEMA).select("row.doc_id", "spans")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
