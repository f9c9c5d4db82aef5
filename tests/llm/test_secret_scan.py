"""Secret scans: base kinds against the plain patterns, built keys and tokens, near misses, edges."""

import base64
import hashlib
import json
import random
import re

import pytest

from seatwise.llm import secret_scan as S
from seatwise.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, row string, spans int, kind string, start int"
SF = "/root/testdata/sf0.001"


def base_truth(text):
    """The patterns as stated, failing matches dropped after the search."""
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found, key=lambda x: (x[1], S.BASE.index(x[0])))


def der(tag, *parts):
    body = b"".join(parts)
    size = len(body).to_bytes((len(body).bit_length() + 7) // 8 or 1, "big")
    return bytes([tag]) + (size if len(body) < 128 else bytes([0x80 + len(size)]) + size) + body


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def lines(data, width=64, gap="\n"):
    text = base64.b64encode(data).decode()
    return gap.join(text[k:k + width] for k in range(0, len(text), width))


P, Q = (1 << 521) - 1, (1 << 607) - 1  # Mersenne primes
RSA = der(0x30, number(0), *map(number, (P * Q, 65537, 12345, P, Q, 3, 5, 7)))
BAD_RSA = der(0x30, number(0), *map(number, (P * Q + 2, 65537, 12345, P, Q, 3, 5, 7)))
EC = der(0x30, number(1), der(4, bytes(range(32))), der(0xA0, der(6, bytes.fromhex("2a8648ce3d030107"))))
DSA = der(0x30, number(0), *map(number, (2 * 5 * (1 << 500) + 1, 5, 3, 9, 4)))
PKCS8 = der(0x30, number(0), der(0x30, der(6, bytes.fromhex(S.RSA_OID)), der(5)), der(4, RSA))
ED = der(0x30, number(0), der(0x30, der(6, bytes.fromhex("2b6570"))), der(4, der(4, b"k" * 32)))
SEALED = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30)), der(4, b"x" * 64))
PUBLIC = der(0x30, der(0x30, der(6, bytes.fromhex(S.RSA_OID)), der(5)), der(3, b"\0" + RSA))


def field(x):
    return len(x).to_bytes(4, "big") + x


SSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 51) + field(b"q" * 136)


def part(x):
    return base64.urlsafe_b64encode(x if isinstance(x, bytes) else json.dumps(x).encode()).decode().rstrip("=")


def jwt(alg="HS256", size=32):
    return f"{part({'alg': alg, 'typ': 'JWT'})}.{part({'sub': 'é'})}.{part(bytes(range(size)))}"


@pytest.mark.parametrize(("kind", "secret"), [
    ("rsa", lines(RSA)), ("rsa", lines(RSA, 76, "\r\n")), ("rsa", lines(RSA, 64, "\\n")), ("rsa", lines(RSA, 64, "\n    ")), ("rsa", RSA.hex()), ("rsa", RSA.hex().upper()),
    ("ec", lines(EC, 999)), ("dsa", lines(DSA)), ("pkcs8", lines(PKCS8)), ("pkcs8", lines(ED)), ("encrypted", lines(SEALED)), ("openssh", lines(SSH, 70)),
    ("jwt", jwt()), ("jwt", jwt("RS256", 256)), ("jwt", jwt("ES512", 132)),
    ("rsa", lines(f"-----BEGIN RSA PRIVATE KEY-----\n{lines(RSA)}\n-----END RSA PRIVATE KEY-----\n".encode(), 9999)),
    ("ec", lines(b"-----BEGIN X-----\n" + lines(f"-----BEGIN EC PRIVATE KEY-----\n{lines(EC)}\n-----END EC PRIVATE KEY-----\n".encode()).encode(), 76))])
def test_structures_are_confirmed(kind, secret):
    for before, after in (("", ""), ("é\U0001f600 key: ", " end"), ("-----BEGIN RSA PRIVATE KEY-----\n", "\n-----END"), ("x=\"", "\"\nfollows here and more"), ("(", ")")):
        assert list(S.structures(before + secret + after)) == [(kind, len(before), len(before) + len(secret))], (before, after)
    flipped = secret[:2] + ("A" if secret[2] != "A" else "B") + secret[3:]
    assert list(S.structures(flipped)) == []  # another length, or no key at all


@pytest.mark.parametrize("text", [
    lines(RSA)[:-9], lines(BAD_RSA), lines(PUBLIC), lines(RSA + b"x")[5:], "glued" + lines(EC, 999), jwt("none", 32), jwt("HS256", 31), jwt("HS384", 32), "a.b.c", "eyJ.eyJ.x",
    f"{part([1])}.{part({})}.{part(b'x' * 32)}", f"{part(b'{' * 90000)}.{part({})}.{part(b'x' * 32)}", lines(SSH[:-1]), lines(SSH.replace(b"\0\0\0\4none", b"\xff\0\0\4none", 1)),
    lines(der(0x30, b"\0" * 200)), lines(b"\x30\x84\xff\xff\xff\xff" + b"M" * 300), "M" * 5000, ("M" * 64 + "\n") * 3000, "30" * 4000, lines(b"-----BEGIN nothing-----\n" * 9),
    "".join(random.Random(3).choice("ABCDEFMabcdef0123456789+/") for _ in range(20_000))])
def test_near_misses_are_not_reported(text):
    assert list(S.structures(text)) == []


def test_nested_key_in_a_key_file_is_found_to_its_depth():
    deep = lines(RSA)
    for _ in range(S.DEPTH + 1):
        deep = lines(f"-----BEGIN RSA PRIVATE KEY-----\n{deep}\n".encode(), 99999)
    assert list(S.structures(deep)) == []


def test_base_kinds_match_the_patterns():
    rng = random.Random(9)
    bits = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", "Key", "ſecret", "=", ":", " ", "\"", "'", "abc", "12345", "é", "AKIA", "AKIAKIA", "Z" * 9, "0a1b2c3d4e5f", "\n", "\U0001f600", "/+._-="]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert sum(map(len, map(base_truth, texts))) > 900
    for x in texts:
        assert [s for s in S.find(x) if s[0] in S.BASE] == base_truth(x)


def test_query_on_the_table_and_edges(spark):
    texts = [None, "", "é token = \"" + "ab12" * 10 + "\"", f"secret={lines(RSA)}", "AKIA" + "A" * 16, "word " * 30_000 + jwt(), f"two {jwt()} {jwt()}", "token token token"]
    rows = [(k, x, "r", 1, "k", 2) for k, x in enumerate(texts)] + [(None, texts[2], "r", 1, "k", 2), (2, "other", "r", 1, "k", 2)]
    got = sorted(((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in S.secret_scan(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=repr)
    assert got == sorted(((r[0], S.find(r[1] or "")) for r in rows), key=repr)
    assert len(dict(got)[3]) == 2 and len(dict(got)[6]) == 2
    assert S.secret_scan(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("planted", [False, True])
def test_query_matches_brute_force(spark, tmp_path, planted):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    keys = {}
    if planted:  # keys and base kinds inside the table's texts
        rng = random.Random(4)
        for k, x in docs.items():
            at, key = rng.randrange(len(x or "") + 1), rng.choice([jwt(), lines(EC, 999), "é"])
            near = rng.choice(["token = 'abcdef'", "AKIA" + "Z" * 16, " ", "0a" * 12 + " password:12345"])
            docs[k] = f"{(x or '')[:at]} {key} {near} {(x or '')[at:]}"
            keys[k] = [(kind, at + 1, at + 1 + len(key)) for kind, y in (("jwt", jwt()), ("ec", lines(EC, 999))) if y == key]
    spark.createDataFrame([(k, x, "r", 1, "k", 2) for k, x in docs.items()], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_secret_scan"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    total = 0
    for r in out:
        base = base_truth(docs[r["doc_id"]] or "")
        every = sorted(base + keys.get(r["doc_id"], []), key=lambda s: (s[1], S.KINDS.index(s[0])))
        total += len(base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in base) for k in S.BASE)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in every)
    assert bool(total) is planted
