"""Structural confirmation of secrets: made keys, near misses, and a parser of its own beside the operator's."""

import base64
import time
import hashlib
import hmac
import json
import random
import re

import pytest

from ragloom.llm import secret_scan

RANDOM = random.Random(17)
KINDS = secret_scan.KINDS


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def number(size):
    return der(2, bytes([RANDOM.randint(1, 127)]) + RANDOM.randbytes(size - 1))


def octets(size):
    return RANDOM.randbytes(size)


OID = {"rsa": "2a864886f70d010101", "ec": "2a8648ce3d0201", "p256": "2a8648ce3d030107", "ed25519": "2b6570", "pbes2": "2a864886f70d01050d", "sha256rsa": "2a864886f70d01010b"}
oid = {k: der(6, bytes.fromhex(v)) for k, v in OID.items()}
ZERO, ONE, NULL = der(2, b"\0"), der(2, b"\1"), der(5)


def wire(*parts):
    return b"".join(len(p).to_bytes(4, "big") + p for p in parts)


def openssh(cipher=b"none", twice=True, more=b""):
    public = wire(b"ssh-ed25519", octets(32))
    check = octets(4)
    private = check + (check if twice else bytes(4)) + wire(b"ssh-ed25519", octets(32), octets(64), b"note") + bytes([1, 2, 3])
    return b"openssh-key-v1\0" + wire(cipher, b"none", b"") + (1).to_bytes(4, "big") + wire(public, private) + more


RSA = der(0x30, ZERO, number(128), der(2, b"\1\0\1"), number(128), number(64), number(64), number(64), number(64), number(64))
EC = der(0x30, ONE, der(4, octets(32)), der(0xA0, oid["p256"]), der(0xA1, der(3, b"\0\4" + octets(64))))
KEYS = {
    "pkcs1": RSA, "pkcs1 of three primes": der(0x30, ONE, *(number(64) for _ in range(8)), der(0x30, der(0x30, number(32), number(32), number(32)))), "dsa": der(0x30, ZERO, number(128), number(20), number(128), number(128), number(20)),
    "sec1": EC, "sec1, short": der(0x30, ONE, der(4, octets(32))), "pkcs8 rsa": der(0x30, ZERO, der(0x30, oid["rsa"], NULL), der(4, RSA)), "pkcs8 ec": der(0x30, ZERO, der(0x30, oid["ec"], oid["p256"]), der(4, EC)),
    "pkcs8 ed25519": der(0x30, ONE, der(0x30, oid["ed25519"]), der(4, der(4, octets(32))), der(0x81, b"\0" + octets(32))), "encrypted pkcs8": der(0x30, der(0x30, oid["pbes2"], der(0x30, der(0x30, oid["rsa"]))), der(4, octets(160))),
}
PUBLIC = der(0x30, der(0x30, oid["rsa"], NULL), der(3, b"\0" + der(0x30, number(128), number(3))))
NAME = der(0x30, der(0x31, der(0x30, der(6, b"\x55\4\3"), der(0x0C, b"example"))))
CERTIFICATE = der(0x30, der(0x30, der(0xA0, der(2, b"\2")), number(16), der(0x30, oid["sha256rsa"], NULL), NAME, der(0x30, der(0x17, b"240101000000Z"), der(0x17, b"340101000000Z")), NAME, PUBLIC), der(0x30, oid["sha256rsa"], NULL), der(3, b"\0" + octets(128)))
NO_KEYS = {
    "certificate": CERTIFICATE, "public": PUBLIC, "public pkcs1": der(0x30, number(128), number(3)), "signature": der(0x30, number(32), number(32)), "one integer too few": der(0x30, ZERO, *(number(64) for _ in range(7))), "version 2": der(0x30, der(2, b"\2"), *(number(64) for _ in range(8))),
    "octets that are no rsa key": der(0x30, ZERO, der(0x30, oid["rsa"], NULL), der(4, octets(64))), "unknown encryption": der(0x30, der(0x30, oid["sha256rsa"], der(0x30)), der(4, octets(64))), "cut": RSA[:-3], "longer": RSA + b"\0\0\0", "negative": der(0x30, ZERO, der(2, b"\xff" + octets(64)), *(number(64) for _ in range(7))),
    "any nest": der(0x30, der(0x30, number(3), number(30)), der(4, octets(40))), "openssh, cut": openssh()[:-1], "openssh, longer": openssh(more=b"x"), "openssh, numbers differ": openssh(twice=False), "ssh public": wire(b"ssh-ed25519", octets(32)),
}


def letters(data, url=False):
    return (base64.urlsafe_b64encode if url else base64.b64encode)(data).decode()


def part(value):
    return letters(value if isinstance(value, bytes) else json.dumps(value).encode(), url=True).rstrip("=")


def token(header=None, payload=None):
    signed = f"{part(header or {'alg': 'HS256', 'typ': 'JWT'})}.{part(payload or {'sub': '1'})}"
    return f"{signed}.{part(hmac.new(b'key', signed.encode(), hashlib.sha256).digest())}"


def confirmed(text):
    return [(s, KINDS[k], e) for s, k, e in secret_scan.scan(text) if k > 2]


def pem(label, data, end="\n", headers=""):
    return f"-----BEGIN {label}-----{end}{headers}" + end.join(re.findall(".{1,64}", letters(data))) + f"{end}-----END {label}-----"


@pytest.mark.parametrize("name", KEYS)
def test_keys_are_found_in_every_coding(name):
    key = KEYS[name]
    for text in (letters(key), letters(key, url=True), key.hex(), key.hex().upper(), pem("PRIVATE KEY", key), pem("PRIVATE KEY", key, end="\\n")):
        around = f"é words {text} after"
        assert confirmed(around) == [(8, "der", 8 + len(text))], text[:30]


def test_openssh_and_encrypted_pem():
    for key in (openssh(), openssh(cipher=b"aes256-ctr", twice=False)):
        assert confirmed(letters(key)) == [(0, "openssh", len(letters(key)))]
        block = pem("OPENSSH PRIVATE KEY", key)
        assert confirmed(f"x {block}\n") == [(2, "openssh", 2 + len(block))]
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    locked = pem("RSA PRIVATE KEY", octets(608), headers=headers)
    assert confirmed(locked) == [(0, "der", len(locked))]
    assert confirmed(pem("RSA PRIVATE KEY", octets(607), headers=headers)) == []


@pytest.mark.parametrize("name", NO_KEYS)
def test_other_data_is_no_secret(name):
    data = NO_KEYS[name]
    for text in (letters(data), data.hex(), pem("CERTIFICATE", data), f"ssh-ed25519 {letters(data)} me@host"):
        assert confirmed(text) == []


def test_signed_tokens_are_read_whole():
    for good in (token(), token({"alg": "HS256"}), token(payload={"a": {"b": [1]}}), f"{part(b' ' + json.dumps({'alg': 'HS256'}).encode())}.{part({'a': 1})}.{part(octets(32))}", f"{part({'alg': 'RS256'})}.{part({'a': 1})}.{part(octets(256))}", f"{part({'alg': 'new'})}.{part({'a': 1})}.{part(octets(20))}"):
        for text in (good, f"key={good}.", f"https://x.org/auth/{good}/next?a", f'"{good}"'):
            at = text.index(good)
            assert confirmed(text) == [(at, "jwt", at + len(good))], text
    head, body, sign = token().split(".")
    for bad in (f"{head}.a.b", f"{head}.{body}.", f"{head}.{body}.{sign[:20]}", f"{head}.{part([1])}.{sign}", f"{part({'noalg': 1})}.{body}.{sign}", f"{part({'alg': 'none'})}.{body}.{sign}", f"{part({'alg': 5})}.{body}.{sign}", f"{head}.{body}", "x.y.z"):
        assert confirmed(bad) == [], bad


def test_secrets_behind_other_letters_of_their_run():
    before = ["https://x.org/", "https://internal-api.example.com/auth/", "authorization.header.", "Bearer/", "--token-", "service-account.key.", "a.b.c.", "path/to/", "key_", "key"]
    cases = [(b, t, kind) for b in before for t, kind in ((token(), "jwt"), (letters(RSA), "der"), (letters(EC), "der"), (letters(openssh()), "openssh"))]
    cases += [("0x", RSA.hex(), "der"), ("0X", RSA.hex().upper(), "der")]
    for prefix, secret, kind in cases:
        text = f"é words {prefix}{secret} after"
        at = text.index(secret)
        assert confirmed(text) == [(at, kind, at + len(secret))], (prefix, kind)
        assert secret[-20:] not in secret_scan.redacted(text)
    whole = der(0x30, ONE, der(4, octets(35)))
    assert len(whole) % 3 == 0 and confirmed(f"x/{letters(whole)}/more") == [(2, "der", 2 + len(letters(whole)))]


def test_long_texts_take_time_in_proportion():
    for text in ("eyJ" * 100_000 + ".a.b", "MI" * 100_000, "A" * 200_000, "e/" * 100_000 + ".a.b", "-----BEGIN A-----" * 20_000, "-----BEGIN A-----" + "\\n" * 100_000, "3082" * 50_000):
        assert confirmed(text) == []
    for part in ("eyJh", base64.b64encode(b'{"a":').decode().rstrip("="), base64.b64encode(b"{} ").decode(), base64.b64encode(b"   ").decode()):
        text = part * 100_000 + "fQ." + "e" * 20 + "." + "a" * 43
        began = time.process_time()
        confirmed(text)
        assert time.process_time() - began < 20


def tree(data):
    """A parser of its own: the elements that fill the data, constructed ones as lists; an error if they don't."""
    if not data:
        return []
    head = 2 if data[1] < 0x80 else 2 + data[1] - 0x80
    size = data[1] if head == 2 else int.from_bytes(data[2:head], "big")
    assert head + size <= len(data) and head <= 6 and (head == 2 or data[2] and size >= 128)
    body = data[head : head + size]
    return [(data[0], tree(body) if data[0] & 0x20 else body), *tree(data[head + size :])]


def shape(data):
    try:
        whole = tree(data)
    except (AssertionError, IndexError):
        return None
    return whole[0][1] if len(whole) == 1 and whole[0][0] == 0x30 else None


def is_key_by_tree(data):
    own = shape(data)
    tags = "".join({2: "i", 4: "o", 0x30: "s"}.get(t, "[") for t, _ in own or [])
    ints = [v for t, v in own or [] if t == 2]
    positive = all(0 < int.from_bytes(v, "big", signed=True) for v in ints[1:])
    if re.fullmatch("i{6}|i{9}", tags):
        return ints[0] == b"\0" and positive and len(ints[1]) >= 32
    if tags == "i" * 9 + "s":
        return ints[0] == b"\1" and positive and len(ints[1]) >= 32
    if re.fullmatch(r"io\[{0,2}", tags):
        return ints[0] == b"\1" and len(own[1][1]) >= 16 and [t for t, _ in own[2:]] == sorted({t for t, _ in own[2:]} & {0xA0, 0xA1})
    if re.fullmatch(r"iso\[*", tags):
        kind, inner = own[1][1][0][1], own[2][1]
        if ints[0] not in (b"\0", b"\1") or len(inner) < 16:
            return False
        nested = {bytes.fromhex(OID["rsa"]): "i{6}|i{9}s?", bytes.fromhex(OID["ec"]): r"io\[*"}.get(kind)
        return nested is None or is_key_by_tree(inner) and bool(re.fullmatch(nested, "".join({2: "i", 4: "o", 0x30: "s"}.get(t, "[") for t, _ in shape(inner))))
    return tags == "so" and own[0][1][0][1].startswith(bytes.fromhex("2a864886f70d0105")) and len(own[1][1]) >= 16


def test_a_second_parser_agrees():
    agreed = 0
    pool = [d for n, d in {**KEYS, **NO_KEYS}.items() if "ssh" not in n]
    for data in pool:
        assert secret_scan.is_der_key(data) == is_key_by_tree(data)
    for _ in range(3000):
        data = bytearray(RANDOM.choice(pool))
        for _ in range(RANDOM.randint(1, 2)):
            at = RANDOM.randrange(min(len(data), 40))
            if RANDOM.random() < 0.5:
                data[at] = RANDOM.choice([0, 1, 2, 4, 0x30, 0x81, 0xA0, data[at] ^ 1, RANDOM.randrange(256)])
            else:
                del data[at]
        try:
            expected = is_key_by_tree(bytes(data))
        except (IndexError, TypeError, AttributeError):
            expected = False
        found = secret_scan.is_der_key(bytes(data))
        assert found == expected or not found, data.hex()  # the second parser asks less of integers and of what is nested in members
        agreed += found == expected
    assert agreed > 2900


def test_rows_of_the_table(spark):
    rows = [(1, f"a {token()}", "x", "x"), (1, f"a {token()}", "x", "x"), (None, None, None, None), (2, "", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex string")
    found = sorted((r.doc_id or 0, r.n_assign + r.n_access + r.n_hex, r.spans, r.n_confirmed) for r in secret_scan.find_secrets(df).collect())
    assert found == [(0, 0, "", 0), *[(1, 0, f"jwt:2:{2 + len(token())}", 1)] * 2, (2, 0, "", 0)]
    assert [r.text for r in secret_scan.redact(df).orderBy("doc_id").collect()] == [None, "a [secret]", "a [secret]", ""]
