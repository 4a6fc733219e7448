"""Secret scans with structural confirmation.

The base patterns (assigned values, access ids, long hex runs) report as they match.
Beyond them, base64 and hex runs are only candidates.  They are decoded, and one is
reported if its bytes are, to the last one,

- der: a private key in DER, by the members that its form prescribes: PKCS#1 and DSA (a
  version and the key's integers), SEC1 (version, octets, parameters), PKCS#8 (version,
  algorithm, octets that hold such a key where the algorithm tells) or its encrypted form;
- openssh: an OpenSSH private key, with its public keys and the private section;
- jwt: a signed token, whose header is a JSON object that names an algorithm, whose payload
  is a JSON object, and whose signature has a length that the algorithm gives.

Public keys, certificates and other data with nested lengths are no secrets.  Other
letters, such as a path or a name, may stand before a candidate in its run.  Between PEM
marks it may wrap over lines (spelled out or as \\n), and may be encrypted as its header
says; then the whole PEM block is the span.

Kinds, in the order in which spans at one place are listed: assign, access, hex, der,
openssh, jwt.  Offsets count code points, the end is exclusive.  Text null or empty: no
span, all counts 0.  Texts are scanned whole, row by row: repeated rows give equal rows, an
empty table gives none, and other columns are not looked at.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.support import narrow

KINDS = ("assign", "access", "hex", "der", "openssh", "jwt")
BASE_KINDS = KINDS[:3]

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")

#: Letters, digits and marks of both base64 alphabets.
_B64 = r"[A-Za-z0-9+/_-]"
_URL64 = r"[A-Za-z0-9_-]"
#: A run that may end with the header of a signed token, before the token's other parts.
_HEADER = re.compile(rf"(?<!{_B64}){_B64}{{12,}}(?=\.({_URL64}+)\.({_URL64}+))")
#: Where in it the header may begin: with the letters of a brace, or (blanks before the brace) behind a mark.
_HEADER_START = re.compile(r"(?=e[w-z0-9+/_-])|^|(?<=[+/_-])")
#: A run that is long enough to hold the smallest key.
_RUN = re.compile(rf"(?<!{_B64}){_B64}{{24,}}={{0,2}}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----((?:\s*[A-Za-z0-9-]+:[^\n]*\n)*)((?:\\[rn]|[A-Za-z0-9+/=\s])++)-----END \1-----")
_PEM_CIPHER = re.compile(r"Proc-Type:\s*4,ENCRYPTED\s+DEK-Info:\s*([A-Z0-9-]+),([0-9A-Fa-f]+)\s*")
_HEX_RUN = re.compile(r"(?:(?<![0-9A-Za-z])|(?<=0[xX]))(?:(?:[0-9a-f]{2}){24,}|(?:[0-9A-F]{2}){24,})(?![0-9A-Za-z])")

#: DER tags.
_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: Object identifiers, encoded: RSA, elliptic-curve keys, and what those of password-based encryption begin with.
_RSA = bytes.fromhex("2a864886f70d010101")
_EC = bytes.fromhex("2a8648ce3d0201")
_ENCRYPTED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_OPENSSH = b"openssh-key-v1\x00"
#: Bytes of a key's smallest secret member.
_LEAST = 16
#: Bytes of a signature by algorithm; those of RSA have the size of the key, others are at least _LEAST.
_SIGNED = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114)}
_RSA_SIGNED, _RSA_LEAST = ("RS", "PS"), 64
#: What the base64 of a key begins with.
_KEY_START = re.compile("(?=M[A-P]|" + base64.b64encode(_OPENSSH[:15]).decode() + ")")


def _der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """Length and place of the content whose length stands at ``at``; None if it is no definite DER length."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    size = first & 0x7F
    if not 1 <= size <= 4 or at + 1 + size > len(data) or data[at + 1] == 0:
        return None
    length = int.from_bytes(data[at + 1 : at + 1 + size], "big")
    return (length, at + 1 + size) if length >= 0x80 else None


def _members(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the elements that fill the data."""
    out, at = [], 0
    while at < len(data):
        found = _der_length(data, at + 1)
        if found is None or sum(found) > len(data):
            return None
        out.append((data[at], data[found[1] : sum(found)]))
        at = sum(found)
    return out


def _nests(data: bytes) -> bool:
    """The lengths of all that is constructed fill what they stand in, down to the innermost."""
    todo = [data]
    while todo:
        own = _members(todo.pop())
        if own is None:
            return False
        todo += [content for tag, content in own if tag & 0x20]
    return True


def _sequence(data: bytes) -> list[tuple[int, bytes]]:
    """The members of the one sequence that fills the data; none if it is something else."""
    whole = _members(data)
    return (_members(whole[0][1]) or []) if whole and len(whole) == 1 and whole[0][0] == _SEQUENCE else []


def _is_number(content: bytes, least: int = 1) -> bool:
    """A positive integer in its shortest form."""
    return len(content) >= least and content[0] < 0x80 and (len(content) == 1 or content[0] or content[1] >= 0x80) and any(content)


def _is_integers_key(own: list[tuple[int, bytes]]) -> bool:
    """Version 0, then the eight integers of an RSA key or the five of a DSA key; version 1: RSA with further primes."""
    if any(tag != _INTEGER for tag, _ in own[:9]) or not own:
        return False
    version, numbers = own[0][1], own[1:9]
    if not all(_is_number(content) for _, content in numbers) or len(numbers[0][1]) < 2 * _LEAST:
        return False
    return version == b"\0" and len(own) in (6, 9) or version == b"\1" and len(own) == 10 and own[9][0] == _SEQUENCE


def _is_curve_key(own: list[tuple[int, bytes]]) -> bool:
    """Version 1, the secret octets, and then at most parameters and the public key."""
    if [tag for tag, _ in own[:2]] != [_INTEGER, _OCTETS] or own[0][1] != b"\1" or len(own[1][1]) < _LEAST:
        return False
    return [tag for tag, _ in own[2:]] in ([], [0xA0], [0xA1], [0xA0, 0xA1]) and all(_members(content) for _, content in own[2:])


def is_der_key(data: bytes) -> bool:
    """A private key by PKCS#1, DSA's form, SEC1, PKCS#8 or encrypted PKCS#8, whose lengths fill the data at every level."""
    own = _sequence(data)
    if not own or not _nests(data):
        return False
    if _is_integers_key(own) or _is_curve_key(own):
        return True
    tags = [tag for tag, _ in own]
    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS] and own[0][1] in (b"\0", b"\1") and all(tag in (0xA0, 0xA1, 0x81) for tag in tags[3:]):
        algorithm, key = _members(own[1][1]) or [], own[2][1]
        if not algorithm or algorithm[0][0] != _OID or len(key) < _LEAST:
            return False
        kind = algorithm[0][1]
        return _is_integers_key(_sequence(key)) if kind == _RSA else _is_curve_key(_sequence(key)) if kind == _EC else True
    if tags == [_SEQUENCE, _OCTETS]:
        algorithm = _members(own[0][1]) or []
        return len(algorithm) == 2 and [tag for tag, _ in algorithm] == [_OID, _SEQUENCE] and algorithm[0][1].startswith(_ENCRYPTED) and len(own[1][1]) >= _LEAST
    return False


def _wire(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The length-prefixed string at ``at``, and where it ends."""
    size = int.from_bytes(data[at : at + 4], "big")
    return (data[at + 4 : at + 4 + size], at + 4 + size) if at + 4 + size <= len(data) else None


def is_openssh(data: bytes) -> bool:
    """The magic; cipher, kdf and its options; a count of keys and as many public keys; the private section, which ends the data.

    An unencrypted section begins with a number that stands there twice.
    """
    if not data.startswith(_OPENSSH):
        return False
    at, parts = len(_OPENSSH), []
    for _ in range(3):
        found = _wire(data, at)
        if found is None:
            return False
        parts.append(found[0])
        at = found[1]
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= count <= len(data) // 8:
        return False
    for _ in range(count):
        key = _wire(data, at)
        if key is None or _wire(key[0], 0) is None or not _wire(key[0], 0)[0]:
            return False
        at = key[1]
    private = _wire(data, at)
    if private is None or private[1] != len(data) or len(private[0]) < _LEAST:
        return False
    return parts[0] != b"none" or private[0][:4] == private[0][4:8]


_JSON, _JSON_SPACE = json.JSONDecoder(), " \t\n\r"


def _object(text: str) -> dict | None:
    """The JSON object that base64 letters hold."""
    data = unbase64(text)
    if data is None or not data.lstrip().startswith(b"{"):
        return None
    try:
        own = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return own if isinstance(own, dict) else None


def signature_end(algorithm: object, signature: str) -> int:
    """How many letters of ``signature`` are one by this algorithm; 0: none.  Marks behind it are not part of it."""
    if not isinstance(algorithm, str) or algorithm.lower() == "none":
        return 0
    for own in (signature, signature.rstrip("-_")):
        data = unbase64(own)
        n = 0 if data is None else len(data)
        if n in _SIGNED[algorithm] if algorithm in _SIGNED else n >= (_RSA_LEAST if algorithm.startswith(_RSA_SIGNED) else _LEAST):
            return len(own)
    return 0


def unbase64(text: str) -> bytes | None:
    text = text.rstrip("=").translate({ord("-"): "+", ord("_"): "/"})
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def header_in(run: str) -> tuple[int, dict] | None:
    """Where in the run the header of a signed token begins that ends with it, and the header.

    The run is decoded once for each of the four alignments; a start is a place in what its alignment gives.  Only an
    object that ends where the run does, of which there is one at most, is decoded by itself.
    """
    decoded: dict[int, tuple[str, int] | None] = {}
    for m in _HEADER_START.finditer(run):
        start = m.start()
        n = len(run) - start
        if n < 12 or n % 4 == 1:
            continue
        align = start % 4
        if align not in decoded:
            data = unbase64(run[align:])
            held = None if data is None else data.decode("latin-1")
            decoded[align] = None if held is None else (held, len(held.rstrip(_JSON_SPACE)))
        if decoded[align] is not None:
            text, end = decoded[align]
            at = (start - align) // 4 * 3
            while at < end and text[at] in _JSON_SPACE:
                at += 1
            if text[end - 1 : end] != "}" or text[at : at + 1] != "{":
                continue
            try:
                if _JSON.raw_decode(text, at)[1] != end:
                    continue
            except (ValueError, RecursionError):
                continue
        own = _object(run[start:])
        if own is not None and "alg" in own:
            return start, own
    return None


def key_in(run: str) -> tuple[int, int, str] | None:
    """Place, end and kind of the first key in the run."""
    letters = run.rstrip("=").translate({ord("-"): "+", ord("_"): "/"})
    for m in _KEY_START.finditer(letters):
        at, end = m.start(), len(letters)
        if end - at < 24:
            break
        if letters[at] == "M":
            length = _der_length(unbase64(letters[at : at + 8]), 1)
            if length is None:
                continue
            size = sum(length)
            if size % 3 == 0 and size // 3 * 4 <= end - at:  # whole groups of letters: others may follow
                end = at + size // 3 * 4
            elif size != (end - at) * 3 // 4:
                continue
        kind = kind_of(unbase64(letters[at:end]))
        if kind:
            return at, end if end < len(letters) else len(run), kind
    return None


def kind_of(data: bytes | None) -> str | None:
    if not data:
        return None
    return "openssh" if is_openssh(data) else "der" if is_der_key(data) else None


def pem_kind(label: str, headers: str, body: str) -> str | None:
    """Of what stands between PEM marks; a body that its header calls encrypted has whole blocks of the cipher."""
    data = unbase64("".join(body.replace("\\n", "").replace("\\r", "").split()))
    cipher = _PEM_CIPHER.fullmatch(headers.strip() + "\n")
    if cipher and label.endswith("PRIVATE KEY"):
        block = len(cipher.group(2)) // 2
        return "der" if data and block in (8, 16) and len(data) % block == 0 and len(data) >= 2 * _LEAST else None
    return kind_of(data)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of every span, in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found = set()
    tokens: list[tuple[int, int]] = []
    for m in _HEADER.finditer(text):
        if tokens and m.start() < tokens[-1][1] or _object(m.group(1)) is None:
            continue
        header = header_in(m.group())
        size = signature_end(header[1]["alg"], m.group(2)) if header else 0
        if size:
            tokens.append((m.start() + header[0], m.start(2) + size))
            found.add((tokens[-1][0], KINDS.index("jwt"), tokens[-1][1]))
    passed = 0
    for m in _RUN.finditer(text):
        while passed < len(tokens) and tokens[passed][1] <= m.start():
            passed += 1
        if passed < len(tokens) and tokens[passed][0] < m.end():
            continue
        key = key_in(m.group())
        if key:
            found.add((m.start() + key[0], KINDS.index(key[2]), m.start() + key[1]))
    for m in _HEX_RUN.finditer(text):
        kind = kind_of(bytes.fromhex(m.group()))
        if kind:
            found.add((m.start(), KINDS.index(kind), m.end()))
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            kind = pem_kind(*m.groups())
            if kind:
                found = {f for f in found if not m.start() <= f[0] < m.end()}
                found.add((m.start(), KINDS.index(kind), m.end()))
    return sorted([*spans, *found])


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def find_secrets(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans and n_confirmed (spans that the method adds) of every row.

    Each row is scanned by itself, so nothing is shuffled.
    """
    base = df.select(F.col(id), F.col(text).alias("__text"))
    long = T.LongType()
    schema = T.StructType([base.schema.fields[0], *(T.StructField(c, long) for c in ("n_assign", "n_access", "n_hex")), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_confirmed", long)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in narrow(batches):
            rows = []
            for t in batch.column(1):
                spans = scan(t.as_py() or "")
                own = [s for s in spans if s[1] < 3]
                counts = [sum(s[1] == k for s in own) for k in range(3)]
                rows.append((*counts, hashlib.sha256(shown(own).encode()).hexdigest(), shown(spans), len(spans) - len(own)))
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if i in (3, 4) else pa.int64()) for i, c in enumerate(columns))], names=schema.names)

    return base.mapInArrow(run, schema)


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Replace every span of ``text`` by ``mark``; overlapping spans become one.  All else stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in narrow(batches):
            at = batch.schema.get_field_index(text)
            out = [None if t is None else redacted(t, mark) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def redacted(text: str, mark: str = "[secret]") -> str:
    out, at = [], 0
    spans = [(s, e) for s, _, e in scan(text)]
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
