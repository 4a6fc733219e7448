"""Exact SentencePiece BPE encoding by backtracking, and decoding.

An encoding is the one that the merges give exactly if each of its tokens re-merges
to itself and each two neighbours, re-merged together, stay apart: no merge then
crosses a boundary.  The encoder walks a text by the longest Aho-Corasick match at
each place, takes it if it is compatible with the token before, else tries the next
shorter one, and steps back where none fits; places found to lead nowhere are kept in
a bitfield, so each is left but once.

No piece holds a space mark after another character, so a text falls apart into
stretches (a run of spaces and what follows up to the next) that encode by
themselves; a worker remembers the short stretches it has met, up to a bound in bytes.

Text null or empty: the end id alone, decoded to "".  Texts of any length are encoded
whole, each row by itself: repeated rows give equal rows, and an empty table gives none.
Columns that have the name of one that is appended are replaced; digests() gives the id
and its own columns alone, whatever else the table holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.support import narrow

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What a worker remembers: stretches of up to so many characters, in about so many bytes, and so many pairs of
#: tokens; then it starts anew.  This bounds memory and changes no result.
SHORT, KNOWN_BYTES, KNOWN_PAIRS = 64, 64 << 20, 150_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def read_model(path: str) -> tuple[list[tuple[str, float, int]], dict[int, int | bytes], dict[int, int | bytes]]:
    """Pieces (text, score, kind), trainer and normaliser settings of a .model file."""
    import struct

    pieces, trainer, normaliser = [], {}, {}
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
    return pieces, trainer, normaliser


class PieceCodec:
    def __init__(self, path: str):
        pieces, trainer, normaliser = read_model(path)
        if trainer.get(3) != 2 or not trainer.get(35) or normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no other normalisation")
        if any(kind in (USER, UNUSED) for _, _, kind in pieces):
            raise ValueError("user-defined and unused pieces are not handled")
        self.pieces = pieces
        self.score = {p: (s, i) for i, (p, s, kind) in enumerate(pieces) if kind == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.end = next(i for i, (p, _, kind) in enumerate(pieces) if kind == CONTROL and p == "</s>")
        if any(a != SPACE and b == SPACE for p in self.score for a, b in zip(p, p[1:])):
            raise ValueError("a piece holds a space mark after another character")
        within = {c for p in self.score for c in p}
        apart = "" if "\n" in within else r"\n"
        self.stretch = re.compile(rf" +[^ {apart}]*|{apart or '(?!)'}|[^ {apart}]+")
        whole = {p: (len(p), i) for p, (_, i) in self.score.items() if self.merge(p) == [p]}
        self.matcher = ahocorasick.Automaton()
        for p, match in whole.items():
            self.matcher.add_word(p, match)
        self.matcher.make_automaton()
        #: For a token the longest piece that is a proper prefix of it; the last resort is its first character.
        self.shorter = {}
        for p, (_, i) in whole.items():
            match = next((whole[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in whole), None)
            if match is None and len(p) > 1:
                match = (1, len(pieces) + ord(p[0]))
            if match is not None:
                self.shorter[i] = match
        self.digits = [str(i) for i in range(len(pieces))]
        self.first_piece = 1 + max(i for i, (_, _, kind) in enumerate(pieces) if kind != NORMAL)
        self.surface = ["" if kind == CONTROL else " ⁇ " if kind == UNKNOWN else p.replace(SPACE, " ") for p, _, kind in pieces]
        self.apart: dict[int, bool] = {}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.held = 0

    def merge(self, text: str) -> list[str]:
        """Merge adjacent symbols, the best score first and of equals the leftmost, until none is left to merge."""
        symbols = list(text)
        score = self.score
        while len(symbols) > 1:
            best = None
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s[0] > best[0]):
                    best = (s[0], i)
            if best is None:
                break
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens, merged anew together, stay as they are.  A character that is no piece has the number of pieces and its code as id."""
        key = left << 32 | right
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= KNOWN_PAIRS:
                self.apart.clear()
            a, b = (self.pieces[i][0] if i < len(self.pieces) else chr(i - len(self.pieces)) for i in (left, right))
            known = self.apart[key] = self.merge(a + b) == [a, b]
        return known

    def longest(self, text: str) -> list[int] | None:
        """The tokens if the longest match at each place serves throughout, else None."""
        out, covered, before, apart = [], 0, None, self.apart
        for _, (size, token) in self.matcher.iter_long(text):
            if before is not None and not (apart.get(before << 32 | token) or self.compatible(before, token)):
                return None
            out.append(token)
            covered += size
            before = token
        return out if covered == len(text) else None

    def backtrack(self, text: str) -> list[int]:
        """The tokens of a stretch with its space marks."""
        n, none, shorter, compatible, apart = len(text), len(self.pieces), self.shorter, self.compatible, self.apart.get
        matches = self.matcher.iter_long
        failed = bytearray(n // 8 + 1)
        path: list[tuple[int, int]] = []  # tokens and their sizes
        at, before, fresh = 0, None, True
        while at < n:
            if fresh:
                last, match = next(matches(text, at), (0, None))
                if match is None or last - match[0] + 1 != at:
                    match = (1, none + ord(text[at]))
            while match is not None:
                size, token = match
                stop = at + size
                if (before is None or apart(before << 32 | token) or compatible(before, token)) and not (failed[stop >> 3] >> (stop & 7) & 1):
                    break
                match = shorter.get(token)
            if match is not None:
                path.append(match)
                at, before, fresh = stop, token, True
            else:
                failed[at >> 3] |= 1 << (at & 7)
                size, token = path.pop()
                at -= size
                before = path[-1][1] if path else None
                match, fresh = shorter.get(token), False
        return [token for _, token in path]

    def ids(self, stretch: str) -> list[int]:
        """Ids of a stretch whose spaces are spaces."""
        text = stretch.replace(" ", SPACE)
        tokens = self.longest(text)
        if tokens is None:
            tokens = self.backtrack(text)
            n = len(self.pieces)
            if max(tokens) >= n:
                return [i for t in tokens for i in ([t] if t < n else [self.byte[b] for b in chr(t - n).encode()])]
        return tokens

    def decode(self, ids: list[int], start: bool = True) -> str:
        """The text of ids; at a text's start one space is dropped."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            piece, _, kind = self.pieces[i]
            if kind == BYTE:
                run.append(int(piece[3:5], 16))
                continue
            if run:
                out.append(decode_bytes(run))
                run = bytearray()
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            elif start and not out and piece.startswith(SPACE):
                out.append(piece[1:].replace(SPACE, " "))
            else:
                out.append(piece.replace(SPACE, " "))
            start = False
        if run:
            out.append(decode_bytes(run))
        return "".join(out)

    def stretches(self, text: str) -> list[str]:
        return self.stretch.findall(" " + text.replace(SPACE, " ")) if text else []

    def lookup(self, stretch: str) -> tuple[int, str, str]:
        own = self.ids(stretch)
        back = "".join([self.surface[i] for i in own]) if min(own) >= self.first_piece else self.decode(own, start=False)
        found = (len(own), " ".join([self.digits[i] for i in own]), stretch if back == stretch else back)
        if len(stretch) <= SHORT:
            self.held += 300 + 2 * len(stretch) + len(found[1])  # of Python's objects, about
            if self.held > KNOWN_BYTES:
                self.known.clear()
                self.held = 0
            self.known[stretch] = found
        return found

    def forget(self) -> None:
        """Give the memory of what was met back, as other work may follow in this process."""
        self.known.clear()
        self.held = 0
        self.apart.clear()

    def encode(self, text: str) -> list[int]:
        return [i for s in self.stretches(text) for i in self.ids(s)] + [self.end]

    def summary(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids as text, and the decoded text."""
        known, lookup = self.known, self.lookup
        found = []
        for s in self.stretches(text):
            try:
                found.append(known[s])
            except KeyError:
                found.append(lookup(s))
        n = sum(f[0] for f in found) + 1
        ids = " ".join([f[1] for f in found] + [str(self.end)])
        return n, ids, "".join([f[2] for f in found])[1:]


def decode_bytes(run: bytearray) -> str:
    """Bytes as text, with one replacement character for each byte that is no part of a character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out = []
        at = 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode(df: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Append the ids (array of int, the end id last) of every text."""
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c != out])
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in narrow(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            ids = pa.array([list(map(int, c.summary(t or "")[1].split(" "))) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, out])

    return base.mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the text of every array of ids (null where the array is null)."""
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c != out])
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = pa.array([None if i is None else c.decode(i) for i in own], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out])

    return base.mapInArrow(run, schema)


def digests(df: DataFrame, model: str, id: str = "doc_id", text: str = "text", release: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded in one pass.

    ``release``: give a worker's memory of stretches back after each task, where other work follows in the same workers.
    """
    base = df.select(F.col(id), F.col(text).alias("__text"))
    schema = T.StructType([base.schema.fields[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        for batch in narrow(batches):
            rows = []
            for t in batch.column(1):
                n, ids, back = c.summary(t.as_py() or "")
                rows.append((n, sha(ids), sha(back)))
            n, ids, back = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=schema.names)
        if release:
            c.forget()

    return base.mapInArrow(run, schema)
