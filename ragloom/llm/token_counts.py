"""Token counts by rank-synchronous array merging of byte-pair vocabularies.

The distinct pre-tokens of a batch that are not yet known lie end to end in one
array of symbol ids.  In each round every pre-token finds the lowest rank among
its adjacent pairs and applies that merge at all its places at once; the rounds
end when no pre-token has a pair with a rank.  A pair that a merge newly forms
holds the merged symbol, whose own merges all rank later, so taking all places
of the lowest rank at once equals taking them one by one from the left.

Text null or empty: 0 bytes, 0 tokens.  Texts of any length are counted whole, each row
by itself: repeated rows give equal rows, an empty table gives none, and columns that have
the name of an appended one are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.support import narrow

#: What a worker remembers: pre-tokens of up to so many characters, in about so many bytes; then it starts anew.
#: This bounds memory and changes no count.
SHORT, KNOWN_BYTES = 64, 64 << 20
#: Characters that are split into pre-tokens at once.
STEP_CHARS = 1 << 20

#: Fixed value: the public pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}


class PairMerger:
    """Counts tokens as the byte-level BPE of a tokenizers JSON file gives them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.split = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.held = 0

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def merged_sizes(self, tokens: list[str]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        raw = [t.encode() for t in tokens]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        result = sizes.copy()
        rows = np.arange(len(raw))
        seq = np.repeat(rows, sizes)
        ranks = np.full(len(symbols), self.none, np.int64)  # of the pair that a symbol begins
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            counts = np.diff(np.r_[first, len(seq)])
            lowest = np.minimum.reduceat(ranks, first)
            done = lowest == self.none
            if done.any():
                result[seq[first[done]]] = counts[done]
                keep = np.repeat(~done, counts)
                symbols, seq, ranks = symbols[keep], seq[keep], ranks[keep]
                lowest, counts = lowest[~done], counts[~done]
                if not len(symbols):
                    break
            hit = ranks == np.repeat(lowest, counts)
            at = np.flatnonzero(hit)
            # In a run of overlapping places (one symbol repeated) every second one merges, from the left.
            new_run = np.r_[True, (np.diff(at) != 1) | (seq[at[1:]] != seq[at[:-1]])]
            run_start = at[new_run][np.cumsum(new_run) - 1]
            at = at[(at - run_start) % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbols, seq, ranks = symbols[keep], seq[keep], ranks[keep]
            at = place[at]
            ranks[at] = self.none
            for p in (at, at[at > 0] - 1):
                p = p[(p + 1 < len(seq))]
                p_inner = p[seq[p] == seq[p + 1]] if len(p) else p
                ranks[p_inner] = self.rank(symbols[p_inner], symbols[p_inner + 1])
        return result

    def counts(self, texts: list[str]) -> list[int]:
        split, known = self.split.findall, self.known
        parts: list[list[str]] = []
        extra = []
        for text in texts:
            if self.special is None or self.special.search(text) is None:
                parts.append(split(text))
                extra.append(0)
            else:
                pieces = self.special.split(text)
                parts.append([t for piece in pieces for t in split(piece)])
                extra.append(len(pieces) - 1)
        new = set().union(*parts).difference(known)
        if new:
            size = sum(map(len, new)) + 160 * len(new)  # of Python's objects, about
            if known and self.held + size > KNOWN_BYTES:
                known.clear()
                self.held = 0
                new = set().union(*parts)
            new = list(new)
            known.update(zip(new, self.merged_sizes(new).tolist(), strict=True))
        get = known.__getitem__
        found = [sum(map(get, tokens)) + more for tokens, more in zip(parts, extra, strict=True)]
        for token in new:
            if len(token) > SHORT:
                del known[token]
            else:
                self.held += 160 + len(token)
        return found


_MERGERS: dict[str, PairMerger] = {}


def merger(path: str) -> PairMerger:
    if path not in _MERGERS:
        _MERGERS[path] = PairMerger(path)
    return _MERGERS[path]


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", limit: int = 512, out: str = "n_tokens") -> DataFrame:
    """Append ``n_bytes``, ``out`` and ``over_limit`` (more than ``limit`` tokens) to ``df``.

    ``vocabulary`` is the path of a byte-level BPE in tokenizers' JSON form; every
    executor must have it.  Columns of these names in ``df`` are replaced.  Each row is
    counted by itself: nothing is shuffled, and a lost task is simply run again.
    """
    fresh = {"n_bytes", out, "over_limit"}
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in fresh])
    if text not in base.columns:
        raise ValueError(f"no column {text!r}")
    schema = T.StructType([*base.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary)
        for batch in narrow(batches, 2000):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            n_tokens: list[int] = []
            todo: list[str] = []
            size = 0
            for t in texts:
                todo.append(t)
                size += len(t)
                if size >= STEP_CHARS:
                    n_tokens += m.counts(todo)
                    todo, size = [], 0
            if todo:
                n_tokens += m.counts(todo)
            n_bytes = [len(t.encode()) for t in texts]
            columns = [*batch.columns, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_bytes", out])

    return base.mapInArrow(run, schema).withColumn("over_limit", F.col(out) > limit)
