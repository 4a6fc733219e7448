"""Language identification by a byte convolutional network.

Bytes (A-Z folded) are embedded, filters of several widths slide over them, the largest
response of each filter in a window of fixed length goes through a rectifier to a
softmax.  The net is trained in numpy on a bounded sample of labelled texts; every whole
text is then read in consecutive windows, batched over documents, and its windows'
probabilities are averaged by their bytes.

An embedded byte times a filter's weights at one offset is a row of a table, so a
convolution is a sum of table rows, one for each offset.

Text null or without a letter: ``und`` with score 0.  With no labelled text to learn from
there is no language to predict: every row is ``und`` with score 0.  Each row is read by
itself: repeated rows give equal rows, an empty table gives none, and columns that have
the name of an appended one are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.support import narrow, steps, utf8

#: What may be a letter; numerals such as one half are words for a pattern, but no letters.
_WORDLIKE = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def has_letter(text: str | None) -> bool:
    """A character of a letter's category, as \\p{L} takes them."""
    return text is not None and any(m.group().isalpha() for m in _WORDLIKE.finditer(text))


@dataclass(frozen=True)
class Settings:
    """Of the net and its training; ``per_language`` and ``most_rows`` bound the sample."""

    window: int = 256
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    #: Labelled documents of each language, about, and of all languages, at most, that training reads.
    per_language: int = 800
    most_rows: int = 16_000
    epochs: int = 8
    batch: int = 64
    rate: float = 0.004
    seed: int = 7


@dataclass
class ByteNet:
    settings: Settings
    labels: list[str]
    parameters: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        s = self.settings
        if not self.parameters:
            rng = np.random.default_rng(s.seed)
            draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
            self.parameters = {"embedding": draw(256, s.embedding, scale=0.5), "bias": np.zeros(s.filters * len(s.widths), np.float32)}
            self.parameters |= {f"filter{w}": draw(w, s.embedding, s.filters, scale=(w * s.embedding) ** -0.5) for w in s.widths}
            self.parameters |= {"out": draw(s.filters * len(s.widths), len(self.labels), scale=0.1), "out_bias": np.zeros(len(self.labels), np.float32)}

    def tables(self) -> list[np.ndarray]:
        """For each offset, the response of every filter to every byte there."""
        s, p = self.settings, self.parameters
        out = []
        for offset in range(max(s.widths)):
            parts = [p["embedding"] @ p[f"filter{w}"][offset] if offset < w else np.zeros((256, s.filters), np.float32) for w in s.widths]
            out.append(np.ascontiguousarray(np.concatenate(parts, 1)))
        return out

    def responses(self, windows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Of every filter at every place: (windows, places, filters)."""
        places = windows.shape[1] - len(tables) + 1
        total = tables[0][windows[:, :places]]
        for offset, table in enumerate(tables[1:], 1):
            total += table[windows[:, offset : offset + places]]
        return total

    def probabilities(self, windows: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        tables = tables or self.tables()
        p = self.parameters
        out = np.empty((len(windows), len(self.labels)), np.float32)
        for at in range(0, len(windows), 64):
            pooled = np.maximum(self.responses(windows[at : at + 64], tables).max(1) + p["bias"], 0)
            out[at : at + 64] = softmax(pooled @ p["out"] + p["out_bias"])
        return out

    def gradients(self, windows: np.ndarray, targets: np.ndarray) -> dict[str, np.ndarray]:
        s, p = self.settings, self.parameters
        total = self.responses(windows, self.tables())
        best = total.argmax(1)
        raw = np.take_along_axis(total, best[:, None], 1)[:, 0] + p["bias"]
        pooled = np.maximum(raw, 0)
        error = softmax(pooled @ p["out"] + p["out_bias"])
        error[np.arange(len(targets)), targets] -= 1
        error /= len(targets)
        back = (error @ p["out"].T) * (raw > 0)
        found = {"out": pooled.T @ error, "out_bias": error.sum(0), "bias": back.sum(0), "embedding": np.zeros_like(p["embedding"])}
        rows = np.arange(len(windows))[:, None]
        for k, w in enumerate(s.widths):
            own = slice(k * s.filters, (k + 1) * s.filters)
            seen = windows[rows[:, :, None], best[:, own, None] + np.arange(w)]  # (windows, filters, width) bytes
            found[f"filter{w}"] = np.einsum("bfwd,bf->wdf", p["embedding"][seen], back[:, own])
            np.add.at(found["embedding"], seen, np.einsum("wdf,bf->bfwd", p[f"filter{w}"], back[:, own]))
        return found

    def train(self, windows: np.ndarray, targets: np.ndarray) -> ByteNet:
        """Adam over shuffled batches; the same rows give the same net."""
        s, p = self.settings, self.parameters
        rng = np.random.default_rng(s.seed + 1)
        mean = {k: np.zeros_like(v) for k, v in p.items()}
        square = {k: np.zeros_like(v) for k, v in p.items()}
        step = 0
        total = s.epochs * -(-len(targets) // s.batch)
        for _ in range(s.epochs):
            order = rng.permutation(len(targets))
            for at in range(0, len(order), s.batch):
                rows = order[at : at + s.batch]
                step += 1
                rate = s.rate * (1 - step / (total + 1))
                for k, g in self.gradients(windows[rows], targets[rows]).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of whole rows of bytes (support.utf8); an empty row has zeros."""
        size, tables = self.settings.window, self.tables()
        lengths = np.diff(offsets)
        out = np.zeros((len(lengths), len(self.labels)))
        for first, last in steps(lengths):
            counts = -(-lengths[first:last] // size)
            windows = np.zeros((int(counts.sum()), size), np.uint8)
            flat, at = windows.reshape(-1), 0
            for i, n in zip(range(first, last), counts):
                flat[at : at + lengths[i]] = _FOLD[data[offsets[i] : offsets[i + 1]]]
                at += n * size
            if not len(windows):
                continue
            row = np.repeat(np.arange(first, last), counts)
            ends = np.cumsum(counts)
            weight = np.full(len(windows), size, np.float64)
            some = counts > 0
            weight[ends[some] - 1] = lengths[first:last][some] - (counts[some] - 1) * size
            np.add.at(out, row, self.probabilities(windows, tables) * weight[:, None])
        return out / np.maximum(lengths, 1)[:, None]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fold_of(id: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(folds))


def fit(train: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> ByteNet:
    """Learn from a bounded, hashed sample of the labelled rows of ``train``.

    About ``per_language`` documents of each language, fewer if the languages are so many
    that these would be more than ``most_rows``, come to the driver (those with the lowest
    hash of their id), one window's worth of characters of each, from a place that the
    hash chooses.  If there are still more than ``most_rows``, all sampled languages are
    thinned alike.  Without any labelled text the net has no labels.
    """
    labelled = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    if not counts:
        return ByteNet(settings, [])
    span = 1 << 30
    key = F.pmod(F.xxhash64(F.col(id).cast("string")), F.lit(span))
    each = max(min(settings.per_language, settings.most_rows // len(counts)), 1)
    pairs = [x for label, n in counts.items() for x in (F.lit(label), F.lit(min(span, span * each // n)))]
    bound = F.element_at(F.create_map(*pairs), F.col(lang))
    start = F.pmod(F.xxhash64(F.col(id).cast("string"), F.lit(1)), F.greatest(F.length(text) - settings.window, F.lit(0)) + 1)
    rows = (
        labelled.where(key < bound)
        .select((key / bound).alias("part"), key.alias("key"), F.col(lang).alias("lang"), F.substring(F.col(text), start.cast("int") + 1, F.lit(settings.window)).alias("text"))
        .orderBy("part", "key", "lang", "text").limit(settings.most_rows).collect()
    )
    rows.sort(key=lambda r: (r["key"], r["lang"], r["text"]))
    labels = sorted(counts)
    rng = np.random.default_rng(settings.seed)
    windows, targets = [], []
    for r in rows:
        data = r["text"].encode()
        for size in (settings.window, 64, 20):  # short windows, as short texts give them
            at = int(rng.integers(0, max(len(data) - size, 0) + 1))
            piece = _FOLD[np.frombuffer(data[at : at + size], np.uint8)]
            if len(piece):
                windows.append(np.pad(piece, (0, settings.window - len(piece))))
                targets.append(labels.index(r["lang"]))
    if not windows:
        return ByteNet(settings, [])
    return ByteNet(settings, labels).train(np.stack(windows), np.array(targets))


def predict(df: DataFrame, net: ByteNet, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Append the language of every whole text and its probability; columns of these names are replaced."""
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (label, score)])
    schema = T.StructType([*base.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in narrow(batches):
            column = batch.column(batch.schema.get_field_index(text))
            if not net.labels:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(["und"] * len(column), pa.string()), pa.array([0.0] * len(column), pa.float64())], names=[*batch.schema.names, label, score])
                continue
            p = net.predict(*utf8(column))
            best = p.argmax(1)
            letters = [has_letter(t) for t in column.to_pylist()]
            names = [net.labels[b] if ok else "und" for b, ok in zip(best, letters)]
            scores = np.where(letters, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0) if len(p) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, label, score])

    return base.mapInArrow(run, schema)


def identify(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """Learn from the labelled rows outside fold 0 of the ids, predict every row; ``held_out`` marks fold 0."""
    fold = F.coalesce(fold_of(F.col(id)), F.lit(0))
    net = fit(df.where(fold != 0), id, text, lang, settings)
    return predict(df.select(F.col(id), (fold == 0).alias("held_out"), F.col(text)), net, text).drop(text)
