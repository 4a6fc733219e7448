"""MinHash near-duplicate groups with sequential Bayesian verification.

1. Every document becomes a set of word shingles, the set a MinHash signature.  Equal
   sets are one class; from here on a class stands for all its documents.
2. Signatures are cut into bands; classes that share a band's hash share a bucket.  In
   each bucket the least class is paired with the others, never all with all.
3. The signatures of a pair are compared batch by batch.  A pair is dropped as soon as
   the posterior probability that its similarity reaches the threshold falls under the
   chosen miss probability; what is left is verified exactly, on the full sets.
4. Verified links join classes to components.  Buckets whose classes are all in one
   component are done, as no further link could change it.  The others are split by set
   size (linked sets differ by a bounded factor, so only neighbouring size classes meet)
   and dealt to blocks of bounded size, where signatures alone are compared.  Of what they
   don't rule out, each block first names as many pairs as would join its components, the
   likeliest; these are verified.  Only classes that still have a partner in another
   component then meet with their sets, in blocks that are bounded in set bytes too.

So no pair within a group of copies is listed for its own sake, and none that could
join two components is left out.  Rows that share a bucket or a partner with many others
are dealt over tasks (spread()).

Null or blank text has an empty set and links with nothing.  A repeated row, or one with
a repeated id, is a document of its own under the same id.  A row with a null id is its
own document: its component is null and it is kept.  An empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.support import mix, narrow, ragged, run_hashes, small_batches, spread, steps, utf8, words, written

#: Ids up to this number (8 bytes each) are sent to all tasks to pick rows of a large table; more are joined by a shuffle.
MOST_SENT = 1_000_000
#: Classes of one bucket that a task compares with one another at once, and hashes of their sets that it then holds (8 bytes each), about.
BLOCK, BLOCK_HASHES = 512, 1 << 20


@dataclass(frozen=True)
class Settings:
    """A link needs 100 * intersection >= percent * union."""

    width: int = 5
    percent: int = 80
    bands: int = 36
    rows: int = 5
    #: Signature values compared at once, and the probability at which a true link may be dropped.
    batch: int = 20
    miss: float = 1e-7
    seed: int = 11

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


@lru_cache(8)
def bounds(s: Settings) -> tuple[tuple[int, int], ...]:
    """(values compared, matches needed): with fewer, P(similarity >= threshold | matches) < miss, the prior being flat."""
    tau = s.percent / 100
    out = []
    for seen in range(s.batch, s.hashes + 1, s.batch):
        n, total, need = seen + 1, 0.0, 0
        for m in range(seen + 1):  # the posterior's upper tail is the chance of at most m successes in n draws
            total += math.comb(n, m) * tau**m * (1 - tau) ** (n - m)
            if total >= s.miss:
                need = m
                break
        out.append((seen, need))
    return tuple(out)


@lru_cache(8)
def coefficients(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(s.seed)
    draw = rng.integers(0, 1 << 32, (2, s.hashes), dtype=np.uint64).astype(np.uint32)
    return (draw[0] | np.uint32(1))[:, None], draw[1][:, None]


def signature(shingles: np.ndarray, s: Settings) -> np.ndarray:
    a, b = coefficients(s)
    low = np.full(s.hashes, np.uint32(0xFFFFFFFF))
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(folded), 8192):
        np.minimum(low, (folded[at : at + 8192] * a + b).min(1), out=low)
    return low


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer words than ``width`` are one shingle."""
    data, offsets = utf8(column)
    for first, last in steps(np.diff(offsets)):
        own = offsets[first : last + 1]
        _, _, at, hashes = words(data[own[0] : own[-1]], own - own[0], fold_case=True)
        runs = run_hashes(hashes, width)
        for i, j in zip(at[:-1], at[1:]):
            yield np.unique(runs[i : j - width + 1] if j - i >= width else run_hashes(hashes[i:j], j - i) if j > i else hashes[:0])


def sketches(df: DataFrame, id: str, text: str, s: Settings) -> DataFrame:
    """id, set size n, 128 bits of the set (c1, c2), band hashes and signature (16 bits a value) of every row."""
    base = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([base.schema.fields[0], *(T.StructField(c, T.LongType()) for c in ("n", "c1", "c2")), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, s.bands + 1, dtype=np.uint64))
        for batch in narrow(batches):
            n, c1, c2, bands, ends, sigs = [], [], [], [], [0], []
            for shingles in shingle_sets(batch.column(1), s.width):
                n.append(len(shingles))
                ends.append(ends[-1])
                if not len(shingles):
                    c1.append(None), c2.append(None), sigs.append(None)
                    continue
                c1.append(int(mix(shingles).sum().view(np.int64)))
                c2.append(int(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)))
                sig = signature(shingles, s).astype(np.uint16)
                key = salt.copy()
                for row in sig.reshape(s.bands, s.rows).T:
                    key = mix(key ^ row)
                bands.append(key.view(np.int64))
                ends[-1] += s.bands
                sigs.append(sig.tobytes())
            values = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), ragged(values, np.array(ends), pa.int64()), pa.array(sigs, pa.binary())], names=schema.names)

    return base.mapInArrow(run, schema)


def signatures(column: pa.Array, s: Settings) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, s.hashes)


def screened(pairs: DataFrame, sigs: DataFrame, s: Settings) -> DataFrame:
    """Of pairs (a, b), a kept table, those that the batches of their signatures don't rule out, with the values that agree."""
    with_b = spread(pairs, sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), ["b"])
    joined = with_b.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").select("a", "b", "sa", "sb")
    schema = T.StructType([joined.schema["a"], joined.schema["b"], T.StructField("agree", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = signatures(batch.column(2), s), signatures(batch.column(3), s)
            alive, agree, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
            for seen, need in bounds(s):
                agree[alive] += (left[alive, done:seen] == right[alive, done:seen]).sum(1)
                alive, done = alive[agree[alive] >= need], seen
            pick = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(agree[alive])], names=schema.names)

    return joined.mapInArrow(run, schema)


def full_sets(nodes: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """(id, set) of the documents whose ids are in ``nodes`` (id, without repeats).  ``docs``: id and text of every document."""
    if nodes.count() <= MOST_SENT:
        nodes = F.broadcast(nodes)
    base = docs.join(nodes, "id", "left_semi").select("id", "text")
    schema = T.StructType([base.schema["id"], T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in narrow(batches):
            sets = list(shingle_sets(batch.column(1), s.width))
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([batch.column(0), ragged(values, ends, pa.int64())], names=schema.names)

    return written(base.mapInArrow(run, schema), "sets")


def verified(pairs: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Of pairs (a, b), a kept table, those that are links by their full sets."""
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, s)
    with_b = spread(pairs.select("a", "b"), sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), ["b"])
    joined = with_b.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - common
    return joined.where((common * 100 >= union * s.percent) & (common > 0)).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of ``edges`` (a, b) can reach.

    Labels spread to neighbours and then jump to their label's label, until none changes.
    """
    both = written(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = least.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", "old", F.least("label", "next").alias("label"))
        found = written(jumped, "labels")
        labels = found.select("node", "label")
        if found.where("old != label").isEmpty():
            return labels


def relabel(df: DataFrame, labels: DataFrame | None, node: str, out: str) -> DataFrame:
    """Append the label of a node column; a node without links is its own label."""
    if labels is None:
        return df.withColumn(out, F.col(node))
    own = labels.select(F.col("node").alias(node), F.col("label").alias("__label"))
    return df.join(own, node, "left").withColumn(out, F.coalesce("__label", node)).drop("__label")


class Groups:
    """Links found so far, and the components that they make."""

    def __init__(self, docs: DataFrame, settings: Settings):
        self.docs, self.settings = docs, settings
        self.edges: DataFrame | None = None
        self.labels: DataFrame | None = None

    def add(self, links: DataFrame) -> None:
        found = written(links, "links")
        if not found.isEmpty():
            self.edges = found if self.edges is None else self.edges.union(found)
            self.labels = components(self.edges)

    def settle(self, survivors: DataFrame) -> None:
        """Verify each class's likeliest partner first, then what still lies between two components."""
        survivors = written(survivors, "survivors")
        if survivors.isEmpty():
            return
        first = survivors.groupBy("a").agg(F.max_by("b", "agree").alias("b"))
        self.add(verified(written(first, "pairs"), self.docs, self.settings))
        rest = relabel(relabel(survivors.join(first, ["a", "b"], "left_anti"), self.labels, "a", "la"), self.labels, "b", "lb")
        rest = written(rest.where("la != lb").select("a", "b").distinct(), "pairs")
        if not rest.isEmpty():
            self.add(verified(rest, self.docs, self.settings))


def dealt_blocks(members: DataFrame, labels: DataFrame | None, s: Settings) -> DataFrame:
    """Rows of the blocks in which classes that share a bucket but no component meet.

    ``members``: bucket, band, node and n (set size).  A bucket's classes of one size class, and those of the class
    below, are a group.  In a group of several components the classes outside the commonest one (minor) meet all
    classes: block (i, j) holds those with number i of all and those with number j of the minor ones.
    """
    ratio = 100 / s.percent * (1 + 1e-9)
    size_class = F.floor(F.log("n") / math.log(ratio)).cast("int") if ratio > 1.01 else F.col("n").cast("int")
    labelled = written(relabel(members, labels, "node", "label").withColumn("own", size_class).withColumn("group", F.explode(F.array("own", F.col("own") + 1))), "labelled")
    counts = labelled.groupBy("bucket", "group", "label").agg(F.count("*").alias("count"), F.sum("n").alias("hashes"))
    most = F.max(F.struct("count", "label", "hashes")).alias("most")
    mixed = counts.groupBy("bucket", "group").agg(most, F.sum("count").alias("count"), F.sum("hashes").alias("hashes"), F.count("*").alias("labels")).where("labels > 1")
    needed = lambda count, hashes: F.ceil(F.greatest(count / BLOCK, hashes / BLOCK_HASHES, F.lit(1))).cast("int")
    mixed = written(mixed.select("bucket", "group", "count", F.col("most.label").alias("major"), needed(F.col("count"), F.col("hashes")).alias("blocks"), needed(F.col("count") - F.col("most.count"), F.col("hashes") - F.col("most.hashes")).alias("minor_blocks")), "groups")
    rows = written(spread(labelled, mixed, ["bucket", "group"], "count"), "mixed")
    place, kept = F.xxhash64("node"), ["bucket", "group", "band", "node", "n", "label", (F.col("own") == F.col("group")).alias("upper")]
    every = rows.select(*kept, F.lit(False).alias("minor"), F.pmod(place, "blocks").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("minor_blocks") - 1)).alias("j"))
    minor = rows.where("label != major").select(*kept, F.lit(True).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(place, "minor_blocks").cast("int").alias("j"))
    return every.union(minor)


class Rows:
    """The columns of a batch of block rows as arrays."""

    def __init__(self, t: pa.RecordBatch, s: Settings, exact: bool):
        self.band, self.n = t.column("band").to_numpy(), t.column("n").to_numpy()
        self.upper, self.minor = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("upper", "minor"))
        self.label = t.column("label").dictionary_encode().indices.to_numpy()
        self.sig = signatures(t.column("sig"), s)
        self.ends = self.values = None
        if exact:
            sets = t.column("set")
            self.ends, self.values = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)


def met(blocks: DataFrame, sigs: DataFrame, sets: DataFrame | None, s: Settings, listed: str) -> DataFrame:
    """What the blocks find.  A pair counts in the first band that it shares, if its sizes and signatures don't rule it out.

    ``listed``: "links" (a, b), the likeliest first, and none within what they have joined: as many as would join
    components by signatures or, if the sets are there, as do; "members" (node) that have a partner.
    """
    told, exact = sigs.select("node", "sig"), sets is not None
    columns = ["bucket", "group", "i", "j", "band", "node", "n", "label", "upper", "minor", "sig"]
    if exact:
        told = told.join(sets.select(F.col("id").alias("node"), "set"), "node")
        columns.append("set")
    placed = blocks.join(told, "node").repartition("bucket", "group", "i", "j").sortWithinPartitions("bucket", "group", "i", "j").select(columns)
    kind = blocks.schema["node"].dataType
    if listed == "links":
        schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    else:
        schema = T.StructType([T.StructField("node", kind)])

    def partners(rows: Rows, own: slice) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of a block's rows that may be links, and how many values agree."""
        label, n, sig, minor = rows.label[own], rows.n[own], rows.sig[own], rows.minor[own]
        upper, band = rows.upper[own], rows.band[own.start]
        left, right = np.flatnonzero(minor), np.flatnonzero(~minor)
        for at in range(0, len(left), 32):
            i = left[at : at + 32, None]
            small, large = np.minimum(n[i], n[right]), np.maximum(n[i], n[right])
            x, y = np.nonzero((label[i] != label[right]) & (upper[i] | upper[right]) & (100 * small >= s.percent * large))
            x, y = left[at + x], right[y]
            agree, done = np.zeros(len(x), np.int64), 0
            for seen, need in bounds(s):
                if not len(x):
                    break
                agree = agree + (sig[x, done:seen] == sig[y, done:seen]).sum(1)
                keep = agree >= need
                x, y, agree, done = x[keep], y[keep], agree[keep], seen
            if band and len(x):
                before = (sig[x, : band * s.rows] == sig[y, : band * s.rows]).reshape(len(x), band, s.rows)
                keep = ~before.all(2).any(1)
                x, y, agree = x[keep], y[keep], agree[keep]
            if len(x):
                yield own.start + x, own.start + y, agree

    def linked(rows: Rows, i: int, j: int) -> bool:
        if rows.ends is None:
            return True
        x, y = (rows.values[rows.ends[k] : rows.ends[k + 1]] for k in (i, j))
        both = np.concatenate([x, y])
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= s.percent * (len(x) + len(y) - common)

    def compare(rows: Rows, own: slice, links: list[tuple[int, int]]) -> None:
        """Append the pairs of rows that the block lists."""
        if (rows.label[own] == rows.label[own.start]).all():
            return
        if listed == "members":
            for x, y, _ in partners(rows, own):
                links += [(k, k) for k in np.union1d(x, y).tolist()]
            return
        top: dict[int, int] = {}  # of each component the one that links of this block have joined it to

        def root(x: int) -> int:
            while top.get(x, x) != x:
                x = top[x]
            return x

        for x, y, agree in partners(rows, own):
            for k in np.argsort(-agree, kind="stable"):
                i, j = int(x[k]), int(y[k])
                p, q = root(int(rows.label[i])), root(int(rows.label[j]))
                if p != q and linked(rows, i, j):
                    top[max(p, q)] = min(p, q)
                    links.append((i, j))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # the block that the last batch ended in
        for batch in itertools.chain(narrow(batches), [None]):  # with sets a row is kilobytes
            t = carried if batch is None else batch if carried is None else pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
            if t is None or not t.num_rows:
                continue
            keys = [t.column(k).to_numpy() for k in range(4)]
            starts = np.r_[0, np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1].tolist()
            carried = t.slice(starts[-1]) if batch is not None else None
            bounds_ = starts if batch is not None else [*starts, t.num_rows]
            if len(bounds_) < 2:
                continue
            rows, links = Rows(t, s, exact), []
            for first, last in zip(bounds_[:-1], bounds_[1:]):
                compare(rows, slice(first, last), links)
            x, y = (t.column("node").take(pa.array([link[k] for link in links], pa.int64())) for k in (0, 1))
            if listed == "members":
                yield pa.RecordBatch.from_arrays([x], names=["node"])
            else:
                yield pa.RecordBatch.from_arrays([pc.min_element_wise(x, y), pc.max_element_wise(x, y)], names=["a", "b"])

    return placed.mapInArrow(run, schema).distinct()


def across(members: DataFrame, sigs: DataFrame, groups: Groups) -> None:
    """Add the links between classes that share a bucket but no component; ``members``: bucket, band, node and n."""
    s = groups.settings
    blocks = written(dealt_blocks(members, groups.labels, s), "blocks")
    if blocks.isEmpty():
        return
    likely = written(met(blocks, sigs, None, s, "links"), "pairs")
    if likely.isEmpty():
        return
    groups.add(verified(likely, groups.docs, s))
    # Labels are coarser now; the blocks still hold every pair across them.
    blocks = relabel(blocks.drop("label"), groups.labels, "node", "label")
    left = written(met(blocks, sigs, None, s, "members"), "members")
    if left.isEmpty():
        return
    sets = full_sets(left.select(F.col("node").alias("id")), groups.docs, s)
    groups.add(met(blocks.join(left, "node", "left_semi"), sigs, sets, s, "links"))


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """id, n_shingles, component_id and kept of every row of ``df``."""
    with small_batches(df.sparkSession):
        rows, classes, labels = grouped(df, id, text, settings)
    placed = rows.select("id", "n", "c1", "c2").join(classes, ["c1", "c2"], "left")
    placed = relabel(placed, labels, "node", "component")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return placed.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def grouped(df: DataFrame, id: str, text: str, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Sketches of all rows, the node of each class, and the label of each node that is linked."""
    docs = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = written(sketches(docs, "id", "text", s), "sketches")
    some = rows.where("n > 0 and id is not null")
    classes = written(some.groupBy("c1", "c2").agg(F.min("id").alias("node")), "classes")
    sigs = written(some.join(classes, ["c1", "c2"]).where("id = node").dropDuplicates(["c1", "c2"]).select("node", "n", "bands", "sig"), "signatures")

    cells = sigs.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    buckets = written(cells.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("least")).where("size > 1"), "buckets")
    members = written(spread(cells, buckets, ["bucket"], "size"), "members")
    groups = Groups(docs, s)
    pairs = written(members.where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), "pairs")
    groups.settle(screened(pairs, sigs, s))
    across(members.where("size > 2").select("bucket", "band", "node", "n"), sigs, groups)
    return rows, classes, groups.labels
