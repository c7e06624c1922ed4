"""Near-duplicate documents through SetSketch registers.

1. A document is the set of its distinct word shingles, as 64-bit hashes. Equal sets form a class; one
   document stands for it from here on.
2. A SetSketch of REGISTERS truncated minima at exponentially spaced levels of base BASE is drawn from
   the set. Sketches of parts merge by the greater register; equal registers are likelier the more alike
   two sets are.
3. Bands of ROWS registers put classes into buckets. In each bucket all are compared with its least
   member; what turns out alike is one component. Buckets that still hold several components are then
   compared in full, on their sketches, in blocks; components with a likely pair meet on full sets, also
   in blocks. So buckets of true copies cost one comparison a member, what is moved never grows with
   the square of a group, and still no candidate pair goes unexamined.
4. The likeness of a pair is first estimated from its registers and the known set sizes by maximum
   likelihood; pairs far below the threshold go. The others are confirmed on full sets.
5. Components come from alternating large-star and small-star steps, by shuffles only.

A pair at the threshold shares a bucket with probability 1 - (1 - 0.8**6)**42 > 0.999997, more above it.

Defined results: null, empty or blank text has no shingles and is linked with nothing; text of fewer
words than a shingle is one shingle; unlike rows with equal doc_id are not linked by it, so rows that are
to be told apart need ids of their own; a null doc_id is linked
with nothing and has a null component, kept; repeated rows are in one class; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_others, stored, tidy
from .words import mix as _mix
from .words import word_hashes

REGISTERS, ROWS, BASE, RATE = 256, 6, 1.02, 20.0
BANDS = REGISTERS // ROWS
#: Pairs estimated this far under the threshold are dropped: six standard errors of the estimate.
MARGIN = 0.15
#: Bytes of text described at once; members of a bucket (as sketches) and of components (as full sets) compared at once; members of a star confirmed by one task.
SLICE, MEET, BLOCK, STAR = 1 << 19, 8192, 512, 512
#: Documents whose full sets are needed go to all executors by key only up to so many.
BROADCAST_KEYS = 1_000_000

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1


def shingle_sets(texts: list[str], size: int = 2) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    h, of = word_hashes(texts)
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        w = h[bounds[i] : bounds[i + 1]]
        if not len(w):
            out.append(np.empty(0, _U))
            continue
        width = min(size, len(w))
        s = w[: len(w) - width + 1].copy()
        for k in range(1, width):
            s = _mix(s) * _U(3) + w[k : len(w) - width + 1 + k]
        out.append(np.unique(_mix(s + _U(width))))
    return out


def sketches(sets: list[np.ndarray], m: int = REGISTERS, base: float = BASE, rate: float = RATE) -> np.ndarray:
    """Registers (sets x m, 16 bits). Each element draws ascending exponential times, each for a random
    register, until none of its later ones can still raise one; a register keeps its highest level."""
    n = len(sets)
    k = np.zeros((n, m), np.uint16)
    if not n:
        return k
    flat = k.reshape(-1)
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    time = np.zeros(len(elements))
    low = np.zeros(n, np.int64)
    drawn, width, log_base = 0, 1, math.log(base)
    active = np.arange(len(elements))
    while len(active):
        own, steps = owner[active], np.arange(drawn + 1, drawn + width + 1, dtype=_U) * _U(0xD1B54A32D192ED03)
        r = _mix(elements[active][:, None] + steps)
        times = time[active][:, None] + np.cumsum(-np.log(((r >> _U(11)).astype(float) + 0.5) * 2.0**-53), axis=1) / (rate * m)
        level = np.clip(np.floor(1 - np.log(times) / log_base), 0, 65535).astype(np.int64)
        up = level > low[own][:, None]
        place = (own * m)[:, None] + (_mix(r) % _U(m)).astype(np.int64)
        np.maximum.at(flat, place[up], level[up].astype(np.uint16))
        touched = np.unique(own)
        low[touched] = k[touched].min(axis=1)
        time[active] = times[:, -1]
        active = active[level[:, -1] > low[own]]
        drawn, width = drawn + width, min(2 * width, 32)
    return k


def bands(k: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Bucket keys (sets x bands)."""
    n = k.shape[1] // rows
    x = k[:, : n * rows].reshape(len(k), n, rows).astype(_U)
    h = np.broadcast_to(np.arange(n, dtype=_U), (len(k), n)).copy()
    for i in range(rows):
        h = _mix(h * _U(_P) + x[:, :, i])
    return h.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float = BASE) -> np.ndarray:
    """Jaccard likeness of pairs by maximum likelihood, jointly from greater, smaller and equal registers, given the set sizes."""
    up, down = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - up - down
    u = na / (na + nb)
    v = 1 - u
    scale, log_base = (base - 1) / base, math.log(base)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * scale) / log_base

    def score(j: np.ndarray) -> np.ndarray:
        more, less = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return up * np.log(more) + down * np.log(less) + same * np.log(np.maximum(1 - more - less, 1e-12))

    lo, hi, golden = np.zeros(len(a)), np.minimum(u / v, v / u), (5**0.5 - 1) / 2
    for _ in range(24):  # the likelihood has one peak
        x, y = hi - golden * (hi - lo), lo + golden * (hi - lo)
        left = score(x) > score(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of 512 rows and about a SLICE of text (column 1) at most, since a set's temporary arrays take many times its text."""
    for whole in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(whole.column(1)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if i > start and (size + n > SLICE or i - start >= 512):
                yield whole.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < whole.num_rows:
            yield whole.slice(start)
    tidy()


def _described(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, n, sig, sketch) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("setsketch")
        for batch in _slices(batches):
            sets = shingle_sets([t or "" for t in batch.column(1).to_pylist()], size)
            k = sketches(sets)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n": pa.array([len(s) for s in sets], pa.int64()), "sig": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()), "sketch": pa.array([r.tobytes() for r in k], pa.binary())})

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, "id long, n long, sig binary, sketch binary")


def _banded(reps: DataFrame) -> DataFrame:
    """(key, id) for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("setsketch")
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                k = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(part.num_rows, REGISTERS)
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_pydict({"key": pa.array(bands(k).ravel()), "id": pa.array(ids)})

    return reps.select("id", "sketch").mapInArrow(run, "key long, id long")


def _likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose estimated likeness is least or more."""
    own = reps.select("id", "n", "sketch")
    both = pairs.join(own.toDF("a", "na", "ka"), "a").join(own.toDF("b", "nb", "kb"), "b")
    # sets too different in size are never alike enough
    both = both.where(F.least("na", "nb") >= least * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("setsketch")
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                x = whole.slice(at, 4096)
                k = [np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint16).reshape(x.num_rows, REGISTERS) for c in ("ka", "kb")]
                j = estimate(*k, *[x.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb")])
                yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], names=["a", "b"]).filter(pa.array(j >= least))

    return both.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, "a long, b long")


def _sets(ids: DataFrame, docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, items): full shingle sets of the documents with those ids."""
    needed = cut(ids.select("id").distinct())
    few = needed.count() <= BROADCAST_KEYS
    texts = docs.select(F.col(key).cast("long").alias("id"), text).join(F.broadcast(needed) if few else needed, "id", "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("setsketch")
        for batch in _slices(batches):
            sets = shingle_sets([t or "" for t in batch.column(1).to_pylist()], size)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "items": pa.array([s.tobytes() for s in sets], pa.binary())})

    return texts.mapInArrow(make, "id long, items binary")


def _confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that hold on full sets: 100 * intersection >= percent * union."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, key, text, size)
    # a star's centre is sent once to each part of its members, and read before them
    stars = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts")), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    members = stars.select("a", "part", F.col("b").alias("id"), F.lit(1).alias("member"))
    centres = stars.select("a", "part").distinct().select("a", "part", F.col("a").alias("id"), F.lit(0).alias("member"))
    rows = centres.unionByName(members).join(sets, "id").repartition("a", "part").sortWithinPartitions("a", "part", "member")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("setsketch")
        centre, own = None, np.empty(0, _U)
        for batch in batches:
            a, b = [], []
            for c, i, member, items in zip(*[batch.column(x).to_pylist() for x in ("a", "id", "member", "items")]):
                s = np.frombuffer(items, _U)
                if not member:
                    centre, own = c, s
                    continue
                if c != centre or not len(own) or not len(s):
                    continue
                place = np.searchsorted(own, s)
                both = int((own[np.minimum(place, len(own) - 1)] == s).sum())
                if 100 * both >= percent * (len(own) + len(s) - both):
                    a.append(c)
                    b.append(i)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cut(rows.select("a", "id", "member", "items").mapInArrow(confirm, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id reachable, for each id in edges (a, b)."""
    spark = edges.sparkSession
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not n or (n, total) == before:
            break
        before = n, total
        # large star: neighbours above a node move to its least neighbour
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's lower neighbours, and the node, move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = cut(small.where("u != v").distinct())
    if before is None:
        return spark.createDataFrame([], "id long, label long")
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def _unsettled(banded: DataFrame, settled: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs of components (a, b) that share a bucket and in it a likely pair of members."""
    marked = banded.join(settled, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    marked = stored(marked)
    mixed = marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", F.ceil(F.col("n") / MEET).cast("int").alias("blocks"))
    members = marked.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # each two blocks of a bucket meet once; nearly all buckets are one block
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    rows = members.withColumn("meet", F.explode(F.array_distinct(meets))).select("key", "meet.x", "meet.y", "block", "id", "label").join(reps.select("id", "n", "sketch"), "id")
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id")

    def compare(group: list[tuple], out: set[tuple]) -> None:
        ids, labels, n = (np.array([g[i] for g in group]) for i in (1, 2, 3))
        blocks = np.array([g[5] for g in group])
        x, y = group[0][0][1:]
        k = np.frombuffer(b"".join(g[4] for g in group), np.uint16).reshape(len(group), REGISTERS)
        for i in range(len(group)):
            j = np.flatnonzero((labels != labels[i]) & (ids > ids[i]) & (np.minimum(n, n[i]) >= least * np.maximum(n, n[i])))
            if x != y:
                j = j[blocks[j] != blocks[i]]
            if len(j):  # equal registers are at least as common as shared elements
                j = j[(k[j] == k[i]).sum(1) >= (least - MARGIN) * REGISTERS]
            if len(j):
                near = estimate(np.broadcast_to(k[i], (len(j), REGISTERS)), k[j], np.full(len(j), float(n[i])), n[j].astype(float)) >= least
                out.update((min(int(labels[i]), b), max(int(labels[i]), b)) for b in np.unique(labels[j[near]]).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("setsketch")
        group: list[tuple] = []
        for batch in batches:
            out: set[tuple] = set()
            c = {name: batch.column(name).to_pylist() for name in ("key", "x", "y", "block", "id", "label", "n", "sketch")}
            for row in zip(zip(c["key"], c["x"], c["y"]), c["id"], c["label"], c["n"], c["sketch"], c["block"]):
                if group and group[0][0] != row[0]:
                    compare(group, out)
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})
        if group:
            out = set()
            compare(group, out)
            yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return rows.mapInArrow(run, "a long, b long").distinct()


def _crossed(combos: DataFrame, labels: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """A confirmed link (a, b) for each document of a component that is linked with the other one of a pair.

    The larger component of each pair stays in blocks, and the documents of all its partners, in blocks
    too, meet each of them once, on full sets. What is moved grows with the members, not with their pairs.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    both = combos.join(sizes.toDF("a", "na"), "a", "left").join(sizes.toDF("b", "nb"), "b", "left").fillna(1, ["na", "nb"])
    big = F.col("na") >= F.col("nb")
    sided = cut(both.select(F.when(big, F.col("a")).otherwise(F.col("b")).alias("home"), F.when(big, F.col("b")).otherwise(F.col("a")).alias("other")))
    member = lambda c: sided.select("home", c).distinct().join(labels.select(F.col("label").alias(c), "id"), c, "left").select("home", F.coalesce("id", c).alias("id"))
    homes, guests = cut(sided.select("home").distinct().join(labels.select(F.col("label").alias("home"), "id"), "home", "left").select("home", F.coalesce("id", "home").alias("id"))), cut(member("other").distinct())
    parts = homes.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("hs")).join(guests.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("gs")), "home")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    rows = homes.join(parts, "home").select("home", own("hs").alias("h"), every("gs").alias("g"), F.lit(0).alias("guest"), "id").unionByName(guests.join(parts, "home").select("home", every("hs").alias("h"), own("gs").alias("g"), F.lit(1).alias("guest"), "id"))
    sets = _sets(homes.select("id").unionByName(guests.select("id")), docs, key, text, size)
    rows = rows.join(sets, "id").repartition("home", "h", "g").sortWithinPartitions("home", "h", "g", "guest", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("setsketch")
        place, ids, held = None, [], []
        table: tuple | None = None
        for batch in batches:
            a, b = [], []
            c = {n: batch.column(n).to_pylist() for n in ("home", "h", "g", "guest", "id", "items")}
            for here, guest, i, items in zip(zip(c["home"], c["h"], c["g"]), c["guest"], c["id"], c["items"]):
                if here != place:
                    place, ids, held, table = here, [], [], None
                s = np.frombuffer(items, _U)
                if not guest:
                    ids.append(i)
                    held.append(s)
                    continue
                if not held:
                    continue
                if table is None:  # all items of the block with their owners, sorted
                    items_, owner = np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])
                    order = np.argsort(items_, kind="stable")
                    table = items_[order], owner[order], np.array([len(x) for x in held])
                all_, owner, n = table
                left, right = np.searchsorted(all_, s), np.searchsorted(all_, s, side="right")
                width = right - left
                hits = np.repeat(left - np.cumsum([0, *width[:-1]]), width) + np.arange(width.sum())
                both = np.bincount(owner[hits], minlength=len(n))
                good = np.flatnonzero(100 * both >= percent * (n + len(s) - both)) if len(s) else []
                good = [k for k in good if ids[k] != i]
                if good:
                    a.append(ids[good[0]])
                    b.append(i)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cut(rows.select("home", "h", "g", "guest", "id", "items").mapInArrow(run, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row; documents are linked if 100 * intersection >= percent * union."""
    least = max(0.05, percent / 100 - MARGIN)
    base = cut(_described(docs, key, text, size))
    first = F.row_number().over(Window.partitionBy("sig").orderBy("id"))
    reps = cut(base.where(F.col("id").isNotNull() & F.col("sig").isNotNull()).withColumn("__r", first).where("__r = 1").select("id", "n", "sig", "sketch"))
    banded = stored(_banded(reps))
    heads = banded.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("m")).where("m > 1").select("key", "a")
    shared = stored(banded.join(heads, "key"))
    star = cut(_likely(shared.where("id != a").select("a", F.col("id").alias("b")).distinct(), reps, least))
    edges = _confirmed(star, docs, key, text, size, percent)
    settled = cut(components(edges))
    combos = cut(_unsettled(shared.select("key", "id"), settled, reps, least))
    edges = edges.unionByName(_crossed(combos, settled, docs, key, text, size, percent))
    label = components(edges)
    named = reps.select("sig", F.col("id").alias("rep")).join(label.withColumnRenamed("id", "rep"), "rep", "left").select("sig", F.coalesce("label", "rep").alias("component"))
    out = base.select("id", "n", "sig").join(named, "sig", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
