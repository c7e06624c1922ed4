"""LM scoring with a log-frequency Bloom filter.

Tokens are words (ASCII letters lower-cased) and one end for each text, known by 64-bit hashes. Every word
and every pair of neighbours of the training texts counts, those seen once too. Counts are quantised on a
log scale, and a word or pair is put into a Bloom filter once for each level up to its own; a count is read
by probing one level after the other until one is absent. The model smooths by a Dirichlet prior of weight
PRIOR, with all of its counts read from the filter:

    P(w | h) = (c(h, w) + PRIOR * P(w)) / (c(h) + PRIOR)

c(h, w) is held to c(h) and c(w), so whatever false hits the filter has, no score exceeds 0. base_score and
n_known use the exact counts of words, which lie beside the filter.

The filter is built in shards by the leading bits of the hashes; their number follows the training texts, and
a shard's bits (BITS for each insertion) what was put into it. Up to MOST_BYTES the filter and the counts are
broadcast. Beyond, they stay where they are: the texts go by a hash into chunks of about CHUNK bytes, each
chunk asks every shard for its distinct words and pairs, packed, and the answers meet the chunk again. What
is moved then is proportional to the texts, and no task holds more than a chunk or a shard.

Defined results: null or empty text is one end token; a null doc_id is not held out; with nothing to learn
from every count is 0 and scores use a vocabulary of one; repeated rows count, and are scored, as often as
they stand; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, tidy
from .langid import held_out
from .words import mix, word_hashes

BITS, PROBES, LEVEL_BASE, PRIOR, SMOOTHING = 10, 3, 1.5, 2.0, 0.1
#: Bytes of the filter and the word counts that go to all executors, of training text for each shard, of text in a chunk.
MOST_BYTES, SHARD, CHUNK = 1 << 24, 1 << 22, 1 << 23
#: Tokens that a task gathers before it hands their counts on.
TOKENS = 4_000_000
#: Arrays from this length on are moved compressed.
PRESSED = 64

_U = np.uint64
#: The key of the end of a text.
END = _U(0x0E0D0E0D0E0D0E0D)
_LOW = _U(0xFFFFFFFF)


def _value(level: int) -> float:
    """The mean of the counts of a level."""
    first, last = math.ceil(LEVEL_BASE ** (level - 1) - 1e-9), math.ceil(LEVEL_BASE**level - 1e-9) - 1
    return (first + last) / 2


#: What a level stands for; 0 was never put in.
VALUES = np.array([0.0, *[_value(k) for k in range(1, 128)]])


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def token_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the tokens of all texts, tokens of each text)."""
    h, of = word_hashes([t or "" for t in texts])
    out = np.full(len(h) + len(texts), END, _U)
    out[np.arange(len(h)) + of] = h
    return out, np.bincount(of, minlength=len(texts)) + 1


def pair_keys(tokens: np.ndarray) -> np.ndarray:
    """Keys of (the token before, token); a text starts after an end."""
    return mix(mix(np.roll(tokens, 1)) * _U(0x9E3779B97F4A7C15) + tokens)


def _shards(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> _U(64 - bits)).astype(np.int64)


def _local(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits by which a key is known in its shard."""
    return ((keys << _U(bits)) >> _U(32)).astype(np.uint32)


def _split(keys: np.ndarray, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shards, first, end) of sorted keys."""
    own = _shards(keys, bits)
    shards = np.unique(own) if wanted is None else wanted
    return shards, np.searchsorted(own, shards), np.searchsorted(own, shards, side="right")


def press(x: np.ndarray, ascending: bool = False) -> bytes:
    """An array as few bytes: differences of ascending numbers, byte by byte, by zstd."""
    if len(x) < PRESSED:
        return b"\0" + x.tobytes()
    step = np.diff(x, prepend=x.dtype.type(0)) if ascending else x
    planes = np.ascontiguousarray(step.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return (b"\2" if ascending else b"\1") + len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpress(blob: bytes, dtype) -> np.ndarray:
    if not blob[:1].strip(b"\0"):
        return np.frombuffer(blob, dtype, offset=1)
    planes = pa.decompress(blob[9:], int.from_bytes(blob[1:9], "little"), "zstd", asbytes=True)
    x = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()
    return np.cumsum(x, dtype=dtype) if blob[0] == 2 else x


def _blobs(x: np.ndarray, first: np.ndarray, end: np.ndarray, ascending: bool = False) -> pa.Array:
    return pa.array([press(x[a:b], ascending) for a, b in zip(first.tolist(), end.tolist())], pa.binary())


def _packed(words: np.ndarray, pairs: np.ndarray, bits: int, more: dict[str, tuple[np.ndarray, bool]] | None = None) -> dict[str, pa.Array]:
    """Columns shard, w and p (keys by shard), and more: arrays along the words, or the pairs."""
    shards = np.union1d(_shards(words, bits), _shards(pairs, bits))
    _, a, b = _split(words, bits, shards)
    _, c, d = _split(pairs, bits, shards)
    out = {"shard": pa.array(shards, pa.int32()), "w": _blobs(words, a, b, True), "p": _blobs(_local(pairs, bits), c, d, True)}
    for name, (x, of_pairs) in (more or {}).items():
        out[name] = _blobs(x, c, d) if of_pairs else _blobs(x, a, b)
    return out


def _counted(docs: DataFrame, bits: int, text: str) -> DataFrame:
    """Counts of words and pairs by shard, in packed pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate([p for _, p in held]), return_counts=True)
            words, c = np.unique(np.concatenate([t for t, _ in held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_pydict(_packed(words, pairs, bits, {"c": (c.astype(np.uint32), False), "n": (n.astype(np.uint32), True)}))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                tokens, _ = token_keys(batch.column(0).slice(at, 256).to_pylist())
                held.append((tokens, pair_keys(tokens)))
                size += len(tokens)
                if size >= TOKENS:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        tidy()

    return docs.select(text).mapInArrow(run, "shard int, w binary, p binary, c binary, n binary")


def _each(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    return [np.empty(0, dtype), *[unpress(x, dtype) for x in column.to_pylist()]]


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.concatenate(_each(column, dtype))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.empty(0, np.int64)


def _places(local: np.ndarray, level: np.ndarray | int, size: int) -> list[np.ndarray]:
    """Bits of keys at a level, in a shard of `size` bits."""
    h = mix((local.astype(_U) + (np.asarray(level).astype(_U) << _U(32))) * _U(0x9E3779B97F4A7C15))
    a, b = h & _LOW, (h >> _U(32)) | _U(1)
    return [((((a + _U(i) * b) & _LOW) * _U(size)) >> _U(32)).astype(np.int64) for i in range(PROBES)]


def fill(local: np.ndarray, depth: np.ndarray, density: int = BITS) -> tuple[bytes, int]:
    """(bits, their number) of a shard that holds each key at all levels up to its depth."""
    size = max(64, int(depth.sum()) * density)
    bits = np.zeros(size, bool)
    for level in range(1, int(depth.max(initial=0)) + 1):
        for place in _places(local[depth >= level], level, size):
            bits[place] = True
    return np.packbits(bits).tobytes(), size


def probe(local: np.ndarray, bits: np.ndarray, size: int, top: int) -> np.ndarray:
    """The level up to which each key is there."""
    found, live = np.zeros(len(local), np.uint8), np.arange(len(local))
    for level in range(1, top + 1):
        if not len(live):
            break
        hit = np.ones(len(live), bool)
        for place in _places(local[live], level, size):
            hit &= (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
        live = live[hit]
        found[live] = level
    return found


def _merge(bits: int, density: int):
    """A shard of the filter with its words: (shard, bits, size, top, w, c, words, total)."""

    def run(pieces: pa.Table) -> pa.Table:
        words, c = _summed(_joined(pieces.column("w"), _U), _joined(pieces.column("c"), np.uint32))
        pairs, n = _summed(_joined(pieces.column("p"), np.uint32), _joined(pieces.column("n"), np.uint32))
        depth = levels(np.concatenate([c, n]))
        made, size = fill(np.concatenate([_local(words, bits), pairs]), depth, density)
        return pa.table({"shard": pa.array([pieces.column("shard")[0].as_py()], pa.int32()), "bits": [made], "size": [size], "top": [int(depth.max())], "w": [words.tobytes()], "c": [c.tobytes()], "words": [len(words)], "total": [int(c.sum())]})

    return run


_PARTS = "shard int, bits binary, size long, top long, w binary, c binary, words long, total long"


class Part:
    """One shard."""

    def __init__(self, row):
        self.bits, self.size, self.top = np.frombuffer(row["bits"], np.uint8), row["size"], row["top"]
        self.words, self.counts = np.frombuffer(row["w"], _U), np.frombuffer(row["c"], np.int64)

    def exact(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, words), max(len(self.words) - 1, 0))
        return np.where(self.words[at] == words, self.counts[at], 0) if len(self.words) else np.zeros(len(words), np.int64)

    def levels(self, local: np.ndarray) -> np.ndarray:
        return probe(local, self.bits, self.size, self.top)


class Model:
    """What was learned: the frame of its shards, their number as bits, the totals, and, where small, the shards themselves."""

    def __init__(self, parts: DataFrame, bits: int):
        self.parts, self.bits = parts, bits
        bytes_ = F.octet_length("bits") + F.octet_length("w") + F.octet_length("c")
        self.total, self.distinct, self.bytes = (x or 0 for x in parts.agg(F.sum("total"), F.sum("words"), F.sum(bytes_)).first())
        self.local = {r["shard"]: Part(r) for r in parts.collect()} if self.bytes <= MOST_BYTES else None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"parts": None, "local": None}

    def look(self, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(exact counts of words, their levels, levels of pairs) of sorted keys, from the shards at hand."""
        c, lw, lp = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint8), np.zeros(len(pairs), np.uint8)
        for shard, a, b in zip(*(x.tolist() for x in _split(words, self.bits))):
            if part := self.local.get(shard):
                c[a:b], lw[a:b] = part.exact(words[a:b]), part.levels(_local(words[a:b], self.bits))
        for shard, a, b in zip(*(x.tolist() for x in _split(pairs, self.bits))):
            if part := self.local.get(shard):
                lp[a:b] = part.levels(_local(pairs[a:b], self.bits))
        return c, lw, lp

    def scores(self, tokens: np.ndarray, sizes: np.ndarray, look) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of each text; look is as above."""
        words, at = np.unique(tokens, return_inverse=True)
        pairs, at_pair = np.unique(pair_keys(tokens), return_inverse=True)
        c, lw, lp = look(words, pairs)
        whole = self.total + SMOOTHING * (self.distinct + 1)
        counts = VALUES[lw]
        p = np.minimum(1.0, (counts + SMOOTHING) / whole)
        own, before = counts[at], counts[np.roll(at, 1)]
        n = np.minimum(VALUES[lp][at_pair], np.minimum(own, before))
        term = np.log10((n + PRIOR * p[at]) / (before + PRIOR))
        first = np.cumsum([0, *sizes[:-1]])
        add = lambda x: np.add.reduceat(x, first) if len(first) else np.empty(0, x.dtype)
        return {"n_tokens": sizes.astype(np.int64), "n_known": add((c > 0).astype(np.int64)[at]), "base_score": add(np.log10((c + SMOOTHING) / whole)[at]), "score": add(term)}


def _bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def train(docs: DataFrame, text: str = "text") -> Model:
    bits = max(4, math.ceil(math.log2(max(1, _bytes(docs, text) / SHARD))))
    return Model(stored(_counted(docs, bits, text).groupBy("shard").applyInArrow(_merge(bits, BITS), _PARTS)), bits)


_RESULTS = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]


def _near(docs: DataFrame, model: Model, schema: T.StructType) -> DataFrame:
    """Scores with the shards at every worker; docs: (__key, __text)."""
    shared = docs.sparkSession.sparkContext.broadcast((model, {k: p.__dict__ for k, p in model.local.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, parts = shared.value
        m.local = {}
        for shard, held in parts.items():
            m.local[shard] = Part.__new__(Part)
            m.local[shard].__dict__ = held
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = m.scores(*token_keys(part.column(1).to_pylist()), m.look)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(found[f.name]) for f in _RESULTS]], names=["__key", *[f.name for f in _RESULTS]])

    return docs.mapInArrow(run, schema)


def _far(docs: DataFrame, model: Model, schema: T.StructType) -> DataFrame:
    """Scores with the shards asked by chunks of the texts; docs: (__key, __text)."""
    chunks = max(1, math.ceil(_bytes(docs, "__text") / CHUNK))
    dealt = docs.withColumn("__chunk", F.pmod(F.xxhash64("__key", "__text"), F.lit(chunks)).cast("long"))
    bits, own = model.bits, model

    def ask(chunk: pa.Table) -> pa.Table:
        tokens, _ = token_keys(chunk.column("__text").to_pylist())
        made = _packed(np.unique(tokens), np.unique(pair_keys(tokens)), bits)
        number = pa.array([chunk.column("__chunk")[0].as_py()] * len(made["shard"]), pa.int64())
        return pa.table({"shard": made["shard"], "__chunk": number, "w": made["w"], "p": made["p"]})

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        part = Part(held.to_pylist()[0]) if len(held) else None
        each = _each(asked.column("w"), _U)[1:], _each(asked.column("p"), np.uint32)[1:]
        words, pairs = (np.concatenate([none, *x]) for none, x in zip((np.empty(0, _U), np.empty(0, np.uint32)), each))
        c, lw, lp = (part.exact(words), part.levels(_local(words, bits)), part.levels(pairs)) if part else (np.zeros(len(words), np.int64), np.zeros(len(words), np.uint8), np.zeros(len(pairs), np.uint8))
        at, at_pair = (np.cumsum([0, *map(len, x)]) for x in each)
        return pa.table({"__chunk": asked.column("__chunk"), "shard": asked.column("shard"), "c": _blobs(c, at[:-1], at[1:]), "lw": _blobs(lw, at[:-1], at[1:]), "lp": _blobs(lp, at_pair[:-1], at_pair[1:])})

    def finish(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("shard")

        def look(words: np.ndarray, pairs: np.ndarray):
            got = _joined(answers.column("c"), np.int64), _joined(answers.column("lw"), np.uint8), _joined(answers.column("lp"), np.uint8)
            if (len(got[0]), len(got[2])) != (len(words), len(pairs)):
                raise RuntimeError("a chunk changed between its two readings")
            return got

        found = own.scores(*token_keys(chunk.column("__text").to_pylist()), look)
        return pa.table({"__key": chunk.column("__key"), **{f.name: pa.array(found[f.name]) for f in _RESULTS}})

    asks = dealt.groupBy("__chunk").applyInArrow(ask, "shard int, __chunk long, w binary, p binary")
    answers = asks.groupBy("shard").cogroup(model.parts.select("shard", "bits", "size", "top", "w", "c").groupBy("shard")).applyInArrow(answer, "__chunk long, shard int, c binary, lw binary, lp binary")
    return dealt.groupBy("__chunk").cogroup(answers.groupBy("__chunk")).applyInArrow(finish, schema)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    schema = T.StructType([T.StructField("__key", docs.schema[key].dataType), *_RESULTS])
    out = (_near if model.local is not None else _far)(rows, model, schema)
    return out.select(F.col("__key").alias(key), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def held_out_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """Scores of all rows by a model of the rows not held out."""
    out = held_out(F.col(key), folds, 0)
    scored = score(docs, train(docs.where(~out), text), key, text)
    return scored.select(key, out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
