"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams are summed for each language over all training rows; the matrix of log
probabilities, of (languages x BUCKETS) numbers, is broadcast. Texts are scored in batches: the
n-grams of many texts index the matrix at once and are summed by text.

Defined results: null text, or text without a letter, is `und` with score 0, as is every text when
nothing can be learned; equal scores go to the first language in order; a null doc_id is not held out;
repeated rows count and are scored as often as they stand; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS, BUCKET_BITS, SMOOTHING = (1, 2, 3), 16, 0.5
BUCKETS = 1 << BUCKET_BITS
UNKNOWN = "und"
PAD = max(ORDERS) - 1
#: Code points scored at once.
SLICE = 1_000_000
_LETTER = regex.compile(r"\p{L}")


def held_out(key: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))


def gram_ids(points: np.ndarray, order: int) -> np.ndarray:
    """Buckets of all n-grams of one order."""
    h = points.astype(np.uint32)
    for _ in range(order - 1):
        h = h[:-1] * np.uint32(0x01000193) + points[len(points) - len(h) + 1 :]
    return (((h + np.uint32(order)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _slices(texts: list[str], most: int = SLICE) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(indices, code points, starts): texts in groups, each followed by PAD zeros; n-grams that start in those are no text's."""
    pad = "\0" * PAD
    group, size = [], 0
    for i, t in enumerate(texts):
        if group and size + len(t) > most:
            yield _points(texts, group, pad)
            group, size = [], 0
        group.append(i)
        size += len(t)
    if group:
        yield _points(texts, group, pad)


def _points(texts: list[str], group: list[int], pad: str) -> tuple[list[int], np.ndarray, np.ndarray]:
    parts = [texts[i].lower() + pad for i in group]
    starts = np.cumsum([0, *map(len, parts)])
    return group, np.frombuffer("".join([*parts, pad]).encode("utf-32-le"), np.uint32), starts


def _pads(starts: np.ndarray) -> np.ndarray:
    """Places of the zeros."""
    return (starts[1:, None] - np.arange(1, PAD + 1)).ravel()


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and the matrix (BUCKETS + 1, languages); its last row holds the log priors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int64()), "n": pa.array(n[at], pa.int64())})
            sums.clear()

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for group, points, starts in _slices(texts):
                names, of = np.unique(np.array([langs[i] for i in group], object), return_inverse=True)
                owner = np.repeat(of, np.diff(starts))
                owner[_pads(starts)] = -1
                for k, name in enumerate(names):
                    n = sums.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    n[BUCKETS] += int((of == k).sum())
                    for order in ORDERS:
                        n[:BUCKETS] += np.bincount(gram_ids(points, order)[: len(owner)][owner == k], minlength=BUCKETS)
            if len(sums) > 64:
                yield from flush()
        yield from flush()

    usable = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    got = usable.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(got["lang"]))
    counts = np.zeros((BUCKETS + 1, len(names)))
    counts[got["bucket"].to_numpy(np.int64), got["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(np.int64)] = got["n"]
    if not names:
        return names, counts
    grams = counts[:BUCKETS] + SMOOTHING
    return names, np.vstack([np.log(grams / grams.sum(0)), np.log(counts[BUCKETS:] / counts[BUCKETS].sum())])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with lang_pred and score, the probability of lang_pred."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            sums = np.zeros((len(texts), len(names)))
            if names:
                for group, points, starts in _slices(texts, SLICE * 4 // max(4, len(names))):
                    for order in ORDERS:
                        ids = gram_ids(points, order)[: starts[-1]]
                        found = logs[ids]
                        found[_pads(starts)] = 0
                        sums[group] += np.add.reduceat(found, starts[:-1], axis=0)
                sums += logs[BUCKETS]
                best = sums.argmax(1)
                score = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            else:
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            known = np.array([bool(names) and _LETTER.search(t) is not None for t in texts], bool)
            pred = [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i + 1) for i in range(len(keep))], pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(text, *keep).mapInArrow(run, schema)
