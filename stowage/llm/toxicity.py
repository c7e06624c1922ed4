"""Toxicity: a bidirectional GRU with attention pooling over character and word inputs, in numpy.

A word's input joins a hashed word vector, the mean of the vectors of its hashed character n-grams and
the highest and lowest log-odds of those n-grams in the labelled texts. Each
window of WINDOW words, starting every STRIDE words, is read in both directions; attention pools the
states into one logit. A text's score is that of its highest window, so a short passage counts in any
text. All overlapping windows of every text are scored. A word of more than LONGEST characters is read as
overlapping pieces, each a word of its own, so text without blanks is read to its end.

The network is fitted on the driver on at most FIT_ROWS toxic and CLEAN times as many clean
labelled rows, of FIT_LENGTH code points at most each and FIT_TEXT together, picked by a hash of the key. Each round backpropagates
through a toxic text's highest window and a clean text's few highest, among those that promise most. A fifth of the rows is set aside
to choose the score that becomes 0.5. The word vectors' first number starts as the word's log-odds.

Defined results: null or empty text, and text without a word, scores the share of toxic labels, below
0.5 at most; without labels of both classes all score that; repeated rows score alike; a null key is
not held out; an empty table gives no rows; extra columns pass through on request.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_others, tidy

WINDOW, STRIDE = 32, 16
#: Characters of a word; longer runs (text without blanks) are read in pieces that overlap by half.
LONGEST = 32
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 6
INPUT = WORD_DIM + CHAR_DIM + 2
WORD_BUCKETS, CHAR_BITS, GRAMS = 1 << 15, 16, (3, 4, 5)
CHAR_BUCKETS = 1 << CHAR_BITS
#: Bounds of the fit.
FIT_ROWS, CLEAN, FIT_LENGTH, SEED = 1500, 3, 100_000, 11
#: Code points of all rows of the fit together; of rows beyond, in order of the hash, none takes part.
FIT_TEXT = 20_000_000
#: At least ROUNDS over the rows, and more, up to MOST_ROUNDS, until there were STEPS updates.
ROUNDS, MOST_ROUNDS, STEPS = 10, 60, 500
#: Windows of a text that take part in the fit, by each of two orders; all count when the threshold is set.
PROMISING = 3
#: A wrongly flagged clean text weighs this much against a missed toxic one in the choice of the threshold.
FALSE_ALARM = 3.0
#: Words whose input a worker keeps, and windows read at once.
KNOWN_WORDS, BLOCK = 150_000, 4096

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Words, those of more than LONGEST characters as overlapping pieces."""
    out = _WORD.findall(text.lower()) if text else []
    if out and max(map(len, out)) > LONGEST:
        return [w[i : i + LONGEST] for w in out for i in range(0, max(1, len(w) - LONGEST // 2), LONGEST // 2)]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def features(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets; n-gram buckets of all words; where each word's n-grams start."""
    word = np.fromiter((zlib.crc32(w.encode()) % WORD_BUCKETS for w in vocabulary), np.int64, len(vocabulary))
    marked = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary)) + 2
    ends = np.cumsum(sum((np.maximum(marked - k + 1, 0) for k in GRAMS), np.zeros(1, np.int64)))
    grams, starts = np.empty(ends[-1] if len(vocabulary) else 0, np.int32), np.concatenate([[0], ends[:-1]])[: len(vocabulary)]
    for at in range(0, len(vocabulary), BLOCK):  # what sorts the n-grams of all words would take many times the n-grams
        to = min(at + BLOCK, len(vocabulary))
        grams[starts[at] : ends[to - 1]] = _grams(vocabulary[at:to])
    return word, grams, starts


def _grams(vocabulary: list[str]) -> np.ndarray:
    """N-gram buckets of the words, word by word."""
    marked = [f"^{w}$" for w in vocabulary]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(marked), dtype=np.int32), [len(m) for m in marked])
    ids, of, h = [], [], points
    for k in range(2, max(GRAMS) + 1):
        if len(points) < k:
            break
        h = h[:-1] * np.uint32(0x01000193) + points[k - 1 :]
        if k in GRAMS:
            inside = owner[: len(h)] == owner[k - 1 :]
            ids.append((((h + np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS))[inside].astype(np.int32))
            of.append(owner[: len(h)][inside])
    return np.concatenate(ids)[np.argsort(np.concatenate(of), kind="stable")]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all spans, one after the other."""
    return np.repeat(starts - np.cumsum([0, *sizes[:-1]]), sizes) + np.arange(sizes.sum())


def summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index, as an array of n rows."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        out[at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Net:
    """Parameters and both passes. Row 0 of a table of inputs is padding."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        d, h = INPUT, HIDDEN
        s = lambda *shape, k: r.normal(0, k, shape).astype(np.float32)
        self.p = {"word": s(WORD_BUCKETS, WORD_DIM, k=0.05), "char": s(CHAR_BUCKETS, CHAR_DIM, k=0.1), "v": s(2 * h, k=0.3), "o": s(2 * h, k=0.3), "c": np.array([-1.0], np.float32)}
        for way in "fb":
            self.p |= {f"w{way}": s(d, 3 * h, k=d**-0.5), f"u{way}": s(h, 3 * h, k=h**-0.5), f"a{way}": np.zeros(3 * h, np.float32)}
        self.odds = np.zeros(CHAR_BUCKETS, np.float32)
        self.empty = 0.0

    def inputs(self, word: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(words, INPUT)."""
        if not len(word):
            return np.zeros((0, INPUT), np.float32)
        out = np.empty((len(word), INPUT), np.float32)
        ends = np.append(starts, len(grams))
        for at in range(0, len(word), BLOCK):  # the vectors of all n-grams at once would take many times the words'
            to = min(at + BLOCK, len(word))
            own, first = grams[ends[at] : ends[to]], starts[at:to] - ends[at]
            odds = self.odds[own]
            out[at:to, :WORD_DIM] = self.p["word"][word[at:to]]
            out[at:to, WORD_DIM:-2] = np.add.reduceat(self.p["char"][own], first, axis=0) / np.diff(ends[at : to + 1])[:, None]
            out[at:to, -2], out[at:to, -1] = np.maximum.reduceat(odds, first), np.minimum.reduceat(odds, first)
        return out

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for way in "fb":
            out[way] = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
            np.matmul(x, self.p[f"w{way}"], out=out[way][1:])
            out[way][1:] += self.p[f"a{way}"]
        return out

    def run(self, x: dict[str, np.ndarray], ids: np.ndarray, keep: bool = False):
        """Logits of windows of word rows (0 pads the end); with keep also what backward() needs."""
        b, t = ids.shape
        h = HIDDEN
        live = (ids > 0).astype(np.float32)
        states = np.zeros((t, b, 2 * h), np.float32)
        saved = []
        for way, order in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            u, state, lo = self.p[f"u{way}"], np.zeros((b, h), np.float32), 0 if way == "f" else h
            uzr, un = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
            for k in order:
                xk, m = x[way][ids[:, k]], live[:, k, None]
                zr = xk[:, : 2 * h] + state @ uzr
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r = zr[:, :h], zr[:, h:]
                hn = state @ un
                n = np.tanh(xk[:, 2 * h :] + r * hn)
                new = state + (m * (1 - z)) * (n - state)
                if keep:
                    saved.append((way, k, state, z, r, hn, n, m))
                state = new
                states[k, :, lo : lo + h] = state
        scores = (states @ self.p["v"]).T
        scores = np.where(live > 0, scores, -1e9)
        e = np.exp(scores - scores.max(1, keepdims=True)) * live
        alpha = e / np.maximum(e.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("bt,tbh->bh", alpha, states)
        logit = pooled @ self.p["o"] + self.p["c"][0]
        return (logit, (states, alpha, pooled, saved)) if keep else logit

    def backward(self, g: np.ndarray, x: dict[str, np.ndarray], ids: np.ndarray, kept) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Gradients of parameters and of the projected inputs, from those of the logits."""
        states, alpha, pooled, saved = kept
        h, (b, t) = HIDDEN, ids.shape
        d = {"o": pooled.T @ g, "c": np.array([g.sum()], np.float32)}
        gp = g[:, None] * self.p["o"][None, :]
        ga = np.einsum("bh,tbh->bt", gp, states)
        gs = alpha * (ga - (alpha * ga).sum(1, keepdims=True))
        d["v"] = np.einsum("bt,tbh->h", gs, states)
        gstates = alpha.T[:, :, None] * gp[None] + gs.T[:, :, None] * self.p["v"]
        gx: dict[str, list] = {"f": [], "b": []}
        for way in "fb":
            d[f"u{way}"] = np.zeros_like(self.p[f"u{way}"])
        carry, last = None, None
        for way, k, state, z, r, hn, n, m in reversed(saved):
            if way != last:
                carry, last = np.zeros((b, h), np.float32), way
            lo = 0 if way == "f" else h
            u = self.p[f"u{way}"]
            gh = carry + gstates[k, :, lo : lo + h]
            gn = gh * m * (1 - z) * (1 - n * n)
            gz = gh * m * (state - n) * z * (1 - z)
            gr = gn * hn * r * (1 - r)
            ghn = gn * r
            gzr = np.hstack([gz, gr])
            d[f"u{way}"][:, : 2 * h] += state.T @ gzr
            d[f"u{way}"][:, 2 * h :] += state.T @ ghn
            carry = gh * (1 - m * (1 - z)) + gzr @ u[:, : 2 * h].T + ghn @ u[:, 2 * h :].T
            gx[way].append((k, np.hstack([gzr, gn])))
        out = {way: summed(np.concatenate([ids[:, k] for k, _ in own]), np.vstack([r for _, r in own]), len(x[way])) for way, own in gx.items()}
        for way in "fb":
            out[way][0] = 0
        return d, out


def windows(ids: np.ndarray) -> np.ndarray:
    """All overlapping windows of one text's word rows, the last padded by 0."""
    n = len(ids)
    count = 1 + max(0, -(-(n - WINDOW) // STRIDE))
    padded = np.zeros((count - 1) * STRIDE + WINDOW, np.int32)
    padded[:n] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def _indexed(texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
    """The word rows of each text, from 1, and the words."""
    rows: dict[str, int] = {}
    return [np.array([rows.setdefault(w, len(rows) + 1) for w in words(t)], np.int32) for t in texts], list(rows)


def _numbered(flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of n words that stand in windows of word rows, from 0, and the windows as rows of these words alone."""
    there = np.zeros(n + 1, bool)
    there[0] = there[flat] = True
    return np.flatnonzero(there)[1:] - 1, (np.cumsum(there, dtype=np.int32) - 1)[flat]


def fit(texts: list[str], toxic: list[int], seed: int = SEED) -> Net:
    """Fits a net to labelled texts; the order of rows matters, so pass them in a fixed one."""
    net = _fit(texts, toxic, seed)
    tidy()
    return net


def _fit(texts: list[str], toxic: list[int], seed: int) -> Net:
    net = Net(seed)
    y = np.array(toxic, np.float32)
    net.empty = float(min(y.mean(), 0.49)) if len(y) else 0.0
    if not (0 < y.sum() < len(y)):
        net.constant = net.empty
        return net
    texts_ids, vocabulary = _indexed(texts)
    word, grams, starts = features(vocabulary)
    ends = np.append(starts, len(grams))
    del vocabulary
    tidy()

    def inputs_of(own: np.ndarray) -> np.ndarray:
        """Inputs of words; n-grams are looked up for a block of words at a time."""
        out = np.empty((len(own), INPUT), np.float32)
        for at in range(0, len(own), BLOCK):
            some = own[at : at + BLOCK]
            sizes = ends[some + 1] - ends[some]
            out[at : at + BLOCK] = net.inputs(word[some], grams[spans(ends[some], sizes)], np.cumsum([0, *sizes[:-1]]))
        return out

    def odds(of, buckets: int, support: float) -> np.ndarray:
        """Log-odds of buckets by the texts that hold them, less where few do."""
        seen = np.zeros((2, buckets), np.float32)
        for ids, label, fits in zip(texts_ids, toxic, learns):
            if fits:
                seen[label][np.unique(of(np.unique(ids) - 1))] += 1
        total = np.array([[(learns & (y == 0)).sum()], [(learns & (y == 1)).sum()]], np.float32)
        rate = (seen + 0.5) / (total + 1)
        return np.clip(np.log(rate[1] / rate[0]) * np.minimum(1, seen.sum(0) / support), -4, 4) / 2

    learns = np.arange(len(y)) % 5 != 0
    if not (0 < y[learns].sum() < learns.sum()):
        learns[:] = True
    net.p["word"][:, 0] = odds(lambda w: word[w], WORD_BUCKETS, 8)
    net.odds = odds(lambda w: grams[spans(ends[w], ends[w + 1] - ends[w])] if len(w) else grams[:0], CHAR_BUCKETS, 12)
    # a text's windows that promise most by the log-odds of their words, whose logits choose among them
    hint = np.zeros(len(word) + 1, np.float32)
    hint[1:] = net.p["word"][word, 0] + (np.maximum.reduceat(net.odds[grams], starts) if len(word) else 0)
    every = [windows(ids) for ids in texts_ids]
    del texts_ids
    wins = []
    for w in every:
        h = hint[w]
        picks = {*np.argsort(-h.max(1), kind="stable")[:PROMISING].tolist(), *np.argsort(-h.sum(1), kind="stable")[:PROMISING].tolist()}
        wins.append(w[sorted(picks)])
    flat, owner = np.vstack(wins), np.repeat(np.arange(len(wins)), [len(w) for w in wins])
    first = np.cumsum([0, *[len(w) for w in wins]])
    del wins, hint
    # the threshold is set on rows set aside where they have both classes
    judged = np.flatnonzero(~learns if min((y[~learns] == 1).sum(), (y[~learns] == 0).sum()) >= 5 else np.ones(len(y), bool))
    every = [every[i] for i in judged]
    seen, near = _numbered(flat, len(word))
    moment: dict[str, list[np.ndarray]] = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    rng, step = np.random.default_rng(seed), 0
    share = len(y) / (2 * np.array([len(y) - y.sum(), y.sum()]))
    for round_ in range(MOST_ROUNDS):
        if round_ >= ROUNDS and step >= STEPS:
            break
        x = net.projected(inputs_of(seen))
        logits = np.concatenate([net.run(x, near[i : i + BLOCK]) for i in range(0, len(near), BLOCK)])
        picked = []
        for k in np.flatnonzero(learns).tolist():
            own = logits[first[k] : first[k + 1]]
            most = 1 if y[k] else 3
            picked += (first[k] + np.argsort(-own, kind="stable")[:most]).tolist()
        picked = rng.permutation(np.array(picked))
        for i in range(0, len(picked), 256):
            at = picked[i : i + 256]
            used, ids = np.unique(flat[at], return_inverse=True)
            ids = ids.reshape(len(at), WINDOW)
            if used[0] != 0:
                used, ids = np.concatenate([[0], used]), ids + 1
            own = used[1:] - 1
            sizes = ends[own + 1] - ends[own]
            sub = word[own], grams[spans(ends[own], sizes)], np.cumsum([0, *sizes[:-1]])
            inp = net.inputs(*sub)
            x = net.projected(inp)
            logit, kept = net.run(x, ids, keep=True)
            label = y[owner[at]]
            g = ((_sigmoid(logit) - label) * share[label.astype(int)] / len(at)).astype(np.float32)
            d, gx = net.backward(g, x, ids, kept)
            gin = np.zeros_like(inp)
            for way in "fb":
                d[f"w{way}"], d[f"a{way}"] = inp.T @ gx[way][1:], gx[way][1:].sum(0)
                gin += gx[way][1:] @ net.p[f"w{way}"].T
            d["word"] = summed(sub[0], gin[:, :WORD_DIM], WORD_BUCKETS)
            d["char"] = summed(sub[1], np.repeat(gin[:, WORD_DIM:-2] / sizes[:, None], sizes, axis=0), CHAR_BUCKETS)
            step += 1
            for k, gk in d.items():
                m, v = moment[k]
                m += 0.1 * (gk - m)
                v += 0.01 * (gk * gk - v)
                rate_k = 0.01 if k not in {"word", "char"} else 0.004
                net.p[k] -= (rate_k * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    # the logit that parts the classes best becomes 0
    first = np.cumsum([0, *[len(w) for w in every]])
    seen, near = _numbered(np.vstack(every), len(word))
    x = net.projected(inputs_of(seen))
    logits = np.concatenate([net.run(x, near[i : i + BLOCK]) for i in range(0, len(near), BLOCK)])
    top, y = np.maximum.reduceat(logits, first[:-1]), y[judged]
    order = np.sort(top)
    edges = np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2])
    clean, bad = np.sort(top[y == 0]), np.sort(top[y == 1])
    cost = FALSE_ALARM * (1 - np.searchsorted(clean, edges) / len(clean)) + np.searchsorted(bad, edges) / len(bad)
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    net.p["c"] = net.p["c"] - np.float32(edges[best[len(best) // 2]])
    return net


class Scorer:
    """Scores texts with a net; keeps the inputs of words it has seen, within KNOWN_WORDS."""

    def __init__(self, net: Net):
        self.net = net
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.x = {way: np.zeros((1, 3 * HIDDEN), np.float32) for way in "fb"}
        self.n = 1

    def _learn(self, new: list[str]) -> None:
        made = self.net.projected(self.net.inputs(*features(new)))
        for way in "fb":
            if self.n + len(new) > len(self.x[way]):
                grown = np.zeros((2 * (self.n + len(new)), 3 * HIDDEN), np.float32)
                grown[: self.n] = self.x[way][: self.n]
                self.x[way] = grown
            self.x[way][self.n : self.n + len(new)] = made[way][1:]
        for i, w in enumerate(new):
            self.rows[w] = self.n + i
        self.n += len(new)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.net.empty)
        if hasattr(self.net, "constant"):
            return out
        pending, owner, size = [], [], 0
        for i, text in enumerate(texts):
            tokens = words(text)
            if not tokens:
                continue
            new = [w for w in dict.fromkeys(tokens) if w not in self.rows]
            if new:
                if self.n + len(new) > KNOWN_WORDS and self.rows:
                    if pending:
                        self._flush(out, pending, owner)
                        pending, owner, size = [], [], 0
                    self._reset()
                    new = list(dict.fromkeys(tokens))
                self._learn(new)
            wins = windows(np.fromiter(map(self.rows.__getitem__, tokens), np.int32, len(tokens)))
            pending.append(wins)
            owner += [i] * len(wins)
            size += len(wins)
            if size >= BLOCK:
                self._flush(out, pending, owner)
                pending, owner, size = [], [], 0
        if pending:
            self._flush(out, pending, owner)
        return out

    def _flush(self, out: np.ndarray, pending: list[np.ndarray], owner: list[int]) -> None:
        flat, owner = np.vstack(pending), np.array(owner)
        prob = np.concatenate([_sigmoid(self.net.run(self.x, flat[i : i + BLOCK])) for i in range(0, len(flat), BLOCK)])
        start = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[start]] = np.maximum.reduceat(prob, start)


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", each: int = FIT_ROWS) -> tuple[list[str], list[int]]:
    """Texts and labels to fit on: at most `each` toxic and CLEAN * each clean rows among keys not held out, by a hash of the key."""
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (F.crc32(F.col(key).cast("string")) % 5 != 0)).groupBy(key).agg(F.max(label).cast("int").alias("__y"))
    order = [F.xxhash64(key), F.col(key)]
    chosen = marked.where("__y = 1").orderBy(*order).limit(each).unionByName(marked.where("__y = 0").orderBy(*order).limit(CLEAN * each))
    rows = docs.where(F.length(text).between(1, FIT_LENGTH)).select(key, text).join(F.broadcast(chosen), key).groupBy(key, "__y").agg(F.min(text).alias(text))
    # at most (1 + CLEAN) * each rows are numbered; the order is that of their choice, the classes in turn
    rank = F.row_number().over(Window.partitionBy("__y").orderBy(*order)) / F.when(F.col("__y") == 1, 1).otherwise(CLEAN)
    upto = F.sum(F.length(text).cast("long")).over(Window.orderBy("__r", "__y", key))
    got = sorted(rows.withColumn("__r", rank).withColumn("__n", upto).where(F.col("__n") <= FIT_TEXT).select(key, text, "__y").collect(), key=lambda r: (r[0] != r[0], *r[:2]))
    return [r[1] for r in got], [r[2] for r in got]


def score(docs: DataFrame, net: Net, keep: list[str] | None = None, text: str = "text", out: str = "score") -> DataFrame:
    """The kept columns (all by default) with the score (0 to 1)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != out]
    columns = [*keep, *([text] if text not in keep else [])]
    place, n = columns.index(text), len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("toxicity")
        scorer = Scorer(shared.value)
        for batch in batches:
            got = scorer.score(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], pa.array(got, pa.float64())], names=[*keep, out])
        del scorer
        tidy()

    return docs.select(*columns).mapInArrow(run, schema)
