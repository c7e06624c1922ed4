"""The pipeline against a plain version of each stage, on a small corpus."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pyarrow as pa
from stowage.llm import bpe, linededup, setsketch, toxicity
from stowage.llm.common import ARROW_BYTES, small_batches
from stowage.llm.queries import tokenizer_path

from .conftest import text
from .test_models import brute_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(12)
    out = []
    for i in range(120):
        t = "\n".join([f"notice of {i % 3}"] + [text(r, 12) for _ in range(r.randint(1, 6))])
        if i % 6 == 0:
            t += " vexoru grumble"
        out.append((i, t, "en", f"s{i % 3}", len(t)))
    out += [(200 + i, out[i][1] + " end", "en", out[i][3], 0) for i in range(20, 40)]
    out += [(300, None, None, None, None), (301, "", "en", "s0", 0), (302, out[7][1].upper(), "en", "s1", 0), out[9]]
    return out


def test_stages_match_plain_versions(spark, tmp_path):
    data = corpus()
    docs = spark.createDataFrame(data, COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d[0], int("vexoru" in (d[1] or "")), 1) for d in data if d[0] < 300], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    net = toxicity.fit(*toxicity.sample(docs, labels))
    plain = [d for d in data if toxicity.Scorer(net).score([d[1]])[0] < 0.5]
    bad = {d[0] for d in data if "vexoru" in (d[1] or "")}
    assert sum(d[0] in bad for d in plain) < len(bad) / 4 and len(plain) > 0.9 * (len(data) - len(bad))

    got = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(plain)

    seen, pages = defaultdict(Counter), Counter(d[3] for d in plain)
    for d in plain:
        seen[d[3]].update({x.strip(" \t\n\v\f\r") for x in (d[1] or "").split("\n")} - {""})
    gone = lambda s, x: pages[s] >= linededup.MIN_PAGES and seen[s][x.strip(" \t\n\v\f\r")] > linededup.RATIO * pages[s]
    kept = [(i, t if t is None else "\n".join(x for x in t.split("\n") if not gone(s, x)), lang, s) for i, t, lang, s, _ in plain]
    plain = [(*d, None if d[1] is None else len(d[1])) for d in kept]
    assert not any("notice" in (d[1] or "") for d in plain)
    got = corpus_pipeline.drop_boilerplate(spark, got, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(plain)

    stay = {i for (i, _, _, k), _ in brute_components([d[:2] for d in plain]).items() if k}
    plain = sorted({d for d in plain if d[0] in stay}, key=repr)
    got = corpus_pipeline.drop_near_copies(spark, got, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(plain)

    sizes = defaultdict(int)
    for d in plain:
        sizes[d[3]] += len(WORDS.findall(d[1] or ""))
    from .test_native import brute_targets

    target, due, at = brute_targets(sizes), Counter(), defaultdict(int)
    for d in sorted(plain, key=lambda d: hashlib.md5(str(d[0]).encode()).hexdigest()):
        n = len(WORDS.findall(d[1] or ""))
        if n:
            due[d] += (at[d[3]] < int(target[d[3]] + 1e-9)) + (at[d[3]] + sizes[d[3]] < int(target[d[3]] + 1e-9))
        at[d[3]] += n
    got = corpus_pipeline.mix_sources(spark, got, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == +due

    codec, want = bpe.Codec(tokenizer_path()), Counter()
    for d, n in due.items():
        ids, said = codec.whole(d[1] or "")
        want[(d[0], len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said.encode()).hexdigest())] += n
    assert Counter((r[0], r[1], bytes(r[2]), r[3], r[4]) for r in corpus_pipeline.encode(spark, got, str(tmp_path)).collect()) == +want

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["ids_sha256"] for r in whole) == Counter({k[3]: 0 for k in want}) + Counter(k for x, n in want.items() for k in [x[3]] * n)


def test_nothing_goes_through(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_are_those_of_five_words(spark, tmp_path):
    base = [f"w{i}" for i in range(100)]
    few, many = list(base), list(base)
    few[50] = "other"
    for i in range(5, 100, 20):
        many[i] = f"other{i}"  # of pairs of words 89 in 109 are shared, of five words 71 in 121
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in enumerate((base, few, many))], COLUMNS)
    got = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 2]


def test_repeated_and_null_ids_lose_no_unlike_text(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    data = [(1, a), (2, a), (2, b), (3, b), (None, c), (None, c), (None, a), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], COLUMNS)
    got = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(1, a), (2, b), (None, c), (4, None), (4, "")])


class Frame:
    """Takes the place of a frame and keeps the function that workers would run."""

    def __init__(self, df):
        self.columns, self.schema = df.columns, df.schema

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_stores_of_bpe_go_when_another_operator_takes_the_worker(spark):
    docs = Frame(spark.createDataFrame([], COLUMNS))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one two three"]})
    encode = lambda: list(bpe.encode(docs, tokenizer_path(), keep=["doc_id"]).run(iter([batch])))
    want, codec = encode(), bpe.Codec.at(tokenizer_path())
    assert encode() == want and bpe.Codec._made == {tokenizer_path(): codec}  # kept from task to task
    list(setsketch._described(docs, "doc_id", "text", 5).run(iter([batch])))
    assert not bpe.Codec._made
    assert encode() == want


def test_texts_go_to_workers_in_small_batches(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 6000, 1, 1).selectExpr("id doc_id", "repeat(concat(id, ' word '), 300) text", "'en' lang", "'s' source", "0L n_chars")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    probe = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_copies, corpus_pipeline.encode):
        spark.conf.set(name, "64m")
        stage(spark, docs.limit(3), str(tmp_path))
        sizes = [r["n"] for r in docs.mapInArrow(probe, "n long").collect()]
        assert sum(sizes) > 3 * ARROW_BYTES and max(sizes) < 1.1 * ARROW_BYTES, stage
    for size, now in (("1m", "1m"), ("3000000", "3000000"), ("1g", str(ARROW_BYTES))):
        spark.conf.set(name, size)
        small_batches(spark)
        assert spark.conf.get(name) == now
    spark.conf.unset(name)
    small_batches(spark)
    assert spark.conf.get(name) == str(ARROW_BYTES)
    spark.conf.unset(name)
