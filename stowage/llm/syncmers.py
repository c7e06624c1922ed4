"""Document fingerprints from closed syncmers (DataFrame operations only).

A k-mer of code points is an anchor if the least of its inner s-mers, by hash, is its first or its
last. That depends on the k-mer alone, so anchors of a passage are the same wherever it stands, and
anchors of a spliced text are those of its pieces plus the few k-mers across the seam. Any
k - s + 1 neighbouring k-mers hold an anchor.

s-mer hashes are made once per code point; the sliding minimum doubles its width four times. A k-mer's
own hash joins the s-mers at offsets 0, 5, 10 and 15, which cover it.

Texts of fewer than SHORT code points use all their s-mers instead, those under S one hash of the text.

Defined results: null text is empty, with an empty fingerprint; likeness is Dice's over distinct
anchors, 1 for two empty fingerprints; rows are ordered by descending key (nulls last), then by text
(null as empty), and the next of the last row is the first; repeated rows are rows of their own; a
single row is its own next; an empty table gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Inner length, inner s-mers in a k-mer, k-mer length, and the length under which all s-mers count.
S, INNER = 5, 16
K = S + INNER - 1
SHORT = 2 * K
#: Bits of the keys that share a bucket, and bits of key range taken off at each level of `lower`.
BUCKET_BITS, LEVEL_BITS = 8, 12
#: First rows of buckets go to all executors only up to so many (16 bytes each), else they are shuffled.
BROADCAST_ROWS = 500_000

_MASK = 0xFFFFFFFF


def _s_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{S}}}))."), F.lit(1)), lambda x: F.xxhash64(x))


def with_anchors(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with the anchors of a non-null text, array<struct<p, h>> in order of position; short texts have dense ones."""
    h, m = f"{out}_h", f"{out}_m"
    rows = rows.withColumn(h, _s_hashes(F.col(text))).withColumn(m, F.col(h))
    width = 1
    while width < INNER:
        rows = rows.withColumn(m, F.zip_with(F.col(m), F.slice(F.col(m), width + 1, F.greatest(F.size(m), F.lit(1))), lambda a, b: F.least(a, b)))
        width *= 2
    at = F.filter(F.sequence(F.lit(0), F.size(h) - INNER), lambda i: (F.get(m, i) == F.get(h, i)) | (F.get(m, i) == F.get(h, i + (INNER - 1))))
    kmers = F.transform(at, lambda i: F.struct(i.alias("p"), F.xxhash64(*[F.get(h, i + j) for j in range(0, INNER, S)]).bitwiseAND(F.lit(_MASK)).alias("h")))
    dense = F.transform(F.col(h), lambda x, i: F.struct(i.alias("p"), x.bitwiseAND(F.lit(_MASK)).alias("h")))
    whole = F.array(F.struct(F.lit(0).alias("p"), F.xxhash64(F.lit(1), F.col(text)).bitwiseAND(F.lit(_MASK)).alias("h")))
    none = F.expr("cast(array() as array<struct<p:int,h:bigint>>)")
    n = F.size(h)  # code points - S + 1 where there are S
    found = F.when(n >= SHORT - S + 1, kmers).when(n > 0, dense).when(F.length(text) > 0, whole).otherwise(none)
    return rows.withColumn(out, found).drop(h, m)


def lower(keys: DataFrame, lo: int, hi: int) -> DataFrame:
    """(b, nb): for each of the distinct keys b between lo and hi the next lower one, null for the least.

    Keys are grouped by their high bits until one group is left, so no task holds more than a group.
    """
    if hi - lo < 1 << LEVEL_BITS:
        return keys.select("b", F.lead("b").over(Window.orderBy(F.desc("b"))).alias("nb"))
    group = F.shiftright(F.col("b") - F.lit(lo), LEVEL_BITS)
    own = keys.withColumn("g", group).withColumn("nb", F.lead("b").over(Window.partitionBy("g").orderBy(F.desc("b"))))
    tops = own.groupBy("g").agg(F.max("b").alias("top"))
    down = lower(tops.select(F.col("g").alias("b")), 0, (hi - lo) >> LEVEL_BITS).select(F.col("b").alias("g"), F.col("nb").alias("ng"))
    after = down.join(tops.select(F.col("g").alias("ng"), F.col("top").alias("after")), "ng", "left").select("g", "after")
    return own.join(after, "g", "left").select("b", F.coalesce("nb", "after").alias("nb"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of (key, __n, __text) with __guest: each bucket of neighbouring keys holds its rows and, as guests in last place, the first of the next lower bucket.

    Buckets are hash partitions of the result, so a window over (__bucket) needs no further shuffle.
    """
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    lo, hi = rows.agg(F.min(key), F.max(key)).first()
    lo, hi = ((x or 0) >> BUCKET_BITS for x in (lo, hi))
    lo -= 1  # nulls come last, in a bucket of their own
    keyed = rows.withColumn("__low", F.col(key)).withColumn("__b", F.coalesce(F.shiftright(F.col(key).cast("long"), BUCKET_BITS), F.lit(lo)))
    heads = keyed.groupBy(F.col("__b").alias("b")).agg(F.max("__low").alias("top"))
    every = lower(heads.select("b"), lo, hi)
    first = heads.agg(F.max("b")).first()[0]  # a bucket of nulls alone has no key above it
    guests = every.select(F.col("b").alias("__bucket"), F.coalesce("nb", F.lit(first)).alias("b")).join(heads, "b")
    few = hi - lo < BROADCAST_ROWS or heads.count() <= BROADCAST_ROWS
    hosted = keyed.join(F.broadcast(guests) if few else guests, (F.col("__b") == F.col("b")) & F.col("__low").eqNullSafe(F.col("top"))).select(key, "__text", "__low", "__bucket", F.lit(1).alias("__guest"))
    return keyed.select(key, "__text", "__low", F.col("__b").alias("__bucket"), F.lit(0).alias("__guest")).unionByName(hosted).repartition("__bucket")


def _hashes(anchors: Column) -> Column:
    return F.array_distinct(F.transform(anchors, lambda a: a["h"]))


def written(hashes: Column) -> Column:
    """Distinct anchor hashes in order of first place, 8 hex digits each."""
    return F.lower(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Dice's likeness of two arrays of distinct hashes."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), n_anchors."""
    rows = with_anchors(with_next(docs, key, text), "__text", "__a")
    order = Window.partitionBy("__bucket").orderBy("__guest", F.desc("__low"), "__text")
    rows = rows.withColumns({"__next": F.lead("__text").over(order), "__na": F.lead("__a").over(order)}).where(F.col("__guest") == 0)
    rows = rows.withColumn("n_chars", F.length("__text").cast("long"))
    tail = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumns({"__tail": tail, "__p": (F.col("n_chars") - tail).cast("int")})
    rows = rows.withColumn("__head", F.substring("__next", F.lit(1), F.col("__tail")))
    rows = rows.withColumn("__edited", F.concat(F.substring("__text", F.lit(1), F.col("__p")), F.col("__head")))
    rows = rows.withColumns({"__ne": F.length("__edited"), "__q": F.length("__head"), "__from": F.greatest(F.col("__p") - (K - 1), F.lit(0))})
    short = F.col("__ne") < SHORT
    # the seam: k-mers across it, or the whole of a short text
    rows = rows.withColumn("__seam", F.when(short, F.col("__edited")).otherwise(F.substring("__edited", F.col("__from") + 1, F.col("__p") - F.col("__from") + (K - 1))))
    rows = _seam_anchors(rows)
    shift = lambda by: lambda a: F.struct((a["p"] + by).alias("p"), a["h"].alias("h"))
    kept = F.filter("__a", lambda a: a["p"] + K <= F.col("__p"))
    head = F.filter("__na", lambda a: a["p"] + K <= F.col("__q"))
    # neighbours that are short themselves have dense anchors, which a long spliced text cannot use
    pieces = F.concat(F.when(F.col("n_chars") >= SHORT, kept).otherwise(F.col("__none")), F.transform("__sa", shift(F.col("__from"))), F.when(F.length("__next") >= SHORT, F.transform(head, shift(F.col("__p")))).otherwise(F.transform("__ha", shift(F.col("__p")))))
    rows = rows.withColumn("__ea", F.when(short, F.col("__da")).otherwise(pieces))
    rows = rows.withColumns({"__f": _hashes(F.col("__a")), "__fe": _hashes(F.col("__ea")), "__fn": _hashes(F.col("__na"))})
    return rows.select(key, "n_chars", F.sha2(F.encode("__edited", "UTF-8"), 256).alias("edited_sha256"), written(F.col("__f")).alias("fingerprint"), written(F.col("__fe")).alias("edited_fingerprint"), likeness(F.col("__f"), F.col("__fe")).alias("near_edited"), likeness(F.col("__f"), F.col("__fn")).alias("near_next"), F.size("__a").cast("long").alias("n_anchors"))


def _closed(h: str) -> Column:
    """Anchors among the s-mer hashes of a short string, by direct comparison."""
    def anchor(i: Column) -> Column:
        least = F.array_min(F.slice(F.col(h), i + 1, INNER))
        return (least == F.get(F.col(h), i)) | (least == F.get(F.col(h), i + (INNER - 1)))

    places = F.when(F.size(h) >= INNER, F.filter(F.sequence(F.lit(0), F.size(h) - INNER), anchor)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(places, lambda i: F.struct(i.alias("p"), F.xxhash64(*[F.get(F.col(h), i + j) for j in range(0, INNER, S)]).bitwiseAND(F.lit(_MASK)).alias("h")))


def _seam_anchors(rows: DataFrame) -> DataFrame:
    """Adds __sa (anchors of the seam), __ha (those of a short next text's head), __da (dense ones of a short spliced text), __none."""
    none = F.expr("cast(array() as array<struct<p:int,h:bigint>>)")
    rows = rows.withColumns({"__none": none, "__sh": _s_hashes(F.col("__seam")), "__hh": F.when(F.length("__next") < SHORT, _s_hashes(F.col("__head"))).otherwise(F.expr("cast(array() as array<bigint>)"))})
    dense = F.transform(F.col("__sh"), lambda x, i: F.struct(i.alias("p"), x.bitwiseAND(F.lit(_MASK)).alias("h")))
    whole = F.array(F.struct(F.lit(0).alias("p"), F.xxhash64(F.lit(1), F.col("__seam")).bitwiseAND(F.lit(_MASK)).alias("h")))
    return rows.withColumns({"__sa": _closed("__sh"), "__ha": _closed("__hh"), "__da": F.when(F.size("__sh") > 0, dense).when(F.length("__seam") > 0, whole).otherwise(none)})
