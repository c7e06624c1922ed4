"""Secret scans with multipart credential linking (DataFrame operations only).

Strong kinds stand alone: `assign`, `access` and `hex` matches of enough length. Weak parts, which are
access identifiers, secret-like values and endpoints, are reported only if complementary parts
co-occur: parts are intervals in the text, and a weak secret is joined to every identifier and every
endpoint within `reach` code points to either side. The secret and those partners are reported as
weak_secret, weak_id, weak_endpoint. Identifiers and secrets inside an endpoint are parts too, at no
distance from it; a long run there holds slashes only right after one of = & ? #, so that a path is no
secret.

Offsets are code points. A part has a complement in reach if the one that ends last of those before, or
that starts first of those after, is in reach, so the interval join is a sweep over each text's parts in
both orders and makes no pairs. Only parts are shuffled, never texts.

Defined results: null text is empty; texts without findings give zeros, the digest of an empty string
and an empty string; repeated rows each get the same findings; an empty table gives no rows; extra
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The strong patterns and the least lengths of what they find.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

#: Weak parts, one pattern so that parts never overlap; a part's kind follows from how it begins.
ENDPOINT = r"""(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+"""
IDENTIFIER = r"""(?:client_id|access_key_id|account_id|user_?name|user_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}|AKIA[A-Z0-9]+"""
SECRET = r"""(?:password|passwd|secret|token|api_?key|pwd)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}|[A-Za-z0-9+/]{32,}={0,2}"""
WEAK = f"{ENDPOINT}|{IDENTIFIER}|{SECRET}"
#: Identifiers, and parts inside an endpoint.
NAMED_ID = f"(?i:{IDENTIFIER.rpartition('|')[0]})|AKIA[A-Z0-9]+"
INNER = rf"{NAMED_ID}|(?i:{SECRET.rpartition('|')[0]})|(?<=[=&?#])[A-Za-z0-9+/]{{32,}}={{0,2}}|[A-Za-z0-9+]{{32,}}={{0,2}}"
REACH = 200
#: Hits whose places are added up at once.
BLOCK = 256

_KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint")


def _located(gaps: Column, hits: Column) -> Column:
    """Spans of the hits between the gaps, as array<struct<s, e>>.

    Hits are taken in blocks, since an array that grows by one is copied each time.
    """
    lengths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int")), lambda i: F.slice(lengths, i * BLOCK + 1, F.lit(BLOCK)))

    def grown(kind: str, at: Column) -> Column:
        return F.struct(at.alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + x["h"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e")))).alias("out"))

    def whole(acc: Column, block: Column) -> Column:
        return F.struct((acc["at"] + F.aggregate(block, F.lit(0), lambda n, x: n + x["g"] + x["h"])).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    starts = F.aggregate(blocks, grown("int", F.lit(0)), whole, lambda a: a["out"])
    spans = F.flatten(F.zip_with(blocks, starts, lambda block, at: F.aggregate(block, grown("struct<s:int,e:int>", at), step, lambda a: a["out"])))
    return F.when(F.size(hits) > 0, spans).otherwise(F.expr("cast(array() as array<struct<s:int,e:int>>)"))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda p: F.struct(p["s"].alias("s"), F.lit(kind).alias("k"), p["e"].alias("e")))


def _strong(rows: DataFrame) -> DataFrame:
    """rows with __base: sorted strong spans as structs (s, k, e)."""
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        rows = rows.withColumn(f"__{name}_hits", F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)))
        rows = rows.withColumn(f"__{name}_gaps", F.when(F.size(f"__{name}_hits") > 0, F.split("__text", pattern, -1)))
    rows = rows.withColumn("__values", F.when(F.size("__assign_hits") > 0, F.regexp_extract_all("__text", F.lit(ASSIGN), F.lit(2))))
    spans = []
    for k, name in enumerate(("assign", "access", "hex")):
        rows = rows.withColumn(f"__{name}", _located(F.col(f"__{name}_gaps"), F.col(f"__{name}_hits")))
        kept = F.col(f"__{name}")
        if name == "assign":
            both = F.zip_with(kept, F.coalesce("__values", F.expr("cast(array() as array<string>)")), lambda p, v: F.struct(p["s"].alias("s"), p["e"].alias("e"), F.length(v).alias("n")))
            kept = F.filter(both, lambda p: p["n"] >= ASSIGN_LEAST)
        spans.append(_of_kind(kept, k))
    return rows.withColumn("__base", F.array_sort(F.concat(*spans)))


def _weak_kind(hit: Column) -> Column:
    begins = lambda p: hit.rlike(p)
    return F.when(begins(f"^(?i:{ENDPOINT})$"), 5).when(begins(f"^(?:(?i:{IDENTIFIER.rpartition('|')[0]})|AKIA[A-Z0-9]+)$"), 3).otherwise(4)


def _inside(at: Column, hit: Column) -> Column:
    """Parts inside a hit, as array<struct<s, e, k>> of the text."""
    spans = F.zip_with(_located(F.split(hit["h"], INNER, -1), hit["x"]), hit["x"], lambda p, x: F.struct((at["s"] + p["s"]).alias("s"), (at["s"] + p["e"]).alias("e"), F.when(x.rlike(f"^(?:{NAMED_ID})$"), 3).otherwise(4).alias("k")))
    return F.when(F.size(hit["x"]) > 0, spans).otherwise(F.expr("cast(array() as array<struct<s:int,e:int,k:int>>)"))


def linked(parts: DataFrame, by: list[str], reach: int = REACH) -> DataFrame:
    """Interval join. parts: (*by, s, e, k) with k 3 identifier, 4 secret, 5 endpoint -> the spans to report, once each."""
    order = [F.col(c) for c in ("s", "e", "k")]
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    secret = F.col("k") == 4
    seen = parts
    for name, kind in (("secret", secret), ("partner", ~secret)):
        seen = seen.withColumn(f"__{name}_end", F.max(F.when(kind, F.col("e"))).over(before)).withColumn(f"__{name}_start", F.min(F.when(kind, F.col("s"))).over(after))
    near = lambda name: F.coalesce(F.col("s") - F.col(f"__{name}_end") <= reach, F.lit(False)) | F.coalesce(F.col(f"__{name}_start") - F.col("e") <= reach, F.lit(False))
    return seen.where(F.when(secret, near("partner")).otherwise(near("secret"))).select(*by, F.struct("s", "k", "e").alias("span")).distinct()


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """(key, base, weak): sorted strong and linked weak spans of each row, array<struct<s, k, e>> with k an index in the kinds."""
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = rows.withColumn("__id", F.struct(F.col("__key").isNull().alias("n"), F.coalesce(F.col("__key"), F.lit(0).cast(docs.schema[key].dataType)).alias("k"), F.xxhash64("__text").alias("a"), F.length("__text").alias("b")))
    rows = rows.withColumn("__weak_hits", F.regexp_extract_all("__text", F.lit(f"(?i){ENDPOINT}|(?i:{IDENTIFIER.rpartition('|')[0]})|(?-i:AKIA[A-Z0-9]+)|{SECRET}"), F.lit(0)))
    rows = rows.withColumn("__kinds", F.transform("__weak_hits", _weak_kind))
    none = F.expr("cast(array() as array<string>)")
    inner = F.zip_with("__weak_hits", "__kinds", lambda h, k: F.when(k == 5, F.regexp_extract_all(h, F.lit(INNER), F.lit(0))).otherwise(none))
    rows = rows.withColumn("__inner", F.when(F.array_contains("__kinds", 5), inner))
    hidden = F.coalesce(F.exists(F.flatten("__inner"), lambda x: ~x.rlike(f"^(?:{NAMED_ID})$")), F.lit(False))
    worth = (F.array_contains("__kinds", 4) | hidden) & F.arrays_overlap("__kinds", F.array(F.lit(3), F.lit(5)))
    rows = rows.withColumn("__weak_gaps", F.when(worth, F.split("__text", f"(?i){ENDPOINT}|(?i:{IDENTIFIER.rpartition('|')[0]})|(?-i:AKIA[A-Z0-9]+)|{SECRET}", -1)))
    rows = rows.withColumn("__at", F.when(worth, _located(F.col("__weak_gaps"), F.col("__weak_hits"))))
    rows = _strong(rows).select("__key", "__id", "__base", F.zip_with("__at", "__kinds", lambda p, k: F.struct(p["s"].alias("s"), p["e"].alias("e"), k.alias("k"))).alias("__parts"), F.when(F.size(F.flatten("__inner")) > 0, F.zip_with("__at", F.zip_with("__weak_hits", "__inner", lambda h, x: F.struct(h.alias("h"), x.alias("x"))), _inside)).alias("__inside"))
    rows = rows.withColumn("__parts", F.when(F.col("__inside").isNull(), F.col("__parts")).otherwise(F.concat("__parts", F.flatten("__inside"))))
    parts = rows.where(F.col("__parts").isNotNull()).select("__id", F.explode("__parts").alias("p")).select("__id", "p.s", "p.e", "p.k").distinct()
    weak = linked(parts, ["__id"], reach).groupBy("__id").agg(F.array_sort(F.collect_list("span")).alias("weak"))
    joined = rows.drop("__parts", "__inside").join(weak, "__id", "left")
    return joined.select(F.col("__key").alias(key), F.col("__base").alias("base"), F.coalesce("weak", F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")).alias("weak"))


def written(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in _KINDS])
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", names[p["k"]], p["s"].cast("string"), p["e"].cast("string"))), ",")
