"""Whole reports: listings, digests with totals, audits, benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relations import KEY, safe_components, specific, without_covered_forks


def one_line(text: Column) -> Column:
    """Text for a TSV field, escaped by built-in functions: backslash, tab, line ends, and other controls as \\u{..}."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    odd = [*range(0, 9), 11, 12, *range(14, 32), *range(127, 160), 0x061C, 0x200E, 0x200F, *range(0x2028, 0x202F), *range(0x2066, 0x206A)]
    escaped = F.transform(F.split(out, ""), lambda c: F.when(F.array_contains(F.array(*[F.lit(chr(i)) for i in odd]), c), F.concat(F.lit("\\u{"), F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "^0{1,3}", ""), F.lit("}"))).otherwise(c))
    return F.when(out.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f؜‎‏ -‮⁦-⁩]"), F.array_join(escaped, "")).otherwise(out)


def listing(entries: DataFrame, raw: bool = False) -> DataFrame:
    """index, size or -, kind, method, encryption, name, and what else is known, one line each."""
    label = F.when(F.col("is_encrypted"), F.coalesce(specific("encryption"), F.lit("encrypted"))).otherwise("-")
    more = [F.when(specific(k).isNotNull(), F.concat(F.lit(f"{s}="), specific(k))) for k, s in (("headerLevel", "level"), ("fork", "fork"))]
    more.append(F.when(F.col("solid_group") >= 0, F.concat(F.lit("solid="), F.col("solid_group").cast("string"))))
    if raw:
        more.append(F.lower(F.hex("raw_name")))
    fields = [F.col("index").cast("string"), F.coalesce(F.col("uncompressed_size").cast("string"), F.lit("-")), F.col("kind"), F.col("method_description"), label, one_line(F.col("name")), *more]
    return entries.where(F.col("index").isNotNull()).select(KEY, "index", F.concat_ws("\t", *fields).alias("line"))


def sha_rows(digests: DataFrame, forks: bool = False) -> DataFrame:
    """One row for each entry: index, bytes, sha256, name, error. Directories digest as empty."""
    rows = digests.where(F.col("index").isNotNull())
    if not forks:
        rows = without_covered_forks(rows)
    failed = F.col("error").isNotNull()
    return rows.select(KEY, "index", F.when(~failed, F.coalesce("bytes", F.lit(0))).alias("bytes"), F.when(~failed, F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256))).alias("sha256"), "name", F.when(failed, F.col("error.code")).alias("error"))


def sha_totals(rows: DataFrame) -> DataFrame:
    """One row for each archive: SHA-256 over the hex digests in entry order; `partial` if any entry failed.

    The digests of one archive meet in one ordered aggregate, 64 characters an entry.
    """
    ordered = F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("index", "sha256"))))
    return rows.groupBy(KEY).agg(F.when(F.count("error") > 0, "partial").otherwise("total").alias("label"), F.count(F.when(F.col("error").isNull(), 1)).alias("rows"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["sha256"]), "").cast("binary"), 256).alias("digest"), F.sum("bytes").alias("bytes"))


def failed_entries(rows: DataFrame) -> DataFrame:
    """Archives and entries that failed, by error code."""
    return rows.where(F.col("error").isNotNull()).groupBy(KEY, F.col("error.code").alias("code")).count()


def unsafe_paths(entries: DataFrame) -> DataFrame:
    """Entries that must not be extracted by their name."""
    return entries.where(F.col("index").isNotNull() & safe_components(F.col("path_components"), F.col("name")).isNull())


def summary(entries: DataFrame) -> DataFrame:
    """Entries, bytes and medians by archive format and method."""
    return entries.where(F.col("index").isNotNull()).groupBy("format", "method_description").agg(F.count("*").alias("entries"), F.sum("uncompressed_size").alias("bytes"), F.sum("compressed_size").alias("packed"), F.percentile("uncompressed_size", F.lit(0.5)).alias("median_bytes"))


def sampled(entries: DataFrame, count: int = 20, seed: int = 42) -> DataFrame:
    """At most `count` entries that are no directories of each archive, the same ones each time: those of the least hash."""
    from pyspark.sql import Window

    w = Window.partitionBy(KEY).orderBy(F.xxhash64(F.lit(seed), KEY, "index"), "index")
    return entries.where(F.col("kind") != "directory").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= count).drop("__r")
