"""Line dedup by site-relative frequency (DataFrame operations only).

Within a host, a line's ratio is the number of pages that hold it over the host's number of pages.
Lines above the ratio are boilerplate and go from every page of that host.

A line is known by two 64-bit hashes of its trimmed text. Counts are combined before each shuffle, so
neither a large host nor a very common line lands in one task. A host keeps at most (mean distinct
lines a page / ratio) boilerplate lines, which bounds the lists joined back to the pages.

Defined results: null text stays null with 0 lines; blank lines are kept and never counted; a line
repeated inside one page counts once for it; a null host is one host of its own; hosts with fewer than
`min_pages` pages lose nothing; repeated rows are pages of their own; an empty table gives no rows;
input columns named like a result column are replaced, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Boilerplate: in more than this part of a host's pages, of which there are MIN_PAGES at least.
RATIO, MIN_PAGES = 0.1, 10
#: The boilerplate lists go to all executors only while they hold no more lines than this (16 bytes each).
BROADCAST_LINES = 200_000
#: Pages of a host for each salt where the lists are joined by a shuffle instead.
PAGES_A_SALT = 10_000

_BLANKS = " \t\n\v\f\r"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without port and user; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def html_lines(html: Column) -> Column:
    """HTML as lines of text: scripts, styles and comments go, block tags break lines, other tags go."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "")
    broken = F.regexp_replace(bare, r"(?i)</?(p|br|div|li|ul|ol|nav|article|section|header|footer|aside|main|table|tr|td|th|h[1-6]|title|head|body|html|blockquote|pre)(\s[^>]*)?/?>", "\n")
    return F.regexp_replace(broken, r"<[^>]*>", "")


def _key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(7), bare).alias("b")))


def boilerplate(pages: DataFrame, host: str, lines: str, ratio: float, min_pages: int) -> DataFrame:
    """(__null, __host, __pages, __drop): each host's pages and the keys of its boilerplate lines; only hosts with such lines."""
    keyed = pages.select(F.col(host).isNull().alias("__null"), F.coalesce(F.col(host), F.lit("")).alias("__host"), F.col(lines).alias("__lines"))
    once = keyed.select("__null", "__host", F.explode(F.concat(F.array(F.struct(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))), F.array_distinct(F.filter(F.transform("__lines", _key), lambda k: k.isNotNull())))).alias("k"))
    counts = once.groupBy("__null", "__host", "k").agg(F.count("*").alias("n"))
    # the row with an empty key counts the pages
    totals = counts.where(F.col("k.a").isNull()).select("__null", "__host", F.col("n").alias("__pages"))
    often = counts.where(F.col("k.a").isNotNull() & (F.col("n") >= 2))
    found = often.join(totals, ["__null", "__host"]).where((F.col("__pages") >= min_pages) & (F.col("n") > ratio * F.col("__pages")))
    return found.groupBy("__null", "__host", "__pages").agg(F.collect_list("k").alias("__drop"))


def drop_boilerplate(pages: DataFrame, text: str = "text", host: str = "host", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """pages with boilerplate lines gone from text, and n_lines, n_dropped (long)."""
    own = [c for c in pages.columns if c.lower() not in {"n_lines", "n_dropped"}]
    split = pages.select(*own, F.split(F.col(text), "\n").alias("__lines"))
    found = cut(boilerplate(split, host, "__lines", ratio, min_pages))
    small = (found.agg(F.coalesce(F.sum(F.size("__drop")), F.lit(0))).first()[0]) <= broadcast_lines
    left = split.withColumns({"__null": F.col(host).isNull(), "__host": F.coalesce(F.col(host), F.lit(""))})
    if small:
        joined = left.join(F.broadcast(found), ["__null", "__host"], "left")
    else:
        salts = F.ceil(F.col("__pages") / PAGES_A_SALT).cast("int")
        spread = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("__salts", salts)
        sizes = found.select("__null", "__host", salts.alias("__salts"))
        left = left.join(F.broadcast(sizes) if found.count() <= broadcast_lines else sizes, ["__null", "__host"], "left")
        left = left.withColumn("__salt", F.pmod(F.xxhash64(F.col(text)), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
        joined = left.join(spread.drop("__salts"), ["__null", "__host", "__salt"], "left")
    kept = F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda x: F.coalesce(~F.array_contains(F.col("__drop"), _key(x)), F.lit(True))))
    done = joined.withColumn("__kept", kept)
    n = F.greatest(F.size("__lines"), F.lit(0)).cast("long")
    out = {text: F.array_join("__kept", "\n")}
    return done.select(*[out[c].alias(c) if c in out else F.col(c) for c in own], n.alias("n_lines"), (n - F.greatest(F.size("__kept"), F.lit(0))).alias("n_dropped"))
