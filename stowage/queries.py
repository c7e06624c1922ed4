"""Registered queries of the archive engine with DuckDB equivalents.

The driver's tables hold no archives, so each query packs columns into archives, reads them with the
engine, and returns what SQL can tell from the columns themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sql as functions
from .model import Options
from .operators import relations as R
from .packing import archives_as, archives_of, pack_cpio, streams_as, streams_of
from .plans import reports
from .sources import archive

#: Documents in an archive.
EACH = 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _number() -> Column:
    """The number of a document's archive; as in SQL, the quotient is cut off towards zero."""
    return F.expr(f"doc_id div {EACH}").cast("string")


def _name() -> Column:
    return F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _packed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """All documents, EACH to an archive named by its number."""
    docs = _table(spark, sf_dir, "documents")
    return archives_of(docs, F.concat(_number(), F.lit(f".{kind}")), "doc_id", _name(), F.col("text"), kind)


_DOCS = f"(SELECT CAST(doc_id // {EACH} AS VARCHAR) || '.KIND' AS archive_path, CAST(row_number() OVER (PARTITION BY doc_id // {EACH} ORDER BY doc_id) - 1 AS INTEGER) AS index, coalesce(source, '') || '/' || doc_id || '.txt' AS name, doc_id, source, coalesce(text, '') AS text FROM documents)"


def _sha(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = reports.sha_rows(archive.digests(_packed(spark, sf_dir, kind)))
        return rows.select("archive_path", "index", "bytes", "sha256", "name")

    return query


for _kind in ("zip", "tar", "tar.gz", "tar.xz", "tar.bz2", "tar.zst", "cpio", "cpio.gz", "ar", "7z", "lzma.7z", "rpm", "lzh", "arj", "rar"):
    _add(f"sha_{_kind.replace('.', '_')}", _sha(_kind), f"SELECT archive_path, index, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(text) AS sha256, name FROM {_DOCS.replace('KIND', _kind)}")


def _total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sha_totals(reports.sha_rows(archive.digests(_packed(spark, sf_dir, "zip")))).select("archive_path", "label", "rows", "digest", "bytes")


_add("sha_total", _total, f"SELECT archive_path, 'total' AS label, count(*) AS rows, sha256(string_agg(sha256(text), '' ORDER BY index)) AS digest, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM {_DOCS.replace('KIND', 'zip')} GROUP BY ALL")


def _stream(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = streams_of(_table(spark, sf_dir, "documents"), F.concat(F.col("doc_id").cast("string"), F.lit(f".txt.{kind}")), F.col("text"), kind)
        return archive.digests(files).select("archive_path", "format", "name", "bytes", "sha256")

    return query


#: Stream suffixes and the formats they are detected as.
_STREAMS = {"gz": "gzip", "bz2": "bzip2", "xz": "xz", "zst": "zstd", "lz4": "lz4", "lzma": "lzma", "lz": "lzip", "br": "brotli", "pbzx": "pbzx"}
for _kind, _format in _STREAMS.items():
    _add(f"stream_{_kind}", _stream(_kind), f"SELECT doc_id || '.txt.{_kind}' AS archive_path, '{_format}' AS format, doc_id || '.txt' AS name, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents")


#: Archives that are detected; each format has its suffix for a name.
_ARCHIVES = ("zip", "tar", "cpio", "ar")


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each suffix has a row for its own format, also where no file has it."""
    docs = _table(spark, sf_dir, "documents")
    streams = streams_as(docs, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"), tuple(_STREAMS))
    packed = archives_as(docs.where("doc_id is not null"), _number(), "doc_id", _name(), F.col("text"), _ARCHIVES)
    found = streams.unionByName(packed).select(F.col("kind").alias("suffix"), functions.detect_format("path", "content").alias("format"), F.lit(1).alias("n"))
    none = spark.createDataFrame([(k, f, 0) for k, f in [*_STREAMS.items(), *zip(_ARCHIVES, _ARCHIVES)]], "suffix string, format string, n int")
    return found.unionByName(none).groupBy("suffix", "format").agg(F.sum("n").alias("n"))


_add("detect_format", _detected, " UNION ALL ".join([f"SELECT '{k}' AS suffix, '{f}' AS format, count(*) AS n FROM documents" for k, f in _STREAMS.items()] + [f"SELECT '{k}' AS suffix, '{k}' AS format, count(DISTINCT doc_id // {EACH}) AS n FROM documents" for k in ("zip", "tar", "cpio", "ar")]))


def _zip_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.listing(archive.entries(_packed(spark, sf_dir, "zip")))


_add("list_zip", _zip_list, f"SELECT archive_path, index, concat_ws(chr(9), CAST(index AS VARCHAR), CAST(octet_length(encode(text)) AS VARCHAR), 'file', CASE index % 4 WHEN 0 THEN 'deflate' WHEN 1 THEN 'stored' WHEN 2 THEN 'bzip2' ELSE 'lzma' END, '-', name) AS line FROM {_DOCS.replace('KIND', 'zip')}")


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archives(_packed(spark, sf_dir, "tar.gz")).select("archive_path", "format", "entry_count", "name_encoding", F.col("error.code").alias("error"))


_add("archives", _archives, f"SELECT archive_path, 'tar' AS format, CAST(count(*) AS INTEGER) AS entry_count, CAST(NULL AS VARCHAR) AS name_encoding, CAST(NULL AS VARCHAR) AS error FROM {_DOCS.replace('KIND', 'tar.gz')} GROUP BY ALL")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document is a hard link to the path of its number modulo 7, which later files give new entries."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    linked = F.col("doc_id") % 3 == 2
    name = F.when(linked, F.concat(F.lit("l/"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("f/"), (F.col("doc_id") % 7).cast("string")))
    data = F.when(linked, F.concat(F.lit("./f/"), (F.col("doc_id") % 7).cast("string"))).otherwise(F.col("text"))
    files = archives_of(docs, F.floor(F.col("doc_id") / EACH).cast("string"), "doc_id", name, data, "tar", F.when(linked, "hardlink").otherwise("file"))
    return R.hard_link_targets(archive.entries(files)).where("kind = 'hardlink'").select("archive_path", "index", "target_index")


_add("tar_hardlink_asof", _links, f"""WITH d AS (SELECT CAST(doc_id // {EACH} AS VARCHAR) AS archive_path, doc_id, CAST(row_number() OVER (PARTITION BY doc_id // {EACH} ORDER BY doc_id) - 1 AS INTEGER) AS index FROM documents)
SELECT l.archive_path, l.index, max(f.index) AS target_index FROM d l LEFT JOIN d f ON f.archive_path = l.archive_path AND f.index < l.index AND f.doc_id % 3 <> 2 AND f.doc_id % 7 = l.doc_id % 7 WHERE l.doc_id % 3 = 2 GROUP BY ALL""")


def _inodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    files = archives_of(docs, F.floor(F.col("doc_id") / EACH).cast("string"), "doc_id", F.col("doc_id").cast("string"), F.col("text"), "cpio", packer=lambda items: pack_cpio(items, lambda name, i: (int(name) % 5 + 1, 2)))
    return R.hard_link_groups(archive.entries(files))


_add("cpio_hardlink_groups", _inodes, f"""WITH d AS (SELECT doc_id, text, CAST(doc_id // {EACH} AS VARCHAR) AS archive_path, CAST(row_number() OVER (PARTITION BY doc_id // {EACH} ORDER BY doc_id) - 1 AS INTEGER) AS index FROM documents)
SELECT archive_path, '0:1:' || (doc_id % 5 + 1) AS hard_link_group, count(*) AS members, min(index) AS first_index, CAST(max(octet_length(encode(text))) AS BIGINT) AS bytes FROM d GROUP BY ALL""")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as listing facts: orders are archives, lines are entries."""
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("archive_path"), "l_orderkey", "l_partkey", "l_quantity", F.row_number().over(R.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("index"))


_FACTS = "(SELECT CAST(l_orderkey AS VARCHAR) AS archive_path, l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS index FROM lineitem)"


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir).withColumn("kind", F.when(F.col("l_partkey") % 11 == 0, "directory").otherwise("file"))
    return R.solid_islands(rows, F.col("l_partkey") % 3 != 0).select("archive_path", "index", "solid_group")


_add("solid_islands", _islands, f"""WITH r AS (SELECT *, l_partkey % 11 <> 0 AS file, l_partkey % 3 <> 0 AS solid FROM {_FACTS}),
l AS (SELECT *, CASE WHEN file THEN max(CASE WHEN file AND NOT solid THEN index END) OVER (PARTITION BY l_orderkey ORDER BY index) END AS lead FROM r),
c AS (SELECT *, count(*) FILTER (file) OVER (PARTITION BY l_orderkey, lead) AS n FROM l)
SELECT archive_path, CAST(index AS INTEGER) AS index, CAST(CASE WHEN file AND lead IS NOT NULL AND n > 1 THEN lead ELSE -1 END AS INTEGER) AS solid_group FROM c""")


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.folder_groups(_facts(spark, sf_dir), F.col("l_partkey") % 4).select("archive_path", "index", "solid_group")


_add("folder_groups", _folders, f"SELECT archive_path, CAST(index AS INTEGER) AS index, CAST(CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_partkey % 4) > 1 THEN l_partkey % 4 ELSE -1 END AS INTEGER) AS solid_group FROM {_FACTS}")


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir).withColumn("name", (F.col("l_partkey") % 3).cast("string"))
    return R.first_of_duplicates(rows).select("archive_path", "index", "name", "skipped")


_add("first_of_duplicates", _duplicates, f"SELECT archive_path, CAST(min(index) AS INTEGER) AS index, CAST(l_partkey % 3 AS VARCHAR) AS name, count(*) - 1 AS skipped FROM {_FACTS} GROUP BY l_orderkey, archive_path, l_partkey % 3")


def _budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir).withColumn("uncompressed_size", F.col("l_quantity").cast("long"))
    return R.over_budget(rows, 100).join(R.produced_budget(rows.withColumn("bytes", F.lit(0)), 100).groupBy("archive_path").agg(F.min(F.when(F.col("over"), F.col("index"))).alias("first_over")), "archive_path")


_add("output_budget", _budget, f"""WITH r AS (SELECT *, CAST(l_quantity AS BIGINT) AS size, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY index) AS run FROM {_FACTS})
SELECT archive_path, CAST(sum(size) AS BIGINT) AS declared, sum(size) > 100 AS over, CAST(min(CASE WHEN run > 100 THEN index END) AS INTEGER) AS first_over FROM r GROUP BY archive_path""")


def _safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents")
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("a/", "/", "../", "./b/", "c/../", "d//")]), (F.col("doc_id") % 6 + 1).cast("int")), F.col("doc_id").cast("string"))
    return rows.select("doc_id", name.alias("name")).select("doc_id", "name", R.normal_path(F.col("name")).alias("path"))


_add("path_safety", _safety, """WITH n AS (SELECT doc_id, ['a/', '/', '../', './b/', 'c/../', 'd//'][doc_id % 6 + 1] || doc_id AS name FROM documents)
SELECT doc_id, name, CASE WHEN name LIKE '/%' OR list_contains(string_split(name, '/'), '..') THEN NULL ELSE array_to_string(list_filter(string_split(name, '/'), lambda x: x <> '' AND x <> '.'), '/') END AS path FROM n""")


def _mac_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents are files, odd ones the sidecar of the document before; those of every tenth have no file."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    odd = F.col("doc_id") % 2 == 1
    name = F.when(odd & (F.col("doc_id") % 10 == 9), F.concat(F.lit("__MACOSX/d/._none"), F.col("doc_id").cast("string"))).when(odd, F.concat(F.lit("__MACOSX/d/._"), (F.col("doc_id") - 1).cast("string"))).otherwise(F.concat(F.lit("d/"), F.col("doc_id").cast("string")))
    return archives_of(docs, F.floor(F.col("doc_id") / EACH).cast("string"), "doc_id", name, F.col("text"), "zip")


def _apple_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.merge_apple_double(archive.entries(_mac_archives(spark, sf_dir)))
    return rows.select("archive_path", "index", "name", R.specific("fork").alias("fork"))


_add("appledouble_merge", _apple_double, f"""WITH d AS (SELECT doc_id, CAST(doc_id // {EACH} AS VARCHAR) AS archive_path FROM documents)
SELECT archive_path, CAST(row_number() OVER (PARTITION BY archive_path ORDER BY doc_id) - 1 AS INTEGER) AS index, CASE WHEN doc_id % 10 = 9 THEN '__MACOSX/d/._none' || doc_id WHEN doc_id % 2 = 1 THEN 'd/' || (doc_id - 1) ELSE 'd/' || doc_id END AS name, CASE WHEN doc_id % 2 = 1 AND doc_id % 10 <> 9 THEN 'rsrc' END AS fork FROM d""")


def _fork_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.merge_apple_double(archive.entries(_mac_archives(spark, sf_dir)))
    return R.without_covered_forks(rows).groupBy("archive_path").agg(F.count("*").alias("n"))


_add("fork_suppression", _fork_rows, f"SELECT CAST(doc_id // {EACH} AS VARCHAR) AS archive_path, count(*) FILTER (doc_id % 2 = 0 OR doc_id % 10 = 9) AS n FROM documents GROUP BY ALL")


def _order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = F.col("doc_id") % 4 == 0
    name = F.concat(F.when(folder & (F.col("doc_id") % 8 == 0), "x/y/").otherwise("x/"), F.col("doc_id").cast("string"))
    files = archives_of(docs, F.floor(F.col("doc_id") / EACH).cast("string"), "doc_id", name, F.when(folder, F.lit("")).otherwise(F.col("text")), "tar", F.when(folder, "directory").otherwise("file"))
    return R.extraction_order(archive.entries(files)).select("archive_path", "index", "phase", "step")


_add("extraction_order", _order, f"""WITH d AS (SELECT doc_id, CAST(doc_id // {EACH} AS VARCHAR) AS archive_path, CAST(row_number() OVER (PARTITION BY doc_id // {EACH} ORDER BY doc_id) - 1 AS INTEGER) AS index, CASE WHEN doc_id % 4 = 0 THEN 3 ELSE 0 END AS phase FROM documents)
SELECT archive_path, index, phase, CAST(row_number() OVER (PARTITION BY archive_path ORDER BY phase, CASE WHEN phase = 3 AND doc_id % 8 = 0 THEN -3 WHEN phase = 3 THEN -2 ELSE 0 END, index) AS INTEGER) AS step FROM d""")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.entries(_packed(spark, sf_dir, "zip"))
    bad = R.overlaps(rows).groupBy("archive_path").agg(F.count("*").alias("bad"))
    all_rows = rows.groupBy("archive_path").agg(F.count("raw_record").alias("records"))
    return all_rows.join(bad, "archive_path", "left").select("archive_path", "records", F.coalesce("bad", F.lit(0)).cast("long").alias("overlapping"))


_add("zip_record_overlaps", _records, f"SELECT archive_path, count(*) AS records, CAST(0 AS BIGINT) AS overlapping FROM {_DOCS.replace('KIND', 'zip')} GROUP BY ALL")


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.chunks(_packed(spark, sf_dir, "zip"), size=1000)
    return rows.groupBy("archive_path", "index").agg(F.count("chunk").alias("chunks"), F.sum(F.octet_length("chunk")).cast("long").alias("bytes"))


_add("chunked_payloads", _chunked, f"SELECT archive_path, index, CAST(ceil(octet_length(encode(text)) / 1000.0) AS BIGINT) AS chunks, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM {_DOCS.replace('KIND', 'zip')} WHERE text <> ''")


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives with a payload byte flipped or the end cut off: errors are rows, the other entries still read."""
    files = _packed(spark, sf_dir, "tar")
    short = files.select(F.concat(F.lit("short-"), "path").alias("path"), F.expr("substring(content, 1, length(content) - 1536)").alias("content"))
    cut_off = files.select(F.concat(F.lit("cut-"), "path").alias("path"), F.expr("substring(content, 1, 700)").alias("content"))
    rows = archive.digests(short.unionByName(cut_off), Options(recover=True))
    return rows.groupBy(F.substring_index("archive_path", "-", 1).alias("kind")).agg(F.countDistinct("archive_path").alias("archives"), F.count("index").alias("entries"), F.sum(F.col("is_incomplete").cast("long")).alias("incomplete"))


_add("recover_damaged_tar", _damaged, None)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents as a name in CP932 bytes: decoded with one charset for each source."""
    docs = _table(spark, sf_dir, "documents")
    words = docs.select(F.coalesce("source", F.lit("")).alias("group"), F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    rows = words.select("group", F.translate("word", "abcdefghijklmnopqrstuvwxyz", "あいうえおかきくけこさしすせそたちつてとなにぬねのは").alias("want"))
    encode = F.pandas_udf(lambda s: s.map(lambda t: t.encode("cp932")), "binary")
    named = functions.archive_names(rows.select("group", encode("want").alias("raw")))
    return named.select("group", "encoding", "text")


_add("name_decode_cp932", _names, """SELECT "group", 'cp932' AS encoding, translate(word, 'abcdefghijklmnopqrstuvwxyz', 'あいうえおかきくけこさしすせそたちつてとなにぬねのは') AS text FROM (SELECT DISTINCT coalesce(source, '') AS "group", unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents)""")


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary(archive.entries(_packed(spark, sf_dir, "zip"))).select("format", "method_description", "entries", "bytes", "median_bytes")


_add("method_summary", _summary, f"SELECT 'zip' AS format, CASE index % 4 WHEN 0 THEN 'deflate' WHEN 1 THEN 'stored' WHEN 2 THEN 'bzip2' ELSE 'lzma' END AS method_description, count(*) AS entries, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, median(octet_length(encode(text))) AS median_bytes FROM {_DOCS.replace('KIND', 'zip')} GROUP BY ALL")


def _lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions.register(spark)
    _packed(spark, sf_dir, "zip").createOrReplaceTempView("stowage_files")
    return spark.sql("SELECT path AS archive_path, e.index, e.bytes, e.sha256 FROM stowage_files, LATERAL archive_entries(path, content) e")


_add("sql_lateral_entries", _lateral, f"SELECT archive_path, index, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM {_DOCS.replace('KIND', 'zip')}")


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """Digests of every entry of a set of ZIP archives."""
    return QUERIES["sha_zip"](spark, sf_dir)
