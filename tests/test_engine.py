"""The relations, the data source, extraction and the stream on Spark."""

import hashlib
import io
import os
import zipfile

from pyspark.sql import functions as F

from stowage.functions import sql as functions
from stowage.operators import relations as R
from stowage.model import Options
from stowage.packing import PACKERS, pack_tar, pack_zip
from stowage.plans import reports
from stowage.sources import archive, extract, reader
from stowage.streaming import arriving

ITEMS = [("a/one.txt", "file", b"hello " * 50), ("two", "file", b""), ("b/three.bin", "file", bytes(range(256)))]


def files(spark, made):
    return spark.createDataFrame([(n, bytearray(b)) for n, b in made], "path string, content binary")


def test_one_and_many_partitions_agree(spark):
    made = [(f"x{i}.{k}", PACKERS[k](ITEMS)) for i in range(3) for k in ("zip", "tar.gz", "cpio")] + [("bad.zip", b"PK\3\4nothing"), ("no", b"text")]
    df = files(spark, made)
    one, many = (sorted(map(str, archive.digests(df.repartition(n)).collect())) for n in (1, 4))
    assert one == many and len(one) == 9 * 3 + 2


def test_data_source_filters_and_content(spark, tmp_path):
    archive.register(spark)
    for i in range(3):
        (tmp_path / f"f{i}.zip").write_bytes(pack_zip(ITEMS))
    (tmp_path / "s.tar.001").write_bytes(pack_tar(ITEMS)[:1000])
    (tmp_path / "s.tar.002").write_bytes(pack_tar(ITEMS)[1000:])
    rows = spark.read.format("archive").load(str(tmp_path))
    assert rows.count() == 12 and rows.where("kind = 'file' and name = 'two'").count() == 4
    pushed = spark.read.format("archive").option("content", "true").load(str(tmp_path)).where(F.col("index") == 2)
    assert {bytes(r["content"]) for r in pushed.collect()} == {bytes(range(256))}
    joined = archive.read_files(spark, str(tmp_path), "*.tar.*")
    assert archive.entries(joined).where("error is null").count() == 3


def test_apple_double_policies(spark):
    made = [("m.zip", pack_zip([("d/f", "file", b"1"), ("__MACOSX/d/._f", "file", b"2"), ("d/._lone", "file", b"3")]))]
    rows = archive.entries(files(spark, made))
    got = [(r["index"], r["name"], r["fork"]) for r in R.merge_apple_double(rows).select("index", "name", R.specific("fork").alias("fork")).orderBy("index").collect()]
    assert got == [(0, "d/f", None), (1, "d/f", "rsrc"), (2, "d/._lone", None)]
    assert R.merge_apple_double(rows, "hide").count() == 2 and R.merge_apple_double(rows, "expose").count() == 3


def test_links_trees_and_copies(spark):
    m = "map<string,string>"
    rows = spark.createDataFrame([("a", 0, "f", "file", 5, None), ("a", 1, "l1", "hardlink", 0, {"linkPath": "f"}), ("a", 2, "l2", "hardlink", 0, {"linkPath": "l1"}), ("a", 3, "early", "hardlink", 0, {"linkPath": "late"}), ("a", 4, "late", "file", 1, None), ("a", 5, "c1", "hardlink", 0, {"linkPath": "c2"}), ("a", 6, "c2", "hardlink", 0, {"linkPath": "c1"}), ("a", 7, "copy", "file", 5, {"copyPath": "f"}), ("a", 8, "copy2", "file", 9, {"copyPath": "f"})], f"archive_path string, index int, name string, kind string, uncompressed_size long, format_specific {m}")
    targets = {r["index"]: r["target_index"] for r in R.hard_link_targets(rows).collect()}
    assert targets[1] == 0 and targets[2] == 1 and targets[3] is None and targets[5] is None
    assert {r["index"]: r["file_index"] for r in R.link_closure(rows).collect()} == {1: 0, 2: 0, 3: 4}
    assert {r["index"]: r["source_index"] for r in R.copy_sources(rows).where("index >= 7").collect()} == {7: 0, 8: None}
    nodes = spark.createDataFrame([("a", 1, None, "r"), ("a", 2, 1, "x"), ("a", 3, 2, "y"), ("a", 8, 9, "p"), ("a", 9, 8, "q")], "archive_path string, id int, parent int, name string")
    assert {(r["id"], r["path"], r["depth"]) for r in R.tree_paths(nodes).collect()} == {(1, "r", 1), (2, "r/x", 2), (3, "r/x/y", 3)}


def test_totals_listing_and_lines(spark):
    rows = reports.sha_rows(archive.digests(files(spark, [("x.zip", pack_zip(ITEMS)), ("y.zip", pack_zip(ITEMS)[:-3])])))
    total = {r["archive_path"]: r for r in reports.sha_totals(rows).collect()}
    assert total["x.zip"]["label"] == "total" and total["x.zip"]["rows"] == 3 and "y.zip" not in total
    df = spark.createDataFrame([("a\tb\\\x01‮c",)], "t string")
    assert df.select(reports.one_line(F.col("t"))).first()[0] == "a\\tb\\\\\\u{1}\\u{202e}c"
    assert reports.sampled(archive.entries(files(spark, [("x.zip", pack_zip(ITEMS))])), 2).count() == 2


def test_extraction_is_safe(spark, tmp_path):
    bad = pack_tar([("ok/f", "file", b"1"), ("../evil", "file", b"2"), ("l", "symlink", b"../../out"), ("h", "hardlink", b"ok/f"), ("d", "directory", b"")])
    got = {r["index"]: r["error"] for r in extract.extract(files(spark, [("t.tar", bad)]), str(tmp_path)).collect()}
    assert got == {0: None, 1: "malformed", 2: "malformed", 3: None, 4: None}
    root = tmp_path / "t.tar.d"
    assert (root / "ok/f").read_bytes() == b"1" and os.path.samefile(root / "h", root / "ok/f") and not (tmp_path / "evil").exists()


def test_stream_reads_each_archive_once(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "a.zip").write_bytes(pack_zip(ITEMS))
    for _ in range(2):
        q = arriving.write_digests(arriving.arriving(spark, str(folder), digests=True), str(out), str(tmp_path / "cp"))
        q.awaitTermination()
        (folder / "b.tar").write_bytes(pack_tar(ITEMS))
    assert spark.read.parquet(str(out)).count() == 6


def test_sql_functions(spark):
    functions.register(spark)
    got = spark.sql("SELECT crc16_arc(b) a, crc16_xmodem(b) x, crc64_xz(b) c, detect_format('n', b) f FROM (SELECT cast('123456789' AS binary) b)").first()
    assert (got["a"], got["x"], got["c"], got["f"]) == (0xBB3D, 0x31C3, "995dc9bbdf1939fa", "error:unsupportedFormat")


def test_data_source_filters_and_reuse(spark, tmp_path):
    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for entry in ("f1", "f2", "g1", "fx"):
                z.writestr(entry, f"{name} {entry}")
    archive.register(spark)
    rows = spark.read.format("archive").option("content", "true").load(str(tmp_path))
    assert rows.where(F.col("name").startswith("f1") & F.col("name").startswith("f")).count() == 2
    assert rows.count() == 8
    assert rows.where("index = 1").count() == 2
    assert rows.count() == 8
    assert rows.where((F.col("archive_path") == f"{tmp_path}/a.zip") & (F.col("kind") == "file")).count() == 4
    assert rows.where("index is null").count() == 0 and rows.count() == 8
    some = spark.read.format("archive").option("content", "true").option("namePrefix", "f").option("kind", "file").load(str(tmp_path / "*.zip"))
    assert some.count() == 6 and some.where("content is null").count() == 0


def test_data_source_reads_volume_sets_by_their_listed_path(spark, tmp_path):
    whole = tmp_path / "whole.bin"
    with zipfile.ZipFile(whole, "w") as z:
        for i in range(4):
            z.writestr(f"f{i}", os.urandom(500))
    data = whole.read_bytes()
    whole.unlink()
    for i in range(0, len(data), 700):
        (tmp_path / f"set.zip.{i // 700 + 1:03d}").write_bytes(data[i : i + 700])
    archive.register(spark)
    rows = spark.read.format("archive").load(str(tmp_path))
    assert rows.count() == 4
    path = rows.first()["archive_path"]
    assert rows.where(F.col("archive_path") == path).count() == 4


def test_digests_of_entries_above_the_memory_limit():
    held = io.BytesIO()
    big = bytes(range(256)) * 20_000
    with zipfile.ZipFile(held, "w") as z:
        for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA):
            z.writestr(f"m{method}", big, method)
        z.writestr("empty", b"", zipfile.ZIP_DEFLATED)
    opts = Options()
    opts.limits.max_in_memory = 1 << 20
    got = {r["name"]: r for r in reader.digest_rows("x.zip", held.getvalue(), opts)}
    want = hashlib.sha256(big).hexdigest()
    assert [got[f"m{m}"].get("sha256") for m in (0, 8, 12)] == [want] * 3 and got["empty"]["bytes"] == 0
    assert got["m14"]["error"]["code"] == "limitExceeded"
    pieces = next(e for e in reader.open_archive(held.getvalue(), "x.zip", opts).entries if e.name == "m8").stream()
    assert max(map(len, pieces)) <= 1 << 20
    broken = bytearray(held.getvalue())
    broken[1000] ^= 1
    assert next(reader.digest_rows("x.zip", bytes(broken), opts))["error"]["code"] == "checksumMismatch"


def test_what_fails_is_a_row(monkeypatch):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a", b"text")
    data = held.getvalue()
    at = data.index(b"PK\1\2") + 10
    for method, code in ((0x60, "unsupportedMethod"), (0x62, "malformed")):
        odd = data[:at] + bytes([method, 0]) + data[at + 2 :]
        assert next(reader.rows("a.zip", odd, Options(), True))["error"]["code"] == code
    monkeypatch.setitem(reader.PARSERS, "zip", lambda *a: (_ for _ in ()).throw(ModuleNotFoundError("gone")))
    assert next(reader.rows("a.zip", data, Options()))["error"]["code"] == "malformed"
