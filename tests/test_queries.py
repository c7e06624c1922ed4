"""Stream queries against their SQL on rows that the test tables do not have."""

import lzma
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from stowage.model import ArchiveError, Options
from stowage.packing import PACKERS, compress, pack_cpio, streams_as
from stowage.queries import ORACLES, QUERIES
from stowage.sources.codecs.small import unpbzx
from stowage.sources.detect import detect
from stowage.sources.reader import rows


def words(seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(600))


#: Seeds whose stream has an HFS+ signature at byte 1,024 by chance, as the encoders are now.
LIKE_HFS = {"br": 37712, "lzma": 28906}


@pytest.fixture
def agrees(spark, tmp_path):
    """Whether a query gives the rows of its SQL over the texts."""

    def run(name: str, texts: list[str]) -> bool:
        spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
        want = duckdb.sql(ORACLES[name].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")).fetchall()
        return sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)

    return run


def test_brotli_that_looks_like_a_volume(agrees):
    assert agrees("stream_br", [words(LIKE_HFS["br"]), "plain"])


def test_lzma_that_looks_like_a_volume(agrees):
    assert agrees("stream_lzma", [words(LIKE_HFS["lzma"]), "", "plain"])


def test_pbzx_of_nothing_and_of_digits(agrees):
    assert agrees("stream_pbzx", ["", "070707 is no archive", "070701" + "0" * 200, "plain " * 2000])


def test_pbzx_chunks_to_the_end():
    one, two = b"stored chunk", b"second " * 9
    head = b"pbzx" + (4096).to_bytes(8, "big")
    chunk = lambda size, body: size.to_bytes(8, "big") + len(body).to_bytes(8, "big") + body
    whole = head + chunk(len(one), one) + chunk(len(two), lzma.compress(two))
    assert unpbzx(whole) == one + two and unpbzx(head) == b""
    for bad in (whole[:-1], whole + b"x", head + chunk(5000, one), head + chunk(3, one), head + chunk(3, lzma.compress(two)), head[:8]):
        with pytest.raises(ArchiveError):
            unpbzx(bad)
    packed = pack_cpio([("a", "file", b"1")])
    assert [r["format"] for r in rows("p.pbzx", compress("pbzx", packed), Options())] == ["cpio"]


def test_volume_headers_are_still_found():
    head = b"\0\5" + bytes(36) + (4096).to_bytes(4, "big")
    assert detect(bytes(1024) + b"HX" + head + bytes(1000)) == "dmg"
    for odd in (b"HX\0\4" + head[2:], b"HX" + head[:-1] + b"\1"):
        assert detect(b"\x1b" + bytes(1023) + odd + bytes(1000), "x.tar") == "tar"


def test_detected_formats(agrees):
    assert agrees("detect_format", [*map(words, LIKE_HFS.values()), "", "070707 is no archive", "plain"])


def koly(kind: str) -> bytes:
    """A text for which the word stands 512 bytes before the end of an archive of that kind."""
    pack = lambda text: PACKERS[kind]([("web/0.txt", "file", text)])
    at = len(pack(b"-" * 1200)) - 512 - pack(b"-" * 1200).index(b"-" * 1200)
    return b"-" * at + b"koly" + b"-" * (1196 - at)


@pytest.mark.parametrize("text", [koly("ar").decode(), koly("cpio").decode(), "(This file must be converted with BinHex 4.0)"], ids=["ar", "cpio", "binhex"])
def test_detected_formats_of_texts_with_signatures(agrees, text):
    assert agrees("detect_format", [text])


def test_koly_trailer_is_still_found():
    assert detect(b"x" * 700 + b"koly" + b"\0\0\0\4" + b"\0\0\2\0" + bytes(500)) == "dmg"


@pytest.mark.parametrize("given", [[], [(None, "plain", "web")], [(-1, "plain", "web"), (0, "", None), (1, None, "web"), ((1 << 60) + 19, "plain", "web"), ((1 << 60) + 20, "plain", "web")]], ids=["none", "no id", "odd ids"])
def test_detected_formats_of_odd_rows(spark, tmp_path, given):
    spark.createDataFrame(given, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.sql(ORACLES["detect_format"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")).fetchall()
    assert sorted(map(tuple, QUERIES["detect_format"](spark, str(tmp_path)).collect())) == sorted(want)


def test_packed_alike_by_any_way(spark):
    texts = [None, "", "plain", words(1), words(2) * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r["kind"], r["path"]): bytes(r["content"]) for r in streams_as(docs, F.col("id").cast("string"), F.col("text"), ("xz", "lzma", "lz", "pbzx", "gz")).collect()}
    assert got == {(k, f"{i}.{k}"): compress(k, (t or "").encode()) for i, t in enumerate(texts) for k in ("xz", "lzma", "lz", "pbzx", "gz")}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        assert lzma.decompress(got["xz", f"{i}.xz"]) == lzma.decompress(got["lzma", f"{i}.lzma"], lzma.FORMAT_ALONE) == unpbzx(got["pbzx", f"{i}.pbzx"]) == raw
        assert [r["format"] for r in rows("1.lz", got["lz", f"{i}.lz"], Options())] == ["lzip"]
