"""WARC archives: round trips, frames, attempts."""
import glob
import hashlib
import struct

from corpusql.llm import warc
from corpusql.llm.common import fresh_path

LONG = "<p>" + "long payload " * 100
PAGES = [(1, "http://a/", LONG), (2, "http://b/", LONG), (3, None, None), (4, "http://c\r\nx: y", ""), (5, "http://d/", "short"),
         (6, "http://e/", "short"), (7, "http://f/", "é😀" * 600), (7, "http://f/", "é😀" * 600), (None, "http://g/", LONG),
         (9, "http://h/", "<p>\r\n\r\nWARC/1.1\r\n" * 5000)]


def _pages(spark, rows):
    return spark.createDataFrame([(*r, b"x", "y") for r in rows], "page_id bigint, url string, html string, payload binary, digest string")


def test_round_trip(spark):
    path = fresh_path(spark, "warc-test")
    index = warc.write_archives(_pages(spark, PAGES).coalesce(1), path)
    got = warc.read_archives(spark, path, index).collect()
    assert len(got) == len(PAGES) == index.count()
    for r in got:
        html = next((h or "" for i, _, h in PAGES if i == r.page_id)).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds[1] == ("revisit", 2) and kinds[None] == ("revisit", 2)
    assert {k for k, v in kinds.items() if v == ("response", None)} == {2, 3, 4, 5, 6, 7, 9}


def test_records_are_frames_behind_a_dictionary(spark):
    path = fresh_path(spark, "warc-test")
    rows = [(i, f"http://site/{i}", f"<html><body class='page'>text number {i} of many</body></html>" * 9) for i in range(300)]
    index = warc.write_archives(_pages(spark, rows).coalesce(1), path).collect()
    local = path.removeprefix("file:")
    archive = open(glob.glob(f"{local}/{index[0].archive}")[0], "rb").read()
    assert struct.unpack_from("<I", archive)[0] == warc.DICTIONARY_MAGIC
    assert [b - a for a, b in warc.frames(archive)] == [r.length for r in sorted(index, key=lambda r: r.offset)]
    one = next(r for r in index if r.page_id == 17)
    reader = warc.zstd.ZstdDecompressor(dict_data=warc.read_dictionary(archive))
    assert warc.parse_record(reader.decompress(archive[one.offset:one.offset + one.length]))[0] == 17


def test_files_of_another_attempt_are_not_read(spark):
    path = fresh_path(spark, "warc-test")
    index = warc.write_archives(_pages(spark, PAGES[:3]).coalesce(1), path)
    stale, _ = warc.pack([warc.make_record(99, "http://old/", b"old", None, False)])
    open(f"{path.removeprefix('file:')}/000000-999-00000.warc.zst", "wb").write(stale)
    assert {r.page_id for r in warc.read_archives(spark, path, index).collect()} == {1, 2, 3}


def test_no_pages(spark):
    path = fresh_path(spark, "warc-test")
    index = warc.write_archives(_pages(spark, []), path)
    assert warc.read_archives(spark, path, index).count() == 0
