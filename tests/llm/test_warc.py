import base64
import gzip
import hashlib
import io
import zipfile

import pytest

from tessera.llm import common, warc
from tessera.llm.zip_archive import Archive


def sha(x):
    return base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()


ROWS = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (3, None, None), (4, "http://a/4 b\r\nX: y", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (6, "u", "big " * 100_000), (9, "http://a/9", "<p>same</p>"), (None, "u", "alone"), (None, "u", "<p>same</p>")]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def brute(rows, least=0):
    out = []
    for i, _, h in rows:
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        best = max(same, default=None)
        size = len((h or "").encode())
        visit = size >= least and i != best
        out.append((i, size, sha(h), "revisit" if visit and best is not None else "response", best if visit else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    for least in (0, 8, 1000):
        got = warc.round_trip(table(spark), least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(repr(tuple(r)) for r in got) == brute(ROWS, least)
    assert warc.round_trip(table(spark, []), 0).collect() == []


def test_payloads_come_back_from_small_packages(spark, tmp_path):
    manifest = warc.write_archives(table(spark), f"file://{tmp_path}/w", package=100)
    assert manifest.count() > 3 and sum(r.records for r in manifest.collect()) == len(ROWS)
    got = warc.read_archives(manifest).where("record_type = 'response'").collect()
    assert {bytes(r.payload) for r in got} == {(h or "").encode() for _, _, h in ROWS}
    assert {r.url for r in got if r.page_id in (4, 9)} == {"http://a/4%20b%0D%0AX:%20y", "http://a/9"}
    path = manifest.first().path.removeprefix("file://")
    with zipfile.ZipFile(path) as z:  # a standard reader agrees, and each record is a gzip member of its own
        assert z.testzip() is None and z.getinfo(warc.DATA).compress_type == zipfile.ZIP_STORED
        data, index = z.read(warc.DATA), z.read(warc.INDEX).decode().split("\n")[:-1]
        assert all(gzip.decompress(data[int(a) : int(a) + int(n)]).startswith(b"WARC/1.1") for a, n, _ in (x.split() for x in index))


def test_packages_are_read_by_many_tasks(spark, tmp_path):
    manifest = warc.write_archives(table(spark), f"file://{tmp_path}/w", package=100)
    assert warc.read_archives(manifest).rdd.getNumPartitions() == manifest.count() > 3


def test_archives_of_other_names_are_read_whole(spark, tmp_path):
    """Two archive members, one of them unknown to the index, whose records lie across the pieces of a scan."""
    raw = [warc.record(k, "u", b"%d" % k + b"payload" * 300, warc._sha1(b"%d" % k + b"payload" * 300), None) for k in range(9)]
    packed = [gzip.compress(x) for x in raw]
    path = f"{tmp_path}/other.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/one.warc.gz", b"".join(packed[:4]))
        z.writestr("archive/two.warc.gz", b"".join(packed[4:]))
        z.writestr("indexes/x.cdx", "".join(f"{sum(map(len, packed[:k]))} {len(packed[k])} archive/one.warc.gz\n" for k in range(4)))
        z.writestr("notes.txt", b"nothing")
    manifest = spark.createDataFrame([(f"file://{path}", 9, 0)], warc.MANIFEST)
    assert sorted(r.page_id for r in warc.read_archives(manifest).collect()) == list(range(9))
    with open(path, "rb") as f:
        a = Archive(f, len(open(path, "rb").read()))
        before, warc.PIECE = warc.PIECE, 10
        try:
            assert list(warc.scanned(a, a.members["archive/two.warc.gz"])) == raw[4:]
        finally:
            warc.PIECE = before


def archive(build, comment=b""):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        build(z)
        z.comment = comment
    return buffer


def test_archive_reader_finds_ranges(monkeypatch):
    def build(z):
        z.writestr("a.txt", b"0123456789")
        with z.open("dir/é.bin", "w", force_zip64=True) as f:
            f.write(b"abcdef")
        z.writestr("deflated", b"x" * 1000, zipfile.ZIP_DEFLATED)

    for comment in (b"", b"note PK\5\6 and more of it, long enough to look like an end record"):
        b = archive(build, comment)
        a = Archive(b, len(b.getvalue()))
        assert set(a.members) == {"a.txt", "dir/é.bin", "deflated"}
        assert a.range(a.members["a.txt"], 3, 4) == b"3456" and a.read("dir/é.bin") == b"abcdef"
        with pytest.raises(ValueError):
            a.range(a.members["a.txt"], 8, 3)
        with pytest.raises(ValueError):
            a.read("deflated")


def test_zip64_directories(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 5)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    b = archive(lambda z: [z.writestr(f"m{k}", b"payload %d" % k) for k in range(5)])
    a = Archive(b, len(b.getvalue()))
    assert [a.read(f"m{k}") for k in range(5)] == [b"payload %d" % k for k in range(5)]


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        Archive(io.BytesIO(b"no zip at all"), 13)
    raw = warc.record(1, "u", b"payload", sha("payload"), None)
    assert warc.parse_record(raw)[:3] == (1, "u", 7)
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"payload", b"paYload"))
    with pytest.raises(ValueError):
        warc.parse_record(raw[:-3])
