import gzip
import zlib
from pathlib import Path

import pytest

from threadlake.llm import warc
from threadlake.scratch import Scratch


BOUND = 1500  # bytes of an archive: a few records


def archive(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, Payload string")
    path = Scratch(spark, "test-warc").folder("archives")
    warc.write_archives(warc.plan_records(pages, **options), path, BOUND)
    return path


def test_round_trip(spark):
    rows = [
        (5, "http://a/\r\nb", "same", "x"),
        (3, None, "same", "x"),
        (9, "u", "same", "x"),
        (1, "u", "é" * 70_000 + "\r\n\r\nWARC/1.1", "x"),
        (7, "u", None, "x"),
        (8, "u", "", "x"),
        (3, None, "same", "x"),
        (None, "u", "same", None),
    ]
    path = archive(spark, rows)
    back = warc.read_archives(spark, path).collect()
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in back)
    assert got == [
        (0, "revisit", 3, 4),
        (1, "response", 0, 140_012),
        (3, "response", 0, 4),
        (3, "response", 0, 4),
        (5, "revisit", 3, 4),
        (7, "response", 0, 0),
        (8, "revisit", 7, 0),
        (9, "revisit", 3, 4),
    ]
    for r in back:
        page = dict((p, h) for p, _, h, _ in rows)[r.page_id] or ""
        assert r.payload_digest == warc.digest_of(page.encode())
        assert r.payload is None if r.record_type == "revisit" else r.payload == page.encode()


def test_archives_are_plain_gzip_with_one_member_per_record(spark):
    path = archive(spark, [(i, "u", f"page {i}" * i, "") for i in range(20)])
    files = list(Path(path.removeprefix("file:")).glob("archive=*/part-*"))
    assert len(files) >= 5 and all(f.stat().st_size <= BOUND for f in files)
    for data in (f.read_bytes() for f in files):
        members = list(warc._members(memoryview(data)))
        assert gzip.decompress(data) == b"".join(members)
        assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
    # All that fits is in one archive: no two neighbours of a task would fit into one.
    sizes = {int(f.parent.name[8:]): f.stat().st_size for f in files}
    assert all(sizes[n] + sizes[n + 1] > BOUND for n in sizes if n + 1 in sizes)


def test_a_record_beyond_the_bound_has_an_archive_of_its_own(spark):
    rows = [(i, "u", "".join(map(chr, range(300, 300 + 3000 * (i % 2)))), "") for i in range(6)]
    path = archive(spark, rows)
    files = list(Path(path.removeprefix("file:")).glob("archive=*/part-*"))
    large = [f for f in files if f.stat().st_size > BOUND]
    assert large and all(len(list(warc._members(memoryview(f.read_bytes())))) == 1 for f in large)
    assert warc.read_archives(spark, path).count() == 6


def test_least_bytes_and_no_rows(spark):
    rows = [(2, "u", "abc", ""), (1, "u", "abc", "")]
    back = warc.read_archives(spark, archive(spark, rows, least_bytes=4)).collect()
    assert [r.record_type for r in back] == ["response", "response"]
    assert warc.read_archives(spark, archive(spark, [])).count() == 0


def test_members_of_large_records_end_in_nul():
    record = b"x" * ((16 << 20) + 5)
    whole = warc._line(record) + b"\0"
    assert [m for m in warc._members(memoryview(whole)) if m] == [record]


def test_damage_is_found():
    record = warc.build_record(1, "u", b"payload", warc.digest_of(b"payload"), None, False, 7)
    good = warc._line(record) + b"\0"
    assert len(list(warc.read_archive(good * 3))) == 3
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_archive(good[:-9]))
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_archive(warc._line(record.replace(b"payload\r", b"paylord\r")) + b"\0"))
    with pytest.raises(ValueError, match="bytes long"):
        list(warc.read_archive(warc._line(record + b"more") + b"\0"))
    with pytest.raises(zlib.error):
        list(warc.read_archive(b"no gzip at all"))
