import hashlib
import time

import pytest

from veilmatch.llm.warc import arc_opening, arc_record, chunks_of, convert, inflated, member, parse_arc_header, read_arc, read_back, read_warc, warc_record, write_arc
from veilmatch.llm.common import write_file


def test_headers_of_both_versions():
    one = parse_arc_header(b"http://a/b c 1.2.3.4 20100102030405 text/html 12", 1)
    assert one == {"url": "http://a/b c", "ip": "1.2.3.4", "date": "20100102030405", "kind": "text/html", "length": 12}
    two = parse_arc_header(b"http://a 1.2.3.4 20100102030405 text/html 200 abc - 99 f.arc 7", 2)
    assert two["length"] == 7 and two["status"] == "200" and two["checksum"] == "abc"
    with pytest.raises(ValueError):
        parse_arc_header(b"http://a 1.2.3.4 7", 1)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("gz", [True, False])
def test_records_by_declared_length(version, gz):
    blocks = [b"", b"\n\n", b"HTTP/1.1 200 OK\r\n\r\nhello", b"x" * 100_000, b"http://z 1.1.1.1 20100101000000 text/html 3\nabc"]
    parts = [arc_opening(version, "f", "20100101000000")] + [arc_record(version, f"http://a/{k}", "1.1.1.1", "20100101000000", "text/html", b, "f", 0) for k, b in enumerate(blocks)]
    data = b"".join(member(p) if gz else p for p in parts)
    for step in (7, 1000, 10**7):
        got = list(read_arc(iter([data[k: k + step] for k in range(0, len(data), step)])))
        assert [b for _, _, b in got] == blocks and [h["url"] for _, h, _ in got] == [f"http://a/{k}" for k in range(5)]
    with pytest.raises(ValueError):
        list(read_arc(iter([data[:-10]])))


def test_warc_fields():
    header = {"url": "http://a", "ip": "1.1.1.1", "date": "20100102030405", "kind": "text/html"}
    block = b"HTTP/1.1 200 OK\r\nX-Page-Id: 5\r\n\r\nbody"
    digest = hashlib.sha256(b"body").hexdigest()
    (_, a, b1), (_, r, b2) = read_warc(iter([member(warc_record(header, block, "x.arc", 9, None)) + member(warc_record(header, block, "x.arc", 70, {"path": "x.arc", "offset": 9, "page_id": 5, "url": "http://a", "date": "20100102030405"}))]))
    assert a["WARC-Date"] == "2010-01-02T03:04:05Z" and a["WARC-Payload-Digest"] == f"sha256:{digest}" and b1 == block
    assert r["WARC-Type"] == "revisit" and r["WARC-Refers-To"] == a["WARC-Record-ID"] != r["WARC-Record-ID"] and not b2.endswith(b"body")


def test_round_trip(spark):
    big = "<p>" + "é" * 200
    rows = [(5, "http://x/5", big), (3, "http://x/3 y", big), (9, None, big), (None, "u", big), (4, "http://x/4", "short"), (6, "u\n", "short"), (7, "", None), (8, "u", ""), (3, "http://x/3 y", big), (10, "u", "WARC/1.1\r\n\r\n" * 5000), (11, "u", "\n" * 99), (12, "u", "\n" * 100), (2, "u", "\n" * 100)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, path string").repartition(3)
    got = read_back(convert(write_arc(df, archive_bytes=300))).collect()
    assert len(got) == len(rows)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        same = [j for j, _, x in rows if (x or "").encode() == p and j is not None]
        first = min(same) if same else None
        revisit = len(p) >= 100 and i != first
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    k = next(n for n, w in enumerate(want) if w[0] == 3)
    want[k] = (*want[k][:3], "revisit", 3)  # of the repeated row, one refers to the other
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    assert read_back(convert(write_arc(df.limit(0)))).count() == 0


def test_plain_arc_file(spark, tmp_path):
    data = arc_opening(1, "f", "19990101000000") + arc_record(1, "http://a", "1.1.1.1", "19990101000000", "text/plain", b"no http here", "f", 0)
    write_file(f"{tmp_path}/old.arc", data)
    out = convert(spark.createDataFrame([(f"{tmp_path}/old.arc",)], "path string"))
    r = read_back(out).first()
    assert r["payload_bytes"] == 12 and r["date"] == "1999-01-01T00:00:00Z" and r["page_id"] is None
    assert out.first()["path"].endswith("/old.warc.gz")
    assert len(list(inflated(chunks_of(out.first()["path"])))) == 1


def test_a_long_plain_record_is_read_in_linear_time():
    data = arc_opening(1, "f", "19990101000000") + arc_record(1, "http://a", "1.1.1.1", "19990101000000", "text/plain", b"y" * 80_000_000, "f", 0)
    began = time.time()
    ((_, _, block),) = read_arc(data[k: k + 32_768] for k in range(0, len(data), 32_768))
    assert len(block) == 80_000_000 and time.time() - began < 2


def test_equal_rows_and_names_stay_apart(spark):
    """Equal rows get record ids of their own; files of one name in two folders give two archives, each from its own task."""
    page = [(1, "http://x", "z" * 200)] * 3
    files = write_arc(spark.createDataFrame(page, "page_id long, url string, html string").coalesce(1))
    out = convert(files)
    fields = [f for r in out.collect() for _, f, _ in read_warc(chunks_of(r["path"]))]
    assert len({f["WARC-Record-ID"] for f in fields}) == 3
    (first,) = [f["WARC-Record-ID"] for f in fields if f["WARC-Type"] == "response"]
    assert [f["WARC-Refers-To"] for f in fields if f["WARC-Type"] == "revisit"] == [first, first]
    source = files.first()["path"]
    data = b"".join(chunks_of(source))
    copies = [source.rsplit("/", 1)[0] + f"/{k}/same.arc.gz" for k in range(5)]
    for c in copies:
        write_file(c, data)
    out = convert(spark.createDataFrame([(c, "clash") for c in copies], "path string, decisions string"))
    assert len({r["path"] for r in out.collect()}) == 5
    kinds = [f["WARC-Type"] for r in out.collect() for _, f, _ in read_warc(chunks_of(r["path"]))]
    assert kinds.count("response") == 1 and len(kinds) == 5 * len(list(read_arc(chunks_of(source))))
