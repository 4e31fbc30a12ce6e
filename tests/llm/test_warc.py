import gzip
import hashlib
from collections import Counter

import pytest

from matchlake.llm import warc
from matchlake.llm.common import qualified


def pages(spark):
    big = "<html>" + "same payload " * 20 + "</html>"
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (6, "http://a/6", None), (7, "http://a/7", ""), (8, "http://a/é", "ü" * 60), (9, "x\r\ny", "ü" * 60), (None, "u", big), (1, "http://a/1", big)]
    return rows, spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")


def test_round_trip(spark, monkeypatch):
    rows, df = pages(spark)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        ref = first.get(h)
        ref = ref if ref is not None and i is not None and i > ref else None
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if ref else "response", ref, 0] += 1
    for few in (warc.FEW_REPEATED, 0):  # repeated payloads at hand, and joined
        monkeypatch.setattr(warc, "FEW_REPEATED", few)
        columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "gap_bytes")
        assert Counter(tuple(r[c] for c in columns) for r in warc.archived(df).collect()) == want
    assert warc.archived(df.limit(0)).collect() == []


def parsed(path):
    with open(path, "rb") as f:
        return list(warc.Salvage(f, path.stat().st_size))


def test_salvage(tmp_path):
    members = [warc.record(i, f"http://a/{i}", f"payload {i} ".encode() * 30, hashlib.sha256(f"payload {i} ".encode() * 30).hexdigest(), None) for i in range(6)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members))
    assert [x[2]["x-page-id"] for x in parsed(path)] == list("012345")
    broken = members[2][: len(members[2]) // 2]  # one record is cut short, another has flipped bytes, junk lies between
    flipped = bytearray(members[4])
    flipped[len(flipped) // 2] ^= 0xFF
    parts = [members[0], b"junk" * 10, members[1], broken, members[3], bytes(flipped), members[5], b"\x1f\x8b\x08tail"]
    path.write_bytes(b"".join(parts))
    found = parsed(path)
    assert [x[2]["x-page-id"] for x in found if x[2]] == list("0135")
    ends = [0]
    for p in parts:
        ends.append(ends[-1] + len(p))
    assert [(x[0], x[1]) for x in found if not x[2]] == [(ends[1], ends[2]), (ends[3], ends[4]), (ends[5], ends[6]), (ends[7], ends[8])]


def test_plain_records_and_gaps_in_the_table(spark, tmp_path):
    plain = gzip.decompress(warc.record(7, "http://a/7", b"hello", hashlib.sha256(b"hello").hexdigest(), None))
    path = tmp_path / "b.warc"
    path.write_bytes(plain + b"garbage\n" + plain.replace(b"hello", b"hullo") + plain)
    rows = warc.read_archives(spark, spark.createDataFrame([(str(path),)], "path string")).orderBy("start").collect()
    assert [(r.gap, r.page_id, bytes(r.payload or b"")) for r in rows] == [(False, 7, b"hello"), (True, None, b""), (False, 7, b"hello")]
    assert rows[1].end - rows[1].start == len(plain) + len(b"garbage\n")


def test_long_urls(spark, tmp_path):
    url, html = "http://a/?q=" + "x" * 200_000, "y" * 300
    df = spark.createDataFrame([(1, url, html), (2, url + "2", html), (3, "http://a/3", "z")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in warc.archived(df).collect()) == [(1, 300, "response"), (2, 300, "revisit"), (3, 1, "response")]
    plain = gzip.decompress(warc.record(7, url, b"hello", hashlib.sha256(b"hello").hexdigest(), None))
    cut_short = b"WARC/1.1\r\nWARC-Target-URI: " + b"x" * 200_000
    path = tmp_path / "c.warc"
    path.write_bytes(plain + cut_short + b"\n" + plain)
    found = parsed(path)
    assert [x[2] and x[2]["warc-target-uri"] for x in found] == [url, None, url]
    assert found[1][:2] == (len(plain), len(plain) + len(cut_short) + 1)


def test_lost_records_raise(spark, tmp_path):
    _, df = pages(spark)
    written = warc.write_archives(df, str(tmp_path / "a"))
    found = warc.read_archives(spark, written)
    assert warc.read_back(found, written, str(tmp_path / "g")).count() == df.count()
    with pytest.raises(ValueError, match="of"):
        warc.read_back(found.filter("page_id <> 4 OR page_id IS NULL"), written, str(tmp_path / "g"))


def test_damaged_archives_through_spark(spark, tmp_path):
    """Archives of 300 pages; one has junk between members, so that all records are read and the gap is logged; then one loses a member."""
    html = [f"<p>{i}</p>" * 50 for i in range(300)]
    df = spark.createDataFrame([(i, f"http://a/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(5)
    written = warc.write_archives(df, str(tmp_path / "a"))
    assert written.count() == 5 and warc.read_archives(spark, written).rdd.getNumPartitions() == 20
    path = written.first()["path"].removeprefix("file:").replace("//", "/")
    with open(path, "rb") as f:
        data = f.read()
    at = data.index(warc.GZIP, len(data) // 2)
    with open(path, "wb") as f:
        f.write(data[:at] + b"junk" * 25 + data[at:])
    rows = warc.read_back(warc.read_archives(spark, written), written, str(tmp_path / "g")).collect()
    assert len(rows) == 300 and {r.gap_bytes for r in rows} == {0, 100}
    logged = spark.read.parquet(str(tmp_path / "g")).collect()
    assert [(r.start, r.end) for r in logged] == [(at, at + 100)]
    with open(path, "wb") as f:
        f.write(data[:at] + data[at + 40 :])
    with pytest.raises(ValueError, match="299 of 300|59 of 60"):
        warc.read_back(warc.read_archives(spark, written), written, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 1


def test_paths_without_a_scheme_are_sparks(spark, tmp_path):
    assert qualified(spark, str(tmp_path)).startswith("file:/")
    _, df = pages(spark)
    written = warc.write_archives(df, str(tmp_path / "b"))
    assert written.first()["path"].startswith("file:/")
    assert spark.read.format("binaryFile").load([r.path for r in written.collect()]).count() == written.count()


def test_very_long_payload(spark):
    html = "漢字 " * 3_000_000
    r = warc.archived(spark.createDataFrame([(1, "u", html), (2, "v", html)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(x.payload_bytes, x.record_type) for x in r] == [(len(html.encode()), "response"), (len(html.encode()), "revisit")]
    assert r[0].payload_digest == r[1].payload_digest == hashlib.sha256(html.encode()).hexdigest()
