import hashlib
import time

from loreforge.llm import common, warc


def test_records_survive_magic_in_payloads(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    page = "<p>" + "long page " * 40 + "</p>"
    rows = [(1, "http://a/\r\nX: y", page, "u"), (2, None, page, "v"), (3, "http://c", "tiny", None), (4, "http://d", "tiny", None), (5, "http://e", None, None), (6, "u", fake * 5 + "x" * 300, None), (7, "u", "é" * 3000 + fake, None), (8, "u", page, None), (None, "u", page, None), (9, "u", "WARC/1.1\r\n" * 50, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    path = common.shared_path(spark, "test-warc")
    warc.write_archives(pages.coalesce(1), path)
    found = common.settled(warc.candidates(spark, path, stretch=600), "test")
    assert found.count() > len(rows)  # records within payloads are candidates
    got = {r.page_id: r for r in warc.verified(found).collect()}
    assert len(got) == len(rows) and 77 not in got
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        again = html == page and page_id != 1
        assert (r.record_type, r.refers_to) == (("revisit", 1) if again else ("response", None))


def test_nested_records_with_one_end(spark):
    """A payload full of records that end where it ends, in stretches that begin within it."""
    inner, size = ["x" * 20], 20
    for k in range(300):
        inner.append(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{1000 + k}>\r\nContent-Length: {size}\r\n\r\n")
        size += len(inner[-1])
    html = "".join(reversed(inner))
    rows = [(1, "u", "first"), (2, "u", html), (3, "u", "y" * 500), (4, "u", html + "z"), (5, "u", "last")]
    path = common.shared_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = {r.page_id: r for r in warc.verified(common.settled(warc.candidates(spark, path, stretch=3000), "test")).collect()}
    assert {k: (r.payload_bytes, r.payload_digest) for k, r in got.items()} == {k: (len(h), hashlib.sha256(h.encode()).hexdigest()) for k, _, h in rows}


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, "u", "z" * 200)] * 2 + [(6, "u", "z" * 200)]
    path = common.shared_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.read_archives(spark, path).select("page_id", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == [(5, "response", None), (5, "response", None), (6, "revisit", 5)]
    path = common.shared_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_broken_chain_keeps_what_comes_before(spark):
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bad = b"WARC/1.1\r\nContent-Length: 999999\r\n\r\nabc\r\n\r\n"
    rows, _ = warc._stretch(one + bad + one, 0, 1000)
    assert [r[0] for r in rows] == [0, len(one) + len(bad)]
    assert rows[0][1] == -1


def test_no_payload_breaks_the_reader(spark):
    """Bad lengths, ids beyond 64 bits, numbers of thousands of digits, endless heads: candidates or none, never an error."""
    head = "WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Payload-Length: {size}\r\nContent-Length: {length}\r\n\r\nabcd\r\n\r\n"
    bad = [dict(size="abc"), dict(page="9" * 30), dict(length="9" * 5000), dict(size="9" * 5000), dict(length="-4"), dict(size=""), dict(page="x", kind="revisit"), dict(length="²")]
    html = [head.format(**({"kind": "response", "page": 7, "size": 4, "length": 4} | b)) * 3 + f"page {i}" for i, b in enumerate(bad)]
    html += ["WARC/1.1\r\n" + "A: b\r\n" * 200, "WARC/1.1\r\n\r\n", "WARC/1.1\r\nContent-Length: 4\r\n", "\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    path = common.shared_path(spark, "test-warc")
    warc.write_archives(pages.coalesce(1), path)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert set(got) == set(range(len(html)))
    assert all(got[i].payload_digest == hashlib.sha256(h.encode()).hexdigest() for i, h in enumerate(html))


def test_work_is_in_proportion_to_repeated_magic():
    def seconds(data):
        began = time.perf_counter()
        warc._stretch(data, 0, len(data))
        return time.perf_counter() - began

    def nested(count):  # records one in the other, all with the same end
        data = b"x" * 20 + b"\r\n\r\n"
        parts, size = [data], len(data)
        for k in range(count):
            head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n" % (k, size - 4)
            parts.append(head)
            size += len(head)
        return b"".join(reversed(parts))

    assert len(warc._stretch(nested(100), 0, 1 << 20)[0]) == 100
    assert seconds(nested(80_000)) < 24 * seconds(nested(10_000)) + 0.5  # 8 MB
    for piece in (b"WARC/1.1\r\n", b"A: WARC/1.1\r\n", b"WARC/1.1\r\nA: b\r\n"):
        small, large = seconds(piece * 5_000), seconds(piece * 40_000)
        assert large < 24 * small + 0.5, piece


def test_files_are_bounded_and_shared_payloads_found_over_them(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "SLOTS", 4)  # slots of shared digests hold others too
    rows = [(i, "u", f"{i % 60 if i % 2 else i:05d}" * 30) for i in range(300)]
    path = common.shared_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    assert spark.read.format("binaryFile").load(path).count() > 4
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    got = {r.page_id: r.refers_to for r in warc.read_archives(spark, path).collect()}
    assert got == {i: (first[h] if first[h] != i else None) for i, _, h in rows}
