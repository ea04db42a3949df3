"""Archives: round trips, versions, revisits."""

import base64
from collections import Counter
import hashlib

import pytest

from turnstone.llm import archives


def brute_force(rows, least=1000):
    best = {}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= least and page_id is not None:
            best[payload] = max(best.get(payload, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        rep = best.get(payload)
        revisit = rep is not None and rep != page_id
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", rep if revisit else None))
    return out


def key(row):
    return repr(tuple(row))


ROWS = [
    (1, "http://a.example/x y\n", "é" * 700), (2, None, "é" * 700), (3, "http://b.example", None), (4, "", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", "x" * 1000), (8, "u", "x" * 1000),
    (-9, "u", "x" * 1000), (8, "u", "x" * 1000), (None, "u", "x" * 1000), (None, "w", "lonely"), (10, "u", "HTTP/1.1 200 OK\r\n\r\n WARC/1.1\r\n" * 80), (11, "u", "\r\n\r\n" * 500), (2**62 + 5, "big", "z" * 2000), (-(2**63), "least", "z" * 2000),
]


def test_pages_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, record_type string").repartition(3)
    found = archives.page_archives(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(key, found)) == sorted(map(key, brute_force(ROWS)))
    assert archives.page_archives(pages.limit(0)).count() == 0


def test_a_group_with_most_rows(spark):
    rows = [(k, "u", "hot" * 500 if k % 3 else f"own{k}" * 300) for k in range(3000)]
    found = archives.page_archives(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(key, found)) == sorted(map(key, brute_force(rows)))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    content = archives.arc_head("n.arc", version)
    blocks = [b"HTTP/1.0 404 Not Found\r\nA: b\r\n\r\nbody\n\n", b"", b"plain bytes"]
    for block in blocks:
        content += archives.arc_record(version, "http://x/", block, len(content), "n.arc", mime="text/html; charset=x" if version == 1 else "text/html")
    found = list(archives.parse_arc(content))
    assert [b for _, _, b in found[1:]] == blocks and found[0][1]["URL"] == "filedesc://n.arc"
    assert set(found[1][1]) == set(archives.ARC_FIELDS[version].split(" "))
    with pytest.raises(ValueError):
        list(archives.parse_arc(content[:-5]))
    with pytest.raises(ValueError):
        list(archives.parse_arc(content.replace(f"\n{version} 0".encode(), b"\n7 0")))


def test_conversion_of_foreign_records(spark):
    content = archives.arc_head("f.arc", 1)
    content += archives.arc_record(1, "http://x/", b"HTTP/1.0 200 OK\r\n\r\nhello", len(content), "f.arc", date="199609231421")
    content += archives.arc_record(1, "dns:x", b"1.2.3.4", len(content), "f.arc", mime="text/dns")
    arcs = spark.createDataFrame([("f.arc", 1, bytearray(content))], archives.ARCHIVES)
    warcs = archives.convert_arcs(arcs).collect()
    records = [r for w in warcs for r in archives.parse_warc(w.content)]
    kinds = sorted(h["warc-type"] for h, _ in records)
    assert kinds == ["resource", "response", "warcinfo"]
    head = next(h for h, _ in records if h["warc-type"] == "response")
    assert head["warc-date"] == "1996-09-23T14:21:00Z" and head["warc-target-uri"] == "http://x/"
    assert head["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"hello").digest()).decode()


def test_damage_is_noticed():
    record = archives.warc_record("response", "urn:uuid:x", "2000-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\n\r\nabc")
    assert len(list(archives.parse_warc(record * 3))) == 3
    for bad in (record.replace(b"abc", b"abd"), record[:-3], b"x" + record):
        with pytest.raises(ValueError):
            list(archives.parse_warc(bad))


def test_page_ids_in_record_ids():
    for page in (0, 1, -1, 2**63 - 1, -(2**63), 2**62, 12345678901234):
        assert archives.page_of(archives.page_record_id(page, "ab" * 20)) == page


def test_copies_without_ids_revisit_by_digest(spark):
    """Thousands of copies under null ids, beside some with ids and some that nobody names."""
    big, other = "x" * 1200, "y" * 1500
    rows = [(None, None, big)] * 3000 + [(4, "http://a/", big), (9, "http://b/", big), (None, None, other), (None, None, other), (5, None, None), (None, "http://c/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = archives.page_archives(pages).collect()
    kinds = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found)
    assert kinds == Counter({(None, 1200, "revisit", 9): 3000, (4, 1200, "revisit", 9): 1, (9, 1200, "response", None): 1, (None, 1500, "response", None): 2, (5, 0, "response", None): 1, (None, 0, "response", None): 1})


def test_conversion_of_nothing(spark):
    assert archives.convert_arcs(spark.createDataFrame([], archives.ARCHIVES)).count() == 0
    only_head = spark.createDataFrame([("f.arc", 1, bytearray(archives.arc_head("f.arc", 1)))], archives.ARCHIVES)
    assert archives.convert_arcs(only_head).count() == 0
