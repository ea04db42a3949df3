"""Legacy web archives (ARC 1 and 2) and their conversion to WARC 1.1.

An archive is one row of a table: its name and its bytes, about ``SEGMENT_BYTES`` of them, so that no
task holds more than one archive and one record.  Everything is read back by parsing header lines
and declared lengths; nothing is found by searching for delimiters.

The converter synthesises what ARC doesn't have: record ids, ISO timestamps, record types, block and
payload digests.  Records that carry a page id get an id from which it can be read again; others get
one derived from archive, offset and address.  So a rerun writes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import HOT_SHARE, bound_batches, join_hot, keep

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER = b"X-Page-Id: "
SEGMENT_BYTES, MIN_REVISIT_BYTES = 8 << 20, 1000
DATE = "20000101000000"  # what the pages table doesn't have
ARCHIVES = "archive string, version int, content binary"
RECORDS = "page_id long, archive string, arc_offset long, url string, ip string, archive_date string, mime string, is_http boolean, payload_digest string, payload_bytes long, block binary"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, record_date string, record_id string"


def _address(url: str | None, page_id: int | None) -> str:
    """An address without the white space that separates header fields."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else f"page:{'' if page_id is None else page_id}"


def http_block(payload: bytes, page_id: int | None) -> bytes:
    own = b"" if page_id is None else PAGE_HEADER + str(page_id).encode() + b"\r\n"
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload


def arc_head(name: str, version: int, date: str = DATE) -> bytes:
    """The version block that opens an archive."""
    body = f"{version} 0 turnstone\n{ARC_FIELDS[version]}\n\n".encode()
    rest = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{rest} {len(body)}\n".encode() + body


def arc_record(version: int, url: str, block: bytes, offset: int, name: str, date: str = DATE, ip: str = "0.0.0.0", mime: str = "text/html") -> bytes:
    rest = "" if version == 1 else f" 200 {hashlib.md5(block).hexdigest()} - {offset} {name}"
    return f"{url} {ip} {date} {mime}{rest} {len(block)}\n".encode() + block + b"\n"


def parse_arc(content: bytes):
    """(offset, fields, block) of each record, the version block first; fields by name."""
    at, names, first = 0, None, True
    while at < len(content):
        end = content.find(b"\n", at)
        if end == at:  # the line end between records
            at += 1
            continue
        if end < 0:
            raise ValueError("a header line is cut off")
        values = content[at:end].decode("utf-8", "replace").split(" ")
        block = content[end + 1 : end + 1 + int(values[-1])]
        if len(block) != int(values[-1]):
            raise ValueError("a record is shorter than its header says")
        if first:
            lines = block.decode("utf-8", "replace").split("\n")
            version = int(lines[0].split(" ")[0])
            if version not in ARC_FIELDS or not values[0].startswith("filedesc://"):
                raise ValueError("not an archive of version 1 or 2")
            names = ARC_FIELDS[version].split(" ")
        # a mime type or location may hold spaces: fields are counted from both ends
        if len(values) > len(names):
            values = values[:3] + [" ".join(values[3 : len(values) - len(names) + 4])] + values[len(values) - len(names) + 4 :]
        if len(values) != len(names):
            raise ValueError(f"a header line has {len(values)} of {len(names)} fields")
        yield at, dict(zip(names, values)), block
        at, first = end + 1 + len(block), False


def split_http(block: bytes) -> tuple[dict[bytes, bytes] | None, bytes, bytes]:
    """(headers, head, payload); headers None if the block isn't an HTTP response."""
    cut = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or cut < 0:
        return None, b"", block
    lines = (line.partition(b":") for line in block[:cut].split(b"\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in lines}, block[: cut + 4], block[cut + 4 :]


def page_record_id(page_id: int, digest: str) -> str:
    """A UUID (version 8) that holds a page id: 48 bits of the digest, then the id."""
    value = page_id & (1 << 64) - 1
    number = (int(digest[:12], 16) << 80) | (8 << 76) | ((value >> 62) << 64) | (2 << 62) | (value & (1 << 62) - 1)
    return f"urn:uuid:{uuid.UUID(int=number)}"


def page_of(record_id: str) -> int:
    number = uuid.UUID(record_id.removeprefix("urn:uuid:")).int
    value = ((number >> 64 & 3) << 62) | number & (1 << 62) - 1
    return value - (1 << 64) if value >> 63 else value


def iso_date(date: str) -> str:
    """The ISO form of a 14-digit date; missing digits count as the start of the period."""
    digits = re.sub(r"\D", "", date)[:14]
    digits += "19700101000000"[len(digits) :]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(kind: str, record_id: str, date: str, block: bytes, **fields: str) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, **{k.replace("_", "-"): v for k, v in fields.items()}, "WARC-Block-Digest": _sha1(block), "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_warc(content: bytes):
    """(headers, block) of each record, by declared lengths; the block digest is tested."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or content[at : at + 5] != b"WARC/":
            raise ValueError("not a record")
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(head["content-length"])
        block = content[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        if at > len(content) or content[at - 4 : at] != b"\r\n\r\n" or head.get("warc-block-digest", _sha1(block)) != _sha1(block):
            raise ValueError("a record is damaged")
        yield head, block


def write_arcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Pages as legacy archives, of version 1 and 2 in turn.

    A null html is an empty payload, a null url gets one made from the id, a null id isn't written; no pages give
    no archives; other columns are not read.
    """
    bound_batches(pages.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        task, segment, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def opened():
            name = f"pages-{task:06d}-{segment:05d}.arc"
            version = 1 + (task + segment) % 2
            return name, version, arc_head(name, version)

        name, version, head = opened()
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not parts:
                    name, version, head = opened()
                    parts, size = [head], len(head)
                parts.append(arc_record(version, _address(url, page_id), http_block((html or "").encode(), page_id), size, name))
                size += len(parts[-1])
                if size >= segment_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([version], pa.int32()), pa.array([b"".join(parts)], pa.binary())], names=["archive", "version", "content"])
                    parts, segment = [], segment + 1
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([version], pa.int32()), pa.array([b"".join(parts)], pa.binary())], names=["archive", "version", "content"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, ARCHIVES)


def read_arcs(arcs: DataFrame, with_block: bool = True) -> DataFrame:
    """Records of legacy archives; version blocks are read, not returned.  A record without a page id has none (null)."""

    def run(batches):
        names = [x.split(" ")[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                for offset, fields, block in parse_arc(content):
                    if fields["URL"].startswith("filedesc://"):
                        continue
                    headers, _, payload = split_http(block)
                    own = headers.get(b"x-page-id") if headers else None
                    rows.append((None if own is None else int(own), archive, offset, fields["URL"], fields["IP-address"], fields["Archive-date"], fields["Content-type"], headers is not None, hashlib.sha1(payload).hexdigest(), len(payload), block if with_block else None))
                    held += len(block)
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return arcs.select("archive", "content").mapInArrow(run, RECORDS)


def revisits(index: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the records that revisit another.

    Of equal payloads of at least ``min_bytes`` bytes the largest page id is the response.  Frequent
    payloads are at most 1/HOT_SHARE many; their records meet the response's id by broadcast.
    """
    large, total = index.where(F.col("payload_bytes") >= min_bytes), index.count()
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    groups = keep(groups, "payload-groups", total)
    hot = [r.payload_digest for r in groups.where(F.col("n") > HOT_SHARE * total).select("payload_digest").collect()]
    members = join_hot(large.select("page_id", "payload_digest"), groups.select("payload_digest", "refers_to"), "payload_digest", hot, "inner")
    return keep(members.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct(), "revisits", total)


def write_warcs(records: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """ARC records, with a ``refers_to`` column, as WARC archives; each starts with a warcinfo record.

    A null ``refers_to`` makes a response; a null page id is named by its place; no records give no archives.
    """
    columns = ["page_id", "archive", "arc_offset", "url", "ip", "archive_date", "mime", "is_http", "payload_digest", "block", "refers_to"]
    bound_batches(records.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        task, segment, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{task:06d}-{segment:05d}.warc"]), pa.array([1], pa.int32()), pa.array([b"".join(parts)], pa.binary())], names=["archive", "version", "content"])

        for batch in batches:
            for page_id, archive, offset, url, ip, date, mime, is_http, digest, block, refers_to in zip(*(batch.column(k).to_pylist() for k in range(11))):
                when = iso_date(date)
                if not parts:
                    name = f"pages-{task:06d}-{segment:05d}.warc"
                    parts.append(warc_record("warcinfo", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", when, b"software: turnstone\r\nformat: WARC File Format 1.1\r\n", WARC_Filename=name, Content_Type="application/warc-fields"))
                    size = len(parts[0])
                record_id = page_record_id(page_id, digest) if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}@{offset}:{url}')}"
                common = {"WARC_Target_URI": url, "WARC_IP_Address": ip, "WARC_Payload_Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()}
                if not is_http:
                    parts.append(warc_record("resource", record_id, when, block, Content_Type=mime, **common))
                elif refers_to is None:
                    parts.append(warc_record("response", record_id, when, block, Content_Type="application/http; msgtype=response", **common))
                else:
                    head = split_http(block)[1]
                    parts.append(warc_record("revisit", record_id, when, head, Content_Type="application/http; msgtype=response", WARC_Profile=REVISIT_PROFILE, WARC_Refers_To=f"<{page_record_id(refers_to, digest)}>", **common))
                size += len(parts[-1])
                if size >= segment_bytes:
                    yield done()
                    parts, segment = [], segment + 1
        if parts:
            yield done()

    return records.select(*columns).mapInArrow(run, ARCHIVES)


def read_warcs(warcs: DataFrame) -> DataFrame:
    """One row for each response, resource or revisit record; payload digests are tested, another one raises."""

    def run(batches):
        names = [x.split(" ")[0] for x in READ.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = []
                for head, block in parse_warc(content):
                    kind = head["warc-type"]
                    if kind not in ("response", "revisit", "resource"):
                        continue
                    headers, _, payload = split_http(block)
                    own = headers.get(b"x-page-id") if headers else None
                    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    size = len(payload)
                    if kind == "revisit":
                        size = int(headers[b"content-length"])
                    elif hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError("a payload doesn't have its digest")
                    refers = head.get("warc-refers-to")
                    rows.append((None if own is None else int(own), size, digest, kind, page_of(refers.strip("<>")) if refers else None, head["warc-target-uri"], head["warc-date"], head["warc-record-id"].strip("<>")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return warcs.select("content").mapInArrow(run, READ)


def convert_arcs(arcs: DataFrame) -> DataFrame:
    """Stored legacy archives to WARC archives; later copies of a payload become revisits.

    Records without a page id revisit by digest alone and are never referred to; archives without records, and an
    empty table, give no archives.
    """
    index = keep(read_arcs(arcs, with_block=False).select("page_id", "payload_digest", "payload_bytes"), "arc-index")
    links = revisits(index)
    records = read_arcs(arcs)
    # a page id is nearly unique, so no value is frequent
    key = F.concat_ws(":", F.col("page_id").cast("string"), "payload_digest")
    right = links.where("page_id is not null").select(key.alias("k"), "refers_to")
    joined = records.where("page_id is not null").withColumn("k", key).join(right, "k", "left").drop("k")
    nameless = index.where("page_id is null")
    total = nameless.count()
    if total:  # these may all be copies of one page
        hot = [r.payload_digest for r in nameless.groupBy("payload_digest").count().where(F.col("count") > max(1.0, HOT_SHARE * total)).collect()] if total > 1 / HOT_SHARE else []
        lone = links.where("page_id is null").select("payload_digest", "refers_to")
        joined = joined.unionByName(join_hot(records.where("page_id is null"), lone, "payload_digest", hot))
    return write_warcs(joined)


def page_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as legacy archives, convert them to WARC, read the WARC archives back.

    A null html counts as empty.  Rows of equal id and payload are all responses if theirs is the
    largest id; a null id counts as the smallest and is never referred to; a null url gets one made
    from the id.  Other columns are not read, an empty table gives an empty one.
    """
    arcs = keep(write_arcs(pages, id_col, url_col, html_col), "arcs")
    warcs = keep(convert_arcs(arcs), "warcs")
    return read_warcs(warcs)
