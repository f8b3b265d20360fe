"""Legacy archives: ARC files to WARC files, both written and read by Spark.

ARC record heads are one line of space-separated fields, five in version 1 (URL IP date type length) and ten in version 2
(URL IP date type result-code checksum location offset filename length); the last field is the declared length of the
body that follows. A file's first record (filedesc://) names the version. Bodies are HTTP responses. Each record becomes a
WARC record with a name-based UUID (of archive and place), an ISO timestamp, a type and the SHA-1 digest of its payload;
a payload that a record with a larger page id has too becomes a revisit that names that record.

Archives are gzip files of one member a record, as both formats ask for, rolled over at ``MAX_BYTES``; a task holds one
file and one record of it. They are read by declared lengths, never by searching for separators. Writers put files into a
staging folder and the driver moves those of successful tasks into place, so lost or repeated tasks leave nothing behind.

The registered query writes every page into ARC files of both versions, converts these, and reads the WARC files back.

Defined cases: an empty table writes no file and gives an empty table; a null html has an empty payload; a null url is
``-``; a null page_id is written as an empty field and read back as null, and is never the page that others revisit;
repeated rows are records of their own, and of equal payloads all rows with the largest page_id are responses. Heads that
are no UTF-8 are read as Latin-1; dates of 4 to 14 digits are filled up from the left of the calendar. A malformed head or
a length that does not fit raises ValueError. Columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from eventloom.sources.files import resolve

from .common import bounded, cut, maybe_among, new_path, table

V1 = ("url", "ip", "date", "content_type", "length")
V2 = ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length")
MIN_REVISIT = 1000
#: Compressed bytes after which an archive is closed.
MAX_BYTES = 8 << 20
#: Speed over size: archives are written once and read once here.
LEVEL = 1
# The version blocks of ARC files.
V1_BLOCK = "1 0 eventloom\nURL IP-address Archive-date Content-type Archive-length\n"
V2_BLOCK = "2 0 eventloom\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"


# ARC


def _text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def parse_arc(raw: bytes, version: int | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """Heads and bodies of an ARC file or a part of one, the filedesc record among them; it names the version of the rest."""
    at = 0
    while at < len(raw):
        if raw[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError("ARC head without end")
        line = _text(raw[at:end]).rstrip("\r")
        desc = line.startswith("filedesc://")
        # a URL may hold blanks: fields are counted from the right. A version block's own head has five or ten
        names = {1: V1, 2: V2}.get(0 if desc else version or 0) or {5: V1, 10: V2}.get(len(line.split(" ")), V1)
        fields = line.rsplit(" ", len(names) - 1)
        if len(fields) != len(names):
            raise ValueError(f"ARC head with {len(fields)} fields")
        head = dict(zip(names, fields, strict=True))
        if not head["length"].isdigit() or end + 1 + int(head["length"]) > len(raw):
            raise ValueError(f"ARC length {head['length']} does not fit")
        body = raw[end + 1 : (at := end + 1 + int(head["length"]))]
        if desc:
            version = int(body[:1]) if body[:1] in (b"1", b"2") else 1
        yield head | {"version": str(version or (2 if names is V2 else 1))}, body


def members(raw: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The gzip members of a file one by one; a file that is no gzip is one piece."""
    if raw[:2] != b"\x1f\x8b":
        if raw:
            yield raw
        return
    view, at = memoryview(raw), 0
    while at < len(raw):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(raw):
                raise ValueError("the archive ends within a member")
            parts.append(d.decompress(view[at : at + step]))
            at = min(len(raw), at + step)
        at -= len(d.unused_data)
        yield b"".join(parts)


def arc_file(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a whole ARC file but its filedesc, compressed by records, at once or not at all."""
    version = None
    for part in members(raw):
        for head, body in parse_arc(part, version):
            version = int(head["version"])
            if not head["url"].startswith("filedesc://"):
                yield head, body


def arc_record(version: int, url: str, date: str, body: bytes, name: str = "-") -> bytes:
    url = "".join("%20" if c.isspace() or c < " " else c for c in url) or "-"
    more = f" 200 - - 0 {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} text/html{more} {len(body)}\n".encode() + body + b"\n"


def arc_filedesc(version: int, name: str, date: str) -> bytes:
    block = (V1_BLOCK if version == 1 else V2_BLOCK).encode()
    more = " 200 - - 0 -" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(block)}\n".encode() + block + b"\n"


def http(payload: bytes, page_id: int | None) -> bytes:
    """The HTTP response that an archive keeps."""
    return f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def payload_of(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(HTTP fields, the HTTP head as it is, payload); a block without an HTTP head is all payload."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return {}, b"", block
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in _text(block[:end]).split("\r\n")[1:])}
    return fields, block[: end + 4], block[end + 4 :]


def iso_date(date: str) -> str:
    """A WARC date of an ARC date, 4 to 14 digits."""
    if not (date.isdigit() and 4 <= len(date) <= 14 and len(date) % 2 == 0):
        raise ValueError(f"ARC date {date!r}")
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


# WARC


def to_warc(record_id: str, url: str, date: str, ip: str, block: bytes, digest: str, size: int, page_id: int | None, original: tuple[int, str, str, str] | None) -> bytes:
    """A WARC record. With ``original`` (page id, record id, url, date) it is a revisit: the block ends before the payload."""
    lines = ["WARC/1.0", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {iso_date(date)}", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if original is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <{original[1]}>", f"WARC-Refers-To-Target-URI: {original[2]}", f"WARC-Refers-To-Date: {iso_date(original[3])}", f"X-Refers-To-Page: {original[0]}"]
        block = block[: len(block) - size]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n"


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        lines = _text(raw[at:end]).split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC head at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        body = raw[end + 4 : end + 4 + int(head["content-length"])]
        at = end + 4 + len(body)
        if raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is longer than declared")
        yield head, body
        at += 4


# files


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    """Records (``record binary``) to gzip files of one member each. Options: path, suffix, head (the first record, hex)."""

    def __init__(self, options):
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", "warc.gz")
        self.head = bytes.fromhex(options.get("head", ""))
        self.max_bytes, self.staging = int(options.get("maxbytes", MAX_BYTES)), f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = resolve(self.path)
        fs.create_dir(f"{root}/{self.staging}", recursive=True)
        files: list[str] = []
        out, size = None, 0

        def put(record: bytes) -> int:
            c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            raw = c.compress(record) + c.flush()
            out.write(raw)
            return len(raw)

        for batch in iterator:
            for one in batch.column(0):
                if out is None or size >= self.max_bytes:
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.{self.suffix}")
                    out, size = fs.open_output_stream(f"{root}/{self.staging}/{files[-1]}", compression=None), 0
                    if self.head:
                        size += put(self.head)
                size += put(one.as_buffer().to_pybytes())
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = resolve(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            for name in m.files if m else []:
                fs.move(f"{root}/{self.staging}/{name}", f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, root = resolve(self.path)
        if fs.get_file_info(f"{root}/{self.staging}").type == FileType.Directory:
            fs.delete_dir(f"{root}/{self.staging}")


class ArchiveSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "webarchive"

    def schema(self) -> str:
        return "record binary"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options)


def write_records(records: DataFrame, path: str, suffix: str, head: bytes = b"", max_bytes: int = MAX_BYTES) -> None:
    """(record binary) to files in ``path``."""
    records.sparkSession.dataSource.register(ArchiveSink)
    records.select("record").write.format("webarchive").mode("append").options(suffix=suffix, head=head.hex(), maxbytes=max_bytes).save(path)


def _rows(df: DataFrame, one: object, schema: str, most: int = 256) -> DataFrame:
    """Rows that ``one`` makes of each input row, in batches of ``most``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                for row in one(*(c[i] for c in batch.columns)):
                    rows.append(row)
                    if len(rows) == most:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return bounded(df).mapInArrow(run, schema)


def write_arc(pages: DataFrame, path: str, version: int, max_bytes: int = MAX_BYTES) -> None:
    """Pages (page_id, url, html) to ARC files of one version."""

    def one(page_id, url, html, date) -> Iterator[tuple[bytes]]:
        yield (arc_record(version, url.as_py() or "-", date.as_py(), http((html.as_py() or "").encode("utf-8"), page_id.as_py())),)

    when = F.date_format(F.timestamp_seconds(F.lit(946684800) + F.coalesce(F.col("page_id"), F.lit(0)) % 500_000_000), "yyyyMMddHHmmss")
    write_records(_rows(pages.select("page_id", "url", "html", when), one, "record binary"), path, "arc.gz", arc_filedesc(version, "pages.arc", "20000101000000"), max_bytes)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length long, content binary").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str, pattern: str = "*.arc*") -> DataFrame:
    """(record_id, page_id, url, ip, date, version, block, digest, size): the records of all ARC files in ``path``.

    digest and size are of the payload, the part of the block behind its HTTP head.
    """

    def one(name, content) -> Iterator[tuple]:
        file = name.as_py().rsplit("/", 1)[-1]
        for i, (head, block) in enumerate(arc_file(content.as_buffer().to_pybytes())):
            fields, _, payload = payload_of(block)
            record = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{i}')}"
            page = fields.get("x-page-id", "")
            yield record, int(page) if page.lstrip("-").isdigit() else None, head["url"], head["ip"], head["date"], int(head["version"]), block, hashlib.sha1(payload).hexdigest(), len(payload)

    return _rows(_files(spark, path, pattern), one, "record_id string, page_id long, url string, ip string, date string, version int, block binary, digest string, size long")


def revisits(records: DataFrame) -> DataFrame:
    """(own, original) for records whose payload of MIN_REVISIT bytes or more a record with a larger page id has too.

    ``original`` is of the largest page id; equal payloads are told by digest and length.
    """
    big = records.where(F.col("size") >= MIN_REVISIT).select("digest", "size", "record_id", "page_id", F.struct("page_id", "record_id", "url", "date").alias("o"))
    top = big.groupBy("digest", "size").agg(F.max("o").alias("original"), F.count(F.lit(1)).alias("c")).where("c > 1 and original.page_id is not null").drop("c")
    return big.join(top, ["digest", "size"]).where("page_id is null or page_id <> original.page_id").select(F.col("record_id").alias("own"), "original")


def convert(records: DataFrame, path: str, max_bytes: int = MAX_BYTES) -> None:
    """Records of ``read_arc`` to WARC files."""

    def one(record_id, page_id, url, ip, date, block, digest, size, original) -> Iterator[tuple[bytes]]:
        o = original.as_py()
        yield (to_warc(record_id.as_py(), url.as_py(), date.as_py(), ip.as_py(), block.as_buffer().to_pybytes(), digest.as_py(), size.as_py(), page_id.as_py(), o and (o["page_id"], o["record_id"], o["url"], o["date"])),)

    again = cut(revisits(records), "revisits")
    # records that are certainly no revisit needn't be shuffled to the join
    flagged = maybe_among(records, F.xxhash64("record_id"), again.select(F.xxhash64("own").alias("k")), "maybe")
    plain = flagged.where(~F.col("maybe")).drop("maybe").withColumn("original", F.lit(None).cast(again.schema["original"].dataType))
    joined = flagged.where("maybe").drop("maybe").join(again, F.col("record_id") == F.col("own"), "left").drop("own").unionByName(plain)
    names = ("record_id", "page_id", "url", "ip", "date", "block", "digest", "size", "original")
    write_records(_rows(joined.select(*names), one, "record binary"), path, "warc.gz", b"", max_bytes)


def read_warc(spark: SparkSession, path: str, pattern: str = "*.warc*") -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest as declared, record_id, refers_to_id, and payload (null
    for a revisit)."""

    def one(name, content) -> Iterator[tuple]:
        for part in members(content.as_buffer().to_pybytes()):
            for head, block in parse_warc(part):
                number = lambda k, h=head: int(h[k]) if h.get(k) else None
                again = head["warc-type"] == "revisit"
                yield number("x-page-id"), head["warc-type"], number("x-refers-to-page"), number("x-payload-length"), head["warc-payload-digest"].removeprefix("sha1:"), head["warc-record-id"].strip("<>"), head.get("warc-refers-to", "").strip("<>") or None, None if again else payload_of(block)[2]

    return _rows(_files(spark, path, pattern), one, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, record_id string, refers_to_id string, payload binary")


def archive(pages: DataFrame, path: str, max_bytes: int = MAX_BYTES) -> None:
    """Pages (page_id, url, html) into ARC files of both versions in ``path``/arc, and these into WARC files in ``path``/warc."""
    even = F.coalesce(F.pmod("page_id", F.lit(2)) == 0, F.lit(True))
    for version, part in ((1, pages.where(even)), (2, pages.where(~even))):
        write_arc(part, f"{path}/arc", version, max_bytes)
    convert(read_arc(pages.sparkSession, f"{path}/arc"), f"{path}/warc", max_bytes)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    # What is stored is measured again; a revisit has what its record declares.
    return read_warc(spark, f"{path}/warc").select(
        "page_id", F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


ORACLE_OP4 = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""
