"""WARC archives with revisit records and a two-level capture index.

Archives are files of WARC/1.1 records in the shared folder: a response holds an HTTP head and the payload, a revisit the HTTP
head and the record that it repeats. They are written by Spark's own writer, so any store that Spark writes to can hold them.

The index has the reversed-host key of every capture in sorted, compressed blocks; a sparse directory holds the first
and last key of each block. A lookup searches the directory, opens the blocks it names, and reads the record's range; a
reader of all captures opens all blocks and reads the ranges file by file, in parallel.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm.common import fresh_path, identified, staged, table

#: Payloads under this many bytes are always stored in full.
LEAST_REVISIT = 1000
#: Repeated digests (60 bytes each) up to which they are broadcast.
BROADCAST_DIGESTS = 200_000
#: Index lines in a block.
BLOCK = 1000
#: Bytes that an archive file should have.
FILE_BYTES = 16 << 20
#: Bytes that one read of neighbouring ranges should have.
READ_BYTES = 8 << 20
EOL = "\r\n"
VERSION = f"WARC/1.1{EOL}"
#: Address of a record whose page has none.
NO_URL = "about:unknown"
CONTROLS = re.compile(r"[\x00-\x20\x7F]")
#: Bytes that no archive file exceeds (whole files are read when the index is built), unless one record does.
MOST_BYTES = 1 << 30
#: Fixed value of the standard: profile of a revisit that repeats a payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64())])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string())])
CAPTURE = "key string, file string, offset long, length long, page_id long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def planned(pages: DataFrame, least: int = LEAST_REVISIT, few: int = BROADCAST_DIGESTS) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to and the rows of the record that each row becomes and of the one it refers to.

    Of equal payloads of at least ``least`` bytes the largest page_id (null first) is the response; of repeated
    rows with that id one is. Only digests and ids are shuffled for the decision, combined before the shuffle. Up to
    ``few`` repeated digests are broadcast to the pass that writes; more are joined by a shuffle of the pages.
    """
    rows = identified(pages.select("page_id", "url", "html")).select("_rid", "page_id", "url", "html")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = rows.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn("payload_digest", F.sha1(payload))
    facts = rows.where(F.col("payload_bytes") >= least).select("_rid", "page_id", "payload_digest")
    best = staged(facts.groupBy("payload_digest").agg(F.max(F.struct("page_id", "_rid")).alias("_k"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "repeated")
    if best.count() <= few:
        best = F.broadcast(best)
    again = (F.col("payload_bytes") >= least) & F.col("_k").isNotNull() & (F.col("_rid") != F.col("_k._rid"))
    out = rows.join(best, "payload_digest", "left")
    return out.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_k.page_id")).alias("refers_to"), "_rid", F.when(again, F.col("_k._rid")).alias("_refers_rid"))


def _record_id(archive: str, rid: str) -> Column:
    """A record's identifier: a name-based UUID of the archive and the row."""
    digest = F.md5(F.concat_ws("/", F.lit(archive), F.col(f"{rid}.f"), F.col(f"{rid}.i")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-3$3-8$4-$5"), F.lit(">"))


def write_archive(pages: DataFrame, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES, date: str | None = None) -> str:
    """Write one record per row of ``pages`` and return the folder; ``date`` (now, by default) is the date of capture.

    A response holds the payload after an HTTP head. A revisit holds the head alone, the digest and length of the full payload,
    and the record and page it refers to. Line ends in an address are percent-encoded; a page without one gets NO_URL.
    """
    spark, archive = pages.sparkSession, str(uuid.uuid4())
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    total, n, longest = pages.agg(F.sum(F.octet_length("html")), F.count("*"), F.max(F.octet_length(F.concat_ws("", "html", "url")))).first()
    html = F.when(F.col("record_type") == "response", F.coalesce("html", F.lit(""))).otherwise(F.lit(""))
    url = F.coalesce("url", F.lit(NO_URL))
    for c in "\r\n":
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(EOL + EOL))
    stored = F.octet_length(http) + F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    head = F.concat(
        F.lit(VERSION + "WARC-Type: "), F.col("record_type"),
        _header("WARC-Record-ID", _record_id(archive, "_rid")), _header("WARC-Date", F.lit(date)), _header("WARC-Target-URI", url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _header("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit(PROFILE))), _header("WARC-Refers-To", F.when(F.col("record_type") == "revisit", _record_id(archive, "_refers_rid"))),
        _header("X-Page-ID", F.col("page_id")), _header("X-Page-Without-URL", F.when(F.col("url").isNull(), "1")), _header("X-Refers-To-Page-ID", F.col("refers_to")),
        _header("Content-Type", F.lit("application/http; msgtype=response")), _header("Content-Length", stored), F.lit(EOL + EOL),
    )
    path = fresh_path(spark, "warc")
    records = planned(pages, least).select(F.concat(head, http, html).alias("value"))
    records.write.option("lineSep", EOL + EOL).option("maxRecordsPerFile", max(1, min(file_bytes * (n or 1) // max(1, (total or 0) + 700 * (n or 1)), MOST_BYTES // ((longest or 0) + 1000)))).text(path)
    return path


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{EOL}{name}: "), value.cast("string"))).otherwise(F.lit(""))


def parsed(record: bytes) -> dict:
    """Fields of one record. Length and digest of a stored payload are computed again; a record that does not agree with its head raises."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split(EOL)
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split(EOL)[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = lines[0] + EOL == VERSION and rest[len(block) :] == b"\r\n\r\n"
    if not whole or (kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest)) or (kind == "revisit" and payload):
        raise ValueError(f"damaged WARC record {fields.get('WARC-Record-ID')}")
    number = lambda x: int(x) if x is not None else None
    return {"page_id": number(fields.get("X-Page-ID")), "url": None if "X-Page-Without-URL" in fields else fields["WARC-Target-URI"], "record_type": kind, "refers_to": number(fields.get("X-Refers-To-Page-ID")), "payload_bytes": size, "payload_digest": digest, "payload": payload.decode("utf-8", "replace") if kind == "response" else None}


def url_key(url: str | None) -> str:
    """Sort key of an address: host labels reversed, then port, path and query; the scheme, user and fragment do not count.

    An address that cannot be split is its own key. Controls are percent-encoded, so that a key is one field of an index line.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        key = url.lower()
    else:
        default = {"http": 80, "https": 443}.get(parts.scheme)
        key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return CONTROLS.sub(lambda m: f"%{ord(m[0]):02X}", key)


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, file, offset, length and page of each record in a batch of whole files."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            raw, at, rows = content.as_buffer().to_pybytes(), 0, []
            while at < len(raw):
                head = raw.index(b"\r\n\r\n", at)
                fields = dict(line.split(": ", 1) for line in raw[at:head].decode().split(EOL)[1:])
                end = head + 4 + int(fields["Content-Length"]) + 4
                page = fields.get("X-Page-ID")
                rows.append((url_key(fields["WARC-Target-URI"]), path.as_py(), at, end - at, int(page) if page else None))
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 5, _CAPTURE, strict=True)], schema=_CAPTURE)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed blocks of sorted index lines, at most BLOCK lines each."""
    lines: list[tuple[str, str]] = []

    def block():
        body = "\n".join(x for _, x in lines).encode()
        return pa.RecordBatch.from_pydict({"first": [lines[0][0]], "last": [lines[-1][0]], "n": [len(lines)], "block": [zlib.compress(body)]}, schema=pa.schema([("first", pa.string()), ("last", pa.string()), ("n", pa.int64()), ("block", pa.binary())]))

    for batch in batches:
        for r in batch.to_pylist():
            lines.append((r["key"], "\t".join(str(r[k] if r[k] is not None else "") for k in ("key", "file", "offset", "length", "page_id"))))
            if len(lines) == BLOCK:
                yield block()
                lines = []
    if lines:
        yield block()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of index blocks."""
    for batch in batches:
        for block in batch.column("block").to_pylist():
            rows = [x.split("\t") for x in zlib.decompress(block).decode().split("\n")]
            cols = list(zip(*rows, strict=True))
            numbers = [pa.array([int(x) if x else None for x in c], pa.int64()) for c in cols[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), *numbers], schema=_CAPTURE)


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of captures in order of file and offset: neighbouring ranges are one read."""
    store, name, file = None, None, None
    run: list[tuple[int, int]] = []

    def read():
        start = run[0][0]
        data = file.read_at(run[-1][0] + run[-1][1] - start, start)
        rows = [parsed(data[o - start : o - start + n]) for o, n in run]
        run.clear()
        return pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    for batch in batches:
        for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
            if run and (path != name or offset != sum(run[-1]) or offset + length - run[0][0] > READ_BYTES):
                yield read()
            if path != name:
                store, inner = pyarrow.fs.FileSystem.from_uri(path)
                name, file = path, store.open_input_file(inner)
            run.append((offset, length))
    if run:
        yield read()


def read_captures(spark: SparkSession, path: str, index: str) -> DataFrame:
    """The records (RECORD) of all captures in ``index``, read by their ranges; the payload of a revisit is null.

    Captures are dealt to tasks by file, so a file is read once and by one task. Executors read ranges through the file system
    that Arrow has for the address; where it has none, Spark reads the files and the ranges are cut from their content.
    """
    lines = spark.read.parquet(index).select("block").mapInArrow(_unpack, CAPTURE)
    try:
        pyarrow.fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return _cut_ranges(spark, path, lines)
    return lines.repartition(F.col("file")).sortWithinPartitions("file", "offset").mapInArrow(_read_ranges, RECORD)


def _cut_ranges(spark: SparkSession, path: str, lines: DataFrame) -> DataFrame:
    ranges = lines.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("r"))  # at most the records of one file
    cut = F.transform("r", lambda r: F.substring(F.col("content"), (r["offset"] + 1).cast("int"), r["length"].cast("int")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([parsed(x) for x in batch.column("record").to_pylist()], schema=_RECORD)

    return _files(spark, path).join(ranges, F.col("path") == F.col("file")).select(F.explode(cut).alias("record")).mapInArrow(run, RECORD)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def build_index(spark: SparkSession, path: str) -> str:
    """Write the capture index of an archive and return its folder: ``blocks`` (first, last, n, block), sorted by key over all files."""
    lines = staged(_files(spark, path).mapInArrow(_offsets, CAPTURE), "cdx")
    target = fresh_path(spark, "index")
    lines.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset").mapInArrow(_pack, "first string, last string, n long, block binary").write.parquet(target)
    return target


class Captures:
    """Lookups of addresses in an archive by its index.

    The directory (one line per block) is kept sorted on the driver up to ``limit`` blocks; beyond that it is
    searched where it lies, by the key range in the file statistics.
    """

    def __init__(self, spark: SparkSession, index: str, limit: int = 100_000):
        self.spark, self.index = spark, spark.read.parquet(index)
        few = self.index.select("first", "last").limit(limit + 1).collect()
        self.directory = sorted((r["first"], r["last"]) for r in few) if len(few) <= limit else None
        self.firsts = [first for first, _ in self.directory] if self.directory is not None else []

    def lines(self, url: str) -> list[tuple[str, int, int, int | None]]:
        """(file, offset, length, page_id) of every capture of ``url``."""
        key = url_key(url)
        if self.directory is not None:
            i = bisect.bisect_right(self.firsts, key) - 1
            if not any(last >= key for _, last in self.directory[max(0, bisect.bisect_left(self.firsts, key) - 1) : i + 1]):
                return []
        found = []
        for row in self.index.where((F.col("first") <= key) & (F.col("last") >= key)).select("block").toLocalIterator():
            lines = zlib.decompress(row["block"]).decode().split("\n")
            keys = [x.split("\t", 1)[0] for x in lines]
            for x in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                _, file, offset, length, page = x.split("\t")
                found.append((file, int(offset), int(length), int(page) if page else None))
        return found

    def read(self, file: str, offset: int, length: int) -> str:
        """One record, by a range read through the file system that holds it."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(file)
        stream = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(at)
        try:
            stream.seek(offset)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length)).decode()
        finally:
            stream.close()


def op9_warc(spark, sf_dir):
    """Each row is the record that the index's offset and length give. Null and empty html are payloads of no byte; null addresses
    come back null; repeated rows have a record each; of equal payloads that tie on page_id the first row is the response. Very long
    pages are one record and one range. An empty table gives an empty archive and result; extra columns are ignored."""
    path = write_archive(table(spark, sf_dir, "pages"))
    return read_captures(spark, path, build_index(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS k, max(page_id) OVER (PARTITION BY payload_digest) AS m FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k > 1 AND payload_bytes >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k > 1 AND payload_bytes >= 1000 THEN m END AS refers_to
FROM r
"""
