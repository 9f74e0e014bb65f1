"""WARC archives written and read as tables of record-identifier and chunk-number rows."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import shared_path
from lexloom.session import ship_package

MIN_BYTES = 0
CHUNK_BYTES = 1 << 20
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, n_chunks long"


def base32(hex_digest: Column) -> Column:
    """RFC 4648 base32 of 40 hex digits: each 5 hex digits are 4 letters."""
    out = []
    for g in range(8):
        v = F.conv(F.substring(hex_digest, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, refers_to: of equal payloads the smallest page_id is the one referred to.

    Only digests are grouped, with map-side combining.  Digests that occur once go no further; the others are
    copied under ``SALTS`` salts and joined back, so one very common payload is spread over that many keys.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload"),
                             "salt": F.expr(f"cast(pmod(xxhash64(page_id), {SALTS}) AS int)")})
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.join(first, ["digest", "salt"], "left")
    mine = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "payload", "payload_bytes", base32(F.col("digest")).alias("digest"), F.when(~mine, F.col("first")).alias("refers_to"))


def chunk_table(recs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(page_id, chunk, record string): each row is one WARC record without its closing blank lines.

    A block of more than ``chunk_bytes`` becomes a first record and continuation records as the format defines,
    so no row holds more than a chunk and a head.  A page's rows are neighbours.  The string column holds raw bytes.
    """
    urn = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    rows = recs.select("page_id", "url", "digest", "refers_to", urn.alias("urn"), revisit.alias("revisit"), F.encode(http, "UTF-8").alias("http"), "payload")
    rows = rows.withColumn("total", F.octet_length("http") + F.when(revisit, 0).otherwise(F.octet_length("payload")))
    rows = rows.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("total") / chunk_bytes).cast("int")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    # a chunk is cut from the head and the payload where they stand: neither the block nor the list of its chunks is ever made
    at = F.col("k") * chunk_bytes - F.octet_length("http")
    body = F.substring("payload", F.greatest(at, F.lit(0)) + 1, F.greatest(F.lit(0), F.least(F.lit(chunk_bytes), at + chunk_bytes)))
    data = F.concat(F.substring("http", F.col("k") * chunk_bytes + 1, F.lit(chunk_bytes)), F.when(revisit, F.lit(b"")).otherwise(body))
    rows = rows.withColumn("data", data).drop("http", "payload")

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"\r\n{name}: "), value)

    uri = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7F]", "%20")
    kind = F.when(F.col("k") > 0, "continuation").when(F.col("revisit"), "revisit").otherwise("response")
    number = (F.col("k") + 1).cast("string")
    head = F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat("urn", F.when(F.col("k") > 0, F.concat(F.lit(":"), number)).otherwise(""), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", uri),
        F.when(F.col("k") > 0, F.lit("")).otherwise(line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
                                          line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        F.when(F.col("n") > 1, line("WARC-Segment-Number", number)).otherwise(""),
        F.when(F.col("k") > 0, line("WARC-Segment-Origin-ID", F.concat("urn", F.lit(">")))).otherwise(""),
        F.when((F.col("k") > 0) & (F.col("k") + 1 == F.col("n")), line("WARC-Segment-Total-Length", F.col("total").cast("string"))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length("data").cast("string")), F.lit(END))
    return rows.select("page_id", "k", F.concat(F.encode(head, "UTF-8"), F.col("data")).cast("string").alias("record"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Gzipped WARC/1.1 files under ``path``: the text writer's row end is the blank lines that end a record."""
    chunk_table(records(pages, min_bytes), chunk_bytes).select("record").write.option("lineSep", END).option("compression", "gzip").text(path)


class RecordReader:
    """Incremental parser: bytes in, finished pages out; holds one head and a digest's state, never a payload."""

    def __init__(self, out: list[dict]):
        self.head, self.left, self.skip, self.page, self.http = b"", 0, 0, None, None
        self.out = out

    def close(self) -> None:
        if self.head or self.left or self.page is not None:
            raise ValueError("the archive ends within a record")

    def feed(self, data: bytes) -> None:
        view = memoryview(data)
        while len(view):
            if self.skip:
                n = min(self.skip, len(view))
                self.skip, view = self.skip - n, view[n:]
            elif self.left:
                n = min(self.left, len(view))
                self._block(view[:n])
                self.left, view = self.left - n, view[n:]
                if not self.left:
                    self._ended()
            else:
                old = len(self.head)
                self.head += bytes(view)
                at = self.head.find(b"\r\n\r\n", max(0, old - 3))
                if at < 0:
                    return
                view = view[at + 4 - old :]
                self._begin(self.head[:at].decode("utf-8"))
                self.head = b""

    def _begin(self, head: str) -> None:
        version, *lines = head.split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:80]!r}")
        fields = dict(x.split(": ", 1) for x in lines)
        kind, number = fields["WARC-Type"], int(fields.get("WARC-Segment-Number", 0))
        if kind == "continuation":
            if self.page is None or number != self.page["n_chunks"] + 1 or fields["WARC-Segment-Origin-ID"] != self.page["id"]:
                raise ValueError(f"stray continuation {fields['WARC-Record-ID']}")
            self.page["n_chunks"], self.last = number, "WARC-Segment-Total-Length" in fields
        else:
            name = lambda x: None if x is None or x[10:-1] == "null" else int(x[10:-1])
            self.page = {"id": fields["WARC-Record-ID"], "page_id": name(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": kind,
                         "refers_to": name(fields.get("WARC-Refers-To")), "said": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "n_chunks": 1}
            self.http, self.size, self.sha, self.last = b"", 0, hashlib.sha1(), number == 0
        self.left = int(fields["Content-Length"])

    def _block(self, data: memoryview) -> None:
        if self.http is not None:
            self.http += bytes(data)
            at = self.http.find(b"\r\n\r\n")
            if at < 0:
                return
            self.page["length"] = int(self.http[:at].rpartition(b"Content-Length: ")[2])
            data, self.http = memoryview(self.http)[at + 4 :], None
        self.size += len(data)
        self.sha.update(data)

    def _ended(self) -> None:
        self.skip = 4
        if not self.last:
            return
        p, digest = self.page, base64.b32encode(self.sha.digest()).decode()
        if p["record_type"] == "response" and (digest != p["said"] or self.size != p["length"]):
            raise ValueError(f"{p['id']}: payload digest {digest}, {self.size} bytes; the head says {p['said']}, {p['length']}")
        self.out.append({k: p[k] for k in ("page_id", "url", "record_type", "refers_to", "n_chunks")} | {"payload_bytes": p["length"], "payload_digest": p["said"]})
        self.page = None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each page in the archives.

    Rows of a gzipped file are its pieces between blank lines, in order, in one task; the reader puts the blank lines back
    and follows the record lengths.  Digests of responses are computed from the bytes read and compared; revisits carry
    the size and digest of the full payload in their heads.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, file, out = None, None, []
        for b in batches:
            for name, piece in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if name != file:  # several files may share a task
                    if reader is not None:
                        reader.close()
                    reader, file = RecordReader(out), name
                else:
                    reader.feed(b"\r\n\r\n")
                reader.feed(piece.as_py())
            if out:
                yield pa.RecordBatch.from_pylist(out, SCHEMA_PA)
                out.clear()
        if reader is not None:
            reader.close()

    ship_package(spark)
    pieces = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(run, SCHEMA)


SCHEMA_PA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                       ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("n_chunks", pa.int64())])


def round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives and read them back.

    Null html is an empty payload; equal payloads of at least ``min_bytes`` bytes revisit the one with the smallest page_id (rows that
    repeat that page_id are responses too; a null page_id never is referred to); a null url is about:blank; an empty table
    gives no rows; further columns are ignored.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(pages, path, min_bytes, chunk_bytes)
    return read_archives(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM {pages}),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS x FROM p),
b AS (SELECT page_id, payload_bytes, x, min(page_id) OVER (PARTITION BY x) AS first FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (('0x' || substr(x, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) % 32 + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
