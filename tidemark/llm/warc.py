"""WARC archives: writing with deduplicated payloads, and reading as a chunked record table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table

#: payloads under so many bytes are never revisits
REVISIT_BYTES = 100
#: bytes of payload in one record; longer payloads go on in continuation records
SEGMENT_BYTES = 1 << 20
#: bytes read at a time, and those among which a header must end
BLOCK_BYTES, HEAD_BYTES = 1 << 18, 1 << 20
DATE = "2024-01-01T00:00:00Z"
#: rows with one digest are dealt out over so many tasks
SALTS = 64
NL = "\r\n"


def decide(pages: DataFrame) -> DataFrame:
    """``pages`` (``page_id, url, payload`` binary) with ``digest`` and ``first``: the smallest
    page_id with the same payload, null where no other row has it or it is short.

    The smallest page_id is found per digest and salt, then per digest, and sent back per
    salt, so a payload that a third of all rows share is dealt out.
    """
    rows = pages.withColumn("digest", F.sha2("payload", 256)).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    light = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest", "salt").agg(F.min("page_id").alias("low"), F.count("*").alias("n"))
    many = light.groupBy("digest").agg(F.min("low").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n")
    return rows.join(light.join(many, "digest").select("digest", "salt", "first"), ["digest", "salt"], "left").drop("salt")


def records(pages: DataFrame, segment: int = SEGMENT_BYTES) -> DataFrame:
    """``pages(page_id, url, html)`` to ``value``: WARC records without their closing line ends,
    those of one page one after the other.

    Null html is an empty payload; a null url is written as ``urn:x-page:<id>``; line ends in
    urls are percent-encoded. Repeated rows are written each; those with the smallest
    page_id of a payload are all responses. A null page_id is the smallest.
    """
    p = decide(pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")))
    size = F.octet_length("payload")
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    revisit = F.coalesce(F.col("page_id") != F.col("first"), F.lit(False))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}Content-Length: "), size.cast("string"), F.lit(NL + NL))
    url = F.coalesce(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), F.concat(F.lit("urn:x-page:"), name(F.col("page_id"))))
    p = p.select("page_id", "payload", "digest", "first", revisit.alias("revisit"), http.alias("http"), url.alias("url"), F.when(revisit, 1).otherwise(F.greatest(F.lit(1), F.ceil(size / segment))).cast("int").alias("n"))
    start = F.concat(F.lit(f"WARC/1.1{NL}WARC-Date: {DATE}{NL}WARC-Target-URI: "), "url", F.lit(f"{NL}WARC-Payload-Digest: sha256:"), "digest", F.lit(NL))

    def record(k: F.Column) -> F.Column:
        part = F.when(F.col("revisit"), F.lit("")).otherwise(F.substring("payload", k * segment + 1, F.lit(segment)).cast("string"))
        block = F.concat(F.when(k == 0, F.col("http")).otherwise(F.lit("")), part)
        kind = F.when(F.col("revisit"), "revisit").when(k == 0, "response").otherwise("continuation")
        of = F.concat(F.lit("<urn:x-page:"), name(F.col("page_id")))
        head = F.concat(
            start, F.lit("WARC-Type: "), kind, F.lit(f"{NL}WARC-Record-ID: "), of, F.when(k > 0, F.concat(F.lit(":"), (k + 1).cast("string"))).otherwise(F.lit("")), F.lit(f">{NL}"),
            F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{NL}WARC-Refers-To: <urn:x-page:"), name(F.col("first")), F.lit(f">{NL}"))).otherwise(F.lit("")),
            F.when(k == 0, F.lit(f"Content-Type: application/http; msgtype=response{NL}")).otherwise(F.lit("")),
            F.when(F.col("n") > 1, F.concat(F.lit("WARC-Segment-Number: "), (k + 1).cast("string"), F.lit(NL))).otherwise(F.lit("")),
            F.when(k > 0, F.concat(F.lit("WARC-Segment-Origin-ID: "), of, F.lit(f">{NL}"))).otherwise(F.lit("")),
            F.when((k > 0) & (k == F.col("n") - 1), F.concat(F.lit("WARC-Segment-Total-Length: "), (F.octet_length("http") + F.octet_length("payload")).cast("string"), F.lit(NL))).otherwise(F.lit("")),
        )
        return F.concat(head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(NL + NL), block)

    # one row per segment: beside the payload one segment at a time is held
    return p.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).select(record(F.col("k")).alias("value"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """One gzip-compressed WARC file per task. Spark's text sink writes them, the end of a record being its line
    separator, so a lost task's file is never seen half written."""
    records(pages, segment).write.option("lineSep", NL * 2).option("compression", "gzip").text(path)


class _Source:
    """A stream from which lines and counted bytes are taken, holding one block at a time. Compression is told by the first bytes."""

    def __init__(self, path: str):
        from pyarrow import fs

        uri = path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path
        system, at = fs.FileSystem.from_uri(uri)
        with system.open_input_stream(at, compression=None) as raw:
            zipped = raw.read(2) == b"\x1f\x8b"
        self.stream = system.open_input_stream(at, compression="gzip" if zipped else None)
        self.held = b""

    def _more(self) -> bool:
        got = self.stream.read(BLOCK_BYTES)
        self.held += got
        return bool(got)

    def head(self) -> list[str] | None:
        """The lines up to the next empty one; None at the end of the archive, where line ends may stand."""
        while not self.held.lstrip(NL.encode()):
            self.held = b""
            if not self._more():
                return None
        self.held = self.held.lstrip(NL.encode())
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if len(self.held) > HEAD_BYTES or not self._more():
                raise ValueError(f"no WARC record: {self.held[:80]!r}")
        lines, self.held = self.held[:end], self.held[end + 4 :]
        return lines.decode("utf-8", "replace").split(NL)

    def take(self, n: int) -> Iterator[bytes]:
        while n > 0:
            if not self.held and not self._more():
                raise ValueError("archive ends within a record")
            got, self.held = self.held[:n], self.held[n:]
            n -= len(got)
            yield got


def _name(x: str | None) -> str | None:
    """A record's identifier without its brackets, and without the prefix of this module's own."""
    return None if x is None else x.removeprefix("<").removesuffix(">").removeprefix("urn:x-page:")


def _http(body: Iterator[bytes]) -> tuple[int | None, bytes]:
    """The size that a block's HTTP header gives, and what of the payload was read with it. A block without the empty line that ends a
    header among its first HEAD_BYTES is payload from its start."""
    held = b""
    while (end := held.find(b"\r\n\r\n")) < 0 and len(held) <= HEAD_BYTES and (more := next(body, None)) is not None:
        held += more
    if end < 0:
        return None, held
    sizes = re.findall(rb"(?im)^content-length: *(\d+)", held[:end])
    return int(sizes[-1]) if sizes else None, held[end + 4 :]


class _Record:
    """A record while it is read: the newest chunk is held back until it is known whether more of the record comes."""

    def __init__(self, name: str | None, kind: str, declared: int | None, refers: str | None = None, named: str = "", sure: bool = True):
        self.name, self.kind, self.declared, self.refers, self.sure = name, kind, declared, refers, sure
        self.named = named.removeprefix("sha256:") if named.startswith("sha256:") else None
        self.seen, self.number, self.held, self.digest = 0, 0, b"", hashlib.sha256()

    def row(self, last: bool) -> tuple:
        return self.name, self.kind, self.refers, self.declared, self.seen, self.number, self.held, self.digest.hexdigest(), last

    def put(self, chunk: bytes) -> Iterator[tuple]:
        if chunk:
            if self.held:
                yield self.row(False)
                self.number += 1
            self.held = chunk
            self.seen += len(chunk)
            self.digest.update(chunk)

    def finish(self) -> Iterator[tuple]:
        if self.named and self.sure and self.declared in (None, self.seen) and self.digest.hexdigest() != self.named:
            raise ValueError(f"record {self.name}: payload and digest differ")
        yield self.row(True)


def stream(path: str) -> Iterator[tuple[str, str, str | None, int | None, int | None, int, bytes, str | None, bool]]:
    """``(record, type, refers to, bytes declared, bytes so far, chunk number, chunk, digest so far, last)`` for each chunk of
    an archive's records with payloads; a revisit has one empty chunk, and the size and digest that it names.

    A payload is what follows the HTTP header of a response, or the whole block of a resource or conversion, through all of the record's
    continuations: it ends where the record does, whatever length the HTTP header declares, so truncated and overlong
    payloads come whole, beside what they declare. Other types of record (warcinfo, request, metadata, ...) are passed over. Names of fields
    are read in any case. A SHA-256 that a record names must be its payload's, unless the record says that it is
    truncated or has another length than it declares.
    """
    source, record, passed = _Source(path), None, None
    while (lines := source.head()) is not None:
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:80]!r}")
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        kind, length, name = h.get("warc-type", "").lower(), int(h["content-length"]), _name(h.get("warc-record-id"))
        body = source.take(length)
        if kind == "continuation":
            of = _name(h.get("warc-segment-origin-id"))
            if of != (record.name if record else passed):
                raise ValueError("segments out of order")
            for chunk in body:
                yield from record.put(chunk) if record else ()
            continue
        if record:
            yield from record.finish()
        record, passed, first = None, name, b""
        if kind in ("response", "revisit"):
            declared, first = _http(body)
        if kind == "revisit":
            digest = h.get("warc-payload-digest", "")
            yield name, kind, _name(h.get("warc-refers-to")), declared, declared, 0, b"", digest.removeprefix("sha256:") if digest.startswith("sha256:") else None, True
        elif kind == "response":
            record = _Record(name, kind, declared, None, h.get("warc-payload-digest", ""), "warc-truncated" not in h)
        elif kind in ("resource", "conversion"):
            record = _Record(name, kind, None, None, h.get("warc-payload-digest") or h.get("warc-block-digest", ""), "warc-truncated" not in h)
        if record:
            yield from record.put(first)
        for chunk in body:
            yield from record.put(chunk) if record else ()
    if record:
        yield from record.finish()


CHUNKS = "record_id string, page_id long, record_type string, refers_to long, declared_bytes long, payload_bytes long, chunk int, chunk_bytes long, data binary, digest string, last boolean"
NAMES = [c.split(" ")[0] for c in CHUNKS.split(", ")]


def chunk_table(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The archives under ``path``, every file that is not hidden (its name begins with neither ``.`` nor ``_``), compressed or not, as rows of
    ``record_id, page_id, record_type, refers_to, declared_bytes, payload_bytes, chunk, chunk_bytes, data, digest, last``: a payload comes in
    chunks of about BLOCK_BYTES, each with the bytes and the SHA-256 of the payload up to its end, so no record is ever held whole.
    ``declared_bytes`` is what its HTTP header says, null where it says nothing. Empty files and folders without files give no rows. ``page_id`` and ``refers_to`` are null where an identifier is no number, as
    in archives of others. Without ``with_data`` the bytes themselves stay behind."""
    number = lambda x: int(x) if x and re.fullmatch(r"-?\d{1,18}", x) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch.path:
                out, held = [], 0
                for page, kind, refers, declared, size, k, chunk, digest, last in stream(path):
                    out.append((page, number(page), kind, number(refers), declared, size, k, len(chunk), chunk if with_data else None, digest, last))
                    held += len(chunk) if with_data else 0
                    if held > 8 * BLOCK_BYTES or len(out) > 5000:
                        yield frame(out)
                        out, held = [], 0
                yield frame(out)

    def frame(rows) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=NAMES).astype({"page_id": "Int64", "refers_to": "Int64", "declared_bytes": "Int64", "payload_bytes": "Int64", "chunk": "int32", "chunk_bytes": "int64", "last": "bool"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0").select("path")
    n = spark.sparkContext.defaultParallelism
    return files.repartition(4 * n, "path").mapInPandas(run, CHUNKS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record with a payload, its last chunk's: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    return chunk_table(spark, path, with_data=False).where("last").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


OP5_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f
"""
