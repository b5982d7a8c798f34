"""WARC archives: writing, and reading with segment reassembly.

Writing: a response record per payload, a revisit record where an earlier page
has the same payload.  HTTP bodies are in chunked transfer framing; a record
block longer than ``segment`` bytes is split into a first record and continuation
records, which may lie in later archives.  Archives are files of gzip members in
the folder that all executors share.

Reading: records of one segment are decoded where they are read.  Segments are
grouped by origin identifier, ordered by number, checked for gaps and against the
total length, joined and then decoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.text import shared_folder, stable

SEGMENT = 32 * 1024
CHUNK = 4096
#: Compressed bytes at which the next archive begins.
ARCHIVE = 8 * 1024 * 1024
#: Payloads of fewer bytes are never written as revisits.
LEAST_REVISIT = 0
#: Pages of one payload are dealt to this many keys when they meet its first page.
SALTS = 32
LEVEL = 1
END = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
HTTP_REVISIT = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format."""


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(part), part) for i in range(0, len(payload), size) if (part := payload[i : i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped."""
    at, parts = 0, []
    while True:
        end = body.find(END, at)
        if end < 0:
            raise WarcError("a chunk has no size line")
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError as error:
            raise WarcError("a chunk size is no number") from error
        if not size:
            return b"".join(parts)
        part = body[end + 2 : end + 2 + size]
        if len(part) < size or body[end + 2 + size : end + 4 + size] != END:
            raise WarcError("a chunk is cut short")
        parts.append(part)
        at = end + 4 + size


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, gap, body = block.partition(END + END)
    if not gap:
        raise WarcError("an HTTP head has no end")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One WARC record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + END + block + END + END


def records(page: int | None, row: int, url: str | None, payload: bytes | None, refers: tuple[int | None, int] | None, digest: str, segment: int) -> Iterator[bytes]:
    """The records of one page: a response in segments, or a revisit."""
    me = record_id(page, row)
    common = [("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Target-URI", re.sub(r"\s", "%20", url or "urn:x-page:none")), ("WARC-Payload-Digest", f"sha1:{digest}")]
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", me), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*refers)), kind], HTTP_REVISIT)
        return
    block = HTTP + chunked(payload or b"")
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", me), *common, kind], block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", me), *common, ("WARC-Segment-Number", 1), kind], parts[0])
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        own = f"{me[:-1]}:{k}>"
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), *common[:2], ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", k), *more], part)


def record_id(page: int | None, row: int) -> str:
    return f"<urn:x-page:{'none' if page is None else page}:{row}>"


def page_of(identifier: str) -> tuple[int | None, int]:
    """Page and row that ``record_id`` wrote."""
    found = re.fullmatch(r"<urn:x-page:(none|-?\d+):(\d+)(?::\d+)?>", identifier)
    if not found:
        raise WarcError(f"unknown record identifier {identifier[:80]}")
    return None if found[1] == "none" else int(found[1]), int(found[2])


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an archive."""
    while archive:
        member = zlib.decompressobj(wbits=31)
        try:
            raw = member.decompress(archive)
        except zlib.error as error:
            raise WarcError("an archive is no gzip file") from error
        if not member.eof:
            raise WarcError("an archive is cut short")
        archive = member.unused_data
        while raw:
            head, gap, rest = raw.partition(END + END)
            lines = head.split(END)
            if not gap or not lines[0].startswith(b"WARC/"):
                raise WarcError("a record has no head")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
            size = int(fields["content-length"])
            if len(rest) < size + 4 or rest[size : size + 4] != END + END:
                raise WarcError("a record is cut short")
            yield fields, rest[:size]
            raw = rest[size + 4 :]


def reassembled(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of one record from its segments (number, total length, block).

    Numbers must run from 1 without gaps; a segment read twice counts once if
    both copies are equal.
    """
    by_number: dict[int, bytes] = {}
    total = None
    for number, length, block in parts:
        if by_number.setdefault(number, block) != block:
            raise WarcError(f"segment {number} has two contents")
        total = length if length is not None else total
    if sorted(by_number) != list(range(1, len(by_number) + 1)):
        raise WarcError("a segment is missing")
    block = b"".join(by_number[k] for k in sorted(by_number))
    if total is None or len(block) != total:
        raise WarcError(f"segments have {len(block)} bytes of {total}")
    return block


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def write_archives(pages: DataFrame, folder: str, segment: int = SEGMENT, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record per row of ``pages``; returns path, records and bytes of each archive.

    Needs page_id, url and html.  Of rows with equal payloads of at least
    ``least_revisit`` bytes the smallest page_id (null last; of repeated ids one
    row) is a response and the others refer to it.  Only archives that the result
    names count: a task that is run again writes under another name.
    """
    payload = _payload(F.col("html"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), "html", F.monotonically_increasing_id().alias("row"), F.sha1(payload).alias("sha"), F.xxhash64(payload).alias("check"), F.octet_length(payload).alias("size"))
    key = ["sha", "check", "size"]
    first = rows.where(F.col("size") >= least_revisit).groupBy(*key).agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    revisit = F.col("first").isNotNull() & (F.col("row") != F.col("first.row"))
    salted = first.drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    planned = rows.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, [*key, "salt"], "left").select("page_id", "url", "row", "sha", F.when(revisit, F.lit(None)).otherwise(payload).alias("payload"), F.when(revisit, F.col("first.page_id")).alias("to_page"), F.when(revisit, F.col("first.row")).alias("to_row"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{root}/{task.partitionId():06d}-{uuid.uuid4().hex}"
        held: list[bytes] = []
        size = count = archives = 0
        done: list[tuple[str, int, int]] = []

        def flush() -> None:
            nonlocal held, size, count, archives
            if held:
                path = f"{name}-{archives:05d}.warc.gz"
                with store.open_output_stream(path, compression=None) as out:
                    for part in held:
                        out.write(part)
                done.append((path, count, size))
                held, size, count, archives = [], 0, 0, archives + 1

        for frame in frames:
            for x in frame.itertuples(index=False):
                page = None if pd.isna(x.page_id) else int(x.page_id)
                refers = None if pd.isna(x.to_row) else (None if pd.isna(x.to_page) else int(x.to_page), int(x.to_row))
                digest = base64.b32encode(bytes.fromhex(x.sha)).decode()
                for raw in records(page, int(x.row), x.url, x.payload, refers, digest, segment):
                    pack = zlib.compressobj(LEVEL, wbits=31)
                    held.append(pack.compress(raw) + pack.flush())
                    size += len(held[-1])
                    count += 1
                    if size >= ARCHIVE:
                        flush()
        flush()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    nullable = planned.select(F.col("page_id").cast("string").alias("page_id"), "url", "row", "sha", "payload", F.col("to_page").cast("string").alias("to_page"), F.col("to_row").cast("string").alias("to_row"))
    return stable(nullable.mapInPandas(write, "path string, records long, bytes long"))


SEGMENTS = "origin string, number int, total long, block binary, kind string, page_id long, row long, refers string, payload_bytes long, payload_digest string"


def _read(folder: str, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    store, _ = _filesystem(folder)
    columns = [c.split()[0] for c in SEGMENTS.split(", ")]
    for frame in frames:
        for path in frame["path"]:
            with store.open_input_stream(path, compression=None) as source:
                archive = source.read()
            rows = []
            for fields, block in parsed(archive):
                kind = fields["warc-type"]
                number = int(fields.get("warc-segment-number", 0))
                total = fields.get("warc-segment-total-length")
                origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                page, row = page_of(origin)
                if number:
                    rows.append((origin, number, None if total is None else int(total), block, kind, page, row, None, None, None))
                elif kind == "revisit":
                    rows.append((origin, 0, None, None, kind, page, row, fields["warc-refers-to"], None, fields["warc-payload-digest"].removeprefix("sha1:")))
                elif kind == "response":
                    payload = http_payload(block)
                    rows.append((origin, 0, None, None, kind, page, row, None, len(payload), _checked(payload, fields)))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"number": "int32", "total": "Int64", "page_id": "Int64", "payload_bytes": "Int64"})


def _checked(payload: bytes, fields: dict[str, str]) -> str:
    digest = payload_digest(payload)
    if fields.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
        raise WarcError("a payload differs from its digest")
    return digest


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page.

    ``archives`` has the column path.  Broken framing, missing segments and wrong
    lengths or digests raise ``WarcError``.  A revisit takes the size from the
    response that it refers to; one whose response is missing, or has another
    digest, raises too.
    """
    # Paths are tiny rows: without a number their partitions would be joined into one.
    found = stable(archives.select("path").repartition(max(1, archives.count())).mapInPandas(lambda frames: _read(folder, frames), SEGMENTS))

    @F.pandas_udf("payload_bytes long, payload_digest string")
    def decode(parts: pd.Series) -> pd.DataFrame:
        out = []
        for segments in parts:
            payload = http_payload(reassembled([(s["number"], s["total"], bytes(s["block"])) for s in segments]))
            out.append((len(payload), payload_digest(payload)))
        return pd.DataFrame(out, columns=["payload_bytes", "payload_digest"])

    parts = found.where("number > 0").groupBy("origin").agg(F.first("page_id").alias("page_id"), F.sort_array(F.collect_list(F.struct("number", "total", "block"))).alias("parts"))
    joined = parts.select("origin", "page_id", decode("parts").alias("d")).select("origin", "page_id", "d.payload_bytes", "d.payload_digest")
    responses = found.where("number = 0 AND kind = 'response'").select("origin", "page_id", "payload_bytes", "payload_digest").unionAll(joined)
    responses = stable(responses)
    revisits = found.where("kind = 'revisit'").select("page_id", "refers", F.col("payload_digest").alias("own"))
    same = F.coalesce(F.col("own") == F.col("payload_digest"), F.lit(False))
    problem = F.raise_error(F.concat(F.lit("no equal response for the revisit of "), F.coalesce("refers", F.lit("null"))))
    target = responses.select(F.col("origin").alias("refers"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    again = revisits.join(target, "refers", "left").select("page_id", F.when(same, F.col("payload_bytes")).otherwise(problem.cast("long")).alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionAll(again)


def warc_round_trip(pages: DataFrame, folder: str | None = None, segment: int = SEGMENT, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Writes the archives of ``pages`` and reads them back, a row per page.

    Other columns than page_id, url and html are ignored; a null html is the empty
    payload, a null url and null ids are written as none.  Repeated rows are pages
    of their own.  An empty table gives no archives and no rows.  ``folder`` is a
    new one in the session's shared folder unless given.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, segment, least_revisit), folder)
