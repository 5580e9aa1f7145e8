"""WARC archives: records with revisits for repeated payloads, written to shared storage and read back sequentially.

Each record is a gzip member of its own.  The reader goes through an archive once, in bounded chunks: it inflates with an
incremental zlib stream, frames records by Content-Length and verifies the digests that a record carries.  It reads
WARC/1.0 and WARC/1.1 of any writer, plain or gzipped, with records of every type; a revisit is resolved by the record id
that it refers to.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Payloads under this many bytes are always stored.
MIN_REVISIT_BYTES = 1000
#: An archive is closed once it holds this many compressed bytes.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
LEVEL = 6
#: A record's header lines may take so many bytes.
MOST_HEADER_BYTES = 1 << 20
#: Repeated payloads (60 bytes each) that are broadcast to the pages; more are joined by shuffle.
MOST_DIGESTS_BROADCAST = 500_000
#: Fixed values of the WARC format.
VERSION, VERSIONS = b"WARC/1.1", ("WARC/1.0", "WARC/1.1")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to_id string, refers_to long, payload binary"


def record_uri(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _header(value: str) -> str:
    """One line: a URL with control characters cannot end its header."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def make_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """The gzip member of a response, or of a revisit if ``refers_to`` is given."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_uri(page_id, digest)), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{_base32(digest)}"), ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", _header(url)))
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_uri(refers_to, digest))]
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(text + block + b"\r\n\r\n") + packer.flush()


class Damaged(ValueError):
    """An archive that breaks off or whose lengths or digests do not fit its contents."""


def inflated(stream, name: str) -> Iterator[bytes]:
    """The contents of a file object in bounded pieces: those of its gzip members one after the other, or as they are."""
    raw = stream.read(CHUNK)
    if raw[:2] != b"\x1f\x8b":
        while raw:
            yield raw
            raw = stream.read(CHUNK)
        return
    try:
        while raw:
            inflater = zlib.decompressobj(31)
            while not inflater.eof:
                raw = raw or stream.read(CHUNK)
                if not raw:
                    raise Damaged(f"{name} ends within a record")
                piece = inflater.decompress(raw, CHUNK)
                raw = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
                if piece:
                    yield piece
            raw = raw or stream.read(CHUNK)
    except zlib.error as e:
        raise Damaged(f"{name}: {e}") from e


class Headers(dict):
    """Header fields by lower-case name; the first of a name counts."""

    @classmethod
    def of(cls, lines: list[str]) -> Headers:
        found, last = cls(), None
        for line in lines:
            if line[:1] in " \t" and last:
                found[last] += " " + line.strip()
                continue
            field, colon, value = line.partition(":")
            last = field.strip().lower() if colon else None
            if last and last not in found:
                found[last] = value.strip()
            elif last:
                last = None
        return found

    def get(self, field: str, default: str | None = None) -> str | None:
        return super().get(field.lower(), default)


def read_records(stream, name: str = "archive") -> Iterator[tuple[Headers, bytes]]:
    """(headers, block) of each record of a file object, in order; at most one record and one chunk are held."""
    pieces, plain = inflated(stream, name), bytearray()

    def more() -> bool:
        piece = next(pieces, b"")
        plain.extend(piece)
        return bool(piece)

    while plain or more():
        start = 0
        while (end := plain.find(b"\r\n\r\n", start)) < 0:
            start = max(0, len(plain) - 3)
            if len(plain) > MOST_HEADER_BYTES or not more():
                raise Damaged(f"{name} has a record without end of headers")
        lines = bytes(plain[:end]).decode("utf-8", "replace").split("\r\n")
        if lines[0].strip() not in VERSIONS:
            raise Damaged(f"{name} has {lines[0][:20]!r} for a version")
        head = Headers.of(lines[1:])
        length = head.get("Content-Length", "")
        if not length.isdigit():
            raise Damaged(f"{name} has a record without Content-Length")
        n = int(length)
        del plain[: end + 4]
        while len(plain) < n + 4:
            if not more():
                raise Damaged(f"{name} has a record shorter than its Content-Length")
        block, tail = bytes(plain[:n]), bytes(plain[n : n + 4])
        if tail != b"\r\n\r\n":
            raise Damaged(f"{name} has a record longer than its Content-Length")
        del plain[: n + 4]
        if not fits(head.get("WARC-Block-Digest"), block):
            raise Damaged(f"{name} has a block that does not fit its digest")
        yield head, block


def digest_bytes(value: str | None) -> tuple[str, bytes] | None:
    """``algorithm:digest`` in base32 or hexadecimal -> both, if the algorithm is known; the length tells which it is."""
    algorithm, _, text = (value or "").partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size = hashlib.new(algorithm).digest_size
    text = text.strip()
    try:
        found = bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.upper().rstrip("=") + "=" * (-len(text.rstrip("=")) % 8))
    except ValueError:
        return algorithm, b""
    return algorithm, found


def fits(value: str | None, data: bytes) -> bool:
    """Whether data has this digest; an absent one, or one of an unknown algorithm, says nothing."""
    told = digest_bytes(value)
    return told is None or hashlib.new(told[0], data).digest() == told[1]


def _unchunked(body: bytes) -> bytes | None:
    """The entity of an HTTP body in chunks; None if it is not one."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            n = int(body[at:end].partition(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            n = -1
        if n < 0 or len(body) < end + 2 + n:
            return None
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def parse_record(head: Headers, block: bytes, name: str = "archive") -> tuple:
    """A row of RECORD_SCHEMA; what a revisit does not hold itself is null: its payload, and ``refers_to``.

    The payload is the entity of an HTTP message, else the whole block.  If a record has a payload digest, the payload
    is verified.
    """
    kind, told = head.get("WARC-Type", ""), digest_bytes(head.get("WARC-Payload-Digest"))
    payload, size, digest = None, None, told[1].hex() if told and told[0] == "sha1" else None
    http = head.get("Content-Type", "").lower().startswith("application/http")
    top, blank, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    fields = Headers.of(top.decode("latin-1").split("\r\n")[1:])
    if kind == "revisit":
        size = int(length) if (length := fields.get("Content-Length", "")).isdigit() else None
    else:
        payload = body if blank or not http else b""
        if "chunked" in fields.get("Transfer-Encoding", "").lower() and (entity := _unchunked(payload)) is not None and not fits(head.get("WARC-Payload-Digest"), payload):
            payload = entity
        if not fits(head.get("WARC-Payload-Digest"), payload):
            raise Damaged(f"{name} has a payload that does not fit its digest")
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    page = head.get("X-Page-Id", "")
    page = int(page) if re.fullmatch(r"-?[0-9]{1,19}", page) else None
    return head.get("WARC-Record-ID"), page, head.get("WARC-Target-URI"), kind, size, digest, head.get("WARC-Refers-To"), None, payload


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to: null for what is stored whole."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    digests = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")).filter(F.col("n") >= min_bytes)
    last = digests.groupBy(F.col("digest").alias("_digest")).agg(F.max("page_id").alias("_last"), F.count("*").alias("_rows")).filter("_rows > 1 AND _last IS NOT NULL").drop("_rows")
    last = common.materialize(last, "repeated-payloads")
    rows = rows.withColumns({"digest": F.sha1("payload"), "_long": F.octet_length("payload") >= min_bytes})
    # Payloads stay where they are read unless very many are repeated.
    marked = rows.join(common.broadcast_if_small(last, last.count(), MOST_DIGESTS_BROADCAST), F.when(F.col("_long"), F.col("digest")) == F.col("_digest"), "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("_last")), F.col("_last"))
    return marked.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, records, bytes) of the .warc.gz files written under ``folder``, a URI that all executors reach.

    Each task writes archives under names of its own and closes one as it fills up.  Only archives of tasks that
    succeeded are listed in the result, which is a stored table: what a lost task left behind is never read.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, root = fs.FileSystem.from_uri(folder)
        place.create_dir(root)
        out, done, path, records, size = None, [], "", 0, 0
        for frame in frames:
            for page_id, url, payload, digest, refers in zip(*(frame[c].array for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    path, records, size = f"{root}/pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = place.open_output_stream(path, compression=None)
                whole = lambda v: None if pd.isna(v) else int(v)
                member = make_record(whole(page_id), None if pd.isna(url) else url, payload, digest, whole(refers))
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append((path.rpartition("/")[2], records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path.rpartition("/")[2], records, size))
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"]).astype({"records": "int64", "bytes": "int64"})

    marked = mark_revisits(pages)
    text_ids = marked.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers_to"))
    return common.materialize(text_ids.mapInPandas(write, "archive string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Rows of RECORD_SCHEMA of all records of the listed archives; a damaged archive is an error.

    A revisit has the payload's size and digest, and the page_id, of the record in these archives that it refers to;
    refers_to is null where there is none.  Payloads are null unless asked for.
    """
    names = RECORD_SCHEMA.replace(" string", "").replace(" long", "").replace(" binary", "").split(", ")

    def read(want: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            place, root = fs.FileSystem.from_uri(folder)

            def frame(rows):
                return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

            for listed in frames:
                for archive in listed["archive"]:
                    rows, held = [], 0
                    with place.open_input_stream(f"{root}/{archive}", compression=None) as stream:
                        for head, block in read_records(stream, archive):
                            row = parse_record(head, block, archive)
                            rows.append(row if want else (*row[:-1], None))
                            held += len(block) if want else 1
                            if held > (16 << 20 if want else 20_000):
                                yield frame(rows)
                                rows, held = [], 0
                    yield frame(rows)

        return run

    listed = archives.select("archive").repartition(max(1, min(archives.count(), 100_000)))
    known = common.materialize(listed.mapInPandas(read(False), RECORD_SCHEMA), "records")
    rows = listed.mapInPandas(read(True), RECORD_SCHEMA) if payloads else known
    target = known.filter("record_id IS NOT NULL AND record_type <> 'revisit'").groupBy(F.col("record_id").alias("_id")).agg(F.min("page_id").alias("_page"), F.min("payload_bytes").alias("_bytes"), F.min("payload_digest").alias("_digest"))
    refers = (F.col("record_type") == "revisit") & F.col("refers_to_id").isNotNull()
    found = rows.filter(refers).join(target, F.col("refers_to_id") == F.col("_id"), "left").withColumns({"refers_to": F.col("_page"), "payload_bytes": F.coalesce("_bytes", "payload_bytes"), "payload_digest": F.coalesce("payload_digest", "_digest")}).select(*names)
    return rows.filter(~F.coalesce(refers, F.lit(False))).unionByName(found)


def archive_pages(pages: DataFrame, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """Writes a record per row of ``pages`` and reads all records back: RECORD_SCHEMA.

    The payload is the html in UTF-8, empty for null.  Of rows with equal payloads of at least MIN_REVISIT_BYTES bytes
    the one with the largest page_id is a response, the others are revisits that refer to it; if that page_id is
    repeated, all its rows are responses (of which others refer to one), and if all are null, every row is one.  A null page_id or url leaves its header
    out and comes back as null.  Other columns are not looked at.  An empty table gives an empty result.  ``folder``
    defaults to one in the shared folder.
    """
    folder = folder or common.scratch_path(pages.sparkSession, "warc")
    if "://" not in folder:
        folder = folder if ":" in folder else f"file://{folder}"
    return read_archives(write_archives(pages, folder), folder, payloads)


QUERY = "op7_archive_pages"


def query(spark, sf_dir: str) -> DataFrame:
    return archive_pages(common.table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
l AS (SELECT digest, max(page_id) AS last FROM p WHERE n >= {MIN_REVISIT_BYTES} GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN l ON p.n >= {MIN_REVISIT_BYTES} AND p.digest = l.digest"""
