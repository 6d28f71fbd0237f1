"""Web archives as Zstandard frames: a dictionary frame first, then one frame per record.

Writing. Pages with equal payloads of a least size form a group; the page with the smallest
id is a `response`, the others are `revisit` records that name it. Records are dealt into
archives of a bounded size. Each archive starts with a skippable frame that holds its
dictionary (trained on the archive's first records), and every record is one frame. The
text writer of Spark puts the frames down: its line separator is an empty skippable frame,
which every Zstandard reader passes over, so the files are valid archives on any file
system that Spark can write.

Reading. Each archive is read with Spark's binary reader, its frames are decoded one at a
time with the dictionary of the leading frame, and each record's version line, headers,
length and digest are checked. What fails a check is returned with its fault, never dropped.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.session import cut, find_package

#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 100
#: Text bytes that an archive holds, about; records used to train its dictionary; size of that.
ARCHIVE_BYTES = 8 << 20
TRAIN_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES = 64, 1 << 20, 8 << 10

# Magic numbers of the formats. The separator is a skippable frame without content.
DICTIONARY_MAGIC, FRAME_MAGIC, DICTIONARY_HEAD = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
VERSION, VERSIONS = b"WARC/1.1", (b"WARC/1.1", b"WARC/1.0")
HEADERS = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

RECORD = "page_id long, record_id string, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, fault string, archive string"


def record_of(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record. A revisit carries its payload's digest and length, not the payload."""
    block = payload if refers_to is None else b""
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').encode('unicode_escape').decode()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record and its first fault, if any.

    Header names count in any case. Records other than responses and revisits come back
    with their type and block. A SHA-256 digest is compared with the payload: the block, or
    what follows the head of an HTTP message in it. Digests of other kinds are only returned.
    """
    out: dict = dict.fromkeys(("page_id", "record_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "fault"))
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] not in VERSIONS or not gap:
        return out | {"fault": "version"}
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name:
            return out | {"fault": "header line"}
        fields[name.decode("ascii", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if missing := [h for h in HEADERS if h.lower() not in fields]:
        return out | {"fault": f"header {missing[0]} missing"}
    number = lambda text: int(x) if (x := text.removeprefix("<urn:page:").removesuffix(">")).lstrip("-").isdigit() else None
    name = fields["warc-record-id"]
    out |= {"page_id": number(name), "record_id": name, "record_type": fields["warc-type"].lower()}
    address = fields.get("warc-target-uri", "").removeprefix("<").removesuffix(">")
    own = name.startswith("<urn:page:")  # this module's addresses are escaped
    out["url"] = (address.encode("ascii", "replace").decode("unicode_escape") if own else address) or None
    length = fields["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"fault": "length"}
    block = rest[:-4]
    digest = fields.get("warc-payload-digest", "")
    out["payload_digest"] = digest.removeprefix("sha256:") or None
    if out["record_type"] == "revisit":
        if own and ("warc-refers-to" not in fields or block or not fields.get("x-payload-length", "").isdigit()):
            return out | {"fault": "revisit"}
        size = fields.get("x-payload-length", "")
        return out | {"refers_to": number(fields.get("warc-refers-to", "")), "payload_bytes": int(size) if size.isdigit() else None}
    payload = block
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    if digest.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != out["payload_digest"].lower():
        return out | {"fault": "digest"}
    return out | {"payload": payload, "payload_bytes": len(payload)}


# --- writing --------------------------------------------------------------------


def frames_of(records: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressor]:
    """The leading frame for an archive that begins with these records, and its compressor."""
    dictionary = b""
    if len(records) >= 16:
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, records, level=3).as_bytes()
        except zstandard.ZstdError:  # too little to learn from: an archive without a dictionary is valid too
            dictionary = b""
    lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return lead, zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=True)


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[bytes] = []
    compressor, size = None, 0
    answered: set[tuple[int, str]] = set()  # ids and payloads that several rows repeat

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal compressor, waiting, size
        frames = []
        if compressor is None:
            lead, compressor = frames_of(waiting)
            frames.append(lead)
        frames += [compressor.compress(r) for r in waiting]
        waiting, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    for batch in batches:
        page, url, html, digest, refers, repeats = (batch.column(k) for k in range(6))
        for k in range(batch.num_rows):
            payload, refers_to = (html[k].as_py() or "").encode(), refers[k].as_py()
            if repeats[k].as_py():  # rows of one id are in one task: the first is the response
                same = page[k].as_py(), digest[k].as_py()
                refers_to = refers_to if same not in answered else page[k].as_py()
                answered.add(same)
            waiting.append(record_of(page[k].as_py(), url[k].as_py(), payload, digest[k].as_py(), refers_to))
            size += len(waiting[-1])
            if size >= TRAIN_BYTES or compressor is None and len(waiting) >= TRAIN_RECORDS:
                yield from flush()
    if waiting:
        yield from flush()


def marked(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest, refers_to, repeats): which pages repeat another page's payload, dealt into archives.

    Ties on the payload go to the smallest id. Of rows that repeat that id and the payload
    (`repeats`), the first in its archive is the response and the others revisit it. Rows
    without id are responses. Null html is an empty payload. The groups are found on digests
    alone; payloads are shuffled once, by id, into archives of a mean size.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
    )
    digest = F.sha2(F.col("html"), 256)
    short = cut(rows.select("page_id", digest.alias("digest"), F.octet_length("html").alias("bytes")))
    large = short.filter((F.col("bytes") >= LEAST_BYTES) & F.col("page_id").isNotNull())
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    alike = large.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("rows")).join(firsts, "digest")
    mark = F.struct(F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"), (F.col("first") == F.col("page_id")).alias("repeats"))
    refers = alike.filter("first < page_id OR rows > 1").select("page_id", F.struct("digest", mark).alias("entry"))
    archives = max(1, -(-(short.agg(F.sum("bytes")).first()[0] or 0) // ARCHIVE_BYTES))
    known = rows.filter("page_id IS NOT NULL").repartition(archives, "page_id").withColumn("digest", digest)
    nameless = rows.filter("page_id IS NULL").select("*", digest.alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("repeats"))
    joined = known.join(refers.groupBy("page_id").agg(F.map_from_entries(F.collect_list("entry")).alias("of")), "page_id", "left")
    found = F.try_element_at("of", F.col("digest"))
    return joined.select("page_id", "url", "html", "digest", found["refers_to"].alias("refers_to"), F.coalesce(found["repeats"], F.lit(False)).alias("repeats")).unionByName(nameless)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per page into archives under `path`; an empty table writes no record.

    A page is one record and one frame, however long it is. Archives with fewer than 16 first
    records get no dictionary.
    """
    find_package(pages.sparkSession)
    frames = marked(pages, id_col, url_col, html_col).mapInArrow(_frames, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.mode("overwrite").option("lineSep", SEPARATOR).text(path)


# --- reading --------------------------------------------------------------------


def frame_end(view: memoryview, at: int) -> int | None:
    """Where the frame that begins here ends, by its block headers; None if it is cut short."""
    try:
        head = bytes(view[at : at + 18])
        place, checksum = at + zstandard.frame_header_size(head), zstandard.get_frame_parameters(head).has_checksum
    except zstandard.ZstdError:
        return None
    while place + 3 <= len(view):
        block = int.from_bytes(view[place : place + 3], "little")
        place += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)  # a block of one repeated byte holds that byte
        if block & 1:
            place += 4 * checksum
            return place if place <= len(view) else None
    return None


def records_in(content: bytes | memoryview) -> Iterator[tuple[bytes | None, str | None]]:
    """(record, fault) for each frame of an archive. The leading skippable frame may hold a dictionary, itself compressed or not.

    Only one frame is decoded and held at a time.
    """
    view = memoryview(content)
    decoder = zstandard.ZstdDecompressor()
    at, first = 0, True
    while at < len(view):
        if len(view) - at < 8:
            yield None, "trailing bytes"
            return
        magic, size = struct.unpack_from("<II", view, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if at + 8 + size > len(view):
                yield None, "frame cut short"
                return
            if first and magic == DICTIONARY_MAGIC and size:
                dictionary = bytes(view[at + 8 : at + 8 + size])
                if struct.unpack_from("<I", dictionary)[0] == FRAME_MAGIC:
                    dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(view, at)
            if end is None:
                yield None, "frame cut short"
                return
            try:
                record = decoder.decompressobj().decompress(view[at:end])
            except zstandard.ZstdError:
                yield None, "frame damaged"
                return
            yield record, None
            at = end
        else:
            yield None, "no frame"
            return
        first = False


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORD.split(", ")]
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]]) for n, f in zip(names, RECORD.split(", "))])
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            rows, size = [], 0
            for raw, fault in records_in(content.as_buffer()):
                row = parse_record(raw) if raw is not None else {"fault": fault}
                rows.append(row | {"archive": path.as_py()})
                size += len(raw or b"")
                if size >= TRAIN_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per record of the archives under `path`, whatever their files are called: ids, type, payload, its length and digest, and the fault if a check failed.

    An archive is one file and is read whole by one task (a file of Spark's binary reader is
    below 2 GB), its records one at a time. `glob` narrows the files.
    """
    find_package(spark)
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select("path", "content").mapInArrow(_records, RECORD)
