"""WARC archives of Zstandard frames: a dictionary in a leading skippable frame, one frame for each record.

Records are written by Spark's own text writer, whose bytes go through the commit protocol of any
store that Spark can write: a lost or repeated task leaves no half archive. The line separator is
an empty skippable frame, which every Zstandard reader passes over, so each file is a valid
`.warc.zst` stream. Files are volumes of a bounded size and are read whole by Spark's binary
reader; frame borders are found from block headers, so a damaged record costs that record only.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.llm.shared import attach_group, bound_batches, lean, table, work_dir

#: Fixed values of the formats: Zstandard's magics, the archive's dictionary frame, the revisit profile.
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE = 0x184D2A50
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An empty skippable frame of the first kind; all its bytes are ASCII.
SEPARATOR = struct.pack("<II", SKIPPABLE, 0).decode("ascii")
#: Bytes of compressed records after which a new volume begins.
VOLUME_BYTES = 16_000_000
#: Rows whose start the dictionary is trained on, characters of each, and bytes of the dictionary.
DICTIONARY_ROWS, DICTIONARY_CHARS, DICTIONARY_BYTES = 256, 8_000, 65_536
#: A record that claims more decoded bytes than this is refused.
MOST_RECORD_BYTES = 2_000_000_000
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3

RECORD = "path string, place bigint, error string, version string, warc_type string, record_id string, headers map<string,string>, payload binary, payload_bytes bigint, payload_digest string"


class ArchiveError(ValueError):
    """A record or frame that breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- frames -------------------------------------------------------------------------------


def skippable_frame(magic: int, data: bytes) -> bytes:
    return struct.pack("<II", magic, len(data)) + data


def frame_end(data: memoryview, at: int) -> int:
    """The end of the frame that begins at `at`, from its header and its blocks' headers."""
    if len(data) - at < 8:
        raise ArchiveError("the archive ends inside a frame's header")
    magic, second = struct.unpack_from("<II", data, at)
    if magic & 0xFFFFFFF0 == SKIPPABLE:
        end = at + 8 + second
    elif magic == FRAME_MAGIC:
        flags = data[at + 4]
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        size_bytes = (0, 2, 4, 8)[flags >> 6] or single
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + size_bytes
        last = False
        while not last:
            if end + 3 > len(data):
                raise ArchiveError("the archive ends inside a frame")
            block = data[end] | data[end + 1] << 8 | data[end + 2] << 16
            last, kind, n = block & 1, block >> 1 & 3, block >> 3
            if kind == 3:
                raise ArchiveError("reserved block type")
            end += 3 + (1 if kind == 1 else n)
        end += 4 * checksum
    else:
        raise ArchiveError("no frame begins here")
    if end > len(data):
        raise ArchiveError("the archive ends inside a frame")
    return end


def next_frame(data: bytes, at: int) -> int:
    """The next place after `at` where a record's frame or a separator may begin."""
    found = [x for x in (data.find(struct.pack("<I", FRAME_MAGIC), at + 1), data.find(SEPARATOR.encode(), at + 1)) if x >= 0]
    return min(found, default=len(data))


def leading_dictionary(data: bytes) -> tuple[bytes | None, int]:
    """The dictionary of an archive's leading skippable frame (itself plain or compressed), and where the records begin."""
    import zstandard

    view = memoryview(data)
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_FRAME:
        return None, 0
    end = frame_end(view, 0)
    found = bytes(view[8:end])
    if found[:4] == struct.pack("<I", FRAME_MAGIC):
        found = zstandard.ZstdDecompressor().decompress(found, max_output_size=1 << 27)
    return found, end


# ---- records ------------------------------------------------------------------------------


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def header_text(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1F\x7F]+", " ", value).strip()


def record_id(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def page_of(identifier: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", identifier or "")
    return int(found[1]) if found else None


def encode_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """The bytes of a response, or of a revisit that leaves the payload to the record it refers to."""
    block = http_head(len(payload)) + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {header_text(url or '') or 'about:blank'}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


@dataclass
class Record:
    """A record that has passed validation."""

    version: str
    headers: dict[str, str]
    block: bytes
    payload: bytes | None = None
    payload_bytes: int | None = None
    digest: str | None = None
    kind: str = field(default="")


_TOKEN = re.compile(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
_NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def decode_record(data: bytes) -> Record:
    """Parse and validate one record: version, header syntax, needed headers, lengths, digests."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise ArchiveError("the header has no end")
    first, *lines = head.split(b"\r\n")
    if first not in (b"WARC/1.0", b"WARC/1.1"):
        raise ArchiveError(f"no known version: {first[:20]!r}")
    headers: dict[str, str] = {}
    name = ""
    for line in lines:
        try:
            text = line.decode()
        except UnicodeDecodeError as e:
            raise ArchiveError("a header is not UTF-8") from e
        if text[:1] in (" ", "\t") and name:  # a folded line
            headers[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.lower()
        if not colon or not _TOKEN.fullmatch(name):
            raise ArchiveError(f"a malformed header: {text[:40]!r}")
        if name in headers and name != "warc-concurrent-to":
            raise ArchiveError(f"a repeated header: {name}")
        headers[name] = value.strip()
    for needed in _NEEDED:
        if needed not in headers:
            raise ArchiveError(f"without {needed}")
    if not re.fullmatch(r"[0-9]+", headers["content-length"]):
        raise ArchiveError("a malformed content-length")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ArchiveError(f"content-length says {n}, the frame holds {len(rest) - 4}")
    if not re.fullmatch(r"<[^<>\s]+>", headers["warc-record-id"]):
        raise ArchiveError("a malformed warc-record-id")
    block = rest[:n]
    record = Record(first.decode(), headers, block, kind=headers["warc-type"])
    check_digest(headers.get("warc-block-digest"), block, "block")
    if record.kind in ("response", "revisit") and headers.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", http)
        if not gap or not http.startswith(b"HTTP/"):
            raise ArchiveError("a malformed HTTP head")
        record.payload_bytes = int(length[1]) if length else len(payload)
        record.digest = (headers.get("warc-payload-digest") or "").rpartition(":")[2] or None
        if record.kind == "response":
            if record.payload_bytes != len(payload):
                raise ArchiveError(f"the HTTP head says {record.payload_bytes} bytes, the block holds {len(payload)}")
            check_digest(headers.get("warc-payload-digest"), payload, "payload")
            record.payload, record.digest = payload, record.digest or sha1_base32(payload)
        elif "warc-refers-to" not in headers:
            raise ArchiveError("a revisit that refers to nothing")
    return record


def check_digest(said: str | None, data: bytes, what: str) -> None:
    if said and said.lower().startswith("sha1:") and said[5:] != sha1_base32(data):
        raise ArchiveError(f"the {what} digest is wrong")


def read_archive(data: bytes) -> Iterator[tuple[int, Record | ArchiveError]]:
    """(place of the frame, record or what is wrong with it) for every frame of an archive; reading goes on after a fault."""
    import zstandard

    try:
        dictionary, at = leading_dictionary(data)
    except (ArchiveError, zstandard.ZstdError) as e:
        yield 0, ArchiveError(f"the dictionary can't be read: {e}")
        return
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    view = memoryview(data)
    while at < len(data):
        try:
            end = frame_end(view, at)
            if struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == SKIPPABLE:
                at = end
                continue
            size = zstandard.frame_content_size(view[at:end])
            if size > MOST_RECORD_BYTES:
                raise ArchiveError(f"the frame claims {size} bytes")
            record = decode_record(decoder.decompress(view[at:end], max_output_size=MOST_RECORD_BYTES if size < 0 else 0))
            yield at, record
        except zstandard.ZstdError as e:
            yield at, ArchiveError(f"the frame can't be decoded: {e}")
        except ArchiveError as e:
            if "frame" in str(e) and ("begins" in str(e) or "ends" in str(e) or "block type" in str(e)):
                end = next_frame(data, at)
            yield at, e
        at = end


# ---- tables -------------------------------------------------------------------------------


def train_dictionary(texts: list[str]) -> bytes:
    """A dictionary of these samples; their plain bytes where they are too few to train on."""
    import zstandard

    samples = [t.encode() for t in texts if t]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def write_archives(records: DataFrame, path: str, dictionary: bytes, volume_bytes: int = VOLUME_BYTES) -> None:
    """Write rows (page_id, url, html, refers_to, revisit) to volumes below `path`, each led by the dictionary frame.

    A task cuts a new volume after `volume_bytes` compressed bytes; a larger record has a volume to
    itself. Null url and html count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        lead = skippable_frame(DICTIONARY_FRAME, zstandard.ZstdCompressor(level=19).compress(dictionary)) if dictionary else skippable_frame(SKIPPABLE, b"")
        volume, held, place = 0, 0, 0
        for batch in batches:
            volumes, places, frames = [], [], []
            for page, url, html, refers_to, revisit in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                frame = coder.compress(encode_record(page, url, (html or "").encode(), refers_to, revisit))
                if held and held + len(frame) > volume_bytes:
                    volume, held = volume + 1, 0
                for x in [lead, frame] if not held else [frame]:
                    volumes.append(volume)
                    places.append(place)
                    frames.append(x)
                    held += len(x)
                    place += 1
            yield pa.RecordBatch.from_arrays([pa.array(volumes, pa.int32()), pa.array(places, pa.int64()), pa.array(frames, pa.binary())], names=["volume", "place", "frame"])

    bound_batches(records.sparkSession)
    rows = records.select("page_id", "url", "html", "refers_to", "revisit").mapInArrow(lean(run), "volume int, place bigint, frame binary")
    rows = rows.sortWithinPartitions("volume", "place")  # as the writer asks for its files; already so within a task
    rows.select("volume", F.col("frame").cast("string").alias("value")).write.partitionBy("volume").option("lineSep", SEPARATOR).text(path)


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row for each record of all archives below `path` (see RECORD); a faulty one has `error` and no record columns.

    Archives are files of a bounded size. Header names are lower case.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, held = batch.column(0)[i].as_py(), [], 0
                for at, r in read_archive(batch.column(1)[i].as_py()):
                    if isinstance(r, ArchiveError):
                        rows.append((name, at, str(r), None, None, None, None, None, None, None))
                        continue
                    payload = r.payload if keep_payload else None
                    rows.append((name, at, None, r.version, r.kind, r.headers["warc-record-id"], list(r.headers.items()), payload, r.payload_bytes, r.digest))
                    held += len(payload or b"") + 1000
                    if held > 8_000_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    bound_batches(spark)  # a volume travels alone
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(lean(run), RECORD)


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`pages` (page_id, url, html) with refers_to and revisit.

    Of equal payloads of at least `least_bytes` bytes the row of the largest page_id is the
    response and all others revisit it; repeated rows of that page_id are responses too. A null
    page_id is the least. Only digests and ids are grouped, salted; the html meets the outcome by page_id.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    small = pages.select("page_id", F.sha1(payload).alias("digest"), F.length(payload).alias("n"))
    best = attach_group(small.where(F.col("n") >= least_bytes), "digest", "page_id", {"winner": ("max", "page_id"), "members": ("count", "digest")})
    fate = best.where("members > 1").groupBy("page_id", "digest").agg(F.first("winner").alias("winner"))
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"))
    fate = fate.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "winner", F.lit(True).alias("shared"))
    joined = rows.join(fate, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    return joined.select("page_id", "url", "html", F.col("winner").alias("refers_to"), (F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("winner"))).alias("revisit"))


def archive(pages: DataFrame, path: str, least_bytes: int = 0, volume_bytes: int = VOLUME_BYTES) -> None:
    """Write all `pages` (page_id, url, html) as records below `path`.

    The dictionary is trained on the start of the first DICTIONARY_ROWS rows: it changes the
    sizes of the files and nothing else. Empty tables give an empty folder.
    """
    sample = [r[0] for r in pages.where("html is not null").select(F.substring("html", 1, DICTIONARY_CHARS)).limit(DICTIONARY_ROWS).collect()]
    write_archives(plan_records(pages, least_bytes), path, train_dictionary(sample), volume_bytes)


def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; a null url is about:blank; equal rows of one page_id are records
    of their own, all of the same type. A record that fails validation would have a null
    page_id and type and its fault in `error`.
    """
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}/warc"
    archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    back = read_archives(spark, path, keep_payload=False)
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    refers = F.when(F.col("warc_type") == "revisit", number(F.col("headers")["warc-refers-to"]))
    return back.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), refers.alias("refers_to"), "error")


ORACLE_OP4 = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as n, sha1(b) as h from p),
w as (select *, max(page_id) over (partition by h) as winner, count(*) over (partition by h) as m from d),
bits as (select page_id, n, h, winner, m, list_transform(range(32), lambda i:
           (('0x' || substr(h, (i * 5) // 4 + 1, 1))::int * 16 + ('0x' || substr(h || '0', (i * 5) // 4 + 2, 1))::int)) as pairs from w)
select page_id, n::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (pairs[i + 1] >> (3 - (i * 5) % 4)) % 32 + 1, 1)), '') as payload_digest,
  case when m > 1 and page_id is distinct from winner then 'revisit' else 'response' end as record_type,
  case when m > 1 and page_id is distinct from winner then winner end as refers_to, null::varchar as error
from bits
"""
