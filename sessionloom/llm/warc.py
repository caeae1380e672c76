"""WARC archives of one zstandard frame a record, with their dictionary in a leading skippable frame."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.functions.storage import shared_dir
from sessionloom.llm.common import released, table, written

#: Fixed values of the format: magic numbers of a zstandard frame, of the dictionary's
#: skippable frame and of the first skippable frame (sixteen follow each other).
FRAME, DICTIONARY, SKIPPABLE = bytes.fromhex("28b52ffd"), bytes.fromhex("5d2a4d18"), 0x184D2A50
#: An empty skippable frame; all ASCII, so that it can end the one line of a file of text.
EMPTY_FRAME = "P*M\x18\0\0\0\0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records before compression in an archive (one record at least), and of those that train its dictionary.
ARCHIVE_BYTES, TRAIN_BYTES, DICT_BYTES = 16 << 20, 1 << 20, 32 << 10
RECORDS = "archive string, position long, record_type string, record_id string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, fault string"


def record(kind: str, record_id: str, uri: str | None, payload: bytes, sha1: str, refers_to: str | None, date: str) -> bytes:
    """One record; a revisit's block is the HTTP header alone, which still says the payload's length."""
    import base64

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in uri))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], level: int) -> bytes:
    """The records as an archive; a dictionary is trained on a spread of them, unless they are too few for one."""
    import zstandard

    every = max(1, sum(map(len, records)) // TRAIN_BYTES)
    sample, dictionary, out = records[::every], None, []
    if len(sample) >= 16:
        try:
            dictionary = zstandard.train_dictionary(DICT_BYTES, sample, level=level)
        except zstandard.ZstdError:  # too little in them that repeats
            dictionary = None
    if dictionary is not None:
        held = zstandard.ZstdCompressor(level=level).compress(dictionary.as_bytes())
        out.append(DICTIONARY + len(held).to_bytes(4, "little") + held)
        dictionary.precompute_compress(level=level)
    packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    out += [packer.compress(r) for r in records]
    return b"".join(out)


def frame_end(data: bytes, at: int) -> int:
    """Where the zstandard frame that begins at ``at`` ends, by its blocks' headers; ValueError if it is cut off."""
    import zstandard

    head = data[at : at + 18]
    try:
        pos, checked = at + zstandard.frame_header_size(head), zstandard.get_frame_parameters(head).has_checksum
    except zstandard.ZstdError as e:
        raise ValueError(f"frame header: {e}") from e
    last = False
    while not last:
        if pos + 3 > len(data):
            raise ValueError("frame cut off")
        h = int.from_bytes(data[pos : pos + 3], "little")
        last = bool(h & 1)
        pos += 3 + (1 if h >> 1 & 3 == 1 else h >> 3)
    pos += 4 * checked
    if pos > len(data):
        raise ValueError("frame cut off")
    return pos


def frames(data: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(position, decoded record, fault) of each frame; after a frame whose end can't be told nothing can be read."""
    import zstandard

    at, reader = 0, None
    while at < len(data):
        magic = data[at : at + 4]
        if magic != FRAME:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if len(data) < at + 8 + size or not SKIPPABLE <= int.from_bytes(magic, "little") < SKIPPABLE + 16 or len(magic) < 4:
                yield at, None, "neither a frame nor a whole skippable frame"
                return
            if at == 0 and magic == DICTIONARY:
                held = data[8 : 8 + size]
                try:
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(held) if held[:4] == FRAME else held
                    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
                except zstandard.ZstdError as e:
                    yield at, None, f"dictionary: {e}"
                    return
            at += 8 + size
            continue
        reader = reader or zstandard.ZstdDecompressor()
        try:
            end = frame_end(data, at)
        except ValueError as e:
            yield at, None, str(e)
            return
        try:
            decoder = reader.decompressobj()
            got, fault = decoder.decompress(data[at:end]), None
            if not decoder.eof:
                got, fault = None, "frame doesn't end"
        except zstandard.ZstdError as e:
            got, fault = None, f"frame: {e}"
        yield at, got, fault
        at = end


def fields(lines: bytes) -> dict[str, str]:
    """Header fields by lower-case name, the first of each."""
    out: dict[str, str] = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("a header line without a name")
        out.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
    return out


def parsed(data: bytes) -> dict:
    """The columns of one decoded record; ValueError says what is wrong with it."""
    import base64
    import hashlib

    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or not version.startswith(b"WARC/"):
        raise ValueError("no WARC header")
    has = fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in has:
            raise ValueError(f"no {name}")
    if not has["content-length"].isdigit() or len(rest) != int(has["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("content-length isn't the block's")
    bare = lambda name: has[name].strip("<>") if name in has else None
    out = {"record_type": has["warc-type"], "record_id": bare("warc-record-id"), "target_uri": has.get("warc-target-uri"), "refers_to": bare("warc-refers-to"), "payload": None}
    block, digest = rest[:-4], has.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if has.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        said = fields(http.partition(b"\r\n")[2]).get("content-length") if b"\r\n" in http else None
        if not gap or (said is not None and not said.isdigit()):
            raise ValueError("HTTP header")
        if out["record_type"] == "revisit":
            if payload or out["refers_to"] is None:
                raise ValueError("a revisit with a payload, or of nothing")
            return out | {"payload_bytes": None if said is None else int(said), "payload_digest": digest}
        if said is not None and int(said) != len(payload):
            raise ValueError("HTTP content-length isn't the payload's")
    else:
        payload = block
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest not in (None, own):
        raise ValueError("payload digest")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": own}


def revisits(pages: DataFrame, *, id_col: str, payload, min_bytes: int) -> DataFrame:
    """``pages`` with _revisits: null, or for a revisit a struct of the id of the response with the same payload.

    Payloads are compared by SHA-256 and length.  The response is the row of least
    id, null ids last; of rows equal in id and payload one.  Only digests are grouped,
    and only those found twice are joined back; a payload that many pages share is
    one key of that join, which Spark splits.
    """
    key = F.sha2(payload, 256)
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"))
    keyed = pages.withColumn("_key", key)
    seen = pages.filter(F.octet_length(payload) >= min_bytes).select(key.alias("_key"), order.alias("_o")).groupBy("_key", "_o").agg(F.count(F.lit(1)).alias("_n"))
    groups = written(seen.groupBy("_key").agg(F.min(F.struct("_o", "_n")).alias("_first"), F.sum("_n").alias("_rows")).filter("_rows > 1").select("_key", "_first"), "warc-groups")
    joined = keyed.join(groups, "_key", "left")
    ask = F.struct(F.col("_first._o.id").alias("id"))
    mine = order == F.col("_first._o")
    none = F.lit(None).cast(f"struct<id: {pages.schema[id_col].dataType.simpleString()}>")
    out = joined.withColumn("_revisits", F.when(F.col("_first").isNull() | mine, none).otherwise(ask))
    if not groups.filter("_first._n > 1").isEmpty():  # rows equal in id and payload: all but one revisit it
        tied = F.coalesce((F.col("_first._n") > 1) & mine, F.lit(False))
        n = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0)))
        out = out.filter(~tied).unionByName(out.filter(tied).withColumn("_nth", n).withColumn("_revisits", F.when(F.col("_nth") > 1, ask).otherwise(none)).drop("_nth"))
    return out.drop("_first")


def warc_written(pages: DataFrame, path: str, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> str:
    """Write a record for each row as archives of about ARCHIVE_BYTES into the folder ``path``; returns it.

    Of rows with equal payloads of ``min_revisit_bytes`` or more one is a response,
    the others revisit it (see ``revisits``); null payloads are empty.  An archive is
    one file: a skippable frame with the dictionary trained on its own records (none
    if they are few), then a frame a record, then an empty skippable frame.  Spark's
    own writer commits the files, so they go to any file system it knows and a lost
    task leaves nothing behind; it names them ``.txt``.  Null ids are written as
    ``urn:x-null:``.
    """
    if len({id_col, uri_col, payload_col}) < 3:
        raise ValueError("id, URI and payload are three columns")
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    linked = revisits(rows, id_col="id", payload=F.col("payload"), min_bytes=min_revisit_bytes)
    urn = lambda c: F.coalesce(F.concat(F.lit("urn:x-record:"), F.url_encode(c.cast("string"))), F.lit("urn:x-null:"))
    again = F.col("_revisits").isNotNull()
    # a revisit's payload is not written, but its length is
    ready = linked.select(F.when(again, "revisit").otherwise("response").alias("kind"), urn(F.col("id")).alias("id"), "uri", "payload", F.sha1("payload").alias("sha1"), F.when(again, urn(F.col("_revisits.id"))).alias("refers"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for r in (x for i in range(0, batch.num_rows, 256) for x in batch.slice(i, 256).to_pylist()):
                held.append(record(r["kind"], r["id"], r["uri"], r["payload"], r["sha1"], r["refers"], date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([archive(held, level)], pa.binary())], names=["value"])
                    held, size = [], 0
                    released()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive(held, level)], pa.binary())], names=["value"])

    files = ready.mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    files.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)
    return path


def warc_records(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """The records of all archives in the folder ``path``.

    Returns per record: archive (its file), position (byte of its frame), record_type,
    record_id, target_uri, refers_to (an id; null unless a revisit), payload (binary;
    null for revisits and without ``with_payload``), payload_bytes and payload_digest
    (base-32 SHA-1; both of the full payload, a revisit's as its headers say), and
    fault: null, or what is wrong with the record (frame, headers, lengths, digest),
    whose other columns are then null.  Behind a frame whose end can't be told, the
    rest of its archive is one row with a fault.  An empty archive has no rows.  An
    archive is read whole by one task; records are decoded one after another.
    """
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size = [], 0
                for at, got, fault in frames(data.as_py() or b""):
                    row = dict.fromkeys(names) | {"archive": name.as_py(), "position": at, "fault": fault}
                    if fault is None:
                        try:
                            row |= parsed(got)
                        except ValueError as e:
                            row["fault"] = str(e)
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if size > 4 << 20 or len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)
            released()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, RECORDS)


def page_of(urn):
    """The id in a record's urn, null for the urn of null."""
    return F.when(F.startswith(urn, F.lit("urn:x-record:")), F.url_decode(F.substring_index(urn, ":", -1)))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives into the shared folder, and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = warc_written(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    back, kind = warc_records(spark, path, with_payload=False), pages.schema["page_id"].dataType
    return back.select(page_of(F.col("record_id")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).cast(kind).alias("refers_to"))


#: DuckDB has no base 32: the SHA-1's hexadecimal digits, five at a time, are four characters each.
OP12_SQL = """
with p as (select page_id, coalesce(html, '') as payload from pages),
h as (select page_id, payload, sha1(payload) as s, row_number() over w as n, first_value(page_id) over w as first_id
      from p window w as (partition by payload order by page_id nulls last))
select page_id, strlen(payload)::bigint as payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, (1 + 5 * (i // 4))::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31), 1)), 'string_agg', '') as payload_digest,
    case when n = 1 then 'response' else 'revisit' end as record_type,
    case when n > 1 then first_id end as refers_to
from h
"""
