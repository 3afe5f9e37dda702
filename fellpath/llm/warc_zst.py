"""Zstandard WARC archives: writing and reading one frame per record.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself compressed; each record is one frame compressed with it, so
records are found and decoded one by one. The reader loads the dictionary from
that frame, decodes frame after frame, and validates version, mandatory
headers, block length, end of record, the HTTP head's length and the payload
digest.

Archives are files of bounded size under a shared folder: a task writes each
under a temporary name and renames it, in an order and under names that depend
on its rows only, so a task that runs again replaces its files by equal ones.
The table of archives that a write returns is the manifest; files of tasks that
never finished are not in it.

Defined results: a null payload is empty; a null URL has no target header; a
record that fails validation is returned with ``error`` set and what was read
of it; repeated rows give repeated records of one type; a null id has a record
named so, which revisits the smallest id of an equal payload (rows without any
id are all responses); an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellpath.llm._tables import fresh_path, materialise

#: Fixed values of the format.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads from this size on are written once.
REVISIT_BYTES = 100
#: A dictionary is trained on so many payloads at most, of so many bytes each, to so many bytes.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 32_768
ARCHIVE_BYTES = 16_000_000
LEVEL = 3
#: Ways in which the rows of one digest are dealt out.
SALTS = 8
DATE = "2024-01-01T00:00:00Z"


def train_dictionary(pages: DataFrame, payload: str) -> bytes:
    """A dictionary from the ``SAMPLES`` distinct payloads with the smallest hashes.

    Hashes are compared first, so only the payloads chosen are sent."""
    hashed = pages.select(F.substring(payload, 1, SAMPLE_BYTES).alias("p"), F.xxhash64(payload).alias("h")).where(F.length("p") > 0)
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLES).collect()]
    if len(least) < 16:
        return b""
    samples = [bytes(r["p"]) for r in hashed.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min("p").alias("p")).orderBy("h").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def _clean(value: str) -> str:
    """A header value: control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record; a revisit has the HTTP head of the payload but not its body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def archive_head(dictionary: bytes) -> bytes:
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def _open(data: bytes) -> tuple[zstandard.ZstdDecompressor, int]:
    """A decompressor with the archive's dictionary, and where records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        return zstandard.ZstdDecompressor(), 0
    size = struct.unpack_from("<I", data, 4)[0]
    body = data[8 : 8 + size]
    if len(body) != size:
        raise ValueError("dictionary frame cut short")
    if len(body) >= 4 and struct.unpack_from("<I", body)[0] == FRAME:
        body = zstandard.ZstdDecompressor().decompress(body)
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)), 8 + size


def read_archive(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """(record, error) of every frame; what follows a broken frame is unreadable."""
    try:
        reader, at = _open(data)
    except (ValueError, zstandard.ZstdError) as e:
        yield b"", f"dictionary: {e}"
        return
    view = memoryview(data)
    while at < len(data):
        try:
            one = reader.decompressobj()
            parts, held = [], at
            while not one.eof and held < len(data):
                piece = view[held : held + 65_536]
                parts.append(one.decompress(piece))
                held += len(piece)
            if not one.eof:
                yield b"".join(parts), "frame cut short"
                return
            at = held - len(one.unused_data)
            yield b"".join(parts), None
        except zstandard.ZstdError as e:
            yield b"", f"frame: {e}"
            return


def parse_record(record: bytes) -> dict:
    """Fields of a record; ``error`` names the first check that fails."""
    out: dict = {"page_id": None, "url": None, "record_type": None, "payload_digest": None, "payload_bytes": None, "refers_to": None, "payload": None, "error": None}
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or lines[0].encode() != VERSION:
        return out | {"error": "version"}
    fields = dict(line.partition(": ")[::2] for line in lines[1:])
    missing = [name for name in MANDATORY if name not in fields]
    if missing:
        return out | {"error": f"missing {missing[0]}"}
    out |= {"record_type": fields["WARC-Type"], "url": fields.get("WARC-Target-URI")}
    try:
        length = int(fields["Content-Length"])
        name = fields["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
        out["page_id"] = None if name == "null" else int(name)
        if "WARC-Refers-To" in fields:
            out["refers_to"] = int(fields["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">"))
    except ValueError:
        return out | {"error": "number"}
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        return out | {"error": "length"}
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    sizes = [x[15:].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not gap or len(sizes) != 1 or not sizes[0].isdigit():
        return out | {"error": "http head"}
    out |= {"payload_bytes": int(sizes[0]), "payload_digest": fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")}
    if out["record_type"] == "revisit":
        return out | {"error": "revisit" if payload or out["refers_to"] is None or fields.get("WARC-Profile") != REVISIT_PROFILE else None}
    if out["record_type"] != "response":
        return out | {"error": "type"}
    if len(payload) != out["payload_bytes"]:
        return out | {"error": "payload length"}
    if hashlib.sha256(payload).hexdigest() != out["payload_digest"]:
        return out | {"error": "digest"}
    return out | {"payload": payload}


def _plan(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """Rows (id, url, payload, digest, refers_to)."""
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.encode(F.col(html).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.coalesce("id", F.xxhash64("url")), F.lit(SALTS)).cast("int")).join(first, ["digest", "salt"], "left")
    return rows.select("id", "url", F.when((F.col("first") < F.col("id")) | F.col("id").isNull(), F.col("first")).alias("refers_to"), "digest", "payload")


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row under ``folder`` and return the manifest:
    ``path``, ``records`` and ``bytes`` of every archive."""
    from pyarrow import fs

    encoded = pages.select(F.encode(F.col(html).cast("string"), "UTF-8").alias("p"))
    dictionary = train_dictionary(encoded, "p")
    rows = _plan(pages, page_id, url, html).sortWithinPartitions("id", "url", "digest")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        writer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **options)
        held, size, records, done = [archive_head(dictionary)], 0, 0, []

        def close() -> None:
            nonlocal held, size, records
            name = f"{base}/part-{task.partitionId():05d}-{len(done):05d}.warc.zst"
            data = b"".join(held)
            with store.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp", compression=None) as out:
                out.write(data)
            store.move(f"{name}.{task.taskAttemptId()}.tmp", name)
            done.append((f"{folder}/{name.rpartition('/')[2]}", records, len(data)))
            held, size, records = [archive_head(dictionary)], 0, 0

        for batch in batches:
            for key, target, refers, digest, payload in zip(batch["id"], batch["url"], batch["refers_to"], batch["digest"], batch["payload"], strict=True):
                frame = writer.compress(build_record(None if key is None else int(key), target if isinstance(target, str) else None, bytes(payload), digest, None if pd.isna(refers) else int(refers)))
                held.append(frame)
                size, records = size + len(frame), records + 1
                if size >= archive_bytes:
                    close()
        if records:
            close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"]).astype({"path": object, "records": np.int64, "bytes": np.int64})

    kept = rows.withColumns({c: F.col(c).cast("string") for c in ("id", "refers_to")})
    return materialise(kept.mapInPandas(write, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives that ``manifest`` lists (``path``), validated."""
    from pyarrow import fs

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                store, base = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
                with store.open_input_stream(base, compression=None) as source:
                    data = source.read()
                rows, size = [], 0
                for record, error in read_archive(data):
                    rows.append(parse_record(record) if error is None else parse_record(b"") | {"error": error})
                    rows[-1]["path"] = path
                    size += len(record)
                    if size > 16_000_000:
                        yield _frame(rows)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows)

    schema = "path string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary, error string"
    n = max(1, min(manifest.count(), 10_000))
    return manifest.select("path").repartition(n, "path").mapInPandas(read, schema)


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["path", "page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload", "error"], dtype=object)
    for name in ("page_id", "payload_bytes", "refers_to"):
        out[name] = pd.array(out[name].tolist(), "Int64")
    return out


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, page_id, url, html))
