"""WARC archives with a two-level capture index.

Records are gzip members of their own, so that any can be read by its byte range. The index sorts
captures by reversed-host URL key over range-dealt partitions: each writes blocks of lines, packed
one gzip member a block, and returns a row per block for the sparse directory (first key, file,
offset, length). A lookup searches the directory by bisection, reads the one or few blocks that may
hold the key, and range-reads the records they name. Reading everything back goes the same way:
directory, blocks, then record ranges ordered by place.

Equal payloads of a least size are stored once, as the response of the largest page id; the others
are revisits that name it and carry its digest and length.

Defined cases: a null page is an empty payload; a null URL is keyed by its record name; a null page
id is a revisit where another row has its payload; repeated rows give a record each; an empty table
writes no file; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.llm.common import fresh_dir, map_frames, materialise, parts_for
from plumbago.llm.files import FolderWriter, open_file

#: Fixed values of the format: the profile of revisits and the end of a record.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
CAPTURES = "key string, page_id long, file string, offset long, length long"
DIRECTORY = "first_key string, first_page long, file string, offset long, length long, lines long, record_bytes long"


def url_key(url: str) -> str:
    """Reversed host, then path and query: ``https://www.a.example.com:443/x?y#z`` is ``com,example,a)/x?y``."""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return re.sub(r"\s", "%20", url.strip().lower())
    if not host:
        return re.sub(r"\s", "%20", url.strip())
    labels = host.rstrip(".").split(".")
    if len(labels) > 2 and re.fullmatch(r"www\d*", labels[0]):
        labels = labels[1:]
    shown = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return ",".join(reversed(labels)) + shown + ")" + re.sub(r"\s", "%20", (parts.path or "/") + ("?" + parts.query if parts.query else ""))


def record_name(page_id: int | None) -> str:
    return f"urn:plumbago:page:{'' if page_id is None else page_id}"


def named_page(name: str) -> int | None:
    tail = name.strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_name(page_id)}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else record_name(page_id)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{record_name(refers_to)}>"]
    return gzip.compress("\r\n".join(head).encode() + END + block + END, compresslevel=4, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, of its HTTP message, and the payload; the length and digest are checked."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(END)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != END:
        raise ValueError("the record's length is wrong")
    http, _, payload = block.partition(END)
    inner = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    if fields["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != fields["warc-payload-digest"][5:]:
        raise ValueError("the payload's digest is wrong")
    return fields, inner, payload


def write_archives(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000,
    file_bytes: int = 256 << 20, date: str = "2024-01-01T00:00:00Z",
) -> tuple[str, DataFrame]:
    """Write a record for every row; returns the folder and the captures (key, page_id, file, offset, length)."""
    spark = df.sparkSession
    folder = fresh_dir(spark, "warc")
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.sha1("html")))
    kept = pages.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n"))
    kept = materialise(kept.where("n > 1 and kept is not null").select("digest", "kept"), "payloads")  # written first: the join below can then split hot payloads
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    # small pages, which have no digest, are dealt by a key of their own that finds nothing
    place = F.coalesce("digest", F.concat(F.lit("small "), F.xxhash64("page_id", "url", "html").cast("string")))
    typed = pages.withColumn("place", place).join(kept.withColumnRenamed("digest", "place"), "place", "left").select("page_id", "url", "html", F.when(revisit, F.col("kept")).alias("refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, name, out, at = None, None, None, 0
        for pdf in batches:
            rows = []
            for page_id, url, html, refers in zip(pdf["page_id"].astype("Int64"), pdf["url"], pdf["html"], pdf["refers_to"].astype("Int64")):
                page_id, refers = (None if x is pd.NA else int(x) for x in (page_id, refers))
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    writer = writer or FolderWriter(folder)
                    (name, out), at = writer.create(".warc.gz"), 0
                member = build_record(page_id, url, html.encode("utf-8"), refers, refers is not None, date)
                out.write(member)
                rows.append((url_key(url) if url else record_name(page_id), page_id, name, at, len(member)))
                at += len(member)
            yield pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length"], dtype=object)
        if out is not None:
            out.close()

    return folder, materialise(typed.transform(map_frames, run, CAPTURES), "captures")


def build_index(folder: str, captures: DataFrame, block_lines: int = 3000, shard_rows: int = 300_000) -> DataFrame:
    """Write the sorted, blocked index beside the archives; returns the sparse directory."""
    shards = parts_for(captures.count(), shard_rows, 4)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = out = None
        at, rows, held = 0, [], []

        def flush() -> None:
            nonlocal name, out, at
            if out is None:
                name, out = FolderWriter(folder).create(".cdx.gz")
            member = gzip.compress("\n".join(" ".join(map(str, x)) for x in held).encode(), compresslevel=6, mtime=0)
            out.write(member)
            rows.append((held[0][0], None if held[0][1] == "-" else held[0][1], name, at, len(member), len(held), sum(x[4] for x in held)))
            at += len(member)
            held.clear()

        for pdf in batches:
            for key, page_id, file, offset, length in zip(pdf["key"], pdf["page_id"].astype("Int64"), pdf["file"], pdf["offset"], pdf["length"]):
                held.append((key, "-" if page_id is pd.NA else page_id, file, offset, length))
                if len(held) >= block_lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            yield pd.DataFrame(rows, columns=["first_key", "first_page", "file", "offset", "length", "lines", "record_bytes"], dtype=object)

    dealt = captures.repartitionByRange(shards, "key", "page_id").sortWithinPartitions("key", "page_id")
    return materialise(dealt.transform(map_frames, run, DIRECTORY), "directory")


def read_block(folder: str, file: str, offset: int, length: int) -> list[tuple[str, int | None, str, int, int]]:
    with open_file(folder, file) as source:
        source.seek(offset)
        lines = gzip.decompress(source.read(length)).decode().split("\n")
    out = []
    for line in lines:
        key, page, name, at, n = line.rsplit(" ", 4)
        out.append((key, None if page == "-" else int(page), name, int(at), int(n)))
    return out


def read_archives(folder: str, directory: DataFrame, with_payload: bool = False, part_bytes: int = 16 << 20) -> DataFrame:
    """All records, by way of the index: blocks from the directory, then record ranges in file order."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, offset, length in zip(pdf["file"], pdf["offset"], pdf["length"]):
                yield pd.DataFrame([x[2:] for x in read_block(folder, file, offset, length)], columns=["file", "offset", "length"])

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_name, source = None, None
        for pdf in batches:
            rows = []
            for file, offset, length in zip(pdf["file"], pdf["offset"], pdf["length"]):
                if file != open_name:
                    if source is not None:
                        source.close()
                    open_name, source = file, open_file(folder, file)
                if source.tell() != offset:
                    source.seek(offset)
                fields, inner, payload = parse_record(source.read(length))
                kind = fields["warc-type"]
                row = (
                    named_page(fields["warc-record-id"]), fields["warc-target-uri"],
                    len(payload) if kind == "response" else int(inner["content-length"]),
                    base64.b32decode(fields["warc-payload-digest"][5:]).hex(), kind,
                    named_page(fields["warc-refers-to"]) if kind == "revisit" else None,
                )
                rows.append((*row, payload.decode("utf-8")) if with_payload else row)
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            yield pd.DataFrame(rows, columns=names[: 7 if with_payload else 6], dtype=object)
        if source is not None:
            source.close()

    n, size = directory.agg(F.count(F.lit(1)), F.sum("record_bytes")).first()
    found = directory.select("file", "offset", "length").repartition(max(1, n)).transform(map_frames, blocks, "file string, offset long, length long")
    placed = found.repartitionByRange(parts_for(size or 0, part_bytes), "file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload string" * with_payload
    return placed.transform(map_frames, records, schema)


class CaptureIndex:
    """Lookups by URL over a directory that is held sorted (one row for thousands of captures)."""

    def __init__(self, folder: str, directory_rows: list) -> None:
        self.folder = folder
        self.rows = sorted(directory_rows, key=lambda r: (r["first_key"], r["first_page"] if r["first_page"] is not None else -(1 << 63)))
        self.keys = [r["first_key"] for r in self.rows]

    def captures(self, url: str) -> list[tuple[str, int | None, str, int, int]]:
        key = url_key(url)
        i, found = max(0, bisect_left(self.keys, key) - 1), []
        while i < len(self.rows) and self.keys[i] <= key:
            r = self.rows[i]
            found += [x for x in read_block(self.folder, r["file"], r["offset"], r["length"]) if x[0] == key]
            i += 1
        return found

    def records(self, url: str) -> list[tuple[dict[str, str], dict[str, str], bytes]]:
        out = []
        for _, _, file, offset, length in self.captures(url):
            with open_file(self.folder, file) as source:
                source.seek(offset)
                out.append(parse_record(source.read(length)))
        return out
