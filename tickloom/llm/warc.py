"""Web archives: writing records with revisits, and reading them back by byte ranges with boundary-chain verification.

*Writing.* A page whose payload another page with a smaller id has becomes a revisit record. Records are the lines of Spark's text writer with a record
end as the separator, so archives can be written wherever Spark can write.

*Reading.* Spark's text reader splits the files at every ``WARC/1.1`` line, also at those inside payloads. Each piece is a candidate record. A task gives
for each candidate the offset of its successor, by its Content-Length, and the end of the chain inside its own split; pointer jumping over the splits then
keeps the candidates that are reachable from the start of the file, and only those are records. Payloads in which the mark occurs are put together from
the pieces between two records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.words import parts
from tickloom.session import scratch_path, settle

MARK = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
#: Records of at least this payload size can be revisits.
MIN_REVISIT_BYTES = 0
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "html"):
        data = batch.column("html").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([payload_digest(x) for x in data], pa.string()), pa.array([len(x) for x in data], pa.int64())], ["page_id", "digest", "bytes"])


def _records(date: str):
    """The text of each record without its end, which the writer adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "html"):
            out = []
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "revisits")]
            for page, url, data, revisits in zip(*columns, strict=True):
                name = "null" if page is None else str(page)
                digest = payload_digest(data)
                first = next((r["first"] for r in revisits or () if r["digest"] == digest), None)
                # a header value holds no white space
                target = "".join((url or "").split()) or f"urn:page:{name}"
                head = f"WARC-Record-ID: <urn:page:{name}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {target}\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\n"
                if first is None:
                    head += "WARC-Type: response\r\n"
                    block = _HTTP % len(data) + data
                else:
                    head += f"WARC-Type: revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:{first}>\r\n"
                    block = b""
                out.append(b"".join((MARK, head.encode(), b"Content-Length: %d" % len(block), END, block)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, date: str | None = None) -> None:
    """Write a record for each row of ``page_id, url, html`` to the folder ``path``.

    Of the rows with one payload of at least min_bytes bytes, that with the smallest page_id is the response and the others revisit it. Rows with a
    null page_id are always responses, rows that repeat a page_id and its payload are alike. A null html is empty. An empty table writes no record. All records of
    a call have the same date (UTC, as ``2024-01-31T12:00:00Z``; now, unless given), so a task that runs again writes the same bytes.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary")).alias("html"))
    digests = pages.filter("page_id IS NOT NULL").select("page_id", "html").mapInArrow(_digests, "page_id long, digest string, bytes long").filter(F.col("bytes") >= min_bytes)
    digests = settle(digests.select("page_id", "digest"))
    least = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("most")).filter("first < most").select("digest", "first")
    # only pages that revisit come back to the texts; the planner broadcasts them where they are few
    revisits = settle(digests.join(least, "digest").filter("page_id > first").groupBy("page_id").agg(F.collect_set(F.struct("digest", "first")).alias("revisits")))
    named = pages.join(revisits, "page_id", "left").select("page_id", "url", "html", "revisits")
    named.mapInArrow(_records(date), "value string").write.option("lineSep", END.decode()).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between the marks, in file order within each split."""
    lines = spark.read.option("lineSep", MARK.decode()).text(path)
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, int, bytes]]:
    """(file, split), number and place of each piece in its split, and its bytes."""
    now, number, place = None, 0, 0
    for batch in batches:
        files, blocks, values = (batch.column(c) for c in ("file", "block", "value"))
        for k in range(batch.num_rows):
            key = (files[k].as_py(), blocks[k].as_py())
            if key != now:
                now, number, place = key, 0, 0
            value = values[k].as_py()
            yield key, number, place, value
            number, place = number + 1, place + len(value) + len(MARK)


def _parsed(value: bytes) -> dict | None:
    """Header fields of a candidate (what follows a mark) and its length from the mark to the next record; None without a whole header."""
    stop = value.find(END)
    if stop < 0:
        return None
    fields = {}
    for line in value[:stop].split(b"\r\n"):
        name, colon, content = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = content.strip()
    size = fields.get(b"content-length", b"")
    if not size.isdigit():
        return None
    return fields | {"block": stop + len(END), "length": len(MARK) + stop + len(END) + int(size) + len(END)}


def _page(text: bytes) -> int | None:
    name = text.removeprefix(b"<urn:page:").removesuffix(b">")
    return int(name) if name.lstrip(b"-").isdigit() else None


def _content(value: bytes, fields: dict) -> dict:
    """What a whole record says: page, type, target of a revisit, size and digest of its payload."""
    kind = fields.get(b"warc-type", b"").decode()
    out = {"page_id": _page(fields.get(b"warc-record-id", b"")), "record_type": kind, "refers_to": None, "bytes": None, "digest": fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")}
    if kind == "revisit":
        return out | {"refers_to": _page(fields.get(b"warc-refers-to", b""))}
    block = value[fields["block"] : fields["length"] - len(MARK) - len(END)]
    payload = block[block.find(END) + len(END) :]
    return out | {"bytes": len(payload), "digest": payload_digest(payload)}


_CONTENT = "page_id long, record_type string, refers_to long, bytes long, digest string"
_CANDIDATE = f"file string, block long, number long, place long, size long, next long, leaves long, whole boolean, {_CONTENT}"


def _table(rows: list[dict], kind: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types[t]) for n, t in fields], [n for n, _ in fields])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece. ``place`` is that of its mark in the split, ``next`` that of its successor, ``leaves`` that where the chain
    from it leaves the split; both are null without a valid header."""

    def chained(rows: list[dict]) -> pa.RecordBatch:
        ends: dict[int, int] = {}
        for r in reversed(rows):
            if r["next"] is not None:
                r["leaves"] = ends[r["place"]] = ends.get(r["next"], r["next"])
        return _table(rows, _CANDIDATE)

    rows: list[dict] = []
    now = None
    for key, number, place, value in _numbered(batches):
        if key != now:
            if rows:
                yield chained(rows)
            now, rows = key, []
        row = {"file": key[0], "block": key[1], "number": number, "place": place - len(MARK), "size": len(value), "next": None, "whole": False}
        # what stands before the first mark of a file is no candidate
        fields = None if key[1] == 0 and number == 0 else _parsed(value)
        if fields:
            row |= {"next": row["place"] + fields["length"], "whole": len(value) + len(MARK) >= fields["length"] - len(END)}
            if row["whole"]:
                row |= _content(value, fields)
        rows.append(row)
    if rows:
        yield chained(rows)


def _reached(table: pa.Table) -> pa.Table:
    """The pieces of one split with the record each belongs to: null before the split's first record."""
    rows = sorted(table.to_pylist(), key=lambda r: r["number"])
    at = next((r["entry"] for r in rows if r["entry"] is not None), None)
    record = None
    for r in rows:
        if at is not None and r["at"] == at and r["next_at"] is not None:
            record, at = at, r["next_at"]
        r["record"] = record
    return pa.Table.from_batches([_table(rows, _REACHED)])


_REACHED = f"file string, block long, number long, at long, next_at long, whole boolean, {_CONTENT}, record long"


def _joined_pieces(table: pa.Table) -> pa.Table:
    """A record whose payload holds the mark, put together from its pieces."""
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    value = MARK.join(r["value"] for r in rows)
    fields = _parsed(value)
    return pa.Table.from_batches([_table([_content(value, fields)] if fields else [], _CONTENT)])


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, number, _, value in _numbered(batches):
        yield _table([{"file": key[0], "block": key[1], "number": number, "value": value}], "file string, block long, number long, value binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record in the archives of a folder.

    Digests and sizes are those of the full payload, for a revisit those of the response it refers to (null where that is missing). What
    no chain from the start of its file reaches is no record. Files without a record give none.
    """
    found = settle(_pieces(spark, path).mapInArrow(_candidates, _CANDIDATE))
    # offsets in the file: the sizes of the splits before (as many rows as splits)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MARK)).alias("bytes_"))
    bases = settle(splits.withColumn("base", F.coalesce(F.sum("bytes_").over(before), F.lit(0))).select("file", "block", "base"))
    placed = found.join(bases, ["file", "block"]).withColumns({"at": F.expr("base + place"), "next_at": F.expr("base + next"), "leaves_at": F.expr("base + leaves")})
    # only where a chain enters a split can matter: the start of the file, and wherever a chain of another split leads
    targets = placed.filter("leaves_at IS NOT NULL").select("file", F.col("leaves_at").alias("at")).union(placed.filter("at = 0").select("file", "at")).distinct()
    jumps = settle(placed.filter("leaves_at IS NOT NULL").join(targets, ["file", "at"]).select("file", "at", F.col("leaves_at").alias("to")))
    reached = settle(jumps.filter("at = 0").select("file", "at"))
    count = reached.count()
    while count:
        step = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at")).join(jumps.select("file", "at"), ["file", "at"], "left_semi")
        reached = settle(reached.union(step).distinct())
        new = reached.count()
        if new == count:
            break
        count = new
        jumps = settle(jumps.alias("x").join(jumps.alias("y"), (F.col("x.file") == F.col("y.file")) & (F.col("x.to") == F.col("y.at")), "left").select("x.file", "x.at", F.coalesce("y.to", "x.to").alias("to")))
    entries = placed.join(reached, ["file", "at"], "left_semi").groupBy("file", "block").agg(F.min("at").alias("entry"))
    local = settle(placed.join(entries, ["file", "block"], "left").select("file", "block", "number", "at", "next_at", "whole", *[f.split()[0] for f in _CONTENT.split(", ")], "entry").groupBy("file", "block").applyInArrow(_reached, _REACHED))
    fields = [f.split()[0] for f in _CONTENT.split(", ")]
    records = local.filter("record = at").select(*fields, "whole", "file", "record")
    # pieces of records that hold the mark, also those in later splits
    last = local.groupBy("file", "block").agg(F.max("record").alias("last")).withColumn("from", F.max("last").over(before)).select("file", "block", "from")
    owned = local.join(last, ["file", "block"]).withColumn("record", F.coalesce("record", "from"))
    torn = records.filter("NOT whole").select("file", "record")
    wanted = settle(owned.join(torn, ["file", "record"]).select("file", "block", "number", "at", "record"))
    whole = records.filter("whole").select(*fields)
    if wanted.limit(1).count():
        pieces = _pieces(spark, path).mapInArrow(_values, "file string, block long, number long, value binary").join(wanted, ["file", "block", "number"])
        whole = whole.union(pieces.select("file", "record", "at", "value").groupBy("file", "record").applyInArrow(_joined_pieces, _CONTENT))
    whole = settle(whole)
    sources = whole.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "digest", F.col("bytes").alias("full")).distinct()
    out = whole.join(sources, ["refers_to", "digest"], "left")
    return out.select("page_id", F.coalesce("bytes", "full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``page_id, url, html`` to archives in the shared folder and read the records back, one row per page (see read_archives).

    A null html has an empty payload, a null page_id stays null, an empty table gives an empty result; further columns are ignored.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)


#: DuckDB statement for archive_pages over the table pages; base32 takes five bits at a time from two hexadecimal digits.
PAGES_SQL = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((((strpos('0123456789abcdef', substr(h, 5 * i // 4 + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 5 * i // 4 + 2, 1)) - 1) >> (3 - 5 * i % 4)) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed
"""
