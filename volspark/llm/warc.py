"""WARC archives with a two-level capture index.

Writing: pages meet the smallest id of their payload digest (a join on digests that occur twice, which adaptive
execution splits when one digest is hot), then each task writes its rows to archives of about ``archive_bytes``,
a gzip member per record, and reports where each record lies. File names are unique to the attempt and only records
of committed tasks reach the capture table, so lost executors and retries leave orphans but never wrong offsets.

Index: captures are range-sorted by (reversed-host URL key, id) and packed into blocks of ``block_rows`` entries,
compressed as one value each. The sparse directory holds the first entry of each block of a part; above it, the first
entry of each part (as many as partitions) is the second level. A lookup binary-searches the parts, then the part's
directory, inflates that block alone, binary-searches it and yields file, offset and length for a range read.

Reading: looked-up records are grouped by archive and sorted by offset, so an archive is opened once and read
forward by ranges; headers are parsed and payloads cut by Content-Length.

Defined cases: null html is an empty payload; null url has the empty key; payloads under 100 bytes are always responses;
repeated ids are records of their own: a response is named by id and payload digest, others by id, archive and number in it; the
page id has its own header. Of equal payloads with one smallest page_id the least url (null first) is the response, of equal rows one; all others
revisit it, rows without an id as well; where no row of a payload has an id, all are responses, as there is none to refer to. page_id is a whole number. A very long payload is one record, held whole by its task.
"""

from __future__ import annotations

import bisect
import gzip
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.llm.common import fresh_path, materialise, table

LEAST_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "url_key string, page_id long, record string, record_type string, file string, offset long, length long"


def surt(url: Column) -> Column:
    """Reversed-host key: ``http://a.Example.org/x?y`` is ``org,example,a)/x?y``; without :// the url itself."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), F.substr(rest, F.length(host) + 1))
    return F.when(url.isNull(), F.lit("")).when(at > 0, key).otherwise(url)


def record_bytes(record: str, record_type: str, url: str, payload: bytes, digest: str, refers_to: str | None, page_id: int | None = None, size: int | None = None) -> bytes:
    """One WARC record as a gzip member. A revisit has no payload; its block length is 0, and size tells how long the payload is."""
    head = [("WARC-Type", record_type), ("WARC-Record-ID", f"<urn:volspark:{record}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", " ".join(url.split())), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if record_type == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:volspark:{refers_to}>")]
    if page_id is not None:
        head += [("WARC-Page-ID", str(page_id))]
    head += [("WARC-Payload-Length", str(len(payload) if size is None else size))]
    body = b"" if record_type == "revisit" else payload
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n", 5, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of an inflated record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    names = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(names["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return names, rest[:n]


def _writer(root: str, archive_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = pafs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        out, name, at, number, pending = None, "", 0, 0, None
        try:
            for b in batches:
                rows = []
                for r in b.itertuples(index=False):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        own = uuid.uuid4().hex
                        name, at, number = f"{base}/{own}.warc.gz", 0, 0
                        out = store.open_output_stream(name, compression=None)
                    page_id = None if pd.isna(r.page_id) else int(r.page_id)
                    record = f"{page_id}-{own}-{number}" if r.name is None else r.name
                    number += 1
                    kind = "response" if pd.isna(r.refers_to) else "revisit"
                    data = record_bytes(record, kind, r.url or "", (r.html or "").encode("utf-8", "surrogatepass"), r.digest, r.refers_name, page_id, int(r.size))
                    out.write(data)
                    rows.append((r.url_key, page_id, record, kind, name, at, len(data)))
                    at += len(data)
                frame = pd.DataFrame(rows, columns=["url_key", "page_id", "record", "record_type", "file", "offset", "length"])
                frame["page_id"] = frame["page_id"].astype("Int64")
                if pending is not None:
                    yield pending
                pending = frame
            if out is not None:
                out.close()
                out = None
            if pending is not None:  # the last rows are told only once the last archive is complete
                yield pending
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, archive_bytes: int = 64 << 20, root: str | None = None) -> DataFrame:
    """pages: page_id, url, html. Writes the archives and returns the capture table, itself written to the shared folder."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # written first, so that its size is known: without repeats the join moves no page
    repeats = materialise(p.where("page_id is not null").groupBy("page_id").count().where("count > 1").select(F.col("page_id").alias("again")), "repeats")
    keyed = p.join(repeats, F.col("page_id") == F.col("again"), "left").select("page_id", "url", "html", surt(F.col("url")).alias("url_key"), F.sha2(raw, 256).alias("digest"), F.octet_length(raw).alias("size"), F.col("again").isNotNull().alias("repeated"))
    large = F.col("size") >= LEAST_BYTES
    first = keyed.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("digest").alias("d"), "first")
    # equal rows of a repeated id come together (only the first needs its payload), and the least url of an id and payload is the first
    many = keyed.where("repeated").groupBy("page_id", "url", "url_key", "digest", "size", "repeated").agg(F.count("*").alias("n"), F.any_value("html").alias("html"))
    many = many.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    least = keyed.where(F.col("repeated") & large).groupBy("page_id", "digest").agg(F.min(F.struct("url")).alias("least")).toDF("t_id", "t_digest", "least")
    many = many.join(least, (F.col("page_id") == F.col("t_id")) & (F.col("digest") == F.col("t_digest")), "left")
    many = many.withColumn("leads", (F.col("k") == 1) & F.struct("url").eqNullSafe(F.col("least")))
    rows = keyed.where("not repeated").withColumn("leads", F.lit(True)).unionByName(many.select("page_id", "url", F.when((F.col("k") == 1) | ~large, F.col("html")).alias("html"), "url_key", "digest", "size", "repeated", "leads"))
    rows = rows.join(first, F.col("digest") == F.col("d"), "left")
    named = first.join(repeats, F.col("first") == F.col("again"), "left_semi").select(F.col("d").alias("named"))
    rows = rows.join(named, F.col("digest") == F.col("named"), "left")
    refers = F.when(large & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")) | ~F.col("leads")), F.col("first"))
    refers_name = F.when(refers.isNotNull(), F.concat(F.col("first").cast("string"), F.when(F.col("named").isNotNull(), F.concat(F.lit("-"), F.substring("digest", 1, 32))).otherwise("")))
    name = F.when(F.col("page_id").isNotNull() & ~F.col("repeated"), F.col("page_id").cast("string")).when(F.col("repeated") & large & refers.isNull(), F.concat(F.col("page_id").cast("string"), F.lit("-"), F.substring("digest", 1, 32)))
    rows = rows.select("page_id", "url", "html", "url_key", "digest", F.col("size").alias("size"), refers.alias("refers_to"), refers_name.alias("refers_name"), name.alias("name"))
    captures = rows.mapInPandas(_writer(root or fresh_path(pages.sparkSession, "warc"), archive_bytes), CAPTURE)
    return materialise(captures, "captures")


def _entry_key(url_key: str, page_id, record: str) -> tuple[str, int, str]:
    return url_key, -(1 << 63) if page_id is None or pd.isna(page_id) else int(page_id), record


def _packer(block_rows: int):
    def pack(rows: list[tuple], part: int, block: int) -> dict:
        first = rows[0]
        return {"part": part, "block": block, "first_key": first[0], "first_id": first[1], "first_record": first[2], "n": len(rows), "entries": zlib.compress(json.dumps(rows, separators=(",", ":")).encode(), 6)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block, held = None, 0, []
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                part = r.part if part is None else part
                held.append((*_entry_key(r.url_key, r.page_id, r.record), r.file, int(r.offset), int(r.length)))
                if len(held) == block_rows:
                    out.append(pack(held, part, block))
                    held, block = [], block + 1
            if out:
                yield pd.DataFrame(out)
        if held:
            yield pd.DataFrame([pack(held, part, block)])

    return run


#: Parts of an index, so that its top level (an entry a part) fits the driver and every task; beyond a billion captures parts grow.
MOST_PARTS = 16_384


def build_index(captures: DataFrame, block_rows: int = 256, part_rows: int = 65_536) -> DataFrame:
    """The index's blocks (part, block, first entry, n, compressed entries), written to the shared folder."""
    parts = min(MOST_PARTS, max(1, -(-captures.count() // part_rows)))
    keys = [F.col("url_key"), F.coalesce("page_id", F.lit(-(1 << 63))), F.col("record")]
    ordered = captures.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    blocks = ordered.mapInPandas(_packer(block_rows), "part int, block int, first_key string, first_id long, first_record string, n int, entries binary")
    return materialise(blocks, "cdx")


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: url_key, page_id, record. Adds file, offset and length of those captures that the index holds."""
    tops = index.where("block = 0").select("first_key", "first_id", "first_record", "part").collect()  # MOST_PARTS rows at most
    tops = sorted((r[0], r[1], r[2], r[3]) for r in tops)
    if not tops:
        return wanted.withColumns({"file": F.lit(None).cast("string"), "offset": F.lit(None).cast("long"), "length": F.lit(None).cast("long")}).limit(0)
    starts, numbers = [t[:3] for t in tops], [t[3] for t in tops]

    def route(keys: pd.Series, ids: pd.Series, records: pd.Series) -> pd.Series:
        return pd.Series([numbers[max(0, bisect.bisect_right(starts, _entry_key(*k)) - 1)] for k in zip(keys, ids, records, strict=True)], dtype="int32")

    def search(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        b = blocks.sort_values("block")
        directory = list(zip(b["first_key"], b["first_id"], b["first_record"], strict=True))
        entries, open_at, rows = [], -1, []
        found = []
        for k in sorted(_entry_key(*q) for q in zip(queries["url_key"], queries["page_id"], queries["record"], strict=True)):
            at = bisect.bisect_right(directory, k) - 1
            if at < 0:
                continue
            if at != open_at:  # queries come sorted: a block is inflated once
                entries, open_at = json.loads(zlib.decompress(b["entries"].iloc[at])), at
                rows = [tuple(e[:3]) for e in entries]
            i = bisect.bisect_left(rows, k)
            if i < len(rows) and rows[i] == k:
                found.append((k[0], k[2], *entries[i][3:]))
        return pd.DataFrame(found, columns=["url_key", "record", "file", "offset", "length"])

    routed = wanted.select("url_key", "page_id", "record").withColumn("part", F.pandas_udf(route, "int")("url_key", F.col("page_id"), "record"))
    return routed.groupBy("part").cogroup(index.groupBy("part")).applyInPandas(lambda q, b: search(b, q), "url_key string, record string, file string, offset long, length long")


def read_records(places: DataFrame) -> DataFrame:
    """places: file, offset, length. Range-reads each record: record, page_id, record_type, refers_to, url, digest, payload_bytes, payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, name, stream = None, None, None
        try:
            for b in batches:
                rows = []
                for file, offset, length in zip(b["file"], b["offset"], b["length"], strict=True):
                    if file != name:
                        if stream is not None:
                            stream.close()
                        store = store or pafs.FileSystem.from_uri(file if "://" in file else f"file://{file}")[0]
                        name, stream = file, store.open_input_file(file)
                    stream.seek(int(offset))
                    head, body = parse_record(gzip.GzipFile(fileobj=io.BytesIO(stream.read(int(length)))).read())
                    refers = head.get("warc-refers-to")
                    rows.append((head["warc-record-id"][14:-1], head.get("warc-page-id"), head["warc-type"], refers and re.sub("(?<=.)-[0-9a-f]{32}$", "", refers[14:-1]), head["warc-target-uri"], head["warc-payload-digest"].removeprefix("sha256:"), int(head["warc-payload-length"]), body))
                frame = pd.DataFrame(rows, columns=["record", "page_id", "record_type", "refers_to", "url", "digest", "payload_bytes", "payload"])
                frame["page_id"] = pd.array([None if i is None else int(i) for i in frame["page_id"]], dtype="Int64")
                yield frame
        finally:
            if stream is not None:
                stream.close()

    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.repartition(n, "file").sortWithinPartitions("file", "offset").mapInPandas(run, "record string, page_id long, record_type string, refers_to string, url string, digest string, payload_bytes long, payload binary")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = write_archives(table(spark, sf_dir, "pages"))
    index = build_index(captures)
    back = read_records(lookup(index, captures.select("url_key", "page_id", "record")))
    # a response's digest and size are those of the payload read back; a revisit has none, its headers tell them
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("digest"))
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return back.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP3_SQL = """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first, row_number() OVER (PARTITION BY d ORDER BY page_id NULLS LAST, url NULLS FIRST) AS k FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND first IS NOT NULL AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first IS NOT NULL AND k > 1 THEN first END AS refers_to
FROM f
"""
