"""WARC archives and a globally ordered capture index.

Writing: payloads that repeat (equal digest, at least ``min_bytes``) are written once, as a response of the smallest
page; the others become revisit records that refer to it. Each record is a gzip member of its own. Spark's text writer
puts them into archives of about ``archive_bytes`` in the shared folder; what it writes between them is an empty gzip
member, so an archive is one gzip file, and a record can be read alone from its ``offset`` and ``length``.

Reading: each archive is walked member by member, payload digests are verified, and the captures of an archive are
sorted by (URL key, timestamp, page): a run. ``merge_runs`` deals all runs to key ranges of about ``RANGE_ROWS``
captures, puts the rows of a run back into the order they have in it, and merges the runs of each range by a tree of
losers, so that the ranges in their order are the whole capture history. The ranges are cut by the whole order, so one
very common URL is spread over many.

Cases: null html: empty payload; null URL: empty; line breaks in a URL are dropped. Null page: always a response, last
among equals. Rows that repeat page and payload are all responses or all revisits. Very long pages: an archive is as
long as its longest record at least; records are compressed and read one at a time. Empty table: no archive, no
captures. Input columns other than page, URL and html are not archived, so none can clash.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch_path, work_table

#: Capture times count from here, one second a page, where the input has none.
FIRST_CAPTURE = 1_704_067_200
MAX_BROADCAST_BYTES = 32 << 20
#: Captures that one task merges.
RANGE_ROWS = 100_000
#: An empty gzip member: what stands between records.
BETWEEN = gzip.compress(b"", mtime=0)
CAPTURE = "archive string, offset long, length long, place long, record_id string, refers_id string, record_type string, page_id long, url string, urlkey string, captured string, payload_bytes long, payload_digest string, refers_to long"
FIELDS = [f.split()[0] for f in CAPTURE.split(", ")]


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def with_first(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, url, payload, digest) and, for revisits, the page and URL of the response they refer to."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    repeated = work_table(
        rows.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
        .filter("n > 1 and first is not null")
        .select(F.col("digest").alias("_digest"), "first"),
        "repeated-payloads",
    )
    size = repeated.agg(F.sum(F.octet_length("first.url") + 128)).first()[0] or 0
    joined = rows.join(F.broadcast(repeated) if size <= MAX_BROADCAST_BYTES else repeated, F.col("digest") == F.col("_digest"), "left").drop("_digest")
    return joined.withColumn("first", F.when(F.col("page_id") > F.col("first.page_id"), F.col("first")))


def record(captured: Column) -> Column:
    """The text of a WARC record."""
    end = "\r\n"
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=UTF-8{end}Content-Length: "), F.octet_length("payload"), F.lit(end + end))
    revisit = F.col("first").isNotNull()
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))
    refers = F.concat(
        F.lit(f"{end}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{end}WARC-Refers-To: "),
        _urn(F.col("first.page_id"), F.col("first.url"), F.col("digest")),
    )
    lines = [
        F.concat(F.lit(f"WARC/1.1{end}WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit(f"{end}WARC-Record-ID: "), _urn(F.col("page_id"), F.col("url"), F.col("digest"))),
        F.concat(F.lit(f"{end}WARC-Date: "), captured, F.lit(f"{end}WARC-Target-URI: "), F.col("url")),
        F.coalesce(F.concat(F.lit(f"{end}X-Page-ID: "), F.col("page_id")), F.lit("")),
        F.concat(F.lit(f"{end}WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, refers).otherwise(""),
        F.concat(F.lit(f"{end}Content-Type: application/http; msgtype=response{end}Content-Length: "), F.octet_length(block), F.lit(end + end)),
        block,
        F.lit(end + end),
    ]
    return F.concat(*lines)


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = 100, captured: Column | None = None, archive_bytes: int = 32 << 20) -> None:
    if captured is None:
        captured = F.date_format(F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + FIRST_CAPTURE), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            for text in batch.column(0):
                member = gzip.compress(text.as_py().encode(), mtime=0)
                yield pa.RecordBatch.from_arrays([pa.array([member], pa.binary()), pa.array([written // archive_bytes], pa.int64())], ["value", "volume"])
                written += len(member) + len(BETWEEN)

    made = with_first(pages, min_bytes).select(record(captured).alias("value")).mapInArrow(members, "value binary, volume long")
    between = {"encoding": "ISO-8859-1", "lineSep": BETWEEN.decode("latin-1")}
    made.select(F.col("value").cast("string"), "volume").write.partitionBy("volume").options(**between).text(path)


def url_key(url: str) -> str:
    """Host labels reversed and comma-joined, ``)``, then path and query; lower case, without scheme, www and fragment."""
    rest = url.split("#", 1)[0].split("://", 1)[-1].lower()
    host, slash, path = rest.partition("/")
    host, _, port = host.partition(":")
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + slash + path


def members_of(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of the gzip members that hold anything."""
    view, at = memoryview(content), 0
    while at < len(view):
        reader, data, end = zlib.decompressobj(31), [], at
        while not reader.eof and end < len(view):
            data.append(reader.decompress(view[end : end + 65536]))
            end = min(end + 65536, len(view))
        if not reader.eof:
            raise ValueError(f"the member at {at} is cut off")
        end -= len(reader.unused_data)
        if whole := b"".join(data):
            yield at, end - at, whole
        at = end


def captures_of(archive: str, content: bytes) -> list[tuple]:
    """The captures of one archive as CAPTURE rows, sorted: a run."""
    rows = []
    for at, length, data in members_of(content):
        split = data.index(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in data[:split].decode().split("\r\n")[1:])
        end = split + 4 + int(fields["Content-Length"])
        body = data.index(b"\r\n\r\n", split + 4, end) + 4
        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), None
        if fields["WARC-Type"] == "response":
            size = end - body
            if hashlib.sha256(memoryview(data)[body:end]).hexdigest() != digest:
                raise ValueError(f"{archive}: the record at {at} has another payload than its digest says")
        page = fields.get("X-Page-ID")
        url = fields["WARC-Target-URI"]
        rows.append((archive, at, length, 0, fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), fields["WARC-Type"], int(page) if page else None, url, url_key(url), fields["WARC-Date"], size, digest, None))
    return [(*row[:3], place, *row[4:]) for place, row in enumerate(sorted(rows, key=capture_key))]


def capture_key(row: tuple) -> tuple:
    return row[9], row[10], row[7] is None, row[7] or 0, row[0], row[1]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = list(zip(*rows)) or [()] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(columns, CAPTURE.split(", "))], FIELDS)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """CAPTURE rows, those of an archive together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                yield _batch(captures_of("/".join(archive.rsplit("/", 2)[-2:]), content.as_py()))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, CAPTURE)


def losers_merge(runs: list[list], key) -> Iterator:
    """Sorted lists merged by a tree of losers: one comparison for each level and item."""
    runs = [r for r in runs if r]
    k = len(runs)
    if k < 2:
        yield from runs[0] if runs else []
        return
    at = [0] * k
    heads: list[tuple] = [(0, key(r[0]), i) for i, r in enumerate(runs)]
    tree, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (a, b) if heads[a] < heads[b] else (b, a)
    best = winners[1]
    while not heads[best][0]:
        yield runs[best][at[best]]
        at[best] += 1
        heads[best] = (0, key(runs[best][at[best]]), best) if at[best] < len(runs[best]) else (1, (), best)
        node = (best + k) // 2
        while node:
            if heads[tree[node]] < heads[best]:
                tree[node], best = best, tree[node]
            node //= 2


def merge_runs(runs: DataFrame) -> DataFrame:
    """CAPTURE rows in the order of (URL key, timestamp, page) over partitions and within them."""
    names = FIELDS
    order = ["urlkey", "captured", F.col("page_id").asc_nulls_last(), "archive", "offset"]
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    # Rows of a run arrive in any order; its places put them back into its own.
    dealt = runs.repartitionByRange(ranges, *order).sortWithinPartitions("archive", "place")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in names]):
                found.setdefault(row[0], []).append(row)
        out: list[tuple] = []
        for row in losers_merge(list(found.values()), capture_key):
            out.append(row)
            if len(out) == 5000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return dealt.mapInArrow(merge, CAPTURE)


def resolved(captures: DataFrame) -> DataFrame:
    """Revisits with the size of the payload they refer to, and refers_to: the page of that response."""
    captures = captures.drop("refers_to")
    responses = captures.filter("record_type = 'response'").groupBy(F.col("record_id").alias("_id")).agg(F.min("page_id").alias("_page"), F.first("payload_bytes").alias("_bytes"))
    revisits = captures.filter("record_type = 'revisit'").join(responses, F.col("refers_id") == F.col("_id"), "left")
    revisits = revisits.withColumn("payload_bytes", F.col("_bytes")).withColumn("refers_to", F.col("_page")).drop("_id", "_page", "_bytes")
    return captures.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits).select(*FIELDS)


def archive_and_read(pages: DataFrame, *, min_bytes: int = 100) -> DataFrame:
    """``pages`` through archives in the shared scratch folder and back: CAPTURE rows with refers_to, in index order."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes=min_bytes)
    return merge_runs(resolved(work_table(read_runs(spark, path), "capture-runs")))
