"""WARC archives of pages, and their capture histories by an external merge of index runs.

An archive is read once, into an index run: its captures sorted by URL key, date and page, in a file of blocks. Runs are merged by loser trees that hold one block
of each run: while there are more than FAN_IN runs, groups of FAN_IN become one; the rest are merged range by range into the global order.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, given_back, in_batches, small, written

#: Payloads shorter than this are stored again rather than referred to.
LEAST_SHARED = 1000
#: Bytes (compressed) after which a partition begins another archive; a reader holds one archive.
ARCHIVE_BYTES = 16 << 20
#: Compressed bytes that a reader takes at a time.
READ_BYTES = 16 << 10

#: Rows of a block of an index run; runs that are merged at a time; block keys from which ranges are cut at most.
BLOCK_ROWS = 512
FAN_IN = 64
SAMPLE_KEYS = 20_000

CAPTURES = "url_key string, warc_date string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, position long"
_SCHEMA = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in CAPTURES.split(", "))])


_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", re.S)


def url_key(url: str) -> str:
    """Sortable key: the host's labels from the right, then path and query, in lower case. Whatever is no URL is its own key."""
    found = _URL.match(url)
    if not found or not found[1]:
        return url.lower()
    return f"{','.join(found[1].split('.')[::-1])}){found[2] or '/'}".lower()


def order_of(row: tuple) -> bytes:
    """A capture's place in the global order as bytes that compare alike: URL key, date and page (none first)."""
    page = (1 << 63) + (-(1 << 63) if row[2] is None else row[2])
    return b"\0".join((row[0].encode("utf-8", "surrogatepass").replace(b"\0", b"\0\xff"), row[1].encode(), page.to_bytes(8, "big")))


def sort_key(row: tuple) -> tuple:
    """The same, and then the place in the archives."""
    return order_of(row), row[7], row[8]


def revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload a page with a larger page_id has too; a null page_id is smaller than any.

    pages: page_id, digest, payload_bytes. Digests are counted with partial sums first; only repeated ones are joined, on narrow rows,
    where Spark may split a hot digest.
    """
    large = pages.where(F.col("payload_bytes") >= least)
    holder = large.groupBy("digest", "payload_bytes").agg(
        F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"), F.count("*").alias("rows"), F.count("page_id").alias("named")
    )
    holder = holder.where("least < refers_to or named < rows and named > 0").select("digest", "payload_bytes", "refers_to")
    return large.join(holder, ["digest", "payload_bytes"]).where("page_id is null or page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def header_text(value: str) -> str:
    """One header line: white space and controls become percent escapes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str, date: str, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit has the HTTP header alone, whose Content-Length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {header_text(url)}",
        f"WARC-Payload-Digest: sha1:{digest}"
    ]
    block = http + payload
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        block = http
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records(archive: bytes) -> Iterator[tuple[int, dict[str, str], dict[str, str], bytes]]:
    """(position, WARC fields, HTTP fields, payload) of each gzip member; damage raises ValueError."""
    view, at = memoryview(archive), 0
    while at < len(archive):
        member, parts, end = zlib.decompressobj(31), [], at
        while not member.eof:
            piece = view[end : end + READ_BYTES]
            if not piece:
                raise ValueError(f"archive is cut off in the record at {at}")
            parts.append(member.decompress(piece))
            end += len(piece)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        warc = fields(head)
        block = rest[: int(warc["content-length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        yield at, warc, fields(http), payload
        at = end - len(member.unused_data)


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write rows (page_id, url, html, warc_date, refers_to) as *.warc.gz files, in the order in which they come.

    A task writes under a name of its attempt and renames when done, so lost or repeated tasks leave one copy of each archive; names that begin
    with a dot are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, top = fs.FileSystem.from_uri(folder)
        part, number, out, size = TaskContext.get().partitionId(), 0, None, 0
        names = []

        def close() -> None:
            out.close()
            store.move(hidden, final)
            names.append(final)

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(top, recursive=True)
                    hidden, final = f"{top}/.{uuid.uuid4().hex}", f"{top}/run-{part:06d}-{number:04d}.warc.gz"
                    out, size, number = store.open_output_stream(hidden, compression=None), 0, number + 1
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = squeeze.compress(
                    record(row["page_id"], row["url"] or "", row["warc_date"], (row["html"] or "").encode("utf-8", "surrogatepass"), row["refers_to"])
                ) + squeeze.flush()
                out.write(data)
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["archive"])

    rows = pages.select("page_id", "url", "html", "warc_date", "refers_to")
    in_batches(rows).mapInArrow(given_back(run), "archive string").write.format("noop").mode("overwrite").save()


def captures_of(path: str, archive: bytes) -> list[tuple]:
    """The captures of an archive in their order; digests of stored payloads are verified."""
    rows = []
    for at, warc, http, payload in records(archive):
        digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:"))
        kind, refers = warc["warc-type"], warc.get("warc-refers-to")
        if kind == "response" and hashlib.sha1(payload, usedforsecurity=False).digest() != digest:
            raise ValueError(f"payload of {warc['warc-record-id']} does not match its digest")
        name = warc["warc-record-id"].rpartition(":")[2].rstrip(">")
        rows.append((
            url_key(warc["warc-target-uri"]), warc["warc-date"], None if name == "none" else int(name), int(http["content-length"]), digest.hex(),
            kind, refers and int(refers.rpartition(":")[2].rstrip(">")), path, at
        ))
    return rows


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


_BLOCKS = "run string, block int, rows long, first binary"


def _write_run(folder: str, name: str, rows: Iterable[tuple]) -> list[tuple]:
    """Write sorted rows as an index run of blocks; (run, block, rows, first key) of each. Renamed when done, so a repeated task replaces its own run."""
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    hidden, final, found, part = f"{top}/.{uuid.uuid4().hex}", f"{top}/{name}.index", [], []
    with store.open_output_stream(hidden, compression=None) as out, pa.ipc.new_file(out, _SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:

        def close() -> None:
            file.write_batch(_arrow(part))
            found.append((f"{folder}/{name}.index", len(found), len(part), order_of(part[0])))
            part.clear()

        for row in rows:
            part.append(row)
            if len(part) == BLOCK_ROWS:
                close()
        if part:
            close()
    store.move(hidden, final)
    return found


def _read_run(run: str, blocks: Iterable[int]) -> Iterator[tuple]:
    """The rows of some blocks of a run, one block at a time."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(run)
    with store.open_input_file(path) as source:
        file = pa.ipc.open_file(source)
        for block in blocks:
            yield from zip(*(c.to_pylist() for c in file.get_batch(block).columns), strict=True)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["run", "block", "rows", "first"])


def index_archives(spark, folder: str) -> DataFrame:
    """Read each archive of a folder once, into a sorted index run beside it; returns the runs' blocks. A task holds one archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = sorted(captures_of(path, content.as_buffer().to_pybytes()), key=sort_key)
                yield _found(_write_run(f"{folder}/index", path.rpartition("/")[2].removesuffix(".warc.gz"), rows))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    return written(files.mapInArrow(given_back(run), _BLOCKS), "blocks")


def _make_folder(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


class LoserTree:
    """Merge of sorted runs: each inner place keeps the loser of its match, so a step replays one path of log2(k) matches."""

    def __init__(self, runs: list[Iterable], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.width = len(self.runs)
        self.losers = [-1] * max(1, self.width)
        winners = [-1] * self.width + list(range(self.width))
        for place in range(self.width - 1, 0, -1):
            a, b = winners[2 * place], winners[2 * place + 1]
            winners[place], self.losers[place] = (a, b) if self.before(a, b) else (b, a)
        self.top = winners[1] if self.width > 1 else 0

    def before(self, a: int, b: int) -> bool:
        """Exhausted runs lose; equal keys go by the run's number."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None or self.keys[b] is None and a < b
        return (self.keys[a], a) < (self.keys[b], b)

    def __iter__(self) -> Iterator:
        while self.width and self.keys[self.top] is not None:
            run = self.top
            yield self.heads[run]
            self.heads[run] = head = next(self.runs[run], None)
            self.keys[run] = None if head is None else self.key(head)
            place = (run + self.width) // 2
            while place:
                if self.before(self.losers[place], run):
                    self.losers[place], run = run, self.losers[place]
                place //= 2
            self.top = run


def _merger(folder: str):
    def run(table: pa.Table) -> pa.Table:
        of_run: dict[str, list[int]] = {}
        for name, block in zip(table.column("run").to_pylist(), table.column("block").to_pylist(), strict=True):
            of_run.setdefault(name, []).append(block)
        rows = LoserTree([_read_run(name, sorted(of_run[name])) for name in sorted(of_run)], sort_key)
        return pa.Table.from_batches([_found(_write_run(folder, f"{table.column('group')[0].as_py():08d}", rows))])

    return run


def merged_runs(blocks: DataFrame, folder: str, fan_in: int = FAN_IN) -> tuple[DataFrame, int]:
    """The blocks of at most fan_in runs, and their number: while there are more, about fan_in of them are merged into one, group by group side by side."""
    level, n = 0, blocks.select("run").distinct().count()
    while n > fan_in:
        level, n = level + 1, -(-n // fan_in)
        grouped = blocks.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(n)))
        blocks = written(grouped.groupBy("group").applyInArrow(_merger(f"{folder}/merged-{level}"), _BLOCKS), "blocks")
    return blocks, n


def capture_histories(blocks: DataFrame, folder: str, ranges: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """Captures in global order of (url_key, warc_date, page_id): partition by partition, and within each.

    blocks: those of sorted index runs. Ranges of the order are cut from a sample of at most SAMPLE_KEYS first keys of blocks (a URL with very many captures spans
    several); each is merged from the blocks of all runs that may hold a part of it. A task holds a block of each run.
    """
    blocks, runs = merged_runs(blocks, folder, fan_in)
    total = blocks.agg(F.sum("rows"), F.count("*")).first()
    ranges = ranges or max(1, (total[0] or 0) // max(1, runs * BLOCK_ROWS))  # a block of each run for each, so few blocks are read twice
    keys = blocks.select("first")
    if (total[1] or 0) > SAMPLE_KEYS:
        keys = keys.where(F.pmod(F.xxhash64("first"), F.lit(1 << 62)) < (1 << 62) * SAMPLE_KEYS // total[1])
    keys = sorted(bytes(r.first) for r in keys.distinct().collect())  # SAMPLE_KEYS or so
    cuts = sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block reaches up to the first key of the next one of its run
        for batch in batches:
            out = []
            for run, block, first, after in zip(*(batch.column(c).to_pylist() for c in ("run", "block", "first", "after")), strict=True):
                low, high = bisect_right(cuts, first), len(cuts) if after is None else bisect_right(cuts, after)
                out += [(part, run, block) for part in range(low, high + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int32()))], ["part", "run", "block"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, dict[str, list[int]]] = {}
        for batch in batches:
            for part, run, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.setdefault(part, {}).setdefault(run, []).append(block)
        for part in sorted(parts):
            low, high = cuts[part - 1] if part else b"", cuts[part] if part < len(cuts) else None
            inside = lambda rows, low=low, high=high: (r for r in rows if (k := order_of(r)) >= low and (high is None or k < high))
            out = []
            for row in LoserTree([inside(_read_run(run, sorted(parts[part][run]))) for run in sorted(parts[part])], sort_key):
                out.append(row)
                if len(out) == BLOCK_ROWS:
                    yield _arrow(out)
                    out = []
            if out:
                yield _arrow(out)

    after = F.lead("first").over(Window.partitionBy("run").orderBy("block")).alias("after")
    dealt = blocks.select("run", "block", "first", after).mapInArrow(deal, "part int, run string, block int")
    return dealt.repartitionByRange(len(cuts) + 1, "part").sortWithinPartitions("part").mapInArrow(given_back(merge), CAPTURES)


def archive_pages(pages: DataFrame, folder: str | None = None, date: Column | None = None, least: int = LEAST_SHARED) -> DataFrame:
    """Write a WARC record for each row of pages, read the archives back and return the captures in global order.

    pages: page_id long, url string, html string; other columns are ignored. A null html is an empty payload, a null url an empty one. Of equal payloads of
    at least `least` bytes the record with the largest page_id is the response, those with smaller ones refer to it; rows
    that repeat that page_id are responses as well. A null page_id is smaller than any: such a record refers to another page with its payload where there is one, and nothing refers
    to it. date: the capture time, page_id seconds after 1970 where not given (a null page_id: 1970).
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    at = F.timestamp_seconds(F.coalesce("page_id", F.lit(0))) if date is None else date
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"),
        F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("warc_date"),
    )
    digests = rows.select("page_id", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha1(F.col("html").cast("binary")).alias("digest"))
    known = small(written(revisits(digests, least), "revisits").toDF("p", "d", "refers_to"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).join(known, (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left")
    _make_folder(spark, folder)  # stays empty where there are no pages
    write_archives(rows, folder)
    return capture_histories(index_archives(spark, folder), folder)
