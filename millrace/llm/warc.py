"""WARC archives and their index.

Pages become WARC/1.1 records, each a gzip member; the members of a task follow one another in segments of bounded size, and
concatenated segments are a valid .warc.gz file. Every segment carries a run of the index, sorted by URL key and
time. The index is merged externally: runs are dealt out by ranges of the key, as many as keep a range's size bounded, and the parts of
a range, which come one run after the other, are merged with a loser tree that reads them row by row from their column batches.
This gives capture histories in global order.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, materialise

#: Bytes after which a segment is closed, and the level of compression.
SEGMENT_BYTES, LEVEL = 4_000_000, 1
#: Captures of a range of the merge (some 300 bytes each).
RANGE_ROWS = 200_000
#: Pages without a time of capture get this one plus page_id seconds.
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


def url_key(url: str | None) -> str:
    """A sortable key: host labels in reverse, then path and query in lower case; fragments, ports 80 and 443 and a leading www go."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return (url or "").lower()
    shown = f":{port}" if port not in (None, 80, 443) else ""
    return ",".join(reversed(host.split("."))) + shown + ")" + (parts.path or "/").lower() + (f"?{'&'.join(sorted(parts.query.lower().split('&')))}" if parts.query else "")


def capture_time(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, digest: str) -> bytes:
    """One record as a gzip member. A revisit has the whole payload's digest and length but not its bytes."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {capture_time(page_id)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode("utf-8", "surrogatepass")
    return packer.compress(head + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member."""
    view, at = memoryview(data), 0
    while at < len(data):
        unpack, content, end = zlib.decompressobj(31), [], at
        while not unpack.eof and end < len(data):
            piece = view[end : end + 65536]
            content.append(unpack.decompress(piece))
            end += len(piece)
        if not unpack.eof:
            raise ValueError(f"the member at {at} is cut off")
        end -= len(unpack.unused_data)
        yield at, end - at, b"".join(content)
        at = end


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and the payload behind the HTTP head."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])].partition(b"\r\n\r\n")[2]


def _number(ref: str | None) -> int | None:
    digits = (ref or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits and digits != "None" else None


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(segment, records, data): archive segments for pages (page_id, url, html), written to the shared folder.

    Of equal payloads of min_bytes at least, the one with the largest page_id is a response and the others revisit it; smaller
    ones are responses all. Rows that repeat the largest page_id are responses too; a null page_id comes after all ids and
    revisits any. A null html is an empty payload.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("sha", F.unhex(F.sha1("payload")))
    # only keys are counted; the pages join what is more than once
    repeated = own.filter(F.length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1").select("sha", "top")
    marked = own.join(repeated, "sha", "left").select("page_id", "url", "payload", "sha", F.when(~F.coalesce(F.col("page_id") == F.col("top"), F.lit(False)), F.col("top")).alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, n = io.BytesIO(), 0

        def closed() -> pa.RecordBatch:
            raw = data.getvalue()
            return pa.record_batch([pa.array([hashlib.sha1(raw).hexdigest()]), pa.array([n], pa.int64()), pa.array([raw], pa.binary())], ["segment", "records", "data"])

        for batch in batches:
            for page_id, url, payload, sha, top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data.write(record(page_id, url, payload, "response" if top is None else "revisit", top, base64.b32encode(sha).decode()))
                n += 1
                if data.tell() >= SEGMENT_BYTES:
                    yield closed()
                    data, n = io.BytesIO(), 0
        if n:
            yield closed()

    return materialise(marked.mapInArrow(run, "segment string, records long, data binary"))


CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, segment string, offset long, length long"


def read_archives(archives: DataFrame) -> DataFrame:
    """The index of archives (segment, data): a run for each segment, sorted by URL key, time and id. Digest and length of a
    response are computed from what is stored; those of a revisit are in its head."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, scalar in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for offset, length, content in members(scalar.as_py()):
                    head, payload = parse(content)
                    kind, page_id = head["warc-type"], _number(head["warc-record-id"])
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else head["warc-payload-digest"].removeprefix("sha1:")
                    rows.append((page_id, len(payload) if kind == "response" else int(head["x-payload-length"]), digest, kind, _number(head.get("warc-refers-to")), url_key(head.get("warc-target-uri")), head["warc-date"], segment, offset, length))
                rows.sort(key=_order)
                yield _captures(rows)

    return archives.select("segment", "data").mapInArrow(run, CAPTURE)


def _order(row: tuple) -> tuple:
    return (row[5], row[6], row[0] is not None, row[0] or 0, row[7], row[8])


_KINDS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("segment", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
    return pa.record_batch([pa.array(c, k) for c, (_, k) in zip(columns, _KINDS, strict=True)], [n for n, _ in _KINDS])


def merge_runs(runs: list[Iterator[tuple]], order: Callable[[tuple], tuple]) -> Iterator[tuple]:
    """A k-way merge by a loser tree: each inner node keeps the loser of its match, so the next row costs log k comparisons."""
    k = len(runs)
    heads: list[tuple | None] = [next(r, None) for r in runs]
    keys = [None if h is None else order(h) for h in heads]

    def beats(a: int, b: int) -> bool:
        """a run that has ended loses; equal rows leave in the order of the runs"""
        if a < 0 or b < 0:
            return a < 0
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and (keys[a] is not None or a < b)
        return (keys[a], a) < (keys[b], b)

    tree = [-1] * max(1, k)  # -1 beats all while the tree fills

    def replay(i: int) -> None:
        node = (i + k) // 2
        while node:
            if beats(tree[node], i):
                tree[node], i = i, tree[node]
            node //= 2
        tree[0] = i

    for i in reversed(range(k)):
        replay(i)
    while k and (row := heads[top := tree[0]]) is not None:
        yield row
        heads[top] = next(runs[top], None)
        keys[top] = None if heads[top] is None else order(heads[top])
        replay(top)


def _rows(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a run, of which only one batch at a time is made into Python objects."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _runs(batches: Iterable[pa.RecordBatch]) -> list[list[pa.RecordBatch]]:
    """The batches of each run; rows come by segment, so a run is where the segment stays the same."""
    runs: list[list[pa.RecordBatch]] = []
    last = None
    for batch in batches:
        names = batch.column(7).to_pylist()
        cut = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for a, b in zip(cut, cut[1:]):
            if a == b:
                continue
            if not runs or names[a] != last:
                runs.append([])
            last = names[a]
            runs[-1].append(batch.slice(a, b - a))
    return runs


def merge_index(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures in the order of URL key, time and id: sorted within and across partitions, each of about range_rows rows. Rows that are
    equal in all three stand in the order of segment and offset; null ids come first; no rows give none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in merge_runs([_rows(r) for r in _runs(batches)], _order):
            out.append(row)
            if len(out) == 10_000:
                yield _captures(out)
                out = []
        if out:
            yield _captures(out)

    bound_batches(index.sparkSession)
    ranges = max(index.sparkSession.sparkContext.defaultParallelism, -(-index.count() // range_rows))
    # page_id splits a host or URL that has very many captures; rows of one run arrive in any order and are put in its own again
    dealt = index.repartitionByRange(ranges, "url_key", "captured", "page_id").sortWithinPartitions("segment", "url_key", "captured", F.asc_nulls_first("page_id"), "offset")
    return dealt.mapInArrow(run, CAPTURE)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to archives, read them back, and return the merged index: a row for each page, repeated rows too."""
    return merge_index(materialise(read_archives(write_archives(pages, min_bytes))))
