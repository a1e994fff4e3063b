"""WARC archives and the external merge of their capture indexes (operator 1).

write_archives() sorts each part of a table by URL key, timestamp and page, and packs the records into files of about RUN_BYTES: each
file is a locally sorted capture run. Of equal payloads of at least 100 bytes the one with the smallest page_id is written as a
response, the others as revisit records, which name that page, keep the payload's digest and the HTTP header with its length, and
hold no payload. Spark's own writer and reader move the files, so any store will do.

read_archives() walks the files by Content-Length, checks payloads against their digests, and gives one index row per record, in the
order of the runs. merge_runs() cuts every run at the same splitters, so that a range of keys holds about TASK_ROWS rows however
hot a key is (timestamp, page, run and offset are part of the order), and merges the k segments of a range with a loser tree. A
segment travels as one packed row and is never sorted again; where a run isn't in order, a new segment begins. Each row gets its
place in the global order of captures.

Null html is an empty payload, a null url an empty target with an empty key, null page_id sorts first. Line ends in urls are
written as %0D and %0A. Rows with equal page_id are separate records; of equal rows that hold the smallest page_id all are
responses. Further columns are ignored; empty tables give empty archives and an empty history. A payload may be as long as Spark's limit for
one value; a run is longer than RUN_BYTES by at most one record.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.llm.common import broadcast_if_small, materialise, release, scratch_path, table

LEAST_REVISIT = 100
RUN_BYTES = 32 << 20
TASK_ROWS = 200_000
#: rows drawn for each range to choose the splitters from
SAMPLE = 50
BROADCAST_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
_FOLD = str.maketrans(UPPER, LOWER)


def one_line(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "\r", "%0D"), "\n", "%0A")


def url_key(url: Column) -> Column:
    """Host labels from the right, then the rest of the url: com,example)/path?query; an empty text for null."""
    rest = F.regexp_replace(one_line(url), _SCHEME, "")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*([^#]*)", 1)
    return F.when(rest == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail))


def key_of(url: str) -> str:
    """url_key() of a header's value."""
    rest = re.sub(_SCHEME, "", url)
    if not rest:
        return ""
    host = re.match(r"[^/?#]*", rest)[0]
    return ",".join(host.translate(_FOLD).split(".")[::-1]) + ")" + rest[len(host) :].split("#")[0]


def record(page: int | None, url: str, captured: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record, without the line end that closes it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Target-URI: {url}", f"WARC-Date: {captured}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n"


def write_archives(pages: DataFrame, path: str) -> None:
    """One record per row of (page_id, url, html, captured); each file is a sorted run."""
    pages = pages.select("page_id", one_line(F.col("url")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), "captured").withColumn("digest", F.sha2("html", 256))
    same = pages.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    same = materialise(same, "same")
    pages = pages.join(broadcast_if_small(same, same.count(), BROADCAST_ROWS), "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    stamp = F.coalesce(F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    runs = pages.select("page_id", "url", stamp.alias("captured"), "html", "digest", refers.alias("refers_to"), url_key(F.col("url")).alias("key")).sortWithinPartitions("key", "captured", "page_id")

    def pack(batches):
        held, size = [], 0
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("page_id", "url", "captured", "html", "digest", "refers_to")]
            for page, url, captured, html, digest, to in zip(*cols, strict=True):
                held.append(record(page, url, captured, html.encode(), digest, to))
                size += len(held[-1]) + 2
                if size >= RUN_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\r\n".join(held)], pa.binary()).cast(pa.string())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"\r\n".join(held)], pa.binary()).cast(pa.string())], names=["value"])
        held = []
        release()

    runs.mapInArrow(pack, "value string").write.option("lineSep", "\r\n").option("maxRecordsPerFile", 1).text(path)


INDEX = "run string, offset long, length long, page_id long, url_key string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_INDEX = pa.schema([("run", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
ORDER = ("url_key", "captured", "page_id", "run", "offset")


def records(content: bytes):
    """(offset, length, WARC headers, HTTP headers, payload) of the records of one file."""
    fields = lambda lines: dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = fields(lines)
        start = end + 4
        stop = start + int(head["Content-Length"])
        body = content.index(b"\r\n\r\n", start) + 4
        yield at, stop + 4 - at, head, fields(content[start : body - 4].decode().split("\r\n")[1:]), content[body:stop]
        at = stop + 4


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """An index row per record, in the order of the files."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = []
                for at, n, head, http, payload in records(content.as_py()):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    size, kind = int(http["Content-Length"]), head["WARC-Type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{name} at {at}: the payload is damaged")
                    rows.append((name, at, n, _page(head["WARC-Record-ID"]), key_of(head["WARC-Target-URI"]), head["WARC-Date"], size, digest, kind, _page(head.get("WARC-Refers-To"))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)
            release()

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content").mapInArrow(run, INDEX)


def loser_tree_merge(runs: list):
    """Merges k sorted iterables: a tree of losers, in which one path from a leaf to the root is replayed per item."""
    k = len(runs)
    if k == 1:
        yield from runs[0]
        return
    its = [iter(r) for r in runs]
    heads = [next(i, None) for i in its]
    loser = [-1] * k

    def beats(a: int, b: int) -> bool:
        if heads[a] is None:
            return False
        return heads[b] is None or (heads[a], a) < (heads[b], b)

    winner = [0] * k + list(range(k))  # of each node while the tree is built; the leaves are k .. 2k - 1
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if beats(a, b) else (b, a)
    top = winner[1]
    while heads[top] is not None:
        yield heads[top]
        heads[top] = next(its[top], None)
        node = (top + k) // 2
        while node:
            if beats(loser[node], top):
                loser[node], top = top, loser[node]
            node //= 2


def _keys(batch) -> list[tuple]:
    cols = [batch.column(c).to_pylist() for c in ORDER]
    cols[2] = [-(1 << 63) if p is None else p for p in cols[2]]
    return list(zip(*cols, strict=True))


def splitters(index: DataFrame, n_rows: int) -> list[tuple]:
    """The keys that cut the index into ranges of about TASK_ROWS rows: the driver gets SAMPLE rows for each range."""
    ranges = math.ceil(n_rows / TASK_ROWS)
    if ranges < 2:
        return []
    share = ranges * SAMPLE / n_rows
    drawn = index.select(*ORDER).where(F.pmod(F.xxhash64("run", "offset"), F.lit(1 << 30)) < int(share * (1 << 30))).toArrow()
    keys = sorted(_keys(drawn))
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if len(keys) >= ranges else []


def segments(index: DataFrame, cuts: list[tuple]) -> DataFrame:
    """(range, n, blob): each run cut at the splitters, a sorted segment packed in each row."""
    shared = index.sparkSession.sparkContext.broadcast(cuts)

    def run(batches):
        cuts = shared.value
        for b in batches:
            keys = _keys(b)
            at, out = 0, []
            while at < len(keys):
                place = bisect.bisect_right(cuts, keys[at])
                stop = at + 1
                while stop < len(keys) and keys[stop - 1] <= keys[stop] and (place == len(cuts) or keys[stop] < cuts[place]):
                    stop += 1
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as w:
                    w.write_batch(b.slice(at, stop - at))
                out.append((place, stop - at, sink.getvalue().to_pybytes()))
                at = stop
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["range", "n", "blob"])

    return index.mapInArrow(run, "range int, n long, blob binary")


def merge_runs(index: DataFrame, n_rows: int) -> DataFrame:
    """The index rows with `place`, their place among all captures in the order of key, timestamp and page."""
    cut = materialise(segments(index, splitters(index, n_rows)), "segments")
    counts = {r["range"]: r["n"] for r in cut.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # a row for each range
    first, before = {}, 0
    for place in sorted(counts):
        first[place], before = before, before + counts[place]
    shared = index.sparkSession.sparkContext.broadcast(first)

    def merge(place, blobs):
        parts = [pa.ipc.open_stream(x).read_all().combine_chunks() for x in blobs]
        start, runs = 0, []
        for p in parts:
            runs.append([(k, start + i) for i, k in enumerate(_keys(p))])
            start += p.num_rows
        whole, at = pa.concat_tables(parts).combine_chunks(), shared.value[place]
        order = [i for _, i in loser_tree_merge(runs)]
        for k in range(0, len(order), 20_000):
            part = whole.take(pa.array(order[k : k + 20_000], pa.int64()))
            for batch in part.append_column("place", pa.array(range(at + k, at + k + part.num_rows), pa.int64())).combine_chunks().to_batches():
                yield batch

    def run(batches):
        now, held = None, []
        for b in batches:
            for place, blob in zip(b.column("range").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if place != now and held:
                    yield from merge(now, held)
                    held = []
                now = place
                held.append(blob)
        if held:
            yield from merge(now, held)
        release()

    return cut.select("range", "blob").repartition("range").sortWithinPartitions("range").mapInArrow(run, INDEX + ", place long")


def capture_history(spark: SparkSession, path: str) -> DataFrame:
    """The merged index of the archives under path: what each record says, and its place in the global capture history."""
    index = materialise(read_archives(spark, path), "runs")
    return merge_runs(index, index.count()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "place", "url_key", "captured", "run", "offset", "length")


def op1_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("captured"))
    path = scratch_path(spark, "archives")
    write_archives(pages, path)
    return capture_history(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "place")


OP1_SQL = r"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest, regexp_replace(replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A'), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest from pages),
k as (select *, case when rest = '' then '' else array_to_string(list_reverse(string_split(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.')), ',') || ')' || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) end as key from p),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type, case when first <> page_id then first end as refers_to,
  row_number() over (order by key, page_id) - 1 as place
from k left join f using (payload_digest)
"""
