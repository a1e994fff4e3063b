"""Exact removal of repeated substrings by an enhanced suffix array (operator 9).

A byte goes if some string of `length` bytes that covers it also starts earlier in the corpus (smaller doc_id, or the same
document further left). A suffix array of all suffixes can't be shuffled, so a sparse one is built, of those suffixes that
matter:

1. Winnowing: in each window of `length` bytes the least hash of 32 bytes is its anchor, so equal windows have equal anchors at
   equal places. Each anchor stands for a run of consecutive windows and their common context. Rows are (anchor hash, context
   hash, doc_id, start, windows); they are packed into blobs by bucket, deduplicated in the worker first.
2. Per anchor, occurrences with equal contexts are repeats as a whole: all but the first give a removed range. Of each distinct
   context the first occurrence goes on, if its anchor has several contexts.
3. Per bucket of anchors, the suffixes that start at anchors are sorted and their common prefixes found; a stack scan yields the
   tree of common-prefix intervals. A window that has its anchor at offset o is shared by those members of the interval for
   depth length - o whose left contexts agree over o bytes: the left extensions are compared for each interval, and every
   occurrence but the first of each such group is removed.

Hot anchors: a worker that sees an anchor with more than HOT contexts deals them out by context, and sends a mark to the anchor's
own bucket, so that the contexts other workers sent there go on too; for anchors with more contexts than fit a task, windows
themselves are grouped by hash.

Contexts and windows count as equal if two 64-bit hashes of different bases are. The number of buckets and tasks follows the bytes of
text, so that neither grows with the corpus.

Null and empty texts have nothing to remove. Rows without doc_id are kept as they are. Rows with the same doc_id and equal text count
as one document, and each gives a row; different texts under one doc_id aren't supported: the ranges of both are cut from each.
Texts of any length are cut into pieces that share what a window needs. Further columns are ignored, except those named in `keep`. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from textloom.llm.common import Rolling, broadcast_if_small, joined, materialise, mix, release, slices, table

LENGTH, GRAM = 100, 32
HOT = 64
#: bytes of text whose anchors are in one bucket, and in one task
BUCKET_BYTES, TASK_BYTES = 16 << 20, 128 << 20
TASK_CONTEXTS = 200_000
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
FLUSH = 250_000  # anchors that a worker packs at once
PIECE = 256 << 10  # bytes of text that are hashed at once

ANCHOR = np.dtype([("h", "<u8"), ("c", "<u8"), ("c2", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("wins", "u1"), ("left", "u1"), ("hot", "u1")])
RANGE = np.dtype([("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive keys, by block-wise running minima."""
    n = len(key) - width + 1
    if n <= 0:
        return np.empty(0, key.dtype)
    whole = np.full(-(-len(key) // width) * width, np.iinfo(key.dtype).max, key.dtype)
    whole[: len(key)] = key
    grid = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(col: pa.Array, docs: np.ndarray, at: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The anchors of all windows of the texts, which begin at `at` in their documents; wins consecutive windows from start on have the anchor, the first at offset left."""
    data, ends = joined(col)
    width = length - gram + 1
    if len(data) < length:
        return np.empty(0, ANCHOR)
    roll = Rolling(data)
    grams = roll.every(gram)
    place = np.arange(len(grams), dtype=np.uint64)
    least = sliding_least(grams >> np.uint64(32) << np.uint64(32) | place, width)
    pos = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(ends)
    doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    if not len(doc):
        return np.empty(0, ANCHOR)
    before = np.concatenate([[0], np.cumsum(np.maximum(sizes - length + 1, 0))])
    window = np.arange(len(doc)) - before[doc] + ends[doc]  # starts of all windows inside texts
    pos = pos[window]
    new = np.ones(len(pos), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(pos)))
    out = np.empty(len(first), ANCHOR)
    start = window[first]
    out["h"] = mix(grams[pos[first]])
    out["left"] = pos[first] - start
    out["wins"] = count
    out["c"] = mix(roll.of(start, start + count - 1 + length) ^ (out["left"].astype(np.uint64) << np.uint64(8) | count.astype(np.uint64)))
    out["c2"] = Rolling(data, 1).of(start, start + count - 1 + length)
    out["doc"] = docs[doc[first]]
    out["start"] = start - ends[doc[first]] + at[doc[first]]
    out["hot"] = 0
    return out


def pieces(batches, length: int):
    """(texts, doc_ids, where in its document each text begins): longer documents are cut into pieces that share length - 1 bytes,
    so that each window is in one of them."""
    for b in slices(batches, "text", PIECE):
        col, docs = b.column("text"), b.column("doc_id").to_numpy(zero_copy_only=False)
        data, ends = joined(col)
        if len(data) <= PIECE:
            yield col, docs, np.zeros(len(docs), np.int64)
        else:  # one row
            for at in range(0, len(data) - length + 1, PIECE):
                yield pa.array([data[at : at + PIECE + length - 1].tobytes()], pa.binary()), docs, np.array([at])


def repeats(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted anchors: the first of each (h, c), and the rest as indexes; equal (doc, start) is the same occurrence."""
    order = np.lexsort((found["start"], found["doc"], found["c2"], found["c"], found["h"]))
    found = found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found["h"][1:] != found["h"][:-1]) | (found["c"][1:] != found["c"][:-1]) | (found["c2"][1:] != found["c2"][:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = (found["doc"] == found["doc"][head]) & (found["start"] == found["start"][head])
    return found[new], found[~new & ~again]


def removed(rows: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(rows), RANGE)
    out["doc"], out["start"] = rows["doc"], rows["start"]
    out["end"] = rows["start"] + rows["wins"].astype(np.int64) - 1 + length
    return out


def _blobs(kind: int, bucket: np.ndarray, rows: np.ndarray):
    """Rows packed by bucket: (kind, bucket, blob)."""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    firsts = np.concatenate([[0], cut]) if len(bucket) else []
    parts = np.split(rows, cut) if len(bucket) else []
    return [(kind, int(bucket[f]), p.tobytes()) for f, p in zip(firsts, parts, strict=True)]


def _batch(rows, names=("kind", "bucket", "blob")):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=list(names))


PACKED = "kind int, bucket int, blob binary"
ANCHORS, RANGES, CONTEXTS, MARKS = 0, 1, 2, 3


def _scatter(texts: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    def run(batches):
        held, n = [], 0

        def out():
            first, rest = repeats(np.concatenate(held))
            group = np.flatnonzero(np.concatenate([[True], first["h"][1:] != first["h"][:-1]])) if len(first) else np.empty(0, np.int64)
            many = np.repeat(np.diff(np.append(group, len(first))), np.diff(np.append(group, len(first))))
            first["hot"] = many > HOT
            by = np.where(many > HOT, mix(first["h"] ^ first["c"]), first["h"]) % np.uint64(buckets)
            rows = _blobs(ANCHORS, by.astype(np.int64), first)
            hot = first["h"][group][first["hot"][group] > 0]
            rows += _blobs(MARKS, (hot % np.uint64(buckets)).astype(np.int64), hot)
            gone = removed(rest, length)
            rows += _blobs(RANGES, (mix(gone["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), gone)
            return _batch(rows)

        for col, docs, at in pieces(batches, length):
            got = anchors(col, docs, at, length, gram)
            if len(got):
                held.append(got)
                n += len(got)
            if n > FLUSH:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return texts.mapInArrow(run, PACKED)


def _match(packed: DataFrame, buckets: int, tasks: int, length: int) -> DataFrame:
    """Per bucket of anchors the removed ranges of whole contexts, by document; and first occurrences of contexts that go on. Buckets
    come one after another, so a task holds one at a time."""

    def match(held, marks):
        found = np.concatenate(held)
        if marks:  # hot in some worker is hot in all
            found["hot"] |= np.isin(found["h"], np.concatenate(marks))
        # only anchors that occur again need sorting by all their fields
        h = np.sort(found["h"])
        twice = np.unique(h[1:][h[1:] == h[:-1]])
        spot = np.minimum(np.searchsorted(twice, found["h"]), max(len(twice) - 1, 0))
        found = found[(twice[spot] == found["h"]) | (found["hot"] > 0)] if len(twice) else found[found["hot"] > 0]
        if not len(found):
            return []
        first, rest = repeats(found)
        group = np.concatenate([[True], first["h"][1:] != first["h"][:-1]])
        start = np.flatnonzero(group)
        many = np.repeat(np.diff(np.append(start, len(first))), np.diff(np.append(start, len(first))))
        on = first[(many > 1) | (first["hot"] > 0)]
        gone = removed(rest, length)
        rows = _blobs(RANGES, (mix(gone["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), gone)
        return rows + _blobs(CONTEXTS, (mix(on["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), on)

    def run(batches):
        held, marks, rows, now = [], [], [], None
        for b in batches:
            for kind, bucket, blob in zip(b.column("kind").to_pylist(), b.column("bucket").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if bucket != now:
                    rows += match(held, marks) if held else []
                    held, marks, now = [], [], bucket
                if kind == ANCHORS:
                    held.append(np.frombuffer(blob, ANCHOR))
                elif kind == MARKS:
                    marks.append(np.frombuffer(blob, "<u8"))
                else:
                    rows.append((kind, bucket, blob))
                if len(rows) > 1000:
                    yield _batch(rows)
                    rows = []
        rows += match(held, marks) if held else []
        for k in range(0, len(rows), 1000):
            yield _batch(rows[k : k + 1000])
        release()

    return dealt(packed, "bucket", tasks).sortWithinPartitions("bucket").mapInArrow(run, PACKED)


def dealt(rows: DataFrame, by: str, tasks: int) -> DataFrame:
    """Dealt out by a key over as many tasks as the session says, or more where the data asks for them."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, by) if tasks > usual else rows.repartition(by)


def _by_document(packed: DataFrame, kind: int, tasks: int) -> DataFrame:
    """(doc_id, blob): the packed rows of one kind, dealt out by document; ranges are merged."""
    dtype = RANGE if kind == RANGES else ANCHOR

    def run(batches):
        held = [np.frombuffer(x, dtype) for b in batches for x in b.column("blob").to_pylist()]
        if not held:
            return
        rows = np.concatenate(held)
        rows = merged(rows) if kind == RANGES else rows[np.lexsort((rows["start"], rows["doc"]))]
        cut = np.flatnonzero(np.diff(rows["doc"])) + 1
        docs = rows["doc"][np.concatenate([[0], cut])]
        blobs = [p.tobytes() for p in np.split(rows, cut)]
        for k in range(0, len(blobs), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(docs[k : k + 5000]), pa.array(blobs[k : k + 5000], pa.binary())], names=["doc_id", "blob"])

    return dealt(packed.where(F.col("kind") == kind).select("bucket", "blob"), "bucket", tasks).mapInArrow(run, "doc_id long, blob binary")


def merged(rows: np.ndarray) -> np.ndarray:
    """Maximal runs of overlapping or touching ranges, by document."""
    rows = rows[np.lexsort((rows["start"], rows["doc"]))]
    doc = np.concatenate([[0], np.cumsum(rows["doc"][1:] != rows["doc"][:-1])])
    span = int(rows["end"].max()) + 2
    start, end = rows["start"].astype(np.int64) + doc * span, rows["end"].astype(np.int64) + doc * span
    reach = np.maximum.accumulate(end)
    new = np.ones(len(rows), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    out = rows[first].copy()
    out["end"] = reach[np.append(first[1:] - 1, len(rows) - 1)] - doc[first] * span
    return out


def _contexts(texts: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, doc, start, wins, left, context) of the wanted anchors."""
    width = length - gram + 1
    reach = width - 1 + length

    def run(batches):
        for b in slices(batches, "text", PIECE):
            data, ends = joined(b.column("text"))
            data = np.concatenate([np.zeros(width, np.uint8), data, np.zeros(length, np.uint8)])
            blobs = [np.frombuffer(x, ANCHOR) for x in b.column("blob").to_pylist()]
            rows = np.concatenate(blobs)
            owner = np.repeat(np.arange(len(blobs)), [len(x) for x in blobs])
            at = ends[owner] + rows["start"] + rows["left"]  # the anchor's place in the bytes
            for k in range(0, len(rows), 20_000):
                part = rows[k : k + 20_000]
                grid = data[(at[k : k + 20_000] + 1)[:, None] + np.arange(reach)[None, :]]
                col = np.arange(reach)[None, :]
                low = width - 1 - part["left"].astype(np.int64)[:, None]
                grid[(col < low) | (col >= low + part["wins"].astype(np.int64)[:, None] - 1 + length)] = 0
                flat = grid.reshape(-1).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part["h"].view(np.int64) if part["h"].flags.c_contiguous else part["h"].copy().view(np.int64)), pa.array(part["doc"].copy()), pa.array(part["start"].copy()), pa.array(part["wins"].astype(np.int32)), pa.array(part["left"].astype(np.int32)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(reach), len(part), [None, pa.py_buffer(flat)]).cast(pa.binary())],
                    names=["h", "doc", "start", "wins", "left", "context"],
                )

    few = wanted
    return texts.join(few, "doc_id").select("doc_id", "text", "blob").mapInArrow(run, "h long, doc long, start int, wins int, left int, context binary")


def intervals(lcp: np.ndarray, least: int) -> np.ndarray:
    """The tree of common-prefix intervals of depth `least` or more by one scan with a stack: rows (first, last, depth, depth of
    the parent). lcp[i] is that of suffixes i - 1 and i; lcp[0] is 0."""
    out, stack = [], [(0, 0)]  # (depth, first)
    values = lcp.tolist()
    for i in range(1, len(values) + 1):
        depth = values[i] if i < len(values) else 0
        first = i - 1
        while stack[-1][0] > depth:
            d, first = stack.pop()
            up = max(depth, stack[-1][0])
            if d >= least:
                out.append((first, i - 1, d, up))
        if depth > stack[-1][0]:
            stack.append((depth, first))
    return np.array(out, np.int64).reshape(-1, 4)


def shared_windows(h: np.ndarray, doc: np.ndarray, start: np.ndarray, wins: np.ndarray, left: np.ndarray, grid: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The ranges to remove among occurrences of anchors, from contexts that have the anchor at column length - gram."""
    width = length - gram + 1
    n = len(h)
    right = np.zeros((n, -(-length // 8) * 8), np.uint8)
    right[:, :length] = grid[:, width - 1 :]
    words = right.view(">u8").astype(np.uint64)
    order = np.lexsort((start, doc, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), h))
    h, doc, start, wins, left, grid = h[order], doc[order], start[order], wins[order], left[order], grid[order]
    suffix = grid[:, width - 1 :]
    differ = suffix[1:] != suffix[:-1]
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    lcp[1:][h[1:] != h[:-1]] = 0
    nodes = intervals(lcp, gram)
    gone = np.zeros((n, width + 2), bool)  # column o + 1: the window with the anchor at offset o
    low = left - wins + 1
    back = np.zeros(n, np.uint64)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((start + left, doc))] = np.arange(n)
    for o in range(width):
        if o:
            back = mix(back * np.uint64(0x9E3779B97F4A7C15) + grid[:, width - 1 - o].astype(np.uint64) + np.uint64(1))
        depth = length - o
        live = nodes[(nodes[:, 2] >= depth) & (nodes[:, 3] < depth)]
        if not len(live):
            continue
        live = live[np.argsort(live[:, 0])]
        counts = live[:, 1] - live[:, 0] + 1
        member = np.repeat(live[:, 0] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        node = np.repeat(np.arange(len(live)), counts)
        ok = (low[member] <= o) & (o <= left[member])
        member, node = member[ok], node[ok]
        if len(member) < 2:
            continue
        by = np.lexsort((rank[member], back[member], node))
        m, k = member[by], node[by]
        new = np.ones(len(m), bool)
        new[1:] = (k[1:] != k[:-1]) | (back[m[1:]] != back[m[:-1]])
        head = m[np.flatnonzero(new)[np.cumsum(new) - 1]]
        again = ~new & ~((doc[m] == doc[head]) & (start[m] + left[m] == start[head] + left[head]))
        gone[m[again], o + 1] = True
    step = np.diff(gone.astype(np.int8), axis=1)
    row, first = np.nonzero(step == 1)  # runs of offsets first .. last - 1
    last = np.nonzero(step == -1)[1]
    out = np.empty(len(row), RANGE)
    at = start[row] + left[row]
    out["doc"], out["start"], out["end"] = doc[row], at - last + 1, at - first + length
    return out


def _shared(contexts: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    def run(batches):
        held, grids = [], []
        for b in batches:
            if b.num_rows:
                held.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "doc", "start", "wins", "left")])
                grids.append(joined(b.column("context"))[0].reshape(b.num_rows, -1))
        if not held:
            return
        h, doc, start, wins, left = (np.concatenate(x) for x in zip(*held, strict=True))
        gone = shared_windows(h, doc.astype(np.int64), start.astype(np.int64), wins.astype(np.int64), left.astype(np.int64), np.concatenate(grids), length, gram)
        rows = _blobs(RANGES, (mix(gone["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), gone)
        for k in range(0, len(rows), 1000):
            yield _batch(rows[k : k + 1000])
        release()

    return contexts.repartition("h").mapInArrow(run, PACKED)


def _by_window(contexts: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """For anchors with more contexts than a task may hold: every window is a row, grouped by its own hash, summed map-side."""
    width = length - gram + 1

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            h, doc, start, wins, left = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "doc", "start", "wins", "left"))
            data, ends = joined(b.column("context"))
            roll, other = Rolling(data), Rolling(data, 1)
            for o in range(width):
                ok = (left - wins + 1 <= o) & (o <= left)
                at = ends[:-1][ok] + width - 1 - o
                yield pa.RecordBatch.from_arrays([pa.array((roll.of(at, at + length) ^ mix(h[ok].astype(np.uint64) + np.uint64(o))).view(np.int64)), pa.array(other.of(at, at + length).view(np.int64)), pa.array(doc[ok]), pa.array((start + left - o)[ok].astype(np.int32))], names=["w", "w2", "doc", "start"])

    windows = contexts.mapInArrow(run, "w long, w2 long, doc long, start int")
    first = windows.groupBy("w", "w2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = windows.join(first, ["w", "w2"]).where("struct(doc, start) <> first").select("doc", "start")

    def pack(batches):
        for b in batches:
            rows = np.empty(b.num_rows, RANGE)
            rows["doc"], rows["start"] = b.column("doc").to_numpy(), b.column("start").to_numpy()
            rows["end"] = rows["start"] + length
            if len(rows):
                yield _batch(_blobs(RANGES, (mix(rows["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), rows))

    return again.mapInArrow(pack, PACKED)


def repeated_ranges(df: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, blob): per document with repeats the maximal removed byte ranges, packed as RANGE rows."""
    spark = df.sparkSession
    texts = df.select("doc_id", "text").where("doc_id is not null and octet_length(text) >= %d" % length)
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1024, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // BUCKET_BYTES)
    tasks = n_bytes // TASK_BYTES
    matched = materialise(_match(_scatter(texts, buckets, length, gram), buckets, tasks, length), "matched")
    wanted = materialise(_by_document(matched, CONTEXTS, tasks), "wanted")
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("blob")), F.lit(0))).first()
    few = broadcast_if_small(wanted, n if size <= BROADCAST_BYTES else BROADCAST_ROWS + 1, BROADCAST_ROWS)
    contexts = materialise(_contexts(texts, few, length, gram), "contexts")
    crowds = contexts.groupBy("h").count().where(F.col("count") > TASK_CONTEXTS).select("h")
    ranges = matched
    if crowds.limit(1).count():
        crowds = materialise(crowds, "crowds")  # at most one per TASK_CONTEXTS rows
        ranges = ranges.union(_by_window(contexts.join(crowds, "h", "left_semi"), buckets, length, gram))
        contexts = contexts.join(crowds, "h", "left_anti")
    return _by_document(ranges.union(_shared(contexts, buckets, length, gram)), RANGES, tasks)


def without_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, then n_bytes, n_removed, n_spans, kept_sha256 and kept: the remaining bytes."""
    ranges = materialise(repeated_ranges(df, length, gram), "ranges")
    n, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("blob")), F.lit(0))).first()
    few = broadcast_if_small(ranges, n if size <= BROADCAST_BYTES else BROADCAST_ROWS + 1, BROADCAST_ROWS)
    schema = df.select(*keep).schema

    def run(batches):
        for b in slices(batches):
            rows = []
            for data, blob in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("blob").to_pylist(), strict=True):
                data = data or b""
                gone = np.frombuffer(blob, RANGE) if blob else ()
                at, parts = 0, []
                for r in gone:
                    parts.append(data[at : r["start"]])
                    at = int(r["end"])
                parts.append(data[at:])
                kept = b"".join(parts)
                rows.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            n_bytes, n_removed, n_spans, sha, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = StructType([*schema.fields, *StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").fields])
    columns = list(dict.fromkeys([*keep, "doc_id", "text"]))
    return df.select(*columns).join(few.select("doc_id", "blob"), "doc_id", "left").mapInArrow(run, out)


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")
