"""Removal of repeated byte strings: a byte goes if a string of `LENGTH` bytes that covers it
also starts in a document with a smaller id.

Method: longest previous factors, shard by shard.  A window of `LENGTH` bytes belongs to the least
of its hashed k-grams, so that equal windows of any two documents meet in one shard;
neighbouring windows with the same least gram travel as one segment of text.  A shard sorts the
starts of its windows in suffix order, `LENGTH` + `TAIL` bytes far, with the common prefix of
neighbours.  The previous and the next smaller position of a start are the
nearest ones in that order that lie in a smaller document; the longer of the two common prefixes
is its longest previous factor.  Bytes under factors of `LENGTH` and more go; first copies stay.

Before the shards are formed, grams that only one document has are left out: they are counted
over all documents, and a bit field of bounded size tells the tasks which grams are shared (a
wrong bit only costs work).  A segment that equals one of a smaller document in the same task
is removed there, so that a passage which many documents share meets in few rows.  The segments
of a gram that more than `HOT_SEGMENTS` texts have would crowd one task; they are taken apart
into windows, which are dealt by their own bytes and compared with the least document of each.

Null text: empty.  Rows without an id keep their text and take nothing from others.  Texts
shorter than `LENGTH` stay.  Rows of one id do not remove from each other; each row gets its own
result.  Equality of whole segments within a task goes by 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import batches as B
from wordloom.llm.fields import bit_field, field_bits, member
from wordloom.session import bounded_join, written

LENGTH = 50
GRAM = 20
TAIL = 8  # bytes beyond `LENGTH` that the suffix order looks at
SLICE_BYTES = 1 << 20
SHARD_BYTES = 2 << 20  # segments sorted at once; a larger group of one gram stands alone
HOT_SEGMENTS = 1 << 15  # texts with one gram, from which on its windows are dealt one by one


class Segments:
    """Segments of the texts of a slice: neighbouring windows with the same least gram."""

    def __init__(self, column: pa.Array, length: int, gram: int):
        self.data, offsets = B.text_bytes(column)
        n = len(self.data)
        self.gram = np.zeros(0, np.uint64)
        self.text = self.start = self.windows = np.zeros(0, np.int64)
        if n < length:
            return
        self.sums = B.prefix_hashes(self.data)
        down = B.powers(n + 1)[1]
        least = B.mix((self.sums[gram:] - self.sums[:-gram]) * down[: n - gram + 1])
        width, size = length - gram + 1, 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: size - width], least[width - size :])
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
        at = np.flatnonzero(np.arange(len(least)) + length <= offsets[text + 1])
        if not len(at):
            return
        least, text = least[at], text[at]
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
        first = np.flatnonzero(new)
        self.gram, self.text, self.start = least[first], text[first], at[first]
        self.windows = np.diff(np.append(first, len(least)))
        self.begin = offsets[:-1][self.text]  # of the text, in the slice

    def content(self, some: np.ndarray, length: int) -> np.ndarray:
        """64-bit hashes of whole segments."""
        a = self.start[some]
        b = a + self.windows[some] + length - 1
        down = B.powers(len(self.data) + 1)[1]
        return B.mix((self.sums[b] - self.sums[a]) * down[a] + (b - a).astype(np.uint64))

    def bytes_of(self, some: np.ndarray, length: int) -> pa.Array:
        sizes = self.windows[some] + length - 1
        ends = np.cumsum(sizes)
        gather = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[some] - (ends - sizes), sizes)
        bounds = np.concatenate([[0], ends]).astype(np.int32)
        buffers = [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(self.data[gather]))]
        return pa.Array.from_buffers(pa.binary(), len(sizes), buffers)


def shared_grams(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(g, n), written: the least grams that two texts or more have, and how many have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, "text", SLICE_BYTES):
                found = Segments(part.column("text"), length, gram)
                order = np.lexsort((found.text, found.gram))
                g, t = found.gram[order], found.text[order]
                g = g[np.concatenate([[True], (g[1:] != g[:-1]) | (t[1:] != t[:-1])])[: len(g)]]
                first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])[: len(g)])
                n = np.diff(np.append(first, len(g)))
                yield pa.RecordBatch.from_arrays([pa.array(g[first].view(np.int64)), pa.array(n)], ["g", "n"])

    places = docs.select("text").mapInArrow(run, "g bigint, n bigint")
    return written(places.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1"))


def segments(docs: DataFrame, field: np.ndarray, length: int, gram: int) -> DataFrame:
    """(g, doc_id, key, start, bytes): segments whose gram is shared; rows without bytes are
    removals already known, of `length` bytes or more, with their number in `size`."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, "text", SLICE_BYTES):
                found = Segments(part.column("text"), length, gram)
                some = np.flatnonzero(member(shared.value, found.gram))
                if not len(some):
                    continue
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                keys = part.column("key").to_numpy(zero_copy_only=False)
                content, doc = found.content(some, length), ids[found.text[some]]
                order = np.lexsort((doc, content))
                heads = np.concatenate([[True], content[order][1:] != content[order][:-1]])
                least = np.empty_like(doc)
                least[order] = doc[order][heads][np.cumsum(heads) - 1]
                known = doc > least
                go, cut = some[~known], some[known]
                t = found.text[go]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.gram[go].view(np.int64)),
                        pa.array(ids[t]),
                        pa.array(keys[t]),
                        pa.array(found.start[go] - found.begin[go]),
                        pa.array(np.zeros(len(go), np.int64)),
                        found.bytes_of(go, length),
                    ],
                    names,
                )
                if len(cut):
                    start = found.start[cut]
                    end = start + found.windows[cut] + length - 1
                    first, last = merged(start, end, found.text[cut])
                    t = found.text[cut][first]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(B.mix(start[first].astype(np.uint64) + keys[t].astype(np.uint64)).view(np.int64)),
                            pa.array(ids[t]),
                            pa.array(keys[t]),
                            pa.array(start[first] - found.begin[cut][first]),
                            pa.array(last - start[first]),
                            pa.nulls(len(first), pa.binary()),
                        ],
                        names,
                    )

    names = ["g", "doc_id", "key", "start", "size", "bytes"]
    return docs.mapInArrow(run, "g bigint, doc_id bigint, key bigint, start bigint, size bigint, bytes binary")


def merged(start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals sorted by (group, start) -> (index of the first of each run that touches or
    overlaps, end of the run)."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shift = group * (int(end.max()) + 1)  # so that the furthest end so far is one of the own group
    furthest = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] + shift[1:] > furthest[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(start) - 1)
    return first, furthest[last] - shift[last]


def window_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    sums, down = B.prefix_hashes(data), B.powers(len(data) + 1)[1]
    return (sums[starts + length] - sums[starts]) * down[starts]


def suffix_order(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the starts in the order of the bytes from there to their ends, as far as
    `length` + TAIL, ties by document, and the length of the common prefix of each with the one
    before it, 0 if it is below `length`.

    The first `length` bytes are ordered by their hash, as no one asks which of two different
    windows is smaller; neighbours are compared byte by byte."""
    padded = np.concatenate([data, np.zeros(length + TAIL, np.uint8)])
    eight = np.zeros(len(data) + length + 1, np.uint64)
    for i in range(8):
        eight = eight << np.uint64(8) | padded[i : len(eight) + i]
    left = np.minimum(ends - starts - length, TAIL)
    beyond = (np.uint64(8) * (TAIL - left).astype(np.uint64)) & np.uint64(63)
    tail = np.where(left > 0, eight[starts + length] >> beyond << beyond, np.uint64(0))
    order = np.lexsort((doc, tail, window_hashes(data, starts, length)))
    ranked = starts[order]
    same = np.ones(max(0, len(order) - 1), bool)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length > 8 else [])]:
        word = eight[ranked + at]
        same &= word[1:] == word[:-1]
    if length < 8:
        word = eight[ranked] >> np.uint64(64 - 8 * length)
        same &= word[1:] == word[:-1]
    other = tail[order][1:] ^ tail[order][:-1]
    more = np.full(len(other), TAIL)
    for k in range(8, 0, -1):
        more[(other >> np.uint64(64 - 8 * k)) != 0] = k - 1
    left = left[order]
    common = np.zeros(len(order), np.int64)
    common[1:] = np.where(same, length + np.minimum(more, np.minimum(left[1:], left[:-1])), 0)
    return order, common


def smaller_before(doc: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each place with the nearest one before it that has a smaller document, if it is
    `length` or more; else 0 (or less than `length`).

    All places between a place and its candidate have no smaller document, so a candidate's own
    candidate is the next one to ask; the steps double."""
    prev, shared = np.arange(len(doc)) - 1, common.copy()
    open_ = np.flatnonzero((prev >= 0) & (shared >= length) & (doc[prev] >= doc))
    while len(open_):
        p = prev[open_]
        further, least = prev[p], np.minimum(shared[open_], shared[p])
        prev[open_], shared[open_] = further, least
        open_ = open_[(further >= 0) & (least >= length) & (doc[further] >= doc[open_])]
    return np.where((prev >= 0) & (doc[prev] < doc), shared, 0)


def longest_previous(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factor of each start, from its previous and its next smaller position; lengths
    below `length` are not told apart."""
    order, common = suffix_order(data, starts, ends, doc, length)
    before = smaller_before(doc[order], common, length)
    after = smaller_before(doc[order][::-1], np.append(common[1:], 0)[::-1], length)[::-1]
    out = np.zeros(len(starts), np.int64)
    out[order] = np.maximum(before, after)
    return out


def repeated_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Mask of the starts whose longest previous factor has `length` bytes or more.  Only windows whose
    hash is met twice enter the suffix order."""
    window = window_hashes(data, starts, length)
    order = np.argsort(window)
    ranked = window[order]
    twice = np.zeros(len(order) + 1, bool)
    twice[1:-1] = ranked[1:] == ranked[:-1]
    some = np.sort(order[twice[1:] | twice[:-1]])
    out = np.zeros(len(starts), bool)
    out[some] = longest_previous(data, starts[some], ends[some], doc[some], length) >= length
    return out


def segment_bytes(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of the column of segments."""
    column = rows.column("bytes")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def hot_removals(found: DataFrame, length: int) -> DataFrame:
    """(doc_id, key, start, size): the windows of segments that a smaller document has as well.  One row
    per different window goes back to the windows, which the adaptive planner splits."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(batch.column("bytes").is_valid())
            for part in B.slices(rows, "bytes", 1 << 16):
                data, bounds = segment_bytes(part)
                counts = np.diff(bounds) - length + 1
                segment = np.repeat(np.arange(len(counts)), counts)
                inner = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
                gather = (bounds[segment] + inner)[:, None] + np.arange(length)
                windows = pa.Array.from_buffers(pa.binary(length), len(segment), [None, pa.py_buffer(np.ascontiguousarray(data[gather]))])
                doc, key, start = (part.column(c).to_numpy()[segment] for c in ("doc_id", "key", "start"))
                yield pa.RecordBatch.from_arrays([windows.cast(pa.binary()), pa.array(doc), pa.array(key), pa.array(start + inner)], ["bytes", "doc_id", "key", "start"])

    windows = found.mapInArrow(apart, "bytes binary, doc_id bigint, key bigint, start bigint").withColumn("h", F.xxhash64("bytes"))
    least = windows.groupBy("h", "bytes").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    later = windows.join(least.hint("merge"), ["h", "bytes"]).where("doc_id > least")
    return later.select("doc_id", "key", "start", F.lit(length).cast("bigint").alias("size"))


def removals(found: DataFrame, length: int) -> DataFrame:
    """(doc_id, key, start, size): byte runs to remove, from segments dealt by gram."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        data, bounds = segment_bytes(table)
        doc, key, start = (table.column(c).to_numpy() for c in ("doc_id", "key", "start"))
        counts = np.diff(bounds) - length + 1
        segment = np.repeat(np.arange(len(counts)), counts)
        inner = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
        hit = repeated_windows(data, bounds[segment] + inner, bounds[segment + 1], doc[segment], length)
        segment, inner = segment[hit], inner[hit]
        first, last = merged(inner, inner + length, segment)
        s = segment[first]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[s]), pa.array(key[s]), pa.array(start[s] + inner[first]), pa.array(last - inner[first])], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            known = batch.filter(batch.column("bytes").is_null())
            if known.num_rows:
                yield known.select(names)
            rows = batch.filter(batch.column("bytes").is_valid())
            if not rows.num_rows:
                continue
            g = rows.column("g").to_numpy()
            if held and size > SHARD_BYTES:  # the group at the seam must stay together
                last = held[-1].column("g")[-1].as_py()
                cut = int(np.searchsorted(g != last, True)) if (g == last).any() else 0
                cut = len(g) if (g == last).all() else cut
                if cut:
                    held.append(rows.slice(0, cut))
                if cut < len(g):
                    yield solve(held)
                    held, size = [], 0
                    rows = rows.slice(cut)
                else:
                    continue
            held.append(rows)
            size += rows.nbytes
        if held:
            yield solve(held)

    names = ["doc_id", "key", "start", "size"]
    dealt = found.repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, "doc_id bigint, key bigint, start bigint, size bigint")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("key"), body.alias("text"))


def joined_runs(cuts: DataFrame) -> DataFrame:
    """(doc_id, key, runs): the runs of each row in order, those that touch or overlap made one."""
    kind = pa.struct([("start", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("runs")
            flat = lists.flatten()
            start, size = flat.field("start").to_numpy(), flat.field("size").to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets, np.int64)))
            first, end = merged(start, start + size, row)
            sizes = np.bincount(row[first], minlength=batch.num_rows)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(start[first]), pa.array(end - start[first])], fields=list(kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "key", "runs"]
            )

    found = F.sort_array(F.collect_list(F.struct("start", "size"))).alias("runs")  # at most the windows of one text
    each = cuts.groupBy("doc_id", "key").agg(found)
    return each.mapInArrow(run, "doc_id bigint, key bigint, runs array<struct<start: bigint, size: bigint>>")


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, key, text, runs): every row with the byte runs to remove, as (start, size) in
    order; null if there are none.  The runs reach the texts by a size-checked join."""
    rows = keyed(docs, key, text)
    able = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    shared = shared_grams(able, length, gram)
    found = segments(able, bit_field(shared, "g", field_bits(shared.count())), length, gram)
    hot = written(shared.where(F.col("n") > HOT_SEGMENTS).select("g", F.lit(True).alias("hot")))
    crowded = hot.count()
    if crowded:
        told = bounded_join(found, hot, "g", crowded, 32)
        some = removals(told.where("hot is null").drop("hot"), length)
        cuts = some.unionByName(hot_removals(told.where("hot").drop("hot"), length))
        known = told.where("hot and bytes is null").select("doc_id", "key", "start", "size")
        cuts = cuts.unionByName(known)
    else:
        cuts = removals(found, length)
    runs = written(joined_runs(cuts))
    count, spans = runs.agg(F.count("*"), F.sum(F.size("runs"))).first()
    row_bytes = 96 + 32 * (spans or 0) // max(1, count)
    return bounded_join(rows, runs, ["doc_id", "key"], count, row_bytes)


def cut(data: bytes, runs: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """(what is left of `data`, maximal removed runs as (start, end))"""
    spans: list[tuple[int, int]] = []
    for a, size in sorted((r["start"], r["size"]) for r in runs or []):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], a + size))
        else:
            spans.append((a, a + size))
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), spans


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, kept, spans): what is left of each text, as bytes, and the runs taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, "text"):
                got = [cut(t.encode(), r) for t, r in zip(part.column("text").to_pylist(), part.column("runs").to_pylist())]
                spans = [[{"start": a, "end": b} for a, b in s] for _, s in got]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([k for k, _ in got], pa.binary()), pa.array(spans, kind)],
                    ["doc_id", "kept", "spans"],
                )

    schema = "doc_id bigint, kept binary, spans array<struct<start: bigint, end: bigint>>"
    return marked(docs, key, text, length).mapInArrow(run, schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): the outcome of `removed` as digests."""
    done = removed(docs, key, text, length)
    taken = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return done.select(
        "doc_id",
        (F.octet_length("kept").cast("bigint") + taken).alias("n_bytes"),
        taken.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
