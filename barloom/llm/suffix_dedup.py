"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

A byte goes if a string of ``SPAN`` bytes that covers it also starts in a
document with a smaller doc_id. The suffixes to sort are cut to their first SPAN
bytes, which is all that the rule looks at, and dealt out by content: a window
of SPAN bytes belongs to its anchor, the smallest hash of its ``GRAM``-byte
strings, so equal windows meet in one bucket and a bucket holds about 1/18 of a
hash's neighbourhood, never a whole document.

1. Each task lists the anchors of its documents, a bucket at a time as packed
   arrays; an anchor that several documents of a pack hold goes there once. An anchor
   met once in the corpus can't lie in a repeated string; the others go back to their
   documents. (Exact: it drops nothing that could match.) The number of buckets
   follows the bytes of all texts, not the number of tasks or partitions.
2. The windows of the remaining anchors, as segments of text, go to the buckets, each
   distinct segment of a pack once with the places where it stands.
3. A bucket sorts the suffixes of its distinct segments by the difference cover
   {1, 2} modulo 3: sampled triples are sorted and named, names are sorted by
   recursion until they are distinct or stand for SPAN bytes, the remaining
   suffixes are sorted by their first byte and the name after it, and merged.
   Adjacent suffixes with equal prefixes of SPAN bytes form a group; its smallest
   doc_id decides for all its members.
4. The removed ranges return to their documents and are cut out.

Every row is judged by itself: the unit is a doc_id and, where rows of one id differ, the hash of its text. Units of one id
have no smaller doc_id among them and take nothing from each other.

Defined results: a null text is empty; null doc_ids come after all others (2 ** 63 - 1 stands with them) and are
separate documents, none smaller than another; so are rows that repeat an id, whatever their texts; texts under SPAN bytes
stay whole. Periodic text makes one long segment, which is still one suffix range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.storage import rewritten, small_batches
from barloom.llm.text import chunks, mix, ordered, prefix, slice_hashes

SPAN, GRAM = 50, 16
WINDOW = SPAN - GRAM + 1
#: Anchors and segment bytes that a task packs at a time, at least; anchors to a packed row, as far as a task has so many.
FLUSH_ANCHORS, FLUSH_BYTES, ROW_ANCHORS = 400_000, 4 << 20, 64
#: Bytes of all texts to a bucket of segments, and to one of anchors: more of it where there is more, within these bounds.
SEGMENT_BUCKET, ANCHOR_BUCKET, ANCHOR_BUCKETS = 5 << 19, (5 << 19, 32 << 20), 4000
#: Windows that are looked up at a time when ranges are written.
SLICE = 1 << 20
KNOWN = -(1 << 63)  #: stands for the holders of an anchor that several documents of a pack have, which it lists apart
LAST = (1 << 63) - 1  #: stands for a null doc_id
BROADCAST_IDS = 500_000  #: ids whose rows differ, up to which they are broadcast
_48 = np.uint64(48)


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one anchor: text number, first start, one past the last start, 48-bit anchor."""
    n = len(data) - SPAN + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    starts = np.arange(len(data) - GRAM + 1)
    low = slice_hashes(prefix(data), starts, starts + GRAM) >> np.uint64(16)
    width = 1
    while width * 2 <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if WINDOW > width:
        low = np.minimum(low[: width - WINDOW], low[WINDOW - width :])
    inside = np.zeros(n + 1, np.int8)
    length = np.diff(at)
    long = length >= SPAN
    np.add.at(inside, at[:-1][long], 1)
    np.add.at(inside, at[1:][long] - SPAN + 1, -1)
    valid = np.cumsum(inside[:n], dtype=np.int8) > 0
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
    new[at[:-1][long]] = True
    first = np.flatnonzero(new & valid)
    doc = np.searchsorted(at, first, "right") - 1
    stop = np.minimum(np.append(first[1:], n), at[doc + 1] - SPAN + 1)
    return doc, first, stop, low[first]


def pack(values: np.ndarray) -> bytes:
    """Byte planes of integers, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(blob: bytes, dtype: str) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(blob[8:], n * size, "zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def _bucket(anchor: np.ndarray, n: int) -> np.ndarray:
    """Anchors are minima and crowd at low values, so they are hashed anew."""
    return ((mix(anchor) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _unit(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return rows.column(0).to_numpy(), rows.column(1).to_numpy()


def _fresh(*sorted_keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before it."""
    out = np.ones(len(sorted_keys[0]), bool)
    if len(out):
        out[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    return out


def _list_anchors(n_buckets: int):
    """Packed (anchor, id, nth) by bucket; ``known`` packs hold those whose anchor several documents of the pack have.

    Such an anchor goes to its bucket once, as KNOWN, so what a bucket gets of one anchor is one entry a pack, however many
    documents hold it.
    """
    most = max(FLUSH_ANCHORS, ROW_ANCHORS * n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            anchor, ids, nth = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.lexsort((nth, ids, anchor))
            anchor, ids, nth = anchor[order], ids[order], nth[order]
            fresh = _fresh(anchor, ids, nth)
            anchor, ids, nth = anchor[fresh], ids[fresh], nth[fresh]
            begin = np.flatnonzero(_fresh(anchor))
            several = np.diff(np.append(begin, len(anchor))) > 1
            local = np.repeat(several, np.diff(np.append(begin, len(anchor))))
            rows = []
            if local.any():
                spread = n_buckets + int(mix(anchor[local][:1] ^ ids[local][:1].view(np.uint64))[0] % np.uint64(n_buckets))
                rows.append((spread, pack(np.diff(anchor[local], prepend=np.uint64(0))), pack(ids[local]), pack(nth[local]), True))
            anchor, ids, nth = anchor[begin], np.where(several, KNOWN, ids[begin]), np.where(several, 0, nth[begin])
            bucket = _bucket(anchor, n_buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, anchor, ids, nth = bucket[order], anchor[order], ids[order], nth[order]
            edge = np.flatnonzero(np.diff(bucket)) + 1
            for a, b in zip(np.append(0, edge), np.append(edge, len(anchor)), strict=True):
                rows.append((int(bucket[a]), pack(np.diff(anchor[a:b], prepend=np.uint64(0))), pack(ids[a:b]), pack(nth[a:b]), False))
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], ["bucket", "anchors", "ids", "nths", "known"])

        count = 0
        for rows, data, at in chunks(batches):
            doc, _, _, anchor = anchors(data, at)
            if len(doc):
                held.append((anchor, *(x[doc] for x in _unit(rows))))
                count += len(doc)
            if count >= most:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """(id, nth, anchor) of all anchors that more than one document holds."""

    def listed(known: bool) -> list[np.ndarray]:
        own = [x for x in zip(*(table.column(c).to_pylist() for c in ("anchors", "ids", "nths", "known")), strict=True) if x[3] == known]
        anchor = [np.cumsum(unpack(x[0], "<u8"), dtype=np.uint64) for x in own]
        return [np.concatenate([np.zeros(0, np.uint64), *anchor]), *(np.concatenate([np.zeros(0, np.int64), *(unpack(x[i], "<i8") for x in own)]) for i in (1, 2))]

    anchor, ids, nth = listed(False)
    order = np.lexsort((nth, ids, anchor))
    anchor, ids, nth = anchor[order], ids[order], nth[order]
    begin = np.flatnonzero(_fresh(anchor))
    several = np.add.reduceat(_fresh(anchor, ids, nth).astype(np.int64), begin) > 1 if len(begin) else np.zeros(0, bool)
    # what a pack had several holders of is repeated, though one entry stands for them
    several |= np.minimum.reduceat(ids, begin) == KNOWN if len(begin) else several
    keep = np.repeat(several, np.diff(np.append(begin, len(anchor)))) & (ids != KNOWN)
    more, holders, places = listed(True)
    return pa.table({"id": pa.array(np.concatenate((ids[keep], holders))), "nth": pa.array(np.concatenate((nth[keep], places))), "anchor": pa.array(np.concatenate((anchor[keep], more)).view(np.int64))})


def _cut_segments(n_buckets: int):
    most = min(16 * FLUSH_BYTES, max(FLUSH_BYTES, 2048 * n_buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            bucket, ids, nth, start, size = (np.concatenate([x[i] for x in held]) for i in range(5))
            text = np.concatenate([x[5] for x in held])
            begin = np.cumsum(size) - size
            # equal segments of a pack send their text once
            _, one, which = np.unique(mix(slice_hashes(prefix(text), begin, begin + size) ^ mix(size.astype(np.uint64))), return_index=True, return_inverse=True)
            order = np.lexsort((which, bucket))
            edge = np.flatnonzero(np.diff(bucket[order])) + 1
            out = []
            for own in np.split(order, edge):
                new = np.append(True, which[own][1:] != which[own][:-1])
                kinds = one[which[own][new]]
                n = size[kinds]
                places = np.repeat(begin[kinds] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                own_text = text[places].tobytes()
                packed = len(own_text).to_bytes(8, "little") + pa.compress(own_text, "zstd", asbytes=True)
                out.append((int(bucket[own[0]]), pack(ids[own]), pack(nth[own]), pack(start[own]), pack((np.cumsum(new) - 1).astype(np.int64)), pack(n), packed))
            kinds = [pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["bucket", "ids", "nths", "starts", "kinds", "sizes", "text"])

        total = 0
        for rows, data, at in chunks(batches):
            doc, first, stop, anchor = anchors(data, at)
            lists = rows.column(3)
            wanted = lists.flatten().to_numpy().view(np.uint64)
            lengths = lists.value_lengths().fill_null(0).to_numpy()
            of = np.repeat(np.arange(len(lengths)), lengths)
            salt = np.uint64(0x9E3779B97F4A7C15)
            hit = np.isin(anchor ^ (doc.astype(np.uint64) * salt), wanted ^ (of.astype(np.uint64) * salt))
            doc, first, stop, anchor = doc[hit], first[hit], stop[hit], anchor[hit]
            if not len(doc):
                continue
            size = stop - first + SPAN - 1
            places = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            held.append((_bucket(anchor, n_buckets), *(x[doc] for x in _unit(rows)), (first - at[doc]).astype(np.int64), size.astype(np.int64), data[places]))
            total += int(size.sum())
            if total >= most:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    return run


def _named(parts: list[np.ndarray]) -> tuple[np.ndarray, int, np.ndarray]:
    """Ranks of tuples, equal for equal tuples, how many there are, and an order of the tuples."""
    name = parts[0]
    for more in parts[1:]:
        bits = np.int64(int(more.max(initial=0)).bit_length())
        if int(name.max(initial=0)).bit_length() + bits > 62:
            name = _named([name])[0]
        name = (name << bits) | more
    order, name = ordered(name)
    place = np.cumsum(_fresh(name)) - 1
    rank = np.empty(len(name), np.int64)
    rank[order] = place
    return rank, int(place[-1]) + 1 if len(place) else 0, order


def difference_cover_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``symbols`` (>= 1) in an order that is theirs by at least the first ``depth`` symbols."""
    n = len(symbols)
    s = np.concatenate((symbols.astype(np.int64), np.zeros(5, np.int64)))
    ones, twos = len(range(1, n + 2, 3)), len(range(2, n + 2, 3))
    name, kinds, order = _named([np.concatenate((s[1 + j :: 3][:ones], s[2 + j :: 3][:twos])) for j in range(3)])
    if kinds < len(name) and depth > 3:
        del order  # what is not needed again is not held beside the recursion
        name += 1
        order = difference_cover_order(name, -(-depth // 3))
        name[order] = np.arange(len(name))
    rank = np.zeros(n + 5, np.int64)
    rank[1 : n + 2 : 3], rank[2 : n + 2 : 3] = name[:ones] + 1, name[ones:] + 1
    sorted_sample = np.where(order < ones, 3 * order + 1, 3 * (order - ones) + 2)
    del name, order
    sorted_sample = sorted_sample[sorted_sample < n]
    zeros = np.arange(0, n, 3)
    bits = np.int64(int(rank.max(initial=0)).bit_length())
    single = (s[:n] << bits) | rank[1 : n + 1]
    by, key = ordered(single[::3])
    zeros = zeros[by]
    # a suffix of class 0 meets class 1 by (symbol, rank) and class 2 by (two symbols, rank)
    own_ones, own_twos = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    less = np.searchsorted(single[own_ones], key, "left")
    del single
    wide = np.int64(int(s.max(initial=0)).bit_length())
    if 2 * int(wide) + int(bits) <= 62:
        double = (((s[:n] << wide) | s[1 : n + 1]) << bits) | rank[2 : n + 2]
        left, right = double[own_twos], double[zeros]
        del double
    else:
        both, _, _ = _named([np.concatenate((s[own_twos], s[zeros])), np.concatenate((s[own_twos + 1], s[zeros + 1])), np.concatenate((rank[own_twos + 2], rank[zeros + 2]))])
        left, right = both[: len(own_twos)], both[len(own_twos) :]
    less = less + np.searchsorted(left, right, "left")
    out = np.empty(n, np.int64)
    # ranks of tied prefixes may disagree between the classes; running maxima keep the order of class 0
    at = np.maximum.accumulate(less) + np.arange(len(zeros)) if len(zeros) else less
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at] = zeros
    out[~taken] = sorted_sample
    return out


def _equal_next(data: np.ndarray, order: np.ndarray, span: int) -> np.ndarray:
    """Whether each suffix and the next in order share their first ``span`` bytes."""
    out = np.zeros(len(order), bool)
    view = np.lib.stride_tricks.sliding_window_view(data, span)
    for i in range(0, len(order) - 1, 1 << 16):
        a, b = order[i : min(i + (1 << 16), len(order) - 1)], order[i + 1 : i + 1 + (1 << 16)]
        b = b[: len(a)]
        head = np.flatnonzero((data[a] == data[b]) & (data[a + span - 1] == data[b + span - 1]))
        out[i + head] = (view[a[head]] == view[b[head]]).all(axis=1)
    return out


def smallest_holder(text: np.ndarray, sizes: np.ndarray, holders: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For each window of each segment (end to end), the smallest holder of an equal window."""
    begin = np.cumsum(sizes) - sizes
    separated = np.zeros(len(text) + len(sizes) + span, np.uint8)
    shift = np.repeat(np.arange(len(sizes)), sizes)
    separated_symbols = np.ones(len(separated), np.int64)
    where = np.arange(len(text)) + shift
    separated[where] = text
    separated_symbols[where] = text.astype(np.int64) + 2
    order = difference_cover_order(separated_symbols, span)
    windows = sizes - span + 1
    start = np.repeat(begin + np.arange(len(sizes)) - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    number = np.full(len(separated), -1, np.int64)
    number[start] = np.arange(len(start))
    order = order[number[order] >= 0]
    holder = np.repeat(holders, windows)[number[order]]
    group = np.ones(len(order), bool)
    if len(order):
        group[1:] = ~_equal_next(separated, order, span)[:-1]
    at = np.flatnonzero(group)
    low = np.minimum.reduceat(holder, at) if len(at) else holder
    out = np.empty(len(start), np.int64)
    out[number[order]] = np.repeat(low, np.diff(np.append(at, len(order))))
    return out


def _ranges(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Removed byte ranges (id, nth, start, stop) that the segments of a bucket show.

    Segments are sorted once each, for their smallest holder; their places are looked up a slice at a time.
    """
    column = lambda name, kind: [unpack(x, kind) for x in table.column(name).to_pylist()]
    ids, nths, starts, sizes, kinds = (column(name, "<i8") for name in ("ids", "nths", "starts", "sizes", "kinds"))
    before = np.cumsum([0, *map(len, sizes)])
    kind = np.concatenate([k + b for k, b in zip(kinds, before[:-1], strict=True)])
    ids, nths, starts, sizes = (np.concatenate(x) for x in (ids, nths, starts, sizes))
    text = np.frombuffer(b"".join(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True) for x in table.column("text").to_pylist()), np.uint8)
    begin = np.cumsum(sizes) - sizes
    # the packs' segments again once each
    _, one, same = np.unique(mix(slice_hashes(prefix(text), begin, begin + sizes) ^ mix(sizes.astype(np.uint64))), return_index=True, return_inverse=True)
    kind, n = same[kind], sizes[one]
    places = np.repeat(begin[one] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    holder = np.full(len(one), LAST)
    np.minimum.at(holder, kind, ids)
    low = smallest_holder(text[places], n, holder)
    low_begin = np.cumsum(n - SPAN + 1) - (n - SPAN + 1)
    windows = n[kind] - SPAN + 1
    cut = np.searchsorted(np.cumsum(windows), np.arange(SLICE, int(windows.sum()) + 1, SLICE)) + 1
    for a, b in zip(np.append(0, cut), np.append(cut, len(ids)), strict=True):
        if a >= b:
            continue
        w = windows[a:b]
        member = np.repeat(np.arange(a, b), w)
        offset = np.arange(len(member)) - np.repeat(np.cumsum(w) - w, w)
        gone = low[low_begin[kind[member]] + offset] < ids[member]
        member, offset = member[gone], offset[gone]
        if not len(member):
            continue
        head = np.ones(len(member), bool)
        head[1:] = (member[1:] != member[:-1]) | (offset[1:] != offset[:-1] + 1)
        first = np.flatnonzero(head)
        final = np.append(first[1:], len(member)) - 1
        m = member[first]
        parts = [ids[m], nths[m], (starts[m] + offset[first]).astype(np.int64), (starts[m] + offset[final] + SPAN).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], ["id", "nth", "start", "stop"])


def _all_ranges(table: pa.Table) -> pa.Table:
    kinds = pa.schema([("id", pa.int64()), ("nth", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
    return pa.Table.from_batches(list(_ranges(table)), kinds)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for rows, data, at in chunks(batches):
        lists = rows.column(2)
        flat = lists.flatten()
        edges = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())))
        start, stop = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        out = []
        for i, doc in enumerate(rows.column(0).to_pylist()):
            text = data[at[i] : at[i + 1]]
            a, b = start[edges[i] : edges[i + 1]], np.minimum(stop[edges[i] : edges[i + 1]], len(text))
            sha, kept, removed, spans = hashlib.sha256(), 0, 0, 0
            if len(a):
                by = np.argsort(a, kind="stable")
                a, reach = a[by], np.maximum.accumulate(b[by])
                head = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
                begins, ends = a[head], reach[np.append(head[1:], len(a)) - 1]
                spans, removed = len(head), int((ends - begins).sum())
                for x, y in zip(begins.tolist(), ends.tolist(), strict=True):
                    sha.update(text[kept:x])
                    kept = y
            sha.update(text[kept:])
            out.append((doc, len(text), removed, spans, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)


def _units(docs: DataFrame) -> DataFrame:
    """order_id, nth, text: nth tells the texts of an id apart where they differ, by their hash, and is odd for a null id."""
    null = F.col("doc_id").isNull()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("order_id"))
    mark = F.xxhash64("text")
    differing = rewritten(rows.groupBy("order_id").agg((F.min(mark) != F.max(mark)).alias("_differs")).filter("_differs"), "differing")
    n = differing.count()
    odd = F.when(null, F.lit(1)).otherwise(F.lit(0)).cast("long")
    if not n:
        return rows.select("order_id", odd.alias("nth"), "text")
    flagged = rows.join(F.broadcast(differing) if n <= BROADCAST_IDS else differing, "order_id", "left")
    own = F.when(F.col("_differs"), F.shiftleft(mark, 1)).otherwise(F.lit(0).cast("long"))
    return flagged.select("order_id", own.bitwiseOR(odd).alias("nth"), "text")


def removed_ranges(units: DataFrame) -> DataFrame:
    """id, nth, start, stop: byte ranges to remove of each unit (order_id, nth, text); they may overlap."""
    size = units.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    low, high = ANCHOR_BUCKET
    n_anchors, n_segments = max(1, -(-size // min(high, max(low, size // ANCHOR_BUCKETS)))), max(1, -(-size // SEGMENT_BUCKET))
    listed = units.mapInArrow(_list_anchors(n_anchors), "bucket int, anchors binary, ids binary, nths binary, known boolean")
    repeated = listed.groupBy("bucket").applyInArrow(_repeated, "id long, nth long, anchor long")
    wanted = repeated.groupBy(F.col("id").alias("order_id"), "nth").agg(F.collect_list("anchor").alias("anchors"))
    texts = units.join(wanted, ["order_id", "nth"]).select("order_id", "nth", "text", "anchors")
    segments = texts.mapInArrow(_cut_segments(n_segments), "bucket int, ids binary, nths binary, starts binary, kinds binary, sizes binary, text binary")
    return segments.groupBy("bucket").applyInArrow(_all_ranges, "id long, nth long, start long, stop long")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    small_batches(docs.sparkSession)
    units = _units(docs)
    spans = removed_ranges(units).groupBy(F.col("id").alias("order_id"), "nth").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    # texts are dealt out by unit for the segments already, so Spark uses that shuffle again
    joined = units.join(spans, ["order_id", "nth"], "left")
    doc = F.when(F.col("nth") % 2 == 0, F.col("order_id"))
    return joined.select(doc.alias("doc_id"), "text", "ranges").mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
