"""Near-duplicate classes by ProbMinHash.

A text is the set of its five-word shingles, which weigh the same however often they occur:
the verdict is on the plain similarity, so the candidates must be too. Each element is a
Poisson process (n occurrences given to ``signatures`` make the rate 1 + ln n) whose arrivals fall into random slots
of the signature; a slot keeps the element of its first arrival, and an element
stops once its next arrival comes after the latest first arrival of all slots.
Two signatures agree in a slot with the probability Jaccard similarity of the
sets. Signatures are banded; the texts of a band bucket are verified by the
plain Jaccard similarity of their shingle sets, at least ``LEAST``.

A bucket is not paired within itself. Shingles that only one text has bound what it can
share: a text too far from all others leaves, and a pair that the bound excludes is not
compared. The bucket's text with the fewest shingles of its own leads: all others are
compared with it, and those that are linked to it are one class, which needs no more links
inside. Texts of buckets that still hold several classes then meet by their rarest shingles
(``rare_pairs``), which finds every link between classes that is left.

Equal texts collapse before all this and come back at the end. Classes are the
connected components of the links.

Defined results: texts of fewer than five words (null and empty too) have no
shingle; they are alike only if they are equal, a null equals an empty text.
Rows with a null doc_id are left out; repeated ids share one row, and a link of any of
their texts is theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.llm.native import own_columns
from barloom.llm.storage import rewritten, small_batches
from barloom.llm.text import LOWER, chunks, mix, slice_hashes, prefix, spans, windows

WIDTH, LEAST = 5, 0.8
#: A pair of similarity LEAST shares no band with probability (1 - 0.8 ** 7) ** 44 = 3e-5.
BANDS, ROWS = 44, 7
SLOTS = BANDS * ROWS


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their counts, and where each text's begin (one more at the end)."""
    low = LOWER[data]
    starts, ends, before = spans(low, at)
    shingles = windows(slice_hashes(prefix(low), starts, ends), WIDTH)
    n = np.maximum(0, np.diff(before) - WIDTH + 1)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.repeat(before[:-1], n) + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    own = shingles[place]
    order = np.lexsort((own, doc))
    own, doc = own[order], doc[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return own[first], np.diff(np.append(first, len(own))), np.searchsorted(doc[first], np.arange(len(n) + 1))


def signatures(shingles: np.ndarray, counts: np.ndarray, begin: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash signatures (texts, slots) of uint64; 0 throughout for texts without shingles."""
    texts = len(begin) - 1
    doc = np.repeat(np.arange(texts), np.diff(begin))
    best = np.full(texts * slots, np.inf)
    owner = np.zeros(texts * slots, np.uint64)
    active = np.arange(len(shingles))
    rate, time, seed = 1 + np.log(counts), np.zeros(len(shingles)), shingles
    latest, last = np.full(texts, np.inf), np.empty(texts * slots, np.int64)
    step = 0
    while len(active):
        step += 1
        draw = mix(seed[active] ^ mix(np.uint64(step * 2 + 1) + np.zeros(1, np.uint64)))
        time[active] += -np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)) / rate[active]
        alive = time[active] < latest[doc[active]]
        active, draw = active[alive], draw[alive]
        slot = doc[active] * slots + (mix(draw) % np.uint64(slots)).astype(np.int64)
        # of several arrivals in a slot the first counts: it is written last
        late_first = np.argsort(-time[active])
        last[slot[late_first]] = late_first
        chosen = np.flatnonzero(last[slot] == np.arange(len(slot)))
        s, t = slot[chosen], time[active[chosen]]
        better = t < best[s]
        best[s[better]] = t[better]
        owner[s[better]] = shingles[active[chosen[better]]]
        some = np.unique(doc[active])
        latest[some] = best.reshape(texts, slots)[some].max(axis=1)
        active = active[time[active] < latest[doc[active]]]
    return owner.reshape(texts, slots)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for rows, data, at in chunks(batches):
        shingles, _, begin = shingle_sets(data, at)
        sig = signatures(shingles, np.ones(len(shingles), np.int64), begin)
        some = np.diff(begin) > 0
        band = np.zeros((len(some), BANDS), np.uint64)
        for k in range(BANDS):
            h = np.full(len(some), np.uint64(k + 1))
            for r in range(ROWS):
                h = mix(h ^ sig[:, k * ROWS + r])
            band[:, k] = h
        ends = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32)
        flat = pa.array(band[some].reshape(-1).view(np.int64))
        raw = data.tobytes()
        sha = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(sha, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "same", "bands"]
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, at in chunks(batches):
        shingles, _, begin = shingle_sets(data, at)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(shingles.view(np.int64)))], ["id", "set"]
        )


def partners(sets: DataFrame, least: float = LEAST) -> DataFrame:
    """id, n, own, most for each text that may be linked to another one.

    n: its shingles; own: those that no other text here has; most: the largest partner that is still possible.
    Of the shingles of two texts, n and m, linked ones share (n + m) * least / (1 + least) or more, and n - own at most.
    """
    held = sets.select("key", F.explode("set").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("texts"), F.min("key").alias("key"))
    own = held.filter("texts = 1").groupBy("key").agg(F.count(F.lit(1)).alias("own"))
    sized = sets.select("id", "key", F.size("set").cast("long").alias("n")).join(own, "key", "left").drop("key").withColumn("own", F.coalesce("own", F.lit(0).cast("long")))
    most = (F.col("n") - F.col("own")) * ((1 + least) / least) - F.col("n") + 1e-6
    return sized.withColumn("most", most).filter(F.col("most") >= least * F.col("n") - 1e-6)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with their similarity."""
    a, b = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    rest = [c for c in pairs.columns]
    return pairs.join(b, "b").join(a, "a").select(*rest, (both / (F.size("sa") + F.size("sb") - both)).alias("sim"))


def rare_pairs(texts: DataFrame, least: float = LEAST) -> DataFrame:
    """a, la, b, lb: all pairs of texts (id, key, set, label) of several classes that can have a similarity >= least.

    Shingles are ranked by the texts that hold them, rarest first. Two texts that are alike share one of the first
    n - ceil(least * n) + 1 of each, and behind their first common one enough must be left in both. A shingle's texts of
    its most frequent class are only met by the texts of its other classes.
    """
    held = rewritten(texts.select("id", "label", "key", F.explode("set").alias("shingle")), "held")
    ranks = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts"))
    ranked = held.join(ranks, "shingle").groupBy("id", "label", "key").agg(F.array_sort(F.collect_list(F.struct("texts", "shingle"))).alias("ranked"))
    n = F.size("ranked")
    first = F.slice("ranked", 1, (n - F.ceil(n * least - 1e-9) + 1).cast("int"))
    placed = ranked.select("id", "label", "key", n.alias("n"), F.posexplode(first).alias("at", "r")).select("id", "label", "key", "n", "at", "r.shingle")
    placed = rewritten(placed, "placed")
    per = placed.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("rows"))
    most = per.groupBy("shingle").agg(F.max(F.struct("rows", "label")).alias("m"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    most = most.select("shingle", F.col("m.label").alias("most"))
    open_ = rewritten(placed.join(most, "shingle"), "open")
    a = open_.filter("label <> most").select("shingle", F.col("id").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("at").alias("pa"))
    b = open_.select("shingle", F.col("id").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    alike = (F.col("la") != F.col("lb")) & (left >= (F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9)
    met = a.join(b, "shingle").filter(alike)
    swap = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y))
    return met.select(swap("a", "b").alias("a"), swap("la", "lb").alias("la"), swap("b", "a").alias("b"), swap("lb", "la").alias("lb")).distinct()


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links a, b between the classes of the pairs (a, la, b, lb) of similarity >= least."""
    found = _compared(pairs, sets).filter(F.col("sim") >= least)
    return rewritten(found.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "links")


def classes(buckets: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """node, component: no two texts of similarity >= least in a common bucket are in different components.

    Texts without a component are linked to none.
    """
    sized = rewritten(partners(sets, least), "sized")
    live = buckets.join(sized, "id")
    several = live.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct("own", "id", "n", "most")).alias("m")).filter("texts > 1")
    leaders = several.select("bucket", F.col("m.id").alias("a"), F.col("m.n").alias("na"), F.col("m.most").alias("ma"))
    live = rewritten(live.join(leaders, "bucket"), "live")
    fits = (F.col("n") <= F.col("ma")) & (F.col("na") <= F.col("most")) & (F.col("n") >= least * F.col("na")) & (F.col("na") >= least * F.col("n"))
    led = live.filter((F.col("id") != F.col("a")) & fits).select("a", F.col("a").alias("la"), F.col("id").alias("b"), F.col("id").alias("lb")).distinct()
    links = _linked(rewritten(led, "led"), sets, least)
    found = rewritten(components(links), "components")
    labelled = live.select("bucket", "id").join(found, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("component", "id").alias("label"))
    labelled = rewritten(labelled, "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
    rest = labelled.join(mixed, "bucket", "left_semi").select("id", "label").distinct()
    more = _linked(rewritten(rare_pairs(sets.join(rest, "id"), least), "rare"), sets, least)
    if more.isEmpty():
        return found
    return components(more.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id (the class's smallest doc_id), text_id (the smallest doc_id with the same text)."""
    small_batches(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").filter("doc_id IS NOT NULL")
    signed = rewritten(rows.mapInArrow(_sign, "doc_id long, same binary, bands array<long>"), "signed")
    texts = signed.groupBy("same").agg(F.min(F.struct("doc_id", "bands")).alias("m"))
    kept = rewritten(texts.select("same", F.col("m.doc_id").alias("id"), F.col("m.bands").alias("bands")), "texts")
    buckets = kept.select("id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    held = rewritten(buckets.join(shared, "bucket"), "buckets")
    wanted = held.select(F.col("id").alias("doc_id")).distinct()
    whole = rows.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = whole.select(F.col("doc_id").alias("id"), "text").mapInArrow(_sets, "id long, set array<long>").withColumn("key", F.monotonically_increasing_id())
    sets = rewritten(sets.filter("size(set) > 0"), "sets")
    text_of = signed.select("doc_id", "same").join(kept.select("same", F.col("id").alias("text_id")), "same")
    classed = text_of.join(classes(held, sets, least), F.col("text_id") == F.col("node"), "left")
    return classed.groupBy("doc_id").agg(F.min(F.coalesce("component", "text_id")).alias("class_id"), F.min("text_id").alias("text_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their class; rows without an id stay."""
    return docs.join(near_duplicates(docs).filter("doc_id <> class_id").select("doc_id"), "doc_id", "left_anti").select(*own_columns(docs))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
