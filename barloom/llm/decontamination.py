"""Benchmark decontamination: size-partitioned MinHash containment search.

A document belongs to a benchmark item if it holds 80 % or more of the item's
distinct five-word shingles (lower case). Documents fall into size partitions;
a document of partition e is hashed in one permutation into 2 ** e slots, about
as many as it has shingles, and the smallest hash of each slot is its signature.
An item has a signature for each partition, so that a short item meets a long
document at the same resolution. A common minimum makes a candidate, and exact
shingle containment decides.

An item of few shingles could miss all minima; items under ``EXACT_BELOW``
shingles use the finest partition instead: all their shingles against all
shingles of the documents. For others a document holding 80 % is missed with
probability below 1e-6.

Defined results: texts under five words have no shingles, so such items and
documents match nothing, as null texts and null ids do. Every row is judged by
itself, of documents and of items; of the rows that share a doc_id and an item_id
the pair with the highest containment is reported, of equal ones that with the
most common shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.native import let, own_columns, window_hashes, words
from barloom.llm.storage import rewritten

WIDTH, LEAST, EXACT_BELOW = 5, 0.8, 24
#: Partitions by the power of two of the number of slots; the last takes all larger documents at full resolution.
PARTITIONS = tuple(range(4, 32, 2))
EXACT = -1  #: stands for the finest partition, of all shingles
#: Rows up to which the index, the candidates and the ids found are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def shingles(text: Column) -> Column:
    return F.array_distinct(window_hashes(words(F.lower(text)), WIDTH))


def _minima(hashes: Column, e: Column) -> Column:
    """The smallest hash of each slot; a slot is the e highest bits, so one sort brings slots together."""
    slot = lambda x: F.call_function("shiftrightunsigned", x, 64 - e)
    return let(
        F.sort_array(hashes),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (slot(x) != slot(F.get(s, F.greatest(i - 1, F.lit(0)))))),
    )


def _partition(n: Column) -> Column:
    e = F.lit(PARTITIONS[-1])
    for p in reversed(PARTITIONS[:-1]):
        e = F.when(n <= (1 << p), F.lit(p)).otherwise(e)
    return e


def _bound(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of each pair at or above LEAST."""
    wanted = items.filter("item_id IS NOT NULL").select("item_id", shingles(F.col("text")).alias("item")).filter(F.size("item") > 0)
    wanted = wanted.withColumns({"n_item": F.size("item").cast("long"), "key": F.xxhash64("item")}).dropDuplicates(["item_id", "key"])
    large = wanted.filter(F.col("n_item") >= EXACT_BELOW).withColumn("e", F.explode(F.array(*map(F.lit, PARTITIONS))))
    index = large.select("item_id", "key", "e", F.explode(_minima(F.col("item"), F.col("e"))).alias("h"))
    small = wanted.filter(F.col("n_item") < EXACT_BELOW).select("item_id", "key", F.lit(EXACT).alias("e"), F.explode("item").alias("h"))
    has_small = not small.isEmpty()

    # a text is shingled once: its minima, and all its shingles where items ask for them
    def keys(d: Column) -> Column:
        minima = let(_partition(F.size(d)), lambda e: F.transform(_minima(d, e), lambda h: F.struct(e.alias("e"), h.alias("h"))))
        return F.concat(minima, F.transform(d, lambda h: F.struct(F.lit(EXACT).alias("e"), h.alias("h")))) if has_small else minima

    hashed = docs.filter("doc_id IS NOT NULL").select("doc_id", F.explode(let(shingles(F.col("text")), keys)).alias("k")).select("doc_id", "k.e", "k.h")
    found = hashed.join(_bound(index.unionByName(small)), ["e", "h"]).select("doc_id", "item_id", "key").distinct()
    candidates = _bound(rewritten(found, "candidates")).join(_bound(wanted), ["item_id", "key"])
    exact = docs.select("doc_id", "text").join(_bound(candidates), "doc_id").select(
        "doc_id", "item_id", "n_item", F.size(F.array_intersect(shingles(F.col("text")), F.col("item"))).cast("long").alias("n_shared")
    )
    held = exact.withColumn("containment", F.col("n_shared") / F.col("n_item")).filter(F.col("containment") >= LEAST)
    best = held.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shared", "best.n_item", "best.containment")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item; a null doc_id stays."""
    return docs.join(_bound(rewritten(contained(docs, items).select("doc_id").distinct(), "found")), "doc_id", "left_anti").select(*own_columns(docs))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP8_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
ds AS (SELECT DISTINCT d, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
       FROM (SELECT d, ws, unnest(range(1, len(ws) - 3)) AS i FROM dw WHERE len(ws) >= 5)),
bw AS (SELECT row_number() OVER () AS b, item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
bs AS (SELECT DISTINCT b, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
       FROM (SELECT b, ws, unnest(range(1, len(ws) - 3)) AS i FROM bw WHERE len(ws) >= 5)),
n AS (SELECT b, count(*) AS n_item FROM bs GROUP BY b),
p AS (SELECT d, b, count(*) AS n_shared FROM ds JOIN bs USING (g) GROUP BY d, b),
x AS (SELECT doc_id, item_id, max({'c': n_shared / n_item, 's': n_shared, 'n': n_item}) AS best
      FROM p JOIN n USING (b) JOIN dw USING (d) JOIN bw USING (b) WHERE n_shared / n_item >= 0.8 GROUP BY doc_id, item_id)
SELECT doc_id, item_id, best.s AS n_shared, best.n AS n_item, best.c AS containment FROM x
"""
