"""Centroid clustering by annulus search over whole-number vectors.

A component x becomes floor(SCALE * x), so distances, sums and means are exact and the same on every machine. Centroids lie
sorted by norm. A vector's distance to the centroid nearest in norm bounds its distance to the best one, and by the triangle
inequality a centroid within that bound has a norm no further from the vector's than it; two binary searches find that
annulus, and only its centroids are compared exactly, those on its edges included. A round sends one row of sums a task and
cluster to the next; only centroids (k times the dimension) reach the driver and go back to the tasks.

Defined results: a vector that is null, has another number of components, or has one that is null, not finite or of a
magnitude of 2 ** 20 or more (its squared distances may leave 64 bits) is left out; repeated rows are vectors each; a null
vec_id starts no centroid while others can, its hash comes last; equal hashes go by components; with fewer vectors than
centroids there are as many centroids as vectors; an empty table gives no rows. A sum of distances beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.storage import rewritten

K, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64.0, 1
MAGNITUDE = 2.0**20
#: Bytes of centroids up to which they are collected and sent to every task; pairs compared at once.
MOST_BYTES, PAIRS = 64 << 20, 1 << 15


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector (the smaller of equals) and its squared distance."""
    size = lambda x: np.sqrt((x * x).sum(axis=1).astype(float))
    norms = size(centroids)
    order = np.argsort(norms, kind="stable")
    norms, own = norms[order], size(vectors)
    after = np.clip(np.searchsorted(norms, own), 0, len(norms) - 1)
    before = np.maximum(after - 1, 0)
    first = order[np.where(np.abs(norms[before] - own) <= np.abs(norms[after] - own), before, after)]
    number, best = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64)
    step = max(1, PAIRS // 8)
    for i in range(0, len(vectors), step):
        v, o = vectors[i : i + step], own[i : i + step]
        bound = np.sqrt(((v - centroids[first[i : i + step]]) ** 2).sum(axis=1).astype(float))
        bound += 1e-9 * (bound + o) + 1e-6  # more than the roots can be off
        low, high = np.searchsorted(norms, o - bound, "left"), np.searchsorted(norms, o + bound, "right")
        ends = np.cumsum(high - low)
        a = 0
        while a < len(v):  # slices of about PAIRS candidates
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            counts = (high - low)[a:b]
            heads = np.cumsum(counts) - counts
            member = np.repeat(np.arange(a, b), counts)
            which = order[np.arange(counts.sum()) - np.repeat(heads, counts) + np.repeat(low[a:b], counts)]
            d = ((v[member] - centroids[which]) ** 2).sum(axis=1)
            least = np.minimum.reduceat(d, heads)
            tied = np.where(d == np.repeat(least, counts), which, len(centroids))
            number[i + a : i + b], best[i + a : i + b] = np.minimum.reduceat(tied, heads), least
            a = b
    return number, best


def _numbers(batch: pa.RecordBatch, dim: int, scale: float) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("embedding"))
    return np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64).reshape(-1, dim)


def kept(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id, embedding of the vectors that can be clustered."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MAGNITUDE))
    return vectors.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & F.coalesce(usable, F.lit(False)))


def whole(embedding: Column, scale: float = SCALE) -> Column:
    return F.transform(embedding, lambda x: F.floor(scale * x.cast("double")).cast("long"))


def first_centroids(rows: DataFrame, k: int, seed: int, scale: float) -> np.ndarray:
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    top = rows.select(mark.alias("mark"), whole(F.col("embedding"), scale).alias("q")).orderBy(F.asc_nulls_last("mark"), "q").limit(k)
    return np.array([r["q"] for r in top.collect()], np.int64)


def summed(rows: DataFrame, centroids: np.ndarray, dim: int, scale: float) -> np.ndarray:
    """The centroids after a round: floor of the mean of each one's vectors; one without vectors stays."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(centroids), dim), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            q = _numbers(batch, dim, scale)
            if not len(q):
                continue
            number, _ = nearest(q, centroids)
            by = np.argsort(number, kind="stable")
            heads = np.flatnonzero(np.append(True, number[by][1:] != number[by][:-1]))
            total[number[by][heads]] += np.add.reduceat(q[by], heads, axis=0)
            count += np.bincount(number, minlength=len(centroids))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = rows.mapInArrow(partial, "cluster long, n long, total array<long>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = centroids.copy()
    for r in sums.collect():  # at most a row for each component of a centroid
        out[r["cluster"], r["at"]] = r["s"] // r["n"]
    return out


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that is kept."""
    if k * dim * 8 > MOST_BYTES:
        raise ValueError(f"{k} centroids of {dim} components do not fit into {MOST_BYTES} bytes")
    rows, spark = kept(vectors, dim), vectors.sparkSession
    centroids = first_centroids(rows, k, seed, scale)
    for _ in range(rounds if len(centroids) else 0):
        centroids = summed(rows, centroids, dim, scale)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _numbers(batch, dim, scale)
            number, distance = nearest(q, centroids) if len(q) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    placed = rewritten(rows.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "clusters")
    spread = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    about = [(n, fits(s), fits(sum(spread.values())), digest(centroids[n])) for n, s in spread.items()]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return placed.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS k, q AS c FROM v ORDER BY k LIMIT 16)",
    ]
    for n in range(ROUNDS + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (SELECT i, vec_id, q, arg_min(k, (d, k)) AS k, min(d) AS d FROM
  (SELECT *, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{n}) GROUP BY i, vec_id, q)"""
        )
        if n < ROUNDS:
            parts.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{n} LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM
  (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM a{n}) GROUP BY k, j) GROUP BY k) USING (k))"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(k AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (k)"""


OP12_SQL = _sql()
