"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should appear ``target / source_size`` times. The
whole part is taken; the fractional parts are rounded in pairs: mass in words
moves at random between two documents until one of them is 0 or 1, so the words
of the pair stay as they were and each document's expectation too. A reduction
tree does this: documents of a source lie in chunks of about ``FAN``, each chunk
leaves at most one fractional document, and those meet in the next level. The
last one of a source is rounded at random, so a source misses its target by at
most one document.

Defined results: a null source is a source of its own, ranked last; a document
without words takes nothing; repeated rows are separate documents with one draw
each; empty input gives no rows. Draws hash the ids, texts, SEED and a number that tells
equal rows apart: reruns agree, and no id, null or repeated, fills a chunk by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.native import let, n_words, own_columns, unused
from barloom.llm.storage import rewritten

SHARE, WEIGHTS, MOST, SEED = 1.5, (5, 2, 1), 2.0, 20240229
#: Documents to a chunk; the tree has as many levels as the largest source needs to end in one document.
FAN = 128
_EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n (documents with words), target: words by weight, none above ``most`` times the source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = per.withColumn("w", F.get(F.array(*map(F.lit, weights)), nth).cast("double")).withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("rest_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.col("rest_w"))
        .withColumn("full", F.col("ratio") <= F.col("level"))
    )
    water = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("ratio"))).over(everything)
    return levels.select("source", "source_size", "n", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * water).alias("target"))


def _uniform(*of: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *of), 11).cast("double") + 0.5) / float(1 << 53)


def _pair(acc: Column, x: Column) -> Column:
    """One pivotal step between the carried unit and the next one."""
    ratio = x["size"] / acc["c"]["size"]
    up, down = F.least(1 - acc["c"]["p"], x["p"] * ratio), F.least(acc["c"]["p"], (1 - x["p"]) * ratio)
    snap = lambda v: F.when(v <= _EPS, F.lit(0.0)).when(v >= 1 - _EPS, F.lit(1.0)).otherwise(v)

    def moved(m: Column) -> Column:
        step = F.when(_uniform(acc["c"]["k"], x["k"]) * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"])
        return let(
            step,
            lambda d: F.struct(
                acc["c"].withField("p", snap(acc["c"]["p"] + d)).alias("a"),
                x.withField("p", snap(x["p"] - d / ratio)).alias("b"),
            ),
        )

    whole = lambda u: (u["p"] == 0) | (u["p"] == 1)
    none = F.when(F.lit(False), x)
    result = let(
        let(F.struct(up.alias("up"), down.alias("down")), moved),
        lambda r: F.when(
            whole(r["a"]) & whole(r["b"]), F.struct(none.alias("c"), F.concat(acc["out"], F.array(r["a"], r["b"])).alias("out"))
        )
        .when(whole(r["a"]), F.struct(r["b"].alias("c"), F.concat(acc["out"], F.array(r["a"])).alias("out")))
        .otherwise(F.struct(r["a"].alias("c"), F.concat(acc["out"], F.array(r["b"])).alias("out"))),
    )
    return F.when(acc["c"].isNull(), F.struct(x.alias("c"), acc["out"].alias("out"))).otherwise(result)


def _numbered(sizes: DataFrame) -> DataFrame:
    """The rows with k, a hash of h and of the number of the row among those of its h, from partition counts and offsets."""
    sizes = sizes.withColumn("part", F.shiftright("_row", 33))
    counts = sizes.groupBy("h", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("h", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("h", "part").orderBy("_row"))
    numbered = sizes.withColumn("nth", nth).join(offsets, ["h", "part"])
    return numbered.withColumn("k", F.xxhash64(F.lit(SEED), "h", F.col("nth") + F.col("offset"))).drop("h", "part", "nth", "offset")


def _sizes(docs: DataFrame, row: Column, seed_columns: tuple[str, ...]) -> DataFrame:
    own = F.xxhash64(F.lit(SEED), *seed_columns, F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), own.alias("h"), row.alias("_row"))


def copies(docs: DataFrame, seed_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (long) for each row of ``docs``."""
    return _drawn(rewritten(_sizes(docs, F.monotonically_increasing_id(), seed_columns), "sizes")).drop("_row")


def _drawn(sizes: DataFrame) -> DataFrame:
    sizes = rewritten(_numbered(sizes), "numbered")
    plan = rewritten(targets(sizes).withColumnRenamed("source", "_s"), "targets")
    rows = sizes.join(plan, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(wanted + _EPS).cast("double")
    part = F.when((F.col("size") > 0) & (wanted - whole > _EPS), wanted - whole).otherwise(F.lit(0.0))
    unit = F.struct(
        "k", "doc_id", "source", F.col("size").cast("double").alias("size"), part.alias("p"), whole.alias("whole"), "source_size", "target", "_row"
    )
    chunks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / F.lit(FAN)).cast("long"))
    units = rows.select(unit.alias("u"), F.pmod(F.shiftrightunsigned("k", 3), chunks).alias("chunk"))
    done = [units.filter("u.p = 0").select("u")]
    todo = units.filter("u.p > 0")
    left = -(-(plan.agg(F.max("n")).first()[0] or 1) // FAN)  # chunks of the largest source
    while left:
        gathered = todo.groupBy(F.col("u.source").alias("s"), "chunk").agg(F.array_sort(F.collect_list("u")).alias("us"))
        first = F.get("us", F.lit(0))
        start = F.struct(F.when(F.lit(False), first).alias("c"), F.filter("us", lambda _: F.lit(False)).alias("out"))
        folded = rewritten(gathered.select("chunk", F.aggregate("us", start, _pair).alias("f")), "folded")
        done.append(folded.select(F.explode("f.out").alias("u")))
        todo = folded.filter("f.c IS NOT NULL").select(F.col("f.c").alias("u"), F.floor(F.col("chunk") / FAN).cast("long").alias("chunk"))
        left = -(-left // FAN) if left > 1 else 0
    last = F.when(_uniform(F.col("u.k"), F.lit(-1)) < F.col("u.p"), F.lit(1.0)).otherwise(F.lit(0.0))
    done.append(todo.select(F.col("u").withField("p", last).alias("u")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        "u.doc_id", "u.source", F.col("u.size").cast("long").alias("size"), "u.source_size", "u.target",
        (F.col("u.whole") + F.col("u.p")).cast("long").alias("copies"), "u._row",
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    row, again = unused(docs, "row"), unused(docs, "again")
    rows = rewritten(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    drawn = _drawn(_sizes(rows, F.col(row), ("doc_id",))).filter("copies > 0")
    drawn = drawn.select(F.col("_row").alias(row), F.array_repeat(F.lit(1), F.col("copies").cast("int")).alias(again))
    return rows.join(drawn, row).select(*own_columns(docs), F.explode(again).alias(again)).select(*own_columns(docs))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
