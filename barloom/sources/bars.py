"""Bar tables: asset, ts, bar_idx, open, high, low, close, volume; partition key asset, order key ts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.sources import stored


def by_bar():
    """Window of an asset's bars in order."""
    return Window.partitionBy("asset").orderBy("ts")


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("bar_idx", F.row_number().over(by_bar()).cast("long") - 1)


def grouped_bars(rows: DataFrame, asset: Column, ts: Column, price: Column, first: Column) -> DataFrame:
    """OHLC of ``price`` by (asset, ts); ``first`` orders prints in a bar. All five aggregates combine before the shuffle."""
    price = price.cast("double")
    return numbered(
        rows.groupBy(asset.alias("asset"), ts.alias("ts")).agg(
            F.min_by(price, first).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, first).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals by priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return grouped_bars(o, F.col("o_orderpriority"), F.col("o_orderdate").cast("date"), F.col("o_totalprice"), F.col("o_orderkey"))


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Clock bars of event values by type; ties of ts go by event_id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return grouped_bars(e, F.col("event_type"), F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz"), F.col("value"), F.struct("ts", "event_id"))


def placed(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows with ``nth``, their place (from 0) among those of their key in the order, which must tell all rows apart.

    Rows are sorted over all tasks and counted by task, so no task holds a key: a place is one among the task's rows of the
    key, and what tasks before it hold of it.
    """
    spread = stored.kept(rows.orderBy(key, *order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = spread.groupBy(key, part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(key, "_p", (before - F.col("_first")).alias("_offset"))  # a row a task and key
    return spread.withColumn("_p", part).join(offsets, [key, "_p"]).withColumn("nth", F.col("_m") + F.col("_offset")).drop("_m", "_p", "_offset")


def activity_bars(spark: SparkSession, sf_dir: str, size: int = 50) -> DataFrame:
    """Bars of ``size`` events each: asset, bucket, first_ts, last_ts, OHLC, volume."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("asset"), "ts", "event_id", F.col("value").cast("double").alias("v"))
    put = placed(e, "asset", "ts", "event_id").withColumn("bucket", F.floor(F.col("nth") / size).cast("long"))
    key = F.struct("ts", "event_id")
    return put.groupBy("asset", "bucket").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("v", key).alias("open"), F.max("v").alias("high"), F.min("v").alias("low"),
        F.max_by("v", key).alias("close"), F.count(F.lit(1)).alias("volume"),
    )


def ship_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily high, low, volume-weighted price and volume of line items by return flag."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    unit = F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")
    return li.groupBy(F.col("l_returnflag").alias("asset"), F.col("l_shipdate").cast("date").alias("ts")).agg(
        F.max(unit).alias("high"), F.min(unit).alias("low"),
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.lit(100.0) / F.sum(F.col("l_quantity").cast("double"))).alias("vwap"),
        F.sum(F.col("l_quantity").cast("double")).alias("volume"),
    )


#: Words of a roll flag.
ROLL_WORDS = {"true": 1.0, "yes": 1.0, "y": 1.0, "t": 1.0, "false": 0.0, "no": 0.0, "n": 0.0, "f": 0.0, "": 0.0, "nan": 0.0, "none": 0.0}
STAMPS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
)


def roll_flag(c: Column) -> Column:
    """1 for a roll, 0 for none; a value that is neither number nor word of a flag raises."""
    word = F.lower(F.trim(c))
    number = word.try_cast("double")
    words = F.create_map(*(F.lit(x) for kv in ROLL_WORDS.items() for x in kv))
    told = F.when(number.isNotNull() & ~F.isnan(number), (number != 0).cast("double")).otherwise(F.try_element_at(words, word))
    return F.when(c.isNull(), F.lit(0.0)).otherwise(F.coalesce(told, F.raise_error(F.concat(F.lit("not a roll flag: "), c)).cast("double")))


def day_first(stamps: DataFrame) -> bool | None:
    """Whether the numeric dates of a column (stamp, line) put the day first; None where they are no such dates.

    A first field above 12 decides, or a second one; else the reading whose stamps run in order over half the time or
    less; else the month is first. Four aggregates of the column go to the driver, no rows.
    """
    fields = r"^\s*(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})(?:\D|$)"
    part = lambda k: F.regexp_extract("stamp", fields, k)
    rows = stamps.filter("stamp IS NOT NULL").select("line", part(1).try_cast("int").alias("a"), part(2).try_cast("int").alias("b"), part(3).try_cast("int").alias("y"), F.regexp_extract("stamp", r"\D(\d{1,2}:\d{2})", 1).alias("t"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("dates"), F.max("a").alias("a"), F.max("b").alias("b")).first()
    if not seen["n"] or seen["dates"] < seen["n"]:
        return None
    if seen["a"] > 12 or seen["b"] > 12:
        return seen["a"] > 12 and not seen["b"] > 12
    spans = {}
    for first in (True, False):
        d, m = ("a", "b") if first else ("b", "a")
        year = F.when(F.col("y") < 100, F.col("y") + 2000).otherwise(F.col("y"))
        key = year * 10_000 + F.col(m) * 100 + F.col(d)
        day = F.datediff(F.try_to_date(F.lpad(key.cast("string"), 8, "0"), "yyyyMMdd"), F.lit("1970-01-01")) + F.when(F.col("t") != "", F.split("t", ":")[0].try_cast("int") / 24 + F.split("t", ":")[1].try_cast("int") / 1440).otherwise(0.0)
        step = day - F.lag(day).over(Window.orderBy("line"))
        got = rows.select(day.alias("day"), step.alias("step")).agg(F.min("step").alias("low"), F.max("step").alias("high"), (F.max("day") - F.min("day")).alias("span"), F.count("day").alias("n")).first()
        if got["n"] == seen["n"] and (got["low"] is None or got["low"] >= 0 or got["high"] <= 0):
            spans[first] = got["span"]
    if len(spans) == 1:
        return next(iter(spans))
    return len(spans) == 2 and spans[True] * 2 <= spans[False]


def checked(bars: DataFrame, least: int = 0, point_value: float = 1.0, margin: float = 0.0, cost_bps: float = 0.0, roll_cost: float = 0.0) -> DataFrame:
    """The bars, if they suit the instrument; else a ValueError that says why. One aggregate goes to the driver."""
    if not point_value > 0:
        raise ValueError(f"point_value must be positive, got {point_value}")
    if roll_cost > 0 and "roll" not in bars.columns:
        raise ValueError("a roll cost needs bars with a roll column")
    told = bars.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.min(F.least("open", "high", "low", "close")).alias("low")).agg(F.min("n").alias("n"), F.min("low").alias("low")).first()
    if (told["n"] or 0) < least:
        raise ValueError(f"{told['n'] or 0} bars, {least} are needed")
    if told["low"] is not None and told["low"] <= 0:
        if not margin > 0:
            raise ValueError("a price at or below zero needs a margin")
        if cost_bps > 0:
            raise ValueError("a price at or below zero has no notional for a cost in basis points")
    return bars


def intraday(bars: DataFrame) -> DataFrame:
    """asset, intraday: whether the usual step between stamps is under a day."""
    step = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(by_bar())
    return bars.select("asset", step.alias("s")).filter("s > 0").groupBy("asset").agg((F.median("s") < 86_400_000_000).alias("intraday"))


def cleaned(raw: DataFrame, first_day: bool | None = None) -> DataFrame:
    """Bars of a text table (asset, stamp, open, high, low, close, volume): parsed, priced, the last print of each stamp.

    A stamp is ISO, with or without time, fraction and offset (read as UTC), or a numeric date whose order ``first_day`` says;
    rows with an unreadable stamp or price are dropped, a missing volume stays null. A roll column is flags; a roll on a
    dropped row moves to the last kept bar before it.
    """
    number = lambda c: F.when(~F.isnan(x := F.col(c).try_cast("double")), x)
    text = F.trim("stamp")
    formats = STAMPS
    if first_day is not None:
        order = "d.M" if first_day else "M.d"
        text = F.when(text.rlike(r"^\d{1,2}[./-]"), F.regexp_replace(text, r"^(\d{1,2})[./-](\d{1,2})[./-]", "$1.$2.")).otherwise(text)
        formats += tuple(f"{order}.{y}{t}" for y in ("yyyy", "yy") for t in ("", " HH:mm", " HH:mm:ss"))
    stamp = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))
    flags = [roll_flag(F.col("roll")).alias("roll")] if "roll" in raw.columns else []
    rows = raw.select("asset", stamp.cast("timestamp_ntz").alias("ts"), *(number(c).alias(c) for c in ("open", "high", "low", "close", "volume")), *flags, "line").filter("ts IS NOT NULL")
    priced = F.expr("open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND NOT (open = 0 AND high = 0 AND low = 0 AND close = 0)")
    rolls = None
    if flags:
        stamps = rows.groupBy("asset", "ts").agg(F.max("roll").alias("roll"), F.max(priced).alias("kept"))
        onto = F.last(F.when(F.col("kept"), F.col("ts")), ignorenulls=True).over(by_bar().rowsBetween(Window.unboundedPreceding, 0))
        rolls = stamps.select("asset", onto.alias("ts"), "roll").filter("ts IS NOT NULL").groupBy("asset", "ts").agg(F.sum("roll").alias("roll"))
        rows = rows.drop("roll")
    last = F.row_number().over(Window.partitionBy("asset", "ts").orderBy(F.desc("line")))
    out = rows.filter(priced).withColumn("_n", last).filter("_n = 1").drop("_n", "line")
    return numbered(out if rolls is None else out.join(rolls, ["asset", "ts"], "left").withColumn("roll", F.coalesce("roll", F.lit(0.0))))


def csv_bars(spark: SparkSession, path: str, asset: str) -> DataFrame:
    """Bars of a CSV file with a header; its first column is the stamp, names match in any case."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.lower(): c for c in raw.columns}
    pick = [F.col(f"`{names[k]}`").alias(k) if k in names else F.lit(None).cast("string").alias(k) for k in ("open", "high", "low", "close", "volume")]
    pick += [F.col(f"`{names['roll']}`").alias("roll")] if "roll" in names else []
    rows = raw.select(F.lit(asset).alias("asset"), F.col(f"`{raw.columns[0]}`").alias("stamp"), *pick, F.monotonically_increasing_id().alias("line"))
    return cleaned(rows, day_first(rows))


def shared_bars(bars: DataFrame) -> DataFrame:
    """The bars at stamps that every asset has."""
    n = bars.select("asset").distinct().agg(F.count(F.lit(1)).alias("_n"))
    common = bars.groupBy("ts").agg(F.count_distinct("asset").alias("_c")).join(F.broadcast(n), F.col("_c") == F.col("_n")).select("ts")
    return bars.join(common, "ts", "left_semi")


def restated(bars: DataFrame, currencies: DataFrame, rates: DataFrame, home: str = "USD", each_bar: bool = False) -> DataFrame:
    """The bars in units of ``home``: prices of an asset times what one unit of its currency is worth.

    currencies: asset, currency, a row an asset; an asset without one is in ``home``. rates: currency, ts, close. A series is
    restated at the currency's last rate, so its returns stay its own, or with ``each_bar`` at the last rate up to each bar.
    A currency without any rate is an error, and so is a bar before the first one.
    """
    known = currencies.filter(F.col("currency") != home)
    missing = [r["currency"] for r in known.join(rates, "currency", "left_anti").select("currency").distinct().collect()]  # currencies, not assets
    if missing:
        raise ValueError(f"no rate for {', '.join(sorted(missing))}")
    columns, prices = bars.columns, ("open", "high", "low", "close")
    rows = bars.join(F.broadcast(known.select("asset", F.col("currency").alias("_cur"))), "asset", "left")
    if not each_bar:
        last = rates.groupBy(F.col("currency").alias("_cur")).agg(F.max_by("close", "ts").alias("_rate"))
        rows = rows.join(F.broadcast(last), "_cur", "left")  # a row a currency
    else:
        stamp = lambda c: F.col(c).cast("timestamp_ntz")
        kept = F.struct(*columns)
        both = rows.filter("_cur IS NOT NULL").select("_cur", stamp("ts").alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast("double").alias("_r"), kept.alias("_row"))
        both = both.unionByName(rates.select(F.col("currency").alias("_cur"), stamp("ts").alias("_t"), F.lit(0).alias("_k"), F.col("close").cast("double").alias("_r")), allowMissingColumns=True)
        upto = Window.partitionBy("_cur").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
        met = both.withColumn("_rate", F.last("_r", ignorenulls=True).over(upto)).filter("_k = 1")
        early = F.raise_error(F.concat(F.lit("no rate yet for "), F.col("_cur"), F.lit(" on "), F.col("_t").cast("string"))).cast("double")
        met = met.select("_row.*", F.coalesce("_rate", early).alias("_rate"))
        rows = met.unionByName(rows.filter("_cur IS NULL").select(*columns, F.lit(1.0).alias("_rate")))
    rate = F.coalesce("_rate", F.lit(1.0))
    return rows.select(*((F.col(c) * rate).alias(c) if c in prices else F.col(c) for c in columns))
