"""Spelling variants by wildcard and deletion groups, without pairs.

Words are the letter runs of the texts, some of them damaged by a hash of their document, that are long and frequent enough.
They are numbered by falling frequency, then code points, so of several words the one that spells best is the one with the
least number. A word of length L stands in L wildcard groups (position, what comes before, what comes after), whose members
differ in that position only, and names its distinct deletions, which meet the words of the vocabulary that they spell. A
group keeps its size and its two first members: every member's near words are the others, its best one is the first other
than itself. Groups and deletions share one shuffle, keyed by 128 bits of hash and holding a word's number, not its letters;
a word's sums over its groups are its number of near words and the best of them. No group has more members than the alphabet
has letters, times the places of the word for deletions, so none is hot.

Defined results: a null or empty text has no words; a null doc_id counts as empty text in the hash; rows that repeat an id
count each; a word of any length has its groups; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.storage import rewritten, small_batches
from barloom.llm.text import LOWER, chunks, mix

LETTERS = r"a-zÀ-ÿ"
#: Least length and frequency of a word, one of how many runs of a document is damaged, and how much more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, DAMAGED, TIMES = 6, 5, 199, 5
#: Words that a task counts before it hands them on.
HELD = 1 << 18
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
REPLACED, SPELT, DELETED = 2, 1, 0


def damaged(run: str, crc: int) -> str:
    """The run, without one code point if DAMAGED divides its crc."""
    if crc % DAMAGED:
        return run
    at = crc % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lower, runs = LOWER.tobytes(), re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")  # a shorter run spells no word
    out = lambda held: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
    held: dict[str, int] = {}
    for rows, data, at in chunks(batches):
        for i, doc in enumerate(rows.column(0).to_pylist()):
            text = data[at[i] : at[i + 1]].tobytes().translate(lower).decode("utf-8", "replace")
            seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for run, n in Counter(m.group() for m in runs.finditer(text)).items():
                word = damaged(run, zlib.crc32(run.encode(), seed))
                if len(word) >= LEAST_LENGTH:
                    held[word] = held.get(word, 0) + n
            if len(held) >= HELD:
                yield out(held)
                held = {}
    yield out(held)


def vocabulary(docs: DataFrame) -> DataFrame:
    """id, word, n: the words, with ids that rise as frequency falls and, among equals, with code points."""
    small_batches(docs.sparkSession)
    counted = docs.select("doc_id", "text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    # written once, since the ids depend on how the sort was dealt out
    return rewritten(counted.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b (the key of a group), role, id for every group in which a word stands."""
    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        begin = 0
        while begin < len(words):
            end, room = begin, 0
            while end < len(words) and (end == begin or room + len(words[end]) <= 1 << 18):
                room += len(words[end])
                end += 1
            yield _grouped(ids[begin:end], words[begin:end])
            begin = end


def _grouped(ids: np.ndarray, words: list[str]) -> pa.RecordBatch:
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - starts[word]
    same = np.zeros(len(points), bool)
    same[1:] = (points[1:] == points[:-1]) & (place[1:] > 0)
    gone = ~same & (sizes[word] > LEAST_LENGTH)  # two equal neighbours have one deletion
    keys = []
    with np.errstate(over="ignore"):
        slot, kind = mix((place.astype(np.uint64) << np.uint64(32)) | sizes[word].astype(np.uint64)), mix(~sizes.astype(np.uint64))
        shorter = mix(~(sizes[word] - 1).astype(np.uint64))
        for base in _BASES:
            powers = np.full(int(sizes.max(initial=0)) + 1, base)
            powers[0] = 1
            powers = np.multiply.accumulate(powers)
            term = mix(points) * powers[place]
            before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)))
            whole = before[starts + sizes] - before[starts]
            i = np.arange(len(points))
            left, right = before[i] - before[starts[word]], before[(starts + sizes)[word]] - before[i + 1]
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            keys.append(np.concatenate((mix((whole[word] - term) ^ slot), mix(whole ^ kind), mix((left + right * inverse) ^ shorter)[gone])).view(np.int64))
    roles = np.repeat(np.array([REPLACED, SPELT, DELETED], np.int8), [len(points), len(words), int(gone.sum())])
    who = np.concatenate((ids[word], ids, ids[word][gone]))
    return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(roles), pa.array(who)], ["a", "b", "role", "id"])


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near, best (the near word with the least id) of the words that have one."""
    small_batches(words.sparkSession)
    rows = words.select("id", "word").mapInArrow(_keys, "a long, b long, role byte, id long")
    group = Window.partitionBy("a", "b").orderBy("role", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    role = F.col("role")
    held = rows.select(
        "id", "role", F.count(F.lit(1)).over(group).alias("size"), F.first("id").over(group).alias("first"), F.nth_value("id", 2).over(group).alias("second"),
        F.first(F.when(role == SPELT, F.col("id")), True).over(group).alias("spelt"), F.first(F.when(role == DELETED, F.col("id")), True).over(group).alias("longer"),
    )
    other = F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    found = held.filter("size > 1").select(
        "id",
        F.when(role == REPLACED, F.col("size") - 1).when(role == SPELT, F.col("size") - 1).otherwise(F.col("spelt").isNotNull().cast("long")).alias("near"),
        F.when(role == REPLACED, other).when(role == SPELT, F.col("longer")).otherwise(F.col("spelt")).alias("best"),
    )
    return found.filter("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = vocabulary(docs)
    near = words.join(near_words(words), "id", "left")
    best = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    linked = near.join(best, "best", "left")
    taken = F.col("form_n") >= TIMES * F.col("n")
    linked = rewritten(linked.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *(F.when(taken, F.col(c)).alias(c) for c in ("best", "form", "form_n"))), "variants")
    # every step multiplies the frequency by TIMES, which bounds the steps; jumps double
    most = linked.agg(F.max("n").alias("n")).first()["n"] or LEAST_COUNT
    steps = max(1, int(math.log(max(1, most / LEAST_COUNT), TIMES) + 1e-9))
    ends = linked.filter("best IS NOT NULL").select("id", F.col("best").alias("end"))
    for k in range(math.ceil(math.log2(steps))):
        ends = rewritten(ends.join(ends.select(F.col("id").alias("end"), F.col("end").alias("_next")), "end", "left").select("id", F.coalesce("_next", "end").alias("end")), f"roots{k}")
    roots = ends.join(words.select(F.col("id").alias("end"), F.col("word").alias("root")), "end").select("id", "root")
    return linked.join(roots, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _crc_table() -> str:
    step = "CAST(i AS BIGINT)"
    source = f"(SELECT i, {step} AS c FROM range(256) r(i))"
    for _ in range(8):
        source = f"(SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END AS c FROM {source})"
    return f"(SELECT list(c ORDER BY i) AS t FROM {source})"


OP11_SQL = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
d AS (SELECT doc_id, r, count(*) AS k FROM runs WHERE length(r) >= 6 GROUP BY 1, 2),
u AS (SELECT r, k, list_transform(string_split(doc_id || ':', ''), lambda x: CAST(unicode(x) AS BIGINT)) ||
  flatten(list_transform(string_split(r, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195::BIGINT, CAST(unicode(x) - 64 AS BIGINT)] END)) AS bytes FROM d),
h AS (SELECT r, k, xor(4294967295, list_reduce(bytes, lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8), 4294967295::BIGINT)) AS h FROM u, {_crc_table()} crc),
w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM h) GROUP BY 1
  HAVING length(word) >= 6 AND sum(k) >= 5),
g AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) AS p, substr(word, i + 1) AS s FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS o, b.n AS m FROM g a JOIN g b USING (i, p, s) WHERE a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM g JOIN w ON w.word = p || s UNION SELECT w.word, g.word, g.n FROM g JOIN w ON w.word = p || s),
best AS (SELECT word, count(*) AS n_near, arg_min(o, (-m, o)) AS o, max(m) AS m FROM near GROUP BY word),
f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN o END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk USING (word) JOIN f e ON e.word = walk.at WHERE e.form IS NULL
"""
