"""Token ids of whole texts in Re-Pair compressed shards.

Texts are dealt by ranges of doc_id. A shard is a run of documents of at most
about ``SHARD_IDS`` ids; its ids are compressed by Re-Pair: in each round the
most frequent adjacent pairs become nonterminals, until no pair repays its rule. The table holds for each shard its rules (two
symbols for each nonterminal), the expansion length of each nonterminal, the
remaining sequence and the documents with the place of their first id, so
``decode`` reaches any id by one search in the expansion lengths and expands
only what it needs.

Defined results: a null or empty text is its end id alone; rows with equal or
null ids keep a place each (nulls first); an empty table writes no shard. The
text of a special token counts as that token, as the library has it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.storage import rewritten, small_batches
from barloom.llm.text import LOWER, chunks, mix, ordered, prefix, slice_hashes, spans

END, SHARD_IDS = 1, 1 << 20
NEW = 1 << 17  #: nonterminals begin here, above all ids of the vocabularies
#: A rule takes the room of three ids, so a pair repays it from four uses on.
REPAID, FALL, SLOT_BITS = 4, 16, 20
_FACTORS = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: Shards up to which their offsets are broadcast (24 bytes each); more are joined by shuffle.
BROADCAST_SHARDS = 500_000
SHARD_SCHEMA = "part int, shard int, doc_ids array<long>, n_tokens array<long>, rules binary, expansions binary, sequence binary"


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


#: Kinds of bytes: white space, letters, marks, digits, and those that a piece of plain bytes does not hold.
BLANK, LETTER, MARK, DIGIT, ODD = range(5)
KIND = np.full(256, ODD, np.uint8)
KIND[[32, *range(9, 14)]] = BLANK
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), 123, 125, 126]] = MARK
KIND[48:58] = DIGIT
_LATIN, _SALT = 0xC3, np.uint64(0xD6E8FEB86659FD93)


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each piece, whether it is an odd word, and for each text the pieces before it.

    A word of plain bytes (ASCII without control characters, apostrophe and bar; U+00C0 to U+00FF but for the two signs)
    falls into runs of letters, runs of marks and single digits, as the tokenizer splits it; letters are compared in lower
    case. Any other word is one piece of its own.
    """
    starts, ends, _ = spans(data, at)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(len(at), np.int64)
    kind, low = KIND[data], LOWER[data]
    lead = np.flatnonzero(data[:-1] == _LATIN)
    second = data[lead + 1]
    lead, second = lead[(second != 0x97) & (second != 0xB7)], second[(second != 0x97) & (second != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    low[lead[second < 0x9F] + 1] += 32
    word_odd = np.add.reduceat(kind == ODD, starts) > 0  # what follows a word up to the next is blank
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[word_odd]] += 1
    edge[ends[word_odd]] -= 1
    inside_odd = np.cumsum(edge[:-1], dtype=np.int8) > 0
    low[inside_odd] = data[inside_odd]
    first = np.zeros(len(data), bool)
    first[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) & ~inside_odd[1:] & (kind[1:] != BLANK)
    first[starts] = True
    begin = np.flatnonzero(first)
    stop = np.empty(len(begin), np.int64)
    stop[:-1] = begin[1:]
    stop[np.searchsorted(begin, starts[1:]) - 1] = ends[:-1]
    stop[-1] = ends[-1]
    odd = inside_odd[begin]
    hashes = slice_hashes(prefix(low), begin, stop)
    hashes[odd] = mix(hashes[odd] ^ _SALT)
    hashes[hashes == 0] = 1
    return begin, stop, hashes, odd, np.searchsorted(begin, at)


class Known:
    """Ids of pieces by 64-bit hash: an open-addressing table into one run of ids."""

    BITS = 22

    def __init__(self) -> None:
        n = 1 << self.BITS
        self.keys, self.start, self.size = np.zeros(n, np.uint64), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.ids, self.held, self.full = np.zeros(1 << 20, np.uint32), 0, 0

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each hash, and whether it holds it."""
        slot = self._slots(hashes)
        key = self.keys[slot]
        on = np.flatnonzero((key != hashes) & (key != 0))
        while len(on):
            slot[on] = (slot[on] + 1) & (len(self.keys) - 1)
            key[on] = self.keys[slot[on]]
            on = on[(key[on] != hashes[on]) & (key[on] != 0)]
        return slot, key == hashes

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct hashes that are not here yet, with their ids end to end."""
        while self.held + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        self.ids[self.held : self.held + len(ids)] = ids
        start = self.held + np.cumsum(sizes) - sizes
        todo, slot = np.arange(len(hashes)), self._slots(hashes)
        while len(todo):
            free = self.keys[slot[todo]] == 0
            self.keys[slot[todo[free]]] = hashes[todo[free]]  # of several in a slot one stays
            won = self.keys[slot[todo]] == hashes[todo]
            own = todo[won]
            self.start[slot[own]], self.size[slot[own]] = start[own], sizes[own]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
        self.held, self.full = self.held + len(ids), self.full + len(hashes)


class Encoder:
    """Ids of whole texts, remembered by piece: no rule of this vocabulary reaches over a piece's ends.

    Only the last id of a plain piece ends in ``</w>``, so new ones are encoded many to a text; odd words go in one by
    one. Pieces of more than ``LONG`` bytes are not remembered.
    """

    #: Pieces remembered; beyond that the memory starts anew.
    MOST, LONG, TOGETHER = 1_200_000, 256, 256

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = Known()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._ids(texts)
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def _together(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = self._ids([" ".join(plain[i : i + self.TOGETHER]) for i in range(0, len(plain), self.TOGETHER)])
        ids = np.array([i for x in joined for i in x], np.uint32)
        stops = np.flatnonzero(self.last[ids]) + 1
        if len(stops) != len(plain):
            raise ValueError("a piece of this vocabulary does not end in </w>")
        return ids, np.diff(stops, prepend=0)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts at data[at[i]:at[i + 1]] end to end, and where each text's begin (one more at the end)."""
        begin, stop, hashes, odd, before = pieces(data, at)
        if self.known.full > self.MOST:
            self.known = Known()
        long = stop - begin > self.LONG
        slot, there = self.known.find(hashes)
        new = np.flatnonzero(~there & ~long)
        if len(new):
            kinds, where = np.unique(hashes[new], return_index=True)
            where, raw = new[where], data.tobytes()
            for own, learn in ((~odd[where], self._together), (odd[where], self._alone)):
                if own.any():
                    texts = [raw[a:b].decode() for a, b in zip(begin[where[own]].tolist(), stop[where[own]].tolist(), strict=True)]
                    self.known.add(kinds[own], *learn(texts))
            slot[new] = self.known.find(hashes[new])[0]
        size, start, pool = self.known.size[slot].astype(np.int64), self.known.start[slot].astype(np.int64), self.known.ids
        if long.any():
            texts = [data[a:b].tobytes().decode() for a, b in zip(begin[long].tolist(), stop[long].tolist(), strict=True)]
            ids, sizes = self._alone(texts)
            size[long], start[long] = sizes, len(pool) + np.cumsum(sizes) - sizes
            pool = np.concatenate((pool, ids))
        ends = np.cumsum(size)
        ids = pool[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate(([0], ends))[before]


def with_ends(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with END behind each text."""
    return np.insert(ids, at[1:], END), at + np.arange(len(at))


def repair(ids: np.ndarray, least: int = REPAID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (n, 2), expansion length of each rule, and the sequence after replacement.

    Each round replaces the most frequent pairs, down to 1 / ``FALL`` of the first one's count; the last ones have no pair
    left that comes ``least`` times. Pairs are counted in hashed slots, and those of frequent slots one by one.
    """
    seq, rules, n_rules, fall = ids.astype(np.uint32), [], 0, FALL
    while len(seq) > 1:
        bits = min(SLOT_BITS, len(seq).bit_length())
        slot = seq[:-1] * _FACTORS[0]
        slot += seq[1:] * _FACTORS[1]
        slot >>= np.uint32(32 - bits)
        count = np.bincount(slot, minlength=1 << bits)
        limit = max(least, int(count.max()) // fall)
        some = np.flatnonzero((count >= limit).take(slot))
        wide = int(seq.max()).bit_length()
        order, pair = ordered((seq.take(some).astype(np.int64) << wide) | seq.take(some + 1))
        new = np.append(True, pair[1:] != pair[:-1])[: len(pair)]
        begin, which = np.flatnonzero(new), np.empty(len(pair), np.int64)
        which[order] = np.cumsum(new) - 1
        kinds, counts = pair[begin], np.diff(np.append(begin, len(pair)))
        often = (counts >= limit)[which]
        hit, which = some[often], which[often]
        # of overlapping hits every second one in a row is taken
        place = np.arange(len(hit))
        start = np.ones(len(hit), bool)
        start[1:] = np.diff(hit) != 1
        own = (place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0 if len(hit) else start
        hit, which = hit[own], which[own]
        repaid = np.bincount(which, minlength=len(kinds)) >= least
        hit, which = hit[repaid[which]], which[repaid[which]]
        if not len(hit):
            if limit == least:
                break
            fall *= FALL
            continue
        fall = FALL
        rules.append(np.stack([kinds[repaid] >> wide, kinds[repaid] & ((1 << wide) - 1)], axis=1))
        seq[hit] = (NEW + n_rules + np.cumsum(repaid) - 1).astype(np.uint32)[which]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq = seq[keep]
        n_rules += int(repaid.sum())
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    lengths, done = np.ones(len(table), np.int64), 0
    for part in rules:
        inner = np.maximum(part - NEW, 0)
        lengths[done : done + len(part)] = np.where(part >= NEW, lengths[inner], 1).sum(axis=1)
        done += len(part)
    return table.astype("<u4"), lengths.astype("<u4"), seq.astype("<u4")


def _unfolded(seq: np.ndarray, rules: np.ndarray) -> np.ndarray:
    while len(inner := np.flatnonzero(seq >= NEW)):
        size = np.ones(len(seq), np.int64)
        size[inner] = 2
        place = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int64)
        out[place] = seq
        pairs = rules[seq[inner] - NEW]
        out[place[inner]], out[place[inner] + 1] = pairs[:, 0], pairs[:, 1]
        seq = out
    return seq


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that a sequence of ids and nonterminals stands for; each nonterminal in it is unfolded once."""
    seq = seq.astype(np.int64)
    inner = seq >= NEW
    used = np.zeros(len(rules), bool)
    used[seq[inner] - NEW] = True
    used = np.flatnonzero(used)
    flat = _unfolded(used + NEW, rules.astype(np.int64))
    begin = np.zeros(len(rules), np.int64)
    begin[used] = np.cumsum(lengths[used], dtype=np.int64) - lengths[used]
    # terminals stand behind the unfolded rules
    pool = np.concatenate((flat, seq[~inner]))
    size, start = np.ones(len(seq), np.int64), np.empty(len(seq), np.int64)
    size[inner], start[inner] = lengths[seq[inner] - NEW], begin[seq[inner] - NEW]
    start[~inner] = len(flat) + np.arange(len(seq) - int(inner.sum()))
    ends = np.cumsum(size)
    return pool[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].astype("<u4")


def decode(seq: np.ndarray, rules: np.ndarray, expansions: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a shard; only symbols that reach into the range are expanded."""
    size = np.ones(len(seq), np.int64)
    inner = seq >= NEW
    size[inner] = expansions[seq[inner].astype(np.int64) - NEW]
    ends = np.cumsum(size)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skip = start - (ends[a] - size[a]) if a < len(seq) else 0
    return expand(seq[a:b], rules, expansions)[skip : skip + stop - start]


def _writer(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard, held = encoder_of(path), None, 0, 0
        docs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            rules, lengths, seq = repair(np.concatenate(parts))
            ids = pa.concat_arrays(docs).to_pylist()
            values = [[part], [shard], [ids], [np.concatenate(sizes)], [rules.tobytes()], [lengths.tobytes()], [seq.tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            names = ["part", "shard", "doc_ids", "n_tokens", "rules", "expansions", "sequence"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for rows, data, at in chunks(batches):
            part = rows.column(0)[0].as_py()
            ids, begin = with_ends(*encoder.encode(data, at))
            docs.append(rows.column(1))
            sizes.append(np.diff(begin))
            parts.append(ids)
            held += len(ids)
            if held >= SHARD_IDS:
                yield flush()
                shard, held = shard + 1, 0
                docs, sizes, parts = [], [], []
        if held:
            yield flush()

    return write


def token_shards(docs: DataFrame, path: str) -> DataFrame:
    """The shard table of ``docs``; part and shard ascend with doc_id. Rows of one id, or none, may lie in several parts."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("salt"))
    sorted_rows = rows.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt")
    return sorted_rows.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(_writer(path), SHARD_SCHEMA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "part", "shard", "place", "n_tokens", "ids_crc32"]
    for batch in batches:
        for row in batch.to_pylist():
            rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
            ids = expand(np.frombuffer(row["sequence"], "<u4"), rules, np.frombuffer(row["expansions"], "<u4"))
            ends = np.cumsum(row["n_tokens"])
            starts = ends - row["n_tokens"]
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(crc)
            values = [row["doc_ids"], [row["part"]] * n, [row["shard"]] * n, starts, row["n_tokens"], crc]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files.

    Ids before a shard: those of the parts before, one row for each task that wrote, and of its part's shards before.
    """
    total = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = shards.select("part", "shard", total.alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("whole"))
    own = sizes.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("own"))
    offsets = own.join(parts, "part").select("part", "shard", (F.col("own") + F.col("whole")).alias("offset"))
    few = shards.select(F.count(F.lit(1)).alias("n")).first()["n"] <= BROADCAST_SHARDS
    docs = shards.mapInArrow(_digests, "doc_id long, part int, shard int, place long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(offsets) if few else offsets, ["part", "shard"]).select(
        "doc_id", (F.col("offset") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(rewritten(token_shards(docs, default_tokenizer()), "tokens"))
