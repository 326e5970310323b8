"""Language-model scores by causal self-attention in numpy on subword ids.

Vocabulary statistics come from all training documents: counts of words (for the
unigram base score), counts of subword ids, and sums of random projections of what stands
before, after and around each id. By these sums, ids with like neighbours share one of
``CLASSES`` classes, which lie in groups of ``GROUP``; the network predicts the group of the
next id and its class within the group, an id within its class has its smoothed relative
frequency, so the product is a probability over the whole vocabulary. The attention weights are fitted to all windows of all training
documents, the last one of a text padded: in each of ``ROUNDS`` rounds every task trains
on the windows of its next texts from the weights so far, and the results are averaged by
windows. Small inputs are passed over more than once, at most ``EPOCHS`` times, and by
fewer tasks (``TASK_WINDOWS`` each at least). The sums are of whole numbers, so the order
of tasks changes nothing; which windows meet in a task follows from the files.
Scoring reads every text whole: windows of ``WINDOW``
ids overlap by ``CONTEXT``, so each id is scored once, with earlier ids to attend
to, and windows of many texts share batched masked products.

The base score needs the corpus count of each token. The most frequent ones, at most ``HOT``,
travel with the tasks; the rest are joined by hash.

Defined results: a null or empty text is its end token alone; a null doc_id is
hashed as the empty text and is scored; repeated ids are scored row by row; if no
document is for training all counts are 0. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.storage import rewritten, small_batches
from barloom.llm.text import LOWER, chunks, mix, spans, word_hashes
from barloom.llm.token_output import Known, default_tokenizer, encoder_of, with_ends

HOT = 1 << 16
VOCABULARY, OWN_ROWS, CLASSES, GROUP, DIM = 49_408, 4_096, 96, 8, 16
WINDOW, CONTEXT = 24, 8
#: Windows to a product: what stands between fits a core's cache.
BATCH = 384
#: Passes over a small input, and windows that all passes show at least where so many passes allow it; more input is passed once.
EPOCHS, LEAST_WINDOWS = 6, 1 << 17
#: Averaged parts of a pass, windows that make a task, and windows ordered and held at once by one.
ROUNDS, TASK_WINDOWS, BLOCK = 4, 1 << 15, 1 << 14
SEED, SIDE = 7, 24
FIXED = float(1 << 24)  #: weights are averaged as whole multiples of 1 / FIXED
AT_ONCE = 1 << 16  #: ids scored at once; a longer text is scored by itself
END_TOKEN = 0x454E44  #: stands for the end token among word hashes
PACK = 1 << 20
#: A score of what may not be seen or does not occur, and of the later places of a window.
CLOSED = -1e9
MOST = 80.0  #: scores are kept within, so that their exponentials are finite and not 0
CAUSAL = np.triu(np.full((WINDOW, WINDOW), CLOSED - MOST, np.float32), 1) + np.float32(MOST)
STEP = 256  #: windows to a step of descent
#: Short rows are summed as products: with ones, and those of a state's scores by groups and own classes.
ONES = np.ones(DIM + 1, np.float32)
PARTS = np.repeat(np.eye(2, dtype=np.float32), (CLASSES // GROUP, GROUP), axis=0)


def _held_out(ids: list[int | None]) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in ids], bool)


def _tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and end tokens of all texts in order, and the text of each."""
    low = LOWER[data]
    starts, ends, before = spans(low, at)
    n = np.diff(before)
    hashes = np.insert(word_hashes(low, starts, ends).view(np.int64), before[1:], END_TOKEN)
    return hashes, np.repeat(np.arange(len(n)), n + 1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, total = [], 0

    def flush() -> pa.RecordBatch:
        kinds, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n.astype(np.int64))], ["word", "n"])

    for rows, data, at in chunks(batches):
        hashes, doc = _tokens(data, at)
        held.append(hashes[~_held_out(rows.column(0).to_pylist())[doc]])
        total += len(hashes)
        if total >= 8 * PACK:
            yield flush()
            held, total = [], 0
    if held:
        yield flush()


def _encoded(path: str):
    """The rows with the ids of their text, end id included, as little-endian unsigned 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for rows, data, at in chunks(batches):
            ids, begin = with_ends(*encoder.encode(data, at))
            blobs = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((begin * 2).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([*rows.columns, blobs], ["doc_id", "text", "row", "ids"])

    return run


def _signs() -> np.ndarray:
    """Projection of each id, of 1 and -1: sums of them are exact."""
    return np.random.default_rng(SEED).integers(0, 2, (VOCABULARY, SIDE)) * 2 - 1


def _begins(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each distinct key begins."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)


def _counted(high: np.ndarray, low: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers below ``most`` and ids, in order, and how often each comes."""
    kind = np.uint32 if most * VOCABULARY < 1 << 32 else np.int64
    pair, n = np.unique(high.astype(kind) * kind(VOCABULARY) + low.astype(kind), return_counts=True)
    return (pair // kind(VOCABULARY)).astype(np.int64), (pair % kind(VOCABULARY)).astype(np.int64), n


def _sums(parts: np.ndarray, of: np.ndarray, to: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """For each row of ``parts`` the sums, by ``to``, of its numbers at ``of`` times n."""
    out = np.zeros((len(parts), size), np.int64)
    for part, sums in zip(parts, out, strict=True):
        np.add.at(sums, to, part.take(of) * n)
    return out


def _sign_sums(signs: np.ndarray, of: np.ndarray, to: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Sums of the signs at ``of`` times n, by ``to``: positive ones are counted, as many signs to a number as surely stay apart."""
    bits = max(1, int(n.sum()).bit_length())
    lanes = 63 // bits
    places = np.arange(lanes) * bits
    plus = np.zeros((len(signs), -(-SIDE // lanes) * lanes), np.int64)
    plus[:, :SIDE] = signs > 0
    parts = (plus.reshape(len(signs), -1, lanes) << places).sum(axis=2)
    counted = _sums(np.ascontiguousarray(parts.T), of, to, n, size)
    each = ((counted[:, None] >> places[:, None]) & ((1 << bits) - 1)).reshape(-1, size)[:SIDE]
    return (2 * each - _sums(np.ones((1, len(signs)), np.int64), of, to, n, size)).T


def neighbours(ids: np.ndarray, at: np.ndarray, near: np.ndarray, signs: np.ndarray) -> None:
    """Add to near (ids, 3 * SIDE) the projections of what stands before, after and around each id of the texts."""
    inside = np.ones(max(0, len(ids) - 1), bool)
    inside[(edge := at[1:-1])[(edge > 0) & (edge < len(ids))] - 1] = False
    a, b, n = _counted(ids[:-1][inside], ids[1:][inside], VOCABULARY)
    near[:, SIDE : 2 * SIDE] += _sign_sums(signs, b, a, n, len(near))
    near[:, :SIDE] += _sign_sums(signs, a, b, n, len(near))
    text, own, n = _counted(np.repeat(np.arange(len(at) - 1), np.diff(at)), ids, len(at))
    sums = _sign_sums(signs, own, text, n, len(at) - 1)
    mean = np.rint(sums * (65536 / np.maximum(1, np.diff(at)))[:, None]).astype(np.int64)
    near[:, 2 * SIDE :] += _sums(np.ascontiguousarray(mean.T), text, own, n, len(near)).T


def _training(batches: Iterator[pa.RecordBatch], size: int = PACK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of about ``size`` or more at once of the training rows of (doc_id, ids), and their offsets."""
    held, total = [], 0
    for batch in batches:
        out = _held_out(batch.column("doc_id").to_pylist())
        for blob, hidden in zip(batch.column("ids").to_pylist(), out.tolist(), strict=True):
            if hidden:
                continue
            held.append(np.frombuffer(blob, "<u2"))
            total += len(held[-1])
            if total >= size:
                yield np.concatenate(held).astype(np.int64), np.concatenate(([0], np.cumsum([len(x) for x in held])))
                held, total = [], 0
    if held:
        yield np.concatenate(held).astype(np.int64), np.concatenate(([0], np.cumsum([len(x) for x in held])))


NEAR = [f"s{k}" for k in range(3 * SIDE)]


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and neighbour sums of each id; the id -1 has the number of windows."""
    total, near, signs, windows = np.zeros(VOCABULARY, np.int64), np.zeros((VOCABULARY, 3 * SIDE), np.int64), _signs(), 0
    for ids, at in _training(batches):
        total += np.bincount(ids, minlength=VOCABULARY)
        neighbours(ids, at, near, signs)
        windows += int((-(-np.diff(at) // WINDOW)).sum())
    some = np.flatnonzero(total)
    n = pa.array(np.append(total[some], windows))
    sums = [pa.array(np.append(near[some, k], 0)) for k in range(3 * SIDE)]
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), n, *sums], ["id", "n", *NEAR])


class Model:
    """One causal attention layer with a residual over embeddings of ids and places."""

    def __init__(self, counts: np.ndarray, texts: list[np.ndarray], near: np.ndarray | None = None):
        """Counts of all ids and their neighbour sums; where these are not given, those of ``texts``."""
        mass = counts + 1.0
        order = np.argsort(-mass, kind="stable")
        if near is None:
            near, signs = np.zeros((len(mass), 3 * SIDE), np.int64), _signs()
            for ids in texts:
                neighbours(ids, np.array([0, len(ids)]), near, signs)
        self.label = self._classes(mass, order, near)
        within = np.bincount(self.label, weights=mass, minlength=CLASSES)
        self.log_within = np.log(mass / within[self.label]).astype(np.float32)
        self.row = OWN_ROWS + self.label
        self.row[order[:OWN_ROWS]] = np.arange(min(OWN_ROWS, len(order)))
        self.start = OWN_ROWS + CLASSES
        self.empty = within == 0
        rng = np.random.default_rng(SEED)
        draw = lambda *shape, scale=0.1: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = {"E": draw(self.start + 1, DIM), "P": draw(WINDOW, DIM), "Q": draw(DIM, DIM, scale=0.25), "K": draw(DIM, DIM, scale=0.25)}
        self.w |= {"V": draw(DIM, DIM, scale=0.25), "O": draw(DIM, DIM, scale=0.25), "G": draw(DIM, CLASSES // GROUP), "g": np.zeros(CLASSES // GROUP, np.float32)}
        self.w |= {"U": draw(CLASSES // GROUP, DIM, GROUP), "b": np.zeros((CLASSES // GROUP, GROUP), np.float32)}
        self._close()

    @staticmethod
    def _classes(mass: np.ndarray, order: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Classes of ids with like neighbours: k-means of the projections of what stands before, after and around an id.

        The most frequent ids are classes of their own, ids that no training document has share one.
        """
        own, size = CLASSES // 4, SIDE
        label = np.full(len(mass), CLASSES - 1)
        label[order[:own]] = np.arange(own)
        near = sums.astype(np.float32)
        for k in range(3):
            part = near[:, k * size : (k + 1) * size]
            part /= np.linalg.norm(part, axis=1, keepdims=True) + 1e-9
        rest = order[own:]
        rest = rest[np.abs(near[rest]).sum(axis=1) > 0]
        if len(rest) < CLASSES:
            return label
        x, m = near[rest], mass[rest]
        middle = x[: CLASSES - own - 1].copy()
        for _ in range(12):
            nearest = np.argmax(x @ middle.T - (middle**2).sum(axis=1) / 2, axis=1)
            total = np.bincount(nearest, weights=m, minlength=len(middle))
            for j in range(x.shape[1]):
                middle[:, j] = np.bincount(nearest, weights=m * x[:, j], minlength=len(middle)) / np.maximum(total, 1)
        label[rest] = own + nearest
        return label

    def windows(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedding rows that stand before the ids of each window of the texts, and the ids' classes; -1 beyond a text's end."""
        n = np.diff(at)
        count = -(-n // WINDOW)
        text = np.repeat(np.arange(len(n)), count)
        first = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
        before = np.empty(len(ids), np.int32)
        before[1:] = self.row[ids[:-1]]
        before[at[:-1][n > 0]] = self.start
        place = first[:, None] + np.arange(WINDOW)
        inside = place < n[text][:, None]
        where = np.where(inside, at[text][:, None] + place, 0)
        return np.where(inside, before[where], self.start).astype(np.int32), np.where(inside, self.label[ids[where]], -1).astype(np.int32)

    def fit(self, texts: list[np.ndarray]) -> list[float]:
        """EPOCHS passes over all windows of the texts; mean loss of each."""
        if not (texts := [t for t in texts if len(t)]):
            return []
        x, y = self.windows(np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
        moments: dict = {}
        return [self.descend(x, y, epoch, moments) / len(x) for epoch in range(EPOCHS)]

    def descend(self, x: np.ndarray, y: np.ndarray, salt: int, moments: dict) -> float:
        """Adam on the windows in an order that they and the salt alone give; sum of their losses."""
        odd = np.random.default_rng(SEED).integers(0, 1 << 63, 2 * WINDOW).astype(np.uint64) | np.uint64(1)
        key = x.astype(np.uint64) @ odd[:WINDOW] + y.astype(np.uint64) @ odd[WINDOW:]
        order, total = np.argsort(mix(key + np.uint64(salt)), kind="stable"), 0.0
        names, size = list(self.w), sum(v.size for v in self.w.values())
        if not moments:
            moments |= {"step": 0, "first": np.zeros(size, np.float32), "second": np.zeros(size, np.float32)}
        first, second, by = moments["first"], moments["second"], np.empty(size, np.float32)
        for i in range(0, len(order), STEP):
            loss, grad = self._gradient(x[order[i : i + STEP]], y[order[i : i + STEP]])
            total += loss * len(order[i : i + STEP])
            moments["step"] += 1
            step = moments["step"]
            # first and second are 10 and 1000 times the means
            spread = (0.001 / (1 - 0.999**step)) ** 0.5
            rate, least = np.float32(0.001 / (1 - 0.9**step) / spread), np.float32(1e-8 / spread)
            g = np.concatenate([grad[k].reshape(-1) for k in names])
            first *= np.float32(0.9)
            first += g
            g *= g
            second *= np.float32(0.999)
            second += g
            np.sqrt(second, out=by)
            by += least
            np.divide(first, by, out=by)
            by *= rate
            at = 0
            for k in names:
                self.w[k] -= by[at : at + self.w[k].size].reshape(self.w[k].shape)
                at += self.w[k].size
            self._close()
        return total

    def flat(self) -> np.ndarray:
        """All weights in one array of whole multiples of 1 / FIXED."""
        return np.rint(np.clip(np.concatenate([self.w[k].reshape(-1) for k in sorted(self.w)]).astype(float), -64, 64) * FIXED).astype(np.int64)

    def unflat(self, weights: np.ndarray) -> None:
        at = 0
        for k in sorted(self.w):
            self.w[k] = weights[at : at + self.w[k].size].astype(np.float32).reshape(self.w[k].shape)
            at += self.w[k].size
        self._close()

    def _close(self) -> None:
        """Classes without ids, and groups of such classes only, have no probability."""
        empty = self.empty.reshape(-1, GROUP)
        self.w["b"][empty] = CLOSED
        self.w["g"][empty.all(axis=1)] = CLOSED

    def _head(self) -> np.ndarray:
        """For each group the weights of all groups and of its own classes; the last row is what is added."""
        groups, w = CLASSES // GROUP, self.w
        head = np.empty((groups, DIM + 1, groups + GROUP), w["G"].dtype)
        head[:, :DIM, :groups], head[:, DIM, :groups], head[:, :DIM, groups:], head[:, DIM, groups:] = w["G"], w["g"], w["U"], w["b"]
        return head

    def _into(self) -> np.ndarray:
        """What turns a state into its query, its value and 1: both sides of a score, and a value and its way out, are one product."""
        w, into = self.w, np.zeros((DIM + 1, 2 * DIM + 1), self.w["V"].dtype)
        into[:DIM, :DIM], into[:DIM, DIM:-1], into[DIM, -1] = w["Q"] @ w["K"].T / np.float32(DIM**0.5), w["V"] @ w["O"], 1
        return into

    @staticmethod
    def _wide(weights: np.ndarray, last: float = 0) -> np.ndarray:
        """Weights with one more column, of ``last`` only."""
        out = np.full((len(weights), weights.shape[1] + 1), last, weights.dtype)
        out[:, :-1] = weights
        return out

    @staticmethod
    def _scores(states: np.ndarray, edges: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Scores of all groups and of the own group's classes for states in order of their groups."""
        z = np.empty((len(states), head.shape[2]), head.dtype)
        for k in range(len(head)):
            np.matmul(states[edges[k] : edges[k + 1]], head[k], out=z[edges[k] : edges[k + 1]])
        return np.clip(z, -MOST, MOST, out=z)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the windows and its gradient. A class has the probability of its group times its own within it.

        Values have a column of ones, so that one product gives sums of weights with the weighted sum, and the way back takes
        what the sums lose off in its product. The last step works on states in order of their groups.
        """
        w, m, groups = self.w, len(x), CLASSES // GROUP
        inside = (y >= 0).reshape(-1)
        n, label, flat = int(np.count_nonzero(inside)), np.maximum(y, 0).reshape(-1).astype(np.int8), x.reshape(-1)
        e = self._wide(w["E"], 1).take(flat, 0)
        e.reshape(m, WINDOW, DIM + 1)[:] += self._wide(w["P"])
        into, k = self._into(), e.reshape(m, WINDOW, DIM + 1)[:, :, :DIM]
        qv = (e @ into).reshape(m, WINDOW, 2 * DIM + 1)
        q, v = qv[:, :, :DIM], qv[:, :, DIM:]
        a = q @ k.transpose(0, 2, 1)
        np.maximum(a, -MOST, out=a)
        np.minimum(a, CAUSAL, out=a)
        np.exp(a, out=a)
        o = (a @ v).reshape(-1, DIM + 1)
        part = 1 / o[:, DIM:]
        o *= part
        h = o + e
        h[:, DIM] = 1
        group = label // np.int8(GROUP)
        order = np.argsort(group, kind="stable")
        edges = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=groups))))
        states, head = h.take(order, 0), self._head()
        scale = inside.take(order) * np.float32(1 / n)
        z = self._scores(states, edges, head)
        np.exp(z, out=z)
        z *= (scale[:, None] / (z @ PARTS)) @ PARTS.T
        own = np.arange(groups, z.size, groups + GROUP) + (label % np.int8(GROUP)).take(order)
        right = z.reshape(-1).take(own)
        z.reshape(-1)[own] = right - scale
        back = np.empty_like(e)
        of_head = np.zeros_like(head)
        for j in range(groups):
            rows = slice(edges[j], edges[j + 1])
            right[rows] *= z[rows, j]
            z[rows, j] -= scale[rows]
            np.matmul(z[rows], head[j].T, out=back[rows])
            np.matmul(states[rows].T, z[rows], out=of_head[j])
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        dh = back.take(place, 0)
        g = {"G": of_head[:, :DIM, :groups].sum(axis=0), "g": of_head[:, DIM, :groups].sum(axis=0), "U": of_head[:, :DIM, groups:], "b": of_head[:, DIM, groups:]}
        dh[:, DIM] = 0
        do = dh * part
        np.negative((do * o) @ ONES, out=do[:, DIM])
        do = do.reshape(m, WINDOW, DIM + 1)
        ds = do @ v.transpose(0, 2, 1)
        ds *= a
        back = np.empty((m, WINDOW, 2 * DIM), e.dtype)
        np.matmul(ds, k, out=back[:, :, :DIM])
        np.matmul(a.transpose(0, 2, 1), do[:, :, :DIM], out=back[:, :, DIM:])
        back = back.reshape(-1, 2 * DIM)
        # a long thin product is quicker as the sum of some short ones
        of_scores, of_values = np.split((e.reshape(WINDOW, m, DIM + 1)[:, :, :DIM].transpose(0, 2, 1) @ back.reshape(WINDOW, m, 2 * DIM)).sum(axis=0), 2, axis=1)
        of_scores = of_scores / np.float32(DIM**0.5)
        g |= {"Q": of_scores @ w["K"], "K": of_scores.T @ w["Q"], "V": of_values @ w["O"].T, "O": w["V"].T @ of_values}
        de = back @ into[:, : 2 * DIM].T
        de += dh
        de = de[:, :DIM] + (ds.transpose(0, 2, 1) @ q).reshape(-1, DIM)
        g["P"] = de.reshape(m, WINDOW * DIM).sum(axis=0).reshape(WINDOW, DIM)
        g["E"] = np.zeros_like(w["E"])
        # two components are added as one complex number
        pairs = np.result_type(de, np.complex64)
        np.add.at(g["E"].view(pairs).reshape(-1), ((flat * (DIM // 2))[:, None] + np.arange(DIM // 2)).reshape(-1), de.view(pairs).reshape(-1))
        right = right[scale > 0] * np.float32(n) * np.float32(n)
        return float(-np.log(np.maximum(right, 1e-30)).mean()), g

    def prepared(self) -> None:
        """Products of the embeddings that scoring looks up; values, and what goes on, end in 1."""
        e, p, into = self._wide(self.w["E"], 1), self._wide(self.w["P"]), self._into()
        self.q, self.pq = e @ into[:, :DIM], (p @ into[:, :DIM])[CONTEXT:]
        self.kv, self.pkv = (np.concatenate((x[:, :DIM], x @ into[:, DIM:]), axis=1) for x in (e, p))
        self.head = self._head()

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log probability of each text; text i has the ids at[i]..at[i + 1]."""
        new, groups, n = WINDOW - CONTEXT, CLASSES // GROUP, np.diff(at)
        windows = -(-n // new)
        text = np.repeat(np.arange(len(n)), windows)
        opens = np.zeros(len(text), bool)
        opens[(np.cumsum(windows) - windows)[n > 0]] = True
        # every text has room for whole windows; what it does not fill is of no group, and seen by none that counts
        to = np.arange(len(ids)) + np.repeat((np.cumsum(windows) - windows) * new - at[:-1], n)
        before, group = np.full(len(text) * new + CONTEXT, self.start), np.full(len(text) * new, groups, np.int8)
        own, within, label = np.zeros(len(group), np.int8), np.zeros(len(group), np.float32), self.label[ids].astype(np.int8)
        before[CONTEXT + to[1:]] = self.row[ids[:-1]]
        before[CONTEXT::new][opens] = self.start
        group[to], own[to], within[to] = label // np.int8(GROUP), label % np.int8(GROUP), self.log_within[ids]
        places = np.lib.stride_tricks.sliding_window_view(before, WINDOW)[::new] if len(text) else before
        out = np.zeros(len(n))
        for i in range(0, len(text), BATCH):
            x, part = places[i : i + BATCH], slice(i * new, (i + BATCH) * new)
            q, kv = self.q.take(x[:, CONTEXT:], 0), self.kv.take(x, 0)
            q += self.pq
            kv += self.pkv
            s = q @ kv[:, :, :DIM].transpose(0, 2, 1)
            np.maximum(s, -MOST, out=s)
            np.minimum(s, CAUSAL[CONTEXT:], out=s)
            s[opens[i : i + BATCH], :, :CONTEXT] = CLOSED
            np.exp(s, out=s)
            h = s @ kv[:, :, DIM:]
            h *= 1 / h[:, :, DIM:]
            h[:, :, :DIM] += kv[:, CONTEXT:, :DIM]
            edges = np.concatenate(([0], np.cumsum(np.bincount(group[part], minlength=groups)[:groups])))
            order = np.argsort(group[part], kind="stable")[: edges[-1]]
            z = self._scores(h.reshape(-1, DIM + 1).take(order, 0), edges, self.head)
            log_p = within[part].take(order)
            log_p += z.reshape(-1).take(np.arange(groups, z.size, groups + GROUP) + own[part].take(order))
            for k in range(groups):
                log_p[edges[k] : edges[k + 1]] += z[edges[k] : edges[k + 1], k]
            np.exp(z, out=z)
            log_p -= np.log(z @ PARTS) @ ONES[:2]
            out += np.bincount(text[i : i + BATCH].take(order // new), weights=log_p, minlength=len(n))
        return out


def _round(model: Model, number: int):
    """Weights times windows of a task that trains on the windows of its texts of a round, and its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, held, windows, moments = [], [], 0, 0, {}

        def train() -> None:
            nonlocal held, windows
            if held:
                model.descend(np.concatenate(xs), np.concatenate(ys), number, moments)
                windows += held
                xs.clear()
                ys.clear()
                held = 0

        for ids, at in _training(batches, BLOCK * WINDOW):
            x, y = model.windows(ids, at)
            xs.append(x)
            ys.append(y)
            held += len(x)
            if held >= BLOCK:
                train()
        train()
        if windows:
            yield pa.RecordBatch.from_arrays([pa.array([windows]), pa.array([(model.flat() * windows).tobytes()], pa.binary())], ["windows", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    windows, sums = 0, 0
    for batch in batches:
        for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            windows, sums = windows + n, sums + np.frombuffer(blob, np.int64)
    if windows:
        yield pa.RecordBatch.from_arrays([pa.array([windows]), pa.array([sums.tobytes()], pa.binary())], ["windows", "sums"])


def fitted(rows: DataFrame) -> Model:
    """A model for ``rows`` (doc_id, row, ids): statistics and windows of all training rows."""
    texts = rows.select("doc_id", "row", "ids")
    schema = "id long, n long, " + ", ".join(f"{s} long" for s in NEAR)
    counted = texts.mapInArrow(_count_ids, schema).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n", *NEAR)]).toArrow()
    found, n = counted["id"].to_numpy(), counted["n"].to_numpy()
    some, windows = found >= 0, int(n[found < 0].sum())
    counts, near = np.zeros(VOCABULARY, np.int64), np.zeros((VOCABULARY, 3 * SIDE), np.int64)
    counts[found[some]] = n[some]
    for k, s in enumerate(NEAR):
        near[found[some], k] = counted[s].to_numpy()[some]
    model = Model(counts, [], near)
    tasks = max(1, windows // TASK_WINDOWS)
    rounds, passes = (ROUNDS if tasks > 1 else 1), min(EPOCHS, max(1, -(-LEAST_WINDOWS // max(1, windows))))
    for number in range(rounds * passes if windows else 0):
        part = texts.filter(F.pmod("row", F.lit(rounds)) == number % rounds).coalesce(tasks)
        trained = part.mapInArrow(_round(model, number), "windows long, sums binary")
        parts = trained.repartition(min(16, tasks)).mapInArrow(_added, "windows long, sums binary").collect()
        if parts:
            model.unflat(sum(np.frombuffer(r["sums"], np.int64) for r in parts) / sum(r["windows"] for r in parts) / FIXED)
    model.prepared()
    return model


class Hot(Known):
    """Words of the hot table by hash."""

    BITS = 18


class Base:
    """Logs of hot counts and the rule for all others."""

    def __init__(self, hot: list[tuple[int, int]], total: int, kinds: int):
        hot = sorted(hot)
        words = np.array([w for w, _ in hot], np.int64).view(np.uint64)
        self.table = Hot()
        self.table.add(words, np.zeros(0, np.uint32), np.zeros(len(words), np.int64))
        self.logs = np.zeros(1 << Hot.BITS)
        self.logs[self.table.find(words)[0]] = np.log10(np.array([n for _, n in hot], float) + 1)
        self.table.ids = self.table.start = self.table.size = None  # only the hashes travel with the tasks
        self.total, self.log_all = total, float(np.log10(total + kinds + 1))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot, hot = self.table.find(hashes.view(np.uint64))
        hot &= hashes != 0  # an empty slot's key
        return hot, np.where(hot, self.logs[slot], 0.0)


WORDS = "row long, word long, n int, text struct<n_tokens: long, known: long, score: double>"


def _words(base: Base):
    """(row, word, n) of words outside the hot table, and for each text a row of no word: its tokens and what the table knows of them.

    A row of no word has the row's hash for a word, so that these rows spread like words; its n is 0, so it is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(batches):
            hashes, doc = _tokens(data, at)
            hot, logs = base.find(hashes)
            texts, number = len(at) - 1, rows.column("row").to_numpy()
            known, score = np.bincount(doc, weights=hot, minlength=texts), np.bincount(doc, weights=logs, minlength=texts)
            tokens = np.bincount(doc, minlength=texts)
            hashes, doc = hashes[~hot], doc[~hot]
            order = np.lexsort((hashes, doc))
            hashes, doc = hashes[order], doc[order]
            new = np.ones(len(doc), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(doc)))
            whole = [np.concatenate((x, np.zeros(len(first), x.dtype))) for x in (tokens, known.astype(np.int64), score - tokens * base.log_all)]
            text = pa.StructArray.from_arrays([pa.array(x) for x in whole], ["n_tokens", "known", "score"], mask=pa.array(np.arange(texts + len(first)) >= texts))
            values = [
                pa.array(np.concatenate((number, number[doc[first]]))), pa.array(np.concatenate((mix(number.astype(np.uint64)).view(np.int64), hashes[first]))),
                pa.array(np.concatenate((np.zeros(texts, np.int32), n.astype(np.int32)))), text,
            ]
            yield pa.RecordBatch.from_arrays(values, ["row", "word", "n", "text"])

    return run


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("ids").to_pylist()
            ends = np.cumsum([len(b) // 2 for b in blobs])
            i = 0
            while i < len(blobs):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + AT_ONCE, "right")))
                ids = np.frombuffer(b"".join(blobs[i:j]), "<u2").astype(np.int64)
                at = np.concatenate(([0], ends[i:j] - (ends[i - 1] if i else 0)))
                doc = batch.column("doc_id").slice(i, j - i)
                score = model.score(ids, at) / np.log(10)
                yield pa.RecordBatch.from_arrays([doc, batch.column("row").slice(i, j - i), pa.array(_held_out(doc.to_pylist())), pa.array(score)], ["doc_id", "row", "held_out", "score"])
                i = j

    return run


def _least_hot(counts: DataFrame) -> int:
    """The smallest count whose words and those of larger counts are at most HOT, by steps of a sixteenth of a power of two."""
    steps = counts.groupBy(F.floor(F.log2("c") * 16).alias("step")).agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("words"))
    found, held = 1 << 62, 0
    for r in sorted(steps.collect(), reverse=True):
        held += r["words"]
        if held > HOT:
            break
        found = r["least"]
    return found


def language_scores(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    rows = rewritten(plain.mapInArrow(_encoded(path), "doc_id long, text string, row long, ids binary"), "encoded")
    words = rows.select("doc_id", "text", "row")
    counted = words.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("c"))
    counts = rewritten(counted.filter("c > 0"), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    least = _least_hot(counts)
    hot = [(r["word"], r["c"]) for r in counts.filter(F.col("c") >= least).collect()]
    base, model = Base(hot, total, kinds), fitted(rows)
    # the written row number tells apart rows of one id
    found = words.mapInArrow(_words(base), WORDS).join(counts, "word", "left")
    known = F.sum(F.coalesce("text.known", F.lit(0)) + F.when(F.col("c").isNull(), 0).otherwise(F.col("n")))
    more = F.sum(F.coalesce("text.score", F.lit(0.0)) + F.coalesce(F.col("n") * F.log10(F.col("c") + 1), F.lit(0.0)))
    of_words = found.groupBy("row").agg(F.sum("text.n_tokens").alias("n_tokens"), known.cast("long").alias("n_known"), more.alias("base_score"))
    scored = rows.select("doc_id", "row", "ids").mapInArrow(_scored(model), "doc_id long, row long, held_out boolean, score double")
    return scored.join(of_words, "row").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
