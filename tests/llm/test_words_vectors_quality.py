"""Spelling variants, centroid clustering and compression quality against plain versions, SQL and held-out labels."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from barloom.llm import centroids, compression_quality, spelling

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def words_by_hand(texts):
    n = collections.Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def variants_by_hand(texts):
    n = words_by_hand(texts)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, count = {}, {}
    for w in n:
        others = [o for o in n if o != w and near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        count[w] = len(others)
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return plain(out)


def made_texts():
    rng = np.random.default_rng(5)
    letters = list("abcdeé")
    base = ["".join(rng.choice(letters, rng.integers(6, 9))) for _ in range(12)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "z" * 5000]
    texts = [(None, "Straße ÉCOLES écoles a×bcdefg " * 6), (3, None), (4, ""), (4, "short words only")]
    for i in range(160):
        w = base[int(len(base) * rng.random() ** 3)]
        at, kind = int(rng.integers(len(w))), rng.integers(4)
        w = w if kind == 0 else w[:at] + w[at + 1 :] if kind == 1 else w[:at] + str(rng.choice(letters)) + w[at + int(kind == 2) :]
        texts.append((int(rng.integers(40)), f"{w.upper()} {w}-{w} {w} " * int(rng.choice([1, 2, 8]))))
    chain = "chainword " * 900 + "chainwore " * 150 + "chaiwore " * 28 + "haiwore " * 5
    return texts + texts[:30] + [(9, chain), (7, f"{'z' * 5000} " * 5), (8, f"{'z' * 4999} {'z' * 2500}y{'z' * 2499} " * 6)]


def test_spelling_variants_equal_all_pairs(spark):
    texts = made_texts()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, id long, word string").repartition(5)
    got = plain(spelling.variants(docs).collect())
    want = variants_by_hand(texts)
    assert got == want and len(want) > 40 and sum(r[1] is not None for r in want) > 5 and any(r[1] not in (None, r[2]) for r in want)
    assert spelling.variants(docs.limit(0)).collect() == []


def test_spelling_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF2}/documents.parquet'")
    assert plain(spelling.op11_spelling_variants(spark, SF2).collect()) == plain(con.sql(spelling.OP11_SQL).fetchall())


def clusters_by_hand(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centres = [list(q) for _, q in sorted(kept, key=lambda r: (*mark(r[0]), r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda q: min((dist(q, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        held = collections.defaultdict(list)
        for _, q in kept:
            held[place(q)[1]].append(q)
        for n, qs in held.items():
            centres[n] = [sum(c) // len(qs) for c in zip(*qs, strict=True)]
    out = [(i, *place(q)[::-1]) for i, q in kept]
    per = collections.Counter()
    for _, n, d in out:
        per[n] += d
    return plain((i, n, d, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, n, d in out)


def test_clusters_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    grid = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-1, 2, (150, 64)) / 64)]  # many ties
    far = [(200 + i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 10.0 ** rng.integers(-2, 4, (60, 1)), (60, 64)))]
    bad = [(300, None), (301, [0.0] * 63), (302, [0.0] * 65), (303, [None] + [0.0] * 63), (304, [math.nan] * 64), (305, [math.inf] * 64), (306, [])]
    rows = grid + far + grid[:40] + [(5, [0.5] * 64), (None, [0.25] * 64)] + bad
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int").repartition(4)
    assert plain(centroids.clustered(table).collect()) == clusters_by_hand(rows)
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")
    assert plain(centroids.clustered(few).collect()) == clusters_by_hand(rows[:5])
    assert centroids.clustered(few.limit(0)).collect() == []
    huge = spark.createDataFrame([(1, [3e9] * 64), (2, [1.0] * 64)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in centroids.clustered(huge).collect()] == [2]
    with pytest.raises(ValueError):
        centroids.clustered(few, k=1 << 20)


def test_annulus_search_equals_all_distances():
    rng = np.random.default_rng(4)
    for scale in (2, 50, 1 << 26):
        v, c = rng.integers(-scale, scale, (500, 8)), rng.integers(-scale, scale, (40, 8))
        c[7], c[21] = c[3], -c[3]
        d = ((v[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        number, distance = centroids.nearest(v, c)
        assert (number == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_clusters_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF2}/embeddings.parquet'")
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert plain(centroids.op12_centroids(spark, SF2).select(names).collect()) == plain(con.sql(centroids.OP12_SQL).select(*names).fetchall())


def test_quality_scores_tell_held_out_labels(spark):
    got = {r["doc_id"]: r for r in compression_quality.op13_quality_scores(spark, SF2).collect()}
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()]
    tested = [(got[i]["predicted"], q) for i, q in labels if got[i]["held_out"]]
    assert len(tested) > 60 and sum(p == q for p, q in tested) >= 0.95 * len(tested)
    good, bad = ([got[i]["score"] for i, q in labels if got[i]["held_out"] and q == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.93


def test_quality_features_and_calibration():
    good, bad = [b"the quick brown fox jumps over a lazy dog " * 30] * 20, [b"buy!!! now!!! $$$ click ### " * 40] * 20
    sizes = compression_quality.Sizes(compression_quality.dictionary(good), compression_quality.dictionary(bad))
    text = b"the lazy dog jumps over a quick brown fox " * 90 + b"click!!! $$$ "
    parts = [text[i : i + 1024] for i in range(0, len(text), 1024)]
    g, b = (sum(len(c.compress(p)) for p in parts) for c in sizes.by)
    f = sizes.features(text)
    assert f[0] == pytest.approx((b - g) / max(g, b)) and f[0] > 0 and f[2] == pytest.approx(g / len(text)) and sizes.features(bad[0])[0] < 0
    assert np.isfinite(sizes.features(b"")).all()
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, compression_quality.FEATURES))
    p = 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))
    fit = compression_quality.Calibration(x, (rng.random(4000) < p).astype(float))
    assert np.abs(fit.scores(x) - p).mean() < 0.03


def test_quality_odd_rows(spark):
    rows = [(i, "good plain words in a calm line of text " * (3 + i % 4) if i % 3 else "JUNK!! $$$ ### " * (5 + i % 5)) for i in range(90)]
    odd = [(None, "no id"), (500, None), (501, ""), (502, "x" * 300_000), (3, "another text of an id")]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows + odd], "doc_id long, text string, score double, quality int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 9) for i in range(90)] + [(4, 0, 9), (None, 1, 9), (7, None, 9), (8, 5, 9), (999, 1, 9)], "doc_id long, quality int, text int")
    got = compression_quality.scored(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 90 and r["doc_id"] not in (3,))
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    alone = compression_quality.scored(docs, labels.filter("quality = 1")).collect()
    assert len({r["score"] for r in alone}) == 1 and 0.9 < alone[0]["score"] < 1
    assert {r["score"] for r in compression_quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert compression_quality.scored(docs.limit(0), labels).collect() == []
    shifted = compression_quality.scored(docs, labels.withColumn("quality", compression_quality.F.when(compression_quality.held_out(compression_quality.F.col("doc_id")), 0).otherwise(compression_quality.F.col("quality"))))
    assert plain(shifted.collect()) == plain(got)  # held-out labels have no effect
