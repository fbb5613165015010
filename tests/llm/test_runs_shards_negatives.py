"""Periodic runs, sharding and hard negatives against brute force, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives, periodic_runs, sharding

SF = "/root/testdata/sf0.001"


# 11 ------------------------------------------------------------------------------------------

VECTORS = "id long, label int, vector array<float>"


def _mined(rows, divisor):
    """All scores of all anchors, and the windows by hand."""
    rows = [(i, y, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, y, v in rows:
        if i % divisor:
            continue
        scored = {(-sum(a * b for a, b in zip(v, w)), j, z == y) for j, z, w in rows if j != i and len(w) == len(v)}
        for p, j, _ in sorted(s for s in scored if s[2])[:5]:
            near = sorted((n, k) for n, k, alike in scored if not alike and 50 * -p <= 100 * -n <= 95 * -p)
            out |= {(i, j, rank, k, -p, -n) for rank, (n, k) in enumerate(near[:3], 1)}
    return sorted(out)


def _vectors(seed, n, dim=6, groups=4):
    """Random rows, and crowds of near and equal ones."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    rows = []
    for k in range(n):
        centre, wide = rng.choice(centres), rng.choice([0, 0.001, 0.05, 1])
        rows.append((k, rng.randrange(3), [x + rng.gauss(0, wide) for x in centre]))
    return rows


@pytest.mark.parametrize("block_rows, pass_blocks, reach", [(1024, 64, 0.5), (3, 4, 0.5), (7, 2, 0.0), (5, 64, 100.0)])
def test_hard_negatives(spark, block_rows, pass_blocks, reach):
    rows = _vectors(3, 260)
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = hard_negatives.mine(frame, frame.where("id % 10 = 0"), block_rows=block_rows, pass_blocks=pass_blocks, reach=reach)
    assert sorted(tuple(r) for r in got.collect()) == _mined(rows, 10)


@pytest.mark.parametrize("reach", [0.0, 0.5, 100.0])
def test_bounds_lose_no_wanted_candidate(reach):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(5, 8)) * 200
    anchors = np.floor(centre[rng.integers(0, 5, 60)] + rng.normal(size=(60, 8)) * rng.choice([1, 20, 200], (60, 1)))
    labels = rng.integers(0, 2, 60)
    made = hard_negatives._block(list(range(60)), labels.tolist(), list(anchors), reach)
    block = hard_negatives._read([made])[0]
    assert sorted(block.ids.tolist()) == list(range(60))
    values = np.floor(rng.normal(size=(400, 8)) * 100)
    exact = block.vectors.astype(np.int64) @ values.astype(np.int64).T
    skipped = 0
    for a, rows, scores in hard_negatives._scored(block, values, lambda a: (5_000, 20_000), lambda label: np.arange(400)):
        assert (scores == exact[a, rows]).all()
        left = np.setdiff1d(np.arange(400), rows)
        skipped += len(left)
        assert not ((exact[a, left] >= 5_000) & (exact[a, left] <= 20_000)).any()
    assert skipped or reach == 0


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for top in (1 << 8, 1 << 16, 1 << 18):
        a, b = rng.integers(-top, top, (5, 64)), rng.integers(-top, top, (7, 64))
        norms = [float(np.sqrt((x.astype(float) ** 2).sum(axis=1).max())) + 1 for x in (a, b)]
        assert (hard_negatives._products(a.astype(float), b.astype(float), *norms) == a @ b.T).all()


def test_spanning_tree_is_least():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(40, 3))
    order, parent, edge = hard_negatives.spanning_tree(points)
    assert sorted(order.tolist()) == list(range(40)) and parent[0] == -1 and all(p in order[:k] for k, p in enumerate(parent) if k)
    # Kruskal
    pairs = sorted((float(np.linalg.norm(points[a] - points[b])), a, b) for a in range(40) for b in range(a))
    root, total = list(range(40)), 0.0
    for d, a, b in pairs:
        if root[a] != root[b]:
            total += d
            root = [root[a] if r == root[b] else r for r in root]
    assert abs(edge.sum() - total) < 1e-9


def test_hard_negatives_of_odd_rows(spark):
    v = [1.0, 0.5]
    rows = [(0, 1, v), (1, 1, v), (2, 2, [0.9, 0.3]), (3, 2, [0.9, 0.3]), (4, None, v), (5, 1, None), (6, 2, [None, 1.0]), (7, 2, [float("nan"), 1.0]), (8, 2, [float("inf"), 1.0]), (None, 2, v), (9, 2, [1.0]), (10, 1, []), (20, 2, []), (1, 1, v), (2, 2, [0.9, 0.3]), (11, 2, [3.4e38, 1.0])]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({"rank": F.lit("x"), "score": F.lit(1), "block": F.lit(2)})
    got = sorted(tuple(r) for r in hard_negatives.mine(frame.select("id", "label", "vector"), frame.where("id % 10 = 0").select("id", "label", "vector")).collect())
    p, n = 256 * 256 + 128 * 128, 256 * 230 + 128 * 76
    assert got == [(0, 1, 1, 2, p, n), (0, 1, 2, 3, p, n)]
    none = frame.where("false").select("id", "label", "vector")
    assert hard_negatives.mine(none, none).count() == 0
    assert hard_negatives.mine(frame.select("id", "label", "vector"), none).count() == 0


# 12 ------------------------------------------------------------------------------------------


def test_permutation_and_its_inverse(spark):
    for n in (1, 2, 3, 7, 100, 257, 1000):
        assert sorted(sharding.permuted(r, n) for r in range(n)) == list(range(n))
        assert all(sharding.restored(sharding.permuted(r, n), n) == r for r in range(n))
        steps = sharding._walks(spark, n, sharding.SEED)
        got = {r.id: r.p for r in spark.range(n).select("id", sharding.position(F.col("id"), n, sharding.SEED, steps).alias("p")).collect()}
        assert got == {r: sharding.permuted(r, n) for r in range(n)}
    big = (1 << 45) + 12345
    assert all(sharding.restored(sharding.permuted(r, big), big) == r < big for r in (0, 1, big // 3, big - 1))
    assert all(sharding.place_of(sharding.row_at(s, t, big), big) == (s, t) for s in (0, 15) for t in (0, 10**9))
    halves, _ = sharding._halves(big)
    row = spark.range(1).select(sharding.position(F.lit(big - 1), big, 5, 4).alias("p")).first().p
    assert row == sharding.permuted(big - 1, big, 5) and halves**2 >= big


def test_shards_are_even_and_mixed(spark):
    rows = [(k, f"t{k}") for k in range(3001)]
    placed = sharding.shuffled(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), ["doc_id"], shards=7).collect()
    sizes = [sorted(r.slot for r in placed if r["shard"] == s) for s in range(7)]
    assert all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert all((r["shard"], r.slot) == sharding.place_of(r.row_number, 3001, 7) and r.row_number == r.doc_id for r in placed)
    # neighbours are dealt apart: chi square of shards of the first 700 rows, 6 degrees of freedom
    first = np.bincount([r["shard"] for r in placed if r.doc_id < 700], minlength=7)
    assert ((first - 100) ** 2 / 100).sum() < 22.5


def test_shards_do_not_depend_on_files(spark, tmp_path):
    # null ids and texts, copies of one row in many partitions, clashing names
    rows = [(None, "a"), (None, None), (3, ""), (3, None), (3, "x" * 100_000)] + [(5, "same")] * 40 + [(k, f"t{k}") for k in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"slot": F.lit("own"), "_at": F.lit(1), "other": F.lit(2)})
    key = ["doc_id", "text"]
    one, other = (sorted(((r.doc_id, r.text, r["shard"], r.slot, r.other) for r in sharding.shuffled(f, key).collect()), key=repr) for f in (frame.coalesce(1), frame.repartition(9)))
    assert one == other and len(one) == len(rows)
    sharding.write_shards(sharding.shuffled(frame, key), path := str(tmp_path / "shards"))
    back = spark.read.parquet(path)
    assert sorted((r["shard"], r.slot) for r in back.collect()) == sorted((x[2], x[3]) for x in one)
    assert sharding.shuffled(frame.where("false"), key).count() == 0


# 13 ------------------------------------------------------------------------------------------


def _runs(words):
    """Every period compared along the whole sequence; the least one of a stretch stays."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def _sequences(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        k, size, kind = rng.choice([1, 2, 3, 50]), rng.randint(0, 160), rng.randrange(5)
        if kind == 0:
            words = [rng.randrange(k) for _ in range(size)]
        elif kind == 1:
            part = [rng.randrange(k) for _ in range(rng.randint(1, 40))]
            words = (part * (size // len(part) + 1))[:size]
        elif kind == 2:
            words = []
            while len(words) < size:
                words += [rng.randrange(k) for _ in range(rng.randint(1, 12))] * rng.randint(1, 12)
        elif kind == 3:
            a, b = [0] * rng.randint(10, 60), [0, 1] * rng.randint(3, 30)
            words = a + [1] + a + b + [0] + b + a
        else:
            words, last = [0, 1], [0]
            while len(words) < size:
                words, last = words + last, words
        out.append(words)
    return out


def test_runs_of_sequences():
    for seed in range(12):
        parts = _sequences(seed, 12)
        got = periodic_runs.find_runs(np.array([w for p in parts for w in p], np.int64), np.array([len(p) for p in parts]))
        want, base = [], 0
        for p in parts:
            want += [(s + base, s + n + base, q) for s, n, q in _runs(p)]
            base += len(p)
        assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda r: (r[0], r[2]))


def test_occurrences_are_looked_up_in_parts(monkeypatch):
    words = np.array([0, 1] * 300 + [2] + [0] * 300 + [0, 1, 1] * 50)
    whole = periodic_runs.find_runs(words, np.array([len(words)]))
    monkeypatch.setattr(periodic_runs, "_AT_ONCE", 10)
    assert periodic_runs.find_runs(words, np.array([len(words)])).tolist() == whole.tolist() == [[s, s + n, q] for s, n, q in _runs(words.tolist())]


def _op13(doc_id, text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    h, n = 1 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = _runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def _query(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit("own"), "best": F.lit(1), "id": F.lit(2)}).write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r) for r in periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)


def test_periodic_runs_of_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "a b " * 9), (4, "a b " * 9), (4, "a b " * 9), (5, "é é " * 20), (6, "x" * 200_000), (7, "the same line of words again\n" * 3000), (8, "a " * 11), (9, "a " * 12)]
    rows += [(k, " ".join(map(str, p))) for k, p in enumerate(_sequences(50, 60), 100)]
    assert _query(spark, tmp_path, rows) == sorted((_op13(*r) for r in rows), key=repr)


def test_periodic_runs_of_the_whole_table(spark):
    want = [_op13(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in periodic_runs.op13_periodic_runs(spark, SF).collect()) == sorted(want)


def test_periodic_runs_of_an_empty_table(spark, tmp_path):
    assert _query(spark, tmp_path, []) == []
