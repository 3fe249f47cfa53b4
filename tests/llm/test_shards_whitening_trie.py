"""Operators 11 to 13: brute force, exact properties and edge cases."""

from __future__ import annotations

import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from corpusforge.llm import prefix_trie, sharding, whitening  # noqa: E402

# ---- sharding ---------------------------------------------------------------


def _edited(slot_map: dict, weights: dict, shards: int) -> dict:
    """The rebalancing rule in plain Python."""
    mean = sum(weights.values()) / shards
    by = defaultdict(list)
    for s, k in slot_map.items():
        by[k].append((weights.get(s, 0), s))
    moving, loads, out = [], [0] * shards, {}
    for k, slots in by.items():
        left = sum(w for w, _ in slots)
        for w, s in sorted(slots):
            if k >= shards or (w > 0 and left > mean):
                moving.append((-w, s))
            else:
                out[s] = k
                loads[k] += w
            left -= w
    for w, s in sorted(moving):
        k = loads.index(min(loads))
        out[s], loads[k] = k, loads[k] - w
    return out


def test_rebalancing_is_brute_force(spark):
    rng = random.Random(2)
    weights = {s: rng.choice([0, 1, 5, 40, 300]) * rng.randint(1, 9) for s in range(97)}
    first = {s: s % 7 for s in range(101)}
    table = spark.createDataFrame(list(weights.items()), "virtual_slot int, bytes long")
    for shards in (7, 9, 4):
        got = sharding.rebalanced(spark.createDataFrame(list(first.items()), "virtual_slot int, shard int"), table, shards)
        assert {r.virtual_slot: r.shard for r in got.collect()} == _edited(first, weights, shards)


def test_growth_moves_only_into_new_shards_what_evens_them(spark, tmp_path):
    rows = [(i, "x" * (i % 37)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "map")
    one = sharding.shard_records(spark, df, shards=10, slots=512, map_path=path).toPandas().set_index("doc_id")
    two = sharding.shard_records(spark, df, shards=11, slots=512, map_path=path, version=1).toPandas().set_index("doc_id")
    assert (one.virtual_slot == two.loc[one.index].virtual_slot).all()
    moved = one.shard != two.loc[one.index].shard
    assert moved.mean() < 0.2  # about a tenth, not all
    for out, shards in ((one, 10), (two, 11)):
        sums = out.groupby("shard")["size"].sum()
        assert len(sums) == shards and sums.max() < 1.05 * sums.mean()
    assert sorted(r.virtual_slot for r in sharding.load_map(spark, path, 2).collect()) == list(range(512))
    with pytest.raises(Exception):  # a version is never written again
        sharding.save_map(sharding.first_map(spark, 10, 512), path, 1)


def test_sharding_edges(spark):
    rows = [(1, "é", 1), (1, "é", 1), (None, None, 2), (2, "", 3), (3, "a" * 5000, 4)] + [(7, "copy", 5)] * 1500
    df = spark.createDataFrame(rows, "doc_id long, text string, slot long")
    out = sharding.shard_records(spark, df, shards=4, slots=64).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows
    )
    places = defaultdict(list)
    for r in out:
        places[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    assert sharding.shard_records(spark, df.limit(0), shards=4, slots=64).count() == 0


# ---- whitening --------------------------------------------------------------


@pytest.mark.parametrize("kind", range(6))
def test_dqds_and_vectors_against_lapack(kind):
    rng = np.random.default_rng(kind)
    for n in (1, 2, 3, 9, 40):
        u, v = (np.linalg.qr(rng.standard_normal((n, n)))[0] for _ in range(2))
        a = [
            rng.standard_normal((n, n)), u @ np.diag(10.0 ** -np.linspace(0, 14, n)) @ v, np.eye(n) * 3, u * 5,
            u @ np.diag(np.r_[np.ones(n // 2) * 2, np.ones(n - n // 2)]) @ v, rng.standard_normal((n, max(1, n // 2))) @ rng.standard_normal((max(1, n // 2), n)),
        ][kind]
        r = np.linalg.qr(a, mode="r")
        diagonal, above, w = whitening.bidiagonal(r)
        b = np.diag(diagonal) + np.diag(above, 1)
        assert np.allclose(w @ b.T @ b @ w.T, r.T @ r, atol=1e-12)
        exact = np.linalg.svd(r, compute_uv=False)
        assert np.abs(np.sqrt(whitening.dqds(diagonal, above)) - exact).max() < 1e-13 * exact[0]
        values, directions, trace = whitening.whitening_directions(r, 3, n)
        cov = r.T @ r / 3
        assert np.abs(directions.T @ directions - np.eye(directions.shape[1])).max() < 1e-11
        assert np.abs(cov @ directions - directions * values).max() < 1e-12 * values[0]
        assert trace == pytest.approx(np.trace(cov))


def test_dqds_keeps_small_values_accurate():
    diagonal, above = np.array([1.0, 1e-6, 1e-9]), np.array([1e-3, 1e-8])
    got = np.sqrt(whitening.dqds(diagonal, above))
    assert np.prod(got) == pytest.approx(np.prod(diagonal), rel=1e-12)  # the determinant holds the smallest ones


def _white(rows: list, k: int = 8):
    x = np.floor(np.array(rows, dtype=np.float32).astype(float) * 1024).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), y @ v / np.sqrt(e), e / np.trace(y.T @ y / n)


def test_whitening_is_lapack_and_drops_unusable_rows(spark):
    rng = np.random.default_rng(5)
    good = (rng.standard_normal((400, 6)) @ rng.standard_normal((6, 6)) + 3).astype(np.float32).tolist()
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0, 5.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0, 2.0], [1e30] * 6]
    rows = [(i, v, 1, 0.5) for i, v in enumerate(good)] + [(None, v, 2, 0.5) for v in bad]
    rows += [(400, good[0], 1, 0.5), (None, good[1], 1, 0.5)]  # a repeated vector, a null id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, whitened double").repartition(70)
    out = whitening.whiten(spark, df, k=8).toPandas()
    deviation, white, explained = _white(good + [good[0], good[1]])
    assert len(out) == 402 * 6 and set(out.n) == {402} and out.identity_error.max() < 1e-12
    for c in range(6):
        part = out[out.component == c + 1].set_index("vec_id")
        at = list(range(401))
        w = part.loc[at, "whitened"].to_numpy()
        assert np.abs(w - white[:401, c] * np.sign(w @ white[:401, c])).max() < 1e-9
        assert part.loc[at, "deviation"].tolist() == deviation[:401].tolist()
        assert part.explained.iloc[0] == pytest.approx(explained[c], rel=1e-9)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5):
        assert whitening.whiten(spark, spark.createDataFrame(rows, schema)).collect() == []
    flat = whitening.whiten(spark, spark.createDataFrame([(i, [float(i), 2.0, 1.0]) for i in range(9)], schema)).collect()
    assert {r.component for r in flat} == {1} and flat[0].identity_error < 1e-12 and flat[0].explained == pytest.approx(1.0)


def test_whitening_deviation_beyond_long_is_null(spark):
    rows = [(i, [float(10**12 * (i == 0))]) for i in range(3)]
    out = whitening.whiten(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.deviation for r in out} == {0: None, 1: None, 2: None}


# ---- prefix trie ------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def _trie(spark, rows, **more):
    out = prefix_trie.prefix_trie(spark, spark.createDataFrame(rows, TURNS), **more)
    got = [tuple(r)[:8] for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(scope="module")
def talks():
    """Shared first turns, copies, one conversation within another, one of 120 turns, nulls, odd ids."""
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 90), 1000, 1001, 1219, 10**12 + 7, -41, -40]:
        length = 120 if c == 33 else rng.randint(1, 7)
        for t in range(length):
            role = rng.choice(["user", "assistant", None])
            text = rng.choice(["hi there", "a b c", "", None, "über  allen\tGipfeln"]) if c % 3 else "same words here"
            rows.append((c, None if t == 0 else t * 2, role if c % 3 else "user", text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("length,shard_rows", [(64, 20_000), (2, 5), (1, 1), (7, 3)])
def test_trie_is_brute_force(spark, talks, length, shard_rows):
    assert _trie(spark, talks + [(None, 0, "user", "lost")], length=length, shard_rows=shard_rows) == brute.trie(talks)


def test_trie_hot_prefix_and_long_conversation(spark):
    rows = [(c, t, "user", "open" if t < 3 else f"{c % 40} {t}") for c in range(300) for t in range(4)]
    rows += [(301, t, "user", str(t % 5)) for t in range(900)]
    assert _trie(spark, rows, length=16, shard_rows=50) == brute.trie(rows)


def test_trie_edges(spark):
    assert _trie(spark, []) == set()
    assert _trie(spark, [(None, 1, "user", "x")]) == set()
    # ids whose heads are never there and that have no more turns than they take: turnless, the root's own ends
    alone = [(c, 0, None, None) for c in range(21, 39) if zlib.crc32(str(c).encode()) % 4]
    assert alone and _trie(spark, alone) == brute.trie(alone)
    # repeated rows are turns of their own; equal turn numbers go by name, the same way in every conversation
    twice = [(c, 5, "user", x) for c in (40, 45, 52) for x in ("a", "a", "b")]
    nodes = _trie(spark, twice)
    assert max(n[1] for n in nodes) == 3 and len(nodes) == len({n[:2] for n in nodes})
    long = [(60, 0, "user", "w " * 200_000), (61, 0, "user", "w " * 200_000)]
    assert _trie(spark, long) == brute.trie(long)


def test_double_array_holds_what_was_packed():
    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 9, 300)
    names = rng.integers(0, 12, (int(lengths.sum()), 1)).repeat(2, axis=1).astype(np.int64)
    group = np.sort(rng.integers(0, 3, 300))
    group = np.unique(group, return_inverse=True)[1]
    trie, roots, states = prefix_trie.walk_shard(group, lengths, names)
    start = np.cumsum(lengths) - lengths
    paths, state = {}, roots.copy()
    for i, to in enumerate(states):
        going = np.flatnonzero(lengths > i)
        assert (trie.check[to] == state[going]).all()
        for row, s in zip(going, to):
            path = (int(group[row]), *names[start[row] : start[row] + i + 1, 0].tolist())
            assert paths.setdefault(int(s), path) == path  # a state is one prefix
        state[going] = to
    assert len(set(paths.values())) == len(paths)
