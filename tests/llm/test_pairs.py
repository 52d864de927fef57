"""Near-duplicates of texts and vectors against all pairs."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

from certamap.llm import simhash, vectors
from certamap.operators.components import components
from certamap.operators.lineage import cut, drop


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for k in range(64):
            votes[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * votes[k] > len(grams))


def closure(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_fingerprints_and_components(spark, docs):
    got = {(r["id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    assert {(i, f % (1 << 64)) for i, f in got} == set(rows)
    root = closure(sorted({f for _, f in rows}), lambda a, b: (a ^ b).bit_count() <= 3)
    for (i, f), c in got.items():
        same = [j for j, g in rows if root[g] == root[f % (1 << 64)] and j is not None]
        assert c == min(same, default=None)


def test_row_count_and_empty(spark, docs, none):
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("list_block", [2048, 8])
def test_links_keep_every_component(spark, list_block):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for base in list(fps)[:25]:
        for _ in range(6):
            x = base
            for k in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << k
            fps.add(x)
    hub = 0xFFFF
    fps |= {hub ^ (1 << k) for k in range(64)}  # a crowd around one value
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = components(simhash.links(df, 3, list_block), "a", "b").collect()
    found = {r["node"]: r["root"] for r in got}
    nodes = sorted(signed(x) for x in fps)
    want = closure(nodes, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 3)
    assert {n: found.get(n, n) for n in nodes} == want


@pytest.mark.parametrize("seed", range(6))
def test_tally_and_forest_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 62, 5)
    fps = np.unique(np.concatenate([base, *[b ^ (1 << rng.integers(0, 32, 20)) for b in base], *[b ^ rng.integers(0, 1 << 32, 12) for b in base]])).astype(np.int64)
    fps = fps & 0xFFFFFFFF | 0x12345678 << 32  # one list: bytes 4 to 7 are shared
    view = fps.view(np.uint64)
    for least in (1, 2, 3):
        a, b = simhash.tally(view[:30], view, range(4), least)
        same = (view[:30, None].view(np.uint8).reshape(30, 1, 8)[:, :, :4] == view.view(np.uint8).reshape(1, -1, 8)[:, :, :4]).sum(axis=2)
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [tuple(x) for x in np.argwhere(same >= least).tolist()]
    a, b = simhash.tally(view, view, range(4), 1)
    assert len(a) < 0.5 * len(view) ** 2  # what is verified is a part of all pairs
    want = closure(fps.tolist(), lambda x, y: (x ^ y).bit_count() <= 3)
    edges = list(simhash.forest(fps, range(4), 3))
    root = {x: x for x in fps.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in edges:
        root[max(find(x), find(y))] = min(find(x), find(y))
    assert {x: find(x) for x in root} == want


def test_steiner_blocks_cover_every_agreement():
    from itertools import combinations

    blocks = simhash.steiner_blocks()
    assert len(blocks) == 14
    assert all(any(set(b) <= set(five) for b in blocks) for five in combinations(range(8), 5))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(500, 500), (300, 299), (300, 299)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def make_vectors(n, near, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 16))
    for k in range(near):
        v[n - 1 - k] = v[k % 7] + rng.normal(scale=0.03, size=16)
    return v


@pytest.mark.parametrize(("rows", "shard_rows", "split", "fan"), [(400, 1000, 4000, 1024), (900, 150, 4000, 1024), (900, 60, 150, 3)])
def test_vectors_against_brute_force(spark, monkeypatch, rows, shard_rows, split, fan):
    monkeypatch.setattr(vectors, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(vectors, "SPLIT_ROWS", split)
    monkeypatch.setattr(vectors, "FAN", fan)
    v = make_vectors(rows, 120, rows)
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(10_000 + i, v[3].tolist()) for i in range(5)] + [(11_000, (2 * v[4]).tolist())]
    data += [(20_000, None), (20_001, []), (20_002, [0.0] * 16), (20_003, [float("nan")] * 16), (20_004, [None] + [1.0] * 15), (20_005, [1e308] * 16), (20_006, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    out = vectors.near_duplicates(df)
    got = {r["id"]: r for r in out.collect()}
    ok = [(i, np.array(x) / np.abs(x).max()) for i, x in data if x and len(x) == 16 and None not in x and np.isfinite(x).all() and any(x)]
    ids = [i for i, _ in ok]
    m = np.array([x / np.linalg.norm(x) for _, x in ok])
    link = m @ m.T >= 0.95
    np.fill_diagonal(link, False)
    want = {i: int(link[k].sum()) for k, i in enumerate(ids)}
    total = sum(want.values())
    assert all(got[i]["n_links"] <= n for i, n in want.items())
    assert sum(got[i]["n_links"] for i in ids) >= 0.9 * total
    assert vectors.audit(df, out, every=1) >= 0.9
    for i in (20_000, 20_001, 20_002, 20_003, 20_004, 20_006):
        assert (got[i]["n_links"], got[i]["component_id"]) == (0, i)
    for i in range(10_000, 10_005):
        assert got[i]["component_id"] == got[3]["component_id"] <= 3
    assert len(got) == len(data)


def test_split_of_some_shards_only(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 60), ("SPLIT_ROWS", 150), ("FAN", 4)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(5)
    centre = np.eye(16)[rng.choice(4, 700, p=[0.6, 0.2, 0.1, 0.1])]  # homes of very different sizes
    v = 3 * centre + rng.normal(size=(700, 16))
    v[600:] = v[:100] + rng.normal(scale=0.03, size=(100, 16))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    points = spark.createDataFrame([(i, x.tobytes(), 1) for i, x in enumerate(v)], "pid long, unit binary, copies long")
    placed = {r["pid"]: r["shards"] for r in vectors.assigned(points, 16, 700).collect()}
    assert sorted(placed) == list(range(700)) and all(x and len(set(x)) == len(x) for x in placed.values())
    homes = Counter(x[0] for x in placed.values())
    assert max(homes.values()) <= 150 and min(homes) < 4 <= max(homes)  # some were split, some were not
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    assert vectors.audit(df, vectors.near_duplicates(df), every=1) >= 0.9


def test_drop_deletes_one_table_only(spark):
    one, two = cut(spark.range(5)), cut(spark.range(7))
    path = Path(two.inputFiles()[0].removeprefix("file://")).parent
    assert path.exists()
    drop(two)
    assert not path.exists() and one.count() == 5


@pytest.mark.parametrize("kind", ["float", "double"])
def test_packed_vectors_keep_their_precision(spark, kind):
    rows = [(0, [0.1, -0.0, 3.0]), (1, [0.2, 0.0, 6.0]), (2, [1e-30, 1e-30, 0.0]), (3, [0.0] * 3), (4, None)]
    got = {r["id"]: r["unit"] for r in vectors.normalised(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()}
    assert got[0] == got[1] and got[3] is None and got[4] is None and len(got[0]) == 3 * {"float": 4, "double": 8}[kind]
    v = np.array(rows[0][1], np.float32 if kind == "float" else np.float64).astype(float)
    assert np.allclose(vectors._matrix([got[0], got[2]], 3), [v / np.sqrt((v * v).sum()), [0.5**0.5, 0.5**0.5, 0]], rtol=1e-15)


def test_vectors_with_odd_columns(spark):
    v = make_vectors(120, 40, 7)
    rows = [(i if i != 11 else None, x.tolist(), 1, b"u", 2, "home", [3]) for i, x in enumerate(v)] + [(None, None, 1, b"u", 2, "home", [3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, pid int, unit binary, copies int, home string, shards array<int>")
    got = sorted(map(str, vectors.near_duplicates(df).collect()))
    assert got == sorted(map(str, vectors.near_duplicates(df.select("vec_id", "embedding")).collect())) and len(got) == 121


def test_vectors_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline_stage_keeps_one_of_each_group(spark, docs):
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    seen = {(r["id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    want = Counter(i for i, c in seen if i == c)
    assert Counter(r["doc_id"] for r in kept.collect()) == want
