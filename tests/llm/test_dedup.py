"""Near-duplicates and links against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import minhash, vectors
from lodestone.llm.common import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def union(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(k, k + 1) for k in range(40)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(45)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    want = {k: v for k, v in union(p for p in pairs if p[0] != p[1]).items()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError, match="not found after 1"):
        components(spark.createDataFrame(pairs, "a long, b long"), max_rounds=1)


def shingles(text, n):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, percent):
    sets = {}
    for d, t in rows:
        if s := shingles(t, n):
            sets.setdefault(s, []).append(d)
    keys = list(sets)
    links = [(a, b) for a in range(len(keys)) for b in range(a) if 100 * len(keys[a] & keys[b]) >= percent * len(keys[a] | keys[b])]
    root = union(links)
    low = {}
    for k, s in enumerate(keys):
        ids = [d for d in sets[s] if d is not None]
        r = root.get(k, k)
        low[r] = min([*ids, low[r]] if r in low else ids, default=low.get(r))
    where = {s: low[root.get(k, k)] for k, s in enumerate(keys)}
    out = []
    for d, t in rows:
        s = shingles(t, n)
        c = where[s] if s else d
        out.append((d, len(s), c, d == c))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    common = rnd.choices(vocabulary, k=60)  # a passage that many share
    rows, base = [], None
    for k in range(260):
        if k % 4 == 0 or base is None:
            base = rnd.choices(vocabulary, k=rnd.randint(3, 120))
            if k % 8 == 0:
                base = base + common
        words = list(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((k, (" ".join(words)).upper() if k % 7 == 0 else "\n ".join(words)))
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE\x0btwo"), (5, rows[5][1]), (5, rows[5][1]), (None, "lonely null id"), (6, "same id, another text")]


@pytest.mark.parametrize("words,tile", [(4, 128), (5, 8)])
def test_minhash_equals_brute_force(spark, corpus, words, tile):
    df = spark.createDataFrame([(d, t, "x", "k") for d, t in corpus], "doc_id long, text string, key string, sig string").repartition(3)
    got = sorted(map(tuple, minhash.near_duplicates(df, words=words, percent=80, tile=tile).collect()), key=repr)
    want = [(d, n, c, k or d is None and c is None) for d, n, c, k in brute(corpus, words, 80)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("tile", [4, 64])
def test_minhash_tiles_alone_find_all_components(spark, tile):
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 1 << 30, 64).astype(np.int32)
    base = rng.integers(0, 1 << 60, 90).astype(np.uint64)
    sets, rows = {}, []
    for k in range(40):
        own, part = sig.copy(), base.copy()
        own[:20] = k
        part[rng.choice(90, 3 + k % 9, replace=False)] = rng.integers(0, 1 << 60, 3 + k % 9).astype(np.uint64)
        sets[bytes([k]) * 16] = np.unique(part)
        rows.append((bytes([k]) * 16, own.tolist()))
    comp = {k: k if n % 3 else rows[0][0] for n, (k, _) in enumerate(rows)}
    classes = spark.createDataFrame(rows, "key binary, sig array<int>")
    posts = spark.createDataFrame([(1, 7, k, comp[k]) for k, _ in rows], "c int, v int, key binary, comp binary")
    full = spark.createDataFrame([(k, x.tobytes()) for k, x in sets.items()], "key binary, shingles binary")
    got = [(bytes(a), bytes(b)) for a, b in minhash._tiled(posts, classes, full, 38, 80, tile).collect()]
    alike = [(a, b) for a in sets for b in sets if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert set(got) <= set(alike)
    same = lambda pairs: {x: y for x, y in union([*pairs, *comp.items()]).items()}
    assert same(got) == same(alike)


def staged_rows(monkeypatch, name):
    """Rows of the stage tables of a name, as they are written."""
    counts, write = [], minhash.stage

    def counted(df, own):
        out = write(df, own)
        if own == name:
            counts.append(out.count())
        return out

    monkeypatch.setattr(minhash, "stage", counted)
    return counts


def test_a_pair_is_compared_in_one_of_its_lists(spark, monkeypatch):
    """24 texts that share all 20 lists: each pair counts in the list of the highest order alone."""
    kept = staged_rows(monkeypatch, "kept")
    keys = [bytes([k]) * 16 for k in range(24)]
    classes = spark.createDataFrame([(k, list(range(64))) for k in keys], "key binary, sig array<int>")
    posts = spark.createDataFrame([(c, c, k, k) for c in range(20) for k in keys], "c int, v int, key binary, comp binary")
    sets = spark.createDataFrame([(k, np.array([n, *range(100, 120)], np.uint64).tobytes()) for n, k in enumerate(keys)], "key binary, shingles binary")
    links = [(bytes(a), bytes(b)) for a, b in minhash._tiled(posts, classes, sets, 32, 80, 256).collect()]
    assert set(union(links)) == set(keys) and len(set(union(links).values())) == 1
    assert kept == [23 + 24]  # a tile of the smaller components, and one of theirs with the largest's


def test_edited_copies_meet_their_original_first(spark):
    """The hub of a list is the member whose pairs are held most often, wherever its key stands."""
    original, copies = b"m" * 16, [bytes([k]) * 16 for k in (1, 7, 250)]
    texts = [" ".join(f"e{n}" if n and at == 9 * n else f"w{at}" for at in range(90)) for n in range(4)]
    rows = [(k, minhash.signature(minhash.Shingler(5).hashes(t)).tolist()) for k, t in zip([original, *copies], texts, strict=True)]
    posts = minhash.posting_prefixes(spark.createDataFrame(rows, "key binary, sig array<int>"), 64, 32)
    whole = posts.groupBy("c", "v").count().where("count = 4")
    posts = posts.join(whole, ["c", "v"], "left_semi").withColumn("comp", F.col("key"))
    got = {frozenset((bytes(a), bytes(b))) for a, b in minhash._hub_pairs(posts, 0).select("a", "b").collect()}
    assert got == {frozenset((original, k)) for k in copies}


def test_minhash_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = minhash.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert list(map(tuple, only)) == [(1, 0, 1, True)]


def test_near_duplicates_are_dropped_row_by_row(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    near = lambda name: text(name).replace(f"{name}59", "other")
    rows = [(2, text("b")), (6, text("a")), (6, text("b")), (None, text("c")), (None, text("c")), (None, near("c")), (None, near("a")), (7, ""), (7, None), (None, " "), (9, text("d")), (9, text("d")), (3, "x " * 600_000)]
    names = ["row_hash", "_n", "root", "key", "n_shingles", "component_id", "kept", "Row_Hash_"]
    df = spark.createDataFrame([(*r, *names) for r in rows], ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]])).repartition(3)
    out = minhash.without_near_duplicates(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    c = next(t for i, t in got if i is None and t.startswith("c0"))
    assert c in (text("c"), near("c"))
    assert got == sorted([(2, text("b")), (6, text("a")), (None, c), (7, ""), (7, None), (None, " "), (9, text("d")), (3, "x " * 600_000)], key=repr)
    assert minhash.without_near_duplicates(df.where("false")).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = [(k, (v * rng.uniform(0.5, 2)).astype(np.float32).tolist()) for k, v in enumerate(base)]
    rows += [(100 + k, (base[k % 5] + rng.normal(size=16) * 0.12).astype(np.float32).tolist()) for k in range(60)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, [0.0] * 16), (204, [float("nan")] * 16), (205, [None] * 16), (206, []), (207, [1.0, 0.0]), (208, [1.0, 0.1]), (209, [float("inf")] + [0.0] * 15), (None, rows[7][1])]
    v = {i: np.array(x, float) for i, x in rows if i is not None and i < 202}
    ids = sorted(v)
    extra = {207: [208], 208: [207], 7: [None]}
    links = {i: [j for j in ids if j != i and v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) >= 0.9] for i in ids}
    root = union([(i, j) for i in ids for j in links[i]] + [(207, 208)])
    df = spark.createDataFrame([(i, x, "a") for i, x in rows], "vec_id long, embedding array<float>, key string").repartition(3)
    got = {r.vec_id: r for r in vectors.near_duplicates(df, recall=0.9999).collect()}
    assert len(got) == len(rows)
    for i in [r[0] for r in rows if r[0] is not None]:
        want = len(links.get(i, [])) + len(extra.get(i, []))
        if 7 in links.get(i, []):
            want += 1  # the row without an id is a copy of 7
        assert (got[i].n_links, got[i].component_id) == (want, root.get(i, i)), i
        assert got[i].kept == (root.get(i, i) == i)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_at_the_default_setting(spark):
    """Several thousand vectors in more than 16 cells, partners from the threshold on."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(1500, 24))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.normal(size=(1500, 24))
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    near = rng.uniform(0.9, 0.99, 1500)[:, None]
    v = np.concatenate([base, near * base + np.sqrt(1 - near**2) * side]).astype(np.float32)
    assert vectors.codewords(len(v)) ** 2 > 16
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df).collect()}
    unit = v.astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    assert all(got[k] <= n for k, n in enumerate(want.tolist()))
    assert sum(got.values()) >= 0.98 * want.sum() > 0


def test_traversal_visits_nearest_cells_in_order():
    rng = np.random.default_rng(1)
    index = vectors.Index((rng.normal(size=(9, 3)), rng.normal(size=(9, 3))), 81)
    a, b = index.distances(rng.normal(size=(4, 6)))
    for x, y in zip(a, b, strict=True):
        order = index.traverse(x, y, 81)
        sums = [x[c // 9] + y[c % 9] for c in order]
        assert sorted(order) == list(range(81)) and sums == sorted(sums)


def test_vectors_of_any_scale_are_linked(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 0.0]), (3, [1e-200, 0.0]), (4, [2e-200, 0.0]), (5, [0.0, 5e-324]), (6, [0.0, 7.0]), (7, [0.0, 0.0]), (8, [float("inf"), 1.0])]
    out = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8)}
