"""Periodic runs, language identification and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid, periodic, variants

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def plain_runs(w: list) -> set[tuple[int, int, int]]:
    """Runs by the definition: every lag, every stretch, every smaller period."""
    out = set()
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            own = w[i : j + q]
            if j > i and len(own) >= max(24, 3 * q) and not any(own[r:] == own[:-r] for r in range(1, q)):
                out.add((i, len(own), q))
            i = max(j, i + 1)
    return out


def test_runs_equal_the_definition():
    rnd = random.Random(1)
    for _ in range(400):
        n, k = rnd.randint(0, 160), rnd.choice([1, 2, 3, 10])
        w = [str(rnd.randint(0, k)) for _ in range(n)]
        for _ in range(rnd.randint(0, 3) if n else 0):
            a = rnd.randrange(n)
            p = 1 + rnd.randrange(max(1, (n - a) // 2))
            for i in range(a + p, min(n, a + p * rnd.randint(2, 9))):
                w[i] = w[i - p]
        parts = rnd.choice([1, 3, 4])
        assert set().union(*[periodic.find_runs(periodic.numbers(w), x, parts) for x in range(parts)]) == plain_runs(w)


def test_runs_of_very_long_texts():
    assert periodic.find_runs(np.zeros(300_000, np.int32)) == {(0, 300_000, 1)}
    ids = np.arange(400_000, dtype=np.int32)
    ids[100_000:] = 100_000 + np.arange(300_000) % 70_000
    assert periodic.find_runs(ids) == {(100_000, 300_000, 70_000)}


def test_periodic_rows(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 90))), "x") for k in range(60)]
    rows += [(100, "a b " * 40 + "c\x0b\x0cd é", "x"), (100, "a b " * 40 + "c\x0b\x0cd é", "x"), (None, "z " * 30, "x"), (101, None, "x"), (102, "", "x"), (103, " \t\n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, RUNS string")
    planted = periodic.with_repetition(docs)
    got = {}
    for long_chars, ranges in ((10, 3), (1 << 16, 4)):
        out = periodic.digests(periodic.periodic_runs(planted, long_chars=long_chars, ranges=ranges)).collect()
        got[long_chars] = sorted(map(str, out))
    assert got[10] == got[1 << 16]
    want = []
    for doc_id, text, _ in rows:
        w = [x for x in periodic.words_of(text)]
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
        top = periodic.strongest(runs)
        dropped = {i for s, m, p in runs for i in range(s + p, s + m)}
        kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
        want.append((doc_id, len(runs), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, want))
    assert periodic.digests(periodic.periodic_runs(planted.where("false"))).count() == 0


def test_strongest_compares_exactly():
    assert periodic.strongest([(9, 40, 10), (0, 30, 10), (3, 28, 7)]) == (3, 28, 7)
    assert periodic.strongest([]) is None


def every_cut(word: str, names: dict[str, float], unknown: float) -> float:
    """Probability of a word as the plain sum over all its segmentations."""
    total = 0.0
    for bits in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for k, b in enumerate(bits, 1):
            if b:
                parts.append(word[at:k])
                at = k
        parts.append(word[at:])
        p = 1.0
        for x in parts:
            p *= names.get(x, unknown if len(x) == 1 else 0.0)
        total += p
    return total


def test_word_scores_sum_all_segmentations():
    pieces = langid._pieces(PIECES)
    rnd = np.random.default_rng(3)
    score = np.log(rnd.random((2, len(pieces.names) + 1)) / 1000)
    score[:, -1] = langid.UNKNOWN
    model = langid.Model(PIECES, ("a", "b"), score, np.log([0.5, 0.5]))
    words = ["the", "mentation", "éçole", "wh", "ǁx", "a"]
    got = model.word_scores(words)
    for lang in (0, 1):
        names = dict(zip(pieces.names, np.exp(score[lang]), strict=False))
        for w, x in zip(words, got[:, lang], strict=True):
            plain = every_cut("▁" + w, {p: v for p, v in names.items() if p in "▁" + w}, math.exp(langid.UNKNOWN))
            assert math.isclose(x, math.log(plain), rel_tol=1e-9)
    assert np.isfinite(model.word_scores(["ab" * 5_000])).all()


def test_expected_counts_are_shares_of_segmentations():
    pieces = langid._pieces(PIECES)
    score = np.log(np.random.default_rng(4).random((1, len(pieces.names) + 1)))
    got = langid.expected(pieces, ["then", "on"], np.array([3, 5]), np.array([0, 0]), score)
    names = {p: v for p, v in zip(pieces.names, np.exp(score[0]), strict=False)}
    for piece in ("▁the", "n", "▁on", "en"):
        plain = 0.0
        for word, times in (("▁then", 3), ("▁on", 5)):
            inside = {p: v for p, v in names.items() if p in word}
            whole = every_cut(word, inside, 0)
            for at in range(len(word)):
                if word.startswith(piece, at):
                    left, right = word[:at], word[at + len(piece) :]
                    plain += times * names[piece] * (every_cut(left, inside, 0) if left else 1) * (every_cut(right, inside, 0) if right else 1) / whole
        assert abs(got[0, pieces.names.index(piece)] / langid.PARTS - plain) < 0.01


def test_language_rows(spark):
    rnd = random.Random(7)
    stems = {"xx": ["tion", "er", "ing", "the", "an"], "yy": ["eau", "ment", "oi", "que", "le"]}
    rows = []
    for k in range(300):
        lang = rnd.choice(["xx", "yy"])
        rows.append((k, " ".join("".join(rnd.choices(stems[lang], k=rnd.randint(1, 3))) for _ in range(rnd.choice([3, 30]))), lang, 0.5))
    rows += [(None, "tioner ing", "xx", 0.5), (900, None, "yy", 0.5), (901, "", "yy", 0.5), (902, "12 ?² ...", "xx", 0.5), (903, "eaument", None, 0.5), (5, rows[5][1], rows[5][2], 0.5), (904, "the" * 4000, "xx", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, SCORE double")
    model = langid.fit(docs, PIECES)
    assert model.languages == ("xx", "yy")
    out = langid.predict(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by_id = {r.doc_id: r for r in out}
    for doc_id in (900, 901, 902):
        assert (by_id[doc_id].lang_pred, by_id[doc_id].score) == ("und", 0.0)
    assert by_id[903].lang_pred == "yy" and by_id[None].lang_pred == "xx"
    aside = [(by_id[r[0]].lang_pred, r[2]) for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(aside) > 40 and np.mean([a == b for a, b in aside]) >= 0.98
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    again = langid.fit(docs.repartition(3), PIECES)
    assert (again.score == model.score).all()
    turned = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert (langid.fit(turned, PIECES).score == model.score).all()  # nothing of held-out rows is learnt
    none = langid.fit(docs.where("false"), PIECES)
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_wavelet_tree_reports_rectangles():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 300):
        ranks = rnd.permutation(n)
        a, b = np.sort(rnd.integers(0, n + 1, (2, 50)), axis=0)
        c, d = np.sort(rnd.integers(0, n + 1, (2, 50)), axis=0)
        q, r = variants.WaveletTree(ranks).report(a, b, c, d)
        assert sorted(zip(q.tolist(), r.tolist(), strict=True)) == sorted((k, int(x)) for k in range(50) for x in ranks[a[k] : b[k]] if c[k] <= x < d[k])


@pytest.mark.parametrize(("letters", "most_points"), [("ab", 1000), ("ab", 3), ("abéÿ", 4), ("abcdefgh", 1000)])
def test_near_words_equal_all_pairs(spark, letters, most_points):
    rnd = random.Random(3)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(6, 10))) for _ in range(150)}
    for w in sorted(words)[:80]:
        k = rnd.randrange(len(w))
        words |= {w[:k] + rnd.choice(letters) + w[k:], w[:k] + w[k + 1 :] if len(w) > 6 else w}
    counts = [(w, rnd.randint(5, 12)) for w in sorted(words)]
    got = {r.word: (r.n_near, r.near, r.near_n) for r in variants.near_words(spark.createDataFrame(counts, "word string, n long"), most_points, 50).collect()}
    want = {}
    for w, _ in counts:
        if others := [(-m, x) for x, m in counts if one_edit(w, x)]:
            want[w] = (len(others), min(others)[1], -min(others)[0])
    assert got == want


def test_variant_rows(spark):
    rnd = random.Random(11)
    base = ["receive", "separate", "éàüöîñ", "definite", "abcdef"]
    rows = []
    for k in range(1200):
        own = [w if rnd.random() > 0.1 else w[:2] + w[3:] for w in rnd.choices(base, k=4)]
        rows.append((k, " ".join(x.upper() if rnd.random() < 0.1 else x for x in own) + " short 7", 1))
    chain = ["aaaaaaaa"] * 5 + ["aaaaaaab"] * 25 + ["aaaaaabb"] * 125
    rows += [(5000, " ".join(chain), 1), (5001, "x" * 100_000 + ". " + ("y" * 3_000 + " ") * 6 + ("y" * 3_001 + ",") * 30, 1), (None, "receive " * 7, 1), (5002, None, 1), (5003, "", 1), (rows[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, WORD int")
    counts: Counter = Counter()
    for doc_id, text, _ in rows:
        for w in variants._RUN.findall((text or "").translate(variants._LOWER)):
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    form = {}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    for w in n:
        best = min(((-n[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 5 * n[w] else None
    want = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        want.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    assert {tuple(r) for r in variants.variant_groups(docs).collect()} == want
    assert ("aaaaaaaa", "aaaaaaab", "aaaaaabb", 5, 1, 25) in want
    assert variants.variant_groups(docs.where("false")).count() == 0
