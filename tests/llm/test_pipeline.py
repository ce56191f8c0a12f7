"""The pipeline's stages on a small corpus, against plain counts."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
from lodestone.llm import mixing, toxicity
from lodestone.llm.common import stage
from tests.llm.test_dedup import brute, shingles, union


def corpus():
    rnd = random.Random(9)
    plain = ["".join(rnd.choice("abcdefghilmnorstu") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for k in range(330):
        words = rnd.choices(plain, k=60)
        if k % 3 == 0:
            for at in rnd.sample(range(60), 5):
                words[at] = rnd.choice(["idiot", "moron", "scum"])
        rows.append((k, " ".join(words), "en", f"s{k % 4}", 0))
        labels.append((k, int(k % 3 == 0)))
    for k in range(60):
        base = rows[k * 5]
        words = base[1].split()
        words[3] = "changed"
        rows.append((400 + k, " ".join(words) if k % 2 else base[1], "en", "hot", 0))
    return rows + [(500, None, "en", None, 0), (501, "", "en", "hot", 0), (rows[1])], labels


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "mix", "bpe"]

    clean = stage(corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)), "t")
    assert clean.columns == docs.columns
    kept = {r.doc_id for r in clean.collect()}
    bad = {r[0] for r in rows if any(s in (r[1] or "") for s in ("idiot", "moron", "scum"))}
    assert len(kept & bad) <= 0.05 * len(bad) and len({r[0] for r in rows} - bad - kept) <= 0.05 * len(rows)
    scores = {r.doc_id: r.predicted for r in toxicity.scores(docs, toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()}
    assert kept == {d for d, p in scores.items() if p == 0}

    single = stage(corpus_pipeline.drop_near_duplicates(spark, clean, str(tmp_path)), "d")
    want = {d for d, _, _, k in brute([(r.doc_id, r.text) for r in clean.collect()], 5, 80) if k}
    got = [r.doc_id for r in single.collect()]
    assert single.columns == docs.columns and sorted(got) == sorted(want)

    mixed = stage(corpus_pipeline.mix(spark, single, str(tmp_path)), "m")
    assert mixed.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.mix(single).collect()}
    words: dict = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
    assert {d: w for d, w in words.items() if w} == {d: t for d, t in taken.items() if t}

    coded = corpus_pipeline.encode(spark, mixed, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in coded) == sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in mixed.collect())

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, coded))


def test_repeated_ids_are_judged_row_by_row(spark, tmp_path):
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    near = lambda name: text(name).replace(f"{name}59", "other")
    rows = [
        (1, text("a")), (7, near("a")), (7, text("b")),  # one of id 7 is a near-duplicate of 1, the other is its own
        (8, text("c")), (8, text("d")), (8, text("d")), (8, near("d")), (9, text("c")),  # two groups of one smallest id
        (10, ""), (10, text("e")), (10, None), (None, text("a")), (None, ""), (None, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    d = next(t for i, t in got if i == 8 and t != text("c"))
    assert d in (text("d"), near("d"))
    want = [(1, text("a")), (7, text("b")), (8, text("c")), (8, d), (10, ""), (10, None), (10, text("e")), (None, ""), (None, "")]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_rows_of_any_kind_reach_the_end(spark, tmp_path):
    """Null and repeated ids, two texts under one id, repeated rows and columns of clashing names."""
    rows, labels = corpus()
    rows = rows[:120] + [(None, rows[1][1], "en", "s1", 0), (None, "all of its own " * 9, "en", None, 0), (None, None, None, None, None), (2, "another text under this id " * 7, "en", "s2", 0), rows[2], rows[2], (600, "w " * 500_000, "en", "long", 0)]
    extra = ["_row", "_words", "_runs", "_text", "_doc", "_n", "_hash", "row_hash", "row"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in extra)
    spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = stage(corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)), "t")
    single = stage(corpus_pipeline.drop_near_duplicates(spark, clean, str(tmp_path)), "d")
    mixed = stage(corpus_pipeline.mix(spark, single, str(tmp_path)), "m")
    assert docs.columns == clean.columns == single.columns == mixed.columns
    before = [(r.doc_id, r.text) for r in clean.collect()]
    after = [(r.doc_id, r.text) for r in single.collect()]
    assert set(after) <= set(before)
    # brute() names each row's group by its smallest id, which need not tell groups of one id apart: count by sets
    sets = {shingles(t, 5) for _, t in before if shingles(t, 5)}
    linked = union((hash(a), hash(b)) for a in sets for b in sets if a != b and 100 * len(a & b) >= 80 * len(a | b))
    groups = {linked.get(hash(s), hash(s)) for s in sets}
    assert sorted(linked.get(hash(s), hash(s)) for _, t in after if (s := shingles(t, 5))) == sorted(groups)
    assert sum(not shingles(t, 5) for _, t in after) == sum(not shingles(t, 5) for _, t in before)
    words = lambda frame: sum(len((r.text or "").split()) for r in frame.collect())
    assert words(mixed) == sum(r.taken for r in mixing.mix(single).collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == mixed.count()


def test_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
