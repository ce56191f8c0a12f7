"""Toxicity, url filter, WARC audit and mixing on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing, queries, toxicity, urlfilter, warc
from lodestone.llm.common import running

STEMS = ["idiot", "moron", "scum", "gromulk"]


@pytest.fixture(scope="module")
def posts():
    rnd = random.Random(2)
    plain = ["".join(rnd.choice("abcdefghilmnorstu") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for k in range(700):
        words = rnd.choices(plain, k=rnd.choice([8, 60, 200]))
        bad = k % 3 == 0
        if bad:
            for _ in range(max(2, len(words) // 40)):
                words[rnd.randrange(len(words))] = rnd.choice(STEMS) + rnd.choice(["", "s", "ic", "ish", "o"])
        rows.append((k, " ".join(words), "x"))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows_and_misspellings(posts):
    rows, labels = posts
    aside = [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows]
    model = toxicity.train([r[1] for r, a in zip(rows, aside, strict=True) if not a], [y for (_, y), a in zip(labels, aside, strict=True) if not a])
    score = toxicity.Scorer(model).score
    got = np.array(score([r[1] for r, a in zip(rows, aside, strict=True) if a])) >= toxicity.THRESHOLD
    want = np.array([y == 1 for (_, y), a in zip(labels, aside, strict=True) if a])
    assert (got == want).mean() >= 0.95
    assert min(score(["these idiotts moronn", "gromullk idioot"])) >= toxicity.THRESHOLD
    assert max(score(["", "these are fine rows"])) < toxicity.THRESHOLD


def test_toxicity_rows(spark, posts):
    rows, labels = posts
    docs = spark.createDataFrame([*rows, (None, "idiot moron", "x"), (701, None, "x"), (5, rows[5][1], "x")], "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (None, 1), (9, None), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    out = toxicity.scores(docs, model).collect()
    assert len(out) == 703 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in out)
    again = toxicity.fit(docs.repartition(3), known)
    assert (again.weight == model.weight).all() and again.bias == model.bias
    none = toxicity.fit(docs, known.where("false"))
    assert {r.predicted for r in toxicity.scores(docs, none).collect()} == {0}
    assert toxicity.scores(docs.where("false"), none).count() == 0


def test_training_sample_is_bounded(spark, posts):
    rows, labels = posts
    ids = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2][:20]
    many = [(ids[0][0], f"copy {k}", "x") for k in range(5000)] + [(ids[1][0], ids[1][1], "x")] * 5000
    docs = spark.createDataFrame([*ids, *many], "doc_id long, text string, _id string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.sample_rows(docs, known).collect()
    assert sorted(r._id for r in got) == sorted(r[0] for r in ids)
    assert next(r._text for r in got if r._id == ids[0][0]) in {ids[0][1], *(t for _, t, _ in many)}
    long = spark.createDataFrame([(ids[2][0], "w " * 5_000_000, "x")], docs.schema)
    sizes = {r._id: len(r._text) for r in toxicity.sample_rows(docs.where(f"doc_id <> {ids[2][0]}").unionByName(long), known, most_bytes=1_000_000).collect()}
    assert ids[2][0] not in sizes and len(sizes) == 19  # skipped whole
    assert {len(r._text) for r in toxicity.sample_rows(long, known).collect()} == {10_000_000}
    model = toxicity.fit(docs, known)
    out = toxicity.scores(long, model).collect()
    assert len(out) == 1 and 0 <= out[0].score <= 1


def test_labels_of_held_out_rows_change_nothing(spark, posts):
    rows, labels = posts
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    flipped = [(d, 1 - y if zlib.crc32(str(d).encode()) % 4 == 2 else y) for d, y in labels]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert (a.weight == b.weight).all()


PAGES = [
    (1, "http://a.Example.ORG/es/x?y", "<a href='http://far.net/'>"), (2, "https://example.org/en/12#t", ""), (3, "https://b.example.org/en/2", ""), (4, "http://shop.com/de/1", "<a href=\"https://good.org/a\">"),
    (5, "http://shop.com/it/1", None), (6, "http://x.shop.com/it/", ""), (7, "nowhere", ""), (8, None, "x"), (9, "http://far.net/q", "<A HREF=http://Shop.com/de/1>"), (10, "http://notorg/", ""), (11, "http://org", ""),
    (12, "http://org/", ""), (None, "http://good.org/p", ""), (5, "http://shop.com/it/1", None), (13, "http://h.net?x/fr/", ""), (14, "ftp://u@com:8/fr/", ""),
]


def test_url_rules_and_propagation(spark, tmp_path):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, host string")
    got = sorted(map(tuple, urlfilter.judge(df).collect()), key=repr)
    con = duckdb.connect()
    df.drop("host").toPandas().to_parquet(tmp_path / "p.parquet")
    con.execute(f"create view pages as select * from '{tmp_path}/p.parquet'")
    assert got == sorted(con.sql(urlfilter.judge_sql()).fetchall(), key=repr)
    by = {r[0]: r[1:] for r in got}
    assert by[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and by[2][2:] == ("example.org/en/1", "block") and by[3][2:] == ("org/", "allow")
    assert by[4][2:] == ("com/de/", "block") and by[5][2] is None
    assert by[7] == ("", "", None, "allow") and by[8] == ("", "", None, "allow") and by[10][2] is None and by[11] == ("org", "", None, "allow")
    assert urlfilter.judge(df.where("false")).count() == 0


def test_pagerank_against_numpy(spark):
    rnd = random.Random(6)
    hosts = [f"h{k}.t{k % 4}" for k in range(14)]
    edges = sorted({(rnd.choice(hosts), rnd.choice(hosts)) for _ in range(40)} - {(h, h) for h in hosts})
    trust, bad = np.array([k % 5 == 0 for k in range(14)], float), np.array([k % 7 == 3 for k in range(14)], float)
    a = np.zeros((14, 14))
    for s, d in edges:
        a[hosts.index(s), hosts.index(d)] = 1
    t0, d0 = trust / trust.sum(), bad / bad.sum()
    t, d = t0, d0
    out = np.divide(a, a.sum(1, keepdims=True), where=a.sum(1, keepdims=True) > 0, out=np.zeros_like(a))
    back = np.divide(a, a.sum(0, keepdims=True), where=a.sum(0, keepdims=True) > 0, out=np.zeros_like(a))
    for _ in range(300):
        t, d = 0.15 * t0 + 0.85 * (t @ out), 0.15 * d0 + 0.85 * (back @ d)
    got = {r.host: r for r in urlfilter.propagate(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(h, float(x), float(y)) for h, x, y in zip(hosts, trust, bad, strict=True)], "host string, trust double, distrust double")).collect()}
    for k, h in enumerate(hosts):
        assert got[h].trust == pytest.approx(t[k], abs=2e-6) and got[h].distrust == pytest.approx(d[k], abs=2e-6)


def test_trust_settles_along_a_chain(spark):
    """Distrust from the far end must not outweigh trust that is still on its way: after 8 rounds h6 would be blocked."""
    edges = [(f"h{k}", f"h{k + 1}") for k in range(14)] + [(f"h{k + 1}", f"h{k}") for k in range(14)]
    seeds = [(f"h{k}", float(k == 0), float(k == 14)) for k in range(15)]
    a = np.zeros((15, 15))
    for s, d in edges:
        a[int(s[1:]), int(d[1:])] = 1
    t, d = t0, d0 = np.eye(15)[0], np.eye(15)[14]
    out, back = a / a.sum(1, keepdims=True), a / a.sum(0, keepdims=True)
    for _ in range(400):
        t, d = 0.15 * t0 + 0.85 * (t @ out), 0.15 * d0 + 0.85 * (back @ d)
    got = {r.host: r for r in urlfilter.propagate(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "host string, trust double, distrust double")).collect()}
    assert all(abs(got[f"h{k}"].trust - t[k]) < 2e-6 and abs(got[f"h{k}"].distrust - d[k]) < 2e-6 for k in range(15))
    alone = urlfilter.propagate(spark.createDataFrame([], "src string, dst string"), spark.createDataFrame(seeds, "host string, trust double, distrust double")).collect()
    assert {r.host: (r.trust, r.distrust) for r in alone}["h0"] == pytest.approx((0.15, 0.0))


def test_toxicity_scores_equal_a_plain_sum(spark, posts):
    """Scores are the worst window's mean of word means of bucket weights, words said again within a window being silent."""
    rnd = np.random.default_rng(8)
    model = toxicity.Model(rnd.normal(size=toxicity.BUCKETS).astype(np.float32).astype(float), -0.4)
    texts = [posts[0][k][1] for k in range(12)] + ["", "so so so", "idiot " * 60, "Über naïve " + "x" * 5_000]
    got = {r.doc_id: r.score for r in toxicity.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        words = toxicity.words_of(text)
        values = []
        for at, w in enumerate(words):
            marked = f"<{w}>"
            own = [model.weight[toxicity.gram_buckets([w])[0][j]] for j in range(sum(max(0, len(marked) - n + 1) for n in toxicity.GRAMS))]
            values.append(0.0 if w in words[max(0, at - toxicity.WINDOW + 1) : at] else sum(own) / len(own))
        windows = [values[a : a + toxicity.WINDOW] for a in range(max(1, len(values) - toxicity.WINDOW + 1))] if values else []
        worst = max((sum(x) / len(x) for x in windows), default=0.0)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(worst + model.bias))), abs=1e-9)


def test_warc_audit_finds_each_fault(spark):
    rows = [(k, f"http://h/{k}", "ü" * (k % 50)) for k in range(700)] + [(None, None, None), (5, "http://h/5", "again"), (5, "http://h/5", "again")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, shard string").repartition(4)
    replica = warc.write(pages)
    assert warc.audit(replica, replica).where("damaged").count() == 0
    out = warc.audit(replica, warc.with_faults(replica, 97)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.damaged == (zlib.crc32(("" if r.page_id is None else str(r.page_id)).encode()) % 97 == 0)
    ordered = sorted(out, key=lambda r: r.offset)
    assert [r.offset for r in ordered] == np.cumsum([0, *[r.length for r in ordered[:-1]]]).tolist()
    record = replica.where("page_id = 7").first().record
    assert hashlib.sha256(bytes(record)).hexdigest() == next(r.sha256 for r in out if r.page_id == 7)
    head, _, body = bytes(record).partition(b"\r\n\r\n")
    assert b"Content-Length: 14" in head and body == ("ü" * 7).encode() + b"\r\n\r\n"
    gone = replica.where("page_id <> 9 or page_id is null")
    assert warc.audit(replica, gone).where("damaged and page_id = 9").count() == 1
    assert warc.audit(replica.where("false"), replica.where("false")).count() == 0


def test_warc_audit_of_a_tall_tree(spark):
    """Two layers in a shard, one above them; records changed, missing, extra, moved and a shard gone."""
    n = 4096 * 2 + 40
    long = spark.range(n).select(F.when(F.col("id") < n - 5, 0).otherwise(F.col("id") % 3 + 1).cast("int").alias("shard"), F.when(F.col("id") < n - 5, F.col("id")).otherwise(F.col("id") % 2).alias("seq"), F.col("id").alias("page_id"), F.encode(F.concat(F.lit("r"), "id"), "UTF-8").alias("record"))
    long = long.dropDuplicates(["shard", "seq"])
    rows = {(r.shard, r.seq): (r.page_id, bytes(r.record)) for r in long.collect()}
    other = dict(rows)
    other[0, 4100] = (4100, b"R4100")  # the same length
    other[0, 17] = (17, b"r17 longer")  # moves what follows
    del other[0, 8200]
    other[0, 8300] = (1, b"extra")
    other = {k: v for k, v in other.items() if k[0] != 2}
    frame = spark.createDataFrame([(*k, *v) for k, v in other.items()], "shard int, seq long, page_id long, record binary")
    la, lb = warc.leaves(long), warc.leaves(frame)
    ta, tb = warc.tree(la), warc.tree(lb)
    assert (ta.inner, len(ta.layers)) == (2, 3) and ta.root() != tb.root() and ta.root() == warc.tree(warc.leaves(long)).root()
    assert {r.shard for r in ta.shard_roots().exceptAll(tb.shard_roots()).collect()} == {0, 2}

    def placed(table):
        at, out = {}, {}
        for (shard, seq), (_, data) in sorted(table.items()):
            out[shard, seq] = (at.get(shard, 0), data)
            at[shard] = at.get(shard, 0) + len(data)
        return out

    x, y = placed(rows), placed(other)
    want = {k for k in x.keys() | y.keys() if x.get(k) != y.get(k)}
    assert {tuple(r) for r in warc.damaged(ta, tb).collect()} == want
    short = warc.tree(warc.leaves(long.where("seq < 9")))
    assert {tuple(r) for r in warc.damaged(ta, short).collect()} == {k for k in rows if k[1] >= 9}


def test_warc_record_of_a_long_text(spark):
    pages = spark.createDataFrame([(1, "u", "ab" * 1_000_000)], "page_id long, url string, html string")
    r = warc.audit(warc.write(pages), warc.write(pages)).first()
    assert r.length > 2_000_000 and not r.damaged


@pytest.fixture(scope="module")
def sources():
    rnd = random.Random(8)
    rows = []
    for k in range(300):
        source = "hot" if k % 3 == 0 else f"s{k % 7}"
        rows.append((k, " \n".join(f"w{rnd.randrange(99)}" for _ in range(rnd.choice([0, 1, 30, 90, 400]))), "en", source, 0))
    return rows + [(300, None, "en", "hot", 0), (301, "a b", "en", None, 0), (302, " c  d ", None, None, 0), (303, "x " * 5000, "en", "zz", 0), (304, "", "en", "empty", 0)]


def test_mix_meets_targets_and_sql(spark, sources, tmp_path):
    df = spark.createDataFrame([(*r, 1) for r in sources], "doc_id long, text string, lang string, source string, n_chars long, size int").repartition(3)
    got = mixing.mix(df).collect()
    df.drop("size").toPandas().to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d.parquet'")
    want = con.sql(mixing.mix_sql()).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)
    total = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        t = total.setdefault((r.source_size, r.target), [0])
        t[0] += r.taken
    assert sum(t for _, t in total) == pytest.approx(sum(r.size for r in got))
    for (size, target), (taken,) in total.items():
        assert target <= 3 * size and abs(taken - target) <= 3 * mixing.BLOCK
    assert sorted(map(tuple, mixing.mix(df.repartition(5)).collect())) == sorted(map(tuple, got))
    assert mixing.mix(df.where("false")).count() == 0


def test_targets_by_repeated_sharing(spark):
    rnd = random.Random(4)
    sizes = {f"s{k:02}": rnd.choice([1, 10, 1000, 5000]) for k in range(23)} | {None: 400}
    names = sorted([s for s in sizes if s]) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = (total - sum(capped.values())) / sum(w for s, w in weight.items() if s not in capped)
        over = [s for s in names if s not in capped and rest * weight[s] > 3 * sizes[s]]
        if not over:
            break
        capped |= {s: 3 * sizes[s] for s in over}
    got = {r.source: r.target for r in mixing._targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    for s in names:
        assert got[s] == pytest.approx(capped.get(s, rest * weight[s]))


def test_permutations(spark):
    for n in (1, 2, 7, 100, 1023):
        out = [r.at for r in mixing.with_permuted(spark.range(n), "id", f"{n}L", "5L", "at").collect()]
        assert sorted(out) == list(range(n))
    assert out != list(range(n))


def test_mixed_documents_hold_what_was_taken(spark, sources):
    df = spark.createDataFrame(sources, "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words: dict = {}
    texts = {r[0]: r[1] for r in sources}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
        assert r.n_chars is None or r.n_chars == len(r.text)
        if r.text is not None:
            rest = iter((texts[r.doc_id] or "").split())
            assert all(w in rest for w in r.text.split())  # in order
    assert words == {d: t for d, t in taken.items() if t or not (texts[d] or "").split()}


def test_running_sums(spark):
    rnd = random.Random(6)
    values = [(k, rnd.randrange(100)) for k in rnd.sample(range(1000), 300)]
    got = running(spark.createDataFrame(values, "part long, n long").repartition(5), [F.col("part").desc()], {"before": F.col("n"), "rank": F.lit(1)}).collect()
    total = 0
    for rank, (k, n) in enumerate(sorted(values, reverse=True)):
        assert next(tuple(r) for r in got if r.part == k) == (k, n, total, rank)
        total += n
    assert len(got) == 300


def test_shards_hold_multinomial_counts(spark):
    """Given exact totals, a shard's counts are a draw without replacement: near their shares, and no two alike by rule."""
    sizes = spark.createDataFrame([(f"s{k}", 128 * n) for k, n in enumerate((4000, 9000, 2500, 12000))], "source string, source_size long")
    by_source = mixing._targets(sizes)
    slots = {r["rank"]: r.slots for r in by_source.collect()}
    total, per = sum(slots.values()), {}
    for r in mixing.shard_counts(mixing.draws(spark, by_source)).collect():
        per.setdefault(r["shard"], {})[r["rank"]] = r.n
    assert all(sum(v.values()) == mixing.SHARD for k, v in per.items() if k < total // mixing.SHARD)
    assert {k: sum(v.get(k, 0) for v in per.values()) for k in slots} == slots
    full = [v for k, v in per.items() if k < total // mixing.SHARD]
    z = [(v.get(k, 0) - mixing.SHARD * s / total) / (mixing.SHARD * s / total * (1 - s / total)) ** 0.5 for v in full for k, s in slots.items()]
    assert max(map(abs, z)) < 5 and 0.6 < np.std(z) < 1.4


def test_mixed_documents_with_clashing_columns(spark, sources):
    named = ["row", "words", "runs", "whole", "_row", "_words", "_runs", "_text", "_doc", "pass", "block", "uses", "ROW_"]
    df = spark.createDataFrame(sources, "doc_id long, text string, lang string, source string, n_chars long")
    plain = sorted(map(repr, mixing.mixed_documents(df).collect()))
    wide = mixing.mixed_documents(df.withColumns({n: F.lit(n) for n in named}))
    assert wide.columns == [*df.columns, *named]
    assert sorted(map(repr, wide.select(df.columns).collect())) == plain


def test_mixed_documents_tell_rows_of_null_and_repeated_ids_apart(spark):
    rows = [(None if k % 3 else k % 2, " ".join(f"w{k}x{j}" for j in range(40 + 31 * k)), f"row{k}", f"s{k % 3}", 0) for k in range(12)]
    rows += [(None, None, "none", "s0", None), (None, "", "empty", "s0", 0), (None, " ", "blank", "s1", 1), (0, "", "named", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    texts = {r[2]: r[1] for r in rows}
    got: dict = {}
    for r in mixing.mixed_documents(df).collect():
        rest = iter((texts[r.lang] or "").split())
        assert all(w in rest for w in (r.text or "").split())  # its own words, in order
        got.setdefault(r.lang, []).append(len((r.text or "").split()))
    assert all(len(n) <= mixing.MOST_PASSES for n in got.values())
    assert all(got[k] == [0] for k in ("none", "empty", "blank", "named"))
    want = sorted((r.size, r.taken) for r in mixing.mix(df).collect())
    assert sorted((len((t or "").split()), sum(got.get(k, []))) for k, t in texts.items()) == want


def test_queries_and_sql_agree_in_names():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
