"""MinHash near-duplicates by an inverted join over signature coordinates.

Documents with the same shingle set are one class. Each class posts itself under the
(coordinate, value) pairs of its signature. Two classes that agree in MATCHES of
COORDINATES coordinates share a pair among the rarest COORDINATES - MATCHES + 1 of
either, in any one order of all pairs; so only that prefix is joined, rare pairs first,
and the rest of the coordinates is counted by comparing signatures. What passes is
confirmed on the full sets.

A posting list is not expanded into all its pairs: its members meet its hub, links are
contracted into components, and only lists that still hold several components are
looked at again, with other hubs, and at last in tiles, which find every link between
components that is left but return no more of them than join the components.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import columns, components, drop_stage, free_names, sole, stage, text_batches

#: Signature length and the collisions that make a candidate: at a similarity of 0.8, 51 of 64 are expected; fewer than 32 come once in 50 million pairs.
COORDINATES, MATCHES = 64, 32
#: Turns of hub meetings before the tiles, and the lists in which a member meets a hub in one turn.
TURNS, MEETINGS = 2, 3
#: Members of a block; a tile has two.
TILE = 256
#: Orders of lists are multiples of this plus the coordinate.
_ORDER = 4096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
KEPT_WORDS = 250_000


@lru_cache(4)
def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2)
    return rng.integers(1, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, np.uint64)


class Shingler:
    def __init__(self, words: int):
        self.words, self.known = words, {}

    def hashes(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles; of all words if they are fewer."""
        ws = text.encode().translate(_LOWER).split()
        if not ws:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in ws:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.array([known[w] for w in ws], np.uint64)
        n = min(self.words, len(ids))
        h = np.full(len(ids) - n + 1, len(ws) if n < self.words else self.words, np.uint64)
        for j in range(n):
            h = (h ^ ids[j : len(ids) - n + 1 + j]) * _MIX
            h ^= h >> np.uint64(31)
        return np.unique(h * np.uint64(0xD6E8FEB86659FD93))


def signature(hashes: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """Minimum under each of k hash functions, as signed 32-bit integers."""
    a, b = _coefficients(k)
    low = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        low = np.minimum(low, (part[None, :] * a[:, None] + b[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _shingler(words: int) -> Shingler:
    return sole(("shingler", words), lambda: Shingler(words))


def row_hash(id_col: str, text_col: str) -> Column:
    """Rows of one id and one text have the same; null and the empty text do not."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.col(text_col).isNull())


def signed(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_hash (of id and text), n_shingles, key (digest of the set, null if it is empty), sig."""

    def run(batches):
        s = _shingler(words)
        for b in batches:
            for start, texts in text_batches(b.column(1)):
                sets = [s.hashes(t) for t in texts]
                yield pa.record_batch(
                    {
                        "doc_id": b.column(0).slice(start, len(sets)),
                        "row_hash": b.column(2).slice(start, len(sets)),
                        "n_shingles": pa.array(map(len, sets), pa.int64()),
                        "key": pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                        "sig": pa.array([signature(x) if len(x) else None for x in sets], pa.list_(pa.int32())),
                    }
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, row_hash(id_col, text_col)).mapInArrow(run, f"doc_id {kind}, row_hash long, n_shingles long, key binary, sig array<int>")


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """key, shingles (sorted 64-bit hashes) of key, text rows."""

    def run(batches):
        s = _shingler(words)
        for b in batches:
            for start, texts in text_batches(b.column(1)):
                yield pa.record_batch({"key": b.column(0).slice(start, len(texts)), "shingles": pa.array([s.hashes(t).tobytes() for t in texts], pa.binary())})

    return docs.select("key", "text").mapInArrow(run, "key binary, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are alike to percent."""
    left, right = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def posting_prefixes(classes: DataFrame, k: int, matches: int) -> DataFrame:
    """c, v, key, held: for each class the pairs of its prefix that another class holds as well, and how often all its pairs are held."""
    posts = classes.select("key", F.posexplode("sig").alias("c", "v"))
    counts = posts.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1")
    shared = posts.join(counts, ["c", "v"]).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "c", "v"))).alias("p"), F.sum("n").alias("held"))  # k items at most
    # pairs that no other class has are the rarest, so they fill the prefix first
    room = F.lit(k - matches + 1) - (F.lit(k) - F.size("p"))
    return shared.where(room > 0).select("key", "held", F.explode(F.slice("p", 1, room)).alias("p")).select("p.c", "p.v", "key", "held")


def _alike(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Of pairs (a, b), those that agree in so many coordinates."""
    own, other = classes.select(F.col("key").alias("a"), F.col("sig").alias("ga")), classes.select(F.col("key").alias("b"), F.col("sig").alias("gb"))
    same = F.size(F.filter(F.zip_with("ga", "gb", lambda x, y: x == y), lambda x: x))
    return pairs.join(own, "a").join(other, "b").where(same >= matches).select("a", "b")


def _hub_pairs(posts: DataFrame, turn: int) -> DataFrame:
    """Pairs of members and hubs of posting lists (c, v, key, comp, at first held).

    At first a list's hub is the member whose pairs are held most often, which of edited
    copies is their original or whatever is most like it. Later it is some member of the list's
    largest component, another in each list and turn, and is met by members of other
    components, each in MEETINGS of its lists.
    """
    if turn == 0:
        hubs = posts.groupBy("c", "v").agg(F.max(F.struct("held", "key")).alias("m")).select("c", "v", F.col("m.key").alias("hub"))
        met = posts.join(hubs, ["c", "v"]).where("key <> hub")
    else:
        largest = posts.groupBy("c", "v", "comp").agg(F.count("*").alias("n"), F.min_by("key", F.xxhash64("key", "c", "v", F.lit(turn))).alias("hub"))
        largest = largest.groupBy("c", "v").agg(F.max(F.struct("n", "comp", "hub")).alias("m")).select("c", "v", F.col("m.comp").alias("main"), F.col("m.hub").alias("hub"))
        met = posts.join(largest, ["c", "v"]).where(F.col("comp") != F.col("main"))
        met = met.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("c", "v", F.lit(turn))))).where(F.col("_n") <= MEETINGS)
    return met.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()


def _tiles(posts: DataFrame, tile: int) -> DataFrame:
    """Members of mixed posting lists dealt into tiles: c, v, i, j, side, key, comp.

    A list's largest component needs no look at itself. Its members and the others are
    cut into blocks by hash; a tile is a block of the others with another block.
    """
    n = posts.groupBy("c", "v", "comp").agg(F.count("*").alias("n"))
    sizes = n.groupBy("c", "v").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("all"))
    sizes = sizes.select("c", "v", F.col("m.comp").alias("main"), F.ceil(F.col("m.n") / tile).cast("int").alias("nd"), F.ceil((F.col("all") - F.col("m.n")) / tile).cast("int").alias("no"))
    dealt = posts.join(sizes, ["c", "v"]).withColumn("inner", F.col("comp") == F.col("main"))
    block = F.when(F.col("inner"), F.pmod(F.xxhash64("key", F.lit(3)), "nd")).otherwise(F.pmod(F.xxhash64("key", F.lit(3)), "no")).cast("int")
    dealt = dealt.withColumn("own", block)
    # blocks of others are 0 .. no - 1, those of the largest component follow
    at = F.when(F.col("inner"), F.col("no") + F.col("own")).otherwise(F.col("own"))
    partner = F.when(F.col("inner"), F.sequence(F.lit(0), F.col("no") - 1)).otherwise(F.sequence(F.lit(0), F.col("no") + F.col("nd") - 1))
    dealt = dealt.withColumn("at", at).withColumn("with", F.explode(partner))
    return dealt.select("c", "v", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), F.col("at").alias("side"), "key", "comp")


def _candidates(t: pa.Table, matches: int) -> np.ndarray:
    """Pairs of rows, one from each side of a tile, of different components, whose signatures agree enough.

    A pair that meets in a list of higher order as well is left to that one, so it is found once.
    """
    side, c, i, j = t.column("side").to_numpy(), *(t.column(n)[0].as_py() for n in ("c", "i", "j"))
    comp = t.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
    sig, orders = t.column("sig").combine_chunks(), t.column("orders").combine_chunks()
    k = len(sig[0])
    sig = sig.flatten().to_numpy().reshape(-1, k)
    # a bit for each coordinate in whose list, of higher order than this one, a row is
    order = np.full(sig.shape, -1, np.int64)
    flat = orders.flatten().to_numpy()
    order[np.repeat(np.arange(len(sig)), orders.value_lengths().to_numpy()), flat % _ORDER] = flat
    higher = _bits(order > order[:, c : c + 1])
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    out, step = [], max(1, 1_000_000 // (k * max(1, len(right))))
    for at in range(0, len(left), step):
        xs = left[at : at + step]
        agree = _bits(sig[xs][:, None, :] == sig[right][None, :, :])
        found = comp[xs][:, None] != comp[right][None, :]
        if i == j:
            found &= xs[:, None] < right[None, :]
        words = range(agree.shape[2])
        found &= sum(np.bitwise_count(agree[:, :, w]).astype(np.int32) for w in words) >= matches
        for w in words:
            found &= (agree[:, :, w] & higher[xs, None, w] & higher[None, right, w]) == 0
        x, y = np.nonzero(found)
        out.append(np.stack([xs[x], right[y]], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _bits(flags: np.ndarray) -> np.ndarray:
    """Flags along the last axis, packed in words of 64."""
    packed = np.packbits(flags, axis=-1)
    if over := packed.shape[-1] % 8:
        packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], 8 - over), np.uint8)], axis=-1)
    return packed.view(np.uint64)


def _similar(sets: list[np.ndarray], pairs: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets are alike to percent; common members are counted by matrix products where pairs are many."""
    size = np.array([len(s) for s in sets])
    rows, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(pairs.shape)
    if len(pairs) < 8 * len(rows):
        same = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in pairs.tolist()], np.int64)
    else:
        owner = np.repeat(np.arange(len(rows)), size[rows])
        _, item = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True)
        order = np.argsort(item, kind="stable")
        owner, item = owner[order], item[order]
        common = np.zeros((len(rows), len(rows)), np.float32)
        for first in range(0, int(item[-1]) + 1, 4096):
            a, b = np.searchsorted(item, [first, first + 4096])
            part = np.zeros((len(rows), 4096), np.float32)
            part[owner[a:b], item[a:b] - first] = 1
            common += part @ part.T
        same = np.round(common[at[:, 0], at[:, 1]]).astype(np.int64)
    return 100 * same >= percent * (size[pairs[:, 0]] + size[pairs[:, 1]] - same)


def _tiled(posts: DataFrame, classes: DataFrame, sets: DataFrame, matches: int, percent: int, tile: int) -> DataFrame:
    """Links between components within posting lists, a stage table: of each tile as many as join its components, confirmed.

    First only those members are told that have a candidate in their tile; just they
    bring their full sets. Lists are ordered by size, then by coordinate: alike members
    share their largest lists with the same others, so most pairs fall to few lists.
    """
    order = F.floor(4 * F.log2("n")).cast("int") * _ORDER + F.col("c")
    orders = posts.join(posts.groupBy("c", "v").agg(F.count("*").alias("n")), ["c", "v"]).groupBy("key").agg(F.collect_list(order).alias("orders"))  # as many as coordinates at most
    sig = classes.select("key", "sig").join(orders, "key")

    def some(t: pa.Table) -> pa.Table:
        rows = np.unique(_candidates(t, matches))
        return t.select(["c", "v", "i", "j", "side", "key", "comp", "sig", "orders"]).take(pa.array(rows, pa.int64()))

    tiles = _tiles(posts, tile).join(sig, "key").select("c", "v", "i", "j", "side", "key", "comp", "sig", "orders")
    kept = tiles.groupBy("c", "v", "i", "j").applyInArrow(some, tiles.schema)

    def link(t: pa.Table) -> pa.Table:
        pairs = _candidates(t, matches)
        key, comp = t.column("key").to_pylist(), t.column("comp").to_pylist()
        full = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        root: dict = {}

        def find(x):
            while (y := root.setdefault(x, x)) != x:
                root[x] = root[y]
                x = root[x]
            return x

        a, b = [], []
        for x, y in pairs[_similar(full, pairs, percent)].tolist() if len(pairs) else ():
            p, q = find(comp[x]), find(comp[y])
            if p != q:
                root[p] = q
                a.append(min(key[x], key[y]))
                b.append(max(key[x], key[y]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    kept = stage(kept, "kept")
    links = stage(kept.join(sets, "key").groupBy("c", "v", "i", "j").applyInArrow(link, "a binary, b binary").distinct(), "links")
    drop_stage(kept)
    return links


def judged_rows(docs: DataFrame, words: int = 5, percent: int = 80, k: int = COORDINATES, matches: int = MATCHES, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_hash, root, n_shingles, component_id, kept of every row.

    A row without words (or with a null text) has an empty set and is linked with
    nothing. Rows with one set are one class, whatever their ids. component_id is the
    smallest id that links reach; a null id is nobody's smallest. root names the
    component where several have the same smallest id; it is null without words. An
    empty table gives an empty result.
    """
    rows = stage(signed(docs, words, id_col, text_col), "signed")
    # of a class, one row is to be read again: the one with the smallest id
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("m")
    classes = rows.where("key is not null").groupBy("key").agg(least, F.first("sig").alias("sig"))
    classes = stage(classes.select("key", F.col("m.doc_id").alias("rep"), F.col("m.row_hash").alias("row_hash"), "sig"), "classes")
    first = stage(posting_prefixes(classes, k, matches), "posts")
    wanted = first.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1")
    posts = stage(first.join(wanted.select("c", "v"), ["c", "v"], "left_semi"), "lists")
    drop_stage(first)
    need = posts.select("key").distinct().join(classes.select("key", "row_hash"), "key")
    text = docs.select(row_hash(id_col, text_col).alias("row_hash"), F.col(text_col).alias("text"))
    links, sets, roots, parts = None, None, None, []
    for turn in range(TURNS + 1):
        now = posts.withColumn("comp", F.col("key"))
        if roots is not None:
            now = posts.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("c", "v", "key", F.coalesce("root", "key").alias("comp"))
            mixed = now.groupBy("c", "v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("c", "v")
            now = stage(now.join(mixed, ["c", "v"], "left_semi"), "mixed")
            if now.isEmpty():
                drop_stage(now)
                break
        if turn < TURNS:
            pairs = stage(_alike(_hub_pairs(now, turn), classes, matches), "pairs")
            if sets is None:
                # full sets of classes in lists, from one document each
                sets = stage(signed_text(need, text, words), "sets")
            new = stage(confirmed(pairs, sets, percent), "links")
            drop_stage(pairs)
        else:
            new = _tiled(now, classes, sets, matches, percent, tile)
        parts.append(new)
        links = new if links is None else links.unionByName(new)
        if roots is not None:
            drop_stage(roots)
        roots = components(links)
        drop_stage(now)
    named = stage(classes.select("key", "rep").join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", F.coalesce("root", "key").alias("root")), "named")
    # written down, so that the join by root is one of two tables and a large component's rows can be split
    lowest = stage(named.groupBy("root").agg(F.min("rep").alias("component_id")), "lowest")
    by_key = stage(named.join(lowest, "root").select("key", "root", "component_id"), "by_key")
    drop_stage(posts, sets, roots, named, lowest, classes, *parts)
    out = rows.join(by_key, "key", "left").withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "row_hash", "root", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = COORDINATES, matches: int = MATCHES, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row, as judged_rows tells them (nulls, ties and empty tables too).

    Repeated rows are judged alike; columns other than id and text are left out.
    """
    return judged_rows(docs, words, percent, k, matches, tile, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which one stays for each component, in docs' columns.

    It is the row with the smallest id, null last; of several such rows one, the same
    in every run but for rows that are alike in id and text. Rows are judged apart
    whatever their ids: two different texts under one id both stay. Rows without words
    or text are linked with nothing and stay, all of them. An empty table stays empty.
    """
    judged = judged_rows(docs, words, percent, id_col=id_col, text_col=text_col).where("root is not null")
    kinds = judged.groupBy("root", "row_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    first = F.min_by(F.struct("row_hash", "n"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash"))
    winners = stage(kinds.groupBy("root").agg(first.alias("w")).select("w.row_hash", "w.n"), "winners")
    (h,) = free_names(docs.columns, "row_hash")
    hashed = docs.withColumn(h, row_hash(id_col, text_col))
    won = lambda n: winners.where(n).select(F.col("row_hash").alias(h))
    single = hashed.join(won("n = 1"), h, "left_semi")
    repeated = hashed.join(won("n > 1"), h, "left_semi").dropDuplicates([h])
    blank = ~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return columns(single, docs.columns).unionByName(columns(repeated, docs.columns)).unionByName(docs.where(blank))


def signed_text(need: DataFrame, text: DataFrame, words: int) -> DataFrame:
    """key, shingles for key, row_hash rows; documents are read again rather than kept with all their hashes.

    Only rows that are the same in id and text meet; a chance hash is told by the digest.
    """
    both = need.join(text, "row_hash").select("key", "text")

    def own(batches):
        for b in batches:
            keep = [k.as_py() == hashlib.blake2b(s.as_py(), digest_size=16).digest() for k, s in zip(b.column(0), b.column(1), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return sets_of(both, words).mapInArrow(own, "key binary, shingles binary").dropDuplicates(["key"])
