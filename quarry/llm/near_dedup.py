"""MinHash near-duplicate detection with sequential Bayesian verification.

Steps, each written to the shared folder:

1. One pass over the texts makes each text's set of word shingles, a key of the
   whole set, a MinHash signature and the keys of its bands. Texts with equal
   sets become one class, so a group of exact copies is one node from here on.
2. Nodes that share a band key are candidates. A bucket never emits its pairs:
   its smallest node is its hub, and every node is compared with the smallest of the
   hubs of its buckets, so n nodes make n - 1 pairs at most. The confirmed links are
   contracted to components; buckets that lie in a single component are done, since
   further links in them change nothing.
3. Buckets that still hold several components are compared fully, skipping
   pairs within a component and pairs that shared an earlier band. Buckets up
   to ``small`` nodes are compared by their signatures, many buckets in one call. Of
   larger ones every node is compared with its hub; those that still hold several
   components after that are dealt as pairs of blocks of about ``block`` nodes, by
   signatures alone. Blocks with more than ``most`` surviving pairs a node are dealt
   once more with their texts and return only links that join components; the texts
   of others are fetched for the pairs that survived. So no candidate is lost to the
   hubs or to a cap, and no step returns the pairs of a group.
4. Verification reads the signature in batches. With m of n values equal, the
   similarity has the posterior Beta(m + 1, n - m + 1); a pair is pruned as soon
   as the posterior chance of reaching the threshold is below ``miss``.
   Survivors are confirmed on their full shingle sets.

Chance that a link at exactly the threshold shares no band: (1 - t^rows)^bands,
7e-6 for t = 0.8, 5 rows and 30 bands; links of higher similarity less.

Edge cases: null, empty and blank texts have an empty set, are linked with
nothing and are kept. Texts with fewer words than a shingle have one shingle of
all their words. Each row counts by its own text: of rows that repeat an id with
different texts each has the component of its text, and is kept if that is its id.
Rows without an id are linked with nothing: component_id is null, kept true. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS, U64, Chunk, Work, chunks, connected_components, mix, ngram_hashes, pack, table, unpack


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(chunk: Chunk, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z count as a-z."""
    starts, ends, of = chunk.words(SPACE_WORDS)
    h = chunk.hashes(starts, ends, lower=True)
    grams = ngram_hashes(h, n)
    count = np.bincount(of, minlength=chunk.n)
    first = np.concatenate([[0], np.cumsum(count)])
    out = []
    for i in range(chunk.n):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(ngram_hashes(h[a:b], int(b - a)) + U64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sketches(n: int, bands: int, rows: int):
    size = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, mult = _permutations(size)
        band_no = (np.arange(bands, dtype=np.uint64) + U64(1)) * U64(0xA24BAED4963EE407)
        for batch, chunk in chunks(batches):
            sets = shingle_sets(chunk, n)
            length = np.array([len(s) for s in sets], dtype=np.int64)
            some = np.flatnonzero(length)
            sig = np.zeros((len(some), size), dtype=np.uint32)
            key = np.zeros((len(some), 2), dtype=np.uint64)
            if len(some):
                flat = np.concatenate([sets[i] for i in some])
                at = np.concatenate([[0], np.cumsum(length[some])[:-1]])
                key[:, 0] = np.add.reduceat(mix(flat ^ U64(0x51ED270B)), at)
                key[:, 1] = np.add.reduceat(mix(flat ^ U64(0xB5297A4D)), at)
                low = (flat >> U64(32)).astype(np.uint32)
                for j in range(size):
                    sig[:, j] = np.minimum.reduceat((low ^ xor[j]) * mult[j], at)
            band = np.zeros((len(some), bands), dtype=np.uint64)
            part = sig.reshape(len(some), bands, rows).astype(np.uint64)
            for r in range(rows):
                band = mix(band * U64(31) + part[:, :, r] + band_no)
            valid = length > 0
            slot = pa.array(np.where(valid, np.cumsum(valid) - 1, 0), mask=~valid, type=pa.int64())
            lists = pa.FixedSizeListArray.from_arrays(pa.array(band.reshape(-1).view(np.int64)), bands).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(length),
                    pa.array(key[:, 0].view(np.int64)).take(slot),
                    pa.array(key[:, 1].view(np.int64)).take(slot),
                    pack(sig).take(slot),
                    lists.take(slot),
                ],
                ["doc_id", "text_key", "n_shingles", "k1", "k2", "sig", "bands"],
            )

    return run


def least_matches(threshold: float, n: int, miss: float) -> int:
    """The fewest equal values of n for which P(similarity >= threshold) >= miss under Beta(m+1, n-m+1)."""
    t = Fraction(threshold).limit_denominator(10**6)
    for m in range(n + 1):
        # P(Beta(a, b) >= t) = P(Binomial(a + b - 1, t) <= a - 1)
        above = sum(comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))
        if above >= miss:
            return m
    return n


def _prune_rows(a: np.ndarray, b: np.ndarray, rules: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the pairs of signatures that no batch prunes."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int64)
    done = 0
    for upto, least in rules:
        matches[alive] += (a[alive, done:upto] == b[alive, done:upto]).sum(axis=1)
        alive = alive[matches[alive] >= least]
        done = upto
    return alive


def _rules(size: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    return [(n, least_matches(threshold, n, miss)) for n in [*range(batch, size, batch), size]]


def _pruner(size: int, rules: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (unpack(batch.column(i), np.uint32, size) for i in (2, 3))
                yield batch.select([0, 1]).take(pa.array(_prune_rows(a, b, rules)))

    return run


def _confirmer(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                left, right = (shingle_sets(Chunk(part.column(i)), n) for i in (2, 3))
                keep = []
                for i, (x, y) in enumerate(zip(left, right, strict=True)):
                    if percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * both >= percent * (len(x) + len(y) - both):
                            keep.append(i)
                yield part.select([0, 1]).take(pa.array(keep, type=pa.int64()))

    return run


def _first_shared(sig_u: np.ndarray, sig_v: np.ndarray, band: np.ndarray, rows: int) -> np.ndarray:
    """Which pairs of signatures share no band before the given one, in which they are met."""
    out = np.ones(len(band), dtype=bool)
    for b in range(int(band.max(initial=0))):
        on = np.flatnonzero(out & (band > b))
        out[on[(sig_u[on, b * rows : (b + 1) * rows] == sig_v[on, b * rows : (b + 1) * rows]).all(axis=1)]] = False
    return out


def _small_buckets(size: int, rows: int, rules: list[tuple[int, int]], pairs: int = 1 << 17):
    """The candidates of buckets of bounded size that no batch prunes; rows come sorted by bucket, many buckets at a time."""

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        band, key, node, comp = (np.asarray(t.column(c)) for c in ("band", "key", "node", "comp"))
        sig = unpack(t.column("sig"), np.uint32, size)
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (band[1:] != band[:-1])]))
        end = np.repeat(np.append(start[1:], len(key)), np.diff(np.append(start, len(key))))
        later = end - np.arange(len(key)) - 1  # members of the bucket behind each
        cuts = np.searchsorted(np.cumsum(later), np.arange(0, int(later.sum()), pairs), "left")
        for x, y in zip(cuts, [*cuts[1:], len(key)], strict=True):
            i = np.repeat(np.arange(x, y), later[x:y])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[x:y]) - later[x:y], later[x:y])
            apart = comp[i] != comp[j]
            i, j = i[apart], j[apart]
            fresh = _first_shared(sig[i], sig[j], band[i], rows)
            i, j = i[fresh], j[fresh]
            alive = _prune_rows(sig[i], sig[j], rules)
            yield _links(node[i[alive]], node[j[alive]]).to_batches()[0] if len(alive) else _no_links()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key, band = np.asarray(held.column("key")), np.asarray(held.column("band"))
            whole = np.flatnonzero((key != key[-1:]) | (band != band[-1:]))
            if len(whole):  # the last bucket may go on in the next batch
                yield from settle(held.slice(0, int(whole[-1]) + 1).combine_chunks())
                held = held.slice(int(whole[-1]) + 1)
        if held is not None and held.num_rows:
            yield from settle(held.combine_chunks())

    return run


def _links(u: np.ndarray, v: np.ndarray) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _no_links() -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], ["u", "v"])


def _survivors(sig_u: np.ndarray, sig_v: np.ndarray, allowed: np.ndarray, band: int, rows: int, rules: list[tuple[int, int]]) -> np.ndarray:
    """Which allowed pairs (i, j) first share this band and are not pruned."""
    out = np.zeros(allowed.shape, dtype=bool)
    for i in range(len(sig_u)):
        js = np.flatnonzero(allowed[i])
        if len(js):
            js = js[_prune_rows(np.broadcast_to(sig_u[i], (len(js), sig_u.shape[1])), sig_v[js], rules)]
        if len(js) and band:
            js = js[_first_shared(np.broadcast_to(sig_u[i], (len(js), sig_u.shape[1])), sig_v[js], np.full(len(js), band), rows)]
        out[i, js] = True
    return out


def _sides(key: tuple[pa.Scalar, ...], t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    _, x, y = (k.as_py() for k in key)
    node, comp, block = (np.asarray(t.column(c)) for c in ("node", "comp", "block"))
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    allowed = comp[left][:, None] != comp[right][None, :]
    if x == y:
        allowed &= node[left][:, None] < node[right][None, :]
    return node, comp, left, right, allowed


def _blocks(size: int, rows: int, rules: list[tuple[int, int]], most: int):
    """Between two blocks of a large bucket, by signatures alone: rows (u, v, key, x, y).

    The pairs that no batch prunes, if there are at most ``most`` a node; else one row without u and v, which
    tells that the blocks have to be confirmed together.
    """

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        node, _, left, right, allowed = _sides(key, t)
        sig = unpack(t.column("sig"), np.uint32, size)
        i, j = np.nonzero(_survivors(sig[left], sig[right], allowed, t.column("band")[0].as_py(), rows, rules))
        dense = len(i) > most * t.num_rows
        u, v = (pa.array([None], pa.int64()),) * 2 if dense else (pa.array(node[left[i]], pa.int64()), pa.array(node[right[j]], pa.int64()))
        return pa.table({"u": u, "v": v, **{c: pa.array([k.as_py()] * len(u), kind) for c, k, kind in zip(("key", "x", "y"), key, (pa.int64(), pa.int32(), pa.int32()), strict=True)}})

    return run


def _both(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """For each pair of sets the size of their intersection."""
    a, b = (np.concatenate(x) for x in (left, right))
    shared = np.intersect1d(a, b)
    of = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    at = [np.searchsorted(shared, x) for x in (a, b)]
    on = [np.append(shared, U64(0))[p] == x for p, x in zip(at, (a, b), strict=True)]
    on = [o & (p < len(shared)) for o, p in zip(on, at, strict=True)]
    for c in range(0, len(shared), 4096):  # a product of 0/1 matrices, some columns at a time
        m = []
        for k, sets in enumerate((left, right)):
            keep = on[k] & (at[k] >= c) & (at[k] < c + 4096)
            x = np.zeros((len(sets), min(4096, len(shared) - c)), dtype=np.float32)
            x[of[k][keep], at[k][keep] - c] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def _dense_blocks(size: int, rows: int, rules: list[tuple[int, int]], n: int, percent: int):
    """The confirmed links between two blocks of a large bucket, as few as join what they join."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        node, comp, left, right, allowed = _sides(key, t)
        sig = unpack(t.column("sig"), np.uint32, size)
        alive = _survivors(sig[left], sig[right], allowed, t.column("band")[0].as_py(), rows, rules)
        ls, rs = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(ls):
            return _links(node[:0], node[:0])
        texts = t.column("text")
        used = np.union1d(left[ls], right[rs])
        sets = dict(zip(used.tolist(), shingle_sets(Chunk(texts.take(pa.array(used))), n), strict=True))
        x, y = [sets[i] for i in left[ls].tolist()], [sets[i] for i in right[rs].tolist()]
        both = _both(x, y)
        total = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
        i, j = np.nonzero(alive[np.ix_(ls, rs)] & (100 * both >= percent * (total - both)))
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        us, vs = [], []
        for p, q in zip(left[ls[i]].tolist(), right[rs[j]].tolist(), strict=True):
            a, b = find(int(comp[p])), find(int(comp[q]))
            if a != b:
                root[a] = b
                us.append(int(node[p]))
                vs.append(int(node[q]))
        return _links(np.array(us, np.int64), np.array(vs, np.int64))

    return run


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = 30,
    rows: int = 5,
    batch: int = 30,
    miss: float = 1e-6,
    block: int = 4096,
    small: int = 64,
    most: int = 4,
) -> DataFrame:
    """Return doc_id, text_key (xxhash64 of the text), n_shingles, component_id (the smallest id reachable) and kept, one row per row of docs.

    Linked are texts whose shingle sets have 100 * |both| >= percent * |either|.
    """
    work, size = Work(spark, "near"), bands * rows
    rules = _rules(size, batch, percent / 100, miss)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    sketch = work.write(
        docs.select("doc_id", "text", "text_key").mapInArrow(_sketches(shingle, bands, rows), "doc_id long, text_key long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"),
        "sketch",
    )
    # texts of equal sets are one node, whatever their ids; a node's number stands for it from here on
    classes = sketch.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2", "n_shingles")
    nodes = classes.agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = work.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    hubs = members.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    hubs = work.write(hubs, "hubs")  # so that the join deals both sides itself and can split a large bucket
    members = work.write(members.join(hubs.hint("merge"), ["band", "key"]), "candidates")
    work.drop("hubs")
    named = members.groupBy("node").agg(F.min("hub").alias("hub"))
    named = work.write(nodes.select("node", "sig", "rep").join(named.hint("merge"), "node"), "named")
    sigs = named.select("node", "sig")
    texts = named.select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_key").alias("text_key"))
    texts = work.write(docs.join(texts.hint("merge"), ["doc_id", "text_key"]).select("node", "text").dropDuplicates(["node"]), "texts")

    def fetch(pairs: DataFrame, side: DataFrame, what: str) -> DataFrame:
        for end in ("u", "v"):
            pairs = pairs.join(side.select(F.col("node").alias(end), F.col(what).alias(f"{what}_{end}")), end)
        return pairs.select("u", "v", f"{what}_u", f"{what}_v")

    def pruned(pairs: DataFrame) -> DataFrame:
        return fetch(pairs, sigs, "sig").mapInArrow(_pruner(size, rules), "u long, v long")

    def confirmed(pairs: DataFrame, tag: str) -> DataFrame:
        return work.write(fetch(pairs, texts, "text").mapInArrow(_confirmer(shingle, percent), "u long, v long"), f"links-{tag}")

    def mixed(comps: DataFrame) -> DataFrame:
        """Members of buckets that hold several components."""
        state = members.join(comps.hint("merge"), "node", "left").select("band", "key", "node", "n", "hub", F.coalesce("comp", "node").alias("comp"))
        open_ = state.groupBy("band", "key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("band", "key")
        return state.join(open_.hint("merge"), ["band", "key"], "left_semi")

    first = named.where("hub < node").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    links = confirmed(work.write(pruned(first), "pruned-0"), "0")
    comps = connected_components(spark, links, work, "comp-0")
    left = work.write(mixed(comps), "left-0")
    few = left.where(F.col("n") <= small).select("band", "key", "node", "comp").join(sigs.hint("merge"), "node")
    few = few.repartition("key").sortWithinPartitions("key", "band").mapInArrow(_small_buckets(size, rows, rules), "u long, v long")
    few = few.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    many = left.where((F.col("n") > small) & (F.col("node") != F.col("hub")))
    hub_comp = comps.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))
    many = many.join(hub_comp.hint("merge"), "hub", "left").where(F.col("comp") != F.coalesce("hub_comp", "hub"))
    many = pruned(many.select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct())
    rest = work.write(few.unionByName(many).distinct(), "rest")
    if not rest.isEmpty():
        links = links.unionByName(confirmed(rest, "1"))
        comps = connected_components(spark, links, work, "comp-1")
    large = left.where(F.col("n") > small)
    if not large.isEmpty():
        members = large.select("band", "key", "node", "n", "hub")
        large = work.write(mixed(comps), "left-1")
        spread = large.withColumn("of", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("node", "band"), F.col("of")).cast("int"))
        spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
        spread = spread.select("band", "key", "node", "comp", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
        spread = spread.join(sigs, "node")
        found = work.write(spread.groupBy("key", "x", "y").applyInArrow(_blocks(size, rows, rules, most), "u long, v long, key long, x int, y int"), "blocks")
        pairs = found.where("u is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        links = links.unionByName(confirmed(pairs, "2"))
        dense = found.where("u is null").select("key", "x", "y")
        if not dense.isEmpty():
            dense = spread.join(dense, ["key", "x", "y"], "left_semi").join(texts, "node")
            links = links.unionByName(work.write(dense.groupBy("key", "x", "y").applyInArrow(_dense_blocks(size, rows, rules, shingle, percent), "u long, v long"), "links-3"))
        comps = connected_components(spark, links, work, "comp-2")
    by_class = nodes.select("k1", "k2", F.col("n_shingles").alias("n"), "node", F.col("rep.doc_id").alias("rep"))
    inside = work.write(comps.join(by_class.hint("merge"), "node"), "inside")
    inside = inside.join(inside.groupBy("comp").agg(F.min("rep").alias("least")).hint("merge"), "comp").select("node", "least")
    result = work.write(by_class.join(inside.hint("merge"), "node", "left").select("k1", "k2", "n", F.coalesce("least", "rep").alias("component_id")), "result")
    own = sketch.select("doc_id", "text_key", "n_shingles", "k1", "k2")
    same = own["doc_id"].isNotNull() & (own["k1"] == result["k1"]) & (own["k2"] == result["k2"]) & (own["n_shingles"] == result["n"])
    out = own.join(result.hint("merge"), same, "left").select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    work.drop("candidates", "named", "texts", "left-0", "left-1", "blocks", "pruned-0", "rest", "links-0", "links-1", "links-2", "links-3", "inside", "nodes")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), shingle=4, percent=80).drop("text_key")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS k FROM s GROUP BY doc_id),
r AS (SELECT k, min(doc_id) AS rep FROM k GROUP BY k),
sr AS (SELECT s.doc_id, s.g FROM s JOIN r ON s.doc_id = r.rep),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sr a JOIN sr b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
walk(node, pos) AS (SELECT rep, rep FROM r UNION SELECT walk.node, e.v FROM walk JOIN e ON walk.pos = e.u),
c AS (SELECT node, min(pos) AS comp FROM walk GROUP BY node),
m AS (SELECT k.doc_id, c.comp FROM k JOIN r USING (k) JOIN c ON c.node = r.rep)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.comp, d.doc_id) AS component_id, d.doc_id = coalesce(m.comp, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
