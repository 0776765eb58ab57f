"""MinHash near-dedup with sequential Bayesian verification.

Documents with one shingle set make up a class, which is a node with a number of its own. Signatures of the classes
are cut into bands, and a band's bucket proposes pairs with its most central member. A pair's signatures are compared
batch by batch; it is pruned as soon as the posterior chance that its similarity reaches the threshold is below the miss
probability, and the survivors are verified exactly on their whole sets. Links make components.

Members of a bucket that are then still apart may be linked with each other though not with the central one. Sets as similar as
asked for share one of their rarest shingles (of so many that the others are too few to reach the threshold), so members of
open buckets are joined into clusters by those alone: texts that have a common frame in common, and nothing rare, don't meet. The
members of a cluster are dealt into blocks, and every two blocks meet in a task that compares those of different components in the
same way and reports only links that join some.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.graph import components
from sylva.llm.kernels import Words, mix, runs, slices
from sylva.llm.shared import Tables

SHINGLE = 5
#: Members of a block: a sixteenth of a cluster, within these bounds, and less where they hold more shingles than this together. Two blocks and their sets meet in one task.
LEAST_BLOCK, MOST_BLOCK, MOST_SHINGLES = 64, 1024, 4_000_000

#: A shingle of more than one in so many rows is hot; there can't be more such shingles than this.
HOT_PART = 500


@lru_cache(4)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles; with fewer words, one of all of them; none without words."""
    for _, data, bounds in slices(texts):
        words = Words(data, bounds)
        hashes = words.hashes(lower=True)
        all_runs = runs(hashes, SHINGLE)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if b - a >= SHINGLE:
                yield np.unique(all_runs[a : b - SHINGLE + 1])
            else:
                yield mix(runs(hashes[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64)


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each of n hash functions over a set (not empty)."""
    a, b = _functions(n)
    x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(out, (x[k : k + 2048, None] * a + b).min(0), out=out)
    return out


@lru_cache(64)
def least_matches(threshold: float, miss: float, batch: int, n: int) -> list[int]:
    """For batch, 2*batch .. n compared values: the fewest matches with which a pair goes on.

    With a uniform prior the similarity after m matches of k is Beta(m+1, k-m+1), so the chance that it reaches the
    threshold is that of m or fewer successes in k+1 trials at the threshold.
    """
    out = []
    for k in range(batch, n + 1, batch):
        chance, m = 0.0, -1
        while chance < miss and m < k:
            m += 1
            chance += exp(lgamma(k + 2) - lgamma(m + 1) - lgamma(k + 2 - m) + m * log(threshold) + (k + 1 - m) * log(1 - threshold))
        out.append(m)
    return out


def survives(a: np.ndarray, b: np.ndarray, threshold: float, miss: float, batch: int = 16) -> np.ndarray:
    """Which pairs of signatures (rows of a and b) come through all batches."""
    n, alive = a.shape[1], np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for i, least in enumerate(least_matches(threshold, miss, batch, n)):
        part = slice(i * batch, (i + 1) * batch)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _profile(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, size, digest, sig = batch.slice(at, 1000), [], [], []
                for s in shingle_sets(part["text"]):
                    size.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sig.append(signature(s, n).tobytes() if len(s) else None)
                yield pa.record_batch([part["doc_id"], part["h"], size, digest, sig], schema=schema)

    return rows


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield pa.record_batch([part["node"], pa.array([s.tobytes() for s in shingle_sets(part["text"])], pa.binary())], names=["node", "set"])


def _bands(bands: int, width: int):
    schema = pa.schema([("bucket", pa.binary()), ("node", pa.int64()), ("n_shingles", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = [xxhash.xxh3_128_digest(s[4 * width * i : 4 * width * (i + 1)] + bytes([i])) for s in part["sig"].to_pylist() for i in range(bands)]
                yield pa.record_batch([keys, *(np.repeat(part[c].to_numpy(), bands) for c in ("node", "n_shingles"))], schema=schema)

    return rows


def _prune(threshold: float, miss: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                x, y = (np.frombuffer(b"".join(part[c].to_pylist()), np.uint32).reshape(part.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield part.select(["a", "b"]).filter(pa.array(survives(x, y, threshold, miss)))

    return rows


def _verify(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch["set_a"], batch["set_b"]):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return rows


def intersections(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many elements each set shares with each other one, by products of incidence matrices; a stretch of elements at a time."""
    values, place = np.unique(np.concatenate([*sets, *others]), return_inverse=True)
    row = np.repeat(np.arange(len(sets) + len(others)), [len(s) for s in (*sets, *others)])
    often = np.bincount(place, minlength=len(values)) > 1
    row, place = row[often[place]], (np.cumsum(often) - 1)[place[often[place]]]
    out = np.zeros((len(sets), len(others)), np.float32)
    for low in range(0, int(often.sum()), 4096):
        part = (place >= low) & (place < low + 4096)
        held = np.zeros((len(sets) + len(others), 4096), np.float32)
        held[row[part], place[part] - low] = 1
        out += held[: len(sets)] @ held[len(sets) :].T
    return out.astype(np.int64)


def _compare(percent: int, miss: float):
    """Links between the components of two blocks of a cluster (or inside one block): no more than join them."""

    def block(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        at, c = table["block"].to_numpy(), table["c"].to_numpy()
        x, y = np.flatnonzero(at == i), np.flatnonzero(at == j)
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(len(at), -1)
        left, right = np.nonzero((c[x][:, None] != c[y]) & ((i != j) | (np.arange(len(x))[:, None] < np.arange(len(y)))))
        alive = np.zeros(len(left), bool)
        for k in range(0, len(left), 1 << 15):
            part = slice(k, k + (1 << 15))
            alive[part] = survives(sig[x[left[part]]], sig[y[right[part]]], percent / 100, miss)
        left, right = left[alive], right[alive]
        joins: list[tuple[int, int]] = []
        if len(left):
            rows, columns = np.unique(left), np.unique(right)
            sets = [np.frombuffer(s, np.uint64) for s in table["set"].to_pylist()]
            a, b = [sets[k] for k in x[rows]], [sets[k] for k in y[columns]]
            common = intersections(a, b)
            total = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])
            linked = (100 * common >= percent * (total - common))[np.searchsorted(rows, left), np.searchsorted(columns, right)]
            up: dict[int, int] = {}

            def root(k: int) -> int:
                while k in up:
                    k = up[k]
                return k

            for p, q in np.unique(np.stack([c[x[left[linked]]], c[y[right[linked]]]], 1), axis=0).tolist():
                p, q = sorted((root(p), root(q)))
                if p != q:
                    up[q] = p
                    joins.append((q, p))
        return pa.table({"a": pa.array([p for p, _ in joins], pa.int64()), "b": pa.array([q for _, q in joins], pa.int64())})

    return block


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets' shingles as rows: node, s, n_shingles."""
    for batch in batches:
        for node, data in zip(batch["node"].to_pylist(), batch["set"].to_pylist()):
            s = np.frombuffer(data, np.int64)
            yield pa.record_batch([np.full(len(s), node), s, np.full(len(s), len(s), np.int32)], names=["node", "s", "n_shingles"])


def rare_edges(sets: DataFrame, component: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Edges (a, b long) that join the nodes of sets (node, set) with a rare shingle in common, where they are of several components (node, c).

    Shingles are ordered by how many of the sets hold them. A set of n shares percent * n / 100 of its shingles with any it is linked
    with, so both hold one of its n - that + 1 rarest. Those in one set only come first and join nothing. Those that a
    HOT_PART of all rows hold are at most HOT_PART, so they are broadcast and their rows don't meet in one task.
    """
    each = sets.mapInArrow(_elements, "node long, s long, n_shingles int")
    often = tables.keep(each.groupBy("s").agg(F.count("*").alias("f")).filter("f > 1"), "often")
    total = sets.agg(F.coalesce(F.sum(F.length("set")), F.lit(0)).alias("n")).first()["n"] // 8
    is_hot = F.col("f") * HOT_PART >= total
    marked = each.join(F.broadcast(often.filter(is_hot)), "s", "left")
    rows = marked.filter("f is not null").unionByName(marked.filter("f is null").drop("f").join(often.filter(~is_hot), "s"))
    held = rows.groupBy("node", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("all"))
    rarest = F.col("n_shingles") - F.floor((F.col("n_shingles") * percent + 99) / 100) + 1
    take = F.greatest(F.lit(0), rarest - (F.col("n_shingles") - F.size("all"))).cast("int")
    keys = held.select("node", F.explode(F.slice("all", F.lit(1), take)).alias("x")).select("node", F.col("x.s").alias("s")).join(component, "node")
    mixed = keys.groupBy("s").agg(F.min("node").alias("b"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("s", "b")
    return keys.join(mixed, "s").select(F.col("node").alias("a"), "b").filter("a <> b")


def _attach(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with column_a and column_b of values (node, column)."""
    for side in "ab":
        pairs = pairs.join(values.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs


def near_duplicates(docs: DataFrame, percent: int = 85, hashes: int = 128, width: int = 4, miss: float = 1e-9) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id for every row of docs (doc_id, text).

    Shingles are SHINGLE words, A-Z lower-cased; documents are linked if 100 * |both| >= percent * |either|. component_id is
    the smallest doc_id that links reach, kept tells whether it is the own. class_id: the smallest doc_id with the
    same set. Without words (or null text): n_shingles 0, linked with nothing, kept. Rows with one doc_id count as one
    node, whatever their texts: each text's links are found, and all rows have one component_id; null doc_ids are linked
    with nothing, their component_id is null and they are kept; other columns are left.

    hashes, width: values of a signature, and of each band; a pair of similarity s shares a band but for a chance of
    (1 - s**width) ** (hashes / width), 5e-11 at s = 0.85. miss: bound on the posterior chance at which pairs are pruned.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "near")
    text = F.coalesce(F.col("text"), F.lit(""))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    profile = tables.keep(text.mapInArrow(_profile(hashes), "doc_id long, h long, n_shingles long, digest binary, sig binary"), "profile")
    known = profile.filter("digest is not null and doc_id is not null")
    # The row with the least doc_id and text hash gives the class's signature and set.
    own = F.struct("doc_id", "h")
    classes = known.groupBy("digest").agg(F.min(own).alias("least"), F.min_by(F.struct("n_shingles", "sig"), own).alias("one"))
    classes = classes.select("digest", F.col("least.doc_id").alias("class_id"), "least.h", "one.n_shingles", "one.sig")
    classes = tables.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = classes.select("node", "n_shingles", "sig")
    bands = hashes // width
    members = tables.keep(reps.mapInArrow(_bands(bands, width), "bucket binary, node long, n_shingles long"), "bands")
    full = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = tables.keep(members.join(full, "bucket"), "members")
    central = members.groupBy("node").agg(F.sum("n").alias("weight"))
    pivot = members.join(central, "node").groupBy("bucket").agg(F.max_by(F.struct("node", "n_shingles"), F.struct("weight", -F.col("node"))).alias("p"))
    pivot = pivot.select("bucket", F.col("p.node").alias("pivot"), F.col("p.n_shingles").alias("pivot_n"))

    least, most = F.least("n_shingles", "pivot_n"), F.greatest("n_shingles", "pivot_n")
    near_size = 100 * least >= percent * most
    ordered = [F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")]
    pairs = members.join(pivot, "bucket").filter((F.col("node") != F.col("pivot")) & near_size).select(*ordered).distinct()

    sigs = tables.keep(classes.select("node", "sig", F.col("class_id").alias("doc_id"), "h").join(members.select("node").distinct(), "node"), "sigs")
    wanted, sigs = sigs.select("doc_id", "h", "node"), sigs.select("node", "sig")
    sets = tables.keep(text.join(wanted, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("node", "text").mapInArrow(_sets, "node long, set binary"), "sets")
    member = profile.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "node", "class_id"), "digest", "left")
    member = tables.keep(member.drop("digest"), "member")
    # Classes that hold rows of one doc_id are one node.
    placed_ids = member.filter("node is not null and doc_id is not null")
    several = placed_ids.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("high")).filter("b < high").select("doc_id", "b")
    several = placed_ids.join(several, "doc_id").select(F.col("node").alias("a"), "b")
    close = tables.keep(_attach(pairs, sigs, "sig").mapInArrow(_prune(percent / 100, miss), "a long, b long"), "close")
    links = _attach(close, sets, "set").mapInArrow(_verify(percent), "a long, b long").unionByName(several)
    stars = components(links, tables, "stars")

    # Buckets with a pair that is not compared yet and not joined by links: three members or more, in several components.
    placed = members.filter("n > 2").join(stars, "node", "left").select("bucket", F.coalesce("component", "node").alias("c"))
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("bucket")
    apart = members.join(mixed, "bucket").select("node").distinct()
    apart = tables.keep(apart.join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("c")), "apart")
    cluster = components(rare_edges(sets.join(apart, "node", "left_semi"), apart, percent, tables), tables, "open")
    cluster = tables.keep(cluster.unionByName(cluster.select(F.col("component").alias("node"), "component").distinct()), "clusters")
    n = F.count("*")
    blocks = F.greatest(F.ceil(n / F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.ceil(n / 16)))), F.ceil(F.sum("n_shingles") / MOST_SHINGLES))
    sizes = cluster.join(reps.select("node", "n_shingles"), "node").groupBy("component").agg(blocks.alias("blocks"))
    blocked = cluster.join(sizes, "component").join(stars.withColumnRenamed("component", "c"), "node", "left")
    blocked = blocked.select(F.col("component").alias("cluster"), "node", F.coalesce("c", "node").alias("c"), F.pmod(F.xxhash64("node"), "blocks").alias("block"), "blocks")
    dealt = blocked.join(sigs, "node").join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "c", "sig", "set")
    found = tables.keep(dealt.groupBy("cluster", "i", "j").applyInArrow(_compare(percent, miss), "a long, b long"), "found")
    joined = components(found, tables, "joined")
    further = stars.join(joined.select(F.col("node").alias("component"), F.col("component").alias("last")), "component", "left").select("node", F.coalesce("last", "component").alias("component"))
    heads = joined.join(stars.select("node"), "node", "left_anti")
    component = further.unionByName(heads)
    component = tables.keep(component.unionByName(component.select(F.col("component").alias("node"), "component").distinct()), "component")
    low = component.join(classes.select("node", "class_id"), "node").groupBy("component").agg(F.min("class_id").alias("component_id"))
    component = component.join(low, "component").select("node", "component_id")
    # A row without words goes with the other rows of its doc_id.
    bare = F.col("node").isNull() & F.col("doc_id").isNotNull()
    blank = member.filter(bare).select("doc_id", "n_shingles")
    stand = placed_ids.join(blank.select("doc_id").distinct(), "doc_id").groupBy("doc_id").agg(F.min(F.struct("node", "class_id")).alias("one"))
    blank = blank.join(stand.select("doc_id", "one.*"), "doc_id", "left")
    member = member.filter(~bare).unionByName(blank).join(component, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "class_id", "doc_id"))
    same_set = F.when(F.col("n_shingles") > 0, F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id"))
    return member.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), same_set.alias("class_id"))
