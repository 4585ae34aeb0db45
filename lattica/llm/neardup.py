"""MinHash near-duplicate groups by an inverted join on signature coordinates.

A text's set is its distinct k-word shingles. Equal sets are one class. Each
class with a set posts itself under its ``coords`` coordinate-value pairs. Two
classes as similar as asked share at least ``match`` of them (but for a chance
of ``MISS``), so

* a pair of coordinate and value that only one class has links nothing and is
  skipped; a class left with fewer than ``match`` shared pairs is skipped too;
* of the rest, sorted from rare to frequent, any two such classes share one
  among their first ``coords - match + 1``: only this prefix is joined.

Links are confirmed on the full shingle sets, in two steps. First every class
is held against one other only, the leader it collides with most often in its
buckets: at most one link a class, however large a group is. Components of
these links are labels. Then buckets that still hold several labels are
searched for pairs of classes with different labels and ``match`` collisions;
such classes are gathered into clusters, and pairs across labels are confirmed
there. Buckets and clusters are worked in chunks (pairs of chunks beyond one),
each returning a spanning forest between labels and never the pairs. So no
link between different texts is lost, while a large group of copies, which the
first step has already joined, costs the second nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lattica.llm.textbytes import U, blocks, mix, release, shingles, words
from lattica.operators.graph import connected_components, forest_roots
from lattica.plans.scratch import Scratch

#: Chance that a pair just as similar as asked is not found.
MISS = 2e-6
COORDS = 40
#: Classes in a chunk of a bucket, of a cluster.
BUCKET_CHUNK, CLUSTER_CHUNK = 1024, 256

SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, sig binary"


def match_threshold(similarity: float, coords: int = COORDS, miss: float = MISS) -> int:
    """Most collisions m with P(fewer than m of ``coords``) <= miss at this similarity."""
    below, m = 0.0, 0
    while m < coords:
        below += comb(coords, m) * similarity**m * (1 - similarity) ** (coords - m)
        if below > miss:
            break
        m += 1
    return max(1, m)


def _seeds(coords: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * coords + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    return base[:coords] | U(1), base[coords:]


def signatures(docs: DataFrame, k: int, coords: int = COORDS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: set size, a 128-bit hash of the set, the signature (null: empty set)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _seeds(coords)
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets, first = shingles(words(block), k)
                sizes = np.diff(first)
                full = np.flatnonzero(sizes)
                sig = np.zeros((block.n, coords), np.uint32)
                a = np.zeros(block.n, np.uint64)
                b = np.zeros(block.n, np.uint64)
                if len(full):
                    at = first[full]
                    for c in range(coords):
                        sig[full, c] = np.minimum.reduceat(sets * mul[c] + add[c], at) >> U(32)
                    a[full] = np.add.reduceat(mix(sets), at)
                    b[full] = np.add.reduceat(mix(sets ^ U(0x5851F42D4C957F2D)), at)
                width = 4 * coords
                raw = sig.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.n).cast(pa.int64()),
                        pa.array(sizes),
                        pa.array(a.view(np.int64)),
                        pa.array(b.view(np.int64)),
                        pa.array([raw[i * width : i * width + width] if sizes[i] else None for i in range(block.n)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "sig"],
                )
            release()

    return docs.select("doc_id", "text").mapInArrow(work, SIGNED)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, shingles)``: each non-empty set as sorted 64-bit hashes in bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets, first = shingles(words(block), k)
                raw = [sets[first[i] : first[i + 1]].tobytes() for i in range(block.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n).cast(pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "shingles"])
        release()

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, shingles binary").filter(F.length("shingles") > 0)


def postings(classes: DataFrame, coords: int) -> DataFrame:
    """``(key, doc_id)``: one row for each coordinate-value pair of each class; key holds both."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = np.arange(coords, dtype=np.int64) << 32
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, coords)
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), coords)
                yield pa.RecordBatch.from_arrays([pa.array((sig + where).ravel()), pa.array(ids)], ["key", "doc_id"])

    return classes.select("doc_id", "sig").mapInArrow(work, "key long, doc_id long")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by the first ``keys`` columns, some groups at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        final = tuple(c[-1] for c in cols)
        if last is not None and final == last:
            held.append(batch)
            continue
        differs = np.zeros(len(batch), bool)
        for c in cols:
            differs |= c != c[-1]
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        held.append(batch.slice(0, cut))
        done = pa.Table.from_batches([b for b in held if len(b)]) if any(len(b) for b in held) else None
        if done is not None:
            yield done
        held, last = [batch.slice(cut)], final
    if any(len(b) for b in held):
        yield pa.Table.from_batches([b for b in held if len(b)])


def _bounds(table: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(len(table), bool)
    new[0] = True
    for i in range(keys):
        c = table.column(i).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(table))


def _edge_batch(src: list[np.ndarray], dst: list[np.ndarray]) -> pa.RecordBatch:
    a = np.concatenate(src) if src else np.zeros(0, np.int64)
    b = np.concatenate(dst) if dst else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"])


def _label_edges(linked: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest between the labels of rows, from a symmetric matrix of linked rows."""
    order = np.argsort(label, kind="stable")
    names, first = np.unique(label[order], return_index=True)
    if len(names) < len(label):  # rows of one label count as one
        linked = np.logical_or.reduceat(np.logical_or.reduceat(linked[order][:, order], first, axis=0), first, axis=1)
        order = np.arange(len(names))
    x, y = np.nonzero(np.triu(linked[order][:, order]))
    root = forest_roots(x, y, len(names))
    leaf = np.flatnonzero(root != np.arange(len(names)))
    return names[leaf], names[root[leaf]]


def _chunked(rows: DataFrame, group: str, payload: DataFrame, chunk: int, parts: int, scratch: Scratch) -> DataFrame:
    """Deal the written ``rows(group, label, doc_id)`` into chunks of about ``chunk`` of a group, and add the ``payload`` of each doc_id.

    A row goes to every pair of chunks with its own that can hold two labels. A label of more than half a chunk has
    chunks of its own, which are not paired with each other; rows of smaller labels are dealt by hash. A group of
    one chunk is worked whole. Sorted by group and pair in partitions.
    """
    count = rows.count()
    whole = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk)
    whole = scratch.keep(whole.select(group, F.ceil(F.col("n") / chunk).cast("int").alias("pool")), "many", count)
    split = scratch.keep(rows.join(whole, group), "split", count)
    large = split.groupBy(group, "label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * 2 > chunk)
    large = scratch.keep(large.select(group, "label", F.ceil(F.col("n") / chunk).cast("int").alias("own")), "large", count)
    at = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.coalesce("own", "pool")).cast("int")
    series = F.when(F.col("own").isNotNull(), F.col("label"))
    dealt = split.join(large, [group, "label"], "left").select(group, "label", "doc_id", F.struct(series.alias("s"), at.alias("c")).alias("x"))
    dealt = scratch.keep(dealt, "dealt", count)
    lists = scratch.keep(dealt.select(group, "x").distinct().groupBy(group).agg(F.collect_list("x").alias("chunks")), "chunks", count)
    apart = lambda c: (c != F.col("x")) & ~F.coalesce(c["s"] == F.col("x.s"), F.lit(False))
    others = F.filter("chunks", apart)
    # a chunk that meets no other is worked alone, unless it holds one label
    others = F.when((F.size(others) == 0) & F.col("x.s").isNull(), F.array("x")).otherwise(others)
    paired = dealt.join(lists, group).withColumn("y", F.explode(others))
    pair = F.xxhash64(F.least("x", "y"), F.greatest("x", "y"))
    paired = paired.select(group, pair.alias("pair"), "label", "doc_id")
    alone = rows.join(whole, group, "left_anti").select(group, F.lit(0).cast("long").alias("pair"), "label", "doc_id")
    both = scratch.keep(alone.unionByName(paired), "paired").join(payload, "doc_id").select(group, "pair", "label", "doc_id", payload.columns[1])
    return both.repartition(parts, group, "pair").sortWithinPartitions(group, "pair")


def meeting(members: DataFrame, sig: DataFrame, match: int, parts: int, scratch: Scratch) -> DataFrame:
    """``(doc_id, src, dst)`` of ``(key, label, doc_id)``: classes that collide ``match`` times with one of another label
    in their bucket (null src), and a forest of such labels (null doc_id)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 2):
            ids = table.column("doc_id").to_numpy()
            label = table.column("label").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(table), -1)
            bounds = _bounds(table, 2)
            size = np.diff(bounds)
            two = bounds[:-1][size == 2]
            hit = two[((sig[two] == sig[two + 1]).sum(axis=1) >= match) & (label[two] != label[two + 1])]
            docs, src, dst = [ids[hit], ids[hit + 1]], [label[hit]], [label[hit + 1]]
            for g in np.flatnonzero(size > 2):
                a, b = bounds[g], bounds[g + 1]
                own = label[a:b]
                if (own == own[0]).all():
                    continue
                same = np.zeros((b - a, b - a), np.uint8)
                for c in np.ascontiguousarray(sig[a:b].T):
                    same += c[:, None] == c[None, :]
                linked = (same >= match) & (own[:, None] != own[None, :])
                docs.append(ids[a:b][linked.any(axis=1)])
                x, y = _label_edges(linked, own)
                src.append(x)
                dst.append(y)
            one, x, y = np.unique(np.concatenate(docs)), np.concatenate(src), np.concatenate(dst)
            none = lambda n: pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), none(len(one)), none(len(one))], ["doc_id", "src", "dst"])
            yield pa.RecordBatch.from_arrays([none(len(x)), pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["doc_id", "src", "dst"])
        release()

    return _chunked(members, "key", sig, BUCKET_CHUNK, parts, scratch).mapInArrow(work, "doc_id long, src long, dst long")


def intersections(sets: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of the pairwise intersections of sorted arrays of distinct hashes, by blocks of a 0/1 matrix product."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    row = np.repeat(np.arange(n), sizes)
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    new = np.append(True, every[1:] != every[:-1])
    shared = ~(new & np.append(new[1:], True))  # what one set alone has meets nothing
    col = np.cumsum(new & shared)[shared] - 1
    row = row[shared]
    out = np.zeros((n, n), np.float64)
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        lo, hi = np.searchsorted(col, [a, a + step])
        part = np.zeros((n, min(step, int(col[-1]) + 1 - a)), np.float32)
        part[row[lo:hi], col[lo:hi] - a] = 1
        out += part @ part.T
    out = np.rint(out).astype(np.int64)
    np.fill_diagonal(out, sizes)
    return out


def confirmed_edges(members: DataFrame, sets: DataFrame, num: int, den: int, parts: int, scratch: Scratch) -> DataFrame:
    """Forest edges between labels of the pairs with ``den * intersection >= num * union`` in each cluster of ``(cluster, label, doc_id)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 2):
            label = table.column("label").to_numpy()
            raw = table.column("shingles")
            src, dst = [], []
            bounds = _bounds(table, 2)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = label[a:b]
                if b - a < 2 or (own == own[0]).all():
                    continue
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw.slice(a, b - a)]
                size = np.array([len(s) for s in sets])
                common = intersections(sets)
                linked = (den * common >= num * (size[:, None] + size[None, :] - common)) & (own[:, None] != own[None, :])
                x, y = _label_edges(linked, own)
                src.append(x)
                dst.append(y)
            yield _edge_batch(src, dst)
        release()

    return _chunked(members, "cluster", sets, CLUSTER_CHUNK, parts, scratch).mapInArrow(work, "src long, dst long")


def leader_edges(pairs: DataFrame, sets: DataFrame, num: int, den: int, parts: int, scratch: Scratch) -> DataFrame:
    """The ``pairs(doc_id, leader)`` that are as similar as asked, from ``sets(doc_id, shingles)``.

    Classes of one leader are dealt into chunks, the leader's set once to each chunk.
    """
    chunk = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.ceil(F.col("_n") / CLUSTER_CHUNK)).cast("int")
    n = pairs.count()
    sizes = scratch.keep(pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("_n")), "led", n)
    dealt = scratch.keep(pairs.join(sizes, "leader").select("leader", chunk.alias("_chunk"), "doc_id"), "dealt", n)
    heads = dealt.select("leader", "_chunk").distinct().select("leader", "_chunk", F.col("leader").alias("doc_id"))
    rows = scratch.keep(dealt.unionByName(heads), "rows", 2 * n).join(sets, "doc_id").select("leader", "_chunk", "doc_id", "shingles")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 2):
            ids, leader = table.column("doc_id").to_numpy(), table.column("leader").to_numpy()
            raw = table.column("shingles")
            src, dst = [], []
            bounds = _bounds(table, 2)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                at = a + int(np.argmax(ids[a:b] == leader[a]))
                head = np.frombuffer(raw[at].as_buffer(), np.uint64)
                others = np.delete(np.arange(a, b), at - a)
                own = [np.frombuffer(raw[i].as_buffer(), np.uint64) for i in others.tolist()]
                size = np.array([len(s) for s in own], np.int64)
                every = np.concatenate(own)
                place = np.minimum(np.searchsorted(head, every), len(head) - 1)
                total = np.append(0, np.cumsum(head[place] == every))
                end = np.cumsum(size)
                common = total[end] - total[end - size]
                hit = others[den * common >= num * (size + len(head) - common)]
                src.append(ids[hit])
                dst.append(leader[hit])
            yield _edge_batch(src, dst)
        release()

    rows = rows.repartition(parts, "leader", "_chunk").sortWithinPartitions("leader", "_chunk")
    return rows.mapInArrow(work, "src long, dst long")


def _pairs_with_leaders(met: DataFrame, classes: DataFrame, match: int, scratch: Scratch) -> DataFrame:
    """``(doc_id, leader)`` of ``met(key, doc_id, leader)``: for each class the bucket leader it collides with most often in
    its prefix, if ``match`` times in all. One row a class at most."""
    n = classes.count()
    shared = met.filter("doc_id != leader").groupBy("doc_id", "leader").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("leader", F.struct("n", F.xxhash64("leader", F.lit(13)), "leader"))
    pairs = scratch.keep(shared.groupBy("doc_id").agg(best.alias("leader")), "proposed", n)
    sig = classes.select("doc_id", "sig")
    pairs = scratch.keep(pairs.join(sig, "doc_id").select("doc_id", "leader", F.col("sig").alias("own")), "own", n)
    pairs = pairs.join(sig.select(F.col("doc_id").alias("leader"), "sig"), "leader")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own, other = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(len(batch), -1) for i in (2, 3))
                yield batch.select(["doc_id", "leader"]).filter(pa.array((own == other).sum(axis=1) >= match))
        release()

    pairs = pairs.select("doc_id", "leader", "own", "sig").mapInArrow(work, "doc_id long, leader long")
    return scratch.keep(pairs, "pairs", n)


def _same_document(signed: DataFrame, able: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes of a doc_id that has several texts."""
    several = able.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    leads = able.join(several, "doc_id").select("doc_id", "set_a", "set_b").distinct()
    leads = leads.join(classes.select("set_a", "set_b", F.col("doc_id").alias("dst")), ["set_a", "set_b"])
    return leads.select(F.col("doc_id").alias("src"), "dst").distinct().filter("src != dst")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, num: int = 80, den: int = 100, coords: int = COORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``.

    Texts link when ``den * intersection >= num * union`` of their shingle sets;
    component_id is the least doc_id reachable, kept marks the row that has it.
    Null or blank texts have an empty set and link with nothing. Rows that share
    a doc_id are one document, each listed. A null doc_id takes no part: null
    component, kept. Texts of any length count whole. Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    match = match_threshold(num / den, coords)
    prefix = coords - match + 1
    signed = scratch.keep(signatures(docs, words_per_shingle, coords), "signed")

    able = signed.filter("n_shingles > 0 and doc_id is not null")
    least = F.min(F.struct("doc_id", "sig")).alias("least")
    classes = scratch.keep(able.groupBy("set_a", "set_b").agg(least).select("set_a", "set_b", "least.*"), "classes")
    sig = classes.select("doc_id", "sig")

    posted = postings(classes, coords)
    # written, so that the join deals both sides itself and can split a large key
    frequent = scratch.keep(posted.groupBy("key").agg(F.count(F.lit(1)).alias("posted")).filter("posted > 1"), "frequent")
    shared = posted.join(frequent, "key").groupBy("doc_id").agg(F.collect_list(F.struct("posted", "key")).alias("keys"))
    # ranks of pairs that no other class has come first, so they use up the prefix
    left = F.lit(prefix - coords) + F.size("keys")
    rare = shared.filter(F.size("keys") >= match).select("doc_id", F.slice(F.sort_array("keys"), 1, left).alias("keys"))
    first = scratch.keep(rare.select("doc_id", F.explode("keys.key").alias("key")), "prefix")
    scratch.drop(frequent)
    order = F.struct(F.xxhash64("doc_id", F.lit(13)), "doc_id")
    heads = first.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("l")).filter("n > 1")
    posts, many = first.count(), classes.count()
    heads = scratch.keep(heads.select("key", F.col("l.doc_id").alias("leader")), "heads", posts)
    met = scratch.keep(first.join(heads, "key"), "met", posts)
    scratch.drop(first)

    def sets_of(ids: DataFrame) -> DataFrame:
        return shingle_sets(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), words_per_shingle)

    pairs = _pairs_with_leaders(met, classes, match, scratch)
    sets = sets_of(pairs.select(F.explode(F.array("doc_id", "leader")).alias("doc_id")).distinct())
    links = leader_edges(pairs, sets, num, den, parts, scratch)
    links = scratch.keep(links.unionByName(_same_document(signed, able, classes)), "leads")
    labels = connected_components(links, scratch).select(F.col("node").alias("doc_id"), F.col("component").alias("label"))

    labelled = met.select("key", "doc_id").join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    labelled = scratch.keep(labelled, "labelled", posts)
    scratch.drop(met)
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    labelled = scratch.keep(labelled.join(scratch.keep(mixed.select("key"), "mixed", posts), "key"), "apart", posts)
    found = scratch.keep(meeting(labelled, sig, match, parts, scratch), "meeting")
    flagged = scratch.keep(found.select("doc_id").dropna().distinct(), "flagged", many)
    clusters = connected_components(found.select("src", "dst"), scratch)
    clusters = clusters.select(F.col("node").alias("label"), F.col("component").alias("cluster"))
    flagged = flagged.join(labels, "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("label"))
    flagged = scratch.keep(scratch.keep(flagged, "flagged", many).join(clusters, "label"), "clusters", many)
    links = confirmed_edges(flagged, sets_of(flagged.select("doc_id")), num, den, parts, scratch)
    links = scratch.keep(links.distinct(), "links", many)

    joined = connected_components(links, scratch).select(F.col("node").alias("label"), "component")
    named = classes.select("set_a", "set_b", "doc_id").join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    named = scratch.keep(named, "named", many).join(joined, "label", "left")
    named = scratch.keep(named.select("set_a", "set_b", F.coalesce("component", "label").alias("component")), "components", many)
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    reach = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", reach.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, **rule) -> DataFrame:
    """Rows of ``docs`` whose document stands for its group; columns as they were."""
    gone = near_duplicates(docs, **rule).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
