"""Operator 7: near-duplicates by a signature-coordinate inverted join.

Documents with the same set of word shingles form a class, found by a 128-bit
hash of the set with map-side partial aggregation, so copies never meet as
pairs.  Every class has a MinHash signature of ``BANDS * ROWS`` values.  It is
posted under coordinate-value pairs, a coordinate being ``ROWS`` neighbouring
signature values: unrelated texts that share one passage seldom agree on all of
them, and two classes with a similarity of 0.8 share no coordinate with a
chance of (1 - 0.8 ** ROWS) ** BANDS, below one in a million.

A posting list is not expanded into all its pairs.  In the first pass each
member meets the list's least member and, under a quarter of the coordinates,
its neighbour in an order of the list's own, cut into pieces of bounded size.  Collisions of the two signatures
are counted over all values, pairs below ``MATCHES`` are dropped, and the rest
are confirmed on the full shingle sets.  The second pass skips every list whose
members are in one component by then.  The others are dealt into blocks of at
most two pieces, so that any two members meet in one block of bounded size.
A block merges in memory: it compares signatures of members in different
components, each pair only at the first coordinate that it shares, confirms
candidates on the full sets, and skips a pair once a link has joined its
components.  What leaves a block is links alone, fewer than it has members,
and no link between components is lost.

Components are found by min-label propagation with pointer jumping, each round
checkpointed.  Nothing but counts reaches the driver.

Defined results: A-Z is lower-cased; null texts and texts without words have an
empty set, link with nothing and are their own component; fewer words than a
shingle are one shingle; rows with the same set are linked whatever their ids;
a null id's component is the least id of its class, null if there is none; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emoscope.llm.common import kept_by_worker, saved, text_of

ROWS, BANDS = 4, 28
#: Signature values of 112 on which a pair has to agree; at 0.8 it agrees on 90 on average, on fewer than 67 in one of ten million.
MATCHES = 67
PIECE = 1024
#: Shingles of a piece, about (8 MB); a block holds the full sets of two pieces.
PIECE_SHINGLES = 1 << 20
BROADCAST_ROWS = 300_000
_SPACE = bytes(range(65, 91))
_LOWER = bytes.maketrans(_SPACE, _SPACE.lower())
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_random = np.random.RandomState(20240607)
_A = (_random.randint(0, 1 << 62, ROWS * BANDS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _random.randint(0, 1 << 62, ROWS * BANDS, dtype=np.int64).astype(np.uint64)


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    words = text.encode("utf-8").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    own = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in number), np.uint64)
    h = own[ids]
    n = max(1, len(words) - size + 1)
    out = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for k in range(min(size, len(words))):  # mixes in order, so that order counts
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(out)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each) of a non-empty set."""
    out = np.full(ROWS * BANDS, _MASK)
    for lo in range(0, len(shingles), 4096):
        part = shingles[lo:lo + 4096]
        out = np.minimum(out, (_A[:, None] * part + _B[:, None]).min(1))
    return out >> np.uint64(32)


def coordinates(values: np.ndarray) -> np.ndarray:
    """A hash of each coordinate (by its place) and the signature values it takes."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + values[r::ROWS])
    return out.view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, node, keys, sig``: set size, 128-bit set hash (null for
    the empty set), the coordinate-value pairs as hashes, and a sketch of the
    signature, the low byte of every value, which collides wherever the values do."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("near_dedup")
        for batch in batches:
            counts, nodes, keys, sigs = [], [], [], []
            for x in batch.column(2):
                s = shingle_hashes(x.as_py() or "", size)
                counts.append(len(s))
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                values = signature(s) if len(s) else None
                keys.append(coordinates(values) if len(s) else None)
                sigs.append(values.astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "node", "keys", "sig"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"),
                       "text").mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, node binary, keys array<long>, sig binary")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """``node, shingles`` of every document with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("near_dedup")
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                sets = [shingle_hashes(x.as_py() or "", size) for x in batch.column(0).slice(lo, 128)]
                sets = [s for s in sets if len(s)]
                nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["node", "shingles"])
    return docs.select("text").mapInArrow(run, "node binary, shingles array<long>")


def postings(classes: DataFrame) -> DataFrame:
    """``key, band, node, n, least, pieces``: the posting lists with at least two members, and into how
    many pieces of bounded size the members go, by their number and by the size of their sets."""
    posts = classes.select("node", "n_shingles", F.posexplode("keys").alias("band", "key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"),
                                     F.sum("n_shingles").alias("size")).filter("n > 1")
    pieces = F.ceil(F.greatest(F.col("n") / PIECE, F.col("size") / PIECE_SHINGLES)).cast("int")
    return saved(posts.drop("n_shingles").join(lists.withColumn("pieces", pieces).drop("size"), "key"))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def first_pairs(posts: DataFrame) -> DataFrame:
    """Each member with its list's least member and with its neighbour in the list's own order."""
    star = posts.filter("node != least").select(*_ordered(F.col("least"), F.col("node")))
    # neighbours under a quarter of the coordinates join most families; the second pass finds the rest
    some = posts.filter(F.col("band") % 4 == 0)
    own = F.xxhash64("key", "node")
    piece = F.pmod(own, F.ceil(F.col("n") / PIECE))  # by number alone: the sets are not held here
    order = Window.partitionBy("key", "_piece").orderBy("_own", "node")
    chain = (some.withColumn("_own", own).withColumn("_piece", piece)
             .withColumn("next", F.lead("node").over(order)).filter("next is not null")
             .select(*_ordered(F.col("node"), F.col("next"))))
    return star.unionByName(chain).distinct()


def open_blocks(posts: DataFrame, component: DataFrame) -> DataFrame:
    """``g, band, cross, side, lab, node``: members of the lists that hold more than
    one component, dealt into blocks ``g``.  A block takes one piece of a list
    with itself or two with each other (``cross``; ``side`` tells them apart)."""
    at = posts.select("key", "band", "pieces", "node").join(component, "node", "left").select(
        "key", "band", "pieces", "node", F.xxhash64(F.coalesce("label", "node")).alias("lab"))
    several = at.groupBy("key").agg((F.min("lab") != F.max("lab")).alias("several")).filter("several").select("key")
    rows = at.join(several, "key").withColumn("piece", F.pmod(F.xxhash64("node", "key"), "pieces").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    low, high = F.least("piece", "other"), F.greatest("piece", "other")
    return rows.select(F.xxhash64("key", low, high).alias("g"), "band", (low != high).alias("cross"),
                       (F.col("piece") == low).alias("side"), "lab", "node")


class _Block:
    """The members of one block, and its candidate pairs."""

    def __init__(self, rows: pa.Table, sig: np.ndarray, keys: np.ndarray):
        self.band = rows.column("band")[0].as_py()
        self.cross = rows.column("cross")[0].as_py()
        self.side = rows.column("side").to_numpy()
        self.lab = rows.column("lab").to_numpy()
        self.nodes = rows.column("node").to_pylist()
        self.sig, self.keys = sig, keys

    def candidates(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """Members after ``x`` that it may link with, and their collisions."""
        same = self.sig[x + 1:] == self.sig[x]
        hits = same.sum(1)
        good = (hits >= MATCHES) & (self.lab[x + 1:] != self.lab[x])
        if self.cross:
            good &= self.side[x + 1:] != self.side[x]
        at = np.flatnonzero(good)
        if len(at):  # a pair belongs to the first list that it shares; sketches may collide where values do not
            first = (self.keys[at + x + 1] == self.keys[x]).argmax(1)
            at = at[first == self.band]
        return at + x + 1, hits[at]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by ``g`` as one table for each block."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        g = table.column("g").to_numpy()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _sorted_blocks(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "g").sortWithinPartitions("g", "node")


def open_members(blocks: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of ``blocks`` that have a candidate partner in their block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("near_dedup")
        for rows in _blocks(batches):
            sig = _matrix(rows.column("sig"))
            keys = np.concatenate([x.values.to_numpy() for x in rows.column("keys")]).reshape(-1, BANDS)
            rows = rows.drop_columns(["sig", "keys"])
            block, keep = _Block(rows, sig, keys), set()
            for x in range(len(rows) - 1):
                found = block.candidates(x)[0].tolist()
                keep.update(found)
                if found:
                    keep.add(x)
            if keep:
                yield from rows.take(sorted(keep)).to_batches()

    rows = blocks.join(classes.select("node", "sig", "keys"), "node").select(
        "g", "band", "cross", "side", "lab", "node", "sig", "keys")
    return _sorted_blocks(rows).mapInArrow(run, rows.drop("sig", "keys").schema)


def merged_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: confirmed links between components, block by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("near_dedup")
        for rows in _blocks(batches):
            # signatures are computed anew: cheaper than to carry them along
            full = [x.values.to_numpy() for x in rows.column("shingles")]
            values = [signature(x.view(np.uint64)) for x in full]
            block = _Block(rows, np.stack(values).astype(np.uint8), np.stack([coordinates(v) for v in values]))
            root = {int(v): int(v) for v in block.lab}

            def find(v: int) -> int:
                while root[v] != v:
                    root[v] = v = root[root[v]]
                return v

            links = []
            for x in range(len(rows) - 1):
                at, hits = block.candidates(x)
                for y in at[np.argsort(-hits, kind="stable")].tolist():  # likeliest first
                    p, q = find(int(block.lab[x])), find(int(block.lab[y]))
                    if p == q:
                        continue
                    both = len(np.intersect1d(full[x], full[y], assume_unique=True))
                    if 100 * both >= percent * (len(full[x]) + len(full[y]) - both):
                        root[p] = q
                        links.append(sorted((block.nodes[x], block.nodes[y])))
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())],
                                                 names=["a", "b"])

    return _sorted_blocks(members.join(sets, "node")).mapInArrow(run, "a binary, b binary")


def similar_signatures(pairs: DataFrame, classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """Pairs whose signatures collide on at least ``matches`` values."""
    left = classes.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    right = classes.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("near_dedup")
        for batch in batches:
            if batch.num_rows:
                hits = (_matrix(batch.column("sa")) == _matrix(batch.column("sb"))).sum(1)
                yield batch.select(["a", "b"]).filter(pa.array(hits >= matches))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _matrix(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, ROWS * BANDS)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - both
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * either).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the least node reachable, for every node of a link."""
    edges = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = saved(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
                  .select(F.col("a").alias("node"), "label"))
    while True:
        near = (edges.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")))
        least = label.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = saved(least.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")))
        changed = new.filter("old != label").limit(1).count()
        label = new.select("node", "label")
        if not changed:
            return label


def _sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``node, shingles`` of the classes in ``nodes``, from their representative documents."""
    ids = saved(nodes.distinct().join(classes.select("node", "rep"), "node").select("rep").distinct())
    # a bound that is checked; beyond it the join shuffles
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = thin.join(ids, thin["doc_id"].eqNullSafe(ids["rep"]), "leftsemi")
    return saved(shingle_sets(texts, size).dropDuplicates(["node"]))


def labelled(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``signatures`` of every document, and ``node, rep, label`` of every class
    (the least id of its documents and its component)."""
    signed = saved(signatures(docs, size))
    classes = saved(signed.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"),
        F.first("sig").alias("sig")))
    posts = postings(classes)

    close = saved(similar_signatures(first_pairs(posts), classes))
    nodes = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node")))
    links = saved(confirmed(close, _sets_of(docs, classes, nodes, size), percent))
    members = saved(open_members(open_blocks(posts, components(links)), classes))
    more = saved(merged_links(members, _sets_of(docs, classes, members.select("node"), size), percent))
    label = components(links.unionByName(more))
    return signed, classes.select("node", "rep").join(label, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document."""
    signed, named = labelled(docs, size, percent)
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of = named.join(least, "label").select(F.col("node").alias("_node"), F.col("component_id").alias("_c"))
    # null nodes (empty sets) match nothing and keep their own id
    done = signed.select("doc_id", "n_shingles", "node").join(of, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("_c"))
    return done.select("doc_id", "n_shingles", component.alias("component_id"),
                       F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the near-duplicates: one row of each component stays, the
    one with the least id (none sorts last) and then the least text hash.  Rows
    without words are in no component and stay."""
    signed, named = labelled(docs, size, percent)
    rows = saved(signed.filter("node is not null").groupBy("doc_id", "text_hash", "node").agg(F.count("*").alias("n")))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    of = saved(rows.groupBy("node").agg(F.min(key).alias("own")).join(named.select("node", "label"), "node"))
    best = of.join(of.groupBy("label").agg(F.min("own").alias("best")), "label").select("node", "best")
    marks = rows.join(best, "node").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"), "n",
                                            (key != F.col("best")).alias("_gone"))
    marks = saved(marks.filter("_gone or n > 1"))  # what is not in here stays as it is
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_rid"),
                         F.xxhash64(text_of()).alias("_rth"))
    same = F.col("_rid").eqNullSafe(F.col("_id")) & (F.col("_rth") == F.col("_th"))
    single = packed.join(marks, same, "leftanti").select("_row.*")
    repeated = marks.filter("not _gone")
    if not repeated.limit(1).count():
        return single
    one = packed.join(repeated, same, "leftsemi").dropDuplicates(["_rid", "_rth"])
    return single.unionByName(one.select("_row.*"))
