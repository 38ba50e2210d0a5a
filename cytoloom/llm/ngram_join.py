"""N-gram Jaccard join by signature trees.

A text's set is its distinct 4-word shingles, as 64-bit hashes. Equal sets are one class; its representative is the smallest
doc_id that has the set. Two sets whose Jaccard index is at least `percent` share one of the first n - ceil(percent n) + 1
shingles of either, in whatever order all agree on; ours is by hash, but with the corpus's frequent shingles last, by frequency. So
each class goes to the bucket of each shingle of that beginning, and no linked pair is missed. Buckets with the same smallest member
are searched as one, so that near copies meet once and not in each of their shingles.

Each bucket is searched with a signature tree. A set's signature is a bitmap of its shingles (two to four bits a shingle),
its size, and how many shingles share bits. A node holds the OR of its members' bitmaps, their range of sizes and the most
shared bits. The dual traversal drops a pair of nodes when their bitmaps' common bits, plus shared ones, cannot make
the overlap that the smallest sizes need. Nodes whose members are already joined are compared only until one pair passes, so a
bucket gives a spanning forest of its passing pairs. Every link is a passing pair, so it lies within one part of that forest.

The whole sets of each part then decide: they meet once, in blocks of at most `BLOCK` sets a side, where every pair whose sizes can
link is compared. A block counts its links (or lists them) and gives a spanning forest of them; from these come the components. A
group of g different texts that are all alike costs g * g / 2 comparisons of bitmaps, in as many tasks as it has pairs of
blocks: that is what counting all its links takes. Where links are not asked for, a large part is first compared with one of its members
(the hub), and pairs of texts that both link to the hub are not compared. A bucket of more than `cell` members is searched likewise.

Nulls: a null text is an empty one; a text without words has an empty set, is linked with nothing and is its own component.
A null doc_id takes part in no link and gets a null component unless an equal set has an id. Rows that share a doc_id are one
document: what one of them links to, all do. Very long texts are taken whole. Repeated rows each give a row, extra columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .components import components
from .staging import Staging
from .text import Words, small_batches

SLOTS = 1 << 27  # at most, of the filter that finds candidates' texts: 16 MB
SEEN = 100_000  # sets that a task remembers, to write copies once


def need(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that it links to."""
    return -(-percent * n // 100)


def least_overlap(a: int, b: int, percent: int) -> int:
    """The least overlap of linked sets of sizes a and b: 100 x >= percent (a + b - x)."""
    return -(-percent * (a + b) // (100 + percent))


# ---- signatures -----------------------------------------------------------------------------------------------------


def frequent_shingles(docs: DataFrame, k: int, staging: Staging, share: float = 1 / 100_000, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles found in at least `share` of the texts, at most `most` of them: only their order depends on it.

    A shingle of that share has it in some part of the table too, so parts list only their own frequent ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            on = c >= max(2, share * len(held))
            return pa.RecordBatch.from_arrays([pa.array(u[on].view(np.int64)), pa.array(c[on].astype(np.int64)), pa.array(np.full(int(on.sum()), 0, np.int64))], names=["shingle", "n", "texts"])

        total = size = 0
        for b in small_batches(batches):
            sets = Words(b.column("text")).shingles(k)
            held += sets
            total += len(sets)
            size += sum(map(len, sets))
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
        yield flush()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], names=["shingle", "n", "texts"])

    seen = docs.select("text").mapInArrow(run, "shingle long, n long, texts long").groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    total = F.max(F.when(F.col("shingle").isNull(), F.col("texts")))
    staged = staging.write(seen.filter("n >= 8 OR shingle IS NULL"), "counts")
    texts = staged.agg(total.alias("t")).first()["t"] or 0
    got = staged.filter(F.col("shingle").isNotNull() & (F.col("n") >= share * texts)).orderBy(F.col("n").desc(), "shingle").limit(most).select("shingle", "n").toPandas()
    staging.drop(staged)
    order = np.argsort(h := got.shingle.to_numpy(np.int64).view(np.uint64))
    return h[order], got.n.to_numpy(np.int64)[order]


def bitmap(shingles: np.ndarray) -> bytes:
    width = 64
    while width < 2 * len(shingles):
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(shingles >> np.uint64(7) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _often(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many texts have each shingle, 0 if it is not a frequent one."""
    keys, counts = frequent
    if not len(keys):
        return np.zeros(len(shingles), np.int64)
    at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
    return np.where(keys[at] == shingles, counts[at], 0)


def beginning(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The first n - need + 1 shingles in the common order."""
    m = len(shingles) - need(len(shingles), percent) + 1
    return shingles[np.argsort(_often(shingles, frequent), kind="stable")[:m]]


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat))


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, k: int, percent: int, staging: Staging) -> DataFrame:
    """doc_id, n, key (of the set), and rare, often (the beginning's shingles), bits: one row per row of docs.

    The last three are given once in a task for each set (null or empty in its copies), so a set that many rows have is routed a few times only.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, k, staging))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        none = np.zeros(0, np.uint64)
        for b in small_batches(batches):
            sets = Words(b.column("text")).shingles(k)
            keys, firsts, bits = [set_key(s) for s in sets], [], []
            for s, key, known in zip(sets, keys, b.column("doc_id").is_valid().to_pylist()):
                if not len(s) or not known or key in seen:
                    firsts.append((none, none))
                    bits.append(None)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                first = beginning(s, sent.value, percent)
                on = _often(first, sent.value) > 0
                firsts.append((first[~on], first[on]))
                bits.append(bitmap(s))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.binary()), _lists([f[0] for f in firsts]), _lists([f[1] for f in firsts]), pa.array(bits, pa.binary())],
                names=["doc_id", "n", "key", "rare", "often", "bits"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n int, key binary, rare array<long>, often array<long>, bits binary")


# ---- the tree -------------------------------------------------------------------------------------------------------

FAN = 8


class Node:
    """Members below it, the OR of their bitmaps, their range of sizes, the most shingles that share bits; joined: all members are."""

    __slots__ = ("bits", "width", "low", "high", "shared", "kids", "member", "joined")

    def __init__(self, bits: int, width: int, low: int, high: int, shared: int, kids: list | None = None, member: int = -1):
        self.bits, self.width, self.low, self.high, self.shared, self.kids, self.member, self.joined = bits, width, low, high, shared, kids, member, kids is None


def fold(bits: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


def leaf(member: int, n: int, raw: bytes) -> Node:
    bits = int.from_bytes(raw, "little")
    return Node(bits, 8 * len(raw), n, n, n - bits.bit_count(), None, member)


def grown(nodes: list[Node]) -> Node:
    """The tree over leaves that come by size: neighbours share a parent."""
    while len(nodes) > 1:
        up = []
        for i in range(0, len(nodes), FAN):
            kids = nodes[i : i + FAN]
            width = min(x.width for x in kids)
            bits = 0
            for x in kids:
                bits |= fold(x.bits, x.width, width)
            # folding lets more shingles share a bit, by at most the bits it loses
            shared = max(x.shared + x.bits.bit_count() - fold(x.bits, x.width, width).bit_count() for x in kids)
            up.append(Node(bits, width, min(x.low for x in kids), max(x.high for x in kids), shared, kids))
        nodes = up
    return nodes[0]


class Search:
    """Dual traversal of a tree with itself or with another; joins members by passing pairs and lists these."""

    def __init__(self, n: int, percent: int, forest: bool):
        self.up, self.percent, self.forest, self.pairs = list(range(n)), percent, forest, []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def may(self, p: Node, q: Node) -> bool:
        """Can any member of p link to any of q?"""
        if 100 * p.high < self.percent * q.low or 100 * q.high < self.percent * p.low:
            return False
        width = min(p.width, q.width)
        a, b = fold(p.bits, p.width, width), fold(q.bits, q.width, width)
        lost_p = p.shared + (p.bits.bit_count() - a.bit_count() if p.width > width else 0)
        lost_q = q.shared + (q.bits.bit_count() - b.bit_count() if q.width > width else 0)
        return (a & b).bit_count() + min(lost_p, lost_q) >= least_overlap(p.low, q.low, self.percent)

    @staticmethod
    def some(p: Node) -> int:
        while p.kids:
            p = p.kids[0]
        return p.member

    def within(self, p: Node) -> None:
        if p.kids is None:
            return
        for x in p.kids:
            self.within(x)
        for i, x in enumerate(p.kids):
            for y in p.kids[:i]:
                self.between(y, x)
        p.joined = all(x.joined for x in p.kids) and len({self.root(self.some(x)) for x in p.kids}) == 1

    def between(self, p: Node, q: Node) -> bool:
        """True once p and q, each joined in itself, have become one part."""
        whole = p.joined and q.joined
        if whole and self.root(self.some(p)) == self.root(self.some(q)):
            return True
        if not self.may(p, q):
            return False
        if p.kids is None and q.kids is None:
            self.pairs.append((p.member, q.member))
            if self.forest:
                self.up[self.root(p.member)] = self.root(q.member)
            return self.forest
        big, other = (p, q) if q.kids is None or (p.kids is not None and p.high - p.low >= q.high - q.low) else (q, p)
        for x in big.kids:
            if self.between(x, other) and whole and self.forest:
                return True
        return False


def search(members: list[tuple[int, int, bytes, int, int]], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the passing pairs among members (id, n, bits, part, cell side); members of one part are joined already; sides, if two, are compared across."""
    sides = sorted({m[4] for m in members})
    s = Search(len(members), percent, True)
    firsts: dict[int, int] = {}
    for i, m in enumerate(members):
        s.up[i] = firsts.setdefault(m[3], i)
    leaves = [leaf(i, m[1], m[2]) for i, m in enumerate(members)]
    # by size, but members of one part together, so that their nodes are joined and need no look inside
    size: dict[int, int] = {}
    for m in members:
        size[m[3]] = min(size.get(m[3], m[1]), m[1])
    order = sorted(range(len(members)), key=lambda i: (size[members[i][3]], members[i][3], members[i][1], members[i][0]))
    if len(sides) == 1:
        if len(members) > 2:  # a first star about the lowest id gives the same pairs in many buckets
            hub = min(range(len(members)), key=lambda i: members[i][0])
            for i in order:
                if i != hub:
                    s.between(leaves[hub], leaves[i])
        s.within(grown([leaves[i] for i in order]))
    else:
        trees = [grown([leaves[i] for i in order if members[i][4] == side]) for side in sides]
        for t in trees:
            mark_joined(t, s)
        s.between(*trees)
    return [(members[i][0], members[j][0]) for i, j in s.pairs if members[i][0] != members[j][0]]


def mark_joined(p: Node, s: Search) -> None:
    for x in p.kids or ():
        mark_joined(x, s)
    if p.kids:
        p.joined = all(x.joined for x in p.kids) and len({s.root(s.some(x)) for x in p.kids}) == 1


def cell_pairs(rows: DataFrame, group: str, cells) -> DataFrame:
    """group, id, own, i, j: the pairs of cells that each row is compared in. rows: group, id, n, rest.

    cells(rows, shingles) of a group gives how many its rows are dealt to; rows that are not `rest` are compared with those of `rest` only.
    """
    sizes = rows.groupBy(group).agg(
        cells(F.count_if("rest"), F.sum(F.when(F.col("rest"), F.col("n")))).alias("r"), cells(F.count_if(~F.col("rest")), F.sum(F.when(~F.col("rest"), F.col("n")))).alias("l")
    )
    spread = lambda c: F.pmod(F.xxhash64("id"), F.greatest(F.col(c), F.lit(1))).cast("int")
    own = rows.join(sizes, group).withColumn("own", F.when(F.col("rest"), spread("r")).otherwise(F.col("r") + spread("l")))
    last = F.when(F.col("rest"), F.col("r") + F.col("l")).otherwise(F.col("r")) - 1
    both = own.withColumn("other", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))))
    return both.select(group, "id", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def against_hub(rows: DataFrame, group: str, size: int, test) -> DataFrame:
    """group, id of the rows that pass test(n, raw, n of hub, raw of hub) with their group's hub. rows: group, id, n, raw, hub, members; about `size` rows a task."""
    salts = F.ceil(F.col("members") / size).cast("int")
    dealt = rows.withColumn("salt", F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), salts).cast("int")))))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = dealt.select(group, "salt", "hub", "id", "n", "raw").repartition(parts, group, "salt").sortWithinPartitions(group, "salt", F.desc("hub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hubs = None, []
        for b in batches:
            out = []
            for g, salt, hub, i, n, raw in zip(*(c.to_pylist() for c in b.columns)):
                if (g, salt) != key:
                    key, hubs = (g, salt), []
                if hub:
                    hubs.append((n, raw))
                elif any(test(n, raw, *h) for h in hubs):
                    out.append((g, i))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=[group, "id"])

    return together.mapInArrow(run, f"{group} long, id long").distinct()


def candidate_pairs(members: DataFrame, percent: int) -> DataFrame:
    """a, b: spanning forests of the passing pairs. members: bucket, i, j, own, part, id, n, bits."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = members.select("bucket", "i", "j", "id", "n", "bits", "part", "own").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, {}, []

        def close() -> None:
            if len(held) > 1 and (key[1] == key[2] or len({m[4] for m in held.values()}) == 2):
                out.extend((min(p), max(p)) for p in search(list(held.values()), percent))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:3] != key:
                    close()
                    key, held = row[:3], {}
                held[row[3], row[5]] = row[3:]  # a set that several tasks have given is one member
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        close()
        yield _pairs(out)

    return together.mapInArrow(run, "a long, b long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def shared_buckets(signed: DataFrame, staging: Staging) -> DataFrame:
    """bucket, id, members: the buckets of shingles with at least two members, named by the smallest; those of one name are one.

    The rare shingles' rows meet in windows (a rare one has few rows). Of a frequent one, which any share of the rows may
    have, only the smallest member is looked up; the frequent ones are listed in at most half a million rows, so that table is broadcast.
    """
    rare = signed.select(F.explode("rare").alias("shingle"), "id")
    of_shingle = Window.partitionBy("shingle")
    met = rare.select("id", F.min("id").over(of_shingle).alias("bucket"), F.max("id").over(of_shingle).alias("top")).filter("bucket < top").select("bucket", "id")
    often = signed.select(F.explode("often").alias("shingle"), "id")
    lowest = often.groupBy("shingle").agg(F.min("id").alias("bucket"), F.max("id").alias("top")).filter("bucket < top").select("shingle", "bucket")
    hot = often.join(F.broadcast(lowest), "shingle").select("bucket", "id")
    merged = staging.write(met.unionByName(hot).distinct(), "postings")
    return staging.write(merged.join(merged.groupBy("bucket").agg(F.count("*").alias("members")), "bucket"), "buckets")


def passing(signed: DataFrame, percent: int, cell: int, staging: Staging) -> DataFrame:
    """a, b: pairs of ids of sets, in spanning forests of all pairs that may link. signed: id, n, rare, often, bits."""
    met = shared_buckets(signed, staging)
    # a set may be given by several tasks; its rows meet where the join needs them
    light = signed.filter("bits IS NOT NULL").select("id", "n", "bits")
    large = met.filter(F.col("members") > cell)
    whole = met.filter(F.col("members") <= cell).join(light, "id")
    zero = F.lit(0)
    found = candidate_pairs(whole.select("bucket", zero.alias("i"), zero.alias("j"), zero.alias("own"), F.col("id").alias("part"), "id", "n", "bits"), percent)
    if large.isEmpty():
        return found
    rows = staging.write(large.join(light, "id").dropDuplicates(["bucket", "id", "bits"]), "large")
    s = Search(0, percent, False)
    near = staging.write(
        against_hub(rows.select("bucket", "id", "n", F.col("bits").alias("raw"), (F.col("id") == F.col("bucket")).alias("hub"), "members"), "bucket", cell, lambda n, raw, m, hub: s.may(leaf(0, n, raw), leaf(1, m, hub))), "near-hub"
    )
    flagged = rows.select("bucket", "id", "n", (F.col("id") != F.col("bucket")).alias("other")).join(near.withColumn("near", F.lit(True)), ["bucket", "id"], "left")
    rest = flagged.select("bucket", "id", "n", (F.col("other") & F.col("near").isNull()).alias("rest")).distinct()
    dealt = cell_pairs(rest, "bucket", lambda rows, _: F.ceil(rows / cell).cast("int"))
    part = F.when(F.col("rest"), F.col("id")).otherwise(F.col("bucket"))
    members = rows.select("bucket", "id", "n", "bits").join(rest.select("bucket", "id", part.alias("part")).distinct(), ["bucket", "id"]).join(dealt, ["bucket", "id"])
    return found.unionByName(near.select(F.col("bucket").alias("a"), F.col("id").alias("b"))).unionByName(candidate_pairs(members, percent))


# ---- whole sets -----------------------------------------------------------------------------------------------------


def whole_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """key, set (packed hashes) of texts with a doc_id of ids (id), and of few others: a filter that grows with ids up to `SLOTS` finds them."""
    slots = 1 << 16
    while slots < min(SLOTS, 32 * ids.count()):
        slots *= 2
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots))
    marked = ids.select((slot("id") + 1).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    on = np.zeros(-(-slots // 32768) * 4096, np.uint8)
    for r in marked.collect():  # a row for each 32,768 slots
        on[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, seen = sent.value, set()
        for b in batches:
            s = b.column("slot").to_numpy()
            few = b.filter(pa.array((on[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)))
            for part in small_batches(iter([few])):
                sets = {set_key(x): x for x in Words(part.column("text")).shingles(k) if len(x)}
                fresh = [key for key in sets if key not in seen]
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(fresh)
                yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.binary()), pa.array([sets[key].tobytes() for key in fresh], pa.binary())], names=["key", "set"])

    near = docs.filter("doc_id IS NOT NULL").select(slot(F.col("doc_id").cast("long")).alias("slot"), "text")
    return near.mapInArrow(run, "key binary, set binary")


BLOCK, WEIGHT = 2048, 1 << 20  # sets and shingles of a side, about


def overlaps(one: list[np.ndarray], two: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> Iterator[np.ndarray]:
    """For each set of one, how many shingles it has in common with two[low:high]. Shingles of a single set are left out; the rest are compared as bitmaps, or as lists where bitmaps would be wider."""
    both = one if one is two else [*one, *two]
    size = np.array([len(x) for x in both])
    keys, at, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    on = times[at] > 1
    at, row = place[at[on]], np.repeat(np.arange(len(both)), size)[on]
    width = -(-max(int(place[-1]) + 1, 1) // 64)
    first = 0 if one is two else len(one)
    if width <= 2 * len(at) // max(len(both), 1) + 8:
        bits = np.zeros((len(both), width), np.uint64)
        np.bitwise_or.at(bits, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        for i in range(len(one)):
            yield np.bitwise_count(bits[first + low[i] : first + high[i]] & bits[i]).sum(1, dtype=np.int64)
        return
    edge = np.searchsorted(row, np.arange(len(both) + 1))
    mark = np.zeros(int(place[-1]) + 1, np.int64)
    for i in range(len(one)):
        mark[at[edge[i] : edge[i + 1]]] = 1
        cuts = edge[first + low[i] : first + high[i] + 1]
        sums = np.concatenate(([0], np.cumsum(mark[at[cuts[0] : cuts[-1]]]))) if len(cuts) else np.zeros(1, np.int64)
        mark[at[edge[i] : edge[i + 1]]] = 0
        yield np.diff(sums[cuts - cuts[0]]) if len(cuts) > 1 else np.zeros(0, np.int64)


def linked_in(members: list[tuple[int, int, np.ndarray]], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(id, ids linked to it) with each linked pair once, among members (id, side, set); two sides are compared across. An id may have several sets."""
    members = sorted(members, key=lambda m: len(m[2]))
    sides = sorted({m[1] for m in members})
    one, two = ([m for m in members if m[1] == side] for side in (sides[0], sides[-1]))
    ids, size = np.array([m[0] for m in two]), np.array([len(m[2]) for m in two])
    own = size if len(sides) == 1 else np.array([len(m[2]) for m in one])
    low, high = np.searchsorted(size, -(-percent * own // 100)), np.searchsorted(size, 100 * own // percent, "right")
    left = [m[2] for m in one]
    found: dict[int, list[np.ndarray]] = {}
    for n, both in enumerate(overlaps(left, left if len(sides) == 1 else [m[2] for m in two], low, high)):
        i, span = one[n][0], slice(low[n], high[n])
        near = ids[span][(both > 0) & (100 * both >= percent * (own[n] + size[span] - both))]
        found.setdefault(i, []).append(near[near > i] if len(sides) == 1 else near[near != i])
    for i, near in found.items():
        if len(each := np.unique(np.concatenate(near))):
            yield i, each


def judged(docs: DataFrame, classes: DataFrame, parts: DataFrame, k: int, percent: int, give: str, staging: Staging) -> DataFrame:
    """a, b, n of the links of representatives, each pair of texts compared in one block of its part.

    give "pairs": all links (a, b); "forest": a spanning forest of them; "counts": that, and rows (a, null, n) that add up to a's links.
    """
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = staging.write(classes.join(parts.select(F.col("node").alias("id"), "component"), "id").select("component", "key", "rep", "n"), "members")
    sets = whole_sets(docs, members.select(F.col("rep").alias("id")), k)
    rows = members.groupBy("component", F.col("rep").alias("id")).agg(F.sum("n").alias("n")).withColumn("rest", F.lit(True))
    edges = None
    if give == "forest":
        groups = rows.groupBy("component").agg(F.count("*").alias("members"), F.min("id").alias("hub")).filter(F.col("members") > BLOCK)
        if not groups.isEmpty():
            groups = staging.write(groups, "large")
            whole = members.join(groups, "component").join(sets, "key").select("component", F.col("rep").alias("id"), "n", F.col("set").alias("raw"), (F.col("rep") == F.col("hub")).alias("hub"), "members")

            def linked(n: int, raw: bytes, m: int, hub: bytes) -> bool:
                both = len(np.intersect1d(np.frombuffer(raw, np.uint64), np.frombuffer(hub, np.uint64), assume_unique=True))
                return both > 0 and 100 * both >= percent * (n + m - both)

            near = staging.write(against_hub(whole, "component", BLOCK, linked), "near-hub")
            edges = near.join(groups, "component").select(F.col("hub").alias("a"), F.col("id").alias("b"), F.lit(None).cast("long").alias("n"))
            done = near.unionByName(groups.select("component", F.col("hub").alias("id"))).withColumn("done", F.lit(True))
            rows = rows.join(done, ["component", "id"], "left").select("component", "id", "n", F.col("done").isNull().alias("rest"))
    cells = lambda rows, shingles: F.greatest(F.ceil(rows / BLOCK), F.ceil(F.coalesce(shingles, F.lit(0)) / WEIGHT)).cast("int")
    cut = members.withColumnRenamed("rep", "id").join(cell_pairs(rows, "component", cells), ["component", "id"])
    together = cut.join(sets, "key").select("component", "i", "j", "own", "id", "key", "set").repartition(shuffles, "component", "i", "j").sortWithinPartitions("component", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}

        def close() -> Iterator[pa.RecordBatch]:
            members = list(held.values())
            if len(members) < 2 or (group[1] != group[2] and len({m[1] for m in members}) < 2):
                return
            ids = np.unique([m[0] for m in members])
            count, label, edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
            for i, near in linked_in(members, percent):
                if give == "pairs":
                    yield _links(np.minimum(near, i), np.maximum(near, i), None)
                    continue
                at, there = int(np.searchsorted(ids, i)), np.searchsorted(ids, near)
                count[at] += len(there)
                count[there] += 1
                new = there[np.unique(label[there], return_index=True)[1]]
                for x in new[label[new] != label[at]].tolist():
                    edges.append((i, int(ids[x])))
                    label[label == label[x]] = label[at]
            if edges:
                yield _links(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]), None)
            if give == "counts" and (has := np.flatnonzero(count)).size:
                yield _links(ids[has], None, count[has])

        for b in batches:
            for *new, own, i, key, raw in zip(*(c.to_pylist() for c in b.columns)):
                if new != group:
                    yield from close()
                    group, held = new, {}
                held[key, i] = (i, own, np.frombuffer(raw, np.uint64))
        yield from close()

    out = together.mapInArrow(run, "a long, b long, n long")
    return out if edges is None else out.unionByName(edges)


def _links(a: np.ndarray, b: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (a, b, n)], names=["a", "b", "n"])


def _judged_parts(docs: DataFrame, k: int, percent: int, cell: int, give: str, staging: Staging) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(doc_id, n, key of all rows; the classes; the links; pairs of representatives that one document has, or none)."""
    full = staging.write(signatures(docs, k, percent, staging), "signatures")
    keys = staging.write(full.select("doc_id", "n", "key"), "keys")
    known = keys.filter("n > 0 AND doc_id IS NOT NULL")
    classes = staging.write(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")).withColumn("id", F.xxhash64("key")), "classes")
    tried = staging.write(passing(full.withColumn("id", F.xxhash64("key")), percent, cell, staging), "candidates")
    staging.drop(full)
    several = known.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("top")).filter("low < top").select("doc_id", "low")
    same = None
    if not several.isEmpty():  # a document of several texts
        twins = staging.write(known.join(several, "doc_id").filter("key <> low").select("low", "key").distinct(), "twins")
        tried = tried.unionByName(twins.select(F.xxhash64("low").alias("a"), F.xxhash64("key").alias("b")))
        rep = lambda c, to: classes.select(F.col("key").alias(c), F.col("rep").alias(to))
        same = twins.join(rep("low", "a"), "low").join(rep("key", "b"), "key").select("a", "b")
    parts = components(tried, staging)
    return keys, classes, staging.write(judged(docs, classes, parts, k, percent, give, staging), "links"), same


def link_components(docs: DataFrame, k: int = 4, percent: int = 85, cell: int = 512, links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), class_id (the smallest doc_id with an equal set), n_links.

    n_links counts the other representatives that the class's representative links to; without `links` the column is left out.
    """
    staging = Staging(docs.sparkSession, "ngram-join")
    keys, classes, found, same = _judged_parts(docs, k, percent, cell, "counts" if links else "forest", staging)
    edges = found.filter("b IS NOT NULL").select("a", "b")
    parts = components(edges if same is None else edges.unionByName(same), staging)
    named = classes.select("key", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    if links:
        named = named.join(found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links")), "rep", "left")
    out = keys.join(named, "key", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    counted = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if links else []
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"), *counted)


def linked_pairs(docs: DataFrame, k: int = 4, percent: int = 85, cell: int = 512) -> DataFrame:
    """a, b (a < b) of all linked pairs of class representatives."""
    return _judged_parts(docs, k, percent, cell, "pairs", Staging(docs.sparkSession, "ngram-join"))[2].select("a", "b")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: the one with the smallest id (of wholly repeated rows, one). Texts without words are each kept. Columns stay."""
    linked = link_components(docs, k, percent, links=False)
    gone = linked.filter("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"))
    rest = row.join(gone, "id", "left_anti")
    repeated = row.groupBy("id").count().filter("count > 1").select(F.col("id").alias("again"))
    if repeated.isEmpty():
        return rest.select("row.*")
    once = rest.join(repeated, F.col("id").eqNullSafe(F.col("again")), "left_semi").select("row.*").dropDuplicates()
    return rest.join(repeated, F.col("id").eqNullSafe(F.col("again")), "left_anti").select("row.*").unionByName(once)


def op4_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
