"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Exact for any threshold on sets of word shingles:

1. Documents are cut into blocks; a block deals its shingles to buckets of hash
   ranges, and a bucket tells which shingles occur in more than one set, and in
   how many. Shingles that many sets of a block hold are counted there first, so
   a passage in every document is an entry a block, not an entry a set.
2. A set links only if it shares enough; its rarest shingles (a prefix in the
   order of frequency) must meet a partner's prefix. Sets that meet form
   families; equal sets were made one before.
3. Within a family, or a pair of blocks of a large one, inverted lists are
   searched: short lists are merged, long ones are probed, and sets that reach
   the required overlap are linked. Pairs already connected are not counted
   again, so copies never expand into all pairs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import mixed, pack_sorted, plain_words, saved, slices, unpack_sorted
from sieveline.llm.components import components
from sieveline.llm.ngram_lm import WordHashes, large, small

#: Shingles of a block, entries of a bucket, and sets of a block of a large family: what a task holds at once.
BLOCK_ENTRIES, BUCKET_ENTRIES, FAMILY_BLOCK = 1_000_000, 2_000_000, 1_024
#: Sets of a block from which on a shingle's sets stay with the block, and their number alone goes to the bucket.
HOT = 4
#: Bits of a shingle's hash.
HASH_BITS = 56
#: How much more a probe costs than a step of a merge, by the logarithm of the longest list.
MU = 0.02
#: Numbers in short lists up to which a heap merges them.
HEAP_MOST = 500


def shingles(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted hashes of the text's different runs of ``width`` words; of fewer words, the whole sequence; of none, nothing."""
    words = plain_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    span = min(width, len(h))
    out = h[: len(h) - span + 1]
    for i in range(1, span):
        out = mixed(out, h[i : len(h) - span + 1 + i])
    if span < width:
        out = mixed(out, np.uint64(span))
    return np.unique(out >> np.uint64(64 - HASH_BITS))


def least_overlap(n: int, percent: int) -> int:
    """What a set of n must share with any partner: Jaccard is at most overlap by the larger size."""
    return -(-percent * n // 100)


def needed(n: int, m: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The overlap of sets of n and m that reaches the percentage of their union."""
    return -(-percent * (n + m) // (100 + percent))


def sets_of(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, block_entries: int, bucket_entries: int) -> DataFrame:
    """A stored row for each document: uid, id, n, digest of the set, and for the first of a set in its block, if it can link at all,
    ``tokens`` (its shingles that other sets hold, packed) and ``prefix`` (the rarest of them).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    # Words by a cheap bound (a blank for each), to choose the number of hash ranges: a matter of task size only.
    words = docs.agg(F.sum(F.length(text_col)).alias("n")).collect()[0].n or 0
    bits = max(0, math.ceil(math.log2(max(1, words / 5 / bucket_entries))))
    routed = f"bucket int, block long, ids array<{kind}>, sizes binary, digests array<binary>, member binary, hashes binary, sets binary, hot boolean"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = WordHashes(), 0
        kind = None
        held: list[tuple] = []
        sets: dict[bytes, tuple[int, np.ndarray]] = {}

        def block() -> pa.RecordBatch:
            name = (TaskContext.get().partitionId() << 32) + number
            member = np.array([sets[d][0] for _, _, d in held])
            meta = (name % (1 << bits), name, [i for i, _, _ in held], small(np.array([n for _, n, _ in held])), [d for _, _, d in held], small(member), None, None, False)
            rows: list[tuple] = [meta]
            if sets:
                every = np.concatenate([s for _, s in sets.values()])
                owner = np.repeat([k for k, _ in sets.values()], [len(s) for _, s in sets.values()])
                order = np.argsort(every, kind="stable")
                every, owner = every[order], owner[order]
                different, place, counts = np.unique(every, return_inverse=True, return_counts=True)
                hot = counts[place] >= HOT
                if hot.any():  # their sets wait for the counts where the block is put together again
                    rows.append((meta[0], name, None, None, None, None, pack_sorted(every[hot]), small(owner[hot]), None))
                for flag, h, n in ((False, every[~hot], owner[~hot]), (True, different[counts >= HOT], counts[counts >= HOT])):
                    edges = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(HASH_BITS - bits)).tolist()
                    for bucket, (a, b) in enumerate(zip(edges, [*edges[1:], len(h)], strict=True)):
                        if b > a:
                            rows.append((bucket, name, None, None, None, None, pack_sorted(h[a:b]), small(n[a:b]), flag))
            types = [pa.int32(), pa.int64(), pa.list_(kind), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
            names = ["bucket", "block", "ids", "sizes", "digests", "member", "hashes", "sets", "hot"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        size = 0
        for batch in slices(batches):
            kind = batch.column(id_col).type
            for i, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist(), strict=True):
                found = shingles(text, width, known)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                held.append((i, len(found), digest))
                if digest not in sets:  # equal sets of a block are dealt once
                    sets[digest] = (len(sets), found)
                    size += len(found)
                if size >= block_entries or len(held) >= block_entries // 10:
                    yield block()
                    held, sets, size, number = [], {}, 0, number + 1
        if held:
            yield block()

    passed = f"block long, ids array<{kind}>, sizes binary, digests array<binary>, member binary, bucket int, hashes binary, sets binary, counts binary, hot boolean"

    def count(key: tuple, dealt: pa.Table) -> pa.Table:
        out: list[tuple] = []
        blocks, hashes, owners = [], [], []
        for row in dealt.to_pylist():
            if row["hot"] is None:  # on its way to its block
                out.append((row["block"], None, None, None, None, -1, row["hashes"], row["sets"], None, None))
            elif row["hashes"] is None:
                out.append((row["block"], row["ids"], row["sizes"], row["digests"], row["member"], None, None, None, None, None))
            else:
                blocks.append((row["block"], row["hot"]))
                hashes.append(unpack_sorted(row["hashes"]))
                owners.append(large(row["sets"]))
        if blocks:
            _, place = np.unique(np.concatenate(hashes), return_inverse=True)
            # Entries are sets, or numbers of sets that a block holds back.
            weights = np.concatenate([own if hot else np.ones(len(own), dtype=np.int64) for (_, hot), own in zip(blocks, owners, strict=True)])
            counts = np.bincount(place, weights=weights).astype(np.int64)
            at = 0
            for (block, hot), own, sets in zip(blocks, hashes, owners, strict=True):
                n = counts[place[at : at + len(own)]]
                at += len(own)
                shared = n > 1
                if shared.any():
                    out.append((block, None, None, None, None, key[0].as_py(), pack_sorted(own[shared]), None if hot else small(sets[shared]), small(n[shared]), hot))
        kind = dealt.schema.field("ids").type
        types = [pa.int64(), kind, pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
        names = ["block", "ids", "sizes", "digests", "member", "bucket", "hashes", "sets", "counts", "hot"]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})

    def gather(key: tuple, own: pa.Table) -> pa.Table:
        rows = own.to_pylist()
        meta = next(r for r in rows if r["ids"] is not None)
        parts = sorted((r for r in rows if r["ids"] is None), key=lambda r: r["bucket"])
        waiting = [r for r in parts if r["bucket"] == -1]
        hot = [r for r in parts if r["hot"]]
        parts = [r for r in parts if r["hot"] is False]
        sizes, member = large(meta["sizes"]), large(meta["member"])
        tokens: list[bytes | None] = [None] * len(member)
        prefix: list[list[int] | None] = [None] * len(member)
        if parts or waiting:
            hashes = [unpack_sorted(r["hashes"]) for r in parts]
            sets = [large(r["sets"]) for r in parts]
            counts = [large(r["counts"]) for r in parts]
            for r in waiting:  # a row at most
                known = np.concatenate([unpack_sorted(x["hashes"]) for x in hot])
                hashes.append(unpack_sorted(r["hashes"]))
                sets.append(large(r["sets"]))
                counts.append(np.concatenate([large(x["counts"]) for x in hot])[np.searchsorted(known, hashes[-1])])
            hashes, sets, counts = np.concatenate(hashes), np.concatenate(sets), np.concatenate(counts)
            order = np.lexsort((hashes, sets))
            hashes, sets, counts = hashes[order], sets[order], counts[order]
            # By set, and by hash within it.
            _, first = np.unique(member, return_index=True)
            edges = np.searchsorted(sets, np.arange(len(first) + 1))
            for k, doc in enumerate(first.tolist()):
                a, b = edges[k], edges[k + 1]
                n = int(sizes[doc])
                room = n - least_overlap(n, percent) + 1 - (n - (b - a))  # of the prefix, beside shingles that no other set has
                if n and room > 0:
                    rare = np.lexsort((hashes[a:b], counts[a:b]))[:room]
                    tokens[doc] = pack_sorted(hashes[a:b])
                    prefix[doc] = hashes[a:b][rare].astype(np.int64).tolist()
        return pa.table(
            {
                "id": pa.array(meta["ids"], own.schema.field("ids").type.value_type),
                "n": pa.array(sizes, pa.int64()),
                "digest": pa.array(meta["digests"], pa.binary()),
                "tokens": pa.array(tokens, pa.binary()),
                "prefix": pa.array(prefix, pa.list_(pa.int64())),
            }
        )

    dealt = docs.select(id_col, text_col).mapInArrow(deal, routed)
    counted = dealt.groupBy("bucket").applyInArrow(count, passed)
    rows = counted.groupBy("block").applyInArrow(gather, f"id {kind}, n long, digest binary, tokens binary, prefix array<long>")
    return saved(rows.withColumn("uid", F.monotonically_increasing_id()))


class Index:
    """Inverted lists over sets, which are numbered by size; and which sets are known to be connected."""

    def __init__(self, sizes: list[int], tokens: list[np.ndarray], percent: int):
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        self.names = order
        self.sizes = np.array([sizes[i] for i in order], dtype=np.int64)
        self.tokens = [tokens[i] for i in order]
        self.percent = percent
        every = np.concatenate(self.tokens) if self.tokens else np.empty(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(self.tokens)), [len(t) for t in self.tokens])
        by = np.lexsort((owner, every))
        self.owner = owner[by]
        self.keys, starts = np.unique(every[by], return_index=True)
        self.starts = np.append(starts, len(every))
        self.parent = np.arange(len(order))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = int(self.parent[i])
        return i

    def lists(self, tokens: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
        """The tokens' lists, cut to set numbers from lo to hi, the shortest first; empty ones are left out."""
        at = np.searchsorted(self.keys, tokens)
        out = []
        for k in at.tolist():
            whole = self.owner[self.starts[k] : self.starts[k + 1]]
            part = whole[np.searchsorted(whole, lo) : np.searchsorted(whole, hi)]
            if len(part):
                out.append(part)
        return sorted(out, key=len)

    def search(self, q: int, allowed: np.ndarray) -> Iterator[int]:
        """Smaller-numbered sets linked with set q and not known to be connected with it (T-occurrence, DivideSkip)."""
        n, percent = int(self.sizes[q]), self.percent
        least = least_overlap(n, percent)  # also the least size of a partner
        lo = int(np.searchsorted(self.sizes, least))
        t = int(needed(n, max(least, 1), percent))
        lists = self.lists(self.tokens[q], lo, q)
        if len(lists) < t:
            return
        longest = len(lists[-1])
        n_long = min(t - 1, int(t / (MU * math.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        ids, counts = merged(short)
        keep = (counts >= t - n_long) & allowed[ids]
        ids, counts = ids[keep], counts[keep]
        mine = self.root(q)
        apart = np.array([self.root(i) != mine for i in ids.tolist()], dtype=bool)
        ids, counts = ids[apart], counts[apart]
        need = needed(n, self.sizes[ids], percent)
        for left, probe in zip(range(len(long), 0, -1), long, strict=True):
            alive = counts + left >= need
            if not alive.all():
                ids, counts, need = ids[alive], counts[alive], need[alive]
            if not len(ids):
                return
            at = np.minimum(np.searchsorted(probe, ids), len(probe) - 1)
            counts = counts + (probe[at] == ids)
        for i in ids[counts >= need].tolist():
            if self.root(i) != self.root(q):
                self.parent[self.root(q)] = self.root(i)
                yield i

    def links(self, side: list[int] | None = None) -> list[tuple[int, int]]:
        """Links that connect what the index's sets connect, as positions in the order given; with sides, only those across."""
        sides = None if side is None else np.array([side[i] for i in self.names])
        every = np.ones(len(self.names), dtype=bool)
        out = []
        for q in range(len(self.names)):
            for i in self.search(q, every if sides is None else sides != sides[q]):
                out.append((self.names[q], self.names[i]))
        return out


def merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Set numbers in sorted lists and how many lists hold each: a heap merge, or one sort of the lists together.

    Both give the same; from some hundred numbers on a heap of Python objects takes four to five times as long.
    """
    if sum(map(len, lists)) > HEAP_MOST:
        return np.unique(np.concatenate(lists), return_counts=True)
    runs = [(k, sum(1 for _ in g)) for k, g in groupby(heapq.merge(*(x.tolist() for x in lists)))]
    return np.array([k for k, _ in runs], dtype=np.int64), np.array([c for _, c in runs], dtype=np.int64)


def families(sets: DataFrame, percent: int) -> DataFrame:
    """sid and family of sets that may have a partner: those whose prefixes meet, at sizes that can link.

    Sizes fall into bands a threshold wide; a set reaches its own band and the
    next, so sets of linkable sizes share one. Each (shingle, band) is
    represented by its least set, found by aggregation, not by pairs.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9) if percent < 100 else F.col("n")
    reach = F.array(band, band + 1) if percent < 100 else F.array(band)
    entries = sets.select("sid", F.explode("prefix").alias("token"), reach.alias("bands")).select("sid", "token", F.explode("bands").alias("band"))
    hubs = entries.groupBy("token", "band").agg(F.min("sid").alias("hub"), F.max("sid").alias("last")).where("last > hub").drop("last")
    met = entries.join(hubs, ["token", "band"]).where("sid <> hub").select(F.col("sid").alias("a"), F.col("hub").alias("b")).distinct()
    return components(met).select(F.col("node").alias("sid"), F.col("root").alias("family"))


def links(sets: DataFrame, percent: int, family_block: int) -> DataFrame:
    """Links (a, b) between sets, enough to connect all that are linked.

    Small families are searched many to a task; a large one is cut into blocks,
    and each pair of its blocks is searched by itself.
    """
    of = families(sets, percent)
    sizes = of.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("n")).collect()[0].n or 0
    bundles = max(1, math.ceil(total / family_block))
    parts = F.ceil(F.col("size") / family_block).cast("int")
    placed = of.join(sizes, "family").withColumn("parts", parts).withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("sid"), F.col("parts"))).otherwise(0).cast("int"))
    home = F.when(F.col("parts") > 1, F.col("family")).otherwise(-1 - F.pmod(F.xxhash64("family"), F.lit(bundles)))
    placed = placed.select("sid", home.alias("home"), "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = placed.select("sid", "home", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"))
    # Cells grow with the sets; they are never broadcast, however small Spark takes them to be.
    work = sets.select("sid", "n", "tokens").join(cells.hint("merge"), "sid")

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        sids = rows.column("sid").to_pylist()
        index = Index(rows.column("n").to_pylist(), [unpack_sorted(b) for b in rows.column("tokens").to_pylist()], percent)
        found = index.links(None if key[1].as_py() == key[2].as_py() else rows.column("side").to_pylist())
        return pa.table({"a": pa.array([sids[x] for x, _ in found], pa.int64()), "b": pa.array([sids[y] for _, y in found], pa.int64())})

    return work.groupBy("home", "i", "j").applyInArrow(search, "a long, b long")


def join(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    percent: int = 90,
    block_entries: int = BLOCK_ENTRIES,
    bucket_entries: int = BUCKET_ENTRIES,
    family_block: int = FAMILY_BLOCK,
) -> DataFrame:
    """Per document: id, ``n_shingles`` and ``component_id`` (the least id reachable by links, its own included).

    Documents link when their sets of shingles have a Jaccard index of at least
    ``percent`` hundredths. A set holds the different runs of ``width`` words; a
    shorter text is one shingle, and a null or blank one has none and links with
    nothing. Repeated rows and equal texts are one class, joined once. A null
    id is no component's least id unless there is no other. An empty table
    gives no rows; other columns are ignored.
    """
    rows = sets_of(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, width, percent, block_entries, bucket_entries)
    some = rows.where("n > 0")
    classes = some.groupBy("digest").agg(F.min("uid").alias("sid"), F.min("id").alias("least"))
    able = some.where("tokens IS NOT NULL").groupBy("digest").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("prefix").alias("prefix"))
    sets = saved(able.join(classes, "digest").select("sid", "n", "tokens", "prefix"))
    linked = components(links(sets, percent, family_block))
    rooted = classes.join(linked, classes["sid"] == linked["node"], "left").select("digest", "least", F.coalesce("root", "sid").alias("root"))
    # Only classes that are linked need their component's least id looked up.
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("digest", "component_id")
    joined = some.select("id", "n", "digest").join(named, "digest").select("id", "n", "component_id")
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return joined.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
