"""Similarity join on word n-gram sets: prefixes extended for token combinations, then verified on full sets.

All tokens (shingle hashes) share one order, from rare to frequent as far as a table of counts by hash bucket tells them
apart. A set of n tokens that is to share a of them with another may miss n - a, so among its first n - a + 1 tokens one
is shared. A token found in many prefixes says little: such tokens are dealt to subclasses by hash, and a subclass is
indexed by its pairs of tokens instead. A subclass of m tokens keeps a shared pair until all but one are missed, so it
counts m - 1 of the tokens that may be missed, and the prefix is extended by one token a subclass to make up for it. This
holds for any order and any subclasses that both sets agree on, so neither counts nor collisions can lose a link.

Of two sets the smaller may miss fewer tokens than the larger; its shorter *index* prefix meets the other's *probe*
prefix. Links are then sought in pivot rounds, each set being verified against one set that shares its keys, and at last
exactly among the sets of different components that still share a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import linked
from ..plans.durable import replaced
from .common import Stored, WordHashes, apart, mix
from .near_dedup import shingles

SHINGLE, PERCENT = 4, 85
#: Bits of the table of counts: 2 ** 24 counts, of which a byte each reaches the tasks, whatever the input.
ORDER_BITS = 24
#: A token in the prefixes of more sets than this is frequent; the sieve of sets to verify has so many bits.
FREQUENT, SIEVE_BITS, PIVOT_ROUNDS = 16, 24, 1
#: What a task remembers: words with their hashes, and names of sets.
KNOWN_WORDS, SEEN = 300_000, 100_000
_BLOCK = 16
_STEP, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# ---- bounds -------------------------------------------------------------------------------------------------------


def may_miss(n: int, percent: int) -> int:
    """Tokens that a set of n may miss of any set that it is linked with."""
    return n - -(-percent * n // 100)


def smaller_may_miss(n: int, percent: int) -> int:
    """Tokens that a set of n may miss of a set that is no smaller and linked with it."""
    return n - -(-2 * percent * n // (100 + percent))


def subclasses(n: int, percent: int) -> int:
    """Subclasses of frequent tokens where the larger set of a pair has n tokens; small sets have none."""
    budget = may_miss(n, percent) + 1
    return 0 if budget < 8 else 1 << ((budget // 2).bit_length() - 1)


def levels(n: int, percent: int) -> list[int]:
    """The numbers of subclasses under which a set of n can meet a set that is no smaller."""
    first, last = subclasses(n, percent), subclasses(100 * n // percent, percent)
    return [first, *(m for k in range(last.bit_length()) if first < (m := 1 << k) <= last and m >= 4)]


def keys(n: int, at: np.ndarray, tokens: np.ndarray, frequent: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, room, index) of a set's shared tokens: ``at`` are their places in the order of its n tokens.

    ``room`` bounds the tokens shared with another set for which this key is the first in common; ``index`` tells keys of
    the index prefix.
    """
    budgets = may_miss(n, percent) + 1, smaller_may_miss(n, percent) + 1
    before = np.concatenate([[0], np.cumsum(frequent)[:-1]]) if len(at) else at
    single = np.zeros(len(at), bool)
    index = np.zeros(len(at), bool)
    room = np.zeros(len(at), np.int64)
    for m in levels(n, percent):
        hot = np.flatnonzero(frequent) if m else np.empty(0, np.int64)
        group = (mix(tokens[hot] ^ _ODD) % np.uint64(m)).astype(np.int64) if m else hot
        firsts = np.sort(at[hot[np.unique(group, return_index=True)[1]]])
        ends = []
        for budget in budgets:
            last, more = budget - 1, -1
            while more != (more := int(np.searchsorted(firsts, last, "right"))):
                last = budget - 1 + more
            ends.append(last)
        left = n - at + np.minimum(before, m)
        alone = (at <= ends[0]) & (~frequent if m else True)
        single |= alone
        index |= alone & (at <= ends[1])
        room = np.where(alone, np.maximum(room, left), room)
        inside = at[hot] <= ends[0]
        hot, group = hot[inside], group[inside]
        order = np.argsort(group, kind="stable")
        hot, group = hot[order], group[order]
        for gap in range(1, len(hot)):  # pairs of one subclass that stand so far apart in it
            both = np.flatnonzero(group[gap:] == group[:-gap])
            if not len(both):
                break
            a, b = hot[both], hot[both + gap]
            yield mix(tokens[a] * _STEP + mix(tokens[b] + np.uint64(m * int(_ODD) % 2**64))), left[a], at[b] <= ends[1]
    yield tokens[single], room[single], index[single]


def name_of(s: np.ndarray) -> bytes:
    """A 128-bit name of a set, and its size."""
    return np.array([mix(s).sum(), mix(s ^ _STEP).sum()]).tobytes() + len(s).to_bytes(4, "big")


# ---- passes over the texts ------------------------------------------------------------------------------------------


def _sets_of(batches: Iterator[pa.RecordBatch], size: int, column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    hashes = WordHashes(KNOWN_WORDS)
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            yield part, [shingles(t, hashes, size) for t in part.column(column).cast(pa.binary()).to_pylist()]


def _count(size: int, bits: int):
    """Counts tokens by bucket; at its end a task sends its counts, up to 255 each, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(1 << bits, np.uint16), []

        def add() -> None:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            counts[found] = np.minimum(counts[found] + np.minimum(n, 255), 255)
            held.clear()

        for _, sets in _sets_of(batches, size, 0):
            held += [(s >> np.uint64(64 - bits)).astype(np.uint32) for s in sets]
            if sum(map(len, held)) > 1_000_000:
                add()
        if held:
            add()
        blocks = counts.astype(np.uint8).reshape(-1, 1 << min(_BLOCK, bits))
        pack = zstandard.ZstdCompressor(level=1).compress
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([pack(blocks[b].tobytes()) for b in some], pa.binary())], names=["block", "counts"])

    return run


def _sum_blocks(width: int):
    """Sums the blocks of a partition as they come and gives the number of bits of each sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(unpack(counts.as_py()), np.uint8)
                sums[block] = sums[block] + more if block in sums else more.astype(np.int64)
        sizes = [np.ceil(np.log2(np.maximum(s, 1))).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(sizes, pa.binary())], names=["block", "levels"])

    return run


def token_levels(texts: DataFrame, size: int, bits: int) -> np.ndarray:
    """A byte for each of 2 ** bits buckets of tokens: the logarithm of how many tokens of all texts fall there."""
    width = 1 << min(_BLOCK, bits)
    sent = texts.mapInArrow(_count(size, bits), "block int, counts binary").repartition("block")
    found = np.zeros(1 << bits, np.uint8).reshape(-1, width)
    for r in sent.mapInArrow(_sum_blocks(width), "block int, levels binary").collect():  # 2 ** bits bytes in all
        found[r["block"]] = np.frombuffer(r["levels"], np.uint8)
    return found.reshape(-1)


def _prefixes(size: int, percent: int, bits: int, levels_of):
    """Of each row its set's size, 128-bit name and, once a task for the sets it remembers, the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(levels_of.value, np.uint8)
        seen: set[bytes] = set()
        for part, sets in _sets_of(batches, size):
            names, prefixes = [], []
            for s in sets:
                n = len(s)
                if not n:
                    names.append(None)
                    prefixes.append(None)
                    continue
                names.append(name := name_of(s))
                if name in seen:
                    prefixes.append(None)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                ranked = s[np.argsort(order[(s >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")]
                prefixes.append(ranked[: may_miss(n, percent) + 1 + levels(n, percent)[-1]].view(np.int64))
            columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "name", "prefix"])

    return run


def _full_sets(size: int, wanted):
    """(of, set): the names and sets of the rows whose id passes the sieve, a set once a task for those it remembers; the third column is a hash of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint64)

        def some() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column(2).to_numpy() & (len(bits) * 64 - 1)
                yield batch.filter(pa.array((bits[h >> 6] >> (h & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

        seen: set[bytes] = set()
        for _, sets in _sets_of(some(), size):
            new = {}
            for s in sets:
                if len(s) and (name := name_of(s)) not in seen:
                    new[name] = s
            seen = seen | new.keys() if len(seen) < SEEN else set(new)
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array([s.view(np.int64) for s in new.values()], pa.list_(pa.int64()))], names=["of", "set"])

    return run


def _keyed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, n, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                fields = held.values
                at, tokens, often = (fields.field(k).to_numpy(zero_copy_only=False) for k in ("i", "token", "frequent"))
                order = np.argsort(at, kind="stable")
                for key, room, index in keys(n, at[order].astype(np.int64), tokens[order].view(np.uint64), often[order].astype(bool), percent):
                    if m := len(key):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key.view(np.int64)), pa.array(np.full(m, node)), pa.array(np.full(m, n)), pa.array(room), pa.array(index)], names=["key", "node", "n", "room", "index"]
                        )

    return run


# ---- the join -------------------------------------------------------------------------------------------------------


class Join:
    """What the passes over the texts leave: rows by set, the sets, and their keys that several sets share."""

    def __init__(self, docs: DataFrame, key: str, text: str, size: int, percent: int, bits: int, frequent: int):
        self.spark: SparkSession = docs.sparkSession
        self.size, self.percent = size, percent
        self.rows_in = docs.select(docs[f"`{key}`"].alias("id"), docs[f"`{text}`"].alias("t"))
        kind = self.rows_in.schema["id"].dataType
        order = self.spark.sparkContext.broadcast(token_levels(self.rows_in.select("t"), size, bits).tobytes())
        fields = [("id", kind), ("n", T.LongType()), ("name", T.BinaryType()), ("prefix", T.ArrayType(T.LongType()))]
        self.rows = Stored(self.rows_in.mapInArrow(_prefixes(size, percent, bits, order), T.StructType([T.StructField(*f) for f in fields])), "prefixes")
        order.destroy()
        full = self.rows.df.where("n > 0 and id is not null")
        least = full.groupBy("name").agg(F.min("id").alias("rep"))
        # a set's prefix comes once a task at least, but perhaps with a row that has no key
        held = self.rows.df.where("prefix is not null").select(F.col("name").alias("name_"), "n", "prefix").dropDuplicates(["name_"])
        sets = held.join(least, F.col("name_") == F.col("name")).select(F.monotonically_increasing_id().alias("node"), "name", "rep", "n", "prefix")
        self.sets = Stored(sets, "sets")
        self.buckets = self._buckets(frequent)
        # prefixes have done their work
        self.rows = replaced(self.rows, self.rows.df.drop("prefix"), "rows")
        self.sets = replaced(self.sets, self.sets.df.drop("prefix"), "named-sets")

    def _buckets(self, frequent: int) -> Stored:
        """(key, node, n, room, index) for the keys of two sets at least, one of them by its index prefix."""
        each = self.sets.df.select("node", "n", F.posexplode("prefix").alias("i", "token"))
        often = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select(F.col("token").alias("k"), (F.col("df") > frequent).alias("frequent"))
        met = each.join(often, F.col("token") == F.col("k")).groupBy("node", "n").agg(F.collect_list(F.struct("i", "token", "frequent")).alias("held"))
        keyed = Stored(met.mapInArrow(_keyed(self.percent), "key long, node long, n long, room long, index boolean"), "keys")
        busy = keyed.df.groupBy("key").agg(F.count("*").alias("c"), F.max("index").alias("any")).where("c > 1 and any").select(F.col("key").alias("k"))
        buckets = Stored(keyed.df.join(busy, F.col("key") == F.col("k")).drop("k"), "buckets")
        keyed.drop()
        # what has no partner that is near in size and leaves room enough meets nobody: each row as a probe key, or as an index key
        small, large = (x.select(F.col("key").alias("k"), *(F.col(c).alias(f"o_{c}") for c in ("node", "n", "room"))) for x in (buckets.df.where("index"), buckets.df))
        of = lambda less, more: (F.col("key") == F.col("k")) & (F.col("node") != F.col("o_node")) & self._may(F.col(less), F.col(more))
        met = buckets.df.join(small, of("o_n", "n"), "left_semi").union(buckets.df.where("index").join(large, of("n", "o_n"), "left_semi"))
        return replaced(buckets, met.distinct(), "buckets")

    def _may(self, less, more):
        """Whether a set of ``less`` tokens and one of ``more``, no smaller, can be linked by a key with such room."""
        return (less <= more) & self.close(less, more) & ((100 + self.percent) * F.least("room", "o_room") >= self.percent * (less + more))

    def full_sets(self) -> Stored:
        """(of, set): by name the sets in a bucket, perhaps some more and some from several tasks. A sieve on ids keeps other texts from being worked on."""
        members = self.buckets.df.select("node").distinct()
        wanted = Stored(self.sets.df.select("node", "name", "rep").join(members.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left_semi"), "wanted")
        bits = np.zeros((1 << SIEVE_BITS) // 64, np.int64)
        places = wanted.df.select(F.xxhash64("rep").bitwiseAND((1 << SIEVE_BITS) - 1).alias("h"))
        for r in places.groupBy(F.shiftright("h", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).collect():  # bounded by the sieve's size
            bits[r["at"]] = r["bits"]
        sieve = self.spark.sparkContext.broadcast(bits.tobytes())
        made = self.rows_in.where("id is not null").select("id", "t", F.xxhash64("id").alias("h"))
        found = made.mapInArrow(_full_sets(self.size, sieve), "of binary, set array<bigint>")
        stored = Stored(found, "full-sets")
        sieve.destroy()
        wanted.drop()
        return stored

    def close(self, n, m):
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes whose full sets are similar enough, with ``common`` and ``both``."""
        ends = [self.sets.df.select(F.col("node").alias(f"_{x}"), F.col("name").alias(f"name_{x}")) for x in "ab"]
        named = pairs.join(ends[0], F.col("a") == F.col("_a")).join(ends[1], F.col("b") == F.col("_b")).select("a", "b", "name_a", "name_b")
        # few pairs are sent to the sets; for many, the sets are dealt by name, as the next join wants them
        asked = named.select(F.explode(F.array("name_a", "name_b")).alias("asked")).distinct()
        once = sets.join(asked, F.col("of") == F.col("asked"), "left_semi").groupBy("of").agg(F.first("set").alias("set"))
        left, right = (once.select(F.col("of").alias(f"of_{x}"), F.col("set").alias(f"s{x}")) for x in "ab")
        met = named.join(left, F.col("name_a") == F.col("of_a")).join(right, F.col("name_b") == F.col("of_b"))
        met = met.select("a", "b", (F.size("sa") + F.size("sb")).alias("both"), F.size(F.array_intersect("sa", "sb")).alias("common"))
        return met.where(100 * F.col("common") >= self.percent * (F.col("both") - F.col("common")))

    def candidates(self, buckets: DataFrame, labelled: bool) -> DataFrame:
        """Pairs (a, b): the index key of a smaller set meets the probe key of a larger one, and there is room enough.

        With labels only pairs of different ones. Joined by key; a hot key's side is split by the join as any skew is.
        """
        more = ["label"] if labelled else []
        small = buckets.where("index").select(F.col("key").alias("k"), *(F.col(c).alias(f"o_{c}") for c in ("node", "n", "room", *more)))
        ok = (F.col("key") == F.col("k")) & (F.col("o_node") != F.col("node")) & self._may(F.col("o_n"), F.col("n"))
        if labelled:
            ok = ok & (F.col("o_label") != F.col("label"))
        return buckets.join(small, ok).select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The buckets that hold several labels, with labels; nodes without a label are their own."""
    own = buckets.join(labels.select(F.col("node").alias("m"), "label"), F.col("node") == F.col("m"), "left").withColumn("label", F.coalesce("label", "node")).drop("m")
    still = own.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.max("index").alias("any")).where("l0 < l1 and any").select(F.col("key").alias("k"))
    return own.join(still, F.col("key") == F.col("k")).drop("k")


def similar_components(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT, bits: int = ORDER_BITS, pivot_rounds: int = PIVOT_ROUNDS
) -> DataFrame:
    """(key, n_shingles, component_id) of each row; component_id is the smallest key that links lead to.

    A null or empty text, or one of white space, has no shingles and is linked with nothing. Rows that repeat a key are
    each answered by their own text; equal texts share a component whatever their keys. A row with a null key is its own
    component, null, and links nothing. An empty table gives an empty result; other columns are not read. A result column
    that clashes with the key gets ``_``.
    """
    join = Join(docs, key, text, size, percent, bits, frequent)
    spark, buckets = join.spark, join.buckets
    none = spark.createDataFrame([], "node long, label long")
    labels = Stored(none, "members")
    tested: DataFrame | None = None
    if not buckets.df.isEmpty():
        sets = join.full_sets()
        turn = -1
        while turn < pivot_rounds:
            turn += 1
            buckets = replaced(buckets, _open(buckets.df.select("key", "node", "n", "room", "index"), labels.df), "buckets")
            if buckets.df.isEmpty():
                break
            if turn < pivot_rounds:
                # the set with the fewest tokens of its own is the likeliest to be linked with others; then any
                order = F.struct((F.lit(0) if turn else F.col("n") - F.col("room")) / F.col("n"), F.xxhash64("node", F.lit(turn)))
                pivot = buckets.df.where("index").groupBy("key").agg(*(F.min_by(c, order).alias(f"p_{c}") for c in ("node", "n", "label"))).withColumnRenamed("key", "k")
                met = buckets.df.join(pivot, (F.col("key") == F.col("k")) & (F.col("label") != F.col("p_label")) & join.close(F.col("n"), F.col("p_n")))
                pairs = met.groupBy("node", "p_node").agg(F.count("*").alias("c")).select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b"), "node", "p_node", "c")
            else:
                pairs = join.candidates(buckets.df, True)
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            if turn < pivot_rounds:
                best = pairs.groupBy("node").agg(F.max_by("p_node", F.struct("c", "p_node")).alias("p_node"))
                pairs = best.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()
            pairs = Stored(pairs.select("a", "b"), "pairs").df
            if pairs.isEmpty():  # no pivot has more to give: the exact round is next
                turn = max(turn, pivot_rounds - 1)
                continue
            found = Stored(join.verified(pairs, sets.df).select("a", "b"), "found")
            tested = pairs if tested is None else tested.union(pairs)
            if not found.df.isEmpty():
                labels = replaced(labels, _merged(found.df, labels.df), "members")
            found.drop()
        sets.drop()
    buckets.drop()
    named = join.sets.df.select("node", F.col("name").alias("name_"), "rep").join(labels.df.select(F.col("node").alias("m"), "label"), F.col("node") == F.col("m"), "left").select("name_", "rep", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id")).withColumnRenamed("label", "l")
    named = named.join(least, F.col("label") == F.col("l")).select("name_", "component_id")
    full = join.rows.df.where("n > 0 and id is not null").join(named, F.col("name") == F.col("name_")).select("id", "n", "component_id")
    alone = join.rows.df.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return full.union(alone).toDF(key, *apart(key, "n_shingles", "component_id"))


def _merged(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels after links (a, b) between nodes; only nodes that a link has reached have one."""
    ends = [labels.select(F.col("node").alias(f"_{x}"), F.col("label").alias(f"l{x}")) for x in "ab"]
    known = found.join(ends[0], F.col("a") == F.col("_a"), "left").join(ends[1], F.col("b") == F.col("_b"), "left")
    met = linked(known.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct())
    new = found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("label"))
    return labels.union(new).join(met.df, F.col("label") == F.col("v"), "left").select("node", F.coalesce("c", "label").alias("label"))


def similar_pairs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT, bits: int = ORDER_BITS) -> DataFrame:
    """(key_a, key_b, n_common, n_union): all links between different sets, each by the smallest key that has it.

    Nulls, empty texts and repeated rows as in ``similar_components``. The links of n sets can be n squared; none is lost.
    """
    join = Join(docs, key, text, size, percent, bits, frequent)
    sets = join.full_sets()
    found = join.verified(join.candidates(join.buckets.df, False), sets.df)
    reps = [join.sets.df.select(F.col("node").alias(f"_{x}"), F.col("rep").alias(f"rep_{x}")) for x in "ab"]
    met = found.join(reps[0], F.col("a") == F.col("_a")).join(reps[1], F.col("b") == F.col("_b"))
    first, second = F.least("rep_a", "rep_b").alias(f"{key}_a"), F.greatest("rep_a", "rep_b").alias(f"{key}_b")
    return met.select(first, second, F.col("common").cast("long").alias("n_common"), (F.col("both") - F.col("common")).cast("long").alias("n_union"))
