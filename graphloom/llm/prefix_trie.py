"""The trie of conversations by their turns, built as a burst trie.

A container holds the rest of every conversation that passes a node. One container, at the root, holds all; containers
of too many turns burst by the id of the next turn, each into a node and container a turn, round by round and all side by
side. What is left is small: containers are dealt to tasks by node, and each is sorted and swept into its nodes. Equal
conversations are one with a weight from the start, so a container bursts for its different ones only; one that holds a
single long conversation is a chain, whose nodes are its rows.

A node is named by its depth and the smallest conversation that passes it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.durable import Stored, numbered

#: Turns that a container may hold before it bursts; ids that are hashed as one piece.
LIMIT, PIECE = 50_000, 1024
_CHAIN_BLOCK = 4096
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end long, head boolean"


def placed_turns(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, t1, t2, bytes): each turn's place in its conversation from 0, a 128-bit id of role and text, and UTF-8 bytes.

    Turns come by ``turn``, null first, then by a hash of what they say; a repeated row is a turn of its own. A null role
    or text is empty. Rows without a conversation are left out. Places come from one sort of all turns, so that a
    conversation of any length is nobody's single task.
    """
    r, t = (F.coalesce(turns[f"`{c}`"], F.lit("")) for c in (role, text))
    each = turns.select(turns[f"`{conv}`"].cast("long").alias("conv"), turns[f"`{turn}`"].alias("turn"), F.xxhash64(r, t).alias("t1"), F.xxhash64(t, F.lit(1), r).alias("t2"), F.octet_length(t).cast("long").alias("bytes"))
    at = Stored(numbered(each.where("conv is not null"), ["conv", "turn", "t1", "t2"], "no"), "turns").df
    first = at.groupBy(F.col("conv").alias("c")).agg(F.min("no").alias("first"))
    return at.join(first, F.col("conv") == F.col("c")).select("conv", (F.col("no") - F.col("first")).alias("pos"), "t1", "t2", "bytes")


# ---- ends ---------------------------------------------------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the sorted ids of a conversation that stand next to each other, some at a time."""
    for batch in batches:
        reps, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[tuple[int, int, str]] = []
        for rep, own in groupby(range(len(reps)), reps.__getitem__):
            own = list(own)
            for i in range(0, len(own), PIECE):
                piece = own[i : i + PIECE]
                out.append((rep, convs[piece[0]], ",".join(str(convs[k]) for k in piece)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["rep", "first", "piece"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation's pieces, in order, as they stream by."""
    now, state = None, None
    for batch in batches:
        out: list[tuple[int, str]] = []
        for rep, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if rep != now:
                if state is not None:
                    out.append((now, state.hexdigest()))
                now, state = rep, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=["end", "sha"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], names=["end", "sha"])


def _end_hashes(members: DataFrame) -> DataFrame:
    """(end, sha) for each rep of members (rep, conv): ids are joined where they lie, and only pieces meet in one task."""
    pieces = members.repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv").mapInArrow(_pieces, "rep long, first long, piece string")
    return pieces.repartition("rep").sortWithinPartitions("rep", "first").select("rep", "piece").mapInArrow(_hashed, "end long, sha string")


# ---- containers ---------------------------------------------------------------------------------------------------


def _sweep(node: int, depth: int, reps: list[int], weights: list[int], turns: list[list[int]], sizes: list[list[int]]) -> list[tuple]:
    """The nodes of one container: its sorted suffixes, each opening nodes where it leaves the one before."""
    up, conv, count, size, end, level = [-1], [node], [0], [0], [None], [depth]
    path, before = [0], []
    for k in sorted(range(len(reps)), key=turns.__getitem__):
        now = turns[k]
        same = 0
        for a, b in zip(before, now):
            if a != b:
                break
            same += 1
        del path[same + 1 :]
        for i in range(same, len(now)):
            up.append(path[-1])
            path.append(len(up) - 1)
            conv.append(reps[k])
            count.append(0)
            size.append(sizes[k][i])
            end.append(None)
            level.append(depth + i + 1)
        at = path[-1]
        count[at] += weights[k]
        conv[at] = min(conv[at], reps[k])
        end[at] = reps[k]
        before = now
    kids, leaves, saved = [0] * len(up), [0] * len(up), [0] * len(up)
    for i in range(len(up) - 1, -1, -1):  # nodes stand before what is under them
        leaves[i] = leaves[i] or 1
        saved[i] += (count[i] - 1) * size[i] if i else 0
        if i:
            p = up[i]
            count[p] += count[i]
            conv[p] = min(conv[p], conv[i])
            kids[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    return [(conv[i], level[i], conv[up[i]] if i else None, count[i], kids[i], leaves[i], saved[i], end[i], not i) for i in range(len(up))]


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps containers one by one; their rows (node, depth, rep, weight, pos, t1, t2, bytes) come together, each conversation's in order."""
    types = [pa.int64()] * 8 + [pa.bool_()]
    names = [f.split(" ")[0] for f in _NODES.split(", ")]

    def of(rows: list[tuple]) -> list[tuple]:
        ids: dict[tuple, int] = {}
        reps, weights, turns, sizes = [], [], [], []
        for _, _, rep, weight, pos, t1, t2, size in rows:
            if not reps or reps[-1] != rep:
                reps.append(rep)
                weights.append(weight)
                turns.append([])
                sizes.append([])
            if pos is not None:
                turns[-1].append(ids.setdefault((t1, t2), len(ids)))
                sizes[-1].append(size)
        return _sweep(rows[0][0], rows[0][1], reps, weights, turns, sizes)

    def record(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    held: list[tuple] = []
    for batch in batches:
        out: list[tuple] = []
        rows = zip(*(c.to_pylist() for c in batch.columns))
        for _, own in groupby(rows, lambda r: r[0]):
            own = list(own)
            if held and held[0][0] != own[0][0]:
                out += of(held)
                held = own
            else:
                held += own
        if out:
            yield record(out)
    if held:
        yield record(of(held))


def _chains(rows: DataFrame) -> DataFrame:
    """The nodes of containers of one conversation (node, depth, rep, weight, n, pos, bytes), a row a node, and the heads' sums."""
    each = rows.select("*", ((F.col("weight") - 1) * F.col("bytes")).alias("own"), F.floor(F.col("pos") / _CHAIN_BLOCK).alias("block"))
    blocks = each.groupBy("rep", "block").agg(F.sum("own").alias("of_block"))
    later = F.sum("of_block").over(W.partitionBy("rep").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select(F.col("rep").alias("r"), F.col("block").alias("b"), F.coalesce(later, F.lit(0)).alias("later"))
    inside = F.sum("own").over(W.partitionBy("rep", "block").orderBy(F.desc("pos")))
    each = each.withColumn("inside", inside).join(blocks, (F.col("rep") == F.col("r")) & (F.col("block") == F.col("b"))).withColumn("saved", F.col("inside") + F.col("later"))
    last = F.col("pos") + 1 == F.col("n")
    one = F.lit(1).cast("long")
    top = F.col("pos") == F.col("depth")
    nodes = each.select(
        F.col("rep").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.when(top, F.col("node")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.when(last, F.col("rep")).alias("end"), F.lit(False).alias("head"),
    )
    heads = each.where(top).select("node", "depth", F.lit(None).cast("long"), F.lit(0).cast("long"), one, one, "saved", F.lit(None).cast("long"), F.lit(True))
    return nodes.union(heads)


# ---- the trie -----------------------------------------------------------------------------------------------------


def prefix_trie(placed: DataFrame, members: DataFrame | None = None, *, limit: int = LIMIT) -> DataFrame:
    """One row a node of the trie of conversations ``placed`` (conv, pos, t1, t2, bytes), as ``placed_turns`` gives them.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). ``members`` (conv) names
    conversations beside those with turns; they end at the root. ends_sha256 is of the decimal ids of the conversations
    that end at the node, ascending, joined by commas. No conversation at all gives an empty result.
    """
    placed = Stored(placed.select("conv", "pos", "t1", "t2", "bytes"), "placed")
    each = placed.df.groupBy("conv").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("pos", "t1", "t2")).alias("f1"), F.bit_xor(F.xxhash64("t2", "pos", "t1")).alias("f2"))
    if members is not None:
        zero = F.lit(0).cast("long")
        each = each.union(members.select("conv").distinct().join(each.select("conv"), "conv", "left_anti").select("conv", zero, zero, zero))
    each = Stored(each, "conversations")
    classes = Stored(each.df.groupBy("n", "f1", "f2").agg(F.min("conv").alias("rep"), F.count("*").alias("weight")), "classes")
    several = each.df.join(classes.df.where("weight > 1"), ["n", "f1", "f2"]).select("rep", "conv")
    hashes = Stored(_end_hashes(several), "ends")
    each.drop()
    rows = Stored(placed.df.join(classes.df.select("rep"), F.col("conv") == F.col("rep"), "left_semi"), "rows")
    placed.drop()

    root = classes.df.agg(F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs")).where("conv_id is not null")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    level = Stored(root.select("conv_id", zero.alias("depth"), none.alias("parent_conv_id"), "n_convs", zero.alias("bytes"), F.array("conv_id").alias("path")), "heads")
    heads, ended, closed, chains = [level], [], [], []
    opened = Stored(classes.df.crossJoin(F.broadcast(root.select(F.col("conv_id").alias("node")))).select("rep", "weight", "n", "node"), "open")  # one row
    depth = 0
    while True:
        sizes = opened.df.groupBy("node").agg(F.sum(F.col("n") - depth).alias("turns"), F.count(F.when(F.col("n") > depth, 1)).alias("different"))
        over = sizes.where(F.col("turns") > limit).select(F.col("node").alias("o"), (F.col("different") > 1).alias("bursts"))
        dealt = Stored(opened.df.join(over, F.col("node") == F.col("o"), "left").select("rep", "weight", "n", "node", F.lit(depth).cast("long").alias("depth"), "bursts"), "dealt")
        opened.drop()
        closed.append(dealt.df.where("bursts is null").drop("bursts"))
        chains.append(dealt.df.where("not bursts").drop("bursts"))
        big = dealt.df.where("bursts")
        ended.append(dealt.df.where("bursts is not null and n = depth").select("node", "depth", F.col("rep").alias("end")))
        if big.isEmpty():
            break
        following = rows.df.where(F.col("pos") == depth).select("conv", "t1", "t2", "bytes")
        onward = Stored(big.where("n > depth").join(following, F.col("rep") == F.col("conv")).select("rep", "weight", "n", "node", "t1", "t2", "bytes"), "onward")
        child = Stored(onward.df.groupBy("node", "t1", "t2").agg(F.min("rep").alias("child"), F.sum("weight").alias("n_convs"), F.first("bytes").alias("bytes")), "children")
        above = level.df.select(F.col("conv_id").alias("p"), "path")
        made = child.df.join(above, F.col("node") == F.col("p")).select(F.col("child").alias("conv_id"), F.lit(depth + 1).cast("long").alias("depth"), F.col("node").alias("parent_conv_id"), "n_convs", "bytes", F.concat("path", F.array("child")).alias("path"))
        level = Stored(made, "heads")
        heads.append(level)
        opened = Stored(onward.df.join(child.df.select("node", "t1", "t2", "child"), ["node", "t1", "t2"]).select("rep", "weight", "n", F.col("child").alias("node")), "open")
        onward.drop()
        child.drop()
        depth += 1

    def whole(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for more in parts[1:]:
            out = out.union(more)
        return out

    held = whole(closed).join(rows.df, (F.col("rep") == F.col("conv")) & (F.col("pos") >= F.col("depth")), "left").select("node", "depth", "rep", "weight", "pos", "t1", "t2", "bytes")
    swept = held.repartition("node").sortWithinPartitions("node", "rep", "pos").mapInArrow(_swept, _NODES)
    alone = whole(chains).join(rows.df, (F.col("rep") == F.col("conv")) & (F.col("pos") >= F.col("depth"))).select("node", "depth", "rep", "weight", "n", "pos", "bytes")
    below = Stored(swept.union(_chains(alone)), "nodes")
    rows.drop()

    # heads: what a container sums up goes to its own head and all above it
    tops = whole([h.df for h in heads])
    sums = below.df.where("head").select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), "n_children", "n_leaves", "saved_tokens", "end")
    at = tops.join(sums, (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("d")), "left").withColumn("own", (F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("saved_tokens", F.lit(0)))
    up = at.select("own", "n_leaves", F.posexplode("path").alias("d2", "c2")).groupBy("c2", "d2").agg(F.sum("own").alias("saved"), F.coalesce(F.sum("n_leaves"), F.lit(0)).alias("leaves"))
    kids = tops.groupBy(F.col("parent_conv_id").alias("c3"), (F.col("depth") - 1).alias("d3")).agg(F.count("*").alias("kids"))
    stops = whole(ended).select(F.col("node").alias("c4"), F.col("depth").alias("d4"), F.col("end").alias("stop"))
    same = lambda c, d: (F.col("conv_id") == F.col(c)) & (F.col("depth") == F.col(d))
    top = at.join(up, same("c2", "d2")).join(kids, same("c3", "d3"), "left").join(stops, same("c4", "d4"), "left")
    top = top.select("conv_id", "depth", "parent_conv_id", "n_convs", (F.coalesce("n_children", F.lit(0)) + F.coalesce("kids", F.lit(0))).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("end", "stop").alias("end"))
    nodes = below.df.where("not head").drop("head").union(top)
    found = nodes.join(hashes.df.withColumnRenamed("end", "e"), F.col("end") == F.col("e"), "left")
    sha = F.when(F.col("end").isNull(), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", F.sha2(F.col("end").cast("string"), 256)))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))


def mixed_families(placed: DataFrame, *, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of their family's first, and all conversations (conv).

    c's family begins with c - c % family; h is crc32 of the decimal c, modulo ``most``. Where that conversation has
    fewer turns, or is absent, so many fewer turns come before c's own, which begin after its first h.
    """
    placed = Stored(placed, "original").df
    convs = Stored(placed.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % family).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")), "families").df
    first = placed.where(F.col("pos") < most - 1).select(F.col("conv").alias("b"), F.col("pos").alias("p"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("bytes").alias("size"))
    lent = convs.join(first, (F.col("base") == F.col("b")) & (F.col("p") < F.col("h"))).select("conv", F.col("p").alias("pos"), F.col("u1").alias("t1"), F.col("u2").alias("t2"), F.col("size").alias("bytes"))
    lent = Stored(lent, "lent").df
    got = lent.groupBy(F.col("conv").alias("g")).agg(F.count("*").alias("got"))
    shift = convs.join(got, F.col("conv") == F.col("g"), "left").select(F.col("conv").alias("c"), "h", F.coalesce("got", F.lit(0)).alias("got"))
    own = placed.join(shift, (F.col("conv") == F.col("c")) & (F.col("pos") >= F.col("h"))).select("conv", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "t1", "t2", "bytes")
    return lent.union(own), convs.select("conv")
