"""Operator 13: the prefix trie of conversations, by double arrays per prefix shard.

A turn is named by two 64-bit numbers (MD5 of role and text), a node by two more
(exclusive or of the names of its turns, each mixed with its depth), so texts
are read once and never shuffled. A conversation is cut into segments of
``SEGMENT`` turns, each with the name of the node it hangs from; equal segments
are counted before anything else, so copies are one row. Segments are sorted and
dealt out by range: a shard is a run of neighbouring prefixes, and a prefix that
many conversations share is spread over as many shards as it needs. Each shard
numbers its turns densely, packs its segments into BASE and CHECK arrays and
walks every segment through them, adding up per node. A node that several shards
share (an upper node, or one on a shard's edge) gets its total by one global
aggregation over the shards' partial rows.

Two walks are made. The first gives members, smallest member and words of every
node. A node belongs to its smallest member; with X = words of a conversation in
nodes that are not its own, the saving below a node u is
sum of X over its members except the smallest - (members - 1) * words above u,
and its leaves are the members that own a leaf. So both are sums over members,
which the second walk adds up; nothing is passed from level to level, and depth
costs no rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.tables import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
#: turns of a segment; segments of one double array
SEGMENT, SHARD_ROWS = 64, 10_000
#: conversation ids joined into one piece before hashing: ids of one piece share id div ID_BLOCK
ID_BLOCK = 1 << 14


def _two_longs(value: Column) -> tuple[Column, Column]:
    digest = F.md5(value)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return half(1), half(17)


def numbered_turns(spark: SparkSession, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, pos, k1, k2, words): turns in order, from 1; ties in turn go by the turn's name.

    Rows are dealt out by range of (conv_id, turn, name) and numbered where they
    are; a conversation that runs over several partitions adds the counts of
    the earlier ones. Those are at most two conversations a partition.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    k1, k2 = _two_longs(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(WORDS)).cast("long")
    narrow = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", k1.alias("k1"), k2.alias("k2"), words.alias("words"))
    order = ["conv_id", "turn", "k1", "k2"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = np.asarray(batch.column(0))
            if not len(conv):
                continue
            new = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            run = np.arange(len(conv)) - np.repeat(new, np.diff(np.append(new, len(conv)))) + 1
            if conv[0] == last:
                run[: new[1] if len(new) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(run[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(conv), part), pa.int32()), batch.column(0), pa.array(run, pa.int64()), *(batch.column(i) for i in (2, 3, 4))],
                ["part", "conv_id", "at", "k1", "k2", "words"],
            )

    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = scratch.keep(ranged.mapInArrow(number, "part int, conv_id long, at long, k1 long, k2 long, words long"), "numbered")
    edges = ranged.groupBy("part").agg(F.array(F.min("conv_id"), F.max("conv_id")).alias("e")).select(F.explode("e").alias("conv_id")).distinct()
    counts = ranged.join(F.broadcast(edges), "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("before", before).where("before is not null").drop("n")
    return ranged.join(F.broadcast(offsets), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "k1", "k2", "words"
    )


def rebuilt_turns(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of every conversation, and (conv_id, depth, k1, k2, words) of the rebuilt ones.

    Conversation c begins with the first h turns of conversation c - c % group,
    h = crc32(decimal c) % heads, and goes on with its own turns after its
    first h.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("turns"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("long")
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns")), "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0))))
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "k1", "k2", "words")
    head = turns.where((F.col("pos") < heads) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    head = head.join(convs.select("base", "conv_id", "h"), "base").where("pos <= h")
    head = head.select("conv_id", F.col("pos").alias("depth"), "k1", "k2", "words")
    return convs.select("conv_id"), own.unionByName(head)


def segments(convs: DataFrame, turns: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """One row per conversation and ``length`` turns: conv_id, seg, p1, p2, above (name of the node it hangs from and the
    words up to it), e1, e2 (its last node), words, last, turns (array of depth, k1, k2, t1, t2, w).

    Names and words above a segment are running sums over the conversation's
    earlier segments, blocks of 4,096 of them first. A conversation without turns has one empty segment.
    """
    turns = turns.withColumns({"t1": F.xxhash64("k1", "depth"), "t2": F.xxhash64("k2", "depth")})
    one = F.struct("depth", "k1", "k2", "t1", "t2", F.col("words").alias("w"))
    cut = F.floor((F.col("depth") - 1) / length).cast("long")
    segs = turns.groupBy("conv_id", cut.alias("seg")).agg(
        F.sort_array(F.collect_list(one)).alias("turns"), F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"), F.sum("words").alias("words"),
    )
    segs = scratch.keep(segs, "segments")
    sums = [F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"), F.sum("words").alias("bw")]
    empty = [F.coalesce(c, F.lit(0).cast("long")) for c in ("b1", "b2", "bw")]
    # conversations of more than one segment
    far = segs.where("seg > 0").select("conv_id", "seg").groupBy("conv_id").agg(F.max("seg").alias("top"))
    many = segs.drop("turns").join(far, "conv_id").withColumn("block", F.expr("seg div 4096"))
    blocks = many.groupBy("conv_id", "block").agg(*sums)
    over_blocks = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *[agg(c).over(over_blocks).alias(f"o{c}") for c, agg in (("b1", F.bit_xor), ("b2", F.bit_xor), ("bw", F.sum))])
    inside = Window.partitionBy("conv_id", "block").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    many = many.select("conv_id", "seg", "block", "top", F.bit_xor("x1").over(inside).alias("b1"), F.bit_xor("x2").over(inside).alias("b2"), F.sum("words").over(inside).alias("bw"))
    zero = F.lit(0).cast("long")
    many = many.join(blocks, ["conv_id", "block"]).select(
        "conv_id", "seg", "top",
        empty[0].bitwiseXOR(F.coalesce("ob1", zero)).alias("p1"), empty[1].bitwiseXOR(F.coalesce("ob2", zero)).alias("p2"), (empty[2] + F.coalesce("obw", zero)).alias("above"),
    )
    out = segs.join(many, ["conv_id", "seg"], "left").withColumns({c: F.coalesce(c, zero) for c in ("p1", "p2", "above", "top")})
    cols = ["conv_id", "seg", "p1", "p2", "above", F.col("p1").bitwiseXOR(F.col("x1")).alias("e1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("e2"), "words", (F.col("seg") == F.col("top")).alias("last"), "turns"]
    none = convs.join(segs.where("seg = 0").select("conv_id"), "conv_id", "left_anti")
    none = none.withColumns({"seg": zero, "p1": zero, "p2": zero, "above": zero, "x1": zero, "x2": zero, "words": zero, "top": zero})
    none = none.withColumn("turns", F.array().cast(segs.schema["turns"].dataType))
    return out.select(*cols).unionByName(none.select(*cols))


class DoubleArray:
    """BASE and CHECK over dense symbols: the child of state s by symbol c is state BASE[s] + c if CHECK of that is s.

    Built level by level from sorted rows of symbols. Children of one state
    are placed together at the first base that fits among the lowest free
    cells (cells behind the last used one are free as well), else behind the
    last used cell; single children fill free cells.
    """

    TRIES, STALE = 32, 128

    def __init__(self, symbols: int, room: int):
        self.base = np.zeros(symbols + room + 2, dtype=np.int64)
        self.check = np.full(symbols + room + 2, -1, dtype=np.int64)
        self.check[0] = 0  # the root
        self.top = 1
        self.free = np.zeros(0, dtype=np.int64)

    def _use(self, state: np.ndarray | int, base: np.ndarray | int, cells: np.ndarray) -> None:
        end = int(cells.max()) + 1
        if end > len(self.check):
            more = max(len(self.check) // 4, end - len(self.check))
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
        self.base[state], self.check[cells] = base, state
        self.top = max(self.top, end)

    def _fits(self, base: int, children: np.ndarray) -> bool:
        cells = base + children
        return bool((self.check[cells[cells < self.top]] < 0).all())

    def add_level(self, state: np.ndarray, symbol: np.ndarray) -> None:
        """Children of a level: distinct (state, symbol), sorted."""
        first = np.flatnonzero(np.concatenate([[True], state[1:] != state[:-1]]))
        count = np.diff(np.append(first, len(state)))
        for i, (a, k) in enumerate(zip(first[count > 1].tolist(), count[count > 1].tolist())):
            if i % self.STALE == 0:
                self.free = np.flatnonzero(self.check[: self.top] < 0)
            children = symbol[a : a + k]
            low = int(children[0])
            at = int(np.searchsorted(self.free, low + 1))
            tries = [f for f in self.free[at : at + self.STALE + self.TRIES].tolist() if self.check[f] < 0][: self.TRIES]
            base = next((f - low for f in tries if self._fits(f - low, children)), max(self.top - low, 1))
            self._use(int(state[a]), base, base + children)
        alone = first[count == 1]
        if not len(alone):
            return
        alone = alone[np.argsort(symbol[alone], kind="stable")]
        s, c = state[alone], symbol[alone]
        holes = np.flatnonzero(self.check[: self.top] < 0)[-len(alone) :]  # the largest, for the largest symbols
        cells = np.full(len(alone), -1, np.int64)
        cells[len(alone) - len(holes) :] = holes
        cells[cells <= c] = -1  # a base is 1 at least
        rest = np.flatnonzero(cells < 0)
        cells[rest] = max(self.top, int(c[rest].max(initial=0)) + 1) + np.arange(len(rest))
        self._use(s, cells - c, cells)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is no such child."""
        to = self.base[state] + symbol
        found = (to >= 0) & (to < len(self.check))
        found[found] = self.check[to[found]] == state[found]
        return np.where(found, to, -1)


def walk_shard(group: np.ndarray, lengths: np.ndarray, names: np.ndarray) -> tuple[DoubleArray, np.ndarray, list[np.ndarray]]:
    """Pack sorted segments into a double array; also the state of each segment's group and of each of its turns.

    ``group`` numbers the nodes that segments hang from, ``names`` (turns x 2)
    the turns of all segments in a row. Symbols are dense: groups first, then
    the distinct turns, level by level as they first occur, so that children
    of one node lie close together.
    """
    start = np.cumsum(lengths) - lengths
    groups = int(group.max(initial=-1)) + 1
    symbols, dense = groups, np.zeros(0, np.int64)
    if len(names):
        pair = np.ascontiguousarray(names).view([("a", np.int64), ("b", np.int64)]).ravel()
        by_level = np.argsort(np.arange(len(names)) - np.repeat(start, lengths), kind="stable")
        distinct, at, dense = np.unique(pair[by_level], return_index=True, return_inverse=True)
        place = np.empty(len(distinct), np.int64)
        place[np.argsort(at)] = np.arange(len(distinct))
        back = np.empty(len(names), np.int64)
        back[by_level] = place[dense.ravel()]
        dense, symbols = back + groups, groups + len(distinct)
    trie = DoubleArray(symbols, len(dense) + groups)
    trie.add_level(np.zeros(groups, np.int64), np.arange(groups))
    roots = trie.step(np.zeros(len(group), np.int64), group)
    state, states = roots.copy(), []
    for i in range(int(lengths.max(initial=0))):
        going = np.flatnonzero(lengths > i)
        symbol = dense[start[going] + i]
        both = np.unique(state[going] * symbols + symbol)  # sorted (state, symbol)
        trie.add_level(both // symbols, both % symbols)
        state[going] = trie.step(state[going], symbol)
        states.append(state[going].copy())
    return trie, roots, states


def _shards(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Sorted rows in runs of about ``rows``."""
    kept, n = [], 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(kept)
            kept, n = [], 0
    if n:
        yield pa.Table.from_batches(kept)


def _walker(first: bool, rows: int):
    """The Arrow function of a walk. First: members, smallest member, ends and place of each node; else sums over members."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _shards(batches, rows):
            col = lambda name: np.asarray(table.column(name).combine_chunks())
            turns = table.column("turns").combine_chunks()
            lengths = np.asarray(turns.value_lengths()).astype(np.int64)
            flat = turns.flatten()
            field = lambda name: np.asarray(flat.field(name)).astype(np.int64)
            seg, p1, p2 = col("seg"), col("p1"), col("p2")
            hang = np.stack([seg, p1, p2], axis=1)
            changed = np.concatenate([[True], (hang[1:] != hang[:-1]).any(axis=1)])
            group = np.cumsum(changed) - 1
            trie, roots, states = walk_shard(group, lengths, np.stack([field("k1"), field("k2")], axis=1))
            # totals are kept by node, not by cell: cells of the array may be many more
            number = np.cumsum(trie.check >= 0) - 1
            roots, states, size = number[roots], [number[x] for x in states], int(number[-1]) + 1
            start = np.cumsum(lengths) - lengths
            t1, t2, w, depth = field("t1"), field("t2"), field("w"), field("depth")
            n, low = col("n"), col("low")
            own = {c: np.zeros(size, np.int64) for c in ("n1", "n2", "parent1", "parent2", "depth", "above", "w", "n", "ends", "x", "leaves", "low_x")}
            own["low"] = np.full(size, np.iinfo(np.int64).max)
            used = np.zeros(size, dtype=bool)
            add = [("n", n), ("ends", col("ends"))] if first else [("x", col("x")), ("leaves", col("leaves"))]

            def count(at: np.ndarray, rows: np.ndarray) -> None:
                used[at] = True
                for name, values in add:
                    np.add.at(own[name], at, values[rows])
                if first:
                    np.minimum.at(own["low"], at, low[rows])
                else:  # X of the smallest member
                    order = np.lexsort((low[rows], at))
                    at, rows = at[order], rows[order]
                    head = np.concatenate([[True], at[1:] != at[:-1]])
                    own["low"][at[head]], own["low_x"][at[head]] = low[rows][head], col_low_x[rows][head]

            col_low_x = None if first else col("low_x")
            everyone = np.arange(len(lengths))
            whole = everyone[seg == 0]  # the root of all is a node of segment 0 alone
            if first:
                ends, add[1] = add[1][1], ("ends", np.where(lengths == 0, add[1][1], 0))
            if len(whole):
                count(roots[whole], whole)
            own["n1"][roots], own["n2"][roots], own["above"][roots] = p1, p2, col("above")
            own["depth"][roots] = depth[np.minimum(start, max(len(depth) - 1, 0))] - 1 if len(depth) else 0
            own["depth"][roots[lengths == 0]] = 0
            state = roots.copy()
            for i, to in enumerate(states):
                going = everyone[lengths > i]
                at = start[going] + i
                before = state[going]
                own["parent1"][to], own["parent2"][to] = own["n1"][before], own["n2"][before]
                own["n1"][to], own["n2"][to] = own["n1"][before] ^ t1[at], own["n2"][before] ^ t2[at]
                own["above"][to] = own["above"][before] + own["w"][before]
                own["w"][to], own["depth"][to] = w[at], depth[at]
                if first:
                    add[1] = ("ends", np.where(lengths == i + 1, ends, 0))
                count(to, going)
                state[going] = to
            s = np.flatnonzero(used)
            names = FIRST if first else SECOND
            yield pa.RecordBatch.from_arrays([pa.array(own[c][s], pa.int64()) for c in names], list(names))

    return walk


FIRST = ("n1", "n2", "depth", "parent1", "parent2", "above", "w", "n", "low", "ends")
SECOND = ("n1", "n2", "depth", "x", "leaves", "low", "low_x")


def _ends_sha(ends: DataFrame) -> DataFrame:
    """(e1, e2, depth, ends_sha256) from (e1, e2, depth, conv_id): ids ascending, joined by commas.

    Ids are joined in pieces of neighbouring ids wherever they lie, then the
    pieces of a node stream through one hash in order. SHA-256 runs from
    front to back, so a node's pieces must meet in one task; it holds one
    piece at a time, whatever their number.
    """
    pieces = ends.groupBy("e1", "e2", "depth", F.floor(F.col("conv_id") / ID_BLOCK).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for batch in batches:
            done = []
            for e1, e2, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if (e1, e2, depth) != now:
                    if now is not None:
                        done.append((*now, h.hexdigest()))
                    now, h = (e1, e2, depth), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["e1", "e2", "depth", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, h.hexdigest())], ["e1", "e2", "depth", "ends_sha256"])

    key = ["e1", "e2", "depth"]
    dealt = pieces.repartition(*key).sortWithinPartitions(*key, "piece").select(*key, "piece", "ids")
    return dealt.mapInArrow(digests, "e1 long, e2 long, depth long, ends_sha256 string")


def prefix_trie(spark: SparkSession, conversations: DataFrame, length: int = SEGMENT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, words.

    ``conversations`` needs conv_id, turn, role and text; other columns are
    not read. Rows with a null conv_id belong to no conversation. A null role
    or text counts as empty; null turns come first; turns of equal number go
    by the name of role and text, repeated rows are turns of their own. A
    table without conversations gives no rows, not even a root.
    """
    scratch = Scratch(spark, "trie")
    key = ["n1", "n2", "depth"]
    turns = scratch.keep(numbered_turns(spark, conversations, scratch), "turns")
    convs, rebuilt = rebuilt_turns(turns)
    convs, rebuilt = scratch.keep(convs, "convs"), scratch.keep(rebuilt, "rebuilt")
    segs = scratch.keep(segments(convs, rebuilt, scratch, length), "hung")

    one = segs.groupBy("seg", "p1", "p2", "turns", "e1", "e2").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("low"), F.sum(F.col("last").cast("long")).alias("ends"), F.first("above").alias("above")
    )
    one = scratch.keep(one, "distinct")
    place = ["seg", "p1", "p2", "turns"]
    ranged = lambda df: df.repartitionByRange(*place).sortWithinPartitions(*place)
    schema = lambda names: ", ".join(f"{c} long" for c in names)
    parts = ranged(one).mapInArrow(_walker(True, shard_rows), schema(FIRST))
    nodes = parts.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in ("parent1", "parent2", "above", "w")], F.sum("n").alias("n"), F.min("low").alias("low"), F.sum("ends").alias("ends")
    )
    nodes = scratch.keep(nodes, "nodes")
    up = [F.col("parent1").alias("n1"), F.col("parent2").alias("n2"), (F.col("depth") - 1).alias("depth")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("children"))
    nodes = scratch.keep(nodes.join(children, key, "left").withColumn("children", F.coalesce("children", F.lit(0))), "family")

    # X of each conversation, and whether it owns a leaf
    mine = nodes.groupBy(F.col("low").alias("conv_id")).agg(F.sum("w").alias("o"), F.max((F.col("children") == 0).cast("long")).alias("leaves"))
    total = segs.groupBy("conv_id").agg(F.sum("words").alias("words"))
    member = total.join(mine, "conv_id", "left").select(
        "conv_id", (F.col("words") - F.coalesce("o", F.lit(0))).alias("x"), F.coalesce("leaves", F.lit(0)).alias("leaves")
    )
    member = scratch.keep(member, "members")
    sums = segs.select("conv_id", "seg", "e1", "e2").join(member, "conv_id").groupBy("seg", "e1", "e2").agg(
        F.sum("x").alias("x"), F.sum("leaves").alias("leaves"), F.min(F.struct("conv_id", "x"))["x"].alias("low_x")
    )
    second = one.join(scratch.keep(sums, "sums"), ["seg", "e1", "e2"])
    parts = ranged(second).mapInArrow(_walker(False, shard_rows), schema(SECOND))
    below = parts.groupBy(*key).agg(F.sum("x").alias("x"), F.sum("leaves").alias("leaves"), F.min(F.struct("low", "low_x"))["low_x"].alias("low_x"))
    below = scratch.keep(below, "below")

    last = segs.where("last").select("e1", "e2", (F.col("seg") * length + F.size("turns")).alias("depth"), "conv_id")
    shas = _ends_sha(last).withColumnsRenamed({"e1": "n1", "e2": "n2"})
    parents = nodes.select(F.col("n1").alias("parent1"), F.col("n2").alias("parent2"), (F.col("depth") + 1).alias("depth"), F.col("low").alias("parent_conv_id"))
    out = nodes.join(below, key).join(shas, key, "left").join(parents, ["parent1", "parent2", "depth"], "left")
    saved = F.col("x") - F.col("low_x") - (F.col("n") - 1) * F.col("above")
    return out.select(
        F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        F.col("w").alias("words"),
    )
