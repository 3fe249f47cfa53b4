"""Operator 2: all documents whose word-shingle sets are similar, by a prefix-tree join.

Sets are kept in one global order (the order of the shingle names). The join
has two parts:

* **Which sets meet.** Two sets with Jaccard similarity t differ in at most
  d = 2 n (1 - t) / (1 + t) shingles, n being the larger size. The name range
  is cut into M = 2**k > d equal segments, so at least M - d segments hold
  exactly the same shingles in both. The path of a set through one segment
  (its shingles there, in order) is named by a hash; sets that share a path
  name meet. M depends on the larger set only; a set whose partners may need
  another power of two is entered for each. A frequent shingle is no hot key,
  since a path is the whole content of a segment. A set with so many empty
  segments that they alone could be the equal ones is also entered by the
  first shingles of its order (the prefix filter), of which linked sets share
  one. A set that shares fewer than M - d paths with all others together has
  no partner and leaves before families are formed.
* **The tree.** Sets that meet, directly or over others, form families. Work is
  dealt out by family or, where that sends fewer sets around (a very large
  family that shares little), by path; larger groups are cut into blocks of bounded size and
  every pair of blocks is one unit. In a unit the ordered sets form a trie with
  edges of 64 shingles; a set walks it level by level, so sets with a common
  path share their partial overlap, and a subtree leaves as soon as its
  overlap plus the smaller of the remaining lengths cannot reach the threshold.

Exact copies are merged before the join (a set is named by 128 bits), only
links that join two groups of a unit are returned, and groups are connected
components over those links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import textbytes as tb
from corpusforge.llm.tables import Scratch, components

SIZE = 5
PERCENT = 80
EDGE = 64  # shingles on one edge of the trie
BLOCK_SETS = 256  # sets in one block
BLOCK_TOKENS = 1 << 20  # shingles in one block, about
PEELS = 3
WAVE_SHARE = 2  # texts sent to units at a time: one such part of all distinct sets
WAVE_TOKENS = 1 << 26  # shingles that are always sent at once


def _waves(sent: int, whole: int) -> int:
    """Number of waves in which ``sent`` shingles go to their units, ``whole`` being those of all distinct sets.

    A family of c sets sends each of its texts c / ``BLOCK_SETS`` times. All at once that would fill the
    disk with the square of c; a wave's shuffle files go before the next begins."""
    return max(1, -(-sent * WAVE_SHARE // max(whole, WAVE_SHARE * WAVE_TOKENS)))


def _most(n: int, percent: int) -> int:
    """Largest difference of two linked sets of which the larger has n shingles."""
    return 2 * n * (100 - percent) // (100 + percent)


def _slack(percent: int) -> float:
    """Segments to spare, as a share of the largest difference, so that empty segments are seldom all the equal ones."""
    return 10 * math.exp(-(100 + percent) / (2 * (100 - percent)))


def _power(n: int, percent: int) -> int:
    """k for a pair whose larger set has n shingles: 2**k exceeds the largest difference, with room for empty segments."""
    most = _most(n, percent)
    return (most + int(most * _slack(percent))).bit_length()


_K = tb.U64(31)  # the low bits of a path's name hold its k; PREFIX marks entries by the prefix filter
PREFIX = 31


def _named_paths(h: np.ndarray, k: int) -> np.ndarray:
    return (h & ~_K) | tb.U64(k)


def _paths(s: np.ndarray, percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(path names of one ordered set, [(k, need)]): with any partner for k the set shares at least ``need`` of its paths."""
    out, needs = [], []
    n = len(s)
    mixed = tb.finalize(s)
    widest = 100 * n // percent  # size of the largest partner
    for k in range(_power(n, percent), _power(widest, percent) + 1):
        if k == 0:  # any partner is the same set
            continue
        seg = (s >> tb.U64(64 - k)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        ids = (seg[cut] + (k << 48)).astype(np.uint64)
        with np.errstate(over="ignore"):
            out.append(_named_paths(tb.finalize(np.add.reduceat(mixed, cut) + ids * tb._MIX1), k))
        # segments that a partner for this k shares at least; the empty ones among them have no path
        equal = (1 << k) - min(_most(widest, percent), int((1 << k) / (1 + _slack(percent))), (1 << k) - 1)
        needs.append((k, equal - ((1 << k) - len(cut))))
    if any(need < 1 for _, need in needs):
        out.append(_named_paths(tb.finalize(s[: n + (-percent * n // 100) + 1] ^ tb._MIX2), PREFIX))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), needs


def ordered_sets(col: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ordered distinct shingle names) of each text."""
    data, offsets = tb.text_bytes(col)
    for a, b in tb.runs_of_rows(offsets):
        local = offsets[a : b + 1] - offsets[a]
        part = data[offsets[a] : offsets[b]]
        start, end, row = tb.word_spans(part, local)
        h, r = tb.shingle_hashes(tb.word_hashes(part, start, end), row, b - a, size)
        h, r = tb.distinct_per_row(h, r)
        cut = np.searchsorted(r, np.arange(b - a + 1))
        for i in range(b - a):
            yield a + i, h[cut[i] : cut[i + 1]]


def _name(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128-bit name of a set."""
    with np.errstate(over="ignore"):
        return tb.finalize(s).sum(dtype=np.uint64) + tb.U64(len(s)), tb.finalize(s ^ tb._MIX2).sum(dtype=np.uint64)


def _signed(x: list) -> pa.Array:
    return pa.array(np.array(x, dtype=np.uint64).view(np.int64))


def _set_rows(size: int, percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = [(len(s), *_name(s), _paths(s, percent)[1] if len(s) else []) for _, s in ordered_sets(batch.column(1), size)]
            n, one, two, needs = zip(*named) if named else ((), (), (), ())
            pairs = [[{"k": k, "need": need} for k, need in x] for x in needs]
            kind = pa.list_(pa.struct([("k", pa.int32()), ("need", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), _signed(one), _signed(two), pa.array(pairs, kind)],
                names=["doc_id", "n", "id1", "id2", "needs"],
            )

    return rows


def _path_rows(size: int, percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                paths, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
                for _, s in ordered_sets(batch.column(0).slice(a, 512), size):
                    if len(s):
                        paths.append(_paths(s, percent)[0])
                        ids.append(np.full(len(paths[-1]), _name(s)[0]))
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(x)) for x in (paths, ids)], names=["path", "id1"])

    return rows


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (path, id1): (path, id1, first id1) of the paths with two sets or more. Carries one row between batches."""
    last: tuple[int, int, bool] | None = None  # path, its first set, whether that row is out
    for batch in batches:
        if batch.num_rows == 0:
            continue
        path, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        new = np.concatenate([[last is None or path[0] != last[0]], path[1:] != path[:-1]])
        group = np.cumsum(new)  # 0: the carried path goes on
        first = np.concatenate([[last[1] if last else 0], node[new]])
        is_out = np.zeros(len(first), dtype=bool)
        is_out[0] = last is None or last[2]
        other = node != first[group]
        other[1:] &= new[1:] | (node[1:] != node[:-1])
        paths = np.concatenate([[last[0] if last else 0], path[new]])
        meets = np.zeros(len(first), dtype=bool)
        meets[group[other]] = True
        heads = np.flatnonzero(meets & ~is_out)
        p = np.concatenate([paths[heads], path[other]])
        i = np.concatenate([first[heads], node[other]])
        f = np.concatenate([first[heads], first[group[other]]])
        last = (int(path[-1]), int(first[group[-1]]), bool(meets[group[-1]] or (group[-1] == 0 and is_out[0])))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, i, f)], names=["path", "id1", "first"])


class Trie:
    """Ordered sets of one unit as a tree of ``EDGE``-shingle edges."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        vocabulary, ids = np.unique(flat, return_inverse=True)
        self.n_names = len(vocabulary)
        cut = np.concatenate([[0], np.cumsum(self.sizes)])
        self.sets = [ids[cut[i] : cut[i + 1]] for i in range(len(sets))]
        depth = int(-(-self.sizes.max() // EDGE))
        node = np.zeros(len(sets), dtype=np.int64)
        self.levels = []
        for level in range(depth):
            has = np.flatnonzero(self.sizes > level * EDGE)
            edge = np.full((len(has), EDGE + 1), self.n_names, dtype=np.int64)
            edge[:, 0] = node[has]
            for r, i in enumerate(has):
                part = self.sets[i][level * EDGE : (level + 1) * EDGE]
                edge[r, 1 : 1 + len(part)] = part
            edges, where = np.unique(edge, axis=0, return_inverse=True) if len(has) > 1 else (edge, np.zeros(1, np.int64))
            where = where.reshape(-1)
            node = np.full(len(sets), -1, dtype=np.int64)
            node[has] = where
            # last name on the edge: what a query has after it bounds what it can still add
            tail = np.where(edges[:, 1:] < self.n_names, edges[:, 1:], -1).max(axis=1)
            self.levels.append((edges[:, 1:], node.copy(), tail))

    def near(self, q: int, alive: np.ndarray, percent: int) -> np.ndarray:
        """Those of ``alive`` whose similarity with set q is at least ``percent`` / 100."""
        query, nq = self.sets[q], len(self.sets[q])
        mark = np.zeros(self.n_names + 1, dtype=bool)
        mark[query] = True
        need = -(-percent * (nq + self.sizes) // (100 + percent))  # smallest overlap that links
        over = np.zeros(len(self.sizes), dtype=np.int64)
        done = []
        for level, (edges, node, tail) in enumerate(self.levels):
            ended = self.sizes[alive] <= level * EDGE
            if ended.any():
                done.append(alive[ended])
                alive = alive[~ended]
            if len(alive) == 0:
                break
            nodes, where = np.unique(node[alive], return_inverse=True)
            over[alive] += mark[edges[nodes]].sum(axis=1)[where]
            left_query = nq - np.searchsorted(query, tail[nodes], side="right")[where]
            left_set = np.maximum(self.sizes[alive] - (level + 1) * EDGE, 0)
            alive = alive[over[alive] + np.minimum(left_query, left_set) >= need[alive]]
        done.append(alive)
        done = np.concatenate(done)
        return done[over[done] >= need[done]]


def unit_links(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect the linked sets of one unit. sides: 0 and 1 for two blocks, whose own pairs are another unit's; all 2 within one block."""
    order = np.lexsort((ids, [len(s) for s in sets]))
    ids, sides, sets = ids[order], sides[order], [sets[i] for i in order]
    trie = Trie(sets)
    root = np.arange(len(sets))
    out = []
    for q in range(1, len(sets)):
        near_size = 100 * trie.sizes[:q] >= percent * trie.sizes[q]
        alive = np.flatnonzero(near_size & (root[:q] != root[q]) & ((sides[:q] != sides[q]) | (sides[q] == 2)))
        if len(alive) == 0:
            continue
        for x in trie.near(q, alive, percent):
            if root[x] != root[q]:
                out.append((int(ids[x]), int(ids[q])))
                root[root == root[x]] = root[q]
    return out


def _unit_rows(size: int, percent: int):
    """Rows (kind, grp, i, j, node, side, id1, text) of one unit come together; a unit that spans Arrow batches is carried over."""

    def links(held: list[tuple]) -> pa.RecordBatch:
        node, side, id1, text = zip(*held)
        sets = [s for _, s in ordered_sets(pa.array(text, pa.string()), size)]
        own = [k for k, s in enumerate(sets) if int(_name(s)[0].view(np.int64)) == id1[k]]  # a repeated doc_id may have other texts
        ids, sides = (np.array([x[k] for k in own], dtype=np.int64) for x in (node, side))
        found = unit_links(ids, sides, [sets[k] for k in own], percent) if len(own) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                for *unit, node, side, id1, text in zip(*[part.column(i).to_pylist() for i in range(8)]):
                    if held and unit != last:
                        yield links(held)
                        held = []
                    last = unit
                    held.append((node, side, id1, text))
        if held:
            yield links(held)

    return rows


def _peeled(scratch: Scratch, shared: DataFrame, kinds: DataFrame, rounds: int = PEELS) -> DataFrame:
    """(path, id1, first) without the sets that share too few of their paths for k with anyone, over and over; ``shared`` itself is dropped.

    Documents that only have a passage in common share a few of many paths
    and leave here, before they chain families together. Fewer rounds leave
    more rows, never fewer links.
    """
    need = kinds.select("id1", F.explode("needs").alias("x")).groupBy("id1", "x.k").agg(F.min("x.need").alias("need"))
    need = scratch.keep(need.where("need > 1"), "need")
    for r in range(rounds):
        k = F.col("path").bitwiseAND(PREFIX).cast("int").alias("k")
        have = shared.groupBy("id1", k).agg(F.count("*").alias("have"))
        few = have.join(need, ["id1", "k"]).where("have < need").select("id1", "k")
        few = scratch.keep(few, f"few{r}")
        rest = shared.withColumn("k", k).join(few, ["id1", "k"], "left_anti").drop("k")
        rest = scratch.keep(rest, f"rest{r}")
        scratch.drop(few, shared)
        again = rest.groupBy("path").agg(F.count("*").alias("c"), F.min("id1").alias("lead")).where("c > 1")
        again = scratch.keep(again.select("path", "lead"), f"again{r}")
        shared = scratch.keep(rest.join(again, "path").select("path", "id1", F.col("lead").alias("first")), f"shared{r}")
        scratch.drop(rest, again)
    scratch.drop(need)
    return shared


def near_duplicate_groups(
    spark: SparkSession, docs: DataFrame, size: int = SIZE, percent: int = PERCENT, block_sets: int = BLOCK_SETS
) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per distinct non-null doc_id.

    Two documents link when 100 * intersection >= percent * union of their sets
    of ``size``-word shingles (A-Z lower-cased; fewer words: the whole sequence
    is one shingle). A document without words, or with null text, has an empty
    set and is linked with nothing. component_id is the smallest doc_id
    reachable by links. Rows that repeat a doc_id count once, by the largest
    of their sets' names; rows with a null doc_id are left out.
    """
    scratch = Scratch(spark, "ngram")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where("doc_id is not null")
    ddl = "doc_id long, n long, id1 long, id2 long, needs array<struct<k: int, need: int>>"
    sets = texts.mapInArrow(_set_rows(size, percent), ddl)
    one = sets.groupBy("doc_id").agg(F.max(F.struct("id1", "id2", "n", "needs")).alias("s")).select("doc_id", "s.*")
    one = scratch.keep(one, "sets")
    kinds = one.where("n > 0").groupBy("id1", "id2", "n").agg(F.min("doc_id").alias("node"), F.first("needs").alias("needs"))
    kinds = scratch.keep(kinds, "kinds")

    # which sets meet; a path has each set once at most, so no path has more than its share of the rows
    entered = texts.select("text").mapInArrow(_path_rows(size, percent), "path long, id1 long")
    entered = entered.repartition("path").sortWithinPartitions("path", "id1")
    shared = scratch.keep(entered.mapInArrow(_shared_rows, "path long, id1 long, first long"), "shared")
    shared = _peeled(scratch, shared, kinds)
    rooted = components(spark, shared.select(F.col("first").alias("a"), F.col("id1").alias("b")), scratch)
    family = rooted.select(F.col("node").alias("id1"), F.col("root").alias("family"))

    # units: by family, or by path where that sends fewer sets around
    by_path = shared.groupBy("path").agg(F.count("*").alias("c"), F.min("id1").alias("id1")).join(family, "id1")
    by_path = by_path.groupBy("family").agg(F.sum("c").alias("path_rows"))
    members = kinds.select("node", "n", "id1").join(family, "id1")
    size_of = members.groupBy("family").agg((F.count("*") * F.ceil(F.count("*") / block_sets)).alias("family_rows"))
    way = size_of.join(by_path, "family").select("family", (F.col("path_rows") < F.col("family_rows")).alias("paths"))
    way = scratch.keep(way, "way")  # a table of its own, so that AQE can split the join's other side
    members = scratch.keep(members.join(way, "family"), "members")
    scratch.drop(way, rooted)
    groups = members.where("not paths").select(F.lit(0).alias("kind"), F.col("family").alias("grp"), "node", "id1", "n")
    along = shared.select("path", "id1").join(members.where("paths").select("id1", "node", "n"), "id1")
    groups = groups.unionByName(along.select(F.lit(1).alias("kind"), F.col("path").alias("grp"), "node", "id1", "n"))
    groups = scratch.keep(groups, "groups")
    scratch.drop(members, shared)
    total = groups.groupBy("kind", "grp").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    blocks = F.ceil(F.greatest(F.col("c") / block_sets, F.col("t") / BLOCK_TOKENS)).cast("int")
    total = scratch.keep(total.where("c > 1").select("kind", "grp", "t", blocks.alias("blocks")), "total")
    sent = total.agg(F.sum(F.col("t") * F.col("blocks"))).first()[0] or 0
    waves = _waves(sent, kinds.agg(F.sum("n")).first()[0] or 0)
    totals, total = total, total.drop("t")
    units = groups.join(total, ["kind", "grp"])
    units = units.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select(
        "kind",
        "grp",
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
        "node",
        "id1",
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
    )

    # the text of each set's first document goes to every unit its block takes part in (a text is shorter than
    # its names); always by a shuffle, so that the plan is the same at every size
    place = ["kind", "grp", "i", "j"]
    parts = []
    for w in range(waves):  # a unit is in one wave, whole
        own = units.where(F.pmod(F.xxhash64(*place), F.lit(waves)) == w)
        own = texts.join(own.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id")
        own = own.select(*place, "doc_id", "side", "id1", "text").repartition(*place).sortWithinPartitions(*place)
        parts.append(scratch.keep(own.mapInArrow(_unit_rows(size, percent), "a long, b long"), f"links{w}"))
    links = reduce(DataFrame.unionByName, parts)
    scratch.drop(groups, totals)

    group = components(spark, links, scratch)
    scratch.drop(*parts)
    sets_of = kinds
    kinds = kinds.join(group, "node", "left").select("id1", "id2", "n", "node", F.coalesce("root", "node").alias("root"))
    least = scratch.keep(kinds.groupBy("root").agg(F.min("node").alias("component_id")), "least")
    named = scratch.keep(kinds.join(least, "root").select("id1", "id2", "n", "component_id"), "named")
    scratch.drop(least, group, sets_of)
    kinds = named
    out = one.join(kinds, ["id1", "id2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
