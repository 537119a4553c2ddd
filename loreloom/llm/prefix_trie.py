"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns. Peeling descends from the greatest depth: at every depth the conversations
that end there join the nodes that survive from below, equal beginnings become one node, the node is finished (members,
children, leaves, tokens saved), its last turn is stripped, and it goes on one depth higher. So nodes are discovered and
aggregated in the same pass, and a node's subtree is never visited again.

At scale:

1. Turns are numbered, and texts replaced by hashes and word counts before anything moves. The exclusive-or of the hashes
   of a conversation's first d turns (each with its place, in two 64-bit words) stands for its beginning of d turns.
2. Conversations of equal turns become one class; the checksum of its ids is taken over the ids in range order, in pieces.
3. Depths are worked on in blocks of ``SEGMENT`` turns, deepest first, so a conversation with a third of all rows is many
   rows. Inside a block the beginnings with at most ``CELL`` ends below them are cells; a task peels a bucket of cells.
4. Beginnings with more ends (a common first turn) are peeled over all tasks, a depth at a time, by grouping, which
   combines before it shuffles; every such node has been reduced to one row per task by then.

Defined results: turns are ordered by turn number (null first), then role, then the SHA-256 of the text; a null role or
text is empty; repeated turns stay; rows without a conversation id belong to none; other columns are not read; a table
without conversations gives no node, otherwise there is a root, without text and parent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.llm.common import word_count
from loreloom.session import cut_lineage

PART = 1_024  # turn numbers ordered together
SEGMENT = 256  # turns of a block of depths
CELL = 1_024  # ends below a beginning that one task peels
BUCKET = 4_096  # turns of the cells of one call, about
SMALL = 10_000  # hot beginnings that are broadcast, 24 bytes each
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "rel long, x1 long, x2 long, p1 long, p2 long, conv long, parent long, m long, kids long, leaves long, saved long, ends string"


# --- turns -----------------------------------------------------------------------------------------------------------

def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, place in the part, role, said, words) and parts (conv_id, part, start: turns before it, n)."""
    slim = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("said"), word_count(text).alias("words"))
    slim = slim.withColumn("part", F.coalesce(F.floor(F.col("turn") / PART), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "said")
    turns = cut_lineage(slim.withColumn("place", F.row_number().over(inside).cast("long")).drop("turn"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return turns, parts


def in_order(turns: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id) and their turns (conv_id, k from 1, role, said, words) as they are."""
    placed = turns.join(parts, ["conv_id", "part"]).withColumn("k", F.col("start") + F.col("place"))
    return parts.select("conv_id").distinct(), placed.select("conv_id", "k", "role", "said", "words")


def with_shared_openings(turns: DataFrame, parts: DataFrame, *, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """As *in_order*, with every conversation c rebuilt: the first h turns of conversation c - c % every, then its own after h.

    h is the checksum of the decimal id modulo *most*, so only a few turns of a few conversations are copied, each to
    fewer than 2 * every others.
    """
    parts = cut_lineage(parts)
    own = parts.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = cut_lineage(own.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("opening")))
    starts = parts.select("conv_id", "part", "start").join(convs, "conv_id")
    placed = turns.join(starts, ["conv_id", "part"]).withColumn("k", F.col("start") + F.col("place"))
    cols = ["role", "said", "words"]
    rest = placed.where("k > h").select("conv_id", (F.col("opening") + F.col("k") - F.col("h")).alias("k"), *cols)
    first = parts.where((F.col("conv_id") % every == 0) & (F.col("start") < most)).select("conv_id", "part", "start")
    openings = turns.where(F.col("conv_id") % every == 0).join(first, ["conv_id", "part"]).select(
        F.col("conv_id").alias("base"), (F.col("start") + F.col("place")).alias("k"), *cols).where(F.col("k") < most)
    opened = openings.join(convs, "base").where("k <= h").select("conv_id", "k", *cols)
    return convs.select("conv_id"), rest.unionByName(opened)


def paths(turns: DataFrame) -> DataFrame:
    """Per conversation and block of depths: conv_id, block, path (x1, x2, w): the beginning before the block, then one more turn each."""
    h1, h2 = F.xxhash64("k", "role", "said"), F.xxhash64("said", F.lit(1), "role", "k")
    rows = turns.select("conv_id", F.expr(f"(k - 1) div {SEGMENT}").alias("block"), "k", h1.alias("h1"), h2.alias("h2"), "words")
    run = Window.partitionBy("conv_id", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rolled = rows.select("conv_id", "block", "k", F.bit_xor("h1").over(run).alias("x1"), F.bit_xor("h2").over(run).alias("x2"), "words")
    blocks = cut_lineage(rolled.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("k", "x1", "x2", F.col("words").alias("w")))).alias("turns")))
    last = F.element_at("turns", -1)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(last[x]).over(before), F.lit(0)).alias(c) for x, c in (("x1", "c1"), ("x2", "c2"))])
    path = F.concat(F.array(F.struct(F.col("c1").alias("x1"), F.col("c2").alias("x2"), F.lit(0).cast("long").alias("w"))), F.transform(
        "turns", lambda t: F.struct(t["x1"].bitwiseXOR(F.col("c1")).alias("x1"), t["x2"].bitwiseXOR(F.col("c2")).alias("x2"), t["w"].alias("w"))))
    return cut_lineage(blocks.join(carry, ["conv_id", "block"]).select("conv_id", "block", path.alias("path")))


# --- conversations that end alike ------------------------------------------------------------------------------------

def id_checksums(members: DataFrame) -> DataFrame:
    """(n, x1, x2, ends): SHA-256 of each class's ids, ascending, joined by commas; members: n, x1, x2, conv_id.

    Ids are put in order by range, so the ids of a large class lie in many tasks; each joins its stretch, and the
    checksum runs over the stretches.
    """
    key = ["n", "x1", "x2"]

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x1, x2, conv = (batch.column(c).to_numpy() for c in range(4))
            cuts = [0, *(np.flatnonzero((np.diff(n) != 0) | (np.diff(x1) != 0) | (np.diff(x2) != 0)) + 1).tolist(), len(n)] if len(n) else [0]
            ids = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, cuts[1:])]
            at = cuts[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (n, x1, x2, conv)] + [pa.array(ids, pa.string())], [*key, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for n, x1, x2, ids in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if (n, x1, x2) != now:
                    if now:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (n, x1, x2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _rows(done)
        if now:
            yield _rows([(*now, sha.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())], [*key, "ends"])

    ranged = members.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    pieces = ranged.mapInArrow(stretch, "n long, x1 long, x2 long, first long, ids string")
    gathered = pieces.repartition(*key).sortWithinPartitions(*key, "first").select(*key, "ids")
    return gathered.mapInArrow(digest, "n long, x1 long, x2 long, ends string")


def classes(convs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(n, x1, x2, conv, m, ends): conversations of equal turns; conv is the smallest id."""
    last = F.element_at("path", -1)
    ends = blocks.select("conv_id", "block", (F.col("block") * SEGMENT + F.size("path") - 1).alias("n"), last["x1"].alias("x1"), last["x2"].alias("x2"))
    ends = ends.groupBy("conv_id").agg(*[F.max_by(c, "block").alias(c) for c in ("n", "x1", "x2")])
    whole = cut_lineage(convs.join(ends, "conv_id", "left").na.fill(0, ["n", "x1", "x2"]))
    counted = whole.groupBy("n", "x1", "x2").agg(F.min("conv_id").alias("conv"), F.count("*").alias("m"))
    return cut_lineage(counted.join(id_checksums(whole), ["n", "x1", "x2"]))


# --- peeling ---------------------------------------------------------------------------------------------------------

def peel(table: pa.Table) -> pa.Table:
    """Nodes of whole cells. Rows are ends, one for each beginning: level (depth of the cell's beginning), conv, m, kids, leaves, saved, ends, path.

    A node whose parent is outside the cell has a null parent and the parent's beginning (p1, p2).
    """
    flat = pa.concat_arrays([c.flatten() for c in table["path"].chunks])  # of structs
    x1, x2, w = (flat.field(c).to_numpy() for c in ("x1", "x2", "w"))
    size = np.concatenate([c.value_lengths().to_numpy() for c in table["path"].chunks])
    begin, depth = np.cumsum(size) - size, size - 1
    level, conv, m, kids, leaves, saved = (table[c].to_numpy() for c in ("level", "conv", "m", "kids", "leaves", "saved"))
    ends = np.array(table["ends"].to_pylist(), object)
    by_depth = np.argsort(-depth, kind="stable")
    limits = np.searchsorted(-depth[by_depth], -np.arange(depth.max() + 1), "right")  # ends at a depth or deeper
    out: dict[str, list[np.ndarray]] = {c: [] for c in ("rel", "x1", "x2", "p1", "p2", "conv", "m", "kids", "leaves", "saved", "ends")}
    parents: list[np.ndarray] = []
    # Survivors: an end below them, which knows the path; the rest are the sums so far. row: where the node was written.
    rep, sums, conv_of, row, told = np.empty(0, int), np.empty((0, 4), np.int64), np.empty(0, np.int64), np.empty(0, int), 0
    for d in range(int(depth.max()), int(level.min()) - 1, -1):
        new = by_depth[limits[d + 1] if d + 1 < len(limits) else 0:limits[d]]
        if not len(new) and not len(rep):
            continue
        who = np.concatenate([rep, new])
        added = np.concatenate([np.column_stack([sums[:, 0], np.ones(len(rep), np.int64), sums[:, 2:]]), np.column_stack([m[new], kids[new], leaves[new], saved[new]])])
        smallest = np.concatenate([conv_of, conv[new]])
        a, b = x1[begin[who] + d], x2[begin[who] + d]
        order = np.lexsort((smallest, b, a))
        first = np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))
        at = np.flatnonzero(first)
        group = np.empty(len(who), int)
        group[order] = np.cumsum(first) - 1
        sums = np.add.reduceat(added[order], at)
        rep, conv_of = who[order[at]], smallest[order[at]]
        childless = sums[:, 1] == 0
        sums[childless, 2] = 1
        sums[:, 3] += (sums[:, 0] - 1) * w[begin[rep] + d]
        own = np.full(len(at), None, object)
        own[group[len(row):]] = ends[new]  # at most one end for each beginning
        parents.append(np.column_stack([row, conv_of[group[:len(row)]]]))
        for c, v in (("rel", np.full(len(at), d)), ("x1", x1[begin[rep] + d]), ("x2", x2[begin[rep] + d]), ("p1", x1[begin[rep] + d - 1]), ("p2", x2[begin[rep] + d - 1]),
                     ("conv", conv_of), ("m", sums[:, 0]), ("kids", sums[:, 1]), ("leaves", sums[:, 2]), ("saved", sums[:, 3]), ("ends", own)):
            out[c].append(v)
        row = told + np.arange(len(at))
        told += len(at)
        on = level[rep] < d
        rep, sums, conv_of, row = rep[on], sums[on], conv_of[on], row[on]
    columns = {c: np.concatenate(v) for c, v in out.items()}
    known = np.concatenate(parents)
    parent, missing = np.zeros(told, np.int64), np.ones(told, bool)
    parent[known[:, 0]], missing[known[:, 0]] = known[:, 1], False
    arrays = {c: pa.array(v.tolist(), pa.string()) if c == "ends" else pa.array(v, pa.int64()) for c, v in columns.items()}
    arrays["parent"] = pa.array(parent, pa.int64(), mask=missing)
    return pa.table({c.split()[0]: arrays[c.split()[0]] for c in NODE.split(", ")})


def _small(df: DataFrame) -> DataFrame:
    """Broadcast where the number of rows is small; the larger side's skew is Spark's to split otherwise."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _merged() -> list[Column]:
    return [F.min("conv").alias("conv"), F.sum("m").alias("m"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
            F.max("ends").alias("ends")]


def peel_block(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of a block of depths: those whose parent is known, and those of depth 1, whose parent lies before the block.

    items: ends in the block, one for each beginning: conv, m, kids, leaves, saved, ends, path up to the end.
    """
    live, level, cells, hot, hot_ends = cut_lineage(items), 1, [], [], []
    while True:
        keyed = live.withColumn("k1", F.col("path")[level]["x1"]).withColumn("k2", F.col("path")[level]["x2"]).withColumn("level", F.lit(level).cast("long"))
        above, here = F.col("path")[level - 1], F.col("path")[level]
        counts = keyed.groupBy("k1", "k2").agg(F.count("*").alias("c"), F.first(above["x1"]).alias("p1"), F.first(above["x2"]).alias("p2"), F.first(here["w"]).alias("w"))
        big = cut_lineage(counts.where(F.col("c") > CELL).drop("c"))
        if big.isEmpty():
            cells.append(keyed)
            break
        some = _small(big.select("k1", "k2"))
        cells.append(keyed.join(some, ["k1", "k2"], "left_anti"))
        crowded = keyed.join(some, ["k1", "k2"], "left_semi")
        hot.append(big)
        hot_ends.append(crowded.where(F.size("path") == level + 1))
        live = cut_lineage(crowded.where(F.size("path") > level + 1).select(*items.columns))
        level += 1
    ends = cells[0]
    for more in cells[1:]:
        ends = ends.unionByName(more)
    ends = cut_lineage(ends)
    buckets = max(1, -(-int(ends.agg(F.sum(F.size("path")).alias("s")).first().s or 0) // BUCKET))
    ends = ends.withColumn("bucket", F.pmod(F.xxhash64("level", "k1", "k2"), F.lit(buckets)))
    cols = ["bucket", "level", "conv", "m", "kids", "leaves", "saved", "ends", "path"]
    found = cut_lineage(ends.select(*cols).groupBy("bucket").applyInArrow(peel, NODE))
    # The crowded beginnings, deepest first.
    tops, done = found.where("parent IS NULL"), found.where("parent IS NOT NULL")
    below = None
    empty = F.lit(None).cast("long")
    for level in range(len(hot), 0, -1):
        children = tops.where(F.col("rel") == level + 1)
        children = children if below is None else children.unionByName(below)
        sums = ["conv", "m", "kids", "leaves", "saved", "ends"]
        rows = children.select(F.col("p1").alias("x1"), F.col("p2").alias("x2"), "conv", "m", F.lit(1).cast("long").alias("kids"), "leaves", "saved",
                               F.lit(None).cast("string").alias("ends"), empty.alias("p1"), empty.alias("p2"), empty.alias("w"))
        rows = rows.unionByName(hot_ends[level - 1].select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), *sums, empty.alias("p1"), empty.alias("p2"), empty.alias("w")))
        zero = F.lit(0).cast("long")
        rows = rows.unionByName(hot[level - 1].select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), empty.alias("conv"), zero.alias("m"), zero.alias("kids"), zero.alias("leaves"),
                                                      zero.alias("saved"), F.lit(None).cast("string").alias("ends"), "p1", "p2", "w"))
        nodes = rows.groupBy("x1", "x2").agg(*_merged(), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("w").alias("w"))
        nodes = nodes.withColumn("leaves", F.greatest("leaves", F.lit(1))).withColumn("saved", F.col("saved") + (F.col("m") - 1) * F.col("w"))
        nodes = cut_lineage(nodes.withColumn("rel", F.lit(level).cast("long")).withColumn("parent", empty).select(*found.columns))
        owners = _small(nodes.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv").alias("parent")))
        done = done.unionByName(children.drop("parent").join(owners, ["p1", "p2"]).select(*found.columns))
        below = nodes
    first = tops.where("rel = 1")
    return done, first if below is None else first.unionByName(below)


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    convs: conv_id, one row each; turns: conv_id, k (from 1), role, said (any hash of the text), words.
    """
    blocks = paths(turns)
    ended = classes(convs, blocks)
    zero = F.lit(0).cast("long")
    sums = ["conv", "m", "kids", "leaves", "saved", "ends"]
    starts = ended.withColumns({"kids": zero, "leaves": zero, "saved": zero})
    deepest = blocks.agg(F.max("block").alias("b")).first().b
    out: list[DataFrame] = []
    open_: DataFrame | None = None  # nodes of depth 1 of the block below
    for block in range(-1 if deepest is None else deepest, -1, -1):
        low = block * SEGMENT
        items = starts.where((F.col("n") > low) & (F.col("n") <= low + SEGMENT)).select((F.col("n") - low).alias("rel"), "x1", "x2", *sums)
        if open_ is not None:
            carried = open_.select(F.lit(SEGMENT).cast("long").alias("rel"), F.col("p1").alias("x1"), F.col("p2").alias("x2"), "conv", "m", F.lit(1).cast("long").alias("kids"),
                                   "leaves", "saved", F.lit(None).cast("string").alias("ends"))
            items = items.unionByName(carried)
            items = items.groupBy("rel", "x1", "x2").agg(*_merged())
        rows = items.join(blocks.where(F.col("block") == block).select(F.col("conv_id").alias("conv"), "path"), "conv")
        done, first = peel_block(rows.select(*sums, F.slice("path", 1, F.col("rel") + 1).alias("path")))
        if open_ is not None:
            owners = done.unionByName(first).where(F.col("rel") == SEGMENT).select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv").alias("parent"))
            out.append(_finished(open_.drop("parent").join(owners, ["p1", "p2"]), low + SEGMENT))
        out.append(_finished(done, low))
        open_ = first
    # The root: conversations without turns and the nodes of depth 1.
    tops = starts.where("n = 0").select(*sums)
    if open_ is not None:
        tops = tops.unionByName(open_.select("conv", "m", F.lit(1).cast("long").alias("kids"), "leaves", "saved", F.lit(None).cast("string").alias("ends")))
    root = cut_lineage(tops.agg(*_merged()).where("m > 0").withColumn("leaves", F.greatest("leaves", F.lit(1))))
    nodes = _finished(root.withColumns({"rel": zero, "parent": F.lit(None).cast("long")}), 0)
    if open_ is not None:
        out.append(_finished(open_.withColumn("parent", F.lit(root.first().conv)), 0))
    for more in out:
        nodes = nodes.unionByName(more)
    return nodes


def _finished(nodes: DataFrame, low: int) -> DataFrame:
    return nodes.select(F.col("conv").alias("conv_id"), (F.col("rel") + low).alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("m").alias("n_convs"),
                        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *, shared_openings: bool = False) -> DataFrame:
    """The trie of a table of turns; *shared_openings* rebuilds the conversations first, see ``with_shared_openings``."""
    turns, parts = numbered(conversations, conv_id, turn, role, text)
    return trie(*(with_shared_openings if shared_openings else in_order)(turns, parts))
