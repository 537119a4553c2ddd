"""N-gram Jaccard join by prefix trees, and the groups its links form.

A document's set holds its distinct five-word shingles as 64-bit hashes. Two documents link at a similarity of
three quarters or more. The join is exact on the hashes:

1. *Repeats.* Documents fall into blocks, the hash space into ranges. Blocks send their distinct hashes to the
   ranges, packed, and get back how common each is, one byte per hash. Rarity, then the hash, is the global
   order. A hash that no other row has cannot be shared, so a document with more than a quarter of such hashes
   links with nothing and leaves here. The rest keep their shared hashes, rare ones first.
2. *Classes.* Equal sets become one class, so copies are never expanded.
3. *Branches.* Two sets that link share one of their first ``n - ceil(0.75 n) + 1`` ordered hashes; these are the
   branches a set hangs under. A task stores the sets of a branch in a prefix tree and walks it with each
   set, carrying the overlap of the path for all sets below it and leaving subtrees whose remaining lengths cannot
   reach the overlap needed.
4. *Groups.* For reachability a walk skips what is known to be connected. Each set first
   goes to its most common branch; then one set for each group and branch; in the end every pair of sets
   under one branch that is still unconnected and within the length and position bounds is checked.
5. *Links.* Links stay inside a group, so the sets of each group are stored in trees of at most ``LINK_BLOCK`` sets
   and every set walks all of them. A task sums up each set's links, copies counted in; pairs are not emitted.

Large branches are cut into blocks of at most ``BLOCK`` sets. Defined results: documents without words have the
empty set and link with nothing; rows without an id link with nothing and have no component and no class; rows with the
same id are one document for groups, while each of its sets has its own links, also with another set of that id, and
counts as one link of others; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import Words, buffer_of, give_back, mix, row_chunks
from loreloom.session import TEXT_ROWS, Scratch, cut_lineage, in_few_parts

WIDTH = 5
BREAKS = b"\x20\x09\x0a\x0b\x0c\x0d"
NUMERATOR, DENOMINATOR = 75, 100
BLOCK_BYTES = 4 << 20  # text of a block of documents
RANGE_BYTES = 8 << 20  # text whose hashes meet in one range
LEAST_PIECE = 64  # hashes that a block sends to a range, at least on average
CHUNK = 1 << 20
BLOCK = 1_024  # sets of a branch that meet in one task
LINK_BLOCK = 512  # sets of a group that meet in one task when links are counted, twice as many from two blocks
BUCKET = 2_048  # sets that one call works on, over small branches
SCOUTS = 4  # rounds before every pair left is checked


# --- sets of shingles ------------------------------------------------------------------------------------------------

def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: Words, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingles of every row; a row with fewer words has its whole sequence as the one."""
    odd = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    sets: list[np.ndarray] = []
    for first, last in row_chunks(offsets, CHUNK):
        row, _, _, word = words.find(raw[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        bounds = np.searchsorted(row, np.arange(last - first + 1))
        full = max(len(word) - width + 1, 0)
        rolled = np.zeros(full, np.uint64)
        for k in range(width):
            rolled += word[k:k + full] * odd[k]
        rolled = mix(rolled + np.uint64(width))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                sets.append(np.unique(rolled[a:b - width + 1]))
            else:
                sets.append(mix((word[a:b] * odd[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)) if b > a else word[:0])
    return sets


def _sets(table: pa.Table) -> list[np.ndarray]:
    words = Words(BREAKS, CHUNK)
    sets = [s for chunk in table["text"].chunks for s in shingle_sets(*buffer_of(chunk), words)]
    give_back()
    return sets


def _bounds(ranges: int) -> np.ndarray:
    """First hash of every range but the first."""
    return np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)


def _needed(n, m):
    """Overlap that sets of these sizes need to link."""
    total = NUMERATOR * (n + m)
    return -(-total // (NUMERATOR + DENOMINATOR))


def shared_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, t (hash of the text), n (size of the set), k1 and k2 (hash of the set), links (false where it can link with nothing), tokens.

    tokens are the hashes that occur elsewhere, in the global order, as packed 64-bit words; only one of the rows of a
    block with the same id and set carries them.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("s")).first().s or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    ranges = max(1, min(-(-size // RANGE_BYTES), BLOCK_BYTES // 6 // LEAST_PIECE))
    blocked = rows.withColumn("t", F.xxhash64("text")).withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int"))

    def send(table: pa.Table) -> pa.Table:
        sets = _sets(table)
        hashes, times = np.unique(np.concatenate(sets), return_counts=True)
        cuts = np.searchsorted(hashes, _bounds(ranges))
        keys = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pa.table({
            "range": pa.array(np.arange(ranges), pa.int32()), "block": pa.array(np.full(ranges, table["block"][0].as_py()), pa.int32()),
            "keys": pa.array([k.tobytes() for k in np.split(keys, cuts)], pa.binary()),
            "times": pa.array([t.tobytes() for t in np.split(np.minimum(times, 255).astype(np.uint8), cuts)], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        keys = table["keys"].to_pylist()
        _, place = np.unique(np.frombuffer(b"".join(keys), np.uint32), return_inverse=True)
        total = np.bincount(place, np.frombuffer(b"".join(table["times"].to_pylist()), np.uint8))[place] if len(place) else np.empty(0)
        level = np.round(8 * np.log2(total)).astype(np.uint8)  # 0: no other row has it
        ends = np.cumsum([len(k) // 4 for k in keys])[:-1]
        return pa.table({"block": table["block"], "range": table["range"], "levels": pa.array([x.tobytes() for x in np.split(level, ends)], pa.binary())})

    def keep(table: pa.Table, answers: pa.Table) -> pa.Table:
        sets = _sets(table)
        hashes = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]))
        order = np.argsort(answers["range"].to_numpy())
        answered = answers["levels"].to_pylist()
        level = np.frombuffer(b"".join(answered[i] for i in order), np.uint8)
        n, k1, k2, links, tokens, seen = [], [], [], [], [], set()
        for doc, s in zip(table["doc_id"].to_pylist(), sets, strict=True):
            at = level[np.searchsorted(hashes, s)]
            known = at > 0
            links.append(len(s) > 0 and doc is not None and DENOMINATOR * int(known.sum()) >= NUMERATOR * len(s))
            n.append(len(s))
            k1.append(mix(s).sum(dtype=np.uint64)), k2.append(mix(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
            # The sets are sorted by hash, so a stable sort by level gives the global order.
            new = links[-1] and (doc, k1[-1], k2[-1]) not in seen
            seen.add((doc, k1[-1], k2[-1]))
            tokens.append(s[known][np.argsort(at[known], kind="stable")].tobytes() if new else None)
        return pa.table({"doc_id": table["doc_id"], "t": table["t"], "n": pa.array(n, pa.int64()), "k1": pa.array(np.array(k1, np.uint64).view(np.int64)),
                         "k2": pa.array(np.array(k2, np.uint64).view(np.int64)), "links": pa.array(links, pa.bool_()), "tokens": pa.array(tokens, pa.binary())})

    kind = docs.schema[doc_id].dataType.simpleString()
    pieces = blocked.groupBy("block").applyInArrow(send, "range int, block int, keys binary, times binary")
    answers = pieces.groupBy("range").applyInArrow(count, "block int, range int, levels binary")
    kept = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(keep, f"doc_id {kind}, t long, n long, k1 long, k2 long, links boolean, tokens binary")
    return in_few_parts(kept, blocks, 2)


# --- prefix tree -----------------------------------------------------------------------------------------------------

class PrefixTree:
    """Ordered sets stored so that equal beginnings are one path; a path without branches is one edge."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        """sets: sequences of token numbers in the global order; sizes: full sizes of the sets."""
        self.order = np.array(sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes()), int)
        ranked = [sets[i] for i in self.order]
        lengths = np.array([len(s) for s in ranked], int)
        common = [0] * (len(ranked) + 1)  # tokens that a set shares with the one before it
        for i in range(1, len(ranked)):
            m = min(lengths[i - 1], lengths[i])
            differ = np.flatnonzero(ranked[i - 1][:m] != ranked[i][:m])
            common[i] = int(differ[0]) if len(differ) else int(m)
        # Edges: (depth where it begins, depth where it ends, first set below, last set below + 1, parent edge).
        edges: list[list[int]] = []
        open_edges: list[int] = []  # the path to the set before
        for i in range(len(ranked) + 1):
            keep = common[i] if i < len(ranked) else 0
            while open_edges and edges[open_edges[-1]][0] >= keep and (i == len(ranked) or edges[open_edges[-1]][1] > keep):
                edges[open_edges.pop()][3] = i
            if open_edges and i < len(ranked) and edges[open_edges[-1]][1] > keep:  # the edge splits at depth keep
                old = open_edges.pop()
                lower = len(edges)
                edges.append([keep, edges[old][1], edges[old][2], i, old])
                for child in range(lower):
                    if edges[child][4] == old and child != old:
                        edges[child][4] = lower
                edges[old][1] = keep
                open_edges.append(old)
            if i < len(ranked):
                edges.append([keep, int(lengths[i]), i, i + 1, open_edges[-1] if open_edges else -1])
                open_edges.append(len(edges) - 1)
        table = np.array(edges, int).reshape(-1, 5)
        depth = np.zeros(len(table), int)
        by_start = np.argsort(table[:, 0], kind="stable")
        for e in by_start:
            depth[e] = depth[table[e, 4]] + 1 if table[e, 4] >= 0 else 0
        self.first, self.last = table[:, 2], table[:, 3]
        self.begin, self.end, self.parent = table[:, 0], table[:, 1], table[:, 4]
        self.levels = [np.flatnonzero(depth == d) for d in range(depth.max(initial=-1) + 1)]
        self.tokens = np.concatenate([ranked[f][b:e] for b, e, f in zip(self.begin, self.end, self.first, strict=True)]) if len(table) else np.empty(0, int)
        self.at = np.concatenate([[0], np.cumsum(self.end - self.begin)])
        size = sizes[self.order]
        self.sizes, self.lengths = size, lengths
        spans = np.stack([self.first, self.last], 1).ravel()
        pad = lambda x: np.append(x, x[-1:])
        self.smallest = np.minimum.reduceat(pad(size), spans)[::2] if len(table) else size
        self.largest = np.maximum.reduceat(pad(size), spans)[::2] if len(table) else size
        self.most_left = np.maximum.reduceat(pad(lengths), spans)[::2] - self.end if len(table) else size
        self.ends_here = lengths[self.first] == self.end  # the first set below an edge ends with it, or none does

    def walk(self, flags: np.ndarray, length: int, size: int, wanted: np.ndarray) -> np.ndarray:
        """Sets (as given) that link with a set, flags: which token numbers it holds; wanted: sets worth a look."""
        overlap = np.zeros(len(self.begin), int)
        open_ = np.zeros(len(self.begin), bool)
        ranked_wanted = np.append(0, np.cumsum(wanted[self.order]))
        found = []
        for edges in self.levels:
            up = self.parent[edges]
            use = (up < 0) | open_[up]
            use &= ranked_wanted[self.last[edges]] > ranked_wanted[self.first[edges]]
            use &= (DENOMINATOR * self.largest[edges] >= NUMERATOR * size) & (NUMERATOR * self.smallest[edges] <= DENOMINATOR * size)
            edges, up = edges[use], up[use]
            if not len(edges):
                break
            so_far = np.where(up < 0, 0, overlap[up])
            spans = self.end[edges] - self.begin[edges]
            starts = np.cumsum(spans) - spans
            index = np.arange(spans.sum()) + np.repeat(self.at[edges] - starts, spans)
            hits = np.append(flags[self.tokens[index]], False)
            gained = np.add.reduceat(hits, np.minimum(starts, len(hits) - 1), dtype=int) * (spans > 0)
            overlap[edges] = now = so_far + gained
            reach = now + np.minimum(length - now, self.most_left[edges])
            alive = reach >= _needed(size, self.smallest[edges])
            open_[edges] = alive
            ending = edges[alive & self.ends_here[edges]]
            for e in ending:
                # Equal sequences end on one edge, one after the other.
                stop = self.first[e]
                while stop < self.last[e] and self.lengths[stop] == self.end[e]:
                    if overlap[e] >= _needed(size, self.sizes[stop]):
                        found.append(stop)
                    stop += 1
        hits = self.order[np.unique(np.array(found, int))]  # equal sequences are found by each of their edges
        return hits[wanted[hits]]


def tree_links(sets: list[np.ndarray], sizes: np.ndarray, group: np.ndarray, probes: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the groups of the given sets, as few as connect them.

    group: what is known to be connected; probes: the sets to walk the tree with.
    """
    numbers, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sets = np.split(flat, np.cumsum([len(s) for s in sets])[:-1])
    tree, group, links = PrefixTree(sets, sizes), group.copy(), []
    flags = np.zeros(len(numbers), bool)
    for i in np.flatnonzero(probes):
        wanted = group != group[i]
        if not wanted.any():
            continue
        flags[sets[i]] = True
        for j in tree.walk(flags, len(sets[i]), int(sizes[i]), wanted):
            if group[j] != group[i]:
                links.append((int(i), int(j)))
                group[group == group[j]] = group[i]
        flags[sets[i]] = False
    return links


def tree_counts(sets: list[np.ndarray], sizes: np.ndarray, weight: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Weight of the sets that each of the given sets links with; of two blocks only links between them, each link once."""
    numbers, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sets = np.split(flat, np.cumsum([len(s) for s in sets])[:-1])
    stored = np.flatnonzero(block == block.min())
    probes = np.flatnonzero(block != block.min())
    one = not len(probes)
    tree = PrefixTree([sets[i] for i in stored], sizes[stored])
    flags, total = np.zeros(len(numbers), bool), np.zeros(len(sets), np.int64)
    wanted = np.ones(len(stored), bool)
    for i in stored if one else probes:
        if one:
            wanted[i] = False  # the sets before i have met it
        flags[sets[i]] = True
        hits = stored[tree.walk(flags, len(sets[i]), int(sizes[i]), wanted)]
        flags[sets[i]] = False
        total[i] += weight[hits].sum()
        total[hits] += weight[i]
    return total


# --- Spark side ------------------------------------------------------------------------------------------------------

def _linked(members: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """Links (a, b) found inside the groups of *members*: (g1, g2, node, part, probe); part is what is connected."""
    buckets = max(1, -(-count // BUCKET))

    def work(table: pa.Table) -> pa.Table:
        g1, g2, node, part, n = (table[c].to_numpy() for c in ("g1", "g2", "node", "part", "n"))
        probe, tokens = table["probe"].to_numpy(), table["tokens"]
        order = np.lexsort((node, g2, g1))
        cuts = np.flatnonzero((np.diff(g1[order]) != 0) | (np.diff(g2[order]) != 0)) + 1
        found = []
        for own in np.split(order, cuts):
            if len(own) > 1:
                sets = [np.frombuffer(tokens[int(i)].as_py(), np.uint64) for i in own]
                _, known = np.unique(part[own], return_inverse=True)
                found += [(node[own[i]], node[own[j]]) for i, j in tree_links(sets, n[own], known, probe[own])]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    spread = members.join(nodes.select("node", "n", "tokens"), "node").withColumn("bucket", F.pmod(F.xxhash64("g1", "g2"), F.lit(buckets)))
    return spread.select("bucket", "g1", "g2", "node", "part", "probe", "n", "tokens").groupBy("bucket").applyInArrow(work, "a long, b long")


def branches(nodes: DataFrame) -> DataFrame:
    """(token, node, n, pos): the first ordered hashes of every set, where another set can share them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(t, np.int64) for t in batch.column("tokens").to_pylist()]
            n = batch.column("n").to_numpy()
            length = np.array([len(s) for s in sets], int)
            alone = n - length  # hashes that no other row has stand first
            take = np.maximum(n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1 - alone, 0)
            row = np.repeat(np.arange(len(sets)), take)
            place = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take) + alone[row]
            token = np.concatenate([s[:t] for s, t in zip(sets, take, strict=True)]) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), batch.column("node").take(pa.array(row)), pa.array(n[row]), pa.array(place, pa.int64())],
                                             ["token", "node", "n", "pos"])

    return nodes.select("node", "n", "tokens").mapInArrow(cut, "token long, node long, n long, pos long")


def _with_part(entries: DataFrame, parts: DataFrame | None) -> DataFrame:
    entries = entries.drop("part")
    if parts is None:
        return entries.withColumn("part", F.col("node"))
    return entries.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))


def _scout(entries: DataFrame, nodes: DataFrame, round_: int, scratch: Scratch) -> DataFrame:
    """Links among sets that meet in their most common branch; after the first round one set for each part and branch."""
    if round_:
        entries = scratch.keep(entries.groupBy("token", "part").agg(F.min_by("node", F.xxhash64("node", F.lit(round_))).alias("node")))
    common = scratch.keep(entries.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"))
    chosen = entries.join(common, "token").groupBy("node", "part").agg(F.max(F.struct("c", "token")).alias("m"))
    members = scratch.keep(chosen.select("node", "part", F.col("m.token").alias("g1"), F.lit(True).alias("probe"),
                                         F.pmod(F.xxhash64("node"), F.ceil(F.col("m.c") / BLOCK)).alias("g2")))
    return scratch.keep(_linked(members, nodes, members.count()))


def _pairs(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of sets under one branch, not connected and within the length and position bounds.

    The entries of a branch's largest part stay in blocks of their own, and only the others come to them, so a large
    group under a branch with a few strangers costs the strangers times the group. The others meet in pairs of blocks.
    """
    sizes = scratch.keep(entries.groupBy("token", "part").agg(F.count("*").alias("c")))
    largest = sizes.groupBy("token").agg(F.max(F.struct("c", "part")).alias("m"), F.sum("c").alias("c")).select(
        "token", F.col("m.part").alias("most"), F.ceil(F.col("m.c") / BLOCK).cast("int").alias("blocks"), (F.col("c") - F.col("m.c")).alias("others"))
    sorted_ = entries.join(scratch.keep(largest), "token").withColumn("own", F.col("part") == F.col("most"))
    wide = F.ceil(F.col("others") / BLOCK).cast("int")
    at = lambda blocks: F.pmod(F.xxhash64("node"), blocks).cast("int")
    cols = ["token", "node", "part", "n", "pos", "own"]
    stay = sorted_.where("own AND others > 0").select(*cols, at(F.col("blocks")).alias("low"), F.lit(-1).alias("high"), F.lit(0).alias("home"))
    come = sorted_.where("NOT own").select(*cols, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("low"), F.lit(-1).alias("high"), F.lit(0).alias("home"))
    among = sorted_.where("NOT own").withColumn("home", at(wide)).withColumn("other", F.explode(F.sequence(F.lit(0), wide - 1)))
    among = among.select(*cols, F.least("home", "other").alias("low"), F.greatest("home", "other").alias("high"), "home")
    spread = stay.unionByName(come).unionByName(among)
    rows = int(sizes.agg(F.sum("c").alias("s")).first().s or 0)
    buckets = max(1, -(-rows // (4 * BUCKET)))

    def work(table: pa.Table) -> pa.Table:
        token, low, high, own, home, node, part, n, pos = (table[c].to_numpy(zero_copy_only=False) for c in ("token", "low", "high", "own", "home", "node", "part", "n", "pos"))
        order = np.lexsort((node, high, low, token))
        cuts = np.flatnonzero((np.diff(token[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)) + 1
        found = [np.empty((0, 2), np.int64)]
        for g in np.split(order, cuts):
            if high[g[0]] < 0:
                strangers, members = g[~own[g]], g[own[g]]
                a, b = np.repeat(strangers, len(members)), np.tile(members, len(strangers))
            else:
                a, b = np.triu_indices(len(g), 1)
                a, b = g[a], g[b]
                use = (part[a] != part[b]) & ((low[a] == high[a]) | (home[a] != home[b]))
                a, b = a[use], b[use]
            reach = np.minimum(n[a] - pos[a], n[b] - pos[b])
            use = (reach >= _needed(n[a], n[b])) & (DENOMINATOR * np.minimum(n[a], n[b]) >= NUMERATOR * np.maximum(n[a], n[b]))
            a, b = node[a[use]], node[b[use]]
            found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    spread = spread.withColumn("bucket", F.pmod(F.xxhash64("token", "low", "high"), F.lit(buckets)))
    return spread.groupBy("bucket").applyInArrow(work, "a long, b long").distinct()


def _checked(pairs: DataFrame, parts: DataFrame | None, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links among the pairs: a tree of the partners of each first set, walked with it."""
    pairs = scratch.keep(pairs, bounded=False)
    scratch.rows = max(scratch.rows or 0, 2 * pairs.count())
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = pairs.join(counts, "a").withColumn("g2", F.pmod(F.xxhash64("b"), F.col("blocks")))
    partners = placed.select(F.col("a").alias("g1"), "g2", F.col("b").alias("node"), F.lit(False).alias("probe"))
    firsts = placed.select(F.col("a").alias("g1"), "g2", F.col("a").alias("node"), F.lit(True).alias("probe")).distinct()
    members = scratch.keep(_with_part(partners.unionByName(firsts), parts))
    return scratch.keep(_linked(members, nodes, members.count()))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either a root or has one edge, to a root."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up + root > 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of every node of the edges (u, v): large-star and small-star steps until only stars are left."""
    scratch = scratch or Scratch(edges.sparkSession)
    stars = scratch.keep(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = scratch.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _connected(parts: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, part) after adding links between nodes."""
    if parts is None:
        return scratch.keep(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch).withColumnRenamed("root", "part"))
    ends = links
    for end, name in (("a", "u"), ("b", "v")):
        known = parts.select(F.col("node").alias(end), F.col("part").alias(name))
        ends = ends.join(known, end, "left").withColumn(name, F.coalesce(name, end))
    roots = scratch.keep(components(ends.select("u", "v"), scratch))
    moved = parts.join(roots.withColumnRenamed("node", "part"), "part", "left").select("node", F.coalesce("root", "part").alias("part"))
    new = roots.join(parts, "node", "left_anti").select("node", F.col("root").alias("part"))
    return scratch.keep(moved.unionByName(new))


def _unsettled(entries: DataFrame, parts: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Entries of branches that hold more than one part."""
    entries = _with_part(entries, parts)
    split = entries.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("token")
    return scratch.keep(entries.join(split, "token", "left_semi"))


def linked_parts(nodes: DataFrame, same: DataFrame) -> DataFrame | None:
    """(node, part) of the nodes that link with another; None where no node does.

    same: links (a, b) known beforehand. What a round wrote is deleted once the next one has its tables.
    """
    scratch = Scratch(nodes.sparkSession)
    parts = None if same.isEmpty() else _connected(None, same, scratch)
    most = nodes.agg(F.count("*").alias("nodes"), F.sum(F.col("n") - F.ceil(NUMERATOR * F.col("n") / DENOMINATOR) + 1).alias("branches")).first()
    scratch.rows = int(most.branches or 0)
    entries = _unsettled(branches(nodes), parts, scratch)
    scratch.rows = max(entries.count(), most.nodes)
    scratch.clear(parts, entries)
    for round_ in range(SCOUTS):
        links = _scout(entries, nodes, round_, scratch)
        if links.isEmpty():
            scratch.clear(parts, entries)
            if round_:
                break
            continue
        parts = _connected(parts, links, scratch)
        entries = _unsettled(entries, parts, scratch)
        scratch.clear(parts, entries)
        if entries.isEmpty():
            return parts
    links = _checked(_pairs(entries, scratch), parts, nodes, scratch)
    if not links.isEmpty():
        parts = _connected(parts, links, scratch)
    scratch.clear(parts)
    return parts


def link_counts(nodes: DataFrame, classes: DataFrame, parts: DataFrame | None) -> DataFrame:
    """(k1, k2, others): documents of other classes that a class links with; classes without such links may be missing."""
    slim = _with_part(classes, parts)
    cells = slim.groupBy("part").agg(F.count("*").alias("m")).where("m > 1").select("part", F.ceil(F.col("m") / LINK_BLOCK).cast("int").alias("blocks"))
    # A group of one block meets itself; blocks of a larger one meet in pairs.
    own = F.pmod(F.xxhash64("k1", "k2"), F.col("blocks")).cast("int")
    members = cut_lineage(slim.join(cells, "part").select("k1", "k2", "part", "weight", "blocks", own.alias("own")))
    buckets = max(1, -(-int(members.agg(F.sum("blocks").alias("s")).first().s or 0) // LINK_BLOCK))
    spread = (members.join(nodes.select("k1", "k2", "n", "tokens"), ["k1", "k2"])
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
              .withColumn("bucket", F.pmod(F.xxhash64("part", "low", "high"), F.lit(buckets))))

    def work(table: pa.Table) -> pa.Table:
        k1, k2, part, low, high, own, weight, n = (table[c].to_numpy() for c in ("k1", "k2", "part", "low", "high", "own", "weight", "n"))
        tokens = table["tokens"]
        order = np.lexsort((k2, k1, high, low, part))
        # Rows of one id with one set can carry its tokens twice.
        again = np.zeros(len(order), bool)
        again[1:] = np.all([np.diff(c[order]) == 0 for c in (part, low, high, k1, k2)], 0)
        order = order[~again]
        cuts = np.flatnonzero(np.any([np.diff(c[order]) != 0 for c in (part, low, high)], 0)) + 1
        total = np.zeros(len(k1), np.int64)
        for cell in np.split(order, cuts):
            if len(cell) > 1 and (low[cell[0]] == high[cell[0]] or len(np.unique(own[cell])) > 1):
                sets = [np.frombuffer(tokens[int(i)].as_py(), np.uint64) for i in cell]
                total[cell] = tree_counts(sets, n[cell], weight[cell], own[cell])
        some = order[total[order] > 0]
        return pa.table({"k1": k1[some], "k2": k2[some], "others": total[some]})

    cols = ["bucket", "part", "low", "high", "own", "k1", "k2", "weight", "n", "tokens"]
    counted = spread.select(*cols).groupBy("bucket").applyInArrow(work, "k1 long, k2 long, others long")
    return counted.groupBy("k1", "k2").agg(F.sum("others").alias("others"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links, its own included), class_id (smallest id
    with an equal set, its own included) and n_links (documents with a linking set, copies counted in)."""
    rows, some, classes, nodes, parts = _grouped(docs, doc_id, text)
    of = _with_part(classes, parts).join(link_counts(nodes, classes, parts), ["k1", "k2"], "left")
    of = cut_lineage(of.select("k1", "k2", "part", "node", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    grouped = some.join(of, ["k1", "k2"]).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("part").alias("component_id"), F.col("node").alias("class_id"), "n_links")
    alone = rows.where("NOT links").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    # A row that links with nothing belongs to the group of the other rows of its id.
    owned = some.join(of, ["k1", "k2"]).groupBy("doc_id").agg(F.min("part").alias("component_id"))
    named = alone.where("doc_id IS NOT NULL").join(owned, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    nameless = alone.where("doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    return grouped.unionByName(named).unionByName(nameless)


def _grouped(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Rows, those that may link, classes (k1, k2, node, weight: its documents), nodes with tokens, and parts."""
    count = docs.count()
    rows = cut_lineage(shared_sets(docs.withColumn(doc_id, F.col(doc_id).cast("long")), doc_id, text))
    some = rows.where("links").drop("tokens")
    classes = cut_lineage(in_few_parts(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count_distinct("doc_id").alias("weight")), count))
    firsts = classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "node")
    # The id is a key of this join, so a class that a third of all rows share does not meet in one task.
    same = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("doc_id") == F.col("node"))
    nodes = cut_lineage(in_few_parts(rows.where(F.col("tokens").isNotNull()).join(firsts, same).select("k1", "k2", "node", "n", "tokens"), count, TEXT_ROWS))
    # Classes that share an id are one document, hence connected.
    own = cut_lineage(in_few_parts(some.join(firsts, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))).select("doc_id", "node").distinct(), count))
    several = own.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b != last")
    same = cut_lineage(in_few_parts(own.join(several, "doc_id").where("node != b").select(F.col("node").alias("a"), "b").distinct(), count))
    return rows, some, classes, nodes, linked_parts(nodes, same)


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """*docs* with one document of each group, that of the smallest id; all columns as they were.

    Rows go by id and text: another text under the id of a near copy stays, if it links with nothing.
    """
    _, some, classes, _, parts = _grouped(docs, doc_id, text)
    count = docs.count()
    groups = some.join(cut_lineage(in_few_parts(_with_part(classes, parts), count)), ["k1", "k2"])
    go = cut_lineage(in_few_parts(groups.where("doc_id != part").select(F.col("doc_id").alias("__gone"), F.col("t").alias("__text")).distinct(), count))
    same = (docs[doc_id].cast("long") == go["__gone"]) & (F.xxhash64(docs[text]) == go["__text"])
    return in_few_parts(docs.join(go, same, "left_anti").select(*docs.columns), count, TEXT_ROWS)
