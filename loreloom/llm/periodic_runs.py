"""Periodic runs of words by a suffix automaton with link-cut access.

Words are appended one by one. The states of the automaton form a tree by their suffix links; the states on the way from
the text so far up to the root are its endings. Each state has the place where its words last ended, and states of one
way with the same place are one segment. The segments are the preferred paths of a link-cut tree: an access walks the
segments of the new ending and recolours them all to the new place. A segment last seen at distance d, whose longest
words have length L >= d, is a square: the last L + d words have period d, and no smaller one, since the segment would
then have been seen later. They begin where the run begins, so the run is the pair (begin, d), and its end is the last
place that meets it.

Only stretches in which every word occurs often enough reach the automaton: a run of at least ``EXPONENT`` periods holds
each of its words that often, so a text is cut at rarer words, again and again inside the stretches, until nothing
changes. A text without such words costs one count.

A text is one row and worked on by itself, in memory proportional to it; a text of n words costs about n log n steps
whatever it repeats. Defined results: a null, empty or blank text has no words, no run and collapses to the empty text;
ids are carried as they are, repeated or null; columns other than the two named are not read; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import text_chunks

LEAST = 6  # words of the shortest run
EXPONENT = 4  # periods of the shortest run
CHUNK = 1 << 20
BREAKS = r"[\x20\x09-\x0D]+"


def stretches(words: list, least: int = LEAST, exponent: int = EXPONENT) -> Iterator[tuple[int, int]]:
    """Stretches (first, end) in which every word occurs at least *exponent* times."""
    waiting = [(0, len(words))]
    while waiting:
        first, end = waiting.pop()
        if end - first < max(least, exponent):
            continue
        times = Counter(words[first:end])
        if min(times.values()) >= exponent:
            yield first, end
        elif max(times.values()) >= exponent:
            often = {w for w, n in times.items() if n >= exponent}
            begin = None
            for i in range(first, end):
                if words[i] in often:
                    if begin is None:
                        begin = i
                elif begin is not None:
                    waiting.append((begin, i))
                    begin = None
            if begin is not None:
                waiting.append((begin, end))


class Endings:
    """Suffix automaton of the words appended, its suffix links kept as a link-cut tree of last places.

    State 0 is none, state 1 the root. ``up`` is the parent inside a preferred path's splay tree, or, at its root, the
    suffix link of the path's topmost state; ``seen`` belongs to the path and is kept at the root of its splay tree.
    """

    def __init__(self):
        self.length, self.link, self.step = [0, 0], [0, 0], [{}, {}]
        self.up, self.left, self.right, self.seen = [0, 0], [0, 0], [0, 0], [0, 0]
        self.whole, self.place = 1, 0

    def _new(self, length: int, link: int, step: dict) -> int:
        self.length.append(length), self.link.append(link), self.step.append(step)
        self.up.append(link), self.left.append(0), self.right.append(0), self.seen.append(0)
        return len(self.length) - 1

    def splay(self, x: int) -> None:
        """Make x the root of its splay tree; the order inside the tree stays."""
        up, left, right = self.up, self.left, self.right
        p = up[x]
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner and (left[g] == p) == (left[p] == x):
                self._lift(p, g)
                self._lift(x, p)
            else:
                self._lift(x, p)
                if inner:
                    self._lift(x, g)
            p = up[x]

    def _lift(self, x: int, p: int) -> None:
        up, left, right = self.up, self.left, self.right
        g = up[p]
        if left[p] == x:
            c = left[p] = right[x]
            right[x] = p
        else:
            c = right[p] = left[x]
            left[x] = p
        if c:
            up[c] = p
        up[p], up[x] = x, g
        if g and left[g] == p:
            left[g] = x
        elif g and right[g] == p:
            right[g] = x
        else:
            self.seen[x] = self.seen[p]  # x is the root now

    def append(self, word) -> list[tuple[int, int]]:
        """Append a word; (begin, period) of every run that ends here so far."""
        length, link, step = self.length, self.link, self.step
        self.place += 1
        last, new = self.whole, self._new(self.place, 0, {})
        p = last
        while p and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if not p:
            above = 1
        else:
            above = step[p][word]
            if length[above] != length[p] + 1:
                above = self._copy(above, length[p] + 1)
                old = step[p][word]
                while p and step[p].get(word) == old:
                    step[p][word] = above
                    p = link[p]
        link[new] = self.up[new] = above
        self.whole = new
        return self._access(new)

    def _copy(self, state: int, length: int) -> int:
        """A copy of a state for its shorter words, put above it on its own path."""
        copy = self._new(length, self.link[state], dict(self.step[state]))
        self.splay(state)
        above = self.left[state]
        self.left[state] = copy
        self.left[copy] = above
        self.up[copy] = state
        if above:
            self.up[above] = copy
        self.link[state] = copy
        return copy

    def _access(self, new: int) -> list[tuple[int, int]]:
        up, right, seen, length = self.up, self.right, self.seen, self.length
        found, below, x = [], new, up[new]
        while x:
            self.splay(x)
            last = seen[x]
            if last and self.place - last <= length[x]:
                found.append((last - length[x], self.place - last))
            if cut := right[x]:
                seen[cut] = last
            right[x] = below
            below, x = x, up[x]
        seen[below] = self.place
        self.splay(new)
        return found


def runs(words: list, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least *least* words and *exponent* periods, by start and period."""
    out = []
    for first, end in stretches(words, least, exponent):
        endings, ends = Endings(), {}
        for i in range(first, end):
            for run in endings.append(words[i]):
                ends[run] = i + 1
        out += [(first + begin, stop - first - begin, period) for (begin, period), stop in ends.items()
                if stop - first - begin >= max(least, exponent * period)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """Words but those that a run repeats: all of it after its first period."""
    keep, at = [], 0
    for first, end in sorted((a + p, a + n) for a, n, p in found):
        if end > at:
            keep += words[at:first] if first > at else []
            at = end
    return keep + words[at:]


def run_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period), strongest (the run of most periods) and collapsed, the text without repetitions."""
    kinds = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, every, best, kept = [], [], [], []
            for part in text_chunks(batch.column(1), CHUNK):
                for t in part:
                    words = t.encode().split()  # of bytes, so at ASCII white space only
                    found = runs(words, least, exponent)
                    n.append(len(words))
                    every.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    best.append(dict(zip(("start", "length", "period"), strongest(found))) if found else None)
                    kept.append(b" ".join(collapsed(words, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(every, pa.list_(kinds)), pa.array(best, kinds), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "strongest", "collapsed"])

    kind = docs.schema[doc_id].dataType.simpleString()
    run = "struct<start:long,length:long,period:long>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        find, f"doc_id {kind}, n_words long, runs array<{run}>, strongest {run}, collapsed string")


def digests(table: DataFrame) -> DataFrame:
    """Per row of a run table: doc_id, n_runs, the strongest run, and hashes of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    runs_text = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    best = [F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")]
    exact = F.expr("strongest.length * 1000 div strongest.period")
    return table.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, exact.alias("exponent_milli"),
                        F.sha2(runs_text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def with_planted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): a tenth of the texts, chosen by the checksum of the id, repeats its words from one place on.

    With h the checksum and g = h // 10, word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) // (3 + g % 8). Texts without words and rows without an id stay as they are.
    """
    words: Column = F.filter(F.split(F.col("text"), BREAKS), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = F.expr("array_join(transform(sequence(0, n - 1), i -> words[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("h", h)
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))
