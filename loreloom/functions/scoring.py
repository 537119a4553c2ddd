"""Scores of one block of points against one block of queries, and the running top-k of a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

# Largest score matrix a task holds at a time.
MAX_CELLS = 4_000_000
# Sparse scores are sums; rounded, equal texts tie whatever the order of their terms.
SPARSE_DIGITS = 9
# The last digits of a matrix product depend on its blocking; rounded, equal vectors tie.
DENSE_DIGITS = 15
NONE = -np.inf
PAIRS = 65_536  # pairs scored exactly at a time
OUT = 100_000  # rows of a result batch


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(length of every list, concatenated values); a NULL list has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), column.flatten()


def _units(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of unit length (zero vectors stay), and which rows have no finite length."""
    values = _flat(column)[1].to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    norms = np.linalg.norm(values, axis=1, keepdims=True)
    return np.divide(values, norms, out=np.zeros_like(values), where=norms > 0), ~np.isfinite(norms[:, 0])


def _coded(column: pa.Array) -> tuple[np.ndarray, list]:
    """Number of each row's value among the distinct ones, NULL as a value, and these."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    coded = column.dictionary_encode("encode")
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


class TermIndex:
    """Postings of a block of queries: which queries hold a word, and with what weight."""

    def __init__(self, terms, weights=None):
        lengths, values = _flat(terms)
        self.n = len(lengths)
        w = np.ones(len(values)) if weights is None else _flat(weights)[1].to_numpy(zero_copy_only=False).astype(float)
        owner = np.repeat(np.arange(self.n), lengths)
        codes, vocabulary = pd.factorize(values.to_pandas())
        order = np.argsort(codes, kind="stable")
        start = np.zeros(len(vocabulary) + 1, dtype=np.int64)
        np.cumsum(np.bincount(codes, minlength=len(vocabulary)), out=start[1:])
        self.words, self.start, self.owner, self.weight = pd.Index(vocabulary), start, owner[order], w[order]

    def accumulate(self, lengths, codes, values):
        """Sum of value x weight over shared terms, and whether any term is shared."""
        start, owner, weight = self.start, self.owner, self.weight
        rows = np.repeat(np.arange(len(lengths)), lengths)
        values = np.ones(len(codes)) if values is None else values
        known = codes >= 0
        rows, codes, values = rows[known], codes[known], values[known]
        fan = start[codes + 1] - start[codes]
        total = int(fan.sum())
        shape = (len(lengths), self.n)
        if total == 0:
            return np.zeros(shape), np.zeros(shape, dtype=bool)
        shift = np.repeat(np.cumsum(fan) - fan, fan)
        at = np.repeat(start[codes], fan) + np.arange(total) - shift
        cell = np.repeat(rows, fan) * self.n + owner[at]
        cells = shape[0] * shape[1]
        sums = np.bincount(cell, weights=np.repeat(values, fan) * weight[at], minlength=cells)
        return sums.reshape(shape), (np.bincount(cell, minlength=cells) > 0).reshape(shape)

    def counts(self, column):
        """Per point: distinct known terms and how often each occurs."""
        lengths, values = _flat(column)
        codes = self.words.get_indexer(values.to_pandas()).astype(np.int64)
        rows = np.repeat(np.arange(len(lengths)), lengths)[codes >= 0]
        key, count = np.unique(rows * max(len(self.words), 1) + codes[codes >= 0], return_counts=True)
        rows, codes = np.divmod(key, max(len(self.words), 1))
        return np.bincount(rows, minlength=len(lengths)), codes, count.astype(np.float64)


class MatchBlock:
    """Queries as sets of words that must all occur."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.qids = table.column("qid").to_pandas().to_numpy()
        self.index = TermIndex(table.column("match"))
        self.wanted = _flat(table.column("match"))[0].astype(np.float64)

    def holds(self, column) -> np.ndarray:
        found, _ = self.index.accumulate(*self.index.counts(column)[:2], None)
        return (found == self.wanted) & (self.wanted > 0)

    def pairs(self, batch: pa.Table):
        """(query ids, point ids) of all matches, a slice of points at a time."""
        step = max(1, MAX_CELLS // max(len(self.qids), 1))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            rows, queries = np.nonzero(self.holds(part.column("tokens")))
            if len(rows):
                yield self.qids[queries], part.column("id").to_pandas().to_numpy()[rows]


class RarestBlock:
    """Questions as sets of words that must all occur, found by their rarest word.

    Rows: ``match`` (distinct words), ``rarest`` (one of them), ``qids`` (the queries that ask for them).
    """

    def __init__(self, table: pa.Table):
        lengths, words = _flat(table.column("match"))
        codes, vocabulary = pd.factorize(words.to_pandas())
        self.words = pd.Index(vocabulary)
        anchor = self.words.get_indexer(table.column("rarest").to_pandas())
        order = np.argsort(anchor, kind="stable")
        self.start = np.searchsorted(anchor[order], np.arange(len(vocabulary) + 1))
        self.first, self.n_words = (np.cumsum(lengths) - lengths)[order], lengths[order]
        self.codes, self.most = codes, int(lengths.max(initial=0))
        sizes, self.qids = _flat(table.column("qids"))
        self.first_query, self.n_queries = (np.cumsum(sizes) - sizes)[order].astype(np.int64), sizes[order].astype(np.int64)

    def pairs(self, batch: pa.Table):
        """(query ids, point ids) of all matches, a bounded number at a time."""
        step = max(1, 2 * MAX_CELLS // max(len(self.words), len(self.n_words), 1))
        ids = batch.column("id").combine_chunks()
        for at in range(0, batch.num_rows, step):
            lengths, words = _flat(batch.column("tokens").slice(at, step))
            codes = self.words.get_indexer(words.to_pandas()).astype(np.int64)
            rows = np.repeat(np.arange(len(lengths)), lengths)[codes >= 0]
            codes = codes[codes >= 0]
            holds = np.zeros((len(lengths), len(self.words)), bool)
            holds[rows, codes] = True
            fan = self.start[codes + 1] - self.start[codes]
            point = np.repeat(rows, fan)
            question = np.repeat(self.start[codes] - np.cumsum(fan) + fan, fan) + np.arange(len(point))
            for i in range(self.most):
                more = self.n_words[question] > i
                good = ~more
                good[more] = holds[point[more], self.codes[self.first[question[more]] + i]]
                point, question = point[good], question[good]
            ends = np.cumsum(self.n_queries[question])
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(OUT, ends[-1], OUT)) + 1, len(ends))) if len(ends) else []
            for a, b in zip([0, *cuts], cuts):
                n = self.n_queries[question[a:b]]
                query = np.repeat(self.first_query[question[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                yield self.qids.take(pa.array(query)), ids.take(pa.array(at + np.repeat(point[a:b], n)))


class QueryBlock:
    """Queries prepared for scoring: unit vectors, postings by term, match postings, allowed values.

    A whole block is scored roughly, cosines by a product of 4-byte floats; what may count is then scored exactly.
    ``margin`` bounds how far a rough score lies from the exact one.
    """

    def __init__(self, table: pa.Table, *, arm: str, match: bool, filters: tuple[str, ...]):
        table = table.combine_chunks()
        self.qids = table.column("qid").to_pandas()
        self.n = len(self.qids)
        self.arm, self.filters = arm, filters
        self.margin = 0.0
        if arm == "dense":
            self.vectors, self.odd = _units(table.column("vector"), self.n)
            self.rough_vectors = self.vectors.T.astype(np.float32)
            # Twice the bound of a sum of that many rounded products, so that a rounded bar is below it as well.
            self.margin = (self.vectors.shape[1] + 4) * 2.0 ** -23
        else:
            self.terms = TermIndex(table.column("terms"), table.column("weights"))
        self.match = MatchBlock(table) if match else None
        self.allowed = {f: self._allowed(table.column(f"allow_{f}")) for f in filters}
        self.floor: dict = {}

    def _allowed(self, column):
        lists = column.to_pylist()
        free = np.array([v is None for v in lists])
        values = sorted({x for v in lists if v is not None for x in v})
        return {x: free | np.array([v is not None and x in v for v in lists]) for x in values}, free

    # --- scores ---------------------------------------------------------------------------------

    def score(self, batch: pa.Table):
        """Rough scores, ``NONE`` where a pair does not count, and a function (rows, queries) -> exact scores."""
        if self.arm == "dense":
            d, odd = _units(batch.column("vector"), batch.num_rows)
            s = d.astype(np.float32) @ self.rough_vectors
            s[odd], s[:, self.odd] = NONE, NONE

            def exact(rows, queries):
                # A pair's sum is the same in any block; rounded, equal vectors tie.
                parts = [np.einsum("ij,ij->i", d[rows[at:at + PAIRS]], self.vectors[queries[at:at + PAIRS]]) for at in range(0, len(rows), PAIRS)]
                return np.round(np.concatenate(parts), DENSE_DIGITS) if parts else np.zeros(0)
        else:
            if "weights" in batch.column_names:
                lengths, terms = _flat(batch.column("terms"))
                codes = self.terms.words.get_indexer(terms.to_pandas()).astype(np.int64)
                values = _flat(batch.column("weights"))[1].to_numpy(zero_copy_only=False).astype(float)
            else:
                lengths, codes, count = self.terms.counts(batch.column("tokens"))
                values = 1.0 + np.log(count)
            s, shared = self.terms.accumulate(lengths, codes, values)
            s = np.where(shared, np.round(s, SPARSE_DIGITS), NONE)

            def exact(rows, queries):
                return s[rows, queries]
        if self.match is not None:
            s[~self.match.holds(batch.column("tokens"))] = NONE
        for f in self.filters:
            table, free = self.allowed[f]
            codes, values = _coded(batch.column(f))
            np.copyto(s, NONE, where=np.stack([~table.get(v, free) for v in values])[codes])
        return s, exact


class TopK:
    """Best *k* points per (query, group), ties by id.

    A query's bar, on the scale of rough scores, is one that its k-th best point reaches; pairs below it are left out.
    """

    def __init__(self, block: QueryBlock, k: int, *, grouped: bool, skip_self: bool, min_score: float | None):
        self.block, self.k, self.grouped = block, k, grouped
        self.skip_self, self.min_score = skip_self, min_score
        self.self_index = pd.Index(block.qids) if skip_self else None
        self.kind = np.float32 if block.arm == "dense" else np.float64
        # No pair at all has less, and a pair that does not count lies below.
        self.least = np.finfo(self.kind).min if min_score is None else min_score - block.margin
        self.groups: dict = {}
        self.bars: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = self.kept = 0

    def add(self, batch: pa.Table) -> None:
        step = max(1, MAX_CELLS // max(self.block.n, 1))
        for start in range(0, batch.num_rows, step):
            self._add(batch.slice(start, step))

    def _add(self, batch: pa.Table) -> None:
        s, exact = self.block.score(batch)
        ids = batch.column("id").to_pandas()
        if self.skip_self:
            at = self.self_index.get_indexer(ids)
            rows = np.nonzero(at >= 0)[0]
            s[rows, at[rows]] = NONE
        ids = ids.to_numpy()
        if not self.grouped:
            self._keep(None, s, np.arange(len(s)), ids, exact)
            return
        codes, values = _coded(batch.column("group"))
        for code, group in enumerate(values):
            rows = np.flatnonzero(codes == code)
            self._keep(group, s[rows] if len(values) > 1 else s, rows, ids, exact)

    def _group(self, group) -> int:
        code = self.groups.setdefault(group, len(self.groups))
        if code == len(self.bars):
            bar = np.full(self.block.n, self.least, self.kind)
            given = self.block.floor.get(group)
            self.bars.append(bar if given is None else np.maximum(bar, given - self.block.margin).astype(self.kind))
        return code

    def _keep(self, group, s: np.ndarray, rows: np.ndarray, ids: np.ndarray, exact) -> None:
        code = self._group(group)
        passes = s >= self.bars[code]
        if len(s) > self.k and np.count_nonzero(passes) > self.block.n * self.k:
            kth = np.partition(s, len(s) - self.k, axis=0)[len(s) - self.k]
            self.bars[code] = np.maximum(self.bars[code], kth - self.kind(2 * self.block.margin))
            passes = s >= self.bars[code]
        r, q = np.divmod(np.flatnonzero(passes), self.block.n)
        score = exact(rows[r], q)
        if self.min_score is not None:
            good = score >= self.min_score
            r, q, score = r[good], q[good], score[good]
        if len(r):
            self.parts.append((q.astype(np.int32), np.full(len(q), code, np.int32), ids[rows[r]], score))
            self.held += len(r)
            if self.held > 2 * self.kept + 2 * self.block.n * self.k + 200_000:
                self._compact()

    def _compact(self) -> tuple[np.ndarray, ...]:
        """The best *k* of what is held, in order; raises the bars of queries that have k."""
        q, g, ids, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        key = q.astype(np.int64) * len(self.bars) + g
        order = np.lexsort((pd.factorize(ids, sort=True)[0] if ids.dtype == object else ids, -score, key))
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
        order, rank = order[rank < self.k], rank[rank < self.k]
        q, g, ids, score = q[order], g[order], ids[order], score[order]
        last = rank == self.k - 1
        for code, bar in enumerate(self.bars):
            full = last & (g == code)
            bar[q[full]] = np.maximum(bar[q[full]], score[full] - self.block.margin)
        self.parts, self.held, self.kept = [(q, g, ids, score)], len(q), len(q)
        return q, g, ids, score, rank

    def result(self, schema: pa.Schema, arm: str) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        q, g, ids, score, rank = self._compact()
        names, qids = pa.array(list(self.groups)) if self.grouped else None, self.block.qids.to_numpy()
        for at in range(0, len(q), OUT):
            part = slice(at, at + OUT)
            arrays = {"qid": qids[q[part]], "arm": [arm] * len(q[part]), "id": ids[part], "score": score[part], "rank": rank[part] + 1}
            if self.grouped:
                arrays["group"] = names.take(pa.array(g[part]))
            yield pa.RecordBatch.from_arrays(
                [a.cast(f.type) if isinstance(a := arrays[f.name], pa.Array) else pa.array(a, type=f.type) for f in schema], schema=schema)
