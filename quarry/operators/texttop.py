"""The best documents of many searches at once (F1, F16).

All (query, document) scores are queries times documents; only ``limit`` of a query's are wanted.  Documents are split once
into groups, and every task passes its group against a broadcast of the queries, in chunks.  In a chunk a term has a row of
its documents' shares in the score, rounded up to 16 bits; the sum of a query's rows bounds the scores of all documents,
and only those whose bound reaches the best so far are scored exactly.  So nothing is cut: what is left out can't be among the best.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Documents of a chunk, postings read before they are cut into chunks, and bytes of a chunk's rows; rarer terms beyond these add up posting by posting.
CHUNK_DOCS, READ_POSTINGS, ROW_BYTES = 16_384, 1_000_000, 96 << 20
#: Queries of more terms are scored on all their documents exactly.
MOST_BOUNDED = 128
#: (query, document) pairs that are scored exactly at once.
PAIRS = 100_000
_TOP = 60_000


class Queries:
    """Queries as lists of term numbers, query i's being ``terms[starts[i]:starts[i + 1]]``, a term as often as it is asked for.

    Terms are numbered from the most asked for and sorted so in each query, and queries are in order of these lists: those that begin
    alike follow each other and share the sum of what they have in common.
    """

    def __init__(self, ids: pa.Array, codes: pa.ListArray):
        lengths = np.asarray(codes.value_lengths(), dtype=np.int64)
        self.codes, at, asked = np.unique(np.asarray(codes.flatten()), return_inverse=True, return_counts=True)
        self.number = np.empty(len(asked), np.int64)
        self.number[np.argsort(-asked, kind="stable")] = np.arange(len(asked))
        ends = np.cumsum(lengths).tolist()
        lists = [sorted(x) for x in map(self.number[at].tolist().__getitem__, map(slice, [0, *ends[:-1]], ends))]
        order = sorted(range(len(lists)), key=lists.__getitem__)
        self.ids = ids.take(pa.array(order, pa.int64()))
        self.starts = np.concatenate([[0], np.cumsum(lengths[order])])
        self.terms = np.array([t for i in order for t in lists[i]], dtype=np.int32)

    def __len__(self) -> int:
        return len(self.ids)

    def numbers(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of terms, and which of them are asked for; of others the number has no meaning."""
        at = np.searchsorted(self.codes, code).clip(max=len(self.codes) - 1)
        return self.number[at], self.codes[at] == code


class Best:
    """The ``limit`` best (score, document number) of each query so far; of equal scores the lower number, which is the lesser document."""

    def __init__(self, n: int, limit: int, digits: int):
        self.unit, self.limit = 10.0**digits, limit
        self.score, self.doc = np.full((n, limit), -1, np.int64), np.zeros((n, limit), np.int64)

    def least(self) -> np.ndarray:
        """What a score must reach to count, below zero while fewer than ``limit`` are known."""
        return (self.score[:, -1] - 1) / self.unit

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        asked = np.unique(query)
        known = self.score[asked] >= 0
        q = np.concatenate([np.repeat(asked, self.limit)[known.ravel()], query])
        s = np.concatenate([self.score[asked][known], np.floor(score * self.unit + 0.5).astype(np.int64)])
        d = np.concatenate([self.doc[asked][known], doc])
        order = np.lexsort((d, -s, q))
        q, s, d = q[order], s[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        kept = rank < self.limit
        self.score[q[kept], rank[kept]], self.doc[q[kept], rank[kept]] = s[kept], d[kept]


def _candidates(bound: np.ndarray, limit: int, slack: int) -> np.ndarray:
    """Documents that may be among the ``limit`` best of a chunk; a bound exceeds its score by less than ``slack``."""
    at = int(np.maximum.reduce(bound))
    while at > 1 and np.count_nonzero(bound >= at) < limit:
        at = at * 3 // 4
    near = (bound >= max(at, 1)).nonzero()[0]
    if len(near) < limit:
        return near
    values = bound[near]
    low = int(np.partition(values, -limit)[-limit]) - slack
    return near[values >= low] if low >= at else np.flatnonzero(bound >= max(low, 1))


def score_chunk(queries: Queries, best: Best, n: int, base: int, doc: np.ndarray, term: np.ndarray, part: np.ndarray) -> None:
    """Adds a chunk's best: postings (document 0 to n - 1 of the chunk, term, share of the score), one a document and term; its numbers begin at ``base``."""
    n_terms, starts = len(queries.codes), queries.starts
    key = term.astype(np.int64) * n + doc
    order = np.argsort(key)
    key, doc, part = key[order], doc[order], part[order]
    at = np.searchsorted(key, np.arange(n_terms + 1) * n)
    df = np.diff(at)
    there = np.flatnonzero(df)
    if not len(there):
        return
    peak = np.zeros(n_terms)
    peak[there] = np.maximum.reduceat(part, at[there])
    reach, asks = np.add.reduceat(peak[queries.terms], starts[:-1]), np.diff(starts)
    ceiling = min(reach.max(), 64 * peak.max())
    scale = min(_TOP / ceiling, 1e6)
    least = best.least()
    open_ = (reach > 0) & (reach >= least)
    whole = (reach > ceiling) | (asks > MOST_BOUNDED)
    up = np.ceil(part * scale).clip(0, 65_535).astype(np.uint16)
    cost = df * np.bincount(queries.terms, minlength=n_terms)
    dense = np.argsort(-cost, kind="stable")[: max(1, ROW_BYTES // (2 * n))]
    dense = dense[cost[dense] > 0]
    table = np.zeros((len(dense), n), np.uint16)
    for r, t in enumerate(dense):
        table[r, doc[at[t] : at[t + 1]]] = up[at[t] : at[t + 1]]
    row: list[np.ndarray | None] = [None] * n_terms
    for r, t in enumerate(dense.tolist()):
        row[t] = table[r]
    ends, limits, begin, asked = at.tolist(), np.floor((least - 1e-8) * scale).astype(np.int64).tolist(), starts.tolist(), array("i", queries.terms.tobytes())
    none, sums, room, path, peaks, found, size = np.zeros(n, np.uint16), [], [], array("i"), [], [], 0

    def score_found() -> None:
        q, d = np.repeat([i for i, _ in found], [len(c) for _, c in found]), np.concatenate([c for _, c in found])
        each = asks[q]
        first = np.cumsum(each) - each
        t = queries.terms[np.arange(each.sum()) - np.repeat(first - starts[q], each)].astype(np.int64)
        wanted = t * n + np.repeat(d, each)
        where = np.searchsorted(key, wanted).clip(max=len(key) - 1)
        best.add(q, np.add.reduceat(np.where(key[where] == wanted, part[where], 0.0), first), base + d)

    for i in np.flatnonzero(open_ & ~whole).tolist():
        wanted = asked[begin[i] : begin[i + 1]]
        same = next((k for k, (x, y) in enumerate(zip(path, wanted)) if x != y), min(len(path), len(wanted)))
        del sums[same:], peaks[same:]
        path = wanted
        for k in range(same, len(path)):
            t, above = path[k], sums[-1] if sums else none
            if k and k == len(path) - 1 and limits[i] >= 1:
                if peaks[-1] < 0:
                    peaks[-1] = int(np.maximum.reduce(above))
                if peaks[-1] < limits[i]:  # none but the last term's documents reach the limit
                    path = path[:-1]
                    break
            if k == len(room):
                room.append(np.empty(n, np.uint16))
            if row[t] is not None:
                sums.append(np.add(above, row[t], room[k]) if k else row[t])
            elif ends[t] < ends[t + 1]:
                np.copyto(room[k], above)
                room[k][doc[ends[t] : ends[t + 1]]] += up[ends[t] : ends[t + 1]]
                sums.append(room[k])
            else:
                sums.append(above)
            peaks.append(-1)
        bound = sums[-1]
        if len(path) < len(wanted):
            own = doc[ends[t] : ends[t + 1]]
            near = own[bound[own] + up[ends[t] : ends[t + 1]] >= limits[i]]
        elif limits[i] < 1:
            near = _candidates(bound, best.limit, len(path))
        else:
            near = (bound >= limits[i]).nonzero()[0]
        if len(near):
            found.append((i, near))
            size += len(near) * int(asks[i])
            if size >= PAIRS:
                score_found()
                found, size = [], 0
    if found:
        score_found()
    for i in np.flatnonzero(open_ & whole).tolist():
        total, hit = np.zeros(n), np.zeros(n, bool)
        for t in asked[begin[i] : begin[i + 1]]:
            total[doc[ends[t] : ends[t + 1]]] += part[ends[t] : ends[t + 1]]
            hit[doc[ends[t] : ends[t + 1]]] = True
        near = np.flatnonzero(hit)
        best.add(np.full(len(near), i), total[near], base + near)


def best_documents(batches: Iterator[pa.RecordBatch], queries: Queries, limit: int, digits: int) -> Iterator[pa.RecordBatch]:
    """(query_id, doc, score): the best of one group of documents; batches are (doc, code, part) in order of documents."""
    best, ids, base = Best(len(queries), limit, digits), [], 0

    def take(held: list[pa.RecordBatch], last: bool) -> list[pa.RecordBatch]:
        nonlocal base
        rows = pa.Table.from_batches(held).combine_chunks()
        docs = rows["doc"].combine_chunks().dictionary_encode(null_encoding="encode")
        docs = docs.chunk(0) if isinstance(docs, pa.ChunkedArray) else docs
        number, names = np.asarray(docs.indices), docs.dictionary
        n = len(names) - (not last)  # the last document may go on in the next batch
        stop = len(number) if last else int(np.searchsorted(number, n))
        code, part = np.asarray(rows["code"])[:stop], np.asarray(rows["part"])[:stop]
        term, asked = queries.numbers(code)
        for low in range(0, n, CHUNK_DOCS):
            high = min(n, low + CHUNK_DOCS)
            a, b = np.searchsorted(number[:stop], [low, high])
            keep = asked[a:b]
            score_chunk(queries, best, high - low, base + low, number[a:b][keep] - low, term[a:b][keep], part[a:b][keep])
        ids.append(names.slice(0, n))
        base += n
        return rows.slice(stop).to_batches()

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= READ_POSTINGS:
            held = take(held, False)
            size = sum(b.num_rows for b in held)
    if size:
        take(held, True)
    if not base:
        return
    query, rank = np.nonzero(best.score >= 0)
    names = pa.concat_arrays(ids)
    for i in range(0, len(query), 50_000):
        q, r = query[i : i + 50_000], rank[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([queries.ids.take(pa.array(q)), names.take(pa.array(best.doc[q, r])), pa.array(best.score[q, r] / best.unit)], ["query_id", "doc", "score"])
