"""What a cell of `search` works out: the best of a block of documents for each of a block of queries.

Each function takes two Arrow tables and gives (query_id, doc_id, score). Documents are numbered in
the order of their ids, so that ties go to the lesser number. Scores are compared as they will be rounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores that differ by less may be equal after rounding.
SLACK = 1e-5
#: Scores of a matrix of queries by documents, postings that are added to it at once, and weights of terms held as rows.
SCORES, ADDED, DENSE = 1 << 22, 1 << 22, 1 << 23
#: A term found in more than one of so many documents is a row of weights.
COMMON = 25
#: Columns whose greatest score stands for them when the k-th is bounded.
WIDTH = 64


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each row's number, and the distinct values by number, in their order (nulls first)."""
    coded = pc.dictionary_encode(column, null_encoding="encode").combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    order = pc.sort_indices(coded.dictionary, null_placement="at_start")
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(order)


def _best(scores: np.ndarray, k: int, places: int, positive: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score): the k best columns of each row, ties to the lesser column; only those above 0 if so asked. A NaN is greatest."""
    if not positive:
        scores = np.where(np.isnan(scores), np.inf, scores)
    groups = scores.shape[1] // WIDTH
    most = scores[:, : WIDTH * groups].reshape(len(scores), WIDTH, groups).max(axis=1)
    most = np.concatenate([most, scores[:, WIDTH * groups :]], axis=1)
    # The k-th of the groups' greatest is at most the k-th of all.
    floor = np.partition(most, -k, axis=1)[:, -k, None] - SLACK if most.shape[1] > k else np.full((len(scores), 1), -np.inf)
    rows, columns = np.nonzero((scores >= floor) & (scores > 0) if positive else scores >= floor)
    found = scores[rows, columns]
    order = np.lexsort((columns, -np.floor(found * 10.0**places + 0.5), rows))
    rows, columns, found = rows[order], columns[order], found[order]
    some = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[some], columns[some], np.where(np.isinf(found[some]), np.nan, found[some])


def _table(queries: pa.Array, docs: pa.Array, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    q, d, s = (np.concatenate(x) for x in zip((np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), *found, strict=True))
    return pa.table({"query_id": queries.take(pa.array(q)), "doc_id": docs.take(pa.array(d)), "score": pa.array(s, pa.float64())})


def bm25(post: pa.Table, asked: pa.Table, k: int, places: int) -> pa.Table:
    """post (doc_id, term, part) and asked (query_id, term, idf): the sums of idf times part over the terms of both.

    A matrix of some queries by all documents is filled at a time, from the postings of rarer terms and the rows of common ones.
    """
    d, docs = _numbered(post["doc_id"])
    t, terms = _numbered(post["term"])
    q, queries = _numbered(asked["query_id"])
    at = pc.fill_null(pc.index_in(asked["term"], value_set=terms), -1).to_numpy().astype(np.int64)
    q, at, idf = q[at >= 0], at[at >= 0], asked["idf"].to_numpy()[at >= 0]
    if not len(at):
        return _table(queries, docs, [])
    n = len(docs)
    order = np.argsort(t * n + d, kind="stable")
    key, parts = (t * n + d)[order], post["part"].to_numpy()[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))  # an id may have texts of several lengths
    key, parts = key[first], np.add.reduceat(parts, first)
    t, d = key // n, key % n
    weight = np.zeros(len(terms))
    weight[at] = idf
    parts *= weight[t]
    starts = np.searchsorted(t, np.arange(len(terms) + 1))
    sizes = np.diff(starts)
    common = np.flatnonzero((sizes * COMMON > n) & (weight > 0))
    common = common[np.argsort(-sizes[common], kind="stable")[: DENSE // n]]
    row = np.full(len(terms), -1)
    row[common] = np.arange(len(common))
    dense = np.zeros((len(common), n))
    for i, term in enumerate(common):
        dense[i, d[starts[term] : starts[term + 1]]] = parts[starts[term] : starts[term + 1]]
    order = np.argsort(q, kind="stable")
    q, at = q[order], at[order]
    adds = np.concatenate(([0], np.cumsum(np.where(row[at] < 0, sizes[at], 0))))
    begins = np.searchsorted(q, np.arange(len(queries) + 1))
    found, b = [], 0
    while b < len(queries):
        e = int(np.searchsorted(adds[begins], adds[begins[b]] + ADDED, "right")) - 1
        e = min(max(e, b + 1), b + max(1, SCORES // n), len(queries))
        mine, terms_of = q[begins[b] : begins[e]] - b, at[begins[b] : begins[e]]
        rare = row[terms_of] < 0
        lengths = sizes[terms_of[rare]]
        place = np.repeat(starts[terms_of[rare]] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        scores = np.bincount(np.repeat(mine[rare] * n, lengths) + d[place], parts[place], (e - b) * n).astype(np.float64, copy=False).reshape(e - b, n)
        for i, j in zip(mine[~rare].tolist(), row[terms_of[~rare]].tolist(), strict=True):
            scores[i] += dense[j]
        rows, columns, s = _best(scores, k, places, True)
        found.append((rows + b, columns, s))
        b = e
    return _table(queries, docs, found)


def _vectors(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors of length 1) for each dimension; vectors of no length are left out."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = []
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        v = column.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), size)
        norm = np.sqrt((v * v).sum(axis=1))
        some = (norm > 0) | np.isnan(norm)
        with np.errstate(invalid="ignore"):
            out.append((rows[some], v[some] / norm[some, None]))
    return out


def cosine(vectors: pa.Table, asked: pa.Table, k: int, places: int) -> pa.Table:
    """vectors (doc_id, v) and asked (query_id, v): their cosines."""
    order = pc.sort_indices(vectors["doc_id"], null_placement="at_start")
    vectors = vectors.take(order)
    ours, found = {v.shape[1]: (rows, v) for rows, v in _vectors(vectors["v"])}, []
    for rows, q in _vectors(asked["v"]):
        docs, v = ours.get(q.shape[1], (np.empty(0, np.int64), np.empty((0, q.shape[1]))))
        step = max(1, SCORES // max(1, len(docs)))
        for b in range(0, len(rows) if len(docs) else 0, step):
            i, j, s = _best(q[b : b + step] @ v.T, k, places)
            found.append((rows[b + i], docs[j], s))
    return _table(asked["query_id"].combine_chunks(), vectors["doc_id"].combine_chunks(), found)
