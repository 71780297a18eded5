"""The best documents of many queries, by sums of products over terms, without a row for each query and document.

The query side is packed and broadcast, in groups of bounded size; documents are read as a stream, a block at a time, and
each task keeps the k best of every query. What is shuffled is k rows a query and task. Terms that many queries and many
documents have go through one matrix product, the others through their postings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.tokens import ngrams
from millrace.operators import tfidf
from millrace.operators.ranking import DIGITS, top_k

GROUP_ROWS, GROUP_QUERIES = 2_000_000, 8192  # most terms and, on average, queries of a group
CELLS = 2_000_000  # of queries x documents, scored at once
DENSE = 1024  # most terms of the matrix product
WORTH = 1 / 150  # of all queries x documents that share a term, from which it goes there
HELD = 500_000  # rows kept before they are cut to the k best


def _grouped(vectors: DataFrame) -> list[DataFrame]:
    n = vectors.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    groups = max(math.ceil(n[0] / GROUP_ROWS), math.ceil(n[1] / GROUP_QUERIES))
    return [vectors.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g) for g in range(groups)]


def _packed(vectors: DataFrame, n_docs: int) -> dict:
    """Queries, terms, and by term the queries that have it and their weights; the terms of the matrix product."""
    t = vectors.select("query_id", "term", "weight", "df").toArrow().combine_chunks()
    q, term = (pc.dictionary_encode(t.column(c)).combine_chunks() for c in ("query_id", "term"))
    at, of = q.indices.to_numpy(), term.indices.to_numpy()
    order = np.argsort(of, kind="stable")
    n = np.bincount(of, minlength=len(term.dictionary))
    df = np.zeros(len(n))
    df[of] = t.column("df").to_numpy()
    shared = n / max(len(q.dictionary), 1) * df / max(n_docs, 1)
    dense = np.argsort(-shared, kind="stable")[:DENSE]
    return {"queries": q.dictionary, "terms": term.dictionary, "starts": np.r_[0, np.cumsum(n)], "at": at[order].astype(np.int64), "weight": t.column("weight").to_numpy()[order], "dense": dense[shared[dense] > WORTH]}


class _Best:
    """The k best rows of each query so far, by rounded score, then document."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.held, self.size = k, np.zeros(n), [], 0  # least: rounded score that a row needs

    def add(self, docs: pa.Array, score: np.ndarray) -> None:
        """score: [document, query]; 0 is no row."""
        rounded = np.floor(score * 10.0**DIGITS + 0.5)
        some = rounded >= self.least
        if np.count_nonzero(some) > 4 * self.k * score.shape[1] and len(score) > self.k:
            self.least = np.maximum(self.least, np.partition(rounded, len(score) - self.k, axis=0)[len(score) - self.k])
            some = rounded >= self.least
        some &= score > 0
        d, q = np.nonzero(some)
        self.held.append(pa.table({"q": q, "r": rounded[d, q], "score": score[d, q], "doc": docs.take(pa.array(d))}))
        self.size += len(d)
        if self.size > HELD + 2 * self.k * score.shape[1]:
            self.cut()

    def cut(self) -> pa.Table:
        t = pa.concat_tables(self.held)
        t = t.take(pc.sort_indices(t, sort_keys=[("q", "ascending"), ("r", "descending"), ("doc", "ascending")]))
        q = t.column("q").to_numpy()
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        last = place == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], t.column("r").to_numpy()[last])
        t = t.filter(pa.array(place < self.k)).combine_chunks()
        self.held, self.size = [t], len(t)
        return t


def _sums(side: dict, matrix: np.ndarray, place: np.ndarray, n: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """[document, query] scores of n documents, whose terms are given as (row, term, weight)."""
    width = len(side["queries"])
    dense = place[term] >= 0
    left = np.zeros((n, len(matrix)))
    left[row[dense], place[term[dense]]] = weight[dense]
    row, term, weight = row[~dense], term[~dense], weight[~dense]
    begin = side["starts"][term]
    size = side["starts"][term + 1] - begin
    of = np.repeat(np.arange(len(term)), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + begin[of]
    rest = np.bincount(row[of] * width + side["at"][at], weight[of] * side["weight"][at], minlength=n * width)
    return left @ matrix + rest.reshape(n, width)


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists and the row of each."""
    return column.flatten(), pc.list_parent_indices(column).to_numpy()


def best_documents(vectors: DataFrame, docs: DataFrame, tokens: str, index: DataFrame, model: tfidf.Model, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): for each query the k documents of the largest sums of its weights times theirs.

    vectors is (query_id, term, weight), computed once. Documents are weighted within the row if the vocabulary can be
    broadcast and no document has two rows; otherwise the index, read by document, has their weights.
    """
    spark = vectors.sparkSession
    vectors = vectors.join(model.side().select("term", "df"), "term")
    config = model.config
    types = f"query_id {vectors.schema['query_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    in_row = model.n_terms <= tfidf.BROADCAST_TERMS and docs.agg(F.count_distinct("doc_id")).first()[0] == model.n_docs
    if in_row:
        rows = docs.select("doc_id", ngrams(F.col(tokens), config.low, config.high).alias("terms"))
        words = model.vocabulary.select("term", "idf").toArrow().combine_chunks()
        known = spark.sparkContext.broadcast((words.column("term").combine_chunks(), words.column("idf").to_numpy()))
    else:
        rows = index.groupBy("doc_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
        known = None
    rows = rows.coalesce(4 * spark.sparkContext.defaultParallelism)

    def searched(group: DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast(_packed(group, model.n_docs))

        def own_weights(b: pa.RecordBatch, terms: pa.Array, idf: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            flat, row = _lists(b.column(1))
            term = pc.fill_null(pc.index_in(flat, terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            both, n = np.unique((row * len(terms) + term)[term >= 0], return_counts=True)
            row, term = both // max(len(terms), 1), both % max(len(terms), 1)
            weight = (1.0 + np.log(n) if config.sublinear else n.astype(float)) * idf[term]
            weight /= np.sqrt(np.bincount(row, weight * weight, minlength=b.num_rows))[row]
            asked = number[term] >= 0
            return row[asked], number[term[asked]], weight[asked]

        def given_weights(b: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            flat, row = _lists(b.column(1))
            term = pc.fill_null(pc.index_in(flat, terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            asked = term >= 0
            return row[asked], term[asked], b.column(2).flatten().to_numpy()[asked]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            side = sent.value
            width = len(side["queries"])
            if not width:
                return
            place = np.full(len(side["terms"]), -1)
            place[side["dense"]] = np.arange(len(side["dense"]))
            matrix = np.zeros((len(side["dense"]), width))
            for i, x in enumerate(side["dense"]):
                of = slice(side["starts"][x], side["starts"][x + 1])
                matrix[i, side["at"][of]] = side["weight"][of]
            if known is not None:
                terms, idf = known.value
                number = pc.fill_null(pc.index_in(terms, side["terms"]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            best, step = _Best(width, k), max(16, CELLS // width)
            for whole in batches:
                for i in range(0, whole.num_rows, step):
                    b = whole.slice(i, step)
                    got = own_weights(b, terms, idf, number) if known is not None else given_weights(b, side["terms"])
                    best.add(b.column(0), _sums(side, matrix, place, b.num_rows, *got))
            if best.held:
                t = best.cut()
                for b in pa.table({"query_id": side["queries"].take(t.column("q").combine_chunks()), "doc_id": t.column("doc"), "score": t.column("score")}).to_batches(10_000):
                    yield b

        return rows.mapInArrow(run, types)

    groups = [searched(g) for g in _grouped(vectors)]
    found = reduce(DataFrame.unionAll, groups) if groups else spark.createDataFrame([], types)
    return top_k(found, k).select("query_id", "rank", "doc_id", "score")
