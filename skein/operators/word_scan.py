"""Sums over the words that documents and queries share, and the best documents of each query by them.

Joined as rows, a common word would meet every query that has it in every document. Here a document with its words is one row, a block of queries is sent to all
tasks, and sums are made in Arrow batches, so that only the best rows of each task are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .vectors import QUERY_BLOCK, SCORES, best_of


def asked_blocks(asked: DataFrame) -> list[pa.Table]:
    """Rows of (query_id, term, ...), one a query and word, in blocks of about QUERY_BLOCK queries."""
    n = asked.select("query_id").distinct().count()
    if n <= QUERY_BLOCK:
        return [asked.toArrow()]
    parts = -(-n // QUERY_BLOCK)
    return [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).toArrow() for i in range(parts)]


class Asked:
    """A block's queries and words: for each word the queries that have it, with a weight each."""

    def __init__(self, block: pa.Table, weight: str):
        names = block["query_id"].combine_chunks()
        keys = pa.array([repr(x) for x in names.to_pylist()], pa.string()).dictionary_encode()
        query = keys.indices.to_numpy()
        self.names = names.take(pa.array(np.unique(query, return_index=True)[1])) if len(query) else names
        words = block["term"].combine_chunks().dictionary_encode()
        self.words, word = words.dictionary, words.indices.to_numpy()
        order = np.argsort(word, kind="stable")
        self.query, self.weight = query[order], block[weight].to_numpy()[order].astype(np.float64)
        self.start = np.searchsorted(word[order], np.arange(len(self.words) + 1))
        self.n_words = np.bincount(query, minlength=len(self.names))

    def sums(self, row: np.ndarray, word: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """n rows by all queries: the sums of value times weight over (row, word), which are in the order of rows."""
        many = self.start[word + 1] - self.start[word]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.start[word], many)
        cells = np.repeat(row, many) * len(self.names) + self.query[place]
        return np.bincount(cells, np.repeat(value, many) * self.weight[place], n * len(self.names)).reshape(n, -1)


def best(docs: DataFrame, asked: Asked, value: Callable[[pa.Array], np.ndarray], finish: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int) -> DataFrame:
    """(query_id, id, score): of each task those of docs (id, said: array of words, or of structs with a term) that may be among the k best of a query. A score is finish()
    of the sums over the words of value() of a document's entries times the query's weight, and of each query's number of words; a document without a word
    of the query has none."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        floor = np.full(len(a.names), -np.inf)
        for b in batches if len(a.names) else ():
            if not b.num_rows:
                continue
            said = b.column("said")
            entries = said.flatten()
            row = np.repeat(np.arange(len(said)), np.asarray(said.value_lengths().fill_null(0)))
            word = np.asarray(pc.index_in(entries.field("term") if pa.types.is_struct(entries.type) else entries, a.words).fill_null(-1))
            known = np.nonzero(word >= 0)[0]
            row, word, number = row[known], word[known], value(entries)[known]
            # documents are taken so many at a time that neither their cells nor their pairs of words and queries are more than SCORES by much
            cost = np.bincount(row, a.start[word + 1] - a.start[word], len(said)) + len(a.names)
            part = (np.cumsum(cost) // SCORES).astype(np.int64)
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                at = slice(*np.searchsorted(row, [lo, hi]))
                sums = a.sums(row[at] - lo, word[at], number[at], hi - lo)
                scores = np.where(sums > 0, finish(sums, a.n_words), -np.inf)
                ids = b.column("id").slice(lo, hi - lo)
                rows, cols = best_of(scores, ids, floor, k)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([a.names.take(pa.array(cols)), ids.take(pa.array(rows)), pa.array(scores[rows, cols])], ["query_id", "id", "score"])

    return docs.select("id", "said").mapInArrow(run, f"query_id {from_arrow_type(asked.names.type).simpleString()}, id {docs.schema['id'].dataType.simpleString()}, score double")
