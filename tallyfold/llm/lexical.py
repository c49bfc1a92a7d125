"""Ranked lexical search by the Best Position Algorithm.

A document's score for a query is a sum over the query's terms of integer impacts (BM25-like, see `impacts`).  Every task
holds an index of a part of the documents: for each term the list of its documents by falling impact, and the places of all
its documents in that list.  The lists of a query are read from the top in step; every document met is looked up in all
lists (direct access), which marks its place in each.  A list's best position is the end of the places that are marked without
a gap from its top, which direct accesses push beyond the place that was last read.  No document that is still unseen can have more than the
sum of the impacts right behind the best positions; once that sum is strictly below the k-th best score, reading stops (at
equality it does not, as an equal score with a smaller id would come first).

Parts are independent, so the corpus is read where it lies and only the k best of each part are shuffled.  Documents are taken in two
turns: the k-th best score of the first, small turn is a floor for all parts of the second.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import arrow_sized, forget_tables, lower_ascii, staged, text_slices

#: Words: maximal runs of letters and digits of ASCII and of everything beyond ASCII.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BEST = 10
#: Query terms (each counted for every item that has it) that one pass over the documents serves; more items take more passes.
PASS_TERMS = 300_000
#: Postings of a part that a task indexes at once, 40 bytes each.
PART_POSTINGS = 1_000_000
#: One document in FIRST_TURN makes the floor of the others.
FIRST_TURN = 16
#: Entries of each list that are read first; every further step reads twice as many.
STEP = 16


def terms(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term), distinct; rows of one item id are one query."""
    return items.select(F.col(id_col).alias("item"), F.explode(terms(F.col(text_col))).alias("term")).distinct()


def forward_index(docs: DataFrame, wanted: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, n, term, tf) of every row that has a term: n with repeats over its whole text, and the wanted terms (their places in `wanted`) with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)  # at most PASS_TERMS short strings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        number = {w.encode(): k for k, w in enumerate(sent.value)}
        for batch in batches:
            for at, count in text_slices(batch.column(1)):
                part = batch.slice(at, count)
                lengths, ends, term, tf = [], [0], [], []
                for text in part.column(1):
                    words = _BYTES.findall(text.as_buffer().to_pybytes().translate(_LOWER)) if text.is_valid else []
                    lengths.append(len(words))
                    own = Counter(words)
                    found = own.keys() & number.keys()
                    term += [number[w] for w in found]
                    tf += [own[w] for w in found]
                    ends.append(len(term))
                lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (term, tf))
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), *lists], names=["id", "n", "term", "tf"])
                yield out.filter(pa.compute.greater(out.column(1), 0))

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_sized(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, n long, term array<int>, tf array<int>")


def weights(held: int, found: DataFrame) -> dict[int, int]:
    """The weight of each wanted term that a document has: floor(1000 ln((2N + 2) / (2 df + 1)))."""
    w = F.floor(1000 * F.log(F.lit(2.0 * held + 2) / (2.0 * F.col("df") + 1)))
    return {r["term"]: r["w"] for r in found.select("term", w.cast("long").alias("w")).collect()}


class Part:
    """Impact lists over some documents, in order of their ids."""

    def __init__(self, m: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray):
        self.size = len(m)
        doc = np.repeat(np.arange(self.size), np.diff(ends))
        tf = tf.astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        by_doc = np.argsort(term, kind="stable")
        self.terms, self.start = np.unique(term[by_doc], return_index=True)
        self.end = np.append(self.start[1:], len(term))
        self.at = {int(t): k for k, t in enumerate(self.terms)}
        self.doc, self.impact = doc[by_doc].astype(np.int32), impact[by_doc]
        # the same lists by falling impact, then id
        falling = np.lexsort((doc, -impact, term))
        self.top_doc, self.top_impact = doc[falling].astype(np.int32), impact[falling]
        rank = np.empty(len(term), np.int32)
        rank[falling] = np.arange(len(term), dtype=np.int32)
        self.place = rank[by_doc] - np.repeat(self.start, self.end - self.start).astype(np.int32)
        self.dense: dict[int, np.ndarray] = {}

    def find(self, k: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of `docs` the list k has, and where (by document)."""
        a, b = self.start[k], self.end[k]
        if 8 * (b - a) >= self.size:  # long lists by a table over all documents: 8 times the postings at most
            if k not in self.dense:
                table = np.full(self.size, -1, np.int32)
                table[self.doc[a:b]] = np.arange(a, b, dtype=np.int32)
                self.dense[k] = table
            j = self.dense[k][docs]
            hit = np.flatnonzero(j >= 0)
            return hit, j[hit]
        j = np.searchsorted(self.doc[a:b], docs)
        j[j == b - a] = 0
        hit = np.flatnonzero(self.doc[a:b][j] == docs)
        return hit, j[hit] + a

    def best(self, query: list[tuple[int, int]], k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents of (term, weight) with a score of at least max(1, floor), their scores, and how many documents were seen.

        Best first, equal scores by document.
        """
        lists = [(self.at[t], w) for t, w in query if t in self.at and w > 0]
        starts, ends = [self.start[i] for i, _ in lists], [self.end[i] for i, _ in lists]
        marked = [np.zeros(b - a + 1, bool) for a, b in zip(starts, ends)]  # the last stands for the end and is never marked
        best_at = [0] * len(lists)
        seen = np.zeros(self.size, bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step, count = 0, STEP, 0
        while lists:
            met = np.concatenate([self.top_doc[a + depth : min(b, a + depth + step)] for a, b in zip(starts, ends)])
            if not len(met):
                break
            depth, step = depth + step, 2 * step
            fresh = np.unique(met[~seen[met]])
            if len(fresh):
                seen[fresh], count = True, count + len(fresh)
                score = np.zeros(len(fresh), np.int64)
                for x, (i, w) in enumerate(lists):
                    hit, j = self.find(i, fresh)
                    score[hit] += w * self.impact[j]
                    marked[x][self.place[j]] = True
                good = score >= max(1, floor)
                docs, scores = np.concatenate([docs, fresh[good]]), np.concatenate([scores, score[good]])
                order = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[order], scores[order]
            limit = 0
            for x, (i, w) in enumerate(lists):
                best_at[x] += int(np.argmin(marked[x][best_at[x] :]))
                if best_at[x] < ends[x] - starts[x]:
                    limit += w * int(self.top_impact[starts[x] + best_at[x]])
            if limit < max(1, floor, int(scores[k - 1]) if len(scores) == k else 0):
                break
        return docs, scores, count


def _searched(index: DataFrame, plan, k: int, held: int, total: int) -> DataFrame:
    """(item, id, score): the k best of every part for every query of the broadcast `plan`: [(item number, [(term, weight)], floor)]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()

        def answers(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            order = pa.compute.sort_indices(table, sort_keys=[("id", "ascending")], null_placement="at_start")
            table = table.take(order).combine_chunks()
            ids, n = table.column("id"), table.column("n").to_numpy()
            term, tf = table.column("term").combine_chunks(), table.column("tf").combine_chunks()
            part = Part(10 + 90 * n * held // total, np.append(0, np.cumsum(term.value_lengths().to_numpy(zero_copy_only=False))), term.flatten().to_numpy(), tf.flatten().to_numpy())
            items, docs, scores = [], [], []
            for item, query, floor in plan.value:
                d, s, _ = part.best(query, k, floor)
                items.append(np.full(len(d), item, np.int32))
                docs.append(d)
                scores.append(s)
            found = ids.take(pa.array(np.concatenate(docs)))
            yield from pa.Table.from_arrays([pa.array(np.concatenate(items)), found, pa.array(np.concatenate(scores))], names=["item", "id", "score"]).combine_chunks().to_batches()

        held_back, postings = [], 0
        for batch in batches:
            sizes = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            at = 0
            while at < len(sizes):
                room = PART_POSTINGS - postings + (sizes[at - 1] if at else 0)
                end = max(at + 1, int(np.searchsorted(sizes, room, side="right")))
                held_back.append(batch.slice(at, end - at))
                postings += int(sizes[end - 1] - (sizes[at - 1] if at else 0))
                at = end
                if postings >= PART_POSTINGS or at < len(sizes):
                    yield from answers(held_back)
                    held_back, postings = [], 0
        if held_back:
            yield from answers(held_back)

    kind = index.schema["id"].dataType.simpleString()
    return arrow_sized(index).mapInArrow(run, f"item int, id {kind}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Spark cuts every task's rows to k an item before they are shuffled."""
    order = W.Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pass_terms: int = PASS_TERMS
) -> DataFrame:
    """item_id, rank, id, score: the k best rows of `docs` for every item, fewer where fewer have a score above 0.

    Equal scores are ranked by id, null ids first; rows that repeat are documents each.  Null and empty texts have no terms: such items get
    no rows, such documents do not count; rows that repeat an item id are one query of all their terms, a null item id is an item of
    its own; empty tables give no rows; other columns are not read.  Items are dealt by hash to passes of some `pass_terms` terms each.
    """
    asked = staged(query_terms(items, item_col, item_text_col), "query-terms")
    sizes = staged(asked.groupBy("item").agg(F.count("*").alias("n")), "query-sizes")
    passes = (sizes.agg(F.sum("n")).first()[0] or 0) // pass_terms + 1
    turned = staged(sizes.select(F.col("item").alias("t_item"), F.pmod(F.xxhash64("item"), F.lit(passes)).alias("turn")), "query-turns")
    out = None
    for (turn,) in sorted(map(tuple, turned.select("turn").distinct().collect())):
        own = asked.join(turned.where(F.col("turn") == turn), F.col("item").eqNullSafe(F.col("t_item"))).select("item", "term")
        some = _search_pass(docs, own, k, id_col, text_col)
        out = some if out is None else out.union(some)
    kind = docs.schema[id_col].dataType
    if out is None:
        return asked.select(F.col("item").alias("item_id"), F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("id"), F.lit(0).cast("long").alias("score")).where("false")
    return out


def _search_pass(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """`search` for queries that the driver may hold."""
    spark = docs.sparkSession
    queries: dict = {}
    for r in asked.collect():
        queries.setdefault(r["item"], []).append(r["term"])
    names = sorted(queries, key=lambda x: (x is not None, x))
    wanted = sorted({t for q in queries.values() for t in q})
    number = {t: i for i, t in enumerate(wanted)}
    index = staged(forward_index(docs, wanted, id_col, text_col), "forward-index")
    held, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    named = spark.createDataFrame(list(enumerate(names)), f"number int, item_id {asked.schema['item'].dataType.simpleString()}")
    w = weights(held, index.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    plan = [(i, [(number[t], w[number[t]]) for t in queries[name] if number[t] in w], 0) for i, name in enumerate(names)]
    first = F.pmod(F.xxhash64("id", "n"), F.lit(FIRST_TURN)) == 0

    def turn(rows: DataFrame, plan: list, name: str) -> DataFrame:
        return staged(_searched(rows, spark.sparkContext.broadcast(plan), k, held, total), name)

    early = turn(index.where(first), plan, "first-turn")
    # k rows an item at most
    floors = {r["item"]: r["score"] for r in _ranked(early, k).where(F.col("rank") == k).select("item", "score").collect()}
    late = turn(index.where(~first), [(i, q, floors.get(i, 0)) for i, q, _ in plan], "second-turn")
    best = _ranked(early.union(late), k).withColumnRenamed("item", "number")
    return best.join(F.broadcast(named), "number").select("item_id", "rank", "id", "score")
