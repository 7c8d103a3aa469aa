"""Ranked lexical search over a length-stratified index.

A document's score depends on its length through a whole number m alone, so documents of equal m are a
stratum. Within a stratum (or a slice of it, where it is large) each term's postings are grouped by tf, and as
an impact is a function of tf and m it is computed once for each tf. The largest tf of each term bounds what
any document of a stratum can score for an item: strata are visited in descending order of that bound, until
it falls below the item's tenth score so far. The tenth score of the best-bounded stratum of the whole corpus is
known to all tasks before they begin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifmill.llm import text
from motifmill.llm.shared import in_arrow, partitions, save

#: Postings of a slice, about: a stratum with more is cut. A document with more is a slice of its own.
SLICE_POSTINGS = 1 << 18
#: Text of items that are searched for at once; more are searched for in several turns.
ITEM_BYTES = 16 << 20
TOP = 10
_LAST = np.iinfo(np.int64).max
INDEX = "slice long, m long, docs array<long>, terms array<int>, tops array<int>, run_term array<int>, run_tf array<int>, run_end array<int>, places array<int>"


def terms_of(texts: list[str | None]) -> list[np.ndarray]:
    """The hashes of each text's terms: runs of 0-9, A-Z, a-z and characters beyond ASCII, A-Z lower-cased."""
    out = []
    for _, at, h in text.words(pa.array([t or "" for t in texts], pa.string()), lower=True, gaps=text.PUNCTUATION):
        out += [h[a:b] for a, b in zip(at[:-1], at[1:])]
    return out


@dataclass
class Items:
    """Items with at least a term, and their vocabulary in the order of hashes; rows of one item_id are one item with all their terms."""

    ids: list
    terms: list[np.ndarray]  # places in the vocabulary
    vocabulary: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Tenth scores that are known already; no document below is wanted.
    least: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self):
        self.least = np.ones(len(self.ids), np.int64)
        owners = np.concatenate([np.full(len(t), i) for i, t in enumerate(self.terms)] or [np.zeros(0, int)])
        every = np.concatenate([*self.terms, np.zeros(0, int)]).astype(int)
        order = np.argsort(every, kind="stable")
        self.holders = owners[order]  # items by term
        self.first = np.searchsorted(every[order], np.arange(len(self.vocabulary) + 1))

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        by_id: dict = {}
        for (ident, _), h in zip(rows, terms_of([t for _, t in rows])):
            by_id.setdefault(ident, []).append(h)
        sets = {i: np.unique(np.concatenate(hs)) for i, hs in by_id.items()}
        sets = {i: s for i, s in sets.items() if len(s)}
        vocabulary = np.unique(np.concatenate([*sets.values(), np.zeros(0, text.U64)]))
        return cls(list(sets), [np.searchsorted(vocabulary, s) for s in sets.values()], vocabulary)

    def bounds(self, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        """The most that each item can score where its terms have these impacts at most."""
        count = self.first[terms + 1] - self.first[terms]
        at = np.repeat(self.first[terms] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(terms) else np.zeros(0, int)
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, self.holders[at], np.repeat(impacts * self.weights[terms], count))
        return out


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _ints(col: pa.ListArray, i: int) -> np.ndarray:
    return col[i].values.to_numpy(zero_copy_only=False)


def _lists(ends: np.ndarray, values: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, kind))


def _vectors(sent):
    """Rows with a term to (doc_id, n, terms, tfs): their number of terms, and those of the vocabulary with their occurrences."""

    def run(batches):
        vocabulary = sent.value.vocabulary
        size = max(len(vocabulary), 1)
        for batch in batches:
            ids = batch.column("doc_id")
            for row, at, h in text.words(text.column(batch, "text"), lower=True, gaps=text.PUNCTUATION):
                n = np.diff(at)
                place = np.minimum(np.searchsorted(vocabulary, h), size - 1)
                known = vocabulary[place] == h if len(vocabulary) else np.zeros(len(h), bool)
                rank = np.cumsum(n > 0) - 1  # rows without terms are left out
                keys, tf = np.unique(np.repeat(rank, n)[known] * size + place[known], return_counts=True)
                full = np.flatnonzero(n)
                ends = np.searchsorted(keys, (np.arange(len(full)) + 1) * size)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row + full)), pa.array(n[full]), _lists(ends, (keys % size).astype(np.int32), pa.int32()), _lists(ends, tf.astype(np.int32), pa.int32())], ["doc_id", "n", "terms", "tfs"]
                )

    return run


def _slice(number: int, m: int, docs: pa.Array, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> tuple:
    """A row of the index: postings by term, then by tf, the largest first."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((owner, -tfs, terms))
    terms, tfs, owner = terms[order], tfs[order], owner[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (tfs[1:] != tfs[:-1])
    runs = np.flatnonzero(new)
    head = np.ones(len(runs), bool)
    head[1:] = terms[runs][1:] != terms[runs][:-1]
    ends = np.append(runs[1:], len(terms))[: len(runs)]
    return number, m, docs, terms[runs][head], tfs[runs][head], terms[runs], tfs[runs], ends, owner


def _index(slices: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*slices))
    lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in c])]).astype(np.int32)), pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x.astype(np.int32)) for x in c])) for c in cols[2:]]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *lists], [c.split()[0] for c in INDEX.split(", ")])


def _strata(most: int):
    """Rows sorted by m and doc_id to slices of strata; the rows of a slice that the next batch may go on with are held."""

    def run(batches):
        number, held = TaskContext.get().partitionId() << 32, []
        m_held, postings, done, done_postings = None, 0, [], 0

        def close():
            docs, sizes, terms, tfs = (list(c) for c in zip(*held))
            return _slice(number, m_held, pa.concat_arrays(docs), np.concatenate(sizes), np.concatenate(terms), np.concatenate(tfs))

        for batch in batches:
            m = batch.column("m").to_numpy()
            docs, col, tf_col = batch.column("doc_id"), batch.column("terms"), batch.column("tfs")
            at = col.offsets.to_numpy().astype(np.int64)
            terms, tfs = col.values.to_numpy(), tf_col.values.to_numpy()
            i = 0
            while i < len(m):
                if held and (m[i] != m_held or postings >= most):
                    done.append(close())
                    done_postings += postings
                    number, held, postings = number + 1, [], 0
                    if done_postings >= most:
                        yield _index(done)
                        done, done_postings = [], 0
                m_held = int(m[i])
                end = int(np.searchsorted(m, m[i], "right"))
                end = min(end, max(i + 1, int(np.searchsorted(at, at[i] + most - postings, "right")) - 1))
                held.append((docs.slice(i, end - i), np.diff(at[i : end + 1]), terms[at[i] : at[end]], tfs[at[i] : at[end]]))
                postings += int(at[end] - at[i])
                i = end
        if held:
            done.append(close())
        if done:
            yield _index(done)

    return run


def _seeds(sent):
    """(item, bound, slice): for each item the slice of the task with the greatest bound."""

    def run(batches):
        items = sent.value
        best = np.zeros(len(items.ids), np.int64)
        where = np.zeros(len(items.ids), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                bound = items.bounds(_ints(batch.column("terms"), i), impact(_ints(batch.column("tops"), i), batch.column("m")[i].as_py()))
                more = bound > best
                best[more], where[more] = bound[more], batch.column("slice")[i].as_py()
        got = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(best[got]), pa.array(where[got])], ["item", "bound", "slice"])

    return run


def _search(sent, top: int):
    """(item, doc_id, score): the best documents of each item within a task; a batch's slices are visited in the order of their bounds."""

    def run(batches):
        items = sent.value
        n = len(items.ids)
        least = items.least.copy()
        scores, docs = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        for batch in batches:
            slices, bounds = [], np.zeros((batch.num_rows, n), np.int64)
            for i in range(batch.num_rows):
                terms, tops, run_term, run_tf, run_end, places = (_ints(batch.column(c), i) for c in ("terms", "tops", "run_term", "run_tf", "run_end", "places"))
                m = batch.column("m")[i].as_py()
                bounds[i] = items.bounds(terms, impact(tops, m))
                tf, which = np.unique(run_tf, return_inverse=True)
                gain = impact(tf, m)[which] * items.weights[run_term]  # an impact once for each tf of the stratum
                begin = np.concatenate([[0], run_end[:-1]]).astype(np.int64)
                slices.append((run_term, gain, begin, run_end - begin, places, batch.column("docs")[i].values.fill_null(int(_LAST)).to_numpy()))
            for j in np.flatnonzero((bounds >= least).any(0)):
                for i in np.argsort(-bounds[:, j], kind="stable"):
                    if bounds[i, j] < least[j]:
                        break
                    run_term, gain, begin, size, places, ids = slices[i]
                    lo, hi = np.searchsorted(run_term, items.terms[j]), np.searchsorted(run_term, items.terms[j], "right")
                    runs = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
                    length = size[runs]
                    at = np.repeat(begin[runs] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                    score = np.zeros(len(ids), np.int64)
                    np.add.at(score, places[at], np.repeat(gain[runs], length))
                    good = np.flatnonzero(score >= least[j])
                    s, d = np.concatenate([scores[j], score[good]]), np.concatenate([docs[j], ids[good]])
                    keep = np.lexsort((d, -s))[:top]
                    scores[j], docs[j] = s[keep], d[keep]
                    if len(keep) == top:
                        least[j] = max(least[j], s[keep][-1])
        s, d = np.concatenate([*scores, np.zeros(0, np.int64)]), np.concatenate([*docs, np.zeros(0, np.int64)])
        item = np.repeat(np.arange(n), [len(x) for x in scores])
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int64)), pa.array(d, mask=d == _LAST), pa.array(s)], ["item", "doc_id", "score"])

    return run


def build(docs: DataFrame, items: Items, most: int = SLICE_POSTINGS) -> DataFrame:
    """The index of all docs for the vocabulary of some items, written in the shared folder, a row for each slice of a stratum (INDEX); sets the items' weights.

    N counts the rows with a term, L their terms. A slice has the documents of one m; `terms` and `tops` are its
    terms and their largest tf. Runs of postings of one term and tf end at run_end in places, which are
    places in docs. Large strata are cut by doc_id into slices over many tasks.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(items)
    vectors = save(in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _vectors(sent), "doc_id long, n long, terms array<int>, tfs array<int>"), "vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(items.vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # a row for each term of the vocabulary at most
        df[r.term] = r.df
    items.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    m = F.expr(f"10 + (90 * n * {n_docs}L) div {n_terms or 1}L")
    parts = partitions(spark)
    return save(in_arrow(vectors.withColumn("m", m).repartitionByRange(parts, "m", "doc_id").sortWithinPartitions("m", "doc_id"), _strata(most), INDEX), "strata")


def search(index: DataFrame, items: Items, top: int = TOP) -> DataFrame:
    """(item, doc_id, score, rank) of an index and the items it was built for; item is the place in items.ids.

    First the slice of the greatest bound for each item is searched, for scores below which no other slice is
    visited then; of these slices there are as many as items at most.
    """
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(items)
    seeds = in_arrow(index.select("slice", "m", "terms", "tops"), _seeds(sent), "item long, bound long, slice long")
    first = [r.slice for r in seeds.groupBy("item").agg(F.max_by("slice", F.struct("bound", "slice")).alias("slice")).select("slice").distinct().collect()]
    if first:
        chosen = F.broadcast(spark.createDataFrame([(x,) for x in first], "slice long"))
        found = in_arrow(index.join(chosen, "slice", "left_semi"), _search(sent, top), "item long, doc_id long, score long")
        w = Window.partitionBy("item").orderBy(F.col("score").desc())
        for r in found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") == top).collect():
            items.least[r.item] = max(r.score, 1)
    again = spark.sparkContext.broadcast(items)
    every = in_arrow(index, _search(again, top), "item long, doc_id long, score long")
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def best(docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its `top` documents of the highest score above 0, equal scores by ascending doc_id.

    Null texts have no terms; documents without any don't count. Repeated rows of docs are documents each; a row
    without doc_id (or with 2^63 - 1) ranks behind equal scores and has a null doc_id. Rows of one item_id (null is one) are one
    item with all their terms; items without terms have no rows. No documents or no items give none. Other columns
    don't matter. Terms are told apart by 64 bits of hash. Items of more than item_bytes of text are searched for in
    several turns, each with an index of its own.
    """
    spark = docs.sparkSession
    items = items.select("item_id", "text")
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    turns = max(1, -(-(items.agg(F.sum(size)).first()[0] or 0) // item_bytes))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(turns):
        mine = Items.of([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == k).collect()])
        if not mine.ids:
            continue
        found = search(build(docs, mine), mine, top)
        names = spark.createDataFrame(list(enumerate(mine.ids)), "item long, item_id long")  # as many as items of a turn
        out = out.unionByName(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
