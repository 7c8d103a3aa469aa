"""Benchmark decontamination: every passage of the corpus queries a BM25 index of the test items.

Passages are windows of twice the longest item's words, half overlapping, so that any item that a text
holds lies in one of them whole. An item's impacts are its BM25 term scores divided by their sum, so a
score of 1 means that the passage has all the item's terms. Block-max WAND retrieves every item that
scores at least LEAST_SCORE. Before it, one pass over all passages adds up the impacts from the shorter
posting lists and the most that the longer ones can add to an item; WAND is run for those passages alone
where that bound reaches the threshold, which loses none. Retrieved items are verified: enough word
5-grams of the question (the item without its last sentence) and of the answer (that sentence) have to
stand in the passage.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.llm import text
from motifmill.llm.shared import in_arrow, save

K1, B = 1.2, 0.75
LEAST_SCORE = 0.6
LEAST_OVERLAP = 0.8
GRAM = 5
#: Items in a block with its own maxima.
BLOCK = 8
#: Text of an index that is sent to the executors at most; more items are indexed and queried in several turns.
INDEX_BYTES = 64 << 20
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def _hashed(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, at, h in text.words(pa.array([t.lower() for t in texts], pa.string()), lower=True, gaps=text.PUNCTUATION):
        out += [h[a:b] for a, b in zip(at[:-1], at[1:])]
    return out


def split_item(item: str) -> tuple[str, str]:
    """Question and answer: the last sentence is the answer; an item of one sentence is cut after two thirds of its words."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", item.strip()) if s]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    words = item.split()
    cut = -(-2 * len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _grams(h: np.ndarray, k: int = GRAM) -> np.ndarray:
    return text.shingles(np.array([0, len(h)]), h, k)[1]


def _share(part: np.ndarray, words: np.ndarray) -> float:
    """The share of a part's distinct k-grams that stand in words; a part shorter than k is one gram of all its words."""
    if not len(part):
        return 1.0
    k = min(GRAM, len(part))
    if len(words) < k:
        return 0.0
    want = np.unique(_grams(part, k))
    return float(np.isin(want, _grams(words, k)).mean())


@dataclass
class Whole:
    """Over all items: their number, mean and greatest number of words, and how many items have each of some terms (sorted)."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray
    frequencies: np.ndarray


class Index:
    """Posting lists of impacts by term, with their block maxima."""

    def __init__(self, items: list[tuple[int, str]], least_score: float = LEAST_SCORE, whole: Whole | None = None):
        """whole: what is counted over all items, if these aren't all."""
        items = sorted((i, t or "") for i, t in items)
        self.least = least_score
        hashed = _hashed([t for _, t in items])
        keep = [k for k, h in enumerate(hashed) if len(h)]  # an item without words can't leak
        self.ids = [items[k][0] for k in keep]
        hashed = [hashed[k] for k in keep]
        parts = [split_item(items[k][1]) for k in keep]
        self.question, self.answer = _hashed([q for q, _ in parts]), _hashed([a for _, a in parts])
        self.n = len(keep)
        lens = np.array([len(h) for h in hashed])
        self.terms = np.unique(np.concatenate(hashed)) if self.n else np.zeros(0, text.U64)
        rows = []
        df = np.zeros(len(self.terms), np.int64)
        for k, h in enumerate(hashed):
            t, tf = np.unique(np.searchsorted(self.terms, h), return_counts=True)
            df[t] += 1
            rows.append((t, np.full(len(t), k), tf))
        if whole is None:
            whole = Whole(self.n, lens.mean() if self.n else 1.0, max(lens.tolist(), default=1), self.terms, df)
        self.stride = whole.longest
        df = whole.frequencies[np.searchsorted(whole.terms, self.terms)]
        idf = np.log(1 + (whole.n - df + 0.5) / (df + 0.5))
        postings = []
        for t, k, tf in rows:
            s = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[k] / whole.mean))
            postings.append((t, k, s / s.sum()))
        t, k, s = (np.concatenate([p[i] for p in postings]) if postings else np.zeros(0) for i in range(3))
        order = np.lexsort((k, t))
        t, self.item, self.impact = t[order].astype(np.int64), k[order].astype(np.int64), s[order]
        self.ptr = np.searchsorted(t, np.arange(len(self.terms) + 1))
        # block maxima: of each list's postings in each block of items that it reaches
        block = t * (self.n // BLOCK + 1) + self.item // BLOCK
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
        self.block_no = (self.item // BLOCK)[first]
        self.block_max = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        self.block_ptr = np.searchsorted(t[first] if len(first) else np.zeros(0), np.arange(len(self.terms) + 1))
        self.list_max = np.maximum.reduceat(self.impact, self.ptr[:-1]) if len(self.terms) else np.zeros(0)
        # the longest lists, as long as no item can reach the threshold by them alone
        self.rest = np.zeros(self.n)
        self.essential = np.ones(len(self.terms), bool)
        for term in np.argsort(-np.diff(self.ptr), kind="stable"):
            s = slice(self.ptr[term], self.ptr[term + 1])
            if s.stop - s.start < 2 or (self.rest[self.item[s]] + self.impact[s] >= 0.75 * least_score).any():
                break
            self.rest[self.item[s]] += self.impact[s]
            self.essential[term] = False

    def wand(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All items that score at least the threshold for a passage with these distinct terms, by block-max WAND."""
        lists = [[int(self.ptr[t]), int(t)] for t in terms]  # place in the list, term
        found = []
        end = self.ptr[1:]
        while lists:
            lists.sort(key=lambda x: self.item[x[0]])
            bound, pivot = 0.0, -1
            for i, (_, t) in enumerate(lists):
                bound += self.list_max[t]
                if bound >= self.least - 1e-12:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = int(self.item[lists[pivot][0]])
            while pivot + 1 < len(lists) and self.item[lists[pivot + 1][0]] == item:
                pivot += 1
            block = item // BLOCK
            bound = 0.0
            for _, t in lists[: pivot + 1]:
                a, b = self.block_ptr[t], self.block_ptr[t + 1]
                i = a + int(np.searchsorted(self.block_no[a:b], block))
                bound += self.block_max[i] if i < b and self.block_no[i] == block else 0.0
            if bound >= self.least - 1e-12:
                if self.item[lists[0][0]] == item:
                    score = sum(float(self.impact[p]) for p, _ in lists[: pivot + 1])
                    if score >= self.least - 1e-12:
                        found.append((item, score))
                    after = item + 1
                else:
                    after = item
            else:  # on to the next block, or to the next list's item if that comes first
                after = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    after = max(item + 1, min(after, int(self.item[lists[pivot + 1][0]])))
            for x in lists[: pivot + 1]:
                x[0] += int(np.searchsorted(self.item[x[0] : end[x[1]]], after))
            lists = [x for x in lists if x[0] < end[x[1]]]
        return found

    def candidates(self, offsets: np.ndarray, h: np.ndarray):
        """(row, window) pairs of texts whose bound reaches the threshold, from word hashes."""
        term = np.searchsorted(self.terms, h)
        term[term == len(self.terms)] = 0
        place = np.flatnonzero(self.terms[term] == h)
        term = term[place]
        some = self.essential[term]
        p, t = place[some], term[some]
        row = np.searchsorted(offsets, p, "right") - 1
        at = (p - offsets[row]) // self.stride
        # a word lies in the windows that begin with its stride and the one before
        wide = int(np.max(np.diff(offsets)) // self.stride) + 2 if len(offsets) > 1 else 1
        key = row * wide + at
        key, t = np.concatenate([key, key[at > 0] - 1]), np.concatenate([t, t[at > 0]])
        pairs = np.unique(key * len(self.terms) + t)
        key, t = pairs // len(self.terms), pairs % len(self.terms)
        size = self.ptr[t + 1] - self.ptr[t]
        post = np.repeat(self.ptr[t] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        key = np.repeat(key, size) * self.n + self.item[post]
        if not len(key):
            return []
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        bound = np.add.reduceat(self.impact[post][order], first) + self.rest[key[first] % self.n]
        window = np.unique(key[first][bound >= self.least - 1e-9] // self.n)
        return [(int(w // wide), int(w % wide)) for w in window]


def _found(index: Index, col: pa.Array, least_overlap: float) -> list[tuple]:
    """(row, item number, score, question and answer overlap, first word) of each row's verified items."""
    out: list[tuple] = []
    for first, offsets, h in text.words(col, lower=True, gaps=text.PUNCTUATION) if index.n else ():
        best: dict[tuple[int, int], tuple] = {}
        for row, w in index.candidates(offsets, h):
            a = offsets[row] + w * index.stride
            passage = h[a : min(a + 2 * index.stride, offsets[row + 1])]
            t = np.searchsorted(index.terms, passage)
            t[t == len(index.terms)] = 0
            for item, score in index.wand(np.unique(t[index.terms[t] == passage])):
                q, r = _share(index.question[item], passage), _share(index.answer[item], passage)
                if q >= least_overlap and r >= least_overlap and ((row, item) not in best or best[row, item][0] < score):
                    best[row, item] = (score, q, r, w * index.stride)
        out += [(first + row, item, *v) for (row, item), v in best.items()]
    return out


def _query(sent, least_overlap: float):
    def run(batches):
        index: Index = sent.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = [(ids[row], index.ids[item], *v) for row, item, *v in _found(index, text.column(batch, "text"), least_overlap)]
            cols = list(zip(*out)) if out else [()] * 6
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

    return run


def _clean(sent, least_overlap: float):
    """Rows (row, low) without those whose text holds an item."""

    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[x[0] for x in _found(sent.value, text.column(batch, "low"), least_overlap)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _item_words(batches):
    """(low) to rows (word, n_words): each item's distinct words, and one row with its number of words."""
    for batch in batches:
        words, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, at, h in text.words(text.column(batch, "low"), lower=True, gaps=text.PUNCTUATION):
            words += [np.unique(h[a:b]).view(np.int64) for a, b in zip(at[:-1], at[1:])]
            sizes.append(np.diff(at)[np.diff(at) > 0])
        w, n = np.concatenate(words), np.concatenate(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([*[None] * len(n)], pa.int64()), pa.array(n)], ["word", "n_words"])
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array([*[None] * len(w)], pa.int64())], ["word", "n_words"])


def _turns(items: DataFrame, least_score: float, most: int):
    """Indexes of the items in parts of bounded text, each collected on its own; frequencies and lengths are those of all items."""
    items = items.select("item_id", "text").where("item_id is not null")
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    turns = max(1, -(-(items.agg(F.sum(size)).first()[0] or 0) // most))
    if turns == 1:
        yield Index([tuple(r) for r in items.collect()], least_score)
        return
    rows = lambda d: in_arrow(d.select(F.lower("text").alias("low")), _item_words, "word long, n_words long")
    every = save(rows(items), "item_words")
    n, mean, longest = every.agg(F.count("n_words"), F.avg("n_words"), F.max("n_words")).first()
    df = save(every.where("word is not null").groupBy("word").agg(F.count("*").alias("df")), "frequencies")
    for k in range(turns):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == k)
        mine = df.join(rows(part).where("word is not null").select("word").distinct(), "word").collect()  # of this part's words
        terms = np.array([r.word for r in mine], np.int64).view(text.U64)
        order = np.argsort(terms)
        yield Index([tuple(r) for r in part.collect()], least_score, Whole(n, mean or 1.0, longest or 1, terms[order], np.array([r.df for r in mine], np.int64)[order]))


def leaks(docs: DataFrame, items: DataFrame, least_score: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per row of docs and item that it holds: doc_id, item_id, score, question_overlap, answer_overlap, first_word.

    Words are runs of 0-9, a-z and non-ASCII characters in the lower-cased text. first_word: where the
    best passage begins, counted in words. Items without words or without item_id are left out; texts
    that are null or empty hold none. Items of more than index_bytes of text are indexed in several turns,
    which gives the same rows, as frequencies, lengths and passages are those of all items. Repeated rows: each;
    an item_id that several items have is told of each. No rows or no items give no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    out = None
    for index in _turns(items, least_score, index_bytes):
        sent = spark.sparkContext.broadcast(index)
        found = in_arrow(d, _query(sent, least_overlap), SCHEMA)
        out = found if out is None else out.union(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, least_score: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of docs whose text holds no item, in one pass without a shuffle (one for each turn of `leaks`).

    Null and empty texts hold none and stay, repeated rows stay or go together, columns are those of docs
    whatever their names; without items all rows stay.
    """
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.lower("text").alias("low"))
    for index in _turns(items, least_score, index_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        d = in_arrow(d, _clean(sent, least_overlap), d.schema)
    return d.select("row.*")
