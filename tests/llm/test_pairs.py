import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from motifmill.llm import bm25, chaining, chosenpath, shared, text
from tests.llm.fixtures import documents, frame, grams, prose, words


def similar_rows(rows, least=0.8):
    sets = [grams(r[1]) for r in rows]
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i < j and a and b and len(a & b) >= least * len(a | b) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    return links


def classes_of(rows, links):
    root = {}
    for i in range(len(rows)):
        if i not in root:
            stack, members = [i], {i}
            while stack:
                for y in links[stack.pop()] - members:
                    members.add(y)
                    stack.append(y)
            ids = [rows[m][0] for m in members if rows[m][0] is not None]
            for m in members:
                root[m] = min(ids) if ids else None
    return root


@pytest.mark.parametrize("side, large", [(1024, 64), (3, 2)])
def test_join_against_brute_force(spark, monkeypatch, side, large):
    """The small sizes make large buckets and classes of several blocks of what is one block otherwise."""
    monkeypatch.setattr(chosenpath, "LARGE", large)
    rows = documents()
    base = prose(90, 7).split()
    r = random.Random(4)
    for i in range(24):  # a group of near copies that differ, some of them from some by too much
        w = list(base)
        for k in range(1 + i % 3):
            w[r.randrange(90)] = f"w{i}.{k}"
        rows.append((100 + i, " ".join(w), *rows[0][2:]))
    links = similar_rows(rows)
    root = classes_of(rows, links)
    want = sorted((str(r[0]), str(root[i]), len(links[i])) for i, r in enumerate(rows))
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in chosenpath.classes(frame(spark, rows), side=side).collect())
    assert got == want
    assert any(n > 2 for _, _, n in want)


def test_rows_grow_with_the_sets_and_not_with_their_pairs(spark):
    """Edges of a group of alike signatures, of many blocks."""
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 32, chosenpath.COORDS, np.uint32)
    rows = []
    for i in range(300):
        sig = base.copy()
        sig[r.integers(0, chosenpath.COORDS, 4)] = r.integers(0, 1 << 32, 4, np.uint32)
        rows.append((i, bytearray(sig.tobytes())))
    sets = spark.createDataFrame(rows, "set_id long, sig binary")
    got = chosenpath.proposed_classes(sets, side=10)
    assert {r.set_id for r in got.collect()} == set(range(300)) and got.select("root").distinct().count() == 1
    groups = [("bucket", k, 0, i, bytes(rows[i][1])) for k in range(30) for i in sorted({*range(10), *range(10 * k, 10 * k + 10)})]
    batch = pa.RecordBatch.from_pylist([dict(zip(("bucket", "at", "m", "set_id", "sig"), (1, *g[1:]))) for g in groups])
    assert sum(b.num_rows for b in chosenpath._proposals(0.625)([batch])) <= len(groups)


def test_runs_reach_the_recall():
    """Splits of random signatures, as `missed` reckons them."""
    r = np.random.default_rng(2)
    rate, agree, trials = 1 / 51.2, 51, 4000
    met = 0
    for _ in range(trials):
        paths = 1
        for _ in range(chosenpath.DEPTH):
            paths = r.binomial(agree * paths, rate)
        met += paths > 0
    assert 1 - met / trials == pytest.approx(chosenpath.missed(agree, rate), abs=0.03)
    assert chosenpath.runs_needed(0.999) > chosenpath.runs_needed(0.9)


def test_blocks_share_n_grams():
    r = np.random.default_rng(3)
    a, b = ([np.unique(r.integers(0, 40, r.integers(1, 30)).astype(np.uint64)) for _ in range(n)] for n in (5, 7))
    size = lambda x: np.array([len(s) for s in x])
    got = chosenpath._shared(size(a), np.concatenate(a), size(b), np.concatenate(b))
    assert got.tolist() == [[len(set(x) & set(y)) for y in b] for x in a]


def test_one_of_each(spark):
    rows = documents()
    root = classes_of(rows, similar_rows(rows))
    kept = chosenpath.one_of_each(frame(spark))
    assert kept.columns == frame(spark).columns
    got = kept.collect()
    # as many with words as there are classes, and every row without words
    empty = [r for r in rows if not words(r[1])]
    assert len(got) == len({(root[i], None if root[i] is not None else r[1]) for i, r in enumerate(rows) if words(r[1])}) + len(empty)
    assert chosenpath.one_of_each(frame(spark, [])).count() == 0
    assert chosenpath.join(frame(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.id: r.root for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == got[101] == 100


def chain_score(x, y, cost=chaining.GAP_COST):
    order = sorted(range(len(x)), key=lambda i: (x[i], -y[i]))
    best = {}
    for i in order:
        before = [best[j] - cost * (x[i] - x[j] + y[i] - y[j]) for j in best if x[j] < x[i] and y[j] < y[i]]
        best[i] = 1 + max([0, *before])
    return max(best.values())


def test_fenwick_chains_score_as_all_pairs_do():
    r = np.random.default_rng(2)
    for _ in range(40):
        n = r.integers(2, 30)
        x, y = r.integers(0, 40, n), r.integers(0, 40, n)
        xy = np.unique(np.stack([x, y], 1), axis=0)
        x, y = xy[:, 0], xy[:, 1]
        found = chaining.chains(x, y, least=1)
        c = found[0]
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:]))
        got = len(c) - chaining.GAP_COST * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(c, c[1:]))
        assert got == pytest.approx(chain_score(x.tolist(), y.tolist()))
        assert sorted(i for c in found for i in c) == list(range(len(x)))


def test_near_matches_are_one_chain_without_a_tree():
    """Groups that are chained at once have the chains that the tree gives."""
    r = np.random.default_rng(5)
    rows = []
    for pair in range(60):
        x = np.cumsum(r.integers(1, 14, r.integers(1, 9)))
        y = x + 40 + np.cumsum(r.integers(-2, 3, len(x))) * (pair % 2) + (300 * (np.arange(len(x)) > 3) if pair % 5 == 0 else 0)
        rows += sorted((100 + pair, pair, int(a), int(b)) for a, b in zip(x, y))
    cols = [pa.array(c) for c in zip(*rows)]
    batch = pa.RecordBatch.from_arrays(cols, ["doc_id", "other_id", "place", "other_place"])
    got = sorted(tuple(v) for out in chaining._chained([batch.slice(0, 77), batch.slice(77)]) for v in zip(*[c.to_pylist() for c in out.columns]))
    want = []
    for pair in range(60):
        g = np.array([row for row in rows if row[1] == pair])
        for chain in chaining.chains(g[:, 2], g[:, 3]):
            c = g[chain]
            step = np.diff(c[:, 2:], axis=0)
            for part in np.split(c, np.flatnonzero((np.abs(step[:, 0] - step[:, 1]) > chaining.BAND) | (step[:, 0] > chaining.FLANK)) + 1):
                want.append((100 + pair, pair, part[0, 2], part[-1, 2] + chaining.GRAM, part[0, 3], part[-1, 3] + chaining.GRAM))
    assert got == sorted(map(tuple, (map(int, w) for w in want)))


def test_alignment_goes_over_edits():
    a = np.arange(100, 200).astype("<u2")
    b = np.concatenate([a[:30], [7, 8], a[30:60], a[61:80], [9], a[81:]]).astype("<u2")
    s, e, t, f, equal = chaining.align(a.tolist(), b.tolist(), 10, 10)
    assert (s, e, t, f, equal) == (0, 100, 0, 101, 98)


def test_passages(spark):
    found = chaining.passages(frame(spark)).collect()
    best = {(r.doc_id, r.other_id): r for r in found}
    assert best[24, 3].n_equal == len(words(documents()[3][1])) and best[24, 3].identity == 1
    assert best[25, 5].identity > 0.95
    p = best[26, 7]
    assert p.first_word <= 42 and p.last_word >= 102 and p.other_first <= 12 and p.other_last >= 72
    assert all(r.other_id < r.doc_id for r in found)
    clean = {r.doc_id for r in found} & {0, 1, 2, 4, 6, 8}
    assert not clean
    assert chaining.passages(frame(spark, [])).count() == 0


def test_passage_whose_seeds_were_seen_in_other_documents(spark):
    shared = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(50):  # each has a part of the passage that is too short to be one
        rows.append((i, " ".join([f"a{i}x{j}" for j in range(30)] + shared[i : i + 12] + [f"b{i}x{j}" for j in range(30)]), *documents()[0][2:]))
    for i in (60, 70, 80):
        rows.append((i, " ".join([f"a{i}x{j}" for j in range(40)] + shared + [f"b{i}x{j}" for j in range(40)]), *documents()[0][2:]))
    got = {(r.doc_id, r.other_id, r.first_word, r.last_word, r.n_equal) for r in chaining.passages(frame(spark, rows)).collect()}
    assert got == {(70, 60, 40, 99, 60), (80, 60, 40, 99, 60), (80, 70, 40, 99, 60)}


def test_links_with_the_document_before(monkeypatch):
    import pyspark

    r = np.random.default_rng(3)
    rows = sorted({(int(r.integers(0, 4)), int(r.integers(0, 6)), int(r.integers(0, 5))) for _ in range(70)})
    of = {s: min(x[1:] for x in rows if x[0] == s) for s, _, _ in rows}
    want = set()
    for s, d, p in rows:
        before = [x[1:] for x in rows if x[0] == s and x[1] < d]
        if before:
            want |= {(s, d, p, *of[s])} | ({(s, d, p, *max(before))} if max(before)[0] != of[s][0] else set())
    for cuts in ([], [20], [1, 2, 3, 4, 5, 6, 30, 31, 32], list(range(1, len(rows)))):
        found, tails = [], []
        for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
            monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls, part=part: type("T", (), {"partitionId": lambda self: part})()))
            batches = [pa.table({k: [x[i] for x in rows[c : min(c + 3, b)]] for i, k in enumerate(("seed", "doc_id", "place"))} | {k: [of[x[0]][i] for x in rows[c : min(c + 3, b)]] for i, k in enumerate(("other_id", "other_place"))}).to_batches()[0] for c in range(a, b, 3)]
            found += [x for out in chaining._links(iter(batches)) for x in out.to_pylist()]
        tails = [tuple(x[k] for k in ("part", "seed", "doc_id", "place", "other_id", "other_place")) for x in found if x["kind"] == 2]
        got = {(x["seed"], x["doc_id"], x["place"], x["other_id"], x["other_place"]) for x in found if x["kind"] == 0}
        left = chaining.carried(tails)
        for x in found:
            if x["kind"] == 1:
                prev = [t[2:] for t in left if t[:2] == (x["part"], x["seed"]) and t[2] < x["doc_id"] and t[2] != x["other_id"]]
                got |= {(x["seed"], x["doc_id"], x["place"], *max(prev))} if prev else set()
        assert got == want


def test_alignment_ends_with_its_passage():
    a, b = np.arange(300).astype("<u2"), np.arange(1000, 1300).astype("<u2")
    b[100:140] = a[100:140]
    for i in range(150, 290, 20):  # a few equal words here and there
        b[i : i + 3] = a[i : i + 3]
    assert chaining.align(a.tolist(), b.tolist(), 110, 110) == (100, 140, 100, 140, 40)


def test_wand_finds_what_scoring_all_finds():
    items = [(i, prose(20 + i % 30, 500 + i, 150)) for i in range(60)]
    index = bm25.Index(items, 0.3)
    r = random.Random(1)
    for k in range(60):
        w = prose(40, 900 + k, 150).split() + items[k][1].split()[: r.randrange(5, 20)]
        h = bm25._hashed([" ".join(w)])[0]
        t = np.searchsorted(index.terms, h).clip(0, len(index.terms) - 1)
        t = np.unique(t[index.terms[t] == h])
        score = np.zeros(index.n)
        for term in t:
            s = slice(index.ptr[term], index.ptr[term + 1])
            score[index.item[s]] += index.impact[s]
        got = dict(index.wand(t))
        assert set(got) == set(np.flatnonzero(score >= 0.3 - 1e-12)) and all(v == pytest.approx(score[i]) for i, v in got.items())


def test_bound_loses_no_passage():
    items = [(i, prose(20 + i % 30, 500 + i, 150)) for i in range(60)]
    index = bm25.Index(items, 0.5)
    docs = pa.array([" ".join(prose(200, 700 + k, 150).split()[: 60 + k] + items[k][1].split() + prose(50, 800 + k).split()) for k in range(60)])
    for _, offsets, h in bm25.text.words(docs, lower=True, gaps=bm25.text.PUNCTUATION):
        found = set(index.candidates(offsets, h))
        for row in range(len(offsets) - 1):
            doc = h[offsets[row] : offsets[row + 1]]
            for w in range((len(doc) - 1) // index.stride + 1):
                p = doc[w * index.stride : (w + 2) * index.stride]
                t = np.searchsorted(index.terms, p).clip(0, len(index.terms) - 1)
                if index.wand(np.unique(t[index.terms[t] == p])):
                    assert (row, w) in found


def bench_items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks(spark):
    items = [(0, prose(30, 300)), (1, prose(40, 301) + " Answer here now."), (2, None), (3, ""), (None, prose(30, 302))]
    rows = documents()
    rows.append((200, prose(70, 310) + " " + items[0][1].upper() + " " + prose(500, 311), *rows[0][2:]))
    rows.append((201, items[1][1], *rows[0][2:]))
    rows.append((202, " ".join(items[1][1].split()[:25]), *rows[0][2:]))
    rows.append((203, prose(900, 320) + " " + items[0][1] + " " + items[1][1] + " " + prose(30, 321), *rows[0][2:]))
    seen = []
    for size in (1 << 20, 100):
        found = bm25.leaks(frame(spark, rows), bench_items(spark, items), index_bytes=size).collect()
        assert {(r.doc_id, r.item_id) for r in found} == {(200, 0), (201, 1), (203, 0), (203, 1)}
        # scores and passages are those of one index, whatever the number of turns
        seen.append(sorted((r.doc_id, r.item_id, round(r.score, 12), r.question_overlap, r.answer_overlap, r.first_word) for r in found))
        assert seen[0] == seen[-1]
        clean = bm25.without_leaks(frame(spark, rows), bench_items(spark, items), index_bytes=size)
        assert clean.columns == frame(spark, rows).columns and clean.count() == len(rows) - 3
    assert bm25.leaks(frame(spark, []), bench_items(spark, items)).count() == 0
    assert bm25.leaks(frame(spark, rows), bench_items(spark, [])).count() == 0


def linked(rows, by):
    """Sets of documents that rows link, directly or through others."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in rows:
        root[find(r.doc_id)] = find(r.other_id)
    return {x: find(x) for x in by}


def test_shorter_copies_on_both_sides_hide_no_passage(spark):
    """Documents 11 and 22 hold the same 60 words; ten before and ten in between hold 18 of them each."""
    r = random.Random(3)
    shared = [f"p{i}" for i in range(60)]
    noise = lambda n: [f"n{r.randrange(10**9)}" for _ in range(n)]
    docs = {}
    for i in range(10):
        at = 42 * i // 9
        docs[i + 1], docs[i + 12] = (noise(40) + shared[at : at + 18] + noise(40) for _ in range(2))
    docs[11], docs[22] = noise(30) + shared + noise(50), noise(70) + shared
    rows = [(i, " ".join(w), "en", "s", 0, 1.0, 7, "r", 3, "p", True) for i, w in docs.items()]
    got = [(x.doc_id, x.first_word, x.last_word, x.other_id, x.other_first, x.other_last, x.n_equal) for x in chaining.passages(frame(spark, rows)).collect()]
    assert got == [(22, 70, 129, 11, 30, 89, 60)]


def test_every_shared_run_of_51_words_is_linked(spark):
    """All rows of small corpora of overlapping passages: against all pairs of documents with 51 equal words in a row."""
    for seed in range(2):
        r = random.Random(seed)
        pool = [f"w{i}" for i in range(400)]
        docs = {}
        for i in range(60):
            out = []
            for _ in range(r.randrange(1, 4)):
                at, n = r.randrange(340), r.choice([12, 20, 28, 35, 51, 60, 90])
                out += pool[at : at + n] + [f"x{r.randrange(10**9)}" for _ in range(r.randrange(3, 30))]
            docs[i] = out
        runs = {i: {tuple(w[k : k + 51]) for k in range(len(w) - 50)} for i, w in docs.items()}
        short = {i: {tuple(w[k : k + 30]) for k in range(len(w) - 29)} for i, w in docs.items()}
        rows = chaining.passages(frame(spark, [(i, " ".join(w), "en", "s", 0, 1.0, 7, "r", 3, "p", True) for i, w in docs.items()])).collect()
        member = linked(rows, docs)
        pairs = [(a, b) for a in docs for b in docs if b < a and runs[a] & runs[b]]
        assert len(pairs) > 50 and all(member[a] == member[b] for a, b in pairs)
        for x in rows:  # and every row is a passage
            a, b = docs[x.doc_id][x.first_word : x.last_word + 1], docs[x.other_id][x.other_first : x.other_last + 1]
            assert x.n_equal >= 30 and x.identity >= 0.8 and x.other_id < x.doc_id and a[0] == b[0] and a[-1] == b[-1]
            if a == b:
                assert x.n_equal == len(a) and short[x.doc_id] & short[x.other_id]


def test_every_window_of_30_words_is_matched_with_its_first_holder(spark):
    """Runs of 30 words and more, whose parts other documents hold too: each window against its first holder by brute force."""
    r = random.Random(8)
    pool = [f"w{i}" for i in range(300)]
    docs = {}
    for i in range(60):
        out = []
        for _ in range(r.randrange(1, 4)):
            at, n = r.randrange(250), r.choice([12, 18, 24, 29, 30, 31, 36, 45])
            out += pool[at : at + n] + [f"x{r.randrange(10**9)}" for _ in range(r.randrange(0, 30))]
        docs[i] = out
    docs[60] = pool[:40] + docs[59] + ["and"] * 70  # the same word again and again
    docs[61] = ["and"] * 45 + docs[60]
    rows = chaining.passages(frame(spark, [(i, " ".join(w), "en", "s", 0, 1.0, 7, "r", 3, "p", True) for i, w in docs.items()])).collect()
    found = defaultdict(list)
    for x in rows:
        found[x.doc_id, x.other_id].append((x.first_word, x.last_word))
    holder, n = {}, 0
    for i, w in docs.items():
        for at in range(len(w) - 29):
            first = holder.setdefault(tuple(w[at : at + 30]), i)
            if first != i:
                n += 1
                assert any(a <= at and at + 29 <= b for a, b in found[i, first]), (i, at, first)
    assert n > 300 and len(rows) == len(set(rows))


def edited(words, r, every):
    """words with a new one in place of one of every so many."""
    return [f"y{r.randrange(10**9)}" if k % every == every // 2 else w for k, w in enumerate(words)]


def test_other_holders_hide_no_edited_passage(spark):
    """Documents 11 and 22 hold a passage of runs of 11 words between edits; those before and in between hold each of its runs alone."""
    r = random.Random(4)
    noise = lambda n: [f"n{r.randrange(10**9)}" for _ in range(n)]
    pool = [f"p{i}" for i in range(72)]
    docs = {11: noise(20) + edited(pool, r, 12) + noise(25), 22: noise(30) + edited(pool, r, 12)}
    for i in range(10):
        docs[i + 1], docs[i + 12] = (noise(20) + pool[6 * i : 6 * i + 18] + noise(20) for _ in range(2))
    rows = [(i, " ".join(w), "en", "s", 0, 1.0, 7, "r", 3, "p", True) for i, w in docs.items()]
    got = chaining.passages(frame(spark, rows)).collect()
    assert any(x.first_word <= 36 and x.last_word >= 95 and x.n_equal >= 60 for x in got if (x.doc_id, x.other_id) == (22, 11))


@pytest.mark.parametrize("block, at_once", [(1 << 14, 1 << 15), (8, 16)])
def test_every_edited_passage_is_linked(spark, monkeypatch, block, at_once):
    """Every pair of documents with a passage around a seed, of all pairs of its holders: a row of the two, or windows of 30 words that both have."""
    monkeypatch.setattr(chaining, "BLOCK", block)
    monkeypatch.setattr(chaining, "AT_ONCE", at_once)
    monkeypatch.setattr(chaining, "SMALL", 4)
    r = random.Random(block)
    pool = [f"w{i}" for i in range(120)]
    docs = {}
    for i in range(60):
        out = []
        for _ in range(r.randrange(1, 3)):
            at, n = r.randrange(80), r.choice([12, 18, 25, 40])
            out += edited(pool[at : at + n], r, r.choice([9, 13, 17, 60])) + [f"x{r.randrange(10**9)}" for _ in range(r.randrange(3, 20))]
        docs[i] = out + [f"z{r.randrange(10**9)}" for _ in range(max(0, 30 - len(out)))]
    docs[60] = docs[7]  # the same text again
    found = chaining.passages(frame(spark, [(i, " ".join(w), "en", "s", 0, 1.0, 7, "r", 3, "p", True) for i, w in docs.items()])).collect()
    rows = {(x.doc_id, x.other_id) for x in found}
    holders, short, windows = defaultdict(list), {}, {}
    for i, w in docs.items():
        (_, offsets, h), = text.words(pa.array([" ".join(w)]), lower=True)
        short[i] = (h >> np.uint64(48)).astype("<u2").tolist()
        windows[i] = {tuple(w[k : k + 30]) for k in range(len(w) - 29)}
        for place, seed in zip(*[x.tolist() for x in chaining.minimizers(offsets, h)[1:]]):
            holders[seed].append((i, place))
    n = 0
    for places in holders.values():
        for (a, x), (b, y) in ((p, q) for p in places for q in places if q[0] < p[0]):
            s, e, t, f, equal = chaining.align(short[a], short[b], x, y)
            if equal >= 30 and equal >= 0.8 * max(e - s, f - t) and not windows[a] & windows[b]:
                n += 1
                assert (a, b) in rows or (a == 60 and (7, b) in rows | {(q, p) for p, q in rows}), (a, b)
    assert n > 10


def test_minimizers_are_the_first_least_of_each_window():
    r = np.random.default_rng(4)
    for n, w in ((1, 1), (8, 8), (50, 7), (300, 22), (300, 8)):
        s = r.integers(0, 12, n).astype(np.uint64)
        assert (chaining.first_minima(s, w) == np.lib.stride_tricks.sliding_window_view(s, w).argmin(1) + np.arange(n - w + 1)).all()
    h = r.integers(0, 5, 400).astype(np.uint64)
    offsets = np.array([0, 10, 40, 41, 200, 400])
    at, runs, first = text.runs(offsets, h, 30)
    want = [(row, i, h[i : i + 30].tobytes()) for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])) for i in range(a, b - 29)]
    assert first.tolist() == [i for _, i, _ in want] and np.diff(at).tolist() == [sum(row == k for row, _, _ in want) for k in range(5)]
    same = {}
    for x, (_, _, run) in zip(runs.tolist(), want):
        assert same.setdefault(run, x) == x
    assert len(set(same.values())) == len(same)
