import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from motifmill.llm import bitplane, hpylm, lengths, text
from tests.llm.fixtures import AZ, documents, frame, prose, words


def tokens(t):
    return words((t or "").translate(AZ)) + [None]


def test_scores_against_brute_force(spark):
    rows = documents()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter()
    for r in rows:
        if not held(r[0]):
            c.update(tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        w = tokens(r[1])
        want.append((str(r[0]), held(r[0]), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
    first = hpylm.score(frame(spark), part_tokens=900, block_tokens=2000).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in first) == sorted(want)
    again = hpylm.score(frame(spark), part_tokens=900, block_tokens=2000).collect()
    assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 9)) for r in first) == sorted((str(r.doc_id), r.n_tokens, round(r.score, 9)) for r in again)


def test_frequent_words_are_split_by_context(spark):
    rows = [(i, "the a the b the " * 30 + prose(60, i), "en", "s", 0, 1.0, 7, "r", 3, "p", True) for i in range(40)]
    loads = np.zeros(1 << hpylm.BIN_BITS, np.int64)
    loads[[3, 9, 10]] = 100, 5, 7
    word = np.array([(3 << 48) + 1], np.uint64)
    layout = hpylm.Layout(loads, word, np.array([90]), 4)
    parts = layout.part(np.repeat(word, 500), text.mix(np.arange(500).astype(np.uint64)))
    assert len(set(parts.tolist())) == 4 and parts.min() > layout.first.max() and layout.parts == parts.max() + 1
    # with many parts the contexts of "the" are split; exact counts don't change, and sampled scores little
    few = {r.doc_id: r for r in hpylm.score(frame(spark, rows)).collect()}
    many = {r.doc_id: r for r in hpylm.score(frame(spark, rows), part_tokens=400, block_tokens=1500).collect()}
    for i, a in few.items():
        b = many[i]
        assert (a.n_tokens, a.n_known, a.train_tokens) == (b.n_tokens, b.n_known, b.train_tokens) and a.base_score == pytest.approx(b.base_score)
        assert a.score == pytest.approx(b.score, rel=0.03)


def sequential(docs, held, sweeps, burn_in, d, strengths, seed=1):
    """Mean probabilities of all tokens by a sampler that moves one customer at a time, with every table kept."""
    r = random.Random(seed)
    v = len({w for i, t in enumerate(docs) if not held[i] for w in t})
    tables = defaultdict(lambda: defaultdict(list))  # context: word: customers of each table
    size = lambda u: sum(sum(t) for t in tables[u].values())
    of = lambda t, i: ((("^", "^") + tuple(t))[i : i + 2])

    def prob(u, w):
        if u is None:
            return 1 / (v + 1)
        k = 2 - len(u)
        t = tables[u][w] if w in tables[u] else []
        n = sum(len(x) for x in tables[u].values())
        return (sum(t) - d[k] * len(t) + (strengths[k] + d[k] * n) * prob(u[1:] if u else None, w)) / (strengths[k] + size(u))

    def sit(u, w):
        k, t = 2 - len(u), tables[u][w]
        n = sum(len(x) for x in tables[u].values())
        weights = [x - d[k] for x in t] + [(strengths[k] + d[k] * n) * prob(u[1:] if u else None, w)]
        at = r.choices(range(len(weights)), weights)[0]
        if at < len(t):
            t[at] += 1
            return
        t.append(1)
        if u:
            sit(u[1:], w)

    def leave(u, w):
        t = tables[u][w]
        at = r.choices(range(len(t)), t)[0]
        t[at] -= 1
        if not t[at]:
            t.pop(at)
            if u:
                leave(u[1:], w)

    places = [(of(t, i), w) for k, t in enumerate(docs) if not held[k] for i, w in enumerate(t)]
    for u, w in places:
        sit(u, w)
    total = [[0.0] * len(t) for t in docs]
    for sweep in range(sweeps):
        for u, w in places:
            leave(u, w)
            sit(u, w)
        if sweep >= burn_in:
            for t, out in zip(docs, total):
                for i, w in enumerate(t):
                    out[i] += prob(of(t, i), w) / (sweeps - burn_in)
    return [sum(math.log10(x) for x in out) for out in total]


def test_agrees_with_a_sequential_sampler(spark, monkeypatch):
    r = random.Random(3)
    texts = []
    for i in range(40):
        t = ["a"]
        while len(t) < 12:
            t.append(r.choice({"a": "bbbc", "b": "cccad", "c": "aab", "d": "abcde", "e": "e"}[t[-1]]))
        texts.append(" ".join(t))
    rows = [(i, t, "en", "s", 0, 1.0, 7, "r", 3, "p", True) for i, t in enumerate(texts)]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(40)]
    seen = []
    plain = hpylm._sweep
    monkeypatch.setattr(hpylm, "_sweep", lambda *a: (seen.append(a[1]), plain(*a))[1])
    got = {x.doc_id: x.score for x in hpylm.score(frame(spark, rows), sweeps=4, samples=6, part_tokens=120).collect()}
    want = sequential([tokens(t) for t in texts], held, 120, 20, seen[0], hpylm.STRENGTHS)
    assert sum(held) > 3
    for part in (True, False):
        mine, slow = (sum(x[i] for i in range(40) if held[i] == part) for x in (got, want))
        assert mine == pytest.approx(slow, rel=0.03)
    for i in range(40):
        assert got[i] == pytest.approx(want[i], rel=0.15)


def test_tables_are_drawn_by_their_weights():
    """Against all seatings of five customers, and with customers beyond EXACT near the mean that one at a time gives."""
    d, strength, p, other = 0.4, 1.5, 0.3, 2

    def seatings(c):
        if not c:
            return Counter({(): 1.0})
        out = Counter()
        for t, w in seatings(c - 1).items():
            for k, x in enumerate(t):
                out[t[:k] + (x + 1,) + t[k + 1 :]] += w * (x - d)
            out[t + (1,)] += w * (strength + d * (other + len(t))) * p
        return out

    want = Counter()
    for t, w in seatings(5).items():
        want[len(t)] += w
    n = 40_000
    full = lambda x: np.full(n, x)
    got = Counter(hpylm.draw_tables(full(5), full(1), full(other + 1), full(p), d, strength, np.random.default_rng(1)).tolist())
    for t in range(1, 6):
        assert got[t] / n == pytest.approx(want[t] / sum(want.values()), abs=0.01)
    assert hpylm.draw_tables(np.array([0, 1]), np.array([0, 1]), np.array([1, 1]), np.array([p, p]), d, strength, np.random.default_rng(1)).tolist() == [0, 1]
    n = 3000
    many = hpylm.draw_tables(full(400), full(1), full(1), full(p), d, strength, np.random.default_rng(2))
    exact = np.full(n, 1)
    rng = np.random.default_rng(3)
    exact = hpylm.draw_tables(full(hpylm.EXACT), full(1), full(1), full(p), d, strength, rng)
    for c in range(hpylm.EXACT, 400):
        new = (strength + d * exact) * p
        exact = exact + (rng.random(n) < new / (new + c - d * exact))
    assert many.mean() == pytest.approx(exact.mean(), rel=0.05)


def test_texts_that_occur_twice_are_told_apart(spark):
    """Those that training has twice score far above those that it has once, and copies held out above other texts held out."""
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2]
    train = [i for i in range(300) if i not in held]
    once, twice = train[:160], train[160 : len(train) // 2 * 2]
    text_of = {i: prose(150, 5000 + i, 4000) for i in once} | {i: prose(150, 7000 + k // 2, 4000) for k, i in enumerate(twice)}
    text_of |= {i: text_of[twice[k]] if k % 2 else prose(150, 9000 + i, 4000) for k, i in enumerate(held)}
    rows = [(i, t, "en", "s", 0, 1.0, 7, "r", 3, "p", True) for i, t in text_of.items()]
    got = {r.doc_id: r.score / r.n_tokens for r in hpylm.score(frame(spark, rows)).collect()}
    for more, less in ((twice, once), (held[1::2], held[::2])):
        above = np.array([got[i] for i in more])[:, None] > np.array([got[i] for i in less])
        assert above.mean() > 0.95


def test_model_beats_base_on_held_out_text(spark):
    rows = [(i, prose(400, i % 60)[: 2000 + i], "en", "s", 0, 1.0, 7, "r", 3, "p", True) for i in range(150)]
    p = {r.held_out: r for r in hpylm.perplexity(hpylm.score(frame(spark, rows), part_tokens=20_000)).collect()}
    assert p[True].perplexity < p[True].base_perplexity and p[False].perplexity < p[False].base_perplexity


def test_no_rows(spark):
    assert hpylm.score(frame(spark, [])).count() == 0


def test_frequent_words_are_sent_by_their_places():
    rng = np.random.default_rng(5)
    w = text.mix(rng.zipf(1.3, 20_000).astype(np.uint64) % np.uint64(3000))
    loads, none = np.ones(1 << hpylm.BIN_BITS, np.int64), np.zeros(0, np.int64)
    distinct, n = np.unique(w, return_counts=True)
    plain, known = (hpylm.Layout(loads, none.view(np.uint64), none, 3, k) for k in (None, distinct[n > 20]))
    size = np.full(200, 100)
    (a, order), (b, order2) = (hpylm.request(w, size, np.ones(len(w)), layout) for layout in (plain, known))
    assert (order == order2).all() and [to for to, _ in a] == [to for to, _ in b]
    assert sum(len(x) for _, x in b) < 0.98 * sum(len(x) for _, x in a)
    for (_, x), (_, y) in zip(a, b):
        built = [hpylm.Part.build([blob], layout) for blob, layout in ((x, plain), (y, known))]
        assert built[0][0].blob() == built[1][0].blob()
        for left, right in zip((*built[0][1], *built[0][2]), (*built[1][1], *built[1][2])):
            assert (left == right).all()


def test_words_before_whose_36_bits_are_the_same(spark):
    a, b = "w933375", "w1004886"
    h = {w: int(next(text.words(pa.array([w])))[2][0]) for w in (a, b)}
    assert h[a] != h[b] and h[a] >> 28 == h[b] >> 28
    # each of them stands before x, which the same two words follow, so a block's runs aren't in the order of their part
    said = " ".join(f"{w} x {end}" for w in (a, b) for end in "pq")
    [got] = hpylm.score(frame(spark, [(0, said, "en", "s", 0, 1.0, 7, "r", 3, "p", True)])).collect()
    assert (got.doc_id, got.n_tokens) == (0, 13) and -13 * math.log10(9) < got.score < 0


def test_seating_keeps_customers_and_predicts_a_distribution():
    rng = np.random.default_rng(3)
    w = text.mix(np.minimum(rng.zipf(1.5, 4000), 60).astype(np.uint64))
    layout = hpylm.Layout(np.ones(1 << hpylm.BIN_BITS, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), 1)
    size = np.full(40, 100)
    [(to, blob)], order = hpylm.request(w, size, np.ones(4000), layout)
    part, [places], (words, tag, tokens_) = hpylm.Part.build([blob], layout)
    assert to == 0 and (tag == 0).all() and tokens_.sum() == 4000 and part.count[places[order]].min() >= 1 and part.count.sum() == 4000
    d, strengths = (0.6, 0.5, 0.4), (1.0, 2.0, 3.0)
    t2, t1 = np.minimum(part.count, 1), np.minimum(part.above(np.minimum(part.count, 1)), 1)
    root = np.full(len(words), 0.9 / len(words))  # the rest is for unknown words
    for k in range(3):
        t2, t1 = part.sweep(t2, t1, root, d, strengths, np.random.default_rng(k))
        c1 = part.above(t2)
        assert ((t2 >= 1) & (t2 <= part.count)).all() and ((t1 >= 1) & (t1 <= c1)).all()
        assert part.told(t2, t1).sum() == t1.sum()
    p1, p2 = part.parents(t2, t1, root, d, strengths), part.predict(t2, t1, root, d, strengths)
    # what the words of a restaurant get, and what those it hasn't seen get through its parents, is all there is
    for r in np.unique(part.r1):
        here = part.r1 == r
        open_ = (strengths[1] + d[1] * t1[here].sum()) / (strengths[1] + c1[here].sum())
        assert p1[here].sum() + open_ * (1 - root[part.x[here]].sum()) == pytest.approx(1)
    for r in np.unique(part.r2)[:60]:
        here = part.r2 == r
        open_ = (strengths[0] + d[0] * t2[here].sum()) / (strengths[0] + part.count[here].sum())
        assert p2[here].sum() + open_ * (1 - p1[part.j[here]].sum()) == pytest.approx(1)


def test_ranks_of_wide_keys():
    rng = np.random.default_rng(4)
    cols = [rng.integers(0, 1 << 40, 500) // (1 << 37) * (1 << 37) for _ in range(3)]
    distinct, place = hpylm._ranks(*cols)
    want = sorted(set(zip(*[c.tolist() for c in cols])))
    assert list(zip(*[k.tolist() for k in distinct])) == want and all(want[p] == row for p, row in zip(place.tolist(), zip(*[c.tolist() for c in cols])))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=600), st.sampled_from([1, 8]), st.sampled_from([8, 64, 4096]))
def test_planes_round_trip(ids, bits, block):
    x = np.array(ids, "<u4")
    payload = bitplane.pack(x, bits, block)
    assert (bitplane.unpack(payload) == x).all()
    for k in range(bitplane.blocks(payload)):
        assert (bitplane.unpack_block(payload, k) == x[k * block : (k + 1) * block]).all()


#: Scripts, case pairs, characters that composing or lower-casing takes apart, spaces and punctuation.
CHARACTERS = st.one_of(st.sampled_from("abcXYZ019 .,'!<|>_\n\t\x1c\x85\xa0\u200b\u3000"), st.sampled_from("ΑΣςσİıẞßﬁÅÅǅ\u0300\u0338\u093c\u095c\u0958한글각½Ⅷ²１\u1100\u1161"), st.characters(codec="utf-8"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(CHARACTERS, max_size=60), min_size=1, max_size=8))
def test_encoder_has_the_library_s_ids(texts):
    enc = bitplane.encoder(bitplane.default_tokenizer())
    assert enc.pieces
    ids, at = enc.rows(pa.array(texts))
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert enc.lengths(pa.array(texts)).tolist() == [len(w) for w in want]


def test_encoder_forgets_and_takes_other_tokenizers():
    import public_tokenizers

    texts = ["ΑΣ. ΟΔΟΣ hello", "don't WE'LL a<|endoftext|>b <|STARTOFTEXT|>", "", "***", "word, word. Word!"] + [prose(400, k) for k in range(5)]
    for path, pieces in ((bitplane.default_tokenizer(), True), (public_tokenizers.path("byte_bpe_50k.json"), False)):
        enc = bitplane.Encoder(path, most=500)
        assert enc.pieces == pieces
        for _ in range(2):
            ids, at = enc.rows(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("planes", [1, 8])
def test_store_against_the_library(spark, planes):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(bitplane.default_tokenizer())
    rows = sorted(((r[0] is not None, r[0] or 0), r[1] or "") for r in documents())
    want, at = [], 0
    for (known, i), t in rows:
        ids = tk.encode(t, add_special_tokens=False).ids + [1]
        want.append((i if known else None, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    got = [tuple(r) for r in bitplane.round_trip(frame(spark), plane_bits=planes).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_store_gives_ids_back(spark, tmp_path):
    bitplane.write(frame(spark).where("doc_id < 5"), str(tmp_path / "s"), frame_ids=200)
    got = {r.doc_id: r.ids for r in bitplane.documents(spark, str(tmp_path / "s")).collect()}
    enc = bitplane.encoder(bitplane.default_tokenizer())
    for r in documents()[:5]:
        assert got[r[0]] == enc.tokenizer.encode(r[1], add_special_tokens=False).ids + [1]
    bitplane.write(frame(spark, []), str(tmp_path / "none"))
    assert bitplane.digests(spark, str(tmp_path / "none")).count() == 0


def test_lengths_against_brute_force(spark):
    enc = bitplane.encoder(bitplane.default_tokenizer()).tokenizer
    lens = [len(enc.encode(r[1] or "", add_special_tokens=False).ids) for r in documents()]
    hist = lengths.histogram(frame(spark))
    assert {r.n_tokens: r.n_docs for r in hist.collect()} == Counter(lens)
    for r in lengths.limits(hist, width=64).collect():
        assert r.docs_over == sum(x > r.n_tokens for x in lens) and r.tokens_over == sum(x for x in lens if x > r.n_tokens)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lens) and r.total == sum(lens)
        assert r.whole_share == pytest.approx(sum(x <= r.n_tokens for x in lens) / len(lens))
    one = lengths.at_limit(hist, 77).first()
    assert (one.docs_over, one.truncated_total, one.total) == (sum(x > 77 for x in lens), sum(min(x, 77) for x in lens), sum(lens))
    assert lengths.quantile(hist, 0.5).first()[0] == sorted(lens)[(len(lens) - 1) // 2 if len(lens) % 2 == 0 else len(lens) // 2]
    none = lengths.histogram(frame(spark, []))
    assert none.count() == 0 and lengths.limits(none).count() == 0 and lengths.at_limit(none, 5).first().total == 0


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    t = [r[1] or "" for r in documents()]
    seen = {}
    for row, at, h in text.words(pa.array(t), slice_bytes=4096):
        for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
            w = words(t[row + i])
            assert len(w) == b - a
            for x, y in zip(w, h[a:b].tolist()):
                assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)
