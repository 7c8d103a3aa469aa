import gzip
import math
import os
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from motifmill.llm import interactions, queries, ranking, salvage, sql
from tests.llm.fixtures import AZ, documents, frame, prose, words
from tests.llm.test_native import folder, same

# op 11


def failed(rows, i):
    """The filters that row i fails, as letters."""
    t, w = rows[i][1] or "", words(rows[i][1])
    out = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
    return out + "E" * any(r[0] is not None and rows[i][0] is not None and r[0] < rows[i][0] and (r[1] or "") == t for r in rows)


def brute_audit(rows, marks):
    """Documents gone through one at a time, in every order."""
    out, parts = {}, defaultdict(list)
    for i, r in enumerate(rows):
        parts[r[3] or ""].append((failed(rows, i), marks.get(r[0], (0, 0))))
    for part, docs in parts.items():
        total = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                total[f] += len(gone)
                out[part, "".join(order), step + 1] = [len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == f for d in docs), sum(d[1][0] for d in gone), sum(d[1][1] for d in gone), f]
        for (p, *_), v in out.items():
            if p == part:
                v[6:] = [total[v[6]]]
    return out


MARKS = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 33, 2)] + [(4, 1, 0), (4, None, None), (None, 1, 1)]
LABELS = "doc_id long, quality int, toxic int, text string, good long, mask int"


def labelled(spark):
    return spark.createDataFrame([(*m, "x", 9, 9) for m in MARKS], LABELS)


def test_interactions_against_every_order(spark, tmp_path):
    rows = documents() + [(40 + i, prose(60, 3) if i % 2 else "$ " * 70, "en", "s1", 0, 1.0, 7, "r", 3, "p", True) for i in range(6)]
    d, con = folder(spark, tmp_path, documents=frame(spark, rows), labels=labelled(spark))
    out = queries.op11_filter_interactions(spark, d)
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = out.collect()
    marks = defaultdict(lambda: (0, 0))
    for i, q, t in MARKS:
        if i is not None:
            marks[i] = (max(marks[i][0], int(q == 1)), max(marks[i][1], int(t == 1)))
    assert {(r.part, r.filter_order, r.step): [r[c] for c in columns] for r in got} == brute_audit(rows, marks)
    assert len(got) == 600 * len({r[3] or "" for r in rows})
    assert same(got, out.columns, con.sql(sql.ORACLES["op11_filter_interactions"]))


def test_interactions_of_no_rows(spark):
    cells = interactions.document_cells(frame(spark, []), labelled(spark))
    assert cells.isEmpty() and interactions.audit(cells, "ABCDE").isEmpty()
    unlabelled = interactions.document_cells(frame(spark), labelled(spark).limit(0))
    assert unlabelled.agg(F.sum("good"), F.sum("toxic"), F.sum("n")).first() == (0, 0, len(documents()))


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6])
def test_solution_is_the_shapley_value(n):
    r = random.Random(n)
    v = [0] + [r.randrange(1000) for _ in range((1 << n) - 1)]  # any game, monotone or not
    want = [0] * n
    for order in permutations(range(n)):
        s = 0
        for i in order:
            want[i] += v[s | 1 << i] - v[s]
            s |= 1 << i
    rows = interactions.solution(n)
    assert [sum(x * y for x, y in zip(row, v)) for row in rows] == want
    assert sum(want) == factorial(n) * v[-1]  # efficiency
    assert interactions.kernel(5, 1) == interactions.kernel(5, 4) == Fraction(1, 5)


def test_too_many_filters(spark):
    with pytest.raises(ValueError):
        interactions.audit(spark.createDataFrame([], "part string, mask int, n long, good long, toxic long"), "ABCDEFGH")


# op 12


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(AZ))


def brute_ranking(docs, items, top=10):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(x for _, c in counted for x in c)
    by_id = defaultdict(set)
    for i, t in items:
        by_id[i] |= set(terms(t))
    out = []
    for item, want in by_id.items():
        scored = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * c[x] // (1000 * c[x] + 8 * m)) for x in want if x in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


ITEMS = [(0, prose(12, 3)), (1, "Zé É É a1 12 " + prose(5, 7)), (2, None), (3, ""), (4, "?!"), (5, "unheard"), (5, prose(6, 9)), (None, prose(8, 11)), (6, prose(2000, 92)), (7, "x"), (7, "x")]


def test_ranking_against_brute_force_and_sql(spark, tmp_path):
    items = spark.createDataFrame([(*i, 1.0, "m") for i in ITEMS], "item_id long, text string, score double, rank string")
    d, con = folder(spark, tmp_path, documents=frame(spark), benchmark=items)
    out = queries.op12_length_strata(spark, d)
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in out.collect()), key=str)
    assert got == brute_ranking([r[:2] for r in documents()], ITEMS)
    assert same(out.collect(), out.columns, con.sql(sql.ORACLES["op12_length_strata"]))


@pytest.mark.parametrize("most", [1, 7, 1 << 18])
def test_ranking_by_small_slices_many_ties_and_turns(spark, monkeypatch, most):
    r = random.Random(5)
    docs = [(i, " ".join(r.choices("abcdefgh", k=r.choice([4, 4, 4, 9, 40])))) for i in range(300)] + [(i, "a b") for i in range(300, 420)] + [(7, "a b c"), (None, "a b"), (None, "a a b")]
    r.shuffle(docs)
    items = [(i, " ".join(r.sample("abcdefghij", k=r.randrange(1, 5)))) for i in range(30)] + [(30, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(ranking, "SLICE_POSTINGS", most)
    monkeypatch.setattr(ranking.build, "__defaults__", (most,))
    got = ranking.best(df, spark.createDataFrame(items, "item_id long, text string"), item_bytes=60 if most == 7 else 1 << 20)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute_ranking(docs, items)
    assert got.where("item_id = 30").count() == 10


def test_ranking_of_no_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert ranking.best(frame(spark), none).isEmpty()
    assert ranking.best(frame(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).isEmpty()


def test_index_has_every_posting_once(spark):
    df = frame(spark)
    items = ranking.Items.of([(i, r[1]) for i, r in enumerate(documents())])
    index = ranking.build(df, items, 500).collect()
    per_text = dict(enumerate(terms(r[1]) for r in documents()))
    assert sum(len(r.places) for r in index) == sum(len(set(t)) for t in per_text.values())
    assert sum(len(r.docs) for r in index) == sum(bool(t) for t in per_text.values())
    for r in index:
        assert r.run_end[-1] == len(r.places) and list(r.run_term) == sorted(r.run_term) and len(set(zip(r.run_term, r.run_tf))) == len(r.run_tf)
        assert [max(t for x, t in zip(r.run_term, r.run_tf) if x == term) for term in r.terms] == list(r.tops)


# op 13

PAGES = "page_id long, url string, html string, payload_digest string, kind int"


def pages():
    rows = [(i, f"http://x.example/{i}?q=a b\n", f"<p>{prose(20, i % 7)}</p>\r\n\r\nWARC/1.1\r\n") for i in range(20)]
    rows += [(20, None, None), (21, "u", ""), (22, "u", "é" * 3000), (22, "u", "é" * 3000), (None, "u", "only"), (None, "u", "only"), (None, "u", "é" * 3000), (23, "v", prose(9000, 4)), (24, "w", "WARC/1.1\r\nWARC-Type: x\r\nWARC-Record-ID: <y>\r\nWARC-Date: z\r\nContent-Length: 0\r\n\r\n\r\n\r\n")]
    return [(*r, "d", 3) for r in rows]


@pytest.mark.parametrize("packed", [True, False])
def test_round_trip_of_pages(spark, tmp_path, packed):
    d, con = folder(spark, tmp_path, pages=spark.createDataFrame(pages(), PAGES))
    out = salvage.round_trip(spark.read.parquet(f"{d}/pages.parquet"), packed)
    want = con.sql(sql.ORACLES["op13_warc_salvage"])
    if packed:
        out = queries.op13_warc_salvage(spark, d)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert same(out.collect(), columns, want)


@pytest.mark.parametrize("packed", [True, False])
def test_archives_are_whole_and_standard(spark, tmp_path, packed):
    path = str(tmp_path / "a")
    salvage.write(spark.createDataFrame(pages(), PAGES), path, packed, file_records=4)
    back = salvage.read(spark, path)
    assert salvage.gaps(back).isEmpty()
    html = {r[0]: (r[2] or "").encode() for r in pages()}
    for r in salvage.records(back).collect():
        i = r.record_id.removeprefix(salvage.PAGE)
        assert r.payload is None if r.record_type == "revisit" else i == "" or bytes(r.payload) == html[int(i)]
    files = [os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) > 5
    for f in files:
        data = open(f, "rb").read()
        if packed and data:
            assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
        rows = list(salvage.scanned(data))
        assert all(x.length > 0 for x in rows)


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    assert salvage.round_trip(none).isEmpty()


def archive(packed, n=12):
    records = [salvage.record("response", i, None, prose(30 + i, i).encode()) for i in range(n)]
    parts = [salvage.member(r) for r in records] if packed else records
    return parts, [sum(map(len, parts[:i])) for i in range(n)]


def ids(found):
    names = (re.fullmatch(f"<{salvage.PAGE}([0-9]+)>", f.headers["warc-record-id"]) for f in found if f.kind == "record")
    return [int(m[1]) for m in names if m]


def whole(found, size, damaged=()):
    """Records and gaps together are all bytes once, in order; a member that broke after a record is told as both."""
    at = 0
    for f in found:
        if f.kind == "record" and f.offset in damaged:
            continue
        assert f.offset == at
        at += f.length
    assert at == size


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_after_damage(packed):
    parts, at = archive(packed)
    data = b"".join(parts)
    r = random.Random(3)
    for trial in range(60):
        hit = r.randrange(len(parts))
        bad = bytearray(data)
        if trial % 3 == 0:  # a byte changed
            i = at[hit] + r.randrange(len(parts[hit]) - 4)
            bad[i] ^= 1 << r.randrange(8)
            expected = set(range(len(parts))) - {hit}
        elif trial % 3 == 1:  # bytes lost from the middle of a record
            i = at[hit] + 20
            del bad[i : i + 25]
            expected = set(range(len(parts))) - {hit}
        else:  # noise between two records
            bad[at[hit] : at[hit]] = bytes(r.randrange(256) for _ in range(40)) + b"WARC/1.1\r\n" + salvage.MAGIC
            expected = set(range(len(parts)))
        found = list(salvage.scanned(bytes(bad)))
        assert set(ids(found)) >= expected, trial
        gaps = [f for f in found if f.kind == "gap"]
        if trial % 3 == 2:
            assert [(g.offset, g.length) for g in gaps] == [(at[hit], 53)]
        elif not gaps:  # a bit that no check covers, in a gzip header or a header line
            assert trial % 3 == 0 and sum(f.kind == "record" for f in found) == len(parts)
        else:
            assert len(gaps) == 1 and gaps[0].reason and gaps[0].offset == at[hit]
        whole(found, len(bad), {g.offset for g in gaps})


@pytest.mark.parametrize("packed", [True, False])
def test_cut_off_and_empty_files(packed):
    parts, at = archive(packed)
    data = b"".join(parts)
    for cut in (1, 7, at[1] - 1, at[5] + 30, len(data) - 1):
        found = list(salvage.scanned(data[:cut]))
        n = sum(a + len(p) <= cut for a, p in zip(at, parts))
        assert ids(found)[:n] == list(range(n))
        assert found[-1].kind == "gap" and found[-1].offset + found[-1].length == cut
    assert list(salvage.scanned(b"")) == []


def test_one_member_of_many_records():
    records = [salvage.record("response", i, None, prose(300, i).encode()) for i in range(5)]
    data = bytearray(b"".join(records))
    data[len(records[0]) + 300] ^= 1
    found = list(salvage.scanned(gzip.compress(bytes(data))))
    assert ids(found) == [0, 2, 3, 4]
    gap = next(f for f in found if f.kind == "gap")
    assert (gap.inner, gap.offset, gap.reason) == (len(records[0]), 0, "warc-block-digest differs")
    packed = gzip.compress(b"".join(records), mtime=0)
    assert ids(salvage.scanned(packed[: len(packed) * 2 // 3]))[:2] == [0, 1]  # what came before the break


def test_salvage_is_logged(spark, tmp_path):
    path = tmp_path / "w"
    salvage.write(spark.createDataFrame(pages(), PAGES).coalesce(1), str(path))
    file = next(path / f for f in os.listdir(path) if f.startswith("part-"))
    data = bytearray(file.read_bytes())
    found = [f for f in salvage.scanned(bytes(data)) if f.kind == "record"]
    victim = found[3]
    data[victim.offset + victim.length // 2] ^= 0x55
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.warc.gz").write_bytes(data)
    back = salvage.read(spark, str(tmp_path / "d"))
    gap = salvage.gaps(back).collect()
    assert len(gap) == 1 and gap[0].offset == victim.offset and gap[0].length >= victim.length and gap[0].reason.startswith("member")
    assert salvage.records(back).count() >= len(found) - 1
