"""Doubled paths, simple paths, ancestry, outlines, alignment p-values, settled communities, counted draws, and the flow from files to files."""

import itertools
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifmill.operators import align, background, compare, degenerate, draws, graphs, kmers, report, search, space
from motifmill.plans import flow
from motifmill.sinks import text as sinks
from motifmill.sources import fasta


def letters(r, n, alphabet="ACGU"):
    return "".join(r.choice(alphabet) for _ in range(n))


def test_numbers_of_patterns(spark):
    d = spark.createDataFrame([("ACGU",), ("GGGG",), ("UUAC",)], "kmer string")
    codes = {r.kmer: r.code for r in d.select("kmer", space.code_of(F.col("kmer"), "ACGU", 4).alias("code")).collect()}
    union = codes["ACGU"] | codes["UUAC"]
    row = spark.range(1).select(space.pattern_of(F.lit(union), "ACGU", 4).alias("p"), space.own(F.lit(union), 4).alias("own"), space.full_class(F.lit(union), 4).alias("full"), space.full_class(F.lit(15), 4).alias("all")).first()
    assert row.p == "[AU][CU][AG][CU]" and len(row.own) == 16 and codes["ACGU"] in row.own and not row.full and row.all
    got = {p: set(e.ravel().tolist()) for at, e in space._members(np.array([union]), 4) for p in at}
    assert got == {0: set(row.own)}


def test_search_takes_letters_of_any_alphabet_but_four_at_most(spark):
    r = random.Random(1)
    seqs = spark.createDataFrame([(i, letters(r, 8, "bdpq")) for i in range(40)], "seq_id long, seq string")
    idx = kmers.index(seqs, [3])
    got = search.patterns(kmers.coverage(idx), idx, 3)
    assert not got.isEmpty() and got.where(~F.col("pattern").rlike(r"^[bdpq\[\]]+$")).isEmpty()
    with pytest.raises(ValueError):
        space.PatternSpace(spark.createDataFrame([("ABC", 1), ("DEF", 2)], "kmer string, cov long"), idx, 3, 0, 2)
    assert search.patterns(kmers.coverage(idx).limit(0), idx, 3).isEmpty()


def test_search_by_windows_and_by_levels_is_the_same(spark):
    r = random.Random(11)
    seqs = spark.createDataFrame([(i, letters(r, 7)) for i in range(60)], "seq_id long, seq string")
    idx = kmers.index(seqs, [3])
    some = kmers.coverage(idx).orderBy(F.col("cov").desc(), "kmer").limit(7)
    s = space.PatternSpace(some, idx, 3, 1.0, 1.83)
    windows = [(1.0, 1.83), (1.0, 1.3), (1.2, 1.5), (1.7, 1.8)]
    key = lambda d: sorted(map(tuple, d.collect()))
    got = key(s.best(windows))
    s.sent = None
    assert got == key(s.best(windows)) and len({w for w, *_ in got}) > 2


def test_frequent_paths_against_all_runs(spark):
    r = random.Random(2)
    rows = [(i, letters(r, r.randrange(0, 30), "AC") * r.choice([1, 2])) for i in range(30)] + [(40, "ACN" * 9), (41, "A" * 25)]
    seqs = spark.createDataFrame(rows, "seq_id long, seq string")
    for longest, least in ((20, 2), (13, 3), (8, 2), (3, 4), (2, 1)):
        want = {}
        for k in range(2, longest + 1):
            visits, cov = Counter(), defaultdict(set)
            for i, s in rows:
                for p in range(len(s) - k + 1):
                    if "N" not in s[p : p + k]:
                        visits[s[p : p + k]] += 1
                        cov[s[p : p + k]].add(i)
            want |= {(k, w): (visits[w], len(cov[w])) for w in visits if len(cov[w]) >= least}
        got = kmers.frequent_paths(seqs, longest, least, "ACGU").collect()
        assert {(x.k, x.kmer): (x.visits, x.cov) for x in got} == want and len(got) == len(want)


def test_simple_paths_against_all_permutations(spark):
    r = random.Random(3)
    nodes = "abcdefg"
    edges = [(a, b) for a, b in itertools.combinations(nodes, 2) if r.random() < 0.35]
    near = {frozenset(e) for e in edges}
    used = sorted({x for e in edges for x in e})
    want = {"".join(sorted(p)) for n in range(1, len(used) + 1) for p in itertools.permutations(used, n) if all(frozenset(x) in near for x in zip(p, p[1:]))}
    got = [x.nodes.replace(",", "") for x in graphs.simple_paths(spark.createDataFrame(edges, "u string, v string")).collect()]
    assert set(got) == want and len(got) == len(want)
    assert graphs.simple_paths(spark.createDataFrame([], "u string, v string")).isEmpty()
    with pytest.raises(ValueError):
        graphs.simple_paths(spark.range(64).select(F.col("id").cast("string").alias("u"), (F.col("id") + 1).cast("string").alias("v")))


def test_ancestry_of_long_chains_and_forks(spark):
    links = [(f"n{i:02}", f"n{i - 1:02}") for i in range(1, 21)] + [("n05", "x"), ("x", "y")]
    chains = graphs.ancestry(spark.createDataFrame(links, "child string, parent string"))
    got = {(r.child, r.ancestor): r.distance for r in chains.collect()}
    assert got["n20", "n00"] == 20 and got["n20", "y"] == 17 and ("n04", "y") not in got
    assert len(got) == 20 * 21 // 2 + 16 * 2 + 1
    cov = spark.createDataFrame([(f"n{i:02}", 5) for i in range(21)] + [("x", 1), ("y", 1), ("z", 1)], "kmer string, cov long")
    held = spark.createDataFrame([("n20", 1), ("n19", 1), ("n19", 2), ("y", 9)], "kmer string, seq_id long")
    rows = {r.kmer: r for r in graphs.lineage(spark.createDataFrame(links, "child string, parent string"), cov, held).collect()}
    assert (rows["n20"].roots, rows["n20"].n_ancestors, rows["y"].below, rows["y"].n_descendants) == ("n00,y", 22, 2, 17)
    assert (rows["z"].roots, rows["z"].n_ancestors, rows["n20"].below, rows["n18"].below) == ("z", 0, 0, 2)


@pytest.mark.parametrize("parts", [1, 8])
def test_outline_of_any_depth(spark, parts):
    r = random.Random(4)
    rows, stack, want = [], [], {}
    for n in range(300):
        indent = r.choice([0, 1, 2, 4, 5, 9]) if n % 40 else 9 - n // 40
        if n % 17 == 3:
            rows.append((n, "  "))
            continue
        while stack and stack[-1][0] >= indent:
            stack.pop()
        stack.append((indent, f"line {n}"))
        rows.append((n, " " * indent + f"line {n}  "))
        want[n] = (len(stack) - 1, " / ".join(x for _, x in stack))
    r.shuffle(rows)
    got = compare.indented(spark.createDataFrame(rows, "n long, line string"), parts).collect()
    assert {x.n: (x.depth, x.path) for x in got} == want
    assert compare.indented(spark.createDataFrame([], "n long, line string"), parts).isEmpty()


def random_matrices(r, n, width, base=0.4):
    rows = []
    for i in range(n):
        for pos in range(1, width + 1):
            w = [r.random() ** 3 + base * 0.01 for _ in "ACGU"]
            rows += [(f"p{i:02}", pos, c, x) for c, x in zip("ACGU", w)]
    return rows


def test_alignment_against_brute_force(spark):
    r = random.Random(5)
    rows = [(p + str(w), pos, c, x) for w in (3, 5) for p, pos, c, x in random_matrices(r, 4, w)]
    ppm = spark.createDataFrame(rows, "pattern string, pos int, chr string, w double")
    steps = 20
    m = defaultdict(lambda: defaultdict(dict))
    for p, pos, c, x in rows:
        m[p][pos][c] = x
    unit = {}
    for p, places in m.items():
        unit[p] = []
        for pos in sorted(places):
            w = np.array([places[pos][c] for c in "ACGU"])
            u = w / w.sum() - 0.25
            unit[p].append(u / np.linalg.norm(u))
    step = lambda a, b: math.floor(round((float(a @ b) + 1) * steps / 2, 9) + 0.5)
    every = [v for p in unit for v in unit[p]]
    want = {}
    for q in unit:
        null = []
        for u in unit[q]:
            d = np.zeros(steps + 1)
            for v in every:
                d[step(u, v)] += 1 / len(every)
            null.append(d)
        for t in unit:
            if t == q:
                continue
            tried = []
            for o in range(1 - len(unit[q]), len(unit[t])):
                over = [i for i in range(len(unit[q])) if 0 <= i + o < len(unit[t])]
                if len(over) < 2:
                    continue
                score, chance = sum(step(unit[q][i], unit[t][i + o]) for i in over), 0.0
                for combo in itertools.product(*[np.flatnonzero(null[i]) for i in over]):
                    if sum(combo) >= score:
                        chance += math.prod(null[i][s] for i, s in zip(over, combo))
                tried.append((round(math.log(chance), 9), abs(o), o, len(over), score, chance))
            b = min(tried)
            want[q, t] = (b[2], b[3], b[4], 1 - (1 - b[5]) ** len(tried))
    got = {(x["query"], x.target): x for x in align.aligned(ppm, 2, steps=steps).collect()}
    assert got.keys() == want.keys()
    for k, (offset, overlap, score, p) in want.items():
        assert (got[k].offset, got[k].overlap, got[k].score) == (offset, overlap, score)
        assert got[k].p == pytest.approx(p, rel=1e-9) and got[k].e == pytest.approx(7 * p)
    for q in unit:
        ps = sorted(v[3] for k, v in want.items() if k[0] == q)
        for k, v in want.items():
            if k[0] == q:
                assert got[k].q == pytest.approx(min(1.0, min(p * len(ps) / (i + 1) for i, p in enumerate(ps) if p >= v[3] - 1e-12)))


def test_p_values_of_unrelated_matrices_are_uniform(spark):
    r = random.Random(6)
    ppm = spark.createDataFrame(random_matrices(r, 40, 6), "pattern string, pos int, chr string, w double")
    p = [x.p for x in align.aligned(ppm, 6).collect()]  # one offset only
    assert len(p) == 40 * 39
    for share in (0.05, 0.2, 0.5, 0.8):
        assert sum(x <= share for x in p) / len(p) == pytest.approx(share, abs=0.05)


def test_offsets_of_matrices_of_two_widths(spark):
    rows = [("long", i + 1, c, 1.0) for i, c in enumerate("GACU")] + [("a", i + 1, c, 1.0) for i, c in enumerate("AC")] + [("flat", 1, c, 1.0) for c in "ACGU"] + [("flat", 2, c, 1.0) for c in "ACGU"]
    d = degenerate.offset_similarities(spark.createDataFrame(rows, "pattern string, pos int, chr string, w double"))
    got = {(x.p1, x.p2, x.offset): (x.overlap, round(x.pcc, 9)) for x in d.collect()}
    assert got["long", "a", -1] == (2, 2.0) and got["long", "a", 0][0] == 2 and ("long", "a", -3) not in got and ("long", "a", 1) not in got
    assert got["long", "flat", 0] == (2, 0.0)


def quality(edges, label):
    total = 2 * sum(w for _, _, w in edges)
    size, inside = Counter(), 0.0
    for a, b, w in edges:
        size[label[a]] += w
        size[label[b]] += w
        inside += 2 * w * (label[a] == label[b])
    return inside / total - sum(s * s for s in size.values()) / total**2


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        for i in range(len(rest)):
            yield rest[:i] + [[items[0], *rest[i]]] + rest[i + 1 :]
        yield [[items[0]], *rest]


@pytest.mark.parametrize("seed", range(3))
def test_communities_against_the_best_of_all_partitions(spark, seed):
    r = random.Random(seed)
    nodes = "abcdefghi"
    edges = [(x, y, r.choice([0.2, 0.5, 1.0])) for x, y in itertools.combinations(nodes, 2) if r.random() < (0.7 if (x < "e") == (y < "e") else 0.15)]
    used = sorted({x for e in edges for x in e[:2]})
    best = max(quality(edges, {x: i for i, c in enumerate(p) for x in c}) for p in partitions(used))
    got = {x.pattern: x.cluster_id for x in search.communities(spark.createDataFrame(edges, "a string, b string, w double")).collect()}
    assert set(got) == set(used) and all(got[c] == c for c in got.values())
    here = quality(edges, got)
    assert here >= 0.9 * best - 1e-9
    for x in used:  # no single move is better
        for c in {*got.values(), "new"}:
            assert quality(edges, {**got, x: c}) <= here + 1e-9


def test_every_round_raises_modularity(spark, monkeypatch):
    """Rounds in joins, of a graph with nothing to find and many ties; and the same communities by rounds in one task."""
    r = random.Random(9)
    edges = [(f"{a:02}", f"{b:02}", 1.0) for a, b in itertools.combinations(range(16), 2) if r.random() < 0.3]
    d = spark.createDataFrame(edges, "a string, b string, w double")
    one_task = sorted(map(tuple, search.communities(d).collect()))
    seen = []
    real = search._moved

    def watched(graph, label, total):
        out = real(graph, label, total)
        seen.append({x.id: x.label for x in out.collect()})
        return out

    monkeypatch.setattr(search, "_moved", watched)
    monkeypatch.setattr(search, "SMALL_EDGES", 0)
    assert sorted(map(tuple, search.communities(d).collect())) == one_task
    first = [quality(edges, s) for s in seen if len(s) == 16]
    assert len(first) > 2 and all(b > a for a, b in zip(first[:-1], first[1:-1])) and first[-1] == first[-2]


def test_rounds_in_one_task_raise_modularity():
    for seed in range(30):
        r = random.Random(seed)
        n = 20
        edges = [(a, b, r.choice([0.3, 1.0, 2.0])) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.25]
        both = edges + [(b, a, w) for a, b, w in edges]
        u, v, w = (np.array(x) for x in zip(*both))
        degree = np.bincount(u, w, n)
        label, rounds = np.arange(n), 0
        while (new := search._one_round(u, v, w.astype(float), label, np.maximum(degree, 1e-9), float(w.sum()))) is not None:
            assert quality(edges, new) > quality(edges, label)
            label, rounds = new, rounds + 1
        assert rounds


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (203, 201)]
    got = {x.id: x.component for x in graphs.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(101), 0), **dict.fromkeys((200, 201, 203), 200)}


def test_counted_draws_are_those_of_joined_rows(spark, monkeypatch):
    r = random.Random(7)
    refs = spark.createDataFrame([(i * 7, letters(r, r.randrange(3, 20))) for i in range(400)], "ref_id long, seq string").repartition(3)
    words = [("x", "ACG"), ("x", "GU"), ("y", "AAAA"), ("z", "CCCCCCCC"), ("x", "ACG")]
    w = spark.createDataFrame(words, "pattern string, kmer string")
    d = draws.Draws(refs, 30, 120)
    hits = w.join(refs, F.col("seq").contains(F.col("kmer"))).select("pattern", "ref_id").distinct()
    want = {(x.pattern, x.sample_id): x.cov for x in background.sampled_coverage(hits, d.rows(), "pattern").collect()}
    got = {(x.pattern, x.sample_id): x.cov for x in d.coverage(w, "pattern").collect()}
    assert {k: v for k, v in got.items() if v} == want and len(got) == 90
    monkeypatch.setattr(draws, "MOST_COUNTS", 21)  # seven samples a turn
    monkeypatch.setattr(draws, "BLOCK", 5)
    assert {(x.pattern, x.sample_id): x.cov for x in d.coverage(w, "pattern").collect()} == got
    monkeypatch.setattr(draws, "MOST_WORDS", 2)
    assert {(x.pattern, x.sample_id): x.cov for x in d.coverage(w, "pattern").collect()} == got
    assert d.coverage(w.limit(0), "pattern").isEmpty()


def test_a_thousand_samples_near_the_exact_distribution(spark):
    refs = spark.range(500).select(F.col("id").alias("ref_id"), F.when(F.col("id") < 100, "AC").otherwise("GU").alias("seq"))
    d = draws.Draws(refs, 1000, 50)
    cov = [x.cov for x in d.coverage(spark.createDataFrame([("w", "AC")], "key string, kmer string"), "key").collect()]
    assert len(cov) == 1000 and np.mean(cov) == pytest.approx(10, abs=0.3) and np.var(cov) == pytest.approx(50 * 0.2 * 0.8 * 450 / 499, rel=0.15)
    exact = spark.range(1).select(background.exact_p(*[F.lit(x).cast("long") for x in (14, 50, 100, 500)]).alias("p")).first().p
    assert np.mean([x >= 14 for x in cov]) == pytest.approx(exact, abs=0.03)


def test_pool_draws_again(spark):
    """By its own hashes: lengths that don't fit and starts whose segment has an N."""
    import hashlib

    r = random.Random(8)
    rows = [(i, letters(r, r.randrange(8, 16), "ACGTN" if i % 2 else "ACGT")) for i in range(300)]
    number = lambda what, i: int(hashlib.md5(f"7{what}{i}".encode()).hexdigest()[:8], 16)
    want = {}
    for i, s in rows:
        lengths = [8 + number(f"n{j or ''}", i) % 6 for j in range(3)]
        again = next((j for j, n in enumerate(lengths) if len(s) > n + 1), None)
        if again is None:
            continue
        n = lengths[again]
        cuts = [s[x : x + n] for x in (number(f"s{j or ''}", i) % (len(s) - n) for j in range(5 - again))]
        good = [c for c in cuts if "N" not in c]
        if good:
            want[i] = good[0].replace("T", "U")
    got = {x.ref_id: x.seg for x in background.pool(spark.createDataFrame(rows, "ref_id long, seq string"), 8, 13, shuffled=False).collect()}
    assert got == want and 30 < len(got) < 300
    mixed = {x.ref_id: x.seg for x in background.pool(spark.createDataFrame(rows, "ref_id long, seq string"), 8, 13).collect()}
    assert {i: sorted(s) for i, s in mixed.items()} == {i: sorted(s) for i, s in want.items()} and mixed != want


def files(tmp_path):
    r = random.Random(4)
    positives = "".join(f">s{i}\r\n{letters(r, 8)}GG{r.choice('CG')}AC{letters(r, 8)}\r\n" for i in range(60))
    refs = "".join(f">r{i}\n{letters(r, 30, 'ACGT')}\n{letters(r, 30, 'ACGT')}\n" for i in range(200)) + ">bad\nSequence unavailable\n"
    other = "".join(f">m{i}\n{letters(r, 21)}\n" for i in range(150))
    for name, t in (("pos", positives), ("refs", refs), ("other", other)):
        (tmp_path / f"{name}.fa").write_text(t, newline="")
    return [str(tmp_path / f"{n}.fa") for n in ("pos", "refs", "other")]


def test_a_run_is_taken_up_again(spark, tmp_path, monkeypatch):
    pos, refs, other = files(tmp_path)
    folder, asked = str(tmp_path / "out"), []
    real = flow.Flow.length

    def broken(self, k):
        asked.append(k)
        if k == 3 and asked.count(3) == 1:
            raise RuntimeError("killed")
        return real(self, k)

    monkeypatch.setattr(flow.Flow, "length", broken)
    args = dict(ks=(2, 3), n_samples=20, threshold=0.5)
    with pytest.raises(RuntimeError):
        flow.run(spark, folder, pos, refs, other, **args)
    assert os.path.exists(f"{folder}/manifest/k=2/_SUCCESS") and not os.path.exists(f"{folder}/manifest/k=3")
    tables = flow.run(spark, folder, pos, refs, other, **args)
    assert asked == [2, 3, 3]
    again = flow.run(spark, folder, pos, refs, other, **args)
    assert asked == [2, 3, 3] and sorted(map(str, again["motifs"].collect())) == sorted(map(str, tables["motifs"].collect()))
    with pytest.raises(ValueError):
        flow.run(spark, folder, pos, refs, other, ks=(2, 3), n_samples=21)
    monkeypatch.undo()
    single = lambda p: fasta.single_line(spark, p)
    pool = background.pool(fasta.multi_line(spark, refs, 25).withColumnRenamed("seq_id", "ref_id"), 18, 25).withColumnRenamed("seg", "seq")
    whole = flow.find(single(pos), pool, single(other).withColumnRenamed("seq_id", "ref_id"), **{**args, "ks": (3,)})
    for name in ("patterns", "motifs", "cores"):
        key = lambda t: sorted((x.k, x.pattern, x.cov) for x in t.where("k = 3").collect())
        assert key(whole[name]) == key(tables[name]), name
    assert not tables["motifs"].isEmpty()
    report = spark.read.text(f"{folder}/reports/final_result").collect()
    assert [x.value for x in report if x.value.startswith("pattern length")][-1] == "pattern length: 3"
    assert "=====motif length: 3=====" in {x.value for x in spark.read.text(f"{folder}/reports/pattern_info").collect()}
    assert os.path.exists(f"{folder}/reports/meme/_SUCCESS") and os.path.exists(f"{folder}/reports/cluster_info/_SUCCESS")


def test_flow_of_no_sequences(spark):
    none = spark.createDataFrame([], "seq_id long, seq string")
    assert all(t.isEmpty() for t in flow.find(none, none.withColumnRenamed("seq_id", "ref_id"), ks=(3,)).values())


def test_matrix_files_are_read_back(spark, tmp_path):
    rows = [("A[CG]U", i + 1, c, w) for i, c, w in ((0, "A", 5.0), (1, "C", 2.0), (1, "G", 3.0), (2, "U", 5.0))] + [("GG", 1, "G", 1.5), ("GG", 2, "G", 1.5)]
    m = spark.createDataFrame(rows, "pattern string, pos int, chr string, w double")
    sinks.ppm_files(m, str(tmp_path / "m"))
    for p in ("A[CG]U", "GG"):
        folder = next(x for x in os.listdir(tmp_path / "m") if x.startswith("pattern=") and x.endswith("GG") == (p == "GG"))
        file = next(x for x in os.listdir(tmp_path / "m" / folder) if x.startswith("part-"))
        named = tmp_path / f"PPM-{p}.txt"
        named.write_bytes((tmp_path / "m" / folder / file).read_bytes())
    back = fasta.ppm(spark, str(tmp_path / "PPM-*.txt".replace("[", "?"))).where("w > 0")
    assert sorted((x.pattern, x.pos, x.chr, x.w) for x in back.collect()) == sorted(rows)


def test_kmer_files_and_edges(spark, tmp_path):
    (tmp_path / "k.fa").write_text(">x\nACG\n>y\nUUU\n\n")
    assert sorted(x.kmer for x in fasta.pwm_kmers(spark, str(tmp_path / "k.fa")).select("kmer").collect()) == ["ACG", "UUU"]
    edges = kmers.edges(kmers.index(spark.createDataFrame([(1, "ACGA"), (2, "CGG")], "seq_id long, seq string"), [2]))
    assert {x.end_node for x in kmers.successors(edges, "CG").collect()} == {"GA", "GG"}
    sinks.edge_dump(edges, str(tmp_path / "edges"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "edges")).collect()) == ["AC\t1\tCG", "CG\t1\tGA", "CG\t2\tGG"]


def test_data_jobs(spark):
    d = spark.createDataFrame([("web_b_cell",), ("web_b_cell",), ("exo_t",), ("alone",), (None,)], "name string")
    assert sorted(map(tuple, compare.by_prefix(d, "name").collect())) == [("alone", 1, ""), ("exo", 1, "t"), ("web", 2, "b_cell")]
    rows = spark.createDataFrame([("Let7", "HSA", 1), ("let7", "hsa", 2), ("x", "y", 3)], "id string, species string, experiment int")
    assert compare.distinct_species(rows, spark.createDataFrame([(1,), (2,), (2,)], "experiment int")).collect() == [("let7", "hsa")]
    records = spark.createDataFrame([("a", "ACG"), ("b", "ANG"), ("c", ""), ("d", "ASC")], "title string, seq string")
    assert [x.title for x in compare.clean_records(records).collect()] == ["a"]
    sides = compare.one_against_rest(compare.by_title(records, 1), "species", "b")
    assert {x.title: x.side for x in sides.collect()} == {"a": "negative", "b": "positive", "c": "negative", "d": "negative"}


def test_aligned_pairs_of_blocks(spark):
    """Pairs of blocks give what the joins of all offsets give, whatever the matrices' lengths."""

    rng = random.Random(3)
    rows = [(f"p{i:02}", pos, c, float(rng.choice([0, 1, 1, 5]))) for i in range(23) for pos in range(1, 2 + i % 4) for c in "ACGU"]
    rows = [r if r[2] != "A" else (*r[:3], r[3] + 0.5) for r in rows]  # no place without weight
    ppm = spark.createDataFrame(rows, "pattern string, pos int, chr string, w double")
    sims = degenerate.offset_similarities(ppm)
    lengths = ppm.groupBy("pattern").agg(F.max("pos").alias("n"))
    want = report.aligned_similarity(sims, degenerate.best_offsets(sims).where("mean_pcc > 0.5"), lengths)
    told = lambda d: sorted((r.p1, r.p2, r.offset, round(r.similarity, 9)) for r in d.collect())
    assert told(degenerate.aligned_pairs(ppm, 0.5, block=5)) == told(degenerate.aligned_pairs(ppm, 0.5)) == told(want)


def test_pool_is_dealt_to_tasks(spark):
    """A small file of references is many tasks' work."""
    refs = spark.range(200).coalesce(1).select(F.col("id").alias("ref_id"), F.lit("ACGUACGUACGUACGUACGUACGUACGUACGU").alias("seq"))
    assert background.pool(refs, 18, 25).rdd.getNumPartitions() > 1
