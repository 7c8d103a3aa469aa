import json
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from motifmill.llm import curriculum, licenses, quality, queries, sql, toolcalls
from tests.llm.fixtures import AZ, documents, frame, words


def folder(spark, tmp_path, **tables):
    for name, d in tables.items():
        d.write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    for name in tables:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return str(tmp_path), con


def same(spark_rows, columns, result):
    def norm(v):
        return round(v, 6) if isinstance(v, float) else v

    ix = [result.columns.index(c) for c in columns]
    want = sorted((tuple(norm(r[i]) for i in ix) for r in result.fetchall()), key=str)
    return sorted((tuple(norm(r[c]) for c in columns) for r in spark_rows), key=str) == want


def test_mix_against_sql(spark, tmp_path):
    d, con = folder(spark, tmp_path, documents=frame(spark))
    out = queries.op5_curriculum_mix(spark, d)
    assert same(out.collect(), out.columns, con.sql(sql.ORACLES["op5_curriculum_mix"]))


def test_mix_meets_targets_and_repeats_itself(spark):
    rows = [(i, "w " * (20 + i % 13), "en", f"s{i % 5}" if i % 3 else "hot", 0, 1.0, 7, "r", 3, "p", True) for i in range(600)]
    m = curriculum.mix(frame(spark, rows), hex_digits=1).collect()
    taken, target, size = defaultdict(int), {}, {}
    for r in m:
        taken[r.source] += r.copies * r["size"]
        target[r.source], size[r.source] = r.target, r.source_size
        assert 0 <= r.copies <= 3 and len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in target:
        assert abs(taken[s] - target[s]) <= 17 and target[s] <= 3 * size[s] + 1e-6
    # common level: targets over weight are equal but for those at their limit
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(target))}
    free = [target[s] / weight[s] for s in target if target[s] < 3 * size[s] - 1e-6]
    assert max(free) == pytest.approx(min(free))
    key = lambda r: (r.doc_id, r.copies, r.positions)
    assert sorted(map(key, m)) == sorted(map(key, curriculum.mix(frame(spark, rows), hex_digits=1).collect()))
    order = [r.position for r in curriculum.in_order(curriculum.mix(frame(spark, rows))).select("position").collect()]
    assert order == sorted(order) and len(order) == sum(r.copies for r in m)


def test_inverse_integral(spark):
    for knots in curriculum.SCHEDULES:
        for share in (0.0, 0.1, 0.37, 0.5, 0.9, 1.0):
            t = spark.range(1).select(curriculum.inverse_integral(F.lit(share), knots).alias("t")).first().t
            steps = 20000
            rate = lambda x: next(r0 + (r1 - r0) * (x - t0) / (t1 - t0) for (t0, r0), (t1, r1) in zip(knots, knots[1:]) if x <= t1)  # noqa: E731, B023
            area = lambda upto: sum(rate((i + 0.5) * upto / steps) for i in range(steps)) * upto / steps  # noqa: E731, B023
            assert area(t) / area(1.0) == pytest.approx(share, abs=1e-3)


def test_mix_of_nothing(spark):
    assert curriculum.mix(frame(spark, [])).count() == 0
    none = curriculum.mix(frame(spark, [(1, None, None, None, 0, 1.0, 7, "r", 3, "p", True)])).collect()
    assert (none[0].copies, none[0].target) == (0, 0)


def repeated(w):
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(runs)
    return len({i + j for i, r in enumerate(runs) if c[r] > 1 for j in range(3)})


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


LABELS = [(i, 1, 0) for i in range(12)] + [(12, 0, 0), (13, 1, 1), (3, None, 0), (None, 1, 0), (5, 1, 0)]


def test_quality_against_brute_force(spark):
    rows, bins = documents(), 1 << 10
    hashed = lambda x, seed=42: xxhash.xxh64(x.encode(), seed=seed).intdigest()
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def features(w):
        return [signed(hashed(x)) % bins for x in w] + [signed(hashed(y, hashed(x))) % bins for x, y in zip(w, w[1:])]

    def percentile(values, share):
        values = sorted(values)
        at = share * (len(values) - 1)
        i = int(at)
        return values[i] + (at - i) * (values[min(i + 1, len(values) - 1)] - values[i])

    out_of_target = {i for i in range(12) if signed(hashed("held", xxhash.xxh64(i.to_bytes(8, "little"), seed=42).intdigest())) % 5 == 0} - {3}
    trusted = set(range(12)) - {3} - out_of_target
    raw, good = Counter(), Counter()
    holders = {True: Counter(), False: Counter()}
    size, learnt = {True: 0, False: 0}, 0
    single = lambda w: {signed(hashed(x)) % bins for x in w}
    for r in rows:
        f = features(words(r[1]))
        raw.update(f)
        if r[0] in trusted:
            good.update(f)
            learnt += 1
        if r[0] in trusted or r[0] == 13:
            holders[r[0] == 13].update(single(words(r[1])))
            size[r[0] == 13] += 1
    n, t = sum(raw.values()), sum(good.values())
    p = lambda b: (raw[b] + 1) / (n + bins)
    prior = quality.PRIOR + bins * 5 / (5 + learnt)
    weight = [math.log((good[b] + prior * p(b)) / (t + prior)) - math.log(p(b)) for b in range(bins)]
    share = lambda b, x: (holders[x][b] + 5 * (size[x] + 0.5) / (sum(size.values()) + 1)) / (size[x] + 0.5)
    toxic = lambda w: (lambda top: sum(top) / max(len(top), 1))(sorted((math.log(share(b, True) / share(b, False)) for b in single(w)), reverse=True)[:2])
    mean = lambda w: sum(weight[b] for b in features(w)) / len(features(w)) if w else 0.0
    clean = [words(r[1]) for r in rows if r[0] in out_of_target and len(words(r[1])) >= 50]
    assert clean and learnt
    low, high = percentile([mean(w) for w in clean], quality.REJECTED_SCORE), percentile([toxic(w) for w in clean], 1 - quality.REJECTED_TOXIC)
    least = min(low, (len(clean) * low + 5 * quality.LEAST_SCORE) / (len(clean) + 5))
    most = max(0, high, (len(clean) * high + 5 * quality.MOST_TOXIC) / (len(clean) + 5))
    want = []
    for r in rows:
        w = words(r[1])
        score, bad = mean(w), toxic(w)
        lines = [x for x in (r[1] or "").split("\n") if words(x)]
        base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), len(lines) - len(set(lines)), repeated(w))
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        verdicts = (score < least, bad > most, not failed and score >= least and bad <= most)
        want.append((str(r[0]), *base, failed, *verdicts, round(score, 9), round(bad, 9)))
    got = quality.score_documents(frame(spark).drop("score", "kept", "bins_"), labels(spark, LABELS), bins).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio_failed", "toxic_failed", "kept")
    assert sorted((str(r.doc_id), *[r[c] for c in cols], round(r.score, 9), round(r.toxicity, 9)) for r in got) == sorted(want)
    assert quality.score_documents(frame(spark, []), labels(spark, LABELS), bins).count() == 0
    assert {r.score for r in quality.score_documents(frame(spark), labels(spark, []), bins).collect()} == {0.0}


def test_labels_set_the_limits(spark):
    r = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "bdklm" for b in "aeiou" for c in "nrst"]
    slurs = ["vile", "rotten", "nasty", "horrid"]
    rows, labelled, kind = [], [], {}
    for i in range(700):
        w = r.choices(vocabulary, k=100)
        kind[i] = "toxic" if i % 7 == 0 else "bad" if i % 7 == 1 else "good"
        if kind[i] == "toxic":
            for k in range(4):
                w[r.randrange(100)] = slurs[(i + k) % 4]
        if kind[i] == "bad":
            w = [x if r.random() < 0.6 else f"zq{r.randrange(40)}" for x in w]
        rows.append((i, " ".join(w), "en", "s", 0, 1.0, 7, "r", 3, "p", True))
        if i >= 140:
            labelled.append((i, int(kind[i] != "bad"), int(kind[i] == "toxic")))
    rows_ = {x.doc_id: x for x in quality.score_documents(frame(spark, rows).drop("score", "kept", "bins_"), labels(spark, labelled)).collect()}
    # what each limit rejects by itself
    rejected = {(f, k): sum(rows_[i][f] for i in range(140) if kind[i] == k) / sum(kind[i] == k for i in range(140)) for f in ("ratio_failed", "toxic_failed") for k in ("good", "bad", "toxic")}
    assert rejected["ratio_failed", "bad"] == 1 and rejected["ratio_failed", "good"] <= 0.05
    assert rejected["toxic_failed", "toxic"] == 1 and rejected["toxic_failed", "good"] <= 0.1
    got = {i: x.kept for i, x in rows_.items()}
    share = {k: sum(got[i] for i in range(140) if kind[i] == k) / sum(kind[i] == k for i in range(140)) for k in ("good", "bad", "toxic")}
    assert share["bad"] == 0 and share["toxic"] == 0 and share["good"] >= 0.9


def license_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))


def test_license_scan(spark):
    rows = documents()
    extra = {
        100: "Some words. Licensed under the Apache License, Version 2.0. More.",
        101: "Permission is hereby granted, free of charge, to any good person obtaining a copy of this software and associated documentation files",
        102: "all rights reserved CC-BY cc by General\nPublic License",
        103: "This work is licensed under the GNU General Public License, version 3",
        104: "Released under the new MIT License" + " all rights reserved" * 3000,
        105: "the apache version of a license",
    }
    rows += [(i, t, *rows[0][2:]) for i, t in extra.items()]
    got = {}
    for r in licenses.scan(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, r)
    for row in rows:
        if row[0] is None:
            continue
        w = license_words(row[1])
        places = {label: [i for i in range(len(w)) if tuple(w[i : i + len(p)]) == p] for p, label in licenses.PHRASES}
        every = sorted(x for p in places.values() for x in p)
        r = got[row[0]]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(every), every[0] if every else None, every[-1] if every else None)
        assert r.base_labels == ",".join(sorted(k for k, p in places.items() if p))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert [got[i].labels for i in range(100, 106)] == ["apache-2.0", "mit", "cc-by,gpl,reserved", "gpl,gpl-3.0", "reserved", ""]
    assert got[0].labels == "" and got[0].score == 0
    assert licenses.scan(frame(spark, rows)).count() == len(rows) and licenses.scan(frame(spark, [])).count() == 0


CALL = "conv_id long, call_id string, turn int, name string, arguments string, after array<string>"


def test_tool_calls(spark):
    ok = json.dumps({"turn": 3, "text": "hé\n\"x\""})
    calls = [
        (1, "a", 5, "ask", ok, ["b"]), (1, "b", 9, "ask", '{"text": "", "more": 1}', None), (1, "c", 2, "ask", "[1]", ["zz"]), (1, "d", 2, "other", "{}", []),
        (2, "a", 0, "ask", "no json", ["b"]), (2, "b", 1, "ask", None, ["a"]), (2, "c", 2, None, ok, []), (None, "x", 1, "ask", ok, []), (3, "a", None, "ask", ok, []), (3, "a", 1, "ask", ok, []),
    ]
    results = [(1, "a", 7, "late"), (1, "a", 6, "first"), (3, "a", 4, None), (9, "a", 1, "none"), (1, None, 1, "x")]
    c, r = spark.createDataFrame(calls, CALL), spark.createDataFrame(results, "conv_id long, call_id string, turn int, content string")
    got = toolcalls.link(c, r).collect()
    assert len(got) == 9
    by = {(x.conv_id, x.call_id): x for x in got}
    assert by[1, "a"].valid and by[1, "a"].result_turn == 6 and by[1, "a"].n_results == 2
    assert by[1, "a"].json == '{"arguments":{"text":"hé\\n\\"x\\"","turn":3},"call_id":"a","name":"ask","result":"first"}'
    assert by[1, "b"].errors == "missing turn,range text,unknown more" and by[1, "c"].errors == "not an object" and by[1, "d"].errors == "unknown tool"
    # a needs b, which comes later by its turn
    assert [k[1] for k in sorted((k for k in by if k[0] == 1), key=lambda k: by[k].order_no)] == ["c", "d", "b", "a"]
    assert by[2, "a"].cyclic and by[2, "b"].cyclic and not by[2, "c"].cyclic and not by[1, "a"].cyclic
    assert json.loads(by[2, "a"].json)["arguments"] is None and by[2, "b"].n_results == 0
    assert [x.order_no for x in got if x.conv_id == 3] == [0, 0]
    for x in got:
        assert json.dumps(json.loads(x.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == x.json
    assert toolcalls.link(c.limit(0), r).count() == 0


def test_long_backward_chain_is_ordered(spark):
    n = 40  # longer than the rounds
    calls = spark.createDataFrame([(1, f"c{i:02}", n - i, "ask", "{}", [f"c{i - 1:02}"] if i else []) for i in range(n)], CALL)
    got = toolcalls.link(calls, spark.createDataFrame([], "conv_id long, call_id string, turn int, content string")).collect()
    assert [r.call_id for r in sorted(got, key=lambda r: r.order_no)] == [f"c{i:02}" for i in range(n)]


def test_one_rule_orders_calls_whatever_the_rounds(spark):
    """Keys by rounds and one by one agree, and a cycle elsewhere in the conversation doesn't change the others' order."""
    r = random.Random(6)
    rows = []
    for conv in range(12):
        ids = [f"c{i}" for i in range(9)]
        r.shuffle(ids)
        for n, i in enumerate(ids):  # needs only those ahead in this order, at any turns
            rows.append((conv, i, r.randrange(6), "ask", "{}", r.sample(ids[:n], min(n, r.randrange(3)))))
    calls = spark.createDataFrame(rows, CALL)
    slim = calls.select("conv_id", "call_id", "turn", "after")
    keys = lambda d, n: sorted((x.conv_id, x.call_id, x.key, x.tie, x.cyclic) for x in toolcalls.topological_keys(d, n).collect())
    want = keys(slim, 50)
    assert keys(slim, 0) == want and not any(k[4] for k in want)
    at = {k[:2]: k[2:4] for k in want}
    assert all(at[conv, p] < at[conv, i] for conv, i, _, _, _, after in rows for p in after)
    ring = spark.createDataFrame([(conv, x, 1, "ask", "{}", [y]) for conv in range(12) for x, y in (("x", "y"), ("y", "x"))], CALL).select(slim.columns)
    both = keys(slim.union(ring), 24)
    assert [k for k in both if k[1] not in "xy"] == want and all(k[4] for k in both if k[1] in "xy")


def test_conversations_against_sql(spark, tmp_path):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "hi \"you\"\t\\  "), (1, 2, "assistant", "é"), (1, 3, "user", ""), (2, 0, "user", None), (2, 1, "assistant", None), (3, 1, "assistant", "alone"), (None, 1, "user", "x"), (4, 0, None, "y")]
    d, con = folder(spark, tmp_path, conversations=spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    out = queries.op6_tool_call_links(spark, d)
    assert same(out.collect(), out.columns, con.sql(sql.ORACLES["op6_tool_call_links"]))


def test_all_labelled_documents_are_learnt_from(spark):
    labels = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert quality.trusted_ids(labels).count() == quality.toxic_ids(labels).count() == 25_000


def test_texts_are_not_shuffled_for_their_roles(spark, monkeypatch):
    """Many labelled ids are sent as rows of ids, whatever Spark's threshold; of more than the bound the shuffle gives the same roles."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        docs = spark.createDataFrame([(i, "a b") for i in [*range(-300, 5000), 7, 7, 1 << 60, None]], "doc_id long, text string")
        roles = spark.range(-200, 4000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, ("target", "held", "toxic"))), (F.pmod("id", F.lit(3)) + 1).cast("int")).alias("role")).where("doc_id % 7 <> 5")
        told = lambda: sorted(map(str, quality.with_roles(docs, roles).select("doc_id", "role", "text").collect()))
        plan = quality.with_roles(docs, roles)._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        got = told()
        monkeypatch.setattr(quality, "SENT_IDS", 0)
        assert got == told() and len(got) == docs.count()
        assert quality.with_roles(docs, roles.limit(0)).where("role is not null").isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
