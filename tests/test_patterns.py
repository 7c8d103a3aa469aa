import math
from itertools import product

import pytest
from pyspark.sql import functions as F

from motifmill.functions import patterns as P


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


L = F.lit


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda: P.kmers(L("ATG"), 2), ["AT", "TG"]),
        (lambda: P.kmers(L("A"), 2), []),
        (lambda: P.join_kmers(F.array(L("AT"), L("TG"))), "ATG"),
        (lambda: P.matches(L("ATC"), L("AGC")), 2),
        (lambda: P.positions(L("AT[CG]A[TC]A")), ["A", "T", "CG", "A", "TC", "A"]),
        (lambda: P.optional_positions(L("AT?[CG]?A[TC]A")), ["A", "T?", "CG?", "A", "TC", "A"]),
        (lambda: P.assemble(P.optional_positions(L("AT?[CG]?A[TC]A"))), "AT?[CG]?A[TC]A"),
        (lambda: P.merge_count(L("A[CTG]A")), 2),
        (lambda: P.length(L("A[CTG]A")), 3),
        (lambda: P.distance(L("ATC"), L("AGC")), 1),
        (lambda: P.distance(L("A[TG]C"), L("A[TCG]C")), 0),
        (lambda: P.distance(L("A[TG]C"), L("A[CA]C")), 1),
        (lambda: P.alike(L("T"), L("TC")), True),
        (lambda: P.alike(L("TC"), L("TA")), False),
        (lambda: P.merge(L("ACC"), L("ATG")), "A[CT][CG]"),
        (lambda: P.merge(L("AC[AT][CG]"), L("AGTT")), "A[CG][AT][CGT]"),
        (lambda: P.merge(L("ACC"), L("AC")), ""),
        (lambda: P.union(L("A"), L(" ")), "A?"),
        (lambda: P.scored_merge(L("ACC"), L("ACG")), "AC[CG]"),
        (lambda: P.scored_merge(L("ACC"), L("ACC")), None),
        (lambda: P.similar(L("ACGU"), L("ACUU"), 4), True),
        (lambda: P.similar(L("ACGU"), L("UUAC"), 4), False),
    ],
)
def test_examples(spark, make, want):
    assert one(spark, make()) == want


def test_expand(spark):
    assert sorted(one(spark, P.expand(L("A[CG][TC]")))) == ["ACC", "ACT", "AGC", "AGT"]


def test_information_content(spark):
    assert one(spark, P.ic(L("A[CG][ACG]"))) == pytest.approx(0.60206 + 0.30103 + 0.12494, abs=1e-4)


def test_features(spark):
    f = {n: one(spark, c) for n, c in P.features(L("A[CG]UU[ACG]")).items()}
    assert (f["fixed_cnt"], f["fixed_run"], f["var_cnt"], f["var_run"], f["length"]) == (3, 2, 6, 1, 5)
    assert f["var_rate"] == pytest.approx(0.4)


def test_similar_halves(spark):
    rows = ["".join(x) for x in product("AC", repeat=3)]
    for a in rows[:4]:
        for b in rows:
            want = sum(x == y for x, y in zip(a, b)) >= 2
            assert one(spark, P.similar_halves(L(a), L(b), 3)) == want


def test_log_factorial(spark):
    for n in (0, 1, 15, 16, 50, 1000, 10**6):
        assert one(spark, P.log_factorial(L(n))) == pytest.approx(math.lgamma(n + 1), rel=1e-12, abs=1e-12)


def test_information_content_of_one_string(spark):
    d = spark.createDataFrame([("ACCG",), ("CCCC",), ("ACGU",), ("",)], "s string")
    got = [r.ic for r in d.select(P.string_ic(F.col("s")).alias("ic")).collect()]
    assert got == pytest.approx([0.1505, 0.6021, 0, 0], abs=1e-4)
