"""The registered queries of the motif operators, with the DuckDB SQL that each result is checked against.

Positive sequences come from part, negative ones from supplier and the background pool from orders: a key's
md5, its digits read as letters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill.functions import numbers as N
from motifmill.functions import patterns as P
from motifmill.operators import background, compare, degenerate, graphs, kmers, search
from motifmill.operators.draws import PRIME, Draws
from motifmill.session import save
from motifmill.sources import fasta

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KS = [2, 3, 4, 5, 6]
K = 4
SAMPLES = 20


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def positives(spark, d):
    return fasta.hashed(table(spark, d, "part"), "p_partkey")


def negatives(spark, d):
    return fasta.hashed(table(spark, d, "supplier"), "s_suppkey", "neg")


def references(spark, d):
    return fasta.hashed(table(spark, d, "orders"), "o_orderkey", "bg").withColumnRenamed("seq_id", "ref_id")


def index(spark, d, ks=(K,)):
    return kmers.index(positives(spark, d), list(ks), fasta.RNA)


def cov(spark, d, ks=(K,)):
    return kmers.counted(positives(spark, d), list(ks), fasta.RNA)


def patterns(spark, d):
    """Patterns of the 4-mers of over average coverage that differ at the third place; at most 64."""
    c = save(cov(spark, d), "cov")
    mean = c.agg(F.avg("cov").alias("mean"))
    good = c.join(F.broadcast(mean), F.col("cov") > F.col("mean")).withColumn("g", F.concat(F.left("kmer", F.lit(2)), F.right("kmer", F.lit(1))))
    p = degenerate.segment_merge(good, "g").select("pattern")
    return save(p.where(~F.exists(P.positions(F.col("pattern")), lambda c: F.length(c) >= 4)), "patterns")


def outstanding(spark, d):
    """k-mers two standard deviations over the mean coverage."""
    c = save(cov(spark, d), "cov")
    return c.join(F.broadcast(c.agg((F.avg("cov") + 2 * F.stddev_samp("cov")).alias("least"))), F.col("cov") > F.col("least")).select("kmer")


_HEX = "'0123456789abcdef','ACGUACGUACGUACGU'"
SEQ = f"pos AS (SELECT p_partkey::BIGINT AS seq_id, translate(md5(p_partkey::VARCHAR),{_HEX}) AS seq FROM part)"
NEG = f"neg AS (SELECT s_suppkey::BIGINT AS seq_id, translate(md5('neg' || s_suppkey::VARCHAR),{_HEX}) AS seq FROM supplier)"
REF = f"refs AS (SELECT o_orderkey::BIGINT AS ref_id, translate(md5('bg' || o_orderkey::VARCHAR),{_HEX}) AS seq FROM orders)"


def km(ks, source="pos", name="km", ident="seq_id", seq="seq"):
    return f"{name} AS (SELECT {ident}, (i - 1)::BIGINT AS pos, k::INTEGER AS k, substr({seq}, i, k) AS kmer FROM {source}, (SELECT unnest([{','.join(map(str, ks))}]) AS k), range(1, 33) r(i) WHERE i <= length({seq}) - k + 1)"


COV = "cov AS (SELECT k, kmer, count(*) AS visits, count(DISTINCT seq_id) AS cov FROM km GROUP BY k, kmer)"
#: k-mers that stand out: two standard deviations over the layer's mean coverage.
WORDS = "words AS (SELECT kmer FROM cov WHERE cov > (SELECT avg(cov) + 2 * stddev_samp(cov) FROM cov))"
PATTERNS = """pats AS (SELECT * FROM (SELECT left(kmer, 2) || CASE WHEN count(*) > 1 THEN '[' || string_agg(substr(kmer, 3, 1), '' ORDER BY substr(kmer, 3, 1)) || ']' ELSE min(substr(kmer, 3, 1)) END || right(kmer, 1) AS pattern,
 left(kmer, 2) || '?' || right(kmer, 1) AS g, string_agg(substr(kmer, 3, 1), '' ORDER BY substr(kmer, 3, 1)) AS letters
 FROM cov WHERE cov > (SELECT avg(cov) FROM cov) GROUP BY left(kmer, 2), right(kmer, 1)) WHERE length(letters) < 4)"""
EXPANDED = "expd AS (SELECT pattern, left(g, 2) || substr(letters, i, 1) || right(g, 1) AS kmer FROM pats, range(1, 4) r(i) WHERE i <= length(letters))"
BASE = f"WITH {SEQ}, {km([K])}, {COV}"
PBASE = f"{BASE}, {PATTERNS}, {EXPANDED}"
EDGES = "edges AS (SELECT * FROM (SELECT seq_id, pos, kmer AS start_node, lead(kmer) OVER (PARTITION BY seq_id ORDER BY pos) AS end_node FROM km WHERE k = 2) WHERE end_node IS NOT NULL)"


@query(f"WITH {SEQ} SELECT count(*) AS n, min(length(seq)) AS min_len, max(length(seq)) AS max_len, sum(length(seq))::BIGINT AS letters FROM pos")
def seq_stats(spark, d):
    return fasta.stats(positives(spark, d))


@query("SELECT doc_id AS seq_id, length(regexp_replace(upper(text), '[^ACGTU]', '', 'g')) AS n FROM documents")
def seq_from_text(spark, d):
    return fasta.from_text(table(spark, d, "documents")).select("seq_id", F.length("seq").cast("long").alias("n"))


@query(f"WITH {SEQ}, {km([3])} SELECT seq_id, pos, k, kmer FROM km")
def kmer_explode(spark, d):
    return index(spark, d, [3])


@query(f"WITH {SEQ}, {km(KS)}, {COV} SELECT k, kmer, visits, cov FROM cov")
def kmer_coverage(spark, d):
    return cov(spark, d, KS)


@query(f"WITH {SEQ}, {km(KS)}, {COV} SELECT k, kmer, visits, cov FROM cov WHERE cov > 0.1 * (SELECT count(*) FROM pos)")
def kmer_candidates(spark, d):
    return kmers.candidates(cov(spark, d, KS), positives(spark, d).count())


@query(f"WITH {SEQ}, {km([3, 4])}, {COV}, good AS (SELECT * FROM cov WHERE cov >= 0.1 * (SELECT count(*) FROM pos)) SELECT k, kmer, visits, cov FROM good g WHERE k = 4 AND EXISTS (FROM good WHERE k = 3 AND kmer = left(g.kmer, 3)) AND EXISTS (FROM good WHERE k = 3 AND kmer = right(g.kmer, 3))")
def kmer_apriori(spark, d):
    return kmers.apriori(save(cov(spark, d, [3, 4]), "cov"), 4, 0.1 * positives(spark, d).count())


@query(f"{BASE}, a AS (SELECT unnest(['A','C','G','U']) AS x), u AS (SELECT a.x || b.x || c.x || e.x AS kmer FROM a, a b, a c, a e) SELECT kmer, coalesce(cov, 0) AS cov FROM u LEFT JOIN cov USING (kmer)")
def kmer_universe(spark, d):
    u = kmers.universe(spark, fasta.RNA, K)
    return u.join(cov(spark, d), "kmer", "left").select("kmer", F.coalesce("cov", F.lit(0)).alias("cov"))


@query(f"{BASE} SELECT kmer, sum(length(regexp_extract_all(seq, kmer)))::BIGINT AS visits, count(*) AS cov FROM pos, (SELECT kmer FROM cov) WHERE contains(seq, kmer) GROUP BY kmer")
def kmer_visits_nonoverlap(spark, d):
    return kmers.visits(positives(spark, d), cov(spark, d))


@query(f"""{BASE}, parts AS (SELECT kmer, seq_id, length(seq) AS n, string_split(reverse(seq), reverse(kmer)) AS p FROM pos, (SELECT kmer FROM cov) WHERE contains(seq, kmer))
SELECT kmer, seq_id, (n - list_sum(list_transform(p[1:i], lambda x: length(x))) - i * 4)::BIGINT AS pos FROM parts, range(1, 33) r(i) WHERE i < length(p)""")
def kmer_visits_rtl(spark, d):
    return kmers.visits_from_right(positives(spark, d), cov(spark, d))


@query(f"WITH {SEQ}, {km([2])}, {EDGES} SELECT start_node, end_node, start_node || right(end_node, 1) AS title, count(*) AS weight, count(DISTINCT seq_id) AS cov FROM edges GROUP BY ALL")
def graph_edges(spark, d):
    return kmers.edges(index(spark, d, [2])).groupBy("start_node", "end_node", "title").agg(F.count("*").alias("weight"), F.countDistinct("seq_id").alias("cov"))


@query(f"""WITH {SEQ}, {km([2])}, {COV}, {EDGES} SELECT kmer, visits, cov, coalesce((SELECT count(DISTINCT end_node) FROM edges WHERE start_node = kmer), 0) AS n_next,
 coalesce((SELECT count(DISTINCT start_node) FROM edges WHERE end_node = kmer), 0) AS n_prev FROM cov""")
def graph_node_stats(spark, d):
    i = index(spark, d, [2])
    return kmers.node_stats(i, kmers.edges(i))


@query(f"""WITH {SEQ}, {km([2])}, {EDGES}, e AS (SELECT *, start_node || right(end_node, 1) AS title, pos BETWEEN 2 AND 7 AS seed FROM edges)
SELECT title, count(*) FILTER (seed) AS seed_visits, count(DISTINCT seq_id) FILTER (seed) AS seed_cov, count(*) FILTER (NOT seed) AS other_visits, count(DISTINCT seq_id) FILTER (NOT seed) AS other_cov FROM e GROUP BY title""")
def seed_region_stats(spark, d):
    return kmers.seed_stats(kmers.edges(index(spark, d, [2])))


@query(f"WITH {SEQ}, {km([4])} SELECT kmer AS path, count(*) AS visits, count(DISTINCT seq_id) AS cov FROM km GROUP BY kmer")
def path_extend(spark, d):
    two = index(spark, d, [2])
    three = kmers.extend(two, two, 1)
    four = kmers.extend(three.withColumnRenamed("path", "kmer"), two, 2)
    return four.groupBy("path").agg(F.count("*").alias("visits"), F.countDistinct("seq_id").alias("cov"))


@query(f"WITH {SEQ}, {km(KS)}, {COV} SELECT * FROM (SELECT k, kmer, visits, cov, row_number() OVER (PARTITION BY k ORDER BY cov DESC, kmer)::INTEGER AS rank FROM cov) WHERE rank <= 20")
def topn_kmers_per_k(spark, d):
    return kmers.top(cov(spark, d, KS), 20)


@query(f"WITH {SEQ} SELECT a.seq_id, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN substr(a.seq, i, 1) = substr(b.seq, i, 1) THEN 1 ELSE 0 END))::BIGINT AS same FROM pos a JOIN pos b ON b.seq_id = a.seq_id + 1")
def hamming_match(spark, d):
    p = positives(spark, d)
    nxt = p.select((F.col("seq_id") - 1).alias("seq_id"), F.col("seq").alias("other"))
    return p.join(nxt, "seq_id").select("seq_id", P.matches(F.col("seq"), F.col("other")).alias("same"))


@query(f"{PBASE} SELECT pattern, left(pattern, 1) || '|' || substr(pattern, 2, 1) || '|' || letters || '|' || right(pattern, 1) AS positions FROM pats")
def pattern_parse(spark, d):
    return patterns(spark, d).select("pattern", F.array_join(P.positions(F.col("pattern")), "|").alias("positions"))


@query(f"{PBASE} SELECT pattern, kmer FROM expd")
def pattern_expand(spark, d):
    return degenerate.expansions(patterns(spark, d))


@query(f"""{PBASE} SELECT pattern, CASE length(letters) WHEN 1 THEN 4 ELSE 3 END::BIGINT AS fixed_cnt, CASE length(letters) WHEN 1 THEN 4 ELSE 2 END::BIGINT AS fixed_run, length(letters)::BIGINT AS var_cnt,
 CASE length(letters) WHEN 1 THEN 0 ELSE 1 END::BIGINT AS var_run, CASE length(letters) WHEN 1 THEN 0.0 ELSE 0.25 END::DOUBLE AS var_rate, 4::BIGINT AS length, (length(letters) - 1)::BIGINT AS merge_cnt FROM pats""")
def pattern_features(spark, d):
    p = F.col("pattern")
    return patterns(spark, d).select("pattern", *[c.alias(n) for n, c in P.features(p).items()], P.merge_count(p).alias("merge_cnt"))


_ALIKE = "(length(translate(a.{0}, b.{0}, '')) = 0 OR length(translate(b.{0}, a.{0}, '')) = 0)"


@query(f"""{PBASE}, q AS (SELECT pattern, left(g, 1) AS c1, substr(g, 2, 1) AS c2, letters AS c3, right(g, 1) AS c4 FROM pats)
SELECT a.pattern AS p1, b.pattern AS p2, ({" + ".join(f"(NOT {_ALIKE.format(c)})::INT" for c in ("c1", "c2", "c3", "c4"))})::BIGINT AS dist FROM q a JOIN q b ON a.pattern > b.pattern""")
def pattern_distance(spark, d):
    p = patterns(spark, d)
    a, b = p.withColumnRenamed("pattern", "p1"), p.withColumnRenamed("pattern", "p2")
    return a.join(b, F.col("p1") > F.col("p2")).withColumn("dist", P.distance(F.col("p1"), F.col("p2")))


@query(f"""{BASE} SELECT left(kmer, 2) AS g, left(kmer, 2) || (SELECT CASE WHEN count(DISTINCT x) > 1 THEN '[' || string_agg(DISTINCT x, '' ORDER BY x) || ']' ELSE min(x) END FROM (SELECT unnest(list(substr(kmer, 3, 1))) AS x))
 || (SELECT CASE WHEN count(DISTINCT x) > 1 THEN '[' || string_agg(DISTINCT x, '' ORDER BY x) || ']' ELSE min(x) END FROM (SELECT unnest(list(substr(kmer, 4, 1))) AS x)) AS pattern
 FROM cov WHERE cov > (SELECT avg(cov) FROM cov) GROUP BY left(kmer, 2)""")
def segment_merge(spark, d):
    c = save(cov(spark, d), "cov")
    good = c.join(F.broadcast(c.agg(F.avg("cov").alias("mean"))), F.col("cov") > F.col("mean")).withColumn("g", F.left("kmer", F.lit(2)))
    return degenerate.segment_merge(good, "g")


_UNION = "list_aggregate(list_sort(list_distinct(regexp_extract_all(a.{0} || b.{0}, '.'))), 'string_agg', '')"
_CLASS = "CASE WHEN length({0}) > 1 THEN '[' || {0} || ']' ELSE {0} END"
_COST = "CASE WHEN a.{0} = b.{0} THEN 0 WHEN contains(a.{0}, b.{0}) OR contains(b.{0}, a.{0}) THEN 0.6 ELSE 1 END"


@query(f"""{PBASE}, q AS (SELECT pattern, left(g, 1) AS c1, substr(g, 2, 1) AS c2, letters AS c3, right(g, 1) AS c4 FROM pats),
m AS (SELECT a.pattern AS p1, b.pattern AS p2, {", ".join(f"{_UNION.format(c)} AS {c}" for c in ("c1", "c2", "c3", "c4"))}, {" + ".join(_COST.format(c) for c in ("c1", "c2", "c3", "c4"))} AS cost FROM q a JOIN q b ON a.pattern > b.pattern),
n AS (SELECT *, {" || ".join(_CLASS.format(c) for c in ("c1", "c2", "c3", "c4"))} AS merged FROM m)
SELECT p1, p2, merged, CASE WHEN cost > 0 AND cost <= 1 AND greatest(length(c1), length(c2), length(c3), length(c4)) < 4 THEN merged END AS near FROM n""")
def pattern_merge(spark, d):
    p = patterns(spark, d)
    a, b = p.withColumnRenamed("pattern", "p1"), p.withColumnRenamed("pattern", "p2")
    p1, p2 = F.col("p1"), F.col("p2")
    return a.join(b, p1 > p2).select("p1", "p2", P.merge(p1, p2).alias("merged"), P.scored_merge(p1, p2).alias("near"))


@query(f"{PBASE} SELECT pattern, round(3 * log10(4) + log10(4.0 / length(letters)), 9) AS ic FROM pats")
def pattern_ic(spark, d):
    return patterns(spark, d).select("pattern", F.round(P.ic(F.col("pattern")), 9).alias("ic"))


@query(f"""{PBASE}, w AS (SELECT pattern, kmer, coalesce(cov, 1) AS w FROM expd LEFT JOIN cov USING (kmer)),
f AS (SELECT pattern, i, substr(kmer, i, 1) AS chr, sum(w) AS w FROM w, range(1, 5) r(i) GROUP BY ALL), t AS (SELECT pattern, i, sum(w) AS total FROM f GROUP BY ALL)
SELECT pattern, round(sum(w / total * log10(4 * w / total)), 8) AS ic FROM f JOIN t USING (pattern, i) GROUP BY pattern""")
def pattern_weighted_ic(spark, d):
    return degenerate.weighted_ic(patterns(spark, d), cov(spark, d)).withColumn("ic", F.round("ic", 8))


@query(f"WITH {SEQ}, l AS (SELECT i - 1 AS pos, substr(seq, i, 1) AS chr, count(*) AS n FROM pos, range(1, 33) r(i) GROUP BY ALL), t AS (SELECT pos, sum(n) AS total FROM l GROUP BY pos) SELECT pos::INTEGER AS pos, round(sum(n / total * log10(4 * n / total)), 8) AS ic FROM l JOIN t USING (pos) GROUP BY pos")
def column_ic(spark, d):
    return degenerate.column_ic(positives(spark, d)).withColumn("ic", F.round("ic", 8))


@query(f"{PBASE} SELECT pattern, count(DISTINCT seq_id) AS cov FROM expd JOIN km USING (kmer) GROUP BY pattern")
def pattern_coverage(spark, d):
    return degenerate.coverage(patterns(spark, d), index(spark, d))


@query(f"{PBASE} SELECT pattern, count(*) AS cov, sum(length(regexp_extract_all(seq, pattern)))::BIGINT AS matches FROM pats, pos WHERE regexp_matches(seq, pattern) GROUP BY pattern")
def pattern_regex_coverage(spark, d):
    return degenerate.regex_coverage(patterns(spark, d), positives(spark, d))


@query(f"{BASE} SELECT u.kmer AS u, v.kmer AS v FROM cov u JOIN cov v ON u.kmer > v.kmer AND (left(u.kmer, 2) = left(v.kmer, 2))::INT + (substr(u.kmer, 2, 2) = substr(v.kmer, 2, 2))::INT + (right(u.kmer, 2) = right(v.kmer, 2))::INT >= 1")
def simi_graph(spark, d):
    return graphs.similarity(cov(spark, d), K)


@query(f"WITH {SEQ}, {km([3])}, {COV} SELECT u.kmer AS u, v.kmer AS v FROM cov u JOIN cov v ON u.kmer > v.kmer AND (left(u.kmer, 1) = left(v.kmer, 1))::INT + (substr(u.kmer, 2, 1) = substr(v.kmer, 2, 1))::INT + (right(u.kmer, 1) = right(v.kmer, 1))::INT >= 2")
def simi_graph_alt(spark, d):
    return graphs.similarity(cov(spark, d, [3]), 3, P.similar_halves)


_LAYERS = "thr AS (SELECT k, avg(cov) AS t FROM cov GROUP BY k), good AS (SELECT c.k, kmer FROM cov c JOIN thr USING (k) WHERE cov > t)"
_TREE = """t0 AS (SELECT c.kmer AS child, p.kmer AS parent, 0 AS side FROM good c JOIN good p ON c.k = 4 AND p.k = 3 AND left(c.kmer, 3) = p.kmer),
t1 AS (SELECT c.kmer AS child, p.kmer AS parent, 1 AS side FROM good c JOIN good p ON c.k = 4 AND p.k = 3 AND right(c.kmer, 3) = p.kmer AND left(c.kmer, 3) <> p.kmer),
tree AS (FROM t0 UNION ALL FROM t1), orphans AS (SELECT kmer AS child FROM good WHERE k = 4 AND kmer NOT IN (SELECT child FROM tree))"""


def _layers(spark, d):
    c = save(cov(spark, d, [3, 4]), "cov")
    means = c.groupBy("k").agg(F.avg("cov").alias("mean"))
    return c.join(F.broadcast(means), "k").where("cov > mean").select("k", "kmer")


@query(f"WITH {SEQ}, {km([3, 4])}, {COV}, {_LAYERS}, {_TREE} SELECT child, parent, side FROM tree UNION ALL SELECT child, '____', 0 FROM orphans")
def kmer_tree(spark, d):
    g = _layers(spark, d)
    return graphs.tree(g.where("k = 4"), g.where("k = 3"), 4)


@query(f"WITH {SEQ}, {km([3, 4])}, {COV}, {_LAYERS}, {_TREE} SELECT child FROM orphans")
def tree_orphans(spark, d):
    g = _layers(spark, d)
    return graphs.orphans(g.where("k = 4"), g.where("k = 3"), 4)


_BOTH = f"WITH {SEQ}, {NEG}, {km([K])}, {km([K], 'neg', 'nm')}"


@query(f"{_BOTH}, a AS (SELECT kmer FROM km GROUP BY kmer HAVING count(DISTINCT seq_id) > 0.1 * (SELECT count(*) FROM pos)), b AS (SELECT kmer FROM nm GROUP BY kmer HAVING count(DISTINCT seq_id) > 0.1 * (SELECT count(*) FROM neg)) FROM a INTERSECT FROM b")
def layer_common(spark, d):
    p, n = positives(spark, d), negatives(spark, d)
    c = [kmers.candidates(kmers.counted(s, [K], fasta.RNA), s.count()).select("kmer") for s in (p, n)]
    return c[0].intersect(c[1])


@query(f"{_BOTH} SELECT DISTINCT kmer FROM km UNION SELECT kmer FROM nm")
def layer_union(spark, d):
    parts = [kmers.index(s, [K], fasta.RNA).select("kmer") for s in (positives(spark, d), negatives(spark, d))]
    return parts[0].union(parts[1]).distinct()


@query(f"WITH {SEQ}, {km(KS)}, {COV}, good AS (SELECT k, kmer FROM cov WHERE cov > 0.1 * (SELECT count(*) FROM pos)), l AS (SELECT k, count(DISTINCT seq_id) AS cov FROM km JOIN good USING (k, kmer) GROUP BY k) SELECT k, cov, cov - lead(cov) OVER (ORDER BY k) AS drop, cov / (SELECT count(*) FROM pos) AS rate FROM l")
def layer_coverage_drop(spark, d):
    n, i = positives(spark, d).count(), index(spark, d, KS)
    good = kmers.candidates(cov(spark, d, KS), n).select("k", "kmer")
    return kmers.layer_coverage(i.join(kmers.sent(good), ["k", "kmer"], "left_semi"), n)


@query(f"{BASE}, s AS (SELECT DISTINCT kmer, seq_id FROM km), n AS (SELECT kmer, count(*) AS n FROM s GROUP BY kmer), c AS (SELECT a.kmer AS a, b.kmer AS b, count(*) AS common FROM s a JOIN s b USING (seq_id) WHERE a.kmer > b.kmer GROUP BY ALL) SELECT c.a, c.b, round(common / (x.n + y.n - common), 9) AS similarity FROM c JOIN n x ON x.kmer = c.a JOIN n y ON y.kmer = c.b")
def coverage_jaccard(spark, d):
    return graphs.jaccard(index(spark, d).select("kmer", "seq_id")).withColumn("similarity", F.round("similarity", 9))


@query(f"{BASE}, {WORDS} SELECT count(DISTINCT seq_id) AS cov FROM km JOIN words USING (kmer)")
def coverage_bitmap(spark, d):
    bits = kmers.layer_bitmaps(index(spark, d).join(kmers.sent(outstanding(spark, d)), "kmer", "left_semi"))
    every = bits.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).agg(F.sum(F.bitmap_count("bits")).alias("cov"))
    return every.select(F.coalesce("cov", F.lit(0)).alias("cov"))  # 0 where no word stands out


@query(f"{BASE}, {WORDS} SELECT seq_id FROM pos WHERE seq_id NOT IN (SELECT seq_id FROM km JOIN words USING (kmer))")
def uncovered_sequences(spark, d):
    hit = index(spark, d).join(kmers.sent(outstanding(spark, d)), "kmer", "left_semi")
    return positives(spark, d).join(hit.select("seq_id").distinct().hint("merge"), "seq_id", "left_anti").select("seq_id")


_PPM = f"{PBASE}, hit AS (SELECT pattern, regexp_extract_all(seq, pattern) AS m FROM pats, pos WHERE regexp_matches(seq, pattern)), one AS (SELECT pattern, 1.0::DOUBLE / length(m) AS w, unnest(m) AS m FROM hit), ppm AS (SELECT pattern, i::INTEGER AS pos, substr(m, i, 1) AS chr, sum(w) AS w FROM one, range(1, 5) r(i) GROUP BY ALL)"


@query(f"{_PPM} SELECT pattern, pos, chr, round(w, 6) AS w FROM ppm")
def ppm(spark, d):
    return degenerate.ppm(patterns(spark, d), positives(spark, d)).withColumn("w", F.round("w", 6))


_F = "f AS (SELECT pattern, pos, chr, w / sum(w) OVER (PARTITION BY pattern, pos) AS f FROM ppm)"


@query(f"{_PPM}, {_F}, b AS (SELECT pattern, pos, 2 + sum(f * log2(f)) AS bits FROM f GROUP BY ALL) SELECT pattern, pos, chr, round(f * bits, 6) AS height FROM f JOIN b USING (pattern, pos)")
def ppm_logo(spark, d):
    return degenerate.logo(degenerate.ppm(patterns(spark, d), positives(spark, d))).withColumn("height", F.round("height", 6))


_PCC = f"""{_PPM}, {_F}, v AS (SELECT pattern, pos, sum(f * f) - 0.25 AS v FROM f GROUP BY ALL),
xy AS (SELECT a.pattern AS p1, b.pattern AS p2, a.pos AS i, b.pos AS j, sum(a.f * b.f) AS xy FROM f a JOIN f b ON a.chr = b.chr AND a.pattern > b.pattern GROUP BY ALL),
r AS (SELECT a.pattern AS p1, b.pattern AS p2, b.pos - a.pos AS shift, CASE WHEN sqrt(greatest(a.v * b.v, 0)) > 1e-12 THEN (coalesce(xy.xy, 0) - 0.25) / sqrt(greatest(a.v * b.v, 0)) ELSE 0 END AS r
 FROM v a JOIN v b ON a.pattern > b.pattern LEFT JOIN xy ON xy.p1 = a.pattern AND xy.p2 = b.pattern AND xy.i = a.pos AND xy.j = b.pos),
sims AS (SELECT p1, p2, shift, count(*) AS overlap, sum(r) AS pcc FROM r GROUP BY ALL HAVING count(*) >= 2)"""


def _sims(spark, d):
    return degenerate.offset_similarities(save(degenerate.ppm(patterns(spark, d), positives(spark, d)), "ppm"))


@query(f"{_PCC} SELECT p1, p2, shift AS \"offset\", overlap, round(pcc, 6) AS pcc FROM sims")
def pattern_pcc(spark, d):
    return _sims(spark, d).withColumn("pcc", F.round("pcc", 6))


@query(f"{_PCC}, z AS (SELECT p1, p2, round(pcc, 9) AS pcc FROM sims WHERE shift = 0), e AS (SELECT min(pcc) AS low, max(pcc) AS high FROM z) SELECT p1, p2, round(CASE WHEN pcc = low THEN 0.0001 WHEN pcc = high THEN 0.9999 ELSE (pcc - low) / (high - low) END, 5) AS similarity FROM z, e")
def pcc_normalized(spark, d):
    return degenerate.normalized(_sims(spark, d).where("offset = 0").withColumn("pcc", F.round("pcc", 9))).withColumn("similarity", F.round("similarity", 5))


@query(f"{_PCC} SELECT p1, p2, (-x.n)::INTEGER AS \"offset\", round(x.m, 6) AS mean_pcc FROM (SELECT p1, p2, max({{'m': round(pcc / overlap, 9), 'a': -abs(shift), 'n': -shift}}) AS x FROM sims GROUP BY ALL)")
def align_offset(spark, d):
    return degenerate.best_offsets(_sims(spark, d)).select("p1", "p2", "offset", F.round("mean_pcc", 6).alias("mean_pcc"))


_NUM = "('0x' || substr(md5('7{0}' || ref_id::VARCHAR), 1, 8))::BIGINT"
POOL = f"""{REF}, sized AS (SELECT *, 20 + {_NUM.format("n")} % 9 AS n FROM refs), cut AS (SELECT ref_id, substr(seq, ({_NUM.format("s")} % (32 - n) + 1)::BIGINT, n::BIGINT) AS seg0 FROM sized),
ref_pool AS (SELECT ref_id, string_agg(substr(seg0, i + 1, 1), '' ORDER BY md5('7' || ref_id || '/' || i)) AS seg FROM cut, range(0, 32) r(i) WHERE i < length(seg0) GROUP BY ref_id)"""


def draw(pool: str, name: str, seed: str) -> str:
    """SQL of samples of as many references of a pool as there are positive sequences: those of the least hash."""
    number = lambda i: f"('0x' || substr(m, {i}, 8))::BIGINT % {PRIME}"
    h = f"((a * x + b) % {PRIME} * x % {PRIME} + (c * y + d) % {PRIME}) % {PRIME}"
    return f"""{name}_c AS (SELECT sample_id, {number(1)} AS a, {number(9)} AS b, {number(17)} AS c, {number(25)} AS d FROM (SELECT s AS sample_id, md5('{seed}/' || s) AS m FROM range(0, {SAMPLES}) r(s))),
{name}_r AS (SELECT ref_id, {number(1)} AS x, {number(9)} AS y FROM (SELECT ref_id, md5('{seed}#' || ref_id) AS m FROM {pool})),
{name} AS (SELECT sample_id, ref_id FROM (SELECT sample_id, ref_id, row_number() OVER (PARTITION BY sample_id ORDER BY {h}, ref_id) AS nth FROM {name}_r, {name}_c) WHERE nth <= (SELECT count(*) FROM pos))"""


DRAW = draw("ref_pool", "drawn", "7")
RK = km([K], "ref_pool", "rk", "ref_id", "seg")


def _pool(spark, d):
    return background.pool(references(spark, d), 20, 28)


def _draws(spark, d):
    """Samples of as many references of the pool as there are positive sequences."""
    p = save(_pool(spark, d), "pool").withColumnRenamed("seg", "seq")
    return Draws(p, SAMPLES, positives(spark, d).count())


SUB = f"WITH {SEQ}, {km([K])}, words AS (SELECT kmer, count(DISTINCT seq_id) AS cov FROM km GROUP BY kmer), {POOL}, {DRAW}, {RK}"
HIST = f"""{SUB}, sc AS (SELECT kmer, sample_id, count(DISTINCT ref_id) AS cov FROM rk JOIN drawn USING (ref_id) GROUP BY ALL), hits AS (SELECT kmer, cov, count(*) AS freq FROM sc WHERE kmer IN (SELECT kmer FROM words) GROUP BY ALL),
hist AS (SELECT * FROM (FROM hits UNION ALL SELECT w.kmer, 0, {SAMPLES} - coalesce((SELECT sum(freq) FROM hits h WHERE h.kmer = w.kmer), 0)::BIGINT FROM words w) WHERE freq > 0)"""


def _hist(spark, d):
    words = save(cov(spark, d).select("kmer", "cov"), "words")
    return words, save(background.histograms(words, _draws(spark, d).coverage(words, "kmer"), SAMPLES, "kmer"), "hist")


@query(f"WITH {POOL} SELECT ref_id, seg FROM ref_pool")
def bg_pool(spark, d):
    return _pool(spark, d)


#: References of many lengths, some with an N for every three A in a row, and with T.
_MIXED = f"""{REF.replace("refs AS", "refs0 AS")}, refs AS (SELECT ref_id, replace(replace(left(seq, 18 + (ref_id % 15)::INT), 'AAA', 'N'), 'U', 'T') AS seq FROM refs0)"""
_REDRAWN = f"""{_MIXED}, lens AS (SELECT ref_id, seq, [{", ".join(f"20 + {_NUM.format(f'n{i or str()}')} % 9" for i in range(3))}] AS l, [{", ".join(_NUM.format(f"s{i or str()}") for i in range(5))}] AS s FROM refs),
used AS (SELECT *, CASE WHEN length(seq) > l[1] + 1 THEN 0 WHEN length(seq) > l[2] + 1 THEN 1 WHEN length(seq) > l[3] + 1 THEN 2 END AS i FROM lens),
segs AS (SELECT ref_id, list_filter(list_transform(s[1:5 - i], lambda x: substr(seq, (x % (length(seq) - l[i + 1]) + 1)::BIGINT, l[i + 1]::BIGINT)), lambda x: NOT contains(x, 'N'))[1] AS seg0 FROM used WHERE i IS NOT NULL)
SELECT ref_id, string_agg(substr(replace(seg0, 'T', 'U'), i + 1, 1), '' ORDER BY md5('7' || ref_id || '/' || i)) AS seg FROM segs, range(0, 32) r(i) WHERE i < length(seg0) GROUP BY ref_id"""


@query(f"WITH {_REDRAWN}")
def bg_pool_redrawn(spark, d):
    """A pool of references of which some are short and some have an N, so that lengths and starts are drawn again."""
    cut = F.left("seq", (18 + F.col("ref_id") % 15).cast("int"))
    refs = references(spark, d).select("ref_id", F.translate(F.replace(cut, F.lit("AAA"), F.lit("N")), "U", "T").alias("seq"))
    return background.pool(refs, 20, 28)


@query(f"WITH {SEQ}, {POOL}, {DRAW} SELECT sample_id::INTEGER AS sample_id, ref_id FROM drawn")
def bg_samples(spark, d):
    return _draws(spark, d).rows()


@query(f"{HIST} SELECT kmer, cov, freq FROM hist")
def bg_hist(spark, d):
    return _hist(spark, d)[1]


THR = f"{HIST}, cum AS (SELECT kmer, cov, sum(freq) OVER (PARTITION BY kmer ORDER BY cov) / {SAMPLES} AS c FROM hist), thr AS (SELECT kmer, min(cov) AS threshold FROM cum WHERE c >= 0.99 GROUP BY kmer)"


@query(f"{THR} FROM thr")
def bg_threshold(spark, d):
    return background.thresholds(_hist(spark, d)[1])


@query(f"{THR} SELECT kmer, cov, threshold FROM words JOIN thr USING (kmer) WHERE cov > threshold")
def kmer_significant(spark, d):
    words, hist = _hist(spark, d)
    return words.join(background.thresholds(hist), "kmer").where("cov > threshold")


@query(f"""{HIST}, j AS (SELECT w.kmer, w.cov AS c, h.cov, h.freq FROM words w JOIN hist h USING (kmer)),
a AS (SELECT kmer, c, sum(freq) AS n, coalesce(sum(freq) FILTER (cov >= c), 0) AS o, coalesce(sum(freq // 2) FILTER (cov = c - 1), 0) AS half, max_by(freq, cov) FILTER (cov < c) AS bf, max(cov) FILTER (cov < c) AS bc FROM j GROUP BY ALL)
SELECT kmer, c AS cov, round(o / n, 9) AS p_basic, round((o + half) / n, 9) AS p_half, round(CASE WHEN o > 0 THEN o / n ELSE bf * pow(0.5, c - bc) / n END, 9) AS p_extrapolated FROM a""")
def kmer_pvalues(spark, d):
    p = background.p_values(*_hist(spark, d))
    return p.select("kmer", "cov", *[F.round(c, 9).alias(c) for c in ("p_basic", "p_half", "p_extrapolated")])


_EXACT = """m AS (SELECT count(*) AS size, (SELECT count(*) FROM pos) AS n FROM ref_pool), rc AS (SELECT kmer, count(DISTINCT ref_id) AS c FROM rk GROUP BY kmer),
x AS (SELECT w.kmer, w.cov, coalesce(c, 0) AS c, size, n, unnest(range(w.cov, least(coalesce(c, 0), n) + 1)) AS x FROM words w LEFT JOIN rc USING (kmer), m),
lf AS (SELECT kmer, cov, exp(lgamma(c + 1) - lgamma(x + 1) - lgamma(c - x + 1) + lgamma(size - c + 1) - lgamma(n - x + 1) - lgamma(size - c - n + x + 1) - lgamma(size + 1) + lgamma(n + 1) + lgamma(size - n + 1)) AS p FROM x WHERE x >= n + c - size)"""


@query(f"{SUB}, {_EXACT} SELECT kmer, w.cov, round(least(coalesce(sum(p), 0), 1), 6) AS p FROM words w LEFT JOIN lf USING (kmer) GROUP BY kmer, w.cov")
def pvalue_exact(spark, d):
    pool = save(_pool(spark, d), "pool")
    ref = kmers.counted(pool.select(F.col("ref_id").alias("seq_id"), F.col("seg").alias("seq")), [K]).select("kmer", F.col("cov").alias("c"))
    d2 = cov(spark, d).select("kmer", "cov").join(ref, "kmer", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    number = lambda n: F.lit(n).cast("long")
    return d2.select("kmer", "cov", F.round(background.exact_p(F.col("cov"), number(positives(spark, d).count()), F.col("c"), number(pool.count())), 6).alias("p"))


_FEWP = f"WITH {SEQ}, {km([K])}, {COV}, {PATTERNS}, {EXPANDED}, {POOL}, {DRAW}, {RK}"


@query(f"""{_FEWP}, words AS (SELECT pattern, count(DISTINCT seq_id) AS cov FROM expd JOIN km USING (kmer) GROUP BY pattern),
sc AS (SELECT pattern, sample_id, count(DISTINCT ref_id) AS cov FROM expd JOIN rk USING (kmer) JOIN drawn USING (ref_id) GROUP BY ALL), hits AS (SELECT pattern, cov, count(*) AS freq FROM sc GROUP BY ALL),
hist AS (SELECT * FROM (FROM hits UNION ALL SELECT w.pattern, 0, {SAMPLES} - coalesce((SELECT sum(freq) FROM hits h WHERE h.pattern = w.pattern), 0)::BIGINT FROM words w) WHERE freq > 0),
j AS (SELECT w.pattern, w.cov AS c, h.cov, h.freq FROM words w JOIN hist h USING (pattern)), a AS (SELECT pattern, c, sum(freq) AS n, coalesce(sum(freq) FILTER (cov >= c), 0) AS o, max_by(freq, cov) FILTER (cov < c) AS bf, max(cov) FILTER (cov < c) AS bc FROM j GROUP BY ALL)
SELECT pattern, c AS cov, round(least((CASE WHEN o > 0 THEN o / n ELSE bf * pow(0.5, c - bc) / n END) * (SELECT count(*) FROM pats), 1), 9) AS p_adjusted FROM a""")
def pattern_pvalue(spark, d):
    pats = patterns(spark, d)
    tests = pats.count()
    words = save(degenerate.coverage(pats, index(spark, d)), "words")
    hist = background.histograms(words, _draws(spark, d).coverage(degenerate.expansions(pats), "pattern"), SAMPLES, "pattern")
    p = background.p_values(words, hist, "pattern")
    return p.select("pattern", "cov", F.round(background.bonferroni(F.col("p_extrapolated"), F.lit(tests)), 9).alias("p_adjusted"))


@query(f"""{PBASE}, {NEG}, {km([K], 'neg', 'nm')}, pc AS (SELECT pattern, count(DISTINCT seq_id) AS a FROM expd JOIN km USING (kmer) GROUP BY ALL), nc AS (SELECT pattern, count(DISTINCT seq_id) AS c FROM expd JOIN nm USING (kmer) GROUP BY ALL),
t AS (SELECT pattern, coalesce(a, 0) AS a, (SELECT count(*) FROM pos) - coalesce(a, 0) AS b, coalesce(c, 0) AS c, (SELECT count(*) FROM neg) - coalesce(c, 0) AS d FROM pats LEFT JOIN pc USING (pattern) LEFT JOIN nc USING (pattern)),
x AS (SELECT *, a + b AS r, a + c AS q, a + b + c + d AS n, unnest(range(greatest(0, a + c - c - d), least(a + b, a + c) + 1)) AS x FROM t),
l AS (SELECT *, lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(n - r + 1) - lgamma(q - x + 1) - lgamma(n - r - q + x + 1) - lgamma(n + 1) + lgamma(q + 1) + lgamma(n - q + 1) AS lp FROM x),
h AS (SELECT pattern, max(exp(lp)) FILTER (x = a) AS here FROM l GROUP BY ALL)
SELECT pattern, a AS pos_cov, c AS neg_cov, round(least(sum(exp(lp)) FILTER (exp(lp) <= here * (1 + 1e-7)), 1), 6) AS p FROM l JOIN h USING (pattern) GROUP BY ALL""")
def negative_fisher(spark, d):
    pats, pos, neg = patterns(spark, d), positives(spark, d), negatives(spark, d)
    n_pos, n_neg = pos.count(), neg.count()
    a = degenerate.coverage(pats, kmers.index(pos, [K], fasta.RNA)).withColumnRenamed("cov", "a")
    c = degenerate.coverage(pats, kmers.index(neg, [K], fasta.RNA)).withColumnRenamed("cov", "c")
    t = pats.join(a, "pattern", "left").join(c, "pattern", "left").select("pattern", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("c", F.lit(0)).alias("c"))
    p = background.fisher(F.col("a"), n_pos - F.col("a"), F.col("c"), n_neg - F.col("c"))
    return t.select("pattern", F.col("a").alias("pos_cov"), F.col("c").alias("neg_cov"), F.round(p, 6).alias("p"))


@query("SELECT CASE WHEN l_quantity < 1 THEN 0 WHEN l_quantity >= 51 THEN 6 ELSE floor((l_quantity - 1) / 10)::INTEGER + 1 END::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY ALL")
def value_histogram(spark, d):
    return compare.histogram(table(spark, d, "lineitem"), "l_quantity", 1, 51, 5)


@query("SELECT event_type AS value, count(*) OVER (PARTITION BY event_type) AS n, event_id AS id FROM events")
def value_freq(spark, d):
    """Every value's count and the ids that have it, one row for each id."""
    e = table(spark, d, "events")
    n = e.groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n"))
    return e.select(F.col("event_type").alias("value"), F.col("event_id").alias("id")).join(n, "value").select("value", "n", "id")


@query(f"""WITH {SEQ}, {NEG}, {km([3])}, {km([3], 'neg', 'nm')}, u AS (SELECT kmer, 'pos' AS side, count(DISTINCT seq_id) / (SELECT count(*) FROM pos) AS rate FROM km GROUP BY kmer UNION ALL SELECT kmer, 'neg', count(DISTINCT seq_id) / (SELECT count(*) FROM neg) FROM nm GROUP BY kmer)
SELECT CASE WHEN a.side = b.side THEN 'in' ELSE 'trans' END AS kind, count(*) AS n, round(avg(abs(a.rate - b.rate)), 9) AS mean_gap FROM u a JOIN u b ON a.kmer || a.side > b.kmer || b.side GROUP BY ALL""")
def cross_dataset_simi(spark, d):
    parts = {"pos": positives(spark, d), "neg": negatives(spark, d)}
    rates = [kmers.counted(s, [3], fasta.RNA).select("kmer", F.lit(side).alias("side"), (F.col("cov") / s.count()).alias("rate")) for side, s in parts.items()]
    return compare.pair_gaps(rates[0].unionByName(rates[1])).withColumn("mean_gap", F.round("mean_gap", 9))


@query("""WITH e AS (SELECT DISTINCT user_id, event_type FROM events), p AS (SELECT a.event_type AS p1, b.event_type AS p2, a.user_id FROM e a JOIN e b USING (user_id) WHERE a.event_type < b.event_type)
SELECT p1, p2, count(*) AS n, min(user_id) AS first_set FROM p GROUP BY ALL HAVING count(*) > 1""")
def cooccur_multi(spark, d):
    return compare.coexisting(table(spark, d, "events"), "user_id", "event_type")


@query(f"WITH {SEQ}, w AS (SELECT l_partkey AS seq_id, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL) SELECT seq_id, seq, CASE WHEN weight >= 750 THEN 'positive' ELSE 'negative' END AS side FROM pos JOIN w USING (seq_id)")
def posneg_split(spark, d):
    w = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("seq_id")).agg(F.sum("l_quantity").alias("weight"))
    return compare.split_by_weight(positives(spark, d).join(w, "seq_id"), 750)


@query(f"""WITH {SEQ}, w AS (SELECT l_orderkey AS id, l_partkey AS accession, l_suppkey % 20 AS "first", l_suppkey % 20 + 3 + l_linenumber AS "last" FROM lineitem),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "last" - "first", accession, "first") AS nth FROM w) WHERE nth = 1)
SELECT id, accession, substr(seq, ("first" + 1)::BIGINT, ("last" - "first" + 1)::BIGINT) AS seq FROM one JOIN pos ON accession = seq_id""")
def segment_lookup(spark, d):
    first = F.col("l_suppkey") % 20
    w = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("accession"), first.alias("first"), (first + 3 + F.col("l_linenumber")).alias("last"))
    return compare.segments(w, positives(spark, d))


@query("SELECT user_id, day, length(s) AS letters, greatest(length(s) - 2, 0) AS n_kmers FROM (SELECT user_id, ts::DATE AS day, string_agg(upper(left(event_type, 1)), '' ORDER BY ts, event_id) AS s FROM events GROUP BY ALL)")
def event_sequences(spark, d):
    s = compare.event_strings(table(spark, d, "events"))
    return s.select("user_id", "day", F.length("seq").cast("long").alias("letters"), F.size(P.kmers(F.col("seq"), 3)).cast("long").alias("n_kmers"))


@query("SELECT p_partkey, p_size AS a, (p_partkey % 60 + 1)::BIGINT AS b, gcd(p_size, p_partkey % 60 + 1)::BIGINT AS gcd, lcm(p_size, p_partkey % 60 + 1)::BIGINT AS lcm FROM part")
def number_helpers(spark, d):
    a, b = F.col("p_size"), F.col("p_partkey") % 60 + 1
    return table(spark, d, "part").select("p_partkey", a.alias("a"), b.alias("b"), N.gcd(a, b).alias("gcd"), N.lcm(a, b).alias("lcm"))


@query("""WITH o AS (SELECT o_custkey, list(epoch_ms(o_orderdate) // 86400000) FILTER (o_orderstatus = 'F') AS a, list(epoch_ms(o_orderdate) // 86400000) FILTER (o_orderstatus <> 'F') AS b FROM orders GROUP BY o_custkey)
SELECT o_custkey, coalesce((SELECT min(y - x) FROM (SELECT unnest(a) AS x), (SELECT unnest(b) AS y) WHERE y > x), -1)::BIGINT AS days FROM o""")
def least_offset(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.floor(F.unix_timestamp("o_orderdate") / 86400).alias("day"), (F.col("o_orderstatus") == "F").alias("done"))
    return N.least_offsets(o, "o_custkey", "day", "done").select("o_custkey", F.col("least").alias("days"))


@query(f"WITH {SEQ} SELECT seq_id, i::BIGINT AS n, length(seq) - i + 1 AS runs, left(seq, i::BIGINT) AS first FROM pos, range(1, 4) r(i)")
def list_ngrams(spark, d):
    letters = F.filter(F.split("seq", ""), lambda c: c != "")
    p = positives(spark, d).withColumn("letters", letters)
    parts = [p.select("seq_id", F.lit(n).cast("long").alias("n"), N.ngrams(F.col("letters"), n).alias("g")) for n in (1, 2, 3)]
    return parts[0].union(parts[1]).union(parts[2]).select("seq_id", "n", F.size("g").cast("long").alias("runs"), F.array_join(F.col("g")[0], "").alias("first"))


@query("SELECT (i - 1)::INTEGER AS pos, string_agg(substr(n_name, i, 1), '' ORDER BY n_nationkey) AS letters FROM nation, range(1, 40) r(i) WHERE i <= length(n_name) GROUP BY i")
def transposed(spark, d):
    return N.transposed(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("seq")))


@query(f"{_PPM}, {_F} SELECT pattern, pos, chr, round(log2(f / 0.25), 2) AS score FROM f")
def pwm_log_odds(spark, d):
    m = degenerate.ppm(patterns(spark, d), positives(spark, d))
    total = m.groupBy("pattern", "pos").agg(F.sum("w").alias("all"))
    return m.join(total, ["pattern", "pos"]).select("pattern", "pos", "chr", N.log_odds(F.col("w") / F.col("all"), F.lit(0.25)).alias("score"))


@query(f"{PBASE} SELECT pattern, (i - 1)::INTEGER AS pos, substr(kmer, i, 1) AS chr, count(*) AS n FROM expd, range(1, 5) r(i) GROUP BY ALL")
def pwm_counts(spark, d):
    return degenerate.pwm_counts(degenerate.expansions(patterns(spark, d)))


@query(f"{HIST} SELECT w.kmer, w.cov, round(coalesce(sum(freq) FILTER (h.cov <= w.cov), 0) / sum(freq), 9) AS share FROM words w JOIN hist h USING (kmer) GROUP BY w.kmer, w.cov")
def distribution_share(spark, d):
    words, hist = _hist(spark, d)
    return background.share_up_to(hist, words).withColumn("share", F.round("share", 9))


@query()
def merged_tops(spark, d):
    return search.merged_tops(cov(spark, d), index(spark, d), 20)


@query()
def pattern_search(spark, d):
    return search.patterns(kmers.candidates(cov(spark, d), positives(spark, d).count()), index(spark, d), K)


@query()
def louvain_clusters(spark, d):
    sims = degenerate.best_offsets(_sims(spark, d)).where("mean_pcc > 0.2").select(F.col("p1").alias("a"), F.col("p2").alias("b"), F.col("mean_pcc").alias("w"))
    return search.communities(sims)


def _clustered(spark, d):
    clusters = save(louvain_clusters(spark, d), "clusters")
    pats = patterns(spark, d)
    members = degenerate.held(pats, index(spark, d))
    ic = pats.select("pattern", P.ic(F.col("pattern")).alias("ic"))
    return members.join(F.broadcast(clusters), "pattern").join(F.broadcast(ic), "pattern")  # 64 patterns at most


@query()
def cluster_cores(spark, d):
    return search.cores(_clustered(spark, d), positives(spark, d).count())


@query()
def final_motifs(spark, d):
    members = save(_clustered(spark, d), "members")
    return search.final(search.cores(members, positives(spark, d).count()), members)
