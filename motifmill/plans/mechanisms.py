"""Queries of doubled paths, simple paths, ancestry, outlines, alignment p-values and data jobs, registered beside those of `catalog`."""

from __future__ import annotations

from pyspark.sql import functions as F

from motifmill.functions import patterns as P
from motifmill.operators import align, compare, degenerate, graphs, kmers, report, search
from motifmill.plans import catalog as c
from motifmill.plans import reports
from motifmill.plans.catalog import query
from motifmill.session import save
from motifmill.sources import fasta

LONGEST = 20


@query(f"WITH {c.SEQ}, {c.km(range(2, LONGEST + 1))} SELECT k, kmer, count(*) AS visits, count(DISTINCT seq_id) AS cov FROM km GROUP BY ALL HAVING count(DISTINCT seq_id) >= 2")
def frequent_paths(spark, d):
    """All runs of 2 to 20 letters that two sequences or more have."""
    return kmers.frequent_paths(c.positives(spark, d), LONGEST, 2)


_PLACE = "list_sort(list_distinct(list_transform(seen, lambda x: substr(x, {0}, 1))))"
_MERGED = " || ".join(f"CASE WHEN len({_PLACE.format(i)}) > 1 THEN '[' || array_to_string({_PLACE.format(i)}, '') || ']' ELSE {_PLACE.format(i)}[1] END" for i in (1, 2, 3))


@query(f"""WITH RECURSIVE {c.SEQ}, {c.km([3])}, {c.COV}, words AS (SELECT kmer FROM cov WHERE cov > (SELECT avg(cov) + stddev_samp(cov) FROM cov)),
e AS (SELECT a.kmer AS u, b.kmer AS v FROM words a JOIN words b ON a.kmer <> b.kmer),
p AS (SELECT DISTINCT u AS last, [u] AS seen FROM e UNION SELECT v, list_sort(list_append(seen, v)) FROM p JOIN e ON last = u WHERE NOT list_contains(seen, v))
SELECT DISTINCT array_to_string(seen, ',') AS nodes, len(seen)::INTEGER AS n, {_MERGED} AS pattern FROM p""")
def simple_paths(spark, d):
    """The node sets of all simple paths through 3-mers that stand out, which are all alike, and the patterns that they merge to."""
    cov = save(c.cov(spark, d, [3]), "cov")
    least = cov.agg((F.avg("cov") + F.stddev_samp("cov")).alias("least"))
    near = save(graphs.similarity(cov.join(F.broadcast(least), F.col("cov") > F.col("least")), 3), "near")
    sets = save(graphs.simple_paths(near), "sets")
    merged = degenerate.segment_merge(sets.select("nodes", F.explode(F.split("nodes", ",")).alias("kmer")), "nodes")
    return sets.join(merged, "nodes")


_LINKS = """links AS (SELECT c.kmer AS child, p.kmer AS parent FROM good c JOIN good p ON p.k = c.k - 1 AND (left(c.kmer, p.k) = p.kmer OR right(c.kmer, p.k) = p.kmer))"""


@query(f"""WITH RECURSIVE {c.SEQ}, {c.km(c.KS)}, {c.COV}, {c._LAYERS}, {_LINKS},
anc AS (SELECT DISTINCT child, parent AS ancestor FROM links UNION SELECT a.child, l.parent FROM anc a JOIN links l ON l.child = a.ancestor),
up AS (SELECT child AS kmer, count(*) AS n_ancestors, string_agg(ancestor, ',' ORDER BY ancestor) FILTER (ancestor NOT IN (SELECT child FROM links)) AS roots FROM anc GROUP BY child),
down AS (SELECT ancestor AS kmer, count(*) AS n_descendants FROM anc GROUP BY ancestor),
below AS (SELECT ancestor AS kmer, count(DISTINCT seq_id) AS below FROM anc JOIN km ON km.kmer = anc.child GROUP BY ancestor)
SELECT g.kmer, c.cov, coalesce(n_ancestors, 0) AS n_ancestors, coalesce(roots, g.kmer) AS roots, coalesce(n_descendants, 0) AS n_descendants, coalesce(below, 0) AS below
FROM good g JOIN cov c USING (k, kmer) LEFT JOIN up USING (kmer) LEFT JOIN down USING (kmer) LEFT JOIN below USING (kmer)""")
def kmer_ancestry(spark, d):
    """Ancestors, roots and what descendants cover, of the k-mers of over average coverage of all lengths."""
    index = c.index(spark, d, c.KS)
    cov = save(c.cov(spark, d, c.KS), "cov")
    good = save(cov.join(F.broadcast(cov.groupBy("k").agg(F.avg("cov").alias("t"))), "k").where("cov > t").select("k", "kmer", "cov"), "good")
    links = None
    for k in c.KS[1:]:
        t = graphs.tree(good.where(F.col("k") == k), good.where(F.col("k") == k - 1), k).where(~F.col("parent").contains("_")).select("child", "parent")
        links = t if links is None else links.union(t)
    held = index.join(kmers.sent(good.select("kmer")), "kmer", "left_semi").select("kmer", "seq_id").distinct()
    return graphs.lineage(save(links, "links"), good, held)


_DEPTHS = range(5)
_AT = ", ".join(f"coalesce(max(CASE WHEN depth = {i} THEN n END) OVER w, -1) AS n{i}, last_value(CASE WHEN depth = {i} THEN line END IGNORE NULLS) OVER w AS l{i}" for i in _DEPTHS)
_VALID = [f"CASE WHEN depth > {i} AND n{i} > {'greatest(' + ', '.join(f'n{j}' for j in range(i)) + ')' if i else '-1'} THEN l{i} END" for i in _DEPTHS]


@query(f"""WITH o AS (SELECT p_partkey AS n, p_size % {len(_DEPTHS)} AS depth, p_name || ' ' || p_partkey AS line FROM part),
s AS (SELECT *, {_AT} FROM o WINDOW w AS (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT n, line, list_filter([{", ".join(_VALID)}], lambda x: x IS NOT NULL) AS above FROM s)
SELECT n, len(above)::INTEGER AS depth, array_to_string(list_append(above, line), ' / ') AS path FROM a""")
def outline_paths(spark, d):
    """Parts as lines of an outline, indented by their size: each with all its ancestors."""
    line = F.concat(F.expr(f"repeat('  ', p_size % {len(_DEPTHS)})"), "p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    return compare.indented(c.table(spark, d, "part").select(F.col("p_partkey").alias("n"), line.alias("line")))


_RUNS = "\n".join(f"r{n} AS (SELECT r.query, r.first, p.i AS last, r.s + p.step AS s, sum(r.p * p.p) AS p FROM r{n - 1} r JOIN p0 p ON p.query = r.query AND p.i = r.last + 1 GROUP BY ALL)," for n in range(2, c.K + 1))


@query(f"""{c._PPM}, {c._F}, sh AS (SELECT pattern, (pos - 1)::INTEGER AS i, {", ".join(f"coalesce(max(f) FILTER (chr = '{x}'), 0) - 0.25::DOUBLE AS {x}" for x in "ACGU")} FROM f GROUP BY ALL),
nm AS (SELECT *, sqrt(A * A + C * C + G * G + U * U) AS m FROM sh),
u AS (SELECT pattern, i, {", ".join(f"round(CASE WHEN m > 1e-6 THEN {x} / m ELSE 0 END, 12) AS {x}" for x in "ACGU")} FROM nm),
st AS (SELECT a.pattern AS query, a.i, b.pattern AS target, b.i AS j, floor(round((a.A * b.A + a.C * b.C + a.G * b.G + a.U * b.U + 1) * {align.STEPS} / 2, 9) + 0.5)::BIGINT AS step FROM u a, u b),
c0 AS (SELECT query, i, step, count(*) AS n FROM st GROUP BY query, i, step), p0 AS (SELECT query, i, step, n / sum(n) OVER (PARTITION BY query, i) AS p FROM c0),
r1 AS (SELECT query, i AS first, i AS last, step AS s, p FROM p0),
{_RUNS}
runs AS ({" UNION ALL ".join(f"SELECT * FROM r{n}" for n in range(1, c.K + 1))}),
sc AS (SELECT query, target, (j - i)::INTEGER AS shift, count(*) AS overlap, sum(step)::BIGINT AS score, min(i) AS first, max(i) AS last FROM st WHERE query <> target GROUP BY ALL HAVING count(*) >= 2),
kinds AS (SELECT DISTINCT query, first, last, score FROM sc),
tails AS (SELECT k.query, k.first, k.last, k.score, sum(p) AS p FROM kinds k JOIN runs r ON r.query = k.query AND r.first = k.first AND r.last = k.last AND r.s >= k.score GROUP BY ALL),
b AS (SELECT query, target, count(*) AS offsets, min({{'l': round(ln(p), 9), 'a': abs(shift), 'o': shift, 'n': overlap, 's': score}}) AS b, min(p) AS p FROM sc JOIN tails USING (query, first, last, score) GROUP BY ALL),
m AS (SELECT query, target, b.o AS shift, b.n AS overlap, b.s AS score, 1 - pow(1 - p, offsets) AS p FROM b),
q AS (SELECT *, p * count(*) OVER (PARTITION BY query) / (count(*) OVER (PARTITION BY query) - rank() OVER (PARTITION BY query ORDER BY p DESC) + 1) AS raw FROM m)
SELECT query, target, shift AS "offset", overlap, score, round(p, 6) AS p, round(p * ((SELECT count(*) FROM pats) - 1), 6) AS e, round(least(min(raw) OVER (PARTITION BY query ORDER BY p DESC RANGE UNBOUNDED PRECEDING), 1), 6) AS q FROM q""")
def align_pvalue(spark, d):
    """Every pattern's best alignment with every other, by the chance of its score."""
    out = align.aligned(degenerate.ppm(c.patterns(spark, d), c.positives(spark, d)))
    return out.select("query", "target", "offset", "overlap", "score", *[F.round(x, 6).alias(x) for x in ("p", "e", "q")])


@query()
def pattern_bisected(spark, d):
    """Patterns of ever narrower windows, grown from k-mers a standard deviation over the mean coverage."""
    i = c.index(spark, d)
    cov = save(c.cov(spark, d), "cov")
    least = cov.agg((F.avg("cov") + F.stddev_samp("cov")).alias("least"))
    return search.bisected(cov.join(F.broadcast(least), F.col("cov") > F.col("least")), i, c.K)


_SHORT = f"short AS (SELECT c_custkey::BIGINT AS seq_id, left(translate(md5('neg' || c_custkey::VARCHAR),{c._HEX}), 16) AS seq FROM customer)"


@query(f"""WITH {c.SEQ}, {c.km([c.K])}, {c.COV}, {c.PATTERNS}, {c.EXPANDED}, {_SHORT}, {c.km([c.K], "short", "nm")},
pc AS (SELECT pattern, count(DISTINCT seq_id) AS a FROM expd JOIN km USING (kmer) GROUP BY ALL), nc AS (SELECT pattern, count(DISTINCT seq_id) AS c FROM expd JOIN nm USING (kmer) GROUP BY ALL),
t AS (SELECT pattern, a, (SELECT count(*) FROM pos) - a AS b, coalesce(c, 0) AS c, (SELECT count(*) FROM short) - coalesce(c, 0) AS d FROM pc LEFT JOIN nc USING (pattern)),
x AS (SELECT *, a + b AS r, a + c AS q, a + b + c + d AS n, unnest(range(greatest(0, a + c - c - d), least(a + b, a + c) + 1)) AS x FROM t),
l AS (SELECT *, lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(n - r + 1) - lgamma(q - x + 1) - lgamma(n - r - q + x + 1) - lgamma(n + 1) + lgamma(q + 1) + lgamma(n - q + 1) AS lp FROM x),
h AS (SELECT pattern, max(exp(lp)) FILTER (x = a) AS here FROM l GROUP BY ALL), f AS (SELECT pattern, a, c, least(sum(exp(lp)) FILTER (exp(lp) <= here * (1 + 1e-7)), 1) AS p FROM l JOIN h USING (pattern) GROUP BY ALL)
SELECT pattern, a AS pos_cov, c AS neg_cov, round(least(p * (SELECT count(*) FROM t), 1), 6) AS p FROM f WHERE p * (SELECT count(*) FROM t) < 0.05""")
def negative_short(spark, d):
    """Patterns that differ from negative sequences which are half as long."""
    short = fasta.hashed(c.table(spark, d, "customer"), "c_custkey", "neg").withColumn("seq", F.left("seq", F.lit(16)))
    pats = save(degenerate.coverage(c.patterns(spark, d), c.index(spark, d)), "pos_cov")
    hits = degenerate.coverage(pats.select("pattern"), kmers.index(short, [c.K], fasta.RNA))
    return report.against_negatives(pats, hits, c.positives(spark, d).count(), short.count()).withColumn("p", F.round("p", 6))


@query("""SELECT split_part(p_name, ' ', 1) AS category, count(*) AS n, string_agg(DISTINCT substr(p_name, strpos(p_name, ' ') + 1), ',' ORDER BY substr(p_name, strpos(p_name, ' ') + 1)) AS members FROM part GROUP BY ALL""")
def named_categories(spark, d):
    return compare.by_prefix(c.table(spark, d, "part"), "p_name", " ")


@query("""SELECT DISTINCT lower(p_name) AS id, lower(p_brand) AS species FROM part WHERE p_size IN (SELECT DISTINCT s_nationkey FROM supplier)""")
def distinct_species(spark, d):
    """Names and brands, in lower case, of parts whose size is one of the suppliers' nations."""
    wanted = c.table(spark, d, "supplier").select(F.col("s_nationkey").alias("experiment"))
    rows = c.table(spark, d, "part").select(F.col("p_name").alias("id"), F.col("p_brand").alias("species"), F.col("p_size").alias("experiment"))
    return compare.distinct_species(rows, wanted)


@query(f"""WITH {c.SEQ}, p AS (SELECT *, CASE WHEN seq_id % 7 = 0 THEN replace(seq, 'GGG', 'N') WHEN seq_id % 5 = 0 THEN replace(seq, 'CC', 'S') ELSE seq END AS s FROM pos)
SELECT '>s' || seq_id AS title, s AS seq FROM p WHERE NOT contains(s, 'N') AND NOT contains(s, 'S')""")
def clean_records(spark, d):
    """Records without N or S, titled."""
    i, seq = F.col("seq_id"), F.col("seq")
    dirty = F.when(i % 7 == 0, F.replace(seq, F.lit("GGG"), F.lit("N"))).when(i % 5 == 0, F.replace(seq, F.lit("CC"), F.lit("S"))).otherwise(seq)
    d2 = c.positives(spark, d).select(F.concat(F.lit("s"), i.cast("string")).alias("title"), dirty.alias("seq"))
    return compare.clean_records(d2).select(F.concat(F.lit(">"), "title").alias("title"), "seq")


@query(f"{c.BASE}, one AS (SELECT left(kmer, 1) AS species, count(*) AS n, count(DISTINCT seq_id) AS seqs FROM km GROUP BY ALL) SELECT species, n, seqs, CASE WHEN species = 'A' THEN 'positive' ELSE 'negative' END AS side FROM one")
def titled_sides(spark, d):
    """k-mers by the first letter of their title, one letter against the rest."""
    named = compare.by_title(c.index(spark, d).withColumnRenamed("kmer", "title"), 1)
    one = named.groupBy("species").agg(F.count("*").alias("n"), F.countDistinct("seq_id").alias("seqs"))
    return compare.one_against_rest(one, "species", "A")


@query(f"""{reports._ALIGNED.replace(c._PPM, reports._TWO)}, z AS (SELECT p1, p2, round(similarity, 9) AS s FROM simi), e AS (SELECT min(s) AS low, max(s) AS high FROM z),
nz AS (SELECT p1, p2, CASE WHEN s = low THEN 0.0001 WHEN s = high THEN 0.9999 ELSE (s - low) / (high - low) END AS s FROM z, e)
SELECT CASE WHEN right(p1, 3) = right(p2, 3) THEN 'in' ELSE 'trans' END AS kind, count(*) AS n, round(avg(s), 5) AS mean FROM nz GROUP BY ALL""")
def cross_dataset_aligned(spark, d):
    """Matrices of the same patterns in two data sets at their best offsets, their similarities scaled to 0 to 1."""
    pats = c.patterns(spark, d)
    named = lambda t, side: t.withColumn("pattern", F.concat("pattern", F.lit(f"_{side}")))
    both = save(named(degenerate.ppm(pats, c.positives(spark, d)), "pos").unionByName(named(degenerate.ppm(pats, c.negatives(spark, d)), "neg")), "ppm")
    sims, best = reports._aligned(degenerate.offset_similarities(both))
    lengths = both.groupBy("pattern").agg(F.max("pos").alias("n"))
    aligned = report.aligned_similarity(sims, best, lengths).withColumn("similarity", F.round("similarity", 9))
    side = both.select("pattern").distinct().withColumn("side", F.right("pattern", F.lit(3)))
    return report.across(degenerate.normalized(aligned, "similarity"), side).withColumn("mean", F.round("mean", 5))


@query("""WITH s AS (SELECT n_nationkey, upper(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) AS s FROM nation), l AS (SELECT n_nationkey, len(s) AS m, unnest(regexp_extract_all(s, '.')) AS c FROM s),
f AS (SELECT n_nationkey, c, count(*) / min(m) AS f FROM l GROUP BY ALL) SELECT n_nationkey, round(sum(f * log10(4 * f)), 6) AS ic FROM f GROUP BY n_nationkey""")
def string_ic(spark, d):
    """The information content of each nation's letters, as if they were one column."""
    letters = F.upper(F.regexp_replace("n_name", "[^A-Za-z]", ""))
    return c.table(spark, d, "nation").select("n_nationkey", F.round(P.string_ic(letters), 6).alias("ic"))
