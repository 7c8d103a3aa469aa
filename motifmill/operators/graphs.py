"""Similarity graphs of k-mers and the hierarchy of k-mers by length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifmill.functions import patterns as P
from motifmill.session import save


def similarity(kmers: DataFrame, k: int, alike: Callable[[Column, Column, int], Column] = P.similar) -> DataFrame:
    """Pairs u > v of k-mers that are alike. There are 4**k k-mers at most, whatever the number of sequences.

    From k = 4 on pairs are found through a 2-mer that they share at one place, not by comparing all.
    """
    d = kmers.select("kmer").distinct()
    if alike is P.similar and k >= 4:
        keyed = d.select("kmer", F.posexplode(P.kmers(F.col("kmer"), 2)).alias("place", "part"))
        a, b = keyed.withColumnRenamed("kmer", "u"), keyed.withColumnRenamed("kmer", "v")
        pairs = a.join(b, ["place", "part"]).where("u > v").groupBy("u", "v").agg(F.count("*").alias("same"))
        return pairs.where(F.col("same") >= k - 3).select("u", "v")
    a, b = d.withColumnRenamed("kmer", "u"), d.withColumnRenamed("kmer", "v")
    return a.join(b, (F.col("u") > F.col("v")) & alike(F.col("u"), F.col("v"), k))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of undirected edges (u, v): the least node that each is connected with.

    Each round a node takes the least label of its neighbours, then the label of its label, so that chains
    halve; labels only fall, and the last round changes none.
    """
    both = save(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "both")
    label = save(both.select(F.col("u").alias("id")).distinct().withColumn("component", F.col("id")), "component")
    while True:
        near = both.join(label.select(F.col("id").alias("v"), "component"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("least"))
        near = label.join(near, "id").select("id", "component", F.least("component", "least").alias("least"))
        jump = label.select(F.col("id").alias("least"), F.col("component").alias("further"))
        new = save(near.join(jump, "least").select("id", F.least("least", "further").alias("component"), (F.least("least", "further") < F.col("component")).alias("fell")), "component")
        label = new.select("id", "component")
        if new.where("fell").isEmpty():
            return label


def ancestry(links: DataFrame) -> DataFrame:
    """(child, ancestor, distance) of all chains in (child, parent), which may not be circular; the least distance where several chains lead to an ancestor.

    Chains double in length each round: those of up to d steps joined with themselves are those of up to 2 d.
    """
    chains = save(links.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct(), "chains")
    reach = 1
    while True:
        further = chains.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("top"), F.col("distance").alias("more"))
        joined = chains.join(further, "ancestor").select("child", F.col("top").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        longer = save(chains.union(joined).groupBy("child", "ancestor").agg(F.min("distance").alias("distance")), "chains")
        chains, reach = longer, 2 * reach
        if chains.where(F.col("distance") > reach // 2).isEmpty():
            return chains


def lineage(links: DataFrame, cov: DataFrame, holders: DataFrame) -> DataFrame:
    """(kmer, cov, n_ancestors, roots, n_descendants, below) of each k-mer of (kmer, cov): the ancestors without a parent, and the sequences that have any descendant.

    links is (child, parent), holders (kmer, seq_id), distinct. A k-mer without ancestors is its own root.
    """
    chains = save(ancestry(links), "ancestry")
    tops = chains.join(links.select(F.col("child").alias("ancestor")).distinct(), "ancestor", "left_anti").groupBy("child").agg(F.array_join(F.array_sort(F.collect_set("ancestor")), ",").alias("roots"))
    up = chains.groupBy("child").agg(F.count("*").alias("n_ancestors"))
    down = chains.groupBy("ancestor").agg(F.count("*").alias("n_descendants"))
    held = chains.join(holders.withColumnRenamed("kmer", "child"), "child").select("ancestor", "seq_id").distinct().groupBy("ancestor").agg(F.count("*").alias("below"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    d = cov.select("kmer", "cov")
    for t, key in ((up, "child"), (tops, "child"), (down, "ancestor"), (held, "ancestor")):
        d = d.join(t.withColumnRenamed(key, "kmer"), "kmer", "left")
    return d.select("kmer", "cov", number("n_ancestors"), F.coalesce("roots", "kmer").alias("roots"), number("n_descendants"), number("below"))


def simple_paths(edges: DataFrame) -> DataFrame:
    """(nodes, n): the node sets of all simple paths of an undirected graph (u, v), single nodes too, nodes in order and joined by commas.

    A frontier of (last node, bits of the visited nodes) is joined with the edges round by round; paths that end at one
    node with the same visited ones are one row. Graphs of more than 63 nodes are refused, as their sets are too many anyway.
    """
    nodes = sorted(r.n for r in edges.select(F.explode(F.array("u", "v")).alias("n")).distinct().limit(64).collect())
    if len(nodes) > 63:
        raise ValueError("more than 63 nodes")
    spark = edges.sparkSession
    if not nodes:
        return spark.createDataFrame([], "nodes string, n int")
    bit = F.broadcast(spark.createDataFrame([(x, 1 << i) for i, x in enumerate(nodes)], "v string, bit long"))
    near = save(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct().join(bit, "v"), "near")
    frontier = save(spark.createDataFrame([(x, 1 << i) for i, x in enumerate(nodes)], "last string, seen long"), "paths")
    every = frontier.select("seen")
    for _ in range(1, len(nodes)):  # a path has a node more each round
        step = frontier.join(near, F.col("last") == F.col("u")).where(F.col("seen").bitwiseAND(F.col("bit")) == 0)
        frontier = save(step.select(F.col("v").alias("last"), F.col("seen").bitwiseOR(F.col("bit")).alias("seen")).distinct(), "paths")
        if frontier.isEmpty():
            break
        every = every.union(frontier.select("seen"))
    named = F.concat_ws(",", *[F.when(F.col("seen").bitwiseAND(F.lit(1 << i)) != 0, x) for i, x in enumerate(nodes)])
    return every.distinct().select(named.alias("nodes"), F.bit_count("seen").alias("n"))


def tree(layer: DataFrame, parents: DataFrame, k: int) -> DataFrame:
    """(child, parent, side) of a layer's k-mers under (k-1)-mers: side 0 if the parent begins the child, else 1; children without one hang below a dummy of underscores."""
    p = parents.select(F.col("kmer").alias("parent")).distinct()
    c = layer.select(F.col("kmer").alias("child")).distinct()
    at0 = c.withColumn("parent", F.left("child", F.lit(k - 1))).join(p, "parent", "left_semi").withColumn("side", F.lit(0))
    at1 = c.withColumn("parent", F.right("child", F.lit(k - 1))).where("parent <> left(child, length(child) - 1)").join(p, "parent", "left_semi").withColumn("side", F.lit(1))
    under = at0.unionByName(at1)
    orphans = c.join(under.select("child"), "child", "left_anti").select("child", F.lit("_" * k).alias("parent"), F.lit(0).alias("side"))
    return under.unionByName(orphans).select("child", "parent", "side")


def orphans(layer: DataFrame, parents: DataFrame, k: int) -> DataFrame:
    return tree(layer, parents, k).where(F.col("parent") == "_" * k).select("child")


def jaccard(kmers: DataFrame) -> DataFrame:
    """Coverage similarity |A & B| / |A | B| of pairs a > b of words that share a sequence; kmers is (kmer, seq_id) of a bounded list of words."""
    held = kmers.groupBy("seq_id").agg(F.array_sort(F.collect_set("kmer")).alias("words"))
    # pairs are made inside a sequence's row, so no table of sequences is joined; a word with itself tells its size
    pairs = held.select("words", F.posexplode("words").alias("i", "a")).select("a", F.explode(F.slice("words", F.lit(1), F.col("i") + 1)).alias("b"))
    counts = save(pairs.groupBy("a", "b").agg(F.count("*").alias("common")), "common")
    size = counts.where("a = b").select(F.col("a").alias("kmer"), F.col("common").alias("n"))
    both = counts.where("a > b")
    d = both.join(size.select(F.col("kmer").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("kmer").alias("b"), F.col("n").alias("nb")), "b")
    return d.select("a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("similarity"))
