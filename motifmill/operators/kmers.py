"""k-mer indexes and coverage. Sequences are (seq_id, seq); an index is (seq_id, pos, k, kmer), pos from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifmill.functions import patterns as P
from motifmill.session import save


#: Sequences of a task that makes k-mers, at most.
TASK_SEQS = 1 << 14
#: Rows of a table that is sent to all tasks, at most.
SENT_ROWS = 1 << 18


def spread(seqs: DataFrame, key: str = "seq_id") -> DataFrame:
    """The sequences dealt to tasks of about TASK_SEQS by seq_id, or another key.

    A table of short keys is a small file, which one task would read and make many times as many k-mers of. What is
    grouped by seq_id and more afterwards isn't moved again.
    """
    return seqs.repartition(_tasks(seqs), key)


def _tasks(seqs: DataFrame) -> int:
    return max(seqs.sparkSession.sparkContext.defaultParallelism, -(-seqs.count() // TASK_SEQS))


def sent(table: DataFrame) -> DataFrame:
    """A table for a join with k-mers of sequences: written, so that its rows are known, and sent to all tasks if it has SENT_ROWS at most, else sorted and merged.

    Spark would guess the k-mers' size from the file of keys and send those instead.
    """
    table = table if hasattr(table, "saved_at") else save(table, "sent")
    return F.broadcast(table) if table.count() <= SENT_ROWS else table.hint("merge")


def index(seqs: DataFrame, ks: list[int], alphabet: str | None = None) -> DataFrame:
    """One row per k-mer occurrence; k-mers with letters outside the alphabet are dropped. The rows of a sequence are in one task (see `spread`)."""
    return _placed(spread(seqs).select("seq_id", "seq"), ks, alphabet).select("seq_id", "pos", "k", "kmer")


def _placed(seqs: DataFrame, ks: list[int], alphabet: str | None) -> DataFrame:
    """seqs (seq, ..) with a row for each k-mer: pos, k, kmer."""
    d = seqs.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.length("seq") >= F.col("k"))
    d = d.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), (F.length("seq") - F.col("k")).cast("long")))).withColumn("kmer", F.substring("seq", F.col("pos").cast("int") + 1, F.col("k")))
    return d.where(F.translate("kmer", alphabet, "") == "") if alphabet else d


def counted(seqs: DataFrame, ks: list[int], alphabet: str | None = None) -> DataFrame:
    """`coverage` of the `index` of sequences, a seq_id having one seq: a k-mer's first place in a sequence counts for cov, so nothing is grouped by sequence and k-mer."""
    one = spread(seqs).groupBy("seq_id", "seq").agg(F.count("*").alias("copies"))
    first = F.instr("seq", F.col("kmer")) == F.col("pos") + 1
    return _placed(one, ks, alphabet).groupBy("k", "kmer").agg(F.sum("copies").alias("visits"), F.count_if(first).alias("cov"))


def coverage(kmers: DataFrame) -> DataFrame:
    """visits: occurrences, overlapping ones too; cov: sequences. Counted first per sequence, within the tasks of `index`, so that a frequent k-mer is partly summed before the shuffle."""
    per_seq = kmers.groupBy("k", "kmer", "seq_id").agg(F.count("*").alias("n"))
    return per_seq.groupBy("k", "kmer").agg(F.sum("n").alias("visits"), F.count("*").alias("cov"))


def candidates(cov: DataFrame, n_seqs: int, threshold: float = 0.1) -> DataFrame:
    return cov.where(F.col("cov") > threshold * n_seqs)


def universe(spark, alphabet: str, k: int) -> DataFrame:
    """All k-mers over an alphabet, from the digits of a range of numbers."""
    n = len(alphabet)
    letters = [F.substring(F.lit(alphabet), (F.floor(F.col("id") / n ** (k - 1 - i)) % n + 1).cast("int"), F.lit(1)) for i in range(k)]
    return spark.range(n**k).select(F.concat(*letters).alias("kmer"))


def apriori(cov: DataFrame, k: int, least: float) -> DataFrame:
    """Candidates of length k whose two (k-1)-mers are candidates too."""
    good = cov.where((F.col("k") == k - 1) & (F.col("cov") >= least)).select("kmer")
    d = cov.where((F.col("k") == k) & (F.col("cov") >= least))
    for side in (F.left("kmer", F.lit(k - 1)), F.right("kmer", F.lit(k - 1))):
        d = d.withColumn("part", side).join(good.withColumnRenamed("kmer", "part"), "part", "left_semi").drop("part")
    return d


def holders(seqs: DataFrame, words: DataFrame) -> DataFrame:
    """(seq_id, seq, kmer) of each sequence and each of the words that it has, by an equi-join with the sequences' distinct k-mers."""
    words = save(words.select("kmer").distinct(), "words")
    lengths = [r.n for r in words.select(F.length("kmer").alias("n")).distinct().collect()]  # a handful of numbers
    every = F.flatten(F.array(*[F.array_distinct(P.kmers(F.col("seq"), n)) for n in sorted(lengths)])) if lengths else F.array().cast("array<string>")
    d = spread(seqs).select("seq_id", "seq", F.explode(every).alias("kmer"))
    return d.join(sent(words), "kmer", "left_semi")


def visits(seqs: DataFrame, words: DataFrame) -> DataFrame:
    """(kmer, visits, cov) with occurrences counted left to right without overlap."""
    n = (F.length("seq") - F.length(F.replace("seq", F.col("kmer"), F.lit("")))) / F.length("kmer")
    return holders(seqs, words).groupBy("kmer").agg(F.sum(n.cast("long")).alias("visits"), F.count("*").alias("cov"))


def visits_from_right(seqs: DataFrame, words: DataFrame) -> DataFrame:
    """(kmer, seq_id, pos) counted right to left without overlap: the reversed sequence is searched for the reversed k-mer."""
    parts = F.split(F.reverse("seq"), F.reverse("kmer"))  # k-mers have letters only, so they are their own pattern
    k = F.length("kmer")
    gaps = F.slice(parts, 1, F.size(parts) - 1)
    ends = F.transform(gaps, lambda g, i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda s, x: s + F.length(x)) + (i + 1) * k)
    return holders(seqs, words).select("kmer", "seq_id", F.explode(F.transform(ends, lambda e: (F.length("seq") - e).cast("long"))).alias("pos"))


def decoded(bitmaps: DataFrame) -> DataFrame:
    """(kmer, seq_id) of (kmer, bucket, bits), undoing `layer_bitmaps`: bit i of bucket b is sequence 32768 (b - 1) + i + 1 for b > 0, else 32768 b - i."""
    octet = bitmaps.select("kmer", "bucket", F.posexplode(F.regexp_extract_all(F.hex("bits"), F.lit("(..)"), 1)).alias("i", "hex")).where("hex <> '00'")
    d = octet.select("kmer", "bucket", "i", F.conv("hex", 16, 10).cast("int").alias("octet"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    at = F.col("i") * 8 + F.col("bit")
    ident = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + 1 + at).otherwise(F.col("bucket") * 32768 - at)
    return d.where("shiftright(octet, bit) & 1 = 1").select("kmer", ident.cast("long").alias("seq_id"))


def edges(kmers: DataFrame) -> DataFrame:
    """Neighbouring 2-mers: (seq_id, pos, start_node, end_node, title)."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    d = kmers.where("k = 2").withColumn("end_node", F.lead("kmer").over(w)).where("end_node is not null")
    return d.select("seq_id", "pos", F.col("kmer").alias("start_node"), "end_node", F.concat("kmer", F.right("end_node", F.lit(1))).alias("title"))


def node_stats(kmers: DataFrame, edges: DataFrame) -> DataFrame:
    """Visits, coverage and numbers of distinct successors and predecessors of every 2-mer."""
    stats = coverage(kmers.where("k = 2")).drop("k")
    after = edges.groupBy("start_node").agg(F.countDistinct("end_node").alias("n_next"))
    before = edges.groupBy("end_node").agg(F.countDistinct("start_node").alias("n_prev"))
    d = stats.join(after, F.col("kmer") == F.col("start_node"), "left").join(before, F.col("kmer") == F.col("end_node"), "left")
    return d.select("kmer", "visits", "cov", F.coalesce("n_next", F.lit(0)).alias("n_next"), F.coalesce("n_prev", F.lit(0)).alias("n_prev"))


def successors(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("start_node") == node).select("end_node").distinct()


def seed_stats(edges: DataFrame, first: int = 2, end: int = 8) -> DataFrame:
    """Edges within and outside the seed region [first, end)."""
    seed = (F.col("pos") >= first) & (F.col("pos") < end)
    return edges.groupBy("title").agg(
        F.count_if(seed).alias("seed_visits"), F.countDistinct(F.when(seed, F.col("seq_id"))).alias("seed_cov"), F.count_if(~seed).alias("other_visits"), F.countDistinct(F.when(~seed, F.col("seq_id"))).alias("other_cov")
    )


def extend(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """Occurrences of paths of n 2-mers extended by the next occurrence in the same sequence: (seq_id, pos, path)."""
    r = right.select("seq_id", (F.col("pos") - n).alias("pos"), F.right("kmer", F.lit(1)).alias("letter"))
    return left.hint("merge").join(r, ["seq_id", "pos"]).select("seq_id", "pos", F.concat("kmer", "letter").alias("path"))


def frequent_paths(seqs: DataFrame, longest: int, least: float, alphabet: str | None = None) -> DataFrame:
    """(k, kmer, visits, cov) of all runs of 2 to `longest` letters that at least `least` sequences of (seq_id, seq) have.

    Prefix doubling: a run is named by its first occurrence, and a run of k letters is the pair of names of its first and
    last n letters, n being the largest power of two up to k. Only occurrences of frequent runs
    of n letters are kept, as no longer run is more frequent; lengths between n and 2 n are counted from them
    alone, by one pass over each sequence's occurrences in order, and letters are looked up for the results only.
    """
    seqs = seqs.select("seq_id", "seq")
    parts = 2 * _tasks(seqs)
    first = index(seqs, [2], alphabet).select("seq_id", "pos", "k", F.struct("kmer").alias("name"))
    runs, n = _runs(first, least), 2
    every = runs.select("k", "at", "visits", "cov")
    occurrences = _renamed(first, runs)
    while n < longest and not occurrences.isEmpty():
        own = occurrences.repartition(parts, "seq_id")
        runs = _runs(_pairs(own, n, range(n + 1, min(2 * n, longest) + 1)), least)
        every = every.unionByName(runs.select("k", "at", "visits", "cov"))
        n *= 2
        if n < longest:
            occurrences = _renamed(_pairs(own, n // 2, [n]), runs.where(F.col("k") == n))
    letters = every.hint("merge").join(seqs, F.col("at.seq_id") == F.col("seq_id"))
    return letters.select("k", F.expr("substring(seq, cast(at.pos as int) + 1, k)").alias("kmer"), "visits", "cov")


def _pairs(occurrences: DataFrame, n: int, ks) -> DataFrame:
    """(seq_id, pos, k, name) of runs of k letters, n < k <= 2 n, from occurrences (seq_id, pos, name) of runs of n letters."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    tails = [F.struct(F.lit(k).alias("k"), F.first("name").over(w.rangeBetween(k - n, k - n)).alias("tail")) for k in ks]
    d = occurrences.select("seq_id", "pos", "name", F.array(*tails).alias("tails")).select("seq_id", "pos", "name", F.explode("tails").alias("t"))
    return d.where("t.tail is not null").select("seq_id", "pos", "t.k", F.struct("name", "t.tail").alias("name"))


def _runs(d: DataFrame, least: float) -> DataFrame:
    """(k, name, at, visits, cov), saved, of the frequent names of (seq_id, pos, k, name); at is the first occurrence."""
    per_seq = d.groupBy("k", "name", "seq_id").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    runs = per_seq.groupBy("k", "name").agg(F.sum("n").alias("visits"), F.count("*").alias("cov"), F.min(F.struct("seq_id", "pos")).alias("at"))
    return save(runs.where(F.col("cov") >= least), "runs")


def _renamed(d: DataFrame, runs: DataFrame) -> DataFrame:
    """Occurrences of the runs of one length, named by the first one of each; saved."""
    return save(d.select("seq_id", "pos", "name").join(sent(runs.select("name", "at")), "name").select("seq_id", "pos", F.col("at").alias("name")), "named")


def top(cov: DataFrame, n: int) -> DataFrame:
    """The n k-mers of each length that most sequences have, ties by k-mer."""
    w = Window.partitionBy("k").orderBy(F.col("cov").desc(), "kmer")
    return cov.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def layer_coverage(kmers: DataFrame, n_seqs: int) -> DataFrame:
    """Sequences with any of each layer's k-mers, and the drop to the next layer."""
    w = Window.orderBy("k")  # a row per length
    d = kmers.select("k", "seq_id").distinct().groupBy("k").agg(F.count("*").alias("cov"))
    return d.select("k", "cov", (F.col("cov") - F.lead("cov").over(w)).alias("drop"), (F.col("cov") / n_seqs).alias("rate"))


def layer_bitmaps(kmers: DataFrame) -> DataFrame:
    """Coverage as bitmaps: (k, kmer, bucket, bits); their union and count stay in the JVM.

    The sequences of a bucket come to one task, so each bitmap is made once. A k-mer that repeats sets its bit again.
    """
    s = kmers.select("k", "kmer", "seq_id", F.bitmap_bucket_number("seq_id").alias("bucket")).repartition("bucket")
    return s.groupBy("k", "kmer", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("seq_id")).alias("bits"))


def dimer_lengths(edges: DataFrame) -> DataFrame:
    """(seq_id, n): a sequence's number of 2-mers, one more than its edges."""
    return edges.groupBy("seq_id").agg((F.count("*") + 1).alias("n"))
