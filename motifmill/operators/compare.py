"""Comparing data sets, and the small jobs that prepare them."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifmill.session import save


def histogram(d: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): 0 below low, 1..bins of equal width, bins + 1 from high on."""
    b = F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return d.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def pair_gaps(rates: DataFrame) -> DataFrame:
    """(kind, n, mean_gap) over pairs of (kmer, side, rate): pairs within a data set and across. A row per k-mer and data set, so few rows."""
    ident = F.concat("kmer", "side")
    a = rates.select(ident.alias("i"), F.col("side").alias("s1"), F.col("rate").alias("r1"))
    b = rates.select(ident.alias("j"), F.col("side").alias("s2"), F.col("rate").alias("r2"))
    d = a.join(b, F.col("i") > F.col("j"))
    kind = F.when(F.col("s1") == F.col("s2"), "in").otherwise("trans")
    return d.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("r1") - F.col("r2"))).alias("mean_gap"))


def coexisting(d: DataFrame, group: str, item: str) -> DataFrame:
    """(p1, p2, n, first_set) of pairs of items p1 < p2 that more than one group has."""
    e = d.select(F.col(group).alias("g"), F.col(item).alias("x")).where("g is not null and x is not null").distinct()
    a, b = e.withColumnRenamed("x", "p1"), e.withColumnRenamed("x", "p2")
    return a.join(b, "g").where("p1 < p2").groupBy("p1", "p2").agg(F.count("*").alias("n"), F.min("g").alias("first_set")).where("n > 1")


def split_by_weight(seqs: DataFrame, least: float) -> DataFrame:
    """(seq_id, seq, side): positive from a weight on, negative below."""
    return seqs.select("seq_id", "seq", F.when(F.col("weight") >= least, "positive").otherwise("negative").alias("side"))


def one_against_rest(seqs: DataFrame, group: str, value: str) -> DataFrame:
    """side: positive for sequences of one group, negative for all others."""
    return seqs.withColumn("side", F.when(F.col(group) == value, "positive").otherwise("negative"))


def by_title(seqs: DataFrame, length: int = 3) -> DataFrame:
    """species: the first letters of the title."""
    return seqs.withColumn("species", F.left("title", F.lit(length)))


def by_prefix(rows: DataFrame, name: str, separator: str = "_") -> DataFrame:
    """(category, n, members): rows by what stands before the first separator of their name, and the different rests of their names."""
    at = F.instr(F.col(name), F.lit(separator))
    category = F.when(at > 0, F.expr(f"left(`{name}`, instr(`{name}`, '{separator}') - 1)")).otherwise(F.col(name))
    rest = F.when(at > 0, F.expr(f"substring(`{name}`, instr(`{name}`, '{separator}') + {len(separator)})")).otherwise("")
    d = rows.where(F.col(name).isNotNull()).select(category.alias("category"), rest.alias("rest")).groupBy("category", "rest").agg(F.count("*").alias("n"))
    return d.groupBy("category").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list("rest")), ",").alias("members"))


def distinct_species(rows: DataFrame, experiments: DataFrame) -> DataFrame:
    """(id, species), in lower case and each once, of the rows (id, species, experiment) of certain experiments (experiment)."""
    d = rows.join(experiments.select("experiment").distinct(), "experiment", "left_semi")
    return d.select(F.lower("id").alias("id"), F.lower("species").alias("species")).distinct()


def clean_records(records: DataFrame) -> DataFrame:
    """The records (title, seq) that are neither empty nor have an N or an S."""
    return records.where((F.col("seq") != "") & ~F.col("seq").rlike("[NS]"))


def segments(wanted: DataFrame, seqs: DataFrame) -> DataFrame:
    """(id, accession, seq): of each id's intervals (id, accession, first, last) the shortest, cut from that accession's sequence.

    Ties go to the least accession, then the first place; accessions that no sequence has are left out.
    """
    one = wanted.groupBy("id").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("n"), "accession", "first")).alias("w"))
    d = one.join(seqs.select("seq_id", "seq"), F.col("w.accession") == F.col("seq_id"))
    return d.select("id", F.col("w.accession").alias("accession"), F.substring("seq", (F.col("w.first") + 1).cast("int"), (F.col("w.n") + 1).cast("int")).alias("seq"))


def event_strings(events: DataFrame) -> DataFrame:
    """(user_id, day, seq): the first letters of a user's event types of one day, in order."""
    letter = F.upper(F.left("event_type", F.lit(1)))
    d = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", letter.alias("c")))).alias("e"))
    return d.select("user_id", "day", F.array_join(F.transform("e", lambda x: x["c"]), "").alias("seq"))


def indented(lines: DataFrame, parts: int = 8) -> DataFrame:
    """(n, depth, path) of an indented outline (n, line): each line behind all its ancestors, joined by " / "; blank lines are left out.

    A line's parent is the last one before it that is indented less. Lines are split into `parts` runs of n, which each task goes
    through with a stack of open ancestors. A run tells what it leaves open and how far it unindents; from
    that, a short list, follows what is open where each run begins, and each line is completed by
    the open ones that are indented less than its first ancestor in the run.
    """
    spark = lines.sparkSession
    d = lines.select(F.col("n").cast("long").alias("n"), "line").where(F.trim("line") != "").repartitionByRange(parts, "n").sortWithinPartitions("n")
    local = save(d.mapInArrow(_run, "part int, n long, root int, path array<string>, open array<struct<indent int, line string>>"), "outline")
    carried, stack = [], []
    for r in local.where("n is null").orderBy("part").collect():  # a row for each run, as long as the outline is deep
        carried.append((r.part, [tuple(x) for x in stack]))
        stack = [x for x in stack if x[0] < r.root] + [(x.indent, x.line) for x in r.open]
    ahead = F.broadcast(spark.createDataFrame(carried, "part int, carried array<struct<indent: int, line: string>>"))
    joined = local.where("n is not null").join(ahead, "part")
    over = F.transform(F.filter("carried", lambda x: x["indent"] < F.col("root")), lambda x: x["line"])
    path = F.concat(over, "path")
    return joined.select("n", (F.size(path) - 1).alias("depth"), F.array_join(path, " / ").alias("path"))


def _run(batches):
    stack, least, part = [], None, TaskContext.get().partitionId()
    for batch in batches:
        rows = []
        for n, line in zip(batch.column("n").to_pylist(), batch.column("line").to_pylist()):
            indent = len(line) - len(line.lstrip())
            while stack and stack[-1][0] >= indent:
                stack.pop()
            stack.append((indent, line.strip()))
            least = indent if least is None else min(least, indent)
            rows.append((part, n, stack[0][0], [x for _, x in stack], None))
        yield _outline(rows)
    if stack:
        yield _outline([(part, None, least, None, [{"indent": i, "line": x} for i, x in stack])])


def _outline(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.struct([("indent", pa.int32()), ("line", pa.string())]))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], ["part", "n", "root", "path", "open"])
