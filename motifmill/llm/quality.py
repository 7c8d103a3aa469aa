"""Quality rules and hashed n-gram importance weights, in DataFrame functions only.

Words and word pairs are hashed into a fixed number of bins. One multinomial over the bins is counted
from the whole corpus, one from trusted documents; a document's score is the mean over its n-grams of
the log-likelihood ratio of the two. The mean tells little of a few bad words in a good text, so words have
a second weight, how much more of the documents labelled toxic hold them than of the trusted ones, and a
document's toxicity is the mean of its highest. Both limits are quantiles of trusted documents that neither
weight was learnt from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifmill.llm.shared import save

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
BINS = 1 << 16
#: Limits that those from labels are drawn towards: the least mean log-likelihood ratio, the highest toxicity.
LEAST_SCORE, MOST_TOXIC = -0.25, 3.0
#: Of the trusted documents, one of HELD_SHARE by hash is held out of the target for the limits.
HELD_SHARE = 5
#: The target has PRIOR prior counts, and as many more as there are bins where no document is learnt from, the half of them with
#: PRIOR_DOCS documents, and so on. Limits are drawn by as many documents.
PRIOR, PRIOR_DOCS = 1024.0, 5
#: Share of the trusted documents held out that each limit may reject.
REJECTED_SCORE, REJECTED_TOXIC = 0.005, 0.01
#: Labelled ids that are sent to all tasks at most, eight bytes each, and ids of a row of them, about.
SENT_IDS, ROW_IDS = 1 << 24, 64
#: The highest words that toxicity is the mean of; prior documents of a bin.
TOXIC_WORDS, TOXIC_PRIOR = 2, 5.0


def split_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def base_columns(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, words, and the base counts of every row of docs; null text is empty.

    n_repeat_words: words in runs of three words found twice or more. Runs are compared by 64-bit hash:
    the sorted hashes tell the runs that occur again, and their sorted places cover three words each,
    fewer where the next one begins sooner.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", *keep, text.alias("t_"), split_words(text).alias("words"))
    n = F.size("words")
    runs = F.when(n >= 3, F.transform(F.slice("words", 1, F.greatest(n - 2, F.lit(1))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("t_", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id",
        *keep,
        "words",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t_", SYMBOLS, "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        runs.alias("runs"),
    )
    # places of the runs that share their hash with another one: neighbours in the sorted order
    placed = F.when(F.size(F.array_distinct("runs")) == F.size("runs"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    d = d.select("doc_id", *keep, "words", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), placed.alias("placed"))
    again = F.filter("placed", lambda x, j: (F.get("placed", j - 1)["h"] == x["h"]) | (F.get("placed", j + 1)["h"] == x["h"]))
    d = d.withColumn("places", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("placed")
    covered = F.aggregate(
        F.transform("places", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("places", j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    return d.withColumn("n_repeat_words", covered.cast("long")).drop("places")


def features(words: Column, bins: int = BINS) -> Column:
    """Bins of all words, then of all word pairs."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(bins)).cast("int"))
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(bins)).cast("int"))
    return F.concat(single, pairs)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good and not toxic in all their labels."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    return good.where("q = 1 and x = 0").select("doc_id")


def toxic_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled toxic in any of their labels."""
    return labels.where("doc_id is not null and toxic = 1").select("doc_id").distinct()


def word_bins(words: Column, bins: int = BINS) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(bins)).cast("int")))


def toxic_weights(docs: DataFrame, bins: int = BINS) -> DataFrame:
    """One row, weights array<double>: log ratio of the smoothed shares of toxic and trusted documents that hold a word of each bin. docs: text, role.

    Null texts hold none, repeated rows count each. Without toxic documents, or without rows, no weight is above 0.
    """
    d = docs.where("role in ('target', 'toxic')").select(F.when(F.col("role") == "toxic", 1).otherwise(0).alias("x"), word_bins(split_words(F.coalesce(F.col("text"), F.lit(""))), bins).alias("bins"))
    counts = d.select("x", F.explode("bins").alias("bin")).groupBy("bin").agg(F.sum("x").alias("toxic"), F.sum(1 - F.col("x")).alias("good"))
    all_bins = docs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    counts = all_bins.join(counts, "bin", "left").select("bin", F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce("good", F.lit(0)).alias("good"))
    rows = counts.agg(F.sort_array(F.collect_list(F.struct("bin", "toxic", "good"))).alias("rows"))
    sizes = d.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("n_toxic"), F.coalesce(F.sum(1 - F.col("x")), F.lit(0)).alias("n_good"))
    both = F.col("n_toxic") + F.col("n_good") + 1.0
    # TOXIC_PRIOR documents of the mean kind in each bin, so that a word of one toxic document weighs little
    share = lambda n, size: (n + TOXIC_PRIOR * (size + 0.5) / both) / (size + 0.5)
    weight = lambda x: F.log(share(x["toxic"], F.col("n_toxic"))) - F.log(share(x["good"], F.col("n_good")))
    return rows.crossJoin(sizes).select(F.transform("rows", weight).alias("weights"))


def with_roles(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """docs with their role of (doc_id, role), null for those without; a doc_id has one role at most.

    Texts stay where they are: ids are sent to all tasks in rows of some ROW_IDS, which take a few bytes more than the numbers
    themselves. Only of more than SENT_IDS ids, texts and ids meet by a shuffle.
    """
    n = roles.count()
    if n > SENT_IDS:
        return docs.join(roles, "doc_id", "left")
    row = lambda i: F.pmod(F.xxhash64(i.cast("string"), F.lit("role")), F.lit(-(-n // ROW_IDS) or 1))
    kinds = ("target", "held", "toxic")
    ids = [F.collect_list(F.when(F.col("role") == kind, F.col("doc_id"))).alias(f"{kind}_") for kind in kinds]
    sent = save(roles.groupBy(row(F.col("doc_id")).alias("row_")).agg(*ids), "sent")
    role = F.coalesce(*[F.when(F.array_contains(f"{kind}_", F.col("doc_id")), kind) for kind in kinds])
    return docs.join(F.broadcast(sent), row(F.col("doc_id")) == F.col("row_"), "left").select(*[docs[c] for c in docs.columns], role.alias("role"))


def mean_weight(bins: str, weights: str) -> Column:
    total = F.aggregate(bins, F.lit(0.0), lambda acc, b: acc + F.element_at(weights, b + 1))
    return F.when(F.size(bins) == 0, F.lit(0.0)).otherwise(total / F.size(bins))


def toxicity(bins: str, weights: str) -> Column:
    """Mean of the TOXIC_WORDS highest weights of the word bins."""
    top = F.slice(F.sort_array(F.transform(bins, lambda b: F.element_at(weights, b + 1)), asc=False), 1, TOXIC_WORDS)
    return F.when(F.size(bins) == 0, F.lit(0.0)).otherwise(F.aggregate(top, F.lit(0.0), lambda acc, w: acc + w) / F.size(top))


def bin_weights(docs: DataFrame, bins: int = BINS, prior_counts: float = PRIOR) -> DataFrame:
    """One row, weights array<double>: log ratio of the smoothed target and raw probabilities of each bin. docs: text, role.

    The target is smoothed towards the raw distribution with prior_counts. The raw counts are those of every n-gram
    of every document, null texts have none, repeated rows count each. Without target documents, or without rows, all weights are 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.coalesce(F.col("role") == "target", F.lit(False)).cast("long").alias("good"), split_words(text).alias("words"))
    d = d.select("good", features(F.col("words"), bins).alias("bins"))
    counts = d.select("good", F.explode_outer("bins").alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
    all_bins = docs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    counts = all_bins.join(counts, "bin", "left").select("bin", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    rows = counts.agg(F.sort_array(F.collect_list(F.struct("bin", "raw", "target"))).alias("rows"), F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    prior = F.lit(float(bins))
    raw = lambda x: (x["raw"] + 1.0) / (F.col("all_raw") + prior)
    held = F.lit(float(prior_counts))
    weight = lambda x: F.log((x["target"] + held * raw(x)) / (F.col("all_target") + held)) - F.log(raw(x))
    return rows.select(F.transform("rows", weight).alias("weights"))


def shrunk(limit: float | None, n: int, towards: float, milder) -> float:
    """A limit taken from n documents, drawn towards a fixed one as if PRIOR_DOCS more had given that, if that is milder (min or max)."""
    return towards if limit is None else milder(limit, (n * limit + PRIOR_DOCS * towards) / (n + PRIOR_DOCS))


def score_documents(docs: DataFrame, labels: DataFrame, bins: int = BINS, least_score: float | None = None, most_toxic: float | None = None, least_words: int = 50, most_repeated: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, score, toxicity, ratio_failed, toxic_failed, kept, and the columns named in keep.

    ratio_failed: the score (mean log-likelihood ratio) is below least_score. toxic_failed: the toxicity is above
    most_toxic. kept: none of the three failed. Limits that aren't given are quantiles of the trusted documents
    held out of the target, drawn towards LEAST_SCORE and MOST_TOXIC, where these are milder, by the weight of PRIOR_DOCS
    documents, so few labels, or none, are treated like many. A text without words has score and toxicity 0 and fails the base rules. Without
    trusted labels every score is 0, without toxic ones no toxicity is above 0. Null text: empty. Null doc_id:
    scored like any other. Repeated rows: each.
    """
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD_SHARE)) == 0
    roles = trusted_ids(labels).select("doc_id", F.when(held, "held").otherwise("target").alias("role")).union(toxic_ids(labels).select("doc_id", F.lit("toxic").alias("role")))
    marked = with_roles(docs.select("doc_id", "text"), save(roles, "roles"))
    some = save(marked.where("role is not null"), "labelled")
    learnt = some.where("role = 'target'").count()
    prior = PRIOR + bins * PRIOR_DOCS / (PRIOR_DOCS + learnt)
    weights = save(bin_weights(marked, bins, prior), "weights").scalar()
    toxic_weight = save(toxic_weights(some, bins), "toxic").scalar()
    if least_score is None or most_toxic is None:
        clean = some.where("role = 'held'").select(split_words(F.coalesce(F.col("text"), F.lit(""))).alias("words")).where(F.size("words") >= least_words)
        clean = clean.select(features(F.col("words"), bins).alias("bins_"), word_bins(F.col("words"), bins).alias("word_bins_")).withColumns({"weights_": weights, "toxic_weights_": toxic_weight})
        clean = clean.select(mean_weight("bins_", "weights_").alias("s"), toxicity("word_bins_", "toxic_weights_").alias("x"))
        n, low, high = clean.agg(F.count("*"), F.percentile("s", F.lit(REJECTED_SCORE)), F.percentile("x", F.lit(1 - REJECTED_TOXIC))).first()
        least_score = shrunk(low, n, LEAST_SCORE, min) if least_score is None else least_score
        most_toxic = max(shrunk(high, n, MOST_TOXIC, max), 0.0) if most_toxic is None else most_toxic
    d = base_columns(docs, keep)
    d = d.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))
    d = d.withColumns({"bins_": features(F.col("words"), bins), "word_bins_": word_bins(F.col("words"), bins)}).drop("words").withColumns({"weights_": weights, "toxic_weights_": toxic_weight})
    # the row number keeps a filter on the verdict above this projection, so that counts aren't evaluated again inside it
    d = d.withColumns({"score": mean_weight("bins_", "weights_"), "toxicity": toxicity("word_bins_", "toxic_weights_"), "row_no_": F.monotonically_increasing_id()}).drop("weights_", "bins_", "word_bins_", "toxic_weights_")
    d = d.withColumns({"ratio_failed": F.col("score") < least_score, "toxic_failed": F.col("toxicity") > most_toxic})
    return d.withColumn("kept", (F.col("row_no_") >= 0) & ~F.col("base_failed") & ~F.col("ratio_failed") & ~F.col("toxic_failed")).drop("row_no_")
