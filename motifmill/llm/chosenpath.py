"""Jaccard join of word n-gram sets by chosen paths.

Every distinct set has a signature of COORDS min-hashes, its tokens (coordinate, value). Each run draws
coordinates at random, LEAST_SIMILARITY * COORDS to one on average, and splits the sets by the value that
they have there, so that sets meet in a bucket if they share a sampled token. A bucket that is still
large is split again by further sampled tokens, up to DEPTH times. Small buckets are compared by brute
force. What is still large after DEPTH splits is cut into blocks: each block is compared with itself and
with the bucket's first block, which joins a group of alike sets; then blocks are compared with each other,
but only sets that aren't joined yet, so that no pair is left out and the rows stay in proportion to the
sets. The number of runs is what TARGET_RECALL takes by the splits' chances; the recall is then measured
on a sample of the sets against all others, and as many runs follow until it is reached.

Buckets only propose classes: pairs whose signatures agree enough are united within a bucket, and each
bucket hands on one row per set, not its pairs. The sets of a proposed class are then compared by their
exact n-grams, a class of several blocks in two passes like a large bucket, which counts all their links
with one row for each set.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifmill.llm import text
from motifmill.llm.shared import connected_components, in_arrow, partitions, row_groups, save
from motifmill.llm.text import U64

GRAM = 5
LEAST_SIMILARITY = 0.8
COORDS = 64
TARGET_RECALL = 0.999
#: A bucket of more sets is split again.
LARGE = 64
DEPTH = 3
#: Sets of a block, and bytes of n-grams of a block in the exact comparison, about.
SIDE, BLOCK_BYTES = 1024, 1 << 20
#: Standard errors of the signature's estimate that a pair may lie below the least similarity.
MARGIN = 3.5
#: Sets, those of the least hash, whose links measure the recall; sequences of runs until that is given up.
SAMPLE, MOST_TURNS = 256, 6
_SALT = [int(x) for x in np.random.default_rng(5).integers(1, 1 << 63, COORDS)]


def missed(agreeing: int, rate: float, depth: int = DEPTH) -> float:
    """The probability that a run of `depth` splits keeps a pair apart whose signatures agree in so many coordinates."""
    lost = 0.0
    for _ in range(depth):
        lost = (1 - rate * (1 - lost)) ** agreeing
    return lost


def runs_needed(recall: float = TARGET_RECALL, least: float = LEAST_SIMILARITY, depth: int = DEPTH) -> int:
    """Runs until a pair of the least similarity has met with this probability, over what its signatures may agree in."""
    rate = 1 / (least * COORDS)
    chance = [math.comb(COORDS, a) * least**a * (1 - least) ** (COORDS - a) for a in range(COORDS + 1)]
    lost = [missed(a, rate, depth) for a in range(COORDS + 1)]
    runs = 1
    while sum(c * x**runs for c, x in zip(chance, lost)) > 1 - recall:
        runs += 1
    return runs


def _signatures(gram: int, least_hash_rows: int = 1 << 13):
    mul = np.array([x | 1 for x in _SALT], U64)

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            sets, sizes, sigs = [], [], []
            for _, offsets, h in text.words(text.column(batch, "text")):
                at, s, _ = text.shingles(offsets, h, gram)
                n = len(at) - 1
                row = np.repeat(np.arange(n), np.diff(at))
                # distinct n-grams of each row
                order = np.lexsort((s, row))
                s, row = s[order], row[order]
                new = np.append(True, (s[1:] != s[:-1]) | (row[1:] != row[:-1]))[: len(s)]
                s, row = s[new], row[new]
                size = np.bincount(row, minlength=n)
                start = np.append(0, np.cumsum(size))
                sums = np.append(U64(0), np.cumsum(text.mix(s + U64(0x1234567))))
                both = sums[start[1:]] - sums[start[:-1]]
                sets.append(text.mix(both ^ size.astype(U64)).view(np.int64))
                sizes.append(size)
                sig = np.zeros((n, COORDS), np.uint32)
                full = np.flatnonzero(size)
                # whole rows at a time, so that the table of hashes stays small
                i = 0
                while i < len(full):
                    j = max(i + 1, int(np.searchsorted(start[full], start[full[i]] + least_hash_rows)))
                    rows = full[i:j]
                    a, b = start[rows[0]], start[rows[-1] + 1]
                    hashed = ((s[a:b, None] * mul) >> U64(32)).astype(np.uint32)
                    sig[rows] = np.minimum.reduceat(hashed, start[rows] - a, axis=0)
                    i = j
                sigs += [x.tobytes() for x in sig]
            yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(np.concatenate(sets)), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(sigs, pa.binary())], ["doc_id", "text_hash", "set_id", "n_grams", "sig"])

    return run


def _draw(paths: np.ndarray, rate: float) -> np.ndarray:
    """(paths x COORDS) booleans: the coordinates that each path draws, from hashes of path and coordinate."""
    h = text.mix(paths[:, None] ^ np.array(_SALT, U64))
    return (h >> U64(40)).astype(np.float64) < rate * (1 << 24)


def _next(path: np.ndarray, coord: np.ndarray, value: np.ndarray) -> np.ndarray:
    return text.mix(text.mix(path * U64(0x9E3779B97F4A7C15) + coord.astype(U64)) ^ value.astype(U64))


def _roots(first: int, runs: int, rate: float):
    roots = text.mix(np.arange(first + 1, first + runs + 1).astype(U64))
    run_no, coord = np.nonzero(_draw(roots, rate))

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, COORDS)
            ids = batch.column("set_id").to_numpy(zero_copy_only=False)
            for a in range(0, len(ids), 4096):
                part = sig[a : a + 4096]
                path = _next(roots[run_no][None, :], coord[None, :], part[:, coord])
                yield pa.RecordBatch.from_arrays([pa.array(path.ravel().view(np.int64)), pa.array(np.repeat(ids[a : a + 4096], len(coord)))], ["bucket", "set_id"])

    return run


def _split(rate: float):
    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, COORDS)
            ids = batch.column("set_id").to_numpy(zero_copy_only=False)
            path = batch.column("bucket").to_numpy(zero_copy_only=False).view(U64)
            i, coord = np.nonzero(_draw(path, rate))
            out = _next(path[i], coord, sig[i, coord])
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), pa.array(ids[i])], ["bucket", "set_id"])

    return run


def _own_block(m: Column) -> Column:
    return F.pmod(F.xxhash64("set_id", F.lit(17)), m).cast("int")


def _first_pass(d: DataFrame) -> DataFrame:
    """Rows with `m` blocks in their group and their own `block`: the first block's rows join every block."""
    every = F.when((F.col("block") == 0) & (F.col("m") > 1), F.sequence(F.lit(0), F.col("m") - 1)).otherwise(F.array("block"))
    return d.withColumn("at", F.explode(every))


def _by_block(d: DataFrame, *key: str) -> DataFrame:
    return d.repartition(partitions(d.sparkSession), *key).sortWithinPartitions(*key, "set_id")


def _unite(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member's place that each of n places is linked with, directly or not."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == old).all():
            return root


def _once(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows sorted by set_id without repeats, and their ids."""
    ids = rows.column("set_id").combine_chunks().to_numpy(zero_copy_only=False)
    new = np.append(True, ids[1:] != ids[:-1])
    return (rows, ids) if new.all() else (rows.filter(pa.array(new)), ids[new])


def _edges_out(a: list, b: list) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])


def _signature_rows(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint32).reshape(-1, COORDS)


def _proposals(least: float):
    """Sorted (bucket, at, set_id, sig) to edges (a, b) that span the pairs whose signatures agree, one row for each set at most."""
    agree = least * COORDS

    def run(batches):
        out_a, out_b, waiting = [], [], 0
        for _, rows in row_groups(batches, ["bucket", "at"]):
            if rows.num_rows < 2:
                continue
            rows, ids = _once(rows)
            sig = _signature_rows(rows.column("sig").to_pylist())
            a, b = [], []
            for i in range(len(ids) - 1):
                hit = np.flatnonzero((sig[i + 1 :] == sig[i]).sum(1) >= agree) + i + 1
                if len(hit):
                    a.append(np.full(len(hit), i))
                    b.append(hit)
            if not a:
                continue
            root = _unite(len(ids), np.concatenate(a), np.concatenate(b))
            linked = np.flatnonzero(root != np.arange(len(ids)))
            out_a.append(ids[linked])
            out_b.append(ids[root[linked]])
            waiting += len(linked)
            if waiting > 100_000:
                yield _edges_out(out_a, out_b)
                out_a, out_b, waiting = [], [], 0
        yield _edges_out(out_a, out_b)

    return run


def _packed(columns: list[str]):
    """Sorted (key, block, m, ..) to one row for each block: its rows' columns as one binary value each."""

    def run(batches):
        for (key, block), rows in row_groups(batches, ["key", "block"]):
            rows, ids = _once(rows)
            values = [ids.tobytes()]
            for c in columns:
                x = rows.column(c).combine_chunks()
                if pa.types.is_binary(x.type):
                    blobs = x.to_pylist()
                    values += [np.array([len(v) for v in blobs], np.int64).tobytes(), b"".join(blobs)]
                else:
                    values.append(x.to_numpy(zero_copy_only=False).astype(np.int64).tobytes())
            m = rows.column("m")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([block], pa.int32()), pa.array([m], pa.int32()), pa.array([values], pa.list_(pa.binary()))], ["key", "block", "m", "values"])

    return run


def _pack(d: DataFrame, columns: list[str], name: str) -> DataFrame:
    packed = in_arrow(_by_block(d, "key", "block"), _packed(columns), "key long, block int, m int, values array<binary>")
    return save(packed, name)


def _streamed(batches):
    """Rows sorted by (key, at, block other than at, block): (own values, others' values as a list that is read once) by key and at."""
    own, at, last = None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["key"], row["at"]) != at:
                at, own = (row["key"], row["at"]), row["values"]
                yield own, None
                continue
            yield own, row["values"]


def _joined_apart(least: float):
    """Blocks of signatures to edges (a, b) of labels: pairs of sets of different labels whose signatures agree."""
    agree = least * COORDS

    def run(batches):
        for own, other in _streamed(batches):
            if other is None:
                continue
            label, label_o = (np.frombuffer(v[1], np.int64) for v in (own, other))
            sig, sig_o = (np.frombuffer(v[3], np.uint32).reshape(-1, COORDS) for v in (own, other))
            a, b = [], []
            for x, s in zip(label.tolist(), sig):
                apart = np.flatnonzero(label_o != x)
                if len(apart):
                    hit = np.unique(label_o[apart[(sig_o[apart] == s).sum(1) >= agree]])
                    a.append(np.full(len(hit), x))
                    b.append(hit)
            if a:
                pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
                yield _edges_out([pairs[:, 0]], [pairs[:, 1]])

    return run


def _shared(size_a: np.ndarray, a: np.ndarray, size_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many n-grams each of some sets shares with each of others; a and b have their n-grams one set after the other."""
    row_a, row_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
    same = np.isin(a, b)
    a, row_a = a[same], row_a[same]
    every, col_a = np.unique(a, return_inverse=True)
    col_b = np.searchsorted(every, b)
    col_b[col_b == len(every)] = 0
    same = every[col_b] == b if len(every) else np.zeros(len(b), bool)
    col_b, row_b = col_b[same], row_b[same]
    order_a, order_b = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
    row_a, col_a, row_b, col_b = row_a[order_a], col_a[order_a], row_b[order_b], col_b[order_b]
    out = np.zeros((len(size_a), len(size_b)), np.float32)
    width = 4096
    for c in range(0, len(every), width):
        (i, j), (k, m) = np.searchsorted(col_a, [c, c + width]), np.searchsorted(col_b, [c, c + width])
        has_a, has_b = np.zeros((len(size_a), width), np.float32), np.zeros((len(size_b), width), np.float32)
        has_a[row_a[i:j], col_a[i:j] - c] = 1
        has_b[row_b[k:m], col_b[k:m] - c] = 1
        out += has_a @ has_b.T
    return out


def _linked(size_a, a, size_b, b, least: float) -> np.ndarray:
    """Whether |A & B| >= least * |A | B|."""
    common = _shared(size_a, a, size_b, b)
    return common >= least * (size_a[:, None] + size_b[None, :] - common) - 1e-6


_COMPARED = "set_id long, links long, other long"


def _compared_out(ids, links, other) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.asarray(links, np.int64)), pa.array(other)], ["set_id", "links", "other"])


def _exact(least: float):
    """Sorted (key, at, set_id, copies, m, grams) to (set_id, links, other): rows linked with the set in this block (0 if its class has several blocks), and a set that the block's links connect it with."""

    def run(batches):
        for _, rows in row_groups(batches, ["key", "at"]):
            rows, ids = _once(rows)
            if len(ids) < 2:
                continue
            copies = rows.column("copies").combine_chunks().to_numpy(zero_copy_only=False)
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()]
            size, grams = np.array([len(s) for s in sets]), np.concatenate(sets)
            linked = _linked(size, grams, size, grams, least)
            np.fill_diagonal(linked, False)
            some = np.flatnonzero(linked.any(1))
            if len(some):
                root = _unite(len(ids), *np.nonzero(linked))
                links = linked @ copies if rows.column("m")[0].as_py() == 1 else np.zeros(len(ids))
                yield _compared_out(ids[some], links[some], ids[root[some]])

    return run


def _exact_blocks(least: float):
    """Blocks of a class, each with all of them in turn, to (set_id, links, other): one row for each set with all its links, and one for labels that links connect."""

    def run(batches):
        held = None
        for own, other in _streamed(batches):
            if other is None:
                if held is not None:
                    yield from told(*held)
                ids, copies, label = (np.frombuffer(v, np.int64) for v in own[:3])
                size, grams = np.frombuffer(own[3], np.int64) // 8, np.frombuffer(own[4], np.uint64)
                linked = _linked(size, grams, size, grams, least)
                np.fill_diagonal(linked, False)
                held = ids, label, linked @ copies, set()
                continue
            copies_o, label_o = (np.frombuffer(v, np.int64) for v in other[1:3])
            linked = _linked(size, grams, np.frombuffer(other[3], np.int64) // 8, np.frombuffer(other[4], np.uint64), least)
            held[2].__iadd__(linked @ copies_o)
            i, j = np.nonzero(linked & (label[:, None] != label_o[None, :]))
            held[3].update(zip(label[i].tolist(), label_o[j].tolist()))
        if held is not None:
            yield from told(*held)

    def told(ids, label, links, apart):
        yield _compared_out(ids, links, label)
        if apart:
            a, b = np.array(sorted(apart), np.int64).T
            yield _compared_out(a, np.zeros(len(a)), b)

    return run


def _gram_sets(gram: int):
    def run(batches):
        for batch in batches:
            out = []
            for _, offsets, h in text.words(text.column(batch, "text")):
                at, s, _ = text.shingles(offsets, h, gram)
                out += [np.unique(s[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
            rest = [batch.column(c) for c in ("key", "set_id", "copies", "m", "block")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.binary())], ["key", "set_id", "copies", "m", "block", "grams"])

    return run


def _met(sets: DataFrame, turn: int, runs: int, rate: float, side: int) -> DataFrame:
    """(bucket, set_id, m, block) of a turn's runs: the buckets of two sets or more."""
    sigs = sets.select("set_id", "sig")
    frontier = in_arrow(sigs, _roots(turn * runs, runs, rate), "bucket long, set_id long")
    leaves = None
    for depth in range(1, DEPTH + 1):
        frontier = save(frontier, f"buckets{depth}")
        sizes = frontier.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        members = frontier.join(sizes, "bucket")
        done = members if depth == DEPTH else members.where(F.col("n") <= LARGE)
        leaves = done if leaves is None else leaves.union(done)
        if depth == DEPTH or sizes.where(F.col("n") > LARGE).isEmpty():
            break
        frontier = in_arrow(members.where(F.col("n") > LARGE).select("bucket", "set_id").join(sigs, "set_id"), _split(rate), "bucket long, set_id long")
    return leaves.withColumn("m", F.ceil(F.col("n") / F.lit(side)).cast("int")).withColumn("block", _own_block(F.col("m"))).drop("n")


def _measured(sample: list[tuple], least: float):
    """(set_id, sig, root) to (pairs, found): pairs with a sampled set (set_id, sig, root) whose signatures agree in the least similarity, and those of one class."""
    ids = np.array([r[0] for r in sample], np.int64)
    sig = _signature_rows([r[1] for r in sample])
    roots = np.array([r[2] for r in sample], np.int64)

    def run(batches):
        pairs = found = 0
        for batch in batches:
            mine = _signature_rows(batch.column("sig").to_pylist())
            own, root = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("set_id", "root"))
            for i in range(len(ids)):
                hit = ((mine == sig[i]).sum(1) >= least * COORDS) & (own != ids[i])
                pairs += int(hit.sum())
                found += int((hit & (root == roots[i])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([found])], ["pairs", "found"])

    return run


def proposed_classes(sets: DataFrame, least: float = LEAST_SIMILARITY, recall: float = TARGET_RECALL, side: int = SIDE) -> DataFrame:
    """(set_id, root) of the sets (set_id, sig) that runs have linked with others; the recall is reached, or MOST_TURNS times the runs are made."""
    n = partitions(sets.sparkSession)
    rate = 1 / (least * COORDS)
    agree = least - MARGIN * math.sqrt(least * (1 - least) / COORDS)
    runs = runs_needed(recall, least)
    sigs = sets.select("set_id", "sig")
    edges = None
    for turn in range(MOST_TURNS):
        leaves = save(_met(sets, turn, runs, rate, side), "leaves")
        first = _first_pass(leaves).join(sigs, "set_id").select("bucket", "at", "set_id", "sig")
        new = save(in_arrow(_by_block(first, "bucket", "at"), _proposals(agree), "a long, b long").distinct(), "edges")
        edges = new if edges is None else edges.union(new)
        classes_ = save(connected_components(edges), "proposed").withColumnRenamed("id", "set_id")
        large = leaves.where("m > 1")
        if not large.isEmpty():
            labelled = large.join(classes_, "set_id", "left").select(F.col("bucket").alias("key"), "set_id", "m", "block", F.coalesce("root", "set_id").alias("label"))
            apart = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
            packed = _pack(labelled.join(apart, "key", "left_semi").join(sigs, "set_id"), ["label", "sig"], "packed")
            square = packed.withColumn("at", F.explode(F.sequence("block", F.col("m") - 1)))
            square = square.repartition(n, "key", "at").sortWithinPartitions("key", "at", F.col("block") != F.col("at"), "block")
            edges = edges.union(save(in_arrow(square.select("key", "at", "values"), _joined_apart(agree), "a long, b long").distinct(), "edges"))
            classes_ = save(connected_components(edges), "proposed").withColumnRenamed("id", "set_id")
        marked = sets.select("set_id", "sig").join(classes_, "set_id", "left").select("set_id", "sig", F.coalesce("root", "set_id").alias("root"))
        sample = [tuple(r) for r in marked.orderBy(F.xxhash64("set_id", F.lit(turn)), "set_id").limit(SAMPLE).collect()]  # of bounded size
        pairs, found = in_arrow(marked, _measured(sample, least), "pairs long, found long").agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("found"), F.lit(0))).first()
        if found >= recall * pairs:
            break
    return classes_


def classes(docs: DataFrame, gram: int = GRAM, least: float = LEAST_SIMILARITY, recall: float = TARGET_RECALL, side: int = SIDE) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, class_id, n_links, stays.

    Words are runs of anything but ASCII white space; a text of fewer than `gram` words has one n-gram of
    all of them, and one without words is linked with none. n_links: other rows whose sets have a Jaccard
    similarity of `least` or more, equal sets included. class_id: the least doc_id among all rows that a
    row is linked with directly or through others; its own doc_id without links. Rows of null doc_id are
    compared like others; a class of nothing but those has a null class_id. Repeated rows link each other.
    stays: whether (doc_id, text_hash) is the least of its class, which all repeats of that row have in common.
    No rows give none; other columns aren't read.
    """
    n = partitions(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = save(in_arrow(d, _signatures(gram), "doc_id long, text_hash long, set_id long, n_grams long, sig binary"), "signatures")
    sets = save(
        signed.where("n_grams > 0").groupBy("set_id").agg(
            F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("pick"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("n_grams").alias("n_grams")
        ),
        "sets",
    )
    proposed = proposed_classes(sets, least, recall, side)
    # one document of each set of a proposed class brings its n-grams
    wanted = proposed.join(sets.select("set_id", "pick", "copies", "n_grams"), "set_id")
    per_class = wanted.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / F.lit(side)), F.ceil(F.sum("n_grams") * 8 / F.lit(BLOCK_BYTES * side // SIDE))).cast("int").alias("m"))
    wanted = wanted.join(per_class, "root").withColumn("block", _own_block(F.col("m")))
    wanted = wanted.select(F.col("root").alias("key"), "set_id", "copies", "m", "block", F.col("pick.doc_id").alias("pick_id"), F.col("pick.text_hash").alias("pick_hash"))
    text_rows = wanted.join(d, (F.col("pick_hash") == F.col("text_hash")) & F.col("pick_id").eqNullSafe(F.col("doc_id"))).select("key", "set_id", "copies", "m", "block", "text")
    grams = save(in_arrow(text_rows, _gram_sets(gram), "key long, set_id long, copies long, m int, block int, grams binary"), "grams")
    compared = save(in_arrow(_by_block(_first_pass(grams), "key", "at"), _exact(least), _COMPARED), "compared")
    large = grams.where("m > 1")
    if not large.isEmpty():
        label = connected_components(compared.select(F.col("set_id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "set_id")
        labelled = large.join(label, "set_id", "left").withColumn("label", F.coalesce("root", "set_id"))
        square = _pack(labelled, ["copies", "label", "grams"], "packed").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        square = square.repartition(n, "key", "at").sortWithinPartitions("key", "at", F.col("block") != F.col("at"), "block")
        compared = compared.union(save(in_arrow(square.select("key", "at", "values"), _exact_blocks(least), _COMPARED), "compared"))
    links = compared.groupBy("set_id").agg(F.sum("links").alias("links"))
    roots = connected_components(compared.select(F.col("set_id").alias("a"), F.col("other").alias("b")))
    found = sets.select("set_id", "rep", "pick", "copies").join(links, "set_id", "left").join(roots.withColumnRenamed("id", "set_id"), "set_id", "left")
    found = found.select("set_id", "rep", "pick", F.coalesce("root", "set_id").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    per_class = found.groupBy("root").agg(F.min("rep").alias("class_id"), F.min("pick").alias("pick"))
    per_set = found.drop("pick").join(per_class, "root").select(F.col("set_id").alias("s_"), "class_id", "n_links", "pick")
    # texts without words have no row in per_set
    key = F.when(F.col("n_grams") > 0, F.col("set_id"))
    out = signed.select("doc_id", "text_hash", key.alias("set_id")).join(per_set, F.col("set_id") == F.col("s_"), "left")
    alone = F.col("s_").isNull()
    return out.select(
        "doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("pick.doc_id")) & (F.col("text_hash") == F.col("pick.text_hash")))).alias("stays"),
    )


def join(docs: DataFrame, gram: int = GRAM, least: float = LEAST_SIMILARITY, recall: float = TARGET_RECALL) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, as in `classes`."""
    return classes(docs, gram, least, recall).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, gram: int = GRAM, least: float = LEAST_SIMILARITY) -> DataFrame:
    """The rows of docs without near duplicates: of each class the row of the least doc_id stays, once.

    Rows whose text is null or has no word are no one's duplicates and all stay, as do the columns of docs.
    Of a class without any doc_id the row of the least text hash stays; equal rows stay once.
    """
    stay = classes(docs, gram, least).where("stays").select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).distinct()
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    d = docs.select(F.col("doc_id").cast("long").alias("id"), text_hash.alias("hash"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    d = d.join(stay, (F.col("hash") == F.col("hash_")) & F.col("id").eqNullSafe(F.col("id_")), "left_semi")
    empty = F.btrim(F.coalesce(F.col("row.text"), F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == ""
    nth = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(0)))
    return d.withColumn("nth", nth).where((F.col("nth") == 1) | empty).select("row.*")
