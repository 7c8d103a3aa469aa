"""A hierarchical Pitman-Yor language model of three words, seated by Gibbs sampling over Spark partitions.

Restaurants: one for each context of two words, one for each context of one word, which is the parent of
those that end in that word, and one without context, whose base is uniform over the V training words and
an unknown one. Contexts are told apart by 64-bit hashes of their words. Each level has its own discount,
taken from its counts of one and of two.

Blocks of documents send each distinct run of three words once to the part of its middle word (the part
of a frequent word's contexts is chosen by the word before, so that no part is too large), with their
training counts. A part has whole restaurants of two words with their parents, and seats them. The
restaurant without context lies by ranges of word hash in roots: parts tell them how many tables each
word has, roots seat it and tell the parts its probability. Of a frequent context word, whose restaurants of
two words lie in several parts, the roots seat the restaurant of one word too. A sweep is one such round:
each type (a word in a restaurant) has all its customers seated anew, that is, its number of tables is
drawn given those of the others; parts take the roots' probabilities as they were after the last sweep, as
in other distributed Gibbs samplers. Seats are written after each sweep, and draws follow from the seed,
the part and the sweep, so a lost executor costs one sweep of its parts.

After SWEEPS rounds each part goes on sweeping by itself, with the roots as they are then, and takes SAMPLES
samples. Scores are log10 of the probability averaged over them; blocks get it for each of their runs in the
order in which they sent them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.llm import text
from motifmill.llm.shared import discard, in_arrow, partitions, save_and_free
from motifmill.llm.text import U64

#: Sweeps of parts and roots before samples are taken, and samples.
SWEEPS, SAMPLES = 2, 3
#: Strengths of the restaurants of two words, of one, and of none.
STRENGTHS = (1.0, 1.0, 1.0)
#: Tokens of a block and of a part, about.
BLOCK_TOKENS, PART_TOKENS = 3 << 20, 2_500_000
#: Bins of word hashes whose loads are counted first.
BIN_BITS = 16
#: A context word's load is counted by itself where more than one of so many of a block's tokens are it.
FREQUENT = 1 << 16
#: Customers up to which the number of tables is drawn from its exact distribution.
EXACT = 48

_END = int(text.mix(np.array([0xE0D], U64))[0])
_BEGIN = int(text.mix(np.array([0xB0D], U64))[0])


def _dump(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, byte by byte of all their numbers, compressed."""
    import zstandard

    head = "\n".join(f"{a.dtype.str} {len(a)}" for a in arrays).encode()
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([len(head).to_bytes(4, "little"), head, *planes]))


def _load(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for line in raw[4:at].decode().splitlines():
        kind, n = line.split()
        kind, n = np.dtype(kind), int(n)
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def _steps(words: np.ndarray) -> np.ndarray:
    """Sorted hashes as steps, whose high bytes are zeros; np.cumsum undoes it."""
    return np.diff(words, prepend=U64(0))


def _ranks(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of equally long arrays of whole numbers, sorted, and each row's place among them."""
    bits = [max(int(k.max()).bit_length(), 1) if len(k) else 1 for k in keys]
    if sum(bits) > 63:  # first the ranks of all but the last, then those with it
        before, place = _ranks(*keys[:-1])
        (at, last), place = _ranks(place, keys[-1]) if bits[-1] + len(before[0]).bit_length() < 64 else _ranks(place, np.unique(keys[-1], return_inverse=True)[1])
        if bits[-1] + len(before[0]).bit_length() >= 64:
            last = np.unique(keys[-1])[last]
        return [*(k[at] for k in before), last], place
    packed = np.zeros(len(keys[0]), np.int64)
    for k, n in zip(keys, bits):
        packed = (packed << n) | k.astype(np.int64)
    packed, place = np.unique(packed, return_inverse=True)
    out = []
    for n in reversed(bits):
        out.append(packed & ((1 << n) - 1))
        packed = packed >> n
    return out[::-1], place


def _bins(h: np.ndarray, bits: int = BIN_BITS) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64)


def _loads(batches):
    """Arrow batches of (text) to rows (word, key, n): tokens that follow a word of each bin of hashes (word false), and those that follow a frequent word."""
    n = np.zeros(1 << BIN_BITS, np.int64)
    words = [(np.array([_BEGIN], U64), np.zeros(1, np.int64))]
    held: list[np.ndarray] = []

    def count():
        h = np.concatenate(held)
        held.clear()
        bins = _bins(h)
        here = np.bincount(bins, minlength=len(n))
        np.add(n, here, out=n)
        # a word as frequent as that is in a bin as frequent at least
        w, k = np.unique(h[here[bins] * FREQUENT > len(h)], return_counts=True)
        some = k * FREQUENT > len(h)
        words.append((w[some], k[some]))

    for batch in batches:
        n[_BEGIN >> (64 - BIN_BITS)] += batch.num_rows
        words[0][1][0] += batch.num_rows
        for _, _, h in text.words(text.column(batch, "text"), lower=True):
            held.append(h)
            if sum(map(len, held)) >= BLOCK_TOKENS:
                count()
    if held:
        count()
    w, k = (np.concatenate(x) for x in zip(*words))
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(np.zeros(len(some), bool), np.ones(len(w), bool))), pa.array(np.append(some, w.view(np.int64))), pa.array(np.append(n[some], k))], ["word", "key", "n"]
    )


class Layout:
    """Parts of the context words: neighbouring bins fill a part; a frequent word has parts of its own.

    known: words that all blocks and parts know by their places here, sorted.
    """

    def __init__(self, loads: np.ndarray, words: np.ndarray, counts: np.ndarray, parts: int, known: np.ndarray | None = None):
        self.known = np.zeros(0, U64) if known is None else np.unique(known)
        room = max(int(loads.sum()) / parts, 1.0)
        often = counts > room / 4
        order = np.argsort(words[often])
        self.words, counts = words[often][order], counts[often][order]  # 4 * parts at most
        loads = np.maximum(loads - np.bincount(_bins(self.words), counts, len(loads)), 0)
        self.first = np.zeros(len(loads), np.int64)
        part, held = 0, 0.0
        for b, n in enumerate(loads.tolist()):
            if held and held + n > room:
                part, held = part + 1, 0.0
            self.first[b] = part
            held += n
        self.split = np.maximum(np.ceil(counts / room).astype(np.int64), 1)
        self.own = part + 1 + np.cumsum(self.split) - self.split
        self.parts = part + 1 + int(self.split.sum())

    def frequent(self, h1: np.ndarray) -> np.ndarray:
        """The words' places among the frequent ones, or -1."""
        if not len(self.words):
            return np.full(len(h1), -1)
        at = np.minimum(np.searchsorted(self.words, h1), len(self.words) - 1)
        return np.where(self.words[at] == h1, at, -1)

    def part(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.frequent(h1)
        if not len(self.words):
            return self.first[_bins(h1)]
        return np.where(at < 0, self.first[_bins(h1)], self.own[at] + (text.mix(h2) % self.split[at].astype(U64)).astype(np.int64))


SENT = "to int, frm long, request binary, rows binary"


def _row(names: list[str], to: int, frm: int, **payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([frm], pa.int64()), *[pa.array([payload.get(c)], pa.binary()) for c in names]], ["to", "frm", *names])


def _blocks(sent, block_tokens: int):
    """Arrow batches of (doc_id, text, held) to requests, one row for each block and part, and the blocks' rows."""

    def run(batches):
        from pyspark import TaskContext

        layout: Layout = sent.value
        block = TaskContext.get().partitionId() << 24
        tokens: list[np.ndarray] = []
        sizes, facts, held = [], [], 0

        def flush():
            nonlocal block, held
            size = np.concatenate(sizes)
            ids, null, out = (np.concatenate(x) for x in zip(*facts))
            w = np.concatenate(tokens)
            tokens.clear()
            requests, order = request(w, size, np.repeat(out == 0, size), layout)
            for part, blob in requests:
                yield _row(["request", "rows"], part, block, request=blob)
            spread = int(text.mix(np.array([block], U64))[0]) % layout.parts  # blocks are numbered in steps, so their remainders aren't even
            yield _row(["request", "rows"], spread, block, rows=_dump(ids, null, out, size, order))
            block, held = block + 1, 0
            sizes.clear(), facts.clear()

        for batch in batches:
            ids = batch.column("doc_id")
            null = np.asarray(ids.is_null()).astype("u1")
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            out = batch.column("held").to_numpy(zero_copy_only=False).astype("u1")
            for at, offsets, h in text.words(text.column(batch, "text"), lower=True):
                n = len(offsets) - 1
                size = len(h) + n
                ends = offsets[1:] + np.arange(n)  # place of each row's end token
                w = np.full(size, _END, U64)
                word = np.ones(size, bool)
                word[ends] = False
                w[word] = h
                tokens.append(w)
                sizes.append((np.diff(offsets) + 1).astype("<u4"))
                facts.append((ids[at : at + n], null[at : at + n], out[at : at + n]))
                held += size
                if held >= block_tokens:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _named(words: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes as steps of the places of the known ones and steps of the others."""
    here = np.isin(words, known, assume_unique=True)
    return np.diff(np.searchsorted(known, words[here]), prepend=0).astype("<u4"), _steps(words[~here])


def _hashes(places: np.ndarray, others: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.sort(np.concatenate([known[np.cumsum(places, dtype=np.int64)], np.cumsum(others)]))


def request(w: np.ndarray, size: np.ndarray, train: np.ndarray, layout: Layout) -> tuple[list[tuple[int, bytes]], np.ndarray]:
    """Distinct runs of three words by part, and each token's place among all of them in the order of parts.

    The words two before only have to be told apart among those of one context word, so 36 bits are sent of them.
    """
    words, i0 = np.unique(np.append(w, U64(_BEGIN)), return_inverse=True)
    i0 = i0.astype(np.int32)
    begin, i0 = i0[-1], i0[:-1]
    first = np.cumsum(size) - size
    i1 = np.append(begin, i0[:-1])
    i1[first] = begin
    i2 = np.append(begin, i1[:-1])
    i2[first] = begin
    (u1, u2, u0), place = _ranks(i1, i2, i0)
    place = place.astype(np.int32)
    del i0, i1, i2
    n = np.bincount(place, train, len(u0)).astype("<u4")
    part = layout.part(words[u1], words[u2])
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
    known2 = np.unique(layout.known >> U64(28))
    out = []
    for s in np.split(order, cut[1:]):
        used, local = np.unique(np.concatenate([u1[s], u0[s]]), return_inverse=True)
        used2, local2 = np.unique(words[u2[s]] >> U64(28), return_inverse=True)
        l1, l0 = np.split(local.astype("<u4"), 2)
        changed = np.append(True, l1[1:] != l1[:-1])
        step2 = np.where(changed, local2, np.diff(local2, prepend=0)).astype("<u4")  # rising after each new context word
        out.append((int(part[s[0]]), _dump(*_named(words[used], layout.known), *_named(used2, known2), np.diff(l1, prepend=np.uint32(0)), step2, l0, n[s])))
    rank = np.empty(len(order), "<u4")
    rank[order] = np.arange(len(order))
    return out, rank[place]


def _requested(blob: bytes, known: np.ndarray, known2: np.ndarray) -> tuple[np.ndarray, ...]:
    """A request's words, its words two before (36 bits), the places of each run's three words in them, and its count."""
    places, others, places2, others2, step1, step2, l0, n = _load(blob)
    l1 = np.cumsum(step1, dtype=np.int64)
    # sums of the steps since the last new context word
    new = np.flatnonzero(np.append(True, step1[1:] != 0))
    sums = np.cumsum(step2, dtype=np.int64)
    l2 = sums - np.repeat(sums[new] - step2[new], np.diff(np.append(new, len(step2))))
    return _hashes(places, others, known), _hashes(places2, others2, known2), l1, l2, l0, n


class Part:
    """The restaurants of a part. Types of two words: count, restaurant r2 and parent type j; of one: restaurant r1, and place x of what the roots tell."""

    def __init__(self, *arrays: np.ndarray):
        self.count, self.new2, self.new_word, self.near, self.new1, self.frequent, self.x = arrays
        self.r2, self.r1 = np.cumsum(self.new2, dtype=np.int64) - 1, np.cumsum(self.new1, dtype=np.int64) - 1
        # near: a type's parent, counted from the first parent of the same context word
        self.j = np.flatnonzero(self.new1)[np.cumsum(self.new_word, dtype=np.int64) - 1] + self.near

    @classmethod
    def build(cls, requests: list[bytes], layout: Layout):
        """The part, each request's places among its types, and what the roots are told of its words: (word, frequent context or 0, tokens)."""
        known2 = np.unique(layout.known >> U64(28))
        loaded = [_requested(b, layout.known, known2) for b in requests]
        words, words2 = (np.unique(np.concatenate([x[i] for x in loaded])) for i in (0, 1))
        keys, n = [[], [], []], []
        for used, used2, l1, l2, l0, k in loaded:
            at, at2 = np.searchsorted(words, used).astype(np.int32), np.searchsorted(words2, used2).astype(np.int32)
            for key, i in zip(keys, (at[l1], at2[l2], at[l0])):
                key.append(i)
            n.append(k)
        sizes = [len(x) for x in n]
        del loaded
        (w1, w2, w0), place = _ranks(*map(np.concatenate, keys))
        count = np.bincount(place, np.concatenate(n), len(w0)).astype("<u4")
        changed1 = np.append(True, w1[1:] != w1[:-1])
        new2 = changed1 | np.append(True, w2[1:] != w2[:-1])
        (v1, v0), j = _ranks(w1, w0)
        frequent = layout.frequent(words[v1]) >= 0
        (x0, x1), x = _ranks(v0, np.where(frequent, v1 + 1, 0))
        new1 = np.append(True, v1[1:] != v1[:-1])
        near = j - np.flatnonzero(new1)[np.cumsum(changed1) - 1]
        part = cls(count, new2.astype("u1"), changed1.astype("u1"), near.astype("<u4"), new1.astype("u1"), frequent.astype("u1"), x.astype("<u4"))
        tag = np.where(x1 > 0, words[np.maximum(x1 - 1, 0)], U64(0))
        tokens = np.bincount(part.x[part.j], count, len(x0)).astype("<u4")
        return part, np.split(place.astype("<u4"), np.cumsum(sizes)[:-1]), (words[x0], tag, tokens)

    def blob(self) -> bytes:
        return _dump(self.count, self.new2, self.new_word, self.near, self.new1, self.frequent, self.x)

    def first_seats(self) -> tuple[np.ndarray, np.ndarray]:
        """One table for each type that has customers."""
        tables2 = np.minimum(self.count, 1).astype(np.int64)
        return tables2, np.where(self.frequent > 0, 0, np.minimum(self.above(tables2), 1)).astype(np.int64)

    def seats(self, held: dict) -> tuple[np.ndarray, np.ndarray]:
        """The seats that were written (kind 1), or the first ones."""
        return tuple(x.astype(np.int64) for x in _load(held[1][0][1])) if 1 in held else self.first_seats()

    def above(self, tables: np.ndarray) -> np.ndarray:
        """Customers of the types of one word, from the tables of those of two."""
        return np.bincount(self.j, tables, len(self.x))

    def told(self, tables2: np.ndarray, tables1: np.ndarray) -> np.ndarray:
        """Tables of each of the roots' words; of frequent contexts the customers that the roots seat themselves."""
        return np.bincount(self.x, np.where(self.frequent > 0, self.above(tables2), tables1), int(self.x.max()) + 1 if len(self.x) else 0).astype("<u4")

    def parents(self, tables2, tables1, root, d, strengths) -> np.ndarray:
        """The probability that each type's parent gives its word."""
        c = self.above(tables2)
        t, all_ = np.bincount(self.r1, tables1), np.bincount(self.r1, c)
        p = root[self.x]
        one = (np.maximum(c - d[1] * tables1, 0) + (strengths[1] + d[1] * t[self.r1]) * p) / (strengths[1] + all_[self.r1])
        return np.where(self.frequent > 0, p, one)

    def predict(self, tables2, tables1, root, d, strengths) -> np.ndarray:
        p = self.parents(tables2, tables1, root, d, strengths)[self.j]
        t, c = np.bincount(self.r2, tables2), np.bincount(self.r2, self.count)
        return (np.maximum(self.count - d[0] * tables2, 0) + (strengths[0] + d[0] * t[self.r2]) * p) / (strengths[0] + c[self.r2])

    def sweep(self, tables2, tables1, root, d, strengths, rng) -> tuple[np.ndarray, np.ndarray]:
        p = self.parents(tables2, tables1, root, d, strengths)[self.j]
        tables2 = draw_tables(self.count, tables2, np.bincount(self.r2, tables2)[self.r2], p, d[0], strengths[0], rng)
        c = self.above(tables2).astype(np.int64)
        seated = np.where(self.frequent > 0, 0, c)
        tables1 = draw_tables(seated, np.minimum(tables1, seated), np.bincount(self.r1, tables1)[self.r1], root[self.x], d[1], strengths[1], rng)
        return tables2, tables1


def log_stirling(n: int, d: float) -> np.ndarray:
    """[c, t]: log of the generalised Stirling number, the weight of all seatings of c customers at t tables."""
    out = np.full((n + 1, n + 2), -np.inf)
    out[0, 0] = 0.0
    for c in range(n):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            out[c + 1, t] = np.logaddexp(out[c, t - 1], out[c, t] + np.log(np.maximum(c - d * t, 0)))
    return out[:, : n + 1]


def draw_tables(count: np.ndarray, tables: np.ndarray, in_restaurant: np.ndarray, p: np.ndarray, d: float, strength: float, rng) -> np.ndarray:
    """The tables of each type, all its customers seated anew, given the tables of its restaurant's other types and its parent's probability.

    t tables of c customers weigh S(c, t) * p**t * product over k < t of (strength + d * (other tables + k)).
    Beyond EXACT customers, the others sit down in groups of a quarter of those seated, each at a new table
    with its probability when half the group has come.
    """
    out = np.minimum(count, 1).astype(np.int64)
    others = in_restaurant - tables
    many = np.flatnonzero(count > 1)
    capped = np.minimum(count[many], EXACT)
    order = np.argsort(capped, kind="stable")
    many, capped = many[order], capped[order]
    if not len(many):
        return out
    stirling = log_stirling(int(capped[-1]), d)
    cut = np.flatnonzero(np.append(True, capped[1:] != capped[:-1]))
    for s, c in zip(np.split(many, cut[1:]), capped[cut].tolist()):
        for a in range(0, len(s), 1 << 16):
            i = s[a : a + (1 << 16)]
            weight = np.cumsum(np.log(strength + d * (others[i][:, None] + np.arange(c))) + np.log(np.maximum(p[i], 1e-300))[:, None], axis=1) + stirling[c, 1 : c + 1]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[i] = 1 + (weight < (rng.random(len(i)) * weight[:, -1])[:, None]).sum(axis=1)
    i = many[np.searchsorted(capped, EXACT) :] if capped[-1] == EXACT else many[:0]
    i = i[count[i] > EXACT]
    seated = EXACT
    while len(i):
        group = np.minimum(count[i].astype(np.int64) - seated, max(seated // 4, 1))
        new = (strength + d * (others[i] + out[i])) * p[i]
        out[i] += rng.binomial(group, np.clip(new / (new + seated + (group - 1) / 2 - d * out[i]), 0, 1))
        seated += max(seated // 4, 1)
        i = i[count[i] > seated]
    return out


BUILT = "to int, frm long, payload binary, kind string"


def _built(to: int, frm: int, kind: str, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([frm], pa.int64()), pa.array([payload], pa.binary()), pa.array([kind])], ["to", "frm", "payload", "kind"])


def _slices(words: np.ndarray, roots: int):
    """(root, its slice) of sorted words, by ranges of hash."""
    root = ((words >> U64(32)) * U64(roots)) >> U64(32)
    cut = np.flatnonzero(np.append(True, root[1:] != root[:-1])) if len(words) else np.zeros(0, np.int64)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(words)]):
        yield int(root[a]), slice(a, b)


def _build(sent, roots: int):
    """Rows sorted by (to, frm) to each part's state and first seats, what roots are told, and blocks' places in it; blocks' own rows go on."""

    def run(batches):
        layout: Layout = sent.value
        part, blocks, requests = None, [], []

        def close():
            built, places, (words, tag, tokens) = Part.build(requests, layout)
            tables2, tables1 = built.first_seats()
            facts = np.array([[(x == n).sum() for n in (1, 2)] for x in (built.count, built.above(tables2))], np.int64).ravel()
            yield _built(part, part, "state", built.blob())
            yield _built(part, part, "facts", _dump(facts))
            say = built.told(tables2, tables1)
            for root, s in _slices(words, roots):
                yield _built(root, part, "words", _dump(_steps(words[s]), tag[s], tokens[s], say[s]))
            for block, at in zip(blocks, places):
                yield _built(part, block, "places", _dump(np.diff(at, prepend=np.uint32(0))))
            blocks.clear(), requests.clear()

        for batch in batches:
            for to, frm, blob, rows in zip(*[batch.column(c).to_pylist() for c in ("to", "frm", "request", "rows")]):
                if to != part and requests:
                    yield from close()
                part = to
                if rows is not None:
                    yield _built(to, frm, "rows", rows)
                else:
                    blocks.append(frm), requests.append(blob)
        if requests:
            yield from close()

    return run


class Root:
    """A range of words without context, and words after frequent contexts: the places that each part's words have here."""

    def __init__(self, words: np.ndarray, tag: np.ndarray, tokens: np.ndarray, parts: np.ndarray, sizes: np.ndarray, at: np.ndarray):
        self.words, self.tag, self.tokens, self.parts, self.sizes, self.at = words, tag, tokens, parts, sizes, at
        self.word = np.cumsum(np.append(True, words[1:] != words[:-1])) - 1  # of each entry, its word's place
        self.contexts, self.context = np.unique(tag, return_inverse=True)  # 0 first, unless all are tagged

    @classmethod
    def build(cls, told: list[tuple[int, bytes]]):
        parts, loaded = [p for p, _ in told], [(np.cumsum(w), *rest) for w, *rest in (_load(b) for _, b in told)]
        words, tag, tokens, say = (np.concatenate(x) for x in zip(*loaded))
        distinct_w, w = np.unique(words, return_inverse=True)
        distinct_t, t = np.unique(tag, return_inverse=True)
        (w, t), at = _ranks(w, t)
        per_word = np.bincount(w[at], tokens, len(distinct_w))
        root = cls(distinct_w[w], distinct_t[t], per_word[w].astype("<i8"), np.array(parts, "<i8"), np.array([len(x[0]) for x in loaded], "<i8"), at.astype("<u4"))
        return root, root.summed(say)

    def blob(self) -> bytes:
        return _dump(self.words, self.tag, self.tokens, self.parts, self.sizes, self.at)

    def summed(self, say: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, say, len(self.words)).astype(np.int64)

    def customers(self, say: np.ndarray, tables1: np.ndarray) -> np.ndarray:
        """Customers of each word: tables that parts and the frequent contexts here have of it."""
        return np.bincount(self.word, np.where(self.tag > 0, tables1, say))


ROOT = "to int, frm long, state binary, seats binary, reply binary, fact string, key long, x long, y long"


def _root_row(to: int, frm: int, state=None, seats=None, reply=None, fact=None, key=None, x=None, y=None) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((to, frm, state, seats, reply, fact, key, x, y), types)], [c.split()[0] for c in ROOT.split(", ")])


def _grouped(batches):
    """Sorted (to, kind, frm, payload): (to, {kind: [(frm, payload)]})."""
    to, held = None, {}
    for batch in batches:
        for t, kind, frm, payload in zip(*[batch.column(c).to_pylist() for c in ("to", "kind", "frm", "payload")]):
            if t != to and held:
                yield to, held
                held = {}
            to = t
            held.setdefault(kind, []).append((frm, payload))
    if held:
        yield to, held


def _roots(sweep: int, d, strengths, totals, seed: int, tokens: bool):
    """What a root is told (kind 2), with its state and seats (0, 1) or, at first, without, to its seats, replies and facts.

    totals: (words V, all customers, all tables, {frequent context: (customers, tables)}) after the last sweep, or
    None at first, when each type has one table and no reply can be made.
    """

    def run(batches):
        for to, held in _grouped(batches):
            if 0 not in held:
                root, say = Root.build(held[2])
                tables1 = np.where(root.tag > 0, np.minimum(say, 1), 0)
                tables0 = np.minimum(root.customers(say, tables1), 1)
                yield _root_row(to, -1, state=root.blob())
            else:
                root = Root(*_load(held[0][0][1]))
                say, tables1, tables0 = (x.astype(np.int64) for x in _load(held[1][0][1]))
                words, all_, tables, contexts = totals
                if held.get(2):
                    # parts answer in the order of their numbers, as they were told of
                    say = root.summed(np.concatenate([_load(b)[0] for _, b in held[2]]))
                    rng = np.random.default_rng([seed, 1 << 30, to, sweep])
                    p0 = probability(root, tables0, root.customers(say, tables1), words, all_, tables, d, strengths)[root.word]
                    in_context = np.array([contexts.get(int(c), (0, 0))[1] for c in root.contexts.view(np.int64)])[root.context]
                    seated = np.where(root.tag > 0, say, 0)
                    tables1 = draw_tables(seated, np.minimum(tables1, seated), np.maximum(in_context, tables1), p0, d[1], strengths[1], rng)
                    c0 = root.customers(say, tables1).astype(np.int64)
                    tables0 = draw_tables(c0, np.minimum(tables0, c0), np.full(len(c0), max(tables, 1)), np.full(len(c0), 1 / (words + 1)), d[2], strengths[2], rng)
                else:
                    p0 = probability(root, tables0, root.customers(say, tables1), words, all_, tables, d, strengths)[root.word]
                    of = [contexts.get(int(c), (0, 0)) for c in root.contexts.view(np.int64)]
                    c1, t1 = (np.array([x[k] for x in of])[root.context] for k in (0, 1))
                    one = (np.maximum(say - d[1] * tables1, 0) + (strengths[1] + d[1] * t1) * p0) / (strengths[1] + c1)
                    p = np.where(root.tag > 0, one, p0).astype("<f4")
                    for part, at in zip(root.parts.tolist(), np.split(root.at, np.cumsum(root.sizes)[:-1])):
                        yield _root_row(part, to, reply=_dump(p[at], *([root.tokens[at].astype("<u4")] if tokens else [])))
                    continue
            c0 = root.customers(say, tables1)
            yield _root_row(to, -1, seats=_dump(say.astype("<u4"), tables1.astype("<u4"), tables0.astype("<u4")))
            first = np.flatnonzero(np.append(True, root.words[1:] != root.words[:-1]))
            n = root.tokens[first]
            yield _root_row(to, to, fact="tokens", key=0, x=int(n.sum()), y=int((n > 0).sum()))
            yield _root_row(to, to, fact="tables", key=0, x=int(c0.sum()), y=int(tables0.sum()))
            yield _root_row(to, to, fact="counts", key=0, x=int((c0 == 1).sum()), y=int((c0 == 2).sum()))
            for k, c in enumerate(root.contexts.view(np.int64).tolist()):
                if c:
                    mine = root.context == k
                    yield _root_row(to, to, fact="context", key=c, x=int(say[mine].sum()), y=int(tables1[mine].sum()))

    return run


def probability(root: Root, tables0, c0, words: int, all_: int, tables: int, d, strengths) -> np.ndarray:
    return (np.maximum(c0 - d[2] * tables0, 0) + (strengths[2] + d[2] * tables) / (words + 1)) / (strengths[2] + all_)


SWEPT = "to int, frm long, seats binary, say binary"
_SWEPT = ["seats", "say"]


def _sweep(sweep: int, d, strengths, seed: int):
    """A part's state, seats, roots' replies (kinds 0, 1, 2) to its next seats and what roots are told."""

    def run(batches):
        for to, held in _grouped(batches):
            part = Part(*_load(held[0][0][1]))
            tables2, tables1 = part.seats(held)
            replies = [_load(b)[0] for _, b in held[2]]  # in the order of roots, as the words are
            tables2, tables1 = part.sweep(tables2, tables1, np.concatenate(replies).astype(np.float64), d, strengths, np.random.default_rng([seed, to, sweep]))
            yield _row(_SWEPT, to, to, seats=_dump(tables2.astype("<u4"), tables1.astype("<u4")))
            say = part.told(tables2, tables1)
            for (frm, _), s in zip(held[2], np.split(say, np.cumsum([len(r) for r in replies])[:-1])):
                yield _row(_SWEPT, frm, to, say=_dump(s))

    return run


def _answers(sweep: int, samples: int, d, strengths, seed: int):
    """A part's state, seats, roots' replies and blocks' places in it (kinds 0 to 3) to (block, 1, part, answer), from samples of further sweeps.

    An answer has log10 of the probabilities' means, in steps of 2**-12, and the words' training counts.
    """

    def run(batches):
        for to, held in _grouped(batches):
            part = Part(*_load(held[0][0][1]))
            tables2, tables1 = part.seats(held)
            replies = [_load(b) for _, b in held[2]]
            root = np.concatenate([r[0] for r in replies]).astype(np.float64)
            rng = np.random.default_rng([seed, to, sweep])
            sums = np.zeros(len(part.count))
            for _ in range(samples):
                tables2, tables1 = part.sweep(tables2, tables1, root, d, strengths, rng)
                sums += part.predict(tables2, tables1, root, d, strengths)
            log = (np.round(np.log10(np.maximum(sums / samples, 1e-300)) * 4096) / 4096).astype("<f4")
            tokens = np.concatenate([r[1] for r in replies])[part.x][part.j]
            for block, blob in held[3]:
                # places fall where words two before have the same 36 bits, so their steps are taken modulo 2**32
                at = np.cumsum(_load(blob)[0], dtype=np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([1], pa.int32()), pa.array([to], pa.int64()), pa.array([_dump(log[at], tokens[at])], pa.binary())], ["to", "kind", "frm", "payload"])

    return run


def _scores(n: int, words: int):
    """Sorted (to, kind, frm, payload), to: block; its rows (kind 0) and the parts' answers (1), to one row for each of its documents."""

    def run(batches):
        for _, held in _grouped(batches):
            ids, null, out, size, order = _load(held[0][0][1])
            log, tokens = (np.concatenate(x)[order] for x in zip(*[_load(b) for _, b in held[1]]))
            first = np.cumsum(size, dtype=np.int64) - size
            base = np.log10((tokens.astype(np.float64) + 1) / (n + words + 1))
            sums = [np.add.reduceat(x, first) for x in (base, log.astype(np.float64))]
            known = np.add.reduceat((tokens > 0).astype(np.int64), first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=null.astype(bool)), pa.array(out.astype(bool)), pa.array(size.astype(np.int64)), pa.array(known), pa.array(np.full(len(ids), n, np.int64)), *map(pa.array, sums)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def _kind(df: DataFrame, kind: int, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select("to", F.lit(kind).alias("kind"), "frm", F.col(column).alias("payload"))


def _together(n: int, *tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out.repartitionById(n, F.col("to")).sortWithinPartitions("to", "kind", "frm")


def _part(built: DataFrame, kind: int, name: str) -> DataFrame:
    return built.where(F.col("kind") == name).select("to", F.lit(kind).alias("kind"), "frm", "payload")


def score(docs: DataFrame, sweeps: int = SWEEPS, samples: int = SAMPLES, strengths: tuple[float, float, float] = STRENGTHS, seed: int = 11, part_tokens: int = PART_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text: empty, so only its end is scored. Null doc_id: crc32 of the empty string, which is in
    training. Repeated rows: each is learnt from and scored. No rows: no rows. Without training rows every
    token is unknown. Other columns aren't read.
    """
    spark = docs.sparkSession
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    d_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.cast("byte").alias("held"))
    counted = save_and_free(in_arrow(docs.select("text"), _loads, "word boolean, key long, n long").groupBy("word", "key").agg(F.sum("n").alias("n")), "loads")
    loads = np.zeros(1 << BIN_BITS, np.int64)
    for r in counted.where("not word").collect():  # 2**BIN_BITS rows at most
        loads[r.key] = r.n
    total = int(loads.sum())
    if not total:
        return spark.createDataFrame([], schema)
    parts = max(1, -(-total // part_tokens))
    often = counted.where(F.col("word") & (F.col("n") > total / parts / 4)).collect()  # 4 * parts rows at most
    known = counted.where(F.col("word") & (F.col("n") * FREQUENT > total)).select("key").collect()  # FREQUENT rows at most
    layout = Layout(loads, np.array([r.key for r in often], np.int64).view(U64), np.array([r.n for r in often], np.int64), parts, np.array([r.key for r in known], np.int64).view(U64))
    sent = spark.sparkContext.broadcast(layout)  # of 2**BIN_BITS + FREQUENT + 12 * parts numbers at most
    roots = max(1, parts // 2)
    cut = in_arrow(d_, _blocks(sent, block_tokens), SENT).repartitionById(layout.parts, F.col("to")).sortWithinPartitions("to", "frm")
    built = save_and_free(in_arrow(cut, _build(sent, roots), BUILT), "parts", "kind")
    del cut
    ones = in_arrow(_part(built, 1, "facts").select("payload"), _facts, "a long, b long, c long, d long").agg(*[F.sum(c) for c in "abcd"]).first()
    state, seats = _part(built, 0, "state"), None
    root = save_and_free(in_arrow(_together(roots, _part(built, 2, "words")), _roots(0, None, strengths, None, seed, False), ROOT), "roots")
    discard(built, "kind=words")
    root_state, root_seats = _kind(root, 0, "state"), _kind(root, 1, "seats")

    def facts(table: DataFrame):
        rows = table.where("fact is not null").groupBy("fact", "key").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()  # one for each frequent context, and three
        one = {r.fact: (r.x, r.y) for r in rows if r.fact != "context"}
        return one, {r.key: (r.x, r.y) for r in rows if r.fact == "context"}

    one, contexts = facts(root)
    n, words = one["tokens"]
    rate = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5
    d = (rate(ones[0], ones[1]), rate(ones[2], ones[3]), rate(*one["counts"]))
    for k in range(sweeps + 1):
        totals = (words, *one["tables"], contexts)
        replies = save_and_free(in_arrow(_together(roots, root_state, root_seats), _roots(k, d, strengths, totals, seed, k == sweeps), ROOT), "replies")
        told = _kind(replies, 2, "reply")
        if k == sweeps:
            break
        swept = save_and_free(in_arrow(_together(layout.parts, state, told, *([seats] if k else [])), _sweep(k, d, strengths, seed), SWEPT), "seats")
        new = save_and_free(in_arrow(_together(roots, root_state, root_seats, _kind(swept, 2, "say")), _roots(k, d, strengths, totals, seed, False), ROOT), "roots")
        discard(replies)
        if k:
            discard(root), discard(before)  # the first root has all roots' states
        root, root_seats, before, seats = new, _kind(new, 1, "seats"), swept, _kind(swept, 1, "seats")
        one, contexts = facts(root)
    tables = [state, told, _part(built, 3, "places")] + ([seats] if sweeps else [])
    answers = save_and_free(in_arrow(_together(layout.parts, *tables), _answers(sweeps, samples, d, strengths, seed), "to long, kind int, frm long, payload binary"), "answers")
    for kind in ("state", "places"):
        discard(built, f"kind={kind}")
    rows = _part(built, 0, "rows").select(F.col("frm").alias("to"), "kind", F.col("to").cast("long").alias("frm"), "payload")
    both = rows.union(answers).repartition(partitions(spark), "to").sortWithinPartitions("to", "kind", "frm")
    return in_arrow(both, _scores(n, words), schema)


def _facts(batches):
    for batch in batches:
        rows = np.array([_load(b)[0] for b in batch.column("payload").to_pylist()], np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(4)], list("abcd"))


def perplexity(scored: DataFrame) -> DataFrame:
    """Per side of the hold-out: tokens and perplexity of the model and of the base; no rows give none."""
    return scored.groupBy("held_out").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"),
        F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity"),
    )
