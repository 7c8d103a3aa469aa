"""Token ids in a bit-plane file format.

A store is a table of frames. A frame holds whole documents: a header row (shard, frame number, first id
within the shard, the documents' ids and lengths) and a payload. The payload cuts the ids into blocks of
BLOCK ids and transposes each block, so that bit (or byte) j of all its ids lies together; each plane of
each block is compressed with zstandard as a chunk of its own, and an index of the chunks' places and sizes
stands ahead of them, so any block can be read by itself. Spark writes the table, so a store commits as a
whole and can lie wherever Spark can write.

Payload, little-endian: magic "BPL2", plane width in bits (1 or 8), 3 zero bytes, number of ids (u64),
number of planes (u32), ids per block (u32), one (offset u64, size u32, 4 zero bytes) per block and plane,
chunks.
"""

from __future__ import annotations

import functools
import itertools
import json
import string
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifmill.llm import text
from motifmill.llm.shared import in_arrow, new_path, partitions

BLOCK = 1 << 15
#: A frame is closed at the first document end after so many ids.
FRAME_IDS = 1 << 17
LEVEL = 3
MAGIC = b"BPL2"
_HEAD = struct.Struct("<4sB3xQII")
_ENTRY = struct.Struct("<QI4x")

FRAME_SCHEMA = "shard int, frame long, first_id long, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def pack(ids: np.ndarray, plane_bits: int = 1, block: int = BLOCK, level: int = LEVEL) -> bytes:
    """Ids (unsigned 32-bit) to a payload. Planes above the largest id's top bit are left out; the last block may be short."""
    import zstandard

    n = len(ids)
    top = int(ids.max()).bit_length() if n else 0
    planes = -(-top // plane_bits)
    compressor = zstandard.ZstdCompressor(level=level)
    chunks = []
    for a in range(0, n, block):
        octets = np.ascontiguousarray(ids[a : a + block], "<u4").view(np.uint8)
        for j in range(planes):
            if j * plane_bits % 8 == 0:
                low = np.ascontiguousarray(octets[j * plane_bits // 8 :: 4])  # this byte of all ids
            raw = np.packbits(low & np.uint8(1 << j % 8), bitorder="little") if plane_bits == 1 else low
            chunks.append(compressor.compress(raw.tobytes()))
    at = _HEAD.size + _ENTRY.size * len(chunks)
    index = []
    for c in chunks:
        index.append(_ENTRY.pack(at, len(c)))
        at += len(c)
    return b"".join([_HEAD.pack(MAGIC, plane_bits, n, planes, block), *index, *chunks])


def blocks(payload: bytes) -> int:
    """Number of a payload's blocks."""
    magic, _, n, _, block = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a bit-plane payload")
    return -(-n // block)


def unpack_block(payload: bytes, k: int) -> np.ndarray:
    """The ids of a payload's block k, from its own chunks alone."""
    import zstandard

    if not 0 <= k < blocks(payload):
        raise IndexError(k)
    _, plane_bits, n, planes, block = _HEAD.unpack_from(payload)
    size = min(block, n - k * block)
    out = np.zeros(size, "<u4")
    octets = out.view(np.uint8)
    decompressor = zstandard.ZstdDecompressor()
    for j in range(planes):
        at, length = _ENTRY.unpack_from(payload, _HEAD.size + (k * planes + j) * _ENTRY.size)
        raw = np.frombuffer(decompressor.decompress(payload[at : at + length]), np.uint8)
        if plane_bits == 8:
            octets[j::4] = raw
            continue
        if j % 8 == 0:
            low = np.zeros(size, np.uint8)
        low |= np.unpackbits(raw, count=size, bitorder="little") << np.uint8(j % 8)
        if j % 8 == 7 or j == planes - 1:
            octets[j // 8 :: 4] = low
    return out


def unpack(payload: bytes) -> np.ndarray:
    """A payload's ids."""
    return np.concatenate([np.zeros(0, "<u4"), *[unpack_block(payload, k) for k in range(blocks(payload))]])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: How a tokenizer has to be made for its ids to be those of white-space separated pieces, one after the other.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def cuts_at_spaces(made: dict) -> bool:
    """Whether a tokenizer's parts (its JSON) show that it drops white space and never looks across it, nor from a word's letters to ASCII punctuation after them."""
    steps = [(made.get(k) or {}).get(f"{k.split('_')[0]}s" if k == "normalizer" else "pretokenizers") for k in ("normalizer", "pre_tokenizer")]
    octets = (steps[1] or [{}])[-1]
    model = made["model"]
    return bool(
        steps[0] == _NORMALIZERS and len(steps[1] or ()) == 2 and steps[1][0] == _SPLIT
        and octets.get("type") == "ByteLevel" and not octets.get("add_prefix_space") and not octets.get("use_regex")
        and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not made.get("truncation") and not made.get("padding")
        and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or set(t["content"][:1] + t["content"][-1:]) - set(string.punctuation) for t in made["added_tokens"])
    )


class Encoder:
    """Encodes whole texts with the tokenizers library, remembering the ids of units of text.

    Where the tokenizer's parts allow it (`cuts_at_spaces`), a text's ids are those of its white-space
    separated pieces, and a piece of letters and ASCII punctuation after them has the ids of both. Letters
    that are new are encoded many words a call, whose ids are cut at word ends; the library does all
    lower-casing but that of A-Z. Other tokenizers encode each text as it is. What is remembered is kept in
    Arrow and numpy buffers of `most` bytes, or as much as one group of rows needs.
    """

    def __init__(self, path: str, most: int = 8 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        made = json.loads(self.tokenizer.to_str())
        self.pieces = cuts_at_spaces(made)
        if self.pieces:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Remember nothing, as at first."""
        self.known, self.ids, self.at = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.tried: set[str] = set()
        self.letters: set[str] = set()

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts, one after the other, and how many each has."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(lists), "<u4"), np.fromiter(map(len, lists), np.int64, len(lists))

    def cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `each`, for many words of letters, from one call unless they aren't a run of ids each."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        end = np.flatnonzero(self.ends[ids]) + 1
        if len(end) != len(words) or end[-1] != len(ids):
            return self.each(words)
        return ids, np.diff(np.append(0, end))

    def rows(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column's texts, one after the other, and the rows' places in them."""
        if not self.pieces:
            ids, size = self.each(col.to_pylist())
            return ids, np.append(0, np.cumsum(size))
        which, at, start, size, pool = self._pieces(col)
        start, size = start[which], size[which]
        end = np.append(0, np.cumsum(size))
        return pool[np.repeat(start - end[:-1], size) + np.arange(end[-1])], end[at]

    def lengths(self, col: pa.Array) -> np.ndarray:
        """The number of ids of each of a column's texts."""
        if not self.pieces:
            return np.diff(self.rows(col)[1])
        which, at, _, size, _ = self._pieces(col)
        return np.diff(np.append(0, np.cumsum(size[which]))[at])

    def _pieces(self, col: pa.Array):
        """(each piece's number, the rows' places in the pieces, start and size of each number's ids, ids)."""
        split = pc.ascii_split_whitespace(col)
        at = split.offsets.to_numpy().astype(np.int64)
        pieces = split.flatten().dictionary_encode()
        distinct = pieces.dictionary
        stems = pc.ascii_rtrim(distinct, characters=string.punctuation)
        letters = self._letters(stems)
        heads = pc.if_else(letters, pc.ascii_lower(stems), distinct)
        tails = _tails(distinct, pc.if_else(letters, pc.binary_length(stems), pc.binary_length(distinct)))
        units = pa.concat_arrays([heads, tails]).dictionary_encode()
        start, size, pool = self._look_up(units.dictionary)
        head, tail = np.split(units.indices.to_numpy(), 2)
        # a piece's ids are its head's and its tail's
        each = np.stack([head, tail], 1).ravel()
        n = size[each]
        end = np.append(0, np.cumsum(n))
        pool = pool[np.repeat(start[each] - end[:-1], n) + np.arange(end[-1])]
        return pieces.indices.to_numpy(), at - at[0], end[:-1:2], size[head] + size[tail], pool

    def _letters(self, stems: pa.Array) -> pa.Array:
        """Whether all characters are letters that the tokenizer keeps apart from ASCII punctuation behind them; other than a-z and A-Z, each is tried once."""
        good = pc.or_(pc.ascii_is_alpha(stems), pc.equal(stems, "")).to_numpy(zero_copy_only=False).copy()
        wide = np.flatnonzero(~pc.string_is_ascii(stems).to_numpy(zero_copy_only=False))
        strings = stems.take(pa.array(wide)).to_pylist()
        for c in set().union(*strings) - self.tried:
            self.tried.add(c)
            parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(c + "."))
            if c in string.ascii_letters or c.isalpha() and [p for p, _ in parts[1:]] == ["."]:
                self.letters.add(c)
        good[wide] = [self.letters.issuperset(s) for s in strings]
        return pa.array(good)

    def _look_up(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size) of each unit's ids, and the ids."""
        place = pc.index_in(units, value_set=self.known)
        new = units.filter(place.is_null())
        if len(new):
            alpha = pc.utf8_is_alpha(new)
            words, others = new.filter(alpha), new.filter(pc.invert(alpha))
            ids, sizes = zip(*[self.cut(words.slice(a, 512).to_pylist()) for a in range(0, len(words), 512)], self.each(others.to_pylist()))
            self.known = pa.concat_arrays([self.known, words, others])
            self.ids = np.concatenate([self.ids, *ids])
            self.at = np.append(self.at, self.at[-1] + np.cumsum(np.concatenate(sizes)))
            place = pc.index_in(units, value_set=self.known)
        place = place.to_numpy()
        start, size, pool = self.at[place], np.diff(self.at)[place], self.ids
        if self.known.nbytes + self.ids.nbytes > self.most:  # keep what these rows need
            end = np.append(0, np.cumsum(size))
            pool = pool[np.repeat(start - end[:-1], size) + np.arange(end[-1])]
            self.known, self.ids, self.at = units, pool, end
            start = end[:-1]
        return start, size, pool


def _tails(col: pa.Array, heads: pa.Array) -> pa.Array:
    """What follows the first so many bytes of each string."""
    data, offsets = text.buffers(col)
    start = offsets[:-1] + heads.to_numpy()
    size = offsets[1:] - start
    at = np.append(0, np.cumsum(size))
    raw = data[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
    return pa.StringArray.from_buffers(len(col), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw.tobytes()))


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def groups(col: pa.Array, group_bytes: int = 3 << 20):
    """Runs of a string column's rows of bounded size, a longer text alone: (first row, rows)."""
    _, offsets = text.buffers(col)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + group_bytes, "right")) - 1)
        yield row, col.slice(row, end - row)
        row = end


def _frames(path: str, end_id: int, frame_ids: int, plane_bits: int):
    end = np.array([end_id], "<u4")

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(path)
        shard, frame, first = TaskContext.get().partitionId(), 0, 0
        ids, lengths, parts, held = [], [], [], 0

        def close():
            nonlocal frame, first, ids, lengths, parts, held
            payload = pack(np.concatenate(parts), plane_bits)
            row = [[shard], [frame], [first], [ids], [lengths], [payload]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["shard", "frame", "first_id", "doc_ids", "lengths", "payload"])
            frame, first = frame + 1, first + held
            ids, lengths, parts, held = [], [], [], 0
            return out

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for row, part in groups(text.column(batch, "text")):
                encoded, at = enc.rows(part)
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist()), row):
                    ids.append(doc_ids[i])
                    lengths.append(b - a + 1)
                    parts += (encoded[a:b], end)
                    held += lengths[-1]
                    if held >= frame_ids:
                        yield close()
        if ids:
            yield close()
        enc.forget()

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, frame_ids: int = FRAME_IDS, plane_bits: int = 1, shards: int | None = None) -> None:
    """Encode every text of docs (doc_id, text) and write a store in ascending doc_id order (null first).

    Shards are ranges of doc_id, so the order is global: shard by shard, frame by frame. Null text is
    empty and has the end id alone. Rows of one doc_id stand in the order of their texts. A table without
    rows gives a store without frames.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.repartitionByRange(shards or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    in_arrow(d, _frames(tokenizer or default_tokenizer(), end_id, frame_ids, plane_bits), FRAME_SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The frames of a store."""
    return spark.read.schema(FRAME_SCHEMA).parquet(path)


def shard_offsets(frames: DataFrame) -> DataFrame:
    """(shard, offset): ids of all shards before; from the index alone, one row per shard."""
    per = frames.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    return per.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))


def _digests(batches):
    for batch in batches:
        out: dict[str, list] = {"shard": [], "doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
        for row in batch.to_pylist():
            ids = unpack(row["payload"])
            at = 0
            if len(ids) != sum(row["lengths"]):
                raise ValueError("a frame's index and payload differ in length")
            for doc_id, n in zip(row["doc_ids"], row["lengths"]):
                out["shard"].append(row["shard"])
                out["doc_id"].append(doc_id)
                out["start"].append(row["first_id"] + at)
                out["n_tokens"].append(n)
                out["ids_crc32"].append(zlib.crc32(ids[at : at + n].tobytes()))
                at += n
        yield pa.RecordBatch.from_pydict(out, pa.schema([("shard", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32"))]))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store, from its decoded ids: doc_id, start, n_tokens, ids_crc32."""
    frames = read(spark, path)
    d = in_arrow(frames, _digests, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    d = d.join(shard_offsets(frames), "shard")
    return d.select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store: doc_id, ids (array<int>)."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"]).astype(np.int64)
                ends = np.cumsum([0, *row["lengths"]])
                lists = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return in_arrow(read(spark, path), run, "doc_id long, ids array<bigint>")


def round_trip(docs: DataFrame, tokenizer: str | None = None, plane_bits: int = 1) -> DataFrame:
    """Write a store of docs in the shared folder and read it back as `digests`."""
    path = new_path(docs.sparkSession, "ids.bitplanes")
    write(docs, path, tokenizer, plane_bits=plane_bits)
    return digests(docs.sparkSession, path)
