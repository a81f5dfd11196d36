"""Token ids of event contents as patched frame-of-reference blocks in files, and back.

A file row is a segment: whole contents in ascending order of id, the number of tokens before
it in its shard, and their ids in blocks. A block subtracts its minimum, packs what is left at
a width that a percentile of its values needs, and lists the values that need more as
exceptions; the byte at which each block starts is kept, so a block can be read by itself.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from vigil.llm.words import Words, byte_chunks

END = 2
BLOCK = 2048
#: Share of a block's values that the packed width must hold.
PERCENTILE = 0.9
#: A segment ends with the first content that brings it to so many tokens.
SEGMENT = 1 << 18
#: Ids that the store of known pieces holds before it is begun anew, and pieces it takes in at a time.
STORED = 1 << 22
RECENT = 1 << 16
_HEAD = struct.Struct("<IBHH")


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block: minimum, width, numbers of values and exceptions, packed bits, exceptions."""
    low = int(ids.min())
    value = (ids - np.uint32(low)).astype(np.uint32)
    width = int(np.sort(value)[int(np.ceil(percentile * len(value))) - 1]).bit_length()
    over = np.flatnonzero(value >> np.uint32(width)) if width < 32 else np.zeros(0, dtype=np.int64)
    bits = (value[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    listed = over.astype("<u2").tobytes() + value[over].astype("<u4").tobytes()
    return _HEAD.pack(low, width, len(value), len(over)) + packed + listed


def unpack_block(data: memoryview) -> np.ndarray:
    low, width, n, over = _HEAD.unpack_from(data)
    at = _HEAD.size
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    value = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32)) if width else np.zeros(n, np.uint32)
    at += size
    where = np.frombuffer(data, "<u2", over, at)
    value[where] = np.frombuffer(data, "<u4", over, at + 2 * over)
    return value + np.uint32(low)


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, bytes]:
    """(payload, starts): the blocks of a segment and where each begins, as unsigned 32-bit."""
    blocks = [pack_block(ids[i : i + block]) for i in range(0, len(ids), block)]
    starts = np.cumsum([0] + [len(b) for b in blocks[:-1]]).astype("<u4") if blocks else np.zeros(0, "<u4")
    return b"".join(blocks), starts.tobytes()


def unpack(payload: bytes, starts: bytes) -> np.ndarray:
    places = np.frombuffer(starts, "<u4")
    view = memoryview(payload)
    return np.concatenate([unpack_block(view[p:]) for p in places]) if len(places) else np.zeros(0, np.uint32)


def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letter, mark, space = (np.zeros(256, dtype=bool) for _ in range(3))
    letter[[*range(65, 91), *range(97, 123)]] = True
    mark[33:127] = True
    mark[[*range(48, 58)]] = False
    mark &= ~letter
    space[[*range(9, 14), *range(28, 33)]] = True
    return letter, mark, space


_LETTER, _MARK, _SPACE = _kinds()
#: White space beyond ASCII, in UTF-8.
_WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut so that byte-level BPE gives the same ids piece by piece.

    The library first parts a text into runs of letters, of digits, of other signs and of white
    space, a single space going with what follows it. So a text may be cut before a single
    space or around a single line break, if no other white space is next to it, and between a
    letter and a sign behind it.
    """
    n = len(data)
    begins = np.zeros(n + 1, dtype=bool)
    space = np.ones(n + 2, dtype=bool)
    space[1:-1] = _SPACE[data]
    lead = data >= 0xC2
    if (lead & (data != 0xC3)).any():
        text = data.tobytes()
        for wide in _WIDE_SPACES:
            code, at = wide.encode(), -1
            while (at := text.find(code, at + 1)) >= 0:
                space[at + 1 : at + 1 + len(code)] = True
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    alone = ~space[:-2] & ~space[2:] & ~edge[:-1] & ~edge[1:]
    blank, line = alone & (data == 0x20), alone & (data == 0x0A)
    begins[:-1] = blank | line
    begins[1:] |= line
    letter = _LETTER[data]
    latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter[1:] |= latin
    begins[1:-1] |= letter[:-1] & _MARK[data[1:]]
    begins[offsets[offsets < n]] = True
    return np.flatnonzero(begins[:-1])


class Encoder:
    """Ids of pieces, each distinct one encoded once per process as far as the store holds it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.keys = [np.zeros(0, dtype=np.uint64)] * 2
        self.at = [np.zeros((2, 0), dtype=np.int64)] * 2
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def _find(self, key: np.ndarray) -> np.ndarray:
        """(begin, length) of each key's ids in the flat store; -1 where it is not known."""
        out = np.full((2, len(key)), -1, dtype=np.int64)
        for keys, at in zip(self.keys, self.at):
            if len(keys):
                i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                known = keys[i] == key
                out[:, known] = at[:, i[known]]
        return out

    def _learn(self, key: np.ndarray, texts: list[str]) -> None:
        ids, counts = [], []
        for begin in range(0, len(texts), 4096):
            for e in self.tokenizer.encode_batch(texts[begin : begin + 4096], add_special_tokens=False):
                ids += e.ids
                counts.append(len(e.ids))
        new = np.array(ids, dtype=np.uint32)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(new)] = new
        length = np.array(counts, dtype=np.int64)
        begin = self.used + np.cumsum(length) - length
        self.used += len(new)
        keys = np.concatenate([self.keys[1], key])
        at = np.concatenate([self.at[1], [begin, length]], axis=1)
        full = len(keys) > RECENT
        if full:  # the small store goes into the large one
            keys, at = np.concatenate([self.keys[0], keys]), np.concatenate([self.at[0], at], axis=1)
        order = np.argsort(keys, kind="stable")
        self.keys[1], self.at[1] = keys[order], at[:, order]
        if full:
            self.keys, self.at = [self.keys[1], keys[:0]], [self.at[1], at[:, :0]]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, the end id behind them."""
        for _, data, offsets in byte_chunks(texts):
            start = piece_starts(data, offsets)
            raw = data.tobytes()
            for token in self.added:
                at = raw.find(token)
                while at >= 0:  # the library looks for these in whole texts: leave such a text whole
                    row = int(np.searchsorted(offsets, at, "right")) - 1
                    start = start[(start <= offsets[row]) | (start >= offsets[row + 1])]
                    at = raw.find(token, int(offsets[row + 1]))
            words = Words(0, data, offsets, start, np.append(start[1:], len(data)) if len(start) else start, np.searchsorted(start, offsets))
            key, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
            if self.used > STORED:
                self.forget()
            new = np.flatnonzero(self._find(key)[0] < 0)
            if len(new):
                where = first[new]
                self._learn(key[new], [raw[s:e].decode() for s, e in zip(words.start[where], words.end[where])])
            begin, length = self._find(key)[:, back]
            total = np.concatenate([[0], np.cumsum(length)])
            place = np.repeat(begin - total[:-1], length) + np.arange(total[-1])
            ids = np.insert(self.flat[place], total[words.first[1:]], END)
            ends = total[words.first[1:]] + np.arange(1, words.rows + 1)
            for before, end in zip(np.append(0, ends[:-1]), ends):
                yield ids[before:end]


_loaded: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _segments(path: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder = TaskContext.get().partitionId(), _encoder(path)
        before, number, held, texts = 0, 0, [], []

        def flushed() -> pa.RecordBatch:
            stream = np.concatenate(texts)
            payload, starts = pack(stream)
            ids = pa.concat_arrays(held)
            lengths = pa.array([len(t) for t in texts], pa.int64())
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            return pa.record_batch(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([before], pa.int64()),
                 one(ids), one(lengths), pa.array([starts]), pa.array([payload])],
                names=schema.names,
            ).cast(schema)

        total = 0
        for batch in batches:
            for i, ids in enumerate(encoder.encode(batch.column(1))):
                held.append(batch.column(0).slice(i, 1))
                texts.append(ids)
                total += len(ids)
                if total >= SEGMENT:
                    yield flushed()
                    before, number, held, texts, total = before + total, number + 1, [], [], 0
        if texts:
            yield flushed()

    return run


def write_tokens(mails: DataFrame, path: str, tokenizer_path: str) -> None:
    """Encodes every whole content and writes the ids, the end id 2 behind each, in order of id.

    Contents are dealt into ranges of ids, so each file holds a run of them and shards are in
    order. Null content is empty, null ids come first, rows that share an id follow each other
    by content, other columns are ignored, and no rows write no segments.
    """
    kind = mails.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()), T.StructField("segment", T.LongType()),
            T.StructField("tokens_before", T.LongType()),
            T.StructField("ids", T.ArrayType(kind)), T.StructField("n_tokens", T.ArrayType(T.LongType())),
            T.StructField("block_starts", T.BinaryType()), T.StructField("payload", T.BinaryType()),
        ]
    )
    ordered = mails.select("id", "content").repartitionByRange("id").sortWithinPartitions("id", "content")
    ordered.mapInArrow(_segments(tokenizer_path, to_arrow_schema(schema)), schema).write.option(
        "compression", "uncompressed"
    ).parquet(path)


def _contents(digest, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                stream = unpack(batch["payload"][i].as_buffer(), batch["block_starts"][i].as_buffer())
                ids, lengths = batch["ids"][i].values, batch["n_tokens"][i].values.to_numpy()
                ends = np.cumsum(lengths)
                found = [digest(stream[e - n : e]) for e, n in zip(ends, lengths)]
                yield pa.record_batch(
                    [pa.array([batch["shard"][i].as_py()] * len(ids), pa.int32()), ids,
                     pa.array(batch["tokens_before"][i].as_py() + ends - lengths), pa.array(lengths),
                     pa.array(found, schema.field("found").type)],
                    names=schema.names,
                ).cast(schema)

    return run


def read_tokens(spark: SparkSession, path: str, digest, found: T.DataType) -> DataFrame:
    """id, start, n_tokens, found: each content's place in the stream of all ids, read back.

    `digest` is applied to the array of a content's ids. Segments are decoded where they lie;
    only the tokens of whole shards, of which there are as many as files, are summed in order.
    """
    segments = spark.read.parquet(path)
    sizes = segments.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n"))
    before = Window.partitionBy(F.lit(1)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    kind = segments.schema["ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()), T.StructField("id", kind), T.StructField("place", T.LongType()),
            T.StructField("n_tokens", T.LongType()), T.StructField("found", found),
        ]
    )
    rows = segments.mapInArrow(_contents(digest, to_arrow_schema(schema)), schema)
    return rows.join(offsets, "shard").select("id", (F.col("offset") + F.col("place")).alias("start"), "n_tokens", "found")
