"""Token ids as transposed planes: fixed-size blocks, one zstandard frame per byte or bit plane, and a chunk index.

Ids of documents in ascending id order form one long sequence.  It is stored in chunks of whole documents, each a
row of a Parquet table that names its documents and holds its ids in blocks; the high planes of a block are nearly
constant and vanish.  The index says where in the sequence each chunk starts, so any range of ids is found without
reading the rest.  Chunks are independent: a lost task is repeated by itself.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.segments import pieces

BLOCK = 16_384
#: Ids after which a chunk is closed; a longer document has a chunk to itself.
CHUNK = 131_072
END = 0
#: Segments remembered per Python worker: as many new ones, and as many before these.
REMEMBERED = 600_000


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Compressed planes of one block of unsigned 32-bit ids, lowest first; planes that are all zero are left out at the top."""
    block = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        planes = np.packbits(np.unpackbits(block, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        planes = np.ascontiguousarray(block.T)
    press = zstandard.ZstdCompressor(level=1)
    while len(planes) > 1 and not planes[-1].any():
        planes = planes[:-1]
    return [press.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], count: int, bits: bool = False) -> np.ndarray:
    """The ids of a block again."""
    read = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(read.decompress(p), np.uint8) for p in planes]
    if bits:
        whole = np.zeros((32, count), np.uint8)
        for i, r in enumerate(rows):
            whole[i] = np.unpackbits(r, count=count, bitorder="little")
        return np.packbits(whole.T, axis=1, bitorder="little").reshape(-1).view("<u4")
    out = np.zeros((count, 4), np.uint8)
    for i, r in enumerate(rows):
        out[:, i] = r
    return out.reshape(-1).view("<u4")


class LibraryIds:
    """Ids by the tokenizers library, which sees each distinct segment of a batch once.

    Texts are cut where no token reaches across, so the ids of the segments are those of the whole text.  For the same
    reason new segments go to the library joined by spaces, many at a time, and token lengths part the ids again.
    """

    JOINED = 2_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        names = self.library.get_vocab(with_added_tokens=True)
        # A character of a token's name stands for one byte.
        self.length = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.length[i] = len(name)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        """Ids of segments that a space precedes."""
        for low in range(0, len(new), self.JOINED):
            some = new[low : low + self.JOINED]
            ids = np.array(self.library.encode(" " + " ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.cumsum([1 + len(s.encode()) for s in some])
            cuts = [0, *(np.searchsorted(np.cumsum(self.length[ids]), ends) + 1).tolist()]
            data = ids.tobytes()
            for s, a, b in zip(some, cuts, cuts[1:]):
                self.known[s] = data[4 * a : 4 * b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [pieces(t) for t in texts]
        seen: set[str] = set()
        for _, rest in cut:
            seen.update(rest)
        if len(self.known) + len(seen) > REMEMBERED:
            self.older, self.known = self.known, {}
        new = []
        for s in seen:
            if s not in self.known:
                # What is still in use moves on, what is not is forgotten with its generation.
                found = self.older.get(s)
                if found is None:
                    new.append(s)
                else:
                    self.known[s] = found
        self._learn(new)
        starts = self.library.encode_batch_fast([first for first, _ in cut], add_special_tokens=False)
        get = self.known.__getitem__
        return [np.array(e.ids, "<u4").tobytes() + b"".join(map(get, rest)) for e, (_, rest) in zip(starts, cut)]


_LIBRARY: dict[str, LibraryIds] = {}


def _library(path: str) -> LibraryIds:
    if path not in _LIBRARY:
        _LIBRARY[path] = LibraryIds(path)
    return _LIBRARY[path]


def _schema(id_type: T.DataType) -> T.StructType:
    doc = T.StructType([T.StructField("id", id_type), T.StructField("n", T.LongType())])
    block = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("planes", T.ArrayType(T.BinaryType()))])
    return T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("seq", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("docs", T.ArrayType(doc)),
            T.StructField("blocks", T.ArrayType(block)),
        ]
    )


def _chunks(path: str, bits: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, part, seq, first = _library(path), TaskContext.get().partitionId(), 0, 0
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                coded = [x + end for x in library.encode([t.as_py() or "" for t in some.column("text")])]
                at = 0
                while at < len(coded):
                    to, total = at, 0
                    while to < len(coded) and (to == at or total < CHUNK):
                        total += len(coded[to]) // 4
                        to += 1
                    ids = np.frombuffer(b"".join(coded[at:to]), "<u4")
                    cut = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
                    docs = pa.StructArray.from_arrays([some.column("id").slice(at, to - at), pa.array([len(c) // 4 for c in coded[at:to]], pa.int64())], ["id", "n"])
                    blocks = pa.StructArray.from_arrays(
                        [pa.array([len(b) for b in cut], pa.int32()), pa.array([to_planes(b, bits) for b in cut], pa.list_(pa.binary()))], ["n", "planes"]
                    )
                    one = lambda values, kind: pa.array([values], kind)
                    whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                    yield pa.RecordBatch.from_arrays(
                        [one(part, pa.int32()), one(seq, pa.int32()), one(first, pa.int64()), one(len(ids), pa.int64()), whole(docs), whole(blocks)],
                        ["part", "seq", "first", "n_ids", "docs", "blocks"],
                    )
                    at, seq, first = to, seq + 1, first + len(ids)

    return each


def write(df: DataFrame, folder: str, path: str, id_column: str = "doc_id", text: str = "text", bits: bool = False) -> None:
    """Encode whole texts in ascending order of id (nulls first, equal ids by content) and write ``chunks`` and ``index``.

    A null text is an empty one; every document ends with id ``END``.  ``path`` is a tokenizers vocabulary file.
    """
    some = df.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    dealt = some.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(*order)
    chunks = dealt.mapInArrow(_chunks(path, bits), _schema(some.schema["id"].dataType))
    chunks.write.option("compression", "none").parquet(f"{folder}/chunks")
    spark = df.sparkSession
    stored = spark.read.parquet(f"{folder}/chunks")
    # As many rows as the table had partitions when it was written.
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    index = stored.select("part", "seq", "first", "n_ids", F.size("docs").alias("n_docs")).join(F.broadcast(base), "part")
    index.select("part", "seq", (F.col("base") + F.col("first")).alias("start"), "n_ids", "n_docs", F.lit(bits).alias("bits")).write.parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32, ids)`` of the documents in chunks that meet positions [low, high), or of all."""
    index = spark.read.parquet(f"{folder}/index")
    if low is not None:
        index = index.where(F.col("start") + F.col("n_ids") > low)
    if high is not None:
        index = index.where(F.col("start") < high)
    chunks = spark.read.parquet(f"{folder}/chunks").select("part", "seq", "docs", "blocks")
    chosen = chunks.join(index.select("part", "seq", "start", "bits"), ["part", "seq"]).select("start", "bits", "docs", "blocks")
    id_type = chunks.schema["docs"].dataType.elementType["id"].dataType
    out = T.StructType([T.StructField("id", id_type), *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")], T.StructField("ids", T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bits = batch.column("bits")[row].as_py()
                blocks = batch.column("blocks")[row].as_py()
                ids = np.concatenate([from_planes(b["planes"], b["n"], bits) for b in blocks])
                docs = batch.column("docs")[row].values
                sizes = docs.field("n").to_numpy()
                ends = np.cumsum(sizes)
                own = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
                columns = [docs.field("id"), pa.array(ends - sizes + batch.column("start")[row].as_py()), pa.array(sizes)]
                columns += [pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids_crc32", "ids"])

    return chosen.mapInArrow(each, out)
