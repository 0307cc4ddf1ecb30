"""Exact repeated-substring removal by bucket-pointer refinement over sampled suffixes.

A byte is removed when a ``LENGTH``-byte string that covers it starts anywhere else too.  A suffix array of all
positions answers this, but almost every suffix is alone in its bucket.  The work is therefore laid out so that a
row stands for a run of neighbouring suffixes, and a run is refined only while it shares its bucket:

* *Bucket identifiers.*  The identifier at depth 2h of a position is mixed from its identifier at depth h and the
  one h bytes later (8, 16, 32, 64, 128); any longer string is named by the depth-128 identifiers at its start,
  middle and last offset.  No identifier is computed twice: each depth reuses the last.
* *Initial q-gram buckets.*  Every window of ``LENGTH`` bytes has one anchor, the leftmost smallest 32-gram
  identifier in it.  Equal windows have equal anchors at equal distance.  The starts that share an anchor form one
  run; its bucket is the anchor's 32-gram.
* *Refinement.*  Runs alone in their bucket are unique and leave.  Runs equal in every byte that any of their
  windows covers repeat as a whole and leave too.  Each other run is cut at fixed distances from its anchor into
  shorter runs whose buckets are the identifiers of the longer string common to their windows, until every run is
  decided; a run of one start always is.

Buckets are counted with map-side partial sums and joined back by identifier, so a bucket with a third of all
rows is neither gathered nor paired.  Identifiers of bucket and covered bytes together have 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.storage import materialize

LENGTH = 200
GRAM = 32
#: Distances of starts from their anchor: 0 to SPAN - 1.
SPAN = LENGTH - GRAM + 1
#: Starts that one pass over a text looks at; longer texts take several, overlapping passes.
CHUNK = 1 << 16
#: Lengths of the cuts of a run in each refinement round; the last decides single starts.
CUTS = (13, 1)

K1, K2, K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of a string from those of its two parts."""
    out = a * K1
    out += b * K2
    out ^= out >> np.uint64(29)
    return out


def _final(a: np.ndarray) -> np.ndarray:
    out = a * K3
    out ^= out >> np.uint64(32)
    return out * K1


def identifiers(data: np.ndarray, depth: int) -> np.ndarray:
    """Bucket identifiers at ``depth`` (a power of two, 8 at least) of all positions that have so many bytes."""
    n = len(data) - 7
    if len(data) < depth:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for k in range(8):
        part = out[k::8]
        part[:] = data[k : k + 8 * len(part)].view("<u8")
    out *= K3
    out ^= out >> np.uint64(31)
    h = 8
    while h < depth:
        out = _mix(out[:-h], out[h:])
        h *= 2
    return out


def anchors(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of valid window starts: first start, last start and anchor of each, in order."""
    firsts, lasts, places = [], [], []
    mask = np.uint64(0x1FFFF)
    for at in range(0, len(valid), CHUNK):
        count = min(CHUNK, len(valid) - at)
        order = _final(identifiers(data[at : at + count + LENGTH - 1], GRAM))
        # The position in the low bits makes the smallest leftmost among equals.
        order = (order & ~mask) | np.arange(len(order), dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            order = np.minimum(order[:-width], order[width:])
            width *= 2
        low = np.minimum(order[:count], order[SPAN - width : SPAN - width + count])
        place = (low & mask).astype(np.int64) + at
        place[~valid[at : at + count]] = -1
        edge = np.append(np.flatnonzero(np.diff(place, prepend=-2)), count)
        first = edge[:-1]
        real = place[first] >= 0
        firsts.append(first[real] + at)
        lasts.append(edge[1:][real] - 1 + at)
        places.append(place[first][real])
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (firsts, lasts, places))


def _named(deep: np.ndarray, x: np.ndarray, y: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    """Identifiers of the byte ranges [x, y), 128 to 384 long, from the depth-128 ones."""
    return _final(_mix(_mix(deep[x], deep[(x + y) // 2 - 64]), deep[y - 128]) + np.asarray(salt, np.uint64) * K2)


Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def runs(texts: list[bytes]) -> Runs:
    """Text index, packed run, bucket identifier, covered-bytes identifier and weight of each run of some texts.

    Runs that repeat inside their text are decided here: the first stays as a row of weight 2 and the others, joined
    where they touch, become rows with a bucket of their own and weight 2.  So a text of one repeated byte has few rows.
    """
    bounds = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    valid = np.zeros(max(len(data) - LENGTH + 1, 0), bool)
    for low, high in zip(bounds[:-1], bounds[1:]):
        valid[low : max(high - LENGTH + 1, low)] = True
    first, last, place = anchors(data, valid)
    if not len(first):
        return (np.empty(0, np.int64),) * 5
    owner = np.searchsorted(bounds, first, "right") - 1
    bucket, covered = (np.empty(len(first), np.uint64) for _ in range(2))
    done = 0
    while done < len(first):  # identifiers are made for a piece of the bytes at a time
        low = int(first[done])
        end = int(np.searchsorted(first, low + CHUNK))
        part = slice(done, end)
        piece = data[low : int(last[end - 1]) + LENGTH]
        gram = identifiers(piece, GRAM)
        deep = _mix(gram[:-32], gram[32:])
        deep = _mix(deep[:-64], deep[64:])
        shape = (place[part] - first[part]) * 256 + (place[part] - last[part])
        bucket[part] = _final(gram[place[part] - low])
        covered[part] = _named(deep, first[part] - low, last[part] + LENGTH - low, shape)
        done = end
    _, origin, count = np.unique(_mix(_mix(bucket, covered), owner.astype(np.uint64)), return_index=True, return_counts=True)
    weight = np.zeros(len(first), np.int64)
    weight[origin] = np.minimum(count, 2)
    start = bounds[owner]
    first, last, place = first - start, last - start, place - start
    stay, again = weight > 0, np.flatnonzero(weight == 0)
    if not len(again):
        return owner, pack(first, last, place), bucket.view(np.int64), covered.view(np.int64), weight
    apart = (first[again[1:]] != last[again[:-1]] + 1) | (owner[again[1:]] != owner[again[:-1]])
    opens = np.flatnonzero(np.append(True, apart | (np.arange(1, len(again)) % CHUNK == 0)))
    begin, end, whose = first[again[opens]], last[again[np.append(opens[1:], len(again)) - 1]], owner[again[opens]]
    own = _final(_mix(bucket[again[opens]], _mix(begin.astype(np.uint64), covered[again[opens]])))
    return (
        np.concatenate([owner[stay], whose]),
        np.concatenate([pack(first[stay], last[stay], place[stay]), pack(begin, end, end)]),
        np.concatenate([bucket[stay], own]).view(np.int64),
        np.concatenate([covered[stay], own]).view(np.int64),
        np.concatenate([weight[stay], np.full(len(begin), 2)]),
    )


def pack(first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A run in one long: first start (32 bits), starts after it (24), distance of the last to the anchor (8)."""
    return first << 32 | (last - first) << 8 | (place - last)


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and anchor of packed runs."""
    first = at >> 32
    last = first + ((at >> 8) & 0xFFFFFF)
    return first, last, last + (at & 0xFF)


def cuts(pieces: list[bytes], at: np.ndarray, length: int) -> Runs:
    """Cut runs, each given with the bytes its windows cover, at multiples of ``length`` from their anchor."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    base = np.cumsum([0, *map(len, pieces)])[:-1]
    origin = at >> 32
    first, last, place = (x - origin + base for x in unpack(at))
    low, high = (place - last) // length, (place - first) // length
    which = np.repeat(np.arange(len(at)), high - low + 1)
    step = np.arange(len(which)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1) - low, high - low + 1)
    place, near, far = place[which], step * length, np.minimum(step * length + length, SPAN) - 1
    begin, end = np.maximum(place - far, first[which]), np.minimum(place - near, last[which])
    bucket, covered = (np.empty(len(which), np.uint64) for _ in range(2))
    for block in np.unique(begin // CHUNK):
        own = np.flatnonzero(begin // CHUNK == block)
        low_byte = int(begin[own].min())
        deep = identifiers(data[low_byte : int(end[own].max()) + LENGTH], 128)
        x, y = place[own] - near[own], place[own] - far[own] + LENGTH
        bucket[own] = _named(deep, x - low_byte, y - low_byte, step[own] + 1)
        shape = (place[own] - begin[own]) * 256 + (place[own] - end[own]) + 1
        covered[own] = _named(deep, begin[own] - low_byte, end[own] + LENGTH - low_byte, shape * 65537)
    shift = (origin - base)[which]
    packed = pack(begin + shift, end + shift, place + shift)
    return which, packed, bucket.view(np.int64), covered.view(np.int64), np.ones(len(which), np.int64)


KEY = "key long, other long"
ROWS = f"{KEY}, at long, bucket long, covered long, weight long"
PIECES = f"{KEY}, at long, piece binary"


def _batch(batch: pa.RecordBatch, index: np.ndarray, columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    keys = [batch.column(k).take(pa.array(index)) for k in ("key", "other")]
    return pa.RecordBatch.from_arrays(keys + columns, ["key", "other", *names])


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about a megabyte together."""
    low = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= 1 << 20:
            yield low, i + 1
            low, total = i + 1, 0
    if low < len(sizes):
        yield low, len(sizes)


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)).tolist()
        for low, high in _groups(sizes):
            owner, *found = runs([x.as_py() or b"" for x in texts[low:high]])
            yield _batch(batch, owner + low, [pa.array(x) for x in found], ["at", "bucket", "covered", "weight"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            text = zstandard.decompress(batch.column("text")[i].as_py())
            at = batch.column("runs")[i].values.to_numpy(zero_copy_only=False)
            first, last, _ = unpack(at)
            pieces = [text[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist())]
            yield _batch(batch, np.full(len(at), i), [pa.array(at), pa.array(pieces, pa.binary())], ["at", "piece"])


def _cut_rows(length: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                which, *found = cuts(batch.column("piece").to_pylist(), batch.column("at").to_numpy(), length)
                yield _batch(batch, which, [pa.array(x) for x in found], ["at", "bucket", "covered", "weight"])

    return each


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the open parts of a run."""
    for batch in batches:
        counts = np.array([len(x) for x in batch.column("runs")], np.int64)
        at = batch.column("runs").flatten().to_numpy(zero_copy_only=False)
        which = np.repeat(np.arange(batch.num_rows), counts)
        own = unpack(batch.column("at").to_numpy())
        first, last, _ = unpack(at)
        inside = (first >= own[0][which]) & (last <= own[1][which])
        at, which = at[inside], which[inside]
        pieces, origin = batch.column("piece").to_pylist(), batch.column("at").to_numpy() >> 32
        first, last, _ = unpack(at)
        part = [pieces[w][a : b + LENGTH] for w, a, b in zip(which.tolist(), (first - origin[which]).tolist(), (last - origin[which]).tolist())]
        yield _batch(batch, which, [pa.array(at), pa.array(part, pa.binary())], ["at", "piece"])


def _judge(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs that repeat as a whole, and the runs that the next round looks at.

    Those are the runs that share their bucket without an equal, and, to be compared with them, one of each set of
    equal runs in such a bucket.  Sums per bucket are stored before they are joined back: both sides of a join then
    are plain exchanges, which adaptive execution can split where one bucket has very many rows.
    """
    run = ["key", "other", "at"]
    sums = [F.sum("weight").alias("_n"), F.min("covered").alias("_low"), F.max("covered").alias("_high")]
    buckets = rows.groupBy("bucket").agg(*sums).where("_n > 1")
    buckets = materialize(buckets.select("bucket", (F.col("_low") == F.col("_high")).alias("_same")), "buckets")
    shared = rows.join(buckets, "bucket").select(*run, "bucket", "covered", "weight", "_same")
    shared = materialize(shared, "shared")
    mixed = shared.where("not _same")
    kinds = mixed.groupBy("bucket", "covered").agg(F.sum("weight").alias("_n"), F.min(F.struct(*run)).alias("_one"))
    kinds = materialize(kinds, "kinds")
    alone, equal = kinds.where("_n = 1"), kinds.where("_n > 1")
    whole = shared.where("_same").select(*run).union(mixed.join(equal, ["bucket", "covered"]).select(*run))
    beside = equal.join(materialize(alone.select("bucket").distinct(), "open"), "bucket", "left_semi")
    return whole, alone.select("_one.*").union(beside.select("_one.*"))


def _lists(runs_of: DataFrame, by: list[str]) -> DataFrame:
    """The runs of each text; a text has as many as its own length allows."""
    return materialize(runs_of.groupBy(*by).agg(F.collect_set("at").alias("runs")), "lists")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in a shuffle are compressed better than the shuffle does by itself."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        done = pa.array([press.compress(_encoded(x)) for x in batch.column("text")], pa.binary())
        yield batch.set_column(batch.schema.get_field_index("text"), "text", done)


def _encoded(value: pa.Scalar) -> bytes:
    got = value.as_py()
    return got.encode() if isinstance(got, str) else got or b""


def repeated_starts(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, other, runs)``: packed runs of all window starts of a text whose window starts elsewhere too."""
    base = df.select(F.xxhash64(id_column, text).alias("key"), F.xxhash64(F.lit(1), text, id_column).alias("other"), F.col(text).alias("text"))
    long_enough = base.where(F.octet_length("text") >= LENGTH)
    whole, left = _judge(long_enough.mapInArrow(_run_rows, ROWS))
    packed = long_enough.mapInArrow(_packed, f"{KEY}, text binary")
    pieces = packed.join(_lists(left, ["key", "other"]), ["key", "other"]).select("key", "other", "text", "runs")
    pieces = materialize(pieces.mapInArrow(_pieces, PIECES), "pieces")
    found = [whole]
    for i, length in enumerate(CUTS):
        done, left = _judge(pieces.mapInArrow(_cut_rows(length), ROWS))
        found.append(done)
        if i + 1 < len(CUTS):
            anchor = ["key", "other", "place"]
            parts = pieces.withColumn("place", _place()).join(_lists(left.withColumn("place", _place()), anchor), anchor)
            pieces = materialize(parts.select("key", "other", "at", "piece", "runs").mapInArrow(_cut_pieces, PIECES), "pieces")
    return reduce(DataFrame.union, found)


def _place() -> F.Column:
    """Anchor of a packed run."""
    return F.expr("shiftright(at, 32) + (shiftright(at, 8) & 16777215) + (at & 255)")


def spans_of(at: np.ndarray) -> np.ndarray:
    """Maximal byte ranges covered by the windows that start in some packed runs: rows of start and end."""
    first, last, _ = unpack(np.sort(at))
    if not len(first):
        return np.empty((0, 2), np.int64)
    reach = np.maximum.accumulate(last) + LENGTH
    opens = np.flatnonzero(np.append(True, first[1:] > reach[:-1]))
    return np.stack([first[opens], reach[np.append(opens[1:], len(first)) - 1]], 1)


def _inward(text: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans shrunk to whole UTF-8 characters."""
    inside = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    out = []
    for a, b in spans.tolist():
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def _removed(characters: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x.as_buffer() or b"") * 4 for x in batch.column("text")]
            for low, high in _groups(sizes):
                kept, spans, lengths = [], [], []
                for i in range(low, high):
                    text = zstandard.decompress(batch.column("text")[i].as_py())
                    runs_here = batch.column("runs")[i]
                    found = spans_of(runs_here.values.to_numpy(zero_copy_only=False) if runs_here.is_valid else np.empty(0, np.int64))
                    found = _inward(text, found) if characters else found
                    edges = [0, *found.ravel().tolist(), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    spans.append([{"start": a, "end": b} for a, b in found.tolist()])
                    lengths.append(len(text))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                columns = [batch.column("row").slice(low, high - low), pa.array(lengths, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "n_bytes", "spans", "kept"])

    return each


def without_repeats(df: DataFrame, id_column: str = "doc_id", text: str = "text", characters: bool = False) -> DataFrame:
    """Remove every byte covered by a ``LENGTH``-byte string that also starts anywhere else.

    All columns but ``text`` come back, with ``n_bytes``, ``spans`` (removed byte ranges, end exclusive, maximal)
    and ``kept`` (the remaining bytes); input columns of these names are replaced.  With ``characters`` a removed
    range is shrunk to whole characters, so that what stays is valid text.  Null and empty texts, and those shorter
    than ``LENGTH``, lose nothing (null: zero bytes).  Equal rows are repeats of each other; ids may be null or equal.
    """
    lists = _lists(repeated_starts(df, id_column, text), ["key", "other"])
    row = F.struct(*[F.col(c) for c in df.columns if c not in (text, "n_bytes", "spans", "kept")]).alias("row")
    base = df.select(F.xxhash64(id_column, text).alias("key"), F.xxhash64(F.lit(1), text, id_column).alias("other"), F.col(text).alias("text"), row)
    schema = T.StructType([base.schema["key"], base.schema["other"], T.StructField("text", T.BinaryType()), base.schema["row"]])
    joined = base.mapInArrow(_packed, schema).join(lists, ["key", "other"], "left").select("text", "row", "runs")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([base.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    return joined.mapInArrow(_removed(characters), out).select("row.*", "n_bytes", "spans", "kept")
