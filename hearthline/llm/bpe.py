"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

Merges are applied by rank, so bytes that have not been seen yet can still change tokens near the end of what has.
How far back is bounded by the merge list alone.  Let two inputs agree up to a position.  A merge (u, v) moves the
first difference left by the length of u, and only where v begins at the difference; the merge that moved it there
before had a lower rank and a left part that lies on the left edge of v.  The longest such chain, summed over the
lengths of its left parts, is the sufficient lookahead: a token is stable, and emitted, once so many bytes follow.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.segments import SAFE, pieces

#: Fixed value: the pre-token pattern of the public byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def alphabet() -> dict[str, int]:
    """Character that stands for each byte in the vocabulary file: visible ones for themselves, others from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, ranked merges and special tokens of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        byte_of = alphabet()
        ids = said["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = [0] * 256
        for c, b in byte_of.items():
            self.byte_id[b] = ids[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(said["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        # One number for a pair, one for its rank and what it makes: quick to look up and to compare.
        self.ranked = {a << 24 | b: rank << 24 | made for (a, b), (rank, made) in self.merges.items()}
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        left_of = {made: pair[0] for pair, (_, made) in self.merges.items()}
        reach: dict[int, int] = {}
        for left, right in self.merges:  # in the order of their ranks
            far, edge = 0, right
            while edge is not None:
                far, edge = max(far, reach.get(edge, 0)), left_of.get(edge)
            reach[left] = max(reach.get(left, 0), far + len(self.bytes_of[left]))
        return max(reach.values(), default=0)

    def merged(self, data: bytes) -> list[int]:
        """Tokens of a whole byte string, merged by rank, leftmost first."""
        ids = list(map(self.byte_id.__getitem__, data))
        get, none = self.ranked.get, 1 << 60
        ranks = [get(a << 24 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best & 0xFFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 24 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 24 | ids[i + 1], none)
        return ids

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one pre-token that arrives in chunks; holds a chunk and the lookahead, not the whole."""
        held = b""
        for chunk in chunks:
            held += chunk
            stable = len(held) - self.lookahead
            if stable > 0:
                done = 0
                for token in self.merged(held):
                    end = done + len(self.bytes_of[token])
                    if end > stable:
                        break
                    yield token
                    done = end
                held = held[done:]
        yield from self.merged(held)


class Recent(dict):
    """Results of ``compute`` by argument, in bounded memory: beyond ``limit`` bytes the ones not asked for lately go."""

    ENTRY = 200

    def __init__(self, compute: Callable[[str], bytes], limit: int = 96 << 20):
        super().__init__()
        self.compute, self.limit, self.held = compute, limit, 0
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        cost = self.ENTRY + 4 * len(key) + len(value)
        if cost > self.limit >> 10:
            return value
        if self.held + cost > self.limit:
            self.older, self.held = dict(self), 0
            self.clear()
        self.held += cost
        self[key] = value
        return value


class Encoder:
    """Encodes texts as the public library does, special tokens found in a text included.

    A text is read in blocks that end where no token reaches across, and every pre-token goes through the transducer
    in chunks; what is held is one block, the transducer's window and a bounded memory of frequent words.
    """

    CHUNK, BLOCK = 256, 1 << 16

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.pre_token = regex.compile(PRE_TOKEN)
        names = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.words = Recent(self._words)

    def _word(self, word: str) -> array:
        data = word.encode()
        parts = [data[i : i + self.CHUNK] for i in range(0, len(data), self.CHUNK)]
        return array("i", self.vocabulary.stream(parts))

    def _words(self, piece: str) -> bytes:
        return b"".join(map(self._word, self.pre_token.findall(piece)))

    def _plain(self, text: str) -> bytes:
        first, rest = pieces(text)
        return self.words[first] + b"".join([self.words[" " + piece] for piece in rest])

    def blocks(self, text: str) -> Iterator[bytes]:
        """Ids of a text in order, as little-endian 32-bit integers, a block at a time."""
        done = 0
        while done < len(text):
            cut = SAFE.search(text, done + self.BLOCK)
            end = cut.start() if cut else len(text)
            yield self._block(text[done:end])
            done = end

    def _block(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, done = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[done : m.start()]), array("i", [self.vocabulary.special[m[0]]]).tobytes()]
            done = m.end()
        return b"".join([*out, self._plain(text[done:])])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        return np.frombuffer(b"".join(self.blocks(text)), "<i4")


class Decoder:
    """Incremental byte-to-text state machine: ids go in as they come, text comes out as soon as it is whole.

    Between calls it holds the bytes of one unfinished character; bytes that form none become U+FFFD.
    """

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of = bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def close(self) -> str:
        return self.state.decode(b"", True)


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def with_ids(df: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """Add the token ids of a text (null: none) by the vocabulary file at ``path``, readable on every executor."""

    @F.arrow_udf("array<int>")
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = encoder(path)
        for batch in batches:
            found = [machine.encode(t.as_py() or "") for t in batch]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate(found) if found else np.empty(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))

    return df.withColumn(name, each(F.col(text)))


def with_text(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded", block: int = 4096) -> DataFrame:
    """Add the text of token ids, special tokens included (null ids: null)."""

    @F.arrow_udf("string")
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = encoder(path).vocabulary.bytes_of
        for batch in batches:
            out = []
            for row in batch:
                machine, given = Decoder(table), row.values if row.is_valid else None
                if given is not None:
                    parts = [machine.feed(given.slice(i, block).to_pylist()) for i in range(0, len(given), block)]
                out.append(None if given is None else "".join([*parts, machine.close()]))
            yield pa.array(out, pa.string())

    return df.withColumn(name, each(F.col(ids)))


def with_digests(df: DataFrame, path: str, text: str = "text", name: str = "digests") -> DataFrame:
    """Add the number of tokens of a text and digests of its ids and of the text decoded from them.

    A struct of ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas) and ``decoded_sha256`` (UTF-8).  Ids go from
    the transducer to the decoder and both digests block by block, so neither is ever held whole.  A null text counts
    as empty; rows that repeat have equal digests; an empty table gives no rows.  A column named ``name`` is replaced.
    """

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = encoder(path)
        for batch in batches:
            columns = zip(*[_digests(machine, t.as_py() or "") for t in batch]) if len(batch) else ([], [], [])
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))]
            yield pa.StructArray.from_arrays(made, ["n_tokens", "ids_sha256", "decoded_sha256"])

    return df.withColumn(name, each(F.col(text)))


def _digests(machine: Encoder, text: str) -> tuple[int, str, str]:
    count, of_ids, of_text, back = 0, hashlib.sha256(), hashlib.sha256(), Decoder(machine.vocabulary.bytes_of)
    for block in machine.blocks(text):
        ids = np.frombuffer(block, "<i4").tolist()
        if ids:
            of_ids.update((("," if count else "") + ",".join(map(str, ids))).encode())
            of_text.update(back.feed(ids).encode())
        count += len(ids)
    of_text.update(back.close().encode())
    return count, of_ids.hexdigest(), of_text.hexdigest()
