import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hearthline.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(PATH)


def odd_texts():
    rng = random.Random(0)
    parts = ["a", "b", " ", "  ", "\n", "the", "ing", "'s", "é", "🙂", "1", "!", "\t", "<|endoftext|>", "<|", "\x1c", "\xa0", "ß", "==", "日本"]
    out = ["", "a" * 5000, "ab " * 300, "  x  y\n\n z \t\t", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", " lead", "trail "]
    out += [" " * 50 + "x", "=-" * 4000, "1" * 9000, "\r\n a\r\n", "".join(rng.choice("abcdefgh") for _ in range(30_000))]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)]


def test_same_ids_and_text_as_the_library(library, own):
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text).tolist()
        assert got == want, text[:60]
        machine = bpe.Decoder(own.vocabulary.bytes_of)
        assert machine.feed(got) + machine.close() == library.decode(want, skip_special_tokens=False)


def test_decoding_any_ids_one_at_a_time(library, own):
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(rng.randrange(20))]
        machine = bpe.Decoder(own.vocabulary.bytes_of)
        assert "".join([*(machine.feed([i]) for i in ids), machine.close()]) == library.decode(ids, skip_special_tokens=False)


def test_stable_tokens_never_change(own):
    rng = random.Random(2)
    assert 0 < own.vocabulary.lookahead < 1000
    for _ in range(150):
        letters = "abcdething"[: rng.randrange(1, 11)]
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(4000))).encode()
        step = rng.randrange(1, 200)
        assert list(own.vocabulary.stream(word[i : i + step] for i in range(0, len(word), step))) == own.vocabulary.merged(word)


def test_query_matches_the_library_on_a_table(spark, library, tmp_path):
    texts = [None, "", *odd_texts()[:40], "x"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op8_streaming_bpe(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "ab", "b")], "doc_id long, text string, ids string")
    assert sorted(len(r["ids"]) for r in bpe.with_ids(df, PATH).collect()) == [0, 1]
    assert bpe.with_text(spark.createDataFrame([(None,)], "ids array<int>"), PATH).first()["decoded"] is None
    assert bpe.with_ids(df.limit(0), PATH).count() == 0


def test_every_pre_token_goes_through_the_transducer(monkeypatch):
    machine, seen = bpe.Encoder(PATH), []
    stream = bpe.Vocabulary.stream
    monkeypatch.setattr(bpe.Vocabulary, "stream", lambda self, chunks: (seen.append(1), stream(self, chunks))[1])
    words = [f"word{i}" for i in range(500)]
    machine.encode(" ".join(words))
    assert len(seen) == sum(len(machine.pre_token.findall(" " + w)) for w in words)


def test_memory_stays_bounded_on_ever_new_words():
    machine, rng = bpe.Encoder(PATH), random.Random(3)
    machine.words.limit = 1 << 20
    new = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(n))
    for _ in range(3):
        bpe._digests(machine, new(10_000))
    tracemalloc.start()
    for _ in range(6):
        bpe._digests(machine, new(10_000))
    grown = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert machine.words.held <= machine.words.limit
    assert grown < 3 * machine.words.limit


def test_blocks_join_to_the_whole(library, own):
    rng = random.Random(4)
    parts = ["word", " ", " ", "  ", "\n", "é", "1", "<|endoftext|>", "\t", "it's", "\x1c", "\xa0"]
    text = "".join(rng.choice(parts) for _ in range(60_000)) + "z" * 70_000 + " end"
    assert len(list(own.blocks(text))) > 2
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "ab cd", "x")] * 3 + [(2, None, "y")], "doc_id long, text string, digests string")
    rows = bpe.with_digests(df, PATH).collect()
    assert len(rows) == 4 and len({tuple(r["digests"]) for r in rows if r["doc_id"] == 1}) == 1
    assert [r["digests"]["n_tokens"] for r in rows if r["doc_id"] == 2] == [0]
    assert bpe.with_digests(df.limit(0), PATH).count() == 0
