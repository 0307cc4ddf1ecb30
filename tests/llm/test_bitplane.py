import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hearthline.llm import bitplane
from hearthline.llm.segments import pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for high in (1, 2, 300, 70_000, 2**32):
        for n in (1, 7, 8, 9, 1000):
            ids = rng.integers(0, high, n, dtype=np.uint32)
            planes = bitplane.to_planes(ids, bits)
            assert np.array_equal(bitplane.from_planes(planes, n, bits), ids)
    assert len(bitplane.to_planes(np.zeros(5, np.uint32), bits)) == 1


def test_pieces_join_to_the_text():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice(["a", " ", "b", "\n", "  ", "é", "\xa0"]) for _ in range(rng.randrange(12)))
        first, rest = pieces(text)
        assert " ".join([first, *rest]) == text


@pytest.mark.parametrize("bits", [False, True])
def test_files_hold_the_library_ids_in_order(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(bitplane, "CHUNK", 64)
    monkeypatch.setattr(bitplane, "BLOCK", 50)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "thing  x", "é\n", "<|endoftext|>", "12"]) for _ in range(rng.randrange(40))) for _ in range(80)]
    rows = [(i, t, "e") for i, t in enumerate(texts)] + [(None, None, "n"), (5, "again", "r"), (5, "again", "r"), (200, "long word " * 900, "l")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(5)
    folder = f"{tmp_path}/{bits}"
    bitplane.write(df, folder, PATH, bits=bits)
    out = sorted(bitplane.read(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["id"] for r in out] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    library, at = Tokenizer.from_file(PATH), 0
    by_id = {i: t for i, t, _ in rows if i != 5}
    for r in out:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        if r["id"] != 5:
            assert ids.tolist() == library.encode(by_id[r["id"]] or "", add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        at += len(ids)
    # A range needs only the chunks that meet it.
    some = bitplane.read(spark, folder, 100, 120).collect()
    assert len(some) < len(out) and {r["start"] for r in out if r["start"] < 120 and r["start"] + r["n_tokens"] > 100} <= {r["start"] for r in some}


def test_empty_table(spark, tmp_path):
    bitplane.write(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/x", PATH)
    assert bitplane.read(spark, f"{tmp_path}/x").count() == 0
