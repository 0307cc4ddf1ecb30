import random

import public_tokenizers
from tokenizers import Tokenizer

from hearthline.llm import packing, queries


def test_query_counts_tokens_and_keeps_the_budget(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " ", "x" * 3000, "ab1!" * 4000, "日本語" * 900, "  two\n\n gaps \t"]
    texts += [" ".join("".join(rng.choice("abcdeéz7-") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(900))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    query = queries.op3_length_buckets(spark, str(tmp_path))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    pieces, got, batches = {}, dict.fromkeys(want, 0), {}
    for r in query.collect():
        got[r["doc_id"]] += r["n_tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"]))
        if r["bucket"] is not None:
            batches.setdefault((r["bucket"], r["shard"], r["batch"]), []).append(r["n_tokens"])
    assert got == want and want[3] > 1 and sum(want.values()) > packing.TOKEN_BUDGET
    # Real tokens of a batch, and of a piece.
    assert all(sum(n) <= packing.TOKEN_BUDGET and len(n) * b <= packing.TOKEN_BUDGET for (b, _, _), n in batches.items())
    assert all(n <= packing.MAX_LENGTH for p in pieces.values() for _, n in p)
    assert all([s for s, _ in sorted(p)] == [packing.MAX_LENGTH * k for k in range(len(p))] for p in pieces.values())
