import random

import tokenizers

import corpus_pipeline
from hearthline.llm.packing import TOKEN_BUDGET
from hearthline.llm.queries import vocabulary
from hearthline.llm.suffix import LENGTH


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(3, 8))) for _ in range(n))


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    passage = sentence(rng, 70)
    assert len(passage) > LENGTH
    clean = {i: sentence(rng, 120) + "\n" + sentence(rng, 60) for i in range(40)}
    docs = dict(clean)
    docs[100] = " ".join(f"{w}###" for w in sentence(rng, 120).split())  # junk
    docs[101] = None
    docs[102] = clean[3]  # copy
    docs[103] = sentence(rng, 150) + " " + passage + " " + sentence(rng, 20)
    docs[104] = sentence(rng, 90) + " " + passage + " é " + sentence(rng, 90)
    docs[105] = sentence(rng, 90) + " reach a.b@c.example.org or 10.20.30.40 soon " + sentence(rng, 90)
    # Columns of the user with the names that operators give their own.
    clashing = ["quality", "kept", "spans", "pii", "document", "_text_hash", "class", "row"]
    mine = {c: f"my {c}" for c in clashing}
    rows = [(i, t, "en", "s", len(t or ""), *mine.values()) for i, t in docs.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clashing)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), schema.replace(",", "").split()[::2]
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        kept = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert kept.columns == columns
            seen.append({r["doc_id"]: r for r in kept.collect()})
            assert all({c: r[c] for c in clashing} == mine for r in seen[-1].values())
    quality, copies, passages, private = seen
    assert set(docs) - set(quality) == {100, 101}
    assert set(quality) - set(copies) == {102}
    assert set(passages) == set(copies) == set(private)
    assert all(passage not in passages[i]["text"] for i in (103, 104)) and "é" in passages[104]["text"]
    assert all(passages[i]["text"] == docs[i] for i in clean)
    assert "[EMAIL]" in private[105]["text"] and "[IP]" in private[105]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in private.values())
    packed = kept.groupBy("doc_id").sum("n_tokens").collect()
    library = tokenizers.Tokenizer.from_file(vocabulary())
    count = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    assert {r[0]: r[1] for r in packed} == {i: count(r["text"]) for i, r in private.items()}
    for r in kept.groupBy("bucket", "shard", "batch").count().collect():
        assert r["bucket"] * r["count"] <= TOKEN_BUDGET


def test_rows_without_words_and_empty_table(spark):
    schema = "doc_id long, text string, class string"
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, None, "z"), (None, "", "z")], schema)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] is None, r["class"]) for r in kept) == [(0, False, "z"), (0, True, "z"), (1, True, "x"), (2, False, "y")]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), "").collect() == []
