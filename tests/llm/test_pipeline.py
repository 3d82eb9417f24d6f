import random

import corpus_pipeline as P
from attestry.llm.jaccard_join import keep_one

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(folder, spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    bad = ["vile", "awful", "nasty"]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs = {i: prose(60) for i in range(240)}
    toxic = set(range(0, 240, 6))
    for i in toxic:
        for _ in range(8):
            docs[i].insert(rng.randrange(60), rng.choice(bad))
    passage = prose(14)
    docs[301] = [*prose(20), *passage, *prose(20)]
    docs[302] = list(docs[1])
    docs[303] = [*docs[7][:-1], "changed"]
    texts = {i: " ".join(w) for i, w in docs.items()} | {304: "", 305: "12 34 !!"}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(306, None, "en", "s", 0), (5, texts[5], "en", "s", len(texts[5]))]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 240, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, toxic


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    texts, toxic = corpus(folder, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = sorted(r.doc_id for r in docs.collect())
    clean = (set(texts) | {306}) - toxic
    assert not toxic & set(kept["toxicity"]) and clean <= set(kept["toxicity"])
    assert set(kept["toxicity"]) - set(kept["language"]) == {304, 305, 306}
    assert set(kept["language"]) - set(kept["near_duplicates"]) == {302, 303} and len(set(kept["near_duplicates"])) == len(kept["near_duplicates"])
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {301}
    pieces = P.pack_sequences(spark, docs, folder).collect()
    assert {r.doc_id for r in pieces} == set(kept["decontamination"])
    assert {r.doc_id for r in P.run(spark, folder).collect()} == set(kept["decontamination"])


def test_columns_of_other_names_stay_as_they_are(spark, tmp_path):
    folder = str(tmp_path)
    corpus(folder, spark)
    more = ["score", "predicted", "held_out", "n_words", "_sid", "lang_pred", "passages", "hit_spans", "_column0", "component"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", *(f"concat('{c} ', doc_id) AS {c}" for c in more))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c} {r.doc_id}" for r in rows for c in more), name


def test_text_of_an_unknown_language_goes(spark, tmp_path):
    folder = str(tmp_path)
    corpus(folder, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    strange = spark.createDataFrame([(900, "опознать чужую письменность легко ведь буквы другие " + " ".join(f"слово{chr(1072 + k)}" for k in range(12)), None, "s", 50), (901, "".join(chr(0x4E00 + k) for k in range(60)), None, "s", 60), (902, "да", None, "s", 2)], DOCS)
    kept = {r.doc_id for r in P.drop_unknown_language(spark, docs.unionByName(strange), folder).collect()}
    assert not kept & {900, 901, 304, 305, 306} and len(kept) == 244


def test_keep_one_of_an_empty_table(spark):
    assert keep_one(spark.createDataFrame([], DOCS)).count() == 0
