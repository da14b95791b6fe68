import random
from collections import Counter

import corpus_pipeline
from histoloom.llm import queries


def test_pipeline(spark, tmp_path):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("bdgkl") + r.choice("aeio") for _ in range(3)) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) + ("." if r.random() < 0.1 else "") for _ in range(n))
    rows = [(i, prose(120), "en", f"s{i % 3}", 1) for i in range(120)]
    rows += [(200 + i, prose(60) + " you idiot. you stupid moron", "en", "s0", 1) for i in range(10)]
    rows += [(300 + i, "BUY!! NOW!! " * 60, "en", "s1", 1) for i in range(10)]
    rows += [(400 + i, rows[i][1], "en", "s2", 1) for i in range(20)]
    rows += [(500 + i, rows[i][1].replace(" ", " odd ", 1), "en", "s2", 1) for i in range(20, 40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(200 <= i < 210)) for i in [*range(120), *range(200, 210)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, ids = queries.table(spark, folder, "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        ids.append(Counter(x.doc_id for x in docs.select("doc_id").collect()))
    base = set(range(120))
    assert set(ids[0]) == base | set(range(300, 310)) | set(range(400, 420)) | set(range(520, 540))
    assert set(ids[1]) == base | set(range(400, 420)) | set(range(520, 540))
    assert ids[2] == Counter(base)
    assert set(ids[3]) <= base and max(ids[3].values()) <= 2
    assert set(ids[4]) == set(ids[3])
    whole = Counter((r.doc_id, r.doc_tokens) for r in docs.collect() if r.start == 0)
    assert sum(whole.values()) == sum(ids[3].values())
    assert corpus_pipeline.run(spark, folder).count() == docs.count()
