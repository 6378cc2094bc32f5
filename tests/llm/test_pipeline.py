import zlib

import numpy as np

import corpus_pipeline
from veilmatch.llm.op1 import tokenizer_path
from veilmatch.llm.packing import ChunkEncoder


def write(spark, path, rows, schema, name):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def corpus():
    """Clean, toxic, copied, contaminated and secret-bearing documents with known fates."""
    docs, labels, fate = [], [], {}
    for i in range(200):
        words = [f"w{(i * 7919 + k * 104729) % 5003}" for k in range(60)]
        fate[i] = "stays"
        if i % 5 == 0:
            words[10:10] = ["blargh", "snorkish"]
            fate[i] = "goes"
        labels.append((i, 1, int(i % 5 == 0)))
        docs.append([i, " ".join(words)])
    for i, source in ((200, 1), (201, 1), (202, 2)):
        words = docs[source][1].split()
        if i != 201:
            words[-1] = f"edit{i}"
        docs.append([i, " ".join(words)])
        fate[i] = "goes"
    bench = [(0, "one two three four five six seven eight nine ten eleven"), (1, "alpha beta gamma")]
    docs[3][1] += " " + bench[0][1]
    docs[4][1] += " ALPHA, beta gamma."
    fate[3] = fate[4] = "goes"
    docs[6][1] += " password: hunter2hunter"
    docs += [[300, None], [301, ""]]
    fate |= {300: "stays", 301: "stays"}
    return docs, labels, bench, fate


def test_run_like_brute_force(spark, tmp_path):
    docs, labels, bench, fate = corpus()
    path = str(tmp_path)
    write(spark, path, [(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    write(spark, path, labels, "doc_id long, quality int, toxic int", "labels")
    write(spark, path, bench, "item_id long, text string", "benchmark")
    rows = corpus_pipeline.run(spark, path).collect()
    stay = {i for i, f in fate.items() if f == "stays"}
    assert {r["doc_id"] for r in rows} == stay
    texts = dict(docs)
    texts[6] = texts[6].replace("password: hunter2hunter", "[REDACTED:assign]")
    enc = ChunkEncoder(tokenizer_path())
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for i in stay:
        want = np.append(enc.encode([(texts[i] or "").encode()])[0], 1).astype("<u4").tobytes()
        assert zlib.crc32(b"".join(x for _, x in sorted(pieces[i]))) == zlib.crc32(want)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs, labels, bench, _ = corpus()
    path = str(tmp_path)
    write(spark, path, labels, "doc_id long, quality int, toxic int", "labels")
    write(spark, path, bench, "item_id long, text string", "benchmark")
    df = spark.createDataFrame([(i, t, "x", len(t or "")) for i, t in docs], "doc_id long, text string, score string, n_chars long")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "secrets", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, path).columns == df.columns
        assert stage(spark, df.limit(0), path).count() == 0
