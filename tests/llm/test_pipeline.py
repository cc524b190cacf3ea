import random

from llm_helpers import prose

import corpus_pipeline
from quern.llm.common import staged


def folder(spark, tmp_path):
    r = random.Random(5)
    words = "idiotic vile".split()
    docs, labels, items = [], [], [(1, prose(900, 40)), (2, prose(901, 25))]
    for i in range(240):
        t = prose(i, r.randrange(40, 160))
        if i % 6 == 0:
            t += " " + words[i % 2]
        docs.append([i, t])
        if i % 2 == 0:
            labels.append((i, 1, int(i % 6 == 0)))
    for i, j in ((40, 11), (43, 11), (50, 1)):
        docs[i][1] = docs[j][1]
    near = docs[13][1].split()
    near[len(near) // 2] = "swapped"
    docs[80][1] = " ".join(near)
    docs[91][1] += " " + items[0][1].upper()
    docs.append([500, None])
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return dict(docs)


def test_stages_decide_as_brute_force_does(spark, tmp_path):
    texts = folder(spark, tmp_path)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = docs.columns, set(texts)
    gone = [{i for i in texts if i % 6 == 0 and i < 240 and i not in (40, 43, 50, 80)}, {40, 43, 50}, {80}, {91}]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]
    for (name, stage), out in zip(corpus_pipeline.STAGES, gone):
        docs = staged(stage(spark, docs, sf), "t")
        left -= out
        assert docs.columns == columns and {r.doc_id for r in docs.collect()} == left, name
        assert docs.count() == len(left)
    assert {r.doc_id: r.text for r in docs.collect()} == {i: texts[i] for i in left}
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {p.doc_id for p in pieces} == left
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def write(spark, d, docs, labels, items):
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")


def test_an_empty_folder_gives_an_empty_result(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_null_ids_repeated_rows_and_blank_texts_in_every_stage(spark, tmp_path):
    same = prose(1, 60)
    docs = [(None, prose(2, 60)), (None, prose(2, 60)), (None, None), (None, ""), (1, same), (1, same), (2, same + " more words"), (None, same), (3, None), (4, "  "), (5, prose(5, 3000))]
    write(spark, tmp_path, docs, [(1, None, None), (None, 1, 1), (2, 1, 0), (5, 0, 0)], [(None, None), (1, prose(9, 12))])
    rows, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    want = [
        docs,
        [(None, prose(2, 60)), (1, same), (2, same + " more words"), (3, None), (4, "  "), (5, prose(5, 3000))],
        [(None, prose(2, 60)), (1, same), (3, None), (4, "  "), (5, prose(5, 3000))],
    ]
    want.append(want[-1])
    for (name, stage), left in zip(corpus_pipeline.STAGES, want):
        rows = staged(stage(spark, rows, sf), "t")
        assert sorted(((r.doc_id, r.text) for r in rows.collect()), key=str) == sorted(left, key=str), name
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert sorted({str(p.doc_id) for p in pieces}) == ["1", "3", "4", "5", "None"]


def test_registered(spark):
    import __spark_entry__ as e

    q = e.queries()
    assert "pipeline" in q and all(any(n.startswith(f"op{k}_") for n in q) for k in range(1, 11))
    assert set(e.oracle_sql()) <= set(q)
