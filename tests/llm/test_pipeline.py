"""The stages of the pipeline on planted rows against plain forms."""

import random
from collections import Counter

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, source string, n_chars long, key int, _kept string, score double, start int"


def test_stages_keep_what_they_should_with_every_column(spark, tmp_path):
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    passage, same = words(60), words(120)
    texts = {i: words(80) + ("\nyou blorgish thing." if i < 20 else "") for i in range(60)}
    texts |= {60: None, 61: "", 62: same, 63: same, 64: f"{words(40)} {passage}", 65: f"{passage} {words(40)}"}
    rows = [(i, t, "ab"[i % 2], len(t or ""), i, f"k{i}", i / 4, -i) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(i, int(i < 20)) for i in range(60)], "doc_id long, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    own = {r[0]: r for r in rows}

    clean = cp.harmless(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert sorted(map(tuple, clean.collect())) == sorted(r for r in rows if r[0] >= 20)

    some = docs.where("doc_id >= 56")
    single = cp.once(spark, some, "").collect()
    assert {r.doc_id for r in single} >= set(range(56, 66)) - {60, 61, 63} and 63 not in {r.doc_id for r in single}
    assert all(tuple(r) == own[r.doc_id] for r in single)

    less = {r.doc_id: r for r in cp.unrepeated(spark, docs.where("doc_id in (56, 60, 61, 64, 65)"), "").collect()}
    assert set(less) == {56, 60, 61, 64, 65}
    left = " ".join(texts[65].split()[60:])
    assert tuple(less[65]) == (65, left, "b", len(left), *own[65][4:])
    assert all(tuple(less[i]) == own[i] for i in (56, 60, 61, 64))

    mix = cp.weighed(spark, some, "").collect()
    assert mix and all(tuple(r) == own[r.doc_id] for r in mix)
    assert max(Counter(r.doc_id for r in mix).values()) <= 3

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    pieces, tokens = cp.run(spark, str(tmp_path)).collect(), Counter()
    for r in pieces:
        tokens[r.doc_id] += r.length
    copies = {r.doc_id: r.doc_tokens for r in pieces}
    assert set(tokens) <= set(texts) - set(range(20)) - {63} and len(tokens) > 30
    assert all(tokens[i] in (n, 2 * n, 3 * n) for i, n in copies.items())


def test_removing_repeats_shuffles_no_plain_text_and_keeps_rows_of_one_id_apart(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    passage = words(60)
    tails = ["\t left  as\nit was ", words(7), words(9), None, ""]
    rows = [(1, f"{tails[0]}{passage}", "a", 5, {"k": [1]}), (2, f"{passage} {tails[1]}", None, 6, None),
            (2, f"{passage} {tails[2]}", "b", 7, {}), (3, None, "c", 0, {"k": None}), (4, "", "c", 0, {"m": [None, 2]}),
            (5, " \n", "c", 2, {}), (None, f" {passage}  x", "d", None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, n_chars long, more map<string,array<int>>")
    got = cp.unrepeated(spark, docs, "")
    assert got.dtypes == docs.dtypes
    wanted = [(i, t, s, n, m) for i, t, s, n, m in rows if i != 2]
    wanted += [(2, tails[1], None, len(tails[1]), None), (2, tails[2], "b", len(tails[2]), {})]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = cp.unrepeated(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line]
    assert len(shuffled) == 2, "passages and what others take from them; not the documents once more"
