"""The corpus pipeline on planted cases, stage by stage and as a whole."""

import random

import corpus_pipeline
import pytest

from plumbline.llm import near_dedup, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(8)
    item, passage = prose(rng, 25), prose(rng, 60)
    texts = {i: prose(rng, 90) for i in range(12)}
    texts[20], texts[21] = texts[3], texts[3]  # exact copies
    near = texts[4].split()
    near[10] = "edited"
    texts[22] = " ".join(near)
    texts[30], texts[31] = f"{prose(rng, 70)}\n{passage}\n{prose(rng, 60)}", f"{prose(rng, 80)}\n{passage}\n{prose(rng, 90)}"
    texts[40] = f"{prose(rng, 60)} {item} {prose(rng, 60)}"
    texts[50], texts[51], texts[52] = "too short", None, "again and again " * 60
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()] + [(7, texts[7], "en", "s1", len(texts[7]))]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, passage


def test_stages(spark, planted, tmp_path):
    folder, texts, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == corpus_pipeline.COLUMNS
        made.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    ids = {name: sorted(r.doc_id for r in rows) for name, rows in kept.items()}
    clean = list(range(12))
    assert ids["quality_rules"] == sorted([*clean, 7, 20, 21, 22, 30, 31, 40])
    assert ids["near_dedup"] == [*clean, 30, 31, 40]
    text = {r.doc_id: r.text for r in kept["substring_dedup"]}
    assert all(text[i] == texts[i] for i in [*clean, 30, 40])
    before, after = texts[31].split(f"\n{passage}\n")
    assert text[31] == f"{before} {after}" and {r.doc_id: r.n_chars for r in kept["substring_dedup"]}[31] == len(text[31])
    assert ids["decontaminate"] == [*clean, 30, 31]
    assert sorted(set(ids["packing"])) == [*clean, 30, 31]


def test_run_gives_the_last_stage(spark, planted):
    got = corpus_pipeline.run(spark, planted[0]).collect()
    assert sorted({r.doc_id for r in got}) == [*range(12), 30, 31]


def test_empty_table(spark, planted, tmp_path):
    empty = spark.read.parquet(f"{planted[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, planted[0])
        assert empty.count() == 0
        if "text" not in empty.columns:
            break


def test_boilerplate_lines_leave_kept_documents(spark, tmp_path):
    rng = random.Random(9)
    footer = "All  rights reserved\tby the host"
    bodies = {k: prose(rng, 80) for k in range(30)}
    made = {k: f"{footer}\n{b}\n \n{footer.upper()}\n{b[::-1]}" for k, b in bodies.items()}
    left = {k: f"{b}\n \n{b[::-1]}" for k, b in bodies.items()}
    made[100] = left[100] = f"{prose(rng, 70)}\n\n{prose(rng, 70)}\r\n"
    rows = [(i, t, "en", "h", -1) for i, t in made.items()] + [(3, made[3], "en", "h", -1), (200, f"{footer}\n{bodies[0]}", "en", "other", -1)]
    left[200] = f"{footer}\n{bodies[0]}"
    got = corpus_pipeline.drop_low_quality(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert {r.doc_id: r.text for r in got} == left
    assert {r.doc_id: r.n_chars for r in got} == {i: -1 if i >= 100 else len(t) for i, t in left.items()}


def test_two_texts_of_one_id_are_judged_each_for_itself(spark, tmp_path):
    rng = random.Random(10)
    a, b, c = (prose(rng, 90) for _ in range(3))
    rows = [(3, b, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (7, c, "en", "s", 2), (7, c, "en", "s", 1), (None, b, "en", "s", 1)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in got), key=str) == sorted([(3, b, 1), (5, a, 1), (7, c, 1), (None, b, 1)], key=str)


def test_queries_are_named_by_operator():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


def test_shared_part_rules_out_only_what_cannot_link(spark):
    texts = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(50))), (2, " ".join(f"w{k}" for k in range(2, 52))), (3, " ".join(f"x{k}" for k in range(50)))], "node long, text string")
    open_ = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "bucket long, node long, part long")
    got = near_dedup.may_link(open_, texts, 0.8, "set")
    assert sorted(r.node for r in got.collect()) == [1, 2]
