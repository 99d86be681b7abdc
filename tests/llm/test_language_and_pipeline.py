"""Held-out accuracy of language ID, and the pipeline's stages against what they promise."""

import zlib

import pytest
from cases import SCHEMA, empty, odd, prose

from gitstrata.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]
    assert got.score.between(0, 1).all()


def test_language_rules_for_odd_rows(spark):
    got = langid.identify(odd(spark)).collect()
    assert len(got) == 10
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (1, 2, 3, 8))
    assert by[6].lang_pred == "en" and by[7].lang_pred in ("en", "fr")
    assert langid.identify(empty(spark)).count() == 0


def test_labels_are_no_inputs_of_a_prediction(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, table = langid.learn(docs)
    a = langid.predict(docs.selectExpr("doc_id", "text"), names, table, [docs["doc_id"]]).orderBy("doc_id").collect()
    other = docs.selectExpr("doc_id", "text", "'xx' as lang", "'y' as source")
    b = langid.predict(other, names, table, [other["doc_id"]]).orderBy("doc_id").collect()
    assert a == b


def test_a_text_is_judged_alone(spark):
    names, table = langid.learn(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    fill = [((table[0] >> i) & 1).mean() ** langid.PROBES for i in range(len(names))]
    letters = langid.Letters()
    known = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect()]
    texts = ["x", "this", "", "x", known[0], "th", " ", "1", *known[1:], "x", "a"]
    alone = [next(iter(langid._decide(letters, table, fill, [t]))) for t in texts]
    for order in (range(len(texts)), reversed(range(len(texts))), [4, 0, 1, 0, 5, 2]):
        order = list(order)
        got = list(langid._decide(letters, table, fill, [texts[i] for i in order]))
        assert got == [alone[i] for i in order]


def test_kept_texts_go_to_the_workers_once_and_pieces_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, table = langid.learn(docs)
    alone = langid.predict(docs, names, table, [docs["doc_id"]]).select("doc_id", "lang_pred", "score", "known")
    kept = langid.predict(docs, names, table, [docs["doc_id"], docs["text"]])
    assert kept.columns == ["doc_id", "text", "lang_pred", "score", "known"]
    assert "text_in" not in kept._jdf.queryExecution().analyzed().toString()
    assert sorted(kept.drop("text").collect()) == sorted(alone.collect())
    assert kept.join(docs, ["doc_id", "text"]).count() == docs.where("text is not null").count()
    monkeypatch.setattr(langid, "LETTERS_AT_ONCE", 500)
    texts = ["a" * 400, "b" * 400, "", "c" * 900]
    assert list(langid.batches_of(texts)) == [(0, 2), (2, 4)]


def test_copies_teach_once(spark):
    rows = [(i, f"alpha beta gamma{i}", "a") for i in range(30)] + [(100 + i, "delta epsilon zeta", "b") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = spark.createDataFrame(rows[:31], "doc_id long, text string, lang string")
    a, b = langid.learn(docs, sample=10), langid.learn(few, sample=10)
    assert a[0] == b[0] and (a[1] == b[1]).all()


@pytest.mark.parametrize("stage", [1, 2])
def test_a_repeated_row_leaves_a_stage_once(spark, stage):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, prose(1, 60)), (2, prose(2, 60)), (2, prose(2, 60)), (2, prose(3, 60)), (4, prose(4, 60)), (4, prose(4, 60))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = pipeline.STAGES[stage][1](spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(set(rows))


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).union(odd(spark).select(*pipeline.COLUMNS))
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == pipeline.COLUMNS
    assert kept["language_id"].where("text is null").count() == 0
    lines = [x for r in kept["line_dedup"].collect() for x in r.text.split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    assert kept["packing"].where("piece = 0").count() == kept["decontamination"].count()


def test_pipeline_on_an_empty_table(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = empty(spark)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
