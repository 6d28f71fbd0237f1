from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")
def test_stages_agree_with_the_operators(spark, tmp_path):
    from dossier.llm import decontamination, near_dedup

    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs, seen = source, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        seen[name] = docs
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "bpe" or docs.columns == source.columns
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    kept = {r.doc_id for r in near_dedup.near_duplicates(seen["near_dedup"], size=5, percent=80).collect() if r.kept}
    assert {r.doc_id for r in read("near_dedup").collect()} == kept
    dirty = {r.doc_id for r in decontamination.find_overlaps(seen["decontamination"], spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect() if r.contaminated}
    assert {r.doc_id for r in read("decontamination").collect()} == kept - dirty and dirty
    assert all(r.n_chars == len(r.text) for r in read("line_dedup").collect())
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.ids_sha256) for r in docs.collect())
    assert {r.doc_id for r in whole.collect()} == kept - dirty


def test_near_copies_go_by_id_and_text(spark):
    copied, clean = " ".join(f"word{k}" for k in range(80)), " ".join(f"other{k}" for k in range(80))
    rows = [(1, copied), (5, copied + " end"), (5, clean), (5, None), (None, copied), (None, copied), (7, clean), (8, copied)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(out, key=str) == sorted([rows[k] for k in (0, 2, 3, 4, 5)], key=str)


def test_what_the_planner_expects_of_a_stage_stays_small(spark):
    def most(plan):
        below = [most(plan.children().apply(k)) for k in range(plan.children().size())]
        return max([plan.stats().sizeInBytes().bit_length(), *below])

    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[k : k + 100])) for k in range(0, 200, 5)]  # each text is near its neighbours only: one group, many steps
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert most(out._jdf.queryExecution().optimizedPlan()) < 2_000
    assert [r.doc_id for r in out.select("doc_id").collect()] == [0]
