import corpus_pipeline
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_near_dups import brute as near
from tests.llm.test_suffix_dedup import brute as repeats

SF = "/root/testdata/sf0.001"


def test_stages_as_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [tuple(x) for x in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted((x.doc_id, x.text) for x in docs.select("doc_id", "text").collect())
        docs = corpus_pipeline.packed.stored(stage(spark, docs, SF), "stage")
        if k < 4:
            assert docs.columns == columns
            after = dict(sorted((x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()))
        if k == 0:
            assert len(after) >= 0.95 * len(before)
        elif k == 1:
            assert sorted(after) == [i for i, _, _, kept in near(before, size=5) if kept]
        elif k == 2:
            gone = {i: n for i, _, n, _, _ in repeats(before)}
            for i, t in before:
                if not gone[i]:
                    assert after[i] == t
                else:
                    assert len(after[i].encode().replace("�".encode(), b"")) <= len(t.encode()) - gone[i]
        elif k == 3:
            assert sorted(after) == [i for i, *_, bad in contaminated(before, items) if not bad]
    assert {x.doc_id for x in docs.select("doc_id").distinct().collect()} == set(after)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_a_run_leaves_no_folder_but_its_result(spark):
    before = corpus_pipeline.packed.made()
    corpus_pipeline.run(spark, SF)
    assert len(set(corpus_pipeline.packed.made()) - set(before)) == 1
