"""The stages in a row: what each keeps follows from its operator, and the last packs all that is left."""
import corpus_pipeline
from firmlens.llm import line_quality, personal_data, simhash
from firmlens.llm.registry import table

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    documents = table(spark, SF, "documents")
    judged = {r["doc_id"]: r["kept"] for r in line_quality.judge(documents, line_quality.train(documents, table(spark, SF, "labels"))).collect()}
    one = line_quality.stage(spark, documents, SF)
    assert one.columns == documents.columns and {r["doc_id"] for r in one.collect()} == {k for k, kept in judged.items() if kept}
    two = simhash.stage(spark, one, SF)
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(one).collect()}
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(set(groups.values()))
    three = personal_data.stage(spark, two, SF)
    spans = {r["doc_id"]: r["spans"] for r in personal_data.personal_data(two).collect()}
    before = {r["doc_id"]: r["text"] for r in two.collect()}
    for r in three.collect():
        text, at = "", 0
        for x in spans[r["doc_id"]]:
            text += (before[r["doc_id"]][at:x["s"]] + f"[{x['kind']}]") if x["s"] >= at else ""
            at = max(at, x["e"])
        assert r["text"] == text + before[r["doc_id"]][at:]
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(packed.doc_id.unique()) == sorted(before) and packed.groupby("sequence_id").length.sum().max() <= 4096
