"""Each stage of the pipeline against a brute-force version, on its own input."""

import corpus_pipeline
import pytest
from tests.llm.test_documents import base, components, fingerprint, measures
from tests.llm.test_tokens import check_packed, pieces_of, plain

from sealframe.llm import quality


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "redaction", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = kept, stage(spark, docs, small).cache()
        if name != "best_fit_packing":
            assert docs.columns == columns
            kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality_rules":
            hosts = quality.rejected_hosts(quality.with_rules(spark.read.parquet(f"{small}/documents.parquet")), "source").count()
            assert hosts == 0 and kept == {d: t for d, t in before.items() if not measures(t)[-1]}
        elif name == "near_duplicates":
            assert kept == {d: before[d] for d, _, c in components([(d, fingerprint(t)) for d, t in before.items()]) if d == c}
        elif name == "decontamination":
            assert kept == {d: t for d, t in before.items() if not any(" ".join(b.lower().split()) in " ".join(t.lower().split()) for b in bench.values())}
        elif name == "redaction":
            assert kept.keys() == before.keys()
            assert all(kept[d] == t if not base(t) and kept[d] == t else "[" in kept[d] for d, t in before.items())
            assert not any(base(t) for t in kept.values())
        else:
            rows = docs.collect()
            assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == set(pieces_of(kept.items(), plain("leading_space")))
            check_packed(rows)



def test_stages_take_odd_rows(spark, odd, nothing, small):
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            assert out.count() <= max(odd.count() * 40, 1), name
            if name != "best_fit_packing":
                assert out.columns == docs.columns


@pytest.mark.parametrize("name", ["pipeline"])
def test_run_is_registered(spark, small, name):
    import __spark_entry__

    assert __spark_entry__.queries()[name](spark, small).count() > 0
