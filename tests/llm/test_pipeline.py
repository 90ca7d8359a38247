"""corpus_pipeline.run() against brute force, stage by stage, on the smallest tables."""

import public_tokenizers

import corpus_pipeline as cp
from tests.llm import brute
from tests.llm.conftest import SF


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    d, kept = docs, []
    for _, stage in cp.STAGES[:4]:
        d = stage(spark, d, SF).checkpoint()
        assert d.columns == names
        kept.append([(r["doc_id"], r["text"]) for r in d.collect()])
    judged, single, clean, mixed = kept
    want, union = brute.jaccard(judged, 5, 80)
    groups = {}
    for i, (doc, _) in enumerate(judged):
        groups.setdefault(union.find(i) if want[i][1] else ("empty", i), []).append(doc)
    assert sorted(x for x, _ in single) == sorted(min(g) for g in groups.values())
    bad = {x[0] for x in brute.contained(single, bench)}
    assert sorted(x for x, _ in clean) == sorted(x for x, _ in single if x not in bad) and bad
    assert {x for x, _ in mixed} <= {x for x, _ in clean}
    got = sorted(tuple(r)[2:] + (r["doc_id"],) for r in cp.run(spark, SF).collect())
    tokens = brute.tokens(sorted(mixed), public_tokenizers.path("byte_bpe_50k.json"))
    assert got == sorted((n, crc, doc) for doc, _, n, crc in tokens)
