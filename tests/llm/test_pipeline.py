"""The pipeline against the stages done by plain means on the smallest tables."""

from collections import Counter

import pytest
from test_operators import brute_fingerprint, groups

import corpus_pipeline
from barloom.llm import decontaminate, mixing, rules


@pytest.fixture(scope="module")
def stages(spark, samples):
    docs, out = spark.read.parquet(f"{samples}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, samples))
    return [*out, docs]


def test_every_stage_decides(spark, samples, stages):
    raw, good, single, clean, mixed, placed = ([tuple(r) for r in df.collect()] for df in stages)
    for df in stages[1:5]:
        assert df.columns == stages[0].columns
    bits = {r: rules.fail_bits(rules.np.array([rules.measure(r[1].encode())]))[0] for r in raw}
    assert Counter(good) == Counter(r for r in raw if bits[r] == 0)
    fp = {r: brute_fingerprint(r[1]) for r in good}
    root = groups(set(fp.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for r in sorted(good):
        first.setdefault(root[fp[r]], r)
    assert Counter(single) == Counter(first.values())
    items = spark.read.parquet(f"{samples}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.report(stages[2], items).collect() if r.contaminated}
    assert bad and Counter(clean) == Counter(r for r in single if r[0] not in bad)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_documents(stages[3]).collect()}
    assert Counter(mixed) == Counter({r: taken[r[0]] for r in clean if taken[r[0]]})
    assert Counter(r[0] for r in placed) == Counter(r[0] for r in mixed)


def test_run_is_registered_and_reruns_agree(spark, samples):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    one, two = (Counter(tuple(r) for r in corpus_pipeline.run(spark, samples).collect()) for _ in range(2))
    assert one == two and sum(one.values()) > 0
