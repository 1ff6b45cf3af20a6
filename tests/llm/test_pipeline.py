import itertools

import corpus_pipeline
from cardloom.llm import decontaminate, near_copies, packing, toxicity


def test_stages(spark, docs, sf_dir):
    seen, table = {"documents": docs}, docs
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, sf_dir).cache()
        seen[name] = table
        if name != corpus_pipeline.STAGES[-1][0]:
            assert table.columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    rows = {n: [(r.doc_id, r.text) for r in t.collect()] for n, t in seen.items() if n != "best_fit_packing"}

    scored = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert sorted(d for d, _ in rows["toxicity"]) == sorted(d for d, _ in rows["documents"] if not scored[d])
    last = {}
    for d, t in rows["toxicity"]:
        last[t] = max(d, last.get(t, -1))
    assert sorted(d for d, _ in rows["exact_dedup"]) == sorted(last.values())
    before = sorted((d, near_copies.shingles(t or "")) for d, t in rows["exact_dedup"])
    root = {d: d for d, _ in before}
    for (x, a), (y, b) in itertools.combinations(before, 2):
        if root[x] != root[y] and near_copies.jaccard(a, b) >= 0.8:  # five words, as the task has it for stages
            old, new = max(root[x], root[y]), min(root[x], root[y])
            root = {k: new if v == old else v for k, v in root.items()}
    assert sorted(d for d, _ in rows["simhash_near_dedup"]) == sorted(set(root.values())) and len(set(root.values())) < len(root)
    bad = {r.doc_id for r in decontaminate.contaminated(seen["simhash_near_dedup"], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert sorted(d for d, _ in rows["benchmark_decontamination"]) == sorted(d for d, _ in rows["simhash_near_dedup"] if d not in bad)
    packed = seen["best_fit_packing"]
    assert {r.doc_id for r in packed.collect()} == {d for d, _ in rows["benchmark_decontamination"]}
    used, bound = packing.certificate(packed)
    assert bound <= used <= bound + 1


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
