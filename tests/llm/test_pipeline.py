from collections import Counter

import corpus_pipeline
from lexloom.llm import common, packing, pii, quality


def test_stages_and_run(spark, folder, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    own, now = docs, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = common.keep(stage(spark, own, folder), common.shared_dir(spark), f"s{number}")
        if number < 3:
            assert after.columns == docs.columns
        now.append(after)
        own = after
    kept, single, masked, packed = now
    rules = quality.fitted(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    judged = quality.judged(docs, rules).collect()
    assert Counter(r.doc_id for r in judged if r[quality.RESERVED].kept) == Counter(r.doc_id for r in kept.collect())
    ids = [r.doc_id for r in single.collect()]
    assert set(ids) <= {r.doc_id for r in kept.collect()} and {5} == {5, 6} & set(ids)
    assert Counter(r.doc_id for r in masked.collect()) == Counter(ids)
    assert pii.detect(masked).selectExpr(f"sum(size({pii.RESERVED}))").first()[0] in (0, None)
    assert Counter(r.doc_id for r in packed.collect() if r.piece == 0) == Counter(ids)
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == packed.columns and whole.count() == packed.count()


def test_empty_documents(spark, no_docs, folder):
    own = no_docs
    for _, stage in corpus_pipeline.STAGES:
        own = stage(spark, own, folder)
    assert own.count() == 0 and own.columns == packing.pack(no_docs).columns


def test_large_groups_of_copies_leave_one_document_each(spark, folder):
    """All stages over hundreds of exact and near copies, held to groups by brute force."""
    from .conftest import DOC_SCHEMA, body, document
    from .test_simhash import plain_fingerprint, plain_groups

    near = body(41, 600).split()
    texts = [body(40, 300)] * 400 + [" ".join([*near[:i], "changed", *near[i + 1 :]]) for i in range(0, 600, 3)] + [body(50 + i, 80) for i in range(60)]
    docs = spark.createDataFrame([document(i, t) for i, t in enumerate(texts)], DOC_SCHEMA).repartition(5)
    codes = [int(f"{plain_fingerprint(t):016x}", 16) for t in texts]
    groups = plain_groups(sorted(set(codes)))
    least: dict[int, int] = {}
    for i, c in enumerate(codes):
        least.setdefault(groups[c], i)
    own = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        own = common.keep(stage(spark, own, folder), common.shared_dir(spark), f"large{number}")
        if number == 1:
            assert sorted(r.doc_id for r in own.collect()) == sorted(least.values()) and len(least) < 100
    assert {r.doc_id for r in own.collect()} == set(least.values())
