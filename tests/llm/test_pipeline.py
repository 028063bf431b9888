import corpus_pipeline
from webgauge.llm import decontamination, nbsvm
from webgauge.llm.common import remainder

from . import test_jaccard, test_linededup, test_mixing


def test_equals_plain_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{tiny}/labels.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    model = nbsvm.train(docs, labels, remainder("doc_id", 5) == 0)
    rows = {r.doc_id: r for r in nbsvm.score_documents(docs, model).collect() if r.predicted}
    sources = {i: r.source for i, r in rows.items()}
    before = {i: r.text for i, r in rows.items()}
    after = test_linededup.plain(sorted(before.items()), 50)
    texts = {i: t for i, t in after.items() if t.split() or t == before[i]}
    found = test_jaccard.plain(sorted(texts.items()))
    texts = {i: texts[i] for i, _, low in found if i == low}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    leaked = {r.doc_id for r in decontamination.find_leaks(frame, benchmark).collect()}
    texts = {i: t for i, t in texts.items() if i not in leaked}
    sizes, target = test_mixing.plain([(i, t, sources[i]) for i, t in texts.items()])

    got = corpus_pipeline.run(spark, tiny).collect()
    assert {r.doc_id for r in got} <= set(texts) and len({r.doc_id for r in got}) == len(got)
    assert all(r.text == texts[r.doc_id] and r.source == sources[r.doc_id] and r.n_chars == len(r.text) and r.copies in (1, 2) for r in got)
    for source in sizes:
        own = [len(t.split()) for i, t in texts.items() if sources[i] == source]
        assert abs(sum(r.copies * len(r.text.split()) for r in got if r.source == source) - target[source]) <= max(own)


def test_stages(spark, tiny):
    assert len(corpus_pipeline.STAGES) == 5
    empty = spark.read.parquet(f"{tiny}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tiny).count() == 0
