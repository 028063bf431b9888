import random

from webgauge.llm import mixing


def plain(rows, weights=(5, 2, 1)):
    """Water filling by repeated resharing; sizes by source."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return sizes, target


def test_targets_and_selection(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "é", "Z", None, "hot", "hot", "hot"])) for k in range(600)]
    rows += [(None, "x y", "a"), (1000, None, "b"), (1001, "", "empty"), (7, "same text", "a"), (7, "same text", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as hash", "2 as low", "3 as target")
    got = mixing.mix_report(df, bits=4).collect()
    sizes, target = plain(rows)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 30 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(df.repartition(3), bits=10).collect()))
    mixed = mixing.mix_documents(df).collect()
    assert {(r.doc_id, r.source, r.copies) for r in mixed} == {(r.doc_id, r.source, r.copies) for r in got if r.copies}
    assert mixed[0].low == 2


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_report(df).count() == 0 and mixing.mix_documents(df).count() == 0
    one = spark.createDataFrame([(1, None, "s")], "doc_id long, text string, source string")
    assert [r.target for r in mixing.mix_report(one).collect()] == [0.0]
