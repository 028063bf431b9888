import random

from webgauge.llm import linededup as L


def plain(docs, min_words):
    """For each position, the longest run that occurs at an earlier one, by comparing all pairs."""
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    flat = [(d, k, line.strip(" \t\x0b\x0c\r")) for d, (_, t) in enumerate(order) if t is not None for k, line in enumerate(t.split("\n"))]
    at = {(d, k): n for n, (d, k, _) in enumerate(flat)}
    gone = set()
    for n, (d, k, _) in enumerate(flat):
        best = 0
        for m in range(n):
            length = 0
            while n + length < len(flat) and flat[n + length][0] == d and flat[m + length][0] == flat[m][0] and flat[m + length][2] == flat[n + length][2]:
                length += 1
            best = max(best, length)
        if sum(len(flat[n + j][2].split()) for j in range(best)) >= min_words:
            gone |= {(d, k + j) for j in range(best)}
    out = {}
    for d, (doc_id, t) in enumerate(order):
        out[doc_id] = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
    assert at
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    lines = ["a b", "c", "d e f", "", " g h ", "i j k l"]
    for min_words, size in ((4, 40), (1, 12)):
        docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 25)))) for k in range(size)]
        docs += [(100, docs[3][1]), (101, docs[3][1] + "\n" + docs[4][1]), (102, None), (103, ""), (104, "\n".join(["x y z"] * 40))]
        rng.shuffle(docs)
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as removed", "8 as n")
        got = {r.doc_id: r.text for r in L.dedup_lines(df, min_words).collect()}
        assert got == plain(docs, min_words)


def test_copies_and_empty_table(spark):
    long = "\n".join(f"line {k} of a passage that many documents share today" for k in range(8))
    df = spark.createDataFrame([(2, long), (1, long), (3, "own\n" + long + "\nend"), (None, long), (3, "own\n" + long + "\nend"), (4, "short"), (5, "short")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text, r.n_removed_lines) for r in L.dedup_lines(df).collect())
    assert got == [(0, "", 8), (1, long, 0), (2, "", 8), (3, "own\nend", 8), (3, "own\nend", 8), (4, "short", 0), (5, "short", 0)]
    assert L.dedup_lines(df.limit(0)).count() == 0
