import random
import re

from webgauge.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    ids = {}
    for k, (doc_id, _) in enumerate(rows):
        ids.setdefault(top(k), []).append(doc_id)
    low = {root: min((i for i in found if i is not None), default=None) for root, found in ids.items()}
    return [(rows[k][0], len(sets[k]), low[top(k)]) for k in range(len(rows))]


def documents(rng):
    words = [f"w{k}" for k in range(400)]
    shared = [rng.choice(words) for _ in range(60)]
    rows = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        if rng.random() < 0.5:
            base = base[:20] + shared + base[20:]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy).upper() if rng.random() < 0.1 else "\t".join(copy))
    crowd = [rng.choice(words) for _ in range(80)]
    for _ in range(60):  # each near some of the others only
        copy = list(crowd)
        for _ in range(3):
            copy[rng.randrange(80)] = rng.choice(words)
        rows.append(" ".join(copy))
    rows += [None, "", " \n", "one", "one", "one two", "É é", "é é"]
    rng.shuffle(rows)
    return [(k, t) for k, t in enumerate(rows)]


def test_equals_brute_force(spark):
    sizes = jaccard.CHUNK, jaccard.BLOCK, jaccard.SLICE, jaccard.PAIR_SLICE
    rng = random.Random(11)
    try:
        for chunk, block, size in ((128, 512, 2_000_000), (4, 8, 900)):
            jaccard.CHUNK, jaccard.BLOCK, jaccard.SLICE, jaccard.PAIR_SLICE = chunk, block, size, size
            rows = documents(rng)
            rows += [(None, rows[0][1]), rows[1], (None, "lonely words without any number")]
            df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 as key", "2 as id", "3 as n")
            got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect()), key=str)
            assert got == sorted(plain(rows), key=str)
    finally:
        jaccard.CHUNK, jaccard.BLOCK, jaccard.SLICE, jaccard.PAIR_SLICE = sizes
    assert jaccard.similar_documents(df.limit(0)).count() == 0


def test_keep_one(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x"), (5, ""), (6, None), (None, "q r s"), (None, "q r s")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as root")
    got = sorted(((r.doc_id, r.text) for r in jaccard.keep_one_of_each(df).collect()), key=str)
    assert got == sorted([(1, "a b c d e f"), (2, "x"), (5, ""), (6, None), (None, "q r s")], key=str)


def test_prefix_bound():
    for n in range(1, 400):
        first, long = jaccard.prefix_lengths(n)
        assert first == n // 4 + 1 and long >= first or n < 3
