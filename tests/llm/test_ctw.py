import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from webgauge.llm import ctw
from webgauge.llm.common import remainder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Tree:
    """Context-tree weighting with one node object for each context, as in the paper."""

    def __init__(self, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])

    def steps(self, text):
        data = bytes([ctw.START]) * self.depth + text.translate(FOLD).encode() + bytes([ctw.END])
        for t in range(self.depth, len(data)):
            context = data[t - self.depth : t][::-1]
            j = 1
            for i in range(7, -1, -1):
                bit = data[t] >> i & 1
                yield j, context, bit
                j = 2 * j + bit

    def learn(self, text):
        for j, context, bit in self.steps(text):
            for d in range(self.depth + 1):
                self.counts[j, context[:d]][bit] += 1

    def weigh(self):
        kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        self.own = {k: kt(*c) for k, c in self.counts.items()}
        self.log = {}
        below = defaultdict(float)
        for d in range(self.depth, -1, -1):
            for (j, s), own in self.own.items():
                if len(s) == d:
                    self.log[j, s] = own if d == self.depth else math.log(0.5) + max(own, below[j, s]) + math.log1p(math.exp(-abs(own - below[j, s])))
                    if d:
                        below[j, s[:-1]] += self.log[j, s]

    def score(self, text):
        total = 0.0
        for j, context, bit in self.steps(text):
            p = 0.5
            for d in range(self.depth, -1, -1):
                node = j, context[:d]
                if node in self.counts:
                    c = self.counts[node]
                    own = (c[1] + 0.5) / (sum(c) + 1)
                    w = 1.0 if d == self.depth else math.exp(math.log(0.5) + self.own[node] - self.log[node])
                    p = w * own + (1 - w) * p
            total += math.log10(p if bit else 1 - p)
        return total


def test_equals_plain_version(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["The", "cat", "sat", "Ünder", "a", "tree\n", f"n{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 25)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "zzz qqq 日本"), (None, "the cat"), (5, rows[5][1]), (5, rows[5][1])]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    learn = [i is not None and not h for (i, _), h in zip(rows, held, strict=True)]
    words = [[*WORD.findall((t or "").translate(FOLD)), None] for _, t in rows]
    counts = Counter(w for k, ws in enumerate(words) if learn[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as rid", "2 as score")
    small = ctw.HOT_GRAMS, ctw.HOT_WORDS, ctw.K.CHUNK
    try:
        for depth, hot, chunk in ((5, 1 << 20, 1 << 21), (3, 40, 1 << 21), (2, 8, 64)):
            ctw.HOT_GRAMS = ctw.HOT_WORDS = hot
            ctw.K.CHUNK = chunk
            tree = Tree(depth)
            for k, (_, t) in enumerate(rows):
                if learn[k]:
                    tree.learn(t or "")
            tree.weigh()
            want = []
            for k, (i, t) in enumerate(rows):
                base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words[k])
                want.append((str(i), held[k], len(words[k]), sum(w in counts for w in words[k]), n, round(base, 6), round(tree.score(t or ""), 3)))
            got = ctw.score_documents(df, remainder("doc_id", 10) == 0, depth).collect()
            got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)) for r in got]
            assert sorted(got) == sorted(want)
    finally:
        ctw.HOT_GRAMS, ctw.HOT_WORDS, ctw.K.CHUNK = small
    assert ctw.score_documents(df.limit(0), F.lit(False)).count() == 0
