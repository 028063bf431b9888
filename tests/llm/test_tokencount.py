import random

from webgauge.llm import tokencount as T


def greedy(word, pieces, start="▁"):
    text, at, n = start + word, 0, 0
    longest = max(map(len, pieces))
    while at < len(text):
        for end in range(min(len(text), at + longest), at, -1):
            if text[at:end] in pieces:
                at, n = end, n + 1
                break
        else:
            return 0
    return n


def test_small_vocabularies_match_greedy():
    rng = random.Random(1)
    for _ in range(300):
        alphabet = "▁abc"
        pieces = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 14))}
        if rng.random() < 0.7:
            pieces |= set("▁ab")
        matcher = T.LongestMatch(sorted(pieces))
        for _ in range(40):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            assert matcher.count(word) == greedy(word, pieces), (word, pieces)


def test_public_vocabulary_matches_greedy():
    pieces = T.load_pieces()
    known = set(pieces)
    matcher = T.LongestMatch(pieces)
    for word in ["hello", "Zählerstände", "naïve", "3.14159", "ñandú", "日本語テキスト", "\u0001", "a" * 300, "x|y", "▁"]:
        assert matcher.count(word) == greedy(word, known), word


def test_rows(spark):
    rows = [(1, "one two"), (2, None), (3, ""), (4, " \n "), (None, "one"), (1, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words")
    got = T.count_tokens(df, ["▁one", "▁t", "w", "o"]).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([(1, 2, 4, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0), (None, 1, 1, 0), (1, 2, 4, 0)], key=str)
    assert T.count_tokens(df.limit(0), ["▁a"]).count() == 0
