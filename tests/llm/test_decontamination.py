import re

from pyspark.sql import functions as F

from webgauge.llm import decontamination as D

ITEMS = [
    (1, "In the market of the old town Anna Meier bought 12 apples and 7 pears for 19 coins and then gave 12 apples back to the seller."),
    (2, "The quick brown fox jumps over the lazy dog while nobody is looking at it"),
    (3, "Too short item"),
    (4, "five little words are here"),
    (5, None),
]


def leaks(spark, docs, items=ITEMS):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "2 as item_id", "3 as pos")
    return D.find_leaks(d, spark.createDataFrame(items, "item_id long, text string"))


def test_templates(spark):
    text = "In 1999 Anna Meier paid 5 kg, 3.5% and $7 for 12km. The end. Then Bob came"
    got = spark.range(1).select(D.template(D.plain_words(F.lit(text)))).first()[0]
    assert got.split(" ") == ["in", D.NUMBER, D.NAME, D.NAME, "paid", D.NUMBER, D.UNIT, D.NUMBER, "and", D.NUMBER, "for", D.NUMBER, "the", "end", "then", D.NAME, "came"]


def test_windows_by_doubling(spark):
    rows = spark.createDataFrame([(list("abcdefghij"),), (list("zbcdefghijk"),), (["a"],), ([""],)], "words array<string>")
    for width in range(1, 9):
        got = [r.hashes for r in D.with_window_hashes(rows, width).collect()]
        assert [len(h) for h in got] == [max(0, n - width + 1) for n in (10, 11, 1, 1)]
        assert got[0][1:] == got[1][1 : 11 - width]


def test_leaks(spark):
    first = ITEMS[0][1]
    other = first.replace("12", "33").replace("Anna Meier", "Paul Weber").replace("19", "80")
    mixed = first.replace("gave 12", "gave 99")
    docs = [
        (1, "some words before " + first.lower() + " and behind"),
        (2, "x y z " + other),
        (3, mixed.replace("Anna Meier", "Paul Weber")),
        (4, "quick brown fox jumps over the lazy cat"),
        (5, "so the quick brown fox!!! jumps over the lazy dog, ok"),
        (6, "here five little words are here now"),
        (7, None),
        (8, ""),
        (None, ITEMS[1][1]),
        (9, ITEMS[1][1].replace(" ", "\n\t")),
        (9, ITEMS[1][1].replace(" ", "\n\t")),
        (10, "too short item"),
    ]
    got = {(r.doc_id, r.item_id): r.verbatim for r in leaks(spark, docs).collect()}
    assert set(got) == {(2, 1), (5, 2), (6, 4), (None, 2), (9, 2), *((1, i) for d, i in got if d == 1), *((3, i) for d, i in got if d == 3)}
    assert (2, 1) in got and not got[2, 1] and got[5, 2]
    assert got[3, 1]  # 12 stands for 12 and for 99, but eleven words in a row are verbatim
    kept = D.drop_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} >= {4, 7, 8, 10} and kept.where("doc_id in (2, 3, 5, 6, 9)").count() == 0
    assert leaks(spark, docs[:0] or [(1, None)]).count() == 0
    assert D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_verbatim_windows_count_whatever_else_changed(spark):
    first = ITEMS[0][1]
    mixed = first.replace("gave 12", "gave 99")
    docs = [(1, mixed), (2, mixed.replace("Anna Meier", "Paul Weber")), (3, mixed.replace("bought 12", "bought 33").replace("Anna Meier", "Paul Weber").replace("19", "80"))]
    got = {r.doc_id: (r.n_windows, r.verbatim) for r in leaks(spark, docs).collect()}
    equal = lambda text: sum(text.split()[k : k + 8] == first.split()[k : k + 8] for k in range(len(first.split()) - 7))
    assert got == {d: (equal(text), True) for d, text in docs[:2]}  # in document 3 12 stands for 33 and for 99, and no window is verbatim


def test_other_numbers_in_items_of_few_plain_words(spark):
    items = [(1, "What is 15 percent of 240 dollars in total?"), (2, "How many eggs are 3 dozen"), (3, "Tom has 9 red pens and Eva has 4 blue pens in a box")]
    docs = [
        (1, "Well, what is 20 percent of 300 dollars in total? Sixty"),
        (2, "so how many eggs are 7 dozen then"),
        (3, "what is 20 percent of 300 dollars in a year"),  # not the whole item
        (4, "and has 5 red pens and Ida has 6 blue pencils"),  # eight words with other values, six of them plain
        (5, "what is 20 percent of"),
    ]
    assert {(r.doc_id, r.item_id, r.verbatim) for r in leaks(spark, docs, items).collect()} == {(1, 1, False), (2, 2, False)}


def test_verbatim_windows_of_numbers_and_names(spark):
    items = [(1, "Compute 12 + 34 - 56 * 78 + 90 - 11 and give the result as one whole number"), (2, "What is 12 times 1.5"), (3, "9 - 8 - 7"), (4, "- - - - - - - - - -")]
    docs = [
        (1, "so Compute 12 + 34 - 56 * 78, you"),
        (2, "so compute 12 * 34 - 56 * 78, you"),
        (3, "so compute 12 + 34 - 5.6 * 78, you"),
        (4, "or: (what is 12 times 1.5?)"),
        (5, "or what is 12 times 15"),
        (6, "it is 9 - 8 - 7 here"),
        (7, "- - - - - - - - - -"),
        (8, "x - 56 * 78 + 90 - 11 y"),
    ]
    assert {(r.doc_id, r.item_id, r.n_windows, r.verbatim) for r in leaks(spark, docs, items).collect()} == {(1, 1, 1, True), (4, 2, 1, True), (6, 3, 1, True), (8, 1, 1, True)}


def test_short_items_match_whole_texts(spark):
    items = [(1, "Who was Ada?"), (2, "2 + 2"), (3, "..."), (4, "x"), (None, "a b")]
    docs = [(1, " who was\tADA"), (2, "Who was Ada Lovelace"), (3, "2 + 2"), (4, "2 - 2"), (5, "..."), (6, "X!"), (None, "x"), (7, ""), (8, None), (9, "a, b")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert D.find_leaks(*frames).count() == 0
    got = {(r.doc_id, r.item_id, r.verbatim) for r in D.find_leaks(*frames, whole_texts=True).collect()}
    assert got == {(1, 1, True), (3, 2, True), (6, 4, True), (None, 4, True), (9, None, True)}
    assert {r.doc_id for r in D.drop_leaks(*frames, whole_texts=True).collect()} == {2, 4, 5, 7, 8}


def test_recased_copies(spark):
    items = [(1, "When did Alice meet Bob near Paris and Rome with Carl or Dora in Oslo")]
    docs = [(k, f"x {text} y") for k, text in enumerate([items[0][1], items[0][1].lower(), items[0][1].upper(), items[0][1].title()])]
    assert {(r.doc_id, r.n_windows, r.verbatim) for r in leaks(spark, docs, items).collect()} == {(k, 8, True) for k in range(4)}


def test_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: [re.sub(r"[^\w]", "", w.lower()) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    windows = {}
    for r in items.collect():
        w = plain(r.text)
        for k in range(len(w) - 7):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(r.item_id)
    want = {(r.doc_id, i) for r in docs.collect() for w in [plain(r.text)] for k in range(len(w) - 7) for i in windows.get(tuple(w[k : k + 8]), ())}
    assert want <= {(r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()}
