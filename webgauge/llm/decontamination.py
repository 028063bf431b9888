"""Operator 5: benchmark decontamination by templates (DataFrame functions only).

Texts are canonicalised word by word: a word that begins with a digit becomes a
number slot, a unit behind a number a unit slot, a capitalised word inside a sentence
a name slot; other words are lower-cased and lose their punctuation.  Windows of
``WIDTH`` template words of the documents are hash-joined with those of the benchmark
items (an item of 4 to 7 words is one window).  Windows of one document and item on
one diagonal form a passage.  As leaks count

* every window that is verbatim up to case and punctuation (all its slot values equal),
  whatever the rest of its passage holds; and
* the windows of a passage with other slot values, if these are consistent (each slot
  value of the item stands for one value of the document all over the passage, so a
  question with other numbers or names is caught and a chance meeting of slots is not)
  and the passage covers ``LITERALS`` words that are no slots, or, of an item whose
  windows hold fewer, all of them.

Plan: two scans of the documents, for templates and for bare words, each with the words, the
window hashes, the explode and the join to the benchmark in a stage without a shuffle while the
benchmark's windows are few enough to be broadcast (counted first, ``BROADCAST_WINDOWS``
at most; a hash join on the window otherwise).  Only matches go further.

Every window is joined by its bare words (lower-cased, without punctuation or slots) as
well and counts as verbatim if numbers and lone operators agree too: capitals decide what
is a name, so a recased copy has another template.  Windows of fewer than ``LEAST`` plain
words are joined in this way only, being no evidence with other slot values.

Edge cases: null and empty texts have no windows; items of fewer than ``LEAST`` words do
not take part, or with ``whole_texts`` (as in the query) are matched by documents that consist of them
alone (within a text such a run stands by chance); windows with fewer words and operators together do not take part; null ids take
part; rows repeated in full are reported once by ``find_leaks`` and removed alike by
``drop_leaks``; empty tables give no leaks; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, row_key

WIDTH = 8
LEAST = 4  # plain words that a window needs
LITERALS = 8
BROADCAST_WINDOWS = 500_000
UNITS = "mm|cm|dm|m|km|in|ft|yd|mi|mg|g|kg|t|lb|oz|ml|cl|l|gal|s|sec|min|h|hr|hours?|days?|weeks?|months?|years?|hz|khz|mhz|ghz|w|kw|v|a|k|c|f|pa|bar|kb|mb|gb|tb|mph|kmh|eur|usd|gbp|euros?|dollars?|cents?|percent|degrees?|meters?|metres?|miles?|grams?|kilograms?|litres?|liters?"
OPERATOR = "^[^\\p{L}\\p{N}]*[-+*/=<>^%\u00d7\u00f7\u2212][^\\p{L}\\p{N}]*$"  # a word that is an operator
NUMBER, UNIT, NAME = "\u0001n", "\u0001u", "\u0001p"

_NAME = (
    "\\p{Lu}(?<!(?:^|[.!?][^\\p{L}\\p{N} ]{0,6} )[\"'(\\[]{0,2}\\p{Lu})"  # not first in its sentence
    "\\p{Ll}+(?=[^\\p{L}\\p{N}]|$)(?<=(?:^|[ \"'(\\[-])\\p{Lu}\\p{Ll}{1,60})"
)
_NUMBER = "(?<=^| )[^\\p{L}\\p{N} ]{0,6}[0-9][^ ]*"
_UNIT = f"(?i){NUMBER} (?:{UNITS})(?=[^\\p{{L}}\\p{{N}} ]*(?: |$))"


def plain_words(text: Column) -> Column:
    """The text with one space between words."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "))


def template(spaced: Column) -> Column:
    """Template words, joined like the words of ``plain_words``."""
    named = F.regexp_replace(spaced, _NAME, NAME)
    numbered = F.regexp_replace(named, _NUMBER, NUMBER)
    united = F.regexp_replace(numbered, _UNIT, f"{NUMBER} {UNIT}")
    return F.regexp_replace(F.lower(united), "[^\\p{L}\\p{N}\u0001 ]+", "")


def with_window_hashes(rows: DataFrame, width: int, of: str = "words") -> DataFrame:
    """rows with ``hashes``, of all runs of ``width`` (1 to 8) of the words in ``of``, by doubling.

    Each doubling is a column of its own, which is used twice, so that it is computed once.
    """
    others = rows.columns
    pair = lambda a, b: F.xxhash64(a, b)
    ahead = lambda name, n: F.slice(name, n + 1, F.greatest(F.size(name), F.lit(1)))
    rows = rows.withColumn("h1", F.transform(of, lambda w: F.xxhash64(w)))
    have = 1
    while 2 * have <= width:
        rows = rows.withColumn(f"h{2 * have}", F.zip_with(f"h{have}", ahead(f"h{have}", have), pair))
        have *= 2
    hashes = F.col(f"h{have}")
    for n in (4, 2, 1):
        if have + n <= width:
            hashes = F.zip_with(hashes, ahead(f"h{n}", have), pair)
            have += n
    return rows.select(*others, F.slice(hashes, 1, F.greatest(F.size(of) - (width - 1), F.lit(0))).alias("hashes"))


def _windows(rows: DataFrame, width: int, keep: list[str], of: str) -> DataFrame:
    """keep columns, raw, template and bare words of the text, and pos and hash of each window of its words ``of``.

    The outer explode gives a text without windows a row with a null hash, which joins
    with nothing; the inner one would compute all hashes a second time, to filter by them.
    """
    spaced = rows.select(*keep, plain_words(F.col("text")).alias("spaced"))
    bare = F.regexp_replace(F.lower("spaced"), "[^\\p{L}\\p{N} ]+", "")
    split = spaced.select(*keep, F.split("spaced", " ").alias("raw"), F.split(template(F.col("spaced")), " ").alias("words"), F.split(bare, " ").alias("bare"))
    return with_window_hashes(split, width, of).select(*keep, "raw", "words", "bare", F.posexplode_outer("hashes").alias("pos", "hash"))


def _slot(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}%]+$", ""))


def _exact(word: Column) -> Column:
    """What two words with the same letters and digits must have alike: numbers their inner punctuation, lone operators all."""
    return F.when(word.rlike("[0-9]"), _slot(word)).when(word.rlike(OPERATOR), word).otherwise("")


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, literals: int = LITERALS, whole_texts: bool = False) -> DataFrame:
    """(key, doc_id, item_id, n_windows, n_item_windows, verbatim) of documents that hold a passage of an item."""
    items = benchmark.select("item_id", F.col("text").alias("text"))
    sizes = items.select(F.size(F.split(plain_words(F.col("text")), " ")).alias("n")).where(F.col("n") >= LEAST)
    lengths = sorted(r[0] for r in sizes.select(F.least("n", F.lit(width)).alias("n")).distinct().collect())  # width - 3 values at most
    rows = docs.select(row_key("doc_id", "text").alias("key"), "doc_id", "text")
    found = [_matches(rows, items, n, n if n < width else 0, of) for n in lengths for of in ("words", "bare")]
    short = _whole_texts(rows, items if whole_texts else items.limit(0))
    if not found:
        return short
    matches = found[0]
    for more in found[1:]:
        matches = matches.union(more)
    passage = ["key", "doc_id", "item_id", "shift", "of"]
    best = F.max(F.struct("same", "plain", "slots", "most")).alias("best")
    matches = materialize(matches.groupBy(*passage, "item_pos").agg(best).select(*passage, "item_pos", "best.*").where("same is not null"))
    slots = matches.where(F.size("slots") > 0).select(*passage, F.explode("slots").alias("slot"))
    values = slots.groupBy(*passage, F.col("slot.theirs").alias("theirs")).agg(F.min("slot.ours").alias("low"), F.max("slot.ours").alias("high"))
    judged = values.groupBy(*passage).agg(F.bool_and(F.col("low") == F.col("high")).alias("consistent"))
    covered = matches.select(*passage, "item_pos", "same", "most", F.explode_outer("plain").alias("word"))
    spots = lambda same: F.countDistinct(F.when(F.col("same") == F.lit(same), F.col("item_pos")))
    passages = covered.groupBy(*passage).agg(spots(True).alias("verbatim"), spots(False).alias("changed"), F.countDistinct("word").alias("literals"), F.max("most").alias("most"))
    alike = [F.col(f"p.{c}").eqNullSafe(F.col(f"j.{c}")) for c in passage]
    both = passages.alias("p").join(judged.alias("j"), alike, "left").select("p.*", F.coalesce("consistent", F.lit(True)).alias("consistent"))
    counts = F.col("consistent") & (F.col("literals") >= F.least(F.lit(literals), "most"))
    good = both.withColumn("windows", F.col("verbatim") + F.when(counts, F.col("changed")).otherwise(0)).where("windows > 0")
    leaks = good.groupBy("key", "doc_id", "item_id").agg(F.sum("windows").alias("n_windows"), F.max("of").cast("long").alias("n_item_windows"), F.bool_or(F.col("verbatim") > 0).alias("verbatim"))
    return leaks.union(short)


def _whole_texts(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Documents whose whole text is that of an item of fewer than LEAST words, case and punctuation aside."""
    spaced = plain_words(F.col("text"))
    said = F.transform(F.split(spaced, " "), lambda w: F.when(w.rlike("[\\p{L}\\p{N}]"), F.when(w.rlike("[0-9]"), _slot(w)).otherwise(F.regexp_replace(F.lower(w), "[^\\p{L}\\p{N}]+", ""))).otherwise(w))
    whole = lambda table, *keep: table.where((F.size(F.split(spaced, " ")) < LEAST) & spaced.rlike("[\\p{L}\\p{N}]")).select(*keep, F.array_join(said, " ").alias("said"))
    found = whole(rows, "key", "doc_id").join(whole(items, "item_id"), "said").select("key", "doc_id", "item_id").distinct()
    return found.select("key", "doc_id", "item_id", F.lit(1).cast("long").alias("n_windows"), F.lit(1).cast("long").alias("n_item_windows"), F.lit(True).alias("verbatim"))


def _matches(rows: DataFrame, items: DataFrame, width: int, exactly: int, of: str) -> DataFrame:
    """Windows of documents that equal a window of an item in their words ``of``; ``exactly``: only items of so many words.

    ``same`` says whether a window is verbatim; it is null if the window does not count.
    """
    theirs = _windows(items, width, ["item_id"], of)
    theirs = theirs.where(F.col("hash").isNotNull())
    theirs = theirs.where(F.size("words") == exactly) if exactly else theirs
    part = lambda words: F.slice(words, F.col("pos") + 1, width)
    spots = F.sequence(F.lit(0), F.lit(width - 1))
    theirs = theirs.select(
        "item_id",
        F.xxhash64("words").alias("item"),
        F.col("hash").alias("item_hash"),
        F.col("pos").alias("item_pos"),
        (F.size("words") - (width - 1)).alias("of"),
        part("raw").alias("item_raw"),
        part("words").alias("item_words"),
        part("bare").alias("item_bare"),
    )
    plain = F.filter(spots, lambda k: (~F.element_at("item_words", k + 1).startswith("\u0001")) & (F.element_at("item_words", k + 1) != ""))
    theirs = theirs.withColumn("plain", F.transform(plain, lambda k: k + F.col("item_pos")))
    slotless = F.forall("item_words", lambda w: ~w.startswith("\u0001"))
    theirs = theirs.withColumn("loose", slotless & (F.size("plain") >= LEAST))  # punctuation aside, as with the template
    spoken = F.size(F.filter("item_bare", lambda w: w != ""))
    operators = F.size(F.filter("item_raw", lambda w: w.rlike(OPERATOR)))
    told = F.size("plain") >= LEAST if of == "words" else (spoken >= 2) & (spoken + operators >= LEAST)
    theirs = materialize(theirs.where(told).drop("item_bare").distinct())
    most = theirs.where(F.size("plain") >= LEAST).select("item", F.explode("plain").alias("word")).groupBy("item").agg(F.countDistinct("word").alias("most"))
    theirs = materialize(theirs.join(most, "item", "left").drop("item"))
    few = theirs.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    ours = _windows(rows, width, ["key", "doc_id"], of)
    joined = ours.join(F.broadcast(theirs) if few else theirs, F.col("hash") == F.col("item_hash"))
    if of == "words":
        slots = F.transform(
            F.filter(spots, lambda k: F.element_at("item_words", k + 1).startswith("\u0001")),
            lambda k: F.struct(
                F.concat(F.element_at("item_words", k + 1), _slot(F.element_at("item_raw", k + 1))).alias("theirs"),
                F.concat(F.element_at("item_words", k + 1), _slot(F.element_at("ours", k + 1))).alias("ours"),
            ),
        )
        same = F.forall("slots", lambda s: s["theirs"] == s["ours"])
    else:
        slots = F.array().cast("array<struct<theirs:string,ours:string>>")
        alike = F.forall(spots, lambda k: _exact(F.element_at("item_raw", k + 1)) == _exact(F.element_at("ours", k + 1)))
        same = F.when(F.col("loose") | alike, True)
    passage = ["key", "doc_id", "item_id", "shift", "item_pos", "of", "plain", "most"]
    found = joined.select("key", "doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", "of", "plain", "most", "loose", "item_words", "item_raw", part("raw").alias("ours"))
    return found.select(*passage, "loose", "item_raw", "ours", slots.alias("slots")).select(*passage, "slots", same.alias("same"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, whole_texts: bool = False) -> DataFrame:
    """docs without the documents that hold a passage of a benchmark item."""
    keys = materialize(find_leaks(docs, benchmark, whole_texts=whole_texts).select(F.col("key").alias("_leak_key"), F.col("doc_id").alias("_leak_id")).distinct())
    same = (F.col("_own_key") == F.col("_leak_key")) & F.col("doc_id").eqNullSafe(F.col("_leak_id"))
    return docs.withColumn("_own_key", row_key("doc_id", "text")).join(keys, same, "left_anti").drop("_own_key")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), whole_texts=True).drop("key")
