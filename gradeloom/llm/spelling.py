"""Spelling variants: words one edit apart, found by a rare-first prefix filter over positional bigrams, each led to its form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.runtime import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
#: One deletion for each so many checksums of document and run.
SLIP = 199
#: Two words one edit apart differ in two bigrams at most, so the three rarest of each have one in common.
RAREST = 3
#: A form has at least so many times its word's occurrences, so 28 steps pass a long, and five doublings the 28 steps.
TIMES, DOUBLINGS = 5, 5


def lowered(run: Column) -> Column:
    """A-Z to a-z, all others as they are."""
    return F.when(run == F.lower(run), run).otherwise(F.translate(run, UPPER, LOWER))


def slipped(run: Column, key: Column) -> Column:
    """The run, without one of its code points where 199 divides the checksum of key and run."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, text: str, key: str, length: int, least: int) -> DataFrame:
    """word and n: the slipped runs of at least `length` code points and `least` occurrences in all texts."""
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0)))
    runs = docs.select(F.col(key).alias("k"), run.alias("r")).select("k", lowered(F.col("r")).alias("r"))
    words = runs.select(slipped(F.col("r"), F.col("k")).alias("word")).filter(F.char_length("word") >= length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """word, n, len and gram, pos of its three rarest bigrams; rarer first over all words, then by bigram, then by place.

    The letters are 26 + 64, so bigrams are 8100 at most and their counts are sent to all tasks.
    """
    grams = words.select("word", "n", F.char_length("word").alias("len"), F.posexplode(F.expr("transform(sequence(1, char_length(word) - 1), i -> substring(word, i, 2))")).alias("pos", "gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("f"))
    ranked = grams.join(F.broadcast(counts), "gram").groupBy("word", "n", "len").agg(F.slice(F.array_sort(F.collect_list(F.struct("f", "gram", "pos"))), 1, RAREST).alias("g"))
    return ranked.select("word", "n", "len", F.explode("g").alias("g")).select("word", "n", "len", F.col("g.gram").alias("gram"), F.col("g.pos").alias("pos"))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each pair of words one edit apart once.

    A bigram that an edit leaves stands at the same place in a word of the same length, and at the same or the next place
    in a word one longer; these are the join's keys, and levenshtein verifies what meets.
    """
    tokens = stored(rarest_bigrams(words), "spelling-bigrams")
    longer = F.explode(F.array(*[F.struct(F.lit(n).alias("l"), F.lit(p).alias("p")) for n, p in ((0, 0), (1, 0), (1, 1))])).alias("d")
    left = tokens.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "gram", "pos", "len", longer).select("a", "a_n", "gram", (F.col("len") + F.col("d.l")).alias("len"), (F.col("pos") + F.col("d.p")).alias("pos"), (F.col("d.l") > 0).alias("grown"))
    right = tokens.select(F.col("word").alias("b"), F.col("n").alias("b_n"), "gram", "len", "pos")
    met = left.join(right, ["gram", "len", "pos"]).filter(F.col("grown") | (F.col("a") < F.col("b")))
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def last_forms(formed: DataFrame) -> DataFrame:
    """word and root (the last of the forms from word on) of words that have a form."""
    at = stored(formed.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(DOUBLINGS):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("last"))
        moved = stored(at.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")), "spelling-roots")
        at = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    return at


def variants(docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: int = 6, least: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of at least `length` (not under 4) code points and `least` occurrences.

    Null and empty texts have no words; a null key counts as the empty text in the checksum. Of near words with equal
    counts the smallest in code-point order is the form. Repeated rows count each time. An empty table gives an empty
    result. Counts are added up before each shuffle; a bigram key that very many words share is split by Spark's skew join.
    """
    words = stored(word_counts(docs, text, key, length, least), "spelling-words")
    pairs = stored(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best"))
    has = -F.col("best.n") >= TIMES * F.col("n")
    found = stored(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.w")).alias("form"), F.when(has, -F.col("best.n")).alias("form_n")), "spelling-forms")
    roots = last_forms(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Form and root of every frequent word. Nulls, ties and empty tables: see `variants`."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
