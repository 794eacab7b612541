"""Spelling variants: words at edit distance one, found with pivotal grams, and the form each word most likely stands for.

Words are the maximal runs of letters (``RUN``) with A-Z lower-cased. ``occurrences`` counts them over whole texts; the query lets a known share of the
occurrences lose a code point first. A word's bigrams are ordered by how many words hold them, then by the bigram and its place. The first ``PREFIX`` =
2 * 1 + 1 of this order are the word's prefix, and its pivots are the two bigrams of the prefix that do not overlap and are rarest together,
chosen by dynamic programming over the prefix in order of place. One edit cannot touch both pivots. Of two words at distance one the pivots of the word
whose prefix ends earlier in the order therefore hold a bigram that stands in the other word's prefix, at a place moved by as much as the
lengths differ or not at all. Pivots are filed under (bigram, place, length) and the prefix grams ask all five such keys; ``levenshtein`` with a bound of
one verifies. All of it is column expressions; the only literal is the count of each bigram, at most ``len(ALPHABET) ** 2`` = 8,100 numbers.

Null texts have no words. A null ``doc_id`` counts as empty text before the colon. Repeated rows count as often as they stand there. Ties of ``form`` go to
the smallest word in code-point order. Words of any length take part. An empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmap.session import cut

LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABET = LOWER + "".join(map(chr, range(0xC0, 0x100)))
RUN = "[a-zÀ-ÿ]+"
PREFIX = 3
TYPO = 97                       # one (document, run) of so many loses a code point in the query


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run) of every run of letters of ``docs`` (doc_id, text), with A-Z lower-cased."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), 0)).alias("run"))


def shortened(doc_id: Column, run: Column, one_in: int = TYPO) -> Column:
    """The run, without its code point ``h % length`` where ``one_in`` divides h = crc32 of ``doc_id:run``."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def occurrences(words: DataFrame, least: int = LEAST_COUNT, length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of the words of at least ``length`` code points that stand at least ``least`` times in ``words`` (word)."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _code(c: Column) -> Column:
    """Place of a letter in ``ALPHABET``."""
    point = F.ascii(c)
    return F.when(point < 128, point - ord("a")).otherwise(point - 0xC0 + len(LOWER))


def _bigram(chars: Column, i: Column) -> Column:
    """The number of the bigram that starts at place ``i``."""
    return _code(F.get(chars, i)) * len(ALPHABET) + _code(F.get(chars, i + 1))


def signed(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with ``size``, ``prefix`` (bigram, place; rarest first), ``pivots`` and ``last`` (the end of the prefix in the order)."""
    split = words.withColumn("chars", F.filter(F.split("word", ""), lambda c: c != ""))
    split = split.withColumn("size", F.size("chars")).withColumn(
        "grams", F.transform(F.sequence(F.lit(0), F.col("size") - 2), lambda i: F.struct(_bigram(F.col("chars"), i).alias("g"), i.alias("p"))))
    held = split.select(F.explode(F.array_distinct(F.transform("grams", lambda x: x["g"]))).alias("g")).groupBy("g").agg(F.count("*").alias("c"))
    count = [0] * len(ALPHABET) ** 2
    for g, c in held.collect():                                                     # at most 8,100 rows, whatever the corpus
        count[g] = c
    counts = F.split(F.lit(",".join(map(str, count))), ",").cast("array<bigint>")   # one folded literal
    # ``sort_array`` of (count, bigram, place) is the global order
    order = F.sort_array(F.transform("grams", lambda x: F.struct(F.get(counts, x["g"]).alias("c"), x["g"].alias("g"), x["p"].alias("p"))))
    known = split.select("word", "n", "size", F.slice(order, 1, PREFIX).alias("prefix")).withColumn("last", F.element_at("prefix", -1))
    # Dynamic programming over the prefix from left to right. At a bigram only the one before it can overlap it, so the state holds that one (``near``), the
    # rarest of all before that (``one``) and the rarest pair so far (``two``).
    none = F.expr("CAST(NULL AS struct<c:bigint,g:int,p:int>)")
    pair = F.expr("CAST(NULL AS struct<c:bigint,a:struct<c:bigint,g:int,p:int>,b:struct<c:bigint,g:int,p:int>>)")
    by_place = F.sort_array(F.transform("prefix", lambda x: F.struct(x["p"].alias("p"), x["c"].alias("c"), x["g"].alias("g"))))
    rarest = lambda a, b: F.when(a.isNull() | (b < a), b).otherwise(a)

    def step(state: Column, x: Column) -> Column:
        gram = F.struct(x["c"].alias("c"), x["g"].alias("g"), x["p"].alias("p"))
        behind = F.when(state["near"].isNull(), state["one"]).otherwise(rarest(state["one"], state["near"]))
        apart = F.when(state["near"]["p"] <= x["p"] - 2, behind).otherwise(state["one"])
        new = F.when(apart.isNotNull(), F.struct((apart["c"] + x["c"]).alias("c"), apart.alias("a"), gram.alias("b")))
        return F.struct(behind.alias("one"), gram.alias("near"), F.when(new.isNull(), state["two"]).otherwise(rarest(state["two"], new)).alias("two"))

    start = F.struct(none.alias("one"), none.alias("near"), pair.alias("two"))
    done = F.aggregate(by_place, start, step, lambda s: F.array(s["two"]["a"], s["two"]["b"]))
    return known.withColumn("pivots", done)


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n): every ordered pair of ``words`` (word, n) that differ by exactly one inserted, deleted or replaced code point."""
    known = cut(signed(words))
    pivots = known.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("last").alias("a_last"), F.col("size").alias("size"), F.explode("pivots").alias("x")).select(
        "a", "a_n", "a_last", "size", F.col("x.g").alias("g"), F.col("x.p").alias("p"))
    # (length, place) of a pivot that an edit elsewhere can turn this prefix gram into
    moves = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(p).alias("p")) for s, p in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))])
    asks = known.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("last").alias("b_last"), F.col("size").alias("b_size"), F.explode("prefix").alias("x")).select(
        "b", "b_n", "b_last", "b_size", F.col("x.g").alias("g"), F.col("x.p").alias("b_p"), F.explode(moves).alias("m")).select(
        "b", "b_n", "b_last", "g", (F.col("b_size") + F.col("m.s")).alias("size"), (F.col("b_p") + F.col("m.p")).alias("p"))
    met = asks.join(pivots, ["g", "p", "size"]).where((F.col("a_last") <= F.col("b_last")) & (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    pairs = met.select("a", "b", "a_n", "b_n").distinct()
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    return pairs.select(F.explode(both).alias("x")).select("x.*").distinct()


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form, ...) with ``root``: the last word when forms are followed. Counts at least double with each step, so a chain is short and
    pointer jumping ends after a logarithm of its length."""
    names = cut(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        ahead = names.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(names.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        names = new.drop("moved")
        if not new.where("moved").limit(1).count():
            break
    return forms.join(names, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n); a form is the near word of largest count if that is at least ``ratio`` times the own one."""
    words = cut(words)
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("o"))).alias("best"))
    joined = words.join(best, "word", "left")
    taken = -F.col("best.m") >= ratio * F.col("n")
    forms = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.o")).alias("form"),
                              F.when(taken, -F.col("best.m")).alias("form_n")))
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
