"""Operator 6: benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is a fixed mask over ``SPAN`` words of which it reads five and ignores the
rest.  Seeds of all places of benchmark items and of training texts are hashed
and joined, so a passage with changed words still meets its item wherever five
read words agree.  Around a hit the item is laid over the text on the hit's
diagonal and compared word by word.  It is a leak if in some stretch of
``STRETCH`` words (the whole item, if shorter) at least ``SHARE`` agree.  The four
masks meet every such stretch, wherever its other words are; a mask may stand out
over an end of the text or item with words that it doesn't read.

Seeds of the benchmark are broadcast if there are ``BROADCAST_SEEDS`` at most;
beyond that the join is by shuffle, with the same result.

Items of 5 to 7 words, too short for a mask, must stand there exactly.  Items of
fewer words can't be told from ordinary text within it and are leaks only where
the text has exactly their words and no others.  Null or empty
texts have no words.  Rows with equal ``doc_id`` and text give one result, equal
items give one each.  Empty tables give an empty result.  Columns with clashing
names are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestline.functions.once import compute_once
from harvestline.llm.common import Scratch

MASKS = ((0, 1, 2, 4, 7), (0, 2, 3, 5, 6), (0, 1, 3, 4, 5), (1, 4, 5, 6, 7))  # words that are read
SPAN = 8
SHORTEST = 5  # of items that are looked for within a text
STRETCH = 16
SHARE = 0.8
BROADCAST_SEEDS = 1_000_000

_BETWEEN = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def _seed(words: str, at: str, kind: int, offsets: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(kind), *(F.get(words, F.col(at) + o) for o in offsets))


def _seeds(parsed: DataFrame, words: str, lengths: list[int], *carry: str) -> DataFrame:
    """A row a place and mask: ``seed``, ``at``, and the columns to carry.

    ``lengths``: of short items; their seeds read that many words in a row.  All
    seeds of a place come from one array: the words stand beside each place only
    inside generated code and are never copied for it.
    """
    size = F.size(words)
    kinds = [*enumerate(MASKS), *((-n, tuple(range(n))) for n in lengths)]
    fits = lambda reads: (F.col("at") >= -reads[0]) & (F.col("at") + reads[-1] < size)
    whole = lambda n: F.lit(True) if n >= SHORTEST else size == n
    found = [F.when(fits(reads) & whole(len(reads)), _seed(words, "at", kind, reads)) for kind, reads in kinds]
    first, shortest = -max(reads[0] for _, reads in kinds), min(reads[-1] + 1 for _, reads in kinds)
    placed = parsed.filter(size >= shortest).select(*carry, words, F.explode(F.sequence(F.lit(first), size - shortest)).alias("at"))
    kept = dict.fromkeys([*carry, "at"])
    return placed.select(*kept, F.explode(F.array(*found)).alias("seed"))


def _best_stretch(places: Column, length: Column) -> Column:
    """Most agreeing words in a stretch; ``places`` are those of the item's words that agree, in order."""
    wide = F.least(length, F.lit(STRETCH))
    # Some best stretch begins at a word that agrees, or holds no more than the one before the item's end.
    inside = lambda p, i: F.size(F.filter(F.slice(places, i + 1, STRETCH), lambda q: q < p + wide))
    return F.coalesce(F.array_max(F.transform(places, inside)), F.lit(0))


def find_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """``doc_id, text_key, item_id, first_word, n_agree, n_compared, share``: a row a leaked item and text.

    ``first_word`` is the word of the text at which the item would begin; negative
    if the text begins within the item.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = scratch.keep(
        benchmark.select(
            F.monotonically_increasing_id().alias("item"), F.col("item_id"), words_of(F.col("text")).alias("i_words")
        ).filter(F.size("i_words") > 0),
        "items",
    )
    sizes = items.filter(F.size("i_words") < SPAN).select(F.size("i_words").alias("n")).distinct()
    lengths = sorted(r["n"] for r in sizes.collect())  # seven at most
    seeds = _seeds(items.filter(F.size("i_words") >= SPAN), "i_words", [], "item")
    for n in lengths:
        one = items.filter(F.size("i_words") == n).withColumn("at", F.lit(0))
        seeds = seeds.unionByName(one.select("item", "at", _seed("i_words", "at", -n, tuple(range(n))).alias("seed")))
    table = scratch.keep(seeds.select("seed", "item", F.col("at").alias("i_at")), "seeds")
    small = table.count() <= broadcast_seeds

    parsed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), words_of(F.col("text")).alias("words"))
    # A passage hits at nearly all its places; its diagonal is one short row before any word is fetched.
    hits = _seeds(parsed, "words", lengths, "doc_id", "text_key").join(F.broadcast(table) if small else table, "seed")
    found = scratch.keep(
        hits.select(F.struct("doc_id", "text_key").alias("of"), "item", (F.col("at") - F.col("i_at")).alias("first_word")).distinct(),
        "hits",
    )
    words = found.join(parsed, F.col("of.doc_id").eqNullSafe(parsed["doc_id"]) & (F.col("of.text_key") == parsed["text_key"]))
    length = F.size("i_words")
    # Of the text no more than lies under the item goes on from here, cut out once and not for each place.
    laid = compute_once(
        words.join(items, "item").withColumn("n_item", length),
        under=F.slice("words", F.greatest("first_word", F.lit(0)) + 1, length),
    )
    place = lambda i: i + F.least("first_word", F.lit(0))
    agrees = lambda i: F.coalesce(F.get("under", place(i)) == F.get("i_words", i), F.lit(False))
    agreeing = compute_once(laid, places=F.filter(F.sequence(F.lit(0), length - 1), agrees))
    judged = (
        agreeing.withColumn("n_agree", _best_stretch(F.col("places"), F.col("n_item")))
        .select("doc_id", "text_key", "item", "item_id", "first_word", "n_item", "n_agree")
        .dropDuplicates(["doc_id", "text_key", "item", "first_word"])
        .withColumn("n_compared", F.least("n_item", F.lit(STRETCH)))
        .withColumn("share", F.col("n_agree") / F.col("n_compared"))
        .filter(F.col("share") >= F.when(F.col("n_item") < SPAN, 1.0).otherwise(SHARE))
    )
    best = F.max_by(F.struct("first_word", "n_agree", "n_compared", "share"), F.struct("share", -F.col("first_word")))
    return judged.groupBy("doc_id", "text_key", "item", "item_id").agg(best.alias("best")).select(
        "doc_id", "text_key", "item_id", "best.*"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no leak, with their columns."""
    leaks = Scratch(docs.sparkSession, "decontaminate").keep(
        find_leaks(docs, benchmark).select(F.struct("doc_id", "text_key").alias("_leak")).distinct(), "leaks"
    )
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    leak = leaks["_leak"]
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leak["doc_id"]) & (key == leak["text_key"]), "left_anti")
