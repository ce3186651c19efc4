"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions alone.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window). Its set is
its word shingles. For containment of the whole set the prefix of a window, its shingles ordered by
rarity in the corpus, need have one element only: the rarest shingle. First the benchmark's words are
counted over all documents: a shingle is at most as frequent as its rarest word, and that bound is the order;
a window with a word that never occurs is out. Then documents' shingles are joined to the prefixes alone, which
gives the candidates. The words are written once, and both passes read them.
The shingle's place fixes where the window would start; length and position bounds prune; last, the words
there, which a matched shingle brings along, are compared with the window's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: What parts words: every ASCII character but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 5
#: Benchmark shingles (8 bytes each) up to this many are broadcast; beyond that both sides shuffle.
BROADCAST_UP_TO = 2_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _shingle(w: Column, i: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *(F.get(w, i + j) for j in range(size)))


def _rarity(split: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(word, df)``: how often each wanted word occurs in the texts ``split`` (w); those that never do have no row.

    Counts are added up before they are shuffled. Wanted words that are few enough are broadcast, so others never leave their task.
    """
    small = wanted.count() <= BROADCAST_UP_TO
    return split.select(F.explode("w").alias("word")).join(F.broadcast(wanted) if small else wanted, "word").groupBy("word").agg(F.count("*").alias("df"))


def _met(split: DataFrame, wanted: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """``(key, n, pos, h, first, around)``: the wanted shingles of the texts ``split`` (key, w), with the words around them.

    Words are dealt out with their places and each place hashes its own shingle: a function over the array would run
    outside of generated code, and a row of the words be copied for each of its places.
    ``around`` starts at word ``first`` and holds every window that could cover the shingle. Where the wanted
    shingles are few enough for a broadcast, the words come from the row at hand. Beyond that shingles are
    shuffled without words, and only the matches fetch theirs.
    """
    small = wanted.count() <= BROADCAST_UP_TO
    first = lambda s: F.greatest(F.col("pos") - (window - s), F.lit(0))
    around = lambda s: F.slice("w", first(s) + 1, F.col("pos") - first(s) + window)
    met = None
    for s in sizes:
        own = split.where(F.size("w") >= s)
        places = own.select("key", F.size("w").alias("n"), "w", F.posexplode("w").alias("pos", "word")).where(F.col("pos") <= F.col("n") - s)
        shingles = places.select("key", "n", "w", "pos", _shingle(F.col("w"), F.col("pos"), s).alias("h"))
        if small:
            one = shingles.join(F.broadcast(wanted), "h")
        else:
            one = shingles.drop("w").join(wanted, "h").distinct().join(own.dropDuplicates(["key"]), "key")
        one = one.select("key", "n", "pos", "h", first(s).alias("first"), around(s).alias("around"))
        met = one if met is None else met.union(one)
    return met


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id, key, n_words, n_hit, item_ids)`` of every row of ``docs``; item_ids: sorted strings.

    ``key`` is the MD5 of the text: rows are matched by content, so null and repeated ids keep their rows
    and copies have equal results. Null texts and items have no words. Windows of equal words are one
    window of several items. Items without an id mark words but aren't listed.
    """
    item = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("w")).where("size(w) > 0")
    item = item.select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("i"))
    item = item.select("item", F.slice("w", F.col("i") + 1, window).alias("w"))
    item = cut(item.select("item", "w", F.array_join("w", " ").alias("words"), F.size("w").alias("len")).distinct(), "windows")
    windows = item.select("words", "w", "len").distinct()
    sizes = [r[0] for r in windows.select(F.least("len", F.lit(shingle)).alias("s")).distinct().collect()]  # shingle numbers at most

    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), words(F.col(text_col)).alias("w"))
    rows = rows.select("id", "key", F.size("w").cast("long").alias("n_words"), "w")
    none = F.array().cast("array<string>")
    if not sizes:
        return rows.select("id", "key", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("item_ids"))
    rows = cut(rows, "words")
    own = windows.select("words", "len", F.posexplode("w").alias("off", "word"))
    own = own.join(_rarity(rows, own.select("word").distinct()), "word", "left").select("words", "len", F.struct("off", F.coalesce("df", F.lit(0)).alias("df")).alias("x"))
    own = own.groupBy("words", "len").agg(F.sort_array(F.collect_list("x"))["df"].alias("dfs")).where(F.array_min("dfs") > 0).withColumn("w", F.split("words", " "))
    prefix = None
    for s in sizes:
        ranks = F.transform(F.sequence(F.lit(0), F.col("len") - s), lambda i: F.struct(F.array_min(F.slice("dfs", i + 1, s)).alias("df"), _shingle(F.col("w"), i, s).alias("h"), i.alias("off")))  # noqa: B023
        one = own.where(F.least("len", F.lit(shingle)) == s).select("words", "len", F.array_min(ranks).alias("p")).select("words", "len", "p.h", "p.off")
        prefix = one if prefix is None else prefix.union(one)
    prefix = cut(prefix, "prefixes")
    met = _met(rows, prefix.select("h").distinct(), sizes, window)

    start = F.col("pos") - F.col("off")
    candidates = met.join(prefix, "h").where((start >= 0) & (start + F.col("len") <= F.col("n")))
    candidates = candidates.where(F.array_join(F.slice("around", start - F.col("first") + 1, F.col("len")), " ") == F.col("words"))
    hits = cut(candidates.select("key", start.alias("start"), "len", "words").distinct(), "hits")

    places = F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("len") - 1)))
    counts = hits.select("key", "start", "len").distinct().groupBy("key").agg(F.size(F.array_distinct(places)).cast("long").alias("n_hit"))
    listed = hits.select("key", "words").distinct().join(item.where("item is not null").select("item", "words"), "words")
    listed = listed.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    found = rows.select("id", "key", "n_words").join(cut(counts.join(listed, "key", "left"), "per-text"), "key", "left")
    return found.select("id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))
