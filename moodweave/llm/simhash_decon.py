"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

Words are runs of letters and digits of the lower-cased text; shingles are
five words, weighted by how often they occur in a window or item.  A window of
a document has as many words as the item it is compared with.  Its SimHash
(64 bits) is looked up in a multi-index over the items' fingerprints: eight
blocks of eight bits, each expanded to every value within two bits, so that by
the pigeonhole principle every fingerprint within ``RADIUS`` = 23 bits agrees
on a block.  Candidates within the radius are verified by exact weighted
Jaccard similarity of their shingles.

A weighted similarity of 0.8 needs a cosine of at least 8/9, an expected
distance of 9.7 bits and 23 bits with probability above 1 - 1e-6.

Windows are fingerprinted where they can match at all: a window that shares no
shingle with any item has similarity 0, so windows start where a shared
shingle aligns the document with an item.

Defined results: null and empty texts, and texts or items of fewer than five
words, have no shingle and match nothing; repeated rows each match; extra
columns are ignored by ``find_leaks`` and kept by ``drop_leaks``; if either
table is empty there are no leaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodweave.llm.common import gram_hashes, proven_small, settle

WIDTH = 5
PERCENT = 80
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
# Rows of a fixed width of at most 32 bytes that may be broadcast.
BROADCAST_ROWS = 1_000_000


def _with_shingles(df: DataFrame) -> DataFrame:
    """Replace ``text`` by ``grams``, the shingle hashes in text order."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    df = df.withColumn("text", clean)
    df = df.withColumn("hashes", F.transform(F.split("text", " "), lambda w: F.xxhash64(w))).drop("text")
    return df.withColumn("grams", gram_hashes("hashes", WIDTH)).drop("hashes")


def simhash(grams: str) -> Column:
    """64-bit SimHash of a bag of hashes: a bit is set when more than half of the bag has it."""
    g = F.col(grams)

    def bit(acc, b):
        ones = F.aggregate(g, F.lit(0), lambda n, x: n + F.getbit(x, b).cast("int"))
        return acc.bitwiseOR(F.when(ones * 2 > F.size(g), F.call_function("shiftleft", F.lit(1).cast("bigint"), b))
                             .otherwise(F.lit(0).cast("bigint")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), bit)


def _block(fp: Column, b) -> Column:
    """Block ``b`` (0 to 7) of a fingerprint."""
    shifted = F.call_function("shiftrightunsigned", fp, (b * BLOCK_BITS).cast("int"))
    return shifted.bitwiseAND(F.lit(2 ** BLOCK_BITS - 1).cast("bigint")).cast("int")


def _neighbours() -> Column:
    """Masks of at most two of eight bits."""
    return F.array(*[F.lit(m) for m in range(2 ** BLOCK_BITS) if bin(m).count("1") <= BLOCK_RADIUS])


def bag_shared(a: str, b: str) -> Column:
    """Size of the intersection of two arrays taken as bags."""
    x, y = F.col(a), F.col(b)
    count = lambda arr, v: F.size(F.filter(arr, lambda z: z == v))
    return F.aggregate(F.array_distinct(x), F.lit(0), lambda n, v: n + F.least(count(x, v), count(y, v)))


def items_table(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, n_words, grams, fp) of the items with a shingle."""
    t = _with_shingles(benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")))
    t = t.withColumn("n_words", F.size("grams") + WIDTH - 1).withColumn("item_fp", simhash("grams"))
    return settle(t.withColumnRenamed("grams", "item_grams"), "n_words").where(F.col("n_words") >= WIDTH)


def _anchors(items: DataFrame) -> DataFrame:
    return items.select("n_words", F.posexplode_outer("item_grams").alias("item_pos", "gram")).distinct()


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_key, start, n_words) of the item-sized windows aligned on a shingle shared with an item.

    ``docs`` has doc_key and text.  The inner join keeps the few shingles that
    any item has, so the exploded rows die in the map task that makes them.
    """
    grams = _with_shingles(docs.select("doc_key", "text")).withColumn("n", F.size("grams") + WIDTH - 1)
    # the outer form adds no size filter, which would compute the shingles again
    every = grams.select("doc_key", "n", F.posexplode_outer("grams").alias("pos", "gram"))
    hit = every.join(proven_small(_anchors(items), BROADCAST_ROWS), "gram")
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("item_pos"), F.col("n") - F.col("n_words")))
    return hit.select("doc_key", start.alias("start"), "n_words").distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Best match per document text and item: (doc_id, item_id, start, n_words, shared, total, similarity).

    ``start`` and ``n_words`` are in words; ``similarity`` is shared / total.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _best(_matches(rows, benchmark)).select(
        "doc_id", "item_id", "start", "n_words", "shared", "total",
        F.round(F.col("shared") / F.col("total"), 6).alias("similarity"))


def _matches(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))
    rows = rows.withColumn("doc_key", key)
    items = items_table(benchmark).checkpoint()  # read by both joins and the size check
    found = windows(rows, items).groupBy("doc_key").agg(F.collect_set(F.struct("start", "n_words")).alias("at"))
    same = F.col("r.doc_key.doc_id").eqNullSafe(F.col("f.doc_key.doc_id")) & (F.col("r.doc_key.h") == F.col("f.doc_key.h"))
    texts = rows.alias("r").join(found.alias("f"), same).select("r.doc_key", "r.text", "f.at")
    w = _with_shingles(texts.dropDuplicates(["doc_key"])).select("doc_key", "grams", F.explode("at").alias("w"))
    w = w.select("doc_key", "w.start", "w.n_words",
                 F.slice("grams", F.col("w.start") + 1, F.col("w.n_words") - (WIDTH - 1)).alias("grams"))
    w = settle(w.withColumn("fp", simhash("grams")), "fp")
    blocks = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    probe = w.withColumn("block", F.explode(blocks)).withColumn("value", _block(F.col("fp"), F.col("block")))
    index = items.withColumn("block", F.explode(blocks)).withColumn("near", F.explode(_neighbours()))
    index = index.select("item_id", "n_words", "item_fp", "item_grams", "block",
                         _block(F.col("item_fp"), F.col("block")).bitwiseXOR(F.col("near")).alias("value"))
    pair = probe.join(index, ["n_words", "block", "value"])
    diff = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.array_min(F.filter(blocks, lambda b: F.bit_count(_block(diff, b)) <= BLOCK_RADIUS))
    pair = pair.where((F.bit_count(diff) <= RADIUS) & (F.col("block") == first))
    pair = settle(pair.withColumn("shared", bag_shared("grams", "item_grams").cast("long")), "shared") \
        .withColumn("total", (F.size("grams") + F.size("item_grams") - F.col("shared")).cast("long"))
    return pair.where(F.col("shared") * 100 >= F.col("total") * PERCENT) \
        .select("doc_key", "item_id", "start", "n_words", "shared", "total")


def _best(matches: DataFrame) -> DataFrame:
    rank = F.struct((F.col("shared") / F.col("total")).alias("s"), (-F.col("start")).alias("at"),
                    "start", "n_words", "shared", "total")
    return matches.groupBy("doc_key", "item_id").agg(F.max(rank).alias("m")) \
        .select(F.col("doc_key.doc_id").alias("doc_id"), "item_id", "m.start", "m.n_words", "m.shared", "m.total")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item."""
    bad = _matches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark)
    bad = bad.select(F.col("doc_key.doc_id").alias("bad_id"), F.col("doc_key.h").alias("bad_h")).distinct().checkpoint()
    same = docs[doc_id].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs[text]) == bad["bad_h"])
    # ids and hashes, 16 bytes a row: broadcast up to a counted bound, else a shuffled anti join
    return docs.join(proven_small(bad, BROADCAST_ROWS), same, "left_anti")
