"""Phrase collocations from a weighted de Bruijn graph of words.

A text is cut into pieces at punctuation and line ends.  Every word of a piece
starts one *edge*: the run of up to ``longest`` words from there, cut short
where the piece ends.  Full edges join two overlapping *nodes*, runs of
``longest - 1`` words.  Only edges are counted in the texts; they are combined
in each task before they are shuffled.  All shorter counts follow from them:
what leaves a node, plus the short edges of pieces that end in it, is the
node's count, and in the same way down to single words.

The graph of frequent edges is then compacted.  A node whose count equals the
weight of one edge into it and of one edge out of it lies on a unary path: all
its occurrences come from the one and go on to the other.  Such runs become
one path with one weight (pointer doubling, so a path of n words takes about
log2 n joins).  Counts inside a path are its weight; only its ends and
single words are looked up.

Phrases are scored by a * a / (l * r) at their weakest cut, in exact decimals,
and dropped where a longer frequent phrase holds most of their occurrences.

Hot words: edges are dealt out by their first word and an eighth of its
successors; lookups of single words are salted.  One task holds the successors
of one pair of words, which were combined before the shuffle.

Defined results: a null text is empty, a null language ``und``; repeated rows
count each time; ties rank by the phrase's bytes; extra columns are ignored; an
empty table has no phrases.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodweave.llm.common import Scratch

LONGEST, MIN_COUNT, SHARE, TOP = 3, 10, 50, 2000
#: Tokens that a task holds before it passes on their edges.
RUN = 1 << 20
SUCCESSOR_SALTS = 8
WORD_SALTS = 8

# Every piece end becomes a line feed and every blank a space; bytes.lower() changes A-Z alone.
_PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")


def _tokens(text: str | None) -> list[bytes]:
    """Words, with a line feed behind each piece and empty strings where blanks adjoin."""
    return ((text or "").encode().lower().translate(_PLAIN) + b"\n").replace(b"\n", b" \n ").split(b" ")[:-1]


def combine_edges(tokens: list[bytes], longest: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct edges of a run of tokens, in ascending order, and how often each occurs.

    An edge is the run of up to ``longest`` words from a word on, cut short where its piece ends.
    """
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words = coded.dictionary.take(pa.array(order))
    codes = rank[coded.indices.to_numpy()]
    size = len(words)
    end, blank = (words.index(x).as_py() for x in (pa.scalar(b"\n", pa.binary()), pa.scalar(b"", pa.binary())))
    codes = codes[codes != blank]
    starts = codes != end
    keys, after, inside, base, levels = codes, codes, starts, size + 1, []
    narrow = base ** longest >= 1 << 62            # keys of whole edges would not fit: number the beginnings
    for k in range(1, longest):
        after = np.append(after[1:], end)
        inside = inside & (after != end)
        keys = keys * base + np.where(inside, after + 1, 0)
        if narrow and k < longest - 1:
            distinct, keys = np.unique(keys, return_inverse=True)
            levels.append(distinct)
    found, counts = np.unique(keys[starts], return_counts=True)
    parts = []
    for k in range(longest - 1, 0, -1):
        word, found = found % base - 1, found // base
        parts.append(words.take(pa.array(word, pa.int64(), mask=word < 0)))
        if narrow and k > 1:
            found = levels[k - 2][found]
    parts.append(words.take(pa.array(found, pa.int64())))
    return pc.binary_join_element_wise(*reversed(parts), pa.scalar(b" ", pa.binary()), null_handling="skip"), counts


def count_edges(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(edge, n): edges as ``lang TAB words``, combined within runs of a task."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[bytes]] = {}

        def flush(lang: bytes) -> Iterator[pa.RecordBatch]:
            tokens, stop = held.pop(lang), 0
            while stop < len(tokens):                  # a long text fills several runs, each to a piece's end
                start, stop = stop, tokens.index(b"\n", min(stop + RUN, len(tokens)) - 1) + 1
                edges, counts = combine_edges(tokens[start:stop], longest)
                for j in range(0, len(edges), 1 << 16):
                    edge = pc.binary_join_element_wise(pa.scalar(lang, pa.binary()), edges[j:j + (1 << 16)], pa.scalar(b"\t", pa.binary()))
                    yield pa.record_batch([edge.cast(pa.string()), pa.array(counts[j:j + (1 << 16)], pa.int64())], names=["edge", "n"])

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                lang = b"und" if lang is None else lang.encode()
                tokens = held.setdefault(lang, [])
                tokens += _tokens(text.as_py())
                if sum(map(len, held.values())) >= RUN:
                    yield from flush(max(held, key=lambda k: len(held[k])))
        for lang in sorted(held):
            yield from flush(lang)

    return docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "edge string, n long")


def _length(phrase: Column) -> Column:
    return F.size(F.split(phrase, " "))


def _split_key() -> list[Column]:
    """Language and phrase of a key; a phrase has no tab, a language might."""
    phrase = F.substring_index("key", "\t", -1)
    return [F.expr("substring(key, 1, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang"),
            phrase.alias("phrase"), _length(phrase).alias("words")]


def count_phrases(docs: DataFrame, scratch: Scratch, longest: int = LONGEST,
                  min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, phrase, words, f) of all phrases of up to ``longest`` words with f >= min_count, and words per language."""
    edge = F.col("edge")
    bucket = F.hash(F.substring_index(edge, " ", 1), F.pmod(F.hash(F.substring_index(edge, " ", 2)), F.lit(SUCCESSOR_SALTS)))
    dealt = count_edges(docs, longest).select(bucket.alias("bucket"), "edge", "n").repartition("bucket")
    # an edge adds to the count of each of its beginnings; the bucket has all edges of a pair of words
    flow = dealt.select("bucket", F.explode(_beginnings(longest)).alias("key"), "n") \
        .groupBy("bucket", "key").agg(F.sum("n").alias("f"))
    single = F.instr("key", " ") == 0
    flows = scratch.write(flow.where(single | (F.col("f") >= min_count)).select("key", "f"), "phrase-flows")
    words = scratch.write(flows.where(single).groupBy("key").agg(F.sum("f").alias("f")).select(*_split_key(), "f"),
                          "phrase-words")
    totals = scratch.write(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    counts = scratch.write(flows.where(~single).select(*_split_key(), "f")
                           .unionByName(words.where(F.col("f") >= min_count)), "phrase-counts")
    scratch.drop(flows, words)
    return counts, totals


def _beginnings(longest: int) -> Column:
    """The beginnings of an edge, one for each number of its words."""
    edge, gaps = F.col("edge"), F.length("edge") - F.length(F.replace(F.col("edge"), F.lit(" "), F.lit("")))
    return F.slice(F.array(*[F.substring_index(edge, " ", k) for k in range(1, longest)], edge), 1, gaps + 1)


def _node(phrase: str, nodes: int, end: int) -> Column:
    """The first (end = 1) or last (end = -1) ``nodes`` words."""
    return F.substring_index(phrase, " ", end * nodes)


def compact(counts: DataFrame, scratch: Scratch, longest: int = LONGEST) -> DataFrame:
    """Frequent edges as maximal unary paths: (lang, path, weight, head_f, tail_f) with the counts of both end nodes."""
    k = longest - 1
    edges = counts.where(F.col("words") == longest).select(
        "lang", F.col("phrase").alias("edge"), F.col("f").alias("weight"),
        _node("phrase", k, 1).alias("head"), _node("phrase", k, -1).alias("tail"))
    flow = counts.where(F.col("words") == k).select("lang", F.col("phrase").alias("node"), "f")
    none = F.lit(None).cast("bigint")
    # a node's count and its heaviest edges in and out; on a unary path the three are equal
    ends = flow.select("lang", "node", "f", none.alias("w_in"), none.alias("w_out")) \
        .unionByName(edges.select("lang", F.col("tail").alias("node"), none.alias("f"), F.col("weight").alias("w_in"), none.alias("w_out"))) \
        .unionByName(edges.select("lang", F.col("head").alias("node"), none.alias("f"), none.alias("w_in"), F.col("weight").alias("w_out")))
    unary = scratch.write(ends.groupBy("lang", "node").agg(*[F.max(x).alias(x) for x in ("f", "w_in", "w_out")])
                          .where((F.col("w_in") == F.col("f")) & (F.col("w_out") == F.col("f"))).select("lang", "node"),
                          "phrase-unary")
    chains = _rank_chains(unary, edges, scratch)
    into = chains.select("lang", F.col("node").alias("tail"), F.col("first").alias("chain"), F.col("dist").alias("at"))
    out = chains.select("lang", F.col("node").alias("head"), F.col("first").alias("chain_o"), (F.col("dist") + 1).alias("at_o"))
    placed = edges.join(into, ["lang", "tail"], "left").join(out, ["lang", "head"], "left").select(
        "lang", "edge", "weight", F.coalesce("chain", "chain_o", F.lit("")).alias("chain"),
        F.coalesce("at", "at_o", F.lit(0)).alias("at"),
        # an edge between two branching nodes is a path of its own
        F.when(F.coalesce("chain", "chain_o").isNull(), F.col("edge")).alias("alone"))
    steps = F.array_sort(F.collect_list(F.struct("at", "edge")))
    joined = placed.groupBy("lang", "chain", "alone").agg(F.max("weight").alias("weight"), steps.alias("steps"))
    path = F.concat_ws(" ", F.col("steps")[0]["edge"],
                       F.transform(F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0))),
                                   lambda s: F.substring_index(s["edge"], " ", -1)))
    paths = joined.select("lang", path.alias("path"), "weight")
    first, last = _node("path", k, 1), _node("path", k, -1)
    paths = scratch.write(
        paths.join(flow.withColumnsRenamed({"node": "h", "f": "head_f", "lang": "lang_h"}),
                   (F.col("lang") == F.col("lang_h")) & (first == F.col("h")))
        .join(flow.withColumnsRenamed({"node": "t", "f": "tail_f", "lang": "lang_t"}),
              (F.col("lang") == F.col("lang_t")) & (last == F.col("t")))
        .select("lang", "path", "weight", "head_f", "tail_f"), "phrase-paths")
    scratch.drop(unary, chains)
    return paths


def _rank_chains(unary: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, node, first, dist) of every unary node: the first node of its chain and its distance, by pointer doubling.

    A chain has an end, because every piece does: where occurrences start, a node's count exceeds what flows in.
    """
    before = edges.select("lang", F.col("tail").alias("node"), F.col("head").alias("prev")) \
        .join(unary.withColumnRenamed("node", "prev"), ["lang", "prev"], "left_semi")
    state = scratch.write(unary.join(before, ["lang", "node"], "left").select(
        "lang", "node", F.coalesce("prev", "node").alias("first"), F.col("prev").isNotNull().cast("long").alias("dist"),
        F.col("prev").isNull().alias("done")), "phrase-chains")
    while state.where(~F.col("done")).limit(1).count():
        there = state.select(F.col("lang").alias("lang2"), F.col("node").alias("first2"), F.col("first").alias("jump"),
                             F.col("dist").alias("more"), F.col("done").alias("ended"))
        moved = state.where(~F.col("done")).join(there, (F.col("lang") == F.col("lang2")) & (F.col("first") == F.col("first2"))) \
            .select("lang", "node", F.col("jump").alias("first"), (F.col("dist") + F.col("more")).alias("dist"), F.col("ended").alias("done"))
        doubled = scratch.write(state.where("done").unionByName(moved), "phrase-chains")
        scratch.drop(state)
        state = doubled
    return state


def windows(paths: DataFrame, longest: int = LONGEST) -> DataFrame:
    """The edges of the paths with the counts of their two nodes, which inside a path are its weight."""
    w = F.split("path", " ")
    last = F.size(w) - longest
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        F.array_join(F.slice(w, i + 1, F.lit(longest)), " ").alias("phrase"),
        F.when(i == 0, F.col("head_f")).otherwise(F.col("weight")).alias("head_f"),
        F.when(i == last, F.col("tail_f")).otherwise(F.col("weight")).alias("tail_f")))
    return paths.select("lang", F.col("weight").alias("a"), F.explode(each).alias("e")) \
        .select("lang", "e.phrase", "a", "e.head_f", "e.tail_f")


def weakest_cuts(candidates: DataFrame, counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, a, l, r, score): each candidate at its lowest-scoring cut, the earliest of equals."""
    w, m = F.split("phrase", " "), _length(F.col("phrase"))
    full = m == longest

    def part(k, start, length, known):
        return F.struct(k.cast("int").alias("k"), (start != 1).alias("rest"),
                        F.array_join(F.slice(w, start, length), " ").alias("part"), known.alias("known"))

    none = F.lit(None).cast("bigint")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), m - 1), lambda k: F.array(
        part(k, F.lit(1), k, F.when(full & (k == longest - 1), F.col("head_f")).otherwise(none)),
        part(k, k + 1, m - k, F.when(full & (k == 1), F.col("tail_f")).otherwise(none)))))
    sides = candidates.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    one = F.instr("part", " ") == 0
    asked = sides.where(F.col("known").isNull()).drop("known") \
        .withColumn("salt", F.when(one, F.pmod(F.hash("phrase"), F.lit(WORD_SALTS))).otherwise(0))
    found = counts.select(F.col("lang"), F.col("phrase").alias("part"), "f", F.explode(
        F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(WORD_SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    sides = asked.join(found, ["lang", "part", "salt"]).select("lang", "phrase", "a", "k", "rest", "f") \
        .unionByName(sides.where(F.col("known").isNotNull()).select("lang", "phrase", "a", "k", "rest", F.col("known").alias("f")))
    lr = sides.groupBy("lang", "phrase", "k").agg(
        F.max("a").alias("a"), F.max(F.when(~F.col("rest"), F.col("f"))).alias("l"), F.max(F.when(F.col("rest"), F.col("f"))).alias("r"))
    # 15 digits hold a count of any corpus; the products stay within 38
    score = F.expr("(1000000 * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0))) div (cast(l as decimal(15, 0)) * cast(r as decimal(15, 0)))")
    best = lr.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def held_by_longer(candidates: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, longer): the count of the most frequent longer candidate that holds the phrase."""
    w, m = F.split("phrase", " "), _length(F.col("phrase"))
    inside = F.flatten(F.transform(F.sequence(F.lit(2), m - 1), lambda k: F.transform(
        F.sequence(F.lit(1), m - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))))
    return candidates.where(m > 2).select("lang", "a", F.explode(inside).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def mine(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, share: int = SHARE,
         top: int = TOP) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of every language: (lang, rank, phrase, a, l, r, n, score)."""
    with Scratch(docs.sparkSession) as scratch:
        counts, totals = count_phrases(docs, scratch, longest, min_count)
        paths = compact(counts, scratch, longest)
        none = F.lit(None).cast("bigint")
        shorter = counts.where((F.col("words") > 1) & (F.col("words") < longest)) \
            .select("lang", "phrase", F.col("f").alias("a"), none.alias("head_f"), none.alias("tail_f"))
        candidates = scratch.write(shorter.unionByName(windows(paths, longest)), "phrase-candidates")
        kept = candidates.join(held_by_longer(candidates, longest), ["lang", "phrase"], "left") \
            .where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")
        ranked = weakest_cuts(kept, counts, longest).withColumn("rank", F.row_number().over(
            Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint")).where(F.col("rank") <= top)
        return scratch.keep(scratch.write(ranked.join(totals, "lang").select(
            "lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrase-top"))
