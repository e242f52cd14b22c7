"""Near-duplicate detection with HyperMinHash sketches.

A document is the set of its shingles of ``width`` words, hashed to 64 bits; a
text with fewer words is one shingle.  Its sketch
has 264 registers; a register keeps the smallest hash of its bucket as a
leading-zero count (6 bits) and the 10 mantissa bits after the leading one.
Sets under ``SMALL`` shingles use 264 hash functions of one bucket each; sets
of ``LARGE`` or more use 8 hash functions of 33 buckets each, filled densely
enough.  Sets in between have both sketches, so any two sets of Jaccard
similarity 0.8 (whose sizes differ by a fifth at most) share a kind.

The registers are cut into 44 bands of 6; sets that agree on a band meet.  At
similarity 0.8 a pair misses every band with probability 1.5e-6.  Pairs pass a
collision-corrected estimate (five standard errors below the threshold) before
their full sets are compared exactly, so every reported link is exact.

Sets that are equal are one node from the start.  Within a band bucket members
are compared with the bucket's smallest member, each with the hub it meets in
most buckets, and components are formed; members of mixed buckets then meet a
member of another component; last, every pair of a bucket whose members still
are in different components is compared, unless it cannot be linked: shingles that
no other document (or version of it) of such buckets has lie outside every intersection, so with
own counts u a link needs (100 + p) min(n - u) >= p (n + n').  That bound is
exact and costs one count per shingle.  The same join compares four bits of
256 registers and drops pairs whose sketches differ in more registers than
five standard errors allow, so the pairs between a large group and the
documents just outside it are not written out.

Defined results: null, empty and blank texts have an empty set, are linked
with nothing and are kept; rows with equal ids are versions of one document;
rows with a null id have no component and are kept; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodweave.llm.common import proven_small, written
from moodweave.llm.graph import components, merge_components

PERCENT = 80
BANDS, ROWS = 44, 6
REGISTERS = BANDS * ROWS
SEEDS, BUCKETS = 8, 33          # of large sets; SEEDS * BUCKETS == REGISTERS
SMALL, LARGE = 640, 512         # LARGE <= PERCENT / 100 * SMALL
MANTISSA = 10
# Fixed value: accidental register collisions of a bucket are about this, times 2 ** -MANTISSA.
COLLISION = 0.169919487159739093975315012348630288992889
LEAST_ESTIMATE = PERCENT / 100 - 5 * (PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS) ** 0.5
WORDS64, PLANES = 4, 4           # the low bits of 64 * WORDS64 registers, one plane of words per bit
_ALIKE = PERCENT / 100 + (1 - PERCENT / 100) / 2 ** PLANES
MOST_DIFFERENT = int(64 * WORDS64 * (1 - _ALIKE) + 5 * (64 * WORDS64 * _ALIKE * (1 - _ALIKE)) ** 0.5)
CACHED_WORDS = 300_000
SEMI_ROWS = 1_000_000           # ids (8 bytes each) that may be broadcast

_U = np.uint64
_rng = np.random.default_rng(20)
_MUL = _rng.integers(0, 2 ** 63, REGISTERS, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 2 ** 63, REGISTERS, dtype=np.uint64) * _U(2)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(31))) * _U(0x9FB21C651E98DF25)
    return (x ^ (x >> _U(28))) * _U(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hash of a word, remembered; the memory is emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, hashes: WordHashes, width: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text (bytes.lower touches A-Z only)."""
    words = text.lower().split() if text else ()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    g = _mix(h[:len(h) - n + 1] + _U(n))
    for k in range(1, n):
        g = _mix(g + h[k:len(h) - n + 1 + k])
    g.sort()
    return g[np.concatenate(([True], g[1:] != g[:-1]))]


def registers(smallest: np.ndarray) -> bytes:
    """Leading-zero counts and mantissas of 64-bit minima as 16-bit registers."""
    m, e = np.frexp(smallest.astype(np.float64))
    zeros = np.clip(64 - e, 0, 63).astype(np.uint16)
    mantissa = ((m * 2 - 1) * (1 << MANTISSA)).clip(0, (1 << MANTISSA) - 1).astype(np.uint16)
    return ((zeros << MANTISSA) | mantissa).astype("<u2").tobytes()


def small_sketch(g: np.ndarray) -> bytes:
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(g), 64):
        x = g[at:at + 64, None] * _MUL[None, :]
        x += _ADD[None, :]
        np.minimum(low, x.min(axis=0), out=low)
    return registers(low)


def large_sketch(g: np.ndarray) -> bytes:
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(SEEDS):
        x = _mix(g * _MUL[k] + _ADD[k])
        bucket = ((x >> _U(32)) * _U(BUCKETS) >> _U(32)).astype(np.int64)
        np.minimum.at(low[k * BUCKETS:(k + 1) * BUCKETS], bucket, x * _U(0xA0761D6478BD642F))
    return registers(low)


def bit_planes(sketch: bytes) -> np.ndarray:
    """The low PLANES bits of the first registers as 64-bit words, plane by plane."""
    r = np.frombuffer(sketch, "<u2")[:64 * WORDS64]
    return np.concatenate([np.packbits((r >> b) & 1).view(np.int64) for b in range(PLANES)])


_PLANE_COLUMNS = [f"p{k}" for k in range(PLANES * WORDS64)]


def _planes(batches):
    for batch in batches:
        ids, versions, kinds, words = [], [], [], []
        for doc_id, version, *sketches in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for kind, x in enumerate(sketches):
                if x is not None:
                    ids.append(doc_id)
                    versions.append(version)
                    kinds.append(kind)
                    words.append(bit_planes(x))
        words = np.array(words, np.int64).reshape(-1, len(_PLANE_COLUMNS))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(kinds, pa.int32()),
                                          *(pa.array(words[:, k]) for k in range(words.shape[1]))],
                                         names=["doc_id", "version", "kind", *_PLANE_COLUMNS])


def _different(x: str, y: str):
    """How many of the compared registers of two rows differ in a kept bit."""
    total = F.lit(0)
    for w in range(WORDS64):
        mask = None
        for b in range(PLANES):
            diff = F.col(f"{x}.p{b * WORDS64 + w}").bitwiseXOR(F.col(f"{y}.p{b * WORDS64 + w}"))
            mask = diff if mask is None else mask.bitwiseOR(diff)
        total = total + F.bit_count(mask)
    return total


_SKETCH = "doc_id long, n long, sig binary, small binary, large binary"
_SETS = "doc_id long, members binary"


def _texts(batch: pa.RecordBatch):
    return zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True)


def _sketcher(width: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, text in _texts(batch):
                g = shingle_set(text, hashes, width)
                n = len(g)
                row = (doc_id, n, xxhash.xxh3_128_digest(g.tobytes()) if n else None,
                       small_sketch(g) if 0 < n < SMALL else None, large_sketch(g) if n >= LARGE else None)
                for col, v in zip(out, row, strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *(pa.array(c, pa.binary()) for c in out[2:])],
                names=["doc_id", "n", "sig", "small", "large"])

    return run


def _set_maker(width: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, members = [], []
            for doc_id, text in _texts(batch):
                ids.append(doc_id)
                members.append(shingle_set(text, hashes, width).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(members, pa.binary())],
                                             names=["doc_id", "members"])

    return run


def sketch(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, sig, small, large): set size, 128-bit digest of the set, the two kinds of sketch."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_sketcher(width), _SKETCH)


def estimate(small_a, small_b, large_a, large_b, n_a, n_b) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of sketch pairs (1-D object arrays; None where absent)."""
    both_small = np.array([x is not None and y is not None for x, y in zip(small_a, small_b, strict=True)], bool)
    a = b"".join(np.where(both_small, small_a, large_a))
    b = b"".join(np.where(both_small, small_b, large_b))
    same = (np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).reshape(-1, REGISTERS).mean(axis=1)
    ratio = np.maximum(n_a, n_b) / np.maximum(np.minimum(n_a, n_b), 1)
    by_chance = COLLISION * 2.0 ** -MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (same - by_chance) / (1 - by_chance)


def _version(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _version_of(sig: str):
    """``_version`` of a digest column: one text of a document that may have several."""
    return F.conv(F.hex(F.substring(sig, 1, 8)), 16, -10).cast("long").alias("version")


def _shingle_rows(width: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                found = [(d, shingle_set(t, hashes, width)) for d, t in _texts(rows)]
                ids = np.repeat(np.array([d for d, _ in found], np.int64), [len(g) for _, g in found])
                versions = np.repeat(np.array([_version(xxhash.xxh3_128_digest(g.tobytes())) for _, g in found], np.int64),
                                     [len(g) for _, g in found])
                grams = np.concatenate([g for _, g in found]) if found else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(versions), pa.array(grams.view(np.int64))],
                                                 names=["doc_id", "version", "gram"])

    return run


def _estimates(batches):
    for batch in batches:
        t = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        obj = lambda c: np.array([*t[c].to_pylist(), None], object)[:-1]
        na, nb = t["n_a"].to_numpy(), t["n_b"].to_numpy()
        sa, sb, la, lb = obj("small_a"), obj("small_b"), obj("large_a"), obj("large_b")
        comparable = np.array([(p is not None and q is not None) or (r is not None and s is not None)
                               for p, q, r, s in zip(sa, sb, la, lb, strict=True)], bool)
        comparable &= 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
        est = np.zeros(len(na))
        if comparable.any():
            est[comparable] = estimate(sa[comparable], sb[comparable], la[comparable], lb[comparable],
                                       na[comparable], nb[comparable])
        keep = pa.array(est >= LEAST_ESTIMATE)
        yield pa.RecordBatch.from_arrays([t["a"].filter(keep), t["b"].filter(keep), pa.array(est).filter(keep)],
                                         names=["a", "b", "est"])


def _verify(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            w = np.concatenate((u, v))
            w.sort()
            shared = int((w[1:] == w[:-1]).sum())
            keep.append(100 * shared >= PERCENT * (len(u) + len(v) - shared))
        k = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(k), batch.column(1).filter(k)], names=["a", "b"])


class Linker:
    """Candidate pairs, estimates and exact links over one table of documents."""

    def __init__(self, docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text"):
        self.width = width
        self.texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        self.sketches = written(sketch(docs, width, doc_id, text), "minhash-sketches")
        known = self.sketches.where("n > 0 and doc_id is not null")
        self.groups = known.groupBy("sig").agg(F.min("doc_id").alias("rep"))
        reps = self.groups.select(F.col("rep").alias("doc_id")).distinct()
        self.reps = written(known.join(reps, "doc_id", "left_semi").select("doc_id", _version_of("sig"), "n", "small", "large"),
                            "minhash-reps")

    def members(self) -> DataFrame:
        """(key, doc_id, kind) of the band buckets that hold two documents or more; kind 0 is small, 1 large."""
        def keys(c: str, kind: int):
            width = 2 * ROWS
            return F.when(F.col(c).isNotNull(), F.transform(
                F.sequence(F.lit(0), F.lit(BANDS - 1)),
                lambda b: F.struct(F.xxhash64(b, F.lit(kind), F.substring(F.col(c), b * width + 1, F.lit(width)))
                                   .alias("key"), F.lit(kind).alias("kind"))))

        none = F.array().cast("array<struct<key:bigint,kind:int>>")
        every = F.concat(F.coalesce(keys("small", 0), none), F.coalesce(keys("large", 1), none))
        bands = self.reps.select("doc_id", F.explode_outer(every).alias("b")).select("doc_id", "b.key", "b.kind")
        shared = bands.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
        return written(bands.join(shared.select("key"), "key"), "minhash-members")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """(a, b, est) of the pairs whose estimate is not far below the threshold."""
        side = lambda s: self.reps.select(F.col("doc_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "small", "large")))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_estimates, "a long, b long, est double")

    def texts_of(self, ids: DataFrame) -> DataFrame:
        """(doc_id, text) of some ids.  Ids are 8 bytes a row: broadcast up to a counted bound, else a shuffled semi join."""
        return self.texts.join(proven_small(ids, SEMI_ROWS), "doc_id", "left_semi")

    def sizes(self, ids: DataFrame) -> DataFrame:
        """(doc_id, version, n, own): set size of each version of a document, and how many of its shingles no
        other document or version of ``ids`` has."""
        grams = self.texts_of(ids).mapInArrow(_shingle_rows(self.width), "doc_id long, version long, gram long")
        own = grams.groupBy("gram").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"),
                                        F.min("version").alias("version"), F.max("version").alias("last_version")) \
            .where("doc_id = last and version = last_version").groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("own"))
        return ids.join(self.reps.select("doc_id", "version", "n").distinct(), "doc_id") \
            .join(own, ["doc_id", "version"], "left").select("doc_id", "version", "n", F.coalesce("own", F.lit(0)).alias("own"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        pairs = written(pairs.select("a", "b"), "minhash-pairs")
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        sets = self.texts_of(ids).mapInArrow(_set_maker(self.width), _SETS)
        sets = written(sets, "minhash-sets")
        both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), "a") \
            .join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long").distinct()


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.select(F.col("id").alias("doc_id"), F.col("component")), "doc_id", "left") \
        .select("key", "doc_id", "kind", F.coalesce("component", "doc_id").alias("c"))


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Each member with one hub: distinct (a, b).

    The hub of a bucket is its smallest member; of its hubs a member takes the
    one that it meets in most buckets, which has the best estimate among them.
    """
    hubs = members.groupBy("key").agg(F.min("doc_id").alias("hub"))
    return _best_hub(members.join(hubs, "key").where("doc_id <> hub").select("doc_id", "hub"))


def _best_hub(pairs: DataFrame) -> DataFrame:
    """(a, b): of the (doc_id, hub) rows the hub that a member meets in most buckets, its likely most similar one."""
    votes = pairs.groupBy("doc_id", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("hub")).alias("h"))).alias("m"))
    return best.select(F.greatest("doc_id", -F.col("m.h")).alias("a"), F.least("doc_id", -F.col("m.h")).alias("b")).distinct()


def _other_hubs(rest: DataFrame) -> DataFrame:
    """Each member of a mixed bucket with one member of another component: distinct (a, b).

    A bucket offers the first member, in an order of its own, of another
    component, so members of one component try many members of the others.
    """
    order = F.xxhash64("key", "doc_id")
    first = rest.groupBy("key", "c").agg(F.min(F.struct(order.alias("o"), F.col("doc_id").alias("hub"))).alias("f"))
    one = first.groupBy("key").agg(F.min(F.struct("f", "c")).alias("m1"))
    two = first.join(one, "key").where(F.col("c") != F.col("m1.c")).groupBy("key", "m1").agg(F.min("f").alias("m2"))
    hub = F.when(F.col("c") != F.col("m1.c"), F.col("m1.f.hub")).otherwise(F.col("m2.hub"))
    return _best_hub(rest.join(two, "key").select("doc_id", hub.alias("hub")))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, doc_id, kind, c) of the buckets whose members are in more than one component."""
    at = written(_labelled(members, labels), "minhash-labelled")
    mixed = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    return written(at.join(mixed, "key"), "minhash-rest")


def find_links(linker: Linker) -> DataFrame | None:
    """(id, component) of the representatives that are linked with another, or None if there are none."""
    members = linker.members()
    if members.isEmpty():
        return None
    labels = components(linker.links(linker.likely(_hub_pairs(members))))
    labels = merge_components(labels, linker.links(linker.likely(_other_hubs(_mixed(members, labels)))))
    labels = written(labels, "minhash-components")
    rest = _mixed(members, labels)
    ids = written(rest.select("doc_id").distinct(), "minhash-ids")
    kinds = "doc_id long, version long, kind int, " + ", ".join(f"{c} long" for c in _PLANE_COLUMNS)
    planes = linker.reps.join(ids, "doc_id", "left_semi").select("doc_id", "version", "small", "large").mapInArrow(_planes, kinds)
    # a row per version of a document and kind: size, own shingles, bit planes
    facts = written(planes.join(linker.sizes(ids), ["doc_id", "version"]), "minhash-facts")
    rest = rest.join(facts, ["doc_id", "kind"])
    x, y = rest.alias("x"), rest.alias("y")
    most = F.least(F.col("x.n") - F.col("x.own"), F.col("y.n") - F.col("y.own"))
    possible = (100 + PERCENT) * most >= PERCENT * (F.col("x.n") + F.col("y.n"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.doc_id") > F.col("y.doc_id"))
                   & (F.col("x.c") != F.col("y.c")) & possible & (_different("x", "y") <= MOST_DIFFERENT)) \
        .select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    return merge_components(labels, linker.links(linker.likely(pairs)))


def near_duplicates(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: (doc_id, n_shingles, component_id, kept)."""
    linker = Linker(docs, width, doc_id, text)
    labels = find_links(linker)
    sizes = linker.sketches.select("doc_id", "n", "sig").join(linker.groups, "sig", "left")
    # versions of one document: rows that share an id share a component
    if labels is None:
        labelled = sizes.withColumn("component_id", F.coalesce("rep", "doc_id"))
    else:
        labels = labels.select(F.col("id").alias("rep"), "component")
        labelled = sizes.join(labels, "rep", "left").withColumn("component_id", F.coalesce("component", "rep", "doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
                           F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, unchanged."""
    gone = near_duplicates(docs, width, doc_id, text).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    # joined by attribute, so a column of the same name in ``docs`` is harmless
    return docs.join(proven_small(gone, SEMI_ROWS), docs[doc_id] == gone["gone_id"], "left_anti")
