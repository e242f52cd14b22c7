"""Secret scanning with an incremental blob ledger.

Every version of every text is addressed by the SHA-256 of its content.  A
blob is scanned once per rule version: pairs already in the ledger are
skipped, the rest are scanned, and the findings are joined back to all rows
(paths) that hold the blob.

Positions come from two linear regular-expression passes: the pieces between
matches (``split``) and the matches themselves (``regexp_extract_all``) have
lengths whose running sum gives every start, so no Python code is needed.

Defined results: a null text is the empty text; empty texts have no findings;
repeated rows each get the findings of their blob; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int       # the group whose length is tested
    least: int       # fewest characters of that group
    version: int = 1


# Secret kinds in reporting order.  The first three are the base rules.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 24),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    # a run that is no token is consumed whole, with an empty group, so that it is read once
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)|eyJ[A-Za-z0-9_-]++", 1, 30),
)
BASE_KINDS = 3
# A rule whose matches must be long is first looked for by its long form, which most texts lack.
_LOOK = {"hex": r"[0-9a-f]{24}", "access": r"AKIA[A-Z0-9]{16}"}


def content_address(docs: DataFrame, text: str = "text"):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def blobs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct texts: (blob, text).  Copies are combined before the shuffle."""
    rows = docs.select(content_address(docs, text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.groupBy("blob").agg(F.first("text").alias("text"))


def pending(content: DataFrame, scanned: DataFrame | None, rules=RULES) -> DataFrame:
    """Add ``todo``: the rule indexes not yet scanned for the blob (all without a ledger).

    ``scanned`` is a ledger of (blob, kind, version) pairs.
    """
    every = F.array(*[F.lit(k) for k in range(len(rules))])
    if scanned is None:
        return content.withColumn("todo", every)
    done = scanned.select("blob", _rule_index(rules).alias("k")).where(F.col("k").isNotNull()) \
        .groupBy("blob").agg(F.collect_set("k").alias("done"))  # at most one value per rule
    none = F.array().cast("array<int>")
    return content.join(done, "blob", "left") \
        .withColumn("todo", F.array_except(every, F.coalesce("done", none))).drop("done") \
        .where(F.size("todo") > 0)


def _rule_index(rules):
    """The place in ``rules`` of the columns (kind, version); null for any other pair."""
    index = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (f"{r.kind}/{r.version}", k)])
    return F.get(F.array(index), F.lit(0))[F.concat_ws("/", "kind", "version")]


def current(known: DataFrame, rules=RULES) -> DataFrame:
    """Findings of earlier runs that the present rules stand by, with the rules' present places.

    What another version of a rule found, or a rule that is gone, is left out: the present version
    scans the blob anew.
    """
    return known.withColumn("k", _rule_index(rules)).where(F.col("k").isNotNull())


def scan(todo: DataFrame, rules=RULES) -> DataFrame:
    """Findings (blob, kind, version, k, start, stop) of the pending pairs; stop is exclusive, in code points."""
    text = F.col("text")

    def pieces(k: int, r: Rule):
        whole = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
        tested = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group))
        z = F.arrays_zip(F.slice(F.split(text, r.pattern), F.lit(1), F.size(whole)).alias("gap"),
                         whole.alias("hit"), tested.alias("part"))
        row = F.transform(z, lambda x, i: F.struct(
            F.lit(k).alias("k"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("n"),
            (F.length(x["part"]) >= r.least).alias("ok")))
        look = F.array_contains("todo", k) & text.rlike(_LOOK.get(r.kind, r.pattern))
        return F.when(look, row)

    empty = F.array().cast("array<struct<k:int,i:int,gap:int,n:int,ok:boolean>>")
    hits = todo.select("blob", F.concat(*[F.coalesce(pieces(k, r), empty) for k, r in enumerate(rules)]).alias("hits"))
    # explode_outer: a plain explode adds a size filter that would run the patterns twice
    one = hits.select("blob", F.explode_outer("hits").alias("x")).where(F.col("x").isNotNull()).select("blob", "x.*")
    before = Window.partitionBy("blob", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = one.withColumn("stop", F.sum(F.col("gap").cast("long") + F.col("n")).over(before)).where("ok")
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    versions = F.array(*[F.lit(r.version) for r in rules])
    return placed.select("blob", F.get(kinds, F.col("k")).alias("kind"), F.get(versions, F.col("k")).alias("version"),
                         "k", (F.col("stop") - F.col("n")).alias("start"), "stop")


def scanned_pairs(todo: DataFrame, rules=RULES) -> DataFrame:
    """The (blob, kind, version) pairs that a scan of ``todo`` adds to the ledger."""
    names = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    return todo.select("blob", F.explode("todo").alias("k")).select("blob", F.get(names, F.col("k")).alias("r")) \
        .select("blob", "r.*")


def by_blob(findings: DataFrame) -> DataFrame:
    """Findings of a blob as one ordered array (its size follows that blob's text)."""
    return findings.groupBy("blob").agg(F.sort_array(F.collect_list(
        F.struct("start", "k", "stop", "kind"))).alias("found"))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scanned: DataFrame | None = None,
                 known: DataFrame | None = None, rules=RULES) -> DataFrame:
    """One row per input row: (doc_id, blob, found), found being ordered (start, k, stop, kind) spans.

    ``scanned`` and ``known`` are the pairs and findings of earlier runs; only
    unseen pairs are scanned, and both old and new findings are joined back.
    """
    new = scan(pending(blobs(docs, text), scanned, rules), rules)
    if known is not None:
        new = new.unionByName(current(known, rules).select(new.columns)).distinct()
    none = F.array().cast("array<struct<start:bigint,k:int,stop:bigint,kind:string>>")
    paths = docs.select(F.col(doc_id).alias("doc_id"), content_address(docs, text).alias("blob"))
    return paths.join(by_blob(new), "blob", "left").select("doc_id", "blob", F.coalesce("found", none).alias("found"))


def scan_into(docs: DataFrame, ledger: str, text: str = "text", rules=RULES) -> None:
    """Scan what the ledger in the shared folder ``ledger`` has not seen, and add it there.

    Findings are written before the pairs that they belong to: after a crash in between, the pairs are
    scanned again, and readers take equal findings as one.
    """
    scanned, known = read_ledger(docs.sparkSession, ledger)
    todo = pending(blobs(docs, text), scanned, rules).checkpoint()
    scan(todo, rules).drop("k").write.mode("append").parquet(f"{ledger}/findings")
    scanned_pairs(todo, rules).write.mode("append").parquet(f"{ledger}/pairs")


def read_ledger(spark: SparkSession, ledger: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(scanned pairs, findings) of a ledger; nothing of one that has no pairs yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/pairs/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None, None
    return spark.read.parquet(f"{ledger}/pairs"), spark.read.parquet(f"{ledger}/findings")


def redact(docs: DataFrame, text: str = "text", rules=RULES, mark: str = "[SECRET]") -> DataFrame:
    """Replace every found span (overlapping ones as one) by ``mark``.

    All columns keep their names and order; a text without findings is
    unchanged, a null text stays null.
    """
    found = by_blob(scan(pending(blobs(docs, text), None, rules), rules))
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"),
                       content_address(docs, text).alias("blob")).join(found, "blob", "left")
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out"))
    piece = lambda acc, stop: F.substring(
        F.col("text"), (acc["pos"] + 1).cast("int"), F.greatest(stop - acc["pos"], F.lit(0)).cast("int"))

    def step(acc, x):
        fresh = F.concat(acc["out"], piece(acc, x["start"]), F.lit(mark))
        return F.struct(F.greatest(acc["pos"], x["stop"]).alias("pos"),
                        F.when(x["start"] >= acc["pos"], fresh).otherwise(acc["out"]).alias("out"))

    whole = F.length(F.col("text")).cast("bigint")
    masked = F.aggregate("found", start, step, lambda acc: F.concat(acc["out"], piece(acc, whole)))
    clean = F.when(F.col("found").isNull(), F.col("text")).otherwise(masked)
    return rows.select(*[clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def spans_text(found, base_only: bool = False):
    """'kind:start:stop' of each span, comma-joined."""
    if base_only:
        found = F.filter(found, lambda x: x["k"] < BASE_KINDS)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def count_kind(found, k: int):
    return F.size(F.filter(found, lambda x: x["k"] == k)).cast("long")
