"""Secret scans over every version of every path, each content scanned once.

A version's text is addressed by its SHA-256 (the blob). A ledger holds the (blob, rule, version) pairs
that have been scanned. A run scans one row of each blob for the rules whose current version the ledger lacks,
appends what it scanned, and joins the findings back to all rows that carry the blob.

Everything is SQL functions. A rule's matches come from one pattern that captures the gap before a match
together with the match (``\\G`` ties it to the end of the one before), so offsets are running sums of lengths
in code points. Rows of one blob are found through its least id, so a blob that many rows share is read once and
texts travel by id, never by a hot key.

Cases: a null text is empty; an empty text has no findings; an empty table gives empty results; rows that repeat an
id are separate versions; null ids are matched to each other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwalk.functions.geo import let
from blockwalk.llm.common import cut, texts


@dataclass(frozen=True)
class Rule:
    """``pattern`` in Java syntax, without repeated groups: the matcher calls itself for each turn of one, and a long text ends the executor. Its group ``measured`` (0: the match) must have ``least`` characters, or the match is dropped.
    ``hint`` is a cheap pattern that every text with a match satisfies."""

    kind: str
    version: int
    pattern: str
    measured: int
    least: int
    hint: str


#: The base rules, in the order in which findings at one place are listed, then the rules added here.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         r"""(?i:word|passwd|secret|token|key)["']?\x20*[:=]"""),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
    Rule("pem", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[opsu]_[A-Za-z0-9]+", 0, 40, r"gh[opsu]_[A-Za-z0-9]{36}"),
)

BASE = ("assign", "access", "hex")

LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule", T.StringType()),
                       T.StructField("version", T.IntegerType())])


def blob_of(text: Column) -> Column:
    return F.sha2(text, 256)


def _parts(text: Column, rule: Rule) -> tuple[Column, Column, Column]:
    """Arrays over the matches: the gap before, the match, and what the rule measures."""
    whole = F.lit(rf"\G((?s:.*?))({rule.pattern})")
    get = lambda group: F.regexp_extract_all(text, whole, F.lit(group))
    return get(1), get(2), get(2 + rule.measured)


def _lengths(text: Column, rule: Rule) -> Column:
    """Of each match: characters of the gap, of the match, and whether it counts."""
    gaps, found, measured = _parts(text, rule)
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), measured.alias("measured"))
    one = lambda x: F.struct(
        F.lit(rule.kind).alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"),
        (F.length(x["measured"]) >= rule.least).alias("counts"))
    return F.when(text.rlike(rule.hint), F.transform(zipped, one))


def unseen(docs: DataFrame, rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """(id, blob, rules): one row of each blob that some rule has not scanned yet."""
    least = docs.groupBy("blob").agg(F.min("doc_id").alias("id"))
    if ledger is None:
        return least.withColumn("rules", F.array(*[F.lit(r.kind) for r in rules]))
    wanted = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules]))
    open_ = least.select("blob", "id", wanted.alias("w")).select("blob", "id", "w.rule", "w.version") \
        .join(ledger, ["blob", "rule", "version"], "left_anti")
    return open_.groupBy("blob", "id").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, rules=RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, scanned): findings are (blob, kind, start, end), end exclusive; scanned has the ledger's columns.

    Findings of earlier runs stay where the caller stored them; append both results to the stored tables.
    """
    rows = texts(docs).withColumn("blob", blob_of(F.col("text")))
    todo = unseen(rows, rules, ledger)
    left, right = rows.alias("l"), todo.alias("r")
    picked = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.id")) & (F.col("l.blob") == F.col("r.blob"))) \
        .select("l.blob", "l.doc_id", "l.text", "r.rules")
    each = F.array(*[F.when(F.array_contains("rules", r.kind), _lengths(F.col("text"), r)) for r in rules])
    hits = picked.select("blob", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("of_rule")) \
        .select("blob", F.posexplode("of_rule").alias("pos", "m")) \
        .select("blob", "pos", "m.kind", "m.gap", "m.hit", "m.counts") \
        .dropDuplicates(["blob", "kind", "pos"])  # the same row given twice
    upto = Window.partitionBy("blob", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.col("gap") + F.col("hit")).over(upto)
    findings = hits.select("blob", "kind", (ends - F.col("hit")).alias("start"), ends.alias("end"), "counts") \
        .where("counts").drop("counts")
    scanned = todo.select("blob", F.explode("rules").alias("rule"))
    versions = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    return findings, scanned.withColumn("version", versions[F.col("rule")])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then by the rule's place."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def by_row(docs: DataFrame, findings: DataFrame, rules=RULES) -> DataFrame:
    """Findings joined back to every row: counts of the base kinds, the digest of base spans, and all spans."""
    place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    span = F.struct("start", place[F.col("kind")].alias("place"), "end", "kind")
    counts = [F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n_{k}") for k in BASE]
    per_blob = findings.groupBy("blob").agg(*counts, F.array_sort(F.collect_list(span)).alias("found"))
    base = F.filter("found", lambda x: x["place"] < len(BASE))
    per_blob = per_blob.select("blob", *[f"n_{k}" for k in BASE], joined(base).alias("base"), joined(F.col("found")).alias("spans"))
    rows = texts(docs).select("doc_id", blob_of(F.col("text")).alias("blob"))
    return rows.join(per_blob, "blob", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), "blob")


def masked(text: Column, rules=RULES) -> Column:
    """The text with each counted match replaced by its kind in brackets; rule after rule, each on what the one before left."""
    for rule in rules:
        text = let(text, partial(_mask_one, rule))
    return text


def _mask_one(rule: Rule, text: Column) -> Column:
    gaps, found, measured = _parts(text, rule)
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), measured.alias("measured"))
    written = F.array_join(F.transform(zipped, lambda x: F.concat(
        x["gap"], F.when(F.length(x["measured"]) >= rule.least, F.lit(f"[{rule.kind}]")).otherwise(x["hit"]))), "")
    used = F.aggregate(zipped, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"]))
    rest = F.substring(text, used + 1, F.length(text))
    return F.when(text.rlike(rule.hint), F.concat(written, rest)).otherwise(text)


def scan_in_turns(batches: list[DataFrame], rules=RULES, ledger: DataFrame | None = None, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger) after one batch of versions after another: each turn scans what the ledger lacks, and both tables grow by its results."""
    for docs in batches:
        found, scanned = map(cut, scan(docs, rules, ledger))
        stored = found if stored is None else stored.unionByName(found)
        ledger = scanned if ledger is None else ledger.unionByName(scanned)
    return stored, ledger


def redacted(docs: DataFrame, rules=RULES, ledger: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, its own columns; texts whose blob has findings are masked.

    With a ledger, ``stored`` must hold the findings of the scans it lists: their blobs are not scanned again, and are masked all the same.
    """
    if ledger is not None and stored is None:
        raise ValueError("a ledger needs the findings of its scans")
    findings, _ = scan(docs, rules, ledger)
    hit = findings.select("blob")
    if stored is not None:
        hit = hit.unionByName(stored.select("blob"))
    hit = hit.distinct()
    blob = blob_of(F.coalesce(F.col("l.text"), F.lit("")))
    rows = docs.alias("l").join(hit.alias("r"), blob == F.col("r.blob"), "left")
    text = F.when(F.col("r.blob").isNotNull(), masked(F.col("l.text"), rules)).otherwise(F.col("l.text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"l.`{c}`") for c in docs.columns])
