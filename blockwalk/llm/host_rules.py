"""Quality rules per document and per host.

Counts of each text are column arithmetic: words, symbols, repeated lines, and the words inside 3-word windows that the
text repeats. For the last, each window's 64-bit hash is shifted and its position put into the free bits; one in-row
sort then puts equal windows side by side, and neighbours name the positions that may repeat. Only their windows are then sorted by
their words, which settles it: a hash that two windows share by chance counts nothing. Nothing is exploded or shuffled.

Failures of each rule are summed per host with partial aggregation. A host's failure rate is shrunk by a beta prior that
is fitted to all hosts by the method of moments, so a host with few documents is judged by the prior. A host
fails a rule where its shrunk rate is over ``HOST_LIMIT``; its documents all go.

Cases: a null text has no words and fails; a null host has no host verdict; a table of one host has a prior of its mean
with the strength of one document; repeated rows count as often as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwalk.functions.geo import let
from blockwalk.llm.common import SPACE, cut, squeezed, texts

MIN_WORDS = 50
HOST_LIMIT = 0.8
BROADCAST_HOSTS = 100_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


#: SQL conditions over the counts. The first two are the base; hosts are judged by all four.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "3 * n_dup_lines > n_lines",
}

BASE = ("short", "repeats")


def repeat_words(words: Column) -> Column:
    """Words covered by a 3-word window that stands in the text twice or more, the first included.

    ``let`` binds what the lambdas read per element; otherwise the optimizer would copy its making into them.
    """

    def marked(w: Column, bits: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.call_function(
            "shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")))

    def same(a: Column, b: Column, mask: Column) -> Column:
        return F.coalesce(a.bitwiseXOR(b).between(F.lit(0), mask), F.lit(False))

    def repeated(s: Column, mask: Column) -> Column:
        kept = F.filter(s, lambda x, i: same(F.get(s, i - 1), x, mask) | same(F.get(s, i + 1), x, mask))
        return F.sort_array(F.transform(kept, lambda x: x.bitwiseAND(mask)))

    def confirmed(p: Column, w: Column) -> Column:
        window = lambda i: F.concat_ws(" ", *[F.get(w, i.cast("int") + k) for k in range(3)])
        told = F.sort_array(F.transform(p, lambda i: F.struct(window(i).alias("t"), i.alias("i"))))
        return let(told, lambda s: F.sort_array(F.transform(F.filter(
            s, lambda x, i: F.coalesce(F.get(s, i - 1)["t"] == x["t"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["t"] == x["t"], F.lit(False))), lambda x: x["i"])))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(3).cast("long")), F.lit(3).cast("long")))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def counted(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w)))
        room = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        found = let(bits, lambda b: let(F.sort_array(marked(w, b)), lambda s: let(room, lambda mask: let(repeated(s, mask), lambda p: let(confirmed(p, w), covered)))))
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(found)

    return let(words, counted)


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the counts of its text, under names that start with ``prefix``."""
    body = F.coalesce(F.col(text), F.lit(""))
    clean = F.trim(squeezed(body))
    out = docs.withColumn("__clean", clean) \
        .withColumn("__words", F.when(F.col("__clean") == "", F.array().cast("array<string>")).otherwise(F.split("__clean", " ", -1))) \
        .withColumn("__n", F.size("__words"))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    out = out.withColumn("__lines", lines)
    counts = {
        "n_words": F.col("__n"), "word_chars": F.length("__clean") - F.greatest(F.col("__n") - 1, F.lit(0)),
        "n_symbols": F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]", "")),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")), "n_lines": F.size("__lines"),
        "n_repeat_words": repeat_words(F.col("__words")),
    }
    return out.withColumns({prefix + k: v.cast("long") for k, v in counts.items()}).drop("__clean", "__words", "__n", "__lines")


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, counts, base_failed), one row per row of ``docs``."""
    rows = with_counts(texts(docs, F.col(host).alias("host")))
    return rows.select("doc_id", "host", *COUNTS, "n_lines", F.expr(" OR ".join(RULES[k] for k in BASE)).alias("base_failed"))


def host_verdicts(rows: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n, rate_<rule>, host_failed) from the rows of ``measured``."""
    hosts = rows.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("n"), *[F.sum(F.expr(f"CASE WHEN {c} THEN 1 ELSE 0 END")).alias(f"f_{k}") for k, c in RULES.items()])
    hosts = cut(hosts)
    # beta prior of each rule, by moments over hosts: mean and spread of the observed rates
    shares = [f"f_{k} / n" for k in RULES]
    prior = hosts.agg(*[x for k, s in zip(RULES, shares, strict=True)
                        for x in (F.avg(F.expr(s)).alias(f"m_{k}"), F.var_pop(F.expr(s)).alias(f"v_{k}"))]).first()
    out = hosts
    bad = F.lit(False)
    for k in RULES:
        mean, spread = prior[f"m_{k}"] or 0.0, prior[f"v_{k}"] or 0.0
        strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4) if spread > 0 else 1.0
        rate = (F.col(f"f_{k}") + mean * strength) / (F.col("n") + strength)
        out = out.withColumn(f"rate_{k}", rate)
        bad = bad | (F.col(f"rate_{k}") > limit)
    return out.withColumn("host_failed", bad)


def judged(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """(doc_id, counts, base_failed, host_failed, kept), one row per row of ``docs``."""
    rows = cut(measured(docs, host))
    hosts = host_verdicts(rows, limit).select("host", "host_failed")
    failed = F.coalesce("host_failed", F.lit(False))
    return rows.join(hosts, "host", "left").select(
        "doc_id", *COUNTS, "base_failed", failed.alias("host_failed"), (~F.col("base_failed") & ~failed).alias("kept"))


def kept_rows(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that pass, with its own columns."""
    counted = with_counts(docs, prefix="__q_")
    names = (*COUNTS, "n_lines")
    seen = counted.select(F.col(host).alias("host"), *[F.col(f"__q_{c}").alias(c) for c in names])
    bad_hosts = cut(host_verdicts(seen, limit).where("host_failed").select(F.col("host").alias("__host")))
    n = bad_hosts.count()
    failed = " OR ".join(RULES[k] for k in BASE).replace("n_", "__q_n_")
    passed = counted.where(~F.expr(failed))
    if n:
        # few hosts fail: texts stay where they are; beyond the bound the adaptive join splits a large host
        side = F.broadcast(bad_hosts) if n <= BROADCAST_HOSTS else bad_hosts
        passed = passed.join(side, F.col(host) == F.col("__host"), "left_anti")
    return passed.select(*docs.columns)
