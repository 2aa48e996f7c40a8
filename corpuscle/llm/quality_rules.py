"""Quality rules on documents and their hosts, in DataFrame functions only.

Each document is measured and judged by a base rule and by further rules; failures are then
counted by host, and a host's failure rate under a rule is shrunk towards the rate of all
hosts by a beta prior, whose two parameters come from the hosts themselves (mean and
between-host variance, less the sampling variance).  A host with a shrunk rate over
``host_limit`` under any rule fails; its documents aren't kept, nor are those that fail the
base rule.

Null texts have no words (and so fail); null hosts are one host of their own; repeated rows
count each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.support import written

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
HOST_LIMIT = 0.5


def rules() -> dict[str, Column]:
    """What fails each rule that is counted by host."""
    return {
        "base": F.col("base_failed"),
        "symbols": F.col("n_words") < F.col("n_symbols") * 2,
        "lines": F.col("n_words") < F.col("n_dup_lines") * 10,
    }


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host and the measures of every text."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    with_words = F.filter(F.split("t", "\n"), lambda line: F.translate(line, SPACES, "") != "")
    words = text.select(
        "doc_id", "host", with_words.alias("lines"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(F.filter(F.split("t", SPACE), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("h"),
    )
    windows = F.when(F.size("h") < WINDOW, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))
    )
    counted = words.select(
        "doc_id", "host", F.size("h").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("w"),
    )
    # Only texts that have a window twice sort theirs.
    paired = F.when(F.size("w") == F.size(F.array_distinct("w")), F.lit(None)).otherwise(F.sort_array(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ranked = counted.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", paired.alias("s"))
    same = lambda x, k: F.coalesce(F.get("s", k)["h"] == x["h"], F.lit(False))
    again = F.filter("s", lambda x, k: same(x, k - 1) | same(x, k + 1))
    placed = ranked.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.sort_array(F.transform(again, lambda x: x["i"])).alias("p"))
    # A window covers its five words, less those that the next one covers.
    covered = F.aggregate(F.transform("p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    out = placed.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def beta_prior(n: float, hosts: float, nn: float, failures: float, squares: float) -> tuple[float, float]:
    """Mean and strength of the beta prior of hosts' failure rates.

    ``n`` documents on ``hosts`` hosts, ``nn`` the sum of squared host sizes, ``squares`` the sum of
    failures squared over documents.  The strength is a number of documents, from 1 to a million.
    """
    if not n:
        return 0.0, 1.0
    mean = failures / n
    noise, spread = mean * (1 - mean), n - nn / n
    between = (squares - n * mean * mean - (hosts - 1) * noise) / spread if spread > 0 else 0.0
    return mean, min(1e6, max(1.0, noise / between - 1)) if between > 0 else 1e6


def host_verdicts(documents: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """host, documents, and under each rule the failures and the shrunk rate; host_failed."""
    named = rules()
    hosts = documents.groupBy("host").agg(F.count("*").alias("documents"), *[F.sum(rule.cast("int")).alias(f"{name}_failures") for name, rule in named.items()])
    # Over all hosts: mean, and the between-host variance by the method of moments.  One row of sums.
    sums = hosts.agg(F.sum("documents").cast("double").alias("n"), F.count("*").cast("double").alias("k"), F.sum(F.col("documents").cast("double") * F.col("documents")).alias("nn"), *[
        x for name in named for x in (
            F.sum(f"{name}_failures").cast("double").alias(f"{name}_f"),
            F.sum(F.col(f"{name}_failures") * F.col(f"{name}_failures") / F.col("documents")).alias(f"{name}_ff"),
        )
    ]).first()
    prior = {name: beta_prior(sums["n"] or 0.0, sums["k"], sums["nn"] or 0.0, sums[f"{name}_f"] or 0.0, sums[f"{name}_ff"] or 0.0) for name in named}
    shrunk = hosts
    for name, (mean, strength) in prior.items():
        shrunk = shrunk.withColumn(f"{name}_rate", (F.col(f"{name}_failures") + mean * strength) / (F.col("documents") + strength))
    failed = F.greatest(*[F.col(f"{name}_rate") for name in named]) > host_limit
    return shrunk.select("host", "documents", *[c for name in named for c in (f"{name}_failures", f"{name}_rate")], failed.alias("host_failed"))


def quality_rules(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """The measures of every document with base_failed, host_failed and kept."""
    documents = written(measured(docs), "quality")  # narrow rows; the texts are read once
    hosts = host_verdicts(documents, host_limit).select(F.col("host").alias("of_host"), "host_failed")
    joined = documents.join(hosts, F.col("host").eqNullSafe(F.col("of_host")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
