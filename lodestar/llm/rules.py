"""Quality rules by document and by host, in DataFrame functions only.

Every text is measured inside its row (no word is exploded or shuffled). The failures are then summed by host (the
column ``source``) and the hosts' failure rates are shrunk towards a beta prior: its mean is the share of all documents
that fail, its weight the one that explains how far the hosts' rates lie apart beyond what chance does to hosts of their
sizes (moments of the beta-binomial law, each host weighing as many documents as it has). A host is rejected, with its
documents, if its posterior puts more than ``CONFIDENCE`` standard deviations between its mean and ``host_limit``.

Defined cases: null and empty text has no words and fails; very long texts are measured whole; a null host has no verdict,
so its documents stand on their own; repeated rows count each, ties of rates need no order; an empty table gives an empty
result. If hosts lie no further apart than chance allows, nearly all weight is the prior's (``HEAVIEST`` documents); it
never weighs less than one document. ``keep_good`` carries rows as one struct, so columns of any name come through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import SPACES, text_of, words_of
from lodestar.sources.workspace import materialize

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
HOST_LIMIT, CONFIDENCE, LIGHTEST, HEAVIEST = 0.5, 1.645, 1.0, 1e6
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _covered(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, by sorting the windows of the one text."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    n = F.size(hashes)
    before = F.zip_with(
        ordered,
        F.concat(F.array(F.lit(None).cast("struct<h:bigint,p:int>")), F.slice(ordered, 1, n - 1)),
        lambda a, b: F.struct(a["h"].alias("h"), a["p"].alias("p"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("e")),
    )
    twice = F.zip_with(
        before, F.slice(ordered, 2, n), lambda a, b: F.when(a["e"] | F.coalesce(a["h"] == b["h"], F.lit(False)), a["p"])
    )
    places = F.sort_array(F.array_compact(twice))
    steps = F.zip_with(places, F.slice(places, 2, n), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def measure(docs: DataFrame, text: str = "text", metrics: Sequence[str] = METRICS) -> DataFrame:
    """``docs`` with the five counts, or some of them, and ``base_failed``; columns of those names are replaced.

    The counts leave through a generator of one row: a filter on them is not pushed below it, where each of the nested
    array expressions would be made again for every use.
    """
    keep = [c for c in docs.columns if c not in (*METRICS, "base_failed")]
    rows = docs.select(*[f"`{c}`" for c in keep], text_of(text).alias("__text"))
    rows = rows.withColumn("__words", words_of(F.col("__text"))).withColumn("__n", F.size("__words"))
    h = F.transform("__words", lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        rows = rows.withColumn("__h", h)
        h = F.zip_with("__h", F.slice("__h", step + 1, F.col("__n")), lambda a, b: F.xxhash64(a, b))
    rows = rows.withColumn(
        "__h", F.when(F.col("__n") >= WINDOW, F.slice(h, 1, F.greatest(F.col("__n") - (WINDOW - 1), F.lit(0))))
    )
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    rows = rows.withColumn("__lines", lines)
    repeated = F.coalesce(F.size(F.array_distinct("__h")) < F.size("__h"), F.lit(False))
    counts = {
        "n_words": F.col("__n"),
        "word_chars": F.length(F.array_join("__words", "")),
        "n_symbols": F.length("__text") - F.length(F.regexp_replace("__text", SYMBOLS, "")),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.when(repeated, _covered(F.col("__h"))).otherwise(0),
    }
    one = F.struct(*[c.cast("long").alias(k) for k, c in counts.items() if k in metrics])
    rows = rows.select(*[f"`{c}`" for c in keep], F.inline(F.array(one)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def prior(hosts: DataFrame) -> tuple[float, float]:
    """(mean, weight) of the beta prior from rows (n, failed), one of each host; five sums reach the driver."""
    n, f = F.col("n"), F.col("failed")
    got = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(n * n.cast("double")).alias("nn"), F.sum(f * f / n).alias("ff")).first()
    if not got["n"]:
        return 0.0, HEAVIEST
    mean = got["f"] / got["n"]
    spread, chance = got["ff"] - got["f"] * mean, mean * (1 - mean)
    room = got["n"] - got["nn"] / got["n"] - (got["k"] - 1)
    alike = (spread - chance * (got["k"] - 1)) / (chance * room) if chance > 0 and room > 0 else 0.0
    return mean, min(max(1 / alike - 1, LIGHTEST), HEAVIEST) if alike > 0 else HEAVIEST


def rejected_hosts(measured: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row (``host``, ``host_rate``) for each host whose posterior lies above the limit; the rate is its mean."""
    hosts = (
        measured.filter(F.col(f"`{host}`").isNotNull())
        .groupBy(F.col(f"`{host}`").alias("host"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("failed"))
    )
    hosts = materialize(hosts, "hosts", share=8)
    mean, weight = prior(hosts)
    total = F.col("n") + F.lit(weight)
    rate = (F.col("failed") + F.lit(mean * weight)) / total
    sure = F.col("host_rate") - CONFIDENCE * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (total + 1)) > host_limit
    return hosts.withColumn("host_rate", rate).filter(sure).select("host", "host_rate")


def with_verdict(measured: DataFrame, rejected: DataFrame, host: str = "source") -> DataFrame:
    """``measured`` with ``kept``. The join is by host and left to the adaptive planner: broadcast once the rejected
    hosts are known to be few, else sort-merge with its hot partitions split."""
    hosts = rejected.select(F.col("host").alias("__host"), F.lit(True).alias("__out"))
    joined = measured.join(hosts, F.col(f"`{host}`") == F.col("__host"), "left")
    kept = ~F.col("base_failed") & F.col("__out").isNull()
    return joined.select(*[f"`{c}`" for c in measured.columns if c != "kept"], kept.alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with their own columns.

    Texts are measured once: what they and their hosts failed is written with the rows themselves, those that failed
    without their columns, and the verdicts on hosts join what is left.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    renamed = docs.select(row.alias("__row"), text_of(text).alias("__in"), F.col(f"`{host}`").cast("string").alias("__at"))
    measured = measure(renamed, "__in", ("n_words", "n_repeat_words")).select(F.when(~F.col("base_failed"), F.col("__row")).alias("__row"), "__at", "base_failed")
    measured = materialize(measured, "measured")
    rejected = rejected_hosts(measured, "__at")
    return with_verdict(measured.filter("not base_failed"), rejected, "__at").filter("kept").select("__row.*")
