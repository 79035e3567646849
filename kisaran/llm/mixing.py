"""Mixing sources to target shares of tokens.

Documents get Efraimidis-Spirakis keys: an exponential variate over the
document's quality weight.  Every source gives its complete epochs first; the
fraction that is left is taken in the order of the keys until its token budget
is used up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kisaran.llm.tokens import VOCABULARY, token_count
from kisaran.session import cut_lineage

#: Targets are read by the driver; beyond this many sources the operator refuses.
MAX_SOURCES = 10_000


def quality(text: Column) -> Column:
    """Weight of a document, 0.05 to 1: the share of letters and blanks, less for
    markup, invisible signs and texts all in capitals."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\s.,]", "")) / F.greatest(F.length(text), F.lit(1))
    markup = F.when(text.rlike(r"<[a-zA-Z/][^>]*>|&[a-z]+;"), 0.25).otherwise(0.0)
    hidden = F.when(text.rlike("[\\u200b-\\u200f\\ufeff\\u00ad]"), 0.15).otherwise(0.0)
    loud = F.when((text == F.upper(text)) & text.rlike(r"\p{L}"), 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.05), F.coalesce(letters - markup - hidden - loud, F.lit(0.05)))


def sampling_key(identity: Column, weight: Column, seed: int) -> Column:
    """Exponential key from a hash of the identity, so that it stands under retries."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), identity), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(uniform) / weight


@dataclass(frozen=True)
class Budget:
    source: str
    target: float
    available: int
    budget: int
    epochs: int
    rest: int


def budgets(targets: list[tuple[str, float, int]], available: dict[str, int]) -> list[Budget]:
    """Budgets of the largest mixture that all repeat caps allow.

    Shares are taken over the sources that have tokens; a source without any
    gets budget 0.  A cap below one allows no token, and so leaves no mixture.
    """
    live = [(s, share, cap) for s, share, cap in targets if share > 0 and available.get(s, 0) > 0]
    whole = sum(share for _, share, _ in live)
    total = min((max(0, cap) * available[s] * whole / share for s, share, cap in live), default=0.0)
    out = []
    for s, share, cap in targets:
        have = available.get(s, 0)
        want = min(int(total * share / whole + 1e-6), max(0, cap) * have) if have and share > 0 and whole else 0
        epochs = want // have if have else 0
        out.append(Budget(s, share, have, want, epochs, want - epochs * have))
    return out


def mix(documents: DataFrame, targets: DataFrame, seed: int = 17, path: str = VOCABULARY, buckets: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    ``selection``: doc_id, source, n_tokens, repeats (how often the document is in
    the mixture).  ``report``: source, target_share, available_tokens,
    mixed_tokens, actual_share, epochs (complete passes) per target.

    NULL and empty texts have no tokens and are left out; so are documents whose
    source is NULL or without target.  doc_id is unique.  Of repeated targets the first by share is
    taken.  Equal keys are ordered by doc_id.  Empty tables give empty results.

    Scale: one pass counts tokens, one sums them by (source, bucket of the key).
    The running total of a source runs over its ``buckets`` sums; documents are
    sorted only inside the one bucket of each source that the budget ends in, so
    a source with a third of all documents never meets in one task.
    """
    want = targets.where("source is not null and target_share is not null").groupBy("source").agg(F.max(F.struct(F.col("target_share").cast("double").alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("cap"))).alias("x"))
    rows = want.select("source", "x.share", "x.cap").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    spark = documents.sparkSession
    base = documents.where("text is not null").select("doc_id", "source", token_count(F.col("text"), path).alias("n_tokens"), sampling_key(F.col("doc_id"), quality(F.col("text")), seed).alias("key"))
    counted = cut_lineage(base.where("n_tokens > 0 and source is not null").withColumn("bucket", F.floor(F.lit(buckets) * F.col("key") / (1 + F.col("key"))).cast("int")))
    sums = cut_lineage(counted.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t")))
    named = sums.where(F.col("source").isin([r["source"] for r in rows])) if rows else sums.limit(0)
    available = {r["source"]: r["t"] for r in named.groupBy("source").agg(F.sum("t").alias("t")).collect()}
    plan = budgets([(r["source"], r["share"], r["cap"]) for r in rows], available)
    table = spark.createDataFrame([(b.source, b.target, b.available, b.epochs, b.rest) for b in plan], "source string, target_share double, available_tokens long, epochs long, rest long")
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most MAX_SOURCES rows, as checked
    levels = sums.join(F.broadcast(table), "source").withColumn("before", F.coalesce(F.sum("t").over(running), F.lit(0)))
    state = levels.select("source", "bucket", "epochs", "rest", "before", (F.col("before") + F.col("t") <= F.col("rest")).alias("inside"), (F.col("before") < F.col("rest")).alias("reached"))
    placed = counted.join(state, ["source", "bucket"])
    edge = placed.where("reached and not inside")
    upto = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edged = edge.withColumn("extra", (F.col("before") + upto <= F.col("rest")).cast("long"))
    sure = placed.where("inside or not reached").withColumn("extra", F.col("inside").cast("long"))
    chosen = sure.unionByName(edged)
    # the document that crosses the budget may be long: one that fits the gap takes its place
    taken = chosen.groupBy("source").agg((F.max("rest") - F.sum(F.col("n_tokens") * F.col("extra"))).alias("gap"))
    fits = chosen.where("extra = 0").join(F.broadcast(taken), "source").where("n_tokens <= gap")
    filler = fits.groupBy("source").agg(F.max_by("doc_id", F.struct("n_tokens", -F.col("key"), "doc_id")).alias("_fill"))
    filled = chosen.join(F.broadcast(filler), "source", "left").withColumn("extra", F.when(F.col("doc_id") == F.col("_fill"), F.greatest(F.lit(1).cast("long"), "extra")).otherwise(F.col("extra")))
    both = filled.withColumn("repeats", F.col("epochs") + F.col("extra")).where("repeats > 0")
    selection = both.select("doc_id", "source", "n_tokens", "repeats")
    mixed = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"))
    report = table.join(mixed, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    share = F.try_divide(F.col("mixed_tokens"), F.sum("mixed_tokens").over(Window.partitionBy()))
    return selection, report.select("source", "target_share", "available_tokens", "mixed_tokens", F.round(share, 6).alias("actual_share"), "epochs")
