"""Mixing sources to target weights by systematic sampling.

Per source: the share of the weights, capped by ``max_repeats`` times its tokens. Every
document's expected copies are laid end to end in a fixed order of its source (prefix sums in
two steps: within hash buckets, then over the bounded table of bucket sums), one offset is
drawn per source, and a copy is emitted for every integer boundary crossed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.session import bounded

#: Buckets that a source is cut into for its prefix sums.
BUCKETS = 4096
#: Most listed sources whose rates are broadcast.
MOST_SOURCES = 100_000


def clean_source(column) -> F.Column:
    """Name trimmed of white space and lower-cased; blank is missing."""
    name = F.lower(F.regexp_replace(column, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(name != "", name)


def clean_targets(targets: DataFrame) -> DataFrame:
    """(source, weight, max_repeats): one row per clean name, weights of one name add up.

    Null, NaN or negative weights count 0, null or negative repeats 0; nameless rows are left out.
    """
    weight = F.when((F.col("weight") > 0) & ~F.isnan("weight"), F.col("weight")).otherwise(F.lit(0.0))
    rows = targets.select(clean_source(F.col("source")).alias("source"), weight.alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    return rows.where("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))


def mix_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, weight, max_repeats, documents, tokens, share, wanted, reachable, copies, short).

    ``sized`` has ``source`` and ``n_tokens``; only listed sources count. T is the tokens of all
    listed documents, ``wanted`` = share * T, ``reachable`` = max_repeats * tokens, ``short``
    says that reachable < wanted. ``copies`` is the expected number of copies of each
    document: min(wanted, reachable) / tokens, 0 for a source without tokens.
    """
    listed = clean_targets(targets)
    sums = sized.groupBy(clean_source(F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce("n_tokens", F.lit(0))).alias("tokens"))
    rows = listed.join(sums, "source", "left").select("source", "weight", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    total = rows.agg(F.sum("weight").alias("all_weight"), F.sum("tokens").alias("all_tokens"))  # one row
    rows = rows.join(F.broadcast(total), F.lit(True))
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(F.lit(0.0))
    wanted = F.when(F.col("all_weight") > 0, F.col("weight") * F.col("all_tokens") / F.col("all_weight")).otherwise(F.lit(0.0))
    rows = rows.withColumn("share", share).withColumn("wanted", wanted).withColumn("reachable", (F.col("max_repeats") * F.col("tokens")).cast("double"))
    copies = F.when(F.col("tokens") > 0, F.least("wanted", "reachable") / F.col("tokens")).otherwise(F.lit(0.0))
    return rows.withColumn("copies", copies).withColumn("short", F.col("reachable") < F.col("wanted")).drop("all_weight", "all_tokens")


def _offset(seed: int):
    """One offset in [0, 1) per source, fixed by the seed."""
    return (F.pmod(F.xxhash64(F.col("source"), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("offset")


def _crossings(sized: DataFrame, plan: DataFrame, seed: int, key: str) -> DataFrame:
    """(key, source, n_tokens, rate, crossed): documents with the integer boundaries that their ``rate`` expected copies cross.

    The copies of a source's documents are laid end to end in a fixed random order, from one random
    offset on. ``plan`` has one row per listed source.
    """
    docs = sized.select(F.col(key), clean_source(F.col("source")).alias("source"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    plan = plan.select("source", "rate")
    docs = docs.join(F.broadcast(plan) if bounded(plan, MOST_SOURCES) else plan, "source")
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(BUCKETS)))
    sums = docs.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = Window.partitionBy("source", "bucket").orderBy(F.xxhash64(F.col(key), F.lit(seed + 1)), F.col(key))
    docs = docs.withColumn("at", F.row_number().over(place) - 1).join(sums, ["source", "bucket"]).withColumn("at", F.col("at") + F.col("before"))
    docs = docs.withColumn("offset", _offset(seed))
    crossed = F.floor((F.col("at") + 1) * F.col("rate") + F.col("offset")) - F.floor(F.col("at") * F.col("rate") + F.col("offset"))
    return docs.select(key, "source", "n_tokens", "rate", crossed.alias("crossed"))


def mix(sized: DataFrame, targets: DataFrame, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """(key, source, n_tokens, copies): documents with how often the mixture takes them, if at all.

    ``sized`` has ``key``, ``source`` and ``n_tokens``. A document of a source with r expected
    copies is taken floor(r) or ceil(r) times, so never more than ``max_repeats``; a source's
    documents together are taken within one of their number times r. Rows with equal keys are
    taken as several documents. Unlisted and nameless sources are not taken.
    """
    plan = mix_plan(sized, targets).where("copies > 0").withColumn("rate", F.col("copies"))
    return _crossings(sized, plan, seed, key).select(key, "source", "n_tokens", F.col("crossed").cast("int").alias("copies")).where("copies > 0")


def short_sources(sized: DataFrame, targets: DataFrame, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """(source): listed sources that cannot reach their share, found by sampling them without the cap.

    Each source is sampled at the rate that its share asks for. If the rate is above ``max_repeats``,
    the boundaries crossed are at least ``max_repeats`` for each document, whatever the offset, so a
    source of which fewer are crossed is not short. Of the sources that the sample finds exhausted, which
    may be off by one copy, the exact sums decide. A source without tokens has nothing to sample and
    is short if it has a share.
    """
    plan = mix_plan(sized, targets)
    asked = plan.where("tokens > 0").withColumn("rate", F.col("wanted") / F.col("tokens"))
    crossed = _crossings(sized, asked, seed, key).groupBy("source").agg(F.sum("crossed").alias("crossed"))
    rows = plan.join(crossed, "source", "left")
    exhausted = (F.col("tokens") == 0) | (F.col("crossed") >= F.col("max_repeats") * F.col("documents"))
    return rows.where(exhausted & F.col("short")).select("source")


def mix_shares(sized: DataFrame, targets: DataFrame, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """Per listed source: target share, real share of the mixture's tokens, documents and tokens taken, ``short``."""
    taken = mix(sized, targets, seed, key).groupBy("source").agg(F.count(F.lit(1)).alias("documents_taken"), F.sum("copies").alias("copies_taken"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_taken"))
    plan = mix_plan(sized, targets)
    rows = plan.join(taken, "source", "left").fillna(0, ["documents_taken", "copies_taken", "most_copies", "tokens_taken"])
    total = rows.agg(F.sum("tokens_taken").alias("all_taken"))
    rows = rows.join(F.broadcast(total), F.lit(True))
    real = F.when(F.col("all_taken") > 0, F.col("tokens_taken") / F.col("all_taken")).otherwise(F.lit(0.0))
    return rows.select("source", "share", real.alias("real_share"), "max_repeats", "documents", "tokens", "documents_taken", "copies_taken", "most_copies", "tokens_taken", "short")
