"""Finding knock-out activities."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegate.errors import NoKnockoutsError
from casegate.lineage import cut_lineage
from casegate.operators.filters import eventually_follows
from casegate.operators.names import names_frame, names_of
from casegate.operators.ordered import sequence
from casegate.operators.variants import placed_steps, sorted_variants, variant_steps
from casegate.schema import ACTIVITY, BY_START, CASE, START

MEX_BLOCK = 1_000


def activities_before(log: DataFrame, post: Sequence[str]) -> DataFrame:
    """Activities that directly precede a known post-knock-out activity."""
    stepped = sequence(log.select(CASE, ACTIVITY, *BY_START), BY_START, leads={"next_activity": ACTIVITY})
    return (
        stepped.filter(F.col("next_activity").isin(*post) & ~F.col(ACTIVITY).isin(*post))
        .select(ACTIVITY)
        .distinct()
    )


def differentiating_transitions(steps: DataFrame, variants: DataFrame) -> DataFrame:
    """The transition that best sets each variant apart from the others.

    Comparing every variant with every other, each transition absent there counts
    once per occurrence here.  That sum is ``occurrences * (variants - variants
    having it)``, an aggregate over (transition, variant).  Ties go to the
    transition met first: smallest variant lacking it, then position.
    """
    total = variants.agg(F.count(F.lit(1))).scalar()
    uses = (
        steps.filter(F.col("next_activity").isNotNull())
        .groupBy(ACTIVITY, "next_activity", "vidx")
        .agg(F.count(F.lit(1)).alias("uses"), F.min("position").alias("first_position"))
    )
    pair = [ACTIVITY, "next_activity"]
    having = uses.groupBy(*pair).agg(F.count(F.lit(1)).alias("having"))
    scored = (
        uses.join(having, pair)
        .join(first_lacking(uses, pair), pair)
        .withColumn("score", F.col("uses") * (total - F.col("having")))
        .filter(F.col("score") > 0)
    )
    best = F.struct(-F.col("score"), F.col("lacking"), F.col("first_position"))
    return (
        scored.groupBy("vidx")
        .agg(F.min_by(F.struct(*pair, "score"), best).alias("_best"))
        .select(
            "vidx",
            F.col(f"_best.{ACTIVITY}").alias("from_activity"),
            F.col("_best.next_activity").alias("to_activity"),
            F.col("_best.score").alias("score"),
        )
    )


def first_lacking(uses: DataFrame, pair: Sequence[str]) -> DataFrame:
    """Per transition, the smallest variant number that does not have it.

    Found in two steps so that no window sees all variants of a common
    transition: the first block of ``MEX_BLOCK`` numbers that is not full, then
    the first gap inside that block.
    """
    blocked = uses.select(*pair, "vidx", F.floor(F.col("vidx") / MEX_BLOCK).alias("_block"))
    full = (
        blocked.groupBy(*pair, "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == MEX_BLOCK)
        .withColumn("_place", F.row_number().over(Window.partitionBy(*pair).orderBy("_block")) - 1)
        .filter(F.col("_block") == F.col("_place"))
        .groupBy(*pair)
        .agg(F.count(F.lit(1)).alias("_open"))
    )
    every = blocked.select(*pair).distinct()
    open_block = every.join(full, list(pair), "left").select(*pair, F.coalesce("_open", F.lit(0)).alias("_open"))
    inside = (
        blocked.join(open_block, list(pair))
        .filter(F.col("_block") == F.col("_open"))
        .withColumn(
            "_place",
            F.row_number().over(Window.partitionBy(*pair, "_block").orderBy("vidx"))
            - 1
            + F.col("_open") * MEX_BLOCK,
        )
        .filter(F.col("vidx") == F.col("_place"))
        .groupBy(*pair)
        .agg((F.max("vidx") + 1).alias("_next"))
    )
    return open_block.join(inside, list(pair), "left").select(
        *pair, F.coalesce(F.col("_next"), F.col("_open") * MEX_BLOCK).cast("long").alias("lacking")
    )


def candidate_sequences(steps: DataFrame, variants: DataFrame, best: DataFrame, limit: int) -> DataFrame:
    """Candidate checks in the order the sorted variants bring them up.

    A variant proposes the first activity of its transition, then the second one,
    unless that one is met first at the last but one place.  The first mention of
    an activity counts.  No variant is read after the one where ``limit``
    activities are known; a variant whose second activity was new but refused
    does not end the search.
    """
    size = variants.select("vidx", "variant_len")
    picked = best.join(size, "vidx")
    refusable = picked.select("vidx", "variant_len", F.col("to_activity").alias(ACTIVITY))
    seconds = (
        steps.select("vidx", "position", ACTIVITY, "next_activity")
        .join(refusable, ["vidx", ACTIVITY])
        .groupBy("vidx", "variant_len", ACTIVITY)
        .agg(
            F.min("position").alias("first_at"),
            F.min_by("next_activity", "position").alias("after"),
        )
    )
    outcomes = steps.filter(F.col("position") == F.col("variant_len") - 2).select(
        "vidx", F.col(ACTIVITY).alias("outcome")
    )
    refused = F.col("first_at") == F.col("variant_len") - 2
    mentions = picked.select(
        "vidx",
        F.lit(0).alias("slot"),
        F.col("from_activity").alias("candidate"),
        F.col("to_activity").alias("followed_by"),
        "variant_len",
    ).unionByName(
        seconds.filter(~refused).select(
            "vidx",
            F.lit(1).alias("slot"),
            F.col(ACTIVITY).alias("candidate"),
            F.col("after").alias("followed_by"),
            "variant_len",
        )
    )
    mention = F.struct("vidx", "slot")
    firsts = (
        mentions.groupBy("candidate")
        .agg(
            F.min(mention).alias("_first"),
            F.min_by(F.struct("followed_by", "variant_len"), mention).alias("_of"),
        )
        .select(
            "candidate",
            F.col("_first.vidx").alias("vidx"),
            F.col("_first.slot").alias("slot"),
            F.col("_of.followed_by").alias("followed_by"),
            F.col("_of.variant_len").alias("variant_len"),
        )
    )
    firsts = firsts.join(outcomes, "vidx", "left").withColumn(
        "followed_by", F.coalesce("followed_by", "outcome")
    )
    # One row per activity name from here on.
    numbered = firsts.withColumn("rank", F.row_number().over(Window.orderBy("vidx", "slot")))
    reached = numbered.filter(F.col("rank") == limit).agg(F.min("vidx")).scalar()
    known = firsts.select(
        F.col("candidate").alias(ACTIVITY), F.struct("vidx", "slot").alias("_known")
    )
    passing = (
        seconds.filter(refused)
        .join(known, ACTIVITY, "left")
        .filter(F.col("_known").isNull() | (F.col("_known") > F.struct(F.col("vidx"), F.lit(1))))
        .select("vidx")
    )
    stop = (
        variants.select("vidx")
        .filter(F.col("vidx") >= reached)
        .join(passing, "vidx", "left_anti")
        .agg(F.min("vidx"))
        .scalar()
    )
    return numbered.withColumn("_stop", stop).filter(
        F.col("_stop").isNull() | (F.col("vidx") <= F.col("_stop"))
    ).select("candidate", "followed_by", "outcome", "variant_len", "vidx", "rank")


def automatic_outcomes(sequences: DataFrame) -> DataFrame:
    """Outcomes of the candidate sequences with the number that lead there."""
    return sequences.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("candidates"), F.min("rank").alias("first_rank")
    )


def automatic_sequences(
    log: DataFrame, limit: int, success: Sequence[str] = (), start: str = START
) -> DataFrame:
    """Candidate sequences of a log without known outcomes; cases known to succeed
    are left out."""
    if success:
        log = eventually_follows(log, [(start, s) for s in success], retain=False)
    steps = placed_steps(log)
    variants = sorted_variants(steps)
    # Both tables are read several times below; they are as small as the variants.
    rows = cut_lineage(variant_steps(steps, variants))
    best = cut_lineage(differentiating_transitions(rows, variants))
    return candidate_sequences(rows, variants, best, limit)


def excluded(kos: DataFrame, column: str, unwanted: Sequence[str]) -> DataFrame:
    return kos.filter(~F.col(column).isin(*unwanted)) if unwanted else kos


@dataclass(frozen=True)
class Discovery:
    """What was found: check names, outcome names, candidate sequences if any."""

    kos: object
    outcomes: list[str]
    sequences: DataFrame | None


def discover(log: DataFrame, config) -> Discovery:
    """Manual, semi-automatic or automatic, by what the configuration knows."""
    post, success = config.post_knockout_activities, config.success_activities
    if config.known_ko_activities:
        outcomes = post or success or [config.end_activity]
        return Discovery(sorted(set(config.known_ko_activities)), list(outcomes), None)
    unwanted = [config.start_activity, config.end_activity, *post, *config.exclude_from_ko_activities]
    if post:
        found, sequences = activities_before(log, post), None
        outcomes = list(post)
    else:
        limit = config.ko_count_threshold or log.select(ACTIVITY).distinct().count()
        sequences = automatic_sequences(log, limit, success, config.start_activity)
        found = sequences.select(F.col("candidate").alias(ACTIVITY))
        outcomes = list(success) or [config.end_activity]
    kos = names_of(excluded(found, ACTIVITY, unwanted), ACTIVITY)
    if names_frame(log.sparkSession, kos, ACTIVITY).isEmpty():
        raise NoKnockoutsError("no knock-out activities were found")
    return Discovery(kos, outcomes, sequences)
