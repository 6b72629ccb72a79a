"""Resource roles: groups of resources that do the same mix of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegate.lineage import cut_lineage
from casegate.operators.names import names_of
from casegate.operators.ordered import dense_index
from casegate.operators.similar import correlated_groups
from casegate.schema import ACTIVITY, END, RESOURCE, START

AUTOMATIC = "AUTO"


def task_frequencies(log: DataFrame) -> DataFrame:
    """How often each resource does each task; no boundaries, no automatic user."""
    return (
        log.filter(
            ~F.col(ACTIVITY).isin(START, END) & F.col(RESOURCE).isNotNull() & (F.col(RESOURCE) != AUTOMATIC)
        )
        .groupBy(RESOURCE, ACTIVITY)
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def profile_classes(frequencies: DataFrame) -> DataFrame:
    """Resources with the one that stands for their profile.

    Resources with the same counts correlate equally with everyone else, so a crowd
    of copies costs one row in the pairing below.  A profile is as long as the list
    of tasks.
    """
    profiles = frequencies.groupBy(RESOURCE).agg(
        F.array_sort(F.collect_list(F.struct(ACTIVITY, "freq"))).alias("_profile")
    )
    first = profiles.groupBy("_profile").agg(F.min(RESOURCE).alias("profile"))
    return profiles.join(first, "_profile").select(RESOURCE, "profile")


def profile_correlations(frequencies: DataFrame, floor: float | None = None) -> DataFrame:
    """Pearson correlation of every two profiles that share a task, over all tasks.

    Profiles without a common task correlate at 0 or below, so for thresholds of 0
    and more nothing is lost.  A constant profile has no correlation.  With
    ``floor`` only larger ones are kept.
    """
    tasks = frequencies.select(ACTIVITY).distinct().agg(F.count(F.lit(1))).scalar()
    norms = frequencies.groupBy(RESOURCE).agg(
        F.sum("freq").alias("s"), F.sum(F.col("freq") * F.col("freq")).alias("q")
    )
    sized = frequencies.join(norms, RESOURCE)

    def side(letter: str) -> DataFrame:
        return sized.select(
            ACTIVITY,
            F.col(RESOURCE).alias(letter),
            F.col("freq").alias(f"f{letter}"),
            F.col("s").alias(f"s{letter}"),
            F.col("q").alias(f"q{letter}"),
        )

    dots = (
        side("x")
        .join(side("y"), ACTIVITY)
        .filter(F.col("x") < F.col("y"))
        .groupBy("x", "y", "sx", "qx", "sy", "qy")
        .agg(F.sum(F.col("fx") * F.col("fy")).alias("dot"))
    )
    spread = (tasks * F.col("qx") - F.col("sx") * F.col("sx")).cast("double") * (
        tasks * F.col("qy") - F.col("sy") * F.col("sy")
    )
    pairs = dots.select(
        "x",
        "y",
        F.try_divide((tasks * F.col("dot") - F.col("sx") * F.col("sy")).cast("double"), F.sqrt(spread)).alias(
            "correlation"
        ),
    )
    return pairs.filter(F.col("correlation") > floor) if floor is not None else pairs


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``vertices`` (v) with the smallest vertex of their component.

    Each round takes the smallest label among the neighbours and then jumps to that
    label's own label, so long chains shrink quickly.  Labels are checkpointed every
    round; the loop ends when none changes.
    """
    both = cut_lineage(
        edges.select(F.col("x").alias("a"), F.col("y").alias("b"))
        .union(edges.select(F.col("y").alias("a"), F.col("x").alias("b")))
        .distinct()
    )
    labels = cut_lineage(vertices.select("v", F.col("v").alias("component")))
    while True:
        offered = (
            both.join(labels.select(F.col("v").alias("b"), F.col("component").alias("_o")), "b")
            .groupBy(F.col("a").alias("v"))
            .agg(F.min("_o").alias("_o"))
        )
        lowered = labels.join(offered, "v", "left").select(
            "v", "component", F.least("component", F.coalesce("_o", "component")).alias("_low")
        )
        jumps = lowered.select(F.col("v").alias("_low"), F.col("_low").alias("_jump"))
        renewed = cut_lineage(
            lowered.join(jumps, "_low", "left").select(
                "v", F.coalesce("_jump", "_low").alias("_new"), F.col("component").alias("_old")
            )
        )
        labels = renewed.select("v", F.col("_new").alias("component"))
        if renewed.filter(F.col("_new") != F.col("_old")).isEmpty():
            return labels


def count_vectors(frequencies: DataFrame) -> DataFrame:
    """One row per resource (``v``) with its counts over all tasks, by task name."""
    tasks = F.array(*[F.lit(name) for name in names_of(frequencies, ACTIVITY)]).cast("array<string>")
    known = F.map_from_entries(F.collect_list(F.struct(ACTIVITY, "freq")))
    return frequencies.groupBy(F.col(RESOURCE).alias("v")).agg(known.alias("_known")).select(
        "v", F.transform(tasks, lambda name: F.coalesce(F.element_at("_known", name), F.lit(0)).cast("long")).alias("counts")
    )


def profile_groups(sample: DataFrame, threshold: float) -> DataFrame:
    """``v, component``: groups of profiles linked by correlations above the threshold.

    Found without pairs for thresholds of 0 and more; pairs are made where profiles are too different for
    that, and below 0.
    """
    found = correlated_groups(count_vectors(sample), threshold) if threshold >= 0 else None
    if found is None:
        profiles = sample.select(F.col(RESOURCE).alias("v")).distinct()
        found = connected_components(profiles, profile_correlations(sample, threshold))
    return found


def discover_roles(log: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Resources with their role: connected groups of profiles that correlate above
    the threshold, numbered by size (largest first), then first member."""
    frequencies = cut_lineage(task_frequencies(log))
    classes = cut_lineage(profile_classes(frequencies))
    profiles = classes.select(F.col("profile").alias("v")).distinct()
    sample = frequencies.join(profiles, frequencies[RESOURCE] == profiles["v"], "left_semi")
    # Every task stays in the sample: each resource's tasks are those of its profile.
    found = profile_groups(sample, threshold)
    members = lone_constants(classes, sample).join(
        found.withColumnRenamed("v", "profile"), "profile"
    ).select(RESOURCE, F.coalesce("_own", "component").alias("component"))
    sizes = members.groupBy("component").agg(
        F.count(F.lit(1)).alias("quantity"), F.min(RESOURCE).alias("_first")
    )
    numbered = dense_index(sizes, [F.col("quantity").desc(), "_first"], "_i")
    return members.join(numbered, "component").select(
        RESOURCE, F.concat(F.lit("Role "), F.col("_i") + 1).alias("role"), "quantity"
    )


def lone_constants(classes: DataFrame, sample: DataFrame) -> DataFrame:
    """A constant profile correlates with nothing, not even its copies: its members
    (``_own``) stay alone."""
    tasks = sample.select(ACTIVITY).distinct().agg(F.count(F.lit(1))).scalar()
    constant = (
        sample.groupBy(F.col(RESOURCE).alias("profile"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("freq").alias("_low"), F.max("freq").alias("_high"))
        .filter((F.col("_n") == tasks) & (F.col("_low") == F.col("_high")))
        .select("profile", F.lit(True).alias("_flat"))
    )
    return classes.join(constant, "profile", "left").withColumn(
        "_own", F.when(F.col("_flat"), F.col(RESOURCE))
    )


def with_roles(log: DataFrame, roles: DataFrame) -> DataFrame:
    """The role of its resource on each event; null without one."""
    return log.join(roles.select(RESOURCE, "role"), RESOURCE, "left")


def role_members(roles: DataFrame) -> DataFrame:
    """Roles with their size and members, one row per member."""
    return roles.select("role", "quantity", RESOURCE)


def dominant_roles(log: DataFrame) -> DataFrame:
    """The role that does each task most often; equal counts by role name."""
    return (
        log.filter(F.col("role").isNotNull())
        .groupBy(ACTIVITY, "role")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(ACTIVITY)
        .agg(F.min_by("role", F.struct(-F.col("_n"), "role")).alias("role"))
    )
