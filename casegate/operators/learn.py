"""Rule learning by distributed counting (IREP, RIPPER and a boosted-tree teacher).

After Fuernkranz and Widmer (1994) and Cohen (1995).  Cases are binned and counted once into a table
with one row per combination of attribute bins, label and grow/prune part.  Each learner is a
generator that asks for counts and is sent them; all learners (checks, folds, settings) are asked in
lock step, so a job answers one question of each.  A growth step brings the counts of both parts, so
pruning and description lengths need no jobs of their own.  The driver holds rules, the winner of each
step and count tables of at most ``LOCAL_COMBINATIONS`` rows, never cases: such a table is counted there,
a larger one by a job per round of questions, with the same answers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegate.config import AnalysisConfig
from casegate.errors import RuleLearningError
from casegate.functions.bins import Binning, fit_bins
from casegate.lineage import cut_lineage
from casegate.operators.casetable import numeric_columns
from casegate.operators.roc import score_area
from casegate.operators.rules import Rule
from casegate.operators.splits import shuffled
from casegate.operators.targets import CodedEstimator
from casegate.schema import KO

Pairs = tuple[tuple[str, str], ...]  # (attribute, bin label), a rule while it grows

GAIN_FLOOR = 1e-9
#: Looks that one job answers, and combinations that one task reads: batching only, none is left out.
LOOKS_PER_JOB = 400
COMBINATIONS_PER_TASK = 100_000
#: Rows of a count table (combinations of bins, not cases) up to which it is read once, by the driver.
LOCAL_COMBINATIONS = 100_000
#: The part of rows that are only scored.
TEST = -1
#: The teacher: values an attribute may have as an index, bins of its trees, their depth.
INDEXED_VALUES = 32
TREE_BINS = 256
DEEPEST = 16


@dataclass(frozen=True)
class LearnSettings:
    """The defaults are the configuration's."""

    max_rules: int | None = AnalysisConfig.max_rules
    max_rule_conds: int | None = AnalysisConfig.max_rule_conds
    max_total_conds: int | None = AnalysisConfig.max_total_conds
    k: int = AnalysisConfig.k
    n_discretize_bins: int = AnalysisConfig.n_discretize_bins
    dl_allowance: float = AnalysisConfig.dl_allowance
    prune_size: float = AnalysisConfig.prune_size
    seed: int = 0


@dataclass(frozen=True)
class Tally:
    """Positives and negatives of the growing and the pruning part."""

    grow_p: int
    grow_n: int
    prune_p: int
    prune_n: int

    @property
    def p(self) -> int:
        return self.grow_p + self.prune_p

    @property
    def n(self) -> int:
        return self.grow_n + self.prune_n


@dataclass(frozen=True)
class Look:
    """A question: the rows of a training set that ``covered`` leaves and ``rule`` holds for, counted
    for a check; with ``growing`` also the condition that extends the rule best."""

    table: int
    ko: str
    size_at: int
    covered: tuple[Pairs, ...]
    rule: Pairs
    growing: bool = False
    test: bool = False


@dataclass(frozen=True)
class Seen:
    """The answer.  ``best``: attribute, bin label, gain and the counts with that condition."""

    counts: Tally
    best: tuple[str, str, float, Tally] | None = None


@dataclass
class Counts:
    """Count tables of training sets as one frame (``_set``), with the bins of each set."""

    frame: DataFrame
    features: list[str]
    prune_sizes: list[float]
    binnings: Mapping[int, Mapping[str, Binning]]
    conditions: Mapping[int, int]
    rows: Mapping[int, int]
    combinations: int


def count_tables(
    sets: Mapping[int, tuple[DataFrame, int]],
    features: Sequence[str],
    prune_sizes: Sequence[float],
    seed: int = 0,
    tests: Mapping[int, DataFrame] | None = None,
) -> Counts:
    """Bin and count training sets (``number: (cases, bins)``) and the cases to score beside them.

    A case prunes if its hash lies below ``prune_size``; ``_part`` is the number of prune sizes that
    do not exceed the hash, so one table serves all of them.
    """
    sizes = sorted(set(prune_sizes))
    place = F.conv(F.substring(shuffled(seed), 1, 6), 16, 10).cast("long") / float(16**6)
    part = sum(((place >= size).cast("int") for size in sizes), F.lit(0))
    binnings, frames = {}, []
    for number, (train, bins) in sets.items():
        numeric = numeric_columns(train, features)
        other = [c for c in features if c not in numeric]
        own = binnings[number] = {b.feature: b for b in fit_bins(train, numeric, other, bins)}
        scored = [(train, part)]
        if tests is not None:
            scored.append((tests[number], F.lit(TEST)))
        for cases, kept_part in scored:
            frames.append(
                cases.select(
                    F.lit(number).alias("_set"),
                    *[own[c].label().alias(c) for c in features],
                    F.col(KO).alias("_ko"),
                    kept_part.cast("int").alias("_part"),
                )
            )
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    counted = cut_lineage(rows.groupBy("_set", *features, "_ko", "_part").agg(F.count(F.lit(1)).alias("_n")))
    train_rows = counted.filter(F.col("_part") != TEST)
    seen = train_rows.groupBy("_set").agg(
        F.sum("_n").alias("rows"),
        F.count(F.lit(1)).alias("combinations"),
        *[F.count_distinct(f"`{c}`").alias(f"_{i}") for i, c in enumerate(features)],
    )
    found = {r["_set"]: r for r in seen.collect()}
    combinations = sum(r["combinations"] for r in found.values())
    # Many short jobs follow: no more tasks than the table is worth.
    frame = counted.coalesce(1 + combinations // COMBINATIONS_PER_TASK)
    return Counts(
        frame,
        list(features),
        sizes,
        binnings,
        {s: sum(found[s][f"_{i}"] for i in range(len(features))) if s in found else 0 for s in sets},
        {s: found[s]["rows"] if s in found else 0 for s in sets},
        combinations + counted.filter(F.col("_part") == TEST).count() if tests is not None else combinations,
    )


def count_looks(batch: pa.RecordBatch, looks: Sequence[Look], features: Sequence[str]) -> Iterator[tuple]:
    """``look, attribute, bin label, counts`` over the rows of a batch; attribute None for all rows."""
    number, part, weight = (batch[c].to_numpy(zero_copy_only=False) for c in ("_set", "_part", "_n"))
    coded = {}
    for name in ("_ko", *features):
        column = batch[name].dictionary_encode()
        codes = column.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        coded[name] = codes, column.dictionary.to_pylist()
    masks: dict[tuple, np.ndarray] = {}

    def meets(feature: str, label: str) -> np.ndarray:
        if (feature, label) not in masks:
            codes, labels = coded[feature]
            masks[feature, label] = codes == labels.index(label) if label in labels else np.zeros(len(codes), bool)
        return masks[feature, label]

    def holds(rule: Pairs) -> np.ndarray:
        if ("rule", rule) not in masks:
            met = np.ones(batch.num_rows, bool)
            for condition in rule:
                met &= meets(*condition)
            masks["rule", rule] = met
        return masks["rule", rule]

    for at, look in enumerate(looks):
        rows = (number == look.table) & ((part == TEST) if look.test else (part != TEST)) & holds(look.rule)
        for rule in look.covered:
            rows &= ~holds(rule)
        rows = np.flatnonzero(rows)
        if not len(rows):
            continue
        kind = 2 * (part[rows] <= look.size_at).astype(np.int64) + ~meets("_ko", look.ko)[rows]
        weights = weight[rows]
        yield at, None, None, *np.bincount(kind, weights, 4).astype(np.int64).tolist()
        if not look.growing:
            continue
        for feature in features:
            codes, labels = coded[feature]
            own = codes[rows]
            some = own >= 0
            sums = np.bincount(4 * own[some] + kind[some], weights[some], 4 * len(labels)).astype(np.int64).reshape(-1, 4)
            for code in np.flatnonzero(sums.any(axis=1)).tolist():
                yield at, feature, labels[code], *sums[code].tolist()


_SUMS = ("gp", "gn", "pp", "pn")


class Asker:
    """Answers looks at a count table, one job at a time.  The condition of a look is the one with the
    highest information gain on the growing part, ``p1 * (log2(p1/(p1+n1)) - log2(p0/(p0+n0)))``; ties
    go to the first attribute and bin by name.  The expressions are made once, as the jobs are many."""

    def __init__(self, counts: Counts):
        self.counts = counts
        self.table = None
        if counts.combinations <= LOCAL_COMBINATIONS:
            table = counts.frame.toArrow().combine_chunks()
            self.table = table.to_batches()[0] if table.num_rows else None
        p1, n1 = F.col("gp"), F.col("gn")
        self.whole = F.col("feature").isNull()
        look = Window.partitionBy("look")
        gain = p1 * (F.log2(p1 / (p1 + n1)) - F.log2(F.col("p0") / (F.col("p0") + F.col("n0"))))
        # The same gain summed in another order may differ in its last digits.
        rank = F.struct(-F.round("gain", 9), F.col("feature"), F.col("label"))
        self.sums = [F.sum(c).alias(c) for c in _SUMS]
        self.base = {c: F.max(F.when(self.whole, F.col(s))).over(look) for c, s in (("p0", "gp"), ("n0", "gn"))}
        self.gain = {"gain": F.when(~self.whole & (p1 > 0), gain)}
        self.picks = [
            F.max(F.when(self.whole, F.struct(*_SUMS))).alias("totals"),
            F.min_by(F.struct("feature", "label", "gain", *_SUMS), F.when(F.col("gain").isNotNull(), rank)).alias("best"),
        ]

    def answer(self, looks: Sequence[Look]) -> list[Seen]:
        return self.asked(looks) if self.table is None else self.read(looks)

    def read(self, looks: Sequence[Look]) -> list[Seen]:
        """From the table at hand."""
        totals: dict[int, Tally] = {}
        best: dict[int, tuple] = {}
        for at, feature, label, *sums in count_looks(self.table, looks, self.counts.features):
            if feature is None:
                totals[at] = Tally(*sums)
            elif sums[0] > 0:
                whole = totals[at]
                gain = sums[0] * (math.log2(sums[0] / (sums[0] + sums[1])) - math.log2(whole.grow_p / (whole.grow_p + whole.grow_n)))
                rank = (-round(gain, 9), feature, label)
                if at not in best or rank < best[at][0]:
                    best[at] = rank, (feature, label, gain, Tally(*sums))
        return [
            Seen(totals.get(at, Tally(0, 0, 0, 0)), best[at][1] if at in best and best[at][1][2] > GAIN_FLOOR else None) for at in range(len(looks))
        ]

    def asked(self, looks: Sequence[Look]) -> list[Seen]:
        """By one job."""
        features = self.counts.features
        kinds = (pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 4)
        names = ["look", "feature", "label", *_SUMS]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = list(zip(*count_looks(batch, looks, features), strict=True)) or [[]] * 7
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        rows = (
            self.counts.frame.mapInArrow(run, "look int, feature string, label string, gp long, gn long, pp long, pn long")
            .repartition("look")
            .groupBy("look", "feature", "label")
            .agg(*self.sums)
            .withColumns(self.base)
            .withColumns(self.gain)
            .groupBy("look")
            .agg(*self.picks)
            .collect()
        )
        seen = {r["look"]: r for r in rows}
        answers = []
        for at in range(len(looks)):
            row = seen.get(at)
            if row is None:
                answers.append(Seen(Tally(0, 0, 0, 0)))
                continue
            best = row["best"]
            if best is not None and best["gain"] > GAIN_FLOOR:
                best = best["feature"], best["label"], best["gain"], Tally(*(best[c] for c in _SUMS))
            else:
                best = None
            answers.append(Seen(Tally(*(row["totals"][c] for c in _SUMS)), best))
        return answers


def theory_bits(rule: Pairs, conditions: int) -> float:
    """Bits to send one rule out of ``conditions`` possible conditions."""
    size = len(rule)
    if size == 0 or conditions <= 0:
        return 0.0
    share = min(size / conditions, 1.0)
    bits = math.log2(size) if size > 1 else 1.0
    bits += size * math.log2(1 / share)
    if share < 1:
        bits += (conditions - size) * math.log2(1 / (1 - share))
    return 0.5 * bits


def exception_bits(tp: int, fp: int, tn: int, fn: int) -> float:
    """Bits to send which cases the ruleset gets wrong."""

    def choose(n: int, r: int) -> float:
        return (math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)) / math.log(2)

    return choose(tp + fp, fp) + choose(tn + fn, fn)


Asking = Generator[list[Look], list[Seen], object]


@dataclass
class Learner:
    """One check to learn on one training set."""

    counts: Counts
    table: int
    ko: str
    settings: LearnSettings
    totals: tuple[int, int] = (0, 0)

    def look(self, covered: Sequence[Pairs], rule: Pairs = (), growing: bool = False, test: bool = False) -> Look:
        at = self.counts.prune_sizes.index(self.settings.prune_size)
        return Look(self.table, self.ko, at, tuple(covered), rule, growing, test)

    def room(self, rules: Sequence[Pairs]) -> int | None:
        if self.settings.max_total_conds is None:
            return None
        return self.settings.max_total_conds - sum(len(r) for r in rules)

    def length(self, rules: Sequence[Pairs], left: Tally, taken: Tally = Tally(0, 0, 0, 0)) -> float:
        """Description length of a ruleset that leaves ``left`` but for ``taken``."""
        positives, negatives = self.totals
        tp, fp = positives - left.p + taken.p, negatives - left.n + taken.n
        told = exception_bits(tp, fp, negatives - fp, positives - tp)
        return told + sum(theory_bits(rule, self.counts.conditions[self.table]) for rule in rules)

    def grow(self, covered: Sequence[Pairs], start: Pairs = ()) -> Asking:
        """Extend a rule on the growing part; returns it with the counts of its prefixes."""
        settings = self.settings
        looks = [self.look(covered, start[:n], n == len(start)) for n in range(len(start) + 1)]
        seen = yield looks
        counts = [s.counts for s in seen]
        rule, best = start, seen[-1].best
        if start and not (counts[-1].grow_p > 0 and counts[-1].grow_n > 0):
            return rule, counts
        limits = [m for m in (settings.max_rule_conds, self.room(covered)) if m is not None]
        while best is not None and best[0] not in {f for f, _ in rule}:
            rule = (*rule, (best[0], best[1]))
            counts.append(best[3])
            if best[3].grow_n == 0 or (limits and len(rule) >= min(limits)):
                break
            ((now),) = yield [self.look(covered, rule, True)]
            best = now.best
        return rule, counts

    def add_rules(self, found: list[Pairs], by_length: bool) -> Asking:
        """Learn rules until the check runs out of positives, limits or good rules.

        IREP stops at a rule that is wrong more often than right on the pruning part; with
        ``by_length`` (RIPPER) also at one that lengthens the description beyond the allowance.
        """
        settings, shortest = self.settings, None
        while settings.max_rules is None or len(found) < settings.max_rules:
            room = self.room(found)
            if room is not None and room <= 0:
                break
            rule, counts = yield from self.grow(found)
            if not found:
                self.totals = counts[0].p, counts[0].n
            if shortest is None:
                shortest = self.length(found, counts[0])
            if not rule or counts[0].grow_p == 0:
                break
            rule = pruned(rule, counts)
            taken = counts[len(rule)]
            if settings.prune_size > 0 and taken.prune_p <= taken.prune_n:
                break
            if by_length:
                length = self.length([*found, rule], counts[0], taken)
                if length > shortest + settings.dl_allowance:
                    break
                shortest = min(shortest, length)
            found.append(rule)

    def optimise(self, found: list[Pairs]) -> Asking:
        """Each rule competes with a replacement grown from nothing and a revision grown from itself;
        the shortest description stays."""
        for at, own in enumerate(found):
            others = [r for i, r in enumerate(found) if i != at]
            full = self.settings.max_rule_conds is not None and len(own) >= self.settings.max_rule_conds
            grown = yield from together(self.grow(others), self.stay(others, own) if full else self.grow(others, own))
            left = grown[0][1][0]
            offers = [(own, grown[1][1][len(own)])]
            for rule, counts in grown if not full else grown[:1]:
                if rule:
                    cut = pruned(rule, counts)
                    offers.append((cut, counts[len(cut)]))
            lengths = [self.length([*others, rule], left, taken) for rule, taken in offers]
            found[at] = offers[lengths.index(min(lengths))][0]

    def stay(self, covered: Sequence[Pairs], rule: Pairs) -> Asking:
        """A rule as it is, with the counts of its prefixes."""
        seen = yield [self.look(covered, rule[:n]) for n in range(len(rule) + 1)]
        return rule, [s.counts for s in seen]

    def drop_longer(self, found: list[Pairs]) -> Asking:
        """Delete rules, last first, whose absence makes the description shorter."""
        found[:] = dict.fromkeys(found)
        at = len(found) - 1
        while at >= 0:
            less = [[r for i, r in enumerate(found) if i != gone] for gone in range(at + 1)]
            seen = yield [self.look(rules) for rules in (found, *less)]
            whole = self.length(found, seen[0].counts)
            while at >= 0 and self.length(less[at], seen[at + 1].counts) >= whole:
                at -= 1
            if at >= 0:
                del found[at]
                at -= 1

    def irep(self) -> Asking:
        found: list[Pairs] = []
        yield from self.add_rules(found, by_length=False)
        return found

    def ripper(self) -> Asking:
        found: list[Pairs] = []
        yield from self.add_rules(found, by_length=True)
        for _ in range(self.settings.k):
            before = list(found)
            yield from self.optimise(found)
            yield from self.add_rules(found, by_length=True)
            if found == before:
                break
        yield from self.drop_longer(found)
        return found


def pruned(rule: Pairs, counts: Sequence[Tally]) -> Pairs:
    """The prefix with the best ``(p-n)/(p+n)`` on the pruning part, the shortest of equals; the
    whole rule where none covers any of it."""
    worth = {}
    for length in range(1, len(rule) + 1):
        p, n = counts[length].prune_p, counts[length].prune_n
        worth[length] = (p - n) / (p + n) if p + n else -1.0
    if all(counts[length].prune_p + counts[length].prune_n == 0 for length in worth):
        return rule
    return rule[: max(worth, key=lambda length: (worth[length], -length))]


def together(*askers: Asking) -> Asking:
    """Several generators asked at the same time; returns what each returns."""
    results: list = [None] * len(askers)
    waiting: dict[int, list[Look]] = {}
    for at, asker in enumerate(askers):
        try:
            waiting[at] = next(asker)
        except StopIteration as end:
            results[at] = end.value
    while waiting:
        seen = yield [look for looks in waiting.values() for look in looks]
        for at, looks in list(waiting.items()):
            own, seen = seen[: len(looks)], seen[len(looks) :]
            try:
                waiting[at] = askers[at].send(own)
            except StopIteration as end:
                results[at] = end.value
                del waiting[at]
    return results


def ask_all(counts: Counts, askers: Sequence[Asking]) -> list:
    """Run generators to their ends, with a job for each round of questions."""
    every = together(*askers)
    asker = Asker(counts)
    try:
        looks = next(every)
        while True:
            seen = []
            for begin in range(0, len(looks), LOOKS_PER_JOB):
                seen += asker.answer(looks[begin : begin + LOOKS_PER_JOB])
            looks = every.send(seen)
    except StopIteration as end:
        return end.value


LEARNERS: dict[str, Callable[[Learner], Asking]] = {"IREP": Learner.irep, "RIPPER": Learner.ripper}


def learn_rules(
    train: DataFrame,
    kos: Sequence[str],
    features: Sequence[str],
    algorithm: str = "RIPPER",
    settings: LearnSettings = LearnSettings(),
) -> dict[str, list[Rule]]:
    """Rulesets of all checks from labelled cases; empty where nothing is learnt."""
    if algorithm not in LEARNERS:
        raise RuleLearningError(f"unknown rule algorithm {algorithm!r}")
    if not kos or not features:
        return {ko: [] for ko in kos}
    counts = count_tables({0: (train, settings.n_discretize_bins)}, features, [settings.prune_size], settings.seed)
    if counts.rows[0] == 0:
        return {ko: [] for ko in kos}
    learners = [Learner(counts, 0, ko, settings) for ko in kos]
    found = ask_all(counts, [LEARNERS[algorithm](one) for one in learners])
    return {
        ko: [tuple(counts.binnings[0][f].condition(label) for f, label in rule) for rule in rules]
        for ko, rules in zip(kos, found, strict=True)
    }


@dataclass
class Teacher:
    """A fitted teacher model of one check and what it says about the attributes."""

    model: object
    importances: dict[str, float] = field(default_factory=dict)
    auc: float | None = None


def boosted_trees(features: Sequence[str], train: DataFrame, iterations: int = 10, depth: int = 5):
    """An unfitted boosted-tree pipeline over mixed attributes; label in ``_y``.  ``depth`` is 1 to 16.

    Attributes of at most ``INDEXED_VALUES`` values are value indexes, richer ones ordered target
    statistics, so the trees' bins do not grow with the values.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    if not 1 <= depth <= DEEPEST or iterations < 1:
        raise RuleLearningError(f"a teacher has a depth of 1 to {DEEPEST} and at least one tree")
    numeric = numeric_columns(train, features)
    other = [c for c in features if c not in numeric]
    values = train.agg(*[F.count_distinct(F.col(f"`{c}`")) for c in other]).first() if other else []
    indexed = [c for c, n in zip(other, values, strict=True) if n <= INDEXED_VALUES]
    rich = [c for c in other if c not in indexed]
    stages = []
    codes = [f"_code_{i}" for i in range(len(indexed))]
    shares = [f"_share_{i}" for i in range(len(rich))]
    if indexed:
        stages.append(StringIndexer(inputCols=indexed, outputCols=codes, handleInvalid="keep", stringOrderType="alphabetAsc"))
    stages.append(VectorAssembler(inputCols=[*numeric, *codes, *shares], outputCol="_features"))
    stages.append(GBTClassifier(featuresCol="_features", labelCol="_y", maxIter=iterations, maxDepth=depth, maxBins=TREE_BINS, seed=0))
    pipeline = Pipeline(stages=stages)
    return (CodedEstimator(pipeline, rich, shares) if rich else pipeline), numeric + indexed + rich


def surrogate_rules(
    train: DataFrame,
    kos: Sequence[str],
    features: Sequence[str],
    settings: LearnSettings = LearnSettings(),
    teacher: Callable | None = None,
    test: DataFrame | None = None,
) -> tuple[dict[str, list[Rule]], dict[str, Teacher]]:
    """Rules that imitate a teacher: fit it per check, then learn its predictions.  The teacher's area
    under the ROC curve is measured on ``test``.

    ``teacher(features, train)`` returns an unfitted estimator with label ``_y`` and
    output ``prediction``, and the attribute order of its importances.
    """
    rules: dict[str, list[Rule]] = {}
    teachers: dict[str, Teacher] = {}
    for ko in kos:
        teachers[ko] = fit_teacher(train, ko, features, teacher, test)
        if teachers[ko].model is None:
            rules[ko] = []
            continue
        said = teachers[ko].model.transform(train).withColumn(KO, F.when(F.col("prediction") == 1.0, F.lit(ko)))
        rules |= learn_rules(said.select(*train.columns), [ko], features, "RIPPER", settings)
    return rules, teachers


def fit_teacher(
    train: DataFrame, ko: str, features: Sequence[str], teacher: Callable | None = None, test: DataFrame | None = None
) -> Teacher:
    """The teacher of a check; without a model where the check rejects all cases or none."""
    marked = train.withColumn("_y", F.col(KO).eqNullSafe(ko).cast("double"))
    if marked.select("_y").distinct().count() < 2:
        return Teacher(None)
    estimator, order = (teacher or boosted_trees)(features, train)
    model = estimator.fit(marked)
    last = model.stages[-1] if hasattr(model, "stages") else model
    weights = getattr(last, "featureImportances", None)
    told = dict(zip(order, (float(w) for w in weights.toArray()))) if weights is not None else {}
    return Teacher(model, told, None if test is None else teacher_area(model, test, ko))


def teacher_area(model, test: DataFrame, ko: str) -> float | None:
    """Area under the ROC curve of a teacher's scores; None where a class is missing."""
    from pyspark.ml.functions import vector_to_array

    said = model.transform(test.withColumn("_y", F.col(KO).eqNullSafe(ko).cast("double")))
    score = vector_to_array("probability")[1] if "probability" in said.columns else F.col("prediction")
    return score_area(said.select(score.alias("score"), (F.col("_y") == 1).alias("label"))).first()["auc"]
