"""Segmented scans: next values, last known values, running totals and their minima per key.

A scan is a window over a key's rows in order.  A key that holds more rows than a task should is cut into
pieces of about equal size, at places of the total order (so equal times are cut as well), and each piece
is a window of its own.  What the pieces before or after contribute is a monoid: the first row, the last
known value, a sum, a sum with its lowest prefix.  It is combined over one row per piece and added to the
piece's own result.

Keys above their share come from one frequent-items sketch of the keys, cut places from a sample of those
keys' rows; both are bounded by the number of shuffle partitions, and so is the table of pieces, which is
broadcast.  The rows are shuffled once, by key and piece.  A log without such keys is a plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sampled rows per piece of a cut key.
SAMPLED = 64
#: Items the sketch of frequent keys follows, per shuffle partition and at least.
_TRACKED, _TRACKED_LEAST = 16, 4_096
_HASHES = 1 << 20
Source = str | Column


def column(source: Source) -> Column:
    return F.col(f"`{source}`") if isinstance(source, str) else source


@dataclass(frozen=True)
class Cuts:
    """Where keys are cut: per key hash, the places at which a new piece begins."""

    table: DataFrame
    keys: Sequence[str]
    order: Sequence[str]
    width: int

    def pieces_of(self, df: DataFrame, how: str) -> DataFrame:
        """``df`` with ``_piece``: null where the key is whole.  Two levels of places, so that a row is
        compared with some ``2 * sqrt(pieces)`` of them."""
        place = F.struct(*[column(c).alias(f"o{i}") for i, c in enumerate(self.order)])
        group = F.size(F.filter("_heads", lambda head: head <= place))
        inner = F.size(F.filter(F.get("_groups", group - 1), lambda cut: cut <= place))
        piece = F.when(group == 0, 0).otherwise((group - 1) * self.width + inner)
        joined = df.join(F.broadcast(self.table), key_hash(self.keys) == F.col("_hash"), how)
        return joined.withColumn("_piece", F.when(F.col("_hash").isNotNull(), piece)).drop("_hash", "_heads", "_groups")


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[column(k) for k in keys]) if keys else F.lit(0).cast("long")


def cuts_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], tasks: int | None = None) -> Cuts | None:
    """Where to cut the keys of ``df`` that hold two tasks' rows or more; None without such keys."""
    spark = df.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if tasks < 2:
        return None
    rows = df.select(key_hash(keys).alias("_hash"), *[column(c).alias(f"o{i}") for i, c in enumerate(order)])
    tracked = max(_TRACKED_LEAST, _TRACKED * tasks)
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_hash, {tasks}, {tracked})").alias("top")).first()
    share = {item["item"]: item["count"] * tasks // max(1, found.n) for item in found.top}
    share = {key: pieces for key, pieces in share.items() if pieces > 1}
    if not share:
        return None
    crowd = sum(item["count"] for item in found.top if item["item"] in share)
    chance = min(1.0, SAMPLED * sum(share.values()) / crowd)
    drawn = F.pmod(F.xxhash64(F.lit("drawn"), *[f"o{i}" for i in range(len(order))]), F.lit(_HASHES)) < int(chance * _HASHES) + 1
    sampled: dict[int, list[tuple]] = {key: [] for key in share}
    for row in rows.where(F.col("_hash").isin(list(share)) & drawn).collect():
        sampled[row[0]].append(tuple(row[1:]))
    width = max(1, int(max(share.values()) ** 0.5))
    table = []
    for key, pieces in share.items():
        places = sorted(sampled[key], key=lambda place: [(part is not None, part) for part in place])
        chosen = list(dict.fromkeys(places[len(places) * i // pieces] for i in range(1, pieces) if places))
        groups = [chosen[i : i + width] for i in range(0, len(chosen), width)]
        table.append((key, [group[0] for group in groups], groups))
    place = T.StructType([T.StructField(f"o{i}", rows.schema[f"o{i}"].dataType) for i in range(len(order))])
    schema = T.StructType(
        [
            T.StructField("_hash", T.LongType()),
            T.StructField("_heads", T.ArrayType(place)),
            T.StructField("_groups", T.ArrayType(T.ArrayType(place))),
        ]
    )
    return Cuts(spark.createDataFrame(table, schema), keys, order, width)


@dataclass
class Scan:
    """What to add to each row, by new name.

    ``leads``: the value of the next row; ``lasts``: the last value so far that is not null; ``totals``: the
    running sum; ``lows``: of a total named there, the least value before this row, 0 at most; ``position``:
    the 0-based place.  With ``peers`` totals take in all rows of equal order.
    """

    leads: Mapping[str, Source] = field(default_factory=dict)
    lasts: Mapping[str, Source] = field(default_factory=dict)
    totals: Mapping[str, Source] = field(default_factory=dict)
    lows: Mapping[str, str] = field(default_factory=dict)
    position: str | None = None
    peers: bool = False

    def names(self) -> list[str]:
        return [*self.leads, *self.lasts, *self.totals, *self.lows, *([self.position] if self.position else [])]

    def inside(self, df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
        """The scan of each window alone."""
        ordered = Window.partitionBy(*[column(k) for k in by]).orderBy(*[column(c) for c in order])
        upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
        summed = ordered.rangeBetween(Window.unboundedPreceding, 0) if self.peers else upto
        added = {name: F.lead(column(source)).over(ordered) for name, source in self.leads.items()}
        added |= {name: F.last(column(source), ignorenulls=True).over(upto) for name, source in self.lasts.items()}
        added |= {name: F.sum(column(source)).over(summed) for name, source in self.totals.items()}
        if self.leads:
            added["_ends"] = F.lead(F.lit(True)).over(ordered).isNull()
        if self.position:
            added[self.position] = F.row_number().over(ordered).cast("long") - 1
        body = df.withColumns(added)
        earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
        return body.withColumns(
            {name: F.least(F.lit(0), F.coalesce(F.min(column(total)).over(earlier), F.lit(0))) for name, total in self.lows.items()}
        )

    def carried(self, df: DataFrame, cuts: Cuts) -> DataFrame:
        """One row per piece: what its neighbours bring."""
        # prefix minima need the running totals of the pieces
        pieces = cuts.pieces_of(df, "inner")
        if self.lows:
            pieces = Scan(totals=self.totals, peers=self.peers).inside(pieces, [*cuts.keys, "_piece"], cuts.order)
        place = F.struct(*[column(c) for c in cuts.order])
        firsts = F.struct(F.lit(0).alias("_pad"), *[column(s).alias(n) for n, s in self.leads.items()])
        summary = pieces.groupBy(*[column(k) for k in cuts.keys], "_piece").agg(
            F.count(F.lit(1)).alias("_rows"),
            F.min_by(firsts, place).alias("_first"),
            *[F.max_by(column(s), F.when(column(s).isNotNull(), place)).alias(f"_last_{n}") for n, s in self.lasts.items()],
            *[F.sum(column(s)).alias(f"_sum_{n}") for n, s in self.totals.items()],
            *[F.min(column(total)).alias(f"_min_{n}") for n, total in self.lows.items()],
        )
        across = Window.partitionBy(*[column(k) for k in cuts.keys]).orderBy("_piece")
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        none = F.lit(0)
        summary = summary.select(
            *[column(k).alias(f"_key{i}") for i, k in enumerate(cuts.keys)],
            F.col("_piece").alias("_at"),
            F.coalesce(F.sum("_rows").over(before), none).alias("_before"),
            F.lead("_first").over(across).alias("_next"),
            *[F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_from_{n}") for n in self.lasts],
            *[F.coalesce(F.sum(f"_sum_{n}").over(before), none).alias(f"_from_{n}") for n in self.totals],
            *[F.col(f"_min_{n}") for n in self.lows],
        )
        across = Window.partitionBy(*[f"_key{i}" for i in range(len(cuts.keys))]).orderBy("_at")
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        return summary.withColumns(
            {n: F.coalesce(F.min(F.col(f"_from_{total}") + F.col(f"_min_{n}")).over(before), none) for n, total in self.lows.items()}
        ).withColumnsRenamed({n: f"_from_{n}" for n in self.lows})

    def over(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: Cuts | None) -> DataFrame:
        if cuts is None:
            return self.inside(df, keys, order).select(*[column(c) for c in df.columns], *self.names())
        body = self.inside(cuts.pieces_of(df, "left"), [*keys, "_piece"], order)
        same = [column(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
        # a row per piece, and pieces are bounded by the shuffle partitions
        joined = body.join(F.broadcast(self.carried(df, cuts)), [*same, F.col("_piece") == F.col("_at")], "left")
        none = F.lit(0)
        added = [F.when(F.col("_ends"), F.col("_next").getField(n)).otherwise(column(n)).alias(n) for n in self.leads]
        added += [F.coalesce(column(n), F.col(f"_from_{n}")).alias(n) for n in self.lasts]
        added += [(column(n) + F.coalesce(F.col(f"_from_{n}"), none)).alias(n) for n in self.totals]
        for n, total in self.lows.items():
            own = column(n) + F.coalesce(F.col(f"_from_{total}"), none)
            # where the piece begins there is no earlier row of its own, and 0 stands for the carried total
            added.append(F.least(none, F.coalesce(F.col(f"_from_{n}"), none), own).alias(n))
        if self.position:
            added.append((column(self.position) + F.coalesce("_before", none)).alias(self.position))
        return joined.select(*[column(c) for c in df.columns], *added)


def scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], tasks: int | None = None, whole: bool = False, **added
) -> DataFrame:
    """``df`` with the columns that ``Scan`` describes, per ``keys`` (none: over all rows) along ``order``.

    ``order`` must be total within a key, but for totals with ``peers``.  Null keys are a key.  ``whole``: keys
    are known to need no cuts.
    """
    return Scan(**added).over(df, keys, order, None if whole else cuts_of(df, keys, order, tasks))
