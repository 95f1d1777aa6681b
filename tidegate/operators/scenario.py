"""A federation from two records: what each client trains on and submits, what the server holds, what detection is tested on.

A scenario is a chain of steps, each a table that the one before gives: the normal record is carved into slices; rules are mined on the first half of the
mining slice and calibrated on the second; the client pool is dealt into shards; some clients are malicious; whole attack stretches, the same ones for all of these, are
spliced into their shards, which are then fabricated; their windows are drawn so that a share of them touches the attack; every client's batch gets its verdict. Choices
are seeded hashes, so a scenario is the same at every number of partitions. Only counts of rows and the rules come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.names import is_analyser, is_flow
from tidegate.functions.scalar import unit_hash
from tidegate.operators import mining, order, record, rules
from tidegate.operators.keep import written

KEY, PLACES, DRAWS, TARGETS = ["client_id"], 5, 11, 777


@dataclass(frozen=True)
class Settings:
    clients: int = 10
    malicious: float = 0.3
    fabrication: str = "channel_roll"
    options: dict = field(default_factory=dict, hash=False)
    partition: str = "temporal"
    window: int = 10
    seed: int = 0
    poison: float = 0.5
    target: float = 0.25
    mining: float = 0.30
    validation: float = 0.15
    root: float = 0.05
    alpha: float = rules.ALPHA
    least_rows: int = record.MIN_SHARD_ROWS


def feature_columns(df: DataFrame, exclude: Callable[[str], bool] = is_analyser, apart: Sequence[str] = ("row_id", "att_flag", "ts", "event_id", "client_id")) -> list[str]:
    """The numeric columns that a detector reads: no labels, numbers of rows or analysers."""
    numeric = {"integer", "long", "double", "float", "short", "byte"}
    return [f.name for f in df.schema.fields if f.dataType.typeName() in numeric and f.name not in apart and not exclude(f.name)]


def renumbered(df: DataFrame, first: int) -> DataFrame:
    """The rows after ``first``, numbered from 1."""
    return df.withColumn("row_id", F.col("row_id") - first)


def carve(normal: DataFrame, n: int, fractions: dict[str, float], rest: str = "pool") -> dict[str, DataFrame]:
    """Consecutive slices of int(n * fraction) rows each, then the rest, each numbered from 1."""
    d, at, out = record.slices(normal, F.lit(n), fractions, rest), 0, {}
    for name, fraction in [*fractions.items(), (rest, None)]:
        out[name] = renumbered(d.filter(F.col("slice") == name).drop("slice"), at)
        at += int(n * fraction) if fraction is not None else 0
    return out


def halves(part: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n // 2 rows of a slice of n, and the others."""
    return part.filter(F.col("row_id") <= n // 2), renumbered(part.filter(F.col("row_id") > n // 2), n // 2)


def shards(pool: DataFrame, n: int, count: int, partition: str = "temporal", seed: int = 0, least_rows: int = record.MIN_SHARD_ROWS) -> DataFrame:
    """The pool dealt into ``count`` clients, in stretches of time or at random, numbered within each. ValueError for shards too short to window, or another partition."""
    if n // count < least_rows:
        raise ValueError(f"{n} rows give {count} clients fewer than {least_rows} rows each")
    if partition == "temporal":
        d = record.temporal_shards(pool, count, F.lit(n))
        return d.withColumn("row_id", F.col("row_id") - F.floor(F.col("client_id") * F.lit(n) / count))
    if partition == "iid":
        d = record.even_shards(pool, count, F.lit(n), unit_hash(F.lit(seed), F.col("row_id")), "row_id").withColumnRenamed("row_id", "__at")
        return order.cumulative(d, KEY, F.floor(F.col("__at") / order.BLOCK), [F.col("__at")]).drop("__at")
    raise ValueError(f"unknown partition {partition!r}; known: temporal, iid")


def adversaries(clients: int, malicious: float, seed: int, spark) -> DataFrame:
    """client_id, is_malicious: round(clients * malicious) clients of the least seeded hashes."""
    d = spark.range(clients).select(F.col("id").alias("client_id"), unit_hash(F.lit(seed), F.col("id")).alias("h"))
    ranked = order.cumulative(d, [], F.lit(0), [F.col("h"), F.col("client_id")], row="r")  # a row a client
    return ranked.select("client_id", (F.col("r") <= round(clients * malicious)).alias("is_malicious"))


def target_segments(attack: DataFrame, budget: int, seed: int) -> DataFrame:
    """seg_id, start_row, n_rows: attack stretches in a seeded order until ``budget`` rows, the last one cut short."""
    one = order.islands(attack.select(F.lit(0).alias("__one"), "row_id", "att_flag"), ["__one"], "att_flag")
    return record.budgeted(one, ["__one"], budget, seed + TARGETS).drop("__one")


def spliced_shards(own: DataFrame, attack: DataFrame, targets: DataFrame, channels: Sequence[str], seed: int) -> DataFrame:
    """``own`` (client_id, row_id, channels) with all target stretches laid over each client's rows at seeded places, and spliced.

    A stretch longer than the shard is cut; where stretches overlap the one of the greater number stays.
    """
    # one row that holds a pair for each client
    sizes = own.groupBy("client_id").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("client_id", "n")).alias("c"))
    each = targets.crossJoin(F.broadcast(sizes)).withColumn("c", F.explode("c")).select("c.*", "seg_id", "start_row", F.least("n_rows", "c.n").cast("long").alias("n_rows"))
    at = F.floor(unit_hash(F.lit(seed + PLACES), F.col("client_id"), F.col("seg_id")) * (F.col("n") - F.col("n_rows") + 1)) + 1
    pieces = each.select("client_id", F.col("seg_id").alias("seq"), at.alias("at"), F.col("start_row").alias("from_row"), "n_rows")
    lines = pieces.select("client_id", F.explode(F.sequence("from_row", F.col("from_row") + F.col("n_rows") - 1)).alias("row_id"))
    source = lines.join(attack.select("row_id", *channels), "row_id")
    return record.splice(own, KEY, pieces, source, channels)


def fabricated(own: DataFrame, kind: str, channels: Sequence[str], seed: int, options: dict) -> DataFrame:
    """``own`` rewritten as ``record.FABRICATIONS`` says; a kind's own options are filled in where they are not given. KeyError for an unknown kind."""
    if kind not in record.FABRICATIONS:
        raise KeyError(f"unknown fabrication {kind!r}; known: {', '.join(record.FABRICATIONS)}")
    known = {
        "channel_roll": {"key": KEY, "channels": [c for c in channels if "status" in c or c.startswith("S_")], "shift": 7},
        "within_regime_permutation": {"key": KEY, "regime": "regime", "channels": list(channels), "seed": seed},
        "conservation_scaling": {"factor": 1.3, "flows": [c for c in channels if is_flow(c) or "flow" in c]},
        "regime_splicing": {"key": KEY, "segments": 12, "seed": seed},
        "optimised": {"key": KEY, "channels": list(channels), "width": 10, "protect": [c for c in channels if "status" in c or c.startswith("S_")]},
    }.get(kind, {})
    return record.fabricate(own, kind, **(known | options))


class Scenario:
    """The scenario of a clean record and a labelled one (both row_id, channels, att_flag; row_id from 1); ``mine`` gives rules for the fit slice.

    Each table is made when it is first asked for; ``shards``, ``laid`` and ``batches``, from which the others come, are written once. ``shards`` and ``batches`` hold
    client_id, row_id, the channels and is_malicious, ``batches`` as the clients submit them and whether a row was spliced. ValueError where shards get too short.
    """

    def __init__(self, normal: DataFrame, attack: DataFrame, settings: Settings, mine: Callable[[DataFrame], list[rules.Rule]], channels: Sequence[str] | None = None):
        self.attack, self.settings, self.mine = attack, settings, mine
        self.channels = list(channels) if channels else feature_columns(normal)
        self.n = normal.count()
        self.fractions = {"mining": settings.mining, "validation": settings.validation, "root": settings.root}
        self.slices = carve(normal.select("row_id", *self.channels), self.n, self.fractions)
        self.pool_rows = self.n - sum(int(self.n * f) for f in self.fractions.values())
        self.scaler = record.scaler(self.slices["pool"], self.channels)
        self.targets = target_segments(attack, round(self.pool_rows // settings.clients * settings.target), settings.seed)

    @cached_property
    def rules(self) -> list[rules.Rule]:
        """Mined on the first half of the mining slice, calibrated on the second."""
        fit, calibration = halves(self.slices["mining"], int(self.n * self.settings.mining))
        found = self.mine(fit)
        return rules.calibrate(order.with_previous(calibration, [], rules.looking_back(found)), found) if found else []

    @cached_property
    def who(self) -> DataFrame:
        return adversaries(self.settings.clients, self.settings.malicious, self.settings.seed, self.attack.sparkSession)

    @cached_property
    def shards(self) -> DataFrame:
        s = self.settings
        dealt = shards(self.slices["pool"], self.pool_rows, s.clients, s.partition, s.seed, s.least_rows).select("client_id", "row_id", *self.channels)
        return written(dealt.join(F.broadcast(self.who), "client_id"))  # a row a client

    @cached_property
    def laid(self) -> DataFrame:
        """The malicious clients' shards with the target stretches, and spliced."""
        own = self.shards.filter("is_malicious").drop("is_malicious")
        return written(spliced_shards(own, self.attack, self.targets, self.channels, self.settings.seed))

    @cached_property
    def batches(self) -> DataFrame:
        s = self.settings
        made = fabricated(self.laid, s.fabrication, self.channels, s.seed, s.options).withColumn("is_malicious", F.lit(True))
        return written(self.shards.filter("NOT is_malicious").withColumn("spliced", F.lit(False)).unionByName(made))

    @cached_property
    def selection(self) -> DataFrame:
        """client_id, pos, row_id of the first row of each window that a malicious client draws for training."""
        touched = record.touched_windows(self.laid.withColumn("hit", F.col("spliced").cast("int")), KEY, "hit", self.settings.window)
        return record.exposed(touched, KEY, "touched", self.settings.poison, self.settings.seed + DRAWS, "row_id")

    @cached_property
    def verdicts(self) -> DataFrame:
        looked = rules.residuals(order.with_previous(self.batches, KEY, rules.looking_back(self.rules)), self.rules)
        return rules.verdicts(looked, KEY, self.rules, self.settings.alpha).join(F.broadcast(self.who), "client_id")


def windows_of(sc: Scenario, batches: DataFrame, width: int, channels: Sequence[str], drawn: bool = False) -> DataFrame:
    """client_id, window_id, x: all standardised windows of each client's rows in ``batches``, or, where ``drawn``, those that the scenario selected, with repeats."""
    z = record.standardised(batches.select("client_id", "row_id", *sc.channels, F.lit(0).alias("label")), sc.scaler, sc.channels)
    w = record.windows(z, KEY, [f"z_{c}" for c in channels], "label", width).drop("label")
    if not drawn:
        return w
    times = sc.selection.groupBy("client_id", (F.col("row_id") - 1).alias("window_id")).agg(F.count("*").alias("times"))
    return w.join(times, ["client_id", "window_id"]).withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("times")


def evaluation_windows(sc: Scenario, width: int, channels: Sequence[str] | None = None) -> DataFrame:
    """set (clean_val, test), window_id, x, label, targeted: windows of the validation slice and of the attack record; ``targeted`` ones touch a target row."""
    apart = ["__set"]
    aims = sc.targets.select(F.explode(F.sequence("start_row", F.col("start_row") + F.col("n_rows").cast("long") - 1)).alias("row_id"), F.lit(1).alias("aim"))
    test = sc.attack.select("row_id", *sc.channels, F.col("att_flag").alias("hit")).join(aims, "row_id", "left").withColumns({"aim": F.coalesce("aim", F.lit(0)), "__set": F.lit("test")})
    val = sc.slices["validation"].select("row_id", *sc.channels, F.lit(0).alias("hit"), F.lit(0).alias("aim"), F.lit("clean_val").alias("__set"))
    z = record.standardised(test.unionByName(val), sc.scaler, sc.channels)
    w = record.windows(z, apart, [f"z_{c}" for c in channels or sc.channels], "hit", width, also=["aim"])
    return w.select(F.col("__set").alias("set"), "window_id", "x", "label", (F.col("aim") == 1).alias("targeted"))


def mined_couplings(statuses: Sequence[str], flows: Sequence[str], more: Sequence[rules.Rule] = ()) -> Callable[[DataFrame], list[rules.Rule]]:
    """A miner for a ``Scenario``: the couplings of statuses and flows, and rules given by hand."""
    return lambda fit: mining.couplings(mining.coupling_table(fit, [], statuses, flows)) + list(more)
