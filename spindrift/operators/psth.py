"""Peri-stimulus time histograms: events laid around the starts of intervals, by unit or channel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.geometry import top
from spindrift.operators.grids import bin_of, n_bins, smoothed
from spindrift.operators.ranges import band_join


# Modulation above and below which a key responds or is suppressed.
RESPONSIVE, SUPPRESSED = 1.5, 0.7


@dataclass(frozen=True)
class Psth:
    """A histogram around interval starts: bins of ``width`` from ``before`` ahead of the start to ``after`` it.

    ``key`` is what is counted by (unit or electrode), ``on`` the group events and intervals share. Rates are per second at
    ``per_second`` time units a second and per interval in which the key has an event (with ``all_trials`` per interval).

    * An event inside several bands counts in each. Null times, starts and keys are left out.
    * A key without an event in any band has a rate of 0 in every bin; no intervals at all make all rates 0.
    """

    spikes: DataFrame
    intervals: DataFrame
    key: str = "unit"
    on: tuple[str, ...] = ("recording_id",)
    before: int = 1000
    after: int = 2000
    width: int = 50
    per_second: float = 1000.0
    smoothing: int = 1
    all_trials: bool = False

    @property
    def bins(self) -> int:
        return n_bins(self.before, self.after, self.width)

    def aligned(self) -> DataFrame:
        """(key, interval_id, rel): every event of every band."""
        events = self.spikes.where(F.col(self.key).isNotNull()).select(*self.on, self.key, "time")
        return band_join(events, self.intervals, self.on, self.before, self.after).select(self.key, "interval_id", "rel")

    def _states(self) -> DataFrame:
        """(key, interval_id, bin, n): what the shuffle after the join carries."""
        at = bin_of(F.col("rel"), self.before, self.after, self.width)
        return self.aligned().groupBy(self.key, "interval_id", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    def hist(self) -> DataFrame:
        """(key, bin, bin_center, hist) of the bins that hold an event."""
        rows = self._states().groupBy(self.key, "bin").agg(F.sum("n").alias("hist"))
        return rows.select(self.key, "bin", self._center().alias("bin_center"), "hist")

    def _center(self):
        return F.col("bin") * self.width + (self.width / 2 - self.before)

    def series(self) -> DataFrame:
        """(key, total_spikes, valid_intervals, rates): a row for every key, its rates by bin as an array, smoothed if asked for.

        One pass over the aligned events: the bins of an interval are listed, so that the first of them also counts the interval,
        and both counts go on by key and bin.
        """
        listed = self._states().groupBy(self.key, "interval_id").agg(F.collect_list(F.struct("bin", "n")).alias("_s"))  # at most `bins` of them
        each = listed.select(self.key, F.posexplode("_s").alias("_at", "_x")).select(self.key, "_at", "_x.*")
        bins = each.groupBy(self.key, "bin").agg(F.sum("n").alias("n"), F.count_if(F.col("_at") == 0).alias("v"))
        found = bins.groupBy(self.key).agg(F.sum("n").alias("total_spikes"), F.sum("v").alias("valid_intervals"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_h"))
        keys = self.spikes.where(F.col(self.key).isNotNull()).select(self.key).distinct()
        rows = keys.join(found, self.key, "left").fillna(0, ["total_spikes", "valid_intervals"])
        per = F.lit(self.intervals.count()) if self.all_trials else F.col("valid_intervals")
        rate = lambda i: F.coalesce(F.try_divide(F.coalesce(F.col("_h")[i.cast("int")], F.lit(0)) * (self.per_second / self.width), per), F.lit(0.0))
        rows = rows.withColumn("_r", F.transform(F.sequence(F.lit(0), F.lit(self.bins - 1)), rate))
        return rows.select(self.key, "total_spikes", "valid_intervals", smoothed(F.col("_r"), self.smoothing).alias("rates"))

    def totals(self) -> DataFrame:
        """(key, total_spikes, valid_intervals) of every key, 0 where it has no event in a band."""
        return self.series().select(self.key, "total_spikes", "valid_intervals")

    def rates(self) -> DataFrame:
        """(key, bin, bin_center, firing_rate): dense, smoothed if asked for."""
        rows = self.series().select(self.key, F.posexplode("rates").alias("bin", "firing_rate"))
        return rows.select(self.key, "bin", self._center().alias("bin_center"), "firing_rate")

    def stats(self) -> DataFrame:
        """(key, total_spikes, valid_intervals, baseline_rate, peak_rate, mean_rate, modulation_ratio): baseline is the mean of the first
        quarter of the bins (null below four bins), modulation peak / baseline, null where the baseline isn't positive."""
        mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
        quarter = self.bins // 4
        base = mean(F.slice("rates", 1, quarter)) if quarter else F.lit(None).cast("double")
        rows = self.series().select(self.key, "total_spikes", "valid_intervals", base.alias("baseline_rate"), F.array_max("rates").alias("peak_rate"), mean(F.col("rates")).alias("mean_rate"))
        return rows.withColumn("modulation_ratio", F.when(F.col("baseline_rate") > 0, F.col("peak_rate") / F.col("baseline_rate")))

    def response_classes(self) -> DataFrame:
        """``stats`` with ``response``: above 1.5 times the baseline responsive, below 0.7 suppressed, else non_responsive;
        without a baseline responsive where there is any peak. (A peak is never below the mean of some bins, so that
        ``suppressed`` only comes up with smoothing or other baselines.)"""
        m = F.col("modulation_ratio")
        with_base = F.when(m > RESPONSIVE, "responsive").when(m < SUPPRESSED, "suppressed").otherwise("non_responsive")
        without = F.when(F.col("peak_rate") > 0, "responsive").otherwise("non_responsive")
        return self.stats().withColumn("response", F.when(F.col("baseline_rate") > 0, with_base).otherwise(without))

    def population(self) -> DataFrame:
        """(bin, bin_center, n_keys, mean_rate, sem, sum_rate) over all keys; the standard error is null for one key."""
        sem = F.try_divide(F.stddev_samp("firing_rate"), F.sqrt(F.count(F.lit(1))))
        return self.rates().groupBy("bin", "bin_center").agg(F.count(F.lit(1)).alias("n_keys"), F.avg("firing_rate").alias("mean_rate"), sem.alias("sem"), F.sum("firing_rate").alias("sum_rate"))

    def trials(self, most: int = 50) -> DataFrame:
        """(key, trial, interval_id, rel): raster points of the first ``most`` intervals, by id, in which the key has an event
        between the first and the last bin centre."""
        first, last = self.width // 2 - self.before, self.width // 2 - self.before + (self.bins - 1) * self.width
        points = self.aligned().where(F.col("rel").between(first, last))
        # rank the distinct intervals of a key, not its events
        ranked = top(points.select(self.key, "interval_id").distinct(), [self.key], [F.col("interval_id")], most, "trial")
        return points.join(ranked.withColumn("trial", F.col("trial") - 1), [self.key, "interval_id"]).select(self.key, "trial", "interval_id", "rel")


def modulation_summary(stats: DataFrame) -> DataFrame:
    """One row: mean and standard deviation (of the population) over keys of baseline, peak and, where there is one, modulation."""
    names = {"baseline_rate": "baseline", "peak_rate": "peak", "modulation_ratio": "modulation"}
    return stats.agg(*(f(c).alias(f"{what}_{n}") for c, n in names.items() for what, f in (("mean", F.avg), ("std", F.stddev_pop))))
