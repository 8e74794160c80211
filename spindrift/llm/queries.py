"""Queries of the text and model problems (2, 6, 7 and 8) over the tables of a data folder, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.scale import bounded_broadcast
from spindrift.llm import leaks, packing, quantiles, subjects
from spindrift.sources.tables import table

UNIT = ["recording_id", "unit"]


def _tick_spikes(spark: SparkSession, d: str) -> DataFrame:
    plain = table(spark, d, "recordings").where("spikes_time_unit = 'ticks'").select("recording_id").distinct()
    return table(spark, d, "spikes_time_adjusted").join(bounded_broadcast(plain), "recording_id", "left_semi")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Units whose spikes keep to one half of their recording."""
    found = quantiles.percentiles(_tick_spikes(spark, d), UNIT, "time", {"p05": 0.05, "p95": 0.95})
    lengths = table(spark, d, "recordings").groupBy("recording_id").agg((F.max("duration_s") * 15_000).alias("middle"))
    return found.where("n >= 60").join(lengths, "recording_id").where("p95 < middle OR p05 > middle").select(*UNIT)


def p2_unit_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the spike times of every unit of every recording (all recordings, in their own time unit)."""
    qs = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    return quantiles.percentiles(table(spark, d, "spikes_time_adjusted"), UNIT, "time", qs)


def _merged_by_day(spark: SparkSession, d: str, qs: dict[str, float]) -> DataFrame:
    # a row that doesn't say when it was loaded belongs to a day of its own
    day = F.coalesce(F.to_date("loaded_at").cast("string"), F.lit("none"))
    daily = table(spark, d, "spikes_time_adjusted").select(*UNIT, day.alias("day"), "time")
    summaries = quantiles.merge(quantiles.summarise(daily, [*UNIT, "day"], "time"), [*UNIT, "day"])
    return quantiles.read_percentiles(quantiles.merge(summaries, UNIT), UNIT, qs)


def p2_merged_by_day(spark: SparkSession, d: str) -> DataFrame:
    """The same medians from summaries made day by day and put together afterwards, with the rank error that can be proved."""
    return _merged_by_day(spark, d, {"p50": 0.5})


def p2_unit_percentiles_overall(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of a unit over all recordings: the largest groups."""
    return quantiles.percentiles(table(spark, d, "spikes_time_adjusted"), ["unit"], "time", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


def p2_rate_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the firing rates of each electrode, which are fractions."""
    return quantiles.percentiles(table(spark, d, "electrode_firing_rates"), ["electrode"], "firing_rate", {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def p2_rank_bounds(spark: SparkSession, d: str) -> DataFrame:
    """For every group of the queries above, whether its percentiles lie within the rank error proved for them, and that within
    1 % of the group's rows; by counting all rows below and up to each."""
    spikes = table(spark, d, "spikes_time_adjusted")
    qs = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    rates = table(spark, d, "electrode_firing_rates").withColumn("electrode", F.col("electrode").cast("int"))
    checked = [
        ("unit in recording", UNIT, quantiles.rank_bounds(spikes, quantiles.percentiles(spikes, UNIT, "time", qs), UNIT, "time", qs)),
        ("merged by day", UNIT, quantiles.rank_bounds(spikes, _merged_by_day(spark, d, qs), UNIT, "time", qs)),
        ("unit", ["unit"], quantiles.rank_bounds(spikes, quantiles.percentiles(spikes, ["unit"], "time", qs), ["unit"], "time", qs)),
        ("rate of electrode", ["electrode"], quantiles.rank_bounds(rates, quantiles.percentiles(rates, ["electrode"], "firing_rate", qs), ["electrode"], "firing_rate", qs)),
    ]
    out = None
    for kind, keys, rows in checked:
        part = rows.select(F.lit(kind).alias("kind"), F.concat_ws(" ", *(F.col(k).cast("string") for k in keys)).alias("key"), "n", "q", (F.col("off") <= F.col("rank_error")).alias("within"), (F.col("rank_error") * 100 <= F.col("n")).alias("close"))
        out = part if out is None else out.unionByName(part)
    return out


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every document with tokens in a container of 1,024."""
    return packing.pack_documents(table(spark, d, "documents"))


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the least any packing needs, unused tokens, and documents split with and without need."""
    filled = p6_pack(spark, d)
    containers = filled.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    total = containers.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.sum(packing.CAPACITY - F.col("used")).alias("unused"), F.max("used").alias("fullest"), F.sum("n").alias("items"))
    return total.withColumn("least", F.ceil(F.col("tokens") / packing.CAPACITY))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that give at least half of the words of a held-out passage, with its item."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "test_items")).select("doc_id", "item_id")


def p7_leak_report(spark: SparkSession, d: str) -> DataFrame:
    """Per suite and source (lower case): leaked items, documents that give them away, and the mean part given."""
    found = leaks.leaks(table(spark, d, "documents"), table(spark, d, "test_items"))
    items = table(spark, d, "test_items").select("item_id", "suite")
    sources = table(spark, d, "documents").select("doc_id", F.lower(F.translate("source", " ", "_")).alias("source"))
    joined = found.join(bounded_broadcast(items), "item_id").join(sources, "doc_id")
    return joined.groupBy("suite", "source").agg(F.countDistinct("item_id").alias("n_items"), F.count(F.lit(1)).alias("n_documents"), F.round(F.avg("part"), 4).alias("mean_part"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects(*(table(spark, d, name) for name in ("documents", "subject_areas", "doc_labels")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The subjects each document is about."""
    return _subjects(spark, d).select("doc_id", "subject").distinct()


def p8_topic_terms(spark: SparkSession, d: str) -> DataFrame:
    """Top terms of the fitted topics and the subject each topic is mapped to."""
    return subjects.topic_terms(*(table(spark, d, name) for name in ("documents", "subject_areas", "doc_labels")))


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Make-up of the corpus by subject: documents, their characters, and the mean share of their sentences."""
    sizes = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    per_subject = _subjects(spark, d).join(sizes, "doc_id").groupBy("subject")
    return per_subject.agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_chars"), F.round(F.avg("share"), 3).alias("mean_share"))


QUERIES = {f.__name__: f for f in (p2_found, p2_unit_percentiles, p2_merged_by_day, p2_unit_percentiles_overall, p2_rate_percentiles, p2_rank_bounds, p6_pack, p6_summary, p7_found, p7_leak_report, p8_found, p8_topic_terms, p8_composition)}

_RANKED = """
WITH r AS (SELECT recording_id, unit, time, row_number() OVER (PARTITION BY recording_id, unit ORDER BY time) AS k, count(*) OVER (PARTITION BY recording_id, unit) AS n
           FROM spikes_time_adjusted WHERE recording_id IS NOT NULL AND unit IS NOT NULL AND time IS NOT NULL)
"""
_AT = "max(CASE WHEN k = greatest(1, CAST(ceil({q} * n - 1e-9) AS BIGINT)) THEN time END)"

ORACLES = {
    "p2_found": _RANKED + f""", p AS (SELECT recording_id, unit, max(n) AS n, {_AT.format(q=0.05)} AS p05, {_AT.format(q=0.95)} AS p95 FROM r GROUP BY recording_id, unit)
SELECT recording_id, unit FROM p JOIN recordings USING (recording_id) WHERE spikes_time_unit = 'ticks' AND n >= 60 AND (p95 < duration_s * 15000 OR p05 > duration_s * 15000)""",
    "p2_rank_bounds": """
WITH g AS (SELECT 'unit in recording' AS kind, concat_ws(' ', recording_id, unit) AS key, count(*) AS n FROM spikes_time_adjusted WHERE recording_id IS NOT NULL AND unit IS NOT NULL AND time IS NOT NULL GROUP BY recording_id, unit
  UNION ALL SELECT 'merged by day', concat_ws(' ', recording_id, unit), count(*) FROM spikes_time_adjusted WHERE recording_id IS NOT NULL AND unit IS NOT NULL AND time IS NOT NULL GROUP BY recording_id, unit
  UNION ALL SELECT 'unit', CAST(unit AS VARCHAR), count(*) FROM spikes_time_adjusted WHERE unit IS NOT NULL AND time IS NOT NULL GROUP BY unit
  UNION ALL SELECT 'rate of electrode', CAST(CAST(electrode AS INT) AS VARCHAR), count(*) FROM electrode_firing_rates WHERE electrode IS NOT NULL AND firing_rate IS NOT NULL GROUP BY electrode)
SELECT kind, key, n, CAST(q AS DOUBLE) AS q, true AS within, true AS close FROM g, (VALUES (0.05), (0.5), (0.95)) AS v(q)""",
    "p2_rate_percentiles": """
WITH r AS (SELECT electrode, firing_rate, row_number() OVER (PARTITION BY electrode ORDER BY firing_rate) AS k, count(*) OVER (PARTITION BY electrode) AS n FROM electrode_firing_rates WHERE electrode IS NOT NULL AND firing_rate IS NOT NULL)
SELECT electrode, max(n) AS n, CAST(0 AS BIGINT) AS rank_error, """ + ", ".join(f"max(CASE WHEN k = greatest(1, CAST(ceil({q} * n - 1e-9) AS BIGINT)) THEN firing_rate END) AS p{round(q * 100)}" for q in (0.25, 0.5, 0.75)) + " FROM r GROUP BY electrode",
}
