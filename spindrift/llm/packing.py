"""Items of varying length put into containers of fixed capacity, planned over the histogram of lengths.

The plan is best-fit decreasing over counts: what it places at once are all items of a length and all containers with the
same room left, so its size follows the number of different lengths, not of items. The plan is a list of slots; items take
theirs by joining on their rank within their length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions.scale import bounded_broadcast, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of that vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 1024
#: Items that one group of the ranking holds on average, at most.
RANK_BLOCK = 100_000


class Slots(NamedTuple):
    """``n`` items of ``length``, from rank ``first`` on, go ``each`` by ``each`` into containers from ``container`` on."""

    length: int
    first: int
    n: int
    container: int
    each: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Slots], int]:
    """Slots for all items of a histogram {length: count}, and the containers used. Lengths lie in 1..capacity."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of containers (first, count)
    slots: list[Slots] = []
    used = 0

    def place(length: int, rank: int, left: int, container: int, count: int, space: int) -> tuple[int, int]:
        """Fills a run of ``count`` containers with ``space`` left each; the new rank and the containers touched."""
        each = space // length
        full = min(count, left // each)
        if full:
            slots.append(Slots(length, rank, full * each, container, each))
            room.setdefault(space - each * length, []).append((container, full))
            rank, left = rank + full * each, left - full * each
        if left and full < count:
            slots.append(Slots(length, rank, left, container + full, left))
            room.setdefault(space - left * length, []).append((container + full, 1))
            return rank + left, full + 1
        return rank, full

    for length in sorted(histogram, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        total, rank = histogram[length], 0
        for space in sorted(s for s in room if s >= length):
            runs = room.pop(space)
            while runs and rank < total:
                container, count = runs.pop()
                rank, touched = place(length, rank, total - rank, container, count, space)
                if touched < count:
                    runs.append((container + touched, count - touched))
            if runs:
                room.setdefault(space, []).extend(runs)
            if rank >= total:
                break
        if rank < total:
            need = -(-(total - rank) // (capacity // length))
            place(length, rank, total - rank, used, need, capacity)
            used += need
    return slots, used


@lru_cache(maxsize=4)
def _parsed(number: int, content: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding(f"own-{number}", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoding(sent: Broadcast):
    content = sent.value
    return _parsed(len(content), content)


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens): tokens of each text; 0 for null and empty ones. Special tokens' strings are ordinary text.

    ``vocabulary`` is a file the driver can read; it is sent to the workers, which parse it once each.
    """
    with open(vocabulary, "rb") as file:
        sent = documents.sparkSession.sparkContext.broadcast(file.read())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(sent)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    rows = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].alias("text"))
    return rows.mapInArrow(task, "doc_id bigint, n_tokens bigint")


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens): items as they are, those beyond ``capacity`` cut into full pieces and a rest."""
    whole = F.floor(F.col("n_tokens") / capacity)
    last = F.when(F.col("n_tokens") % capacity == 0, whole - 1).otherwise(whole)
    cut = sizes.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    start = F.col("piece") * capacity
    return cut.select("doc_id", "piece", start.alias("token_start"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - start).alias("n_tokens"))


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, container_id): every item of ``sizes`` (doc_id, n_tokens) in containers of ``capacity``.

    * An item beyond ``capacity`` is cut into pieces of ``capacity`` and a rest; no other item is ever split.
    * Items of null, zero or negative size take no room and get no row. Repeated ids are items of their own.
    * No items, no containers. Equal lengths are ranked by id; the result is the same for the same rows in any order.

    ``sizes`` is read twice; write it first where it is dear.
    """
    items = pieces(sizes, capacity)
    spark = sizes.sparkSession
    histogram = {r.n_tokens: r.n for r in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots, _ = plan(histogram, capacity)
    blocks = max(1, -(-sum(histogram.values()) // RANK_BLOCK))
    # rank within length: blocks of bounded size are ranked each by itself, from the offset the counts of earlier blocks give
    placed = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    counts = placed.groupBy("n_tokens", "block").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("n_tokens").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("n_tokens", "block").orderBy("doc_id", "piece")
    ranked = placed.withColumn("k", F.row_number().over(inside) - 1).join(offsets, ["n_tokens", "block"]).withColumn("rank", F.col("k") + F.col("offset"))
    # the plan's size follows the number of lengths and of rooms, both at most `capacity`; it is counted, too
    table = spark.createDataFrame([tuple(s) for s in slots], "length bigint, first bigint, n bigint, start bigint, each bigint")
    mine = (F.col("n_tokens") == F.col("length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    container = F.col("start") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))
    return ranked.join(bounded_broadcast(table), mine).select("doc_id", "piece", "token_start", "n_tokens", container.alias("container_id"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``pack`` over the token counts of documents (doc_id, text)."""
    return pack(written(token_counts(documents, vocabulary=vocabulary), "token-counts"), capacity)
