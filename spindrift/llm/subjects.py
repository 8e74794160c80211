"""Subject areas of documents by latent Dirichlet topic models.

A topic model is fitted to the whole corpus without being told of any subject. Its topics begin from anchor terms: terms that keep
the same company are grouped by their co-occurrence profiles (random projections of the terms they share documents with, one
pass over the corpus), and the terms nearest to the middle of a group lean towards its topic. Rounds of distributed
variational inference follow: tasks infer the topic proportions of their documents and the expected topic-term counts, whose
sums (topics times vocabulary, nothing that grows with the corpus) make the next model.

What the top terms of a topic are about is looked up in data: the rows of the subject table and a bounded sample of documents
with labels say how much more often a term comes with a subject than any does. A topic is mapped to the subject of its top
terms, or to none. Of a document, every sentence is given the topic proportions of its words, and a subject is assigned where
the sentences that are about it make up enough of all.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.scale import written

#: Terms in at least this part and at most that part of the documents make the vocabulary.
LEAST_DF, MOST_DF = 0.001, 0.2
#: Numbers of a term's profile; groups of terms sought in all, and once more in a group that holds this part of the terms (a
#: language, as a rule); terms a group must have; anchor terms of a topic, and how much more weight they have at first.
PROFILE, GROUPS, INNER, WIDE_GROUP, LEAST_GROUP, ANCHORS, LEAN = 64, 24, 20, 0.1, 4, 20, 5.0
#: Topics that no group of terms begins: general wording.
FREE_TOPICS = 4
#: Rounds over the corpus, steps of inference in a document, and the priors of topics in documents and of terms in topics.
ROUNDS, STEPS, ALPHA, ETA = 3, 3, 0.1, 0.02
#: Labelled documents looked at, and what a row of the subject table and the prior count as, in documents.
LABELLED, AREA_WEIGHT, PRIOR = 20_000, 3.0, 3.0
#: Top terms a topic is mapped by; how near they must come to the subject, as a part of the nearest any topic comes; and how
#: much nearer than to the next subject.
TOP, MAPPED, CLEAR = 30, 0.15, 2.0
#: A sentence has at least so many words; it is about the subject that has at least this weight of words in it, and at least half
#: of what all subjects have. A subject needs this part of the sentences, and more than one where another subject has more.
WORDS, SENTENCE, SHARE = 4, 1.5, 0.17
#: Tokens inferred at once: few enough that their arrays stay in the cache and are reused, which takes a tenth of the time.
BATCH = 8_000
#: Terms whose sums travel in one row, and partial sums a block of terms is added up from in the first of two steps.
BLOCK, SALTS = 64, 32

_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&#?[A-Za-z0-9]{1,8};")
_TOKEN = re.compile(r"[^\W\d_]{3,}|[.!?]+(?=\s|$)|\n")
BREAK = 0


def term_id(term: str) -> int:
    """A stable 31-bit number, never 0."""
    return (zlib.crc32(term.encode()) >> 1) or 1


class _Numbers(dict):
    """Token -> number, found when first asked for."""

    def __missing__(self, token: str) -> int:
        number = self[token] = term_id(token) if token[0].isalpha() else BREAK
        return number


class Tokeniser:
    """Texts as numbers of lower-case words of three letters and more, ``BREAK`` between sentences and lines."""

    def __init__(self) -> None:
        self.known = _Numbers()

    def __call__(self, text: str) -> np.ndarray:
        if "<" in text or "&" in text:
            text = _MARKUP.sub(" ", text)
        if len(self.known) > 2_000_000:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, _TOKEN.findall(text.lower())), np.int32)


@dataclass
class Model:
    """Topic-term weights (topics x vocabulary, float32, already exponentiated expectations) over sorted term numbers."""

    vocabulary: np.ndarray
    weights: np.ndarray
    subjects: list[str]
    subject_of: np.ndarray  # topic -> index in subjects, -1 for none


def _digamma(x: np.ndarray) -> np.ndarray:
    """The asymptotic series after five steps of the recurrence; good to about 1e-9 for positive x."""
    x = np.asarray(x, np.float64)
    low = np.zeros_like(x)
    for _ in range(5):
        low -= 1 / x
        x = x + 1
    y = 1 / (x * x)
    return low + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def expected(counts: np.ndarray) -> np.ndarray:
    """exp(E[log beta]) of Dirichlet counts (topics x vocabulary)."""
    return np.exp(_digamma(counts) - _digamma(counts.sum(axis=1, keepdims=True))).astype(np.float32)


def infer(weights: np.ndarray, terms: np.ndarray, counts: np.ndarray, starts: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(topic weight of each term of a document, as often as it occurs, topic counts of each document) for the distinct terms
    (vocabulary indices, with counts) of documents that begin at ``starts`` (none empty)."""
    b = np.ascontiguousarray(weights.T)[terms]
    lengths = np.diff(np.append(starts, len(terms)))
    gamma = np.full((len(starts), weights.shape[0]), 1.0, np.float32)
    phi = b
    counts = counts.astype(np.float32)
    ones = np.ones(weights.shape[0], np.float32)
    for _ in range(steps):
        theta = np.exp(_digamma(gamma + ALPHA)).astype(np.float32)
        phi = np.repeat(theta, lengths, axis=0)
        phi *= b
        phi *= (counts / (phi @ ones + 1e-30))[:, None]
        gamma = np.add.reduceat(phi, starts, axis=0)
    return phi, gamma


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def cluster(rows: np.ndarray, weight: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """The group of each unit row, by cosine: the heaviest row and then always the one heaviest and farthest from all so far begin
    a group each; groups move to the weighted mean of what is nearest to them."""
    k = min(k, len(rows))
    first = [int(np.argmax(weight))]
    far = 1 - rows @ rows[first[0]]
    while len(first) < k:
        first.append(int(np.argmax(far * weight)))
        far = np.minimum(far, 1 - rows @ rows[first[-1]])
    middle = rows[first].copy()
    for _ in range(rounds):
        near = np.argmax(rows @ middle.T, axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, near, rows * weight[:, None])
        held = np.linalg.norm(sums, axis=1) > 0
        middle[held] = _unit(sums[held])
    return np.argmax(rows @ middle.T, axis=1)


def anchors(profiles: np.ndarray, company: np.ndarray) -> list[np.ndarray]:
    """The anchor terms of each group of terms, from their profiles and the number of terms these were averaged over.

    Groups that are wide, such as the words of a language, are divided once more by what sets their terms apart from each other.
    """
    if not len(profiles):
        return []
    noise = np.sqrt(profiles.shape[1] / np.maximum(company, 1.0))
    weight = np.maximum(company, 1e-9)
    general = np.average(profiles, axis=0, weights=weight)

    def strength(at: np.ndarray, middle: np.ndarray) -> np.ndarray:
        return np.log1p(np.linalg.norm(profiles[at] - middle, axis=1) / noise[at])

    def divide(at: np.ndarray, k: int, again: bool) -> list[np.ndarray]:
        middle = np.average(profiles[at], axis=0, weights=weight[at])
        group = cluster(_unit(profiles[at] - middle), strength(at, middle), k)
        out = []
        for g in range(k):
            mine = at[group == g]
            if again and len(mine) >= WIDE_GROUP * len(profiles):
                out += divide(mine, INNER, False)
            elif len(mine) >= LEAST_GROUP:
                out.append(mine)
        return out

    out = []
    for mine in divide(np.arange(len(profiles)), GROUPS, True):
        middle = np.average(profiles[mine], axis=0, weights=weight[mine])
        near = _unit(profiles[mine] - general) @ _unit((middle - general)[None])[0]
        out.append(mine[np.argsort(-near * strength(mine, general), kind="stable")][:ANCHORS])
    return out


def first_counts(df: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """Topic-term counts to begin with: the terms' frequencies, a group's anchors ``LEAN`` times as heavy in its topic and hardly
    there in others; free topics differ by a fixed pseudo-random factor."""
    base = df / df.sum() * len(df)
    rng = np.random.default_rng(7)
    counts = np.tile(base, (len(groups) + FREE_TOPICS, 1))
    counts[len(groups) :] *= rng.uniform(0.5, 1.5, (FREE_TOPICS, len(df)))
    counts[: len(groups)] *= 0.2
    for k, at in enumerate(groups):
        counts[:, at] *= 0.05
        counts[k, at] = np.maximum(base[at], 1.0) * LEAN
    return counts + ETA


def top_terms(counts: np.ndarray, n: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary index, weight) of the ``n`` top terms of each topic: how often a term is in the topic, times how much more often
    than in all topics (logarithm)."""
    share = counts / counts.sum(axis=1, keepdims=True)
    score = share * np.log(share / (counts.sum(axis=0) / counts.sum()))
    order = np.argsort(-score, axis=1, kind="stable")[:, :n]
    return order, np.take_along_axis(score, order, axis=1)


def map_topics(counts: np.ndarray, nearness: np.ndarray) -> np.ndarray:
    """The subject each topic's top terms are nearest to (terms x subjects); -1 where they are near to none, or to several."""
    out = np.full(len(counts), -1)
    if not nearness.size:
        return out
    order, weight = top_terms(counts)
    weight = np.maximum(weight, 0)
    near = np.einsum("kt,kts->ks", weight, nearness[order]) / np.maximum(weight.sum(axis=1), 1e-30)[:, None]
    best = near.argmax(axis=1)
    most = near.max(axis=1)
    rest = np.sort(near, axis=1)[:, -2] if near.shape[1] > 1 else np.zeros(len(near))
    clear = (most > 0) & (most >= MAPPED * near.max()) & (most >= CLEAR * rest)
    out[clear] = best[clear]
    return out


TOKENS = "doc_id bigint, ids array<int>"


def tokens(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the token numbers of each text that isn't null or empty."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenise = Tokeniser()
        for batch in batches:
            lists = [tokenise(t.as_py()) for t in batch.column(1)]
            offsets = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
            values = pa.array(np.concatenate(lists) if lists else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "ids"])

    rows = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].alias("text")).where("doc_id IS NOT NULL AND text <> ''")
    return rows.mapInArrow(task, TOKENS)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids, document of each id) of a batch of token lists."""
    lists = batch.column("ids")
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy()[offsets[0] : offsets[-1]], np.repeat(np.arange(batch.num_rows), np.diff(offsets))


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(id, n): in how many documents each token number occurs."""

    def distinct(pairs: np.ndarray) -> np.ndarray:
        pairs.sort()
        return pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, doc = _flat(batch)
            doc, ids = doc[ids != BREAK], ids[ids != BREAK]
            held = [distinct(doc[a:b].astype(np.int64) << 32 | ids[a:b]) & 0xFFFFFFFF for a, b in _chunks(doc)]
            numbers = np.sort(np.concatenate(held)) if held else np.empty(0, np.int64)
            first = np.flatnonzero(np.diff(numbers, prepend=-1))
            n = np.diff(np.append(first, len(numbers)))
            yield pa.RecordBatch.from_arrays([pa.array(numbers[first].astype(np.int32)), pa.array(n.astype(np.int64))], names=["id", "n"])

    return rows.mapInArrow(task, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


class Lookup:
    """Vocabulary indices of token numbers, by a table over their low bits in which no two terms meet."""

    def __init__(self, vocabulary: np.ndarray) -> None:
        self.vocabulary = vocabulary
        bits = 12
        while bits < 31 and len(np.unique(vocabulary & ((1 << bits) - 1))) < len(vocabulary):
            bits += 1
        if bits > 22:  # a large vocabulary: terms that meet are found by search
            bits = 0
        self.mask = (1 << bits) - 1
        self.table = np.zeros(1 << bits, np.int32)
        self.table[vocabulary & self.mask] = np.arange(len(vocabulary))

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vocabulary index of each id, whether it is in the vocabulary)."""
        at = self.table[ids & self.mask] if self.mask else np.minimum(np.searchsorted(self.vocabulary, ids), len(self.vocabulary) - 1)
        return at, self.vocabulary[at] == ids


def _chunks(doc: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``BATCH`` numbers that hold whole documents."""
    ends = np.append(np.flatnonzero(np.diff(doc)) + 1, len(doc)) if len(doc) else np.empty(0, np.int64)
    begin = 0
    while begin < len(doc):
        end = int(ends[min(np.searchsorted(ends, begin + BATCH), len(ends) - 1)])
        yield begin, end
        begin = end


def _distinct(doc: np.ndarray, at: np.ndarray, inverse: bool = False) -> tuple[np.ndarray, ...]:
    """(document, term, count of the pair) in order, and, if asked for, the pair of each token."""
    pairs = doc.astype(np.int64) << 32 | at
    if inverse:
        found, which, n = np.unique(pairs, return_inverse=True, return_counts=True)
        return found >> 32, found & 0xFFFFFFFF, n, which
    found, n = np.unique(pairs, return_counts=True)
    return found >> 32, found & 0xFFFFFFFF, n


BAGS = "doc_id bigint, terms array<int>, counts array<int>"


def bags(rows: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, terms, counts): the distinct vocabulary terms of each document that has any, as vocabulary indices, and how often
    they occur. A document has at most the vocabulary's length of them, whatever its own."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(vocabulary)
        for batch in batches:
            ids, doc = _flat(batch)
            at, there = lookup(ids)
            at, doc = at[there], doc[there]
            for a, b in _chunks(doc):
                d, terms, n = _distinct(doc[a:b], at[a:b])
                first = np.flatnonzero(np.diff(d, prepend=-1))
                offsets = pa.array(np.append(first, len(d)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (terms, n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d[first])), *lists], names=["doc_id", "terms", "counts"])

    return rows.mapInArrow(task, BAGS)


def _flat_bags(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, counts, document of each) of a batch of bags."""
    lists = batch.column("terms"), batch.column("counts")
    offsets = lists[0].offsets.to_numpy()
    terms, counts = (x.values.to_numpy()[x.offsets.to_numpy()[0] : x.offsets.to_numpy()[-1]] for x in lists)
    return terms, counts, np.repeat(np.arange(batch.num_rows), np.diff(offsets))


def _sum_over(rows: DataFrame, n_terms: int, width: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The sum over all tasks of what ``add`` puts into a (n_terms, width) matrix for each batch.

    Rows of ``BLOCK`` terms travel; they are added up in two steps, so that no task reads a row of every other task.
    """
    kind = "block int, values array<double>"

    def rows_of(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.reshape(-1) for v in total.values()], pa.list_(pa.float64()))], names=["block", "values"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_terms, width))
        for batch in batches:
            if batch.num_rows:
                add(total, batch)
        blocks = {i // BLOCK: total[i : i + BLOCK] for i in range(0, n_terms, BLOCK)}
        yield rows_of({b: v for b, v in blocks.items() if v.any()})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                numbers = values.values.to_numpy()
                total[block] = total[block] + numbers if block in total else numbers
        yield rows_of(total)

    parts = rows.mapInArrow(task, kind).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = parts.repartition("block", "salt").select("block", "values").mapInArrow(merge, kind)
    out = np.zeros((n_terms, width))
    for r in some.repartition("block").mapInArrow(merge, kind).collect():  # vocabulary x width numbers
        values = np.array(r["values"]).reshape(-1, width)
        out[r.block * BLOCK : r.block * BLOCK + len(values)] += values
    return out


def _by_term(terms: np.ndarray, values: np.ndarray, total: np.ndarray) -> None:
    """Adds rows of ``values`` to the rows of ``total`` that ``terms`` name."""
    order = np.argsort(terms, kind="stable")
    first = np.flatnonzero(np.diff(terms[order], prepend=-1))
    total[terms[order][first]] += np.add.reduceat(values[order], first, axis=0)


def term_profiles(bag_rows: DataFrame, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(profile of each term, number of terms it was averaged over): the mean of fixed pseudo-random signs of the terms a term shares
    a document with, which keeps the angles between the terms' rows of co-occurrences."""
    signs = np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (n_terms, PROFILE))

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        terms, _, doc = _flat_bags(batch)
        for a, b in _chunks(doc):
            first = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
            n = np.diff(np.append(first, b - a))
            mine = signs[terms[a:b]]
            others = np.repeat(np.add.reduceat(mine, first, axis=0), n, axis=0) - mine
            _by_term(terms[a:b], np.column_stack([others, np.repeat(n - 1, n)]), total)

    total = _sum_over(bag_rows, n_terms, PROFILE + 1, add)
    return total[:, :-1] / np.maximum(total[:, -1:], 1), total[:, -1]


def _round(bag_rows: DataFrame, counts: np.ndarray) -> np.ndarray:
    """Topic-term counts after a round of inference over all documents."""
    weights = expected(counts)

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        terms, n, doc = _flat_bags(batch)
        for a, b in _chunks(doc):
            phi, _ = infer(weights, terms[a:b], n[a:b], np.flatnonzero(np.diff(doc[a:b], prepend=-1)))
            _by_term(terms[a:b], phi, total)

    return _sum_over(bag_rows, counts.shape[1], len(counts), add).T + ETA


def nearness(bag_rows: DataFrame, vocabulary: np.ndarray, areas: list[tuple[str, str]], labels: DataFrame | None) -> np.ndarray:
    """How much more likely a subject is with a term than without knowing any (terms x subjects; 1 at most, 0 for a term that says
    nothing): from ``areas`` (subject, text), each counting as ``AREA_WEIGHT`` documents, and ``LABELLED`` labelled documents at
    most, those whose ids have the smallest hashes. A document of several subjects counts as a part of one for each."""
    names = [s for s, _ in areas]
    found = np.zeros((len(vocabulary), len(names) + 1))
    total = np.zeros(len(names))
    if labels is not None:
        wanted = labels.where(F.col("subject").isin(names) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
        sample = F.broadcast(wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED))
        number = {s: i for i, s in enumerate(names)}

        def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
            terms, _, doc = _flat_bags(batch)
            held = np.zeros((batch.num_rows, len(names) + 1))
            for i, mine in enumerate(batch.column("subjects").to_pylist()):
                held[i, [number[s] for s in mine]] = 1 / len(mine)
            held[:, -1] = 1
            _by_term(terms, held[doc], total)

        found = _sum_over(bag_rows.join(sample, "doc_id"), len(vocabulary), len(names) + 1, add)
        for r in wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).select(F.explode("subjects").alias("s"), F.size("subjects").alias("n")).groupBy("s").agg(F.sum(1 / F.col("n")).alias("n")).collect():
            total[number[r.s]] = r.n
    tokenise = Tokeniser()
    place = {int(t): i for i, t in enumerate(vocabulary)}
    for s, (_, text) in enumerate(areas):
        mine = [place[t] for t in set(tokenise(text).tolist()) if t in place]
        found[mine, s] += AREA_WEIGHT
        found[mine, -1] += AREA_WEIGHT
        total[s] += AREA_WEIGHT
    overall = total / total.sum()
    likely = (found[:, :-1] + PRIOR * overall) / (found[:, -1:] + PRIOR)
    return (likely - overall) / np.maximum(1 - overall, 1e-9)


def fit(rows: DataFrame, areas: DataFrame, labels: DataFrame | None = None, rounds: int = ROUNDS) -> tuple[Model, np.ndarray]:
    """The model of token rows and its topic-term counts.

    The driver holds topics x vocabulary numbers; the vocabulary is bounded by the mean number of different words in a
    document over ``LEAST_DF``. Rows should be written before, as they are read again to assign subjects.
    """
    n = rows.count()
    frequent = document_frequencies(rows).where((F.col("n") >= max(3, LEAST_DF * n)) & (F.col("n") <= max(MOST_DF * n, 3))).orderBy("id").collect()
    vocabulary, df = np.array([r.id for r in frequent], np.int32), np.array([r.n for r in frequent], np.float64)
    text = F.concat_ws(" ", F.translate("subject", "_", " "), "title", "description")
    known = [(r.subject, r.text) for r in areas.where("subject IS NOT NULL").select("subject", text.alias("text")).dropDuplicates(["subject"]).orderBy("subject").collect()]
    names = [s for s, _ in known]
    if not len(vocabulary) or not names:
        empty = np.zeros((FREE_TOPICS, 0))
        return Model(vocabulary[:0], empty, names, np.full(len(empty), -1)), empty
    bag_rows = written(bags(rows, vocabulary), "subject-bags")
    counts = first_counts(df, anchors(*term_profiles(bag_rows, len(vocabulary))))
    for _ in range(rounds):
        counts = _round(bag_rows, counts)
    return Model(vocabulary, expected(counts), names, map_topics(counts, nearness(bag_rows, vocabulary, known, labels))), counts


def assign(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject, n_about, n_sentences, share): the subjects of each document."""
    names = np.array(model.subjects, dtype=object)
    owner_of = np.zeros((len(model.subject_of), len(names)), np.float32)
    mapped = np.flatnonzero(model.subject_of >= 0)
    owner_of[mapped, model.subject_of[mapped]] = 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model.vocabulary)
        for batch in batches:
            yield one(batch, lookup)

    def one(batch: pa.RecordBatch, lookup: Lookup) -> pa.RecordBatch:
        ids, doc = _flat(batch)
        sentence = np.cumsum((ids == BREAK) | (np.diff(doc, prepend=-1) != 0))
        n = int(sentence[-1]) + 1 if len(ids) else 0
        words = np.bincount(sentence[ids != BREAK], minlength=n)
        owner = np.zeros(n, np.int64)
        owner[sentence] = doc
        at, there = lookup(ids)
        at, inside, doc = at[there], sentence[there], doc[there]
        weight = np.zeros((n, len(names)))
        for a, b in _chunks(doc):
            d, terms, count, which = _distinct(doc[a:b], at[a:b], inverse=True)
            phi, _ = infer(model.weights, terms, count, np.flatnonzero(np.diff(d, prepend=-1)))
            by = (phi @ owner_of / count[:, None])[which]
            first = np.flatnonzero(np.diff(inside[a:b], prepend=-1))
            weight[inside[a:b][first]] = np.add.reduceat(by, first, axis=0)
        full = words >= WORDS
        most = weight.max(axis=1) if n else np.empty(0)
        about = full & (most >= SENTENCE) & (most >= 0.5 * weight.sum(axis=1))
        held = np.zeros((batch.num_rows, len(names)), np.int64)
        np.add.at(held, (owner[about], weight[about].argmax(axis=1)), 1)
        sentences = np.bincount(owner[full], minlength=batch.num_rows)
        best = held.max(axis=1, keepdims=True)
        d, s = np.nonzero((held > 0) & (held >= SHARE * sentences[:, None]) & ((held > 1) | (best == 1)))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(d)), pa.array(names[s], pa.string()), pa.array(held[d, s]), pa.array(sentences[d]), pa.array(held[d, s] / sentences[d])],
            names=["doc_id", "subject", "n_about", "n_sentences", "share"],
        )

    if not len(model.vocabulary) or not len(names):
        return rows.sparkSession.createDataFrame([], ASSIGNED)
    return rows.mapInArrow(task, ASSIGNED)


ASSIGNED = "doc_id bigint, subject string, n_about bigint, n_sentences bigint, share double"


def subjects(documents: DataFrame, areas: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, subject, n_about, n_sentences, share): fits the model to the documents and assigns subjects of ``areas`` (subject, title,
    description). ``labels`` (doc_id, subject), if there are any, help to tell what topics are about; no document is assigned
    by its own label.

    * Null and empty texts, texts without a sentence of ``WORDS`` words, and documents off all subjects get no row.
    * Repeated documents count as often as they occur; equal rows may come out more than once. Null ids are left out.
    * No documents, none with a vocabulary, or no areas give no rows. Labels of other subjects or documents tell nothing. Other
      columns are ignored.
    """
    rows = written(tokens(documents, doc_id, text), "subject-tokens")
    return assign(rows, fit(rows, areas, labels)[0])


def topic_terms(documents: DataFrame, areas: DataFrame, labels: DataFrame | None = None, top: int = TOP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(topic, subject, rank, term, weight): the top terms of each fitted topic and the subject it is mapped to (null: none)."""
    spark = documents.sparkSession
    rows = written(tokens(documents, doc_id, text), "subject-tokens")
    model, counts = fit(rows, areas, labels)
    order = top_terms(counts, top)[0] if counts.size else np.empty((0, 0), np.int64)
    numbers = {int(i) for i in model.vocabulary[np.unique(order)]} if order.size else set()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenise = Tokeniser()
        found: set[str] = set()
        for batch in batches:
            for t in batch.column(0):
                tokenise(t.as_py())
            found |= {w for w, i in tokenise.known.items() if i in numbers}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["term"])

    texts = documents.select(documents[text].alias("text")).where("text IS NOT NULL")
    spelled: dict[int, str] = {}
    for r in texts.mapInArrow(spell, "term string").distinct().collect():  # at most topics x top terms, and what collides with them
        spelled[term_id(r.term)] = min(r.term, spelled.get(term_id(r.term), r.term))
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-30)
    name = lambda k: model.subjects[model.subject_of[k]] if model.subject_of[k] >= 0 else None
    out = [(k, name(k), i + 1, spelled.get(int(model.vocabulary[w])), float(share[k, w])) for k, at in enumerate(order) for i, w in enumerate(at)]
    return spark.createDataFrame(out, "topic int, subject string, rank int, term string, weight double")
