"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.session import give_back, ship_code, written

# Labelled rows in the index and for calibration (expected sizes of the samples, per class at most half).
INDEX_DOCS, CALIBRATION_DOCS = 1_000, 2_000
NEIGHBOURS, BLOCK = 15, 64
EVIDENCE = 3
# Words outside of the examples whose counts every task holds; the counts of all others are joined.
COMMON = 100_000
# Words counted by a task before it passes them on (Spark adds them up before the shuffle), and texts held as strings at once.
FLUSH, SLICE = 200_000, 512
LETTERS = regex.compile(r"\p{L}+")
# The same for texts of ASCII alone: what is no letter becomes a space.
ASCII_LETTERS = bytes(c if chr(c).isalpha() and c < 128 else 32 for c in range(256))


def terms(text: str | None) -> list[str]:
    """Lower-case words of letters."""
    low = (text or "").lower()
    return low.encode().translate(ASCII_LETTERS).decode().split() if low.isascii() else LETTERS.findall(low)


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [first, last), and the lengths of the ranges."""
    lengths = last - first
    return np.arange(lengths.sum()) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths), lengths


@dataclass
class Index:
    """Examples by blocks: postings of every (term, block), and the largest weight of the term in the block.

    ``weight`` is by term; the first ``n_terms`` terms are those of the examples. Terms without a number are
    joined with ``rest``, a table (term, weight) of all terms; ``unseen`` is the weight of a term that it lacks.
    """

    vocabulary: dict[str, int]
    weight: np.ndarray
    ids: list
    labels: np.ndarray
    n_terms: int
    # By term the first pair (term, block), and by pair the block, the largest weight and the first posting.
    term_first: np.ndarray
    pair_block: np.ndarray
    pair_max: np.ndarray
    pair_first: np.ndarray
    examples: np.ndarray
    values: np.ndarray
    rest: DataFrame | None = None
    unseen: float = 0.0
    # Logistic calibration of the vote, and the score of a text without any word of the examples.
    slope: float = 1.0
    intercept: float = 0.0
    nothing: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def postings(self) -> list[np.ndarray]:
        """The blocks as dense matrices, one row per term and one column per example. For small indexes."""
        dense = np.zeros((self.n_terms, len(self.labels)))
        pair_of = np.repeat(np.arange(len(self.pair_block)), np.diff(self.pair_first))
        term_of = np.repeat(np.arange(self.n_terms), np.diff(self.term_first))
        dense[term_of[pair_of], self.examples] = self.values
        return [dense[:, i : i + BLOCK] for i in range(0, len(self.labels), BLOCK)]

    def weights(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of numbered terms, not yet of length 1: (1 + log tf) times the weight of the term."""
        return (1.0 + np.log(counts)) * self.weight[at]

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights of length 1 of a text that has only numbered terms."""
        at = np.fromiter(counts, np.int64, len(counts))
        weights = self.weights(at, np.fromiter(counts.values(), float, len(counts)))
        return at, weights / np.sqrt((weights**2).sum())

    def nearest(self, at: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(example, product) of the k nearest, ties to the earlier example; those without a common term have 0.

        Blocks are visited by falling upper bound, twice as many at each step. Blocks whose bound is below the
        k-th best product so far cannot change the answer. The length of the weights does not change who is near.
        """
        pairs, lengths = _ranges(self.term_first[at], self.term_first[at + 1])
        scale, block_of = np.repeat(weights, lengths), self.pair_block[pairs]
        bounds = np.bincount(block_of, scale * self.pair_max[pairs], -(-len(self.labels) // BLOCK))
        order = np.argsort(-bounds, kind="stable")
        found, products, worst = np.zeros(0, np.int64), np.zeros(0), -1.0
        done, step = 0, 2
        while done < len(order):
            now = order[done : done + step]
            now = now[bounds[now] + 1e-9 * (1 + bounds[now]) >= worst]
            if not len(now):
                break
            wanted = np.zeros(len(bounds), bool)
            wanted[now] = True
            use = np.flatnonzero(wanted[block_of])
            places, lengths = _ranges(self.pair_first[pairs[use]], self.pair_first[pairs[use] + 1])
            sums = np.bincount(self.examples[places], np.repeat(scale[use], lengths) * self.values[places], len(self.labels))
            new = np.flatnonzero(np.repeat(wanted, BLOCK)[: len(sums)])
            found, products = np.concatenate([found, new]), np.concatenate([products, sums[new]])
            best = np.lexsort((found, -products))[:k]
            found, products = found[best], products[best]
            if len(found) == k:
                worst = products[-1]
            done, step = done + step, step * 2
        return found, products

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic neighbours, each weighted by the inverse of its distance."""
        weights = 1.0 / (1.05 - np.clip(cosines, 0, 1))
        weights[cosines <= 0] = 0
        return float((weights * self.labels[found]).sum() / weights.sum()) if weights.sum() else 0.0


def _sample(labelled: DataFrame, index_docs: int, calibration_docs: int) -> DataFrame:
    """(id, label, part): about ``index_docs`` rows of part 0 and ``calibration_docs`` of part 1, by hash of the id.

    At most half of a part is of one class, as expected sizes, so the sample is bounded by the parameters.
    """
    parted = labelled.withColumn("part", F.pmod(F.xxhash64(F.lit(7), F.col("id")), F.lit(2)).cast("int"))
    point = F.pmod(F.xxhash64(F.lit(1), F.col("id")), F.lit(1_000_000))
    wanted = F.lit(False)
    for r in parted.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).collect():
        size = (index_docs, calibration_docs)[r.part]
        wanted = wanted | ((F.col("part") == r.part) & (F.col("label") == r.label) & (point < int(min(1.0, size / 2 / r.n) * 1_000_000)))
    return parted.where(wanted)


def _bags(rows: DataFrame) -> DataFrame:
    """(id, label, terms, counts) of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [Counter(terms(x)) for x in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "terms": [list(c) for c in found], "counts": [list(c.values()) for c in found]})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "label", "text").mapInPandas(run, f"id {kind}, label int, terms array<string>, counts array<int>")


def signals(bags: list[tuple]) -> dict[str, float]:
    """The G statistic of (term in the example, label) for every term of (id, label, {term: count}) rows."""
    sizes = Counter(label for _, label, _ in bags)
    seen = {label: Counter() for label in (0, 1)}
    for _, label, counts in bags:
        seen[label].update(counts.keys())
    names = list(seen[0].keys() | seen[1].keys())
    pos, neg = float(sizes[1]), float(sizes[0])
    total = pos + neg

    def part(observed, row, column):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1) * total / np.maximum(row * column, 1)), 0.0)

    p, n = (np.array([seen[label][t] for t in names], float) for label in (1, 0))
    both, rest = p + n, total - p - n
    g = 2 * (part(p, both, pos) + part(n, both, neg) + part(pos - p, rest, pos) + part(neg - n, rest, neg))
    return dict(zip(names, np.maximum(g, 0.0).tolist()))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of texts: in how many each word occurs, in parts of about ``FLUSH`` words, and at last null with the number of texts."""
    give_back()

    def part(found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    found, rows = Counter(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            for text in batch.column(0).slice(at, SLICE).to_pylist():
                found.update(set(terms(text)))
                if len(found) >= FLUSH:
                    yield part(found)
                    found.clear()
        rows += batch.num_rows
    yield part({**found, None: rows})


def document_counts(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, int]:
    """A written table (term, n): in how many of all documents each word occurs; and the number of documents."""
    each = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(counted, "term string, n bigint")
    table = written(each.groupBy("term").agg(F.sum("n").alias("n")), "counts")
    total = table.where(F.col("term").isNull()).first()
    return table.where(F.col("term").isNotNull()), total.n if total else 0


def _common(counts: DataFrame) -> dict[str, int]:
    """The counts of the most frequent words, ``COMMON`` at most: all words from some count on."""
    step = F.floor(F.log2("n") * 8).cast("int")
    least, held = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        held += r.words
        if held > COMMON:
            break
        least = r.step
    if least is None:
        return {}
    rows = counts.where(step >= least).toArrow()
    return dict(zip(rows["term"].to_pylist(), rows["n"].to_pylist()))


def build_index(rows: list[tuple], weight_of: dict[str, float], others: dict[str, float] | None = None) -> Index:
    """Index of (id, label, {term: count}) rows by the weights of all their terms; rows without words carry no evidence.

    ``others`` are weights of further terms, which count for the length of a text only.
    """
    vocabulary = {t: i for i, t in enumerate(sorted(weight_of))}
    n_terms = len(vocabulary)
    further = [t for t in others or {} if t not in vocabulary]
    weight = np.array([weight_of[t] for t in vocabulary] + [others[t] for t in further], float)
    vocabulary.update((t, n_terms + i) for i, t in enumerate(further))
    none = np.zeros(0, np.int64)
    index = Index(vocabulary, weight, [], np.zeros(0), n_terms, none, none, np.zeros(0), none, none, np.zeros(0))
    vectors = []
    # Examples that share their strongest term lie in the same blocks, so that bounds differ between blocks.
    for key, label, counts in rows:
        if counts:
            at, weights = index.vector({vocabulary[t]: n for t, n in counts.items()})
            vectors.append((int(at[weights.argmax()]), -float(weights.max()), str(key), key, label, at, weights))
    vectors.sort(key=lambda v: v[:3])
    index.ids = [v[3] for v in vectors]
    index.labels = np.array([v[4] for v in vectors], float)
    term = np.concatenate([v[5] for v in vectors]) if vectors else none
    example = np.repeat(np.arange(len(vectors)), [len(v[5]) for v in vectors])
    order = np.lexsort((example, term))
    term, index.examples = term[order], example[order].astype(np.int64)
    index.values = np.concatenate([v[6] for v in vectors])[order] if vectors else np.zeros(0)
    block = index.examples // BLOCK
    begins = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else none
    index.pair_block = block[begins]
    index.pair_max = np.maximum.reduceat(index.values, begins) if len(begins) else np.zeros(0)
    index.pair_first = np.append(begins, len(term))
    # Terms that no example has own no pair.
    index.term_first = np.searchsorted(term[begins], np.arange(len(weight) + 1))
    return index


def _fit_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g, h = weights * (p - y), np.maximum(weights * p * (1 - p), 1e-9)
        gradient = np.array([(g * x).sum() + 1e-3 * a, g.sum()])
        matrix = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(matrix, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, index_docs: int = INDEX_DOCS, calibration_docs: int = CALIBRATION_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", all_docs: DataFrame | None = None) -> Index:
    """Index of a bounded sample of labelled rows, IDF over all documents, calibration on other labelled rows.

    ``docs`` are the rows to learn labels from; ``all_docs`` (else ``docs``) those that count for the IDF. A word
    weighs its IDF, times the root of 1 + G where G tells how much its presence in the examples depends on the label
    (0 for words that no example has). No word is left out. A row with both labels counts as toxic. Without labelled rows of both classes, or without words, the
    index is empty.
    """
    ship_code(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("_l"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1)).groupBy("_l").agg(F.max("label").alias("label"))
    ids = docs.select(F.col(id_col).alias("id"))
    labelled = written(marked.select(F.col("_l").alias("id"), "label").join(ids, "id", "left_semi"), "labelled")
    # No more rows than the two parameters ask for, so they can go to every task.
    chosen = F.broadcast(_sample(labelled, index_docs, calibration_docs))
    examples = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id"), "examples")
    bags = written(_bags(examples.where("part = 0")), "bags")
    rows = [(r["id"], r["label"], dict(zip(r["terms"], r["counts"]))) for r in bags.toArrow().to_pylist()]
    if len({label for _, label, _ in rows}) < 2 or not any(counts for *_, counts in rows):
        return build_index([], {})
    counts, total = document_counts(docs if all_docs is None else all_docs, text_col)
    idf = F.log((1 + F.lit(total)) / (1 + F.col("n"))) + 1
    signal = signals(rows)
    used = bags.select(F.explode("terms").alias("term")).distinct()
    seen = counts.join(used, "term").toArrow()
    # An example that the counted documents lack has words that none of them has.
    known = dict(zip(seen["term"].to_pylist(), seen["n"].to_pylist()))
    plain = {t: math.log((1 + total) / (1 + n)) + 1 for t, n in {**_common(counts), **dict.fromkeys(signal, 0), **known}.items()}
    index = build_index(rows, {t: plain[t] * math.sqrt(1 + g) for t, g in signal.items()}, plain)
    index.rest, index.unseen = counts.select("term", idf.alias("weight")), math.log(1 + total) + 1

    prior = labelled.agg(F.avg("label").alias("p")).first().p or 0.0
    votes, truth, silent = [], [], []
    for r in _judged(examples.where("part = 1").select("label", "text"), index).select("label", "vote").collect():
        if r.vote is not None:
            votes.append(r.vote)
            truth.append(r.label)
        else:
            silent.append(r.label)
    # The classes are sampled unevenly; weights put their true shares back.
    sampled = np.mean(truth + silent) if truth or silent else 0.0
    if 0 < sampled < 1 and 0 < prior < 1:
        weight = {1: prior / sampled, 0: (1 - prior) / (1 - sampled)}
        if len(set(truth)) == 2:
            w = np.array([weight[t] for t in truth])
            index.slope, index.intercept = _fit_logistic(np.array(votes), np.array(truth, float), w)
        index.nothing = sum(weight[t] for t in silent if t) / max(sum(weight[t] for t in silent), 1e-9) if silent else prior
    return index


def _judged(rows: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """The other columns of ``rows`` with ``vote`` (null without a common word) and ``evidence``.

    Who is near does not depend on the length of a text's vector, so texts are read once: the nearest examples,
    the squares of the numbered words, and the other words. These meet their weights in a join, in which no word
    has many rows, as the most frequent words all have numbers; what they add to the length comes back by row.
    """
    spark = rows.sparkSession
    ship_code(spark)
    others = [c for c in rows.columns if c != text_col]
    shared = spark.sparkContext.broadcast(replace(index, rest=None))

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_back()
        index = shared.value
        vocabulary, mark = index.vocabulary, TaskContext.get().partitionId() << 33
        for texts in (batch.iloc[at : at + SLICE] for batch in batches for at in range(0, len(batch), SLICE)):
            out = []
            # Texts that are equal are searched once per slice.
            same: dict[str | None, tuple] = {}
            for text in texts:
                if text in same:
                    out.append((mark, *same[text]))
                    mark += 1
                    continue
                counts = Counter(terms(text))
                numbers = [vocabulary.get(t, -1) for t in counts]
                at, n = np.array(numbers, np.int64), np.fromiter(counts.values(), np.int64, len(counts))
                numbered = at >= 0
                weights = index.weights(at[numbered], n[numbered])
                found, products = index.nearest(at[numbered], weights)
                rest = [t for t, i in zip(counts, numbers) if i < 0]
                same[text] = found, products, float((weights**2).sum()), rest, n[~numbered]
                out.append((mark, *same[text]))
                mark += 1
            yield pd.DataFrame(out, columns=["mark", "found", "products", "square", "rest", "times"])

    searched = F.pandas_udf(search, "mark bigint, found array<int>, products array<double>, square double, rest array<string>, times array<int>")
    table = written(rows.select(*others, searched(text_col).alias("_f")), "searched").select(*others, "_f.*")
    word = F.explode(F.arrays_zip("rest", "times")).alias("w")
    apart = table.select("mark", word).select("mark", F.col("w.rest").alias("term"), F.col("w.times").alias("times"))
    # A word that the counted documents lack has count 0, the largest weight.
    weight = (1 + F.log("times")) * F.coalesce("weight", F.lit(index.unseen))
    added = apart.join(index.rest.hint("merge"), "term", "left").groupBy("mark").agg(F.sum(weight * weight).alias("added"))

    def vote(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            out = []
            for found, products, square in zip(*batch):
                cosines = products / math.sqrt(square) if square > 0 else np.zeros(len(products))
                near = [{"id": str(index.ids[i]), "label": int(index.labels[i]), "cosine": float(c)} for i, c in zip(found[:EVIDENCE], cosines[:EVIDENCE]) if c > 0]
                out.append((index.vote(found, cosines) if near else None, near))
            yield pd.DataFrame(out, columns=["vote", "evidence"]).astype({"vote": float})

    voted = F.pandas_udf(vote, "vote double, evidence array<struct<id:string,label:int,cosine:double>>")
    square = F.col("square") + F.coalesce("added", F.lit(0.0))
    return table.join(added.hint("merge"), "mark", "left").select(*others, voted("found", "products", square).alias("_v")).select(*others, "_v.*")


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", more: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, columns ``more``, score (0 to 1), predicted (1 from 0.5), evidence.

    ``evidence`` holds the nearest examples with a common word; their ids are given as text. Null and empty
    texts, and texts without a word of the examples, get the share of toxic rows among such labelled texts.
    Repeated rows get equal scores, row by row; an empty table gives no rows; other columns are not read. A very
    long text is one row of its task: its words are counted whole. Runs jobs when called.
    """
    kept = [id_col, *(more or [])]
    rows = docs.select(*kept, F.col(text_col).alias("_text"))
    if not len(index.labels):
        judged = rows.select(*kept, F.lit(None).cast("double").alias("vote"), F.expr("cast(array() as array<struct<id:string,label:int,cosine:double>>)").alias("evidence"))
    else:
        judged = _judged(rows, index, "_text")
    chance = 1 / (1 + F.exp(-(F.lit(index.slope) * F.col("vote") + F.lit(index.intercept))))
    scored = judged.withColumn("score", F.coalesce(chance, F.lit(float(index.nothing))))
    return scored.select(*kept, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
