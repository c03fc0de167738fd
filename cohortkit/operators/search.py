"""Keyword and phrase search over a positional inverted index that is kept as a table.

A row of the index holds the postings of one term in one block of documents: for each document its place in
the block and the positions of the term, as differences. A frequent term has one row per block, so neither
building nor searching brings all its postings together. Searches read the index alone, never a text.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cohortkit.session import ship_code

# A word: letters and digits, in lower case.
WORD = r"[\p{L}\p{N}]+"
# Documents of a block (ids next to each other), folders of terms, tasks that share a folder's blocks.
BLOCK_DOCS, FOLDERS, PARTS = 4096, 64, 16

SCHEMA = "term string, block bigint, docs array<struct<at:int,steps:array<int>>>, n_docs int, n_hits bigint, folder int"


def folder_of(term: Column, folders: int = FOLDERS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def words(text: Column) -> Column:
    """The words of a text in order, in lower case; null for a null text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def postings(docs: np.ndarray, words: pa.ListArray) -> pa.RecordBatch:
    """term, block, docs, n_hits of some documents, whose words come in order: one row per term and block."""
    # Documents in the order of their ids, so that one stable sort by term leaves their words in order.
    by_id = np.argsort(docs, kind="stable")
    docs, words = docs[by_id], words.take(pa.array(by_id))
    sizes = words.value_lengths().to_numpy()
    terms = words.flatten().dictionary_encode()
    code, doc = terms.indices.to_numpy(), np.repeat(docs, sizes)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(code, kind="stable") if (np.diff(docs) > 0).all() else np.lexsort((pos, doc, code))
    code, doc, pos = code[order], doc[order], pos[order]
    block = doc // BLOCK_DOCS
    first = np.ones(len(doc), bool)
    new_doc, new_row = first.copy(), first
    new_doc[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    new_row[1:] = (code[1:] != code[:-1]) | (block[1:] != block[:-1])
    steps = np.diff(pos, prepend=0)
    steps[new_doc] = pos[new_doc]
    held, rows = np.flatnonzero(new_doc), np.flatnonzero(new_row)
    lists = pa.ListArray.from_arrays(pa.array(np.append(held, len(doc)), pa.int32()), pa.array(steps, pa.int32()))
    pairs = pa.StructArray.from_arrays([pa.array(doc[held] - block[held] * BLOCK_DOCS, pa.int32()), lists], ["at", "steps"])
    grouped = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(held, rows), len(held)), pa.int32()), pairs)
    hits = pa.array(np.diff(np.append(rows, len(doc))), pa.int64())
    return pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(code[rows])), pa.array(block[rows], pa.int64()), grouped, hits], ["term", "block", "docs", "n_hits"])


def _places(steps: Column) -> Column:
    return F.transform(steps, lambda _, i: F.aggregate(F.slice(steps, F.lit(1), i + 1), F.lit(0), lambda done, x: done + x))


def _merged(docs: Column) -> Column:
    """Sorted postings with one entry per document; entries meet only if an id is repeated."""

    def entry(at: Column) -> Column:
        places = F.sort_array(F.flatten(F.transform(F.filter(docs, lambda d: d["at"] == at), lambda d: _places(d["steps"]))))
        return F.transform(F.array(places), lambda p: F.struct(at.alias("at"), F.transform(p, lambda x, i: x - F.coalesce(F.get(p, i - 1), F.lit(0))).alias("steps")))[0]

    ids = F.array_distinct(docs["at"])
    return F.when(F.size(ids) == F.size(docs), docs).otherwise(F.transform(ids, entry))


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the index of ``docs`` at ``path``, partitioned by term folder, and return it.

    The id must be a unique whole number, as it names the document and its block; rows without an id or a word
    are not indexed. One shuffle brings the places of a term in a block together.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"id column {id_col!r} must hold whole numbers")
    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(words(F.col(text_col)), F.array().cast("array<string>")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield postings(batch.column(0).to_numpy(), batch.column(1))

    ship_code(docs.sparkSession)
    # A row per term, block and batch of documents is shuffled, not one per word.
    made = given.mapInArrow(run, "term string, block bigint, docs array<struct<at:int,steps:array<int>>>, n_hits bigint")
    placed = made.withColumns({"folder": folder_of(F.col("term")), "part": F.pmod("block", F.lit(PARTS)).cast("int")})
    # Terms are grouped where the one shuffle put them: by folder and part of the blocks.
    found = placed.repartition("folder", "part").groupBy("folder", "part", "term", "block").agg(
        F.sort_array(F.flatten(F.collect_list("docs"))).alias("docs"), F.sum("n_hits").cast("bigint").alias("n_hits")
    )
    rows = found.withColumn("docs", _merged(F.col("docs"))).withColumn("n_docs", F.size("docs"))
    rows.sortWithinPartitions("folder", "term", "block").drop("part").write.partitionBy("folder").parquet(path)
    return read_index(docs.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def term_statistics(index: DataFrame) -> DataFrame:
    """term, n_docs, n_hits. Postings are not read."""
    return index.groupBy("term").agg(F.sum("n_docs").cast("bigint").alias("n_docs"), F.sum("n_hits").alias("n_hits"))


def as_queries(spark: SparkSession, queries: Mapping[str, Sequence[str]]) -> DataFrame:
    """(query, at, term) from lists of words."""
    rows = [(name, i, term) for name, terms in queries.items() for i, term in enumerate(terms)]
    return spark.createDataFrame(rows, "query string, at int, term string").withColumn("term", F.lower("term"))


def _asked(index: DataFrame, queries: DataFrame | Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """The queries as a frame, and the part of the index that can hold their terms."""
    if isinstance(queries, DataFrame):
        return queries.select("query", "at", F.lower("term").alias("term")), index
    terms = sorted({t.lower() for words in queries.values() for t in words})
    # Constants: only the folders of these terms are listed, and their row groups skipped by the terms' range.
    literal = [F.lit(t) for t in terms]
    found = index.where(F.col("folder").isin(*[folder_of(t) for t in literal]) & F.col("term").isin(*literal)) if terms else index.limit(0)
    return as_queries(index.sparkSession, queries), found


def _meet(index: DataFrame, queries: DataFrame | Mapping[str, Sequence[str]], every: bool) -> DataFrame:
    """One row per query, term and document: query, wanted, block, term, doc, steps."""
    asked, found = _asked(index, queries)
    terms = asked.select("query", "term").distinct()
    terms = terms.withColumn("wanted", F.count(F.lit(1)).over(Window.partitionBy("query")))
    postings = found.join(terms, "term")
    if every:
        # Blocks first: they are told by two columns, and postings of the others are not looked at.
        meet = postings.groupBy("query", "block").agg(F.count(F.lit(1)).alias("_terms"), F.max("wanted").alias("_wanted")).where(F.col("_terms") == F.col("_wanted"))
        postings = postings.join(meet.select("query", "block"), ["query", "block"], "left_semi")
    return postings.select("query", "wanted", "block", "term", F.explode("docs").alias("d")).select(
        "query", "wanted", "term", (F.col("block") * BLOCK_DOCS + F.col("d.at")).alias("doc"), F.col("d.steps").alias("steps")
    )


def search(index: DataFrame, queries: DataFrame | Mapping[str, Sequence[str]], match: str = "all") -> DataFrame:
    """query, doc, n_terms, n_hits, hits (per term) of the documents that hold all or any of a query's words.

    ``queries`` maps names to words, or is a frame (query, at, term). A word that a query repeats counts once.
    """
    if match not in ("all", "any"):
        raise ValueError("match must be 'all' or 'any'")
    found = _meet(index, queries, match == "all").groupBy("query", "wanted", "doc").agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.sum(F.size("steps")).cast("bigint").alias("n_hits"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", F.size("steps").alias("n"))))).alias("hits"),
    )
    if match == "all":
        found = found.where(F.col("n_terms") == F.col("wanted"))
    return found.drop("wanted")


def search_phrases(index: DataFrame, phrases: DataFrame | Mapping[str, Sequence[str]]) -> DataFrame:
    """query, doc, n_hits: how often the words of a phrase follow each other in a document, in their order."""
    asked, _ = _asked(index, phrases)
    here = Window.partitionBy("query", "doc")
    places = (
        _meet(index, phrases, True)
        .withColumn("_terms", F.count(F.lit(1)).over(here))
        .where(F.col("_terms") == F.col("wanted"))
        .select("query", "doc", "term", F.posexplode("steps").alias("_i", "step"))
        .withColumn("pos", F.sum("step").over(Window.partitionBy("query", "doc", "term").orderBy("_i")))
    )
    sized = asked.withColumn("_length", F.count(F.lit(1)).over(Window.partitionBy("query")))
    # A phrase starts where each of its words, set back by its place in the phrase, has the same position.
    starts = places.join(sized, ["query", "term"]).groupBy("query", "doc", "_length", (F.col("pos") - F.col("at")).alias("start")).agg(F.count(F.lit(1)).alias("_met"))
    whole = starts.where(F.col("_met") == F.col("_length"))
    return whole.groupBy("query", "doc").agg(F.count(F.lit(1)).alias("n_hits"))
