"""Near duplicates by ProbMinHash sketches of sets of word shingles, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm.components import components
from cohortkit.session import ship_code, written

# Fixed values of the contract: words of a shingle, least similarity.
SHINGLE, SIMILARITY = 5, 0.8
# Of two sets of that similarity at most this share of the summed sizes is in one of them alone.
MOST_APART = (1 - SIMILARITY) / (1 + SIMILARITY)
# Long shingles weigh up to this much more in the sketch, LETTERS characters and beyond the most.
EXTRA, LETTERS = 0.1, 50
# Bands and registers of a band: a pair of sets at the least similarity has at least 0.784 of the weights in common
# and shares a band with probability 0.996 at least, 0.998 if its weights are alike; one at 0.5 does with 0.13.
BANDS, ROWS = 36, 8
# Rows sketched at once, words kept by the cache of hashes.
BATCH, CACHE = 1_000, 300_000
# A text with at least 1/HOT_SHARE of all rows is spread over SPREAD tasks; there are at most HOT_SHARE of them.
HOT_SHARE, SPREAD = 256, 64

_GOLDEN, _MIX1, _MIX2, _BASE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def normalised(text: Column) -> Column:
    """Lower case, blanks as one space, none at the ends; null as empty. The words are what spaces separate."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " "))


def text_key(text: Column) -> Column:
    """128 bits that name a normalised text."""
    return F.unhex(F.md5(text))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters (the finalizer of splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> set[str]:
    """The word shingles of a normalised text; a shorter text is one shingle, an empty one has none."""
    words = text.split(" ") if text else []
    return {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def jaccard(a: set[str], b: set[str]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 0.0


class Sketcher:
    """ProbMinHash registers of batches of texts."""

    def __init__(self, registers: int = BANDS * ROWS):
        self.registers = registers
        self.hashes: dict[str, int] = {}

    def elements(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, shingle hash, weight) of the distinct shingles.

        A shingle weighs the same in every text, by the length of its words: rare wording counts for more, and how
        often a text repeats it does not matter, as in the verified similarity of sets.
        """
        split = [t.split(" ") if t else [] for t in texts]
        new = set().union(*split).difference(self.hashes)
        self.hashes.update((w, xxhash.xxh64_intdigest(w)) for w in new)
        lengths = np.array([len(s) for s in split])
        words = np.fromiter((self.hashes[w] for s in split for w in s), np.uint64, int(lengths.sum()))
        if len(self.hashes) > CACHE:
            for w in new:
                del self.hashes[w]
        counts = np.where(lengths > 0, np.maximum(1, lengths - SHINGLE + 1), 0)
        doc = np.repeat(np.arange(len(texts)), counts)
        first = np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), counts) + np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        last = np.repeat(np.cumsum(lengths), counts)
        hashed = np.zeros(len(doc), np.uint64)
        padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
        letters = np.concatenate([[0], np.cumsum(np.fromiter((len(w) for s in split for w in s), np.int64, len(words)))])
        weight = 1 + EXTRA * np.minimum(letters[np.minimum(first + SHINGLE, last)] - letters[first], LETTERS) / LETTERS
        for j in range(SHINGLE):
            hashed = hashed * _BASE + np.where(first + j < last, padded[first + j], np.uint64(0)) + _GOLDEN
        hashed = _mix(hashed)
        order = np.lexsort((hashed, doc))
        doc, hashed, weight = doc[order], hashed[order], weight[order]
        begins = np.ones(len(doc), bool)
        begins[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
        at = np.flatnonzero(begins)
        return doc[at], hashed[at], weight[at]

    def registers_of(self, n: int, doc: np.ndarray, element: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The element whose first arrival is earliest, for every register of every text.

        Each element arrives by a Poisson process with its weight as rate, at a register drawn for each
        arrival. An element is done when its next arrival comes later than all registers' earliest ones.
        Two texts agree in a register with their probability Jaccard similarity.
        """
        m = self.registers
        time, held = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
        latest = np.full(n, np.inf)
        live, clock, step = np.arange(len(doc)), np.zeros(len(doc)), 0
        while len(live):
            step += 1
            drawn = _mix(element[live] + np.uint64(step * int(_GOLDEN) % 2**64))
            clock = clock - np.log(((drawn >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight[live]
            on = clock <= latest[doc[live]]
            live, clock, drawn = live[on], clock[on], drawn[on]
            place = doc[live] * m + (_mix(drawn ^ _BASE) % np.uint64(m)).astype(np.int64)
            better = np.flatnonzero(clock < time[place])
            # Of several arrivals at one register the earliest is written last.
            better = better[np.argsort(-clock[better], kind="stable")]
            time[place[better]], held[place[better]] = clock[better], element[live[better]]
            touched = np.unique(doc[live[better]])
            latest[touched] = time.reshape(n, m)[touched].max(axis=1)
        return held.reshape(n, m)

    def bands(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Band hashes (none for texts without words) and the number of distinct shingles."""
        doc, element, weight = self.elements(texts)
        rows = self.registers_of(len(texts), doc, element, weight).reshape(len(texts), BANDS, ROWS)
        keys = np.zeros((len(texts), BANDS), np.uint64)
        for j in range(ROWS):
            keys = _mix(keys * _BASE + rows[:, :, j] + _GOLDEN)
        sizes = np.bincount(doc, minlength=len(texts))
        signed = keys.view(np.int64)
        return [signed[i] if sizes[i] else np.zeros(0, np.int64) for i in range(len(texts))], sizes


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table (id, key, size, bands) of all rows."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sketcher = Sketcher()
        for batch in batches:
            texts = batch.tolist()
            parts = [sketcher.bands(texts[i : i + BATCH]) for i in range(0, len(texts), BATCH)]
            yield pd.DataFrame({"size": np.concatenate([p[1] for p in parts]) if parts else [], "bands": [b for p in parts for b in p[0]]})

    made = F.pandas_udf(run, "size int, bands array<bigint>")
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    return written(rows.select("id", text_key(F.col("text")).alias("key"), made("text").alias("_s")).select("id", "key", "_s.*"), "sketches")


class Sets:
    """The shingle sets of the last texts."""

    def __init__(self):
        self.seen: dict[str, set[str]] = {}

    def of(self, text: str) -> set[str]:
        if text not in self.seen:
            if len(self.seen) >= 64:
                self.seen.clear()
            self.seen[text] = shingles(text)
        return self.seen[text]


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    first = texts.select(F.col("key").alias("a"), F.col("text").alias("_text_a"))
    second = texts.select(F.col("key").alias("b"), F.col("text").alias("_text_b"))
    return pairs.join(second, "b").join(first, "a")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Add ``similarity``, the exact Jaccard similarity of the shingle sets, to pairs (a, b) of keys."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        sets = Sets()
        for left, right in batches:
            yield pd.Series([jaccard(sets.of(a), shingles(b)) for a, b in zip(left, right)], dtype=float)

    return _with_texts(pairs, texts).withColumn("similarity", F.pandas_udf(run, "double")("_text_a", "_text_b")).drop("_text_a", "_text_b")


def differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Add ``similarity`` and ``apart``, the hashes of the shingles that only one of the two texts has, to pairs."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        sets = Sets()
        for left, right in batches:
            similar, apart = [], []
            for a, b in zip(left, right):
                x, y = sets.of(a), shingles(b)
                similar.append(jaccard(x, y))
                apart.append(np.array([xxhash.xxh64_intdigest(s) for s in x ^ y], np.uint64).view(np.int64))
            yield pd.DataFrame({"similarity": similar, "apart": apart})

    found = F.pandas_udf(run, "similarity double, apart array<bigint>")("_text_a", "_text_b")
    return _with_texts(pairs, texts).withColumn("_f", found).select(*pairs.columns, "_f.*")


def _within(x: str, y: str) -> Column:
    """Whether the sizes of two shingle sets allow the least similarity."""
    return F.least(x, y) >= SIMILARITY * F.greatest(x, y) - 1e-9


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_keys: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, class_id (least id of its class), kept (whether it is that one).

    ``with_keys`` adds ``key`` (``text_key`` of the normalised text) and ``class_key`` (one key that names the class,
    also where ids are null; null for texts without words).

    Two texts are linked when they share a band and the Jaccard similarity of their sets of ``SHINGLE``
    words is at least ``SIMILARITY``; a class is what links connect. Texts with the same normalised words
    are one node. Texts without words are alone, each row in its own class. Null ids come last; in a class of
    null ids class_id is null. Rows that repeat id and text are all kept when their id is. An empty table
    gives no rows; other columns are not read. Runs jobs when called.

    The sketch is of weighted shingles (see ``Sketcher.elements``), the link rule is of plain sets; so many bands
    are used that sets at the least similarity meet with the probability stated there. In every bucket all
    nodes are compared with one of them, its centre. Where these links leave the nodes of a bucket in several
    components, further pairs are found by what sets nodes apart from their centre (see ``crossing_pairs``). So
    no pair that shares a band is left undecided that could change a class, and neither the pairs inside a
    large group of copies nor those of a crowd of merely similar texts are made. A very long text is one row
    of its task; its sets grow with it.
    """
    sketches = sketch(docs, id_col, text_col)
    nodes = written(sketches.where(F.col("size") > 0).groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.first("size").alias("size"), F.first("bands").alias("bands")), "nodes")
    placed = nodes.select("key", "size", F.posexplode("bands").alias("band", "bucket"))
    centres = placed.groupBy("band", "bucket").agg(F.min("key").alias("centre"), F.count(F.lit(1)).alias("nodes")).where(F.col("nodes") > 1).drop("nodes")
    members = written(placed.join(centres, ["band", "bucket"]), "members")

    sizes = nodes.select(F.col("key").alias("a"), F.col("size").alias("size_a"))
    stars = members.where(F.col("key") != F.col("centre")).select(F.col("centre").alias("a"), F.col("key").alias("b"), F.col("size").alias("size_b")).distinct().join(sizes, "a")
    wanted = members.select("key").distinct()
    texts = docs.select(normalised(F.col(text_col)).alias("text")).withColumn("key", text_key(F.col("text")))
    # Copies are merged before and after they are shuffled; the join is the same at every size.
    needed = written(texts.groupBy("key").agg(F.first("text").alias("text")).join(wanted.hint("merge"), "key", "left_semi"), "texts")
    checked = written(differences(stars, needed).withColumn("star", F.monotonically_increasing_id()), "stars")
    links = checked.where(F.col("similarity") >= SIMILARITY).select("a", "b")
    component = written(components(links).withColumnRenamed("node", "key"), "components")
    across = verify(crossing_pairs(members, checked, component), needed).where(F.col("similarity") >= SIMILARITY).select("a", "b")
    final = components(links.unionByName(across))

    named = nodes.select("key", "rows").join(final.withColumnRenamed("node", "key"), "key", "left").withColumn("class", F.coalesce("component", "key")).select("key", "rows", "class")
    least = sketches.groupBy("key").agg(F.min("id").alias("least"))
    ids = named.join(least, "key").groupBy("class").agg(F.min("least").alias("class_id"))
    classes = written(named.join(ids, "class").select("key", "rows", "class_id", F.col("class").alias("class_key")), "classes")
    return _attach(sketches, classes, id_col, ["key", "class_key"] if with_keys else [])


def crossing_pairs(members: DataFrame, stars: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with one centre, in different components, that can still be similar enough.

    With |xy| for the number of shingles that only one of x and y has, x and y are similar enough when |xy| <=
    (|x| + |y|) / 9. A node x that is not linked to its centre c has |xc| > (|x| + |c|) / 9. As |xy| is |xc| + |yc|
    less twice what these differences have in common, two nodes of which one is not linked must share more than
    (|yc| + (|c| - |y|) / 9) / 2 of them, seen from y, the one that may be linked; seen from x that leaves
    (|xc| - (|x| + |c|) / 9) / 2. Two sets that share t members share one among the first |set| - t + 1 of each, in
    any fixed order: here the rarest come first, as in a crowd most differences belong to a single node. So
    pairs meet on these few members alone; a pair's own t, which its sizes tell, rules most meetings out. The order
    is that of ``h``, which names centre and shingle.
    """
    place = ["band", "bucket"]
    labelled = members.join(component, "key", "left").withColumn("component", F.coalesce("component", "key"))
    mixed = labelled.groupBy(*place).agg(F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") < F.col("high")).select(*place)
    undecided = members.join(mixed, place, "left_semi").select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct()
    apart = F.size("apart")
    own = (apart + (F.col("size_a") - F.col("size_b")) * MOST_APART) / 2
    other = (apart - (F.col("size_a") + F.col("size_b")) * MOST_APART) / 2
    nodes = written(
        stars.join(undecided, ["a", "b"], "left_semi")
        .join(component.withColumnRenamed("key", "b"), "b", "left")
        .select(
            "star",
            F.col("b").alias("key"),
            F.col("size_b").alias("size"),
            F.coalesce("component", "b").alias("component"),
            (F.col("similarity") >= SIMILARITY).alias("linked"),
            apart.alias("n"),
            # Rounding may only let more members in.
            (apart - F.floor(own - 1e-6)).alias("few"),
            (apart - F.greatest(F.lit(1), F.ceil(other - 1e-6)) + 1).alias("many"),
            F.transform("apart", lambda s: F.xxhash64("a", s)).alias("apart"),
        ),
        "open",
    )
    met = Window.partitionBy("h")
    each = nodes.select("star", "n", "few", F.when(F.col("linked"), F.col("few")).otherwise(F.greatest("few", "many")).alias("most"), F.explode("apart").alias("h"))
    # Members of a single node take the first places and meet nothing.
    shared = each.withColumn("nodes", F.count(F.lit(1)).over(met)).where(F.col("nodes") > 1)
    ranked = Window.partitionBy("star").orderBy("nodes", "h")
    rank = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("star")) + F.row_number().over(ranked)
    first = shared.withColumn("rank", rank).where(F.col("rank") <= F.col("most")).select("star", "h", "rank", (F.col("rank") <= F.col("few")).alias("short"))
    told = nodes.select("star", "key", "size", "component", "linked", "n")
    rows = written(first.join(told, "star"), "prefixes")

    def side(mark: str, these: DataFrame) -> DataFrame:
        return these.select("h", *[F.col(c).alias(f"{mark}_{c}") for c in ("star", "key", "size", "component", "linked", "n", "rank", "short")])

    limit = (F.col("x_size") + F.col("y_size")) * MOST_APART + 1e-6
    found = side("x", rows.where("short")).join(side("y", rows.where("NOT linked")), "h").where(
        (F.col("x_linked") | (F.col("y_short") & (F.col("x_star") < F.col("y_star"))))
        & (F.col("x_component") != F.col("y_component"))
        & _within("x_size", "y_size")
        & (F.abs(F.col("x_n") - F.col("y_n")) <= limit)
        & (F.greatest(F.col("x_rank") - F.col("x_n"), F.col("y_rank") - F.col("y_n")) < 1 - (F.col("x_n") + F.col("y_n") - limit) / 2)
    )
    return found.select(F.least("x_key", "y_key").alias("a"), F.greatest("x_key", "y_key").alias("b")).distinct()


def _attach(sketches: DataFrame, classes: DataFrame, id_col: str, more: list[str]) -> DataFrame:
    """Give every row the class of its text; the few texts with very many rows are spread over tasks."""
    rows = classes.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n
    hot = [bytes(r.key) for r in classes.where((F.col("rows") * HOT_SHARE >= rows) & (F.col("rows") > 1)).select("key").collect()]
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    part = F.when(is_hot, F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")).otherwise(F.lit(0))
    parts = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))))
    found = sketches.select("id", "key", "size").withColumn("part", part).join(classes.select("key", "class_id", "class_key").withColumn("part", parts), ["key", "part"], "left")
    class_id = F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), class_id.alias("class_id"), class_id.eqNullSafe(F.col("id")).alias("kept"), *more)
