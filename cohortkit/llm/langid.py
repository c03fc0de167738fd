"""Language identification: scripts narrow the candidates, Viterbi labels spans of mixed text."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.session import ship_code

# Code point ranges of the scripts that are told apart.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x531, 0x58F)],
    "hebrew": [(0x591, 0x5F4)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
# Scripts written without blanks: their runs are labelled in pieces of a few characters.
UNSPACED, PIECE = ("thai", "kana", "han"), 4

# Documents to learn from (expected size of the sample), lengths of n-grams, buckets per length, smoothing.
TRAIN_DOCS, ORDERS, BUCKETS, SMOOTHING = 20_000, (2, 3, 4), 2**16, 0.5
# Least share of a language's letters for a script to count as one of its own.
SCRIPT_SHARE = 0.01
# Price of a change of language, in nats.
SWITCH = 15.0
# Units kept by the cache, words of one Viterbi pass.
CACHE, PASS_WORDS = 300_000, 1_000_000
UNKNOWN = "und"

_CLASSES = {s: "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) for s, ranges in SCRIPTS.items()}
UNITS = regex.compile("|".join(f"[{c}]{{1,{PIECE}}}" if s in UNSPACED else f"[{c}]+" for s, c in _CLASSES.items()) + r"|\p{L}+")
LETTERS = regex.compile(r"\p{L}+")
BEYOND_LATIN = regex.compile(r"[^\x00-ɏ -⁯]")


def script(word: str) -> str:
    """The script of the first character."""
    code = ord(word[0])
    return next((s for s, ranges in SCRIPTS.items() if any(a <= code <= b for a, b in ranges)), "other")


def units(text: str) -> list[str]:
    """Lower-case words; in text beyond Latin letters, runs of one script."""
    text = text.lower()
    return UNITS.findall(text) if BEYOND_LATIN.search(text) else text.split()


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket) of every n-gram of the marked words."""
    codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32).astype(np.uint64)
    mark = codes == 10
    word = np.cumsum(mark) - 1
    at, buckets = [], []
    for k, n in enumerate(ORDERS):
        size = len(codes) - n + 1
        if size <= 0:
            continue
        hashed, whole = np.full(size, np.uint64(n)), np.ones(size, bool)
        for j in range(n):
            hashed = (hashed ^ codes[j : j + size]) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(29)
            if 0 < j < n - 1:
                whole &= ~mark[j : j + size]
        if n == 2:
            whole &= ~(mark[:size] & mark[1 : 1 + size])
        at.append(word[:size][whole])
        buckets.append((hashed[whole] % np.uint64(BUCKETS)).astype(np.int64) + k * BUCKETS)
    return np.concatenate(at), np.concatenate(buckets)


@dataclass
class Model:
    """Log probabilities of n-gram buckets by language, and the scripts of each language."""

    langs: list[str]
    logs: np.ndarray
    scripts: dict[str, np.ndarray]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def is_held_out(id_col: Column, divisor: int, remainder: int) -> Column:
    """Whether the CRC-32 of the id as text leaves that remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % divisor == remainder


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count n-grams and scripts by language over a hash sample of about ``train_docs`` labelled rows."""
    ship_code(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = labelled.count()
    share = min(1.0, train_docs / max(rows, 1))
    chosen = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                found: Counter = Counter()
                for text in texts:
                    found.update(w for u in units(text) for w in LETTERS.findall(u))
                if not found:
                    continue
                words, n = list(found), np.fromiter(found.values(), float)
                at, buckets = grams(words)
                sums = np.bincount(buckets, n[at], BUCKETS * len(ORDERS))
                used = np.flatnonzero(sums)
                yield pd.DataFrame({"lang": lang, "kind": "", "bucket": used, "n": sums[used]})
                letters: Counter = Counter()
                for w, c in found.items():
                    letters[script(w)] += c * len(w)
                yield pd.DataFrame({"lang": lang, "kind": list(letters), "bucket": -1, "n": [float(x) for x in letters.values()]})

    counts = chosen.mapInPandas(count, "lang string, kind string, bucket bigint, n double").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((BUCKETS * len(ORDERS), len(langs)), SMOOTHING)
    scripts: dict[str, np.ndarray] = {}
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        of_grams = own[own["bucket"] >= 0]
        table[of_grams["bucket"].to_numpy(), i] += of_grams["n"].to_numpy()
        of_scripts = own[own["bucket"] < 0]
        for name, n in zip(of_scripts["kind"], of_scripts["n"]):
            if n >= SCRIPT_SHARE * of_scripts["n"].sum():
                scripts.setdefault(name, np.zeros(len(langs), bool))[i] = True
    for k in range(len(ORDERS)):
        part = slice(k * BUCKETS, (k + 1) * BUCKETS)
        table[part] = np.log(table[part] / table[part].sum(axis=0)) if langs else 0
    return Model(langs, table.astype(np.float32), scripts)


class Labeller:
    """Scores of units, kept in a bounded cache, and spans of texts."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.langs)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        """Add the scores of units: sums over their words, languages without their scripts far behind."""
        found = [LETTERS.findall(u) for u in new]
        words = [w for ws in found for w in ws]
        owner = np.repeat(np.arange(len(new)), [len(ws) for ws in found])
        scores = np.zeros((len(new), len(self.model.langs)), np.float32)
        if words:
            at, buckets = grams(words)
            for lang in range(len(self.model.langs)):
                scores[:, lang] = np.bincount(owner[at], self.model.logs[buckets, lang], len(new))
            for i, u in enumerate(new):
                if found[i] and not (u.isascii() and "latin" in self.model.scripts and self.model.scripts["latin"].all()):
                    candidates = self.model.scripts.get(script(found[i][0]))
                    if candidates is None:
                        scores[i] = 0
                    elif not candidates.all():
                        scores[i, ~candidates] = -1e4
        letters = np.fromiter((sum(map(len, ws)) for ws in found), np.int64, len(new))
        self.known.update(zip(new, range(len(self.letters), len(self.letters) + len(new))))
        self.scores, self.letters = np.concatenate([self.scores, scores]), np.concatenate([self.letters, letters])

    def forget(self) -> None:
        """Drop what came after the first ``CACHE`` units."""
        for unit in list(self.known)[CACHE:]:
            del self.known[unit]
        self.scores, self.letters = self.scores[:CACHE], self.letters[:CACHE]

    def paths(self, lists: list[np.ndarray]) -> list[np.ndarray]:
        """The best language of every unit, for texts given as score rows; all texts advance together."""
        order = np.argsort([-len(x) for x in lists], kind="stable")
        lengths = np.array([len(lists[i]) for i in order])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        rows = np.concatenate([lists[i] for i in order])
        langs, steps = len(self.model.langs), int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")
        switched = np.zeros((len(rows), langs), bool)
        source = np.zeros(len(rows), np.int16)
        value = self.scores[rows[starts[: active[0]]]].astype(np.float64)
        for t in range(1, steps):
            k = active[t]
            here = starts[:k] + t
            before = value[:k]
            best = before.argmax(axis=1)
            entered = before[np.arange(k), best] - SWITCH
            change = before < entered[:, None]
            switched[here], source[here] = change, best
            value[:k] = np.where(change, entered[:, None], before) + self.scores[rows[here]]
        labels = np.zeros(len(rows), np.int16)
        state = value.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            k = active[t]
            here = starts[:k] + t
            labels[here] = state[:k]
            if t:
                state[:k] = np.where(switched[here, state[:k]], source[here], state[:k])
        out: list[np.ndarray] = [None] * len(lists)
        for i, start, n in zip(order, starts, lengths):
            out[i] = labels[start : start + n]
        return out

    def label(self, texts: list[str | None]) -> pd.DataFrame:
        """lang, score and spans of every text."""
        split = [units(t or "") for t in texts]
        new = sorted(set().union(*split).difference(self.known))
        if new:
            self.learn(new)
        lists = [np.fromiter(map(self.known.__getitem__, s), np.int64, len(s)) for s in split]
        # Units without letters keep their place in the text but take no part.
        kept = [np.flatnonzero(self.letters[x] > 0) for x in lists]
        given = [i for i, k in enumerate(kept) if len(k)] if self.model.langs else []
        answer = [(UNKNOWN, 0.0, [])] * len(texts)
        while given:
            size, batch = 0, []
            while given and (not batch or size + len(kept[given[-1]]) <= PASS_WORDS):
                batch.append(given.pop())
                size += len(kept[batch[-1]])
            for i, labels in zip(batch, self.paths([lists[i][kept[i]] for i in batch])):
                weights = np.bincount(labels, self.letters[lists[i][kept[i]]], len(self.model.langs))
                top = int(weights.argmax())
                edges = np.flatnonzero(np.diff(labels)) + 1
                firsts, lasts = np.concatenate([[0], edges]), np.concatenate([edges, [len(labels)]]) - 1
                spans = [(int(kept[i][a]), int(kept[i][b]) + 1, self.model.langs[labels[a]]) for a, b in zip(firsts, lasts)]
                answer[i] = (self.model.langs[top], float(weights[top] / weights.sum()), spans)
        if len(self.known) > CACHE:
            self.forget()
        return pd.DataFrame({"lang_pred": [a[0] for a in answer], "score": [a[1] for a in answer], "spans": [[{"start": s, "end": e, "lang": x} for s, e, x in a[2]] for a in answer]})


# One labeller per Python worker, for the model used last.
_LABELLERS: dict[str, Labeller] = {}


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, lang_pred, score, spans.

    A word is what blanks separate (in text beyond Latin letters, a run of one script). ``spans`` lists the
    labelled stretches by number of the word (start, end after the last, lang); ``lang_pred`` is the
    language with the most letters, the first by name in a tie, and ``score`` its share of the letters. Null
    texts, texts without letters and an empty model give ``und``, 0 and no spans. Repeated rows are labelled
    one by one; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from cohortkit.llm import langid

        name = shared.value.name
        if name not in langid._LABELLERS:
            langid._LABELLERS.clear()
            langid._LABELLERS[name] = langid.Labeller(shared.value)
        for batch in batches:
            texts = batch.tolist()
            parts = [langid._LABELLERS[name].label(texts[a : a + 1000]) for a in range(0, len(texts), 1000)]
            yield pd.concat(parts, ignore_index=True)

    made = F.pandas_udf(run, "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
    return docs.select(F.col(id_col), made(text_col).alias("_found")).select(id_col, "_found.*")
