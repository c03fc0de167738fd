"""Registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from cohortkit.llm import alignment, ann, bpe, exact_dedup, langid, line_dedup, near_dedup, packing, phrases, quality, sharding, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql
        return build

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@register(
    "op1_exact_dedup",
    r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
        doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
)
def op1_exact_dedup(spark, d):
    return exact_dedup.exact_dedup(table(spark, d, "documents"))


@register("op2_langid")
def op2_langid(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    held_out = langid.is_held_out(F.col("doc_id"), 4, 2)
    model = langid.train(docs.where(~held_out))
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@register("op3_near_dedup")
def op3_near_dedup(spark, d):
    return near_dedup.near_duplicates(table(spark, d, "documents"))


# Bytes of a shard of op4, small as the tables are: one megabyte of text.
SHARD_BYTES = 2**20

_DEPTHS = "range(0, 25)"


@register(
    "op4_sharding",
    f"""WITH rows AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n,
            CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
        deep AS (SELECT *, unnest({_DEPTHS}) AS depth FROM rows),
        sums AS (SELECT depth, h >> (60 - depth) AS prefix, sum(n) AS bytes FROM deep GROUP BY ALL),
        fits AS (SELECT doc_id, n, min(deep.depth) AS depth, any_value(h) AS h FROM deep
            JOIN sums ON sums.depth = deep.depth AND prefix = h >> (60 - deep.depth) WHERE bytes <= {SHARD_BYTES} GROUP BY doc_id, n)
    SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(depth AS INT) AS shard_bits, h >> (60 - depth) AS shard_prefix, CAST(0 AS BIGINT) AS shard_part FROM fits""",
)
def op4_sharding(spark, d):
    return sharding.assign_shards(table(spark, d, "documents"), SHARD_BYTES)


WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@register("op5_packing")
def op5_packing(spark, d):
    pieces = packing.pack(table(spark, d, "documents"), WORD_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


@register("op6_toxicity")
def op6_toxicity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    held_out = langid.is_held_out(F.col("doc_id"), 5, 0)
    index = toxicity.fit(docs.where(~held_out), table(spark, d, "labels"), all_docs=docs)
    found = toxicity.score(docs, index)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.to_json("evidence").alias("evidence"))


@register("op7_ann")
def op7_ann(spark, d):
    vectors = table(spark, d, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5, skip_self=True)


@register("op8_bpe")
def op8_bpe(spark, d):
    return bpe.round_trip(table(spark, d, "documents"), BYTE_BPE)


@register("op10_quality")
def op10_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    held_out = langid.is_held_out(F.col("doc_id"), 5, 0)
    ensemble = quality.fit(docs.where(~held_out), table(spark, d, "labels"))
    return quality.score(docs, ensemble).select("doc_id", held_out.alias("held_out"), "score", "predicted")


_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register(
    "op9_line_dedup",
    f"""WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM parts),
        keyed AS (SELECT *, {_KEY} AS k FROM lines),
        shared AS (SELECT k, max(doc_id) AS stays FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        judged AS (SELECT doc_id, pos, line, stays IS NULL OR stays = doc_id AS keep FROM keyed LEFT JOIN shared USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS kept_sha256 FROM judged GROUP BY doc_id""",
)
def op9_line_dedup(spark, d):
    kept = line_dedup.dedup_lines(table(spark, d, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


@register("op11_alignment")
def op11_alignment(spark, d):
    return alignment.align(table(spark, d, "documents"), BYTE_BPE, PIECE_BPE)


@register(
    "op12_phrases",
    r"""WITH given AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM given),
        words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
        sums AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
        sizes AS (SELECT lang, w, unnest(range(1, 6)) AS k FROM words),
        grams AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM sizes WHERE k <= len(w)),
        freq AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
        cand AS (SELECT lang, k, p AS phrase, f AS a, string_split(p, ' ') AS w FROM freq WHERE k > 1),
        cuts AS (SELECT *, unnest(range(1, k)) AS c FROM cand),
        scored AS (SELECT cuts.lang, phrase, a, c, h.f AS l, t.f AS r, n, CAST((1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f) AS BIGINT) AS score FROM cuts
            JOIN freq h ON h.lang = cuts.lang AND h.p = array_to_string(cuts.w[1:cuts.c], ' ')
            JOIN freq t ON t.lang = cuts.lang AND t.p = array_to_string(cuts.w[cuts.c + 1:cuts.k], ' ') JOIN sums ON sums.lang = cuts.lang),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
        parts AS (SELECT lang, k, a, w, unnest(range(2, k)) AS m FROM cand),
        inner_phrases AS (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS p FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM parts)),
        dropped AS (SELECT DISTINCT best.lang, phrase FROM best JOIN inner_phrases i ON i.lang = best.lang AND i.p = phrase WHERE 100 * i.a >= 100 * best.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM best ANTI JOIN dropped USING (lang, phrase) QUALIFY rank <= 2000""",
)
def op12_phrases(spark, d):
    return phrases.collocations(table(spark, d, "documents"))


@register(
    "op13_suffix_dedup",
    """WITH given AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        starts AS (SELECT doc_id, octet_length(b) AS n, unnest(range(octet_length(b) - 99)) AS s, b FROM given WHERE octet_length(b) >= 100),
        windows AS (SELECT doc_id, s, row_number() OVER (PARTITION BY b[s + 1:s + 100] ORDER BY doc_id, s) > 1 AS again FROM starts),
        fresh AS (SELECT doc_id, s, s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, -1) AS begins FROM windows WHERE again),
        numbered AS (SELECT doc_id, s, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM fresh),
        spans AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS z FROM numbered GROUP BY ALL),
        listed AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM spans GROUP BY doc_id),
        cuts AS (SELECT given.doc_id, octet_length(b) AS n, hex(b) AS h, coalesce(a, []) AS a, coalesce(z, []) AS z FROM given LEFT JOIN listed USING (doc_id))
    SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(list_sum(z) - list_sum(a), 0) AS BIGINT) AS n_removed, CAST(len(a) AS BIGINT) AS n_spans,
        sha256(unhex(list_aggregate(list_transform(range(len(a) + 1),
            lambda i: CASE WHEN i = 0 THEN h[1:2 * coalesce(a[1], n)] ELSE h[2 * z[i] + 1:2 * coalesce(a[i + 1], n)] END), 'string_agg', ''))) AS kept_sha256
    FROM cuts""",
)
def op13_suffix_dedup(spark, d):
    found = suffix_dedup.dedup_substrings(table(spark, d, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _pipeline(spark: SparkSession, d: str) -> DataFrame:
    return corpus_pipeline.run(spark, d)


register("pipeline", corpus_pipeline.ORACLE_SQL)(_pipeline)
