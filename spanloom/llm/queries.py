"""The queries of this subpackage, with production parameters, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontaminate, hard_negatives, html_extract, jaccard_join, kd_shards, language_id, line_dedup, media, minhash, spelling, token_store, toxicity


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.encode_decode(common.documents(spark, sf_dir, "doc_id", "text"), path, offsets=False)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "op6")
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = scratch.table(token_store.write(docs, path, scratch.folder("store")), "manifest")
    return token_store.read(spark, manifest)


def op10_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.encode(common.documents(spark, sf_dir, "doc_id", "text"))
    return media.features(stored.select("doc_id", "media")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "thumbnail_hash"
    )


#: A score from here on counts as toxic.
TOXIC = 0.3


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    seen = common.documents(spark, sf_dir, "doc_id", "toxic", table="labels").filter(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, seen))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.documents(spark, sf_dir, "page_id", "url", "html", table="pages")
    return language_id.identify(pages, common.documents(spark, sf_dir, "text", "lang"))


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.shards(common.documents(spark, sf_dir, "doc_id", "text"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(common.documents(spark, sf_dir, "doc_id", "text"), n=4, percent=85)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    kept = line_dedup.apply(docs, line_dedup.bitmaps(docs, min_docs=10, min_chars=1))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
line AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
hot AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(hot.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (k) GROUP BY doc_id
"""


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(common.documents(spark, sf_dir, "page_id", "url", "html", table="pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
walk AS (SELECT a AS id, a AS m FROM edge UNION SELECT e.b, w.m FROM walk w JOIN edge e ON w.id = e.a WHERE w.m < e.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(walk.m), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN walk ON d.doc_id = walk.id GROUP BY d.doc_id
"""

OP9_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM iw WHERE len(w) > 0)),
spot AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
hit AS (SELECT doc_id, item_id, i, win.size FROM spot JOIN win USING (s, size)),
word AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(word.n, 0)::BIGINT AS n_hit, coalesce(item.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
FROM w LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(common.documents(spark, sf_dir, "doc_id", "text"), common.documents(spark, sf_dir, "item_id", "text", table="benchmark"), n=10)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.documents(spark, sf_dir, "vec_id", "embedding", "label", table="embeddings")
    moved = rows.withColumn("label", F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(moved, F.pmod("vec_id", F.lit(50)) == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(common.documents(spark, sf_dir, "doc_id", "text"), n=4, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP12_SQL = OP5_SQL.replace("100 * k >= 85 *", "100 * k >= 80 *").replace("AS component_id\n", "AS component_id, d.doc_id <= coalesce(min(walk.m), d.doc_id) AS kept\n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(common.documents(spark, sf_dir, "doc_id", "text"), length=7, least=2, times=10, drop=31)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_kd_shards": op4_kd_shards,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_token_store": op6_token_store,
    "op7_line_dedup": op7_line_dedup,
    "op8_html_extract": op8_html_extract,
    "op9_decontaminate": op9_decontaminate,
    "op10_media_jpeg": op10_media_jpeg,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_minhash": op12_minhash,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {"op5_jaccard_join": OP5_SQL, "op7_line_dedup": OP7_SQL, "op9_decontaminate": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_minhash": OP12_SQL}
