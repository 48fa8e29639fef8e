"""Manifests of a grid and of a split as tables, what has drifted from them, and canonical fingerprints."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_manifest(docs: DataFrame, sentences: DataFrame) -> DataFrame:
    """case_id, text_sha256, n_sentences and grid_sha256 (over a case's offsets in order) of every case, also of those without sentences."""
    ordered = F.array_sort(F.collect_list(F.struct("sent_idx", "b", "e")))
    listed = F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("["), x["b"], F.lit(","), x["e"], F.lit("]"))), ",")
    own = sentences.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), listed.alias("g"))
    joined = docs.select("case_id", F.sha2("text", 256).alias("text_sha256")).join(own, "case_id", "left")
    return joined.select("case_id", "text_sha256", F.coalesce("n", F.lit(0).cast("long")).alias("n_sentences"), F.sha2(F.concat(F.lit("["), F.coalesce("g", F.lit("")), F.lit("]")), 256).alias("grid_sha256"))


def _problem(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(name))


def grid_problems(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """case_id and problem of every case in which two grid manifests differ: missing, added, text, grid (only where the text is the same)."""
    a, b = manifest.alias("a"), now.alias("b")
    both = a.join(b, F.col("a.case_id") == F.col("b.case_id"), "full")
    text = F.col("a.text_sha256") != F.col("b.text_sha256")
    grid = ~text & (F.col("a.grid_sha256") != F.col("b.grid_sha256"))
    found = F.coalesce(_problem(F.col("b.case_id").isNull(), "missing"), _problem(F.col("a.case_id").isNull(), "added"), _problem(text, "text"), _problem(grid, "grid"))
    return both.select(F.coalesce("a.case_id", "b.case_id").alias("case_id"), found.alias("problem")).filter("problem is not null")


def split_problems(manifest: DataFrame, now: DataFrame, sizes: dict[str, int], excluded: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """problem and what (an id, a split or a group, as text) of everything in which a split manifest does not fit the documents.

    manifest: case_id, split, text_sha256, n_regions; now: case_id, text_sha256, n_regions; groups:
    case_id, root. Problems: missing, added, excluded (a listed id that was to be left out), text,
    regions, size (of a split), straddles (a group in several splits).
    """
    a, b = manifest.alias("a"), now.alias("b")
    both = a.join(b, F.col("a.case_id") == F.col("b.case_id"), "full")
    text, regions = F.col("a.text_sha256") != F.col("b.text_sha256"), F.col("a.n_regions") != F.col("b.n_regions")
    each = F.array(_problem(F.col("b.case_id").isNull(), "missing"), _problem(F.col("a.case_id").isNull(), "added"), _problem(text, "text"), _problem(regions, "regions"))
    parts = [both.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("problem"), F.coalesce("a.case_id", "b.case_id").cast("string").alias("what"))]
    if excluded is not None:
        parts.append(manifest.join(excluded.select("case_id"), "case_id", "left_semi").select(F.lit("excluded").alias("problem"), F.col("case_id").cast("string").alias("what")))
    if groups is not None:
        spread = manifest.join(groups, "case_id").groupBy("root").agg(F.countDistinct("split").alias("k")).filter("k > 1")
        parts.append(spread.select(F.lit("straddles").alias("problem"), F.col("root").cast("string").alias("what")))
    wanted = manifest.sparkSession.createDataFrame(list(sizes.items()), "split string, wanted long")
    counted = manifest.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    off = wanted.join(counted, "split", "full").filter(~F.coalesce("wanted", F.lit(0)).eqNullSafe(F.coalesce("n", F.lit(0))))
    parts.append(off.select(F.lit("size").alias("problem"), F.col("split").alias("what")))
    return reduce(DataFrame.unionByName, parts)


def split_manifest(assigned: dict, flags: dict[object, dict[str, int]], counts: dict, texts: dict, sizes: dict[str, int], groups: list, seed: int, **more: object) -> dict:
    """The manifest of a split of an annotated corpus, of a row a document, with its hash; groups of one document are left out."""
    listed = {s: sorted(i for i, own in assigned.items() if own == s) for s in sizes}
    volume = {s: sorted(counts[i] for i in ids) for s, ids in listed.items()}
    body = {
        "seed": seed,
        "sizes": dict(sizes),
        "splits": listed,
        "related_groups": [sorted(g) for g in groups if len(g) > 1],
        "text_sha256": {str(i): texts[i] for i in sorted(texts)},
        "regions_per_document": {str(i): counts[i] for i in sorted(counts)},
        "indicator_counts": {s: {k: sum(flags[i][k] for i in ids) for k in next(iter(flags.values()), {})} for s, ids in listed.items()},
        "region_volume": {s: {"documents": len(v), "total": sum(v), "least": v[0], "upper_median": v[len(v) // 2], "most": v[-1]} for s, v in volume.items() if v},
    } | more
    return body | {"manifest_sha256": fingerprint(body, "split")}


#: The three canonical forms: what of json.dumps each takes, and the keys that are left out.
FORMS = {
    "grid": ({"separators": (",", ":"), "sort_keys": True}, ()),
    "split": ({"separators": (",", ":"), "sort_keys": True, "ensure_ascii": False}, ("manifest_sha256", "created_utc")),
    "audit": ({"sort_keys": True}, ()),
}


def fingerprint(value: object, form: str) -> str:
    options, without = FORMS[form]
    held = {k: v for k, v in value.items() if k not in without} if isinstance(value, dict) else value
    return hashlib.sha256(json.dumps(held, **options).encode()).hexdigest()


def grid_fingerprint(sentences: DataFrame) -> str:
    """The canonical fingerprint of a whole grid: one hash over {case: [[b, e], ...]} with cases in order of their names, taken a case at a time; the driver holds no more than a partition."""
    each = sentences.groupBy(F.col("case_id").cast("string").alias("c")).agg(F.array_sort(F.collect_list(F.struct("b", "e"))).alias("g")).orderBy("c")
    out, between = hashlib.sha256(b"{"), b""
    for r in each.toLocalIterator():
        out.update(between + json.dumps(r.c).encode() + b":" + json.dumps([[x.b, x.e] for x in r.g], separators=(",", ":")).encode())
        between = b","
    out.update(b"}")
    return out.hexdigest()
