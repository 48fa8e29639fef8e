"""Commands over a folder of annotated documents: audits, groups, manifests and their checks. What they gather is a row for each annotated document."""

from __future__ import annotations

import json
from argparse import Namespace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.roles import ROLES, names, role_name
from ..operators import duplicates, grid, manifests, projection, spans, splitting, subwords, validation
from ..sources import annotations
from .catalogue import shared_folder


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    return spans.regions(annotations.normalised(spark, folder))


def audit(spark: SparkSession, a: Namespace) -> int:
    docs, found = annotations.load(spark, a.dir), _regions(spark, a.dir)
    nested = spans.nesting(found)
    many = F.bit_count("mask")
    out = {
        "documents": docs.count(),
        "regions": found.count(),
        "multi_role": {str(r.k): r.n for r in found.filter(many > 1).groupBy(many.alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy("k").collect()},
        "nesting": nested.count(),
        "same_role_nesting": nested.filter("same_role").count(),
        "documents_with_crossing": spans.crossing(found).select("case_id").distinct().count(),
    }
    Path(a.out).write_text(json.dumps(out, indent=1))
    return 0


def dedup(spark: SparkSession, a: Namespace) -> int:
    docs = annotations.load(spark, a.dir).select("case_id", "text")
    folder = shared_folder(spark)
    linked = duplicates.pairs(docs, folder)
    copies = docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("case_id").alias("a"), F.collect_list("case_id").alias("ids")).select("a", F.explode("ids").alias("b")).filter("a <> b")
    roots = duplicates.components(docs, linked.select("a", "b").unionByName(copies), folder)
    groups = sorted(sorted(r.ids) for r in roots.groupBy("root").agg(F.collect_list("case_id").alias("ids")).collect())
    pairs = [r.asDict() | {"kind": "near"} for r in linked.select("a", "b", F.round("jac", 4).alias("jaccard"), F.round("cont", 4).alias("containment")).orderBy(F.desc("jac"), "a", "b").collect()]
    pairs = [r.asDict() | {"jaccard": 1.0, "containment": 1.0, "kind": "exact"} for r in copies.orderBy("a", "b").collect()] + pairs
    Path(a.out).write_text(json.dumps({"params": {"words": duplicates.N, "jaccard": duplicates.JACCARD, "containment": duplicates.CONTAINMENT}, "pairs": pairs, "groups": groups}, indent=1))
    return 0


def _grid(spark: SparkSession, folder: str) -> tuple[list, str]:
    docs = annotations.load(spark, folder).select("case_id", "text")
    cut = grid.sentences(docs)
    return [r.asDict() for r in manifests.grid_manifest(docs, cut).orderBy("case_id").collect()], manifests.grid_fingerprint(cut)


def freeze_grid(spark: SparkSession, a: Namespace) -> int:
    if Path(a.out).exists() and not a.force:
        raise SystemExit(f"{a.out} exists")
    rows, fingerprint = _grid(spark, a.dir)
    annotations.write_manifest(a.out, {"cases": rows, "n_sentences": sum(r["n_sentences"] for r in rows), "grid_sha256": fingerprint}, a.force)
    return 0


def _state(spark: SparkSession, folder: str) -> tuple[dict, dict, DataFrame]:
    found = _regions(spark, folder)
    counts = found.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_regions"))
    held = annotations.load(spark, folder).select("case_id", "text_sha256").join(counts, "case_id").collect()
    return {r.case_id: r.text_sha256 for r in held}, {r.case_id: r.n_regions for r in held}, found


def split(spark: SparkSession, a: Namespace) -> int:
    if Path(a.out).exists() and not a.force:
        raise SystemExit(f"{a.out} exists")
    texts, counts, found = _state(spark, a.dir)
    sizes = {k: int(v) for k, v in (x.split("=") for x in a.sizes.split(","))}
    b = splitting.volume_bounds(found.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_regions"))).head()
    flags = {r.case_id: {k: v for k, v in r.asDict().items() if k != "case_id"} for r in splitting.indicators(found, b.b1, b.b2).collect()}
    groups = [own for g in json.loads(Path(a.dedup).read_text())["groups"] if (own := [i for i in g if i in flags])]
    made = splitting.stratified_group_split(flags, groups, sizes, a.seed)
    of = {"grid_sha256": annotations.read_manifest(a.grid)["grid_sha256"]} if a.grid else {}
    body = manifests.split_manifest(made, flags, counts, texts, sizes, groups, a.seed, volume_bounds=[b.b1, b.b2], **of)
    annotations.write_manifest(a.out, body, a.force)
    return 0


def _problems(spark: SparkSession, a: Namespace) -> list[tuple[str, str, str]]:
    """What does not fit between a folder of documents and the manifests of its grid and split; the manifests' own hashes are checked on reading."""
    frozen, made = annotations.read_manifest(a.grid), annotations.read_manifest(a.split)
    rows, fingerprint = _grid(spark, a.dir)
    texts, counts, _ = _state(spark, a.dir)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    schema = "case_id string, text_sha256 string, n_sentences long, grid_sha256 string"
    as_rows = lambda listed: [(r["case_id"], r["text_sha256"], r["n_sentences"], r["grid_sha256"]) for r in listed]
    problems = [("grid", r.case_id, r.problem) for r in manifests.grid_problems(frame(as_rows(frozen["cases"]), schema), frame(as_rows(rows), schema)).collect()]
    if not problems and fingerprint != frozen["grid_sha256"]:
        problems.append(("grid", "", "fingerprint"))
    if made.get("grid_sha256") and made["grid_sha256"] != frozen["grid_sha256"]:
        problems.append(("split", "", "made for another grid"))
    listed = [(i, s, made["text_sha256"][i], made["regions_per_document"][i]) for s, ids in made["splits"].items() for i in ids]
    now = frame([(i, texts[i], counts[i]) for i in texts], "case_id string, text_sha256 string, n_regions long")
    groups = [(i, g[0]) for g in made["related_groups"] for i in g]
    found = manifests.split_problems(frame(listed, "case_id string, split string, text_sha256 string, n_regions long"), now, made["sizes"], groups=frame(groups, "case_id string, root string"))
    return sorted(problems + [("split", r.what, r.problem) for r in found.collect()])


def verify(spark: SparkSession, a: Namespace) -> int:
    """Prints each problem."""
    problems = _problems(spark, a)
    for p in problems:
        print(*p)
    return int(bool(problems))


def check(spark: SparkSession, a: Namespace) -> int:
    """Prints everything that is wrong or odd in the documents, and how they were reviewed."""
    docs, rest = annotations.load(spark, a.dir), annotations.residue(spark, a.dir)
    rows, wrong = annotations.spans(docs), False
    for r in validation.documents(docs, rows, rest, ROLES).orderBy("level", "case_id", "code").toLocalIterator():
        print(r.level, r.case_id, r.code, r.n)
        wrong = wrong or r.level == validation.ERROR
    print(json.dumps(validation.reviewed(rows, rest).head().asDict()))
    return int(wrong)


def build(spark: SparkSession, a: Namespace) -> int:
    """The span and sentence tables of a folder of documents by the split of a manifest; nothing is written unless both manifests fit."""
    if problems := _problems(spark, a):
        raise SystemExit("the manifests do not fit: " + "; ".join(" ".join(p) for p in problems))
    made = annotations.read_manifest(a.split)
    where = F.broadcast(spark.createDataFrame([(i, s) for s, ids in made["splits"].items() for i in ids], "case_id string, split string"))
    docs, found = annotations.load(spark, a.dir).select("case_id", "text"), _regions(spark, a.dir)
    text = T.slice_(F.col("text"), F.col("b"), F.col("e")).alias("text")
    n = F.bit_count("mask").cast("long")
    labels = lambda mask: F.split(names(F.col(mask), True), r"\+")
    s1 = spans.nesting_roles(found).join(docs, "case_id").join(where, "case_id")
    s1 = s1.select(F.concat("case_id", F.lit(":"), "b", F.lit("-"), "e").alias("id"), "split", "case_id", F.col("b").alias("begin"), F.col("e").alias("end"), text, labels("mask").alias("labels"), n.alias("n_labels"), (n > 1).alias("is_multi"), "is_nested", "nesting_role")
    if a.vocabulary:
        s1 = subwords.cached_lengths(s1, f"{shared_folder(spark)}/subwords", subwords.encoder(spark, subwords.read_vocabulary(a.vocabulary)))
    s2 = projection.project(grid.sentences(docs), found).join(docs, "case_id").join(where, "case_id")
    s2 = s2.select(F.format_string("%s:s%04d", "case_id", "sent_idx").alias("id"), "split", "case_id", "sent_idx", F.col("b").alias("begin"), F.col("e").alias("end"), text, "status", role_name(F.col("label")).alias("label"), labels("present").alias("roles_intersecting"), labels("tied").alias("max_roles"), "ambiguity_kind")
    for name, rows in (("s1", s1), ("s2", s2)):
        annotations.write_split(rows, f"{a.out}/{name}")
    return 0


COMMANDS = {"audit": audit, "dedup": dedup, "freeze-grid": freeze_grid, "split": split, "verify": verify, "check": check, "build": build}
