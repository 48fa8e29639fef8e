"""Checks of annotated documents and of manifests, and set operations over ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans

DEFER = r"(?i)\bdefer(red)?\b"


def errors(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """case_id, code and n of each kind of error or warning that a document has. rows needs blank (a white-space slice), docs n_chars and text_len."""
    n = F.col("n_chars")
    good = (F.col("b") >= 0) & (F.col("b") < F.col("e")) & (F.col("e") <= n)
    own = rows.join(docs.select("case_id", "n_chars"), "case_id")
    coded = own.select("case_id", F.explode(F.filter(F.array(F.when(~good, "bad_offsets"), F.when(good & F.col("blank"), "blank_slice"), F.when(~F.col("label").between(0, 8), "unknown_label"), F.when(F.col("kind") != "rhetorical", "other_kind")), lambda x: x.isNotNull())).alias("code"))
    counted = coded.groupBy("case_id", "code").agg(F.count(F.lit(1)).alias("n"))
    doubled = rows.filter("kind = 'rhetorical'").groupBy("case_id", "b", "e", "label").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").groupBy("case_id").agg(F.sum(F.col("c") - 1).alias("n")).select("case_id", F.lit("duplicate_rows").alias("code"), "n")
    bare = docs.join(rows.filter("kind = 'rhetorical'").select("case_id").distinct(), "case_id", "left_anti").select("case_id", F.lit("no_spans").alias("code"), F.lit(1).cast("long").alias("n"))
    length = docs.filter("n_chars <> text_len").select("case_id", F.lit("text_len").alias("code"), F.lit(1).cast("long").alias("n"))
    return counted.unionByName(doubled).unionByName(bare).unionByName(length)


def has_defer(*columns: Column) -> Column:
    """Whether any of the columns has the marker in a text, however deep: structs, maps (keys too) and arrays are looked through as JSON, whose escapes of line breaks and tabs count as spaces."""
    out = F.lit(False)
    for c in columns:
        plain = F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r"\\[nrtbf]", " ")
        out = out | F.coalesce(plain.rlike(DEFER), F.lit(False))
    return out


ERROR, WARNING = "error", "warning"
# What marks a row that nobody reviewed, and one that merges candidates.
UNREVIEWED = ["unadjudicated"]
UNION = ["UNION"]


def documents(docs: DataFrame, rows: DataFrame, residue: DataFrame, roles: list[str]) -> DataFrame:
    """case_id, level, code and n of all that is wrong or odd in annotated documents.

    docs: case_id, text, text_len; rows: spans with label names; residue: meta and span_meta. Errors:
    text_len, no_spans, duplicate_rows, unknown_label, bad_offsets, blank_slice, and DEFER, a marker of
    an open decision anywhere in a document's other fields. Warnings: other_kind, crossing.
    """
    number = F.array_position(F.array(*map(F.lit, roles)), F.col("label")) - 1
    slices = rows.join(docs.select("case_id", "text"), "case_id")
    text = F.substring("text", (F.col("b") + 1).cast("int"), (F.col("e") - F.col("b")).cast("int"))
    blank = (F.col("b") >= 0) & (F.col("b") < F.col("e")) & ~text.rlike(r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
    marked = slices.select("case_id", "b", "e", F.when(number >= 0, number).otherwise(-1).alias("label"), "kind", F.coalesce(blank, F.lit(False)).alias("blank"), F.col("label").alias("name"))
    own = marked.filter("kind = 'rhetorical'")
    length = docs.select("case_id", F.char_length("text").cast("long").alias("n_chars"), F.coalesce(F.col("text_len").cast("long"), F.char_length("text").cast("long")).alias("text_len"))
    # Rows of unknown labels are doubled only by rows of the same name.
    found = errors(own.withColumn("label", F.col("label").cast("long")), length).filter("code <> 'duplicate_rows'")
    doubled = own.groupBy("case_id", "b", "e", "name").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").groupBy("case_id").agg(F.sum(F.col("c") - 1).alias("n")).select("case_id", F.lit("duplicate_rows").alias("code"), "n")
    labels = rows.groupBy("case_id").agg(F.collect_set("label").alias("_labels"))
    deferred = residue.join(labels, "case_id", "left").filter(has_defer(F.col("meta"), F.col("span_meta"), F.col("_labels"))).select("case_id", F.lit("DEFER").alias("code"), F.lit(1).cast("long").alias("n"))
    good = own.filter((F.col("label") >= 0) & (F.col("b") < F.col("e"))).select("case_id", "b", "e", F.col("label").cast("long").alias("label"), "kind")
    odd = marked.filter("kind <> 'rhetorical'").groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).select("case_id", F.lit("other_kind").alias("code"), "n")
    crossed = spans.crossing(spans.regions(good)).groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).select("case_id", F.lit("crossing").alias("code"), "n")
    at = lambda df, level: df.select("case_id", F.lit(level).alias("level"), "code", F.col("n").cast("long").alias("n"))
    return reduce(DataFrame.unionByName, [at(found, ERROR), at(doubled, ERROR), at(deferred, ERROR), at(odd, WARNING), at(crossed, WARNING)])


def reviewed(rows: DataFrame, residue: DataFrame) -> DataFrame:
    """One row: how the rows of regions with several labels were reviewed, by their own fields. rows: spans with provenance and candidate_source; residue has each document's meta, of which merge counts."""
    own = rows.filter("kind = 'rhetorical'").withColumns({"unreviewed": F.coalesce(F.exists(F.array(*map(F.lit, UNREVIEWED)), lambda p: F.startswith("provenance", p)), F.lit(False)), "union": F.coalesce(F.col("candidate_source").isin(UNION), F.lit(False)), "missing": F.col("provenance").isNull()})
    region = own.groupBy("case_id", "b", "e").agg(F.countDistinct("label").alias("k"), *(F.max(c).alias(c) for c in ("unreviewed", "union", "missing"))).filter("k > 1")
    clean = ~F.col("unreviewed") & ~F.col("union") & ~F.col("missing")
    regions = region.agg(F.count(F.lit(1)).alias("regions"), F.count_if(clean).alias("all_reviewed"), F.count_if("unreviewed").alias("with_unreviewed"), F.count_if("union").alias("with_union"), F.count_if("missing").alias("without_provenance"))
    marked = own.agg(F.count_if("union").alias("rows_with_union"))
    declared = residue.agg(F.count_if(F.get_json_object(F.col("meta")["merge"], "$.NOT_human_adjudicated_gold") == "true").alias("not_human"))
    one = regions.crossJoin(marked).crossJoin(declared)  # one row each
    return one.withColumn("confirmed_by_flags", (F.col("regions") > 0) & (F.col("all_reviewed") == F.col("regions")) & (F.col("not_human") == 0))


def provenance(spans: DataFrame) -> DataFrame:
    """How regions' rows were reviewed: class and n. Provenance 0 is unadjudicated, 3 missing."""
    region = spans.filter("kind = 'rhetorical'").groupBy("case_id", "b", "e").agg(F.countDistinct("label").alias("k"), F.max(F.col("prov") == 0).alias("unreviewed"), F.max(F.col("prov") == 3).alias("missing"), F.max(F.col("prov") == 2).alias("union"))
    kind = F.when(F.col("unreviewed"), "unreviewed").when(F.col("union"), "union").when(F.col("missing"), "missing").otherwise("reviewed")
    return region.filter("k > 1").groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def straddling(groups: DataFrame) -> DataFrame:
    """Groups (root) whose members are in several splits."""
    return groups.groupBy("root").agg(F.countDistinct("split").alias("n_splits"), F.count(F.lit(1)).alias("n")).filter("n_splits > 1")


def not_once(members: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that a grouping does not cover exactly once."""
    counts = members.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    return ids.select("case_id").join(counts, "case_id", "left").select("case_id", F.coalesce("n", F.lit(0).cast("long")).alias("n")).filter("n <> 1")
