"""Annotated documents as JSON files, and the writers of derived data and manifests."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.roles import ROLES
from ..functions.text import LETTER, slice_
from ..operators import spans as span_algebra

SPAN = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("provenance", T.StringType()), T.StructField("candidate_source", T.StringType())])
DOCUMENT = T.StructType([T.StructField("canonical_case_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("text_len", T.IntegerType()), T.StructField("text_sha256", T.StringType()), T.StructField("source", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))])


def load(spark: SparkSession, folder: str, texts: DataFrame | None = None) -> DataFrame:
    """case_id, text, text_sha256, text_len, spans of a folder with one JSON document a file.

    The id is the file's stem where the document names none; of files with the same id the last by
    path counts. A document without text takes it from texts (case_id, text). Reading a document
    whose declared hash is not its text's, or that has no text at all, is an error.
    """
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).json(folder).withColumn("_path", F.col("_metadata.file_path"))
    stem = F.regexp_extract("_path", r"([^/]+)\.json$", 1)
    named = raw.withColumn("case_id", F.coalesce(F.nullif("canonical_case_id", F.lit("")), stem))
    last = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("_path"))) == 1
    docs = named.withColumn("_last", last).filter("_last").drop("_last", "_path", "canonical_case_id")
    if texts is not None:
        docs = docs.join(texts.select("case_id", F.col("text").alias("_other")), "case_id", "left").withColumn("text", F.coalesce("text", "_other")).drop("_other")
    text = F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("no text: "), "case_id")).cast("string")).otherwise(F.col("text"))
    own = F.sha2(F.col("text").cast("binary"), 256)
    checked = F.when(F.col("text_sha256").isNotNull() & (F.col("text_sha256") != own), F.raise_error(F.concat(F.lit("the text's hash differs: "), "case_id")).cast("string")).otherwise(own)
    return docs.withColumn("text", text).withColumn("text_sha256", checked)


def spans(docs: DataFrame) -> DataFrame:
    """One row a span: case_id, b, e, label, kind (rhetorical where none is given), provenance, candidate_source."""
    s = docs.select("case_id", F.explode("spans").alias("s"))
    return s.select("case_id", F.col("s.begin").cast("long").alias("b"), F.col("s.end").cast("long").alias("e"), F.col("s.label").alias("label"), F.coalesce("s.kind", F.lit("rhetorical")).alias("kind"), "s.provenance", "s.candidate_source")


#: What :func:`load` and :func:`spans` read; anything else of a file is kept as it stands by :func:`residue`.
_DOCUMENT_KEYS, _SPAN_KEYS = ["text", "spans", "canonical_case_id"], ["begin", "end", "label", "kind"]


def residue(spark: SparkSession, folder: str) -> DataFrame:
    """case_id, meta (a map of all other fields of a file, as JSON) and span_meta (such a map of each span, in order), whatever fields there are. Of files with the same id the last by path counts."""
    whole = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("_path"))
    fields = F.from_json("value", "map<string,string>")
    held = whole.select("value", "_path", fields.alias("meta"))
    stem = F.regexp_extract("_path", r"([^/]+)\.json$", 1)
    named = held.withColumn("case_id", F.coalesce(F.nullif(F.col("meta")["canonical_case_id"], F.lit("")), stem))
    last = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("_path"))) == 1
    rest = lambda m, known: F.map_filter(m, lambda k, _: ~k.isin(known))
    listed = F.coalesce(F.from_json("value", "struct<spans:array<map<string,string>>>")["spans"], F.array().cast("array<map<string,string>>"))
    return named.withColumn("_last", last).filter("_last").select("case_id", rest(F.col("meta"), _DOCUMENT_KEYS).alias("meta"), F.transform(listed, lambda x: rest(x, _SPAN_KEYS)).alias("span_meta"))


def corpus(spark: SparkSession, root: str, adjudicated: str = "Annotator_C", others: tuple[str, ...] = ("annotator_A", "annotator_B")) -> DataFrame:
    """All annotators' documents with an annotator column; the same ids are needed of each."""
    main = load(spark, f"{root}/{adjudicated}")
    out, ids = main.withColumn("annotator", F.lit(adjudicated)), main.select("case_id")
    for name in others:
        own = load(spark, f"{root}/{name}", main.select("case_id", "text"))
        mine = own.select("case_id")
        if ids.exceptAll(mine).limit(1).count() or mine.exceptAll(ids).limit(1).count():
            raise ValueError(f"{name} has other documents than {adjudicated}")
        out = out.unionByName(own.withColumn("annotator", F.lit(name)))
    return out


def normalised(spark: SparkSession, folder: str) -> DataFrame:
    """The spans that normalisation keeps of a folder of documents: case_id, b, e, label (its number), kind, letter; a label outside the inventory is an error."""
    docs = load(spark, folder)
    number = F.array_position(F.array(*map(F.lit, ROLES)), F.col("label")) - 1
    known = F.when(number >= 0, number).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), "label")).cast("long"))
    rows = spans(docs).join(docs.select("case_id", "text"), "case_id")
    letter = slice_(F.col("text"), F.col("b"), F.col("e")).rlike(LETTER)
    return span_algebra.normalise(rows.select("case_id", "b", "e", known.alias("label"), "kind", letter.alias("letter")))


def texts(spark: SparkSession, folder: str, expected: DataFrame | None = None) -> DataFrame:
    """case_id, text and text_sha256 alone of a folder of documents; a hash other than the expected one (case_id, text_sha256) is an error."""
    found = load(spark, folder).select("case_id", "text", "text_sha256")
    if expected is None:
        return found
    joined = found.join(expected.select("case_id", F.col("text_sha256").alias("_expected")), "case_id", "left")
    checked = F.when(F.col("_expected").isNotNull() & (F.col("_expected") != F.col("text_sha256")), F.raise_error(F.concat(F.lit("not the expected text: "), "case_id")).cast("string")).otherwise(F.col("text"))
    return joined.select("case_id", checked.alias("text"), "text_sha256")


def read_split(spark: SparkSession, folder: str, schema: T.StructType | str, *splits: str, kind: str = "json", status: str | None = None) -> DataFrame:
    """Rows of the named splits (all without a name) that :func:`write_split` wrote, of one status if it is given; other splits' files are not read, and the status is pushed to the scan."""
    found = spark.read.schema(schema).format(kind).load(folder)
    if splits:
        found = found.filter(F.col("split").isin(*splits))
    return found.filter(F.col("status") == status) if status else found


#: Predictions of spans and of sentences.
SPAN_PREDICTIONS = "id string, case_id string, gold array<string>, probs array<double>"
SENTENCE_PREDICTIONS = "id string, case_id string, gold string, pred string, probs array<double>"


def read_predictions(spark: SparkSession, folder: str, schema: str = SPAN_PREDICTIONS) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two systems' predictions side by side by id, as structs a and b, in any order of rows; ids or gold labels that differ are an error."""
    left, right = (x.select("id", F.struct(*x.columns).alias(k)) for x, k in ((a, "a"), (b, "b")))
    both = left.join(right, "id", "full")
    same = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("a.gold").eqNullSafe(F.col("b.gold"))
    return both.select(F.when(same, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("not the same examples: "), "id")).cast("string")).alias("id"), "a", "b")


def write_answers(answers: DataFrame, folder: str, multi: bool, fallback: str | None = None) -> None:
    """Parsed answers (id, case_id, gold, codes) as predictions: vectors of 0 and 1 over the roles, or the first code, or else the fallback."""
    if multi:
        made = answers.select("id", "case_id", "gold", F.array(*(F.array_contains("codes", r).cast("double") for r in ROLES)).alias("probs"))
    else:
        made = answers.select("id", "case_id", "gold", F.coalesce(F.get("codes", F.lit(0)), F.lit(fallback)).alias("pred"))
    made.write.json(folder)


def definitions(path: str) -> dict[str, str]:
    """Role definitions of a JSON file; one for each role."""
    found = json.loads(Path(path).read_text())
    if missing := [r for r in ROLES if r not in found]:
        raise ValueError(f"no definition: {missing}")
    return {r: found[r] for r in ROLES}


def mock_corpus(root: str, documents: int = 4, sentences: int = 11) -> None:
    """A small made-up corpus of three annotators: each document has a span of two roles, a crossing pair, a nested pair, and a sentence that two spans share evenly; the second annotator's files have no text."""
    for k in range(documents):
        said = [f"Sentence {j} of case {k} has {'some ' * (j % 3)}words." for j in range(sentences)]
        text = "".join(x + ("\n\n" if j % 2 else " ") for j, x in enumerate(said))
        at = [text.index(x) for x in said]
        end = [a + len(x) for a, x in zip(at, said, strict=True)]
        half = (at[8] + end[8]) // 2
        marks = [(at[0], end[0], 0), (at[1], end[2], 1), (at[1], end[2], 2), (at[3], end[5], 3), (at[4], end[6], 4), (at[7], end[7], 5), (at[8], half, 6), (half, 2 * half - at[8], 7), (at[9], end[10], 6), (at[10], end[10], 8)]
        for name in ("Annotator_C", "annotator_A", "annotator_B"):
            folder = Path(root) / name
            folder.mkdir(parents=True, exist_ok=True)
            own = marks if name == "Annotator_C" else marks[: 5 + k % 3]
            listed = [{"begin": b, "end": e, "label": ROLES[r]} for b, e, r in own]
            body = {"canonical_case_id": f"M{k:04d}", "text_len": len(text), "text_sha256": hashlib.sha256(text.encode()).hexdigest(), "spans": listed}
            (folder / f"M{k:04d}.json").write_text(json.dumps(body | ({} if name == "annotator_B" else {"text": text})))


def setting(name: str, given: str | None = None, config: str = "spanloom.local.json") -> str:
    """A path by argument, environment variable or local file, in that order."""
    if given:
        return given
    if found := os.environ.get(name.upper()):
        return found
    if Path(config).exists() and (found := json.loads(Path(config).read_text()).get(name)):
        return found
    raise SystemExit(f"{name} is not set")


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(manifest: dict, without: tuple[str, ...] = ("created_utc", "sha256")) -> str:
    return hashlib.sha256(canonical({k: v for k, v in manifest.items() if k not in without}).encode()).hexdigest()


def write_manifest(path: str, manifest: dict, force: bool = False) -> str:
    """Writes a manifest with its hash, and the hash beside it; an existing one stays unless forced."""
    if Path(path).exists() and not force:
        raise FileExistsError(path)
    own = digest(manifest)
    Path(path).write_text(json.dumps(manifest | {"sha256": own}, ensure_ascii=False, indent=1))
    Path(path + ".sha256").write_text(own + "\n")
    return own


def read_manifest(path: str) -> dict:
    found = json.loads(Path(path).read_text())
    if digest(found) != found.get("sha256"):
        raise ValueError(f"{path} has been changed")
    return found


def write_split(df: DataFrame, folder: str, kind: str = "json") -> None:
    """Rows by split, as JSON lines or Parquet; an existing folder is an error."""
    df.write.mode("errorifexists").partitionBy("split").format(kind).save(folder)


def write_predictions(df: DataFrame, folder: str, probabilities: str = "probs") -> None:
    df.withColumn(probabilities, F.transform(probabilities, lambda x: F.round(x, 6))).write.json(folder)
