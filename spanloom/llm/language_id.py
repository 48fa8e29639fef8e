"""Language of web pages by Bayesian fusion of evidence.

The text's likelihood under each language comes from counts of byte trigrams over all labelled
documents, tempered, as trigrams are not independent. Its verdict on every page yields, by grouped
aggregation, how declared markup languages and address suffixes go with languages, and how the
languages of a host, its domain and the whole table are spread. A page's posterior multiplies the
likelihoods of its text, declaration and suffix with a prior of its host, which is smoothed towards
the domain's, and that towards the table's; the page itself is left out of its host's counts.

Cases: an empty table of pages gives no rows; a very long page or document is taken whole, its
declaration wherever it stands; a null or empty page has no text and is judged by address and host alone; a page without a
declaration or suffix takes no evidence from it; ties go to the first language by name; repeated
pages are judged alike; without labelled documents the language is null. Columns besides id, url,
html, and the documents' text and language, are left out, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from . import textnum as tn

#: Buckets of trigrams, as a power of two.
BITS = 16
#: The text counts as so many independent trigrams for each one, and as no more than MOST in all.
TEMPER, MOST = 0.1, 40.0
#: Pages of prior weight at each step from the table to the domain to the host, and of the evidence tables.
STRENGTH, SMOOTH = 4.0, 1.0
_MARKUP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;?")
_HTML = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<html\b([^>]*)")
_LANG = re.compile(r"""(?is)\slang\s*=\s*["']?\s*([a-z]{2,3})""")


def declared(page: str) -> str | None:
    """The language of the page's first html tag, wherever it stands; one in a comment does not count."""
    tag = next((m[1] for m in _HTML.finditer(page) if m[1] is not None), None)
    return m[1].lower() if tag is not None and (m := _LANG.search(tag)) else None


def _trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams within texts, runs of other than letters being one space, and the text of each."""
    fold = tn.ascii_lower_table()
    fold[[b for b in range(128) if not chr(b).isalpha()]] = 32
    low = fold[raw].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    keep[off[:-1][off[:-1] < len(low)]] = True  # what stands before a text is another's
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[keep]
    low = low[keep]
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    same = doc[:-2] == doc[2:]
    return code[same].astype(np.int64), doc[:-2][same]


def likelihoods(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log likelihood of each bucket, from all documents that name a language; a task sums its own counts first."""
    size = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, off = tn.utf8(batch.column("text"))
            names = batch.column("lang").to_pylist()
            for i, j in tn.chunks(off):
                code, doc = _trigrams(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                own = np.array(names[i:j])
                for name in set(names[i:j]):
                    got = np.bincount(code[(own == name)[doc]], minlength=size)
                    total[name] = total[name] + got if name in total else got
        for name, counts in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [name], "counts": pa.array([counts.astype("<i8").tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, data in zip(batch.column("lang").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                got = np.frombuffer(data, dtype="<i8")
                held[name] = held[name] + got if name in held else got
        for name, counts in held.items():
            yield pa.RecordBatch.from_pydict({"lang": [name], "counts": pa.array([counts.tobytes()], pa.binary())})

    own = docs.select(F.col(text).cast("string").alias("text"), F.lower(F.col(lang).cast("string")).alias("lang")).filter("lang is not null and lang <> ''")
    # Sums meet twice: first over 16 groups of tasks, then over those.
    part = own.mapInArrow(run, "lang string, counts binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    once = part.repartition(16, "lang", "salt").select("lang", "counts").mapInArrow(add, "lang string, counts binary")
    found = {r.lang: np.frombuffer(r.counts, dtype="<i8") for r in once.repartition(4, "lang").mapInArrow(add, "lang string, counts binary").toLocalIterator()}  # a row for each language
    names = sorted(found)
    counts = np.array([found[n] for n in names], dtype=float).reshape(len(names), size)
    smooth = counts + 0.5
    return names, np.log(smooth / smooth.sum(axis=1, keepdims=True))


def address(url: Column) -> tuple[Column, Column, Column]:
    """Host, domain (its last two labels) and suffix (its last) of a url."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    labels = F.split(host, "\\.")
    n = F.size(labels)
    domain = F.when(n > 2, F.array_join(F.slice(labels, n - 1, F.lit(2)), ".")).otherwise(host)
    return host, domain, F.when(n > 1, F.get(labels, n - 1)).otherwise("")


def identify(pages: DataFrame, docs: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, url, lang, probability, text_lang and declared of every page."""
    spark = pages.sparkSession
    scratch = common.Scratch(spark, "language")
    names, table = likelihoods(docs, text, lang)
    sent, n = spark.sparkContext.broadcast((table - table.mean(axis=0) if names else table).astype(np.float32)), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                pages = [p or "" for p in part.column("html").to_pylist()]
                said = [declared(p) for p in pages]
                raw, off = tn.utf8(pa.array([_MARKUP.sub(" ", p) for p in pages], pa.string()))
                code, doc = _trigrams(raw, off)
                count = np.bincount(doc, minlength=len(pages))
                logs = np.zeros((len(pages), n))
                for k in range(n):
                    logs[:, k] = np.bincount(doc, weights=sent.value[k][code], minlength=len(pages))
                weight = np.minimum(TEMPER, MOST / np.maximum(count, 1))
                logs = logs * weight[:, None]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("url"), pa.array(said, pa.string()), pa.array(list(logs), pa.list_(pa.float64()))], names=["key", "url", "declared", "logs"])

    kind = pages.schema[key].dataType.simpleString()
    own = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    if not names:
        null = F.lit(None).cast("string")
        return own.select(F.col("key").alias(key), "url", null.alias("lang"), F.lit(None).cast("double").alias("probability"), null.alias("text_lang"), null.alias("declared"))
    host, domain, suffix = address(F.col("url"))
    scored = own.mapInArrow(run, f"key {kind}, url string, declared string, logs array<double>").withColumns({"host": host, "domain": domain, "suffix": suffix})
    # A page without text has no verdict of its own and takes no part in the counts.
    verdict = F.when(F.exists("logs", lambda x: x != 0), F.array_position("logs", F.array_max("logs")).cast("int") - 1)
    judged = scratch.table(scored.withColumn("verdict", verdict), "judged")
    spread = lambda by: judged.filter("verdict is not null").groupBy(*by).agg(F.array(*(F.count_if(F.col("verdict") == k).cast("double") for k in range(n))).alias("counts"))
    total = spread([]).head().counts
    base = [(x + SMOOTH) / (sum(total) + SMOOTH * n) for x in total]
    base_column = F.array(*map(F.lit, base))

    def evidence(column: str) -> DataFrame:
        """log P(value | language) less its mean over languages, for each value of a column; rare values say little."""
        given = F.transform("counts", lambda c, k: F.log((c + SMOOTH * F.get(base_column, k)) / (F.get(F.array(*map(F.lit, total)), k) + SMOOTH)))
        return spread([column]).filter(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(column).alias("v"), given.alias("given"))

    def near(df: DataFrame) -> DataFrame:
        """Small tables are broadcast: rows are counted, and each takes about 100 bytes."""
        held = scratch.table(df, f"near-{abs(hash(tuple(df.columns)))}-{near.made}")
        near.made += 1
        return F.broadcast(held) if held.count() <= 1 << 17 else held

    near.made = 0
    joined = judged
    for column, name in (("declared", "by_markup"), ("suffix", "by_suffix"), ("host", "by_host"), ("domain", "by_domain")):
        side = near(evidence(column) if name in ("by_markup", "by_suffix") else spread([column]).select(F.col(column).alias("v"), F.col("counts").alias("given")))
        joined = joined.join(side.select(F.col("v").alias(f"v_{name}"), F.col("given").alias(name)), F.col(column) == F.col(f"v_{name}"), "left").drop(f"v_{name}")
    mine = lambda k: F.when(F.col("verdict") == k, 1.0).otherwise(0.0)
    less = lambda name: F.transform(F.coalesce(F.col(name), F.array_repeat(F.lit(0.0), n)), lambda c, k: c - mine(k))
    smoothed = lambda counts, prior: F.transform(F.zip_with(counts, prior, lambda c, p: c + STRENGTH * p), lambda x: x / (F.aggregate(counts, F.lit(0.0), lambda a, b: a + b) + STRENGTH))
    nothing = F.array_repeat(F.lit(0.0), n)
    fused = joined.withColumn("domain_prior", smoothed(less("by_domain"), base_column)).withColumn("prior", smoothed(less("by_host"), F.col("domain_prior")))
    log = F.zip_with(F.zip_with("logs", F.coalesce("by_markup", nothing), lambda a, b: a + b), F.zip_with(F.coalesce("by_suffix", nothing), F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b), lambda a, b: a + b)
    fused = fused.withColumn("log", log).withColumn("best", F.array_max("log"))
    mass = F.aggregate(F.transform("log", lambda x: F.exp(x - F.col("best"))), F.lit(0.0), lambda a, b: a + b)
    listed = F.array(*map(F.lit, names))
    return fused.select(F.col("key").alias(key), "url", F.get(listed, F.array_position("log", F.col("best")).cast("int") - 1).alias("lang"), (1 / mass).alias("probability"), F.get(listed, F.col("verdict")).alias("text_lang"), "declared")
