"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Fitting takes bounded samples of labelled rows, by a hash of the id, so every run takes the same:
at most ``TERM_ROWS`` of them say which terms tell the labels apart, and at most ``PER_CLASS`` of each
label are the examples, weighted by their label's share of all labelled rows. Terms are words and
word beginnings of four and five bytes. The vocabulary has those, of either leaning, whose presence
depends on the label beyond chance (chi-squared, at a level at which all tests together would let a
hundredth of a term pass by chance) and strongly (an odds ratio); neither test depends on how many
rows there are, and there is no limit on terms. The examples' TF-IDF vectors fill an inverted index
whose postings are cut into blocks of examples, with the largest weight of each block. Document
frequencies are counted over all documents; vectors and their norms are those of the vocabulary's terms.

Scoring bounds each block of examples by its largest weights, visits blocks in falling order of
the bound, and stops when no block can reach the K-th best: the K nearest are exact. Their votes
count by 1 / distance; a prior from the examples without any vocabulary term joins them; a
monotone map fitted on the examples themselves, each scored without itself, calibrates the result.

Cases: null and empty texts, and texts without a vocabulary term, get the score of no evidence;
very long texts are taken whole, their words in blocks; an empty table of documents gives no rows;
ties go to the lower example; repeated rows are scored alike, and of a repeated example the largest
counts hold; with no labelled rows, or of one label only, all documents get the same score. Neither
labels, languages, sources nor ids are inputs of a score. Columns besides key and text are left
out, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textnum as tn

#: Labelled rows of each class that are examples at most, and those that choose the terms at most.
PER_CLASS, TERM_ROWS = 3000, 1 << 17
#: Terms are tested that at least so many labelled rows have; so many of all that are tested may pass by chance; and having a term must change the odds of a label by this factor, either way.
LEAST_DF, CHANCE, ODDS = 3, 0.01, 16.0
NEIGHBOURS = 15
#: Examples of a block of the index.
BLOCK = 32
PREFIXES = (4, 5)
#: Pairs of term and count that a task gathers before it sends them.
GATHERED = 1 << 21


def term_hashes(words: tn.Words) -> np.ndarray:
    """A row of term hashes for each word: the word, and its beginnings; 0 where it is too short."""
    return np.concatenate((words.hash[:, None], words.heads), axis=1)


def _doc_terms(raw: np.ndarray, off: np.ndarray, known: tn.Lookup | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, terms (their hashes, or their places among the known) and counts, by document and term."""
    words = tn.Words(raw, off, tn.ALNUM, PREFIXES)
    terms = term_hashes(words)
    flat = terms.ravel()
    if known is None:
        at = np.flatnonzero(flat)
        flat = flat[at]
    else:
        at, flat = known.find(flat)
        flat = flat.astype(np.uint64)
    doc = np.searchsorted(words.first, at // terms.shape[1], side="right") - 1
    order = np.lexsort((flat, doc))
    doc, flat = doc[order], flat[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (flat[1:] != flat[:-1])
    first = np.flatnonzero(new)
    return doc[first], flat[first], np.diff(np.append(first, len(doc)))


@dataclass
class Model:
    known: np.ndarray  # sorted hashes of the vocabulary
    idf: np.ndarray
    toxic: np.ndarray  # of the examples
    weight: np.ndarray
    ids: np.ndarray
    start: np.ndarray  # postings of term t: start[t]:start[t + 1]
    example: np.ndarray
    value: np.ndarray
    top: np.ndarray  # largest weight by term and block
    places: np.ndarray  # first posting by term and block, and the end
    prior: float = 0.0
    strength: float = 1.0
    raw: np.ndarray | None = None  # the calibration: raw scores and calibrated ones
    fitted: np.ndarray | None = None

    def nearest(self, terms: np.ndarray, counts: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples of positive cosine and their cosines, best first."""
        q = (1 + np.log(counts)) * self.idf[terms]
        q = q / np.sqrt((q * q).sum())
        bound = q @ self.top[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        k, found, sims, floor = NEIGHBOURS, [], [], 0.0
        at, step = 0, 4
        while at < len(order) and bound[order[at]] >= floor - 1e-9:
            # All blocks that can still matter come next, but few at first, to raise the floor cheaply.
            blocks = order[at : at + step]
            at, step = at + step, 8 * step
            blocks = blocks[bound[blocks] >= floor - 1e-9]
            low, high = self.places[terms[:, None], blocks], self.places[terms[:, None], blocks + 1]
            size = (high - low).ravel()
            where = np.repeat(low.ravel() - (np.cumsum(size) - size), size) + np.arange(size.sum())
            column = np.repeat(np.tile(np.arange(len(blocks)), len(terms)), size) * BLOCK + self.example[where] % BLOCK
            acc = np.bincount(column, weights=self.value[where] * np.repeat(np.repeat(q, len(blocks)), size), minlength=len(blocks) * BLOCK)
            hit = np.flatnonzero(acc > 0)
            ids = blocks[hit // BLOCK] * BLOCK + hit % BLOCK
            keep = ids != without
            found.append(ids[keep])
            sims.append(acc[hit][keep])
            every = np.concatenate(sims)
            floor = np.partition(every, len(every) - k)[len(every) - k] if len(every) >= k else 0.0
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        ids, sim = np.concatenate(found), np.concatenate(sims)
        best = np.lexsort((ids, -np.round(sim, 12)))[:k]
        return ids[best], sim[best]

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        w = self.weight[ids] / (1.02 - sims)
        return float((w @ self.toxic[ids] + self.strength * self.prior) / (w.sum() + self.strength))

    def calibrated(self, raw: float) -> float:
        return float(np.interp(raw, self.raw, self.fitted)) if self.raw is not None else raw


def _monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression by pooling neighbours that fall."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    total = np.array(pools)
    return total[:, 0] / total[:, 2], np.clip(total[:, 1] / total[:, 2], 0, 1)


def _beyond(chance: float) -> float:
    """The value that chi-squared of one degree exceeds with this probability."""
    low, high = 0.0, 2000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if math.erfc(math.sqrt(middle / 2)) > chance else (low, middle)
    return high


def term_counts(rows: DataFrame) -> DataFrame:
    """term, a and b: how many of the rows (text, label 0 or 1) with label 1, and with label 0, have it; a task adds up its own first."""

    def added(held: list[np.ndarray]) -> np.ndarray:
        term, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return np.stack([term, *(np.bincount(at, weights=np.concatenate([h[k] for h in held])).astype(np.uint64) for k in (1, 2))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        send = lambda: pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in held[0]], names=["term", "a", "b"])
        for batch in batches:
            raw, off = tn.utf8(batch.column("text"))
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.uint64)
            for i, j in tn.chunks(off):
                doc, term, _ = _doc_terms(raw[off[i] : off[j]], off[i : j + 1] - off[i], None)
                held.append(added([np.stack([term, label[doc + i], 1 - label[doc + i]])]))
                size += held[-1].shape[1]
                if size > GATHERED:
                    held = [added(held)]
                    size = held[0].shape[1]
                    if 2 * size > GATHERED:
                        yield send()
                        held, size = [], 0
        if held:
            held = [added(held)]
            yield send()

    return rows.select("text", "label").mapInArrow(common.lean(run), "term long, a long, b long").groupBy("term").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))


def vocabulary(rows: DataFrame, n1: float, n0: float) -> np.ndarray:
    """The sorted hashes of the terms that tell the labels of the rows apart."""
    tested = term_counts(rows).filter(F.col("a") + F.col("b") >= LEAST_DF)
    held = common.Scratch(rows.sparkSession, "terms").table(tested, "tested")
    level = _beyond(CHANCE / max(1, held.count()))
    a, b = F.col("a"), F.col("b")
    cross = a * n0 - b * n1
    chi2 = (n1 + n0) * cross * cross / (F.lit(max(n1 * n0, 1.0)) * (a + b) * F.greatest(F.lit(n1 + n0) - a - b, F.lit(1.0)))
    odds = (a + 0.5) * (n0 - b + 0.5) / ((n1 - a + 0.5) * (b + 0.5))
    found = held.filter((chi2 >= level) & ((odds >= ODDS) | (odds <= 1 / ODDS))).select("term").collect()  # of the terms of a bounded sample
    return np.sort(np.array([r.term for r in found], dtype=np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """A model from the labelled rows; docs and labels meet on key. The driver gets the examples' vectors, of bounded number and length."""
    scratch = common.Scratch(docs.sparkSession, "toxicity")
    marked = labels.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label")).filter("key is not null and label in (0, 1)").groupBy("key").agg(F.max("label").alias("label"))
    own = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    totals = {r.label: r.n for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = scratch.table(marked.orderBy(F.xxhash64("key"), "key").limit(TERM_ROWS), "taken")
    rows = own.join(F.broadcast(taken), "key")
    counted = {r.label: r.n for r in taken.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = vocabulary(rows, float(counted.get(1, 0)), float(counted.get(0, 0)))
    chosen = [marked.filter(F.col("label") == v).orderBy(F.xxhash64("key"), "key").limit(per_class) for v in (0, 1)]
    sample = scratch.table(chosen[0].unionByName(chosen[1]), "sample")
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vectors of the examples, and a task's own document frequencies."""
        table, size, total = tn.Lookup(sent.value), 0, np.zeros(len(sent.value), dtype=np.int64)
        for batch in batches:
            raw, off = tn.utf8(batch.column("text"))
            size += batch.num_rows
            example = batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            for i, j in tn.chunks(off):
                doc, term, count = _doc_terms(raw[off[i] : off[j]], off[i : j + 1] - off[i], table)
                total += np.bincount(term.astype(np.int64), minlength=len(total))
                keep = example[doc + i]
                at = pa.array(doc[keep] + i)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(at), pa.array(term[keep].astype(np.int64)), pa.array(count[keep], pa.int64())], names=["key", "term", "n"])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some) + 1, pa.int64()), pa.array(np.append(some, -1)), pa.array(np.append(total[some], size))], names=["key", "term", "n"])

    each = scratch.table(own.join(F.broadcast(sample), "key", "left").mapInArrow(common.lean(run), "key long, term long, n long"), "each")
    sums = {r.term: r.n for r in each.filter("key is null").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term
    vectors = each.filter("key is not null").groupBy("key", "term").agg(F.max("n").alias("n")).groupBy("key").agg(F.collect_list(F.struct("term", "n")).alias("terms"))  # a repeated row is one example
    listed = {r.key: (r.label, r.terms) for r in sample.join(vectors, "key", "left").collect()}  # the sample's rows
    df = np.array([sums.get(k, 0) for k in range(len(known))], dtype=float)
    return _model(known, df, sums.get(-1, 0), listed, totals)


def _model(known: np.ndarray, counted: np.ndarray, size: int, listed: dict, totals: dict[int, int]) -> Model:
    n = len(listed)
    idf = np.log((1 + size) / (1 + counted)) + 1
    keys = sorted(listed)
    toxic = np.array([listed[k][0] for k in keys], dtype=float)
    share = {v: totals.get(v, 0) / max((toxic == v).sum(), 1) for v in (0, 1)}
    mean = sum(totals.values()) / max(n, 1)
    weight = np.array([share[int(t)] / max(mean, 1e-9) for t in toxic])
    vectors, post = [], []
    for e, k in enumerate(keys):
        got = listed[k][1] or []
        at = np.array([t["term"] for t in got], dtype=np.int64)
        counts = np.array([t["n"] for t in got], dtype=float)
        order = np.argsort(at)
        at, counts = at[order], counts[order]
        w = (1 + np.log(counts)) * idf[at] if len(at) else counts
        vectors.append((at, counts))
        if len(at):
            post.append(np.stack([at, np.full(len(at), e), w / np.sqrt((w * w).sum())]))
    flat = np.concatenate(post, axis=1) if post else np.zeros((3, 0))
    flat = flat[:, np.lexsort((flat[1], flat[0]))]
    term, example, value = flat[0].astype(np.int64), flat[1].astype(np.int64), flat[2]
    top = np.zeros((len(known), -(-n // BLOCK) or 1))
    np.maximum.at(top, (term, example // BLOCK), value)
    code = term * (top.shape[1] + 1) + example // BLOCK
    places = np.searchsorted(code, np.arange(len(known) * (top.shape[1] + 1))).reshape(len(known), top.shape[1] + 1)
    model = Model(known, idf, toxic, weight, np.array(keys), np.searchsorted(term, np.arange(len(known) + 1)), example, value, top, places)
    bare = np.array([not len(v[0]) for v in vectors], dtype=bool)
    model.prior = float((weight[bare] @ toxic[bare] + 0.01) / (weight[bare].sum() + 1)) if n else 0.0
    if n:
        raw = np.array([model.vote(*(model.nearest(*v, without=e) if len(v[0]) else (np.zeros(0, np.int64), np.zeros(0)))) for e, v in enumerate(vectors)])
        model.raw, model.fitted = _monotone(raw, toxic, weight)
    return model


EVIDENCE = "array<struct<example:long,cosine:double,toxic:int>>"


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and evidence (the three nearest examples) of every row, in one narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        table = tn.Lookup(model.known)
        none = model.calibrated(model.prior)
        memo: dict[bytes, tuple[float, list]] = {}
        for batch in batches:
            raw, off = tn.utf8(batch.column(1))
            for i, j in tn.chunks(off):
                scores, evidence = [none] * (j - i), [[] for _ in range(j - i)]
                doc, term, count = _doc_terms(raw[off[i] : off[j]], off[i : j + 1] - off[i], table)
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                for d in np.flatnonzero(np.diff(cuts)).tolist():
                    t, c = term[cuts[d] : cuts[d + 1]].astype(np.int64), count[cuts[d] : cuts[d + 1]]
                    sign = t.tobytes() + c.tobytes()
                    if (got := memo.get(sign)) is None:
                        ids, sims = model.nearest(t, c)
                        got = model.calibrated(model.vote(ids, sims)) if len(ids) else none, [{"example": int(model.ids[e]), "cosine": float(s), "toxic": int(model.toxic[e])} for e, s in zip(ids[:3], sims[:3], strict=True)]
                        if len(memo) > 10_000:
                            memo.clear()
                        memo[sign] = got
                    scores[d], evidence[d] = got
                kind = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(scores, pa.float64()), pa.array(evidence, kind)], names=["key", "score", "evidence"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(common.lean(run), f"key {kind}, score double, evidence {EVIDENCE}").withColumnRenamed("key", key)


def held_out(key: str = "doc_id"):
    """Rows whose labels a model never sees."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
