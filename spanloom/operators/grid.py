"""The sentence grid: offsets of sentences in code points."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

if TYPE_CHECKING:
    import pandas as pd


def sentences(docs: DataFrame, stop: str = T.STOP) -> DataFrame:
    """case_id, sent_idx, b, e of the pieces that have a letter or number, without white space at their ends. Only offsets are shuffled, never text."""
    cut = docs.select("case_id", F.posexplode(T.pieces(F.col("text"), stop)).alias("i", "s"))
    measured = cut.select("case_id", "i", F.char_length("s").cast("long").alias("n"), T.leading(F.col("s")).cast("long").alias("l"), T.trimmed_length(F.col("s")).cast("long").alias("r"), F.col("s").rlike(T.CONTENT).alias("good"))
    w = Window.partitionBy("case_id").orderBy("i")
    placed = measured.withColumn("base", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = placed.filter((F.col("r") > F.col("l")) & F.col("good")).select("case_id", "i", (F.col("base") + F.col("l")).alias("b"), (F.col("base") + F.col("r")).alias("e"))
    return kept.withColumn("sent_idx", (F.row_number().over(w) - 1).cast("long")).select("case_id", "sent_idx", "b", "e")


def texts(docs: DataFrame, stop: str = T.STOP) -> DataFrame:
    """case_id, sent_idx, grid_n (the case's sentences) and text of each sentence, cut where the documents are: nothing is shuffled, and no sentence is looked up in the whole text."""
    # The mark that cuts is no part of any piece, so only a text that has it itself has other offsets than its pieces.
    marked = F.contains("text", F.lit("\x01"))
    cut = docs.filter(~marked).select("case_id", F.filter(T.pieces(F.col("text"), stop), lambda s: s.rlike(T.CONTENT)).alias("s"))
    each = cut.select("case_id", "s", F.size("s").cast("long").alias("grid_n")).select("case_id", "grid_n", F.posexplode("s").alias("k", "s"))
    odd = docs.filter(marked)
    own = sentences(odd, stop)
    sized = own.join(own.groupBy("case_id").agg(F.count(F.lit(1)).alias("grid_n")), "case_id").join(odd, "case_id")
    return each.select("case_id", F.col("k").cast("long").alias("sent_idx"), "grid_n", T.trimmed(F.col("s")).alias("text")).unionByName(sized.select("case_id", "sent_idx", "grid_n", T.slice_(F.col("text"), F.col("b"), F.col("e")).alias("text")))


def segmented(docs: DataFrame, segment: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    """The grid of an outside segmenter, which gives a text's pieces as offsets: they are trimmed and kept as :func:`sentences` does; pieces that overlap or leave the text are an error."""
    kind = docs.schema["case_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for batch in batches:
            rows = []
            for case, text in zip(batch["case_id"], batch["text"], strict=True):
                last, k = 0, 0
                for b, e in segment(text or ""):
                    if not last <= b <= e <= len(text):
                        raise ValueError(f"{case}: the segmenter's piece {b}-{e} does not fit")
                    last, piece = e, text[b:e]
                    b, e = b + len(piece) - len(piece.lstrip()), e - len(piece) + len(piece.rstrip())
                    if any(c.isalnum() for c in piece):
                        rows.append((case, k, b, e))
                        k += 1
            yield pd.DataFrame(rows, columns=["case_id", "sent_idx", "b", "e"])

    return docs.select("case_id", "text").mapInPandas(run, f"case_id {kind}, sent_idx long, b long, e long")


def fingerprint(grid: DataFrame) -> DataFrame:
    """One row: a hash over the cases' own hashes in order, the number of cases and of sentences."""
    own = grid.groupBy("case_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "b", "e"))), lambda x: F.concat_ws(",", x["b"], x["e"])), ";"), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    # The cases' hashes meet as sums of their halves, so that no task needs all of them at once.
    half = lambda k: F.sum(F.conv(F.substring("h", k, 8), 16, 10).cast("long"))
    return own.agg(half(1).alias("sum_1"), half(9).alias("sum_2"), F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_sentences"))
