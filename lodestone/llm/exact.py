"""Exact dedup of whole texts, frequent digests apart from the rest. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import KEY, cut, row_key, without

#: A digest is a heavy hitter if it has at least one row in so many.
HEAVY = 1000
#: Counters of the frequent-items sketch: it misses nothing above 3.5 rows in so many.
COUNTERS = 10_000
BLANK = " \t\n\x0b\x0c\r"


def digests(docs: DataFrame) -> DataFrame:
    """(KEY, doc_id, digest, n): SHA-256 of the text without ASCII white space (null: empty), code points of the whole text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*row_key(), "doc_id", F.sha2(F.translate(text, BLANK, ""), 256).alias("digest"), F.char_length(text).alias("n"))


def _with_winners(d: DataFrame) -> DataFrame:
    """``d`` (of :func:`digests`, computed once) with keep_id and group_size of each row's digest."""
    total = d.count()
    order = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"))
    best = lambda rows: rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).getField("doc_id").alias("keep_id"))
    candidates = d.agg(F.expr(f"approx_top_k(digest, {HEAVY}, {COUNTERS})").alias("top")).select(F.explode("top.item").alias("digest"))
    heavy = cut(best(d.join(F.broadcast(candidates), "digest", "left_semi")).where(F.col("group_size") * HEAVY >= total))
    known = d.join(F.broadcast(heavy), "digest")
    rest = d.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    return known.unionByName(rest.join(best(rest), "digest"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``; extra columns are ignored.

    Of equal texts the row with the most code points stays, then that of least doc_id. Null and blank texts are equal to
    each other. A null doc_id sorts after all others and is kept only in a group without any other. Rows that repeat
    with their doc_id count one by one; if that doc_id stays, all are marked as kept. An empty table gives no rows.

    A Misra-Gries summary (the frequent-items sketch of ``approx_top_k``) names the candidates for heavy hitters. Their
    counts and winners are verified by an aggregation that is combined before the shuffle, and broadcast: HEAVY rows at
    most. Rows of a heavy digest find their winner where they lie. The others are shuffled by digest: counts and minima
    combined before, then the rows, which join them; a digest that is just too rare to be heavy can be split there.
    """
    found = _with_winners(cut(digests(docs).drop(*KEY)))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs``, with all its columns, without the rows that :func:`exact_duplicates` drops.

    Rows go by doc_id and text: a row without id goes if a row with one has its text. Rows that share the doc_id that
    stays are all kept, as are rows without id where no other row has their text. Empty documents give no rows.
    """
    found = _with_winners(cut(digests(docs)))
    return without(docs, cut(found.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*KEY)))
