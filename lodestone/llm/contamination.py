"""Benchmark decontamination by windows of words. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_BYTES, KEY, ascii_lower, cut, in_memory_bytes, row_key, small, table, without

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Most bytes of the windows of the benchmark that one pass over the documents broadcasts: more windows take more passes.
PASS_BYTES = BROADCAST_BYTES
#: Fixed value of the contract: all that is not part of a word.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words; null and blank texts have none."""
    return F.array_remove(F.split(ascii_lower(text), NO_WORD), "")


def _hashed(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``rows`` (with words w) and, for each size, a column r<size> with a hash for each run of so many words, by its
    first word. Hashes of runs of 2, 4 and 8 words are made of two halves, those of other sizes of such runs."""
    rows = rows.withColumn("x1", F.expr("transform(w, x -> xxhash64(x))"))
    step = 1
    while 2 * step <= max(sizes, default=0):
        rows = rows.withColumn(f"x{2 * step}", F.expr(f"transform(x{step}, (x, i) -> xxhash64(x, get(x{step}, i + {step})))"))
        step *= 2
    for size in sizes:
        first = step
        while first > size:
            first //= 2
        at, parts = first, []
        while at < size:
            width = 1
            while 2 * width <= size - at:
                width *= 2
            parts.append(f"get(x{width}, i + {at})")
            at += width
        whole = f"transform(x{first}, (x, i) -> xxhash64({', '.join(['x', *parts])}))" if parts else f"x{first}"
        rows = rows.withColumn(f"r{size}", F.expr(f"if(size(w) >= {size}, slice({whole}, 1, greatest(size(w) - {size - 1}, 1)), cast(array() as array<bigint>))"))
    return rows.drop(*(f"x{2**k}" for k in range(12)))


def windows(benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(hash, len, sha, window), a row for each distinct window of ``benchmark`` (item_id, text), and (window, item), its
    items; both computed once. All columns but the item have a fixed width: the words of a window are not kept.

    An item of fewer words, but not none, is one window. Items without id, text or words are ignored.
    """
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(size)))
    items = items.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)))
    sizes = list(range(1, size + 1))
    hashes = _hashed(items.select("item", "len", F.slice("w", F.col("i"), F.col("len")).alias("w")), sizes)
    own = F.coalesce(*(F.when(F.col("len") == k, F.get(f"r{k}", F.lit(0))) for k in sizes))
    each = cut(hashes.select("item", "len", own.alias("hash"), _sha(F.col("w")).alias("sha")).distinct())
    distinct = cut(each.select("hash", "len", "sha").distinct().withColumn("window", F.monotonically_increasing_id()))
    return distinct, cut(each.join(distinct, ["hash", "len", "sha"]).select("window", "item"))


def _sha(words: Column) -> Column:
    """32 bytes that verify a run of words; words hold no spaces."""
    return F.unhex(F.sha2(F.array_join(words, " "), 256))


def hits(docs: DataFrame, found: DataFrame, rows: bool = False) -> DataFrame:
    """(key_id, key_1, key_2, doc_id, n, pos, len, window), computed once: each occurrence of a window (``found``, of
    :func:`windows`) in a row of ``docs`` of n words; with ``rows`` also one of length 0 for each row of ``docs``.

    The windows are broadcast, in as many parts and passes over the documents as their bytes need, so that documents are
    never shuffled. Hashes of all runs of words are exploded, probed and verified within one stage: only hits leave it.
    """
    lens = sorted((r[0] for r in found.select("len").distinct().collect()), reverse=True)  # 13 values at most
    split = _hashed(docs.select(*row_key(), "doc_id", words_of(F.col("text")).alias("w")), lens)
    # the empty run, which the empty window hits, is the first; an inner generator would have Spark compute all runs once
    # more, for a filter of rows without any
    runs = split.select(*KEY, "doc_id", "w", F.size("w").alias("n"), F.concat(F.array(F.lit(0).cast("long")), *(f"r{k}" for k in lens)).alias("runs"))
    each = runs.select(*KEY, "doc_id", "w", "n", F.posexplode_outer("runs").alias("at", "run"))
    first, base = F.lit(0), F.lit(1)  # of the runs of the window's length
    for k in lens:
        first = F.when(F.col("len") == k, base).otherwise(first)
        base = base + F.greatest(F.col("n") - (k - 1), F.lit(0))
    same = (F.col("len") > 0) & (_sha(F.slice("w", F.greatest(F.col("pos"), F.lit(0)) + 1, F.col("len"))) == F.col("sha"))
    empty = found.sparkSession.range(1).selectExpr("0L AS hash", "0 AS len", "cast(null AS binary) AS sha", "-1L AS window")
    passes = max(1, -(-in_memory_bytes(found) // PASS_BYTES))
    out = None
    for i in range(passes):
        part = found if passes == 1 else found.where(F.pmod("hash", F.lit(passes)) == i)
        part = part.unionByName(empty) if rows and i == 0 else part
        met = each.join(F.broadcast(part), F.col("run") == F.col("hash")).withColumn("pos", F.col("at") - first)
        met = table(met.where((F.col("pos") >= 0) & (same | ((F.col("len") == 0) & (F.col("at") == 0)))).select(*KEY, "doc_id", "n", "pos", "len", "window"))
        out = met if out is None else out.union(met)
    return out


def _hit_words(found: DataFrame) -> DataFrame:
    """(KEY, doc_id, n, n_hit) of rows with hits: the union of the spans of each, in order."""
    spans = found.groupBy(*KEY, "doc_id", "n").agg(F.sort_array(F.collect_set(F.struct("pos", "len"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda a, s: F.struct(F.greatest(a["end"], s["pos"] + s["len"]).alias("end"), (a["hit"] + F.greatest(s["pos"] + s["len"] - F.greatest(a["end"], s["pos"]), F.lit(0))).alias("hit")),
    )["hit"]
    return spans.select(*KEY, "doc_id", "n", covered.cast("long").alias("n_hit"))


def _contaminated(n_hit: Column, n: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= n)


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated), one row for each row of ``docs``, equal rows too; extra
    columns are ignored.

    A word inside any occurrence of a window is hit; a document is contaminated if it has a hit and 20 n_hit >= n_words.
    Null and blank texts have no words and no hits; a null doc_id is returned as it is. Rows that share a doc_id, or have
    none, are judged by their own texts. An empty benchmark hits nothing; empty documents give no rows.

    Hits are grouped by row, then distinct pairs of row and item; what is found goes back to the rows by their key, as a
    broadcast if it is small.
    """
    found, of = windows(benchmark, size)
    met = hits(docs, found, rows=True)
    real = met.where("len > 0")
    items = real.select(*KEY, "window").distinct().join(small(of), "window").select(*KEY, "item").distinct()
    items = items.groupBy(*(F.col(k).alias(f"_{k}") for k in KEY)).agg(F.array_sort(F.collect_list("item")).alias("items"))
    same = F.lit(True)
    for k in KEY:
        same = same & (F.col(k) == F.col(f"_{k}"))
    judged = _hit_words(real).join(items, same).select(*(F.col(k).alias(f"_{k}") for k in KEY), "n_hit", "items")
    out = met.where("len = 0").select(*KEY, "doc_id", F.col("n").cast("long").alias("n_words")).join(small(cut(judged)), same, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), _contaminated(n_hit, F.col("n_words")).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs``, with all its columns, without the rows that :func:`scan` calls contaminated.

    Rows are judged one by one, those that share a doc_id or have none too; null and blank texts stay; equal rows go or
    stay together. An empty benchmark drops nothing; empty documents give no rows.
    """
    met = hits(docs, windows(benchmark, size)[0])
    return without(docs, cut(_hit_words(met).where(_contaminated(F.col("n_hit"), F.col("n"))).select(*KEY)))
