"""Line dedup within one edit by a deletion-neighbourhood join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, small, table, unused
from lodestone.session import in_arrow

#: Shorter lines, in characters without surrounding ASCII white space, are left alone.
MIN_CHARS = 10
BLANK = " \t\x0b\x0c\r"
#: The columns of a place, in their order.
PLACE = ["doc_id", "row", "line_no"]


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, line_no, line, h1, h2) for each line that is long enough: ``row`` tells texts of one doc_id, or of
    none, apart; two hashes name the text of a line."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))  # not once for each line
    rows = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    rows = rows.select("doc_id", "row", "line_no", F.trim("raw", F.lit(BLANK)).alias("line")).where((F.char_length("line") >= min_chars) & (F.col("line") != ""))
    return rows.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _halves(line: Column, n: Column) -> list[Column]:
    """Hashes of the first and last q characters, for q half of the length and half of one less: lines within one edit
    share one of them, since the edit touches one half only."""

    def ends(q):
        return [F.xxhash64(F.lit("<"), q, F.substring(line, F.lit(1), q)), F.xxhash64(F.lit(">"), q, F.substring(line, n - q + 1, q))]

    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return [*ends(half), *(F.when(less != half, k) for k in ends(less))]


def _mixed(chars: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A well mixed value of each character at its place; all arithmetic wraps."""
    x = chars * np.uint64(0x9E3779B97F4A7C15) + places * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of mixed values, of the whole line and of the line without the character at each place: sums of those
    before it, and of those after it at the place they move to."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    at, out = np.arange(len(c), dtype=np.uint64), []
    stay, move = _mixed(c, at), _mixed(c, at - np.uint64(1))
    for k in (np.uint64(1), np.uint64(0xD6E8FEB86659FD93)):
        one, two = (np.r_[np.uint64(0), np.cumsum((x ^ (x >> np.uint64(32))) * k if k > 1 else x)] for x in (stay, move))
        out.append(np.r_[one[-1], one[:-1] + (two[-1] - two[1:])])
    return out[0], out[1]


def _deletions(batches):
    """For each line its own hashes (at -1) and those of the line without the character at each place."""
    with np.errstate(over="ignore"):
        for b in batches:
            for doc, row, no, line in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                key, check = _sums(line)
                n = len(key)
                yield pa.record_batch(
                    [
                        *(pa.array(key.view(np.int64)), pa.array((check >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(np.arange(-1, n - 1, dtype=np.int32))),
                        *(pa.array([doc] * n, pa.int64()), pa.array(np.full(n, row, np.int64)), pa.array(np.full(n, no, np.int32))),
                    ],
                    ["key", "sum", "at", "doc_id", "row", "line_no"],
                )


def distinct_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, row, line_no, e1..e4): each distinct line with its earliest place and the hashes of its ends."""
    rows = _lines(docs, min_chars)
    ends = _halves(F.col("line"), F.char_length("line"))
    rows = rows.select("h1", "h2", F.struct(*PLACE).alias("place"), *(e.alias(f"e{i}") for i, e in enumerate(ends, 1)))
    first = rows.groupBy("h1", "h2").agg(F.min("place").alias("first"), *(F.min(f"e{i}").alias(f"e{i}") for i in range(1, 5)))
    return first.select("h1", "h2", *(f"first.{c}" for c in PLACE), *(f"e{i}" for i in range(1, 5)))


def _same_place(of: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(f"{of}doc_id")) & (F.col("row") == F.col(f"{of}row")) & (F.col("line_no") == F.col(f"{of}line_no"))


def later_lines(docs: DataFrame, lines: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row, line_no) of the earliest places of those distinct ``lines`` that are one edit away from an earlier line.

    Only lines that share an end with another one emit their deletion neighbourhood; none else can be within one edit.
    Lines that differ by a substitution are equal without the character at one and the same place, and a line that lacks
    one character is equal to the other without it. So the earliest of each group is an earlier neighbour of all, if
    there is one, and no pairs within a group are needed. Groups have one member for each place and character at most.
    Members of a group agree in 96 bits of two independent sums; the distance of the pairs that are found is verified.
    """
    ends = lines.select(*PLACE, F.explode(F.array_compact(F.array("e1", "e2", "e3", "e4"))).alias("e"))
    shared = cut(lines.select(F.explode(F.array_compact(F.array("e1", "e2", "e3", "e4"))).alias("e")).groupBy("e").count().where("count > 1").select("e"))
    close = cut(ends.join(small(shared), "e", "left_semi").select(*(F.col(c).alias(f"_{c}") for c in PLACE)).distinct())
    texts = cut(_lines(docs, min_chars).select(*PLACE, "line").join(small(close), _same_place("_"), "left_semi").distinct())
    rows = in_arrow(texts.select(F.col("doc_id").cast("long"), "row", "line_no", "line"), _deletions, "key long, sum int, at int, doc_id long, row long, line_no int")
    place = F.struct(*PLACE)
    key, spot = Window.partitionBy("key", "sum"), Window.partitionBy("key", "sum", "at")
    met = rows.select(
        place.alias("x"),
        F.when(F.col("at") >= 0, F.min(place).over(spot)).alias("substituted"),
        F.when(F.col("at") >= 0, F.min(F.when(F.col("at") < 0, place)).over(key)).otherwise(F.min(F.when(F.col("at") >= 0, place)).over(key)).alias("shifted"),
    )
    pairs = met.select("x", F.explode(F.array("substituted", "shifted")).alias("y")).where("y < x").distinct()
    named = texts.select(place.alias("place"), "line")
    both = pairs.join(named.select(F.col("place").alias("x"), F.col("line").alias("a")), "x").join(named.select(F.col("place").alias("y"), F.col("line").alias("b")), "y")
    return both.where(F.levenshtein("a", "b", 1) >= 0).select("x.*").distinct()


def kept_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row, kept): for each text that has any, the numbers of those long lines that stay, in order."""
    lines = table(distinct_lines(docs, min_chars))
    gone = small(cut(later_lines(docs, lines, min_chars).select(*(F.col(c).alias(f"_{c}") for c in PLACE))))
    stay = lines.select(*PLACE).join(gone, _same_place("_"), "left_anti")
    return stay.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list("line_no")).alias("kept"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` (doc_id, text and what else it has) with each line only at its earliest place: by doc_id, then, among
    texts that share it or have none, by a hash of the text, then by line number.

    A line goes if an equal line, or one within one edit (a character inserted, deleted or substituted), has an earlier
    place anywhere; lines are compared without ASCII white space around them. Blank lines and those under ``min_chars``
    characters stay, as do all rows: a text whose lines all go is empty, a null text stays null. Rows that repeat with
    their doc_id and text have the same places, so they keep the same lines; a null doc_id comes before all others.
    Columns pass, n_chars, if there is one, follows the text. An empty table gives no rows.
    """
    of = unused(docs, "_kept_")
    kept = kept_lines(docs, min_chars).select(*(F.col(c).alias(f"{of}{c}") for c in ("doc_id", "row", "kept")))
    joined = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(f"{of}doc_id")) & (F.xxhash64("text") == F.col(f"{of}row")), "left")
    numbers = F.col(f"{of}kept")
    # whether each line up to the last that is kept stays, as one list, so that a line is looked up in no time; it is
    # bound to a name by a transformation of one item, since an expression would be computed again for each line
    gap = lambda k, i: F.concat(F.array_repeat(F.lit(False), k - F.coalesce(F.get(numbers, i - 1), F.lit(-1)) - 1), F.array(F.lit(True)))
    flags = F.coalesce(F.flatten(F.transform(numbers, gap)), F.array().cast("array<boolean>"))
    free = lambda l: F.char_length(F.trim(l, F.lit(BLANK))) < max(min_chars, 1)
    stays = lambda f: F.filter(F.split("text", "\n", -1), lambda l, i: free(l) | F.coalesce(F.get(f, i), F.lit(False)))
    text = F.get(F.transform(F.array(flags), lambda f: F.array_join(stays(f), "\n")), F.lit(0))
    out = joined.withColumn("text", F.when(F.col("text").isNotNull(), text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_kept, text_sha256) of what :func:`dedup_lines` makes of each row; null counts as empty."""
    before = docs.select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    after = dedup_lines(before, min_chars)
    text = F.coalesce("text", F.lit(""))
    return after.select("doc_id", "n_lines", F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "\n", -1))).cast("long").alias("n_kept"), F.sha2(text, 256).alias("text_sha256"))
