"""Token counts as rollups that signed changes keep up to date, with idempotent batch commits."""

from __future__ import annotations

import re
import uuid

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import RANKS
from lodestone.llm.common import shared_dir, small, table
from lodestone.session import in_arrow

VERSION = "byte_bpe_50k"
KEYS = ["source", "lang", "tokenizer"]
_COUNTS = "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long"
_CHANGE = f"{_COUNTS}, gone boolean"
_STATE = f"{_COUNTS}, n_docs long"
_DELTA = "source string, lang string, tokenizer string, d_docs long, d_tokens long, d_chars long"
#: States lie in so many folders, by a hash of the document: a batch reads those only that its documents are in.
BUCKETS = 16
#: Batches since the last snapshot of all states that make the next commit write one.
SNAPSHOT = 16


def count_tokens(docs: DataFrame, tokenizer: str = VERSION, ranks_file: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens, n_chars) for each row of ``docs``; null texts count as empty."""
    path = ranks_file or public_tokenizers.path(RANKS)

    def run(batches):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        count = tiktoken.Encoding(tokenizer, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(3).to_pylist()
                yield pa.record_batch(
                    [*(part.column(i) for i in range(3)), pa.array([tokenizer] * len(texts)), pa.array([len(count(t)) for t in texts], pa.int64()), pa.array(map(len, texts), pa.int64())],
                    ["doc_id", "source", "lang", "tokenizer", "n_tokens", "n_chars"],
                )

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "source", "lang", F.coalesce("text", F.lit("")).alias("text")), run, _COUNTS)


class TokenRollup:
    """Totals by source, language and tokenizer version in a folder of batches.

    A batch is a table of changes: the newest counts of documents (inserted or revised), or ``gone``. Committing it
    writes its documents' new states, then its signed sums, each by one overwrite of that batch's own folder, which
    Spark's committer makes visible as a whole. A batch that is committed again, after a crash or by mistake, is
    computed from the batches before it and replaces itself, so totals stay the same. Batches are named in order;
    a batch may be committed anew only while it is the last one, and is a no-op if it is complete.

    The state of a document is all that the last batch with its id said of it: rows of a batch that share an id are added
    up, and take the place of what earlier batches said. Rows without id are never revised: each is counted for good.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/tables/rollup-{uuid.uuid4().hex}"

    def _folder(self, kind: str, batch: str) -> str:
        return f"{self.path}/{kind}/{batch}"

    def _done(self, kind: str) -> list[str]:
        """Names of the complete batches, in order: a listing of folders, not of rows."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(p.getName() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def batches(self) -> list[str]:
        return self._done("delta")

    def _history(self, before: str | None) -> list[tuple[str, str]]:
        """(kind, batch) of the folders of states that count before ``before``: the last snapshot, what came after it."""
        names = [b for b in self.batches() if before is None or b < before]
        start = max((s for s in self._done("snapshot") if s in names), default=None)
        return ([("snapshot", start)] if start else []) + [("state", b) for b in names if start is None or b > start]

    def states(self, before: str | None = None, touched: DataFrame | None = None) -> DataFrame:
        """The newest states (a row for each document, tokenizer, source and language) of the batches that come before
        ``before``, of all documents that have an id, or of those that are ``touched`` (doc_id, tokenizer: few, computed once)."""
        every = None
        buckets = None if touched is None else [r[0] for r in touched.select(_bucket()).distinct().collect()]  # BUCKETS at most
        for i, (kind, batch) in enumerate(self._history(before)):
            rows = self.spark.read.schema(f"{_STATE}, bucket int").parquet(self._folder(kind, batch))
            rows = (rows if buckets is None else rows.where(F.col("bucket").isin(*buckets))).drop("bucket").where("doc_id is not null").withColumn("batch", F.lit(i))
            every = rows if every is None else every.unionByName(rows)
        if every is None:
            return self.spark.createDataFrame([], _STATE)
        if touched is not None:
            ids = small(touched.select(F.col("doc_id").alias("_d"), F.col("tokenizer").alias("_t")))
            every = every.join(ids, (F.col("doc_id") == F.col("_d")) & (F.col("tokenizer") == F.col("_t")), "left_semi")
        each = F.struct("source", "lang", "n_tokens", "n_chars", "n_docs")
        last = every.groupBy("doc_id", "tokenizer", "batch").agg(F.collect_list(each).alias("s")).groupBy("doc_id", "tokenizer").agg(F.max_by("s", "batch").alias("s"))
        return last.select("doc_id", "tokenizer", F.inline("s")).where("n_docs > 0").select(*(f.split()[0] for f in _STATE.split(", ")))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Take in ``changes`` (the columns of :func:`count_tokens` and ``gone``); False if the batch is in already.

        Within a batch a change that is not ``gone`` outdoes one that is; a null ``gone`` is none. Deleting what is not
        there changes nothing, nor does deleting a null id. An empty batch is committed like any other. Only states of
        the batch's own documents are read again, from the folders that they are in.
        """
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"batch names are plain words, not {batch!r}")
        done = self.batches()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch!r} comes before {done[-1]!r}, which is committed")
        here = ~F.coalesce("gone", F.lit(False))
        total = lambda c: F.coalesce(F.sum(F.when(here, F.col(c))), F.lit(0).cast("long")).alias(c)
        new = changes.groupBy("doc_id", "tokenizer", "source", "lang").agg(total("n_tokens"), total("n_chars"), F.count_if(here).alias("n_docs"))
        state = self._folder("state", batch)
        _write_states(new, state)
        new = self.spark.read.schema(f"{_STATE}, bucket int").parquet(state).drop("bucket")
        sums = [F.sum(F.col("sign") * F.col(c)).alias(d) for c, d in (("n_docs", "d_docs"), ("n_tokens", "d_tokens"), ("n_chars", "d_chars"))]
        signed = new.withColumn("sign", F.lit(1))
        if done:
            touched = table(new.where("doc_id is not null").select("doc_id", "tokenizer").distinct())
            signed = signed.unionByName(self.states(batch, touched).withColumn("sign", F.lit(-1)))
        signed.groupBy(*KEYS).agg(*sums).write.mode("overwrite").parquet(self._folder("delta", batch))
        if len(self._history(None)) > SNAPSHOT:
            self.snapshot()
        return True

    def snapshot(self) -> None:
        """Writes all newest states as one folder, which stands for all batches so far. Doing it again changes nothing."""
        if done := self.batches():
            _write_states(self.states(), self._folder("snapshot", done[-1]))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_chars): the sum of all signed sums; keys without documents go."""
        folders = [self._folder("delta", b) for b in self.batches()]
        every = self.spark.read.schema(_DELTA).parquet(*folders) if folders else self.spark.createDataFrame([], _DELTA)
        out = every.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"), F.sum("d_chars").alias("n_chars"))
        return out.where("n_docs <> 0")


def _bucket() -> Column:
    """The folder of a document."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _write_states(rows: DataFrame, path: str) -> None:
    """States in folders by bucket, in files of the size that adaptive execution advises, whatever a bucket holds."""
    rows.withColumn("bucket", _bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def load(docs: DataFrame, tokenizer: str = VERSION, path: str | None = None) -> TokenRollup:
    """A rollup whose first batch inserts all of ``docs``."""
    rollup = TokenRollup(docs.sparkSession, path)
    rollup.commit("000000", count_tokens(docs, tokenizer).withColumn("gone", F.lit(False)))
    return rollup


def corpus_totals(docs: DataFrame, tokenizer: str = VERSION, path: str | None = None) -> DataFrame:
    """Totals of ``docs`` (doc_id, text, source, lang) by source, language and tokenizer, after the history of a corpus.

    All documents are inserted with no language yet, then revised to have theirs, then the short ones are withdrawn and
    inserted again; the last batch is committed once more. The totals are those of the documents as they are. Rows
    without id can't be revised, so they come with their language. Rows that share an id are added up; null texts count
    as empty; null sources and languages are keys of their own; an empty table gives no totals.
    """
    counts = table(count_tokens(docs, tokenizer))
    rollup = TokenRollup(docs.sparkSession, path)
    named = F.col("doc_id").isNotNull()
    here = lambda rows: rows.withColumn("gone", F.lit(False))
    rollup.commit("000000", here(counts.withColumn("lang", F.when(~named, F.col("lang")))))
    rollup.commit("000001", here(counts.where(named)))
    short = counts.where(named & (F.col("n_tokens") < 100)).select("doc_id", "tokenizer").distinct()
    short = table(counts.join(short, ["doc_id", "tokenizer"], "left_semi").select(*counts.columns))
    rollup.commit("000002", short.withColumn("gone", F.lit(True)))
    for _ in range(2):
        rollup.commit("000003", here(short))
    return rollup.totals()
