"""Quality classifier: document evidence combined with site posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import KEY, cut, row_key, small, without
from lodestone.llm.simhash import fingerprint
from lodestone.session import in_arrow

#: Most labelled rows that the document classifier is fitted on: those with the least hash of their doc_id.
TRAIN_ROWS = 6000
#: Most bytes of their texts, which the driver collects; of more, those with the least hashes.
TRAIN_BYTES = 64_000_000
#: Most stems that each of the two heads looks for, and the least evidence (a log-likelihood ratio) of each.
MOST_STEMS, LEAST_G = 60, 40.0
#: The least evidence of a stem among documents that those before it have left.
LEAST_LEFT = 8.0
#: Stems are told apart by so many words that have them; hash buckets less one.
LEVELS, _BUCKETS = 3, 2**20 - 1
#: A document is rejected if the posterior probability of a bad one is above this.
REJECT = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_PUNCTUATION = frozenset(".,;:!?'\"()-")
N_DENSE = 9


def dense(text: str) -> list[float]:
    """Shares between 0 and 1 that tell prose from symbols, tables, shouting and repetition."""
    tokens = text.split()
    n, chars = max(1, len(tokens)), max(1, len(text))
    counts = Counter(tokens)
    symbols = sum(1 for t in tokens if not t[-1].isalnum() and t[-1] not in _PUNCTUATION)
    bars = counts.get("|", 0)
    shouted = sum(1 for t in tokens if len(t) > 1 and t.isupper())
    bangs = sum(1 for t in tokens if t.endswith("!!"))
    repeats = sum(1 for a, b in zip(tokens, tokens[1:], strict=False) if a == b)
    top = max(counts.values(), default=0)
    letters = sum(map(str.isalpha, text)) / chars
    return [symbols / n, bars / n, shouted / n, bangs / n, repeats / n, top / n if n > 20 else 0.0, len(counts) / n if n > 20 else 1.0, letters, float(n < 3)]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def stems(found: list[str]) -> np.ndarray:
    """Codes of the beginnings of words, of 3 to 8 letters: bucket * LEVELS + k for those that k + 1 words or more have."""
    codes = [zlib.crc32(w[:k].encode()) & _BUCKETS for w in found for k in range(3, min(8, len(w)) + 1)]
    ids, n = np.unique(np.array(codes, np.int32), return_counts=True)
    return np.concatenate([ids[n > k] * np.int32(LEVELS) + np.int32(k) for k in range(LEVELS)])


def _ratio(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> np.ndarray:
    """G of features that a of na bad and b of nb good documents have; 0 for those not more frequent among the bad."""
    p = (a + b) / (na + nb)
    g = np.zeros(len(a))
    with np.errstate(divide="ignore", invalid="ignore"):
        for seen, n in ((a, na), (b, nb)):
            g += np.where(seen > 0, seen * np.log(seen / (n * p)), 0) + np.where(n > seen, (n - seen) * np.log((n - seen) / (n * (1 - p))), 0)
    return np.where(a * nb > b * na, 2 * g, 0)


def choose_stems(texts: list[str], bad: np.ndarray) -> list[tuple[str, int]]:
    """(stem, words that begin with it) that mark bad documents, out of those with LEAST_G of evidence.

    First by sequential covering: the strongest one, then the strongest among bad documents that have none of those
    before. Then those that hardly any good document has, since each may be all that another document shows. Of equally
    strong stems the longest one.
    """
    size, n_bad, n_good = (_BUCKETS + 1) * LEVELS, int(bad.sum()), int((~bad).sum())
    with_it, without_it = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for t, y in zip(texts, bad, strict=True):  # stems are found again below, for bad texts only: all at once take memory
        (with_it if y else without_it)[stems(words(t))] += 1
    seen = np.flatnonzero(with_it)
    full = np.zeros(size)
    full[seen] = _ratio(with_it[seen].astype(float), n_bad, without_it[seen].astype(float), n_good)
    strong = full >= LEAST_G
    codes = {}
    for i in np.flatnonzero(bad):
        own = stems(words(texts[i]))
        codes[int(i)] = own[strong[own]]
    names: dict[int, Counter] = {}  # the text of what the codes stand for
    for i in np.flatnonzero(bad):
        for w in words(texts[i]):
            for k in range(3, min(8, len(w)) + 1):
                code = (zlib.crc32(w[:k].encode()) & _BUCKETS) * LEVELS
                for c in range(code, code + LEVELS):
                    if strong[c]:
                        names.setdefault(c, Counter())[w[:k]] += 1

    def named(candidates: np.ndarray) -> tuple[int, str]:
        found = [(names[c].most_common(1)[0][0], c) for c in candidates.tolist()]
        stem, c = max(found, key=lambda x: (len(x[0]), x[0], -x[1]))
        return c, stem

    left, chosen = list(codes), []
    while left and len(chosen) < MOST_STEMS:
        ids, seen = np.unique(np.concatenate([codes[i] for i in left]), return_counts=True)
        g = _ratio(seen.astype(float), len(left), without_it[ids].astype(float), n_good)
        if not len(ids) or g.max() < LEAST_LEFT:
            break
        code, stem = named(ids[g >= g.max() - 1e-9])
        chosen.append((stem, code % LEVELS + 1))
        left = [i for i in left if code not in codes[i]]
    pure = np.flatnonzero(strong & (without_it * n_bad <= 0.03 * with_it * n_good))
    pure = pure[pure % LEVELS == 0]
    for g in sorted(set(full[pure].tolist()), reverse=True):
        code, stem = named(pure[full[pure] == g])
        if len(chosen) < MOST_STEMS and not any(stem.startswith(s) or s.startswith(stem) for s, _ in chosen):
            chosen.append((stem, 1))
    return chosen


def distinct_rows(texts: list[str], bits: int = 14) -> list[int]:
    """Places of texts none of which is a near copy of one before: what copies share is no evidence."""
    fps, kept = np.array([fingerprint(t) for t in texts], np.uint64), []
    known = np.zeros(len(texts), np.uint64)
    for i, f in enumerate(fps):
        if not (np.bitwise_count(known[: len(kept)] ^ f) <= bits).any():
            known[len(kept)] = f
            kept.append(i)
    return kept


def presence(found: list[str], chosen: list[tuple[str, int]]) -> list[bool]:
    """For each stem whether so many words begin with it."""
    sizes = sorted({len(s) for s, _ in chosen})
    wanted = {k: {s for s, _ in chosen if len(s) == k} for k in sizes}
    n = Counter(w[:k] for k in sizes for w in found if w[:k] in wanted[k])
    return [n[s] >= least for s, least in chosen]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Weights, the last one the bias, by Newton's method with an L2 penalty that leaves the bias free."""
    x = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Classifier:
    """Two heads, for low quality and for toxic documents; each looks at the shares and at a few stems of words."""

    stems: list[list[tuple[str, int]]]
    weights: list[np.ndarray]

    def bad(self, text: str | None) -> float:
        """The probability that a document is of low quality or toxic."""
        text = text or ""
        base, found, good = dense(text), words(text), 1.0
        for chosen, w in zip(self.stems, self.weights, strict=True):
            x = np.array([*base, *presence(found, chosen), 1.0], float)
            good *= 1 / (1 + math.exp(max(-30.0, min(30.0, float(x @ w)))))
        return 1 - good


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Classifier:
    """The document classifier, fitted on the driver on at most ``train_rows`` labelled documents (doc_id, quality, toxic).

    Labels with a null count for neither head. Without labelled documents of both kinds a head says 0. Texts beyond
    TRAIN_BYTES in all are left out whole, those with the greatest hashes of their doc_id first.
    """
    chosen = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = chosen.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(train_rows)
    rows = docs.select(F.col("doc_id").alias("_d"), F.coalesce("text", F.lit("")).alias("_t")).join(F.broadcast(chosen), F.col("_d") == F.col("doc_id"))
    rows = cut(rows.select("h", "_d", "_t", "quality", "toxic").orderBy("h", "_d", "_t").limit(2 * train_rows))
    total, last = 0, None
    for h, n in sorted(tuple(r) for r in rows.select("h", F.octet_length("_t")).collect()):  # 2 * train_rows numbers at most
        total += n
        if total > TRAIN_BYTES and last is not None:
            rows = rows.where(F.col("h") <= last)
            break
        last = h
    rows = rows.select("_d", "_t", "quality", "toxic").collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    rows = [rows[i] for i in distinct_rows([r[1] for r in rows])]
    base = [dense(r[1]) for r in rows]
    heads, weights = [], []
    for of in (lambda r: None if r[2] is None else r[2] == 0, lambda r: None if r[3] is None else r[3] == 1):
        known = [i for i, r in enumerate(rows) if of(r) is not None]
        bad = np.array([of(rows[i]) for i in known], bool)
        if not bad.any() or bad.all():
            heads.append([])
            weights.append(np.r_[np.zeros(N_DENSE), -30.0])
            continue
        top = choose_stems([rows[i][1] for i in known], bad)
        heads.append(top)
        weights.append(logistic(np.array([[*base[i], *presence(words(rows[i][1]), top)] for i in known], float), bad.astype(float)))
    return Classifier(heads, weights)


def evidence(docs: DataFrame, classifier: Classifier, host: str = "source", path: str = "lang") -> DataFrame:
    """(key_id, key_1, key_2, doc_id, host, path, p): the document's own probability of being bad. Null hosts and paths
    are values of their own; the key is that of the row with its host and path."""
    kept = [*KEY, "doc_id", "host", "path"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                p = [classifier.bad(t) for t in part.column(len(kept)).to_pylist()]
                yield pa.record_batch([*(part.column(i) for i in range(len(kept))), pa.array(p, pa.float64())], [*kept, "p"])

    site = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (host, path)]
    return in_arrow(docs.select(*row_key(host, path), F.col("doc_id").cast("long"), *site, "text"), run, "key_id long, key_1 long, key_2 long, doc_id long, host string, path string, p double")


def posteriors(scored: DataFrame) -> DataFrame:
    """``scored`` (host, path, p and what else it has: computed once) with the rate of its site and the posterior ``q`` of
    a bad document.

    Sums by path, added up by host and in all, give the rates. Each level is a beta prior for the one below; its strength
    is estimated from the variance of the rates one level down (method of moments), so that sparse sites shrink to their
    host and sparse hosts to the corpus. A document's own evidence is left out of the rates of its sites. The log odds
    of the site's rate against the corpus's add to those of the document.
    """
    paths = cut(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("path_n"), F.sum("p").alias("path_s")))
    hosts = cut(paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s")))
    n, s = hosts.agg(F.sum("host_n"), F.sum("host_s")).first()
    rate = min(max((s or 0.0) / max(n or 0, 1), 1e-6), 1 - 1e-6)

    def strength(level: DataFrame, count: str, total: str) -> float:
        """Pseudo-counts of the prior: rates that vary no more than chance would have them make it strong."""
        k, spread, noise = level.agg(F.count(F.lit(1)), F.sum(F.col(count) * F.pow(F.col(total) / F.col(count) - rate, 2)) / F.sum(count), F.lit(rate * (1 - rate)) * F.count(F.lit(1)) / F.sum(count)).first()
        between = max((spread or 0.0) - (noise or 0.0), 0.0) if k > 1 else 0.0
        return min(max(rate * (1 - rate) / between - 1, 2.0), 1e6) if between else 1e6

    a, b = strength(hosts, "host_n", "host_s"), strength(paths, "path_n", "path_s")
    sites = paths.join(hosts, "host").select(F.col("host").alias("_h"), F.col("path").alias("_p"), "path_n", "path_s", "host_n", "host_s")
    sites = small(cut(sites))
    host = (F.col("host_s") - F.col("p") + a * rate) / (F.col("host_n") - 1 + a)
    site = (F.col("path_s") - F.col("p") + b * host) / (F.col("path_n") - 1 + b)
    odds = lambda x: F.log(F.greatest(F.least(x, F.lit(1 - 1e-9)), F.lit(1e-9)) / (1 - F.greatest(F.least(x, F.lit(1 - 1e-9)), F.lit(1e-9))))
    logit = odds(F.col("p")) + odds(site) - math.log(rate / (1 - rate))
    return scored.join(sites, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p"))).select(*scored.columns, site.alias("site_rate"), (1 / (1 + F.exp(-logit))).alias("q"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", reject: float = REJECT) -> DataFrame:
    """(doc_id, host, path, p, site_rate, q, kept) for each row of ``docs``; kept means q <= ``reject``.

    Null and empty texts are judged by their (empty) features; null hosts and paths are sites of their own; rows that
    repeat are all returned; extra columns are ignored. Empty documents give no rows; without labels all are kept.
    """
    return _classified(docs, labels, host, path, reject).select("doc_id", "host", "path", "p", "site_rate", "q", "kept")


def _classified(docs: DataFrame, labels: DataFrame, host: str, path: str, reject: float) -> DataFrame:
    return posteriors(cut(evidence(docs, fit(docs, labels), host, path))).withColumn("kept", F.col("q") <= reject)


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", reject: float = REJECT) -> DataFrame:
    """``docs``, with all its columns, without the rows that :func:`classify` rejects.

    Rows go by doc_id, text, host and path, so that rows that share a doc_id or have none are judged one by one; equal
    rows go or stay together; null and empty texts are judged by their features. Without labels all stay; empty documents
    give no rows.
    """
    found = _classified(docs, labels, host, path, reject)
    return without(docs, cut(found.where("not kept").select(*KEY).distinct()), host, path)
