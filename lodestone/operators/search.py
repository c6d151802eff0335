"""Search over catalogs: filter, score, dedup, rank; similar and alternative packages; selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import dims, text
from lodestone.session import durable

#: Similarity from which packages are duplicates, alternatives, one group.
DUPLICATE, ALTERNATIVE, GROUP = 0.9, 0.5, 0.6


def substring_search(rows: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows of which a column contains ``query``, whatever its case; the first of each name by ``seq``."""
    q = query.lower()
    hit = F.lit(False)
    for c in columns or ("name", "description"):
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q)), F.lit(False))
    first = Window.partitionBy("name").orderBy("seq")
    return rows.where(hit).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def by_confidence(rows: DataFrame, least: float = 0.3) -> DataFrame:
    return rows.where(F.col("score") >= least)


def found(rows: DataFrame, query: str, providers: list[str] | None = None, least: float = 0.3, most: int = 20) -> DataFrame:
    """A whole search: what matches, by confidence, without repeats, ranked, of the given providers, the first ``most``."""
    out = dedup(by_confidence(substring_search(rows, query), least))
    return ranked(out.where(F.col("provider").isin(*providers)) if providers else out, query, most)


def dedup(rows: DataFrame) -> DataFrame:
    """Of each normalized name the best row: by score, provider weight, shorter name, name, then seq.

    The best is found as a minimum, which is combined before the shuffle: a name that a third of all rows has is no
    partition of its own.
    """
    keep = [c for c in rows.columns if c != "_norm"]
    order = F.struct((-F.col("score")).alias("a"), (-dims.lookup(F.lower("provider"), "SEARCH_WEIGHT")).alias("b"), F.char_length("name").alias("c"), F.lower("name").alias("d"), F.col("seq").alias("e"))
    best = rows.groupBy(text.normalized_name(F.col("name")).alias("_norm")).agg(F.min(F.struct(order.alias("o"), F.struct(*keep).alias("row"))).alias("m"))
    return best.select("m.row.*")


def relevance(query: str) -> Column:
    q, name = query.lower(), F.lower("name")
    score = 0.4 * F.col("score") + F.when(name == q, 0.3).otherwise(0.0) + F.when(F.startswith(name, F.lit(q)), 0.2).otherwise(0.0)
    score = score + 0.1 * dims.lookup(F.lower("provider"), "SEARCH_WEIGHT") + F.when(F.coalesce(F.contains(F.lower("description"), F.lit(q)), F.lit(False)), 0.1).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def ranked(rows: DataFrame, query: str, most: int | None = None) -> DataFrame:
    """Rows with their relevance, best first; the first ``most`` of them if given (a top-k, not a sort of all)."""
    out = rows.withColumn("relevance", F.round(relevance(query), 6)).orderBy(F.desc("relevance"), F.lower("name"), "seq")
    return out.limit(most) if most else out


def diversity(rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.agg(F.round(F.coalesce((F.countDistinct("provider") / n + F.countDistinct(text.normalized_name(F.col("name"))) / n) / 2, F.lit(0.0)), 6).alias("diversity"))


def package_similarity(a: str, b: str) -> Column:
    """0.6 name, 0.3 description if both have one, 0.1 provider, of two structs ``a`` and ``b``."""
    c = lambda s, f: F.col(f"{s}.{f}")
    described = text.truthy(c(a, "description")) & text.truthy(c(b, "description"))
    desc = F.when(described, text.similarity(c(a, "description"), c(b, "description"))).otherwise(0.0)
    return F.least(0.6 * text.similarity(c(a, "name"), c(b, "name")) + 0.3 * desc + F.when(c(a, "provider") == c(b, "provider"), 0.1).otherwise(0.03), F.lit(1.0))


def find_matches(rows: DataFrame, query: str, least: float = 0.3, most: int | None = 20) -> DataFrame:
    """Names that are similar to ``query``, most similar first; distinct names are scored once."""
    names = rows.groupBy("name").agg(F.min("seq").alias("seq"))
    scored = names.withColumn("similarity", F.round(text.similarity(F.lit(query), F.col("name")), 6)).where(F.col("similarity") >= least)
    out = scored.orderBy(F.desc("similarity"), "seq")
    return out.limit(most) if most else out


def _packages(rows: DataFrame) -> DataFrame:
    """(name, provider, seq, description): each package once, as its first row has it."""
    return rows.groupBy("name", "provider").agg(F.min(F.struct("seq", "description")).alias("m")).select("name", "provider", "m.*")


def _most_alike(a: Column, b: Column) -> Column:
    """The most that the similarity of two texts can be: the sequence ratio as their lengths bound it, the rest as it is."""
    d, e = text.trimmed(F.lower(a)), text.trimmed(F.lower(b))
    m, k = F.char_length(d), F.char_length(e)
    words = text.jaccard(F.array_distinct(text.words(d)), F.array_distinct(text.words(e)))
    most = 0.8 * F.least(m, k) / (m + k) + F.when(F.contains(e, d), 0.3 * m / k).otherwise(0.0) + 0.2 * words + 0.1 * text.common_prefix(d, e) / F.greatest(m, k)
    return F.when(d == e, 1.0).otherwise(F.coalesce(most, F.lit(0.0)))


def alternatives(rows: DataFrame, name: str, provider: str | None = None, least: float = ALTERNATIVE) -> DataFrame:
    """(name, provider, seq, similarity): packages that are like the first one of that ``name`` (and ``provider``), by
    :func:`package_similarity`, most similar first. Descriptions are compared only where the rest can reach ``least``."""
    p = _packages(rows).select(F.struct("name", "provider", "seq", "description").alias("b"))
    of = (F.col("name") == name) & ((F.col("provider") == provider) if provider is not None else F.lit(True))
    t = rows.where(of).agg(F.min_by(F.struct("name", "provider", "description"), "seq").alias("a")).where("a is not null")
    other = p.crossJoin(F.broadcast(t)).where(~(F.col("a.name").eqNullSafe(F.col("b.name")) & F.col("a.provider").eqNullSafe(F.col("b.provider"))))
    rest = 0.6 * text.similarity(F.col("a.name"), F.col("b.name")) + F.when(F.col("a.provider") == F.col("b.provider"), 0.1).otherwise(0.03)
    able = other.where(rest + 0.3 * _most_alike(F.col("a.description"), F.col("b.description")) >= least - 1e-6)
    scored = able.select("b.name", "b.provider", "b.seq", F.round(package_similarity("a", "b"), 6).alias("similarity"))
    return scored.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "seq")


def duplicates(rows: DataFrame) -> DataFrame:
    """(name, provider, first_name, first_provider, similarity): each distinct package that has an earlier one of at
    least DUPLICATE by :func:`package_similarity`, with the first such.

    What is left out before scores cannot reach it: with like descriptions and one provider 0.9 needs a name similarity
    of 5/6, and names that differ have 0.8 at most unless they share a word (what white space separates) and the earlier
    one is contained in the later one. So names meet by their words, and packages by such names.
    """
    p = _packages(rows)
    n = p.select("name").where(text.truthy(F.col("name"))).distinct().withColumn("low", text.trimmed(F.lower("name")))
    n = n.withColumn("k", F.explode(F.array_union(text.words(F.col("low")), F.array("low"))))
    a, b = n.select("k", F.col("name").alias("x"), F.col("low").alias("lx")), n.select("k", F.col("name").alias("y"), F.col("low").alias("ly"))
    names = a.join(b, "k").where(F.contains("ly", F.col("lx"))).select("x", "y").distinct()
    names = names.withColumn("s", text.similarity(F.col("x"), F.col("y"))).where(F.col("s") >= (DUPLICATE - 0.4) / 0.6 - 1e-6)
    one = lambda c: p.select(F.col("name").alias("_" + c), F.struct("name", "provider", "seq", "description").alias(c))
    met = names.join(one("a"), F.col("x") == F.col("_a")).join(one("b"), F.col("y") == F.col("_b")).where("a.seq < b.seq")
    rest = 0.6 * F.col("s") + F.when(F.col("a.provider") == F.col("b.provider"), 0.1).otherwise(0.03)
    able = met.where(rest + 0.3 * _most_alike(F.col("a.description"), F.col("b.description")) >= DUPLICATE - 1e-6)
    scored = able.select("a", "b", F.round(package_similarity("a", "b"), 6).alias("similarity")).where(F.col("similarity") >= DUPLICATE)
    first = scored.groupBy("b.name", "b.provider").agg(F.min(F.struct("a.seq", "a.name", "a.provider", "similarity")).alias("m"))
    return first.select("name", "provider", F.col("m.name").alias("first_name"), F.col("m.provider").alias("first_provider"), "m.similarity")


#: What packages are compared by: those that share all of it are one kind.
KIND = ["name", "provider", "description"]


def _scored(pairs: DataFrame, to: str) -> DataFrame:
    """Distinct ``pairs`` of texts (x, y) with their similarity as ``to``. They are short and slow to score: all shuffle
    partitions get some."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select("x", "y").repartition(n, "x", "y").withColumn(to, text.similarity(F.col("x"), F.col("y")))


def _pairs(kinds: DataFrame, key: str, least: float) -> DataFrame:
    """(key, a, b) of the ``kinds`` (by the first seq of each) of one ``key`` of which a package a is similar by ``least`` or
    more to one b behind it: a comes before b, or b is ``alone`` and goes on after a.

    Names and descriptions that occur together are scored once, descriptions only where the rest can reach ``least``.
    """
    n = kinds.select(key, "name").where(text.truthy(F.col("name"))).distinct()
    x, y = n.select(F.col(key).alias("_a"), F.col("name").alias("x")), n.select(F.col(key).alias("_b"), F.col("name").alias("y"))
    names = x.join(y, F.col("_a") == F.col("_b")).select("x", "y").distinct()
    names = _scored(names, "s")
    one = lambda c: kinds.select(F.col(key).alias(f"_{c}"), F.struct("seq", "alone", *KIND).alias(c))
    met = one("a").join(one("b"), F.col("_a") == F.col("_b")).where("a.seq < b.seq OR (b.alone AND a.seq > b.seq)")
    met = met.join(names, (F.col("a.name") == F.col("x")) & (F.col("b.name") == F.col("y")), "left")
    s, provider = F.coalesce("s", F.lit(0.0)), F.when(F.col("a.provider") == F.col("b.provider"), 0.1).otherwise(0.03)
    met = met.select(F.col("_a").alias(key), "a", "b", s.alias("s"), provider.alias("p"))
    texts = met.groupBy(F.col("a.description").alias("x"), F.col("b.description").alias("y")).agg(F.max(0.6 * F.col("s") + F.col("p")).alias("rest"))
    texts = _scored(texts.where(F.col("rest") + 0.3 * _most_alike(F.col("x"), F.col("y")) >= least - 1e-6), "d")
    scored = met.join(texts, F.col("a.description").eqNullSafe(F.col("x")) & F.col("b.description").eqNullSafe(F.col("y")))
    scored = scored.where(F.round(F.least(0.6 * F.col("s") + 0.3 * F.col("d") + F.col("p"), F.lit(1.0)), 6) >= least)
    return scored.select(key, F.col("a.seq").alias("a"), F.col("b.seq").alias("b"))


def similar_groups(rows: DataFrame, key: str = "software", least: float = GROUP) -> DataFrame:
    """(key, seq, seed): the packages of each ``key`` (results of one search) around seeds: in order of seq, a package that
    no earlier seed is similar to is a seed itself and takes all later ones that are similar and not taken.

    Packages of one kind, with the same name, provider and description, are compared once: they are similar to the same
    seeds, so what takes the first of them takes all. Only a kind that isn't similar to itself (``alone``: it has no name,
    say) goes on with seeds of its own until a seed behind its first package takes the rest. What is similar is found by
    joins; which are seeds follows from kind to kind, so the similar pairs of kinds of one key, numbers only, are gone
    through in one task.
    """
    has = lambda c: F.when(text.truthy(F.col(c)), 1.0).otherwise(0.0)
    own = F.least(0.6 * has("name") + 0.3 * has("description") + F.when(F.col("provider").isNotNull(), 0.1).otherwise(0.03), F.lit(1.0))
    kinds = rows.groupBy(key, *KIND).agg(F.min(F.col("seq").cast("long")).alias("seq")).withColumn("alone", F.round(own, 6) < least)
    placed = kinds.where("seq is not null")
    nodes = placed.select(key, F.col("seq").alias("b"), F.lit(None).cast("long").alias("a"), "alone")
    edges = nodes.unionByName(_pairs(placed, key, least).select(key, "b", "a", F.lit(False).alias("alone")))

    def seeds(g: pd.DataFrame) -> pd.DataFrame:
        others: dict[int, list[int]] = {}
        for b, a in zip(g["b"], g["a"], strict=True):
            own = others.setdefault(int(b), [])
            if not pd.isna(a):
                own.append(int(a))
        seed: dict[int, int] = {}
        for b in sorted(others):
            seed[b] = min((a for a in others[b] if a < b and seed[a] == a), default=b)
        alone = {int(b) for b in g["b"][g["alone"]] if seed[int(b)] == b}
        until = [min((a for a in others[b] if a > b and seed[a] == a), default=None) if b in alone else None for b in seed]
        out = pd.DataFrame({"_first": list(seed), "_seed": list(seed.values()), "_alone": [b in alone for b in seed], "_until": pd.array(until, dtype="Int64")})
        return out.assign(_k=[None if pd.isna(k := g[key].iloc[0]) else k] * len(seed))

    found = edges.groupBy(key).applyInPandas(seeds, f"_first long, _seed long, _alone boolean, _until long, _k {rows.schema[key].dataType.simpleString()}")
    of = kinds.join(found, F.col(key).eqNullSafe(F.col("_k")) & (F.col("seq") == F.col("_first"))).select(*(F.col(c).alias(f"_{c}") for c in (key, *KIND)), "_seed", "_alone", "_until")
    same = F.lit(True)
    for c in (key, *KIND):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    seq = F.col("seq").cast("long")
    seed = F.when(~F.col("_alone"), F.col("_seed")).when(seq > F.col("_until"), F.col("_until")).otherwise(seq)
    each = rows.join(of, same, "left").select(key, seq.alias("seq"), F.when(F.col(key).isNull(), seq).otherwise(seed).alias("seed"))
    return each.groupBy(key, "seq").agg(F.min("seed").alias("seed"))


def _in_order(g: pd.DataFrame) -> pd.DataFrame:
    """Of one group (seq, m: digest of a description) for each two descriptions, or one, how many pairs of packages have x
    before y."""
    codes, names = pd.factorize(g["m"])
    seq, names = g["seq"].to_numpy(np.int64), names.to_numpy(object)
    order = np.lexsort((seq, codes))
    ends, out = np.cumsum(np.bincount(codes, minlength=len(names))), []
    for y, (start, end) in enumerate(zip(np.r_[0, ends[:-1]], ends, strict=True)):
        own = seq[order[start:end]]
        n = np.bincount(codes, end - start - np.searchsorted(own, seq, "right"), len(names)).astype(np.int64)
        x = np.flatnonzero(n)
        out.append((x, np.full(len(x), y), n[x]))
    x, y, n = (np.concatenate(v) for v in zip(*out, strict=True))
    group = g["group"].iloc[0]
    return pd.DataFrame({"k": [group["k"]] * len(x), "seed": group["seed"], "x": names[x], "y": names[y], "n": n})


def compared(rows: DataFrame, key: str = "software", least: float = GROUP) -> DataFrame:
    """(key, seed, n, canonical_name, primary, score, reason, same_name, same_version, similar_descriptions, providers) of
    each group of :func:`similar_groups` with several packages: its best package (by seq) with a recommendation, its
    name at the most popular provider, and what its packages share; descriptions do if their mean similarity, in pairs, is
    over 0.8. Two descriptions are scored once in each order and count as often as packages have them in that order."""
    groups = durable(similar_groups(rows, key, least)).select(F.col(key).alias("_k"), F.col("seq").alias("_q"), "seed")
    r = rows.join(groups, (F.col(key) == F.col("_k")) & (F.col("seq") == F.col("_q"))).withColumn("group", F.struct(F.col(key).alias("k"), "seed"))
    order = F.struct(F.round(selection_score(), 9).alias("s"), (-F.col("seq")).alias("o"))
    score, reason = recommendation()
    pop = F.struct(dims.lookup(F.col("provider"), "POPULARITY", 0).alias("p"), (-F.col("seq")).alias("o"))
    version = F.nullif("version", F.lit(""))
    best = r.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("name", pop).alias("canonical_name"), F.max_by(F.struct(F.col("seq").alias("primary"), score.alias("score"), reason.alias("reason")), order).alias("best"),
        (F.countDistinct("name") == 1).alias("same_name"), F.when(F.countDistinct(version) == 1, F.min(version)).alias("same_version"), F.array_sort(F.collect_set("provider")).alias("providers"),
    ).where("n > 1")
    said = r.where(text.truthy(F.col("description"))).select("group", "seq", "description", F.md5("description").alias("m"))
    counts = durable(said.groupBy("group").applyInPandas(_in_order, said.select("group.*", F.lit("").alias("x"), F.lit("").alias("y"), F.lit(0).cast("long").alias("n")).schema))
    one = lambda c: rows.where(text.truthy(F.col("description"))).groupBy(F.md5("description").alias(f"m{c}")).agg(F.min("description").alias(c))
    met = counts.join(one("a"), F.col("x") == F.col("ma")).join(one("b"), F.col("y") == F.col("mb")).select(F.struct("k", "seed").alias("g"), F.col("a").alias("x"), F.col("b").alias("y"), "n")
    mean = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    bound = met.groupBy("g").agg(mean(_most_alike(F.col("x"), F.col("y"))).alias("most")).where(F.col("most") > 0.8 - 1e-6).select(F.col("g").alias("able"))
    able = met.join(bound, F.col("g") == F.col("able"), "left_semi")
    texts = _scored(able.select("x", "y").distinct(), "d").select(F.col("x").alias("_x"), F.col("y").alias("_y"), "d")
    alike = able.join(texts, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))).groupBy(F.col("g").alias("ga")).agg(mean(F.col("d")).alias("mean"))
    out = best.join(alike, F.col("group") == F.col("ga"), "left")
    return out.select(F.col("group.k").alias(key), "group.seed", "n", "canonical_name", "best.primary", "best.score", "best.reason", "same_name", "same_version", F.coalesce(F.col("mean") > 0.8, F.lit(False)).alias("similar_descriptions"), "providers")


def selection_score() -> Column:
    length = F.least(F.coalesce(F.char_length("description"), F.lit(0)) / 100, F.lit(1.0))
    return 0.3 * dims.lookup(F.col("provider"), "POPULARITY", 1) / 10 + 0.2 * length + F.when(text.truthy(F.col("version")), 0.2).otherwise(0.0) + 0.3 * F.col("score")


def select_best(rows: DataFrame, key: str = "software") -> DataFrame:
    """The best package of each ``key`` by popularity, description, version and score; the first on ties."""
    order = F.struct(F.round(selection_score(), 9).alias("s"), (-F.col("seq")).alias("o"))
    return rows.groupBy(key).agg(F.max(F.struct(order.alias("k"), F.struct("provider", "name", F.round(selection_score(), 6).alias("selection")).alias("row"))).alias("m")).select(key, "m.row.*")


def canonical_name(rows: DataFrame, key: str = "software") -> DataFrame:
    pop = dims.lookup(F.col("provider"), "POPULARITY", 0)
    return rows.groupBy(key).agg(F.max_by("name", F.struct(pop.alias("p"), (-F.col("seq")).alias("o"))).alias("canonical_name"))


def recommendation() -> tuple[Column, Column]:
    """Score and reason of a package."""
    popular, long = F.col("provider").isin("apt", "brew", "winget", "npm", "pypi"), F.char_length("description") >= 20
    version = text.truthy(F.col("version"))
    score = 0.8 + F.when(popular, 0.1).otherwise(0.0) + F.when(version, 0.05).otherwise(0.0) + F.when(F.coalesce(long, F.lit(False)), 0.05).otherwise(0.0)
    reason = F.concat_ws("; ", F.when(popular, F.lit("popular provider")), F.when(version, F.lit("has version")), F.when(long, F.lit("described")))
    return F.round(score, 6), reason
