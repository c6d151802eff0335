"""Instruction datasets: strata, balance, split, labels, augmentation. Chance is md5(id#seed): the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def chance(seed: int = SEED, salt: str = "") -> Column:
    return F.md5(F.concat(F.col("id").cast("string"), F.lit(f"#{seed}{salt}")))


def stratum(by: str = "category") -> Column:
    """What a row is grouped by: its category, else its template; its template; a bucket of its confidence; or nothing."""
    c = F.col("confidence")
    buckets = F.when(c.isNull(), "no_confidence").when(c >= 0.8, "high_confidence").when(c >= 0.5, "medium_confidence").otherwise("low_confidence") if by == "confidence" else None
    kinds = {"category": F.coalesce("category", "template", F.lit("unknown")), "template": F.coalesce("template", F.lit("unknown")), "confidence": buckets, "default": F.lit("default")}
    if by not in kinds:
        raise ValueError(f"unknown field {by!r}")
    return kinds[by]


def good_sample() -> Column:
    """Instruction, input and output are long enough and hold no placeholder."""
    n = lambda c: F.char_length(F.trim(c))
    return (n("instruction") >= 10) & (n("input") >= 5) & (n("output") >= 10) & ~F.concat_ws(" ", "instruction", "input", "output").rlike(r"(?i)TODO|FIXME|\[PLACEHOLDER\]|TBD")


def filter_quality(rows: DataFrame, least: float = 0.5, labels: list[str] | None = None, label: str = "quality_label") -> DataFrame:
    """Good samples; a confidence or a label is judged only where there is one."""
    kept = rows.where(F.coalesce(F.col("confidence") >= least, F.lit(True)) & good_sample())
    return kept.where(F.coalesce(F.col(label).isin(*labels), F.lit(True))) if labels else kept


def confidence_label() -> Column:
    c = F.col("confidence")
    return F.when(c.isNull(), "unknown").when(c >= 0.8, "high_quality").when(c >= 0.6, "medium_quality").when(c >= 0.4, "low_quality").otherwise("poor_quality")


def heuristic_label() -> Column:
    n = lambda c, k: (F.char_length(F.trim(c)) > k).cast("int")
    has = lambda c, words: F.lower(c).rlike(words).cast("int")
    points = n("instruction", 20) + has("instruction", "generate|create|enhance|categorize") + n("input", 10) + has("input", "software|package") + n("output", 20) + has("output", "version:|packages:|description:")
    return F.when(points >= 5, "high_quality").when(points >= 3, "medium_quality").when(points >= 2, "low_quality").otherwise("poor_quality")


def strata_sizes(rows: DataFrame, by: str = "category") -> DataFrame:
    return rows.groupBy(stratum(by).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def statistics(rows: DataFrame) -> DataFrame:
    """(dimension, value, n, mean_confidence): all rows, and by stratum, template and label of quality, in one pass."""
    q = rows.select(stratum().alias("category"), F.col("template"), confidence_label().alias("quality"), "confidence")
    sets = q.groupingSets([[], ["category"], ["template"], ["quality"]], "category", "template", "quality")
    of = F.grouping_id()
    out = sets.agg(of.alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 5).alias("mean_confidence"))
    # a bit for each column that a set leaves out
    names = {0b111: ("all", F.lit("all")), 0b011: ("category", F.col("category")), 0b101: ("template", F.col("template")), 0b110: ("quality", F.col("quality"))}
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for g, (name, c) in names.items():
        dimension, value = F.when(F.col("g") == g, name).otherwise(dimension), F.when(F.col("g") == g, c).otherwise(value)
    return out.select(dimension.alias("dimension"), value.alias("value"), "n", "mean_confidence").where("value is not null")


def _position(rows: DataFrame, key: Column) -> DataFrame:
    """Rank of each row within its stratum, and the stratum's size.

    No stratum is one window: rows are counted by the first two digits of their chance, and ranked within those."""
    r = rows.withColumn("stratum", stratum()).withColumn("_k", key).withColumn("_bin", F.substring("_k", 1, 3))
    bins = r.groupBy("stratum", "_bin").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy("stratum").orderBy("_bin")
    before = bins.select(F.col("stratum").alias("_s"), F.col("_bin").alias("_b"), (F.sum("_c").over(run) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy("stratum")).alias("n_stratum"))
    inside = F.row_number().over(Window.partitionBy("stratum", "_bin").orderBy("_k", "id"))
    ranked = r.withColumn("_r", inside)
    return ranked.join(before, (F.col("stratum") == F.col("_s")) & (F.col("_bin") == F.col("_b"))).withColumn("rank", F.col("_before") + F.col("_r")).drop("_s", "_b", "_k", "_bin", "_before", "_r")


def split(rows: DataFrame, train: float = 0.8, validation: float = 0.1, test: float = 0.1, seed: int = SEED) -> DataFrame:
    """Stratified: whole numbers of each stratum for train and validation, the rest is for test."""
    if abs(train + validation + test - 1) > 1e-6:
        raise ValueError("the ratios have to sum up to 1")
    p = _position(rows, chance(seed))
    a, b = F.floor(F.col("n_stratum") * train), F.floor(F.col("n_stratum") * validation)
    return p.withColumn("part", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "validation").otherwise("test")).drop("rank", "n_stratum")


def balance(rows: DataFrame, target: int, method: str = "oversample", seed: int = SEED) -> DataFrame:
    """``target`` rows of each stratum: the first by chance of a large one; copies of a small one unless undersampling.
    Copies are made where the row lies."""
    if method not in ("oversample", "undersample", "hybrid"):
        raise ValueError(f"unknown method {method!r}")
    p = _position(rows, chance(seed))
    if method == "undersample":
        return p.where(F.col("rank") <= target).withColumn("copy", F.lit(0)).drop("rank", "n_stratum")
    times = F.floor((F.lit(target) - F.col("rank")) / F.col("n_stratum")).cast("int")
    return p.where(F.col("rank") <= target).withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(times, F.lit(0))))).drop("rank", "n_stratum")


def balanced_size(sizes: DataFrame, least: int = 10) -> int:
    """The upper median of the strata's sizes times their number, at least ``least`` times it."""
    n = [r[0] for r in sizes.select("n").orderBy("n").collect()]  # a row for each stratum
    return max(n[len(n) // 2] * len(n), least * len(n)) if n else 0


def augment(rows: DataFrame, seed: int = SEED, share: float = 0.4) -> DataFrame:
    """Variants of some rows, with a rewritten instruction and 0.95 of the confidence, 0.1 at least."""
    picked = F.conv(F.substring(chance(seed, "a"), 1, 8), 16, 10).cast("double") / float(2**32) < share
    words = F.regexp_replace(F.regexp_replace("instruction", "^Generate", "Produce"), "^Categorize", "Classify")
    return rows.where(picked).withColumn("instruction", words).withColumn("confidence", F.greatest(F.col("confidence") * 0.95, F.lit(0.1)))


#: Other wordings of instructions, phrases and words; technical terms that stay as they are.
VARIATIONS = {
    "Enhance the description": ["Improve the description", "Refine the description", "Enrich the description", "Augment the description"],
    "Categorize this software": ["Classify this software", "Determine the category of this software", "Identify the software category", "Assign a category to this software"],
}
PHRASES = {"this software": "the software", "the given software": "this software", "package information": "package details", "metadata information": "metadata details", "software package": "application"}
SYNONYMS = {
    "software": ["application", "program", "tool", "utility"],
    "package": ["software package", "application package", "program"],
    "install": ["set up", "deploy", "configure"],
    "server": ["service", "daemon", "backend"],
    "client": ["frontend", "user interface", "application"],
    "configuration": ["config", "settings", "setup"],
    "documentation": ["docs", "manual", "guide"],
    "repository": ["repo", "source", "codebase"],
}
TECHNICAL = ["apt", "dnf", "brew", "winget", "scoop", "npm", "pip", "cargo", "docker", "kubernetes", "yaml", "json", "xml", "http", "https", "api", "cli", "gui", "server", "client", "database", "cache", "linux", "windows", "macos", "ubuntu", "debian", "fedora", "centos"]
SPACING = {r"\s+": " ", r":\s*": ": ", r",\s*": ", "}


def _drawn(salt: Column, seed: int = SEED) -> Column:
    """A number from 0 up to 1 for each row and salt."""
    return F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"#{seed}"), salt)), 1, 8), 16, 10).cast("double") / float(2**32)


def _picked(choices: list[str], drawn: Column) -> Column:
    return F.get(F.array(*map(F.lit, choices)), F.floor(drawn * len(choices)).cast("int"))


def varied_instruction(salt: Column, variations: dict[str, list[str]], seed: int = SEED) -> Column:
    """The instruction with the first phrase that it holds, whatever its case, in other words (where the case is the same)."""
    out = F.when(F.lit(False), F.lit(""))
    for phrase, others in variations.items():
        out = out.when(F.contains(F.lower("instruction"), F.lit(phrase.lower())), F.replace(F.col("instruction"), F.lit(phrase), _picked(others, _drawn(F.concat(salt, F.lit("v")), seed))))
    return out.otherwise(F.col("instruction"))


def paraphrased(text: Column, salt: Column, seed: int = SEED) -> Column:
    """Each phrase is replaced in three rows of ten."""
    for i, (phrase, other) in enumerate(PHRASES.items()):
        text = F.when(_drawn(F.concat(salt, F.lit(f"p{i}")), seed) < 0.3, F.regexp_replace(text, rf"(?i)\b{phrase}\b", other)).otherwise(text)
    return text


def with_synonyms(text: Column, salt: Column, seed: int = SEED, keep_technical: bool = True) -> Column:
    """Three in ten of the words that have synonyms, punctuation aside, are replaced; a capital stays one. Technical terms
    stay. Words are set one space apart."""
    table = F.create_map(*(x for w, others in SYNONYMS.items() if not (keep_technical and w in TECHNICAL) for x in (F.lit(w), F.array(*map(F.lit, others)))))

    def one(w: Column, i: Column) -> Column:
        others = F.get(F.array(table), F.lit(0))[F.trim(F.lower(w), F.lit(".,!?;:"))]
        at = F.concat(salt, F.lit("s"), i.cast("string"))
        other = F.get(others, F.floor(_drawn(F.concat(at, F.lit("w")), seed) * F.size(others)).cast("int"))
        other = F.when(F.left(w, F.lit(1)) != F.lower(F.left(w, F.lit(1))), F.concat(F.upper(F.left(other, F.lit(1))), F.substring(other, 2, 2**31 - 1))).otherwise(other)
        return F.when(others.isNotNull() & (_drawn(at, seed) < 0.3), other).otherwise(w)

    words = F.array_remove(F.split(F.trim(text), r"\s+"), "")
    return F.array_join(F.transform(words, one), " ")


def respaced(text: Column, salt: Column, seed: int = SEED) -> Column:
    """Each rule of spacing is applied in two rows of ten; blanks at the ends go."""
    for i, (pattern, other) in enumerate(SPACING.items()):
        text = F.when(_drawn(F.concat(salt, F.lit(f"n{i}")), seed) < 0.2, F.regexp_replace(text, pattern, other)).otherwise(text)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def variants(rows: DataFrame, times: int = 1, variations: dict[str, list[str]] | None = None, seed: int = SEED, instruction: float = 0.4, phrases: float = 0.3, synonyms: float = 0.2, spacing: float = 0.1) -> DataFrame:
    """``times`` attempts at a variant of each row (id, instruction, input, confidence, ...), of which those that differ
    are kept: the instruction in other words, phrases, synonyms and spacing of the input, each with its chance. ``copy``
    numbers them; they have 0.95 of the confidence, 0.1 at least. Everything is computed where the row lies."""
    r = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))) if times > 0 else rows.withColumn("copy", F.lit(1)).where("false")
    salt = F.concat(F.lit("#"), F.col("copy").cast("string"))
    hit = lambda name, chance: _drawn(F.concat(salt, F.lit(name)), seed) < chance
    r = r.withColumn("_i", F.when(hit("I", instruction), varied_instruction(salt, VARIATIONS if variations is None else variations, seed)).otherwise(F.col("instruction")))
    r = r.withColumn("_x", F.when(hit("P", phrases), paraphrased(F.col("input"), salt, seed)).otherwise(F.col("input")))
    r = r.withColumn("_x", F.when(hit("S", synonyms), with_synonyms(F.col("_x"), salt, seed)).otherwise(F.col("_x")))
    r = r.withColumn("_x", F.when(hit("N", spacing), respaced(F.col("_x"), salt, seed)).otherwise(F.col("_x")))
    r = r.where((F.col("_i") != F.col("instruction")) | (F.col("_x") != F.col("input")))
    return r.withColumn("instruction", F.col("_i")).withColumn("input", F.col("_x")).withColumn("confidence", F.greatest(F.col("confidence") * 0.95, F.lit(0.1))).drop("_i", "_x")


def augmented(rows: DataFrame, multiplier: float = 2.0, times: int = 4, **chances) -> DataFrame:
    """``rows`` (copy 0) and so many of their :func:`variants`, chosen by chance, that there are ``multiplier`` times as
    many as before; fewer if ``times`` attempts at each row don't give that many."""
    n = rows.count()
    more = int(n * multiplier) - n
    made = variants(rows, times, **chances)
    chosen = made.orderBy(_drawn(F.concat(F.lit("#"), F.col("copy").cast("string"), F.lit("o"))), "id", "copy").limit(max(more, 0))
    return rows.withColumn("copy", F.lit(0)).unionByName(chosen)


def causal_text() -> Column:
    return F.concat(F.lit("### Instruction:\n"), "instruction", F.lit("\n\n### Input:\n"), "input", F.lit("\n\n### Response:\n"), "output")


def seq2seq_text() -> Column:
    """Source and target between marks."""
    return F.concat(F.lit("<source>"), "instruction", F.lit("\n\nInput: "), "input", F.lit("</source><target>"), "output", F.lit("</target>"))


def labelled_text() -> Column:
    """Instruction, input and output on lines of their own."""
    return F.concat(F.lit("Instruction: "), "instruction", F.lit("\nInput: "), "input", F.lit("\nOutput: "), "output")
