"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions only."""

from __future__ import annotations

import random
import string
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.forest import Tree, probability, train

#: Runs of 16 characters or more with a digit.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}"
#: A word that announces a secret, then an assignment.
ANNOUNCED = r"(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key|credential)[A-Za-z_]*[\"']?\s*[=:]"
#: An announcement, then its value in the same word: up to the next quote if it is quoted, else up to a separator too.
WITHIN = rf"({ANNOUNCED}[=:>(]*[\"']?)((?<=[\"'])[^\"']{{6,}}|(?<![\"'])[^\"'&,;]{{6,}})"
SPACE = r"[\x20\x09-\x0D]+"
REPORT = 0.5
#: Words near a secret, near a placeholder, of a path that holds tests; a dictionary; frequent pairs of letters.
KEYWORDS = "password|passwd|pwd|secret|token|api_?key|apikey|access_?key|auth|credential|bearer|private"
PLACEHOLDERS = "example|sample|dummy|placeholder|changeme|your|fake|xxxx|checksum|commit|sha256|md5|digest|uuid|version|order|card|invoice"
TEST_PATHS = "test|spec|example|sample|doc|fixture|mock"
DICTIONARY = "about access account after again also api auth before change client cloud code config count data date default demo dev document email end error event example file final first from group host image index info input install item key last level line list local main make map message model name network node note number object order output package page part pass path place placeholder point port private process prod project public query read record release remote report request response result root run sample save secret server service session set site size source staging start state status storage string system table tag task template test text time token type update upload url user value version view web with word work world write year your here insert the and for"
PAIRS = "th he in er an re nd on en at ou ed ha to or it is hi es ng te se st ar al nt le de ve me co ro ra io ic ne as ti ur ma li la el ta om ce ec si ri et ai ca no us di ch ll ho be pe un so tr wa ac ol em po mo il na ge tu ke ss id ee wh pr sa"
NAMES = ["length", "digits", "uppers", "transitions", "hexes", "pairs", "dictionary", "distinct", "keyword", "placeholder", "assigned", "test_path", "symbols", "equal_digits"]


def _share(c: Column, chars: str) -> Column:
    return F.char_length(F.regexp_replace(c, f"[^{chars}]", "")) / F.char_length(c)


def features(candidate: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """The columns that NAMES names, all double, of a candidate (not empty), the words around it and its path or host."""
    lower = F.lower(candidate)
    n = F.char_length(candidate)
    classes = F.translate(candidate, string.ascii_lowercase + string.ascii_uppercase + string.digits, "a" * 26 + "A" * 26 + "0" * 10)
    at = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    share_of_steps = lambda test: F.size(F.filter(at, test)) / F.size(at)
    near = F.lower(F.concat_ws(" ", before, after))
    flag = lambda c, words: F.coalesce(c.rlike(words), F.lit(False)).cast("double")
    rest = F.regexp_replace(lower, "(" + "|".join(sorted((w for w in DICTIONARY.split() if len(w) > 2), key=len, reverse=True)) + ")", "")
    return [
        F.least(n, F.lit(120)).cast("double"),
        _share(candidate, "0-9"),
        _share(candidate, "A-Z"),
        share_of_steps(lambda i: F.substring(classes, i, F.lit(1)) != F.substring(classes, i + 1, F.lit(1))),
        _share(candidate, "0-9a-f"),
        share_of_steps(lambda i: F.instr(F.lit(PAIRS), F.substring(lower, i, F.lit(2))) % 3 == 1),
        1 - F.char_length(rest) / n,
        F.size(F.array_distinct(F.split(candidate, ""))) / n,
        flag(near, KEYWORDS),
        F.greatest(flag(near, PLACEHOLDERS), flag(lower, PLACEHOLDERS)),
        flag(before, r"[=:]\s*[\"']?$"),
        flag(F.lower(path), TEST_PATHS),
        _share(candidate, "+/_=-"),
        F.greatest(flag(candidate, r"(.)\1{5,}"), flag(candidate, "(?:0123|1234|abcd){2,}")),
    ]


def labelled_findings(n: int = 1600, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Findings (candidate, before, after, path, label) to train on where the caller has none: made from rules."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexes, alnum = string.digits + "abcdef", string.ascii_letters + string.digits
    words = DICTIONARY.split()
    filler = lambda: " ".join("".join(r.choice(PAIRS.split()) for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 3)))
    paths = ["src/app.py", "config/prod.yaml", "src3", "src11", "web", "deploy/main.tf", "notes.txt", "host7"]
    tests = ["tests/test_api.py", "docs/guide.md", "examples/demo.py", "spec/fixtures.rb"]
    name = lambda: r.choice(["password", "secret", "token", "api_key", "API_KEY", "auth_token", "access_key", "db_password", "client_secret"])
    said = lambda: f'{filler()} {name()} {r.choice(["=", ":", "= \"", ": \""])}'.strip()
    true = [
        lambda: (pick(hexes, r.choice([32, 40, 64])), said()),
        lambda: (pick(alnum + "+/", r.choice([40, 44, 64])), said()),
        lambda: ("AKIA" + pick(string.ascii_uppercase + string.digits, 16), r.choice([said(), filler()])),
        lambda: ("ghp_" + pick(alnum, 36), r.choice([said(), filler()])),
        lambda: ("sk-" + pick(alnum, r.choice([32, 48])), r.choice([said(), filler()])),
        lambda: (pick(alnum + "_-", r.randint(16, 30)), said()),
    ]
    false = [
        lambda: (pick(string.digits, r.choice([16, 16, 16, 18, 20])), r.choice([filler(), filler(), f"{filler()} card number", f"{filler()} order:"])),
        lambda: ("-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), r.choice([filler(), f"{filler()} uuid:", f"{filler()} id ="])),
        lambda: ("_".join(r.choice(words) for _ in range(r.randint(3, 5))) + f"_{r.randint(1, 2030)}", r.choice([filler(), said()])),
        lambda: (r.choice(["your_api_key_here_", "changeme_changeme_", "example_token_", "placeholder_secret_"]) + pick(string.digits, 4), said()),
        lambda: ("x" * r.randint(14, 30) + pick(string.digits, 2), said()),
        lambda: (pick(hexes, 40), f"{filler()} commit"),
        lambda: (pick(hexes, r.choice([32, 64])), f"{filler()} {r.choice(['md5', 'sha256', 'checksum', 'digest'])}{r.choice([':', ' =', ''])}"),
        lambda: (f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-00-{r.randint(10, 59)}", filler()),
        lambda: ("".join(r.choice(PAIRS.split()) for _ in range(r.randint(8, 14))) + pick(string.digits, r.randint(1, 2)), filler()),
        lambda: ("/".join(r.choice(words) for _ in range(r.randint(3, 5))) + f"/v{r.randint(1, 9)}", filler()),
        lambda: (r.choice(["0123456789abcdef" * 2, "1234567890123456", "abcd1234" * 4]), said()),
    ]
    out = []
    for i in range(n):
        (candidate, before), label = (r.choice(true)(), 1) if i % 2 else (r.choice(false)(), 0)
        out.append((candidate, before, filler(), r.choice(paths if label or r.random() < 0.5 else tests), label))
    return out


@cache
def _own_forest(spark: SparkSession) -> list[Tree]:
    return fit(spark.createDataFrame(labelled_findings(), "candidate string, before string, after string, path string, label int"))


def fit(findings: DataFrame, most: int = 20_000) -> list[Tree]:
    """A forest for labelled ``findings`` (candidate, before, after, path, label), ``most`` of them at most: of more those
    with the least hashes, so that it is the same forest each time. Nulls around a candidate count as empty."""
    named = ("candidate", "before", "after", "path")
    known = findings.where("candidate <> '' and label is not null").select("label", *(F.coalesce(c, F.lit("")).alias(c) for c in named))
    chosen = known if known.count() <= most else known.orderBy(F.xxhash64(*named, "label"), *named, "label").limit(most)
    rows = chosen.select("label", *features(*map(F.col, named))).collect()
    if len({r[0] for r in rows}) < 2:
        raise ValueError("findings of both labels are needed")
    x = np.array([r[1:] for r in rows], float)
    return train(x, np.array([r[0] for r in rows], float))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, "^[\"'(]+|[\"'),.;]+$", "")


def _pieces(word: Column) -> Column:
    """What lies between the candidates of a word, and the candidates, by turns: left, candidate, left, ..., left.

    Words have no spaces or tabs, so these can mark places: announcements and values are set off by spaces (text,
    announcement, value, text, ...), then tokens in texts and values, or else the whole value, by tabs.
    """
    tokens = lambda c: F.regexp_replace(c, TOKEN, "\t$0\t")
    value = lambda c: F.when(c.rlike(TOKEN), tokens(c)).when(_stripped(c) != "", F.concat(F.lit("\t"), _stripped(c), F.lit("\t"))).otherwise(c)
    parts = F.split(F.regexp_replace(word, WITHIN, " $1 $2 "), " ", -1)
    return F.split(F.array_join(F.transform(parts, lambda p, j: F.when(j % 3 == 0, tokens(p)).when(j % 3 == 1, p).otherwise(value(p))), ""), "\t", -1)


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, word_no, candidate, before, after, path) of whole texts; null texts have none.

    A word has as many candidates as it has tokens and announced values. ``before`` of the first one begins two words
    before, that of others where the last candidate ends; ``after`` of the last one is the next word.
    """
    rows = docs.where(F.col("text").rlike(f"{TOKEN}|{ANNOUNCED}")).select("doc_id", F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.split("text", SPACE).alias("w"))
    assigned = lambda i: F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1)).rlike(f"{ANNOUNCED}$")
    numbered = F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    hit = F.filter(numbered, lambda p: p["x"].rlike(TOKEN) | p["x"].rlike(WITHIN) | ((F.char_length(p["x"]) >= 8) & (p["i"] > 0) & assigned(p["i"])))
    each = rows.select("doc_id", "path", "w", F.explode(hit).alias("hit"))
    i = F.col("hit.i")
    each = each.select("doc_id", "path", i.alias("i"), F.col("hit.x").alias("x"), F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1)).alias("words"), F.coalesce(F.get("w", i + 1), F.lit("")).alias("next"))
    one = lambda c, left, first, last: F.struct(c.alias("c"), left.alias("left"), first.alias("first"), last.alias("last"))
    n = F.size("s")
    many = F.transform(F.sequence(F.lit(1), n - 2, F.lit(2)), lambda k: one(F.get("s", k), F.get("s", k - 1), k == 1, k == n - 2))
    whole = F.array(one(F.col("v"), F.expr("substring_index(x, v, 1)"), F.lit(True), F.lit(True)))
    each = each.withColumns({"s": _pieces(F.col("x")), "v": _stripped(F.col("x"))}).withColumn("f", F.explode(F.when(n > 2, many).otherwise(whole)))
    before = F.trim(F.when(F.col("f.first"), F.concat_ws(" ", "words", "f.left")).otherwise(F.col("f.left")))
    return each.where("f.c <> ''").select("doc_id", F.col("i").cast("long").alias("word_no"), F.col("f.c").alias("candidate"), before.alias("before"), F.when(F.col("f.last"), F.col("next")).otherwise("").alias("after"), "path")


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str = "source", report: float = REPORT) -> DataFrame:
    """(doc_id, word_no, candidate, probability): what the forest takes for a secret, over whole texts; a word may
    have several.

    The forest is trained on ``findings``, else on :func:`labelled_findings`. Null, empty and blank texts have no
    findings; null paths count as empty; rows that repeat are all scanned; extra columns are ignored.
    """
    forest = fit(findings) if findings is not None else _own_forest(docs.sparkSession)
    found = candidates(docs, path)
    f = features(*(F.col(c) for c in ("candidate", "before", "after", "path")))
    found = found.select("doc_id", "word_no", "candidate", *(c.alias(n) for c, n in zip(f, NAMES, strict=True)))
    score = F.round(probability(forest, [F.col(n) for n in NAMES]), 6)
    # the filter is inside of a generator: below the features it would be computed many times over
    kept = F.explode(F.filter(F.array(score), lambda p: p > report)).alias("probability")
    return found.select("doc_id", "word_no", "candidate", kept)
