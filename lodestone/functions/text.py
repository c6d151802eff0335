"""Column functions over names, descriptions, licences, versions and URLs. All run inside of the JVM but difflib's ratio."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import dims

#: Fixed values.
STOP_WORDS = ["a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "the"]
URL = r"^https?://(?:[-\w.])+(?::[0-9]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:[\w.])*)?)?$"
VERSION = r"^(\d+)\.(\d+)(?:\.(\d+))?(?:[-.]?([a-zA-Z0-9]+))?$"
#: Any of four patterns of licences: only whether one of them is there is asked.
LICENSE_LIKE = r"(?i)MIT|Apache.*2\.0|GPL.*3\.0|GNU.*General.*Public.*License.*3|BSD"
_BLANK = " \t\n\x0b\x0c\r"


def truthy(c: Column) -> Column:
    """A string that is neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def words(c: Column) -> Column:
    """What white space separates."""
    return F.array_remove(F.split(c, r"\s+"), "")


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANK))


def normalized_name(c: Column) -> Column:
    """One prefix and one suffix that packagers add go; separators become one hyphen."""
    c = F.regexp_replace(trimmed(F.lower(c)), "^(?:lib|python-|python3-|node-|ruby-)", "")
    c = F.regexp_replace(c, "-(?:dev|devel|doc|docs|common|utils|tools)$", "")
    return F.trim(F.regexp_replace(c, r"[-_.]+", "-"), F.lit("-"))


def keywords(c: Column) -> Column:
    parts = F.split(F.lower(c), r"[-_\s.]+")
    return F.array_distinct(F.filter(parts, lambda w: (F.char_length(w) >= 2) & ~w.isin(*STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def keyword_similarity(a: Column, b: Column) -> Column:
    return jaccard(keywords(a), keywords(b))


def text_similarity(a: Column, b: Column) -> Column:
    """0.7 of the words' Jaccard and 0.3 of how near their first places are; 0 if either text has no words."""

    def of(p: Column) -> Column:
        wa, wb = p["a"], p["b"]
        common = F.array_intersect(wa, wb)
        place = lambda w, x: (F.array_position(w, x) - 1) / F.size(w)
        near = F.aggregate(common, F.lit(0.0), lambda s, x: s + 1 - F.abs(place(wa, x) - place(wb, x)))
        mean = F.when(F.size(common) > 0, near / F.size(common)).otherwise(F.lit(0.0))
        return F.when((F.size(wa) == 0) | (F.size(wb) == 0), F.lit(0.0)).otherwise(0.7 * F.size(common) / F.size(F.array_union(wa, wb)) + 0.3 * mean)

    # one pair of arrays, bound to a name: inside of a lambda they would be split again for each word
    return F.get(F.transform(F.array(F.struct(words(F.lower(a)).alias("a"), words(F.lower(b)).alias("b"))), of), F.lit(0))


def text_clarity(c: Column) -> Column:
    n = F.char_length(c)
    marks = n - F.char_length(F.translate(c, "!@#$%^&*()", ""))
    score = 0.5 + F.when(n.between(20, 200), 0.2).otherwise(0.0) + F.when(F.contains(c, F.lit(".")), 0.1).otherwise(0.0) + F.when(marks / n < 0.1, 0.2).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def normalized_license(c: Column) -> Column:
    low = F.lower(c)
    has = lambda x: F.contains(low, F.lit(x))
    return F.when(has("mit"), "MIT").when(has("apache") & has("2"), "Apache-2.0").when(has("gpl") & has("3"), "GPL-3.0").when(has("bsd"), "BSD").otherwise(c)


def license_format(c: Column) -> Column:
    return F.when(c.isin(*dims.SPDX_QUALITY), 1.0).when(c.rlike(LICENSE_LIKE), 0.8).otherwise(0.3)


def version_key(c: Column) -> Column:
    """All numbers of a version, to be compared in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), 1), lambda x: x.cast("decimal(38,0)"))


def same_major(a: Column, b: Column) -> Column:
    x, y = F.regexp_extract(a, r"(\d+)", 1), F.regexp_extract(b, r"(\d+)", 1)
    return (x == "") | (y == "") | (x.cast("decimal(38,0)") == y.cast("decimal(38,0)"))


def url_ok(c: Column) -> Column:
    return c.rlike(URL)


def has_scheme_and_host(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")


def string_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 1 if either is empty."""
    most = F.greatest(F.char_length(a), F.char_length(b))
    return F.when((a == "") | (b == ""), F.lit(1.0)).otherwise(F.levenshtein(a, b) / most)


def sequence_ratio(a: Column, b: Column) -> Column:
    """difflib's ratio: the one part of the similarity that Spark has no function for."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, i or "", j or "").ratio() for i, j in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(ratio, "double")(a, b)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix: the first place at which the characters differ."""
    n = F.least(F.char_length(a), F.char_length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, n))


def similarity(query: Column, target: Column) -> Column:
    """0.4 sequence ratio, 0.3 share if contained, 0.2 word Jaccard, 0.1 common prefix; 1 if equal, 0 if one is empty."""
    q, t = trimmed(F.lower(query)), trimmed(F.lower(target))
    inside = F.when(F.contains(t, q), F.char_length(q) / F.char_length(t)).otherwise(0.0)
    prefix = common_prefix(q, t) / F.greatest(F.char_length(q), F.char_length(t))
    mixed = 0.4 * sequence_ratio(q, t) + 0.3 * inside + 0.2 * jaccard(F.array_distinct(words(q)), F.array_distinct(words(t))) + 0.1 * prefix
    return F.when(~truthy(query) | ~truthy(target), 0.0).when(q == t, 1.0).otherwise(mixed)


def partial_match(query: Column, target: Column) -> Column:
    """Contained, or a word of the query of two characters or more starts a word of the target."""
    q, t = F.lower(query), F.lower(target)
    split = lambda c: F.split(c, r"[-_\s.]+")
    starts = F.exists(F.filter(split(q), lambda w: F.char_length(w) >= 2), lambda w: F.exists(split(t), lambda x: F.startswith(x, w)))
    return F.contains(t, q) | starts


def dependency_names(c: Column) -> Column:
    """Names of a list like ``a (>= 1), b``."""
    return F.array_remove(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.regexp_extract(x, r"([^\s(]+)", 1)), "")


def name_variations(c: Column) -> Column:
    """Spellings under which a registry may know a package, the given one first."""
    swap = lambda a, b: F.replace(c, F.lit(a), F.lit(b))
    return F.array_distinct(F.array(c, F.lower(c), swap("-", "_"), swap("_", "-"), swap(" ", "-"), swap(" ", "_")))


def literal_kind(c: Column) -> Column:
    """What a template takes a value for: quoted, float, int, bool, null or text."""
    quoted = c.rlike(r"""(?s)^(?:".*"|'.*')$""")
    number = F.when(F.contains(c, F.lit(".")), F.when(c.rlike(r"^\s*[+-]?(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"), "float")).when(c.rlike(r"^\s*[+-]?\d+\s*$"), "int")
    low = F.lower(c)
    return F.when(c.isNull(), "null").when(quoted, "quoted").otherwise(F.coalesce(number, F.when(low.isin("true", "false"), "bool").when(low.isin("none", "null"), "null").otherwise("text")))


def capitalized(c: Column) -> Column:
    """The first letter as a capital, all others small."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 2**31 - 1)))


def glob_pattern(glob: str) -> str:
    """A shell's pattern (*, ?, [seq], [!seq]) as a regular expression for whole texts."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "!")) if c == "[" else -1
        if c == "[" and end > 0:
            inside = glob[i + 1 : end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&").replace("^", r"\^")
            out.append(f"[^{inside[1:]}]" if inside[:1] == "!" else f"[{inside}]")
            i = end
        else:
            out.append({"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or (c if c.isalnum() or c in "_ :=" else "\\" + c))
        i += 1
    return "^" + "".join(out) + r"\z"


def matches_glob(c: Column, glob: str) -> Column:
    return c.rlike(glob_pattern(glob))
