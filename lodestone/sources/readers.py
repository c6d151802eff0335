"""Package catalogs in the formats that repositories publish, read from files as (name, version, description, ...).

Files are read by Spark's own readers and parsed by its functions, wherever the format has one; tar, plist and YAML files
are parsed in Arrow batches. A record that cannot be read gives no row and stops nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import ship

_PACKAGE = "name string, version string, description string, homepage string, license string, depends array<string>"


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs that blank lines separate, however long the file."""
    return spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")


def _field(key: str, end: str = r"(?=\n\S|\z)") -> Column:
    """What follows ``key:`` at the start of a line, with its continuation lines; null if it is not there."""
    return F.nullif(F.trim(F.regexp_extract("value", rf"(?s)(?:\A|\n){key}:[ \t]*(.*?){end}", 1)), F.lit(""))


def _depends(c: Column) -> Column:
    """Names of a list like ``a (>= 1), b``."""
    return F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.regexp_extract(x, r"([^\s(]+)", 1))


def _packages(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows with the columns of a package, null where a format has none, and a name."""
    out = df.select(*(columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in (x.split() for x in _PACKAGE.split(", "))))
    return out.where(F.coalesce(F.col("name") != "", F.lit(False)))


def stanzas(spark: SparkSession, path: str, continued: bool = True) -> DataFrame:
    """apt and opkg indexes; without ``continued`` lines that go on are ignored."""
    end = r"(?=\n\S|\z)" if continued else r"(?=\n|\z)"
    text = F.regexp_replace(_field("Description", end), r"\n[ \t]+", r"\\n")
    return _packages(_records(spark, path), name=_field("Package"), version=_field("Version"), description=text, homepage=_field("Homepage"), license=_field("License"), depends=F.array_remove(_depends(_field("Depends", end)), ""))


def apk_index(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a letter, a colon and a value."""
    one = lambda k: _field(k, r"(?=\n|\z)")
    return _packages(_records(spark, path), name=one("P"), version=one("V"), description=one("T"), homepage=one("U"), license=one("L"), depends=F.array_remove(F.split(F.coalesce(one("D"), F.lit("")), " "), ""))


def slackware(spark: SparkSession, path: str) -> DataFrame:
    """``PACKAGE NAME: name-version-arch-build.txz`` and a description of several lines."""
    file = F.regexp_extract("value", r"PACKAGE NAME:\s*(\S+)", 1)
    part = lambda i: F.regexp_extract(file, r"^(.+)-([^-]+)-([^-]+)-([^-]+)\.t.z$", i)
    text = F.regexp_extract("value", r"(?s)PACKAGE DESCRIPTION:\s*(.*)", 1)
    return _packages(_records(spark, path), name=part(1), version=part(2), description=F.trim(F.regexp_replace(F.regexp_replace(text, r"(?m)^[\w.+-]+:[ ]?", ""), r"\s+", " ")))


def rpm_primary(spark: SparkSession, path: str) -> DataFrame:
    """primary.xml of rpm repositories: the epoch is left out if it is 0; requirements on rpmlib and files are dropped."""
    requires = "array<struct<_name:string>>"
    schema = f"name string, version struct<_epoch:string,_ver:string,_rel:string>, summary string, url string, format struct<`rpm:license`:string,`rpm:requires`:struct<`rpm:entry`:{requires}>>"
    x = spark.read.format("xml").option("rowTag", "package").schema(schema).load(path)
    v = F.col("version")
    epoch = F.when(F.coalesce(v["_epoch"], F.lit("0")) != "0", F.concat(v["_epoch"], F.lit(":"))).otherwise("")
    names = F.transform(F.col("format.`rpm:requires`.`rpm:entry`"), lambda e: e["_name"])
    kept = F.filter(names, lambda n: ~(F.startswith(n, F.lit("rpmlib(")) | F.startswith(n, F.lit("/"))))
    return _packages(x, name=F.col("name"), version=F.concat(epoch, v["_ver"], F.lit("-"), v["_rel"]), description=F.col("summary"), homepage=F.col("url"), license=F.col("format.`rpm:license`"), depends=kept)


def _json(spark: SparkSession, path: str) -> DataFrame:
    """One column j: each file as a variant, null if it is not JSON."""
    return spark.read.text(path, wholetext=True).select(F.try_parse_json(F.regexp_replace("value", r"^﻿", "")).alias("j"), F.col("_metadata.file_name").alias("file"))


def _get(path: str, of: str = "j") -> Column:
    return F.try_variant_get(F.col(of), path, "string")


def _each(df: DataFrame, path: str = "$") -> DataFrame:
    """One row for each item of an array, or member of an object, at ``path``: file, key and j."""
    inner = df.select("file", F.try_variant_get("j", path, "variant").alias("a"))
    return inner.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("a").outer())).select("file", "key", F.col("value").alias("j"))


def brew(spark: SparkSession, path: str) -> DataFrame:
    """An array of formulae or casks; a full name that differs is a package of its own."""
    j = _each(_json(spark, path))
    name = F.coalesce(_get("$.name[0]"), _get("$.name"))
    j = j.withColumn("n", F.explode(F.array_distinct(F.array_compact(F.array(name, _get("$.full_name"))))))
    return _packages(j, name=F.col("n"), version=F.coalesce(_get("$.versions.stable"), _get("$.version")), description=_get("$.desc"), homepage=_get("$.homepage"), license=_get("$.license"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """FreeBSD's packagesite: an object on each line."""
    j = spark.read.text(path).select(F.try_parse_json("value").alias("j"))
    return _packages(j, name=_get("$.name"), version=_get("$.version"), description=_get("$.comment"), homepage=_get("$.www"))


#: Where registries' answers have their items and what is called what: at, name, version, description, homepage, license.
REGISTRIES = {
    "npm": ("$.objects", "$.package.name", "$.package.version", "$.package.description", "$.package.links.homepage", "$.package.license"),
    "npm_details": (None, "$.name", "$['dist-tags'].latest", "$.description", "$.homepage", "$.license"),
    "pypi": (None, "$.info.name", "$.info.version", "$.info.summary", "$.info.home_page", "$.info.license"),
    "cargo": ("$.crates", "$.name", "$.max_version", "$.description", "$.homepage", "$.license"),
    "cargo_details": (None, "$.crate.name", "$.crate.max_version", "$.crate.description", "$.crate.homepage", "$.versions[0].license"),
    "docker": ("$.results", "$.name", "$.tag", "$.description", "$.url", "$.license"),
    "docker_details": (None, "$.name", "$.tag", "$.description", "$.url", "$.license"),
    "snap": ("$._embedded['clickindex:package']", "$.package_name", "$.version", "$.summary", "$.website", "$.license"),
    "flatpak": ("$", "$.id", "$.currentReleaseVersion", "$.summary", "$.homepage", "$.projectLicense"),
    "nuget": ("$.data", "$.id", "$.version", "$.description", "$.projectUrl", "$.licenseUrl"),
    "guix_json": ("$", "$.name", "$.version", "$.synopsis", "$['home-page']", "$.license"),
}
#: What else registries say of a package: names and places.
DETAILS = {
    "brew": {"brew_type": None, "tap": "$.tap", "revision": "$.revision", "outdated": "$.outdated"},
    "npm": {"score": "$.score.final", "author": "$.package.author.name", "date": "$.package.date"},
    "npm_details": {"repository": "$.repository.url", "author": "$.author.name", "main": "$.main"},
    "cargo": {"downloads": "$.downloads", "repository": "$.repository", "documentation": "$.documentation"},
    "cargo_details": {"downloads": "$.crate.downloads", "repository": "$.crate.repository", "documentation": "$.crate.documentation"},
    "docker": {"namespace": "$.namespace", "stars": "$.star_count", "pulls": "$.pull_count", "official": "$.is_official"},
    "docker_details": {"namespace": "$.namespace", "stars": "$.star_count", "pulls": "$.pull_count", "official": "$.is_official"},
    "pypi": {"author": "$.info.author", "requires_python": "$.info.requires_python", "project_url": "$.info.project_url"},
    "nuget": {"downloads": "$.totalDownloads", "icon": "$.iconUrl"},
    "snap": {"publisher": "$.publisher", "channel": "$.channel"},
    "flatpak": {"developer": "$.developerName"},
}


def _registry_name(kind: str) -> Column:
    """Docker images outside of the library are named with their namespace."""
    name = _get(REGISTRIES[kind][1])
    if not kind.startswith("docker"):
        return name
    space = _get("$.namespace")
    return F.when(F.coalesce(space, F.lit("library")).isin("library", "") | F.contains(name, F.lit("/")), name).otherwise(F.concat(space, F.lit("/"), name))


def _registry_items(spark: SparkSession, path: str, kind: str) -> DataFrame:
    at = "$" if kind == "brew" else REGISTRIES[kind][0]
    return _json(spark, path) if at is None else _each(_json(spark, path), at)


def registry(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Saved answers of a package registry: of its search, or with ``_details`` of one package a file."""
    rest = REGISTRIES[kind][2:]
    return _packages(_registry_items(spark, path, kind), name=_registry_name(kind), **{k: _get(p) for k, p in zip(("version", "description", "homepage", "license"), rest, strict=True)})


def details(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(name, key, value): what else saved answers say of packages; brew's type is ``cask`` for what has a token."""
    j = _registry_items(spark, path, kind)
    name = F.coalesce(_get("$.name[0]"), _get("$.name")) if kind == "brew" else _registry_name(kind)
    of = lambda k, p: F.when(_get("$.token").isNotNull(), "cask").otherwise("formula") if p is None else _get(p)
    rows = j.select(name.alias("name"), F.inline(F.array(*(F.struct(F.lit(k).alias("key"), of(k, p).alias("value")) for k, p in DETAILS[kind].items()))))
    return rows.where("name is not null and value is not null")


def nuget_services(spark: SparkSession, path: str) -> DataFrame:
    """(type, url) of a service index: where to search, and where packages are registered."""
    return _each(_json(spark, path), "$.resources").select(_get("$['@type']").alias("type"), _get("$['@id']").alias("url")).where("url is not null")


def _lines_without_json(spark: SparkSession, path: str) -> DataFrame:
    """The lines of those files that are not JSON, as value."""
    t = spark.read.text(path, wholetext=True)
    return t.where(F.try_parse_json("value").isNull()).select(F.explode(F.split("value", r"\r?\n")).alias("value")).select(F.trim("value").alias("value")).where("value <> ''")


def guix(spark: SparkSession, path: str) -> DataFrame:
    """Available packages, as JSON or as lines of name, version and description."""
    g = lambda i: F.regexp_extract("value", r"^([a-z0-9_-]+)\s+([0-9][0-9a-z_.-]*)\s*(.*)$", i)
    return registry(spark, path, "guix_json").unionByName(_packages(_lines_without_json(spark, path), name=g(1), version=g(2), description=F.nullif(g(3), F.lit(""))))


def scoop(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file for each package, named after it."""
    return _packages(_json(spark, path), name=F.regexp_extract("file", r"^(.*)\.json$", 1), version=_get("$.version"), description=_get("$.description"), homepage=_get("$.homepage"), license=F.coalesce(_get("$.license.identifier"), _get("$.license")))


def nix(spark: SparkSession, path: str) -> DataFrame:
    """An object of packages, whose version begins where a part between hyphens begins with a digit; or lines of a path,
    a version in brackets and a description."""
    j = _each(_json(spark, path))
    full = F.coalesce(_get("$.name"), F.col("key"))
    found = _packages(j, name=F.coalesce(F.nullif(F.regexp_extract(full, r"^(.*?)-[0-9].*$", 1), F.lit("")), full), version=F.coalesce(_get("$.version"), F.regexp_extract(full, r"^.*?-([0-9].*)$", 1)), description=_get("$.meta.description"), homepage=_get("$.meta.homepage"))
    g = lambda i: F.regexp_extract("value", r"^(?:\S*\.)?([^\s.]+)\s+\(([^)]+)\)\s*(.*)$", i)
    return found.unionByName(_packages(_lines_without_json(spark, path), name=g(1), version=g(2), description=F.nullif(g(3), F.lit(""))))


def ebuilds(spark: SparkSession, path: str) -> DataFrame:
    """``FIELD="value"`` of ebuilds; name and version are in the file's name, dependencies are atoms."""
    t = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    f = lambda k: F.nullif(F.regexp_extract("value", rf'(?s)(?:\A|\n){k}="(.*?)"', 1), F.lit(""))
    atoms = F.regexp_extract_all(F.coalesce(F.concat_ws(" ", f("DEPEND"), f("RDEPEND")), F.lit("")), F.lit(r"([a-z0-9-]+/[A-Za-z0-9_-]+?)(?=-\d|[\s:\[\]]|$)"), 1)
    return _packages(t, name=F.regexp_extract("file", r"^(.+?)-\d[^/]*\.ebuild$", 1), version=F.regexp_extract("file", r"-(\d[^/]*)\.ebuild$", 1), description=f("DESCRIPTION"), homepage=f("HOMEPAGE"), license=f("LICENSE"), depends=F.array_distinct(atoms))


def spack(spark: SparkSession, path: str) -> DataFrame:
    """package.py files: the class's docstring, homepage and first version; or JSON objects of packages by name."""
    t = spark.read.text(path, wholetext=True)
    g = lambda p: F.regexp_extract("value", p, 1)
    name = F.lower(F.regexp_replace(g(r"class (\w+)\("), r"(?<=[a-z0-9])(?=[A-Z])", "-"))
    found = _packages(t, name=name, version=g(r"version\(\s*[\"']([^\"']+)"), description=F.trim(F.regexp_replace(g(r'(?s)class \w+\([^)]*\):\s*"""(.*?)"""'), r"\s+", " ")), homepage=g(r"homepage\s*=\s*[\"']([^\"']+)"))
    j = _each(_json(spark, path))
    return found.unionByName(_packages(j, name=F.col("key"), version=F.coalesce(_get("$.versions[0]"), _get("$.latest_version")), description=_get("$.description"), homepage=_get("$.homepage"), depends=F.try_variant_get("j", "$.dependencies", "array<string>")))


def emerge(spark: SparkSession, path: str) -> DataFrame:
    """Output of a search: ``* category/name`` and indented fields."""
    t = spark.read.option("lineSep", "\n\n").text(path)
    g = lambda k: F.trim(F.regexp_extract("value", rf"{k}:[ \t]*([^\n]*)", 1))
    return _packages(t, name=F.regexp_extract("value", r"\*[ \t]+(\S+/\S+)", 1), version=g("Latest version available"), description=g("Description"), homepage=g("Homepage"), license=g("License"))


def _parsed(spark: SparkSession, path: str, parse) -> DataFrame:
    """Packages that ``parse`` yields from the bytes of each file, and the file and its problem where it fails; what was
    read of a file before that stays. A library that is missing is an error, not a damaged file."""
    columns = [x.split()[0] for x in _PACKAGE.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    for r in parse(content):
                        rows.append({c: r.get(c) for c in columns})
                except ImportError:
                    raise
                except Exception as e:  # a damaged file stops nothing, and is reported
                    rows.append({"file": file, "problem": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in (*columns, "file", "problem")})

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"{_PACKAGE}, file string, problem string")


def _in_batches(spark: SparkSession, path: str, parse) -> DataFrame:
    return _parsed(spark, path, parse).where("problem is null").drop("file", "problem")


def damaged(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, problem) of archives, plist and YAML files (pacman, xbps or helm) that can't be read, or not to their end."""
    return _parsed(spark, path, _PARSERS[kind]).where("problem is not null").select("file", "problem")


def _pacman(content):
    import io
    import re
    import tarfile

    found: dict[str, dict[str, str]] = {}  # what desc and depends say of each package
    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
        for m in tar:
            folder, _, file = m.name.rpartition("/")
            if m.isfile() and file in ("desc", "depends"):
                text = tar.extractfile(m).read().decode("utf-8", "replace")
                found.setdefault(folder, {}).update({k: " ".join(v.split("\n")).strip() for k, v in re.findall(r"%([A-Z0-9]+)%\n(.*?)(?=\n\n|\n?\Z)", text, re.S)})
    for f in found.values():
        yield {"name": f.get("NAME"), "version": f.get("VERSION"), "description": f.get("DESC"), "homepage": f.get("URL"), "license": f.get("LICENSE"), "depends": f.get("DEPENDS", "").split()}


def pacman(spark: SparkSession, path: str) -> DataFrame:
    """Databases: a tar archive with files of ``%KEY%`` blocks, desc and depends, for each package."""
    return _in_batches(spark, path, _pacman)


def _xbps(content):
    import json
    import plistlib

    index = json.loads(content) if content.lstrip()[:1] == b"{" else plistlib.loads(content)
    listed = [(p.get("pkgname"), p) for p in index["packages"]] if isinstance(index.get("packages"), list) else [(n, p) for n, p in index.items() if isinstance(p, dict)]
    for name, p in listed:
        version = str(p.get("pkgver") or p.get("version") or "")
        yield {"name": name, "version": version.removeprefix(f"{name}-"), "description": p.get("short_desc"), "homepage": p.get("homepage"), "license": p.get("license"), "depends": p.get("run_depends", [])}


def xbps(spark: SparkSession, path: str) -> DataFrame:
    """Indexes in the plist format, a list or an object of packages; or as a JSON object."""
    return _in_batches(spark, path, _xbps)


def _helm(content):
    import yaml

    for name, versions in (yaml.safe_load(content).get("entries") or {}).items():
        if versions:
            yield {"name": name, "version": str(versions[0].get("version")), "description": versions[0].get("description"), "homepage": versions[0].get("home")}


def helm(spark: SparkSession, path: str) -> DataFrame:
    """index.yaml: the first version of each chart. Needs PyYAML on the executors."""
    return _in_batches(spark, path, _helm)


_PARSERS = {"pacman": _pacman, "xbps": _xbps, "helm": _helm}


def release(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of Release files, with continued lines; lists such as Components are separated by spaces."""
    t = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    pairs = t.select("file", F.explode(F.regexp_extract_all("value", F.lit(r"((?:\A|\n)[^\s:][^:\n]*:[^\n]*(?:\n[ \t][^\n]*)*)"), 1)).alias("pair"))
    pair = F.trim("pair", F.lit("\n"))
    return pairs.select("file", F.trim(F.substring_index(pair, ":", 1)).alias("key"), F.trim(F.regexp_replace(F.regexp_replace(pair, r"^[^:]*:", ""), r"\s*\n[ \t]+", " ")).alias("value"))


def repomd(spark: SparkSession, path: str) -> DataFrame:
    """(file, type, location, checksum) of the parts of rpm repositories; the primary one lists packages."""
    schema = "_type string, location struct<_href:string>, checksum struct<_VALUE:string,_type:string>"
    x = spark.read.format("xml").option("rowTag", "data").schema(schema).load(path)
    return x.select(F.col("_metadata.file_path").alias("file"), F.col("_type").alias("type"), F.col("location._href").alias("location"), F.col("checksum._VALUE").alias("checksum")).where("location is not null")


def metalink(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, url) of the mirrors of a metalink that speak HTTP."""
    t = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    tags = F.regexp_extract_all("value", F.lit(r"(<(?:\w+:)?url\b[^>]*>[^<]*<)"), 1)
    each = t.select("file", F.posexplode(tags).alias("place", "tag"))
    return each.where(F.col("tag").rlike(r"""\bprotocol=["']https?["']""")).select("file", "place", F.trim(F.regexp_extract("tag", r">([^<]*)<", 1)).alias("url"))


def rpm_repositories(spark: SparkSession, paths: dict[tuple[str, str], str]) -> DataFrame:
    """Packages of several repositories by (distribution, architecture), with these as columns."""
    out = None
    for (distribution, arch), path in paths.items():
        rows = rpm_primary(spark, path).withColumn("distribution", F.lit(distribution)).withColumn("arch", F.lit(arch))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no repositories are given")
    return out


def cached_names(spark: SparkSession, path: str, manager: str) -> DataFrame:
    """(name): distinct names of packages in cached JSON files, whatever their shape: keys of an object, or what items of
    a list are called, by the rules for ``manager``."""
    j = _json(spark, path)
    is_list = F.startswith(F.schema_of_variant("j"), F.lit("ARRAY"))
    keys = lambda at="$", rows=j: _each(rows.where(F.startswith(F.schema_of_variant(F.try_variant_get("j", at, "variant")), F.lit("OBJECT"))), at).select(F.col("key").alias("name"))

    def items(at: str, rows: DataFrame, *fields: str) -> DataFrame:
        one = _each(rows.where(F.startswith(F.schema_of_variant(F.try_variant_get("j", at, "variant")), F.lit("ARRAY"))), at)
        text = F.when(F.schema_of_variant("j") == "STRING", F.try_variant_get("j", "$", "string"))
        return one.select(F.coalesce(text, *(_get(f"$.{f}") for f in fields)).alias("name"))

    whole = j.where("j is not null")
    packed = whole.where(F.try_variant_get("j", "$.packages", "variant").isNotNull())
    bare = whole.where(F.try_variant_get("j", "$.packages", "variant").isNull())
    if manager == "brew":
        out = keys()
    elif manager == "npm":
        out = _each(whole, "$.objects").select(_get("$.package.name").alias("name"))
    elif manager in ("pypi", "apt", "dnf", "yum", "pacman", "zypper"):
        fields = ("name",) if manager == "pypi" else ("name", "package", "Package")
        out = items("$", whole, *fields).union(items("$.packages", packed.where(~is_list))).union(keys("$.packages", packed.where(~is_list))).union(keys("$", bare))
    else:
        fields, out = ("name", "package", "title"), keys().union(items("$", whole, "name", "package", "title"))
        left = whole.where(~is_list)
        for at in ("packages", "items", "objects", "results"):  # the first that there is
            there = F.try_variant_get("j", f"$.{at}", "variant").isNotNull()
            out, left = out.union(items(f"$.{at}", left.where(there), *fields)), left.where(~there)
    return out.where(F.coalesce(F.col("name") != "", F.lit(False))).distinct()


def yaml_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, value, items, problem): the leaves of YAML files; a file that can't be read is one row with its problem.
    Marks at the beginning and tabs are repaired."""

    def run(batches):
        import yaml

        from lodestone.operators.templates import rows_of

        for pdf in batches:
            out = []
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                try:
                    tree = yaml.safe_load(text)
                    if tree is not None and not isinstance(tree, dict):
                        raise ValueError(f"a document is an object, not {type(tree).__name__}")
                    out += [(file, p, v, i, None) for p, v, i in rows_of(tree or {})]
                except (yaml.YAMLError, ValueError) as e:
                    out.append((file, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["file", "path", "value", "items", "problem"])

    ship(spark)
    t = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), repaired_yaml(decoded(F.col("content"))).alias("value"))
    return t.mapInPandas(run, "file string, path string, value string, items array<string>, problem string")


def choco(spark: SparkSession, path: str) -> DataFrame:
    """Feeds of entries, as a package gallery answers: the title is the name, the rest is among the properties."""
    x = _entries(spark, path, "entry")
    g = lambda tag: F.nullif(F.trim(F.regexp_extract("value", rf"(?is)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>", 1)), F.lit(""))
    named = F.coalesce(g("id").isNotNull() & ~F.contains(g("id"), F.lit("://")), F.lit(False))
    parts = F.filter(F.split(F.coalesce(g("dependencies"), F.lit("")), r"\|"), lambda d: ~d.rlike("<|^$"))
    listed = F.transform(parts, lambda d: F.split(d, ":")[0])
    tagged = F.regexp_extract_all("value", F.lit(r'(?i)<dependency\s[^>]*id="([^"]+)"'), 1)
    return _packages(x, name=F.when(named, g("id")).otherwise(g("title")), version=g("version"), description=F.coalesce(g("description"), g("summary")), homepage=g("projectUrl"), license=g("licenseUrl"), depends=F.concat(listed, tagged))


def _entries(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """The text of each element ``tag`` of XML files, or of a nuspec's ``metadata``."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)(<(?:{tag}|metadata)[\s>].*?</(?:{tag}|metadata)>)"), 1)).alias("value"))


def winget(spark: SparkSession, path: str) -> DataFrame:
    """Manifests of ``Key: value`` lines, several for each package: of each key the file that comes last wins."""
    t = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    g = lambda k: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{k}:[ \t]*(.*?)[ \t\r]*$", 1), F.lit(" '\"")), F.lit(""))
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.installer|\.locale\.[\w-]+)?\.ya?ml$", 1)
    fields = {"version": g("PackageVersion"), "description": F.coalesce(g("ShortDescription"), g("Description")), "homepage": g("PackageUrl"), "license": g("License")}
    rows = t.select(F.coalesce(g("PackageIdentifier"), stem).alias("name"), "file", *(v.alias(k) for k, v in fields.items()))
    last = rows.groupBy("name").agg(*(F.max_by(k, F.when(F.col(k).isNotNull(), F.col("file"))).alias(k) for k in fields))
    return _packages(last, name=F.col("name"), **{k: F.col(k) for k in fields})


def names(spark: SparkSession, path: str) -> DataFrame:
    """A name on each line; blank lines and those that begin with # are left out."""
    t = spark.read.text(path).select(F.trim("value", F.lit(" \t\r")).alias("name"))
    return t.where((F.col("name") != "") & ~F.startswith("name", F.lit("#")))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are, else Latin-1, which anything is."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def repaired_xml(c: Column) -> Column:
    """Without a mark at the beginning and without control characters."""
    return F.regexp_replace(F.regexp_replace(c, "^\ufeff", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def repaired_yaml(c: Column) -> Column:
    """Without a mark at the beginning, two spaces for each tab."""
    return F.replace(F.regexp_replace(c, "^\ufeff", ""), F.lit("\t"), F.lit("  "))


def repaired_json(c: Column) -> Column:
    """JSON as text, or as it is without its mark, trailing commas and single quotes around keys; null if all fails."""
    fixed = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^﻿", ""), r",\s*([}\]])", "$1"), r"([{,]\s*)'([^']*)'\s*:", '$1"$2":')
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(fixed)).cast("string")


READERS = {
    "apt": stanzas, "opkg": lambda s, p: stanzas(s, p, False), "apk": apk_index, "slackpkg": slackware, "pacman": pacman, "dnf": rpm_primary, "yum": rpm_primary, "zypper": rpm_primary, "brew": brew,
    "pkg": json_lines, "scoop": scoop, "nix": nix, "nixpkgs": nix, "portage": ebuilds, "emerge": emerge, "spack": spack, "xbps": xbps, "helm": helm, "choco": choco, "winget": winget, "guix": guix, **{k: (lambda s, p, k=k: registry(s, p, k)) for k in REGISTRIES},
}


def register(provider: str, reader) -> None:
    """Adds a source: a function of a session and a path that gives packages."""
    if not callable(reader):
        raise TypeError("a reader is a function of a session and a path")
    READERS[provider] = reader


def catalog(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Packages of several providers (provider: path) as one table."""
    out = None
    for provider, path in paths.items():
        rows = READERS[provider](spark, path).withColumn("provider", F.lit(provider))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no providers are given")
    return out
