"""Operators on packages, documents and caches against values that are known."""

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import documents, metrics, packages

CATALOG = "software long, seq long, name string, provider string, version string, description string, homepage string, source_url string, license string, platforms array<string>, category string"
ROWS = [
    (1, 0, "nginx", "apt", "1.18.0", "High-performance web server", "", None, None, ["linux"], None),
    (1, 1, "nginx", "brew", None, "HTTP server", "example.org", None, "BSD", ["macos", "linux"], "web"),
    (2, 2, "httpd", "brew", "2.4", None, None, None, None, None, None),
]


def catalog(spark, rows=ROWS):
    return spark.createDataFrame(rows, CATALOG)


def test_lookups_filters_and_features(spark):
    c = catalog(spark)
    assert {(r.name, r.seq) for r in packages.first_sources(c).collect()} == {("nginx", 0), ("httpd", 2)}
    assert [r.seq for r in packages.filtered(c, include=["brew"], least_description=50).collect()] == [2]
    assert [r.seq for r in packages.filtered(c, exclude=["brew"], with_version=True).collect()] == [0]
    f = packages.features(c).collect()
    assert [(r.software, r.same_name, r.same_version, r.n_providers) for r in f] == [(1, "nginx", "1.18.0", 2)]
    assert packages.features(catalog(spark, [])).count() == 0
    assert [r.provider for r in packages.unavailable(c, c.where("seq = 0")).collect()] == ["brew"]


def test_merged_and_fixed(spark):
    m = {r.software: r for r in packages.merged_record(catalog(spark)).collect()}
    assert (m[1].description, m[1].homepage, m[1].license, m[1].platforms) == ("High-performance web server", "example.org", "BSD", ["linux", "macos"])
    assert (m[2].description, m[2].platforms) == (None, None)
    f = {r.seq: r for r in packages.fixed(catalog(spark)).collect()}
    assert (f[1].version, f[1].homepage, f[1].category) == ("0.1", "https://example.org", "web") and (f[2].license, f[2].platforms) == ("MIT", ["linux"])


def test_field_confidence(spark):
    rows = [(1, "x", "a", "apt", 0, 0.9), (1, "x", "a", "brew", 1, 0.8), (1, "x", "b", "none", 2, 0.4)]
    p = spark.createDataFrame(rows, "software long, field string, value string, provider string, seq long, confidence double")
    r = packages.field_confidence(p).first()
    assert r.value == "a" and abs(r.confidence - round((0.9 * 0.9 + 0.85 * 0.8 + 0.5 * 0.4) / 3 + 0.2 * 2 / 3, 5)) < 1e-9


def test_retry(spark):
    rows = spark.createDataFrame([(429, None, 0), (404, None, 0), (None, "Timeout", 2), (None, "Timeout", 3), (None, "SSLError", 0), (None, "KeyError", 0)], "s int, e string, a int")
    assert [r[0].again for r in rows.select(packages.retry(F.col("s"), F.col("e"), F.col("a"))).collect()] == [True, False, True, False, False, False]


def test_close_matches(spark):
    got = packages.close_matches(spark.createDataFrame([("Webb",), ("Webb",), (None,)], "c string"), "c", ["web", "system", "games"]).collect()
    assert [(r.value, r.match, r["rank"]) for r in got] == [("webb", "web", 1)]


def test_documents(spark):
    rows = spark.createDataFrame([("d", "a.b", "1"), ("d", "a[0]", "2"), ("d", "ab", None), ("e", "c", "3")], "doc string, path string, value string")
    assert {tuple(r) for r in documents.with_value(rows, "a", "x").collect()} == {("d", "a", "x"), ("e", "a", "x"), ("d", "ab", None), ("e", "c", "3")}
    d = spark.createDataFrame([("a.b", "1")], "path string, value string")
    q = {r.doc: r for r in documents.override_quality(rows, d, ["a.b"], "doc").collect()}
    assert (q["d"].redundant, q["d"].missing, q["d"].invalid, q["e"].missing) == (1, 0, 1, 1) and abs(q["e"].quality - 0.9) < 1e-9
    j = spark.createDataFrame([('{"k": 1, "s": "x"}',), ('{"k": "1", "s": null}',), ("nope",), (None,)], "j string")
    assert [r[0] for r in j.select(documents.type_issues(F.col("j"), {"k": "integer", "t": "string"})).collect()] == [[], ["k"], ["$"], []]


def test_caches(spark):
    kind = "key string, id long, ts long, v string"
    old, new = spark.createDataFrame([("a", 1, 5, "x"), ("b", 1, 5, "y")], kind), spark.createDataFrame([("a", 2, 5, "z"), ("b", 2, 4, "w"), ("c", 1, 1, "n")], kind)
    assert {(r.key, r.v) for r in metrics.upserted(old, new).collect()} == {("a", "z"), ("b", "y"), ("c", "n")}
    assert {(r.key, r.id) for r in metrics.newest(old.union(new), 1).collect()} == {("a", 2), ("b", 1), ("c", 1)}
    r = metrics.hit_rates(old.union(new), F.col("v") == "x", F.col("v") == "z").orderBy("key").collect()
    assert [(x.hits, x.misses, x.hit_rate) for x in r] == [(1, 1, 0.5), (0, 0, 0.0), (0, 0, 0.0)]


def test_spellings(spark):
    one = spark.createDataFrame([("Foo-bar", "a (>= 1), b,", "1.5")], "n string, d string, l string").select(
        text.name_variations(F.col("n")), text.dependency_names(F.col("d")), text.literal_kind(F.col("l")), text.capitalized(F.col("n"))
    ).first()
    assert tuple(one) == (["Foo-bar", "foo-bar", "Foo_bar"], ["a", "b"], "float", "Foo-bar")
