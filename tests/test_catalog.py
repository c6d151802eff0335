"""Every catalog query against its SQL, and operators against the values that are known."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions import text
from lodestone.operators import dataset, documents, quality, search
from lodestone.plans.views import view
from lodestone.queries.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(round(v, 8) if isinstance(v, float) else int(v) if isinstance(v, bool) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert [x.replace(".0,", ",") for x in plain(rows)] == [x.replace(".0,", ",") for x in plain([tuple(r[i] for i in order) for r in want.fetchall()])]


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def values(spark, rows, *columns):
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(len(rows[0]))))
    return [tuple(r) for r in df.select(*columns).collect()]


def test_similarity(spark):
    a, b = F.col("c0"), F.col("c1")
    got = [r[0] for r in values(spark, [("nginx", "NGINX"), ("", "x"), ("nginx", "apache"), ("nginx", "nginx-full")], text.similarity(a, b))]
    assert got[:2] == [1.0, 0.0] and got[2] < 0.5 and 0.3 < got[3] < 0.9
    got = [r[0] for r in values(spark, [("ngin", "nginx"), ("web", "web-server"), ("xyz", "nginx")], text.partial_match(a, b))]
    assert got == [True, True, False]


def test_names_and_licenses(spark):
    c = F.col("c0")
    got = values(spark, [("MIT License",), ("Apache License 2.0",), ("GPL v3",), ("BSD License",), ("Custom License",)], text.normalized_license(c))
    assert [r[0] for r in got] == ["MIT", "Apache-2.0", "GPL-3.0", "BSD", "Custom License"]
    assert set(values(spark, [("nginx-full-web-server",)], text.keywords(c))[0][0]) == {"nginx", "full", "web", "server"}
    assert [r[0] for r in values(spark, [("libssl-dev",), ("Python3-Foo_bar",)], text.normalized_name(c))] == ["ssl", "foo-bar"]
    got = values(spark, [("1.2.3", "1.2.10"), ("1.9", "2.0"), ("x", "1")], text.version_key(F.col("c0")) < text.version_key(F.col("c1")), text.same_major(F.col("c0"), F.col("c1")))
    assert got == [(True, True), (True, False), (True, True)]


def test_substitution_and_conditions(spark):
    known = {"name": F.col("c0"), "os.kind": F.col("c1")}
    row = [("nginx", "linux")]
    assert values(spark, row, documents.substituted("$name ${os.kind|any} {{ none | d }} {{name}} $x", known))[0][0] == "nginx linux d nginx $x"
    for e, want in (("name == 'nginx' and os.kind in ['linux', 'macos']", True), ("not name or os.kind != 'linux'", False), ("none exists or name", True), ("name not in ['nginx']", False)):
        assert values(spark, row, documents.condition(e, known))[0][0] is want


def test_split_and_balance(spark):
    with pytest.raises(ValueError):
        dataset.split(None, 0.5, 0.1, 0.1)
    with pytest.raises(ValueError):
        dataset.balance(spark.createDataFrame([], "id long, category string, template string"), 3, "other")
    rows = spark.range(50).selectExpr("id", "if(id < 7, 'a', 'b') category", "'t' template")
    sizes = {r.stratum: r.n for r in dataset.strata_sizes(dataset.balance(rows, 20)).collect()}
    assert sizes == {"a": 20, "b": 20}


def test_dedup_prefers_score_then_weight(spark):
    rows = spark.createDataFrame([(1, "nginx", "apt", 0.9), (2, "libnginx", "brew", 0.95), (3, "Nginx-dev", "apt", 0.95), (4, "httpd", "brew", 0.1)], "seq long, name string, provider string, score double")
    assert sorted(r.seq for r in search.dedup(rows).collect()) == [3, 4]


def test_cross_references_of_alike_values(spark):
    rows = [
        (1, 1, "apt", "1.2.0", "a fast web server"),
        (1, 2, "brew", "1.3.0", "a fast web server indeed"),
        (1, 3, "npm", "2.0", "bindings for another thing"),
        (1, 4, "apt", "9.0", "a later value of the first provider"),
        (1, 5, "snap", "", ""),
        (1, 6, "snap", "1.10.0", "a fast web server"),
        (1, 7, "nix", "latest", None),
        (2, 8, "apt", None, "one"),
        (3, 9, "apt", None, None),
        (4, 10, "apt", "1.0", "x y"),
        (4, 11, "brew", "2.0", "p q"),
    ]
    c = spark.createDataFrame(rows, "software long, seq long, provider string, version string, description string")
    got = {r.software: (r.consensus, r.n_conflicts, r.agreement) for r in quality.cross_reference_texts(c, F.col("description")).collect()}
    assert got == {1: ("a fast web server indeed", 3, 0.5), 2: ("one", 0, 1.0), 4: ("x y", 1, 0.0)}
    got = {r.software: (r.consensus, r.n_conflicts, r.agreement) for r in quality.cross_reference_versions(c, F.col("version")).collect()}
    assert got == {1: ("2.0", 3, 0.7), 4: ("2.0", 1, 0.0)}


def test_cross_referenced_descriptions_by_pairs(spark):
    """Against the column function, which compares each pair by itself."""
    c = QUERIES["crossref_descriptions_similar"](spark, SF)
    first = quality._first_values(view(spark, SF, "catalog"), F.col("description"), "software")
    a, b = first.alias("a"), first.alias("b")
    pairs = a.join(b, "software").where("a.provider < b.provider").select("software", text.text_similarity(F.col("a.value"), F.col("b.value")).alias("s"))
    want = {r.software: r.n for r in pairs.groupBy("software").agg(F.count_if(F.round("s", 9) < 0.5).alias("n")).collect()}
    assert {r.software: r.n_conflicts for r in c.collect()} == want


def test_packages_are_compared_with_their_descriptions(spark):
    long = "a fast web server that serves pages over the network"
    rows = [
        (1, "nginx", "apt", long),
        (2, "nginx", "brew", long),
        (3, "nginx", "npm", "bindings"),
        (4, "Nginx", "snap", long.upper()),
        (5, "nginx", "apt", "bindings"),
        (6, "web server", "apt", long),
        (7, "web server pro", "apt", long),
        (8, "open-ssl", "apt", long),
        (9, "openssl", "apt", long),
        (10, "nginx", "nix", None),
        (11, None, "apt", long),
    ]
    c = spark.createDataFrame(rows, "seq long, name string, provider string, description string")
    first = {(n, p): (s, d) for s, n, p, d in reversed(rows)}
    p = spark.createDataFrame([(s, n, q, d) for (n, q), (s, d) in first.items()], "seq long, name string, provider string, description string")
    a, b = p.select(F.struct("*").alias("a")), p.select(F.struct("*").alias("b"))
    every = [(x.a, x.b, round(x.s, 6)) for x in a.crossJoin(b).select("a", "b", F.coalesce(search.package_similarity("a", "b"), F.lit(0.0)).alias("s")).collect()]
    want = {}
    for x, y, s in sorted(every, key=lambda t: -t[0].seq):
        if x.seq < y.seq and s >= 0.9:
            want[y.name, y.provider] = (x.name, x.provider, s)
    got = {(r.name, r.provider): (r.first_name, r.first_provider, r.similarity) for r in search.duplicates(c).collect()}
    assert got == want and {("nginx", "brew"), ("Nginx", "snap")} <= set(got) and not {("nginx", "npm"), ("nginx", "nix"), ("openssl", "apt")} & set(got)
    got = [tuple(r) for r in search.alternatives(c, "nginx").collect()]
    assert sorted(got) == sorted((y.name, y.provider, y.seq, s) for x, y, s in every if x.seq == 1 and y.seq != 1 and s >= 0.5)
    assert [r[2] for r in got] == [x[2] for x in sorted(got, key=lambda r: (-r[3], r[2]))] and got[0][:2] == ("nginx", "brew")
    assert search.alternatives(c, "nginx", "npm").count() and not search.alternatives(c, "none").count()
