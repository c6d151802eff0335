"""Nested documents, conditions, templates, support, records, pairs and streams against plain Python."""

import hashlib
import itertools
import json
import random
import re
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestone.functions import dims
from lodestone.operators import configurations, dataset, documents, expressions, metrics, packages, records, resolve, search, support
from lodestone.operators import templates as t
from lodestone.plans.views import view
from lodestone.queries.catalog import QUERIES
from lodestone.queries.structure import SCHEMA
from lodestone.streaming import health

SF = "/root/testdata/sf0.001"


def random_tree(r, depth=0):
    tree = {}
    for k in r.sample("abcd", r.randint(1, 3)):
        kind = r.random()
        tree[k] = random_tree(r, depth + 1) if kind < 0.45 and depth < 2 else [r.choice("xyz") for _ in range(r.randint(0, 3))] if kind < 0.65 else r.choice(["1", "2", None])
    return tree


def pruned(tree):
    """Without nulls and what they leave empty: deletions are told from values only at the leaves."""
    if not isinstance(tree, dict):
        return tree
    out = {k: pruned(v) for k, v in tree.items() if v is not None}
    return {k: v for k, v in out.items() if v != {}}


def distinct_lists(tree):
    return {k: distinct_lists(v) for k, v in tree.items()} if isinstance(tree, dict) else list(dict.fromkeys(tree)) if isinstance(tree, list) else tree


@pytest.mark.parametrize("deletes", [False, True])
def test_merging_of_layers(spark, deletes):
    r, rows, want = random.Random(3), [], {}
    for doc in range(60):
        layers = [distinct_lists(random_tree(r)) for _ in range(r.randint(1, 4))]
        merged = {}
        for i, tree in enumerate(layers):
            rows += [(doc, i, p, v, x) for p, v, x in t.rows_of(tree)]
            merged = t.merged(merged, tree, deletes)
        want[doc] = {p: v for p, v in t.flattened(pruned(merged) if deletes else merged).items() if v != {}}
    table = spark.createDataFrame(rows, "doc long, seq int, path string, value string, items array<string>")
    got = defaultdict(dict)
    for x in documents.merge_trees(table, deletes=deletes).collect():
        got[x.doc][x.path] = x.value if x["items"] is None else list(x["items"])
    assert got == {d: w for d, w in want.items() if w}


def test_overlay_of_four_layers(spark):
    kind = "doc string, path string, value string, items array<string>"
    base = spark.createDataFrame([("x", "a.b", "1", None), ("x", "l", None, ["p"])], kind)
    over = spark.createDataFrame([("x", "a", "2", None), ("x", "l", None, ["q", "p"])], kind)
    last = spark.createDataFrame([("x", "a.c", "3", None), ("x", "n", None, None)], kind)
    got = {x.path: x.value if x["items"] is None else list(x["items"]) for x in documents.overlay(base, over, last).collect()}
    assert got == {"a.c": "3", "l": ["p", "q"], "n": None}
    assert {x.path for x in documents.overlay(base, over, last, deletes=True).collect()} == {"a.c", "l"}
    assert documents.overlay(base.limit(0)).count() == 0
    with pytest.raises(ValueError):
        documents.overlay()


def test_conditions(spark):
    known = {"name": F.col("c0"), "os.kind": F.col("c1"), "none": F.lit(None).cast("string")}
    tree = {"name": "nginx and more", "os": {"kind": "linux"}}
    row = spark.createDataFrame([("nginx and more", "linux")], "c0 string, c1 string")
    for e, want in {
        "name == 'nginx and more'": True,
        "(name == 'x' or os.kind == 'linux') and not none": True,
        "name == 'x' or os.kind == 'linux' and none": False,
        "not (name or none)": False,
        "os.kind in ['a, b', linux]": True,
        'os.kind not in ["linux"]': False,
        "none exists": False,
        "((name))": True,
        "not not name": True,
    }.items():
        assert row.select(documents.condition(e, known)).first()[0] is want, e
        assert t.truth(e, tree) is want, e
    for bad in ("(a", "a ==", "a b", "", "or a", "a)"):
        with pytest.raises(ValueError):
            expressions.parse(bad)


def test_functions_of_templates():
    known = {"name": "Vim Editor", "tags": ["a", "b"], "n": 3}
    call = lambda tree: t.rendered(tree, known)
    assert call({"$function: join($tags, '-')": "k"}) == {"k": "a-b"} and call({"$function: join(tags)": "k"}) == {"k": "a,b"}
    assert call({"$function: split('a,b')": "k"}) == {"k": ["a", "b"]} and call({"$function: split('a,b', sep=',')": "k"}) == {"k": ["a", "b"]}
    assert call({"$function: replace(name)": {"old": "Vim", "new": "Nano"}}) == {"_function_result_0": "Nano Editor"}
    assert call({"$function: format": ["{} {}", "x", "$n"]}) == {"_function_result_0": "x 3"} and call({"$function: len(tags)": "k"}) == {"k": 2}
    assert call({"a": 1, "$function: replace(name)": "k"}).keys() == {"a", "_function_error_1"}
    assert call({"$function: yaml(tags)": "k"}) == {"k": "- a\n- b\n"} and call({"$function: title('big cat')": "k"}) == {"k": "Big Cat"}
    t.register_function("pair", lambda x: {"left": x, "right": x})
    assert call({"$function: pair(n)": "ignored"}) == {"left": 3, "right": 3}


def test_applied_templates(spark, tmp_path):
    default = {"version": "0.1", "packages": {"default": {"name": "$software_name"}}, "platforms": ["linux"], "$include: none": 1} | {"$include": "footer"}
    del default["$include: none"]
    apt = {"$provider_override: packages.default": {"version": "latest"}, "$provider_override: urls.website": "https://{{ software_name }}.org", "$if: 'linux' in platforms": {"services": {"default": {"enabled": True}}}, "license": None}
    brew = {"packages": {"brew": {"name": "$software_name@$current_provider"}}, "platforms": ["macos"]}
    got = t.applied("nginx", default, {"apt": apt, "brew": brew}, ["apt", "brew", "nix"], ["linux"], {"license": "BSD", "packages": {"default": {"version": None}}}, {"footer": {"note": "by ${software_name}"}})
    assert got == {
        "version": "0.1", "packages": {"default": {"name": "nginx"}, "brew": {"name": "nginx@brew"}}, "platforms": ["macos"], "urls": {"website": "https://nginx.org"},
        "services": {"default": {"enabled": True}}, "license": "BSD", "note": "by nginx",
    }
    assert t.merged_with_defaults({"a": 1}, {"supported": False}) == {"supported": False} and t.merged_with_defaults({"a": 1, "b": 2}, {"a": None}) == {"b": 2}
    assert not t.equal({"a": [1]}, {"a": [True]}) and t.equal({"a": [1]}, {"a": [1.0]}, strict=False)
    folder = tmp_path / "templates"
    for path, body in {"providers/apt.yaml": "a: 1\nvim:\n  b: 2\n", "providers/brew/default.yaml": "c: 3\n", "providers/brew/vim.yaml": "d: 4\n", "software/vim/providers/npm.yaml": "e: 5\n", "empty.yaml": ""}.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(body)
    of = lambda p, s=None: t.provider_template(spark, str(folder), p, s)
    assert of("apt") == {"a": 1, "vim": {"b": 2}} and of("brew") == {"c": 3} and of("nix") == {}
    assert (of("apt", "vim"), of("brew", "vim"), of("npm", "vim"), of("npm", "x")) == ({"b": 2}, {"d": 4}, {"e": 5}, {})
    assert t.loaded(spark, str(folder / "empty.yaml")) == t.loaded(spark, str(folder / "no.yaml")) == {}


def test_similar_documents(spark):
    """By all pairs; one item that all documents have."""
    r = random.Random(4)
    docs = {d: {("all", "x")} | {(f"p{r.randrange(8)}", r.choice("ab")) for _ in range(r.randint(0, 9))} for d in range(70)}
    table = spark.createDataFrame([(d, p, v) for d, items in docs.items() for p, v in items], "doc long, path string, value string")
    for least in (0.5, 0.8, 1.0):
        want = {(a, b, round(len(docs[a] & docs[b]) / len(docs[a] | docs[b]), 6)) for a, b in itertools.combinations(docs, 2) if len(docs[a] & docs[b]) / len(docs[a] | docs[b]) >= least}
        assert {tuple(x) for x in documents.similar_documents(table, "doc", least).collect()} == want
    with pytest.raises(ValueError):
        documents.similar_documents(table, "doc", 0)


def test_support(spark):
    asked = spark.createDataFrame([("vim", "apt"), ("gone", "apt"), ("rusty", "cargo"), ("vim", "cargo"), ("vim", "snap"), ("vim", "nix")], "name string, provider string")
    listed = spark.createDataFrame([("vim", "apt")], "name string, provider string")
    templates = spark.createDataFrame([("apt", None), ("cargo", None), ("snap", False)], "provider string, supported boolean")
    got = {(x.name, x.provider): (x.supported, x.reason) for x in support.supported(asked, listed, templates).collect()}
    assert got == {("vim", "apt"): (True, "repository"), ("gone", "apt"): (False, "repository"), ("rusty", "cargo"): (True, "rule"), ("vim", "cargo"): (False, "rule"), ("vim", "snap"): (False, "template"), ("vim", "nix"): (False, "no template")}


def test_configurations(spark):
    rows = spark.createDataFrame([("apt", "supported", "true"), ("apt", "a.b", "1"), ("apt", "c", "/usr/x"), ("npm", "supported", "false"), ("npm", "x", "1"), ("nix", "version", "1"), ("nix", "a.b", "1")], "provider string, path string, value string")
    defaults = spark.createDataFrame([("a.b", "1"), ("version", "1")], "path string, value string")
    got = {x.provider: tuple(x)[1:] for x in configurations.validated(rows, defaults).collect()}
    assert got["apt"] == (True, 2, 1, 1, 1, round(2 / 3 - 0.1 - 0.05, 6), round(1 / 3, 6))
    assert got["npm"] == (False, 0, 1, 1, 0, 0.5, 0.0) and got["nix"] == (True, 1, 1, 0, 0, 0.5, 0.5)
    assert tuple(configurations.consistency(configurations.validated(rows.limit(0), defaults)).first()) == (0, 0.0, 0, 0, 0, 0)
    moved = spark.createDataFrame([("apt", "services.web.port"), ("apt", "services.default"), ("apt", "packages.default.name"), ("apt", "packages.x.name"), ("apt", "license")], "provider string, path string")
    assert sorted(x.path for x in documents.renamed_items(moved).collect()) == ["license", "packages.apt.name", "services.apt", "services.apt_web.port"]


def test_records(spark):
    docs = ['{"version": "1", "packages": {"a": {"name": "x"}}, "ports": {"h": {"port": 80, "protocol": "tcp"}}, "description": "d", "license": "MIT", "platforms": ["linux"], "category": {"default": "web"}}', "{}", "[1]", "no", None]
    table = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, json string")
    got = [[tuple(x) for x in r[0]] if r[0] is not None else None for r in table.orderBy("id").select(records.schema_issues(F.col("json"), SCHEMA)).collect()]
    assert got == [[], [], [("$", "object")], [("$", "JSON")], []]
    rules = [r[0] if r[0] is None else [tuple(x) for x in r[0]] for r in table.orderBy("id").select(records.record_issues(F.col("json"))).collect()]
    assert rules[0] == [] and [x[1] for x in rules[1]] == ["version", "packages", "description", "category.default", "license", "platforms"]
    strict = {"type": "object", "required": ["a"], "properties": {"a": {"enum": ["x"]}}, "additionalProperties": False}
    one = spark.createDataFrame([('{"a": "y", "b": 1}',), ('{"a": "x"}',), ("{}",)], "json string")
    assert [[tuple(x) for x in r[0]] for r in one.select(records.schema_issues(F.col("json"), strict)).collect()] == [[("$.a", "enum"), ("$.b", "nothing")], [], [("$.a", "required")]]
    answers = spark.createDataFrame([('{"default": "web", "confidence": 2}',), ('{"default": " "}',), ('{"default": "web"}',), ("x",), ('{"website": "ftp://x"}',), ('{"platforms": "linux"}',)], "j string")
    both = [tuple(r) for r in answers.select(records.category_reason(F.col("j")), records.fields_reason(F.col("j"))).collect()]
    assert both[0][0] == "Confidence must be a number between 0 and 1" and both[1][0] == "Default category must be a non-empty string" and both[2] == (None, None) and both[3] == ("Invalid JSON", "Invalid JSON")
    assert both[4][1] == "URL field 'website' must be a valid HTTP/HTTPS URL" and both[5][1] == "Platforms must be a list"


def test_resolved_by_strategy(spark):
    rows = [(1, "license", "MIT", "apt", 0, None, 10.0, 0.5), (1, "license", "BSD", "brew", 1, None, 8.0, 0.9), (1, "license", "MIT", "npm", 2, None, 9.0, 0.7), (1, "version", "1", "apt", 0, None, 10.0, 0.9), (1, "version", "2", "npm", 1, 5, 9.0, 0.1), (1, "name", "n", "npm", 0, None, 9.0, 1.0), (1, "name", "a", "apt", 1, None, 10.0, 0.1), (2, "version", "1", "apt", 0, None, 10.0, 0.2), (2, "version", "3", "npm", 1, None, 9.0, 0.4)]
    p = spark.createDataFrame(rows, "software long, field string, value string, provider string, seq long, ts long, priority double, confidence double")
    got = {(x.software, x.field): (x.value, x.confidence) for x in resolve.resolved(p).collect()}
    assert got == {(1, "license"): ("MIT", round(2 / 3 * 0.6, 6)), (1, "version"): ("2", 0.1), (1, "name"): ("a", 0.1), (2, "version"): ("3", 0.4)}
    with pytest.raises(ValueError):
        resolve.resolved(p, {"name": "best"})
    assert resolve.whole_document(view(spark, SF, "catalog")).where("size(fields) > 3 and size(packages) > 1 and overall > 0").count() > 0


def drawn(i, salt):
    return int(hashlib.md5(f"{i}#42{salt}".encode()).hexdigest()[:8], 16) / 2**32


def plain_variant(i, text, salt):
    """Phrases, synonyms and spacing of an input, each with chance 0.5."""
    if drawn(i, salt + "P") < 0.5:
        for k, (phrase, other) in enumerate(dataset.PHRASES.items()):
            if drawn(i, f"{salt}p{k}") < 0.3:
                text = re.sub(rf"(?i)\b{phrase}\b", other, text, flags=re.ASCII)
    if drawn(i, salt + "S") < 0.5:
        words = re.split(r"\s+", text.strip(" "), flags=re.ASCII)
        out = []
        for k, w in enumerate(x for x in words if x):
            others = dataset.SYNONYMS.get(w.lower().strip(".,!?;:")) if w.lower().strip(".,!?;:") not in dataset.TECHNICAL else None
            if others and drawn(i, f"{salt}s{k}") < 0.3:
                other = others[int(drawn(i, f"{salt}s{k}w") * len(others))]
                w = other[0].upper() + other[1:] if w[0] != w[0].lower() else other
            out.append(w)
        text = " ".join(out)
    if drawn(i, salt + "N") < 0.5:
        for k, (pattern, other) in enumerate(dataset.SPACING.items()):
            if drawn(i, f"{salt}n{k}") < 0.2:
                text = re.sub(pattern, other, text, flags=re.ASCII)
        text = re.sub(r"^\s+|\s+$", "", text, flags=re.ASCII)
    return text


def test_variants_of_inputs(spark):
    texts = ["This software package: Install the Software, server,client of this  software", "the given software has package information:metadata information", "repository; Documentation! configuration", "none of it", ""]
    rows = [(i, "Say", texts[i % len(texts)], 0.9) for i in range(300)]
    p = spark.createDataFrame(rows, "id long, instruction string, input string, confidence double")
    got = {(x.id, x["copy"]): x.input for x in dataset.variants(p, 2, {}, phrases=0.5, synonyms=0.5, spacing=0.5).collect()}
    want = {(i, c): v for i, _, x, _ in rows for c in (1, 2) if (v := plain_variant(i, x, f"#{c}")) != x}
    assert got == want and len(got) > 100
    assert dataset.augmented(p, 1.2, instruction=0, phrases=1.0, synonyms=1.0).groupBy((F.col("copy") > 0).alias("new")).count().orderBy("new").collect()[1]["count"] == 60
    for by in ("category", "template", "confidence", "default"):
        assert dataset.strata_sizes(spark.createDataFrame([(None, "t", 0.6)], "category string, template string, confidence double"), by).first().n == 1
    labelled = spark.createDataFrame([("Generate this text", "input", "some output", 0.9, "a"), ("Generate this text", "input", "some output", 0.9, None), ("Generate this text", "input", "some output", 0.9, "b")], "instruction string, input string, output string, confidence double, quality_label string")
    assert dataset.filter_quality(labelled, labels=["a"]).count() == 2


def test_states_of_providers(spark, tmp_path):
    """Events in disorder over several files, with recoveries, a loss for good, and one that is too late."""
    r = random.Random(7)
    rows = [(f"k{r.randrange(4)}", r.randrange(0, 20_000), i, r.random() < 0.7, r.random() < 0.03) for i in range(400)]
    rows.sort(key=lambda x: x[1] + r.randrange(0, 500))
    kind = "key string, ts long, id long, failure boolean, permanent boolean"
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    for i in range(0, 400, 100):
        spark.createDataFrame(rows[i : i + 100], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    spark.createDataFrame([("end", 40_000, 999, True, False)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    spark.createDataFrame([("k0", 5, 1000, True, True)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    got = {x.id: (x.recent, x.available, x.permanent, x.event) for x in health.drained(spark, health.provider_states(stream(), "600 seconds")).collect()}
    want = {}
    for key in {x[0] for x in rows}:
        times, down, lost = [], False, False
        for _, ts, i, failure, permanent in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1], x[2])):
            times, down, lost, event = health.advanced(times, down, lost, ts, failure, permanent)
            want[i] = (sum(x > ts - 3600 for x in times), not (down or lost), lost, event)
    got.pop(999, None)
    assert got == want and {x[3] for x in want.values()} == {None, "marked_unavailable", "recovered"}


def test_token_bucket(spark):
    m = view(spark, SF, "metrics")
    state, want = {}, set()
    for x in sorted(m.select("key", "ts", "id").collect(), key=lambda x: (x.ts, x.id)):
        last, left = state.get(x.key, (x.ts, 5))
        left = min(5, left + (x.ts - last) * 0.01)
        ok = left >= 1
        state[x.key] = (x.ts, left - ok)
        want.add((x.key, x.ts, x.id, round(left - ok, 6), ok))
    assert {tuple(x) for x in metrics.token_bucket(m, 0.01, 5).collect()} == want


def test_trailing_windows(spark):
    """Limits that are broken, failures for good, and times at the edges of stretches."""
    r = random.Random(9)
    rows = [(f"k{r.randrange(3)}", r.choice([r.randrange(0, 400), 60 * r.randrange(0, 7), 60 * r.randrange(0, 7) - 1]), i, float(r.randrange(100)), r.random() < 0.05) for i in range(200)]
    table = spark.createDataFrame(rows, "key string, ts long, id long, value double, gone boolean")
    got = {x.id: tuple(x)[3:] for x in metrics.budget_windows(table, 60, 5, 250).collect()}
    late = {x.id: tuple(x)[3:] for x in metrics.failure_windows(table, 60, 4, "gone").collect()}
    for k, ts, i, _, gone in rows:
        near = [x for x in rows if x[0] == k and ts - 60 < x[1] <= ts]
        n, total = len(near), round(sum(x[3] for x in near), 4)
        ok = n <= 5 and total <= 250
        assert got[i] == (n, total, ok, 0 if ok else 60 - (ts - min(x[1] for x in near)))
        assert late[i] == (n, n >= 4 or gone)
    waits = [x[0] for x in spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "n int, s string").select(metrics.backoff(F.col("n"), 0.1, 30, F.col("s"))).collect()]
    assert 0.2 <= waits[0] <= 0.6 and 0.3 <= waits[1] <= 0.7 and 25.7 <= waits[2] <= 26.1


def test_picked_values(spark):
    r = random.Random(10)
    rows = [(k, r.choice([0.0, -1.5, -2e-9, 1e12, float(r.randrange(50)), r.gauss(0, 1000)])) for k in "abc" for _ in range(r.randint(1, 300))] + [("d", 5.0), ("e", None)]
    got = {x.name: tuple(x)[1:] for x in metrics.picked(spark.createDataFrame(rows, "name string, value double"), {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}).collect()}
    for k in "abcd":
        v = sorted(x for n, x in rows if n == k)
        assert got[k] == (len(v), *(v[min(int(len(v) * p), len(v) - 1)] for p in (0, 0.5, 0.99, 1)))
    assert "e" not in got


def test_globs(spark):
    from fnmatch import fnmatchcase

    from lodestone.functions import text

    names = ["a.b", "axb", "a", "ab", "[x]", "a]b", "a-b", "a^b", "a\nb", "A.b", "", "a.b\n"]
    table = spark.createDataFrame([(x,) for x in names], "n string")
    for g in ("a*b", "a?b", "a.b", "[abc]*", "a[!.]b", "*", "[[]x]", "a[]]b", "[", "a[.-]b", "a[^x]b"):
        assert {x.n for x in table.where(text.matches_glob(F.col("n"), g)).collect()} == {x for x in names if fnmatchcase(x, g)}, g


def plain_similarity(q, s):
    a, b = q.strip().lower(), s.strip().lower()
    if not q or not s:
        return 0.0
    if a == b:
        return 1.0
    prefix = len(list(itertools.takewhile(lambda x: x[0] == x[1], zip(a, b, strict=False))))
    wa, wb = set(a.split()), set(b.split())
    return 0.4 * SequenceMatcher(None, a, b).ratio() + (0.3 * len(a) / len(b) if a in b else 0) + 0.2 * (len(wa & wb) / len(wa | wb) if wa and wb else 0) + 0.1 * prefix / max(len(a), len(b))


def test_suggestions_and_close_matches(spark):
    c = view(spark, SF, "catalog")
    first = {}
    for x in c.select("name", "seq").orderBy("seq").collect():
        first.setdefault(x.name, x.seq)
    scored = sorted(((-round(plain_similarity("pkg_en3", n), 6), s, n) for n, s in first.items()))
    assert [x.name for x in QUERIES["suggest"](spark, SF).collect()] == [n for p, _, n in scored if -p >= 0.3][:10]
    got = defaultdict(list)
    for x in packages.close_matches(c, "category", dims.CATEGORIES).orderBy("value", "rank").collect():
        got[x.value].append(x.match)
    for value in {x.category.lower() for x in c.select("category").collect() if x.category}:
        ranked = sorted(((SequenceMatcher(None, k, value).ratio(), k) for k in dims.CATEGORIES), reverse=True)
        assert got[value] == [k for p, k in ranked if p >= 0.3][:3]


def test_groups_of_similar_packages(spark):
    """Seeds in order, each taking what is similar and not taken yet, within each software."""
    r = random.Random(6)
    names, words = ["nginx", "nginx-full", "nginx full", "httpd", "http server", "vim", "vim editor"], ["fast web server", "a fast web server", "text editor", None]
    rows = [(s, i, r.choice(names), r.choice(["apt", "brew", "npm"]), r.choice(words), r.random()) for s in range(12) for i in range(s * 100, s * 100 + r.randint(1, 8))]
    c = spark.createDataFrame(rows, "software long, seq long, name string, provider string, description string, score double").withColumn("version", F.lit("1"))

    def alike(x, y):
        d = plain_similarity(x[4], y[4]) if x[4] and y[4] else 0.0
        return round(min(1.0, 0.6 * plain_similarity(x[2], y[2]) + 0.3 * d + (0.1 if x[3] == y[3] else 0.03)), 6)

    want = {}
    for s in range(12):
        own = sorted((x for x in rows if x[0] == s), key=lambda x: x[1])
        taken = set()
        for i, x in enumerate(own):
            if i in taken:
                continue
            want[x[1]] = x[1]
            for j in range(i + 1, len(own)):
                if j not in taken and alike(x, own[j]) >= 0.6:
                    taken.add(j)
                    want[own[j][1]] = x[1]
    got = {x.seq: x.seed for x in search.similar_groups(c).collect()}
    assert got == want
    compared = search.compared(c).collect()
    sizes = defaultdict(int)
    for seed in want.values():
        sizes[seed] += 1
    assert {x.seed: x.n for x in compared} == {k: n for k, n in sizes.items() if n > 1}


def counted_ratios(spark, monkeypatch):
    """How many pairs of texts difflib compares from now on."""
    import pandas as pd
    from lodestone.functions import text

    n = spark.sparkContext.accumulator(0)

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        n.add(len(x))
        return pd.Series([SequenceMatcher(None, i or "", j or "").ratio() for i, j in zip(x, y, strict=True)], dtype=float)

    monkeypatch.setattr(text, "sequence_ratio", lambda a, b: F.pandas_udf(ratio, "double")(a, b))
    return n


def copies(n):
    """Packages of two software, most of them copies of a few; some have no name and aren't like themselves."""
    r = random.Random(8)
    names, said = ["nginx", "nginx-full", "nginx full", "web nginx", "httpd", "", None, "vim editor"], ["fast web server", "a fast web server for all", "text editor", "", None]
    kinds = [(r.choice(names), r.choice(["apt", "brew", None]), r.choice(said)) for _ in range(18)]
    return [(r.randrange(2), i, *r.choice(kinds), r.random()) for i in range(n)]


def grouped(rows, least):
    """Seeds of ``rows``, package by package, and what their descriptions share."""
    known = {}

    def ratio(x, y):
        if (x, y) not in known:
            known[x, y] = plain_similarity(x, y) if x and y else 0.0
        return known[x, y]

    seed, seeds = {}, defaultdict(list)
    for x in rows:
        like = [y for y in seeds[x[0]] if round(min(1.0, 0.6 * ratio(y[2], x[2]) + 0.3 * ratio(y[4], x[4]) + (0.1 if x[3] and x[3] == y[3] else 0.03)), 6) >= least]
        seed[x[1]] = like[0][1] if like else x[1]
        if not like:
            seeds[x[0]].append(x)
    alike = {}
    for s in set(seed.values()):
        own = [x[4] for x in rows if seed[x[1]] == s and x[4]]
        every = [ratio(a, b) for a, b in itertools.combinations(own, 2)]
        alike[s] = bool(every) and sum(every) / len(every) > 0.8
    return seed, alike


def catalog_of(spark, rows):
    return spark.createDataFrame(rows, "software long, seq long, name string, provider string, description string, score double").withColumn("version", F.lit("1")).repartition(5)


@pytest.mark.parametrize("least", [0.6, 0.35])
def test_copies_of_packages_are_compared_once(spark, monkeypatch, least):
    n, rows = counted_ratios(spark, monkeypatch), copies(240)
    got = {x.seq: x.seed for x in search.similar_groups(catalog_of(spark, rows), least=least).collect()}
    assert got == grouped(rows, least)[0]
    assert n.value <= 500  # all pairs of packages are 14,000


def test_packages_without_a_key_are_no_group(spark):
    rows = [(None, 1, "a", "apt", "x", 0.5), (None, 2, "a", "apt", "x", 0.5), (1, 3, "a", "apt", "x", 0.5), (1, 4, "a", "apt", "x", 0.5), (1, 4, "a", "apt", "x", 0.5)]
    assert sorted((x.seq, x.seed) for x in search.similar_groups(catalog_of(spark, rows)).collect()) == [(1, 1), (2, 2), (3, 3), (4, 3)]


@pytest.mark.parametrize("least", [0.6, 0.35])
def test_descriptions_of_copies_are_compared_once(spark, monkeypatch, least):
    """Each order of two descriptions counts as often as packages have them so."""
    n, rows = counted_ratios(spark, monkeypatch), copies(240)
    seed, alike = grouped(rows, least)
    got = {x.seed: (x.n, x.similar_descriptions) for x in search.compared(catalog_of(spark, rows), least=least).collect()}
    sizes = {s: list(seed.values()).count(s) for s in set(seed.values())}
    assert got == {s: (k, alike[s]) for s, k in sizes.items() if k > 1}
    assert n.value <= 1000


def test_json_of_rows():
    assert t.rows_of({"a": {"b": True, "c": []}, "d": None, "e": [1, "x"], "f": {}}) == [("a.b", "true", None), ("a.c", None, []), ("d", None, None), ("e", None, ["1", "x"])]
    assert json.loads("1") == 1
