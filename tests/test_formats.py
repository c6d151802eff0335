"""Further formats of sources and sinks: written, read, damaged and repaired."""

import io
import json
import plistlib
import tarfile

import pytest
import yaml
from pyspark.sql import functions as F

from lodestone.sources import readers, sinks


def written(tmp_path, **files):
    for name, body in files.items():
        (tmp_path / name).write_bytes(body if isinstance(body, bytes) else body.encode())
    return lambda name: str(tmp_path / name)


def names(df):
    return {(x.name, x.version, x.description) for x in df.collect()}


def test_registries(spark, tmp_path):
    at = written(
        tmp_path,
        npm_details=json.dumps({"name": "vim", "dist-tags": {"latest": "9"}, "description": "editor", "repository": {"url": "git:x"}}),
        pypi=json.dumps({"info": {"name": "Vim", "version": "9", "summary": "editor", "author": "b"}}),
        docker=json.dumps({"results": [{"name": "vim", "namespace": "me", "star_count": 3, "pull_count": 9}, {"name": "nginx", "namespace": "library"}, {"name": "own"}]}),
        cargo_details=json.dumps({"crate": {"name": "vim", "max_version": "9", "downloads": 5}, "versions": [{"license": "MIT"}]}),
        snap=json.dumps({"_embedded": {"clickindex:package": [{"package_name": "vim", "version": "9", "summary": "editor"}]}}),
        flatpak=json.dumps([{"id": "org.vim", "currentReleaseVersion": "9", "summary": "editor"}]),
        nuget=json.dumps({"data": [{"id": "Vim", "version": "9", "description": "editor", "totalDownloads": 7}]}),
        index=json.dumps({"resources": [{"@id": "https://s", "@type": "SearchQueryService"}, {"@type": "x"}]}),
        brew=json.dumps([{"name": "vim", "full_name": "t/vim", "versions": {"stable": "9"}, "revision": 1}, {"token": "app", "name": ["App"], "version": "1"}]),
    )
    of = lambda k: readers.registry(spark, at(k), k)
    for k in ("npm_details", "pypi", "cargo_details", "snap", "nuget"):
        assert {n.lower() for n, _, _ in names(of(k))} == {"vim"} and {v for _, v, _ in names(of(k))} == {"9"}
    assert names(of("flatpak")) == {("org.vim", "9", "editor")} and {n for n, _, _ in names(of("docker"))} == {"me/vim", "nginx", "own"}
    more = lambda k: {tuple(x) for x in readers.details(spark, at(k), k).collect()}
    assert {("me/vim", "stars", "3"), ("me/vim", "pulls", "9")} <= more("docker") and ("vim", "downloads", "5") in more("cargo_details") and ("vim", "repository", "git:x") in more("npm_details")
    assert {("vim", "brew_type", "formula"), ("App", "brew_type", "cask"), ("vim", "revision", "1")} <= more("brew")
    assert [tuple(x) for x in readers.nuget_services(spark, at("index")).collect()] == [("SearchQueryService", "https://s")]


def test_listings_without_json(spark, tmp_path):
    at = written(
        tmp_path, guix_text="vim 9.1 a text editor\nnot a package line\nnginx\t1.18\n", guix_json=json.dumps([{"name": "vim", "version": "9", "synopsis": "editor", "home-page": "https://v"}]),
        nix_text="legacyPackages.x86.vim (9.1) an editor\n\nnixpkgs.nginx (1.18)\n", spack_json=json.dumps({"vim": {"description": "editor", "versions": ["9", "8"], "dependencies": ["ncurses"]}}),
    )
    assert names(readers.guix(spark, at("guix_text"))) == {("vim", "9.1", "a text editor"), ("nginx", "1.18", None)}
    g = readers.guix(spark, at("guix_json")).first()
    assert (g.name, g.version, g.homepage) == ("vim", "9", "https://v")
    assert names(readers.nix(spark, at("nix_text"))) == {("vim", "9.1", "an editor"), ("nginx", "1.18", None)}
    s = readers.spack(spark, at("spack_json")).first()
    assert (s.name, s.version, s.description, s.depends) == ("vim", "9", "editor", ["ncurses"])


def archive(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, body in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return out.getvalue()


def test_archives_and_indexes(spark, tmp_path):
    whole = archive({"vim-9/desc": b"%NAME%\nvim\n\n%VERSION%\n9\n", "vim-9/depends": b"%DEPENDS%\nglibc\nncurses\n\n%OPTDEPENDS%\nx\n", "nano-1/desc": b"%NAME%\nnano\n"})
    at = written(tmp_path, whole=whole, broken=b"no archive", list=plistlib.dumps({"packages": [{"pkgname": "vim", "pkgver": "vim-9_1", "short_desc": "editor"}]}), meta=json.dumps({"vim": {"pkgver": "vim-9", "run_depends": ["x"]}, "note": "no package"}))
    got = {x.name: (x.version, x.depends) for x in readers.pacman(spark, at("*ole")).collect()}
    assert got == {"vim": ("9", ["glibc", "ncurses"]), "nano": (None, [])}
    assert readers.pacman(spark, at("broken")).count() == 0
    bad = readers.damaged(spark, at("[wb]*"), "pacman").collect()
    assert len(bad) == 1 and bad[0].file.endswith("broken") and "ReadError" in bad[0].problem
    assert names(readers.xbps(spark, at("list"))) == {("vim", "9_1", "editor")} and names(readers.xbps(spark, at("meta"))) == {("vim", "9", None)}


def test_missing_libraries_are_errors(spark, tmp_path):
    def parse(content):
        raise ImportError("no such library")

    at = written(tmp_path, f="x")
    with pytest.raises(Exception, match="no such library"):
        readers._in_batches(spark, at("f"), parse).count()


def test_helm(spark, tmp_path):
    at = written(tmp_path, index="entries:\n  vim:\n  - {version: 9.1.0, description: editor, home: https://v}\n  - {version: 8.0.0}\n  none: []\n", bad="entries: [")
    assert names(readers.helm(spark, at("index"))) == {("vim", "9.1.0", "editor")}
    assert readers.damaged(spark, at("bad"), "helm").count() == 1


def test_repositories(spark, tmp_path):
    primary = '<metadata><package type="rpm"><name>vim</name><version epoch="0" ver="9" rel="1"/><summary>e</summary></package></metadata>'
    at = written(
        tmp_path,
        repomd='<repomd xmlns="http://linux.duke.edu/metadata/repo"><data type="primary"><checksum type="sha256">ab</checksum><location href="repodata/p.xml.gz"/></data><data type="other"><location href="o"/></data></repomd>',
        mirrors='<metalink xmlns="http://www.metalinker.org/"><files><file><resources><url protocol="https" type="https">https://a/repomd.xml</url><url protocol="rsync">rsync://b</url><url preference="9" protocol="http">http://c</url></resources></file></files></metalink>',
        Release="Origin: Debian\nComponents: main contrib\nSHA256:\n ab 1 main/Packages\n cd 2 x\nSuite: stable\n", p1=primary, p2=primary.replace("vim", "nano"),
    )
    assert {x.type: (x.location, x.checksum) for x in readers.repomd(spark, at("repomd")).collect()} == {"primary": ("repodata/p.xml.gz", "ab"), "other": ("o", None)}
    assert [x.url for x in readers.metalink(spark, at("mirrors")).orderBy("place").collect()] == ["https://a/repomd.xml", "http://c"]
    assert {x.key: x.value for x in readers.release(spark, at("Release")).collect()} == {"Origin": "Debian", "Components": "main contrib", "SHA256": "ab 1 main/Packages cd 2 x", "Suite": "stable"}
    got = {(x.name, x.distribution, x.arch) for x in readers.rpm_repositories(spark, {("f40", "x86"): at("p1"), ("f40", "arm"): at("p2")}).collect()}
    assert got == {("vim", "f40", "x86"), ("nano", "f40", "arm")}


def test_names_of_cached_files(spark, tmp_path):
    shapes = {
        "brew": ({"vim": {}, "nano": 1}, {"vim", "nano"}),
        "npm": ({"objects": [{"package": {"name": "vim"}}, {"x": 1}]}, {"vim"}),
        "pypi": ([{"name": "vim"}, {"title": "x"}], {"vim"}),
        "apt": ([{"Package": "vim"}, {"package": "nano", "Package": "no"}, "ed"], {"vim", "nano", "ed"}),
        "dnf": ({"packages": {"vim": {}}}, {"vim"}),
        "yum": ({"packages": ["vim"]}, {"vim"}),
        "zypper": ({"vim": 1, "nano": 2}, {"vim", "nano"}),
        "snap": ({"results": [{"title": "vim"}, {"package": "nano"}, "ed"]}, {"results", "vim", "nano", "ed"}),
        "helm": ([{"name": "vim"}, "nano"], {"vim", "nano"}),
    }
    for manager, (shape, want) in shapes.items():
        at = written(tmp_path, **{manager: json.dumps(shape)})
        assert {x.name for x in readers.cached_names(spark, at(manager), manager).collect()} == want, manager
    at = written(tmp_path, bad="{")
    assert readers.cached_names(spark, at("bad"), "apt").count() == 0


def test_yaml_documents(spark, tmp_path):
    at = written(tmp_path, a="a:\n  b: 1\n  l: [x, 2]\nc: true\n", b="\ufeffa:\n\tb: 1\n", c="a: [", d="- 1\n", e="", f="n: caf\xe9\n".encode("latin-1"))
    got = {}
    for x in readers.yaml_documents(spark, at("*")).collect():
        got.setdefault(x.file[-1], []).append((x.path, x.value, x["items"], bool(x.problem)))
    assert sorted(got["a"]) == [("a.b", "1", None, False), ("a.l", None, ["x", "2"], False), ("c", "true", None, False)]
    assert got["b"] == [("a.b", "1", None, False)] and got["c"][0][3] and got["d"][0][3] and "e" not in got and got["f"] == [("n", "café", None, False)]


def test_repairs(spark):
    one = spark.createDataFrame([("\ufeff<a>\x01b</a>\x7f", b"caf\xc3\xa9", b"caf\xe9")], "x string, u binary, l binary")
    assert tuple(one.select(readers.repaired_xml(F.col("x")), readers.decoded(F.col("u")), readers.decoded(F.col("l"))).first()) == ("<a>b</a>", "café", "café")


def test_exports(spark, tmp_path):
    rows = spark.range(20).selectExpr("id", "named_struct('n', 'é' || id, 'l', array('p', 'q')) AS d", "'s' AS source")
    for kind in ("jsonl", "csv", "parquet"):
        r = sinks.export_report(rows, str(tmp_path / kind), kind)
        assert (r.kind, r.count) == (kind, 20) and r.bytes > 0
        assert sinks.export(rows, str(tmp_path / kind), kind, metadata=False).count() == 20
    assert "é1" in next((tmp_path / "jsonl").glob("*.json")).read_text()
    with pytest.raises(ValueError):
        sinks.export_report(rows, str(tmp_path / "x"), "xls")


def test_nested_yaml(spark):
    leaves = [("vim", "apt", "a.b", "x: 1", None), ("vim", "apt", "a.c", None, ["p", "q"]), ("vim", "apt", "z", "", None), ("vim", "brew", "a", None, None)]
    rows = spark.createDataFrame(leaves, "name string, provider string, path string, value string, items array<string>")
    got = {(x.name, x.provider): yaml.safe_load(x.value) for x in sinks.nested_yaml(rows).collect()}
    assert got == {("vim", "apt"): {"a": {"b": "x: 1", "c": ["p", "q"]}}}
