"""Files of each format, written and read; streams against their batch forms."""

import io
import json
import plistlib
import tarfile

import pytest
from pyspark.sql import functions as F

from lodestone.operators import metrics
from lodestone.plans.views import view
from lodestone.sources import readers, sinks
from lodestone.streaming import health

SF = "/root/testdata/sf0.001"
FILES = {
    "apt": "Package: nginx\nVersion: 1.18\nDescription: web server\n fast one\nDepends: libc6 (>= 2), zlib1g\n\nPackage: vim\nVersion: 9\n",
    "opkg": "Package: nginx\nVersion: 1.18\nDescription: web server\n fast one\n\nPackage: vim\nVersion: 9\n",
    "apk": "P:nginx\nV:1.18\nT:web: server\n\nP:vim\nV:9\n",
    "slackpkg": "PACKAGE NAME:  nginx-1.18-x86_64-1.txz\nPACKAGE DESCRIPTION:\nnginx: web\nnginx: server\n\nPACKAGE NAME:  vim-9-x86_64-2.txz\n",
    "dnf": '<metadata><package type="rpm"><name>nginx</name><version epoch="1" ver="1.18" rel="2.el9"/><summary>web server</summary><format><rpm:license xmlns:rpm="r">BSD</rpm:license><rpm:requires xmlns:rpm="r"><rpm:entry name="systemd"/><rpm:entry name="/bin/sh"/></rpm:requires></format></package><package type="rpm"><name>vim</name><version epoch="0" ver="9" rel="1"/></package></metadata>',
    "brew": json.dumps([{"name": "nginx", "full_name": "t/nginx", "versions": {"stable": "1.18"}, "desc": "web server"}, {"name": ["vim"], "version": "9"}]),
    "pkg": '{"name": "nginx", "version": "1.18", "comment": "web server"}\nnot json\n{"name": "vim", "version": "9"}\n',
    "npm": json.dumps({"objects": [{"package": {"name": "nginx", "version": "1.18", "description": "web server"}}, {"package": {"name": "vim", "version": "9"}}]}),
    "cargo": json.dumps({"crates": [{"name": "nginx", "max_version": "1.18"}, {"name": "vim", "max_version": "9"}]}),
    "nix": json.dumps({"nginx-1.18": {"meta": {"description": "web server"}}, "x": {"name": "vim-9", "version": "9"}}),
    "emerge": "*  www/nginx\n  Latest version available: 1.18\n  Description: web server\n\n*  app/vim\n  Latest version available: 9\n",
}


@pytest.mark.parametrize("kind", sorted(FILES))
def test_readers(spark, tmp_path, kind):
    (tmp_path / "f").write_text(FILES[kind])
    got = {r.name.split("/")[-1]: r for r in readers.catalog(spark, {kind: str(tmp_path / "f")}).collect()}
    assert set(got) == {"nginx", "vim"} and "1.18" in got["nginx"].version and got["vim"].version.startswith("9")
    if kind == "apt":
        assert got["nginx"].depends == ["libc6", "zlib1g"] and got["nginx"].description == "web server\\nfast one"
    if kind == "opkg":
        assert got["nginx"].description == "web server"
    if kind == "dnf":
        assert (got["nginx"].version, got["nginx"].depends, got["vim"].version) == ("1:1.18-2.el9", ["systemd"], "9-1")


def test_binary_readers(spark, tmp_path):
    desc = b"%NAME%\nnginx\n\n%VERSION%\n1.18-1\n\n%DESC%\nweb server\n\n%DEPENDS%\nglibc\npcre\n"
    with tarfile.open(tmp_path / "core.db", "w:gz") as tar:
        info = tarfile.TarInfo("nginx-1.18-1/desc")
        info.size = len(desc)
        tar.addfile(info, io.BytesIO(desc))
    (tmp_path / "core.bad").write_bytes(b"no archive")
    r = readers.pacman(spark, str(tmp_path / "core.*")).collect()
    assert [(x.name, x.version, list(x.depends)) for x in r] == [("nginx", "1.18-1", ["glibc", "pcre"])]
    (tmp_path / "index.plist").write_bytes(plistlib.dumps({"vim": {"pkgver": "vim-9_1", "short_desc": "editor"}}))
    assert [tuple(x)[:3] for x in readers.xbps(spark, str(tmp_path / "index.plist")).collect()] == [("vim", "9_1", "editor")]


def test_file_per_package(spark, tmp_path):
    (tmp_path / "vim.json").write_text('{"version": "9", "license": {"identifier": "Vim"}}')
    (tmp_path / "nginx-1.18.ebuild").write_text('DESCRIPTION="web server"\nDEPEND="dev-libs/openssl-1.1 sys-libs/zlib:="\n')
    (tmp_path / "package.py").write_text('class PyNumpy(Package):\n    """Arrays."""\n    homepage = "https://numpy.org"\n    version("2.1", sha256="x")\n    version("2.0")\n')
    (tmp_path / "names.txt").write_text("# list\nvim\n\n nginx \n")
    assert tuple(readers.scoop(spark, str(tmp_path / "vim.json")).first())[:2] == ("vim", "9")
    e = readers.ebuilds(spark, str(tmp_path / "nginx-1.18.ebuild")).first()
    assert (e.name, e.version, e.depends) == ("nginx", "1.18", ["dev-libs/openssl", "sys-libs/zlib"])
    assert tuple(readers.spack(spark, str(tmp_path / "package.py")).first())[:4] == ("py-numpy", "2.1", "Arrays.", "https://numpy.org")
    assert [r.name for r in readers.names(spark, str(tmp_path / "names.txt")).collect()] == ["vim", "nginx"]
    with pytest.raises(TypeError):
        readers.register("x", 1)


def test_repaired_json(spark):
    rows = spark.createDataFrame([("{'a': 1,}",), ('{"a":2}',), ("nope",)], "c string")
    assert [r[0] for r in rows.select(readers.repaired_json(F.col("c"))).collect()] == ['{"a":1}', '{"a":2}', None]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, ("x", ["p", "q"]), "s")], "id long, d struct<n:string,l:array<string>>, source string")
    sinks.export(rows, str(tmp_path / "j"), "jsonl", metadata=False)
    assert spark.read.json(str(tmp_path / "j")).columns == ["d", "id"]
    sinks.export(rows, str(tmp_path / "c"), "csv")
    got = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert got.columns == ["d_l", "d_n", "id", "source"] and got.first().d_l == "p, q"
    assert sinks.export(rows, str(tmp_path / "p"), "parquet").count() == 1
    with pytest.raises(ValueError):
        sinks.export(rows, str(tmp_path / "x"), "xls")


def drain(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    keyed = lambda e: e.where("event_type = 'error'").selectExpr("'user=' || (user_id % 7) AS key", "unix_seconds(cast(ts as timestamp)) AS ts", "event_id AS id")
    got = {(r.id, r.recent, r.unavailable) for r in drain(spark, health.provider_health(keyed(stream)), "health").collect()}
    assert got == {(r.id, r.recent, r.unavailable) for r in metrics.failure_windows(view(spark, SF, "metrics").where("name = 'error'")).collect()}
    n = drain(spark, health.windowed_metrics(stream), "windows").agg(F.sum("n")).first()[0]
    assert 0 < n <= events.count()
    assert health.retained(events, 10**10).count() == 0


def test_choco_and_winget(spark, tmp_path):
    feed = '<feed xmlns:d="x"><title>All</title><entry><id>http://x/Packages</id><title type="text">nginx</title><d:Version>1.18</d:Version><d:Dependencies>zlib:1.2:|perl::</d:Dependencies></entry></feed>'
    spec = '<package><metadata><id>vim</id><version>9</version><summary>editor</summary><dependencies><dependency id="git" version="2" /></dependencies></metadata></package>'
    (tmp_path / "a.xml").write_text(feed)
    (tmp_path / "b.xml").write_text(spec)
    got = {r.name: r for r in readers.choco(spark, str(tmp_path / "*.xml")).collect()}
    assert set(got) == {"nginx", "vim"} and (got["nginx"].version, got["nginx"].depends) == ("1.18", ["zlib", "perl"])
    assert (got["vim"].version, got["vim"].description, got["vim"].depends) == ("9", "editor", ["git"])
    (tmp_path / "v1.yaml").write_text("PackageIdentifier: Vim.Vim\nPackageVersion: 8\nLicense: Vim\n")
    (tmp_path / "v2.yaml").write_text("PackageIdentifier: Vim.Vim\nPackageVersion: '9'\nShortDescription: editor\r\n")
    (tmp_path / "Nano.installer.yaml").write_text("PackageVersion: 7\n")
    got = {r.name: tuple(r)[1:5] for r in readers.winget(spark, str(tmp_path / "*.yaml")).collect()}
    assert got == {"Vim.Vim": ("9", "editor", None, "Vim"), "Nano": ("7", None, None, None)}


def test_trees(spark, tmp_path):
    rows = spark.createDataFrame([("vim", "apt", "a.b", 'x "y"'), ("vim", "apt", "a.a", "1"), ("vim", "brew", "a", ""), ("vim", "brew", "b", None)], "name string, provider string, path string, value string")
    sinks.export_trees(rows, str(tmp_path / "t"))
    back = spark.read.text(str(tmp_path / "t")).collect()
    assert sorted(r.value for r in back) == ['"a.a": "1"', '"a.b": "x \\"y\\""'] and {(r.name, r.provider) for r in back} == {("vim", "apt")}
