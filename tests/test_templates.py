"""Templates of configuration trees, and URL resolution."""

import pytest

from lodestone.operators import templates as t

KNOWN = {"name": "nginx", "os": {"kind": "linux"}, "ports": [80, 443], "platforms": ["linux"]}


def test_directives():
    tree = {
        "id": "$name", "{{ name }}_x": "${os.kind|any} ${none|d}",
        "$if: name == 'apache'": {"a": 1}, "$elif: os.kind in ['linux', 'macos'] and not none": {"b": 2}, "$else": {"c": 3},
        "$platform: windows": {"w": 1},
        "$for: p in ports": {"port_$p": "on $p"},
        "$include": "extra",
        "$function: upper($name)": "loud",
    }
    assert t.rendered(tree, KNOWN, {"extra": {"e": ["$name"]}}) == {"id": "nginx", "nginx_x": "linux d", "b": 2, "port_80": "on 80", "port_443": "on 443", "e": ["nginx"], "loud": "NGINX"}
    with pytest.raises(ValueError):
        t.rendered({"$include": "a"}, {}, {"a": {"$include": "a"}})
    with pytest.raises(ValueError):
        t.rendered({"$function: nothing(1)": "x"}, {})
    with pytest.raises(TypeError):
        t.register_function("x", 1)


def test_merging():
    base, over = {"a": {"x": 1, "y": 2}, "l": [1, 2], "n": 1}, {"a": {"x": None}, "l": [2, 3], "n": None}
    assert t.merged(base, over) == {"a": {"x": None, "y": 2}, "l": [1, 2, 3], "n": None}
    assert t.merged(base, over, deletes=True) == {"a": {"y": 2}, "l": [2, 3]}
    assert t.differences({"a": {"x": 1, "y": 3}, "b": 1}, {"a": {"x": 1, "y": 2}, "b": True}) == {"a": {"y": 3}, "b": 1}
    assert t.flattened({"a": {"b": [1], "c": {}}, "d": 2}) == {"a.b": [1], "a.c": {}, "d": 2}
    assert t.at_path({"a": [{"b": 5}]}, "a[0].b") == 5 and t.at_path({"a": []}, "a[0].b") is None


def test_urls(spark):
    urls = spark.createDataFrame([("apt", None, None, "https://d/{name}"), ("apt", "ubuntu", None, "https://u/{{name}}/{other}"), ("apt", "ubuntu", "22", "https://u22")], "provider string, os string, version string, url string")
    asked = spark.createDataFrame([("apt", "debian", "1", "vim"), ("apt", "ubuntu", "20", "vim"), ("apt", "ubuntu", "22", "vim"), ("npm", "x", "1", "vim")], "provider string, os string, version string, name string")
    got = {(r.provider, r.os, r.version): r.url for r in t.resolved_urls(asked, urls, "name").collect()}
    assert got == {("apt", "debian", "1"): "https://d/vim", ("apt", "ubuntu", "20"): "https://u/vim/{other}", ("apt", "ubuntu", "22"): "https://u22", ("npm", "x", "1"): None}
