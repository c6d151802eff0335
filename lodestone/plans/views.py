"""Views of the driver's tables as package catalogs, metadata documents, instruction pairs, metrics and caches.

Each column is given once, as SQL that Spark and DuckDB share but for a few spellings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROVIDERS = "apt brew npm pypi docker winget snap cargo dnf scoop nix unknown choco".split()
_PICK = "CASE doc_id % 13 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PROVIDERS)) + " END"
_TEXT = "replace(text, chr(10), ' ')"

#: Sources of packages: 20 for each software.
CATALOG = {
    "software": "doc_id div 20",
    "seq": "doc_id",
    "provider": _PICK,
    "name": "CASE doc_id % 4 WHEN 0 THEN 'lib' WHEN 1 THEN 'python-' ELSE '' END || 'pkg_' || lang || CASE doc_id % 3 WHEN 0 THEN '-dev' ELSE '' END || (doc_id % 7)",
    "version": "CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 3) || '.' || (doc_id % 7) || '.' || (doc_id % 23) END",
    "description": _TEXT,
    "license": "CASE doc_id % 8 WHEN 0 THEN 'MIT' WHEN 1 THEN 'MIT License' WHEN 2 THEN 'Apache License 2.0' WHEN 3 THEN 'GPL v3' WHEN 4 THEN 'BSD-3-Clause' WHEN 5 THEN 'Custom' WHEN 6 THEN 'Apache-2.0' END",
    "homepage": "CASE doc_id % 5 WHEN 0 THEN 'https://example.org/' || source WHEN 1 THEN 'http://example.com' WHEN 2 THEN 'example.net/x' WHEN 3 THEN '' END",
    "source_url": "CASE doc_id % 3 WHEN 0 THEN 'https://git.example.org/p' || (doc_id % 10) END",
    "platforms": "CASE doc_id % 4 WHEN 0 THEN array('linux', 'debian') WHEN 1 THEN array('macos', 'linux') WHEN 2 THEN array('windows') END",
    "category": "CASE doc_id % 6 WHEN 0 THEN 'web' WHEN 1 THEN 'database' WHEN 2 THEN 'webserver' WHEN 3 THEN 'Games' END",
    "score": "(doc_id % 100) / 100.0e0",
    "ts": "CASE WHEN doc_id % 5 <> 0 THEN (doc_id * 37) % 1009 END",
}
PAIRS = {
    "id": "doc_id",
    "instruction": "CASE doc_id % 3 WHEN 0 THEN 'Generate a summary of this package' WHEN 1 THEN 'Categorize' ELSE 'Enhance the text' END",
    "input": "'software ' || replace(text, chr(10), ' ')",
    "output": "CASE WHEN doc_id % 17 = 0 THEN 'TODO: write' ELSE replace(text, chr(10), ' ') END",
    "category": "CASE doc_id % 6 WHEN 0 THEN 'web' WHEN 1 THEN 'database' WHEN 2 THEN 'database' WHEN 3 THEN 'tool' WHEN 4 THEN 'tool' END",
    "template": "CASE WHEN doc_id % 10 < 7 THEN 'generate_metadata' END",
    "confidence": "CASE WHEN doc_id % 12 <> 5 THEN (doc_id % 101) / 100.0e0 END",
}
METRICS = {"name": "event_type", "key": "'user=' || (user_id % 7)", "value": "value", "ts": "epoch_s", "id": "event_id"}
CONFIG = {
    "provider": "'p' || (s_suppkey % 10)",
    "path": "'settings.' || CASE s_suppkey % 3 WHEN 0 THEN 'nation' WHEN 1 THEN 'level' ELSE 'limit' END || '.k' || (s_suppkey div 10 % 20)",
    "value": "CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN '' ELSE 'v' || (s_nationkey % 4) END",
    "seq": "s_suppkey",
}
#: Leaves of layered documents, some of them lists, some at and below the same path in different layers.
LAYERS = {
    "doc": "o_orderkey % 97 || '-' || (o_orderkey div 2328)",
    "seq": "(o_orderkey div 97) % 4",
    "path": "CASE (o_orderkey div 388) % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'a.b' WHEN 2 THEN 'a.b.c' WHEN 3 THEN 'l' WHEN 4 THEN 'l.x' ELSE 'a.d' END",
    "value": "CASE WHEN (o_orderkey div 388) % 6 = 3 AND o_custkey % 4 <> 1 THEN NULL WHEN o_custkey % 5 = 0 THEN NULL ELSE 'v' || (o_custkey % 3) END",
    "items": "CASE WHEN (o_orderkey div 388) % 6 = 3 AND o_custkey % 4 <> 1 THEN array('i' || (o_custkey % 3), 'i' || (o_custkey % 7), 'i' || (o_custkey % 3)) END",
}
#: Configurations of providers with sections, of a few software packages.
SECTIONS = {
    "software": "'s' || (o_orderkey % 11)",
    "provider": "CASE o_custkey % 4 WHEN 0 THEN 'apt' WHEN 1 THEN 'brew' WHEN 2 THEN 'winget' ELSE 'npm' END",
    "path": "CASE o_custkey % 9 WHEN 0 THEN 'packages.default.name' WHEN 1 THEN 'packages.other.name' WHEN 2 THEN 'services.web.enabled' WHEN 3 THEN 'services.default.enabled' WHEN 4 THEN 'description' WHEN 5 THEN 'urls.website' WHEN 6 THEN 'ports.http.port' WHEN 7 THEN 'supported' ELSE 'version' END",
    "value": "CASE WHEN o_custkey % 9 = 7 THEN CASE WHEN o_custkey % 7 = 0 THEN 'false' ELSE 'true' END WHEN o_custkey % 13 = 0 THEN '' WHEN o_custkey % 17 = 0 THEN NULL ELSE o_orderpriority || ' /usr/' || (o_custkey % 5) END",
    "seq": "o_orderkey",
}
_J = """'{"version": ' || CASE doc_id % 5 WHEN 0 THEN '"0.1"' WHEN 1 THEN '0.1' WHEN 2 THEN 'null' WHEN 3 THEN '""' ELSE '[1]' END
    || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ', "description": "fine"' WHEN 2 THEN ', "description": " "' ELSE ', "description": {}' END
    || ', "urls": ' || CASE doc_id % 6 WHEN 0 THEN '{}' WHEN 1 THEN '{"website": "https://e.org", "source": "http://e.org"}' WHEN 2 THEN '{"website": "e.org"}' WHEN 3 THEN 'null' WHEN 4 THEN '{"website": 7}' ELSE '{"website": "https://e.org", "source": "https://s", "documentation": "https://d", "support": ""}' END
    || ', "category": ' || CASE doc_id % 3 WHEN 0 THEN '{"default": "web"}' WHEN 1 THEN '{"sub": "x"}' ELSE '"web"' END
    || ', "platforms": ' || CASE doc_id % 7 WHEN 0 THEN '[]' WHEN 1 THEN '["linux", 3]' WHEN 2 THEN '"linux"' ELSE '["linux"]' END
    || ', "packages": ' || CASE doc_id % 4 WHEN 0 THEN '{"default": {"name": "x"}}' WHEN 1 THEN '{"default": {"version": "1"}}' WHEN 2 THEN '{}' ELSE '{"a": {"name": ""}, "b": {"name": 5}}' END
    || ', "ports": {"http": {"port": ' || CASE doc_id % 5 WHEN 0 THEN '80' WHEN 1 THEN '70000' WHEN 2 THEN '"80"' WHEN 3 THEN 'null' ELSE '0' END || ', "protocol": "tcp"}}}'"""
#: Documents as JSON texts; some are cut off.
JSONS = {"seq": "doc_id", "json": f"CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN left({_J}, 40) ELSE {_J} END"}
#: Packages whose descriptions are much alike.
PRODUCTS = {
    "software": "p_partkey % 40",
    "seq": "p_partkey",
    "name": "lower(p_name) || CASE p_partkey % 5 WHEN 0 THEN ' pro' ELSE '' END",
    "provider": "CASE p_partkey % 4 WHEN 0 THEN 'apt' WHEN 1 THEN 'brew' WHEN 2 THEN 'npm' ELSE 'snap' END",
    "version": "'1.' || (p_partkey % 3)",
    "description": "CASE WHEN p_partkey % 9 <> 0 THEN 'The ' || p_name || ' as it is packaged for all systems' || CASE p_partkey % 2 WHEN 0 THEN ', small' ELSE '' END END",
    "score": "(p_partkey % 100) / 100.0e0",
}
_OF = {"products": ("part", PRODUCTS), "layers": ("orders", LAYERS), "sections": ("orders", SECTIONS), "jsons": ("documents", JSONS), "catalog": ("documents", CATALOG), "pairs": ("documents", PAIRS), "metrics": ("events", METRICS), "config": ("supplier", CONFIG)}
_EPOCH = {"spark": "unix_seconds(cast(ts as timestamp))", "duckdb": "CAST(floor(epoch(ts)) AS BIGINT)"}


def _spelled(text: str, engine: str) -> str:
    text = text.replace("epoch_s", _EPOCH[engine])
    return text.replace("array(", "list_value(").replace(" div ", " // ") if engine == "duckdb" else text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = _OF[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{_spelled(v, 'spark')} AS {k}" for k, v in columns.items()))


def view_sql(name: str) -> str:
    table, columns = _OF[name]
    return f"{name} AS (SELECT {', '.join(f'{_spelled(v, 'duckdb')} AS {k}' for k, v in columns.items())} FROM {table})"
