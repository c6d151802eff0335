"""Configuration templates, compiled on the driver: conditionals, loops, includes and functions in trees of plain values.

Keys with a dollar sign are directives. What a template says is decided once for each set of known names; columns are
filled in by :func:`lodestone.operators.documents.substituted`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Collection, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import expressions

Tree = dict | list | str | int | float | bool | None



def _yaml(tree: Tree) -> str:
    import yaml

    return yaml.dump(tree, default_flow_style=False)


def _joined(items, sep: str = ",") -> str:
    return sep.join(map(str, items)) if isinstance(items, list | tuple) else str(items)


FUNCTIONS: dict[str, Callable] = {
    "lower": lambda x: str(x).lower(), "upper": lambda x: str(x).upper(), "capitalize": lambda x: str(x).capitalize(), "title": lambda x: str(x).title(), "strip": lambda x: str(x).strip(), "len": lambda x: len(x) if hasattr(x, "__len__") else 0,
    "join": _joined, "split": lambda x, sep=",": x.split(sep) if isinstance(x, str) else [x], "replace": lambda x, old, new: str(x).replace(old, new), "format": lambda f, *a, **k: str(f).format(*a, **k), "json": json.dumps, "yaml": _yaml,
}


def register_function(name: str, function: Callable) -> None:
    """Adds a function that templates can call."""
    if not callable(function):
        raise TypeError(f"{name} is no function")
    FUNCTIONS[name] = function


def at_path(tree: Tree, path: str) -> Tree:
    """The value at ``a.b[0]``; None if there is none."""
    for key, index in re.findall(r"([^.\[\]]+)|\[(\d+)\]", path):
        if index:
            tree = tree[int(index)] if isinstance(tree, list) and int(index) < len(tree) else None
        else:
            tree = tree.get(key) if isinstance(tree, dict) else None
    return tree


def merged(base: Tree, over: Tree, deletes: bool = False) -> Tree:
    """``over`` laid on ``base``. Lists are joined without repeats and null is a value; or, if it ``deletes``, lists are
    replaced, and null and emptied objects go."""
    if not (isinstance(base, dict) and isinstance(over, dict)):
        if isinstance(base, list) and isinstance(over, list) and not deletes:
            return base + [x for x in over if x not in base]
        return over
    out = dict(base)
    for k, v in over.items():
        if deletes and v is None:
            out.pop(k, None)
        else:
            out[k] = merged(base.get(k), v, deletes) if k in base else v
            if deletes and out[k] == {}:
                del out[k]
    return out


def differences(tree: dict, defaults: dict) -> dict:
    """What of ``tree`` is not in ``defaults`` with the same value and type."""
    out = {}
    for k, v in tree.items():
        known = defaults.get(k)
        if isinstance(v, dict) and isinstance(known, dict):
            if inner := differences(v, known):
                out[k] = inner
        elif k not in defaults or v != known or type(v) is not type(known):
            out[k] = v
    return out


def flattened(tree: Tree, separator: str = ".", prefix: str = "") -> dict[str, Tree]:
    if not isinstance(tree, dict):
        return {prefix: tree}
    out = {}
    for k, v in tree.items():
        path = f"{prefix}{separator}{k}" if prefix else k
        out |= flattened(v, separator, path) if isinstance(v, dict) and v else {path: v}
    return out


def _literal(text: str, known: Mapping) -> Tree:
    """A number, truth value, null, quoted text, or what a name stands for."""
    text = text.strip()
    if text[:1] == "$":
        return at_path(dict(known), text[1:])
    if len(text) > 1 and text[0] in "'\"" and text[0] == text[-1]:
        return text[1:-1]
    try:
        return json.loads(text.lower() if text.lower() in ("true", "false", "null") else text)
    except ValueError:
        return text


def truth(expression: str, known: Mapping) -> bool:
    """A condition of :mod:`lodestone.operators.expressions`; a name that is not known stands for itself, but for its truth."""
    names = dict(known)

    def value(x: expressions.Node) -> Tree:
        kind, of = x
        if kind == "list":
            return [value(i) for i in of]
        found = at_path(names, of) if kind == "name" and re.fullmatch(r"[A-Za-z_][\w.\[\]]*", of) else None
        return of if kind == "text" else found if found is not None else _literal(of, known)

    def holds(x: expressions.Node) -> bool:
        kind, *of = x
        if kind in ("or", "and"):
            return (any if kind == "or" else all)(holds(p) for p in of[0])
        if kind == "not":
            return not holds(of[0])
        if kind in ("exists", "truth"):
            found = of[0][1] if of[0][0] == "text" else at_path(names, of[0][1])
            return found is not None if kind == "exists" else bool(found)
        a, b = value(of[0]), value(of[1])
        if kind in ("==", "!="):
            return (a == b) == (kind == "==")
        return (a in (b or ())) == (kind == "in")

    return holds(expressions.parse(expression))


def _filled(text: str, known: Mapping) -> str:
    def one(m: re.Match) -> str:
        name, default = m[1] or m[3] or m[5], m[2] if m[2] is not None else m[4]
        found = at_path(dict(known), name)
        return str(found) if found is not None else default.strip() if default is not None else m[0]

    return re.sub(r"\$\{([\w.]+)(?:\|([^}]*))?\}|\{\{\s*([\w.]+)\s*(?:\|\s*([^}]*?)\s*)?\}\}|\$(\w+)", one, text)


def _called(out: dict, call: str, value: Tree, known: Mapping) -> dict:
    """``out`` with the result of ``name(args)``: an object is merged; else it is stored under the text ``value``, which
    otherwise gives further arguments, by name or by place. What fails leaves its error under a key of its own."""
    m = re.fullmatch(r"(\w+)(?:\((.*)\))?", call)
    if not m or m[1] not in FUNCTIONS:
        raise ValueError(f"unknown function in {call!r}")
    args, named = [], {}
    given = lambda x: _literal(x, known) if isinstance(x, str) else x
    for a in re.findall(r"""(?:"[^"]*"|'[^']*'|[^,"'])+""", m[2] or ""):
        key, eq, rest = a.strip().partition("=")
        if eq and re.fullmatch(r"\w+", key.strip()):
            named[key.strip()] = given(rest.strip())
        else:
            found = at_path(dict(known), a.strip()) if re.fullmatch(r"[A-Za-z_][\w.\[\]]*", a.strip()) else None
            args.append(given(a.strip()) if found is None else found)
    if isinstance(value, dict):
        named |= {k: given(v) for k, v in value.items()}
    elif isinstance(value, list):
        args += [given(v) for v in value]
    elif not isinstance(value, str):
        args.append(value)
    try:
        result = FUNCTIONS[m[1]](*args, **named)
    except Exception as e:  # whatever a registered function raises is the template's, not ours
        return {**out, f"_function_error_{len(out)}": str(e)}
    if isinstance(result, dict):
        return {**out, **result}
    return {**out, value if isinstance(value, str) else f"_function_result_{len(out)}": result}


def rendered(tree: Tree, known: Mapping, includes: Mapping[str, Tree] | None = None, depth: int = 0) -> Tree:
    """``tree`` with its directives carried out, in order of its keys: ``$if: e``, ``$elif: e``, ``$else``,
    ``$platform: p``, ``$for: x in path``, ``$include: name`` (each with a tree as its value but the last, whose value is
    the name's) and ``$function:name(args)``."""
    if depth > 100:
        raise ValueError("the template is nested too deeply, or includes itself")
    again = lambda t, k=known: rendered(t, k, includes, depth + 1)
    if isinstance(tree, str):
        return _filled(tree, known)
    if isinstance(tree, list):
        return [again(x) for x in tree]
    if not isinstance(tree, dict):
        return tree
    out: Tree = {}
    decided = False
    for key, value in tree.items():
        word, _, rest = key.partition(":")
        rest = rest.strip()
        if word in ("$if", "$elif", "$else", "$platform"):
            decided = False if word in ("$if", "$platform") else decided
            holds = not decided and (word == "$else" or (rest in (known.get("platforms") or ()) if word == "$platform" else truth(rest, known)))
            if holds:
                decided, out = True, merged(out, again(value))
        elif word == "$for":
            name, _, path = rest.partition(" in ")
            for x in at_path(dict(known), path.strip()) or ():
                out = merged(out, again(value, {**known, name.strip(): x}))
        elif word == "$include":
            out = merged(out, again((includes or {}).get(value)) or {})
        elif word == "$function":
            out = _called(out, rest, value, known)
        elif word == "$provider_override":
            out[key] = again(value)  # carried out where the provider's template is laid on another
        else:
            out[_filled(key, known)] = again(value)
    return out


def with_overrides(base: dict, template: dict) -> tuple[dict, dict]:
    """``base`` with what ``$provider_override: a.b`` says laid at its path, objects merged and all else replaced; and
    ``template`` without these directives."""
    rest = {}
    for key, value in template.items():
        word, _, path = key.partition(":")
        if word != "$provider_override":
            rest[key] = value
            continue
        tree: Tree = value
        for part in reversed(path.strip().split(".")):
            tree = {part: tree}
        base = _laid(base, tree, path.strip().split("."))
    return base, rest


def _laid(base: Tree, tree: dict, path: list[str]) -> dict:
    """``base`` with the value of ``tree`` at ``path``, merged if both are objects."""
    key, *deeper = path
    base = dict(base) if isinstance(base, dict) else {}
    known, new = base.get(key), tree[key]
    base[key] = _laid(known, new, deeper) if deeper else merged(known, new, True) if isinstance(known, dict) and isinstance(new, dict) else new
    return base


def applied(name: str, default: dict, of_providers: Mapping[str, dict], providers: Collection[str] = (), platforms: Collection[str] = (), metadata: dict | None = None, includes: Mapping[str, Tree] | None = None, context: Mapping | None = None) -> dict:
    """The document of a software: the default template, on it the templates of ``providers`` in order (their overrides at
    paths first), on it the ``metadata`` that is known, includes last. Later layers delete by null and replace lists."""
    known = {"software_name": name, "providers": list(providers) or list(of_providers), "platforms": list(platforms), **(context or {})}
    later = {"$include"}
    out = _rendered_but(default, known, includes, later)
    for p in providers:
        if p in of_providers:
            template = _rendered_but(of_providers[p], {**known, "current_provider": p}, includes, later)
            out, template = with_overrides(out, template)
            out = merged(out, template, True)
    out = merged(out, metadata or {}, True)
    return rendered(out, known, includes) if _has_directive(out) else out


def _has_directive(tree: Tree) -> bool:
    if isinstance(tree, dict):
        return any(k.partition(":")[0] == "$include" or _has_directive(v) for k, v in tree.items())
    return isinstance(tree, list) and any(map(_has_directive, tree))


def _rendered_but(tree: dict, known: Mapping, includes: Mapping[str, Tree] | None, later: set[str]) -> dict:
    """``tree`` rendered without the directives ``later``, which are kept as they are."""
    kept = {k: v for k, v in tree.items() if k.partition(":")[0] in later}
    return {**rendered({k: v for k, v in tree.items() if k not in kept}, known, includes), **kept}


def merged_with_defaults(defaults: dict, overrides: dict) -> dict:
    """Overrides on defaults, nulls removed; those of a provider that is not supported stand alone."""
    if overrides.get("supported") is False:
        return overrides
    return merged(defaults, overrides, True)


def equal(a: Tree, b: Tree, strict: bool = True) -> bool:
    """Deep equality; if ``strict``, 1, 1.0 and True differ."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(v, b[k], strict) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(equal(x, y, strict) for x, y in zip(a, b, strict=True))
    return a == b and (not strict or type(a) is type(b))


def rows_of(tree: dict) -> list[tuple[str, str | None, list[str] | None]]:
    """(path, value, items) of the leaves of a document, for :func:`lodestone.operators.documents.merge_trees`: plain
    values as text (true and false as YAML has them), lists as the text of their items."""
    as_text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else v if isinstance(v, str) else json.dumps(v)
    return [(p, None, [as_text(x) for x in v]) if isinstance(v, list) else (p, as_text(v), None) for p, v in flattened(tree).items() if v != {}]


def loaded(spark: SparkSession, path: str) -> dict:
    """The YAML document at ``path``, of any file system that Spark reads; an empty one if there is no file."""
    import yaml

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return {}
    row = spark.read.text(path, wholetext=True).first()  # none for an empty file
    return (yaml.safe_load(row[0]) if row else None) or {}


def provider_template(spark: SparkSession, folder: str, provider: str, software: str | None = None) -> dict:
    """The first there is of a software's own template of a provider (``software/name/providers/provider.yaml``,
    ``providers/provider/name.yaml``, the section ``name`` of ``providers/provider.yaml``), or without a software of
    ``providers/provider.yaml`` and ``providers/provider/default.yaml``; an empty one if there is none."""
    if software is None:
        return loaded(spark, f"{folder}/providers/{provider}.yaml") or loaded(spark, f"{folder}/providers/{provider}/default.yaml")
    own = loaded(spark, f"{folder}/software/{software}/providers/{provider}.yaml") or loaded(spark, f"{folder}/providers/{provider}/{software}.yaml")
    return own or loaded(spark, f"{folder}/providers/{provider}.yaml").get(software) or {}


def resolved_urls(requests: DataFrame, urls: DataFrame, *context: str) -> DataFrame:
    """The URL of each request (provider, os, version): the most special of the rows of ``urls`` (provider, os, version,
    url; null stands for any), with ``{{name}}`` and ``{name}`` filled in from the columns that ``context`` names. What is
    not known stays as it is written. ``urls`` is a table of settings; one row of it is picked for each request."""
    keys = ["provider", "os", "version"]
    u = urls.select(*(F.col(k).alias(f"_{k}") for k in keys), "url")
    fits = (F.col("provider") == F.col("_provider")) & (F.col("_os").isNull() | (F.col("_os") == F.col("os"))) & (F.col("_version").isNull() | (F.col("_version") == F.col("version")))
    special = F.col("_version").isNotNull().cast("int") * 2 + F.col("_os").isNotNull().cast("int")
    best = requests.select(*keys, *(c for c in context if c not in keys)).distinct().join(u, fits, "left").groupBy(*keys, *(c for c in context if c not in keys)).agg(F.max_by("url", F.struct(special.alias("s"), F.col("url"))).alias("url"))
    out: Column = F.col("url")
    for c in context:
        out = F.replace(F.replace(out, F.lit("{{" + c + "}}"), F.coalesce(F.col(c).cast("string"), F.lit("{{" + c + "}}"))), F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("{" + c + "}")))
    return best.withColumn("url", out)
