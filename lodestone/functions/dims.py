"""Dimension tables that are constants: what is known about each package provider. Fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Groups = dict[float, list[str]]

PRIORITY: Groups = {
    10: ["apt", "dnf", "yum", "zypper", "pacman", "apk", "pkg"],
    9: ["pypi", "npm", "cargo", "gem", "composer", "maven", "nuget"],
    8: ["brew", "scoop", "choco", "winget"],
    7: ["docker", "helm"],
    6: ["snap", "flatpak"],
    5: ["nix", "guix", "spack"],
}
RELIABILITY: Groups = {
    0.95: ["apt", "dnf", "yum", "zypper", "pacman", "apk", "pkg"],
    0.9: ["pypi", "npm", "cargo", "gem", "composer", "maven", "nuget"],
    0.85: ["brew", "winget", "docker", "helm", "nix", "guix", "spack"],
    0.8: ["scoop", "choco", "snap", "flatpak"],
}
SEARCH_WEIGHT: Groups = {
    0.9: ["apt", "dnf"],
    0.85: ["yum", "brew", "docker"],
    0.8: ["zypper", "winget", "npm", "pypi", "pacman"],
    0.75: ["scoop", "cargo", "apk"],
    0.7: ["choco", "snap", "flatpak", "portage", "nix"],
    0.65: ["guix"],
}
POPULARITY: Groups = {
    10: ["apt"],
    9: ["brew"],
    8: ["winget", "dnf"],
    7: ["npm", "pypi", "yum", "zypper"],
    6: ["cargo", "pacman"],
    5: ["docker"],
    4: ["snap", "flatpak"],
    3: ["scoop", "choco"],
}
QUALITY_WEIGHT: Groups = {
    0.9: ["apt", "dnf", "pypi"],
    0.85: ["brew", "npm", "cargo"],
    0.8: ["winget", "docker", "flatpak"],
    0.75: ["scoop", "snap"],
}
FIELD_WEIGHT: Groups = {
    1.0: ["name"],
    0.8: ["description"],
    0.7: ["version"],
    0.6: ["license", "homepage"],
    0.5: ["source_url", "platforms"],
    0.4: ["category"],
    0.3: ["dependencies"],
}
DEFAULTS = {"PRIORITY": 1, "RELIABILITY": 0.7, "SEARCH_WEIGHT": 0.5, "POPULARITY": 0, "QUALITY_WEIGHT": 0.5, "FIELD_WEIGHT": 0.5}
WELL_KNOWN_LICENSES = ["MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "MPL-2.0", "LGPL-3.0", "GPL-2.0", "Apache License 2.0"]
SPDX_QUALITY = ["MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "MPL-2.0", "LGPL-3.0", "LGPL-2.1"]
SPDX_RULES = [*SPDX_QUALITY, "Unlicense", "CC0-1.0", "AGPL-3.0"]
PLATFORMS = ["linux", "windows", "macos", "darwin", "freebsd", "openbsd", "netbsd", "solaris", "aix", "android", "ios"]
CATEGORIES = ["development", "productivity", "system", "network", "security", "multimedia", "graphics", "office", "education", "games", "science", "database", "web", "communication", "utilities"]
#: Platforms and the providers that are for them.
PLATFORMS_OF: list[tuple[list[str], list[str]]] = [
    (["linux"], ["apt", "dnf", "yum", "zypper", "pacman"]),
    (["macos", "linux"], ["brew"]),
    (["windows"], ["winget", "scoop", "choco"]),
    (["linux", "windows", "macos"], ["npm", "pypi", "cargo"]),
]


def lookup(provider: Column, name: str, default: float | None = None) -> Column:
    """What the table ``name`` has for a provider, as a CASE that Catalyst can fold."""
    groups: Groups = globals()[name]
    out = F.lit(float(DEFAULTS[name] if default is None else default))
    for k, v in reversed(groups.items()):
        out = F.when(provider.isin(*v), F.lit(float(k))).otherwise(out)
    return out


def lookup_sql(column: str, name: str, default: float | None = None) -> str:
    """The same as DuckDB SQL."""
    groups: Groups = globals()[name]
    cases = " ".join(f"WHEN {column} IN ({', '.join(repr(x) for x in v)}) THEN {float(k)}::DOUBLE" for k, v in groups.items())
    return f"CASE {cases} ELSE {float(DEFAULTS[name] if default is None else default)}::DOUBLE END"
