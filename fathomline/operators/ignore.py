"""Ignore rules as regular expressions: layered, last match wins within a layer, a directory's verdict covers what is below."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns that always apply.
ALWAYS = (
    ".git/", ".hg/", ".svn/", ".venv/", "venv/", "env/", ".env/", ".direnv/", "node_modules/", ".pnpm-store/", ".yarn/", "__pycache__/", ".pytest_cache/", ".mypy_cache/", ".ruff_cache/", ".pytype/",
    ".ipynb_checkpoints/", "build/", "dist/", "out/", "public/", ".next/", ".nuxt/", ".svelte-kit/", ".angular/", ".astro/", ".vite/", ".cache/", ".parcel-cache/", ".turbo/", "coverage/", ".coverage/", ".nyc_output/",
    ".gradle/", ".idea/", ".vscode/", ".docusaurus/", ".vercel/", ".serverless/", ".terraform/", ".mvn/", ".tox/", "target/", "bin/", "obj/", "*.pyc", "*.pyo", ".DS_Store", "Thumbs.db",
)


def rule_regex(line: str) -> tuple[str, bool] | None:
    """(regular expression over a path without leading slash, whether it ignores) of one rule; None for blanks and comments."""
    rule = line.rstrip("\n")
    rule = re.sub(r"(?<!\\)\s+$", "", rule)
    if not rule or rule.startswith("#"):
        return None
    keep = rule.startswith("!")
    rule = rule[1:] if keep else rule
    rule = rule[1:] if rule[:2] in ("\\#", "\\!") else rule
    only_dir = rule.endswith("/")
    rule = rule.rstrip("/")
    if not rule:
        return None
    anchored = "/" in rule
    rule = rule.lstrip("/")
    out, i = [], 0
    while i < len(rule):
        if rule.startswith("**/", i) and (i == 0 or rule[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif rule.startswith("/**", i) and i + 3 == len(rule):
            out.append("/.+")
            i += 3
        elif rule[i] == "*":
            while rule[i + 1 : i + 2] == "*":
                i += 1
            out.append("[^/]*")
            i += 1
        elif rule[i] == "?":
            out.append("[^/]")
            i += 1
        elif rule[i] == "[" and "]" in rule[i + 2 :]:
            end = rule.index("]", i + 2)
            body = rule[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            if rule[i] == "\\" and i + 1 < len(rule):
                i += 1
            out.append(re.escape(rule[i]))
            i += 1
    return ("^" if anchored else "(?:^|.*/)") + "".join(out) + ("/.*" if only_dir else "(?:/.*)?") + "$", not keep


def layer(path: Column, rules: list[str]) -> Column:
    """Verdict of one layer: the last rule that matches decides; false without a match. `path` of a directory ends with a slash.

    Neighbouring rules that say the same are one expression, so long rule files make short plans.
    """
    out = F.lit(False)
    for ignores, group in groupby(filter(None, map(rule_regex, rules)), key=lambda r: r[1]):
        out = F.when(path.rlike("|".join(f"(?:{r[0]})" for r in group)), F.lit(ignores)).otherwise(out)
    return out


def runtime(path: Column, patterns: list[str]) -> Column:
    """Whether a file or a folder on the path is named by a runtime pattern: a whole name, or `*suffix`."""
    parts = F.split(path, "/")
    ends = lambda suffix: F.exists(parts, lambda x: x.endswith(suffix))
    hits = [ends(p[1:]) if p.startswith("*") else F.array_contains(parts, p) for p in patterns]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def verdicts(paths: DataFrame, col: str = "relative_path", root: list[str] = (), nested: dict[str, list[str]] | None = None, extra: list[str] = (), dynamic: list[str] = ()) -> DataFrame:
    """Adds `ignored_by`: runtime, always, gitignore, nested, extra or null. Layers are tried in that order; the first that ignores wins.

    `nested` maps a folder to the rules of the file in it, the innermost first; those rules see paths relative to it.
    """
    p = F.regexp_replace(F.col(col), r"\\", "/")
    inner = [p.startswith(d + "/") & layer(F.expr(f"substring({_sql(col)}, {len(d) + 2})"), r) for d, r in sorted((nested or {}).items(), key=lambda x: -len(x[0]))]
    by_nested = reduce(lambda a, b: a | b, inner, F.lit(False))
    return paths.withColumn("ignored_by", F.when(runtime(p, list(dynamic)), "runtime").when(layer(p, list(ALWAYS)), "always").when(layer(p, list(root)), "gitignore").when(by_nested, "nested").when(layer(p, list(extra)), "extra"))


@dataclass(frozen=True)
class RuleSet:
    """What a folder's own rule files say; the signature changes with the text of the two files at the top."""

    root: tuple[str, ...] = ()
    nested: dict[str, tuple[str, ...]] = field(default_factory=dict)
    extra: tuple[str, ...] = ()
    signature: dict[str, str | None] = field(default_factory=dict)


def rule_ignores(path: str, rules: list[str]) -> bool:
    """layer() for one path outside a plan."""
    out = False
    for r in filter(None, map(rule_regex, rules)):
        if re.search(r[0], path):
            out = r[1]
    return out


def _sql(col: str) -> str:
    return f"regexp_replace(`{col}`, '\\\\\\\\', '/')"
