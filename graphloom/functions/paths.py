"""Classification of file paths and glob patterns as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path patterns of the file groups; the first group that matches wins.
GROUPS = [
    ("tests", r"(?:^|/)(?:__tests__|e2e|playwright)/|\.(?:test|spec)\.[cm]?[jt]sx?$"),
    ("routes", r"/app/.*/(?:page|layout|route|loading|error|not-found)\.[jt]sx?$|/pages/.*\.[jt]sx?$|/api/.*\.(?:ts|tsx|js|jsx)$"),
    ("components", r"/components?/.*\.[jt]sx?$"),
    ("dataAccess", r"/db/|/models?/|/repositories?/|/queries\.[jt]sx?$"),
]
GROUP_ORDER = ["tests", "routes", "components", "dataAccess", "other"]
#: The test globs *.test.ts, *.test.tsx, *.spec.ts, *.spec.tsx, __tests__/**, e2e/**, playwright/**, matched anywhere.
IMPACT_TEST = r"\.(?:test|spec)\.tsx?|__tests__/|e2e/|playwright/"
IMPACT_ROUTE = r"/app/.*/(?:page|layout|route)\.[jt]sx?$|/pages/.*\.[jt]sx?$|/api/.*\.(?:ts|tsx|js|jsx)$"
IMPACT_COMPONENT = r"/components?/.*\.[jt]sx?$"


def file_group(path: Column) -> Column:
    """The group of a file: tests, routes, components, dataAccess or other."""
    out = F.lit("other")
    for name, pattern in reversed(GROUPS):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def group_ordinal(group: Column) -> Column:
    out = F.lit(len(GROUP_ORDER) - 1)
    for n, name in reversed(list(enumerate(GROUP_ORDER))):
        out = F.when(group == name, n).otherwise(out)
    return out


def relative_path(path: Column, root: str) -> Column:
    """The path from root as ./x; outside of root as it is."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.concat(F.lit("./"), F.substring(path, len(base) + 1, F.length(path)))).otherwise(path) if root else path


def glob_regex(pattern: str, anchored: bool = True) -> str:
    """A glob with ** (any directories), * (within one) and ? (one character) as a regex."""
    out = []
    for part in re.findall(r"\*\*/?|\*|\?|[^*?]+", pattern):
        out.append("(?:.*/)?" if part == "**/" else ".*" if part == "**" else "[^/]*" if part == "*" else "[^/]" if part == "?" else re.escape(part))
    return f"^{''.join(out)}$" if anchored else "".join(out)


def loose_glob(pattern: str) -> str:
    """The looser form of custom edges: * spans directories, nothing is escaped."""
    return "^" + pattern.replace("*", ".*") + "$"


def filter_glob(pattern: str) -> str:
    """The form of the affected filter: * spans directories, all else but ? stands for itself."""
    return "^" + re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", pattern).replace("*", ".*") + "$"


def impact_flags(node_type: Column, name: Column, path: Column) -> dict[str, Column]:
    """The buckets a node of an impact report falls into; it may be several."""
    return {
        "fields": node_type == "field",
        "schemas": node_type == "schema",
        "hooks": (node_type == "function") & name.rlike("use[A-Z]"),
        "routes": path.rlike(IMPACT_ROUTE),
        "components": path.rlike(IMPACT_COMPONENT),
    }
