"""Source files that do not parse."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.batches import slices

#: The dialect of each extension; other extensions are not judged.
DIALECTS = {"ts": "ts", "tsx": "tsx", "js": "js", "mjs": "js", "py": "py", "json": "json"}
_PARSERS: dict[str, object] = {}


def parser(dialect: str):
    """The parser of a dialect, with its tables and cells kept in this Python worker."""
    if dialect not in _PARSERS:
        from graphloom.llm.pythons import Jsons, Pythons
        from graphloom.llm.scripts import Scripts

        _PARSERS[dialect] = Pythons() if dialect == "py" else Jsons() if dialect == "json" else Scripts(dialect)
    return _PARSERS[dialect]


def extension(path: Column) -> Column:
    """The part after the last dot of a path's last segment, in lower case."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


#: Where the repository stands in a path; a parameter of all that count by repository.
CHECKOUTS = r"^/srv/checkouts/([^/]+)/"


def repository(path: Column, layout: str = CHECKOUTS) -> Column:
    """The repository segment of a path, the first group of layout; empty if it has none."""
    return F.regexp_extract(path, layout, 1)


def first_error(path: str, text: str) -> tuple[int, str] | None:
    """Line (from 1) and kind of a file's first unrecoverable error."""
    dialect = DIALECTS[path.rsplit(".", 1)[-1].lower()]
    while True:
        try:
            fault = parser(dialect).fault(text)
            break
        except RecursionError:  # frames of the parser lie on the heap, so depth is a matter of memory only
            sys.setrecursionlimit(sys.getrecursionlimit() * 4)
    return (text.count("\n", 0, fault.offset) + 1, fault.what) if fault else None


def syntax_errors(sources: DataFrame, layout: str = CHECKOUTS) -> DataFrame:
    """Every source text of a known extension with its first error, if any.

    Columns: path, extension, repository, valid boolean, line int and error string
    (null where valid). A .ts text is TypeScript without JSX, .tsx with it, .js and
    .mjs plain ECMAScript, .py Python 3, .json strict JSON. Empty and blank texts of
    these are valid, except JSON. Rows with a null path or text or another extension
    are no cases; a repeated row is judged again and gives a row again; an empty
    table gives an empty result; further columns are ignored.

    Texts are parsed whole where they are read, without a shuffle. Chart cells and
    tables live as long as the Python worker, so a shape of code is parsed once.
    """
    known = extension(F.col("path"))
    rows = sources.select("path", "text").filter(F.col("text").isNotNull() & known.isin(list(DIALECTS)))

    def run(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        for part in slices(batches, "text"):
            paths = part.column("path").to_pylist()
            found = [first_error(p, t) for p, t in zip(paths, part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("path"), pa.array([f is None for f in found]), pa.array([f and f[0] for f in found], pa.int32()), pa.array([f and f[1] for f in found], pa.string())],
                names=["path", "valid", "line", "error"],
            )

    judged = rows.mapInArrow(run, "path string, valid boolean, line int, error string")
    return judged.select("path", extension(F.col("path")).alias("extension"), repository(F.col("path"), layout).alias("repository"), "valid", "line", "error")


def error_rates(judged: DataFrame) -> DataFrame:
    """Per repository and extension: n_files, n_broken, rate. Repeated rows count once."""
    each = judged.groupBy("path", "extension", "repository").agg(F.min("valid").alias("valid"))
    return each.groupBy("repository", "extension").agg(F.count("*").alias("n_files"), F.count_if(~F.col("valid")).alias("n_broken")).withColumn("rate", F.round(F.col("n_broken") / F.col("n_files"), 6))


def unreliable_notes(judged: DataFrame, files: DataFrame) -> DataFrame:
    """Paths where the newest files.errors and the parse disagree: path, noted, valid.

    A path without a row in files counts as nothing noted.
    """
    newest = files.filter("path is not null").groupBy("path").agg(F.max_by(F.coalesce(F.trim("errors"), F.lit("")), F.coalesce("indexed_at", F.lit(-1))).alias("noted"))
    own = judged.groupBy("path").agg(F.min("valid").alias("valid"))
    both = own.join(newest, "path", "left").withColumn("noted", ~F.coalesce("noted", F.lit("")).isin("", "[]", "null"))
    return both.filter(F.col("noted") == F.col("valid"))
