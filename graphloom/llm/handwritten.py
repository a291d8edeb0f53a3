"""Generated, minified or vendored source files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.authorship import signs, token_hashes, tokens
from graphloom.llm.batches import slices
from graphloom.llm.rolling import gram_hashes, winnow
from graphloom.llm.syntax import CHECKOUTS, extension, first_error, repository, syntax_errors
from graphloom.workspace import Scratch

CODE = ("ts", "tsx", "js", "mjs", "py")


def fingerprints(sources: DataFrame, k: int = 16, window: int = 24) -> DataFrame:
    """Signs and winnowed fingerprints of each code file.

    Columns: path, own (why the text itself shows a tool or third party, else null),
    hint boolean, marks array<bigint>. Marks are hashes of k normalized tokens
    (comments, layout, quotes and separators removed), chosen by winnowing; a file
    of fewer tokens than a window has its least hash, one of fewer than k none. Files
    with a sign are parsed, and those that do not parse give no row.
    """
    rows = sources.select("path", "text").filter(F.col("text").isNotNull() & extension(F.col("path")).isin(list(CODE)))

    def run(batches):
        import sys

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        for part in slices(batches, "text"):
            kept, own, hint, streams = [], [], [], []
            for n, (path, text) in enumerate(zip(part.column("path").to_pylist(), part.column("text").to_pylist())):
                code, head = tokens(text)
                why, third = signs(path, text, code, head)
                if why and first_error(path, text):
                    continue
                kept.append(n)
                own.append(why)
                hint.append(third)
                streams.append(np.array(token_hashes(code), np.uint64))
            sizes = np.array([len(s) for s in streams], np.int64)
            owner = np.repeat(np.arange(len(streams)), sizes)
            at, h = winnow(np.concatenate([*streams, np.zeros(0, np.uint64)]), owner, k, window)
            marks = [np.unique(m).view(np.int64) for m in np.split(h, np.searchsorted(owner[at], np.arange(1, len(streams))))] if streams else []
            for n, stream in enumerate(streams):
                if not len(marks[n]) and len(stream) >= k:
                    marks[n] = np.array([gram_hashes(stream, k).min()]).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(m) for m in marks])]).astype(np.int32)
            values = pa.array(np.concatenate([*marks, np.zeros(0, np.int64)]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("path").take(pa.array(kept, pa.int32())), pa.array(own, pa.string()), pa.array(hint, pa.bool_()), pa.ListArray.from_arrays(pa.array(offsets), values)],
                names=["path", "own", "hint", "marks"],
            )

    return rows.mapInArrow(run, "path string, own string, hint boolean, marks array<bigint>")


def not_handwritten(sources: DataFrame, share: float = 0.6, repositories: int = 3, layout: str = CHECKOUTS) -> DataFrame:
    """Code files not written by hand in their project: path, reason.

    reason is ``vendored``, ``generated``, ``minified`` or ``data``. A file is
    vendored if the given share of its fingerprints recurs in at least so many
    repositories (in two, if its path, or a licence banner with a version, hints at a
    third party), or if a package manager's folder holds it; it is generated, minified or data by its head,
    layout and tokens. The repository is what ``layout`` captures of a path. Files that do not
    parse, have no text or another extension are no cases; copies within one
    repository recur nowhere else; repeated rows give one row; empty and tiny files
    have no fingerprints; an empty table gives an empty result; further columns are
    ignored.

    Fingerprints are counted by (hash, repository) with partial aggregation and
    joined back by hash, as 8-byte numbers; a fingerprint of a third of all files is
    one counter per map task, and its join is split by the handling of skew.
    """
    scratch = Scratch(sources.sparkSession, "handwritten")
    files = scratch.save(fingerprints(sources).dropDuplicates(["path"]), "marks")
    rows = files.select(F.xxhash64("path").alias("file"), F.xxhash64(repository(F.col("path"), layout)).alias("repo"), F.explode("marks").alias("mark"))
    spread = rows.select("mark", "repo").distinct().groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1")
    common = rows.select("file", "mark").join(spread, "mark").groupBy("file").agg(F.count("*").alias("two"), F.count_if(F.col("n") >= repositories).alias("many"))
    scored = files.select("path", "own", "hint", F.size("marks").alias("size"), F.xxhash64("path").alias("f")).join(common, F.col("f") == F.col("file"), "left")
    recurs = (F.col("many") >= F.col("size") * share) | (F.col("hint") & (F.col("two") >= F.col("size") * share))
    reason = F.when(F.col("own").isin("generated", "minified", "data"), F.col("own")).when(F.coalesce(recurs & (F.col("size") > 0), F.lit(False)), "vendored").otherwise(F.col("own"))
    found = scratch.save(scored.select("path", reason.alias("reason"), F.col("own").isNotNull().alias("parsed")).filter("reason is not null"), "found")
    # only recurrence speaks against the rest; what of it does not parse is no case
    suspects = sources.select("path", "text").join(found.filter("not parsed").select("path"), "path", "left_semi")
    whole = syntax_errors(suspects).filter("valid").select("path").distinct().withColumn("reason", F.lit("vendored"))
    return found.filter("parsed").select("path", "reason").unionByName(whole)
