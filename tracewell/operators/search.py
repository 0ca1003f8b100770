"""Search in prompts, edits of a file, and the chain of rewrites behind an edit."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import approximate, contains_phrase
from tracewell.plans.materialize import counted, keep


def search(edits: DataFrame, phrase: str, limit: int, text: str = "prompt", order: tuple = ("ts", "commit_sha", "edit_idx")) -> DataFrame:
    """The latest `limit` rows whose text holds the phrase, and in each row whether there are more.

    One row more than asked is taken, so nothing is counted."""
    first, *rest = order
    by = [F.desc(first), *map(F.asc, rest)]
    hits = edits.where(contains_phrase(text, phrase)).orderBy(*by).limit(limit + 1)
    w = Window.orderBy(*by)  # limit + 1 rows at most
    numbered = hits.withColumn("rank", F.row_number().over(w)).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > limit)
    return numbered.where(F.col("rank") <= limit)


def file_edits(edits: DataFrame, files: list | None = None) -> DataFrame:
    """Edits with their rank within the file, the latest first."""
    some = edits if files is None else edits.where(F.col("file").isin(files))
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("ts"), "commit_sha", "edit_idx")))


def with_origin(hits: DataFrame, edits: DataFrame) -> DataFrame:
    """hits (commit_sha, edit_idx, ...) with their edit's origin, and whether it is a guess; a hit whose edit is gone has none."""
    origin = edits.select("commit_sha", "edit_idx", "derived_from")
    a = approximate("derived_from")
    return hits.join(origin, ["commit_sha", "edit_idx"], "left").withColumns({"approximate": a["approximate"], "confidence": a["confidence"]})


def log_file(rows: DataFrame, edits: DataFrame, files: list | None = None) -> DataFrame:
    """The edits of files in the cache's rows, ranked, each with the origin that its note has."""
    return with_origin(file_edits(rows, files), edits)


def search_with_origin(rows: DataFrame, edits: DataFrame, phrase: str, limit: int) -> DataFrame:
    """The latest hits of a phrase in the cache's rows, each with the origin that its note has."""
    hits = keep(search(rows, phrase, limit))
    theirs = edits.join(F.broadcast(hits.select("commit_sha", "edit_idx")), ["commit_sha", "edit_idx"], "left_semi")  # limit rows at most
    return with_origin(hits, theirs)


def jumps(links: DataFrame, most_rounds: int = 64) -> Iterator[DataFrame]:
    """Of links (id, parent), a parent each (the smallest of several): (id, to) over 1, 2, 4, ... steps, until none is left."""
    jump = keep(links.where("parent is not null").groupBy("id").agg(F.min("parent").alias("to")))
    for _ in range(most_rounds):
        yield jump
        jump, (n,) = counted(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.to").alias("to")))
        if not n:
            return


def chains(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, ancestor, depth) for the ids (id) asked for: what they reach over links (id, parent), a parent each.

    Paths double: those of up to 2**k steps go on by a jump of 2**k, so a chain of length n takes log2(n) joins, and rows
    are as many as the asked ids' ancestors.  Depth 0 is the id itself.  A cycle is followed once."""
    paths = keep(ids.select("id").distinct().select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")))
    for k, jump in enumerate(jumps(links)):
        longer = paths.join(jump.select(F.col("id").alias("ancestor"), "to"), "ancestor").select("id", F.col("to").alias("ancestor"), (F.col("depth") + (1 << k)).alias("depth"))
        longer = longer.join(paths.select("id", "ancestor"), ["id", "ancestor"], "left_anti").groupBy("id", "ancestor").agg(F.min("depth").alias("depth"))
        longer, (n,) = counted(longer)
        if not n:
            break
        paths = keep(paths.unionByName(longer))
    return paths


def reachable(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(id) of all that seeds (id) reach over links (id, parent), of which an id may have several; the seeds too.

    A set of ids that grows, never pairs: one parent of each id is followed by doubled jumps, so a line of n commits
    takes log2(n) joins; the other parents of what was reached begin the next round, so there are as many rounds as
    merges lie within merges."""
    links = links.where("parent is not null").select("id", "parent")
    first = links.groupBy("id").agg(F.min("parent").alias("parent"))
    steps = list(jumps(first))
    others = keep(links.join(first, ["id", "parent"], "left_anti").distinct())
    found = keep(seeds.select("id").distinct())
    while True:
        for jump in steps:
            found = keep(found.union(found.join(jump, "id").select(F.col("to").alias("id"))).distinct())
        more = found.join(others, "id").select(F.col("parent").alias("id")).distinct().join(found, "id", "left_anti")
        more, (n,) = counted(more)
        if not n:
            return found
        found = keep(found.union(more))
