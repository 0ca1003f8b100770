"""Reachability in a commit graph by labels that are made once and extended by new commits.

Each commit lies on one chain: of a commit's children that have it as first parent, the one with the smallest id goes on
with its chain, all others begin one of their own.  A label is the chain (its oldest commit) and the place on it.  What a
commit reaches on its own chain is all places up to its own, so a set of reached commits is one number a chain, however
long the history is.  Other parents, and the first parents of chains' beginnings, are links from a place to a place.

From its seeds a search follows links between chains until no chain is reached further up: as many rounds as chains lie
behind one another, each a join of chains with links and never of commits.  One pass over the labels then gives the
commits.  Labels are made by pointer doubling along the chains; new commits are ranked among themselves and set upon the
ends of the chains that they go on with, so old labels stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.plans.materialize import counted, keep, numbered, small


def first_parents(parents: DataFrame) -> DataFrame:
    """(commit_sha, parent) with each commit's first parent: of parents (commit_sha, parent, nth), the one of the smallest
    nth, then of the smallest id; null for roots, and for parents that have no row of their own.  Without a column nth the
    smallest id counts."""
    nth = F.col("nth") if "nth" in parents.columns else F.lit(0)
    rows = parents.select("commit_sha", "parent", nth.cast("int").alias("nth"))
    ends = rows.where("parent is not null").select(F.col("parent").alias("commit_sha"), F.lit(None).cast(parents.schema["parent"].dataType).alias("parent"), F.lit(0).alias("nth"))
    first = F.min(F.when(F.col("parent").isNotNull(), F.struct("nth", "parent")))
    return rows.unionByName(ends).groupBy("commit_sha").agg(first.alias("f")).select("commit_sha", F.col("f.parent").alias("parent"))


def _ranked(steps: DataFrame) -> DataFrame:
    """(commit_sha, begin, ahead) of steps (commit_sha, before): the commit at which each line begins (before is null), and
    how many lie before."""
    at, (rows,) = counted(steps.select("commit_sha", F.coalesce("before", "commit_sha").alias("begin"), F.col("before").isNotNull().cast("long").alias("ahead")))
    for _ in range(rows.bit_length() + 2):
        jump = at.select(F.col("commit_sha").alias("begin"), F.col("begin").alias("__b"), F.col("ahead").alias("__a")).where("__a > 0")
        moved = at.join(jump, "begin", "left").select("commit_sha", F.coalesce("__b", "begin").alias("begin"), (F.col("ahead") + F.coalesce("__a", F.lit(0))).alias("ahead"), F.col("__b").isNotNull().alias("moved"))
        kept, (_, n) = counted(moved, F.col("moved"))
        if not n:
            return at
        at = kept.drop("moved")
    raise ValueError("a commit is its own ancestor")


def labels(parents: DataFrame) -> DataFrame:
    """(commit_sha, chain, place, parent) of all commits of parents (commit_sha, parent, and nth if there is one)."""
    return extended(None, parents)


def extended(known: DataFrame | None, new: DataFrame) -> DataFrame:
    """Labels of the known commits and of new ones (commit_sha, parent, nth); known ones keep theirs, whatever new says."""
    first = first_parents(new)
    if known is not None:
        first = first.join(known.select("commit_sha"), "commit_sha", "left_anti")
    first = keep(first)
    ends = first.select("commit_sha", F.lit(None).cast("string").alias("chain"), F.lit(None).cast("long").alias("place"))
    if known is not None:  # a known commit can be gone on with where it is the last of its chain
        last = known.groupBy("chain").agg(F.max("place").alias("place"))
        open_ = known.join(last, ["chain", "place"]).select("commit_sha", F.col("chain").cast("string").alias("chain"), "place")
        ends = ends.unionByName(open_)
    goes_on = first.where("parent is not null").groupBy("parent").agg(F.min("commit_sha").alias("commit_sha"))
    steps = goes_on.join(ends.withColumnRenamed("commit_sha", "parent"), "parent").select("commit_sha", F.col("parent").alias("before"), "chain", "place")
    at = keep(first.join(steps, "commit_sha", "left"))
    among = at.select("commit_sha", F.when(F.col("place").isNull(), F.col("before")).alias("before"))
    ranked = _ranked(among)
    # a line of new commits begins at its own, or upon the end of a known chain
    upon = at.where("place is not null").select(F.col("commit_sha").alias("begin"), F.col("chain").alias("__c"), (F.col("place") + 1).alias("__p"))
    kind = first.schema["commit_sha"].dataType
    made = ranked.join(upon, "begin", "left").select("commit_sha", F.coalesce(F.col("__c").cast(kind), F.col("begin")).alias("chain"), (F.col("ahead") + F.coalesce("__p", F.lit(0))).alias("place")).join(first, "commit_sha")
    return keep(made if known is None else known.select(*made.columns).unionByName(made))


def links(known: DataFrame, parents: DataFrame) -> DataFrame:
    """(chain, place, to_chain, to_place): parents that aren't the place before on the same chain."""
    child = known.select("commit_sha", "chain", "place")
    to = known.select(F.col("commit_sha").alias("parent"), F.col("chain").alias("to_chain"), F.col("place").alias("to_place"))
    each = parents.where("parent is not null").select("commit_sha", "parent").distinct()
    return each.join(child, "commit_sha").join(to, "parent").where("chain != to_chain").select("chain", "place", "to_chain", "to_place")


def reach(known: DataFrame, between: DataFrame, seeds: DataFrame) -> DataFrame:
    """(chain, upto) of what the seeds (commit_sha) reach, they among it."""
    best = lambda df: df.groupBy("chain").agg(F.max("upto").alias("upto"))
    at, (n,) = counted(best(known.join(seeds.select("commit_sha").distinct(), "commit_sha").select("chain", F.col("place").alias("upto"))))
    fresh = at
    while n:
        more = between.join(small(fresh, n), "chain").where("place <= upto").select(F.col("to_chain").alias("chain"), F.col("to_place").alias("upto"))
        have = at.select("chain", F.col("upto").alias("__u"))
        fresh, (n,) = counted(best(more).join(have, "chain", "left").where("__u is null or upto > __u").drop("__u"))
        if n:
            at = keep(best(at.unionByName(fresh)))
    return at


def reached(known: DataFrame, upto: DataFrame) -> DataFrame:
    """(commit_sha) of the commits up to there."""
    return known.join(upto, "chain").where("place <= upto").select("commit_sha")


def commit_range(known: DataFrame, between: DataFrame, base: DataFrame, head: DataFrame, when: DataFrame) -> DataFrame:
    """(commit_sha, pos): what head (commit_sha) reaches and base (commit_sha) doesn't, the oldest first by when
    (commit_sha, at), then by id."""
    to = reach(known, between, head)
    before = reach(known, between, base).withColumnRenamed("upto", "__base")
    mine = known.join(to, "chain").join(before, "chain", "left").where("place <= upto and (__base is null or place > __base)").select("commit_sha")
    return numbered(mine.join(when, "commit_sha", "left"), ["at", "commit_sha"], "pos").select("commit_sha", "pos")
