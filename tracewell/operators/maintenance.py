"""Note collections over time: merge, squash, repair, collect garbage, compact, scrub, guard a push."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.functions import redact
from tracewell.functions.text import ZERO_SHA, edit_key, trimmed
from tracewell.operators import history
from tracewell.plans.materialize import keep
from tracewell.sources.gittext import split_conflicts
from tracewell.sources.notes import note_json, parse_notes


def _keys(df: DataFrame) -> tuple[DataFrame, list[str]]:
    names = ["__k0", "__k1", "__k2", "__k3"]
    return df.withColumns(dict(zip(names, edit_key(), strict=True))), names


def keep_latest(edits: DataFrame, within: list[str], arrival: list[str]) -> DataFrame:
    """One edit for each key within a note: the latest; of equal instants the first to arrive."""
    keyed, names = _keys(edits)
    order = Window.partitionBy(*within, *names).orderBy(F.desc("ts"), *arrival)
    return keyed.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r", *names)


def keep_first(edits: DataFrame, within: list[str], arrival: list[str]) -> DataFrame:
    """One edit for each place of a turn in a file: the first to arrive."""
    order = Window.partitionBy(*within, "conversation_id", "turn_index", "file", "line_start", "line_end").orderBy(*arrival)
    return edits.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def renumber(edits: DataFrame, within: list[str], order: list) -> DataFrame:
    return edits.withColumn("edit_idx", F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1)


def merge(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union of two sides' edits for each commit: the latest of each key (the local one of equals), in order of instant,
    conversation, turn and tool use."""
    both = local.withColumn("__side", F.lit(0)).unionByName(incoming.withColumn("__side", F.lit(1)))
    kept = keep_latest(both, ["commit_sha"], ["__side", "edit_idx"])
    return renumber(kept.drop("__side"), ["commit_sha"], ["ts", "conversation_id", "turn_index", F.asc_nulls_first("tool_use_id"), "file", "line_start", "line_end"])


def rewrite(edits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edits after commits were rewritten, pairs (old, new): they move to the new commit.

    A commit made of one old one, and without a note of its own, takes that note as it is; else the edits of all and
    those it has are put together, the latest of each key.  Old commits lose theirs."""
    pairs = pairs.where("old != new").distinct()
    # several old commits count only if they have a note
    moved = edits.join(pairs, edits.commit_sha == pairs.old).drop("commit_sha").withColumn("__own", F.lit(0))
    own = edits.join(pairs.select("new").distinct(), edits.commit_sha == F.col("new")).drop("commit_sha").withColumn("old", F.col("new")).withColumn("__own", F.lit(1))
    both = moved.unionByName(own)
    sources = both.groupBy("new").agg(F.count_distinct("old").alias("__sources"))
    both = both.join(sources, "new")
    alone = both.where("__sources = 1").drop("__sources", "__own", "old").withColumnRenamed("new", "commit_sha")
    many = keep_latest(both.where("__sources > 1"), ["new"], ["__own", "old", "edit_idx"])
    many = renumber(many, ["new"], ["ts", *edit_key(), "old"]).drop("__sources", "__own", "old").withColumnRenamed("new", "commit_sha")
    touched = pairs.select(F.col("old").alias("commit_sha")).union(pairs.select(F.col("new").alias("commit_sha"))).distinct()
    return edits.join(touched, "commit_sha", "left_anti").unionByName(alone).unionByName(many.select(edits.columns))


def backfill_merge(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Union that keeps the first edit of each place of a turn, what was there before what is new."""
    both = prior.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    return renumber(keep_first(both, ["commit_sha"], ["__side", "edit_idx"]), ["commit_sha"], ["__side", "edit_idx"]).drop("__side")


def backfill_only(edits: DataFrame) -> DataFrame:
    """commit_sha of notes all of whose edits are reconstructions."""
    kind = F.coalesce(F.col("derived_from.kind") == "backfill", F.lit(False))
    return edits.groupBy("commit_sha").agg(F.bool_and(kind).alias("b")).where("b").select("commit_sha")


def stamp_origin(edits: DataFrame, source: str) -> DataFrame:
    """Edits that came by a cherry-pick from `source` (a column): their origin is its first edit."""
    origin = F.struct(F.lit("rewrite").alias("kind"), F.col(source).alias("source_commit"), F.lit(0).alias("source_edit"), F.lit(None).cast("float").alias("confidence"), F.lit(None).cast("string").alias("transcript_path"))
    return edits.withColumn("derived_from", F.when(F.col(source).isNotNull(), origin).otherwise(F.col("derived_from")))


def new_blobs(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Notes that a remote doesn't have, or has with other content."""
    return local.join(remote.select("commit_sha", "blob").distinct(), ["commit_sha", "blob"], "left_anti")


def repair_pairs(pairs: DataFrame, notes: DataFrame) -> DataFrame:
    """pairs (old, new) with status: the new commit has a note already, or the old one's is to be moved; others are left out."""
    has = notes.select("commit_sha").distinct()
    old = has.select(F.col("commit_sha").alias("old"), F.lit(True).alias("__o"))
    new = has.select(F.col("commit_sha").alias("new"), F.lit(True).alias("__n"))
    both = pairs.where("old != new").join(old, "old", "left").join(new, "new", "left")
    status = F.when(F.col("__n"), "skipped-existing").when(F.col("__o"), "migrated")
    return both.withColumn("status", status).where("status is not null").drop("__o", "__n")


def unreachable(notes: DataFrame, reachable: DataFrame) -> DataFrame:
    return notes.join(reachable.select("commit_sha").distinct(), "commit_sha", "left_anti")


def closure(seeds: DataFrame, parents: DataFrame) -> DataFrame:
    """(commit_sha) of all commits that seeds (commit_sha) reach over parents (commit_sha, parent), the seeds too."""
    known = history.labels(parents.select("commit_sha", "parent"))
    found = history.reached(known, history.reach(known, keep(history.links(known, parents)), seeds))
    return found.union(seeds.select("commit_sha")).distinct()


def commit_range(parents: DataFrame, base: DataFrame, head: DataFrame, order: str = "committed_at") -> DataFrame:
    """(commit_sha, pos): what head (commit_sha) reaches and base (commit_sha) doesn't, the oldest first.

    parents (commit_sha, parent, order), a row for each parent, of a root one with a null parent."""
    known = history.labels(parents.select("commit_sha", "parent"))
    when = parents.groupBy("commit_sha").agg(F.min(order).alias("at"))
    return history.commit_range(known, keep(history.links(known, parents)), base, head, when)


def stale_sessions(activity: DataFrame, now, ttl_seconds: int, at: str = "ts", session: str = "session_id") -> DataFrame:
    """Sessions whose last activity is more than ttl_seconds before now, a column or a table of one row and column; one
    without any counts as stale."""
    last = activity.groupBy(session).agg(F.max(at).alias("last"))
    if isinstance(now, DataFrame):
        one = now.select(F.col(now.columns[0]).alias("__now"), F.lit(1).alias("__k"))
        last, now = last.withColumn("__k", F.lit(1)).join(F.broadcast(one), "__k").drop("__k"), F.col("__now")
    return last.where(F.coalesce(F.col("last"), F.lit(0)) < now - ttl_seconds).select(session, "last")


def compact(edits: DataFrame, cutoff, blobs: DataFrame) -> DataFrame:
    """edits with `compacted`: in notes whose latest edit is older than the cutoff, summaries go, and so do names of blobs
    that are no longer there.  `compacted` says whether the note changed."""
    newest = edits.groupBy("commit_sha").agg(F.max("ts").alias("__newest"))
    there = blobs.select(F.col("blob").alias("original_blob_sha"), F.lit(True).alias("__there")).distinct()
    e = edits.join(newest, "commit_sha").join(there, "original_blob_sha", "left")
    old = F.coalesce((F.col("__newest") < cutoff) & (F.col("__newest").cast("string") != ""), F.lit(False))
    summary = old & F.col("preceding_turns_summary").isNotNull()
    blob = old & F.col("original_blob_sha").isNotNull() & F.col("__there").isNull()
    e = e.withColumns({"preceding_turns_summary": F.when(~summary, F.col("preceding_turns_summary")), "__b": F.when(~blob, F.col("original_blob_sha")), "__c": summary | blob})
    e = e.withColumn("compacted", F.max("__c").over(Window.partitionBy("commit_sha")))
    return e.drop("original_blob_sha", "__newest", "__there", "__c").withColumnRenamed("__b", "original_blob_sha")


def mark_private(edits: DataFrame, commits: DataFrame) -> DataFrame:
    """Edits (with visibility) of the named commits become private; what was private there is replaced."""
    named = commits.select("commit_sha").distinct().withColumn("__named", F.lit(True))
    public = edits.where("visibility = 'public'").select("commit_sha").distinct().withColumn("__public", F.lit(True))
    e = edits.join(named, "commit_sha", "left").join(public, "commit_sha", "left")
    moved = F.col("__named").isNotNull() & F.col("__public").isNotNull()
    kept = e.where(~(moved & (F.col("visibility") == "private")))
    return kept.withColumn("visibility", F.when(moved, "private").otherwise(F.col("visibility"))).drop("__named", "__public")


def redact_history(edits: DataFrame, pattern: str, columns: tuple[str, ...] = ("prompt", "preceding_turns_summary")) -> DataFrame:
    """edits with the pattern's matches replaced in the columns, and `replacements`."""
    out, total = edits, F.lit(0)
    for c in columns:
        done = redact.scrub(c, pattern)
        out = out.withColumn(f"__{c}", done)
        total = total + F.col(f"__{c}.n")
    out = out.withColumn("replacements", total)
    for c in columns:
        out = out.withColumn(c, F.col(f"__{c}.text"))
    return out.drop(*(f"__{c}" for c in columns))


def redaction_stats(edits: DataFrame) -> DataFrame:
    """One row of redact_history()'s result: notes looked at, notes changed, replacements."""
    per = edits.groupBy("commit_sha").agg(F.sum("replacements").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("n") > 0).alias("rewritten"), F.coalesce(F.sum("n"), F.lit(0)).alias("replacements"))


def push_verdicts(lines: DataFrame, private_ref: str = schema.PRIVATE_REF, public_ref: str = schema.PUBLIC_REF) -> DataFrame:
    """lines (local_ref, local_sha, remote_ref, remote_sha) with verdict: block, scan or skip."""
    private = (F.col("local_ref") == private_ref) | (F.col("remote_ref") == private_ref)
    scan = (F.col("local_ref") == public_ref) & (F.col("local_sha") != ZERO_SHA)
    return lines.withColumn("verdict", F.when(private, "block").when(scan, "scan").otherwise("skip"))


def secrets_in_push(edits: DataFrame, rules: tuple[str, ...] = (), columns: tuple[str, ...] = ("prompt", "preceding_turns_summary")) -> DataFrame:
    """(commit_sha, kinds) of notes with something that the detectors find: the sorted kinds."""
    out, kinds = edits, F.array().cast("array<string>")
    for c in columns:
        out = redact.redact(out.withColumn("__in", F.coalesce(F.col(c), F.lit(""))), "__in", rules, out=f"__r_{c}").drop("__in")
        kinds = F.concat(kinds, F.map_keys(f"__r_{c}.counts"))
    # an outer explode infers no filter, which would be pushed below the passes with all of them copied into it
    found = out.select("commit_sha", F.explode_outer(kinds).alias("kind")).where("kind is not null")
    return found.groupBy("commit_sha").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def fetch_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (before, after, new): notes that a fetch brought; fewer than before are none."""
    n = [d.agg(F.count(F.lit(1)).alias(name)).withColumn("k", F.lit(1)) for d, name in ((before, "before"), (after, "after"))]
    return n[0].join(n[1], "k").select("before", "after", F.greatest(F.lit(0).cast("long"), F.col("after") - F.col("before")).alias("new"))


def merge_within(notes: DataFrame, local: str = "local", incoming: str = "incoming") -> DataFrame:
    """notes with `edits`: what merge() makes of the two sides of each note, arrays of edits that lie in its row already, so
    that nothing is moved."""

    def side(name: str, n: int):
        def one(e, i):
            first, last = (F.get(e["line_range"], F.lit(k)) for k in (0, 1))
            tells = lambda f: {"line_start": first, "line_end": last}[f] if f.startswith("line_") else e[f]
            whole = F.struct(*(F.array(first, last).alias(f) if f == "line_range" else e[f].alias(f) for f in schema.EDIT.fieldNames()))
            return F.struct(F.struct(*edit_key(c=tells)).alias("key"), e["timestamp"].alias("ts"), F.lit(-n).alias("side"), (-i).alias("at"), whole.alias("e"))

        return F.transform(name, one)

    def place(x):
        e = x["e"]
        order = (x["ts"], e["conversation_id"], e["turn_index"], e["tool_use_id"], e["file"], e["line_range"][0], e["line_range"][1], -x["side"], -x["at"])
        return F.struct(*(c.alias(f"o{n}") for n, c in enumerate(order)), e.alias("e"))

    keyed = notes.withColumn("__m", F.sort_array(F.concat(side(local, 0), side(incoming, 1))))
    # of each key the last is the latest, and of equal instants the first to arrive
    kept = keyed.withColumn("__m", F.filter("__m", lambda x, i: ~x["key"].eqNullSafe(F.get("__m", i + 1)["key"])))
    return kept.withColumn("edits", F.transform(F.sort_array(F.transform("__m", place)), lambda x: x["e"])).drop("__m")


def resolve_conflicts(conflicts: DataFrame, target_ref: str = schema.PUBLIC_REF, body: str = "body") -> DataFrame:
    """(commit_sha, body, error) of conflicted notes (commit_sha, body): both sides merged into one note, as JSON.

    A text without markers has to be a note, and stays as it is.  A side that is no note, or is of a version that isn't
    known, is an error that names the side and the way back; its commit has no body then.  All is done in the note's row."""
    docs = conflicts.select("commit_sha", F.col(body).alias("__body"))
    sides = split_conflicts(docs, "commit_sha", "__body", "__plain").withColumn("incoming", F.when(F.col("__plain"), note_json(F.array().cast(schema.NOTE["edits"].dataType))).otherwise(F.col("incoming")))
    mine = parse_notes(sides, body="local", beside=("local", "incoming", "__plain")).select("commit_sha", F.col("edits").alias("__local"), F.col("error").alias("__error"), "local", "incoming", "__plain")
    both = parse_notes(mine, body="incoming", beside=("local", "__local", "__error", "__plain")).withColumnRenamed("edits", "__incoming")
    merged = merge_within(both, "__local", "__incoming")
    whose = F.when(F.col("__plain"), "note of ").when(F.col("__error").isNotNull(), "local note of ").otherwise("incoming note of ")
    back = F.lit(f"; `git notes --ref={target_ref} merge --abort` backs out")
    bad = F.coalesce("__error", "error")
    told = F.when(bad.isNotNull(), F.concat(whose, "commit_sha", F.lit(": "), bad, back))
    return merged.select("commit_sha", F.when(bad.isNull(), F.when(F.col("__plain"), trimmed("local")).otherwise(note_json())).alias("body"), told.alias("error"))
