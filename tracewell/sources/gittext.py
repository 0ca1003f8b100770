"""Line protocols: rewrite pairs, push lines, reflogs, commit lists, trees, rule files, conflicted notes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.functions.text import SPACE, is_full_sha, is_rewrite_subject, text_lines, trimmed

#: Starts of the lines that mark a conflict's sides.
OURS, BETWEEN, THEIRS = "<<<<<<<", "=======", ">>>>>>>"


def rewrite_pairs(lines: DataFrame, line: str = "line") -> DataFrame:
    """(old, new) of `old new` lines; other lines are dropped."""
    part = F.split(trimmed(line), SPACE + "+")
    return lines.select(F.get(part, 0).alias("old"), F.get(part, 1).alias("new")).where(is_full_sha("old") & is_full_sha("new"))


def push_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    part = F.split(trimmed(line), SPACE + "+")
    names = ("local_ref", "local_sha", "remote_ref", "remote_sha")
    return lines.where(F.size(part) >= 4).select(*(F.get(part, i).alias(n) for i, n in enumerate(names)))


def reflog(lines: DataFrame, line: str = "line", pos: str = "pos", ref: str = "ref") -> DataFrame:
    """(ref, pos, sha, subject), newest first by pos."""
    part = F.split(F.col(line), " ", 2)
    return lines.select(F.col(ref).alias("ref"), F.col(pos).alias("pos"), F.get(part, 0).alias("sha"), F.coalesce(F.get(part, 1), F.lit("")).alias("subject")).where(is_full_sha("sha"))


def reflog_rewrites(entries: DataFrame) -> DataFrame:
    """(ref, old, new): an entry that ends a rewrite and the entry before it in time."""
    older = F.lead("sha").over(Window.partitionBy("ref").orderBy("pos"))
    pairs = entries.withColumn("old", older).where(is_rewrite_subject("subject") & F.col("old").isNotNull() & (F.col("old") != F.col("sha")))
    return pairs.select("ref", "old", F.col("sha").alias("new"))


def commits(lines: DataFrame, line: str = "line", pos: str = "pos", most: int = schema.MAX_COMMITS) -> DataFrame:
    """(pos, sha, author_email, committed_at) of tab-separated lines, the first `most` by pos."""
    part = F.split(F.col(line), "\t")
    rows = lines.select(F.col(pos).alias("pos"), F.get(part, 0).alias("sha"), F.get(part, 1).alias("author_email"), F.get(part, 2).try_cast("bigint").alias("committed_at"))
    return rows.where("committed_at is not null").orderBy("pos").limit(most)


def tree(lines: DataFrame, line: str = "line") -> DataFrame:
    """(commit_sha, blob) of a notes tree; a path is its commit cut by slashes."""
    got = lines.select(F.regexp_extract(line, r"^\d+ blob ([0-9a-f]+)\t(.*)$", 1).alias("blob"), F.replace(F.regexp_extract(line, r"^\d+ blob ([0-9a-f]+)\t(.*)$", 2), F.lit("/"), F.lit("")).alias("commit_sha"))
    return got.where(is_full_sha("commit_sha")).select("commit_sha", "blob")


def rules(text: str) -> list[str]:
    """A rule file's patterns; a bad one is named by its line."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.strip().startswith("#"):
            continue
        try:
            re.compile(line.strip())
        except re.error as e:
            raise ValueError(f"line {n}: {e}") from e
        out.append(line.strip())
    return out


def split_conflicts(docs: DataFrame, key: str, body: str, plain: str | None = None) -> DataFrame:
    """(key, local, incoming): both sides of conflicted texts; lines outside the markers belong to both.

    Each line's side follows from the last marker that counted before it: the middle one only counts inside the first
    side, the end only inside the second.  Texts without a marker are left out, or with `plain` stay, and a column of that
    name tells them: their one side is the text, the other null."""
    step = F.aggregate(
        text_lines(body),
        F.expr("named_struct('side', 0, 'seen', false, 'local', cast(array() as array<string>), 'incoming', cast(array() as array<string>))"),
        lambda s, x: F.when(F.startswith(x, F.lit(OURS)), _side(s, 1, True))
        .when(F.startswith(x, F.lit(BETWEEN)) & (s["side"] == 1), _side(s, 2))
        .when(F.startswith(x, F.lit(THEIRS)) & (s["side"] == 2), _side(s, 0))
        .otherwise(
            F.struct(
                s["side"].alias("side"), s["seen"].alias("seen"), F.when(s["side"] != 2, F.concat(s["local"], F.array(x))).otherwise(s["local"]).alias("local"),
                F.when(s["side"] != 1, F.concat(s["incoming"], F.array(x))).otherwise(s["incoming"]).alias("incoming"),
            )
        ),
    )
    parts = docs.select(F.col(key), step.alias("s"), *([F.col(body).alias("__text")] if plain else []))
    if plain is None:
        parts = parts.where("s.seen")

    def joined(side: str):
        return F.array_join(F.transform(F.col(f"s.{side}"), lambda x: F.concat(x, F.lit("\n"))), "").alias(side)

    if plain is None:
        return parts.select(key, joined("local"), joined("incoming"))
    seen = F.coalesce("s.seen", F.lit(False))
    return parts.select(key, F.when(seen, joined("local")).otherwise(F.col("__text")).alias("local"), F.when(seen, joined("incoming")).alias("incoming"), (~seen).alias(plain))


def _side(s, side: int, seen: bool | None = None):
    return F.struct(F.lit(side).alias("side"), (F.lit(True) if seen else s["seen"]).alias("seen"), s["local"].alias("local"), s["incoming"].alias("incoming"))
