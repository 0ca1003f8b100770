"""Matching of recorded lines with a change's added lines, and of sessions with commits."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import schema
from tracewell.functions.text import normalize_line
from tracewell.plans.materialize import counted, small


def longest_run(needle: np.ndarray, added: np.ndarray) -> tuple[int, int, int]:
    """(needle_start, added_start, length) of the longest run that both sequences of numbers have; of equal ones the first
    in the needle, then the first in the other.

    Runs of 1, 2, 4, ... are numbered so that equal ones have one number; the length is then found by halving."""
    n, text = len(needle), np.concatenate([needle, [-1], added, [-2]])

    def numbered(k: int) -> np.ndarray:
        """Numbers of the runs of k that begin at each place; sizes are put together out of powers of two."""
        out, done = None, 0
        for power, rank in enumerate(ranks):
            if k >> power & 1:
                if out is None:
                    out, done = rank, 1 << power
                else:
                    after = np.full(len(text), -1, np.int64)
                    after[: len(text) - done] = rank[done:]
                    out, done = np.unique(out * (len(text) + 2) + after + 1, return_inverse=True)[1].astype(np.int64), done + (1 << power)
        return out

    ranks = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
    most = min(n, len(added))
    while 2 << (len(ranks) - 1) <= most:
        k = 1 << (len(ranks) - 1)
        after = np.full(len(text), -1, np.int64)
        after[: len(text) - k] = ranks[-1][k:]
        ranks.append(np.unique(ranks[-1] * (len(text) + 2) + after + 1, return_inverse=True)[1].astype(np.int64))

    def first(k: int) -> tuple[int, int] | None:
        number = numbered(k)
        a, b = number[: n - k + 1], number[n + 1 : n + 1 + len(added) - k + 1]
        common = np.isin(a, b)
        if not common.any():
            return None
        at = int(common.argmax())
        return at, int((b == a[at]).argmax())

    low, high, best = 0, most, None
    while low < high:
        k = (low + high + 1) // 2
        found = first(k)
        if found is None:
            high = k - 1
        else:
            low, best = k, found
    return (*best, low) if best else (0, 0, 0)


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            found = [longest_run(np.array(n, np.int64), np.array(a, np.int64)) if n and a else (0, 0, 0) for n, a in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            starts, others, lengths = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(starts, pa.int32()), pa.array(others, pa.int32()), pa.array(lengths, pa.int64())], names=["key", "needle_start", "added_start", "length"])


def best_windows(needles: DataFrame, added: DataFrame, on: tuple[str, ...] = ("pair",), most_lines: int = schema.MAX_WINDOW_LINES) -> DataFrame:
    """(*on, needle_lines, needle_start, added_start, length) of the longest run of equal lines, if it is half the needle or more.

    needles (*on, pos, h), added (*on, pos, h).  Of equal runs the first in the needle, then the first in the added lines.
    Pairs with a side of more than most_lines lines match nothing.  Each pair's two sequences meet in one row, so lines
    that both have many times cost no more than others."""

    def side(lines: DataFrame, name: str) -> DataFrame:
        one = lines.groupBy(*on).agg(F.count(F.lit(1)).alias(f"{name}_lines"), F.sort_array(F.collect_list(F.struct("pos", F.xxhash64("h").alias("x")))).alias(name))
        return one.where(F.col(f"{name}_lines") <= most_lines)

    size = lambda d: d.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_lines).select(*on)
    fits = size(needles).join(size(added), list(on))
    met = side(needles.join(fits, list(on), "left_semi"), "needle").join(side(added.join(fits, list(on), "left_semi"), "added"), list(on))
    rows = met.select(F.struct(*on, "needle_lines").alias("key"), F.col("needle.x").alias("needle"), F.col("added.x").alias("added"))
    return longest_runs(rows)


def longest_runs(rows: DataFrame) -> DataFrame:
    """(key.*, needle_start, added_start, length) of rows (key, needle, added), two sequences of numbers each; key has
    needle_lines, of which the run must be half."""
    shape = T.StructType([rows.schema["key"], *T.StructType.fromDDL("needle_start int, added_start int, length long").fields])
    return rows.mapInArrow(_longest, shape).select("key.*", "needle_start", "added_start", "length").where("length > 0 and length * 2 >= needle_lines")


class Lines:
    """Lines in which runs of lines are looked for: a suffix array over their numbers, by doubling."""

    def __init__(self, lines: list[str | None]):
        self.numbers: dict[str | None, int] = {}
        self.text = [self.numbers.setdefault(x, len(self.numbers)) for x in lines]
        rank, k, n = np.array(self.text, np.int64), 1, len(lines)
        while k < n and len(np.unique(rank)) < n:
            after = np.zeros(n, np.int64)
            after[: n - k] = rank[k:] + 1
            rank, k = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64), 2 * k
        self.order = np.argsort(rank, kind="stable").tolist()

    def find(self, wanted: list[str]) -> int | None:
        """The first place at which the wanted lines stand one after another."""
        run = [self.numbers.get(x, -1) for x in wanted]
        if not run or -1 in run:
            return None
        beginning = lambda i: self.text[i : i + len(run)]
        low = bisect_left(self.order, run, key=beginning)
        high = bisect_right(self.order, run, low, key=beginning)
        return min(self.order[low:high]) if low < high else None


def _located(edits: pa.Table, added: pa.Table) -> pa.Table:
    """Edits of a file that match its added lines, with where and how; the lines are put in order once for all edits."""
    keep, places = [], []
    if edits.num_rows and added.num_rows:
        added = added.sort_by("pos")
        number = added.column("line_no").to_pylist()
        ways = [(name, edits.column(mine).to_pylist(), Lines(added.column(theirs).to_pylist())) for name, mine, theirs in (("exact", "after", "content"), ("normalized", "__after", "__content"))]
        for i, (start, end) in enumerate(zip(edits.column("line_start").to_pylist(), edits.column("line_end").to_pylist(), strict=True)):
            for name, lines, have in ways:
                wanted = [x for x in lines[i] or () if x]
                at = have.find(wanted)
                if at is not None:
                    keep.append(i)
                    places.append((number[at], number[at + len(wanted) - 1], name))
                    break
            else:
                n = 0 if start is None or end is None else max(0, end - start + 1)
                if n and max(0, min(end, number[-1]) - max(start, number[0]) + 1) * 2 >= n:
                    keep.append(i)
                    places.append((number[0], number[-1], "proximity"))
    out = edits.drop_columns(["__after", "__part"]).take(pa.array(keep, pa.int64()))
    first, last, how = zip(*places, strict=True) if places else ((), (), ())
    return out.append_column("match_start", pa.array(first, pa.int32())).append_column("match_end", pa.array(last, pa.int32())).append_column("strategy", pa.array(how, pa.string()))


#: Edits of a file that are looked for in one task.
TOGETHER = 4096


def match_edits(edits: DataFrame, added: DataFrame, together: int = TOGETHER) -> DataFrame:
    """edits with (match_start, match_end, strategy): where a staged edit lies in a commit's added lines.

    edits (edit_id, file, after array<string>, line_start, line_end), added (file, pos, line_no, content).  First the
    edit's lines as they are, one after another among the added lines; then both normalised; then the whole window of
    added lines if it covers half the captured range.  Empty lines of the edit are passed over, empty added lines aren't.
    Edits that match nothing are left out.

    A file's edits and its added lines meet once; edits of a file that has very many are dealt into parts."""
    sides = edits.withColumn("__after", F.transform("after", normalize_line)), added.select("file", "pos", F.col("line_no").cast("int").alias("line_no"), "content", normalize_line("content").alias("__content"))
    many, (n,) = counted(edits.groupBy("file").count().where(F.col("count") > together).select("file", F.ceil(F.col("count") / together).cast("int").alias("__n")))
    if n:
        parts = small(many, n)
        mine = sides[0].join(parts, "file", "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*(c for c in edits.columns if c != "file")), F.col("__n")), F.lit(0)).cast("int")).drop("__n")
        theirs = sides[1].join(parts, "file", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__n", F.lit(1)) - 1))).drop("__n")
    else:
        mine, theirs = (d.withColumn("__part", F.lit(0)) for d in sides)
    mine = mine.select(*edits.columns, "__after", "__part")
    schema_ = T.StructType([*edits.schema.fields, *T.StructType.fromDDL("match_start int, match_end int, strategy string").fields])
    return mine.groupBy("file", "__part").cogroup(theirs.groupBy("file", "__part")).applyInArrow(_located, schema_)


def session_commits(sessions: DataFrame, commits: DataFrame, pad: int = schema.WINDOW_PAD_SECONDS, on: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """Sessions (session_id, start, end, ...) with the commits (sha, committed_at, ...) within pad seconds of them.

    Windows are cut into pieces of 4 pad seconds, or of width, that lie in two cells at most, so the join has a key; the exact
    bounds are a condition.  A piece is of the cell in which it begins, and a commit goes to its own cell and the one before, as
    commits are fewer and narrower than sessions.  `on` names what both sides also have in common, as the repository: without
    it every session of a cell meets every commit of it, and session_totals and session_bests are what doesn't make these pairs."""
    width = width or 4 * pad
    s = _pieces(sessions, pad, width).withColumn("cell", F.expr(f"floor(__lo / {width})"))
    c = commits.withColumn("cell", F.explode(F.expr(f"sequence(floor(committed_at / {width}) - 1, floor(committed_at / {width}))")))
    return s.join(c, [*on, "cell"]).where((F.col("committed_at") >= F.col("__lo")) & (F.col("committed_at") <= F.col("__hi"))).drop("cell", "__lo", "__hi")


def _pieces(sessions: DataFrame, pad: int, most: int) -> DataFrame:
    """A session's window, of pad seconds around it, as (__lo, __hi) of at most so many seconds: mostly one row."""
    s = sessions.withColumns({"__lo": F.col("start") - pad, "__hi": F.col("end") + pad}).where("__lo <= __hi")
    s = s.withColumn("__lo", F.explode(F.expr(f"sequence(cast(__lo as bigint), cast(__hi as bigint), {most}L)")))
    return s.withColumn("__hi", F.least(F.col("__hi"), F.col("__lo") + (most - 1)))


#: Seconds of a block in which sessions meet commits, and sessions of a block that meet them in one task.
BLOCK, SESSIONS = 16 * 3600, 1 << 16


def _least(rank: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of the least rank in the non-empty ranges [i, j), from tables of runs of 1, 2, 4, ... places."""
    best, tables = np.arange(len(rank)), []
    while True:
        tables.append(best)
        k = 1 << (len(tables) - 1)
        if 2 * k > len(rank):
            break
        left, right = best[:-k], best[k:]
        best = np.where(rank[left] <= rank[right], left, right)
    level, out = np.frexp((j - i).astype(np.float64))[1] - 1, np.zeros(len(i), np.int64)
    for k, table in enumerate(tables):
        at = np.flatnonzero(level == k)
        left, right = table[i[at]], table[j[at] - (1 << k)]
        out[at] = np.where(rank[left] <= rank[right], left, right)
    return out


def _by_block(sessions: DataFrame, moments: DataFrame, pad: int, within, fields: str, block: int, together: int) -> DataFrame:
    """What within(sessions, moments, i, j) makes of each block: of its moments in order of time those from i to j are in a
    session's window.  A session has a row for each piece of its window, of 2 blocks' length, in which there are any.

    moments has a row a second, so a block's are bounded however many commits there are; they go to the three blocks from
    which a piece may reach them, so that sessions, of which there are any number, go to one.  Sessions of a block that has
    very many are dealt into parts."""
    s = _pieces(sessions.select("session_id", "start", "end"), pad, 2 * block).select("session_id", "__lo", "__hi", F.expr(f"floor(__lo / {block})").alias("__block"))
    c = moments.withColumn("__block", F.explode(F.expr(f"sequence(floor(committed_at / {block}) - 2, floor(committed_at / {block}))")))
    many, (n,) = counted(s.groupBy("__block").count().where(F.col("count") > together).select("__block", F.ceil(F.col("count") / together).cast("int").alias("__n")))
    if n:
        parts = small(many, n)
        s = s.join(parts, "__block", "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64("session_id"), F.col("__n")), F.lit(0)).cast("int")).drop("__n")
        c = c.join(parts, "__block", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__n", F.lit(1)) - 1))).drop("__n")
    else:
        s, c = (d.withColumn("__part", F.lit(0)) for d in (s, c))

    def met(windows: pa.Table, seconds: pa.Table) -> pa.Table:
        seconds = seconds.sort_by("committed_at")
        at = seconds.column("committed_at").to_numpy()
        i, j = np.searchsorted(at, windows.column("__lo").to_numpy(), "left"), np.searchsorted(at, windows.column("__hi").to_numpy(), "right")
        any_ = np.flatnonzero(j > i)
        return within(windows.take(pa.array(any_)).select(["session_id"]), seconds, i[any_], j[any_])

    shape = T.StructType([sessions.schema["session_id"], *T.StructType.fromDDL(fields).fields])
    return s.groupBy("__block", "__part").cogroup(c.groupBy("__block", "__part")).applyInArrow(met, shape)


def _ranks(table: pa.Table, keys: list[tuple[str, str]], nulls: str) -> np.ndarray:
    rank = np.empty(table.num_rows, np.int64)
    rank[pc.sort_indices(table, sort_keys=keys, null_placement=nulls).to_numpy()] = np.arange(table.num_rows)
    return rank


def session_totals(sessions: DataFrame, commits: DataFrame, pad: int = schema.WINDOW_PAD_SECONDS, block: int = BLOCK, together: int = SESSIONS) -> DataFrame:
    """(session_id, commits, first_sha, last_sha) of the commits within pad seconds of each session that has any: their
    number, least and greatest, from sums and extremes of each second and no pairs."""
    kind = commits.schema["sha"].dataType.simpleString()
    moments = commits.where("committed_at is not null").groupBy("committed_at").agg(F.count(F.lit(1)).alias("n"), F.min("sha").alias("first"), F.max("sha").alias("last"))

    def within(met: pa.Table, seconds: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.Table:
        before = np.concatenate([[0], np.cumsum(seconds.column("n").to_numpy())])
        first = seconds.column("first").take(pa.array(_least(_ranks(seconds, [("first", "ascending")], "at_end"), i, j)))
        last = seconds.column("last").take(pa.array(_least(_ranks(seconds, [("last", "descending")], "at_end"), i, j)))
        return met.append_column("n", pa.array(before[j] - before[i], pa.int64())).append_column("first", first).append_column("last", last)

    found = _by_block(sessions, moments, pad, within, f"n long, first {kind}, last {kind}", block, together)
    return found.groupBy("session_id").agg(F.sum("n").alias("commits"), F.min("first").alias("first_sha"), F.max("last").alias("last_sha"))


def session_bests(sessions: DataFrame, commits: DataFrame, score: str = "confidence", pos: str = "pos", pad: int = schema.WINDOW_PAD_SECONDS, block: int = BLOCK, together: int = SESSIONS) -> DataFrame:
    """(session_id, score, pos, ...): of the commits within pad seconds of each session those that best_commits may choose
    from, one for each piece of its window; the score is the commit's own, whichever session it meets."""
    rest = [c for c in commits.columns if c not in ("committed_at", score, pos)]
    worth = F.struct(F.col(score).isNull(), -F.col(score), F.col(pos))
    moments = commits.where("committed_at is not null").groupBy("committed_at").agg(F.min_by(F.struct(score, pos, *rest), worth).alias("b")).select("committed_at", "b.*")
    names = [score, pos, *rest]

    def within(met: pa.Table, seconds: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.Table:
        chosen = seconds.select(names).take(pa.array(_least(_ranks(seconds, [(score, "descending"), (pos, "ascending")], "at_end"), i, j)))
        for name in names:
            met = met.append_column(name, chosen.column(name))
        return met

    fields = ", ".join(f"`{c}` {commits.schema[c].dataType.simpleString()}" for c in names)
    return _by_block(sessions, moments, pad, within, fields, block, together)


def best_commits(scored: DataFrame, session: str = "session_id", score: str = "confidence", pos: str = "pos") -> DataFrame:
    """A session's row of the highest score; of equal ones the first in the log."""
    order = Window.partitionBy(session).orderBy(F.desc(score), pos)
    return scored.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def confidence(matched, total):
    return F.when(F.col(total) > 0, F.col(matched).cast("double") / F.col(total))


def locate_files(captured: DataFrame, in_diff: DataFrame) -> DataFrame:
    """captured (id, path) with the file of a diff that it is, or that it ends with; the longest of several.

    Both have the last part of the path in common, so a path meets files by its ends from each place on up to that part: as
    many rows as it has characters, however many files are called the same.  Equal paths are looked for once."""
    paths = captured.select("path").where("path is not null").distinct()
    ends = paths.select("path", F.explode(F.expr("sequence(1, char_length(path) - char_length(element_at(split(path, '/'), -1)) + 1)")).alias("__p"))
    ends = ends.select("path", F.expr("substring(path, __p)").alias("file"))
    files = in_diff.select("file").distinct()
    found = ends.join(files, "file").groupBy("path").agg(F.max_by("file", F.length("file")).alias("file"))
    return captured.select("id", "path").distinct().join(found, "path").select("id", "path", "file")


def finished_sessions(matched: DataFrame, staged: DataFrame) -> DataFrame:
    """session_id of sessions all of whose staged edits matched."""
    t = staged.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"))
    m = matched.groupBy("session_id").agg(F.count(F.lit(1)).alias("matched"))
    return t.join(m, "session_id").where("total > 0 and matched = total").select("session_id")


def accepted(matches: DataFrame, author: str | None, any_author: bool = False, include_low: bool = False, least: float = schema.MIN_CONFIDENCE) -> DataFrame:
    """matches with status: below the floor, by another author, or accepted."""
    low = F.col("confidence") < (0.0 if include_low else least)
    other = F.lit(False) if any_author or author is None else F.coalesce(F.lower("author_email") != author.lower(), F.lit(True))
    return matches.withColumn("status", F.when(low, "skipped-low-confidence").when(other, "skipped-cross-author").otherwise("written"))
