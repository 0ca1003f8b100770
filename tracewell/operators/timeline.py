"""How a change breaks down by session and turn, and which of its lines nobody recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import approximate, counted, quote_prompt

#: Sentences of the document.
SAYS = {
    "contains": "This PR contains ", "across": " across ", "plus": ", plus ", "unexplained": " without provenance", "title": "## PR Intent Timeline", "nothing": "No tracked turns in this PR.",
    "gone": "_(superseded — final code does not contain this turn's output)_", "guess": "_(approximate — backfilled", "human": "pre-existing or human-authored.", "lines": " line(s) without provenance", "turns": " turn(s) · ",
}


def turn_files(resolved: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, conversation_id, turn_index, file, lines) of resolved lines that an edit explains."""
    return resolved.where("status != 'no_provenance'").groupBy(*by, "conversation_id", "turn_index", "file").agg(F.count(F.lit(1)).alias("lines"))


def turns(resolved: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each turn: prompt and instant of its first line (by file, then line), whether any line's origin is a
    guess, and the least confidence of those."""
    some = resolved.where("status != 'no_provenance'").withColumn("a", approximate("derived_from"))
    first = F.min(F.struct("file", "line", "ts", "prompt", "model"))
    t = some.groupBy(*by, "conversation_id", "turn_index").agg(first.alias("f"), F.bool_or("a.approximate").alias("approximate"), F.min("a.confidence").alias("confidence"), F.count(F.lit(1)).alias("lines"), F.count_distinct("file").alias("files"))
    return t.select(*by, "conversation_id", "turn_index", "f.prompt", "f.ts", "f.model", "approximate", "confidence", "lines", "files")


def with_superseded(survivors: DataFrame, pr_turns: DataFrame) -> DataFrame:
    """Turns of a change: those that explain a line, and those of its commits (first edit of each) that don't any more."""
    first = pr_turns.groupBy("conversation_id", "turn_index").agg(F.min_by(F.struct("prompt", "ts", "model", "derived_from"), F.struct("commit_pos", "edit_idx")).alias("f")).select("conversation_id", "turn_index", "f.*")
    gone = first.join(survivors.select("conversation_id", "turn_index"), ["conversation_id", "turn_index"], "left_anti")
    a = approximate("derived_from")
    lost = gone.select("conversation_id", "turn_index", "prompt", "ts", "model", a["approximate"].alias("approximate"), a["confidence"].alias("confidence"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("files"))
    return survivors.unionByName(lost).withColumn("superseded", F.col("files") == 0)


def sessions(turn_table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each conversation (of each document, by): first instant, model of its first turn, number of turns, lines,
    and its ordinal in order of start, then of the conversation."""
    model = F.min_by("model", F.struct("ts", "turn_index"))
    s = turn_table.groupBy(*by, "conversation_id").agg(F.min("ts").alias("started_at"), model.alias("model"), F.count(F.lit(1)).alias("turns"), F.sum("lines").alias("lines"))
    # a document has a session for each conversation of one change
    return s.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy("started_at", "conversation_id")))


def ranges(lines: DataFrame, by: tuple[str, ...] = ("file",), line: str = "line") -> DataFrame:
    """(*by, line_start, line_end): runs of consecutive line numbers."""
    island = F.col(line) - F.row_number().over(Window.partitionBy(*by).orderBy(line))
    distinct = lines.select(*by, line).distinct()
    return distinct.withColumn("__i", island).groupBy(*by, "__i").agg(F.min(line).alias("line_start"), F.max(line).alias("line_end")).drop("__i")


def no_provenance(resolved: DataFrame) -> DataFrame:
    return ranges(resolved.where("status = 'no_provenance'"))


def capped(lines: DataFrame, most: int, by: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """Lines within a change's budget of lookups: past it the rest of the file at hand is unexplained, later files go.

    Lines are counted per file first, so only files are put in order in one task."""
    per = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = lines.join(per.select("file", before.alias("before")), "file")
    number = F.col("before") + F.row_number().over(Window.partitionBy("file").orderBy(*by))
    return at.where(F.col("before") < most).withColumn("looked_up", number <= most).drop("before")


def totals(turn_table: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: turns, sessions, lines without provenance."""
    t = turn_table.agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conversation_id").alias("sessions")).withColumn("k", F.lit(1))
    n = resolved.agg(F.count_if(F.col("status") == "no_provenance").alias("unexplained")).withColumn("k", F.lit(1))
    return t.join(n, "k").drop("k")


def counts(resolved: DataFrame) -> DataFrame:
    """totals() of resolved lines, which are read once: sums by turn, then of these."""
    silent = F.col("status") == "no_provenance"
    each = resolved.groupBy("conversation_id", "turn_index").agg(F.count_if(silent).alias("silent"), F.count_if(~silent).alias("told"))
    told = F.col("told") > 0
    return each.agg(F.count_if(told).alias("turns"), F.count_distinct(F.when(told, F.col("conversation_id"))).alias("sessions"), F.coalesce(F.sum("silent"), F.lit(0)).alias("unexplained"))


def summary_line(turns_: Column, sessions_: Column, unexplained: Column, product: str) -> Column:
    tail = F.when(unexplained > 0, F.concat(F.lit(SAYS["plus"]), counted(unexplained, "line", "lines"), F.lit(SAYS["unexplained"]))).otherwise("")
    return F.concat(F.lit(SAYS["contains"]), counted(turns_, "turn", "turns"), F.lit(SAYS["across"]), sessions_.cast("string"), F.lit(f" {product} "), F.when(sessions_ == 1, "session").otherwise("sessions"), tail, F.lit("."))


def turn_lines(turn_table: DataFrame, files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """turns with `bullet`: the text of a turn's entry, but for its number."""
    keys = [*by, "conversation_id", "turn_index"]
    listed = files.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file", "lines"))), lambda f: F.format_string("%s (%d lines)", f["file"].cast("string"), f["lines"])), ", ").alias("listed"))
    prompt = quote_prompt("prompt")
    guess = F.when(~F.col("approximate"), "").when(F.col("confidence").isNull(), f" {SAYS['guess']})_").otherwise(F.format_string(f" {SAYS['guess']}, confidence %.2f)_", F.col("confidence").cast("double")))
    joined = turn_table.join(listed, keys, "left")
    gone = F.concat(F.lit("~~"), prompt, F.lit(f"~~ {SAYS['gone']}"), guess)
    plain = F.concat(F.lit("**"), prompt, F.lit("**"), F.when(F.col("listed").isNotNull(), F.concat(F.lit(" — _"), F.col("listed"), F.lit("_"))).otherwise(""), guess)
    superseded = F.col("superseded") if "superseded" in turn_table.columns else F.lit(False)
    return joined.withColumn("bullet", F.when(superseded, gone).otherwise(plain)).drop("listed")


def document(changes: DataFrame, turn_table: DataFrame, files: DataFrame, resolved: DataFrame, product: str, footer: str, by: str = "pr") -> DataFrame:
    """(by, body): the Markdown document of each change: title, summary, its sessions in order of start with their turns in
    order, ranges of lines that nobody recorded, and the footer.

    changes (by), turns and files of turns() and turn_files() with `by`, resolved (by, file, line, status).  What meets in
    a row is one change's document, which the budget of lookups bounds."""
    keys = (by,)
    numbered = turn_lines(turn_table, files, keys)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn_index", "bullet"))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["bullet"], F.lit("\n"))), "")
    entries = numbered.groupBy(by, "conversation_id").agg(listed.alias("listed"))
    s = sessions(turn_table, keys).join(entries, [by, "conversation_id"])
    head = F.concat(F.lit("### Session "), F.col("ordinal").cast("string"), F.lit(" — `"), F.col("conversation_id").cast("string"), F.lit("` · "), F.substring("started_at", 1, 10), F.lit(" · "), F.col("turns").cast("string"), F.lit(SAYS["turns"]), F.coalesce("model", F.lit("")), F.lit("\n\n"))
    told = s.groupBy(by).agg(F.count(F.lit(1)).alias("sessions"), F.sum("turns").alias("turns"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.concat(head, "listed", F.lit("\n")).alias("text")))), lambda x: x["text"]), "").alias("told"))
    silent = resolved.where("status = 'no_provenance'")
    span = F.when(F.col("line_start") == F.col("line_end"), F.col("line_start").cast("string")).otherwise(F.concat(F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")))
    item = F.concat(F.lit("- `"), F.col("file").cast("string"), F.lit(":"), span, F.lit(f"` — {SAYS['human']}\n"))
    items = ranges(silent, (by, "file")).groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file", "line_start", item.alias("text")))), lambda x: x["text"]), "").alias("items"))
    unexplained = silent.groupBy(by).agg(F.count(F.lit(1)).alias("unexplained"))
    d = changes.select(by).distinct().join(told, by, "left").join(items, by, "left").join(unexplained, by, "left").fillna(0, ["sessions", "turns", "unexplained"])
    open_lines = F.when(F.col("unexplained") > 0, F.concat(F.lit("### "), F.col("unexplained").cast("string"), F.lit(f"{SAYS['lines']}\n"), "items", F.lit("\n"))).otherwise("")
    whole = F.concat(summary_line(F.col("turns"), F.col("sessions"), F.col("unexplained"), product), F.lit("\n\n"), F.coalesce("told", F.lit("")), open_lines)
    body = F.when((F.col("sessions") == 0) & (F.col("unexplained") == 0), F.lit(f"{SAYS['nothing']}\n")).otherwise(whole)
    return d.select(by, F.concat(F.lit(f"{SAYS['title']}\n\n"), body, F.lit(f"{footer}\n")).alias("body"))
