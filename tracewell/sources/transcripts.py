"""Session transcripts: one JSON event a line.

A line table has (session_file, line_no, value).  Order within a file is the truth about turns; timestamps are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.functions.text import trimmed


def read_lines(spark: SparkSession, path: str, most_bytes: int = schema.MAX_PAYLOAD_BYTES) -> DataFrame:
    """(session_file, line_no, value) of the .jsonl files at path; files beyond most_bytes are left out."""
    files = spark.read.option("pathGlobFilter", "*.[jJ][sS][oO][nN][lL]").text(path, wholetext=True)
    rows = files.where(F.col("_metadata.file_size") <= most_bytes).select(F.col("_metadata.file_path").alias("session_file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    return rows.where(trimmed("value") != "")


def _text(v, path: str) -> Column:
    """A string at a path; null where something else is there."""
    value = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(v, path, "string"))


def events(lines: DataFrame) -> DataFrame:
    """Lines that are JSON objects, with what the operators ask of them."""
    v = lines.withColumn("v", F.try_parse_json("value")).where("v is not null").where(F.schema_of_variant("v").startswith("OBJECT"))
    content = F.try_variant_get("v", "$.message.content", "variant")
    blocks = F.try_variant_get("v", "$.message.content", "array<variant>")
    texts = F.transform(F.filter(blocks, lambda b: _text(b, "$.type") == "text"), lambda b: _text(b, "$.text"))
    results = F.exists(blocks, lambda b: F.coalesce(_text(b, "$.type") == "tool_result", F.lit(False)))
    prompt = F.when(F.schema_of_variant(content) == "STRING", trimmed(F.try_variant_get("v", "$.message.content", "string"))).when(~F.coalesce(results, F.lit(False)), trimmed(F.array_join(F.array_compact(texts), "\n")))
    return v.select(
        "session_file", "line_no", _text(F.col("v"), "$.type").alias("type"), _text(F.col("v"), "$.sessionId").alias("session_id"), _text(F.col("v"), "$.promptId").alias("prompt_id"),
        F.coalesce(F.try_variant_get("v", "$.isMeta", "boolean"), F.lit(False)).alias("is_meta"), _text(F.col("v"), "$.timestamp").alias("ts"), _text(F.col("v"), "$.cwd").alias("cwd"),
        _text(F.col("v"), "$.message.model").alias("model"), F.when(prompt != "", prompt).alias("prompt"), F.filter(blocks, lambda b: _text(b, "$.type") == "tool_use").alias("tools"),
    )


def turns(ev: DataFrame) -> DataFrame:
    """(session_file, line_no, turn_index, prompt_id, ts, prompt): the first usable event of each prompt id, numbered by line."""
    usable = ev.where("type = 'user' and not is_meta and prompt_id is not null and prompt is not null")
    first = usable.withColumn("n", F.row_number().over(Window.partitionBy("session_file", "prompt_id").orderBy("line_no"))).where("n = 1")
    number = F.row_number().over(Window.partitionBy("session_file").orderBy("line_no")) - 1
    return first.select("session_file", "line_no", number.alias("turn_index"), "prompt_id", "ts", "prompt")


def session_table(ev: DataFrame) -> DataFrame:
    """First session id, first non-empty folder, first and last instant, last non-empty model of an assistant."""
    at = F.col("line_no")

    def first(c: str, ok=None):
        return F.min_by(c, F.when(F.col(c).isNotNull() if ok is None else ok, at))

    model = F.when((F.col("type") == "assistant") & (F.col("model") != ""), at)
    return ev.groupBy("session_file").agg(
        first("session_id").alias("session_id"), first("cwd", F.col("cwd") != "").alias("cwd"), first("ts").alias("started_at"),
        F.max_by("ts", F.when(F.col("ts").isNotNull(), at)).alias("ended_at"), F.max_by("model", model).alias("model"),
    )


def latest_model(ev: DataFrame) -> DataFrame:
    """Model of a session's last assistant event whose model isn't empty; one without any model after it leaves it unknown."""
    said = ev.where("type = 'assistant'")
    last_named = F.max(F.when(F.col("model") != "", F.col("line_no")))
    last_without = F.max(F.when(F.col("model").isNull(), F.col("line_no")))
    per = said.groupBy("session_file").agg(F.max_by("model", F.when(F.col("model") != "", F.col("line_no"))).alias("model"), last_named.alias("named"), last_without.alias("without"))
    return per.select("session_file", F.when(F.coalesce(F.col("without") < F.col("named"), F.lit(True)), F.col("model")).alias("model"))


_EDIT_ROWS = "array<struct<file:string,before:string,after:string>>"


def tool_edits(uses: DataFrame, name: str, given: str) -> DataFrame:
    """uses with (part, e), a row for each edit (file, before, after) of what a tool was given; the parts of a MultiEdit are
    edits of their own, a patch one for each file.

    The fields of the variant are columns first, so that each is read once."""
    v = F.col(given)
    fields = {"file": _text(v, "$.file_path"), "old": _text(v, "$.old_string"), "new": _text(v, "$.new_string"), "content": _text(v, "$.content"), "command": _text(v, "$.command")}
    read = uses.withColumns({f"__{k}": c for k, c in fields.items()} | {"__parts": F.try_variant_get(v, "$.edits", "array<variant>")})
    text = lambda c: F.coalesce(c, F.lit(""))
    one = lambda before, after: F.struct(F.col("__file").alias("file"), before.alias("before"), after.alias("after"))
    multi = F.transform("__parts", lambda e: one(text(_text(e, "$.old_string")), text(_text(e, "$.new_string"))))
    patch = F.transform(patch_files(F.col("__command")), lambda p: F.struct(p["file"].alias("file"), F.lit("").alias("before"), p["added"].alias("after")))
    is_write, has = F.col(name) == "Write", F.col("__file").isNotNull()
    single = F.array(one(F.when(is_write, "").otherwise(text(F.col("__old"))), F.when(is_write, text(F.col("__content"))).otherwise(text(F.col("__new")))))
    kinds = ((F.col(name).isin("Edit", "Write") & has, single), ((F.col(name) == "MultiEdit") & has, multi), (F.col(name) == schema.PATCH_TOOL, patch))
    made = [read.where(which).select(*uses.columns, F.posexplode(found.cast(_EDIT_ROWS)).alias("part", "e")) for which, found in kinds]
    return made[0].unionByName(made[1]).unionByName(made[2])


def patch_files(command: Column) -> Column:
    """(file, added text) of a patch: the `+` lines under each file header; a file without any is left out."""
    sections = F.slice(F.split(F.concat(F.lit("\n"), F.coalesce(command, F.lit(""))), r"\n\*\*\* (?:Update|Add) File: "), 2, 1 << 30)

    def section(s: Column) -> Column:
        lines = F.split(s, r"\r?\n")
        added = F.transform(F.filter(F.slice(lines, 2, 1 << 30), lambda x: F.startswith(x, F.lit("+"))), lambda x: F.substring(x, F.lit(2), F.length(x)))
        return F.struct(trimmed(lines[0]).alias("file"), F.array_join(added, "\n").alias("added"), F.size(added).alias("n"))

    return F.filter(F.transform(sections, section), lambda p: p["n"] > 0)


def edits(ev: DataFrame, turn_table: DataFrame) -> DataFrame:
    """(session_file, line_no, part, turn_index, tool_name, tool_use_id, file, before, after, model, ts): each belongs to the
    last turn before it in its file, to turn 0 if there is none."""
    uses = ev.where("type = 'assistant'").select("session_file", "line_no", "model", "ts", F.posexplode("tools").alias("use", "tool"))
    given = uses.select("session_file", "line_no", "use", "model", "ts", _text(F.col("tool"), "$.name").alias("tool_name"), _text(F.col("tool"), "$.id").alias("tool_use_id"), F.try_variant_get("tool", "$.input", "variant").alias("given"))
    found = tool_edits(given, "tool_name", "given").drop("given")
    marks = turn_table.select("session_file", "line_no", F.lit(-1).alias("use"), F.lit(0).alias("part"), F.col("turn_index").alias("t"))
    both = found.withColumn("t", F.lit(None).cast("int")).unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy("session_file").orderBy("line_no", "use", "part").rowsBetween(Window.unboundedPreceding, 0)
    at = both.withColumn("turn_index", F.coalesce(F.last("t", ignorenulls=True).over(order), F.lit(0))).where("use >= 0")
    return at.select("session_file", "line_no", "use", "part", "turn_index", "tool_name", "tool_use_id", "e.file", "e.before", "e.after", "model", "ts")
