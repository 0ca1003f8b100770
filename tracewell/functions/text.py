"""Column functions over lines, paths, prompts and ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The privacy marker, subjects of history rewrites, quotes that normalisation straightens.
PRIVATE_MARKER = "prov:private"
REWRITE_SUBJECTS = ("rebase (finish)", "commit (amend)", "commit(amend)")
CURLY_QUOTES, STRAIGHT_QUOTES = "‘’“”", "''\"\""
#: White space of Unicode, as a class.
SPACE = r"[\t\n\x0B\f\r \x85\xA0  -     　]"
ZERO_SHA = "0" * 40
#: Any hash with equal values for equal lines will do.
HASH_BITS = 256


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(t) -> Column:
    """Without white space of Unicode, line ends among it, at both ends."""
    return F.regexp_replace(col(t), rf"\A{SPACE}+|{SPACE}+\z", "")


def line_hash(line) -> Column:
    """Content hash of a line without its terminator; equality is all that is asked of it."""
    return F.sha2(col(line), HASH_BITS)


def split_lines(text) -> Column:
    """Split at every line feed; a final empty line stays."""
    return F.split(col(text), "\n")


def text_lines(text) -> Column:
    """Lines as a reader shows them: no empty line after a final line feed, no carriage return before one."""
    cut = F.regexp_replace(col(text), r"\r?\n\z", "")
    return F.when(F.length(col(text)) == 0, F.array().cast("array<string>")).otherwise(F.split(cut, r"\r?\n"))


def normalize_line(line) -> Column:
    """Quotes straightened, runs of white space one space, none at the end; leading white space stays as one space."""
    straight = F.translate(F.regexp_replace(col(line), SPACE + r"+\z", ""), CURLY_QUOTES, STRAIGHT_QUOTES)
    return F.regexp_replace(straight, SPACE + "+", " ")


def relativize(path, root) -> Column:
    """Path below the root if it is absolute and inside it, else unchanged."""
    prefix = F.concat(F.rtrim(col(root), F.lit("/")), F.lit("/"))
    return F.when(F.startswith(col(path), prefix), F.substring(col(path), F.length(prefix) + 1, F.length(col(path)))).otherwise(col(path))


def is_private(prompt) -> Column:
    """Whether the first or the last line is the privacy marker as a comment."""
    lines = text_lines(prompt)
    marker = rf"(?i)^{SPACE}*#{SPACE}*{PRIVATE_MARKER}{SPACE}*$"
    return F.coalesce(F.get(lines, 0).rlike(marker), F.lit(False)) | F.coalesce(F.get(lines, F.size(lines) - 1).rlike(marker), F.lit(False))


def is_session_id(s) -> Column:
    return col(s).rlike(r"\A[A-Za-z0-9_:-]+\z")


def is_full_sha(s) -> Column:
    return col(s).rlike(r"\A[0-9a-fA-F]{40}\z")


def short_sha(s) -> Column:
    return F.substring(col(s), 1, 8)


def parse_target(s) -> Column:
    """(file, line) of `file:line`; line is null where what follows the last colon isn't a number that fits."""
    shape = r"(?s)\A(.*):\+?([0-9]+)\z"
    number = F.regexp_extract(col(s), shape, 2).try_cast("bigint")
    line = F.when(number <= 4294967295, number)
    return F.struct(F.when(line.isNotNull(), F.regexp_extract(col(s), shape, 1)).otherwise(col(s)).alias("file"), line.alias("line"))


def phrase_tokens(text) -> Column:
    """Text as lower-case tokens of letters and digits without accents, with one space around each, so a phrase is a substring."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(without_accents(text)), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def without_accents(text) -> Column:
    """Canonical decomposition without its combining marks; texts that are all ASCII are left as they are."""
    t = col(text)
    apart = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), t, F.lit(False))
    return F.when(t.isNull() | (F.octet_length(t) == F.char_length(t)), t).otherwise(F.regexp_replace(apart, r"\p{Mn}+", ""))


def contains_phrase(text, phrase: str) -> Column:
    """Whether the phrase's tokens occur in the text next to one another; a phrase without tokens occurs nowhere."""
    wanted = phrase_tokens(F.lit(phrase))
    return (F.length(F.trim(wanted)) > 0) & F.contains(phrase_tokens(text), wanted)


def quoted_phrase(text) -> Column:
    """A user's text as one quoted phrase."""
    return F.concat(F.lit('"'), F.replace(col(text), F.lit('"'), F.lit('""')), F.lit('"'))


def window_overlap(a_start, a_end, b_start, b_end) -> Column:
    """Lines that two inclusive ranges share."""
    return F.greatest(F.lit(0), F.least(col(a_end), col(b_end)) - F.greatest(col(a_start), col(b_start)) + 1)


def half_covered(captured_start, captured_end, start, end) -> Column:
    """Whether at least half of the captured range lies in the other."""
    n = F.greatest(F.lit(0), col(captured_end) - col(captured_start) + 1)
    return (n > 0) & (window_overlap(captured_start, captured_end, start, end) * 2 >= n)


def project_dir(path) -> Column:
    """Folder name that stands for a work tree: `/` and `.` become `-`."""
    return F.translate(col(path), "/.", "--")


def quote_prompt(prompt, most: int = 200) -> Column:
    """First line for a bullet: double quotes made single, trimmed, cut, quoted."""
    first = trimmed(F.translate(F.coalesce(F.get(text_lines(prompt), 0), F.lit("")), '"', "'"))
    cut = F.when(F.octet_length(first) > most, F.concat(F.substring(first, 1, most), F.lit("…"))).otherwise(first)
    return F.concat(F.lit('"'), cut, F.lit('"'))


def is_rewrite_subject(subject) -> Column:
    out = F.lit(False)
    for s in REWRITE_SUBJECTS:
        out = out | F.startswith(col(subject), F.lit(s))
    return out


def is_diff_header(line) -> Column:
    return F.startswith(col(line), F.lit("+++ ")) | F.startswith(col(line), F.lit("--- "))


def hunk_plus(header) -> Column:
    """(start, count) of the new side of a hunk header; count is 1 where it isn't stated."""
    start = F.regexp_extract(col(header), r"^@@ .*?\+([0-9]+)", 1)
    count = F.regexp_extract(col(header), r"^@@ .*?\+[0-9]+,([0-9]+)", 1)
    return F.struct(F.when(start != "", start.cast("int")).alias("start"), F.when(count != "", count.cast("int")).otherwise(1).alias("count"))


def counted(n, one: str, many: str) -> Column:
    return F.concat(col(n).cast("string"), F.lit(" "), F.when(col(n) == 1, one).otherwise(many))


def approximate(derived_from) -> Column:
    """(approximate, confidence) of an edit's origin."""
    back = F.coalesce(col(derived_from)["kind"] == "backfill", F.lit(False))
    return F.struct(back.alias("approximate"), F.when(back, col(derived_from)["confidence"]).alias("confidence"))


def approximate_label(derived_from) -> Column:
    a = approximate(derived_from)
    return F.when(a["approximate"], F.format_string("approximate (%.2f)", a["confidence"].cast("double")))


def edit_key(e: str = "", c: Callable[[str], Column] | None = None) -> list[Column]:
    """Key under which two records are one edit: with a tool use id that, else the place in the file; c: what tells a field."""
    c = c or ((lambda n: F.col(f"{e}.{n}")) if e else F.col)
    place = F.when(c("tool_use_id").isNull(), F.concat(c("file").cast("string"), F.lit("@"), c("line_start").cast("string"), F.lit("-"), c("line_end").cast("string"))).otherwise("")
    return [c("conversation_id"), c("turn_index"), c("tool_use_id"), place]


def strip_ref(target) -> Column:
    """What a ref file points at; such a file ends with a line feed."""
    return F.regexp_replace(trimmed(target), r"\Aref: ", "")
