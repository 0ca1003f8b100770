"""Fill-in-the-middle: a document is cut at two places and its parts are put in another order; marks say which is which.

Places are found with integers of one bit a byte (the first byte is the lowest bit).  `bytes.translate` turns a text into
class masks: bytes that begin a code point, bytes of words, line feeds.  Shifted boolean operations on the masks mark
where units begin, `bit_count` tells how many there are, and the byte at which the k-th unit begins is found by halving:
the count of the lower half says in which half it lies.  No text is ever decoded, and no place is looked for unit by unit.

Units are code points, words (with the white space after them) or lines.  Words are runs of bytes that aren't ASCII white
space; lines end with their line feed.

Form of a document: `plain` if its text is empty, holds one of the marks, or the draw says so (`plain_percent` of the
documents); otherwise `spm` (`spm_percent` of these) or `psm`.  plain: the text; psm: `<P>`prefix`<S>`suffix`<M>`middle;
spm: `<S>`suffix`<P>`prefix`<M>`middle.  Draws come from the first four groups of eight digits of the hexadecimal
SHA-256 of `seed:id`, so they follow the id and nothing else.  Whatever has no mark can be put together again
(`restored`).

Cases: null text counts as empty, a null id draws like the empty id.  Equal rows have equal results, rows of one id are
cut by the same draws.  Texts of any length: what is held is a few integers of a bit a byte.  Bytes that aren't UTF-8 are
kept as they are.  Empty tables give empty results.  Further columns are handed on in `row`, so no name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Bytes of texts that a task turns into a batch of results.
HELD_BYTES = 4 << 20


def _classes(of: frozenset[int]) -> bytes:
    return bytes(0x31 if b in of else 0x30 for b in range(256))


_LEADS = _classes(frozenset(b for b in range(256) if b & 0xC0 != 0x80))
_WORD = _classes(frozenset(range(256)) - frozenset(b"\t\n\v\f\r "))
_FEED = _classes(frozenset(b"\n"))
UNITS = ("code points", "words", "lines")


def mask(data: bytes, classes: bytes) -> int:
    """Bit i is set if byte i is of the class."""
    return int(data[::-1].translate(classes), 2) if data else 0


def unit_starts(data: bytes, units: str) -> int:
    """Bit i is set if a unit begins at byte i."""
    whole = (1 << len(data)) - 1
    if units == "code points":
        return mask(data, _LEADS)
    if units == "lines":
        return (mask(data, _FEED) << 1 | 1) & whole
    if units == "words":
        word = mask(data, _WORD)
        starts = word & ~(word << 1)
        return starts & (starts - 1) | 1 if starts else whole & 1  # white space before the first word is the first word's
    raise ValueError(f"units are {', '.join(UNITS)}")


def select(bits: int, k: int, size: int) -> int:
    """Place of the k-th set bit (from 0) of an integer of `size` bits; `size` if it has no more than k."""
    if k >= bits.bit_count():
        return size
    at = 0
    while size > 1:
        half = size // 2
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if k < n:
            bits, size = low, half
        else:
            bits, size, at, k = bits >> half, size - half, at + half, k - n
    return at


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def transformed(data: bytes, key: str, seed: int = 1, units: str = UNITS[0], plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, bytes]:
    """(units of the text, form, units of the prefix, units of the middle, output)."""
    starts = unit_starts(data, units)
    n = starts.bit_count()
    h1, h2, h3, h4 = draws(seed, key)
    if not data or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain_percent:
        return n, "plain", None, None, data
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = select(starts, first, len(data)), select(starts, last, len(data))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", first, last - first, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", first, last - first, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, units: str = UNITS[0], plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(row, n, form, prefix_units, middle_units, output), a row for each row of docs; row is a struct of its other columns."""
    if units not in UNITS:
        raise ValueError(f"units are {', '.join(UNITS)}")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    packed = docs.select(F.struct(*(others or [F.lit(0).alias("none")])).alias("row"), key.alias("key"), F.coalesce(F.col(f"`{text_col}`").cast("string").cast("binary"), F.lit(b"")).alias("data"))
    schema = T.StructType([packed.schema["row"], *T.StructType.fromDDL("n long, form string, prefix_units long, middle_units long, output binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(part: pa.RecordBatch, rows: list) -> pa.RecordBatch:
            n, form, prefix, middle, output = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())], names=schema.names)

        for batch in batches:
            keys, data = batch.column("key"), batch.column("data")
            rows, begin, held = [], 0, 0
            for i in range(batch.num_rows):
                rows.append(transformed(data[i].as_py(), keys[i].as_py(), seed, units, plain_percent, spm_percent))
                held += len(rows[-1][-1])
                if held > HELD_BYTES:
                    yield made(batch.slice(begin, i + 1 - begin), rows)
                    rows, begin, held = [], i + 1, 0
            if rows:
                yield made(batch.slice(begin), rows)

    return packed.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text out of an output and its form: the marks are where they first occur, as the text has none."""
    parts = F.split(F.substring(output, F.lit(len(PREFIX) + 1), F.char_length(output)), "<[PSM]>")
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[0], parts[2], parts[1])).when(form == "spm", F.concat(parts[1], parts[2], parts[0]))


def op12(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`, in code points."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return made.select(
        "row.doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), h AS (
  SELECT doc_id, t, n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form != 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form != 'plain' THEN (b - a)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
