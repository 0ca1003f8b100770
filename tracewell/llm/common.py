"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.plans.materialize import counted, small
from tracewell.plans.materialize import keep as cut
from tracewell.plans.materialize import shared_folder as shared_dir

__all__ = ["beside_text", "bounded_sample", "counted", "cut", "fold", "hot_slots", "join_hot", "labelled_texts", "salted", "shared_dir", "slot_filter", "slot_split", "small", "unpacked"]

#: Upper bound on the distinct slots of `slot_filter`, and so on what it broadcasts (16 bytes a slot).
SLOTS = 1 << 20


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; the fold of a null id is that of the empty string."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % folds


def slot_filter(df: DataFrame, df_key: Column, wanted: DataFrame, wanted_key: Column, slots: int = SLOTS) -> DataFrame:
    """Rows of df whose key may be among wanted's keys.

    No row with a wanted key is lost; others may pass and have to be joined away.  Only slot numbers are broadcast, of
    which there are `slots` at most, however large `wanted` is.
    """
    named = wanted.select(F.pmod(F.xxhash64(wanted_key), F.lit(slots)).alias("__slot")).distinct()
    return (
        df.withColumn("__slot", F.pmod(F.xxhash64(df_key), F.lit(slots)))
        .join(F.broadcast(named), "__slot", "left_semi")
        .drop("__slot")
    )


def slot_split(df: DataFrame, df_key: Column, wanted: DataFrame, wanted_key: Column, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose key may be among wanted's keys, rows whose key isn't); bounded like slot_filter."""
    named = F.broadcast(counted(wanted.select(F.pmod(F.xxhash64(wanted_key), F.lit(slots)).alias("__slot")).distinct())[0])
    with_slot = df.withColumn("__slot", F.pmod(F.xxhash64(df_key), F.lit(slots)))
    return tuple(with_slot.join(named, "__slot", how).drop("__slot") for how in ("left_semi", "left_anti"))


def salted(many: DataFrame, few: DataFrame, on: list[str], spread: Column, how: str = "inner", parts: int = 8) -> DataFrame:
    """many join few, where few has a row for each key and a key may be in a third of many's rows: each key's rows are
    dealt into parts by a hash of `spread`, and few's row goes to each part."""
    dealt = many.withColumn("__part", F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))
    every = few.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(every, [*on, "__part"], how).drop("__part")


def hot_slots(counts: DataFrame, on: list[str], n: str, most: int, slots: int = SLOTS) -> DataFrame | None:
    """Slots of the keys of counts (on, n) that have more than `most` rows, for join_hot(); None if there are none."""
    hot, (rows,) = counted(counts.where(F.col(n) > most).select(F.pmod(F.xxhash64(*on), F.lit(slots)).alias("__slot")).distinct())
    return hot if rows else None


def join_hot(many: DataFrame, few: DataFrame, on: list[str], spread: str, hot: DataFrame | None, how: str = "inner", parts: int = 16, slots: int = SLOTS) -> DataFrame:
    """many join few, where few has a row for each key: rows of a key in a hot slot are dealt into parts by a hash of the
    column `spread`, and few's row goes to each of them.  What is broadcast is at most `slots` slot numbers."""
    if hot is None:
        return many.join(few, on, how)

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("__slot", F.pmod(F.xxhash64(*on), F.lit(slots))).join(F.broadcast(hot.withColumn("__hot", F.lit(True))), "__slot", "left").drop("__slot")

    dealt = marked(many).withColumn("__part", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")).otherwise(0)).drop("__hot")
    every = marked(few).withColumn("__part", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return dealt.join(every, [*on, "__part"], how).drop("__part")


#: Groups whose shares bounded_sample states in the plan; with more of them the counts are joined.
STATED = 1024


def bounded_sample(df: DataFrame, key: Column, group: Column, per_group: int, salt: str, known: dict | None = None) -> DataFrame:
    """About per_group rows of each group that isn't null, chosen by a hash of the key.

    Two passes and, but for very many groups, no shuffle of rows: the groups are counted, then each keeps the rows whose
    hash lies under its own share, so a group of a third of all rows costs no more than any other.  known: the counts of
    the groups, where they have been counted."""
    counts = df.groupBy(group.alias("__g")).agg(F.count(F.lit(1)).alias("__n")).where("__g is not null")
    few = list(known.items()) if known is not None else [tuple(r) for r in counts.limit(STATED + 1).collect()]
    if not few:
        return df.limit(0)
    u = F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    if len(few) <= STATED:
        shares = F.create_map(*(F.lit(x) for r in sorted(few, key=str) for x in (r[0], per_group / r[1])))
        return df.where(u < F.try_element_at(shares, group))
    thinned = df.withColumns({"__g": group, "__u": u})
    return salted(thinned, counts, ["__g"], F.col("__u")).where(F.col("__u") * F.col("__n") < per_group).drop("__g", "__u", "__n")


def labelled_texts(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, most_bytes: int) -> list[tuple[str, int]]:
    """(whole text, label) of the chosen labelled ids (id, y), in the order of a hash of the id.

    An id's rows count as one, with the text of the smallest hash.  Rows are taken while their texts fit most_bytes
    together; what doesn't fit any more is left out as a row, so no text is ever cut."""
    thin = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    named = F.broadcast(chosen.select("id", "y").distinct())
    size = F.struct(F.xxhash64("t").alias("h"), F.octet_length("t").alias("size"))
    sizes = thin.join(named, "id").groupBy("id", "y").agg(F.min(size).alias("s")).select("id", "y", "s.h", "s.size").collect()
    taken, left = {}, most_bytes
    for r in sorted(sizes, key=lambda r: (r.h, str(r.id), r.y)):
        if r.size <= left:
            left -= r.size
            taken.setdefault((r.id, r.h), []).append(r.y)
    if not taken:
        return []
    wanted = F.broadcast(docs.sparkSession.createDataFrame(sorted(taken, key=str), chosen.select("id", F.lit(0).cast("long").alias("h")).schema))
    texts = thin.withColumn("h", F.xxhash64("t")).join(wanted, ["id", "h"]).groupBy("id", "h").agg(F.min("t").alias("t")).collect()
    return [(r.t, y) for r in sorted(texts, key=lambda r: (r.h, str(r.id))) for y in sorted(taken[(r.id, r.h)])]


def beside_text(docs: DataFrame, text_col: str, added: str, run: Callable[[list[str | None]], list[pa.Array]], keep_text: bool = True) -> DataFrame:
    """(row, text, ...added): `run` makes the added columns of some texts; row is a struct of all other columns, so that no
    name can clash with another."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*(others or [F.lit(0).alias("none")])).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([*packed.schema.fields[: 2 if keep_text else 1], *T.StructType.fromDDL(added).fields])
    names = schema.names

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                kept = [part.column(0), *([part.column(1)] if keep_text else [])]
                yield pa.RecordBatch.from_arrays([*kept, *run(part.column(1).to_pylist())], names=names)

    return packed.mapInArrow(each, schema)


def unpacked(df: DataFrame, columns: list[str], text_col: str) -> list[Column]:
    """The original columns of what beside_text() returned, in their order."""
    return [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in columns]
