"""Document fingerprints: a canonical exact digest, in DataFrame functions only.

Canonical text: compatibility composition (NFKC) of the Unicode case folding of the NFKC text, every run of white space
(Unicode's, and the separators U+001C to U+001F) one space, trimmed.  Its digest is two 64-bit xxhashes.  Texts whose digests are equal form a bucket, and inside a
bucket of several the canonical bytes themselves are compared; should they differ, the second and further distinct texts
of the bucket get `-1`, `-2`, ... at the end of their fingerprint.  So equal fingerprints mean equal canonical texts,
and the likeness of two fingerprints is 1 or 0.

The next document needs its neighbour in id order, without a sort of everything in one task: ids are cut into buckets at
approximate quantiles, each bucket also gets the head of the next one, and a window inside the bucket does the rest.
The whole text is moved once.  An id (or no id) that very many rows have falls on several quantiles: its rows are cut
further by their digest, and equal rows among them are one row with a count.  Bytes are compared only for documents whose digest may occur twice; what is broadcast for
that is at most common.SLOTS slot numbers.

Cases: null text counts as empty; the empty text has a fingerprint like any other.  Rows of one doc_id follow each other
by digest and text, descending; a null doc_id (or one that is no number) comes after all others.  A single document is its own next.  An empty table gives an
empty result.  Extra columns are passed over.
"""

from __future__ import annotations

import bisect
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import cut, slot_filter

#: Ids a bucket holds about, and buckets there are at most (their heads' ids come to the driver).
BUCKET_ROWS, MAX_BUCKETS = 1000, 16384
LEAST = -(1 << 63)
#: Runs of white space of any kind.
SPACES = r"[\s\p{Z}\x{85}\x1C-\x1F]+"


def canonical(text: Column) -> Column:
    def compose(t: Column) -> Column:
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))

    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    return F.trim(F.regexp_replace(compose(folded), SPACES, " "))


def digests(canon: Column, bits: int = 64) -> tuple[Column, Column]:
    """Two hashes of a canonical text; fewer bits are for tests of what follows a collision."""
    a, b = F.xxhash64(canon), F.xxhash64(F.lit("wide"), canon)
    return (a, b) if bits == 64 else (F.pmod(a, F.lit(1 << bits)), F.lit(0).cast("long"))


def _bucket(key: Column, bounds: list, digest: Column | None = None) -> Column:
    """How many bounds, (key, digest) or keys alone, are at most the row's, by bisection."""
    if not bounds:
        return F.lit(0)
    digest = F.lit(0) if digest is None else digest
    keys, digests_ = (F.split(F.lit(",".join(str(b[i]) for b in _pairs(bounds))), ",").cast("array<bigint>") for i in (0, 1))
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def step(at: Column, by: Column) -> Column:
        k, d = F.get(keys, at + by - 1), F.get(digests_, at + by - 1)
        return F.when((at + by <= len(bounds)) & ((k < key) | ((k == key) & (d <= digest))), at + by).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _pairs(bounds: list) -> list[tuple[int, int]]:
    return [b if isinstance(b, tuple) else (b, LEAST) for b in bounds]


def bounds_of(quantiles: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """(bounds (key, digest), keys on which several quantiles fall): such a key is cut by digest into as many parts."""
    counts = Counter(quantiles)
    out = set()
    for key, n in counts.items():
        out.add((key, LEAST))
        if n > 1:
            out |= {(key, LEAST + (i << 64) // (n + 1)) for i in range(1, n + 1)}
            out |= {(key + 1, LEAST)} if key < -1 - LEAST else set()
    return sorted(out), sorted(k for k, n in counts.items() if n > 1)


def with_next(docs: DataFrame, bucket_rows: int | None = None) -> DataFrame:
    """docs (key, text, and what follows from the text) with `next`, the row after it in descending order of key, digest
    and text (the first after the last), and `copies`, how many rows of docs a row stands for."""
    rest = [c for c in docs.columns if c not in ("key", "text")]
    count = docs.count()
    buckets = max(1, min(MAX_BUCKETS, count // (bucket_rows or BUCKET_ROWS)))
    shares = [i / buckets for i in range(1, buckets)]
    bounds, tied = bounds_of((docs.agg(F.percentile_approx("key", F.array(*map(F.lit, shares)), 4 * buckets)).first()[0] or []) if shares else [])
    digest = F.col("h1") if "h1" in rest else F.xxhash64("text")
    cut_by = digest if tied else F.lit(0)  # where no key is hot, buckets and their heads are told by the key alone
    one = docs.withColumn("copies", F.lit(1).cast("long"))
    if tied:  # equal rows are put together before they are dealt out
        is_tied = F.array_contains(F.split(F.lit(",".join(map(str, tied))), ",").cast("array<bigint>"), F.col("key"))
        together = docs.where(is_tied).groupBy("key", "text").agg(*(F.first(c).alias(c) for c in rest), F.count(F.lit(1)).alias("copies"))
        one = one.where(~is_tied).unionByName(together)
    keyed = one.withColumn("bucket", _bucket(F.col("key"), bounds, cut_by))
    heads = sorted((r.m.key, r.m.d, r.bucket) for r in keyed.groupBy("bucket").agg(F.max(F.struct("key", cut_by.cast("long").alias("d"))).alias("m")).collect())
    # the bucket that comes before each head; the overall first follows the last of all
    before = {(key, d): heads[(i + 1) % len(heads)][2] for i, (key, d, _) in enumerate(heads)}
    named = F.broadcast(docs.sparkSession.createDataFrame(list(before), "key long, d long"))
    head_rows = docs.join(named, "key").where(F.col("d") == cut_by).groupBy("key", "d").agg(F.max(F.struct(digest.alias("__d"), "text", *rest)).alias("h")).select("key", *(F.col(f"h.{c}").alias(c) for c in ("text", *rest)))
    lookup = sorted(before)
    place = F.get(F.split(F.lit(",".join(str(before[k]) for k in lookup)), ",").cast("array<int>"), _bucket(F.col("key"), lookup, cut_by) - 1) if before else F.lit(0)
    every = keyed.withColumn("tail", F.lit(0)).unionByName(head_rows.withColumns({"bucket": place, "tail": F.lit(1), "copies": F.lit(1).cast("long")}))
    order = Window.partitionBy("bucket").orderBy("tail", F.desc("key"), digest.desc(), F.desc("text"))
    own = F.struct("key", "text", *rest)
    found = every.withColumn("next", F.lead(own).over(order)).where("tail = 0").drop("tail", "bucket")
    if not tied:
        return found
    # of equal rows all but the last are followed by their like
    each = F.array(F.struct(F.lit(1).cast("long").alias("copies"), F.col("next")), F.struct((F.col("copies") - 1).alias("copies"), own.alias("next")))
    return found.withColumn("__e", F.explode(F.filter(each, lambda e: e["copies"] > 0))).withColumns({"copies": F.col("__e.copies"), "next": F.col("__e.next")}).drop("__e")


def edited_text(text: Column, n: Column, following: Column) -> Column:
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - half).cast("int")), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64, bucket_rows: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row of docs."""
    base = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.coalesce(F.col(id_col).try_cast("long"), F.lit(LEAST)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("r", F.xxhash64("text"))
    h1, h2 = digests(F.col("canon"), bits)
    hashed = base.withColumn("canon", canonical(F.col("text"))).withColumns({"h1": h1, "h2": h2}).drop("canon", "doc_id")
    rows = with_next(hashed, bucket_rows)
    n = F.char_length("text")
    edited = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited_text(F.col("text"), n, F.col("next.text")))
    edited = edited.withColumn("canon", canonical(F.col("edited"))).withColumns({"e1": h1, "e2": h2})
    thin = cut(edited.select("key", "r", "copies", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "h1", "h2", "e1", "e2", F.col("next.key").alias("next_key"), F.col("next.r").alias("nr"), F.col("next.h1").alias("n1"), F.col("next.h2").alias("n2")))
    orders = _collisions(base, thin, h1, h2)
    if orders is not None:
        # a row is told by its id and its text's hash, an edited text also by the next one's
        for kind, key, r, of in ((0, "key", "r", "h"), (1, "key", "r", "e"), (0, "next_key", "nr", "n")):
            found = orders.where(F.col("kind") == kind).select(F.col("key").alias("k"), F.col("r").alias("kr"), F.col("nr").alias("kn"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("order").alias(f"{of}3")).distinct()
            same = (F.col(key) == F.col("k")) & (F.col(r) == F.col("kr")) & (F.col(f"{of}1") == F.col("c1")) & (F.col(f"{of}2") == F.col("c2"))
            thin = thin.join(found, same & (F.col("nr") == F.col("kn")) if kind else same, "left").drop("k", "kr", "kn", "c1", "c2")

    def name(of: str) -> Column:
        wide = F.concat(*(F.lpad(F.lower(F.hex(f"{of}{i}")), 16, "0") for i in (1, 2)))
        return wide if orders is None else F.concat(wide, F.when(F.coalesce(f"{of}3", F.lit(0)) > 0, F.concat(F.lit("-"), F.col(f"{of}3"))).otherwise(""))

    def likeness(a: Column, b: Column) -> Column:
        return (a == b).cast("double")

    thin = thin.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return thin.select(
        F.when(F.col("key") != LEAST, F.col("key")).alias("doc_id"), "n_chars", "edited_sha256", name("h").alias("fingerprint"), name("e").alias("edited_fingerprint"),
        likeness(name("h"), name("e")).alias("near_edited"), likeness(name("h"), name("n")).alias("near_next"),
    )


def _collisions(base: DataFrame, thin: DataFrame, h1: Column, h2: Column) -> DataFrame | None:
    """Compares bytes inside buckets of several: (key, r, nr, kind, h1, h2, order) of buckets whose texts differ, None if there are none."""
    both = thin.select("h1", "h2", "copies").union(thin.select("e1", "e2", "copies"))
    multi = cut(both.groupBy("h1", "h2").agg(F.sum("copies").alias("n")).where("n > 1").select("h1", "h2"))
    ids = F.xxhash64("h1", "h2")
    texts = base.select("key", "r", F.lit(0).cast("long").alias("nr"), F.lit(0).alias("kind"), canonical(F.col("text")).alias("canon")).withColumns({"h1": h1, "h2": h2})
    texts = slot_filter(texts, ids, multi, ids)
    # edited texts that share a digest: few, and only the documents they are made of are moved
    wanted = cut(thin.select("key", "r", "next_key", "nr", "n_chars", F.col("e1").alias("h1"), F.col("e2").alias("h2")).join(multi, ["h1", "h2"]).distinct())
    if not wanted.isEmpty():
        named = wanted.select("key", "r").union(wanted.select("next_key", "nr")).distinct()
        own = slot_filter(base.select("key", "r", "text"), F.xxhash64("key", "r"), named, F.xxhash64("key", "r")).groupBy("key", "r").agg(F.max("text").alias("text"))
        following = own.select(F.col("key").alias("next_key"), F.col("r").alias("nr"), F.col("text").alias("following"))
        pairs = wanted.join(own, ["key", "r"]).join(following, ["next_key", "nr"])
        canon = canonical(edited_text(F.col("text"), F.char_length("text"), F.col("following")))
        texts = texts.union(pairs.select("key", "r", "nr", F.lit(1).alias("kind"), canon.alias("canon"), "h1", "h2"))
    differ = cut(texts.groupBy("h1", "h2").agg(F.min("canon").alias("least"), F.max("canon").alias("most")).where("least != most").select("h1", "h2"))
    if differ.isEmpty():
        return None
    order = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("canon")) - 1
    return cut(texts.join(differ, ["h1", "h2"]).withColumn("order", order).select("key", "r", "nr", "kind", "h1", "h2", "order"))


def op1(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def bucket_of(key: int, bounds: list, digest: int = 0) -> int:
    """What _bucket computes, for tests."""
    return bisect.bisect_right(_pairs(bounds), (key, digest))
