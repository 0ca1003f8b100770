"""Near-duplicate documents by MinHash bands, odd sketches and a confirmation on whole shingle sets.

Plan, for documents whose shingle sets have a Jaccard similarity of `numerator / denominator` or more:

1.  One pass over the texts makes, for each document, the size and the 128-bit key of its set of distinct w-word
    shingles, 30 band keys of 4 MinHash values, and an *odd sketch*: a 256-bit parity bitmap into which each of 128
    (position, MinHash value) samples flips one bit.  Equal sets are one class from here on.
2.  Documents that share a band key meet in a bucket.  A bucket never emits its pairs: each member is linked to the
    bucket's smallest member (its hub), and of a document's hubs the most similar by the sketches is confirmed first.
3.  A pair is confirmed on the two whole texts.  Confirmed links give components.
4.  Buckets that still span several components are settled, a few bands at a time.  The members outside a bucket's
    largest component are the queries, set against all members in blocks inside a task: first blocks of SKETCH_BLOCK
    members without their texts, which keep the members that the XOR population count of the sketches lets through to
    a member of another component; then blocks of BLOCK members or BLOCK_BYTES of shingles of these: most similar
    first, on whole shingle sets, and two components that a link joined are not compared again.  So pairs never become
    rows, no link between components is lost to a cap, and thousands of copies cost one link a copy.

Keys, hubs and sets that more than TOGETHER rows have are dealt into parts wherever rows are joined on them
(common.join_hot), so no task gets all rows of one.

30 bands of 4 miss a pair at similarity 0.85 with probability (1 - 0.85**4)**30 = 2e-10, at 0.8 with 1e-7.  The
population-count bound comes from the exact law of the flips at the threshold, so that it misses no more than the bands.

Cases: null or blank text has an empty set, is linked with nothing and is its own component.  Fewer words than w: the
whole sequence is one shingle.  Equal rows are one class.  Rows of one doc_id count as one document, whose links are those
of its text of the smallest hash; n_shingles is each row's own.  A null doc_id is never linked; its component_id is null
and it is kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import counted, cut, hot_slots, join_hot, slot_filter, small
from tracewell.plans.materialize import SMALL, release

SAMPLES, BANDS, ROWS, SKETCH_BITS = 128, 30, 4, 256
#: Members of a bucket that one task sets against the queries at a time: by sketches alone, and with their texts.
SKETCH_BLOCK, BLOCK, BLOCK_BYTES = 1024, 1024, 32 << 20
#: Rows of one key that stay together in a join.
TOGETHER = 1024
#: Bands whose buckets are settled together: first a few, which join most components, then the rest.
BAND_ROUNDS = ((0, 1), (2, BANDS - 1))
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = _RNG.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * _U(2) + _U(1)
_B = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_K1, _K2, _K3 = (_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _WordHashes(dict):
    """64-bit hashes of words; forgets them all once there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _K1
    return h ^ (h >> _U(29))


def shingle_set(text: str | None, width: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, tokens), np.uint64, n)
    size = min(n, width)
    h = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        h = _mix(h * _K2 + w[i : n - size + 1 + i] * _K3)
    return np.unique(h)


def _min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row for each set; no set is empty."""
    out = np.empty((len(sets), SAMPLES), np.uint64)
    i = 0
    while i < len(sets):
        j, total = i, 0
        while j < len(sets) and (j == i or total + len(sets[j]) <= 65536):
            total += len(sets[j])
            j += 1
        x = np.concatenate(sets[i:j])
        starts = np.cumsum([0, *map(len, sets[i : j - 1])])
        for k in range(SAMPLES):
            out[i:j, k] = np.minimum.reduceat(x * _A[k] + _B[k], starts)
        i = j
    return out


def _bands_and_sketches(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bands = np.empty((len(m), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(m), b + 1, np.uint64)
        for r in range(ROWS):
            h = _mix(h * _K2 + m[:, b * ROWS + r])
        bands[:, b] = h
    bit = _mix(m * _K3 + np.arange(1, SAMPLES + 1, dtype=np.uint64)[None, :] * _K2) % _U(SKETCH_BITS)
    flips = np.zeros((len(m), SKETCH_BITS), np.uint8)
    np.add.at(flips, (np.arange(len(m))[:, None], bit.astype(np.int64)), 1)
    return bands, np.packbits(flips & 1, axis=1).view(">u8").astype(np.uint64)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t, width, words) for t in part.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                bands = np.zeros((len(sets), BANDS), np.int64)
                sketch = np.zeros((len(sets), SKETCH_BITS // 64), np.int64)
                if full:
                    b, s = _bands_and_sketches(_min_hashes([sets[i] for i in full]))
                    bands[full], sketch[full] = b.view(np.int64), s.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        part.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), pa.array(bands.ravel())),
                        *(pa.array(sketch[:, i]) for i in range(sketch.shape[1])),
                    ],
                    names=["id", "h", "n_shingles", "set_key", "bands", "s0", "s1", "s2", "s3"],
                )

    return run


def signatures(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, n_shingles, set_key, bands, s0..s3), a row for each row of docs; h is the hash of the text."""
    schema = "id long, h long, n_shingles long, set_key binary, bands array<long>, s0 long, s1 long, s2 long, s3 long"
    return _named(docs, id_col, text_col).select("id", "text", F.xxhash64("text").alias("h")).mapInArrow(_signatures(width), schema)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).try_cast("long").alias("id"), F.col(text_col).alias("text"))


def _texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of these ids; of an id's texts that of the smallest hash."""
    return slot_filter(_named(docs, id_col, text_col), F.col("id"), ids, F.col("id")).groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("id", F.col("t.text").alias("text"))


def flips_at(similarity: float) -> float:
    """Expected population count of the XOR of two sketches at this similarity of the sets."""
    flipped = 2 * SAMPLES * (1 - similarity)
    return SKETCH_BITS / 2 * (1 - math.exp(-2 * flipped / SKETCH_BITS))


def estimate(flips: float) -> float:
    """Similarity that the population count of two sketches' XOR speaks for."""
    return 1 + SKETCH_BITS / (4 * SAMPLES) * math.log(max(1 - 2 * flips / SKETCH_BITS, 1e-9))


def miss_rates(similarity: float) -> np.ndarray:
    """For each bound from 0 to SKETCH_BITS: how probably two sets of this similarity have more flips than it.

    Each of the samples differs with probability 1 - similarity, and then throws two bits of the XOR, anywhere."""
    odd, law = np.zeros(SKETCH_BITS + 1), np.zeros(SKETCH_BITS + 1)
    odd[0] = 1.0
    up, down = 1 - np.arange(SKETCH_BITS) / SKETCH_BITS, np.arange(1, SKETCH_BITS + 1) / SKETCH_BITS
    for k in range(SAMPLES + 1):
        law += math.comb(SAMPLES, k) * (1 - similarity) ** k * similarity ** (SAMPLES - k) * odd
        for _ in range(2):
            odd = np.append(0.0, odd[:-1] * up) + np.append(odd[1:] * down, 0.0)
    return np.append(np.cumsum(law[:0:-1])[::-1], 0.0)


def _flip_bound(threshold: float) -> int:
    """The least bound that misses a pair at the threshold no more often than the bands do."""
    return int(np.argmax(miss_rates(threshold) <= (1 - threshold**ROWS) ** BANDS))


def _confirm(width: int, numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, right = _WordHashes(), object(), None
        for batch in batches:
            keep = []
            for b, left_text, right_text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if b != last:
                    last, right = b, shingle_set(right_text, width, words)
                left = shingle_set(left_text, width, words)
                both = len(np.intersect1d(left, right, assume_unique=True))
                union = len(left) + len(right) - both
                keep.append(bool(union) and denominator * both >= numerator * union)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def confirm(pairs: DataFrame, docs: DataFrame, width: int, numerator: int, denominator: int, id_col: str, text_col: str, hot: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose whole texts are that similar.  Only texts that the pairs name are moved; hot: slots of b of many pairs."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = _texts(docs, ids, id_col, text_col)
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("left_text"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("right_text"))
    rows = join_hot(pairs.select("a", "b").join(left, "a"), right, ["b"], "a", hot).select("a", "b", "left_text", "right_text")
    return rows.mapInArrow(_confirm(width, numerator, denominator), "a long, b long")


def roots(links: DataFrame, hot: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(id, component) of links (a, b) that give each a one b < a: what each a reaches in the end, and itself for each
    such end; and how many rows that is at most.

    Each round every pointer jumps to its target's target, so chains halve; nothing is collected but whether any moved."""
    at, (n,) = counted(links.select(F.col("a").alias("id"), F.col("b").alias("component")))
    while True:
        further = small(at.select(F.col("id").alias("component"), F.col("component").alias("next")), n)
        new, (_, moved) = counted(join_hot(at, further, ["component"], "id", hot if n > SMALL else None, "left").select("id", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("moved")), F.col("moved"))
        at = new.select("id", "component")
        if not moved:
            ends = at.select(F.col("component").alias("id")).distinct()
            every, (n,) = counted(at.union(ends.select("id", F.col("id").alias("component"))))
            return every, n


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), for each id that has a link.

    Labels move to neighbours and then jump to their label's label, so chains shorten by powers of two; each round is
    written out.  Nothing is collected but whether any label changed.
    """
    both, (n,) = counted(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = counted(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")))[0]
    while True:
        near = both.join(small(labels.withColumnRenamed("id", "b"), n), "b").groupBy("a").agg(F.min("component").alias("near"))
        moved = labels.join(small(near.withColumnRenamed("a", "id"), n), "id", "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = small(labels.select(F.col("id").alias("new"), F.col("component").alias("further")), n)
        new, (_, changed) = counted(moved.join(jump, "new", "left").select("id", "old", F.least("new", "further").alias("component")), F.col("old") != F.col("component"))
        labels = new.select("id", "component")
        if not changed:
            return labels


def joined(comps: DataFrame, n: int, links: DataFrame) -> tuple[DataFrame, int]:
    """comps (id, component) after further links: their components are joined, and ids that had none come in.

    Only components that a link joins are looked at, which are far fewer than documents."""
    of = {side: small(comps.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}")), n) for side in ("a", "b")}
    between = links.select("a", "b").distinct().join(of["a"], "a", "left").join(of["b"], "b", "left")
    between, (pairs,) = counted(between.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a != b").distinct())
    if not pairs:
        return comps, n
    moved = components(between).select(F.col("id").alias("component"), F.col("component").alias("new"))
    ends = comps.select("component").distinct()
    new = moved.join(small(ends, n), "component", "left_anti").select(F.col("component").alias("id"), F.col("new").alias("component"))
    every, (n,) = counted(comps.join(small(moved, 2 * pairs), "component", "left").select("id", F.coalesce("new", "component").alias("component")).union(new))
    return every, n


def _settle(width: int, numerator: int, denominator: int, bound: int):
    """Links between components of one block of a bucket, at most one for each two components that it joins.

    Rows come sorted by (key, member block, query block); query i takes the members of other components that the
    sketches let through, the most similar first, and each link found joins two components for all that follow.
    """

    def links(ids, comps, is_query, is_member, sketch, texts) -> list[tuple[int, int]]:
        numbers = {c: i for i, c in enumerate(dict.fromkeys(comps))}
        root, sets, words, out = np.arange(len(numbers)), {}, _WordHashes(), []
        comp = np.array([numbers[c] for c in comps])
        at = np.flatnonzero(is_member)

        def whole(i):
            if i not in sets:
                column, row = texts[i]
                sets[i] = shingle_set(column[row].as_py(), width, words)
            return sets[i]

        for i in np.flatnonzero(is_query).tolist():
            near = at[root[comp[at]] != root[comp[i]]]
            flips = np.bitwise_count(sketch[near] ^ sketch[i]).sum(axis=1)
            order = np.argsort(flips, kind="stable")
            for j in near[order[: np.count_nonzero(flips <= bound)]].tolist():
                if root[comp[i]] == root[comp[j]]:
                    continue
                x, y = whole(i), whole(j)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if denominator * both >= numerator * (len(x) + len(y) - both):
                    out.append((ids[i], ids[j]))
                    root[root == root[comp[j]]] = root[comp[i]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found, texts = [], part.column(11)
                for row, (*key, i, c, q, m, s0, s1, s2, s3) in enumerate(zip(*(x.to_pylist() for x in part.columns[:11]), strict=True)):
                    if key != group:
                        found += links(*_columns(rows)) if rows else []
                        group, rows = key, []
                    rows.append((i, c, q, m, (s0, s1, s2, s3), (texts, row)))
                if found:
                    yield _pairs(found)
        if rows and (found := links(*_columns(rows))):
            yield _pairs(found)

    return run


def _columns(rows):
    ids, comps, query, member, sketch, texts = zip(*rows, strict=True)
    return ids, comps, np.array(query), np.array(member), np.array(sketch, np.int64).view(np.uint64), texts


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])


def _near(bound: int):
    """Those rows of a bucket's block that the sketches let through to a row of another component, each once."""

    def near(comps, is_query, is_member, sketch) -> np.ndarray:
        comp = np.unique(np.array(comps), return_inverse=True)[1]
        hit, members = np.zeros(len(comp), bool), np.flatnonzero(is_member)
        queries = np.flatnonzero(is_query)
        for at in range(0, len(queries), 128):
            some = queries[at : at + 128]
            flips = np.bitwise_count(sketch[some][:, None, :] ^ sketch[members][None, :, :]).sum(axis=2)
            met = (flips <= bound) & (comp[some][:, None] != comp[members][None, :])
            hit[some] |= met.any(axis=1)
            hit[members] |= met.any(axis=0)
        return hit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def kept():
            hit = near([r[2] for r in rows], np.array([r[8] for r in rows]), np.array([r[9] for r in rows]), np.array([r[4:8] for r in rows], np.int64).view(np.uint64))
            found = [rows[i][:8] for i in np.flatnonzero(hit).tolist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["key", "id", "component", "size", "s0", "s1", "s2", "s3"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                for mb, qb, *row in zip(*(x.to_pylist() for x in batch.slice(at, 2048).columns), strict=True):
                    if (row[0], mb, qb) != group:
                        if rows:
                            yield from kept()
                        group, rows = (row[0], mb, qb), []
                    rows.append(row)
        if rows:
            yield from kept()

    return run


def _blocks(members: DataFrame, block: int, block_bytes: int | None, hot: DataFrame | None) -> DataFrame:
    """members (key, id, component, size, s0..s3) in the blocks (key, mb, qb) of their bucket in which they are members (m) or
    queries (q): each member block of a bucket meets each query block, and queries are what isn't in the largest component."""

    def blocks(n, size):
        by_rows = F.ceil(n / block)
        return F.greatest(F.lit(1), by_rows if block_bytes is None else F.greatest(by_rows, F.ceil(size * 8 / block_bytes))).cast("int")

    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    main = F.max_by(F.struct("component", "n", "size"), F.struct("n", "component"))
    plan = sizes.groupBy("key").agg(main.alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    plan = plan.select("key", F.col("main.component").alias("main"), blocks(F.col("n"), F.col("size")).alias("m_blocks"), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("q_blocks"))
    rows = join_hot(members, plan, ["key"], "id", hot).withColumns({"mb": F.pmod(F.xxhash64("id"), "m_blocks").cast("int"), "qb": F.pmod(F.xxhash64("id", F.lit(1)), "q_blocks").cast("int"), "q": F.col("component") != F.col("main")})
    # a query is also a member; where both meet it is one row
    as_member = F.transform(F.sequence(F.lit(0), F.col("q_blocks") - 1), lambda x: F.struct(F.col("mb").alias("mb"), x.alias("qb"), (F.col("q") & (x == F.col("qb"))).alias("q"), F.lit(True).alias("m")))
    as_query = F.filter(F.transform(F.sequence(F.lit(0), F.col("m_blocks") - 1), lambda x: F.struct(x.alias("mb"), F.col("qb").alias("qb"), F.lit(True).alias("q"), F.lit(False).alias("m"))), lambda x: x["mb"] != F.col("mb"))
    at = F.explode(F.when(F.col("q"), F.concat(as_member, as_query)).otherwise(as_member))
    return rows.select("key", "id", "component", "size", "s0", "s1", "s2", "s3", at.alias("at")).select("at.mb", "at.qb", "key", "id", "component", "size", "s0", "s1", "s2", "s3", "at.q", "at.m")


def _between(members: DataFrame, hot: DataFrame | None, comps: DataFrame, n: int, sketches: DataFrame, docs: DataFrame, bound: int, block: int, width: int, numerator: int, denominator: int, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, sketch_block: int = SKETCH_BLOCK) -> DataFrame | None:
    """Links (a, b) between different components within these buckets; enough of them to join what any link joins."""
    at = members.join(small(comps, n), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = at.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one != other").select("key")
    full = cut(join_hot(at, mixed, ["key"], "id", hot).join(sketches, "id"))
    near = _blocks(full, sketch_block, None, hot).repartition("key", "mb", "qb").sortWithinPartitions("key", "mb", "qb", "id")
    found = near.mapInArrow(_near(bound), "key long, id long, component long, size long, s0 long, s1 long, s2 long, s3 long")
    involved, (rows,) = counted(found.distinct())  # a row for each document and bucket, no pairs
    if not rows:
        return None
    texts = _texts(docs, involved.select("id").distinct(), id_col, text_col)
    ready = _blocks(involved, block, block_bytes, hot).join(texts, "id").select("key", "mb", "qb", "id", "component", "q", "m", "s0", "s1", "s2", "s3", "text")
    ready = ready.repartition("key", "mb", "qb").sortWithinPartitions("key", "mb", "qb", "id")
    return ready.mapInArrow(_settle(width, numerator, denominator, bound), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, numerator: int = 80, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs; see the module's text."""
    bound = _flip_bound(numerator / denominator)
    how = (width, numerator, denominator, id_col, text_col)
    sig = cut(signatures(docs, width, id_col, text_col))
    known = sig.where("n_shingles > 0 and id is not null")
    # an id of several texts is the one of the smallest hash
    several, (of_several,) = counted(sig.where("id is not null").groupBy("id").agg(F.min("h").alias("one"), F.max("h").alias("other")).where("one != other").select("id", "one"))
    if of_several:
        known = known.join(several, "id", "left").where("one is null or one = h").drop("one")
    # copies are thousands of equal rows: their sums are made before the shuffle
    classes = cut(known.groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), *(F.first(f"s{i}").alias(f"s{i}") for i in range(4))))
    sketches = classes.select(F.col("rep").alias("id"), "size", "s0", "s1", "s2", "s3")
    in_bands = classes.select(F.col("rep").alias("id"), F.posexplode("bands").alias("band", "key"))
    buckets = cut(in_bands.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot_keys = hot_slots(buckets, ["key"], "n", TOGETHER)
    members = cut(join_hot(in_bands, buckets.select("key", "hub"), ["key"], "id", hot_keys))
    stars = cut(members.where("id != hub").select("id", "hub").distinct())
    hot_hubs = hot_slots(stars.groupBy("hub").agg(F.count(F.lit(1)).alias("n")), ["hub"], "n", TOGETHER)
    met = join_hot(stars.join(sketches, "id"), sketches.select(F.col("id").alias("hub"), F.struct("s0", "s1", "s2", "s3").alias("y")), ["hub"], "id", hot_hubs)
    flips = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(1, 4)), F.bit_count(F.col("s0").bitwiseXOR(F.col("y.s0"))))
    scored = met.select(F.col("id").alias("a"), F.col("hub").alias("b"), flips.alias("flips")).where(F.col("flips") <= bound)
    best = scored.groupBy("a").agg(F.min(F.struct("flips", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    links = confirm(best, docs, *how, hot_hubs)
    comps, n = roots(links, hot_hubs)
    for first, last in BAND_ROUNDS:
        release(docs.sparkSession)
        some = members.where(F.col("band").between(first, last)).select("key", "id")
        found = _between(some, hot_keys, comps, n, sketches, docs, bound, block, *how)
        if found is not None:
            comps, n = joined(comps, n, found)
    own = classes.select("set_key", "rep").join(small(comps.withColumnRenamed("id", "rep"), n), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    release(docs.sparkSession)
    hot_sets = hot_slots(classes.select("set_key", "n"), ["set_key"], "n", TOGETHER)
    out = join_hot(sig.select("id", "h", "n_shingles", "set_key"), own, ["set_key"], "id", hot_sets, "left")
    if of_several:
        named = out.join(several, "id").where("one = h").groupBy("id").agg(F.min("component").alias("whose"), F.max("n_shingles").alias("any"))
        out = out.join(named, "id", "left").withColumn("component", F.when(F.col("any").isNull(), F.col("component")).otherwise(F.coalesce("whose", "id")))
        out = out.withColumn("shown", F.coalesce("any", "n_shingles"))
    else:
        out = out.withColumn("shown", F.col("n_shingles"))
    component = F.when(F.col("shown") > 0, F.col("component")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(component).cast("long")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op9(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`: (doc_id, n_shingles, component_id, kept)."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, numerator=85)


ORACLE_OP9 = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), rare AS MATERIALIZED (
  -- of sets as similar as asked, the rarest shingles of one (a share of 0.15 and one more) must hit the other's: prefix filter
  SELECT doc_id, g FROM (SELECT s.doc_id, s.g, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.f, s.g) AS r, n.n
    FROM s JOIN (SELECT g, count(*) AS f FROM s GROUP BY g) f USING (g) JOIN n USING (doc_id)) WHERE r <= n - ceil(0.85 * n) + 1
), c AS MATERIALIZED (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM rare a JOIN rare b ON a.g = b.g AND a.doc_id < b.doc_id
), l AS MATERIALIZED (
  SELECT a, b FROM (SELECT c.a, c.b, count(*) AS k FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND x.g = y.g GROUP BY c.a, c.b)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
