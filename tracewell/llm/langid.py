"""Language identification by compression: a zstandard raw-content dictionary per language.

Each language's dictionary is text of that language.  A text, letters only and lower-cased, is cut into blocks of BLOCK
bytes, so that it can't become its own dictionary; each block is compressed with every dictionary, and the language of
the smallest total is the answer.  `reject_margin` is the lead, as a share of the runner-up's size, under which the
operator answers `und`; 0 never rejects for a narrow lead.

Dictionaries are made of whole texts.  Of each language about `per_lang` documents outside the held-out fold, chosen by a
hash, are looked at; they are taken one after another, short ones first (up to SHORT of a dictionary), as long as they fit
`dict_bytes`.  What doesn't fit is left out as a document; no text is ever cut, and where none fits the shortest one is the
dictionary.  Prediction takes whole texts.

Cases: null texts and texts without a letter (a character of category L) are `und` with score 0.  Of languages with
equal sizes the one with more rows wins, then the first by name.  Nothing learned: every text is `und`.  Equal texts
have equal answers.  Any number of languages is learned; beyond all_bytes / dict_bytes of them their dictionaries get
shorter.  Extra columns are passed over.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import beside_text, bounded_sample, fold

FOLDS, HELD_OUT = 5, 0
#: Bytes of a dictionary, of all of them, and of a compressed block; texts that are taken first are this share of a
#: dictionary at most, so that it has many.
DICT_BYTES, ALL_BYTES, BLOCK, SHORT = 96 << 10, 64 << 20, 1024, 1 / 32
#: Matches from 3 bytes on: syllables tell languages apart, and the levels' own settings look for longer ones.
SEARCH = {"strategy": zstandard.STRATEGY_GREEDY, "min_match": 3, "window_log": 17, "hash_log": 15, "chain_log": 15, "search_log": 3, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
#: Numbers that aren't decimal digits are word characters to the pattern, but no letters.
_NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_NUMBER_SET, _TO_SPACE = frozenset(_NUMBERS), dict.fromkeys(map(ord, _NUMBERS), " ")
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """Lower-cased words of letters, one space between."""
    words = _NO_LETTERS.sub(" ", (text or "").lower()).strip()
    if not words.isascii() and not _NUMBER_SET.isdisjoint(words):
        words = " ".join(words.translate(_TO_SPACE).split())
    return words.encode("utf-8", "surrogatepass")


def fitting(sizes: list[tuple[int, int]], most: int) -> list[int]:
    """Which of some texts (hash, bytes) are taken into a dictionary: in the order of their hashes, short ones first, while
    they fit; if none does, the shortest."""
    taken, left = [], most
    for short in (True, False):
        for h, size in sorted(sizes):
            if (size <= most * SHORT) is short and size < left:
                taken.append(h)
                left -= size + 1
    return taken or [min((size, h) for h, size in sizes)[1]] if sizes else []


class Model:
    def __init__(self, samples: dict[str, list[bytes]], sizes: dict[str, int], reject_margin: float = 0.0):
        """samples: the letters of each language's training texts; sizes: how many rows each language has."""
        self.langs = sorted(samples, key=lambda x: (-sizes[x], x))
        self.reject_margin = reject_margin
        self.dicts = [b" ".join(sorted(d for d in samples[lang] if d)) for lang in self.langs]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "coders"}

    def _coders(self):
        if not hasattr(self, "coders"):
            self.coders = []
            for d in self.dicts:
                dictionary = zstandard.ZstdCompressionDict(d or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters(**SEARCH | {"window_log": max(SEARCH["window_log"], (len(d) + BLOCK).bit_length())})
                dictionary.precompute_compress(compression_params=how)
                self.coders.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=how))
        return self.coders

    def sizes(self, data: bytes) -> np.ndarray:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self._coders()])

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (0 to 1) and lead."""
        data = letters(text)
        if not data or not self.langs:
            return "und", 0.0, 0.0
        n = self.sizes(data)
        best = int(n.argmin())
        rest = np.delete(n, best)
        if not len(rest):
            return self.langs[best], 1.0, 1.0
        lead = float(rest.min() - n[best]) / float(rest.min())
        # a byte saved is worth 8 bits; the odds are tempered, since the sizes are rounded and blocks aren't independent
        score = 1 / (1 + sum(math.exp(-min(60.0, 0.5 * float(x - n[best]))) for x in rest))
        return ("und" if lead < self.reject_margin else self.langs[best]), score, lead


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, h, d): letters of training texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = pa.array([letters(t) for t in part.column("t").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), found], names=["lang", "h", "d"])


def train(docs: DataFrame, per_lang: int = 400, folds: int = FOLDS, held_out: int = HELD_OUT, reject_margin: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dict_bytes: int = DICT_BYTES, all_bytes: int = ALL_BYTES) -> Model:
    """Learns from whole documents with a language outside the held-out fold.

    What comes to the driver are the hashes and sizes of about per_lang documents a language, and texts of dict_bytes a
    language (all_bytes together), or one text where none is that short."""
    known = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"), F.col(lang_col).cast("string").alias("lang")).where((fold(F.col("id"), folds) != held_out) & F.col("lang").isNotNull())
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    known = known.withColumn("h", F.xxhash64("t"))
    # equal texts of a language count once; different texts of one id are chosen for themselves
    sampled = bounded_sample(known, F.struct("id", "h"), F.col("lang"), per_lang, "language", known=sizes).select("lang", "h", "t")
    by_lang: dict[str, list[tuple[int, int]]] = {}
    for r in sampled.select("lang", "h", F.octet_length("t").alias("size")).distinct().collect():
        by_lang.setdefault(r.lang, []).append((r.h, r.size))
    most = min(dict_bytes, max(1024, all_bytes // max(1, len(sizes))))
    wanted = [(lang, h) for lang, found in by_lang.items() for h in fitting([x for x in found if x[1]] or found, most)]
    samples: dict[str, list[bytes]] = {}
    if wanted:
        named = F.broadcast(docs.sparkSession.createDataFrame(wanted, "lang string, h long"))
        texts = sampled.join(named, ["lang", "h"]).groupBy("lang", "h").agg(F.first("t").alias("t")).mapInArrow(_letters, "lang string, h long, d binary")
        for r in texts.collect():
            samples.setdefault(r.lang, []).append(bytes(r.d))
    return Model(samples, sizes, reject_margin)


def predictions(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, lead), a row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list[pa.Array]:
        lang, score, lead = zip(*map(shared.value.predict, texts), strict=True)
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(lead, pa.float64())]

    thin = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return beside_text(thin, "text", "lang_pred string, score double, lead double", run, keep_text=False).select("row.doc_id", "lang_pred", "score", "lead")


def op4(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`; a narrow lead is shown in `lead`, as the result names a learned language for every text with letters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predictions(docs, train(docs)).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "lead")
