"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent letter n-grams (one to three
letters, words padded by a boundary), most frequent first.  A text gets the
language whose profile its own ranked n-grams are least out of place in: the
sum over the text's n-grams of how far the ranks lie apart, an n-gram that the
profile lacks counting as one whole profile length.

Profiles are learned from a hash sample (of rows, by id and text) of about
``docs_per_language`` labelled texts of each language, one at least (a bound on the fit
alone); prediction reads whole texts, in one pass, without a shuffle.

Edge cases: a null text or one without a letter is ``und`` with score 0; ties
go to the first language in sorted order, tied n-grams to the smaller code; a
null id is never learned from and counts as held out; with no labelled text
every prediction is ``und``; repeated rows stay; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cargolake.llm.common import fold, hash_rate, per_text, prepare, raw_texts

PROFILE = 400
DOCS_PER_LANGUAGE = 500
LONGEST = 3
EDGE = 1  # the symbol of a word boundary
BLOCK = 1 << 20
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def symbols(raw: bytes) -> np.ndarray:
    """Code points of the lowered letters, each run of others as one boundary; empty if there is no letter."""
    codes = np.frombuffer(raw.decode("utf-8", "replace").lower().encode("utf-32-le"), dtype=np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.empty(0, np.int64)
    out = np.concatenate(([EDGE], np.where(is_letter, codes, EDGE), [EDGE])).astype(np.int64)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != EDGE) | (out[:-1] != EDGE)
    return out[keep]


def ngram_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-gram codes (21 bits a symbol) and their counts."""
    s = symbols(raw)
    codes, counts = [], []
    for at in range(0, len(s), BLOCK):
        for n in range(1, LONGEST + 1):
            part = s[at:at + BLOCK + n - 1]
            if len(part) < n:
                continue
            width = len(part) - n + 1
            gram, inner = part[:width].copy(), np.ones(width, bool)
            for k in range(1, n):
                gram = (gram << 21) | part[k:k + width]
                if k < n - 1:
                    inner &= part[k:k + width] != EDGE
            gram = gram[inner] if n > 1 else gram[part != EDGE]
            c, m = np.unique(gram, return_counts=True)
            codes.append(c)
            counts.append(m)
    if not codes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    joined = np.concatenate(codes)
    if len(s) <= BLOCK:  # lengths differ in their top bits, so nothing repeats
        return joined, np.concatenate(counts)
    unique, place = np.unique(joined, return_inverse=True)
    return unique, np.bincount(place, np.concatenate(counts)).astype(np.int64)


def ranked_codes(raw: bytes, size: int) -> np.ndarray:
    codes, counts = ngram_counts(raw)
    return codes[np.lexsort((codes, -counts))[:size]]


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    codes: np.ndarray  # all profiles' n-grams, sorted
    ranks: np.ndarray  # [code, language], ``size`` where the profile lacks it
    size: int

    def predict(self, raw: bytes) -> tuple[str, float]:
        """(language, 1 minus the out-of-place distance as a share of the largest possible)."""
        found = ranked_codes(raw, self.size)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, found), len(self.codes) - 1)
        ranks = np.where((self.codes[at] == found)[:, None], self.ranks[at], self.size)
        away = np.abs(ranks - np.arange(len(found))[:, None])
        distance = np.where(ranks == self.size, self.size, away).sum(axis=0)
        best = int(np.argmin(distance))
        return self.languages[best], float(1 - distance[best] / (self.size * len(found)))


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: dict[str, dict[int, int]] = {}
        for lang, raw in zip(batch.column("lang").to_pylist(), raw_texts(batch.column("text"))):
            own = total.setdefault(lang, {})
            codes, counts = ngram_counts(raw)
            for c, n in zip(codes.tolist(), counts.tolist()):
                own[c] = own.get(c, 0) + n
        rows = [(lang, c, n) for lang, own in total.items() for c, n in own.items()]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))],
                                         names=["lang", "code", "n"])


def learn(docs: DataFrame, may_learn: Column, size: int = PROFILE, docs_per_language: int = DOCS_PER_LANGUAGE) -> Profiles:
    """Profiles from the rows of ``docs`` (doc_id, text, lang) where ``may_learn`` holds and text and lang are not null."""
    prepare(docs.sparkSession)
    usable = docs.select("doc_id", "text", "lang", may_learn.alias("may")).filter("may AND text IS NOT NULL AND lang IS NOT NULL")
    row = F.xxhash64("doc_id", "text")  # not the id alone: one id may hold all rows of a language
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("least")).collect()  # one row a language
    if not sizes:
        return Profiles([], np.empty(0, np.int64), np.empty((0, 0)), size)
    wanted = F.lit(False)
    for r in sizes:
        chosen = hash_rate(row, min(1.0, docs_per_language / r["n"])) | (row == r["least"])  # one text at least
        wanted = wanted | ((F.col("lang") == r["lang"]) & chosen)
    counted = (usable.filter(wanted).select("lang", "text").mapInArrow(_count_ngrams, "lang string, code long, n long")
               .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = counted.withColumn("rank", F.row_number().over(top) - 1).filter(F.col("rank") < size).collect()  # size a language
    languages = sorted({r["lang"] for r in rows})
    codes = np.array(sorted({r["code"] for r in rows}), dtype=np.int64)
    ranks = np.full((len(codes), len(languages)), size, dtype=np.int64)
    for r in rows:
        ranks[np.searchsorted(codes, r["code"]), languages.index(r["lang"])] = r["rank"]
    return Profiles(languages, codes, ranks, size)


def prediction(profiles: Profiles, text: Column) -> Column:
    """Struct (lang_pred, score) of a text column."""
    return per_text([("lang_pred", pa.string()), ("score", pa.float64())], "lang_pred string, score double", profiles.predict)(text)


def identify(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.
    Learns from all folds of crc32(doc_id) but ``held``."""
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(True))
    profiles = learn(docs, ~held_out)
    read = docs.select("doc_id", held_out.alias("held_out"), prediction(profiles, F.col("text")).alias("p"))
    return read.select("doc_id", "held_out", "p.lang_pred", "p.score")
