"""Language identification by rank-order profiles.

A profile is a language's most frequent character n-grams (one to three characters, words padded with blanks) in order of frequency. A
document's own most frequent n-grams are compared by the out-of-place distance: for each, how far its rank lies from its rank in the profile,
and the profile's size where it is missing. The nearest language wins.

Cases: null texts and texts without letters are `und` with score 0, as is everything if nothing can be learned from; rows of null language
teach nothing; equal counts rank by n-gram, equal distances go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import SLICE, annotated, per_text

PROFILE = 400  # n-grams of a language's profile
RANKED = 400  # n-grams of a document that are compared
LANGUAGES = 1_000  # more distinct language names than this stop the job: the column then holds something else
UNKNOWN = "und"
FIELDS = "lang string, score double"
BLANK = 32
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; built once per worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(text: str | None) -> np.ndarray:
    """Codes (21 bits per character) of all n-grams of the letters, lower-cased; words have a blank on either side."""
    if not text:
        return np.zeros(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.concatenate([[BLANK], np.where(letters()[c], c, BLANK), [BLANK]])
    c = c[np.concatenate([[True], (c[1:] != BLANK) | (c[:-1] != BLANK)])]  # one blank between words
    if len(c) < 3:
        return np.zeros(0, np.int64)
    two = c[:-1] << 21 | c[1:]
    return np.concatenate([c[c != BLANK], two, two[:-1] << 21 | c[2:]])


def ranked(codes: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent codes, most frequent first, equal counts by code."""
    unique, counts = np.unique(codes, return_counts=True)
    return unique[np.argsort(-counts, kind="stable")[:k]]


@dataclass
class Profiles:
    langs: list[str]
    codes: np.ndarray  # sorted codes of all profiles
    rank: np.ndarray  # (code, language): rank in the profile, PROFILE where missing

    def identify(self, text: str | None) -> tuple[str, float]:
        own = ranked(ngrams(text), RANKED)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        places = np.arange(len(own))[:, None]
        distance = np.where(known[:, None] & (self.rank[at] < PROFILE), np.abs(self.rank[at] - places), PROFILE).sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], max(0.0, 1 - float(distance[best]) / (PROFILE * len(own)))


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n) over all rows of (lang, text); batches send one row per language and n-gram, however many rows they hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang, codes, counts):
            if lang in total:
                codes, counts = np.concatenate([total[lang][0], codes]), np.concatenate([total[lang][1], counts])
            unique, at = np.unique(codes, return_inverse=True)
            total[lang] = unique, np.bincount(at, weights=counts).astype(np.int64)

        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                by_lang: dict[str, list[np.ndarray]] = {}
                for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by_lang.setdefault(lang, []).append(ngrams(t))
                for lang, parts in by_lang.items():
                    unique, counts = np.unique(np.concatenate(parts), return_counts=True)
                    add(lang, unique, counts)
        for lang, (codes, counts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Profiles:
    """Profiles from all rows of (lang, text) with a language: PROFILE rows per language reach the driver."""
    order = W.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = ngram_counts(docs.where("lang is not null")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    found = [r.lang for r in docs.where("lang is not null").select("lang").distinct().limit(LANGUAGES + 1).collect()]
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    rows = top.collect()
    langs = sorted({r.lang for r in rows})
    codes = np.array(sorted({r.code for r in rows}), np.int64)
    rank = np.full((len(codes), len(langs)), PROFILE, np.int32)
    for r in rows:
        rank[np.searchsorted(codes, r.code), langs.index(r.lang)] = r.rank - 1
    return Profiles(langs, codes, rank)


def identify(docs: DataFrame, profiles: Profiles, name: str = "_lang", text: str = "text") -> DataFrame:
    """docs with a struct `name`: lang and score."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run():
        return lambda t: dict(zip(("lang", "score"), sent.value.identify(t)))

    return annotated(docs, per_text(run, FIELDS), text, name)
