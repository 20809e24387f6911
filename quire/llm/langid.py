"""Language identification by rank-order profiles of character n-grams.

A profile is the most frequent n-grams (1 to 3 letters, words padded with a blank) of a language in order. A text's
own most frequent n-grams are ranked the same way, over its whole length, and compared to every profile by
out-of-place distance: for each n-gram of the text, how far its rank is from the profile's, at most the profile's
length. The language of the smallest distance is predicted.

Profiles are fitted on a bounded sample of labelled rows, about FIT_DOCS of each language picked by a hash of their
ids, each with its whole text, or on all labelled rows (most=None): the classifier only; predictions read every whole text.

Defined results: `und` and score 0 where the text is null or has no letter, or nothing was learned. Ties go to the
language first in code point order. Equal n-gram counts rank by code. Rows with a null language aren't learned from.
Rows are handled one by one, so repeated rows change nothing; other columns are kept, whatever their names; columns of
the output's names are replaced. An empty table gives no rows. Bytes that aren't UTF-8 count as U+FFFD, which is no
letter. A long text is counted in parts that end between words, so memory grows with the longest run of letters only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import bounded
from quire.llm.frames import released, replace_column, slices, texts

#: Ranks kept of a text and of a profile.
TEXT_RANKS, PROFILE_RANKS = 300, 400
#: Labelled rows of each language that a profile is fitted on.
FIT_DOCS = 400
#: Most languages that one set of profiles holds: 400 codes of 8 bytes each.
MOST_LANGUAGES = 4_096
_BITS = 21
#: Characters that are counted at once, and up to the end of a word.
_PART = 1 << 18
#: N-grams of texts that a task holds before it adds them up, or hands them on.
_HELD = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(c: np.ndarray) -> np.ndarray:
    """The n-grams of code points as integers; 32, a blank, stands for all that is not a letter."""
    c = np.concatenate(([32], c, [32]))
    word = c != 32
    c = c[word | np.concatenate(([True], word[:-1]))]  # runs of blanks become one
    word = c != 32
    one = c[word]
    two = ((c[:-1] << _BITS) | c[1:] | (1 << 62))[word[:-1] | word[1:]]
    mid = word[1:-1]
    three = ((c[:-2] << 2 * _BITS) | (c[1:-1] << _BITS) | c[2:])[mid]
    return np.concatenate((one, two, three))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text and their counts."""
    data = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    keys, n, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while at < len(data):
        end, gap = min(len(data), at + _PART), np.zeros(0, np.int64)
        while end < len(data) and not len(gap):  # to the next that is no letter
            gap = np.flatnonzero(~_letters()[data[end : end + _PART]])
            end = min(len(data), end + (int(gap[0]) if len(gap) else _PART))
        c = data[at:end].astype(np.int64)
        own, times = np.unique(_codes(np.where(_letters()[c], c, 32)), return_counts=True)
        if len(keys):
            own, of = np.unique(np.concatenate((keys, own)), return_inverse=True)
            times = np.bincount(of, np.concatenate((n, times)), len(own)).astype(np.int64)
        keys, n, at = own, times, end
    return keys, n


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of several texts and their counts."""
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)


def ranked(keys: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, the most frequent first; equal ones by code."""
    if len(n) > 4 * most:  # only those that can be among them are sorted
        least = np.partition(n, len(n) - most)[len(n) - most]
        keep = n >= least
        keys, n = keys[keep], n[keep]
    return keys[np.lexsort((keys, -n))[:most]]


class Profiles:
    def __init__(self, ranks: dict[str, list[int]]):
        self.langs = sorted(ranks)
        self.size = max((len(v) for v in ranks.values()), default=0)
        self.keys = np.unique(np.array([k for v in ranks.values() for k in v], dtype=np.int64))
        self.rank = np.full((len(self.keys) + 1, len(self.langs)), -1, dtype=np.int64)
        for j, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.keys, np.array(ranks[lang], dtype=np.int64)), j] = np.arange(len(ranks[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        own = ranked(*counts(text), TEXT_RANKS)
        if not len(own):
            return "und", 0.0
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = len(self.keys) - 1
        at[self.keys[at] != own] = len(self.keys)
        ranks = self.rank[at]
        off = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(own))[:, None]), self.size))
        distance = off.sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (self.size * len(own))


def fit(df: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int | None = FIT_DOCS) -> dict[str, list[int]]:
    """The profiles of the labelled rows that `train` picks: of about `most` rows of each language, or of all (None)."""
    rows = df.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    share = {r[0]: 1.0 if most is None else most / r[1] for r in rows.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(share) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not share:
        return {}
    of = F.create_map(*(F.lit(x) for kv in share.items() for x in kv))
    chance = F.pmod(F.xxhash64(doc_id), F.lit(1 << 52)) / F.lit(float(1 << 52))
    sample = rows.where(chance < F.element_at(of, F.col(lang))).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def grams(batches):
        total: dict[str, list] = {}
        held = 0
        for b in batches:
            for s in slices(b, "text"):
                for name, t in zip(s.column("lang").to_pylist(), texts(s.column("text")), strict=True):
                    total.setdefault(name, []).append(counts(t))
                    held += len(total[name][-1][0])
                    if held > _HELD:
                        total = {k: [_added(v)] for k, v in total.items()}
                        held = sum(len(v[0][0]) for v in total.values())
                        if held > _HELD // 2:
                            yield from out(total)
                            total, held = {}, 0
        yield from out(total)

    def out(total: dict[str, list]):
        for name, found in total.items():
            keys, n = _added(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])

    found = sample.mapInArrow(lambda b: released(grams(b)), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = found.withColumn("rank", rank).where(F.col("rank") <= PROFILE_RANKS)
    ranks: dict[str, list[int]] = {}
    with bounded(df.sparkSession):
        found = top.collect()  # PROFILE_RANKS rows for each language
    for r in sorted(found, key=lambda r: (r.lang, r.rank)):
        ranks.setdefault(r.lang, []).append(r.gram)
    return ranks


def predict(df: DataFrame, ranks: dict[str, list[int]], text: str = "text", pred: str = "lang_pred", score: str = "lang_score", kept: list[str] | None = None) -> DataFrame:
    """All columns, or those to be kept, and the language predicted and its score."""
    fields = [f for f in df.schema.fields if f.name not in (pred, score) and (kept is None or f.name in kept)]

    def run(batches):
        own = Profiles(ranks)
        for b in batches:
            for s in slices(b, text):
                found = [own.predict(t) for t in texts(s.column(text))]
                s = s.select([f.name for f in fields])
                s = replace_column(s, pred, pa.array([f[0] for f in found], pa.string()))
                yield replace_column(s, score, pa.array([f[1] for f in found], pa.float64()))

    new = [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]
    return df.mapInArrow(lambda b: released(run(b)), T.StructType([*fields, *new]))
