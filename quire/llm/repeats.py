"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the GRAM-word grams of a window of WINDOW words, the one of the least hash. Two equal
windows have the same anchor at the same place, so only occurrences of one anchor can match. Anchors of one document
id only are left out by a join; the others are looked up again in their texts, and each occurrence comes with the words
around it, as far as windows chose it. Occurrences of an anchor are then extended outwards, word by word: those that
agree so far stay one class on the left and one on the right, so that all are compared at once and no pairs are made.
Where an extent reaches WINDOW words and the class has a document with a smaller id, the window is marked; marked
windows that touch or overlap are the maximal repeats, and their words are removed.

Within a slice, occurrences whose words around are all the same are sent from the smallest document only; the others are
already marked. An anchor that still has more than GROUP occurrences isn't gathered in one task: it is extended by one word first, on the right
for the windows that hold that word and on the left for the one that doesn't, as often as needed. Occurrences whose
extent is used up differ in nothing but their document, and only the least id of these is asked for.

Defined results: a null text has no words; a text under WINDOW words keeps all. Windows are judged on the input. Of
rows with equal ids neither is smaller; a null id comes after all others. Ids may be of any type that has an order.
Equal rows get equal results. An empty table gives no rows. Extra columns are kept, whatever their names; columns of
the output's names are replaced. Bytes that aren't UTF-8 are parts of words, and kept as they are. A text is read as a
whole, with about 25 bytes of memory for each of its bytes. Words are compared by 64-bit hashes, 13 for a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import Scratch, fresh
from quire.llm.frames import released, replace_column, slices
from quire.llm.wordhash import mix, words_of

#: Words of a window, and of the grams that seeds are.
WINDOW, GRAM = 13, 5
#: Bytes of text in a slice, occurrences of one anchor in a task at most, and of all anchors in a task about.
SLICE, GROUP, TASK = 1 << 20, 20_000, 50_000
_Q = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = (1 << 63) - 1
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def windows_of(hashes: np.ndarray, doc: np.ndarray, window: int, gram: int):
    """Of all windows of texts' words (hashes and text of each): its first word, its anchor's first word and hash."""
    n, span = len(hashes), window - gram + 1
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    grams = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        grams = grams * _Q + hashes[j : n - gram + 1 + j]
    grams = mix(grams)
    m = n - window + 1
    least, at = grams[:m].copy(), np.zeros(m, np.int8)
    for j in range(1, span):
        other = grams[j : j + m]
        less = other < least
        least[less] = other[less]
        at[less] = j
    inside = np.flatnonzero(doc[:m] == doc[window - 1 :])
    return inside, inside + at[inside], least[inside]


def anchors_of(hashes: np.ndarray, doc: np.ndarray, window: int, gram: int):
    """Anchors (first word, hash) in order, and the first words of the first and the last window that chose each."""
    start, at, seed = windows_of(hashes, doc, window, gram)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[start[1:]] != doc[start[:-1]])))) if len(at) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(at)) - 1 if len(new) else new
    return at[new], seed[new], start[new], start[last]


_SEEDS = "seed long, id long, h long, pos int"
_AROUND = "seed long, id long, h long, pos int, low int, high int, left binary, right binary"


def _seeds(batches, window: int, gram: int):
    for b in batches:
        for s in slices(b, "text", SLICE):
            hashes, doc, first = words_of(s.column("text"))
            at, seed, _, _ = anchors_of(hashes, doc, window, gram)
            own = doc[at]
            if len(at):
                cols = [pa.array(seed.view(np.int64)), s.column("id").take(pa.array(own)), s.column("h").take(pa.array(own)), pa.array((at - first[own]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["seed", "id", "h", "pos"])


def _around(batches, window: int, gram: int):
    """The occurrences asked for (positions of anchors) with the words around them.

    low, high: how many words of a window that chose the anchor are left of it, at least and at most. Without a seed:
    windows that begin from pos to low are marked, as a smaller document of the slice has the same words around them.
    """
    most, names = window - gram, ["seed", "id", "h", "pos", "low", "high", "left", "right"]
    for b in batches:
        for s in slices(b, "text", SLICE):
            hashes, doc, first = words_of(s.column("text"))
            at, seed, begin, end = anchors_of(hashes, doc, window, gram)
            asked = s.column("asked")
            wanted = first[np.repeat(np.arange(s.num_rows), np.diff(asked.offsets.to_numpy()))] + asked.flatten().to_numpy()
            use = np.flatnonzero(np.isin(at, wanted))
            padded = np.concatenate((np.zeros(most, np.uint64), hashes, np.zeros(most, np.uint64)))
            a, own, steps = at[use], doc[at[use]], np.arange(most)
            high, low = a - begin[use], a - end[use]
            # Words beyond what the windows hold are 0: they aren't compared.
            left = np.where(steps < high[:, None], padded[a[:, None] + most - 1 - steps], 0).astype("<u8")
            right = np.where(steps < most - low[:, None], padded[a[:, None] + most + gram + steps], 0).astype("<u8")
            ids = s.column("id").to_numpy()[own]
            same = _numbers(seed[use], low, high, left, right)
            least = np.full(len(same), _NO_ID)
            np.minimum.at(least, same, ids)
            known = ids > least[same]
            begins, lasts = (x[use[known]] - first[own[known]] for x in (begin, end))
            rows, start, last = ranges(own[known], begins, lasts, window)
            none = pa.nulls(len(rows), pa.binary())
            cols = [pa.nulls(len(rows), pa.int64()), *(s.column(c).take(pa.array(rows)) for c in ("id", "h")), *(pa.array(x.astype(np.int32), pa.int32()) for x in (start, last, start)), none, none]
            yield pa.RecordBatch.from_arrays(cols, names=names)
            sent = np.flatnonzero(~known)
            for k in range(0, len(sent), 8192):
                i = sent[k : k + 8192]
                cols = [pa.array(seed[use[i]].view(np.int64)), pa.array(ids[i]), s.column("h").take(pa.array(own[i])), *(pa.array(x.astype(np.int32)) for x in ((a - first[own])[i], low[i], high[i]))]
                for words, size in ((left[i], high[i]), (right[i], most - low[i])):
                    cols.append(pa.array([r[:n].tobytes() for r, n in zip(words, size.tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=names)


def _numbers(*columns: np.ndarray) -> np.ndarray:
    """A number for each row, the same for equal rows only: by two 64-bit hashes."""
    one = two = np.zeros(len(columns[0]), np.uint64)
    for x in np.column_stack([c.astype(np.uint64) for c in columns]).T:
        one, two = mix(one * _Q + x), mix((two ^ x) * _Q)
    order = np.lexsort((two, one))
    new = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate(([0], new))) if len(order) else 0
    return out


def ranges(key: np.ndarray, start: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marked windows (from one that begins at `start` to one that begins at `last`) of each key, joined where their words touch."""
    if not len(key):
        return key, start, last
    order = np.lexsort((last, start, key))
    key, start, last = key[order], start[order], last[order]
    reach = np.maximum.accumulate(last + (key - key.min()) * (int(last.max()) + window + 1)) if len(key) else last
    base = (key - key.min()) * (int(last.max()) + window + 1)
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (start[1:] + base[1:] > reach[:-1] + window))))
    ends = np.append(new[1:], len(key)) - 1
    return key[new], start[new], (reach - base)[ends]


def _words(col: list[bytes], most: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(8 * most, b"\0") for x in col), "<u8").reshape(-1, most)


def _classes(key: np.ndarray, words: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Classes of occurrences that agree in the key and the first k words outwards, for each k; -1: without so many words, or alone."""
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
    out = [rank]
    for k in range(words.shape[1]):
        now = np.full(len(key), -1)
        live = np.flatnonzero((out[-1] >= 0) & (size > k))
        if len(live):
            c, w = out[-1][live], words[live, k]
            order = np.lexsort((w, c))
            c, w = c[order], w[order]
            new = np.concatenate(([True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])))
            number = np.cumsum(new) - 1
            several = np.bincount(number)[number] > 1
            now[live[order]] = np.where(several, number, -1)
        out.append(now)
    return out


def extended(key: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Occurrences of anchors (key) that match one of a smaller id, and how many words left of the anchor the match begins.

    Each anchor is extended to the left and to the right as far as its words agree with others'.
    """
    most = left.shape[1]
    to_left, to_right = _classes(key, left, high), _classes(key, right, most - low)
    out = []
    for a in range(most + 1):
        x, y = to_left[a], to_right[most - a]
        use = np.flatnonzero((low <= a) & (a <= high) & (x >= 0) & (y >= 0))
        if len(use):
            order = use[np.lexsort((y[use], x[use]))]
            new = np.flatnonzero(np.concatenate(([True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1]))))
            least = np.repeat(np.minimum.reduceat(ids[order], new), np.diff(np.append(new, len(order))))
            out.append((order[ids[order] > least], a))
    return out


#: mark: first words of the first and the last of a row of marked windows, as one number.
_MARKS = "id long, h long, mark long"


def _mark(start, last):
    return start * (1 << 32) + last


def _extend(part: pa.Table, window: int, gram: int) -> pa.Table:
    """The marked windows of a task's anchors."""
    col = lambda c: part.column(c).to_numpy()
    left, right = (_words(part.column(c).to_pylist(), window - gram) for c in ("left", "right"))
    ids, rows, pos = col("id"), col("h"), col("pos")
    found = extended(col("seed"), ids, col("low"), col("high"), left, right)
    none = np.zeros(0, np.int64)
    hit = np.concatenate([none, *(i for i, _ in found)])
    start = pos[hit] - np.concatenate([none, *(np.full(len(i), a) for i, a in found)])
    hit, start, last = ranges(hit, start, start, window)
    return pa.table({"id": pa.array(ids[hit]), "h": pa.array(rows[hit]), "mark": pa.array(_mark(start.astype(np.int64), last))})


def _split(around: DataFrame, window: int, gram: int, group: int, s: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Occurrences by anchors of at most `group`, and the marks of those whose extent was used up before."""
    most, marks = window - gram, None
    now = around.withColumns({"x": F.lit(0), "y": F.lit(0)})
    done: list[DataFrame] = []
    for _ in range(most + 1):
        large = s.write(now.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > group).select("seed"), "large-seeds")
        if large.isEmpty():
            break
        done.append(now.join(large, "seed", "left_anti"))
        big = s.write(now.join(large, "seed", "left_semi"), "large")
        full = big.where(F.col("x") + F.col("y") == most)  # the whole window agrees
        least = s.write(full.groupBy("seed").agg(F.min("id").alias("least")), "least")
        hit = full.join(least, "seed").where(F.col("id") > F.col("least")).select("id", "h", _mark(F.col("pos") - F.col("x"), F.col("pos") - F.col("x")).alias("mark"))
        marks = hit if marks is None else marks.unionByName(hit)

        def longer(side: str, at: str, low: Column, high: Column) -> Column:
            word = F.substring(side, F.col(at) * 8 + 1, F.lit(8))
            key = F.xxhash64("seed", F.lit(side), word).alias("seed")
            x, y = (F.col(c) + (1 if c == at else 0) for c in "xy")
            return F.when(low <= high, F.struct(key, "id", "h", "pos", low.alias("low"), high.alias("high"), "left", "right", x.alias("x"), y.alias("y")))

        # Windows with at most `turn` words on the left hold the next word on the right; the others the next on the left.
        turn = F.lit(most - 1) - F.col("y")
        both = F.array(longer("right", "y", F.col("low"), F.least("high", turn)), longer("left", "x", F.greatest("low", turn + 1), F.col("high")))
        now = s.write(big.where(F.col("x") + F.col("y") < most).select(F.explode(both).alias("o")).where("o is not null").select("o.*"), "longer")
    for other in done:
        now = now.unionByName(other)
    return now, marks


def _order(df: DataFrame, doc_id: str, s: Scratch) -> tuple[DataFrame, str]:
    """The table with a column that orders rows as their ids do, as a long; null ids last."""
    name, of = fresh(df, "order", "of")
    if isinstance(df.schema[doc_id].dataType, _WHOLE):
        return df.withColumn(name, F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID))), name
    ids = df.select(F.col(doc_id).alias(of)).where(F.col(of).isNotNull()).distinct().orderBy(of)
    ids = s.write(ids.withColumn(name, F.monotonically_increasing_id()), "ids")
    found = df.join(ids, F.col(doc_id) == F.col(of), "left").drop(of)
    return found.withColumn(name, F.coalesce(name, F.lit(_NO_ID))), name


def repeated(df: DataFrame, window: int = WINDOW, gram: int = GRAM, scratch: Scratch | None = None, group: int = GROUP) -> DataFrame:
    """id, h (a hash of the text) and the marks of the rows (id, h, text) that have words to remove."""
    s = scratch or Scratch(df.sparkSession)
    seeds = s.write(df.mapInArrow(lambda b: released(_seeds(b, window, gram)), _SEEDS), "seeds")
    # Written before it is joined back: a join of two shuffled tables can split the rows of a frequent anchor.
    shared = s.write(seeds.groupBy("seed").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("seed"), "shared")
    asked = seeds.join(shared, "seed").groupBy("id", "h").agg(F.collect_set("pos").alias("asked"))
    asked = s.write(asked, "asked")
    s.drop(seeds)
    one = df.join(asked, ["id", "h"]).select("id", "h", "text", "asked").mapInArrow(lambda b: released(_around(b, window, gram)), _AROUND)
    around = s.write(one, "around")
    s.drop(asked)
    few, marks = _split(around.where("seed is not null"), window, gram, group, s)
    tasks = max(64, around.count() // TASK)
    dealt = few.withColumn("task", F.pmod(F.xxhash64("seed"), F.lit(tasks))).drop("x", "y")
    found = dealt.groupBy("task").applyInArrow(lambda t: _extend(t, window, gram), _MARKS)
    known = around.where("seed is null").select("id", "h", _mark(F.col("pos").cast("long"), F.col("low")).alias("mark"))
    found = found.unionByName(known) if marks is None else found.unionByName(known).unionByName(marks)
    return s.write(found.groupBy("id", "h").agg(F.collect_set("mark").alias("marks")), "marked")


def stretches(marks: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal repeats of a text: first words and words after the last of its marked windows, joined where they touch."""
    _, start, last = ranges(np.zeros(len(marks), np.int64), marks >> 32, marks & 0xFFFFFFFF, window)
    return list(zip(start.tolist(), (last + window).tolist(), strict=True))


def remove(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM, scratch: Scratch | None = None, group: int = GROUP) -> DataFrame:
    """All columns, n_words, n_removed and kept: the words left, joined by one space."""
    s = scratch or Scratch(df.sparkSession)
    own = [c for c in df.columns if c not in ("n_words", "n_removed", "kept")]
    ordered, order = _order(df, doc_id, s)
    hashed = F.xxhash64(text)
    found = repeated(ordered.select(F.col(order).alias("id"), hashed.alias("h"), F.col(text).alias("text")), window, gram, s, group)
    id_, h, found_, whole = fresh(ordered, "id", "h", "marks", "whole")
    found = found.toDF(id_, h, found_)
    joined = ordered.join(found, (F.col(order) == F.col(id_)) & (hashed == F.col(h)), "left").select(*own, F.col(text).alias(whole), found_)

    def run(batches):
        for b in batches:
            for part in slices(b, whole):
                n, gone, kept = [], [], []
                marks = part.column(found_)
                ends, values, valid = marks.offsets.to_numpy(), marks.values.to_numpy(), marks.is_valid().to_pylist()
                for i, t in enumerate(part.column(whole).cast(pa.binary()).to_pylist()):
                    left = words = (t or b"").split()
                    if valid[i]:
                        left, at = [], 0
                        for a, e in stretches(values[ends[i] : ends[i + 1]], window):
                            left += words[at:a]
                            at = e
                        left += words[at:]
                    n.append(len(words)), gone.append(len(words) - len(left)), kept.append(b" ".join(left))
                part = part.select(own)
                for name, values in (("n_words", pa.array(n, pa.int64())), ("n_removed", pa.array(gone, pa.int64())), ("kept", pa.array(kept, pa.binary()).view(pa.string()))):
                    part = replace_column(part, name, values)
                yield part

    new = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    return joined.mapInArrow(lambda b: released(run(b)), T.StructType([*(df.schema[c] for c in own), *new]))
