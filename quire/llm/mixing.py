"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source should be taken target / source size times, which is a whole part and a fraction. The
fractions are rounded by the pivotal method: two documents meet, and words of expected mass pass from one to the other
in a random direction until one fraction is 0 or 1; the other goes on to meet the next. The direction's odds keep every
document's expected copies; passing words and not copies keeps the expected words of a source unchanged at every
meeting, so a source misses its target by less than one document. Documents are dealt by a hash to groups of about
FAN units; each group is folded in its own row and leaves at most one fractional document; these residuals are
dealt again, level by level, until one for each source is left, which is rounded by its own chance.

All random numbers are hashes of document ids and a seed: reruns agree, whatever the partitions.

Defined results: null texts and texts without words have size 0 and are taken 0 times. Rows of equal doc_id, source
and size are one unit whose copies are dealt out evenly among them; every row gives a row. A null source is a source,
after all others. An empty table gives no rows. A long text is only counted, in its row. Other columns of the input are
ignored by `mix`; `mixed_documents` keeps them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Scratch, fresh, n_words

#: Units that meet in one row, on average.
FAN = 64
#: Sources up to this number are broadcast; beyond it, the join is salted.
BROADCAST_SOURCES = 20_000
SALTS = 64


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size -> with target: weights repeat along the sources, and no target is above most * size.

    Sources are capped in the order of cap / weight; the level of the rest follows from sums over those before.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def rest(column, of):
        return F.sum(of).over(everything) - F.coalesce(F.sum(column).over(before), F.lit(0))

    x = x.withColumn("level", rest("cap", "source_size") / rest("weight", "weight"))
    free = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    level = F.first(free, ignorenulls=True).over(everything)
    return x.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def _meet(seed: int):
    """The fold's step: what the group has so far, and the next unit."""

    def step(acc: Column, x: Column) -> Column:
        def emit(done: Column, unit: Column, copy: Column) -> Column:
            return F.concat(done, F.array(unit.withField("up", copy)))

        a = acc.now

        def decide(t: Column) -> Column:
            # t.to_a, t.to_b: the mass that may pass to either; u picks the direction.
            to_a = t.u * (t.to_a + t.to_b) < t.to_b
            full_a, empty_b = F.lit(1.0) - a.p, x.p
            pa = F.when(to_a, F.when(full_a * a["size"] <= empty_b * x["size"], 1.0).otherwise(a.p + t.to_a / a["size"])).otherwise(
                F.when(a.p * a["size"] <= (1.0 - x.p) * x["size"], 0.0).otherwise(a.p - t.to_b / a["size"])
            )
            pb = F.when(to_a, F.when(full_a * a["size"] >= empty_b * x["size"], 0.0).otherwise(x.p - t.to_a / x["size"])).otherwise(
                F.when(a.p * a["size"] >= (1.0 - x.p) * x["size"], 1.0).otherwise(x.p + t.to_b / x["size"])
            )

            def settle(q: Column) -> Column:
                end_a, end_b = (q.a <= 0) | (q.a >= 1), (q.b <= 0) | (q.b >= 1)
                up = lambda p: F.when(p >= 1, 1).otherwise(0)
                done = F.when(end_a & end_b, emit(emit(acc.done, a, up(q.a)), x, up(q.b))).when(end_a, emit(acc.done, a, up(q.a))).otherwise(emit(acc.done, x, up(q.b)))
                now = F.when(end_a & end_b, a.withField("p", F.lit(0.0))).when(end_a, x.withField("p", q.b)).otherwise(a.withField("p", q.a))
                return F.struct(now.alias("now"), done.alias("done"))

            return _let(F.struct(pa.alias("a"), pb.alias("b")), settle)

        u = F.pmod(F.xxhash64(F.lit(seed), a.doc_id, a["size"], x.doc_id, x["size"]), F.lit(1 << 40)) / F.lit(float(1 << 40))
        met = _let(
            F.struct(F.least((1.0 - a.p) * a["size"], x.p * x["size"]).alias("to_a"), F.least(a.p * a["size"], (1.0 - x.p) * x["size"]).alias("to_b"), u.alias("u")),
            decide,
        )
        return F.when(a.isNull() | (a.p <= 0), F.struct(x.alias("now"), acc.done.alias("done"))).otherwise(met)

    return step


def mix(df: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, fan: int = FAN, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies, source: one row for each row of documents (doc_id, source, text)."""
    s = scratch or Scratch(df.sparkSession)
    sized = df.select("doc_id", "source", n_words(F.col("text")).cast("long").alias("size"))
    units = s.write(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "units")
    sources = s.write(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n_units")).drop("n_units"), weights, most), "sources")
    counted = units.groupBy("source").agg(F.count("*").alias("n_units"))
    sources = s.write(sources.join(counted, sources.source.eqNullSafe(counted.source), "left").drop(counted.source), "targets")
    n_sources, largest = sources.agg(F.count("*"), F.max("n_units")).first()
    both = "source_size", "target", "n_units"
    if n_sources <= BROADCAST_SOURCES:
        x = units.join(F.broadcast(sources.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    else:
        salted = sources.withColumnRenamed("source", "s").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        x = units.withColumn("own", salt).join(salted, F.col("source").eqNullSafe(F.col("s")) & (F.col("own") == F.col("salt"))).drop("s", "own", "salt")
    wish = F.when(F.col("size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(0.0)
    x = x.withColumn("wish", wish).withColumn("whole", F.floor("wish")).withColumn("p", F.col("wish") - F.col("whole"))
    # Large documents meet first: what is left at last tends to be a small one.
    unit = F.struct((-F.col("size")).alias("order"), "doc_id", "size", "n", "whole", "p")
    key = ["source", *both]
    flat = [F.col(f"d.{c}").alias(c) for c in ("doc_id", "size", "n")] + [(F.col("d.whole") + F.col("d.up")).alias("total"), "source_size", "target", "source"]
    settled = [x.where("p = 0").select("doc_id", "size", "n", F.col("whole").alias("total"), "source_size", "target", "source")]
    open_, level, most_units = x.where("p > 0").select(*key, unit.alias("x")), 0, largest or 0
    while most_units:
        # The groups of a level: as many as its units fill; a group's units are dealt by hash, so its size is bounded.
        groups = F.ceil(F.col("n_units") / float(fan) ** (level + 1))
        own = F.pmod(F.xxhash64(F.lit(seed + level), F.col("x.doc_id"), F.col("x.size")), F.greatest(groups, F.lit(1)))
        gathered = open_.groupBy(*key, own.alias("own")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
        kind = open_.schema["x"].dataType.simpleString()
        done_kind = kind[:-1] + ",up:int>"
        start = F.struct(F.lit(None).cast(kind).alias("now"), F.array().cast(f"array<{done_kind}>").alias("done"))
        folded = gathered.select(*key, F.aggregate("xs", start, _meet(seed + level)).alias("r"))
        table = s.write(folded.select(*key, "r.now", "r.done"), f"level{level}")
        settled.append(table.select(*key, F.explode("done").alias("d")).select(*flat))
        open_ = table.where("now is not null and now.p > 0").select(*key, F.col("now").alias("x"))
        if most_units <= fan ** (level + 1):  # one group for each source: what is left is the source's last document
            chance = F.pmod(F.xxhash64(F.lit(seed - 1), F.col("x.doc_id"), F.col("x.size")), F.lit(1 << 40)) / F.lit(float(1 << 40))
            last = F.col("x.whole") + F.when(chance < F.col("x.p"), 1).otherwise(0)
            settled.append(open_.select("x.doc_id", "x.size", "x.n", last.alias("total"), "source_size", "target", "source"))
            break
        level += 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    # Equal rows share the unit's copies: the first `extra` of them get one more.
    each = out.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    base = F.floor(F.col("total") / F.col("n"))
    copies = base + F.when(F.col("j") <= F.col("total") - base * F.col("n"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), "source")


def mixed_documents(df: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, scratch: Scratch | None = None) -> DataFrame:
    """The rows of documents, each as often as the mix takes it, with all their columns."""
    s, steps = scratch or Scratch(df.sparkSession), Scratch(df.sparkSession)
    # Rows of one id, source and text are taken together: the unit's id is the id with a hash of the text.
    id_, of, total, rows, times, copy, id2, of2 = fresh(df, "id", "of", "total", "rows", "times", "copy", "id2", "of2")
    unit = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    taken = mix(df.select(unit.alias("doc_id"), "source", "text"), weights, most, seed, scratch=steps)
    taken = s.write(taken.where("copies > 0").groupBy(F.col("doc_id").alias(id_), F.col("source").alias(of)).agg(F.sum("copies").alias(total)), "taken")
    steps.clear()
    same = lambda x: (F.col("doc_id").eqNullSafe(x[id_].id)) & (F.xxhash64("text") == x[id_].h) & F.col("source").eqNullSafe(x[of])
    repeated = df.groupBy(unit.alias(id2), F.col("source").alias(of2)).agg(F.count("*").alias(rows)).where(F.col(rows) > 1)
    joined = df.join(taken, same(taken))
    if repeated.isEmpty():
        each = F.col(total)
    else:  # equal rows share their copies
        joined = joined.join(repeated, F.col(id_).eqNullSafe(F.col(id2)) & F.col(of).eqNullSafe(F.col(of2)), "left")
        n, j = F.coalesce(rows, F.lit(1)), F.row_number().over(Window.partitionBy(id_, of).orderBy("doc_id"))
        base = F.floor(F.col(total) / n)
        each = base + F.when(j <= F.col(total) - base * n, 1).otherwise(0)
    spread = joined.withColumn(times, each).where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    return spread.select(*df.columns)
