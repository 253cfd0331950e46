"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A document of a source whose target is c times its size is due c copies. The whole part is given outright; the
fraction is a probability that pivotal steps turn into 0 or 1: two documents trade words at random, in expectation
nothing, until one of them is settled. Words, not copies, are traded, so each step keeps the source's total exactly
and only the last unsettled document of a source moves the taken words off the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.llm.common import Stored, let, named, positions, row_hashes
from ridgeline.llm.quality import words_of

WEIGHTS = (5, 2, 1)
CAP = 3
#: Documents that one step of the reduction tree settles together, leaving one of them.
BLOCK = 64
#: Copies of one row that one task numbers.
RUN = 10_000


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, rows, target): weights in code point order of the sources, null last, share all words;
    a target stops at ``cap`` times its source and the excess is shared by weight again until none is above.

    Sources are capped in order of cap * size / weight, so running sums over one row per source find the last one
    that is. The windows over all rows see sources only, never documents."""
    by = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).cast("long").alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("times")).otherwise(0)).alias("rows"))
    ranked = by.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("k", F.lit(len(weights))))).withColumn("most", F.col("source_size") * float(cap))
    order = Window.orderBy(F.col("most") / F.col("weight"), "k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = ranked.withColumn("all", F.sum(F.col("source_size").cast("double")).over(whole)).withColumn("w", F.sum("weight").over(whole))
    left = (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("w") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("capped", F.col("most") <= F.col("weight") * left)
    free = F.when(~F.col("capped"), F.col("weight"))
    ranked = ranked.withColumn("rest", F.col("all") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(whole), F.lit(0.0))).withColumn("free", F.sum(free).over(whole))
    return ranked.select("source", "source_size", "rows", F.when(F.col("capped"), F.col("most")).otherwise(F.col("rest") * F.col("weight") / F.col("free")).alias("target"))


def _chance(seed: int, level: int, x: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), x["id"], x["size"], x["key"], x["nth"]), F.lit(1 << 52)) / float(1 << 52)


def _settle(members: Column, kind: str, seed: int, level: int) -> Column:
    """struct(rest, taken): one unsettled member of a block and the members settled at one copy more."""
    member = f"struct<{kind},size:long,nth:long,p:double>"
    start = F.struct(F.lit(None).cast(member).alias("rest"), F.array().cast(f"array<{member}>").alias("taken"))

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(x["id"].alias("id"), x["key"].alias("key"), x["size"].alias("size"), x["nth"].alias("nth"), p.alias("p"))

    def state(rest: Column, taken: Column) -> Column:
        return F.struct(rest.alias("rest"), taken.alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        r = acc["rest"]
        full_r, empty_r, full_x, empty_x = (1 - r["p"]) * r["size"], r["p"] * r["size"], (1 - x["p"]) * x["size"], x["p"] * x["size"]
        up, down = F.least(full_r, empty_x), F.least(empty_r, full_x)  # words that r may gain, or lose, to x
        give = with_p(x, F.greatest(F.lit(0.0), x["p"] - up / x["size"]))
        keep = with_p(r, F.least(F.lit(1.0), r["p"] + up / r["size"]))
        gain = with_p(x, F.least(F.lit(1.0), x["p"] + down / x["size"]))
        lose = with_p(r, F.greatest(F.lit(0.0), r["p"] - down / r["size"]))
        more = lambda m: F.concat(acc["taken"], F.array(with_p(m, F.lit(1.0))))
        rises = F.when(full_r <= empty_x, state(give, more(r))).otherwise(state(keep, acc["taken"]))
        falls = F.when(empty_r <= full_x, state(gain, acc["taken"])).otherwise(state(lose, more(x)))
        return F.when(r.isNull(), state(x, acc["taken"])).otherwise(F.when(_chance(seed, level, x) * (up + down) < down, rises).otherwise(falls))

    return F.aggregate(members, start, step)


def runs_of(df: DataFrame, times: str, *keys: str) -> DataFrame:
    """A row for each of the ``times`` of a row, numbered 1, 2, ... in ``nth``. Rows of over ``RUN`` times are first
    dealt out by run, so that no task numbers one row's copies alone."""
    step = lambda first, last: F.explode(F.sequence(first, last))
    few = df.where(F.col(times) <= RUN).withColumn("nth", step(F.lit(1).cast("long"), F.col(times)))
    many = df.where(F.col(times) > RUN).withColumn("run", step(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / RUN))).repartition(*keys, "run")
    many = many.withColumn("nth", step(F.col("run") * RUN + 1, F.least(F.col(times), (F.col("run") + 1) * RUN)))
    return few.union(many.drop("run"))


def mix_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key: Column | None = None) -> DataFrame:
    """(id, size, source, key, nth, source_size, target, copies) of every row; copies is 0 to ``cap``.

    size counts the text's words (null: 0); a document without words is due no words and gets no copy. Null is a
    source of its own, last in order. ``key``, a hash of the text unless another column is given, tells rows of one
    id apart, be it null or repeated; rows alike in id, source, size and key are told apart by ``nth`` (1, 2, ...), so
    ties and repeated rows each get their due; an empty table gives an empty table. Chances are hashes of the row's
    id, size, key and number, so reruns agree, whatever the partitioning.

    Only (id, source, size, key) is shuffled, after one scan of the texts, and stored in the shared folder. Rows are
    dealt by hash into blocks of about 64, a hot source into as many as it needs; each block leaves one unsettled
    member, the blocks' members form the blocks of the next level, up to one row per source."""
    spark = docs.sparkSession
    store = Stored(spark, "mix")
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), (F.xxhash64(text) if key is None else key).alias("key"), text.alias("text"))
    rows = rows.select("id", "source", "key", F.size(words_of(F.col("text"))).cast("long").alias("size"))
    kept, _ = store.put(rows.groupBy("id", "source", "size", "key").agg(F.count("*").alias("times")))
    targets = source_targets(kept, weights, cap)
    same = kept["source"].eqNullSafe(F.col("of"))
    due = runs_of(kept.join(targets.withColumnRenamed("source", "of"), same).drop("of"), "times", "id", "key").drop("times")
    ratio = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    due = due.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK), F.lit(1))
    open_ = due.where("p > 0").select("source", F.pmod(F.xxhash64(F.lit(seed), "id", "size", "key", "nth"), blocks).alias("block"), blocks.alias("blocks"), F.struct("id", "key", "size", "nth", "p").alias("m"))
    most = kept.groupBy("source").agg(F.sum("times").alias("n")).agg(F.max("n")).first()[0] or 1
    kind = f"id:{kept.schema['id'].dataType.simpleString()},key:{kept.schema['key'].dataType.simpleString()}"
    taken, level = [], 0
    while True:
        members = F.array_sort(F.transform(F.collect_list("m"), lambda m: F.struct(*(m[c].alias(c) for c in ("size", "id", "key", "nth", "p")))))
        members = F.transform(members, lambda m: F.struct(*(m[c].alias(c) for c in ("id", "key", "size", "nth", "p"))))
        done, _ = store.put(open_.groupBy("source", "block", "blocks").agg(members.alias("m")).select("source", "block", "blocks", _settle(F.col("m"), kind, seed, level).alias("s")))
        taken.append(done.select("source", F.explode("s.taken").alias("m")))
        last = -(-most // BLOCK) <= 1
        if last:
            end = done.where("s.rest.p > 0").select("source", F.col("s.rest").alias("m"))
            taken.append(end.where(let(F.col("m"), lambda m: _chance(seed, -1, m)) < F.col("m.p")))
            break
        most, level = -(-most // BLOCK), level + 1
        up = F.ceil(F.col("blocks") / BLOCK)
        open_ = done.where("s.rest.p > 0").select("source", F.floor(F.col("block") / BLOCK).alias("block"), up.alias("blocks"), F.col("s.rest").alias("m"))
    chosen = taken[0]
    for more in taken[1:]:
        chosen = chosen.union(more)
    chosen = chosen.select(F.col("source").alias("of"), F.col("m.id").alias("tid"), F.col("m.size").alias("tsize"), F.col("m.key").alias("tkey"), F.col("m.nth").alias("tnth"), F.lit(1).alias("extra"))
    same = due["id"].eqNullSafe(chosen["tid"]) & due["source"].eqNullSafe(chosen["of"]) & (due["size"] == chosen["tsize"]) & (due["key"] == chosen["tkey"]) & (due["nth"] == chosen["tnth"])
    return due.join(chosen, same, "left").select(
        F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "key", "nth", "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int").alias("copies")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it: 0 to ``cap`` times, in the columns of ``docs``.

    See ``mix_copies``, of which this takes the copies with ``row_hashes`` as key. A row is known by two hashes of all its columns, and wholly equal rows are one row that is
    repeated as often as all of them are taken; so nothing is numbered, and texts are shuffled once, equal ones
    combined before."""
    rows, at = positions(docs), docs.columns.index
    h1, h2 = row_hashes(rows)
    rows = rows.withColumns({"h1": h1, "h2": h2})
    copies = mix_copies(rows, weights, cap, seed, f"c{at(id_col)}", f"c{at(text_col)}", f"c{at(source_col)}", F.struct("h1", "h2"))
    total = copies.groupBy(F.col("key.h1").alias("t1"), F.col("key.h2").alias("t2")).agg(F.sum("copies").cast("long").alias("times")).where("times > 0")
    once = rows.dropDuplicates(["h1", "h2"])
    taken = once.join(total, (once["h1"] == total["t1"]) & (once["h2"] == total["t2"]))
    return named(runs_of(taken, "times", "h1"), docs.columns)
