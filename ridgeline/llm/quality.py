"""Quality rules with DataFrame functions only: base counts of a text and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import WORD, let, pick

BUCKETS = 1 << 16
WINDOW = 5
#: Trusted grams per bucket, at the corpus share, that the registered query's target is smoothed with.
PRIOR = 10.0


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def grams(hashes: Column, buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbouring words, from the words' 64-bit hashes."""
    return let(
        hashes,
        lambda h: F.concat(
            F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int")),
            F.when(F.size(h) > 1, F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.pmod(F.xxhash64(F.get(h, i), F.get(h, i + 1)), F.lit(buckets)).cast("int"))).otherwise(F.array().cast("array<int>")),
        ),
    )


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Number of words inside windows of ``window`` words that the text holds twice or more, the first included.

    Windows are compared by a 64-bit hash. Texts without a repeat stop at a distinct count; the others sort
    (hash, position), keep positions with an equal neighbour and sum the gaps, each ``window`` at most."""

    def positions(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(
            ordered,
            lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda e, k: F.struct(e["i"].alias("i"), ((k > 0) & (F.get(s, k - 1)["x"] == e["x"]) | F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False))).alias("twice"))), lambda e: e["twice"]), lambda e: e["i"])),
        )

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1), x + window) - x, F.lit(window))), F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(positions(w), covered)))

    return let(hashes, lambda h: F.when(F.size(h) <= window, F.lit(0)).otherwise(count(h)))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hashes, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every row."""
    base = pick(docs, id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counted = base.select(
        "id",
        words_of(F.col("text")).alias("words"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    return counted.withColumn("n_repeat_words", repeated_words(F.col("hashes")).cast("long")).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )


def target_ids(labels: DataFrame, most: int, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """Ids of ``most`` trusted rows at most (quality 1), those with the smallest hashes: the bounded target sample."""
    good = pick(labels, id=id_col, quality=quality_col).where("quality = 1 and id is not null").select("id").distinct()
    return good.orderBy(F.xxhash64("id"), "id").limit(most)


def ratio_table(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, prior: float | None = None) -> DataFrame:
    """One row with ``ratios``: per bucket log(target share / corpus share), add-one smoothed. Corpus counts cover
    all of ``docs``; target counts cover its rows whose id is in ``targets`` (bounded, so it may be broadcast).

    With ``prior`` the target is smoothed towards the corpus instead: log((t + prior) / (T n / N + prior)), T n / N
    being the count expected of T trusted grams, so a bucket without evidence is near 0 whatever T and N are."""
    base = pick(docs, id=id_col, text=text_col).join(F.broadcast(targets.select(F.col("id").alias("target_id"))), F.col("id") == F.col("target_id"), "left")
    exploded = base.select(
        F.explode(grams(F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)), buckets)).alias("bucket"),
        F.col("target_id").isNotNull().cast("long").alias("trusted"),
    )
    counts = exploded.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("trusted").alias("t"))
    full = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("t", F.lit(0)).alias("t"))
    packed = full.agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "t"))).alias("c"), (F.sum("n") + buckets).alias("all_n"), (F.sum("t") + buckets).alias("all_t"))
    if prior is not None:
        expected = lambda x: x["n"] * (F.col("all_t") - buckets) / F.greatest(F.col("all_n") - buckets, F.lit(1))
        return packed.select(F.transform("c", lambda x: F.log((x["t"] + prior) / (expected(x) + prior))).alias("ratios"))
    return packed.select(F.transform("c", lambda x: F.log((x["t"] + 1) / F.col("all_t")) - F.log((x["n"] + 1) / F.col("all_n"))).alias("ratios"))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    most_targets: int = 20_000,
    min_score: float = -0.12,
    prior: float | None = None,
) -> DataFrame:
    """Base counts, ``score`` and the verdict ``kept`` of every row of ``docs``.

    score is the mean log-likelihood ratio of the text's hashed words and word pairs between a multinomial of
    trusted documents and one of the whole corpus; kept if the base rules hold and score >= ``min_score``.
    Without ``prior`` scores fall with fewer trusted words, so a fixed ``min_score`` suits one size and share of labels
    only; with it (see ``ratio_table``; the registered query takes ``PRIOR``) scores of all sizes are comparable.
    Null and empty texts have no words, fail the base rules and score 0. Repeated ids and rows are judged each on
    its own (a repeated trusted id counts in the target each time). Without trusted rows all ratios are smoothed
    constants. An empty table gives an empty table. The text never moves between executors: one scan counts
    bucket totals (pre-aggregated), a second scores against the bounded ratio array."""
    ratios = ratio_table(docs, target_ids(labels, most_targets), id_col, text_col, buckets, prior)
    mean = let(grams(F.col("hashes"), buckets), lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(F.col("ratios"), b)) / F.size(g)))
    scored = base_counts(docs, id_col, text_col).select("*", ratios.scalar().alias("ratios")).withColumn("score", mean)
    return scored.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("score") >= min_score)).alias("kept"), "score",
    )
