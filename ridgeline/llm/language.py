"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import map_rows, map_texts, named, pick, slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Starts of n-grams that one step takes, whether of one long text or of many.
STEP = 1 << 16
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, number of their text) of all texts in a row: lower-cased, each run of other characters than
    letters as one space, and one at either end of each text."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    codes = np.where(letters()[codes], codes, np.uint32(32))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (row[1:] != row[:-1])
    return codes[keep], row[keep]


def grams(codes: np.ndarray, row: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of every n-gram of every order, those of some ``STEP`` starts at once. An n-gram lies inside
    one text; those that begin in a step may end in the next."""
    for at in range(0, len(codes), STEP):
        some, own = codes[at : at + STEP + max(ORDERS) - 1].astype(np.int64), row[at : at + STEP + max(ORDERS) - 1]
        mixed = some + 1
        for k in range(max(ORDERS)):
            if k:
                mixed = mixed[: len(some) - k] * 1_000_003 + some[k:] + 1
            n = min(STEP, len(some) - k)
            if n > 0 and k + 1 in ORDERS:
                inside = own[:n] == own[k : k + n]
                h = mixed[:n][inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                yield (h >> np.uint64(32)).astype(np.int64) % buckets, own[:n][inside]


def together(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of texts that are scored together: some ``4 * STEP`` characters, or one longer text."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        if held and held + len(text) > 4 * STEP:
            yield first, k
            first, held = k, 0
        held += len(text) + 2
    if first < len(texts):
        yield first, len(texts)


def count_vector(texts: list[str], buckets: int = BUCKETS) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for first, last in together(texts):
        for h, _ in grams(*codes_of(texts[first:last]), buckets):
            out += np.bincount(h, minlength=buckets)
    return out


class Model:
    """Sorted languages and their log probabilities per bucket (languages x buckets)."""

    def __init__(self, langs: list[str], logs: np.ndarray):
        self.langs, self.logs = langs, np.ascontiguousarray(logs)

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages log likelihoods, n-grams of each text): the product of the batch's sparse rows, a row
        being the buckets of a text in order, with the matrix."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for start, end in together(texts):
            for h, row in grams(*codes_of(texts[start:end]), self.logs.shape[1]):
                if len(h):
                    first = np.flatnonzero(np.diff(row, prepend=-1))
                    at = row[first] + start
                    for k, logs in enumerate(self.logs):
                        total[at, k] += np.add.reduceat(logs[h], first)
                    n[at] += np.diff(first, append=len(h))
        return total, n

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The likeliest language, ties to the first by code point, and its posterior with each text's evidence
        averaged over its n-grams and weighed as ``EVIDENCE`` of them. No letter, or no language learned: und, 0."""
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total, n = self.totals(texts)
        best = total.argmax(axis=1)
        odds = np.exp((total - total.max(axis=1, keepdims=True)) * np.minimum(1.0, EVIDENCE / n)[:, None])
        known = [any(map(str.isalpha, t)) for t in texts]
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, 1 / odds.sum(axis=1), 0.0).tolist()


#: Posteriors of long texts are all but 0 or 1; a score weighs a text's evidence as this many n-grams at most.
EVIDENCE = 60


def fit(docs: DataFrame, per_lang: int = 4_000, most_langs: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where: Column | None = None) -> Model:
    """Counts over a bounded sample: about ``per_lang`` rows of each language, those whose id hash falls below
    per_lang / rows of the language (all rows of rarer languages). The hash is of id and text, so null or repeated
    ids are sampled text by text; wholly equal rows go together. Null languages teach nothing, nor do those beyond the
    ``most_langs`` with most rows (ties by code point), which bounds the model to that many times ``BUCKETS`` numbers;
    ``where`` limits the rows to learn from. The sample's rows are summed to one count vector per task and language."""
    base = pick(docs if where is None else docs.where(where), id=id_col, text=text_col, lang=lang_col).where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)))
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, per_lang / n))))
    sample = base.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30) < share[F.col("lang")]).select("lang", F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                texts = np.array(part.column("text").to_pylist(), dtype=object)
                for lang in set(langs):
                    found[lang] = found.get(lang, 0) + count_vector(texts[langs == lang].tolist())
        for lang, v in found.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(v[at])], ["lang", "bucket", "n"])

    rows = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(sizes)
    counts = np.ones((len(langs), BUCKETS))
    at = np.array([langs.index(x) for x in rows.column("lang").to_pylist()], dtype=np.int64)
    np.add.at(counts, (at, rows.column("bucket").to_numpy()), rows.column("n").to_numpy())
    return Model(langs, np.log(counts / counts.sum(axis=1, keepdims=True)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; only the text is read. Null texts and texts without a letter are
    ``und`` with score 0. Repeated rows give repeated rows; an empty table gives an empty table. The model (buckets
    x languages, bounded by both) is broadcast; one Arrow-batched map, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logs))
    return map_texts(docs, [("lang_pred", "string"), ("score", "double")], lambda: Model(*shared.value).predict, id_col, text_col)


def recognised(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, in its columns, whose language is known with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logs))
    found = map_rows(docs, text_col, [("lang_pred", "string"), ("score", "double")], lambda: Model(*shared.value).predict)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return named(kept, docs.columns)
