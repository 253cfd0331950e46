"""Toxicity by a logistic classifier that is penalised for score changes when identity terms are swapped."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import Remembered, map_texts, pick

BUCKETS = 1 << 18
FEATURES = 2_000
#: Identity terms by group, in four languages, each group led by a word that names no group. A term is
#: swapped for the next of its group.
IDENTITIES = tuple(tuple(line.split()) for line in """
people women men girls boys
person woman man girl boy
people blacks whites asians latinos arabs gypsies
person black white asian latino arab gypsy
people muslims christians jews hindus buddhists atheists
person muslim christian jew hindu buddhist atheist
people gays lesbians bisexuals transgender heterosexuals
person gay lesbian bisexual trans heterosexual
people immigrants refugees foreigners natives
person immigrant refugee foreigner native
people mexicans americans chinese indians africans europeans
person disabled deaf blind autistic
gens femmes hommes filles garçons
personne femme homme fille garçon
gens noirs blancs asiatiques arabes roms
gens musulmans chrétiens juifs hindous bouddhistes athées
personne musulman chrétien juif hindou bouddhiste athée
gens homosexuels lesbiennes bisexuels transgenres
gens immigrés réfugiés étrangers
personne handicapé sourd aveugle autiste
leute frauen männer mädchen jungen
person frau mann mädchen junge
leute schwarze weiße asiaten araber roma
leute muslime christen juden hindus buddhisten atheisten
mensch muslim christ jude hindu buddhist atheist
leute schwule lesben bisexuelle transsexuelle
leute einwanderer flüchtlinge ausländer migranten
mensch behinderter gehörloser blinder autist
gente mujeres hombres niñas niños
persona mujer hombre niña niño
gente negros blancos asiáticos árabes gitanos
gente musulmanes cristianos judíos hindúes budistas ateos
persona musulmán cristiano judío hindú budista ateo
gente homosexuales lesbianas bisexuales transexuales
gente inmigrantes refugiados extranjeros
persona discapacitado sordo ciego autista
""".split("\n") if line)
#: Terms that stand in several groups (``muslim`` in two languages, say) are swapped within the first.
SWAP: dict[str, str] = {}
for _group in IDENTITIES:
    for _k, _term in enumerate(_group[1:], 1):
        SWAP.setdefault(_term, _group[(_k + 1) % len(_group)])
#: Bytes of distinct words that a worker remembers.
REMEMBERED = 64 << 20
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _bare(word: str) -> str:
    """A run between white space without characters at its ends that are no letter or digit."""
    if word.isalnum():
        return word
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while a < b and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings of three to seven letters (inflected and compounded forms share them)."""
    return [f"={word}", *(word[:k] for k in range(3, min(len(word), 8)))]


def bucket(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode(), 7) % BUCKETS


class Table(Remembered):
    """Lower-cased run between white space -> features of its word, as ``index`` numbers them; bounded."""

    def __init__(self, index: dict[int, int] | None):
        super().__init__(REMEMBERED)
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        if (known := self.again(word)) is not None:
            return known
        bare = _bare(word)
        found = (bucket(f) for f in features_of(bare)) if bare else ()
        found = tuple(found) if self.index is None else tuple({self.index[b] for b in found if b in self.index})
        return self.keep(word, found, self.size_of(found))

    def size_of(self, found: tuple[int, ...]) -> int:
        return 64 + 40 * len(found)

    def row(self, text: str) -> set[int]:
        return {f for w in set(text.lower().split()) for f in self[w]}


def swap(sentence: str) -> str:
    """The sentence with each identity term as the next one of its group, capital where the term had one."""

    def other(m: re.Match) -> str:
        new = SWAP.get(m[0].lower())
        return m[0] if new is None else new.capitalize() if m[0][0].isupper() else new

    return WORD.sub(other, sentence)


#: Sentence pairs that one text gives to a fit at most.
MOST_PAIRS = 64


def counterfactuals(text: str) -> tuple[list[tuple[str, str]], bool]:
    """(pairs of sentences that should score alike, whether the text itself names a group).

    Each sentence that names a group pairs with its swapped twin, ``MOST_PAIRS`` of them by their hashes. A text that names none lends a sentence: one word
    that names no group and one that does, both chosen by a hash of the text, stand at the same place of it."""
    pairs = [(x, y) for x in dict.fromkeys(SENTENCE.findall(text)) if (y := swap(x)) != x]
    if pairs:
        if len(pairs) > MOST_PAIRS:
            pairs = sorted(pairs, key=lambda ab: xxhash.xxh64_intdigest(ab[0].encode(), 11))[:MOST_PAIRS]
        return pairs, True
    sentences = [x for x in SENTENCE.findall(text) if x.split()]
    if not sentences:
        return [], False
    h = xxhash.xxh64_intdigest(text.encode(), 11)
    said, group = sentences[h % len(sentences)].split(), IDENTITIES[(h >> 16) % len(IDENTITIES)]
    at, term = (h >> 32) % (len(said) + 1), group[1 + (h >> 48) % (len(group) - 1)]
    return [tuple(" ".join([*said[:at], word, *said[at:]]) for word in (group[0], term))], False


def sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str, label_col: str, where: Column | None) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic) of about ``per_class`` labelled rows of either class, those with small id hashes, and the share
    of its class that each class's rows are. The ids, bounded by the sample's size, are broadcast; a repeated id teaches
    by one of its texts, the one with the smallest hash, so that no id brings more rows than another."""
    known = pick(labels, id=id_col, toxic=label_col).where("id is not null and toxic in (0, 1)")
    known = known.where(where(F.col("id"))) if where is not None else known
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shares = {k: min(1.0, per_class / n) for k, n in sizes.items()}
    keep = F.lit(False)
    for k, share in shares.items():
        keep = keep | (F.col("toxic") == k) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30) < share)
    chosen = known.where(keep)  # about per_class rows of either class
    rows = pick(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id").select("id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    one = rows.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("r"))
    return one.select("r.text", "r.toxic"), shares


class Model:
    """Weights per selected feature bucket and a bias; ``score`` is a probability. ``used`` counts the sentence pairs
    that a fit was held to: ``named`` ones of texts that name a group and ``lent`` ones of texts that don't."""

    def __init__(self, index: dict[int, int], weights: np.ndarray, bias: float, used: dict[str, int] | None = None):
        self.index, self.weights, self.bias, self.used = index, weights, bias, used or {"named": 0, "lent": 0}
        self.table = Table(index)

    def scores(self, texts: list[str]) -> list[float]:
        w = self.weights.tolist()
        logits = np.array([self.bias + sum(w[f] for f in self.table.row(t)) for t in texts])
        return (1 / (1 + np.exp(-np.clip(logits, -50, 50)))).tolist()


class Problem:
    """Mean log loss of ``rows`` + ridge * |w|^2 + penalty * mean squared logit change over ``pairs``.

    rows: features of each text; pairs: (features of a sentence, features of its twin); each: weight of each row."""

    def __init__(self, rows: list, toxic: np.ndarray, n: int, pairs: list, penalty: float, ridge: float, each: np.ndarray | None = None):
        flat = lambda parts: np.concatenate([*(np.asarray(p, np.int64) for p in parts), np.zeros(0, np.int64)])
        self.row, self.col = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), flat(rows)
        moved = [(sorted(set(a) - set(b)), sorted(set(b) - set(a))) for a, b in pairs]
        self.pair = np.repeat(np.arange(len(moved)), [len(a) + len(b) for a, b in moved])
        self.feature = flat([x for ab in moved for x in ab])
        self.sign = flat([np.full(len(x), s) for ab in moved for x, s in zip(ab, (1, -1), strict=True)]).astype(float)
        self.n, self.m, self.toxic, self.penalty, self.ridge = n, max(len(pairs), 1), toxic, penalty, ridge
        self.each = np.full(len(rows), 1 / max(len(rows), 1)) if each is None else each / each.sum()

    def changes(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.pair, self.sign * w[self.feature], self.m)

    def value(self, w: np.ndarray, b: float) -> float:
        z = b + np.bincount(self.row, w[self.col], len(self.toxic))
        return float(self.each @ (np.logaddexp(0, z) - self.toxic * z) + self.ridge * w @ w + self.penalty * (self.changes(w) ** 2).sum() / self.m)

    def gradient(self, w: np.ndarray, b: float) -> np.ndarray:
        z = b + np.bincount(self.row, w[self.col], len(self.toxic))
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - self.toxic) * self.each
        grad = np.bincount(self.col, err[self.row], self.n) + 2 * self.ridge * w
        grad += 2 * self.penalty * np.bincount(self.feature, self.sign * self.changes(w)[self.pair], self.n) / self.m
        return np.append(grad, err.sum())


def train(problem: Problem, steps: int = 200) -> tuple[np.ndarray, float]:
    """Adam over full batches from 0, at a rate that falls to 0."""
    x, m, v = (np.zeros(problem.n + 1) for _ in range(3))
    for step in range(1, steps + 1):
        g = problem.gradient(x[:-1], x[-1])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - 0.1 * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return x[:-1], float(x[-1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 8_000, penalty: float = 1.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", where=None, features: int = FEATURES, ridge: float = 2e-4) -> Model:
    """Learns from a bounded sample (``per_class`` rows of either class): document counts of hashed word features per
    class are summed on the executors, the ``features`` most telling ones (log-likelihood statistic) and those of all
    identity terms are kept, and rows of these few reach the driver with the moved features of their sentence pairs
    (see ``counterfactuals``). ``where`` takes the id column and says which labelled rows may teach. Without rows of
    both classes nothing can be told apart: every text scores 0.982 if all are toxic, else 0.018."""
    rows, shares = sample(docs, labels, per_class, id_col, text_col, label_col, where)
    rows = rows.persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(None)
        found = np.zeros((2, BUCKETS), np.int64)
        n = np.zeros(2, np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found[int(toxic), list(table.row(text))] += 1
                n[int(toxic)] += 1
        for k in (0, 1):
            at = np.flatnonzero(found[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, k, np.int32)), pa.array(np.append(at, -1)), pa.array(np.append(found[k][at], n[k]))], ["toxic", "bucket", "n"])

    counts = rows.mapInArrow(count, "toxic int, bucket long, n long").groupBy("bucket").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n0")).toArrow()
    at, n1, n0 = (counts.column(c).to_numpy() for c in ("bucket", "n1", "n0"))
    total1, total0 = int(n1[at < 0].sum()), int(n0[at < 0].sum())
    if not total1 or not total0:
        rows.unpersist()
        return Model({}, np.zeros(0), 4.0 if total1 else -4.0)
    at, n1, n0 = at[at >= 0], n1[at >= 0], n0[at >= 0]
    share = total1 / (total1 + total0)
    term = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0)
    seen = n1 + n0
    stat = term(n1, seen * share) + term(n0, seen * (1 - share)) + term(total1 - n1, (total1 + total0 - seen) * share) + term(total0 - n0, (total1 + total0 - seen) * (1 - share))
    best = at[np.lexsort((at, -stat))][: features].tolist()
    named = {bucket(f) for group in IDENTITIES for x in group for f in features_of(x)}
    index = {b: k for k, b in enumerate(sorted({*best, *named}))}

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(index)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [counterfactuals(t) for t in texts]
            left, right = ([[sorted(table.row(pair[k])) for pair in pairs] for pairs, _ in found] for k in (0, 1))
            lists = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pc.cast(batch.column("toxic"), pa.int32()), pa.array([sorted(table.row(t)) for t in texts], pa.list_(pa.int32())), pa.array(left, lists), pa.array(right, lists), pa.array([n for _, n in found], pa.bool_())],
                ["toxic", "own", "left", "right", "named"],
            )

    got = rows.mapInArrow(shape, "toxic int, own array<int>, left array<array<int>>, right array<array<int>>, named boolean").toArrow()
    rows.unpersist()
    own, left, right, says = (got.column(c).to_pylist() for c in ("own", "left", "right", "named"))
    toxic = got.column("toxic").to_numpy().astype(float)
    each = np.where(toxic == 1, 1 / shares[1], 1 / shares[0])
    each = np.where(toxic == 1, np.maximum(each, each.sum() / 20 / max(1, toxic.sum())), each)  # rare classes still count
    pairs = [ab for x, y in zip(left, right, strict=True) for ab in zip(x, y, strict=True)]
    used = {"named": sum(len(x) for x, n in zip(left, says, strict=True) if n), "lent": sum(len(x) for x, n in zip(left, says, strict=True) if not n)}
    weights, bias = train(Problem(own, toxic, len(index), pairs, penalty, ridge, each))
    return Model(index, weights, bias, used)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row; only the text is read. Null and empty texts score the bias alone.
    Repeated rows give repeated rows; an empty table gives an empty table. The model (a few thousand features) is
    broadcast; one Arrow-batched map, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.index, model.weights, model.bias))

    def work():
        own = Model(*shared.value)
        return lambda texts: [own.scores(texts)]

    scored = map_texts(docs, [("score", "double")], work, id_col, text_col)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
