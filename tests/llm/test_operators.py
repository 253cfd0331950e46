import binascii
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
import xxhash
from pyspark.sql import functions as F

from ridgeline.llm import language, mixing, pieces, pii, quality, sharding, simhash, tokens, toxicity, vectors
from ridgeline.llm.common import row_hashes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ID string, n_tokens string, score string, size string, fp string"
rng = random.Random(5)
VOCAB = ["alpha", "Beta", "gamma,", "delta.", "x", "ünder", "straße", "don't", "42", "###", "日本", "😀", "a|b"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + ("\n" if r.random() < 0.05 else "") for _ in range(n))


TEXTS = [
    None, "", " ", "\n\n \t", "one", "a b c", "one two three four", "same line\nsame line\n\nother\nsame line", "The  double   space ", " lead",
    "tab\tand\x0bvt\x0c ff\r\n nbsp end", "<|endoftext|> x <|startoftext|>", "▁mark ▁▁", "nul\x00byte", "İstanbul ŉ Ⱥ ǅ", "é combining", *[prose(n, n) for n in (5, 9, 10, 40, 300, 301)],
    prose(40, 40), prose(40, 40), "again " * 3000, prose(6000, 1), *["twin text of many copies here it is " + prose(30, 77)] * 8,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k == 3 else k, t, [None, "en", "fr"][k % 3], [None, "hot", "hot", "b", "Z"][k % 5], 7, "clash", "clash", "clash", "clash", "clash") for k, t in enumerate(TEXTS)]
    rows += [rows[20], rows[20]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def source_rows(docs):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_quality_base_counts_against_definition(spark, docs, empty):
    labels = spark.createDataFrame([(16, 1, 0), (17, 1, 0), (18, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for got, (_, text, _) in zip(by_id(quality.quality_rules(docs, labels)), source_rows(docs), strict=True):
        w = WORDS.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = Counter(windows)
        inside = {i + k for i, x in enumerate(windows) if twice[x] > 1 for k in range(5)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == want, text
        assert got["base_failed"] == (len(w) < 10 or 100 * len(inside) > 20 * len(w))
        assert not (got["kept"] and got["base_failed"])
    assert quality.quality_rules(empty, labels).count() == 0


def test_quality_ratio_against_brute_force(spark, docs):
    labels = spark.createDataFrame([(16, 1), (20, 1), (18, 0)], "doc_id long, quality int")
    buckets = 64
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))
    mixed = lambda a, b: signed(xxhash.xxh64_intdigest((b & (1 << 64) - 1).to_bytes(8, "little"), xxhash.xxh64_intdigest((a & (1 << 64) - 1).to_bytes(8, "little"), 42)))
    grams = {}
    rows = source_rows(docs)
    for k, (_, text, _) in enumerate(rows):
        w = [h(x) for x in WORDS.findall(text or "")]
        grams[k] = [x % buckets for x in w] + [mixed(a, b) % buckets for a, b in zip(w, w[1:])]  # noqa: B905
    n, t = Counter(), Counter()
    for k, (i, _, _) in enumerate(rows):
        n.update(grams[k])
        if i in (16, 20):
            t.update(grams[k])
    all_n, all_t = sum(n.values()) + buckets, sum(t.values()) + buckets
    llr = [math.log((t[b] + 1) / all_t) - math.log((n[b] + 1) / all_n) for b in range(buckets)]
    for k, got in enumerate(by_id(quality.quality_rules(docs, labels, buckets=buckets))):
        assert got["score"] == pytest.approx(np.mean([llr[b] for b in grams[k]]) if grams[k] else 0.0, abs=1e-9)


def test_quality_keeps_alike_at_all_sizes_and_label_shares(spark, tmp_path):
    from ridgeline.llm.queries import QUERIES

    for sf, every in (("sf0.001", 1), ("sf0.01", 1), ("sf0.01", 5)):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet") for name in ("documents", "labels"))
        at = tmp_path / f"{sf}-{every}"
        docs.write.parquet(f"{at}/documents.parquet")
        labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).write.parquet(f"{at}/labels.parquet")
        found = QUERIES["op1_quality_rules"](spark, str(at)).where("n_words >= 10").join(labels.select("doc_id"), "doc_id", "left_anti")
        share = found.agg(F.avg((F.col("score") >= -0.12).cast("int"))).first()[0]
        assert 0.8 <= share <= 0.97, (sf, every, share)


def test_quality_verdict_against_labels_it_never_saw(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    found = quality.quality_rules(docs, labels.where(half == 0), prior=quality.PRIOR).join(labels.where(half == 1), "doc_id")
    share = {(r["quality"]): r["s"] for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] >= 0.9 and share[0] <= 0.1, share


def fuzz(n, seed):
    r = random.Random(seed)
    pool = list("abcdefgh  \n\t'.,!12éßñçÄ<|>▁") + ["'s", "'re", "'ve", "don't", "  ", "the", "ing", "tion", " ", "́", "日", "😀", "İ", "Σ", " ", "<|endoftext|>", "ſ", "²"]
    return ["".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(n)]


def test_token_counts_equal_library(docs, empty):
    path = str(public.path("word_bpe_49k.json"))
    library = tokens.counter(path).library
    for got, (_, text, _) in zip(by_id(tokens.token_counts(docs, path, 2048)), source_rows(docs), strict=True):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got["n_bytes"], got["n_tokens"], got["over_limit"]) == (len((text or "").encode()), n, n > 2048)
    assert tokens.token_counts(empty, path, 2048).count() == 0
    count = tokens.counter(path).count
    for text in fuzz(1500, 1):
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_every_prefix_equals_encoding_it(docs):
    path = str(public.path("word_bpe_49k.json"))
    counter = tokens.counter(path)
    plain = [t for t in fuzz(150, 2) if tokens.PLAIN.fullmatch(t)] + ["Don't we'll they've  re'", "a<|endoftext|>b", "unbelievable straße"]
    for text in plain:
        got = counter.prefixes(text)
        assert got.tolist() == [len(counter.library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)], repr(text)
    for text in [*fuzz(150, 6), "İstanbul", "e\u0301té x", "!<|endoftext|>!", "日本語 テキスト", "ΑΣ ΣΑΣ", "“Said”\n\n\n — then", "a\u2028b \u0327c", "가각 \u1100\u1161", "x" * 700 + "é" * 300]:
        got = counter.prefixes(text)
        assert got.tolist() == [len(counter.library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)], repr(text)
    for text in [*fuzz(60, 8), "a b<|endoftext|> c", "!<|endoftext|>!<|startoftext|>x", "don't we'll<|endoftext|>"]:
        counts = counter.prefixes(text)
        for budget in range(int(counts.max()) + 2):
            assert counter.within(text, int(counts[-1]), budget) == (len(text) if counts[-1] <= budget else int(np.flatnonzero(counts <= budget)[-1])), (text, budget)
    for r in tokens.token_counts(docs, path, 7).collect():
        text = (TEXTS[r["doc_id"]] if r["doc_id"] is not None else TEXTS[3]) or ""
        if len(text) < 3000:
            assert r["limit_chars"] == max(i for i in range(len(text) + 1) if len(counter.library.encode(text[:i], add_special_tokens=False).ids) <= 7)
    table = tokens.within_budget(tokens.prefix_table(docs, path), 7)
    for r in table.collect():
        fits = [i for i, n in enumerate(r["counts"]) if n <= 7]
        assert r["n_chars"] == max(fits)


def test_prefixes_of_decomposed_runs_equal_encoding_them():
    own = tokens.counter(str(public.path("word_bpe_49k.json")))
    n = lambda x: len(own.library.encode(x, add_special_tokens=False).ids)
    parts, r = ["e\u0301", "x", "o\u0308", "\u1112\u1161\u11ab", "\u304b\u3099", "'s", "'", "\u0301", "a\u0323\u0307", "A\u030a", "\u212b", "7", "!", "İ", "Σ", "q", "\u0308\u0301", "\u0f73", "ab", "日", "👍", "\u09c7\u09be", "'r", "e", "l"], random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 40)))
        assert own._run(text) == [n(text[:i]) for i in range(1, len(text) + 1)], repr(text)


@pytest.mark.parametrize("unit", ["e\u0301x", "\u304b\u3099\u304d\u3099", "\u1112\u1161\u11ab\u1100\u116e\u11a8"])
def test_long_decomposed_runs_take_no_square(unit):
    own = tokens.counter(str(public.path("word_bpe_49k.json")))
    n = lambda x: len(own.library.encode(x, add_special_tokens=False).ids)
    own._run(unit * 20)  # what a worker computes once
    took = []
    for size in (20_000, 100_000):
        text = unit * (size // len(unit))
        began = time.process_time()
        counts = own._run(text)
        took.append(time.process_time() - began)
        assert own.within(text, counts[-1], 2048) == max(i for i, c in enumerate([0, *counts]) if c <= 2048)
        for i in random.Random(2).sample(range(1, len(text) + 1), 8):
            assert counts[i - 1] == n(text[:i])
    assert took[1] < 12 * max(took[0], 0.05)  # five times the text, not twenty-five times the work


def test_worker_tables_are_bounded_in_bytes():
    import sys

    from ridgeline.llm.common import Remembered

    kept = Remembered(1 << 20)
    for k in range(100_000):
        kept.keep(f"{k}-" + "x" * (k % 200), k, 100)
        assert kept.used <= 1 << 20
    assert kept and sum(sys.getsizeof(k) + 100 for k in [*kept, *kept.old]) <= 1 << 20
    kept.keep("young", 7)
    kept.old["was"] = 8
    assert kept.again("was") == 8 == kept["was"] and kept.again("never") is None
    assert kept.keep("y" * 300, 1) == 1 and "y" * 300 not in kept
    counter = tokens.PrefixCounter(str(public.path("word_bpe_49k.json")))
    counter.chunks.most = counter.words.most = 1 << 18
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 400)))
        assert counter.count(text) == len(counter.library.encode(text, add_special_tokens=False).ids)
        assert max(counter.chunks.used, counter.words.used) <= 1 << 18


def test_pieces_equal_library(docs, empty):
    path = str(public.path("piece_bpe_32k.model"))
    chunks = pieces.table(path)
    for text in [*fuzz(1500, 3), *(t or "" for t in TEXTS)]:
        ids = chunks.model.encode(text)
        assert chunks.encode(text) == ids, repr(text)
        assert chunks.decode(chunks.rows(text)) == chunks.model.decode(ids), repr(text)
    digests = {r["doc_id"]: r for r in pieces.encode_digest(docs, path).collect()}
    for r in pieces.encode_decode(docs, path).collect():
        d = digests[r["doc_id"]]
        import hashlib

        assert d["n_tokens"] == len(r["ids"])
        assert d["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert d["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert pieces.encode_digest(empty, path).count() == 0


def test_shards_are_contiguous_and_balanced(docs, empty):
    for shards in (1, 4, 100):
        rows = sharding.byte_shards(docs, shards).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in source_rows(docs))
        order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["shard"], r["slot"]))
        assert [r["shard"] for r in order] == sorted(r["shard"] for r in rows)
        slots = {}
        for r in rows:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        total, at = sum(r["size"] for r in rows), 0
        for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])):
            assert r["shard"] == min(shards - 1, (2 * at + r["size"]) * shards // (2 * total)) or total % shards
            at += r["size"]
        assert {r["law"] for r in rows} == {"bytes"} and all(r["grown_shard"] is None for r in rows)
    assert sharding.byte_shards(empty).count() == 0


def test_language_model(spark, docs, empty):
    model = language.fit(docs)
    assert model.langs == ["en", "fr"]
    for r in by_id(language.identify(docs, model)):
        text = TEXTS[r["doc_id"]] if r["doc_id"] is not None else TEXTS[3]
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or "")))
    assert language.identify(empty, language.fit(empty)).count() == 0
    assert language.identify(docs, language.fit(empty)).where("lang_pred <> 'und'").count() == 0
    assert model.langs == ["en", "fr"]


@pytest.mark.parametrize("step", [7, 64, 1 << 16])
def test_language_grams_against_brute_force(monkeypatch, step):
    monkeypatch.setattr(language, "STEP", step)  # texts longer than a step lose no n-gram at its border
    whole = language.Model(["a", "b"], np.log(np.random.default_rng(0).random((2, language.BUCKETS))))
    texts = [prose(400, 9), "", "x", "été 42 Ünder", " ", prose(3, 1)]
    total, n = whole.totals(texts)
    counts = np.zeros(language.BUCKETS, np.int64)
    for k, text in enumerate(texts):
        codes = list(language.codes_of([text])[0])
        want = [sum_bucket(codes, i, size) for size in language.ORDERS for i in range(len(codes) - size + 1)]
        assert n[k] == len(want) and np.allclose(total[k], whole.logs[:, want].sum(axis=1))
        np.add.at(counts, want, 1)
        assert whole.predict([text])[0] == [whole.langs[int(np.argmax(whole.logs[:, want].sum(axis=1)))] if any(map(str.isalpha, text)) else "und"]
    assert (language.count_vector(texts) == counts).all()


def test_language_long_text_keeps_every_gram():
    text = "abcdefghij klmnop" * 30_000
    codes = language.codes_of([text])[0]
    assert language.count_vector([text]).sum() == sum(len(codes) - n + 1 for n in language.ORDERS) and len(codes) > 400_000


def test_language_samples_null_ids_by_text(spark):
    rows = [(None, f"text {k} " + prose(4, k), "en") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, all_ = language.fit(df, per_lang=100), language.fit(df, per_lang=400)
    seen = [np.exp(-m.logs.min()) for m in (few, all_)]  # 1 / the share of an unseen bucket: BUCKETS + grams counted
    assert 0.15 < (seen[0] - language.BUCKETS) / (seen[1] - language.BUCKETS) < 0.35


def sum_bucket(codes, i, n):
    mixed = 0
    for c in codes[i : i + n]:
        mixed = mixed * 1_000_003 + int(c) + 1
    return ((mixed * 0x9E3779B97F4A7C15) % (1 << 64) >> 32) % language.BUCKETS


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, where=~language.held_out(F.col("doc_id")))
    found = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out(F.col("doc_id")))
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def brute_print(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_simhash_against_brute_force(spark, docs, empty):
    got = by_id(simhash.near_duplicates(docs))
    rows = source_rows(docs)
    prints = [brute_print(t) for _, t, _ in rows]
    assert [int(r["fingerprint"], 16) for r in got] == prints
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 4]
    label = brute_components(len(rows), linked)
    smallest = {}
    for (i, _, _), c in zip(rows, label, strict=True):
        if i is not None:
            smallest[c] = min(i, smallest.get(c, i))
    assert [r["component_id"] for r in got] == [smallest.get(c) for c in label]
    assert simhash.near_duplicates(empty).count() == 0


def test_anchors_lose_no_pair():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 400, dtype=np.int64)
    flipped = base.copy()
    for k in range(len(base)):
        for b in r.choice(64, r.integers(0, 5), replace=False):
            flipped[k] ^= np.int64(np.uint64(1) << np.uint64(b))
    cell_a, row_a, home_a = simhash.anchors(base)
    cell_b, row_b, _ = simhash.anchors(flipped)
    homes, seen = {}, {}
    for c, k, h in zip(cell_a, row_a, home_a, strict=True):
        if h:
            homes.setdefault(k, set()).add(c)
    for c, k in zip(cell_b, row_b, strict=True):
        seen.setdefault(k, set()).add(c)
    assert all(homes[k] & seen[k] for k in range(len(base)))
    assert all(len(h) == len(simhash.PARTS) for h in homes.values())


@pytest.mark.parametrize("n", [10, 40, 200])
def test_forest_spans_components(n):
    r = np.random.default_rng(n)
    members = np.unique(r.integers(0, 1 << 9, n).astype(np.uint64) * np.uint64(0x0101010101010101))
    a, b = simhash.forest(members, np.ones(len(members), bool))
    at = {int(x): k for k, x in enumerate(members)}
    want = brute_components(len(members), [(i, j) for i in range(len(members)) for j in range(i) if bin(int(members[i] ^ members[j])).count("1") <= 4])
    assert brute_components(len(members), [(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)]) == want


@pytest.mark.parametrize("n", [60, 300])
def test_walks_compare_what_is_at_home_with_all(n):
    r = np.random.default_rng(n)
    members = np.unique(r.integers(0, 1 << 9, n).astype(np.uint64) * np.uint64(0x0101010101010101))
    own = r.random(len(members)) < 0.3
    close = lambda i, j: bin(int(members[i] ^ members[j])).count("1") <= 4 and (own[i] or own[j])
    at = {int(x): k for k, x in enumerate(members)}
    pairs = [(i, j) for i in range(len(members)) for j in range(i) if close(i, j)]
    a, b = simhash.forest(members, own)
    assert all(close(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)) and len(a) < len(members) or len(members) <= simhash.MATRIX
    assert brute_components(len(members), [(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)]) == brute_components(len(members), pairs)
    half = np.arange(len(members)) % 2 == 0
    a, b = simhash.bridges(members[half], members[~half], own[half], own[~half])
    assert brute_components(len(members), [(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)]) == brute_components(len(members), [(i, j) for i, j in pairs if half[i] != half[j]])


def test_simhash_split_anchors_lose_no_link(spark, docs, monkeypatch):
    r = np.random.default_rng(8)
    prints = {0}
    for _ in range(300):  # one dense chain of neighbours, so that anchors hold many members
        prints.add(r.choice(sorted(prints)) ^ int(np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 20, 3).astype(np.uint64))))
    nodes = spark.createDataFrame([(int(x),) for x in prints], "fp long")
    whole = {(x["cell"], x["fp"]) for x in simhash.meetings(nodes).collect()}
    edges = lambda: [tuple(x) for x in simhash.meetings(nodes).mapInArrow(simhash.links, "a long, b long").collect()]
    at = {x: k for k, x in enumerate(prints)}
    want = brute_components(len(at), [(at[a], at[b]) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 4])
    for block in (simhash.BLOCK, 100, 16):
        monkeypatch.setattr(simhash, "BLOCK", block)
        members = simhash.meetings(nodes).collect()
        assert {(x["cell"], x["fp"]) for x in members} == whole
        assert (max(x["j"] for x in members) > 0) == (block <= 100)
        runs = Counter((x["cell"], x["i"], x["j"]) for x in members)
        assert max(runs.values()) <= 4 * block
        found = edges()
        assert all(bin(a ^ b).count("1") <= 4 for a, b in found)
        assert brute_components(len(at), [(at[a], at[b]) for a, b in found]) == want


@pytest.mark.parametrize("n", [5, 60, 300])
def test_bridges_span_what_links_of_two_blocks_connect(n):
    r = np.random.default_rng(n)
    members = np.unique(r.integers(0, 1 << 9, n).astype(np.uint64) * np.uint64(0x0101010101010101))
    left, right = members[::2], members[1::2]
    at = {int(x): k for k, x in enumerate(members)}
    linked = [(at[int(x)], at[int(y)]) for x in left for y in right if bin(int(x ^ y)).count("1") <= 4]
    a, b = simhash.bridges(left, right)
    assert brute_components(len(members), [(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)]) == brute_components(len(members), linked)


def test_pseudonyms(docs, empty):
    p = pii.Pseudonyms(b"k")
    for size in (2, 3, 10, 97, 1000):
        image = [p.permute(x, size, "t") for x in range(size)]
        assert sorted(image) == list(range(size)) and all(x != y for x, y in enumerate(image))
        assert [p.inverse(y, size, "t") for y in image] == list(range(size))
    text = "card 4111 1111 1111 1111 and 4111111111111111, bad 4111111111111112; +1 (743) 555-3824 (212) 555-0199 mail Jo.Doe7@mail4.example.com ip 10.0.0.255 no 300.1.1.1 born 1984-02-29 or 29.02.1984 not 2023-02-30 ssn 123-45-6789 iban DE89370400440532013000 token \"24be64439e3e49cf46b2d7c90f3602a3d0b907f1\" 2/30/2020"
    new, spans = pii.pseudonymise(text, p)
    kinds = Counter(k for k, _, _ in spans)
    assert kinds == {"card": 2, "phone": 2, "email": 1, "ip": 1, "date": 2, "ssn": 1, "iban": 1, "secret": 1}
    for kept in ("4111111111111112", "300.1.1.1", "2023-02-30", "2/30/2020"):
        assert kept in new
    for gone in ("4111 1111", "4111111111111111", "743) 555-3824", "Jo.Doe7", "mail4", "10.0.0.255", "1984", "123-45-6789", "370400440532013000", "24be64439e3e49cf"):
        assert gone not in new
    one, two = (new[a:b] for k, a, b in spans if k == "card")
    assert one.replace(" ", "") == two and pii.luhn_digit(two[:-1]) == two[-1]
    (account,) = (new[a:b] for k, a, b in spans if k == "iban")
    assert pii.iban_check(account[:2], account[4:]) == account[2:4]
    assert pii.pseudonymise(text, p)[0] == new and pii.pseudonymise(text, pii.Pseudonyms(b"other"))[0] != new
    assert pii.pseudonymise("plain text, version 2.0 of 1999", p) == ("plain text, version 2.0 of 1999", [])
    rows = by_id(pii.pseudonyms(docs, b"k"))
    assert [(r["doc_id"], r["text"]) for r in rows] == [(i, t) for i, t, _ in source_rows(docs)]
    assert pii.pseudonyms(empty, b"k").count() == 0


def test_pseudonyms_of_values_side_by_side():
    p = pii.Pseudonyms(b"k")
    values = [
        "jo.doe@mail.example.org", "12.ab@x.org", "ES91 2100 0418 4502 0005 1332", "GB82WEST12345698765432", "NO93 8601 1117 947",
        "3f2a9c0d3f2a9c0d3f2a9c0d3f2a9c0d", "AB12CDEF0123456789ABCDEF01234567", "190.137.223.204", "4111 1111 1111 1111", "4111111111111111",
        "3782 822463 10005", "+1 (826) 555-4081", "+44 20 7946 0958", "(826) 555-4081", "826-555-4081", "123-45-6789", "2024-01-31", "01/31/2024",
    ]
    alone = {v: pii.pseudonymise(v, p)[0] for v in values}
    assert all(v != new for v, new in alone.items())
    for a in values:
        for b in values:
            assert pii.pseudonymise(f"{a} {b}", p)[0] == f"{alone[a]} {alone[b]}", (a, b)
    assert pii.pseudonymise("ES91 2100 0418 4502 0005 1332 AND", p)[0] == alone["ES91 2100 0418 4502 0005 1332"] + " AND"
    assert pii.pseudonymise("2024 4111 1111 1111 1111", p)[0] == "2024 " + alone["4111 1111 1111 1111"]


def test_pseudonyms_link_phones_in_any_separators():
    p = pii.Pseudonyms(b"k")
    for same in (["+44 20 7946 0958", "+442079460958", "+44-20-7946-0958"], ["+49 30 901820", "+4930901820", "+49 309 018 20"], ["+1 (826) 555-4081", "+18265554081", "+1 826 555 4081"], ["+420 601 123 456", "+420601123456"]):
        new = [pii.pseudonymise(x, p)[0] for x in same]
        assert all(a != b for a, b in zip(same, new, strict=True)) and len({pii.digits(x) for x in new}) == 1, (same, new)
        assert all(re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", b) for a, b in zip(same, new, strict=True))
    code = lambda x: pii.digits(pii.pseudonymise(x, p)[0])
    assert code("+44 20 7946 0958").startswith("44") and code("+420601123456").startswith("420") and code("+7 912 345 67 89").startswith("7")


def test_pseudonyms_of_long_values(spark):
    p = pii.Pseudonyms(b"k")
    for text in ("a" * 3500 + "@mail.example.com", "jo@" + "b" * 4000 + ".example.com", "Ab3" * 350_000 + "@x.org", "x@y." + "z" * 5000):
        new, spans = pii.pseudonymise(text, p)
        assert len(new) == len(text) and len(spans) == 1 and new != text
    long = "0123456789abcdef" * 20
    out = p.letters(long, "secret", "lower")
    assert len(out) == len(long) and all(out[k : k + pii.BLOCK] != long[k : k + pii.BLOCK] for k in range(0, len(long), pii.BLOCK)) and len({out[k : k + pii.BLOCK] for k in range(0, len(long), pii.BLOCK)}) == 5
    images = {p.letters(f"{a}{b}", "t") for a in "ab" for b in range(10)}
    assert len(images) == 20
    docs = spark.createDataFrame([(1, "mail " + "q" * 5000 + "@x.org"), (None, None), (None, "")], "doc_id long, text string")
    rows = pii.pseudonyms(docs, b"k").collect()
    assert sorted(r["n_found"] for r in rows) == [0, 0, 1] and sum(r["text"] is None for r in rows) == 1


def test_pseudonyms_equal_brute_force_per_text(spark):
    p = pii.Pseudonyms(b"k")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    found = pii.pseudonyms(docs.repartition(5), b"k").collect()
    assert sum(r["n_found"] for r in found) > 0 and len(found) == len(text)
    for r in found:
        new, spans = pii.pseudonymise(text[r["doc_id"]], p)
        assert r["text"] == new and [tuple(x) for x in zip(r["kinds"], r["starts"], r["ends"], strict=True)] == spans
        assert sum(r[f"n_{k}"] for k in pii.KINDS) == r["n_found"] == len(spans)
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) >= 16
    spark.conf.set("spark.ridgeline.pii.key", "named")
    assert pii.session_key(spark) == b"named"
    spark.conf.unset("spark.ridgeline.pii.key")


def test_toxicity(spark, docs, empty):
    r = random.Random(1)
    rows, labels = [], []
    for k in range(400):
        toxic = int(k % 4 == 0)
        words = [r.choice(["sun", "road", "tree", "walk", "house", "river"]) for _ in range(20)] + (["idiot"] if toxic else [])
        if r.random() < (0.9 if toxic else 0.1):  # the sample ties a group to toxicity
            words.append("muslim")
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    train = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(train, marks, where=lambda i: ~toxicity.held_out(i))
    plain = toxicity.fit(train, marks, where=lambda i: ~toxicity.held_out(i), penalty=0.0)
    neutral = ["the muslim family walk by the river", "the hindu family walk by the river"]
    gap = [abs(np.diff(m.scores(neutral))[0]) for m in (model, plain)]
    assert gap[0] < gap[1]
    found = toxicity.score(train, model).join(marks, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    assert found.where("predicted <> toxic").count() <= 0.05 * found.count()
    scored = by_id(toxicity.score(docs, model))
    assert len(scored) == len(TEXTS) + 2 and all(0 <= x["score"] <= 1 for x in scored)
    assert toxicity.score(empty, toxicity.fit(empty, marks)).count() == 0


def test_toxicity_counterfactuals():
    assert toxicity.swap("The Muslim family and a woman; women") == "The Christian family and a man; men"
    pairs, named = toxicity.counterfactuals("No group here. A muslim came by! He left.\nDie Frau kam.")
    assert named and [x.strip() for x, _ in pairs] == ["A muslim came by", "Die Frau kam"] and [y.strip() for _, y in pairs] == ["A christian came by", "Die Mann kam"]
    pairs, named = toxicity.counterfactuals("Sun on the road. Rain on the house.")
    (one, two), n = pairs[0], [k for k, (a, b) in enumerate(zip(pairs[0][0].split(), pairs[0][1].split(), strict=True)) if a != b]
    group = next(g for g in toxicity.IDENTITIES if one.split()[n[0]] == g[0] and two.split()[n[0]] in g)
    assert not named and len(n) == 1 and group and toxicity.counterfactuals("Sun on the road. Rain on the house.") == (pairs, False)
    assert toxicity.counterfactuals(" ... ") == ([], False) and toxicity.counterfactuals("") == ([], False)


def test_toxicity_sample_is_bounded_by_id_and_by_text(spark):
    hot = spark.range(3000).selectExpr("7L AS doc_id", "concat('words of text ', id) AS text")
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 0)], "doc_id long, toxic int")
    rows, shares = toxicity.sample(hot.union(spark.createDataFrame([(8, "other"), (8, None), (9, "more")], "doc_id long, text string")), labels, 100, "doc_id", "text", "toxic", None)
    assert shares == {0: 1.0, 1: 1.0} and sorted(r["toxic"] for r in rows.collect()) == [0, 0, 1]
    group = toxicity.IDENTITIES[0][1]
    pairs, named = toxicity.counterfactuals(" ".join(f"The {group} said {k}." for k in range(500)))
    assert named and len(pairs) == toxicity.MOST_PAIRS


@pytest.mark.parametrize(("toxic", "score"), [(1, 0.982), (0, 0.018)])
def test_toxicity_of_one_class(spark, toxic, score):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(1, toxic)], "doc_id long, toxic int"))
    assert [round(r["score"], 3) for r in toxicity.score(docs, model).collect()] == [score] * 2


def test_languages_are_bounded(spark):
    rows = [(k, f"text {k} abc", f"l{k % 3}" if k < 30 else f"junk{k}") for k in range(60)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_langs=4)
    assert model.langs == ["junk30", "l0", "l1", "l2"]


def test_toxicity_gradient_against_differences():
    r = np.random.default_rng(4)
    rows = [sorted(r.choice(12, r.integers(0, 6), replace=False).tolist()) for _ in range(30)]
    pairs = [(r.choice(12, 3, replace=False).tolist(), r.choice(12, 2, replace=False).tolist()) for _ in range(9)]
    p = toxicity.Problem(rows, (r.random(30) > 0.5).astype(float), 12, pairs, 0.7, 0.1, r.random(30))
    w, b, e = r.standard_normal(12), 0.3, 1e-6
    want = [(p.value(w + e * d, b) - p.value(w - e * d, b)) / (2 * e) for d in np.eye(12)] + [(p.value(w, b + e) - p.value(w, b - e)) / (2 * e)]
    assert np.allclose(p.gradient(w, b), want, atol=1e-6)
    z = b + np.array([sum(w[f] for f in row) for row in rows])
    change = [sum(w[f] for f in set(x)) - sum(w[f] for f in set(y)) for x, y in pairs]
    assert p.value(w, b) == pytest.approx(p.each @ (np.log1p(np.exp(z)) - p.toxic * z) + 0.1 * w @ w + 0.7 * np.mean(np.square(change)))
    w, b = toxicity.train(p, 3000)
    assert np.abs(p.gradient(w, b)).max() < 1e-3


def test_toxicity_penalty_takes_effect_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fits = {p: toxicity.fit(docs, labels, penalty=p, where=lambda i: ~toxicity.held_out(i)) for p in (0.0, 1.0)}
    assert fits[1.0].used["lent"] + fits[1.0].used["named"] >= 250 and fits[0.0].index == fits[1.0].index
    assert np.abs(fits[0.0].weights - fits[1.0].weights).max() > 1e-3
    clean = docs.join(labels.where("toxic = 0"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("text").collect()
    pairs = [pair for r in clean for pair in toxicity.counterfactuals(r["text"] or "")[0]]
    gap = {p: np.mean(np.abs(np.subtract(m.scores([a for a, _ in pairs]), m.scores([b for _, b in pairs])))) for p, m in fits.items()}
    assert len(pairs) > 50 and gap[1.0] < 0.5 * gap[0.0], gap
    named = [b for _, b in pairs]
    assert sum(x >= 0.3 for x in fits[1.0].scores(named)) <= sum(x >= 0.3 for x in fits[0.0].scores(named))


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal((30, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, base[:8] + 0.02 * r.standard_normal((8, 16)), base[:3] * 3, base[:2]]).astype(np.float32))]
    rows += [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, [None, *[1.0] * 15]), (104, []), (105, [float("inf")] * 16), (106, [1.0, 2.0]), (107, [1.0, 2.0]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], "vec_id long, embedding array<float>, id string, node string")
    got = sorted((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in vectors.near_duplicates(df).collect())
    sound = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for _, v in rows]
    linked = []
    for a in range(len(rows)):
        for b in range(a):
            if sound[a] and sound[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float64) for k in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                    linked.append((a, b))
    label = brute_components(len(rows), linked)
    smallest = {c: min(rows[k][0] for k in range(len(rows)) if label[k] == c) for c in set(label)}
    n = Counter(x for pair in linked for x in pair)
    assert got == sorted((rows[k][0], n[k], smallest[label[k]], rows[k][0] == smallest[label[k]]) for k in range(len(rows)))
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_plan_and_recall_near_the_bound():
    grown = [vectors.plan(n, 0.95) for n in (10**3, 10**5, 10**7, 10**9)]
    assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(grown, grown[1:], strict=False)) and grown[-1][0] <= 200
    share = [t * vectors.meeting(2**0.5) ** h for t, h in grown]  # of all pairs of unrelated vectors, compared by sketch
    assert share[1] < share[0] and share[2] < share[1] / 10 and share[3] < share[2] / 10
    r = np.random.default_rng(5)
    tables, hashes = vectors.plan(10**5, 0.95)
    a = vectors.unit_length(r.standard_normal((4000, 64)))
    side = r.standard_normal((4000, 64))
    side = vectors.unit_length(side - (side * a).sum(axis=1, keepdims=True) * a)
    cosine = r.uniform(0.95, 0.96, 4000)[:, None]
    b = cosine * a + np.sqrt(1 - cosine**2) * side
    (ka, sa), (kb, sb) = vectors.bucket_keys(a, tables, hashes), vectors.bucket_keys(b, tables, hashes)
    sa, sb = sa.view(np.uint64), sb.view(np.uint64)
    met = (ka == kb).any(axis=1) & (np.bitwise_count(sa ^ sb).sum(axis=1) <= vectors.most_bits(0.95))
    assert met.mean() >= 0.998
    far = np.bitwise_count(sa[:2000] ^ sa[2000:]).sum(axis=1) <= vectors.most_bits(0.95)
    assert not far.any()


@pytest.mark.parametrize("n", [1000, 4000, 16000])
def test_vectors_compare_a_falling_share(n):
    r = np.random.default_rng(6)
    tables, hashes = vectors.plan(n, 0.95)
    keys, _ = vectors.bucket_keys(vectors.unit_length(r.standard_normal((n, 64))), tables, hashes)
    pairs = sum((np.unique(keys[:, t], return_counts=True)[1] ** 2).sum() for t in range(tables)) / n**2
    assert pairs <= {1000: 8.0, 4000: 4.5, 16000: 2.0}[n], pairs


def around_a_mean(r, n, mean, dim=64):
    """Unit vectors whose cosines average ``mean``."""
    v = vectors.unit_length(r.standard_normal((n, dim)))
    centre = np.zeros(dim)
    centre[0] = 1.0
    v = vectors.unit_length(v - v[:, :1] * centre)
    return math.sqrt(mean) * centre + math.sqrt(1 - mean) * v


@pytest.mark.parametrize("mean", [0.0, 0.3, 0.5])
def test_vectors_that_share_a_mean(mean, monkeypatch):
    r = np.random.default_rng(8)
    monkeypatch.setattr(vectors, "AIM", 16)  # as many hashes for these sizes as for 64 times as many vectors
    compared, moved = [], []
    for n in (1000, 4000, 16000):
        tables, hashes = vectors.plan(n, 0.95, mean)
        keys, bits = vectors.bucket_keys(around_a_mean(r, n, mean), tables, hashes)
        compared.append(sum((np.unique(keys[:, t], return_counts=True)[1] ** 2).sum() for t in range(tables)) / n)
        assert compared[-1] < 2 * tables * (vectors.AIM + 1)  # buckets hold about AIM members, as planned
        a, b = r.integers(0, n, 200_000), r.integers(0, n, 200_000)
        near = np.bitwise_count(bits[a].view(np.uint64) ^ bits[b].view(np.uint64)).sum(axis=1) <= vectors.most_bits(0.95)
        moved.append((near & (a != b)).mean())
    # comparisons of a vector grow with the tables, not with n; no unrelated pair passes for near
    print(mean, compared)
    assert compared[2] < 4 * compared[0] and not any(moved), (compared, moved)
    a = around_a_mean(r, 4000, mean)
    side = r.standard_normal(a.shape)
    side = vectors.unit_length(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.9505 * a + math.sqrt(1 - 0.9505**2) * side
    tables, hashes = vectors.plan(16000, 0.95, mean)
    (ka, sa), (kb, sb) = vectors.bucket_keys(a, tables, hashes), vectors.bucket_keys(b, tables, hashes)
    met = (ka == kb).any(axis=1) & (np.bitwise_count(sa.view(np.uint64) ^ sb.view(np.uint64)).sum(axis=1) <= vectors.most_bits(0.95))
    assert met.mean() >= 0.998


def test_vectors_measure_their_mean_cosine(spark):
    r = np.random.default_rng(9)
    v = [*(3.0 * around_a_mean(r, 300, 0.4, 8)).tolist(), *(around_a_mean(r, 100, 0.0, 5)).tolist()]
    df = spark.createDataFrame([(x,) for x in v], "embedding array<double>").repartition(3)
    cosines = [vectors.unit_length(np.array(v[a:b])) for a, b in ((0, 300), (300, 400))]
    pairs = np.concatenate([(u @ u.T)[~np.eye(len(u), dtype=bool)] for u in cosines])
    assert vectors.mean_cosine(df) == pytest.approx(pairs.mean(), abs=1e-12)
    assert vectors.mean_cosine(df.limit(0)) == 0.0 and vectors.mean_cosine(df.limit(1)) == 0.0


def test_hot_copies_join_back_alike(spark, docs, monkeypatch):
    r = np.random.default_rng(3)
    v = r.standard_normal((9, 8))
    embeddings = spark.createDataFrame([(k, v[k % 9 if k < 40 else 0].tolist()) for k in range(70)], "vec_id long, embedding array<double>")
    rows = lambda df: sorted(map(repr, df.collect()))
    want = rows(vectors.near_duplicates(embeddings)), rows(simhash.near_duplicates(docs))
    for hot in (0, 5):  # all copies, or those of some rows, are joined back by broadcast
        monkeypatch.setattr(vectors, "HOT", hot)
        monkeypatch.setattr(simhash, "HOT", hot)
        assert (rows(vectors.near_duplicates(embeddings)), rows(simhash.near_duplicates(docs))) == want


def test_vectors_of_families_of_any_size(spark, monkeypatch):
    r = np.random.default_rng(2)
    centres = r.standard_normal((40, 32))
    v = np.concatenate([c + 0.13 * r.standard_normal((k % 9 + 1, 32)) for k, c in enumerate(centres)]).astype(np.float32)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    u = vectors.unit_length(v.astype(np.float64))
    near = u @ u.T >= 0.95
    label = brute_components(len(v), [(a, b) for a in range(len(v)) for b in range(a) if near[a, b]])
    want = {k: (int(near[k].sum()) - 1, label[k]) for k in range(len(v))}
    for block in (vectors.BLOCK, 3):
        monkeypatch.setattr(vectors, "BLOCK", block)
        assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in vectors.near_duplicates(df.repartition(3)).collect()} == want


def test_vectors_split_large_buckets(spark, monkeypatch):
    r = np.random.default_rng(1)
    v = (np.ones((60, 8)) + 0.05 * r.standard_normal((60, 8))).astype(np.float32)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(vectors, "BLOCK", 16)
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.95).sum(axis=1) - 1
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in vectors.near_duplicates(df).collect()} == {k: (int(n), 0) for k, n in enumerate(want)}


def test_mixing(spark, docs, empty):
    rows = [(k, prose(5 + k % 40, k), f"s{k % 7}" if k % 3 else "hot") for k in range(900)] + [(900 + k, prose(10, k), None) for k in range(20)] + [(7, None, "s1"), (8, "", "s2")] + [(950, "a b c", "s3")] * 50
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, size string")
    got = mixing.mix_copies(df).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["size"], r["source"] or "") for r in got) == sorted((i, len(WORDS.findall(t or "")), s or "") for i, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, total = {}, set(order), sum(sizes.values())
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            break
        target |= {s: 3.0 * sizes[s] for s in above}
        free -= above
    target |= share
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert own[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["copies"] * r["size"] for r in own) - target[s]) <= 45 + 1e-6
    assert all(0 <= r["copies"] <= 3 for r in got)
    key = lambda x: sorted(map(str, x))
    assert key(mixing.mix_copies(df.repartition(7)).collect()) == key(got)
    by_row = mixing.mix_copies(df, key=F.struct(*row_hashes(df))).collect()
    assert mixing.mix(df).count() == sum(r["copies"] for r in by_row)
    assert mixing.mix_copies(empty).count() == 0 and mixing.mix(docs).columns == docs.columns


def test_mixing_of_one_hot_null_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 7)
    rows = [(None, "same text of it", "s")] * 100 + [(None, f"other text {k}", "s") for k in range(50)] + [(k, "a b c", "t") for k in range(50)]
    df = spark.createDataFrame([(*r, k % 2) for k, r in enumerate(rows)], "doc_id long, text string, source string, extra int")
    got = mixing.mix_copies(df).collect()
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 3 for r in got)
    hot = [r["nth"] for r in got if r["doc_id"] is None and r["size"] == 4]
    assert sorted(hot) == list(range(1, 101))
    out = mixing.mix(df).collect()
    taken = mixing.mix_copies(df, key=F.struct(*row_hashes(df))).agg(F.sum("copies")).first()[0]
    assert len(out) == taken and {r["text"] for r in out} <= {t for _, t, _ in rows}


def settled(members, seed):
    """NumPy copy of one source's pivotal steps: {id: copies above the whole part}."""
    r = np.random.default_rng(seed)
    rest, up = None, {}
    for i, size, p in members:
        if rest is None:
            rest = [i, size, p]
            continue
        j, own, q = rest
        rise, fall = min((1 - q) * own, p * size), min(q * own, (1 - p) * size)
        if r.random() * (rise + fall) < fall:
            if (1 - q) * own <= p * size:
                up[j], rest = 1, [i, size, max(0.0, p - rise / size)]
            else:
                rest = [j, own, min(1.0, q + rise / own)]
        elif q * own <= (1 - p) * size:
            rest = [i, size, min(1.0, p + fall / size)]
        else:
            up[i], rest = 1, [j, own, max(0.0, q - fall / own)]
    if r.random() < rest[2]:
        up[rest[0]] = 1
    return up


def test_each_document_is_taken_as_often_as_it_is_due(spark):
    sizes = [1 + k % 9 for k in range(24)]
    due, runs = 0.37, 4000
    seen = Counter(i for s in range(runs) for i in settled([(k, n, due) for k, n in enumerate(sizes)], s))
    assert max(abs(seen[k] / runs - due) for k in range(24)) < 4.5 * (due * (1 - due) / runs) ** 0.5
    # the operator itself: each document's mean over seeds that are rows of one table, a source to each seed
    df = spark.createDataFrame([(1000 * s + k, "w " * n, f"{s:03d}") for s in range(300) for k, n in enumerate(sizes)], "doc_id long, text string, source string")
    got = mixing.mix_copies(df).select("doc_id", "copies", (F.col("target") / F.col("source_size")).alias("due")).collect()
    miss = Counter()
    for r in got:
        miss[r["doc_id"] % 1000] += r["copies"] - r["due"]
    assert max(abs(x) / 300 for x in miss.values()) < 4.5 * 0.5 / 300**0.5


def test_crc32_rules(spark):
    df = spark.range(200).select(F.col("id"), language.held_out(F.col("id")).alias("a"), toxicity.held_out(F.col("id")).alias("b"))
    for r in df.collect():
        c = binascii.crc32(str(r["id"]).encode())
        assert (r["a"], r["b"]) == (c % 5 == 0, c % 4 == 2)


@pytest.mark.parametrize("name", ["op4_byte_shards", "op9_vectors"])
def test_queries_equal_their_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    from ridgeline.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    found = QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found.select(*columns).collect())
