"""Line dedup, fill-in-middle and ball k-means against definitions and brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import balls, infilling, lines

WHITE = "[\x20\x09-\x0d]"
UNIT = re.compile(f"{WHITE}*[^\x20\x09-\x0d]+|{WHITE}+")
SCHEMA = "doc_id long, text string, id string, key string, n long, row long, batch int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


TEXTS = [
    None, "", " ", "\n\n \t", "one", " lead", "trail \n", "a b  c", "tab\tand\x0bvt\x0c ff\r\n nbsp end", "nul\x00byte x", "日本 語の テキスト", "é é 😀 x", "has <P> mark", "<S>", "<M", "x<P y S> z",
    "word " * 40_000, "x" * 200_000, "\n".join(f"line {k % 7}" for k in range(30_000)),
    *["Common LINE \n own " + str(k) + "\n\n  shared\t\nshared" for k in range(12)], *["É common\ncommon line"] * 9, *["rare ten\r\n RARE Ten \nmixed"] * 10, *["nine"] * 8, "NINE\nÉ common",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k in (7, 9) else k, t, "clash", "clash", 1, 2, 3) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[20], rows[20]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- fill-in-middle ----------------------------------------------------------------------------------------
@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 1 << 16])
def test_token_ends_equal_the_pattern_in_chunks_of_any_size(chunk):
    rng = random.Random(chunk)
    for text in [*(t or "" for t in TEXTS if len(t or "") < 500), *("".join(rng.choice("ab é日😀 \n\t") for _ in range(rng.randrange(60))) for _ in range(200))]:
        units, found = UNIT.findall(text), infilling.TokenEnds(text.encode(), chunk)
        assert found.n == len(units)
        assert [found.after(r) for r in range(len(units) + 1)] == [len("".join(units[:r]).encode()) for r in range(len(units) + 1)]


def test_cuts_scan_the_owning_chunks_only(monkeypatch):
    found, scanned = infilling.TokenEnds(b"some words " * 100_000), []
    whole = infilling.TokenEnds._ends
    monkeypatch.setattr(infilling.TokenEnds, "_ends", lambda self, k: scanned.append(k) or whole(self, k))
    assert found.after(150_000) == len(b"some words " * 75_000) - 1
    assert len(scanned) == 1


def fim_rows(df):
    out = df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infilling.restored(F.col("output"), F.col("form")).alias("back"))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def fim_brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


def test_fill_in_middle_equals_definition_and_restores(docs, empty):
    got = fim_rows(infilling.fill_in_middle(docs))
    assert got == sorted((fim_brute(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    found = infilling.fill_in_middle(empty)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and found.count() == 0
    assert {r["form"] for r in infilling.fill_in_middle(docs, share=0).collect()} == {"plain"}
    assert {r["form"] for r in infilling.fill_in_middle(docs.where("text like 'Common%'"), share=100, spm_share=0).collect()} == {"psm"}


# --- line dedup --------------------------------------------------------------------------------------------
def line_key(line):
    return line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate({c: c + 32 for c in range(65, 91)})


def lines_brute(rows, least_docs=10, least_chars=1):
    count = Counter(k for _, t in rows for k in {line_key(x) for x in (t or "").split("\n")} if len(k) >= least_chars)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if count[line_key(x)] < least_docs]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,least_docs,least_chars", [(1, 10, 1), (4, 10, 1), (5, 2, 6)])
def test_line_dedup_equals_brute_force(docs, batches, least_docs, least_chars):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = lines.without_repeated_lines(docs, least_docs, least_chars, batches)
    want = lines_brute(rows, least_docs, least_chars)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sum(r[2] for r in want) > 20 and any(k[2] == 0 for k in want)


def test_line_dedup_of_an_empty_table(empty):
    got = lines.without_repeated_lines(empty)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"] and got.count() == 0


def test_runs_are_levelled_compacted_and_anti_joined(spark):
    def batch(k):
        return spark.createDataFrame([(10 * k + i, f"hot\nwarm {k // 2}\nown {k}-{i}") for i in range(3)], "doc_id long, text string")

    index = lines.LineIndex(spark, min_docs=6, buckets=4)
    sizes = []
    for k in range(6):
        index.add(batch(k))
        sizes.append([len(level) for level in index.levels])
    assert sizes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1], [0, 1, 1]]  # a binary counter
    hot = lines.hashed([b"hot"], 1)[0]
    young = [bytes(r["key"]) for r in index.levels[1][0].collect()]
    assert hot not in young  # settled by the third batch, so later ones left it out
    assert len(young) == 6
    assert {bytes(r["key"]) for r in index.repeated().collect()} == {hot, *(lines.hashed([f"warm {k}".encode()], 1)[0] for k in range(3))}
    assert len(index.settled) <= index.fan
    found = index.strip(batch(5).union(spark.createDataFrame([(99, "HOT \nwarm 0\nnew")], "doc_id long, text string")))
    assert sorted(r["kept"] for r in found.collect()) == ["new", "own 5-0", "own 5-1", "own 5-2"]
    plan = index._merged([index.levels[1][0], index.levels[2][0]])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ridgeline_run")]


def test_heavy_lines_travel_with_tasks_and_light_ones_by_join(docs, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for share in (0.0, 1.0):  # all are heavy, none is
        monkeypatch.setattr(lines, "HEAVY", share)
        assert sorted((tuple(r) for r in lines.without_repeated_lines(docs).collect()), key=repr) == lines_brute(rows)


# --- ball k-means ------------------------------------------------------------------------------------------
def kmeans_brute(rows, k, rounds, dim):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(q) for _, q in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for left in range(rounds, -1, -1):
        at = [min(range(len(centroids)), key=lambda c: (dist(q, centroids[c]), c)) for _, q in kept]
        if left:
            for c in range(len(centroids)):
                own = [q for (_, q), a in zip(kept, at, strict=True) if a == c]
                if own:
                    centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    d = [dist(q, centroids[a]) for (_, q), a in zip(kept, at, strict=True)]
    inertia = Counter()
    for a, x in zip(at, d, strict=True):
        inertia[a] += x
    return sorted(((i, a, x, inertia[a], sum(d), sha(",".join(map(str, centroids[a])))) for (i, _), a, x in zip(kept, at, d, strict=True)), key=repr)


@pytest.mark.parametrize("k,rounds", [(16, 3), (5, 0), (1, 2), (400, 2)])
def test_ball_kmeans_equals_lloyd(spark, k, rounds):
    rng = np.random.default_rng(k)
    middles = rng.normal(0, 1, (6, 4))
    rows = [(int(i), (middles[i % 6] + rng.normal(0, 0.2, 4)).tolist()) for i in range(150)]
    rows += [(3, rows[7][1]), rows[5], rows[5], (None, [0.0] * 4), (None, [1.0, -1.0, 0.015624, -0.015626])]  # repeats, null ids
    rows += [(1000 + i, [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(80)]  # ties
    rows += [(2000, None), (2001, []), (2002, [1.0] * 3), (2003, [float("nan")] * 4), (2004, [float("inf"), 0.0, 0.0, 0.0]), (2005, [None, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], "vec_id long, embedding array<double>, q string, cluster string").repartition(3)
    got = balls.ball_kmeans(df, k=k, rounds=rounds, dim=4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == kmeans_brute(rows, k, rounds, 4)


def test_ball_kmeans_of_no_vectors(spark):
    for rows in ([], [(1, None)]):
        got = balls.ball_kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


def test_huge_components_are_held(spark):
    rows = [(0, [1e308, 0.0]), (1, [-1e30, 0.0]), (2, [float(1 << 60), 5.0]), (3, [0.5, 0.25])]
    got = {r["vec_id"]: r for r in balls.ball_kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, dim=2).collect()}
    assert len(got) == 4 and got[0]["cluster"] == got[2]["cluster"] and got[0]["distance"] >= 0


def test_balls_compare_few_neighbours():
    rng = np.random.default_rng(0)
    middles = rng.integers(-2000, 2000, (64, 16))
    x = middles[rng.integers(0, 64, 20_000)] + rng.integers(-60, 61, (20_000, 16))
    everything = ((x[:, None, :] - middles[None, :, :]) ** 2).sum(axis=2)
    home = everything.argmin(axis=1)
    radii = np.array([np.sqrt(everything[home == i, i].max()) for i in range(64)])
    drifted = middles + rng.integers(-2, 3, middles.shape)
    ball = balls.Balls.of(drifted, radii + np.sqrt(((drifted - middles) ** 2).sum(axis=1)))
    cluster, distance, n = ball.nearest(x, home)
    all_ = ((x[:, None, :] - drifted[None, :, :]) ** 2).sum(axis=2)
    assert (cluster == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()
    assert n < 1.1 * len(x)  # 64 each without balls
    cluster, distance, n = balls.Balls.of(drifted).nearest(x, np.zeros(len(x), int))  # no home known yet
    assert (cluster == all_.argmin(axis=1)).all() and n <= 64 * len(x)


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_fill_in_middle", "op13_ball_kmeans"])
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
