import corpus_pipeline
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ridgeline.llm import language, mixing, pii, simhash
from ridgeline.llm.common import row_hashes
from ridgeline.llm.queries import QUERIES


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "PII", "mixing", "SentencePiece"]
    known = corpus_pipeline.known_language(spark, docs.union(docs.limit(1).withColumn("text", F.lit("123 ..."))), sf)
    assert known.columns == docs.columns and known.where("text = '123 ...'").count() == 0
    assert known.count() >= 0.97 * docs.count()
    kept = corpus_pipeline.distinct_documents(spark, known, sf)
    assert kept.columns == docs.columns
    groups = simhash.near_duplicates(known)
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in groups.select("component_id").distinct().collect()}
    clean = corpus_pipeline.without_personal_data(spark, kept, sf)
    assert clean.columns == docs.columns and clean.count() == kept.count()
    changed = {r["doc_id"] for r in pii.pseudonyms(kept, pii.session_key(spark)).where("n_found > 0").collect()}
    assert {r["doc_id"] for r in clean.join(kept.withColumnRenamed("text", "old"), "doc_id").where("text <> old").collect()} == changed
    assert clean.where("n_chars <> length(text)").count() == 0
    out = corpus_pipeline.mixed(spark, clean, sf)
    copies = mixing.mix_copies(clean, key=F.struct(*row_hashes(clean)))
    assert out.columns == docs.columns and out.count() == copies.agg(F.sum("copies")).first()[0]
    last = corpus_pipeline.encoded(spark, out, sf)
    assert last.count() == out.count()


def test_run_and_queries(spark, sf):
    n = corpus_pipeline.run(spark, sf).count()
    assert n > 0
    for name in ("op5_language", "op8_toxicity", "op7_pseudonyms"):
        assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert language.UNKNOWN == "und"


def test_distinct_documents_of_null_and_repeated_ids(spark, sf):
    def text(k: int) -> str:
        return " ".join(f"{chr(97 + (k * 7 + j * j) % 26)}{k * 31 + j}" for j in range(40))

    near = [(3, text(0)), (5, text(0)), (5, text(1)), (5, text(2)), (5, text(2)), (7, text(2)), (None, text(2)), (None, text(3)), (None, text(4)), (None, text(4)), (9, text(5)), (9, text(6))]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in near], "doc_id long, text string, lang string, source string, n_chars int")
    kept = corpus_pipeline.distinct_documents(spark, docs.repartition(3), sf)
    assert kept.columns == docs.columns
    want = [(3, text(0)), (5, text(1)), (5, text(2)), (None, text(3)), (None, text(4)), (9, text(5)), (9, text(6))]
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=str) == sorted(want, key=str)


def odd(spark):
    """Null and repeated ids, null, empty and long texts, repeated rows, and extra columns of awkward names."""
    rows = [(i, t, lang, s, n) for k, (i, t) in enumerate([
        (None, "the first of the texts that are here and not there"), (None, "another text of quite other words for it"), (7, "some words on this"), (7, "that is not what it was, but what it is"),
        (1, None), (None, None), (2, ""), (3, "12 34 ..."), (4, "write to jo.doe@mail.example.org or the other one"), (4, "write to jo.doe@mail.example.org or the other one"), (5, "la maison est dans la rue " * 9000),
    ]) for lang, s, n in [(("en", "fr", None)[k % 3], ("a", None)[k % 2], None if k == 4 else 3)]]
    names = ["first", "a.b", "row", "id", "h1", "key", "c0", "lang_pred", "times", "new", "`q`"]
    kinds = [("doc_id", LongType()), *((n, StringType()) for n in ("text", "lang", "source")), ("n_chars", LongType()), *((n, StringType()) for n in names)]
    return spark.createDataFrame([(*r, *[f"x{k}" for k in range(len(names))]) for r in rows], StructType([StructField(n, t) for n, t in kinds]))


def test_stages_take_odd_rows_and_columns(spark, sf, tmp_path):
    docs = odd(spark)
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some.repartition(3), sf)
            out.write.parquet(str(tmp_path / f"{name}-{some is docs}"))
            if name != "SentencePiece":
                assert out.columns == docs.columns, name
    read = lambda name: spark.read.parquet(str(tmp_path / f"{name}-True"))
    source = sorted(map(repr, docs.collect()))
    known = sorted(map(repr, read("language ID").collect()))
    assert set(known) <= set(source) and all(r["text"] and any(map(str.isalpha, r["text"])) for r in read("language ID").collect())
    kept = read("SimHash near-dedup").collect()  # 4 twice, null and empty texts of one fingerprint
    assert len(kept) == 8 and {r["doc_id"] for r in kept} == {None, 7, 1, 3, 4, 5}
    clean = read("PII").collect()
    assert len(clean) == docs.count() and sum(r["text"] is None for r in clean) == 2 and not any("jo.doe" in (r["text"] or "") for r in clean)
    assert all(r["n_chars"] == len(r["text"]) for r in clean if r["text"] is not None)
    mixed = read("mixing").collect()
    assert mixed and set(map(repr, mixed)) <= set(source)
    assert read("SentencePiece").count() == docs.count()
    assert read("SentencePiece").where("n_tokens = 0").count() == 3


def test_stages_take_map_columns(spark, sf):
    odd_maps = spark.range(40).selectExpr("id AS doc_id", "concat('some words on topic ', id % 20, ' and more words of it ', id % 20) AS text", "'en' AS lang", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS source", "0L AS n_chars", "CASE WHEN id % 4 > 0 THEN map('k', array(map(id % 2, 1)), 'j', null) END AS m", "named_struct('x', map(1, 2), 'y', null) AS s", "parse_json('{\"a\": 1}') AS v")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_maps, sf)
        assert out.count() > 0, name
    h = odd_maps.select(*row_hashes(odd_maps.select("m", "s", "v"))).distinct().count()
    assert h == 3  # null, and maps of two kinds


def test_runs_without_a_key_agree(spark, sf):
    assert spark.conf.get("spark.ridgeline.pii.key", None) is None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = []
    for parts in (2, 5):
        own = docs.repartition(parts)
        clean = corpus_pipeline.without_personal_data(spark, own, sf)
        found.append(sorted(map(repr, corpus_pipeline.mixed(spark, clean, sf).collect())))
    assert found[0] == found[1]
    other = pii.corpus_key(docs.where("doc_id > 0"))
    assert pii.corpus_key(docs) == pii.corpus_key(docs.repartition(7)) != other and len(pii.corpus_key(docs.limit(0))) == 32


def test_run_leaves_one_stage_table(spark, sf):
    import os

    from ridgeline.llm.common import shared_dir

    corpus_pipeline.run(spark, sf).count()
    root = shared_dir(spark).removeprefix("file:")
    newest = max((os.path.join(root, x) for x in os.listdir(root) if x.startswith("pipeline-")), key=os.path.getmtime)
    assert len(os.listdir(newest)) == 1
