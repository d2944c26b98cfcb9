import importlib
import zlib

import duckdb
import pytest
import xxhash

import corpus_pipeline
from cloakline.llm import sql
from cloakline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_filter_and_pack(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        n = docs.count()
        assert docs.columns == columns and 0 < n <= before and docs.select("doc_id").distinct().count() == n, name
        before = n
    kept = {r.doc_id for r in docs.collect()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == kept
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


@pytest.mark.parametrize("name", ["op2_packing", "op9_token_files"])
def test_digests(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and all(0 <= r.ids_crc32 < 2**32 for r in rows)


def test_registered():
    assert [int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")] == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "packing"]
    entry = importlib.import_module("__spark_entry__")
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


def test_stages_take_edge_rows(spark, documents, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, documents, str(tmp_path))
        assert name == "packing" or got.columns == documents.columns
        assert got.count() >= 0
        assert stage(spark, documents.limit(0), str(tmp_path)).count() == 0


CLASHING = {c: "'own'" for c in ("odds", "n_grams", "log_weight", "gumbel_key", "matches", "_row", "_own", "own", "_noise", "_text", "_good", "_spread", "_rank", "node", "root", "first", "place", "keys", "key", "lang_pred", "score", "_own_score", "fp", "salt", "kept", "ids", "sequence_id", "length")}


def test_stages_keep_clashing_columns(spark, documents, tmp_path):
    """Every stage but the last returns the columns it is given, with their values."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    held = documents.drop(*CLASHING).withColumn("tags", documents.h * 2).selectExpr("*", *(f"{v} as `{c}`" for c, v in CLASHING.items()), "map('a', 1) as `a.b`")
    docs = held.union(spark.read.parquet(f"{SF}/documents.parquet").limit(60).selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars", *(f"cast(null as {t}) as `{c}`" for c, t in held.dtypes[5:])))
    assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.schema(docs.schema).parquet(f"{tmp_path}/docs")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert got.count() > 0
        else:
            assert got.columns == docs.columns and got.dtypes == docs.dtypes, name
            rows = got.filter("doc_id < 1000 or doc_id is null").collect()
            assert rows and all(r[c] == "own" for r in rows for c in CLASHING) and all(r["a.b"] == {"a": 1} for r in rows), name


def test_crc_is_unsigned_and_little_endian():
    assert zlib.crc32((1).to_bytes(4, "little")) == 0x99F8B879


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    assert expected and sorted(map(tuple, df.collect())) == sorted(expected)


def test_xxh64_in_sql():
    texts = ["", *("é漢ab " * 20)[:90]] + [("é漢ab c" * 20)[:n] for n in range(1, 110)]
    con = duckdb.connect()
    con.execute("CREATE TABLE given AS SELECT DISTINCT unnest(?) AS s", [texts])
    got = dict(con.execute(f"WITH RECURSIVE texts AS (SELECT s FROM given), {sql.xxh64_steps()} SELECT s, h FROM hashes").fetchall())
    assert got == {t: xxhash.xxh64_intdigest(t, seed=sql.SEED) for t in texts}
