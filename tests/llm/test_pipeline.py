import json
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import queries
from tessella.llm.common import written

import corpus_pipeline

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, small), "stage")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= 2 * before
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r["doc_id"] for r in packed} == ids
    used = {}
    for r in packed:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + len(np.frombuffer(r["ids"], "<u4"))
    assert max(used.values()) <= 2048


def test_clean_documents_pass_the_filters(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    clean = docs.join(labels.where("toxic = 0").select("doc_id"), "doc_id")
    kept = corpus_pipeline.drop_toxic(spark, docs, small).select("doc_id")
    assert clean.join(kept, "doc_id", "left_anti").count() <= 0.02 * clean.count()
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    assert 0.99 * lettered.count() <= corpus_pipeline.keep_known_languages(spark, docs, small).count() <= lettered.count()


def test_documents_in_no_language_or_another_go(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    french = docs.where("lang = 'fr' AND length(text) > 500").limit(3).selectExpr("doc_id + 1000000 AS doc_id", "text", "'en' AS lang")
    strange = spark.createDataFrame([(2000000, "xqz wvx kqj zzk qxw jvq " * 20, "en"), (2000001, "1234 !!", "en"), (2000002, None, "en"), (2000003, "ωρα και το δεν ειναι " * 20, None)], "doc_id long, text string, lang string")
    unsaid = docs.where("lang = 'fr' AND length(text) > 500").limit(2).selectExpr("doc_id + 3000000 AS doc_id", "text", "CAST(null AS string) AS lang")
    left = corpus_pipeline.keep_known_languages(spark, docs.union(french).union(strange).union(unsaid), small)
    assert sorted(r["doc_id"] >= 3000000 for r in left.where("doc_id >= 1000000").collect()) == [True, True]


def test_near_duplicates_from_four_fifths(spark, small):
    """One of two texts of similarity 0.82 goes; both of similarity 0.77 stay."""
    docs = []
    for ident, (both, own) in ((1, (82, 9)), (3, (77, 11.5))):
        shared = [f"s{ident}x{i}" for i in range(both + 4)]
        docs += [(ident + k, " ".join(shared + [f"o{ident + k}x{i}" for i in range(int(own + k / 2))])) for k in (0, 1)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert round(near(1, 2), 2) == 0.82 and round(near(3, 4), 2) == 0.77
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), small)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4]


def test_odd_documents(spark, odd, small):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, small), "stage")
        assert docs.columns == odd.columns
    assert docs.where("doc_id = 11").count() >= 1
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0


def test_the_driver_gives_back_unused_native_memory(spark):
    """Freed blocks of the C library that the last one keeps in place leave the driver's memory with the next table written."""
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    if not status.exists():
        pytest.skip("no /proc here")
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1]) / 1024
    memory = jvm.org.apache.spark.unsafe.Platform
    blocks = [memory.allocateMemory(100_000) for _ in range(1500)]
    for block in blocks:
        memory.setMemory(block, 1, 100_000)
    for block in blocks[:-1]:
        memory.freeMemory(block)
    before = held()
    written(spark.range(1).toDF("id"), "few")
    assert held() < before - 70
    memory.freeMemory(blocks[-1])


def test_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, small)
        cursor = con.execute(sql)
        want = [c[0] for c in cursor.description]
        key = lambda rows: sorted(map(str, rows))
        assert key(tuple(r) for r in df.select(*want).collect()) == key(cursor.fetchall())
        assert sorted(df.columns) == sorted(want)


def test_the_rest_works_without_this_package(tmp_path):
    kept = tmp_path / "repo"
    kept.mkdir()
    for f in ("__spark_entry__.py", "tessella"):
        (kept / f).symlink_to(ROOT / f)
    bare = "import json, __spark_entry__ as e; print(json.dumps(sorted(e.queries())))"
    out = subprocess.run([sys.executable, "-c", bare], cwd=kept, capture_output=True, text=True, check=True, env={"PYTHONPATH": str(kept), "PATH": "/usr/bin:/bin"})
    names = json.loads(out.stdout)
    assert len(names) > 150 and not any(n == "pipeline" or n.startswith("op1_") for n in names)
