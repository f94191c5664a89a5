"""The pipeline as a whole against a plain calculation of its stages."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_text import brute_components, brute_spans, brute_terms, expected_digest, reference  # noqa: F401

import corpus_pipeline
from headcount.llm import minhash, mixing, pii, quality, shared


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_result_equals_the_stages_by_hand(spark, sf_dir, documents, reference):  # noqa: F811
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["id"] for r in quality.judge(documents, labels).where("kept").collect()}
    assert len(good) < len(texts)
    texts = {i: t for i, t in texts.items() if i in good}
    texts = {i: texts[i] for i, (_, first) in brute_components(texts, 80).items() if first == i}
    assert len(texts) < len(good)
    terms = brute_terms(texts, pii.THRESHOLD, pii.CONTEXTS)
    clean = {i: pii.replaced(t, brute_spans(t) + [("term", a, b) for a, b in terms[i]]) for i, t in texts.items()}
    assert clean != texts
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {i: expected_digest(reference, t) for i, t in clean.items()}


def test_stages_return_the_columns_of_documents(spark, sf_dir, documents):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, sf_dir).schema.names == documents.schema.names


def test_mixed_documents_are_written_in_order(spark, sf_dir, documents, tmp_path):
    corpus_pipeline.source_mixing(spark, documents, sf_dir).write.parquet(str(tmp_path / "mixed"))
    files = sorted(p for p in (tmp_path / "mixed").iterdir() if p.suffix == ".parquet")
    got = [r["doc_id"] for f in files for r in spark.read.parquet(str(f)).collect()]
    turns = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix(documents).collect()}
    assert got == sorted(turns, key=turns.get)


def test_empty_documents_and_odd_rows(spark, sf_dir, documents):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], documents.schema)
    for rows, n in ((documents.limit(0), 0), (odd.withColumn("extra", F.lit(1)), 3)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, sf_dir)
            assert rows.count() <= n, name


def test_positions_of_the_result_are_the_mixed_order(spark, sf_dir, documents):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "position").collect()
        kept = documents
        for _, stage in corpus_pipeline.STAGES[:3]:
            kept = stage(spark, kept, sf_dir)
        turns = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix(kept).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["position"])] == sorted(turns, key=turns.get)
    assert sorted(r["position"] for r in got) == list(range(len(turns)))


def test_positions_follow_the_names_of_files_not_their_sizes(spark, tmp_path):
    rows = spark.range(0, 900, 1, 1).selectExpr("id AS doc_id", "repeat('x', CAST(id AS INT)) AS text")
    rows.repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "rows"))
    read = spark.read.parquet(str(tmp_path / "rows"))
    assert [tuple(r) for r in corpus_pipeline.positions(read).select("doc_id", "position").orderBy("doc_id").collect()] == [(i, i) for i in range(900)]
    alone = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [tuple(r) for r in corpus_pipeline.tokens(spark, alone, "").select("doc_id", "position").collect()] == [(1, None)]


def test_mixing_ranks_the_rows_once(spark, documents, capsys):
    mixing.in_order(documents).explain()
    plan = capsys.readouterr().out
    # A range partitioner would read its input, whole texts, once more to find the ranges.
    assert "Sort" in plan and "rangepartitioning" not in plan


def test_mixed_order_with_sources_of_any_size(spark, tmp_path):
    rows = [(i, "text", "en", "large" if i < 3000 else None if i < 3050 else f"s{i}", 4) for i in range(3300)] + [(None, None, None, "large", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    corpus_pipeline.source_mixing(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    files = sorted(p for p in (tmp_path / "mixed").iterdir() if p.suffix == ".parquet")
    sizes = [spark.read.parquet(str(f)).count() for f in files]
    got = [r["doc_id"] for f in files for r in spark.read.parquet(str(f)).collect()]
    turns = sorted((r["slot"], r["place"], r["doc_id"]) for r in mixing.mix(docs).collect())
    assert got == [i for _, _, i in turns]
    assert len(files) > 1 and max(sizes) < 2 * len(rows) / len(files)


#: A task that frees texts between small pieces that stay.
TASK = """
import re, sys
sys.path.insert(0, {root!r})
import pyarrow as pa
from headcount.llm import shared
def held():
    return int(re.search(r"Anonymous: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
def run(batches):
    for batch in batches:
        texts = batch.column(0).to_pylist()
        pieces = []
        for t in texts:
            pieces.append(t + "!")
            kept.append(bytes(700))
        yield batch.slice(0, len(pieces) and 1)
kept = []
run = {wrap}(run)
batch = pa.RecordBatch.from_pydict({{"text": [str(i) * 20_000 for i in range(1000, 2000)]}})
before = held()
rows = sum(b.num_rows for b in run(iter([batch])))
print(rows, held() - before)
"""


def test_a_task_gives_its_memory_back():
    if not Path("/proc/self/smaps_rollup").exists():
        pytest.skip("memory can't be read here")
    for wrap, ok in (("shared.lean", lambda mb: mb < 30), ("", lambda mb: mb > 60)):
        code = TASK.format(root=str(Path(__file__).resolve().parents[2]), wrap=wrap)
        rows, mb = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
        assert rows == "1" and ok(float(mb)), (wrap, mb)


def test_texts_reach_python_few_at_a_time():
    batches = [pa.RecordBatch.from_pydict({"id": list(range(n)), "text": ["a b"] * n}) for n in (0, 2500)]
    assert [(b.num_rows, b.column(0)[0].as_py()) for b in shared.slices(iter(batches))] == [(1024, 0), (1024, 1024), (452, 2048)]
    sketches = list(minhash._sketches(minhash.scheme(80))(iter(batches)))
    assert [b.num_rows for b in sketches] == [1024, 1024, 452]
