"""The registered queries against their SQL, and the pipeline against plain stages."""

import collections
import os
import random

import duckdb
import pytest

import corpus_pipeline
from loomframe.llm import decontam, jaccard, linedup, quality
from loomframe.llm.queries import queries
from loomframe.llm.sql import oracle_sql
from loomframe.tables import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert collections.Counter(tuple(r[c] for c in columns) for r in df.collect()) == collections.Counter(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())


def test_held_out_languages(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = [r for r in queries()["op3_language_id"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in rows) >= 0.98 * len(rows)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = {r.doc_id for r in quality.quality_rules(docs).collect() if r.kept}
    one = corpus_pipeline.quality_stage(spark, docs, SF).cache()
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept
    two = corpus_pipeline.line_stage(spark, one, SF).cache()
    lines = {r.doc_id: r for r in linedup.dedup_lines(one).collect()}
    left = {i: r.text for i, r in lines.items() if r["__n_dropped"] == 0 or r.text.split()}
    assert two.columns == docs.columns and {r.doc_id: r.text for r in two.collect()} == left and len(left) < len(lines)
    assert all(r.n_chars == len(r.text) for r in two.collect())
    three = corpus_pipeline.near_duplicate_stage(spark, two, SF).cache()
    assert {r.doc_id for r in three.collect()} == {r.component_id for r in jaccard.jaccard_join(two).documents.collect()}
    four = corpus_pipeline.decontamination_stage(spark, three, SF).cache()
    bad = {r.doc_id for r in decontam.contaminated(three, bench).collect()}
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect()} - bad
    five = corpus_pipeline.packing_stage(spark, four, SF)
    got, want = five.collect(), corpus_pipeline.run(spark, SF).collect()
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(got) == key(want) and {r.doc_id for r in got} == {r.doc_id for r in four.collect()}


def test_pipeline_catches_planted_cases(spark, tmp_path):
    """Exact copies, near copies and frequent lines, from documents to sequences."""
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = [(i, f"{words(60)}\n{words(40)}") for i in range(200)]  # clean
    rows += [(300 + i, rows[i][1]) for i in range(20)]  # exact copies
    near = [words(150) for _ in range(10)]
    for i, text in enumerate(near):  # near copies, each one line
        for j in range(4):
            changed = text.split()
            for _ in range(j):
                changed[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            rows.append((400 + 10 * i + j, " ".join(changed)))
    notice = words(60)  # a line of over 50 words in many documents
    rows += [(600 + i, f"{words(30)}\n{notice}\n{words(20)}") for i in range(40)]
    rows += [(700 + i, f"{notice}\n{words(3)} n{i}") for i in range(10)]  # little else
    item = words(30)
    rows += [(800 + i, f"{words(20)} {item} {words(20)}") for i in range(5)]
    full = [(i, t, "en", "s", len(t)) for i, t in rows] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        out[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(range(200)) | set(range(600, 640))
    assert set(out["quality_rules"]) == {r[0] for r in rows} - set(range(700, 710))
    assert all(notice not in r.text and r.n_chars == len(r.text) for r in out["quality_rules"].values())
    assert set(out["line_dedup"]) == set(out["quality_rules"]) - set(range(300, 320))
    assert set(out["jaccard_join"]) == clean | set(range(400, 500, 10)) | set(range(800, 805))
    assert set(out["decontamination"]) == set(out["best_fit_packing"]) == clean | set(range(400, 500, 10))
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == clean | set(range(400, 500, 10))


def test_pipeline_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (1, "a b c d e f g h i j k", None, None, None), (None, "a b c d e f g h i j l", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows, want in ((docs, [(1, 11), (None, 11)]), (docs.where("false"), [])):
        out = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == docs.columns, name
        assert sorted(((r.doc_id, len(r.text.split())) for r in out.collect()), key=str) == want
        assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, out, SF).collect()} == {i for i, _ in want}
