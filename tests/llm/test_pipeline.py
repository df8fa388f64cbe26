import sys
from pathlib import Path

import pytest

import corpus_pipeline
from gridevents.llm import catalog
from gridevents.llm.passages import passages
from gridevents.llm.secrets import scan

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
FOLDER = "/root/testdata/sf0.001"


def test_stages_and_their_decisions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id: r.kept for r in catalog.QUERIES["op6_compression_bands"](spark, FOLDER).collect()}
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.written(stage(spark, docs, FOLDER), "test"))
        docs = frames[-1]
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert all(f.columns == columns for f in frames[:-1])
    quality, near, cut, clean, packed = frames
    assert {r.doc_id for r in quality.collect()} == {i for i, k in kept.items() if k}
    classes = {r.doc_id: r.class_id for r in catalog.near_duplicates(quality).collect()}
    assert {r.doc_id for r in near.collect()} == set(classes.values())
    assert passages(cut).count() == 0
    rows = clean.collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    assert not any(kind != "literal" for r in rows for kind, *_ in scan(r.text))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in rows}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, name):
    import duckdb
    from check import canonical
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got, want = canonical(catalog.QUERIES[name](spark, FOLDER).toPandas()), canonical(con.execute(catalog.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in catalog.queries()} == {f"op{n}" for n in range(1, 14)}
