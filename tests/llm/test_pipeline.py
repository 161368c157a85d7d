"""Every stage on its own input, and the SQL of the queries that have one."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline as cp
from agonix.llm.common import stored, table
from agonix.llm.line_dedup import line_key
from agonix.llm.near_dedup import near_duplicates
from agonix.llm.queries import ORACLES, QUERIES


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        out = stored(stage(spark, docs, sf), name)
        assert out.columns == columns and 0 < out.count() <= docs.count(), name
        docs = out
        if name == "line_dedup":
            seen = {}
            for r in docs.collect():
                for x in {line_key(x) for x in (r.text or "").split("\n") if len(line_key(x)) >= 40}:
                    seen.setdefault(x, set()).add(r.doc_id)
                assert r.n_chars == len(r.text)
            assert max(map(len, seen.values())) < 5
        if name == "near_dedup":
            assert near_duplicates(docs, words=5).where("not kept").count() == 0
    packed = cp.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    plain = lambda x: "null" if pd.isna(x) else str(int(x)) if isinstance(x, float) else str(x)
    key = lambda df: sorted([plain(x) for x in r] for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
    assert sorted(ours.columns) == sorted(theirs.columns) and key(ours) == key(theirs)


def odd_documents(spark):
    """Nulls, empties, repeats and columns that share names with what the stages add."""
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long), (2, long + " more"), (3, long), (3, long), (4, None), (5, ""), (6, " \n "), (None, "alone"), (None, None), (7, "the key is password: hunter2hunter2"), (8, "x " * 40)]
    rows = [(d, t, None if d == 4 else "en", "s", None if t is None else len(t), "mine", 1, True, 0.5, "k", 3) for d, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Spans string, Kept int, gone boolean, toxicity double, `word` string, Sequence_id int").repartition(3)


def test_stages_on_odd_documents(spark, sf):
    docs = odd_documents(spark)
    columns, expect = docs.columns, {None, 1, 4, 5, 6, 7, 8}
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == columns, name
    rows = docs.collect()
    assert {r.doc_id for r in rows} == expect and all(r.Spans == "mine" and r.Kept == 1 for r in rows)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[4].text is None and by[5].text == "" and by[7].text == "the key is [secret]" and by[7].n_chars == len(by[7].text)
    packed = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == expect and all(0 < r.length <= 4096 for r in packed)


def test_stages_on_nothing(spark, sf):
    docs = odd_documents(spark).limit(0)
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.count() == 0, name
