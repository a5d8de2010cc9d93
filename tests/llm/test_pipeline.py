"""The registry of the subpackage, SQL twins, and the pipeline stage by stage."""

from __future__ import annotations

import collections
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from trafficward.llm import packing, quality, queries
from trafficward.llm.common import stored

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def test_registered():
    names = driver.queries()
    assert [n for n in range(1, 11) if any(k.startswith(f"op{n}_") for k in names)] == list(range(1, 11))
    assert "pipeline" in names and set(queries.SQL) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twins(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations", "labels", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    df = queries.QUERIES[name](spark, FOLDER)
    answer = db.execute(queries.SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, answer.fetchall())) == sorted(map(repr, (tuple(r) for r in df.select(*names).collect())))


def shingles(text: str) -> set:
    words = text.translate(LOWER).split()
    return set(zip(*[words[i:] for i in range(5)]))


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stored(stages["quality rules"](spark, docs, FOLDER), "t")
    ratio = quality.fit_ratio(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    judged = {r.doc_id for r in quality.judged(docs, ratio).where("kept").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == judged

    single = stored(stages["SimHash near-dedup"](spark, good, FOLDER), "t")
    rows = sorted((r.doc_id, shingles(r.text)) for r in good.collect())
    left = {r.doc_id for r in single.collect()}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    close = collections.Counter()
    for k, (i, a) in enumerate(rows):
        for j, b in rows[k + 1 :]:
            likeness = len(a & b) / max(1, len(a | b))
            if likeness >= 0.83:
                parent[max(find(i), find(j))] = min(find(i), find(j))
            if likeness >= 0.7:
                close[i] += 1
                close[j] += 1
    groups = collections.defaultdict(list)
    for i, _ in rows:
        groups[find(i)].append(i)
    assert all(len(left & set(g)) <= 1 for g in groups.values())
    assert all(i in left for i, _ in rows if not close[i])

    short = stored(stages["substring dedup"](spark, single, FOLDER), "t")
    texts = {r.doc_id: r.text for r in single.collect()}
    split = re.compile(r"[^\x20\x09-\x0D]+").findall
    seen = collections.Counter(tuple(w[i : i + 35]) for w in map(split, texts.values()) for i in range(len(w) - 34))
    for r in short.collect():
        w = split(texts[r.doc_id])
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert r.text == (" ".join(x for j, x in enumerate(w) if j not in gone) if gone else texts[r.doc_id])
        assert r.n_chars == len(r.text)

    placed = stages["best-fit packing"](spark, short, FOLDER)
    assert {r.doc_id for r in placed.collect()} == {r.doc_id for r in short.collect()}
    assert placed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    assert packing.packed_documents(short).count() == placed.count()


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.count() > 0 and "sequence_id" in rows.columns
