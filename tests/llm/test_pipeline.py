"""The pipeline keeps what its stages keep, and loses no clean document."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import fitted, odd, plain_posteriors

import corpus_pipeline
from tallybook.llm import mixing, queries
from tallybook.llm.common import table, written


def test_stages(spark, data):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"create view {name} as select * from '{data}/{name}.parquet'")
    first = docs = table(spark, data, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, data), "stage")
        kept.append((name, docs))
        assert docs.columns == first.columns + (["shard"] if name == "sharding" else [])
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for _, df in kept]
    assert ids[0] == {r[0] for r in duck.sql(f"select doc_id from ({queries.ORACLE['op2_quality_rules']}) where kept").fetchall()}

    duck.sql("create table survivors as select * from documents where doc_id in (select unnest($1))", params=[sorted(ids[0])])
    alone = queries.ORACLE["op1_ngram_jaccard_join"].replace("from documents", "from survivors")
    assert ids[1] == {r[0] for r in duck.sql(f"select doc_id from ({alone}) where doc_id = component_id").fetchall()}
    found = duck.sql(f"select distinct doc_id from ({queries.ORACLE['op10_benchmark_decontamination']})").fetchall()
    assert ids[2] == ids[1] - {r[0] for r in found}
    assert ids[3] <= ids[2] and ids[4] == ids[3]

    # The mixture by a plain classifier and plain steps, over what the stages before it have kept.
    rows = [(r.doc_id, r.text) for r in kept[2][1].collect()]
    labels = [tuple(r) for r in table(spark, data, "labels").select("doc_id", "quality", "toxic").collect()]
    domains = sorted(queries.DOMAIN_WEIGHTS)
    scored = plain_posteriors(rows, labels, domains)
    tokens, p = np.array([scored[i][0] for i, _ in rows], float), np.array([scored[i][1] for i, _ in rows])
    own = p[:, domains.index("good")]
    shares = np.array([queries.DOMAIN_WEIGHTS[d] for d in domains])
    rates, _ = fitted(tokens, p, (tokens * own).sum() / queries.DOMAIN_WEIGHTS["good"] * shares, 1.0, own == p.max(1))
    sizes = spark.createDataFrame([(i, scored[i][0]) for i, _ in rows], "doc_id long, tokens long")
    drawn = {r.doc_id: r.u for r in sizes.select("doc_id", mixing.uniform("doc_id", "tokens").alias("u")).collect()}
    close = {i for (i, _), rate in zip(rows, rates, strict=True) if abs(drawn[i] - rate) < 1e-5}
    assert ids[3] - close == {i for (i, _), rate in zip(rows, rates, strict=True) if drawn[i] < rate} - close and len(close) < 5
    clean = {i for i, quality, toxic in labels if quality == 1 and toxic == 0} & ids[2]
    toxic = {i for i, _, toxic in labels if toxic == 1} & ids[2]
    assert clean <= ids[3] and len(clean) > 50 and len(toxic & ids[3]) < len(toxic)
    shards = {r.doc_id: r.shard for r in kept[4][1].collect()}
    plain = {r.doc_id: r.shard for r in queries.QUERIES["op7_sharding"](spark, data).collect()}
    assert all(plain[k] == s for k, s in shards.items())


TEXTS = [" ".join(f"word{(i * 7 + j * j) % 97}" for j in range(40 + i)) for i in range(12)]
CLASHES = {"shard": 1, "kept": "x", "hub": 2, "tokens": 3, "p": "y", "hits": "z", "row": 0, "digest": "d", "size": 5}


def folder(spark, path, rows, data):
    """A folder of tables whose documents are the rows, with columns that the stages use themselves."""
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({name: F.lit(value) for name, value in CLASHES.items()}).write.parquet(f"{path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("rows", [odd(TEXTS), []], ids=["odd", "none"])
def test_stages_take_any_rows(spark, data, tmp_path, rows):
    """Nulls, blank, very long and repeated rows, clashing names, and no rows at all."""
    target = folder(spark, tmp_path, rows, data)
    docs = first = table(spark, target, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, target), "stage")
        assert docs.columns == first.columns, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, target)
    assert sorted(last.columns) == sorted(first.columns) and last.count() == docs.count()
    texts = [r[1] for r in rows]
    # Every text that is left is a whole one of the input; only rows without an id leave a text twice.
    left = [r.text for r in docs.collect()]
    named = [r.text for r in docs.where("doc_id is not null").collect()]
    assert set(left) <= set(texts) and len(named) == len(set(named))
