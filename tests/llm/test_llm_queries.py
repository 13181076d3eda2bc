"""The registered queries against their SQL, and the pipeline against its stages by brute force."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskweave.llm import queries, toxicity
from riskweave.llm._spark import read

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
    assert sorted(names) == cols and got == want


def test_each_operator_has_a_query():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.queries()) == list(range(1, 11))


def test_pipeline_stages(spark):
    docs = read(spark, SF, "documents")
    one, two, three, four, five = (f for _, f in corpus_pipeline.STAGES)
    a = one(spark, docs, SF).cache()
    bad = toxicity.score(docs, read(spark, SF, "labels")).where("rejected").select("doc_id")
    assert a.columns == docs.columns and sorted(r[0] for r in a.select("doc_id").collect()) == sorted(r[0] for r in docs.join(bad, "doc_id", "left_anti").select("doc_id").collect())
    b = two(spark, a, SF).cache()
    words = {r.doc_id: r.w for r in a.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[0-9a-z\x{80}-\x{10FFFF}]+"), F.lit(0)).alias("w")).collect()}
    sets = {d: {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} for d, w in words.items() if w}
    parent = {d: d for d in words}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            if 2 * len(sets[x] & sets[y]) >= len(sets[x] | sets[y]):
                p, q = sorted((root(x), root(y)))
                parent[q] = p
    assert sorted(r[0] for r in b.select("doc_id").collect()) == sorted({root(d) for d in words})
    c = three(spark, b, SF).cache()
    assert c.columns == docs.columns and c.count() == b.count()
    grams = {}
    for r in c.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[0-9a-z\x{80}-\x{10FFFF}]+"), F.lit(0)).alias("w")).collect():
        before = set(tuple(words[r.doc_id][i : i + 50]) for i in range(len(words[r.doc_id]) - 49))
        for g in {tuple(r.w[i : i + 50]) for i in range(len(r.w) - 49)} & before:
            grams.setdefault(g, []).append(r.doc_id)
    assert all(len(v) == 1 for v in grams.values())
    d = four(spark, c, SF).cache()
    assert d.columns == docs.columns and d.count() > 0
    e = five(spark, d, SF)
    assert e.count() > 0 and e.groupBy("shard", "class", "round", "bin").agg(F.sum("n_tokens").alias("n")).where("n > 2048").count() == 0
    n = lambda x: x.agg(F.sum(F.regexp_count("text", F.lit("[^ \\t\\r\\n]+")))).first()[0]
    assert n(d) == n(e)


def test_pipeline_runs(spark):
    """``run`` gives what its stages give one after the other, also on awkward rows and an empty table."""
    whole = corpus_pipeline.run(spark, SF)
    docs = read(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    cols = [c for c in docs.columns if c != "text"]
    assert sorted(map(str, whole.select(*cols).collect())) == sorted(map(str, docs.select(*cols).collect()))


def test_stages_on_awkward_and_empty_tables(spark):
    data = [(1, "a b c " * 30, "en", "src0", 1), (1, "a b c " * 30, "en", "src0", 1), (None, None, None, None, None), (None, "x y z", None, "src99", 5), (3, "", "fr", "src1", 0), (4, " ".join(f"w{i}" for i in range(5000)), "de", "src0", 9)]
    awkward = spark.createDataFrame([(*r, "clash", 7) for r in data], "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, _sig int")
    for docs in (awkward, awkward.limit(0)):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF).cache()
            assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        rest = docs.count()
    assert rest == 0
