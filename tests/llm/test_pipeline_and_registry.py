import pytest

import corpus_pipeline
from barquet.llm import jaccard, lines, mixing, queries, toxicity
from barquet.llm.common import settle

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {"documents": docs}
    last = docs
    for name, stage in corpus_pipeline.STAGES:
        last = settle(stage(spark, last, SF), "test")
        held[name] = last
        if name != "packing":
            assert last.columns == docs.columns
    ids = {k: [r["doc_id"] for r in v.select("doc_id").collect()] for k, v in held.items()}
    assert set(ids["toxicity"]) <= set(ids["documents"]) and set(ids["lines"]) <= set(ids["toxicity"])
    assert set(ids["near_duplicates"]) <= set(ids["lines"]) and set(ids["mixing"]) <= set(ids["near_duplicates"])
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = toxicity.score(docs, model).filter(f"score < {toxicity.THRESHOLD}")
    assert sorted(ids["toxicity"]) == sorted(r["doc_id"] for r in clean.collect())
    emptied = lines.dedup_counts(held["toxicity"]).filter("n_lines > 0 AND n_lines = n_removed").count()
    assert len(ids["lines"]) == len(ids["toxicity"]) - emptied
    groups = jaccard.group_documents(held["lines"]).collect()
    assert sorted(ids["near_duplicates"]) == sorted(r["doc_id"] for r in groups if r["component_id"] == r["doc_id"])
    copies = sum(r["copies"] for r in mixing.mixing_plan(held["near_duplicates"]).collect())
    assert len(ids["mixing"]) == copies
    assert held["packing"].groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0
    assert set(ids["packing"]) == set(ids["mixing"])


def test_run_is_the_stages_in_order(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "lines", "near_duplicates", "mixing", "packing"]


def test_a_query_is_registered_for_each_operator():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert queries.QUERIES.keys() <= names.keys()


@pytest.mark.parametrize("name", ["op6_source_mixing", "op7_mtree_topk", "op8_line_dedup", "op10_chat_formatting", "op11_prefix_trie", "op13_centroid_clustering"])
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from barquet.llm.oracles import ORACLES
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = list(want.columns)
    assert want.sort_values(key).reset_index(drop=True).equals(got.sort_values(key).reset_index(drop=True).astype(want.dtypes))
