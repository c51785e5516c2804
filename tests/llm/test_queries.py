"""Registered queries and the pipeline on the supplied tables."""

import brute
import pytest
from twin import compare, duck

import __spark_entry__ as entry
import corpus_pipeline
from presage.llm import language
from presage.session import table
from test_similar_texts import grouped

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def read(spark, query):
    return QUERIES[query](spark, SF).collect()


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect())


@pytest.mark.parametrize("name", ["op6_warc_revisits", "op10_exact_dedup"])
def test_twin(spark, name):
    assert compare(spark, duck(SF), SF, QUERIES[name], SQL[name]) is None


def test_plain_python(spark, docs):
    brute.check_pieces(docs, [r.asDict() for r in read(spark, "op1_cost_balanced_packing")])
    prints = [brute.simhash(t) for _, t in docs]
    assert sorted(map(tuple, read(spark, "op2_simhash_near_dedup"))) == sorted(zip([d for d, _ in docs], ["%016x" % p for p in prints], brute.linked([d for d, _ in docs], prints)))
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    assert sorted(map(tuple, read(spark, "op5_benchmark_decontamination"))) == sorted(brute.contaminated(docs, items))
    assert sorted(map(tuple, read(spark, "op7_substring_dedup"))) == sorted(brute.substrings(docs))


def test_language_held_out(spark):
    told = {r["doc_id"]: r for r in read(spark, "op8_language_id")}
    real = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    out = [d for d in told if told[d]["held_out"]]
    assert sum(told[d]["lang_pred"] == real[d] for d in out) >= 0.95 * len(out) > 0


def test_others_have_a_row_each(spark):
    assert len(read(spark, "op4_token_counts")) == table(spark, SF, "documents").count()
    assert len(read(spark, "op9_html_extraction")) == table(spark, SF, "pages").count()
    assert len(read(spark, "op3_chat_formatting")) == table(spark, SF, "conversations").select("conv_id").distinct().count() + 1


def test_pipeline(spark, docs):
    """Stages one after the other, by plain Python, against run()."""
    left = docs
    model = language.train(table(spark, SF, "documents").filter(~language.held_out()))
    left = [(d, t) for d, t in left if model.predict([t])[0][0] != "und"]
    left = [(d, t) for (d, t), x in zip(left, brute.exact(left)) if x[3]]
    first = grouped(left)
    left = [(d, t) for d, t in left if first[d] == d]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    left = [(d, t) for (d, t), x in zip(left, brute.contaminated(left, items)) if not x[5]]
    from pyspark.sql import functions as F

    pieces = [r.asDict() for r in corpus_pipeline.run(spark, SF).withColumn("ids_crc32", F.crc32("ids")).collect()]
    brute.check_pieces(left, pieces)


def test_stages_keep_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
