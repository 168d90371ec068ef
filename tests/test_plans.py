"""Plans: what reaches the scans, and what isn't in them."""

import io
from contextlib import redirect_stdout

from brindle.operators import keyword
from brindle.queries.all import QUERIES
from brindle.sources.corpus import Corpus

DATA = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_only_needed_columns_are_read(spark):
    text = plan(QUERIES["filter_type_in"](spark, DATA))
    assert "ReadSchema: struct<id:bigint,path:string,ext:string>" in text and "Exchange" not in text


def test_a_search_reads_its_words_buckets_alone(spark):
    text = plan(keyword.postings_of_words(Corpus(spark, DATA), ["license"]).select("doc_id", "tf"))
    assert "PartitionFilters: [isnotnull(b" in text and "EqualTo(term,license)" in text and "documents.parquet" not in text
    assert "documents.parquet" not in plan(QUERIES["bm25_top"](spark, DATA))


def test_filters_reach_the_scan(spark):
    pages = Corpus(spark, DATA).table("embeddings").filter("label = 1").select("vec_id")
    text = plan(pages)
    assert "EqualTo(label,1)" in text and "ReadSchema: struct<vec_id:bigint,label:int>" in text


def test_row_functions_stay_in_the_jvm(spark):
    for name in ("bm25_top", "dup_groups", "timeline_page", "replace_passages", "html_to_text"):
        text = plan(QUERIES[name](spark, DATA))
        assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text


def test_top_rows_need_no_global_sort(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["files_newest"](spark, DATA))
