import pytest

from corpusflow.operators.domains import (
    RAW_SUBSET_NAMES,
    REDPAJAMA_SET_NAMES,
    filter_domain,
    normalise_domain,
    strip_markup,
)
from corpusflow.plans.catalog import Catalog, corpus_catalog


def test_normalise_rules(spark):
    df = spark.createDataFrame([("Wikipedia_(en)",), ("Pile-CC",)], "d string")
    got = [r.domain_name for r in normalise_domain(df, "d", underscores_to_spaces=True).collect()]
    assert got == ["Wikipedia (en)", "Pile-CC"]
    df = spark.createDataFrame([("arxiv",), ("cc",), ("nope",)], "d string")
    out = {r.d: (r.domain_name, r.unmatched) for r in normalise_domain(df, "d", REDPAJAMA_SET_NAMES).collect()}
    assert out["arxiv"] == ("RedPajamaArXiv", False) and out["nope"] == ("nope", True)
    raw = {r.d: r.domain_name for r in normalise_domain(df, "d", RAW_SUBSET_NAMES).collect()}
    assert raw["cc"] == "common_crawl" and raw["arxiv"] == "arxiv"


def test_strip_markup_dialects(spark):
    df = spark.createDataFrame(
        [("<html><script>var a='<p>';</script><p>Hi &amp; bye</p><!-- c --></html>",
          "\\section{Intro} Text % comment\nmore \\textbf{bold} $$x$$ end")],
        "h string, t string",
    )
    row = strip_markup(strip_markup(df, "h", "html", "h_txt"), "t", "latex", "t_txt").first()
    assert row.h_txt == "Hi & bye"
    assert "comment" not in row.t_txt and "Intro" in row.t_txt and "bold" in row.t_txt
    assert "\\" not in row.t_txt and "x" not in row.t_txt.split()


def test_latex_keys_and_floats_are_no_text(spark):
    tex = "see~\\cite[p. 2][x]{k1,k2} now \\eqref{e}.\n\\begin{figure}[h]\n\\caption{Body}\n\\end{figure}\n\\label{sec:a}end"
    row = strip_markup(spark.createDataFrame([(tex,)], "t string"), "t", "latex", "txt").first()
    assert row.txt.split() == ["see", "now.", "end"]


def test_nested_filter_pushed_to_scan(spark, tmp_dir):
    df = spark.createDataFrame([(1, ("a",)), (2, ("b",))], "id long, meta struct<set_name:string>")
    df.write.parquet(f"{tmp_dir}/n")
    out = filter_domain(spark.read.parquet(f"{tmp_dir}/n"), "meta.set_name", "b")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(meta.set_name,b)" in plan
    assert [r.id for r in out.collect()] == [2]


def test_catalog_keys(spark):
    base = "/root/testdata/sf0.001"
    with pytest.raises(KeyError):
        corpus_catalog(spark, "nope", base)
    cat = Catalog()
    cat.register("toy", lambda s, b: s.createDataFrame(
        [("train", "a-b", 1), ("train", "c", 2)], "split string, domain string, doc_id long"))
    assert [r.doc_id for r in cat.get(spark, "toy-a-b", base).collect()] == [1]  # split once on '-'
    assert cat.get(spark, "toy-all", base).count() == 2
