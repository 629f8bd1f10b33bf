"""Physical-plan checks: what crosses a shuffle, what is read in place."""

import re

from pyspark.sql import functions as F

from conftest import tok_frame


def formatted(df) -> str:
    jvm = df.sparkSession._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        df._jdf.queryExecution(), "formatted"
    )


def exchange_inputs(plan: str) -> list[str]:
    """The ``Input`` line of every (Broadcast)Exchange node section."""
    out = []
    for m in re.finditer(r"^\(\d+\) (?:Broadcast)?Exchange\s*\nInput \[\d+\]: \[(.*)\]$", plan, re.M):
        out.append(m.group(1))
    return out


def test_flagship_never_shuffles_text(spark, tmp_dir):
    from corpusflow.operators.aggregates import domain_token_report
    from corpusflow.operators.tokens import tokenize_char
    from corpusflow.plans.catalog import documents_corpus

    docs = spark.createDataFrame(
        [(i, "text %d " % i * (i % 7), f"s{i % 5}", "en", 1) for i in range(400)],
        "doc_id long, text string, source string, lang string, n_chars long",
    )
    docs.repartition(16).write.parquet(f"{tmp_dir}/documents.parquet")  # many splits: no spreading
    report = domain_token_report(tokenize_char(documents_corpus(spark, tmp_dir)))
    plan = formatted(report)
    inputs = exchange_inputs(plan)
    assert inputs, plan
    assert not any(re.search(r"\btext#", i) for i in inputs), inputs
    assert "ArrowEvalPython" not in plan  # counting tokens never builds id arrays


def test_window_sampling_reads_blocks_in_place(spark):
    from corpusflow.operators.packing import pack_blocks
    from corpusflow.operators.sampling import sample_windows
    from corpusflow.session import materialise

    rows = [("train", "a", i, list(range(i, i + 50))) for i in range(20)]
    blocks = materialise(pack_blocks(tok_frame(spark, rows), 16, ["split", "domain"], ["doc_id"]), "plan-blocks")
    plan = formatted(sample_windows(blocks, 16, 8, 4, 1))
    # the block table is scanned twice (lengths, data); its ids never enter an exchange
    # before the broadcast join with the draws
    inputs = exchange_inputs(plan)
    assert inputs, plan
    ids_exchanges = [i for i in inputs if re.search(r"\bids#", i) and "start" not in i]
    assert not ids_exchanges, ids_exchanges


def test_domain_filter_and_columns_reach_the_scan(spark, tmp_dir):
    rows = [(i, "some text", {"set_name": f"s{i % 3}", "n": i}) for i in range(30)]
    schema = "doc_id long, text string, meta struct<set_name: string, n: long>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_dir}/docs")
    from corpusflow.operators.domains import filter_domain

    plan = formatted(filter_domain(spark.read.parquet(f"{tmp_dir}/docs"), "meta.set_name", "s1").select("doc_id"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(meta\.set_name,s1\)", plan), plan
    assert re.search(r"ReadSchema: struct<doc_id:bigint,meta:struct<set_name:string>>", plan), plan
