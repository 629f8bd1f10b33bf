"""Extra columns pass the pipeline's stages unchanged, whatever they are called."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NAMES = (
    "n_lines n_dropped host line lines page pages on_pages _host _drop _kept _own _at _more _nth _src _epochs _last _budget key size "
    "taken target epochs extra cuts _gone _odd _hex _component _fp fp node root first component_id fingerprint id passed_0 passed_5 "
    "_row _before _uid _task _one a.b"
).split()


def test_extra_columns_keep_their_values(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumns({f"{n}": F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")) for n in NAMES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert all(r[n] == f"{n}:{r['doc_id']}" for n in NAMES), name
