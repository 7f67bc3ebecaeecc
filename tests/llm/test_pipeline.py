"""The pipeline's stages, each on its own input: against brute force where there is one, against the fitted model text by text else."""

import re

from pyspark.sql import functions as F
from tables import DOCS, odd, union
from test_duplicates import brute_links
from test_models import PATTERNS

import corpus_pipeline
from graphdelta.llm import quality, secrets, toxicity
from graphdelta.llm._common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "secrets", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, kept, SF), name)
        assert after.schema == docs.schema
        texts = {r.doc_id: r.text for r in kept.collect()}
        got = {r.doc_id: r.text for r in after.collect()}
        if name == "toxicity":
            model = toxicity.fit(kept.select("doc_id", "text"), known)
            want = {i for i, t in texts.items() if model.score(*model.log_ratio([(t or "").encode()]))[0] < 0.5}
        elif name == "quality":
            ratio = quality.fit(kept.select("doc_id", "text"), known)
            want = set()
            for i, t in texts.items():
                n, _, _, _, repeated = quality.base_features((t or "").encode())
                if n >= 50 and 100 * repeated <= 50 * n and ratio.score([(t or "").encode()])[0] >= ratio.threshold:
                    want.add(i)
        elif name == "near_dedup":
            want = {i for i, c in union(brute_links(texts, 5, 80)[1], texts).items() if i == c}
        else:
            want = set(texts)
            scanner = secrets.fit(kept)
            for i, t in texts.items():
                spans = scanner.spans([t])[0]
                assert got[i] == secrets.redacted(t, spans)
                for _, pattern, ok in PATTERNS:  # nothing that a base pattern found is left
                    assert not any(ok(m) and m.group() in got[i] for m in pattern.finditer(t))
        assert set(got) == want, name
        kept = after
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    lengths = {r.doc_id: (len(r.text.encode().split()), r.source) for r in kept.collect()}
    for i, (n, _) in lengths.items():
        assert sorted((r.start, r.n_tokens) for r in packed if r.doc_id == i) == [(k, min(2048, n - k)) for k in range(0, n, 2048)]
    bins = {}
    for r in packed:
        bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        assert sum(r.n_tokens for r in members) <= 2048
        sources = [lengths[r.doc_id][1] for r in members]
        assert len(sources) == len(set(sources))
    run = sorted((r.doc_id, r.piece, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect())
    assert run == sorted((r.doc_id, r.piece, r.n_tokens) for r in packed)


def test_cases(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns; and no rows at all."""
    plain = " ".join(f"word{i}" for i in range(60))
    rows = [(0, None), (1, ""), (None, plain), (None, None), (2, plain + " two"), (2, plain + " two"), (3, plain + " two"), (4, " ".join(f"long{i}" for i in range(5000))), (5, plain + " password: hunter22x")]
    docs = odd(spark, rows).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.when(F.col("doc_id") != 2, "s")).withColumn("odd", F.struct(F.lit(1).alias("a b")))
    docs.write.parquet(f"{tmp_path}/some/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for folder in ("some", "none"):
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{folder}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, f"{tmp_path}/some")
        assert after.columns == docs.columns
        kept = materialize(after)
    texts = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in kept.collect())
    assert [t[:2] for t in texts] == [(False, 0), (True, 2), (True, 4)]
    assert not any(re.search("hunter", t[2]) for t in texts)
    packed = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert sum(r.n_tokens for r in packed) == 60 + 61 + 5000
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert {f.split()[0] for f in DOCS.split(", ")} <= set(docs.columns)
