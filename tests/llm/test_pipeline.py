"""The pipeline's stages on the smallest tables, each held against its rule."""

from __future__ import annotations

import re

import corpus_pipeline
from test_dedup import components



def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else docs
    with_letters = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if re.search("[a-z]", r.text or "")}
    assert len(with_letters - set(kept["language"])) <= 0.01 * len(with_letters)
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in kept["exact"].values()]
    assert len(set(plain)) == len(plain) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in kept["language"].values()})
    alone = {i for i, x in components(kept["exact"], 5, 80).items() if x[2]}
    assert set(kept["near"]) == alone
    assert set(kept["decontaminate"]) < set(kept["near"])
    assert kept["pieces"].where("NOT round_trip").count() == 0
    assert kept["pieces"].count() == len(kept["decontaminate"])
