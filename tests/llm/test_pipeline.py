import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from tessera.llm import bpe, mixing, toxicity
from tests.llm.test_dedup import brute_components, brute_lines

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    """Each stage against a plain version of it; the mix by its targets, the last by decoding."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = stages["toxicity"](spark, docs, SF)
    assert first.columns == docs.columns
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    assert set(kept) == {i for i, p in scored.items() if not p}

    second = stages["line dedup"](spark, first, SF)
    plain = {i: x[0] for i, x in brute_lines(sorted(kept.items())).items()}
    want = {i: t for i, t in plain.items() if t == kept[i] or re.search(r"\S", t)}
    rows = second.collect()
    assert second.columns == docs.columns and {r["doc_id"]: r["text"] for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)

    third = stages["MinHash near-dedup"](spark, second, SF)
    classes = brute_components(sorted(want.items()), 5, 80)
    assert third.columns == docs.columns and {r["doc_id"] for r in third.collect()} == {i for i, c in classes.items() if c[2]}

    fourth = stages["mixing sources"](spark, third, SF)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(third).collect()}
    assert fourth.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in fourth.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}

    fifth = stages["byte-level BPE"](spark, fourth, SF)
    assert {"doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(fifth.columns)
    library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    ids = sorted((r["doc_id"], np.array(library.encode_ordinary(r["text"] or ""), "<u4").tobytes()) for r in fourth.collect())
    assert ids == sorted((r["doc_id"], bytes(r["ids"])) for r in fifth.collect())


def test_run_and_tables_without_rows(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "mixing sources", "byte-level BPE"]
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
