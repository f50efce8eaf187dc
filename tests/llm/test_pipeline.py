import os
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from breaklens.llm.decontaminate import contamination
from breaklens.llm.near_dup import near_duplicates
from breaklens.llm.pii import redact_pii
from breaklens.llm.quality import quality


def fixture(spark, write_prose, rng, folder, edges):
    item = write_prose(30)
    rows = [(i, write_prose(rng.randint(60, 200))) for i in range(40)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + " tail"), (101, rows[1][1] + " tail"),
             (200, rows[5][1] + " " + item + " " + write_prose(30)),
             (300, " ".join(w + "###" for w in write_prose(60).split())), (301, "too short"),
             (400, write_prose(80) + " mail jane.doe@mail.example.org or +1 555 010 9999.")]
    rows += edges
    docs = spark.createDataFrame([(d, t, "en", "src0", len(t) if t else None) for d, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.mode("overwrite").parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.mode("overwrite").parquet(
        os.path.join(folder, "benchmark.parquet"))
    return spark.read.parquet(os.path.join(folder, "documents.parquet"))


def test_stages_against_operators(spark, write_prose, rng, tmp_dir, edges):
    docs = fixture(spark, write_prose, rng, tmp_dir, edges)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "benchmark_decontamination", "pii", "packing"]
    kept = {r.doc_id for r in quality(docs).where("kept").collect()}
    assert set(range(40)) <= kept and not kept & {300, 301, 900, 901, 902, 903}
    step = docs
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        out = os.path.join(tmp_dir, name)
        stage(spark, step, tmp_dir).write.parquet(out)
        step = frames[name] = spark.read.parquet(out)
        if name != "packing":
            assert step.columns == docs.columns
    ids = lambda name: sorted(r.doc_id for r in frames[name].collect())
    assert set(ids("quality_rules")) == kept
    after = [r.doc_id for r in near_duplicates(frames["quality_rules"]).where("kept").collect()]
    assert ids("near_dedup") == sorted(set(after))
    assert not {100, 101} & set(ids("near_dedup"))
    bad = {r.doc_id for r in contamination(frames["near_dedup"], spark.read.parquet(f"{tmp_dir}/benchmark.parquet"))
           .where("n_hit > 0").collect()}
    assert bad == {200} and set(ids("benchmark_decontamination")) == set(ids("near_dedup")) - bad
    texts = {r.doc_id: r for r in frames["pii"].collect()}
    assert "[EMAIL]" in texts[400].text and "[PHONE]" in texts[400].text and texts[400].n_chars == len(texts[400].text)
    assert {r.doc_id: r.text for r in redact_pii(frames["benchmark_decontamination"]).collect()} == {
        d: r.text for d, r in texts.items()}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {}
    for r in frames["packing"].orderBy("start").collect():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        found.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert found == {d: [*tok.encode(r.text, add_special_tokens=False).ids, 0] for d, r in texts.items()}


def test_run_equals_its_stages(spark, write_prose, rng, tmp_dir, edges):
    docs = fixture(spark, write_prose, rng, tmp_dir, edges)
    step = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, step, tmp_dir).write.parquet(f"{tmp_dir}/again-{i}")
        step = spark.read.parquet(f"{tmp_dir}/again-{i}")
    pick = ["doc_id", "start", "length", "ids_crc32"]
    got = sorted(map(tuple, corpus_pipeline.run(spark, tmp_dir).select(pick).collect()))
    assert got == sorted(map(tuple, step.select(pick).collect()))
