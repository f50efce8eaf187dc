import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from breaklens.llm import tokens
from breaklens.llm.packing import Limits, pack, pack_texts
from breaklens.llm.token_files import read_token_files, write_token_files
from breaklens.llm.tokens import ChunkEncoder, encode_texts
from breaklens.session import scratch_path

ODD = ["", "a  b   c \n\n d", "  lead", "trail  ", "x\ty z \x1c q", "it's don't 'S 's", "a\0b c", "\0b \0\0b b",
       "Ünï É ß ñ ÷ × foo÷ Word,;'s", "<|endoftext|> x", "İstanbul ΑΣ", "é áb", "1 22 333 4a5",
       "\nA\n B \n", "a.b,c !!! ...", "日本 語 \U0001F600", "word, word. word\nWord word!! Word", " ", "\n", "a b c"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("memo", [3, 10_000])
def test_chunks_give_the_ids_of_whole_texts(name, memo, write_prose, monkeypatch):
    monkeypatch.setattr(tokens, "CHARS", 50)  # texts are cut, too
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    texts = [*ODD, write_prose(200), "x" * 300 + " " + "y z " * 80, *ODD]
    got = list(ChunkEncoder(path, memo).encode(iter(texts)))
    assert got == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def check_pieces(rows, ids, limits):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {d for d, x in ids.items() if len(x)}
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[d])
            assert np.array_equal(np.frombuffer(p["ids"], "<u4"), ids[d][at:at + p["length"]])
            at += p["length"]
        assert at == len(ids[d])
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == limits.tokens or at & (at - 1) == 0
        assert at <= limits.tokens and len(pieces) <= limits.segments
        assert sum(p["loss_tokens"] for p in pieces) <= limits.loss
    return sequences


def test_packing_keeps_all_limits_without_padding(spark, rng):
    ids = {d: np.array([rng.randrange(1000) for _ in range(rng.choice([1, 2, 3, 40, 300, 1024, 2500]))], "<u4")
           for d in range(400)}
    limits = Limits(tokens=256, segments=5, loss=150)
    mask = {d: np.array([rng.random() < 0.5 for _ in x], np.uint8) for d, x in ids.items()}
    df = spark.createDataFrame([(d, bytearray(x.tobytes()), bytearray(mask[d].tobytes())) for d, x in ids.items()],
                               "doc_id bigint, ids binary, loss binary").repartition(2)
    rows = [r.asDict() for r in pack(df, "doc_id", loss_col="loss", limits=limits, window=32).collect()]
    check_pieces(rows, ids, limits)
    for r in rows:
        assert r["loss_tokens"] == mask[r["doc_id"]][r["start"]:r["start"] + r["length"]].sum()


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, bytearray(b"")), (2, None), (3, bytearray(np.arange(5, dtype="<u4").tobytes()))],
                               "doc_id bigint, ids binary")
    rows = [r.asDict() for r in pack(df, "doc_id").collect()]
    check_pieces(rows, {1: [], 2: [], 3: np.arange(5)}, Limits())
    assert pack(df.where("doc_id = 9"), "doc_id").count() == 0


def test_most_sequences_are_full(spark, make, write_prose, rng):
    docs = make([(i, write_prose(rng.randint(5, 400))) for i in range(150)]).coalesce(1)
    ids = encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)
    rows = [r.asDict() for r in pack(ids, "doc_id").collect()]
    seq = check_pieces(rows, {r.doc_id: np.frombuffer(r.ids, "<u4") for r in ids.collect()}, Limits())
    full = sum(sum(p["length"] for p in s) == 1024 for s in seq.values())
    assert len(seq) - full <= 10
    again = [r.asDict() for r in pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), 0).collect()]
    assert again == rows


def test_token_files_round_trip(spark, make, edges, write_prose, monkeypatch):
    rows = edges + [(i, write_prose(20 + i)) for i in range(50, 0, -1)]
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = scratch_path(spark, "test-tokens")
    manifest = write_token_files(make(rows, extra=True).repartition(3), folder, path, end_id=2)
    got = read_token_files(spark, folder, batch_ids=64).collect()
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    at = 0
    want = []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got), key=lambda r: r[1]) == want
    assert manifest["n_ids"] == at and manifest["n_docs"] == len(rows)


def test_token_files_of_an_empty_table(spark, make):
    folder = scratch_path(spark, "test-tokens")
    write_token_files(make([]), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    assert read_token_files(spark, folder).count() == 0
