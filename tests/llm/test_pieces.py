"""SentencePiece encoding against the library: odd texts, long cuts, a vocabulary of its own, nulls and empty tables."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tracewright.llm import pieces

PATH = public_tokenizers.path(pieces.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = [None, "", " ", "  a", "Hello,  World!\t1234\n\n", "<s></s><unk><0x0A>", "日本語 mixed Текст 😀\U0010ffff", "a\0b", "▁▁ ▁", "x" * 5000, "the cat " * 5000, "the cat " * 5000, "é" * 49, "-" * 300 + " " * 300]


def _sha(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_digests_as_the_library(spark, sf_dir):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again")] + [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id long, text string, ids string, _text int").repartition(5)
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), _sha(ids), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest(), True))
    key = str
    assert sorted(map(tuple, pieces.piece_digests(df, PATH).collect()), key=key) == sorted(want, key=key)


def test_ids_and_decoding_alone(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    for ends in (True, False):
        encoded = pieces.encode_documents(df, PATH, ends)
        got = {r["doc_id"]: list(r["ids"]) for r in encoded.filter("agrees").collect()}
        assert got == {i: LIBRARY.encode(t or "", add_bos=ends, add_eos=ends) for i, t in enumerate(TEXTS)}
        back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(encoded, PATH).collect()}
        assert back == {i: LIBRARY.decode(x) for i, x in got.items()} and back[4] == TEXTS[4]
    assert pieces.piece_digests(df.filter("false"), PATH).count() == 0
    assert pieces.decode_documents(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).collect()[0]["text"] == ""


def test_random_texts_and_both_agendas(monkeypatch):
    agenda, rng = pieces.Agenda(PATH), random.Random(1)
    for short in (48, 0, 10**9):
        monkeypatch.setattr(pieces, "SHORT", short)
        agenda.clear()
        agenda.older.clear()
        monkeypatch.setattr(pieces, "CACHED", 50)
        monkeypatch.setattr(pieces, "ROWS", 7)
        for n in (1, 2, 5, 30, 400):
            for _ in range(60):
                text = "".join(rng.choice("ab  ▁\n1203é日本😀\0‍<s>. '’-the ing") for _ in range(n))
                assert agenda.checked([text], True)[0][1], text
        texts = ["".join(rng.choice("ab  ▁\n1203é日本😀\0‍<s>. '’-the ing") for _ in range(rng.randint(0, 90))) for _ in range(200)]
        assert all(same for _, same in agenda.checked(texts, False))


def test_equal_scores_and_characters_that_are_no_piece(tmp_path):
    """Pieces with spaces inside (texts aren't cut), equal scores (the left pair first), characters known in longer pieces alone."""
    model, rng = sentencepiece_model_pb2.ModelProto(), random.Random(3)
    model.ParseFromString(open(PATH, "rb").read())
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    kept = [p for p in model.pieces if p.type != kinds.NORMAL]
    words = sorted({"".join(rng.choice("abc▁") for _ in range(rng.randint(2, 5))) for _ in range(150)})
    own = sentencepiece_model_pb2.ModelProto(trainer_spec=model.trainer_spec, normalizer_spec=model.normalizer_spec, pieces=kept)
    for w in ["a", "b", "▁", *words]:
        own.pieces.append(kinds(piece=w, score=-float(rng.randint(1, 12)), type=kinds.NORMAL))
    own.trainer_spec.vocab_size = len(own.pieces)
    path = tmp_path / "own.model"
    path.write_bytes(own.SerializeToString())
    agenda = pieces.Agenda(str(path))
    assert agenda.cuts("▁a▁b") == ["▁a▁b"]
    for _ in range(400):
        text = "".join(rng.choice("abcd  ") for _ in range(rng.randint(1, 90)))
        assert agenda.checked([text], False)[0][1], text


def test_other_kinds_of_model_are_refused(tmp_path):
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="merge vocabularies"):
        pieces.Agenda(str(path))


def test_query(spark, sf_dir):
    assert pieces.op13_pieces(spark, sf_dir).filter(F.col("agrees")).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
