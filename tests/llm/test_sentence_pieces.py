"""SentencePiece encoding, spans and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_pb
from sentencepiece import sentencepiece_pb2 as text_pb

from filelode.llm import sentence_pieces as sp
from filelode.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "▁", "é", "日本", "😀", "\x00", "<s>", "<unk>", "<0x41>", "the ", " and", "1", "23", "‍", "﻿", "�", "ﬁ", "①", "Ａ", "　", "\x85", "ing"]


def invented(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(0, 30))) for _ in range(n)]


def compare(own, library, texts, seed=1):
    rnd = random.Random(seed)
    for text in texts:
        ids, begins, ends = own.encode_with_spans(text)
        want = text_pb.SentencePieceText()
        want.ParseFromString(library.encode(text, out_type="serialized_proto"))
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist())) == [(p.id, p.begin, p.end) for p in want.pieces], text
        assert own.decode(ids) == library.decode(ids.tolist()), text
        junk = [rnd.choice([rnd.randrange(len(own.names)), rnd.randrange(300)]) for _ in range(rnd.randrange(0, 12))]
        assert own.decode(np.array(junk, np.int64)) == library.decode(junk), junk


def test_model_as_it_is():
    compare(sp.load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), invented(600, 1))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("fallback", [True, False])
def test_compiled_character_maps(rule, squeeze, prefix, fallback):
    """The same pieces under the library's own compiled maps and each combination of the white space rules."""
    model, rules = model_pb.ModelProto(), model_pb.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    model.normalizer_spec.add_dummy_prefix = prefix
    model.trainer_spec.byte_fallback = fallback
    if not fallback:
        for piece in model.pieces:
            piece.type = 3 if piece.type == 6 else piece.type
    data = model.SerializeToString()
    compare(sp.PieceModel(data), sentencepiece.SentencePieceProcessor(model_proto=data), invented(100, 2))


def test_other_kinds_of_models_are_refused():
    model = model_pb.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        sp.PieceModel(model.SerializeToString())


def test_long_texts():
    own, library = sp.load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ("a" * 20_000, " " * 5000, "the" * 3000 + "\n" * 3000, "日本語" * 3000):
        assert own.encode(text).tolist() == library.encode(text)


def test_tables(spark):
    """Nulls, empty texts, repeated rows, null ids, extra columns; an empty table."""
    rows = [(1, None, 1), (2, "", 2), (3, "Hello  world\n", 3), (3, "Hello  world\n", 4), (None, "é", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sp.round_trip_digests(docs, PATH).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i or 0, library.encode(t or "")) for i, t, _ in rows]
    assert got == sorted((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, ids in want)
    spans = {r.doc_id: (r.begins, r.ends) for r in sp.encode(docs, PATH).collect()}
    assert spans[3][0][0] == 0 and spans[3][1][-1] == len("Hello  world\n") and spans[1] == ([], [])
    back = sp.decode(sp.encode(docs, PATH), PATH).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, _ in rows)
    assert sp.round_trip_digests(docs.limit(0), PATH).count() == 0
