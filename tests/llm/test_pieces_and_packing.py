"""Tokenizer-backed operators against the libraries' plain calls and exact round trips."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyline.llm import packing, pieces

TEXTS = ["", " ", "a", "Hello, world. It's U.S. 1,000.5!", "a  b\n\n c \n d\x1cx  y  ", "line one.\nLine two, end", "\nab\ncd\n", "😀 日本語. ñandú, ", "<|endoftext|> x", "x <|endoftext|> y <|endoftext|", "a<|endoftext|>\nb", ".a ,b.", "½. ²x a.b", "word " * 3000, "x" * 20000, "Tab\there", "a​b \u0085"]


@pytest.fixture(scope="module")
def plain(tokenizers_path):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizers_path("byte_bpe_50k.json"))
    return lambda text: made.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_whole_texts(tokenizers_path, plain):
    encoder = packing.ChunkEncoder(tokenizers_path("byte_bpe_50k.json"), max_bytes=100)
    for _ in range(2):
        ids, lengths = encoder.encode(TEXTS, None)
        stops = np.cumsum(lengths)
        assert [ids[s - n : s].tolist() for s, n in zip(stops, lengths, strict=True)] == [plain(t) for t in TEXTS]
    ids, lengths = encoder.encode(["a", ""], 0)
    assert lengths.tolist() == [len(plain("a")) + 1, 1] and ids[-1] == 0


def test_other_tokenizers_encode_whole_texts(tokenizers_path):
    from tokenizers import Tokenizer

    path = tokenizers_path("word_bpe_49k.json")
    encoder, other = packing.ChunkEncoder(path), Tokenizer.from_file(path)
    assert not encoder.by_words
    ids, lengths = encoder.encode(TEXTS, None)
    stops = np.cumsum(lengths)
    assert [ids[s - n : s].tolist() for s, n in zip(stops, lengths, strict=True)] == [other.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_level_minimises_squares():
    rng = np.random.default_rng(1)
    for _ in range(200):
        p = packing.Packer(16)
        p.counts[1:16] = rng.integers(0, 4, 15)
        tail = int(rng.integers(1, 16))

        def cost(level, counts=p.counts, tail=tail):
            n = counts.copy()
            if level:
                n[level] -= 1
            if level + tail < 16:
                n[level + tail] += 1
            return int((n[1:16] ** 2).sum())

        allowed = [0] + [h for h in range(1, 17 - tail) if p.counts[h]]
        assert cost(p.level(tail)) == min(map(cost, allowed))


def test_packing_round_trip(spark, tokenizers_path, plain):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS * 3)] + [(None, None, "y"), (1, "a", "z"), (1, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Start string").repartition(3)
    got = packing.pack(df, tokenizers_path("byte_bpe_50k.json"), size=64).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length > 0
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    expected = sum(len(plain(t or "")) + 1 for _, t, _ in rows)
    assert sum(r.length for r in got) == expected
    for i, t in enumerate(TEXTS * 3):
        if i == 1:
            continue  # repeated key
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist()
        ids = b"".join(r.ids for r in parts)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == [*plain(t), 0] and {r.doc_tokens for r in parts} == {len(plain(t)) + 1}
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        total = sum(r.length for r in parts)
        assert [r.offset for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist()
        assert total == 64 or total & (total - 1) == 0  # nothing is padded
    assert packing.pack(df.limit(0), tokenizers_path("byte_bpe_50k.json")).count() == 0


def test_pieces_agree_with_sentencepiece(spark, tokenizers_path):
    import sentencepiece

    path = tokenizers_path("piece_bpe_32k.model")
    judge = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, TEXTS[3]), (3, TEXTS[3])]
    for r in pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), path).collect():
        ids = list(struct.unpack(f"<{r.n_pieces}I", r.piece_ids))
        assert r.parity and ids == judge.encode(r.text or "") and r.decoded == (r.text or ""), r
    with pytest.raises(ValueError, match="parity"):
        pieces.encode(spark.createDataFrame([("a", 1)], "text string, Parity int"), path)


def _message(*parts):
    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += bytes([number << 3 & 0x7F | 0x80, number >> 4]) if number > 15 else bytes([number << 3])
            out += bytes([value])
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += bytes([number << 3 | 2, len(value)]) + value
    return out


def _model(kind, fallback, more):
    named = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *more, ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1), ("▁ab", -5.0, 1), ("ba", -4.5, 1)]
    data = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, k)))) for p, s, k in named)
    return data + _message((2, _message((3, kind), (35, fallback), (40, 0))), (3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))


@pytest.mark.parametrize("kind", [1, 2])
def test_unknown_characters_on_both_sides_of_a_line_end(kind):
    import sentencepiece

    data = _model(kind, 0, [])
    codec = pieces.PieceCodec(data)
    texts = ["abX\nYab", "X\nY Z", "ab ab"]
    ids, lengths, same, _ = codec.encode(pa.array(texts))
    stops = np.cumsum(lengths)
    assert not codec.cut and same.all()
    assert [ids[s - n : s].tolist() for s, n in zip(stops, lengths, strict=True)] == sentencepiece.SentencePieceProcessor(model_proto=data).encode(texts)


def test_parity_is_judged_on_whole_texts(tokenizers_path):
    codec = pieces.PieceCodec(open(tokenizers_path("piece_bpe_32k.model"), "rb").read())
    texts = pa.array(["one two", "three", "", "one two"])
    ids, lengths, same, _ = codec.encode(texts)
    assert same.all()
    ids[0] += 1
    assert codec.agrees(texts, ids, lengths).tolist() == [False, True, True, True]
    assert codec.agrees(texts, ids[1:], lengths - [1, 0, 0, 0]).tolist() == [False, True, True, True]


def test_unigram_models_with_byte_fallback():
    import sentencepiece

    data = _model(1, 1, [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)])
    codec = pieces.PieceCodec(data)
    assert codec.spec.kind == pieces.UNIGRAM and codec.spec.byte_fallback
    texts = ["ab ba", "abba é", "a\nb", "", " ab"]
    ids, lengths, same, said = codec.encode(pa.array(texts))
    judge = sentencepiece.SentencePieceProcessor(model_proto=data)
    stops = np.cumsum(lengths)
    own = [ids[s - n : s].tolist() for s, n in zip(stops, lengths, strict=True)]
    assert own == judge.encode(texts) and same.all() and codec.decode(own) == said.to_pylist() == texts


def test_crc_of_ids():
    assert zlib.crc32(np.array([1, 2], dtype="<u4").tobytes()) == zlib.crc32(struct.pack("<2I", 1, 2))
