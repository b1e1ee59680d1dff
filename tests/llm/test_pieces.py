import os
import random
import struct

import pytest
from sentencepiece import SentencePieceProcessor

from quillmatch.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file")
TEXTS = ["", " ", "  two  spaces ", "Hello world", "a\nb\tc", "▁marker ▁▁", "漢字 é ß 🙂 ​", "<s> </s> <unk> <0x0A>", "x" * 5000, "word " * 3000, "aaaa aaaaaa 11111", "\x00\x01", "हिन्दी भाषा", " lead", "trail "]


def random_texts(n=300):
    rng = random.Random(12)
    return ["".join(rng.choice("abcdeABC  \n.,éß漢🙂12'") for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_ids_are_those_of_sentencepiece_and_decode_to_the_text():
    with open(pieces.MODEL, "rb") as f:
        data = f.read()
    coder, texts = pieces.Coder(data), TEXTS + random_texts()
    ids = coder.encode(texts)
    assert ids == SentencePieceProcessor(model_proto=data).encode(texts)
    again, _, back = coder.encode_and_back(texts)
    assert sum(map(len, ids)) == len(again)
    for text, row, same in zip(texts, ids, back, strict=True):
        assert same == (coder.decode([row])[0] == text)
        assert same or "▁" in text


def test_parts_are_cut_by_arrow_and_go_to_the_library_many_at_once():
    with open(pieces.MODEL, "rb") as f:
        data = f.read()
    coder = pieces.Coder(data)
    texts = TEXTS + random_texts() + ["  ", "▁", " ▁ a▁▁b ▁", "a  b   c    d ", "\n \n  \n"]
    for prefix in (True, False):
        coder.model.prefix = prefix
        want = coder._parts(texts)
        assert all(a.tolist() == b.tolist() for a, b in zip(coder._words(texts), want, strict=True))
    coder, asked = pieces.Coder(data), []
    alone = coder._alone
    coder._alone = lambda parts: asked.append(len(parts)) or alone(parts)
    words = [f"w{k * k}é漢"[k % 3 :] for k in range(5000)]
    assert coder.encode([" ".join(words)]) == SentencePieceProcessor(model_proto=data).encode([" ".join(words)])
    assert sum(asked) <= len(words) / coder.JOINED + 2


def message(*parts):
    """A protobuf message of (field, value): bytes, float or whole number."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for field, value in parts:
        if isinstance(value, bytes):
            out += number(field << 3 | 2) + number(len(value)) + value
        elif isinstance(value, float):
            out += number(field << 3 | 5) + struct.pack("<f", value)
        else:
            out += number(field << 3) + number(value)
    return out


def unigram(byte_fallback):
    """A small unigram model, written by hand."""
    made = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    made += [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)] if byte_fallback else []
    made += [(p, -s, 1) for p, s in [("▁", 3.0), ("a", 4.0), ("b", 4.5), ("c", 5.0), ("ab", 5.5), ("▁ab", 6.0), ("abc", 7.2), ("bc", 6.1), ("▁a", 5.2), ("ca", 6.6)]]
    trainer = message((3, 1), (35, int(byte_fallback)), (40, 0), (41, 1), (42, 2))
    return message(*[(1, message((1, p.encode()), (2, s), (3, k))) for p, s, k in made], (2, trainer), (3, message((3, 1), (4, 0), (5, 1))))


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_models(byte_fallback):
    data = unigram(byte_fallback)
    rng = random.Random(1)
    texts = ["", "abc", "ab abc ca", " a  b "] + ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    texts += ["xay", "é ab"] if byte_fallback else []
    assert pieces.Coder(data).encode(texts) == SentencePieceProcessor(model_proto=data).encode(texts)


def test_query_rows(spark):
    rows = [(k, t, "en") for k, t in enumerate(TEXTS[:-1])] + [(98, None, None), (99, "again", "x"), (99, "again", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, lang string, ids int, parity string")
    found = pieces.encoded(docs, keep=("doc_id", "lang")).collect()
    processor = SentencePieceProcessor(model_file=pieces.MODEL)
    assert sorted(repr((r.doc_id, r.lang, r.ids, r.n_tokens)) for r in found) == sorted(repr((d, x, ids := processor.encode(t or ""), len(ids))) for d, t, x in rows)
    assert all(r.parity for r in found)
    assert pieces.encoded(docs.limit(0)).count() == 0
