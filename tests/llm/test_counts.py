import json

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmatch.llm import counts

SCHEMA = "doc_id long, text string, n_tokens string, n_bytes int"
PLAIN = Tokenizer.from_file(public_tokenizers.path(counts.TOKENIZER))
ODD = [" ", "  ", "\n", "\t", " ", "　", "'s", "'", "don't", "a", "Ab1", "12", "一二", "。", "、", "ー", "²", "<|endoftext|>", "<|", "|>", "end", "oftext", "é", "😀", "...", "_", "-", "가나", "ナ", "́"]


def whole(text):
    return len(PLAIN.encode(text, add_special_tokens=False))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=60).map("".join), st.integers(1, 12), st.integers(1, 40))
def test_cut_texts_have_the_tokens_of_the_whole(text, part, batch):
    made = counts.parts(text, part)
    assert "".join(made) == text
    assert counts.counter(counts.TOKENIZER).count([text, "", text + " x"], batch, part) == [whole(text), 0, whole(text + " x")]


def test_rows(spark):
    texts = [None, "", " ", "one two  three\n\n", "x" * 70_000, "word " * 40_000, "日本語。" * 20_000, "a<|endoftext|>b", "same", "same"]
    rows = [(k if k != 8 else None, x, "n", 1) for k, x in enumerate(texts)]
    found = counts.token_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted((str(i), len((x or "").encode()), whole(x or ""), whole(x or "") > 512) for i, x, *_ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found) == want
    assert counts.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_special_strings_are_as_the_library_has_them():
    assert counts.counter(counts.TOKENIZER).count(["<|endoftext|>"]) == [1]


def test_batches_are_balanced(monkeypatch):
    worker = counts.Counter(counts.TOKENIZER)
    seen = []
    monkeypatch.setattr(worker, "lengths", lambda texts: seen.append(texts) or [1] * len(texts))
    assert worker.count([" ".join(map(str, range(5000)))] + [f"c{k} d" for k in range(3000)] + ["12ab" * 2500], batch=2000, part=1000) == [5000, *[2] * 3000, 10]
    sizes = [sum(map(len, x)) for x in seen]
    assert max(sizes) < 2000 + 1000 and min(sizes) > 1000 and len(sizes) > 10
    assert worker.count(["7 8 c5"]) == [3] and len(seen) == len(sizes) + 1  # only the first part is new


def test_other_tokenizers_are_not_cut():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        assert not counts.splits_safely(json.load(f))
    from sentencepiece import SentencePieceProcessor

    text = "A short text,  with two spaces. " * 50
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert counts.Counter("piece_bpe_32k.model").count([text, ""], part=10) == [len(model.encode(text)), 0]


def test_neither_kind():
    with pytest.raises(ValueError):
        counts.Counter("/tmp/x.tiktoken")
