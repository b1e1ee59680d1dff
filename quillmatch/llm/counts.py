"""Token counts: texts are encoded in batches inside Arrow functions, and only lengths come out.

Texts go to the tokenizer's own library: tokenizers for a .json file, sentencepiece for a .model file; without begin, end or
added special tokens, without truncation or padding, special strings inside texts as the library handles them by default.

Texts are cut where their tokens cannot differ from those of the whole, so a part's length counts wherever it comes, and each distinct
part is encoded once, in batches of nearly equal bytes. Safe boundaries are known for byte-level BPE with its usual pattern:
before white space that follows something else (no piece of the pattern goes on from one to the other), and, in parts longer than PART,
between an ASCII letter or ideograph and a digit or the reverse, and between an ideograph, kana or hangul syllable and CJK punctuation.
Where a tokenizer has a normaliser, another pattern or an added token that such a cut could touch, texts are encoded whole; so is a stretch
without such a place.

A worker remembers the lengths of parts, up to about REMEMBERED bytes, and then begins anew.

Rows stay where they are: no shuffle, one pass over two columns.

Defined results: null and empty texts have no bytes and no tokens; repeated rows each get a row; null ids stay; bytes that are not
UTF-8 count as their replacement characters' tokens, n_bytes is always that of the column; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bytescan import pieces
from .common import table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Bytes of text in a batch, and of a text's part, about.
BATCH, PART = 400_000, 50_000
_IDEOGRAPH = "ぁ-ゖァ-ヺ가-힣一-鿿"
#: Places within other text where the pieces of byte-level BPE's pattern always end.
CUT = re.compile(rf"(?<=[A-Za-z{_IDEOGRAPH}])(?=[0-9])|(?<=[0-9])(?=[A-Za-z{_IDEOGRAPH}])|(?<=[{_IDEOGRAPH}])(?=[、。，！？；：「」])")
#: The white space of Unicode, which is that of the pattern; a part is some of it and what follows.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PARTS = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
REMEMBERED = 64 << 20


def splits_safely(description: dict) -> bool:
    """Whether CUT holds for a tokenizer of the tokenizers library, given its file as a dict."""
    before = description.get("pre_tokenizer") or {}
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or CUT.search(t["content"]) or PARTS.findall(t["content"]) != [t["content"]]) for t in description.get("added_tokens", []))
    return bool(level and plain and not description.get("normalizer"))


def parts(text: str, most: int = PART) -> list[str]:
    """The text cut before white space, and parts of more than `most` characters at the last safe place in each stretch of so many, or the next one."""
    out = PARTS.findall(text)
    if len(text) > most and max(map(len, out)) > most:
        return [piece for part in out for piece in (_cut(part, most) if len(part) > most else [part])]
    return out


def _cut(part: str, most: int) -> list[str]:
    out, at, last = [], 0, 0
    for place in (m.start() for m in CUT.finditer(part)):
        if place - at > most and last > at:
            out.append(part[at:last])
            at = last
        last = place
    if len(part) - at > most and last > at:
        out.append(part[at:last])
        at = last
    return [*out, part[at:]]


class Counter:
    """Lengths of texts in tokens; made once in each worker."""

    def __init__(self, name: str):
        path = public_tokenizers.path(name) if not os.path.isabs(name) else name
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            with open(path, encoding="utf-8") as f:
                self.cuts = splits_safely(json.load(f))
            made = Tokenizer.from_file(path)
            made.no_truncation()
            made.no_padding()
            self.lengths = lambda texts: [len(x) for x in made.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.cuts, self.lengths = False, lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            raise ValueError("a .json or a .model file is needed")
        self.known, self.taken = {}, 0

    def encoded(self, texts: list[str], batch: int = BATCH) -> list[int]:
        """Tokens of each text, encoded in as many batches as their bytes need, of nearly equal bytes."""
        upto = np.cumsum([len(x) for x in texts], dtype=np.int64)
        number = int(np.ceil(upto[-1] / batch))
        ends = np.unique(np.append(np.searchsorted(upto, upto[-1] * np.arange(1, number) / number) + 1, len(texts)))
        sizes, at = [], 0
        for end in ends.tolist():
            sizes += self.lengths(texts[at:end])
            at = end
        return sizes

    def count(self, texts: list[str], batch: int = BATCH, part: int = PART) -> list[int]:
        """Tokens of each text."""
        if not self.cuts:
            return self.encoded(texts, batch) if any(texts) else [0] * len(texts)
        cut = [parts(x, part) for x in texts]
        new = list(set(chain.from_iterable(cut)) - self.known.keys())
        if new:
            if self.taken > REMEMBERED:
                self.known, self.taken = {}, 0
                new = list(set(chain.from_iterable(cut)))
            self.known.update(zip(new, self.encoded(new, batch), strict=True))
            self.taken += sum(100 + len(x) for x in new)
        return [sum(map(self.known.__getitem__, row)) for row in cut]


_counters: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    if name not in _counters:
        _counters[name] = Counter(name)
    return _counters[name]


def _strings(column: pa.Array) -> list[str]:
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def token_counts(docs: DataFrame, name: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_bytes, n_tokens, over_limit); name is a file of public_tokenizers, or an absolute path that all executors have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = counter(name)
        for whole in batches:
            for batch in pieces(whole, "text"):
                n = np.array(worker.count(_strings(batch.column("text"))), np.int64)
                size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op12_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
