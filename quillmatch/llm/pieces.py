"""SentencePiece encoding and decoding by the tokenizers library.

The model's protobuf is parsed here, and the normaliser, the metaspace marker, the pieces with their scores and the byte
fallback are rebuilt: a unigram model as such, a BPE model from the merges that its pieces and scores imply. Texts are
encoded in batches on several threads, decoded again, and held against the sentencepiece library, id by id.

Defined results: null and empty texts have no ids, round trip true; rows stay as they are, repeated ones included;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bytescan import pieces as slices
from .common import table

MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> dict[int, list]:
    """The fields of one protobuf message: numbers, four-byte groups and byte strings by field number."""
    found, at = defaultdict(list), 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            found[tag >> 3].append(number())
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = number() if size is None else size
        found[tag >> 3].append(data[at : at + size])
        at += size
    return found


class Model:
    """What a sentencepiece model file says."""

    def __init__(self, data: bytes):
        top = fields(data)
        self.pieces: list[tuple[str, float, int]] = []
        for raw in top[1]:
            f = fields(raw)
            self.pieces.append((f[1][0].decode(), struct.unpack("<f", f[2][0])[0] if f[2] else 0.0, f[3][0] if f[3] else NORMAL))
        trainer, norm = fields(top[2][0]) if top[2] else {}, fields(top[3][0]) if top[3] else {}
        flag = lambda message, k, default: bool(message.get(k, [default])[0])
        self.kind = trainer.get(3, [UNIGRAM])[0]
        self.byte_fallback = flag(trainer, 35, 0)
        if flag(trainer, 24, 0):
            raise ValueError("models that mark white space as a suffix are not supported")
        self.charsmap = norm.get(2, [b""])[0]
        self.prefix, self.squeeze, self.escape = flag(norm, 3, 1), flag(norm, 4, 1), flag(norm, 5, 1)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs that give a piece, in the order in which sentencepiece would merge them if both were there.

        That order is by score. Pieces of one score merge from the left on, and what has just grown goes on growing:
        among them, the pair with the longer left part comes first.
        """
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        found = [(-self.pieces[i][1], -cut, i, p[:cut], p[cut:]) for p, i in ids.items() for cut in range(1, len(p)) if p[:cut] in ids and p[cut:] in ids]
        return [(a, b) for *_, a, b in sorted(found)]


def normalizer(model: Model):
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def tokenizer(model: Model):
    """The model for texts that are normalised already. Decoding leaves markers as they are, unless the model spells them out in bytes."""
    from tokenizers import Tokenizer, decoders, models

    vocab = [p for p, _, _ in model.pieces]
    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE({p: i for i, p in enumerate(vocab)}, model.merges(), unk_token=vocab[unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    out = Tokenizer(core)
    out.decoder = decoders.Sequence([*([] if MARK in vocab else [decoders.Replace(MARK, " ")]), decoders.ByteFallback(), decoders.Fuse()])
    out.encode_special_tokens = True
    return out


class _Grown:
    """An array that grows at its end without being copied each time."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(1024, kind), 0

    def extend(self, more) -> None:
        to = self.size + len(more)
        if to > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(to, self.data.dtype)])
        self.data[self.size : to] = more
        self.size = to


class Coder:
    """Encodes and decodes lists of texts; made once in each worker.

    Where no piece goes on beyond a word, texts are cut before each run of markers. A part is then encoded and decoded
    once, and remembered, for the ids of a text are those of its parts. New parts of a BPE model are encoded many in a row, which
    costs less than each alone.
    """

    #: Bytes of remembered parts and ids, about, beyond which all are forgotten before the next slice of texts.
    BYTES = 128 << 20
    #: So many new parts go to the library as one text.
    JOINED = 200

    def __init__(self, data: bytes, threads: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        if threads:
            os.environ["RAYON_NUM_THREADS"] = str(threads)
        self.data, self.model = data, Model(data)
        self.tokenizer, self.normalizer = tokenizer(self.model), normalizer(self.model)
        self.plain = not self.model.charsmap and not self.model.squeeze
        self.splits = not any(MARK in p.lstrip(MARK) for p, _, _ in self.model.pieces) and self.model.escape
        self.part = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if self.splits else r"(?s:.+)")
        self.marked = MARK in (p for p, _, _ in self.model.pieces)
        #: Merges of one part never depend on another's; sums of scores could, by their rounding.
        self.joins = self.splits and self.marked and self.model.kind == BPE
        self.opens = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.taken = 0
        self.pool, self.ends, self.fine = _Grown(np.int32), _Grown(np.int64), _Grown(bool)
        self.ends.extend([0])

    def normalized(self, text: str) -> str:
        if not self.plain:
            return self.normalizer.normalize_str(text)
        text = " " + text if self.model.prefix and text else text
        return text.replace(" ", MARK) if self.model.escape else text

    def _learn(self, new: list[str]) -> None:
        """Adds parts: their ids to the pool, and whether decoding these gives the part again."""
        if self.joins:
            one = [x for x in new if x.rfind(MARK) == 0]  # a marker in front and no other: only its first piece begins with one
            new = one + [x for x in new if x.rfind(MARK) != 0]
            ids = self._joined(one) + self._alone(new[len(one) :])
        else:
            ids = self._alone(new)
        back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ends.extend(self.pool.size + np.cumsum(size))
        self.pool.extend(np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())))
        self.fine.extend([(a if self.marked else a.replace(MARK, " ")) == b for a, b in zip(new, back, strict=True)])
        self.taken += 4 * int(size.sum()) + sum(128 + 2 * len(x) for x in new)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))

    def _alone(self, parts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _joined(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts that begin with their only marker: of many in a row, cut at the pieces that begin with one."""
        out = []
        rows = [parts[k : k + self.JOINED] for k in range(0, len(parts), self.JOINED)]
        for row, ids in zip(rows, self._alone(["".join(row) for row in rows]), strict=True):
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(row):
                out += [ids[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(ids)], strict=True)]
            else:
                out += self._alone(row)
        return out

    def encode_and_back(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after the other, each text's number of ids, and whether they decode to the text."""
        if self.taken > self.BYTES:
            self._forget()
        which, count, same = self._words(texts) if self.plain and self.splits else self._parts(texts)
        begin, size = self.ends.data[which], self.ends.data[which + 1] - self.ends.data[which]
        ids = self.pool.data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        text = np.repeat(np.arange(len(texts)), count)
        total = np.bincount(text, size, len(texts)).astype(np.int64)
        wrong = np.bincount(text, ~self.fine.data[which], len(texts)) > 0
        return ids, total, ~wrong & same

    def _numbers(self, parts: list[str]) -> np.ndarray:
        """The number of each part; those that are new are learnt."""
        if new := list(dict.fromkeys(x for x in parts if x not in self.known)):
            self._learn(new)
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def _parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of all parts, each text's number of parts, and whether the normalised text stands for the text itself."""
        normal = [self.normalized(x) for x in texts]
        parts = [self.part.findall(x) for x in normal]
        same = [self.cut(x.replace(MARK, " ")) == y for x, y in zip(normal, texts, strict=True)]
        return self._numbers(list(chain.from_iterable(parts))), np.fromiter(map(len, parts), np.int64, len(parts)), np.array(same, bool)

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _parts, for models that turn spaces into markers and change nothing else. Texts are cut by Arrow; only different words become strings.

        A part is a word and the markers since the word before it, or the markers at a text's end.
        """
        given = pa.array(texts, pa.large_string())
        spaced = pc.replace_substring(given, MARK, " ")
        same = pc.equal(given, spaced).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(spaced, " ")
        cells = cut.flatten().dictionary_encode()
        word = cells.indices.to_numpy().astype(np.int64)
        names = cells.dictionary.to_numpy(zero_copy_only=False).tolist()
        size = np.diff(cut.offsets.to_numpy())
        first = np.cumsum(size) - size
        text = np.repeat(np.arange(len(texts)), size)
        at = np.arange(len(word))
        blank = word == (names.index("") if "" in names else -1)
        # the last word before each cell; with a marker in front of the text, its first cell has one marker before it
        last = np.maximum.accumulate(np.where(blank, -1, at))
        last = np.append(-1, last[:-1])[: len(word)]
        begin = first[text] - (self.model.prefix & (np.array([bool(x) for x in texts], bool)[text]))
        marks = at - np.maximum(last, begin)
        keep = ~blank
        ends = first + size - 1
        keep[ends] |= marks[ends] > 0
        text, word, marks = text[keep], word[keep], marks[keep]
        count = np.bincount(text, minlength=len(texts))
        which = np.zeros(len(word), np.int64)
        plain = marks == 1
        used = np.zeros(len(names), bool)
        used[word[plain]] = True
        used = np.flatnonzero(used)
        number = np.zeros(len(names), np.int64)
        number[used] = self._numbers([MARK + names[w] for w in used.tolist()])
        which[plain] = number[word[plain]]
        other, back = np.unique(marks[~plain] * len(names) + word[~plain], return_inverse=True)
        which[~plain] = self._numbers([MARK * (x // len(names)) + names[x % len(names)] for x in other.tolist()])[back]
        return which, count, same

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, total, _ = self.encode_and_back(texts)
        return [x.tolist() for x in np.split(ids, np.cumsum(total)[:-1])] if texts else []

    def cut(self, text: str) -> str:
        return text[1:] if self.model.prefix and text[:1] == " " else text

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.cut(x.replace(MARK, " ") if self.marked else x) for x in self.tokenizer.decode_batch(ids, skip_special_tokens=False)]

    def expected(self, texts: list[str]) -> list[np.ndarray]:
        from sentencepiece import SentencePieceProcessor

        if not hasattr(self, "processor"):
            self.processor = SentencePieceProcessor(model_proto=self.data)
        return [self.processor.encode(x, return_type="numpy") for x in texts]


_coders: dict[str, Coder] = {}


def coder(data: bytes) -> Coder:
    key = hashlib.sha256(data).hexdigest()
    if key not in _coders:
        _coders[key] = Coder(data, 2)
    return _coders[key]


def encoded(docs: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, and ids, n_tokens, round_trip (decoding gives the text again) and parity (the ids are sentencepiece's)."""
    with open(model, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())  # one model file, whatever the input
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = coder(shipped.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                ids, n, back = worker.encode_and_back(texts)
                begin = np.concatenate([[0], np.cumsum(n)])
                expected = worker.expected(texts)
                parity = [len(x) == n[k] and np.array_equal(ids[begin[k] : begin[k + 1]], x) for k, x in enumerate(expected)]
                rows = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids))
                made = [rows, pa.array(n), pa.array(back), pa.array(parity, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], [*keep, "ids", "n_tokens", "round_trip", "parity"])

    schema = f"{kinds}, ids array<int>, n_tokens long, round_trip boolean, parity boolean"
    return docs.select(*keep, "text").mapInArrow(run, schema)


def op2_pieces(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: every document's ids, with its id, language and source."""
    return encoded(docs, keep=("doc_id", "lang", "source"))
