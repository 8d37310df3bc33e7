"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read as a protobuf message without a protobuf library: pieces with scores and types, the
trainer's kind of model and byte fallback, and the normaliser's character map and white-space rules. From
these the same tokenizer is rebuilt in the tokenizers library: normaliser, the metaspace mark (U+2581) for
spaces and the prefix, a unigram model with the pieces' scores or, for a BPE model, merges ranked by the
scores, byte fallback, and the inverse decoder. Batches are encoded and decoded by several threads.

Where no piece holds a metaspace after another character, a text is cut before every run of
metaspaces, and where none goes on after a letter with an ASCII sign or digit, between those; merges and paths
cannot cross such a cut. Short pieces of text are met again and again, so
each distinct one of a batch goes through the library once, and a worker keeps a bounded number of results.

Parity with the sentencepiece library is verified for a set of hard texts whenever a codec is built, and for every
text on the way; a difference is told in the column ``parity``. Every distinct piece of text is decoded again, and every
text's ids are decoded whole by the sentencepiece library; ``roundtrip`` tells whether both give the normalised text.

Null texts give null ids and null flags; empty texts give no ids. Repeated rows are encoded alike; an empty
table gives an empty result; other columns are not read. Texts are encoded whole, and marks such as ``<s>`` in a text are
plain text.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_worker, steps, table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
THREADS, STEP = 2, 500_000
#: Pieces of text that a worker keeps encoded, and the longest that it keeps.
KEPT, KEPT_CHARS = 600_000, 64
HARD = ["", " ", "  two  spaces ", "a\tb\nc\r\n", "Grüße, señor – déjà vu", "日本語のテキスト", "😀 emoji \U0001f9d1‍\U0001f680", "<s> </s> <unk> <0x41>", f"x{MARK}y {MARK}", "1234567890 3.14", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ﬁ ½ ① Ａ", "\u0000\u0001", "é   　 x", "!!??..,,;;::", "don't can't"]


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message: integers, or the bytes of other kinds."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind in (1, 5) else varint()
        yield number, data[at : at + size]
        at += size


@dataclass
class SpmModel:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    drop_extra_spaces: bool = True
    escape_spaces: bool = True
    space_suffix: bool = False

    @classmethod
    def parse(cls, data: bytes) -> "SpmModel":
        m = cls()
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                m.pieces.append((own.get(1, b"").decode("utf-8"), score, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(fields(value))
                m.kind, m.byte_fallback, m.space_suffix = own.get(3, UNIGRAM), bool(own.get(35, 0)), bool(own.get(24, 0))
            elif number == 3:
                own = dict(fields(value))
                m.charsmap, m.dummy_prefix, m.drop_extra_spaces, m.escape_spaces = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
        return m

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def cuts(self) -> bool:
        """Whether texts may be cut before runs of marks: no piece has one after another character."""
        return not any(MARK in p.lstrip(MARK) for p, _, _ in self.pieces)


#: Where no piece goes on after a letter with an ASCII sign or digit, a text may be cut there as well as before marks.
#: Letters here are those of Latin, Greek and Cyrillic scripts.
SIGN, LETTER = r"\x00-@\[-`{-\x7f", r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0370-\u03ff\u0400-\u052f]"
GOES_ON = rf"(?:(?!(?<={LETTER})[{SIGN}])[^{MARK}])*"
FINE = re.compile(rf"{MARK}*[{SIGN}]*{LETTER}+(?=[{MARK}{SIGN}]|\Z)|{MARK}+{GOES_ON}|[^{MARK}]{GOES_ON}")
COARSE = re.compile(rf"{MARK}+[^{MARK}]*|[^{MARK}]+")


def cutter(model: SpmModel) -> re.Pattern | None:
    """How texts may be cut into pieces that are encoded one by one, by the model's pieces; None: not at all."""
    if not model.cuts():
        return None
    return COARSE if any(re.search(rf"{LETTER}[{SIGN}]", p) for p, _, t in model.pieces if t in (NORMAL, USER)) else FINE


def merges(model: SpmModel) -> list[tuple[str, str]]:
    """All ways to make a piece of two, best piece first."""
    ids = {p: i for i, (p, _, t) in enumerate(model.pieces) if t in (NORMAL, USER)}
    found = []
    for piece, i in ids.items():
        for k in range(1, len(piece)):
            a, b = piece[:k], piece[k:]
            if a in ids and b in ids:
                found.append((-model.pieces[i][1], i, ids[a], ids[b], a, b))
    found.sort()
    return [(x[4], x[5]) for x in found]


def build(model: SpmModel):
    """The tokenizers-library tokenizer of a model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind not in (UNIGRAM, BPE) or model.space_suffix or not model.escape_spaces:
        raise ValueError("only unigram and BPE models with leading space marks are supported")
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    else:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    norm = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.drop_extra_spaces:
        norm += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        norm.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*norm, normalizers.Replace(" ", MARK)])
    if model.cuts():
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), *([decoders.ByteFallback()] if model.byte_fallback else []), decoders.Fuse(), *tail])
    out.add_tokens([AddedToken(p, normalized=False) for p, _, t in model.pieces if t == USER])
    return out


class Codec:
    """Encode and decode with a rebuilt tokenizer; compare with the sentencepiece library."""

    def __init__(self, data: bytes, threads: int = THREADS):
        # read when the library's pool starts, in this process
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        self.model = SpmModel.parse(data)
        self.fast = build(self.model)
        self.piece = cutter(self.model)
        self.bare = build(self.model)  # for pieces that are normalised and cut already
        self.bare.normalizer, self.bare.pre_tokenizer = None, None
        self.kept: dict[str, bytes] = {}  # ids as 32-bit integers
        self.broken: set[str] = set()  # pieces that do not decode to themselves
        self.slow = sentencepiece.SentencePieceProcessor(model_proto=data)
        first = min((i for i, p in enumerate(self.model.pieces) if p[2] == BYTE), default=0)
        self.bytes = (first, first + 256) if self.model.byte_fallback else (0, 0)

    def encode_whole(self, texts: list[str]) -> list[list[int]]:
        """Each text through the library as it is."""
        return [e.ids for e in self.fast.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str]:
        m = self.model
        if m.charsmap or m.drop_extra_spaces:
            norm = self.fast.normalizer.normalize_str(text)
        else:
            norm = (MARK if m.dummy_prefix and text else "") + text.replace(" ", MARK)
        return self.piece.findall(norm)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether they decode to the normalised text; equal to ``encode_whole``."""
        if self.piece is None or any(t == USER for _, _, t in self.model.pieces):
            ids = self.encode_whole(texts)
            return [np.array(x, np.int32) for x in ids], [b == self.normalised(t) for t, b in zip(texts, self.decode(ids), strict=True)]
        cut = [self.pieces(t) for t in texts]
        if len(self.kept) > KEPT:
            self.kept, self.broken = {}, set()
        new = [c for c in set(chain.from_iterable(cut)) if c not in self.kept]
        got = [e.ids for e in self.bare.encode_batch_fast(new, add_special_tokens=False)]
        self.kept.update((c, array("i", x).tobytes()) for c, x in zip(new, got, strict=True))
        back = self.decode(got)
        bad = {c for c, b in zip(new, back, strict=True) if b != c.replace(MARK, " ")[int(self.model.dummy_prefix and c[0] == MARK) :]}
        self.broken |= bad
        ids = [np.frombuffer(b"".join(map(self.kept.__getitem__, c)), np.int32) for c in cut]
        same = [not self.broken or self.broken.isdisjoint(c) for c in cut]
        for c in new:
            if len(c) > KEPT_CHARS:
                del self.kept[c]
                self.broken.discard(c)
        return ids, same

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.fast.decode_batch(ids, skip_special_tokens=False)

    def normalised(self, text: str) -> str:
        """What decoding gives back."""
        if not (self.model.charsmap or self.model.drop_extra_spaces):  # only spaces and marks are written anew
            return text.replace(MARK, " ")
        t = self.fast.normalizer.normalize_str(text).replace(MARK, " ")
        return t[1:] if self.model.dummy_prefix and t else t

    def verify(self, texts: list[str]) -> list[str]:
        """The texts that the two libraries encode unlike."""
        want = self.slow.encode(texts, num_threads=1)
        return [t for t, *ids, w in zip(texts, [x.tolist() for x in self.encode(texts)[0]], self.encode_whole(texts), want, strict=True) if ids != [w, w]]


def encoded(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", threads: int = THREADS) -> DataFrame:
    """(id, ids, n_tokens, n_bytes, roundtrip, parity), one row per row; n_bytes counts byte-fallback tokens."""
    if wrong := Codec(model, threads).verify(HARD):
        raise ValueError(f"the rebuilt tokenizer differs from sentencepiece on {wrong[:3]!r}")
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(("codec", zlib.crc32(shared.value), threads), lambda: Codec(shared.value, threads))
        low, high = codec.bytes
        for batch, texts in steps(batches, limit=STEP):
            ids, same = codec.encode(texts)
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate([*ids, np.zeros(0, np.int32)])
            edges = np.concatenate([[0], np.cumsum(lens)])
            fallback = np.concatenate([[0], np.cumsum((flat >= low) & (flat < high))])
            wanted = codec.slow.encode(texts, num_threads=1)
            parity = [len(w) == len(own) and array("i", w).tobytes() == own.tobytes() for w, own in zip(wanted, ids, strict=True)]
            # equal ids are decoded as they came
            lists = [w if p else own.tolist() for w, own, p in zip(wanted, ids, parity, strict=True)]
            same = [s and b == codec.normalised(t) for s, b, t in zip(same, codec.slow.decode(lists, num_threads=1), texts, strict=True)]
            null = np.asarray(batch.column(1).is_null())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat), mask=pa.array(null)) if len(texts) else pa.array([], pa.list_(pa.int32())),
                pa.array(lens, mask=null), pa.array(fallback[edges[1:]] - fallback[edges[:-1]], mask=null),
                pa.array(np.array(same, bool), mask=null), pa.array([None if n else p for n, p in zip(null, parity, strict=True)], pa.bool_()),
            ], names=[id_col, "ids", "n_tokens", "n_bytes", "roundtrip", "parity"])

    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_tokens long, n_bytes long, roundtrip boolean, parity boolean")


def decoded(df: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids", threads: int = THREADS) -> DataFrame:
    """(id, text) of encoded rows; null ids give null texts."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(("codec", zlib.crc32(shared.value), threads), lambda: Codec(shared.value, threads))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids = part.column(1).to_pylist()
                texts = codec.decode([x or [] for x in ids])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else t for x, t in zip(ids, texts, strict=True)], pa.string())], names=[id_col, "text"])

    return df.select(id_col, F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")


def model_bytes(path: str | None = None) -> bytes:
    """A model file's bytes; read by the driver, a few hundred kilobytes that are broadcast."""
    with open(path or os.environ.get("RECOLLECT_SPM_MODEL", MODEL_PATH), "rb") as f:
        return f.read()


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), model_bytes())
