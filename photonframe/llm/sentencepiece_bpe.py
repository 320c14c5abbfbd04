"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly.

A text is cut into units (a run of word marks and what follows it up to the next run); no
piece of the vocabulary spans two units, so units are encoded on their own and repeated
units are encoded once per worker. In a unit, Aho-Corasick gives the pieces that start at
each place. Encoding takes the longest piece, checks that it and its left neighbour are
compatible, that is that merging their joined text again gives exactly the two, and goes
back to a shorter piece, or to an earlier place, if not. A bitfield marks places from which
no compatible rest exists, so each place is left for good at most once. The pieces found
are the only ones whose neighbours are all compatible, which is what merging gives.

Cases: null and empty texts encode to begin and end id only and decode to ""; characters
outside the vocabulary fall back to their UTF-8 bytes; bytes that are not UTF-8 decode to
U+FFFD each; very long texts and units take time linear in their length for each retry;
repeated rows give equal results; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import whole_texts

MARK = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a model file, by the library's reader."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.trainer_spec.model_type != 2 or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
        raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
    if any(p.type in (4, 5) or (p.type == 1 and MARK in p.piece.lstrip(MARK)) for p in model.pieces):
        raise ValueError("no piece may be user-defined or unused, or have a word mark after another character")
    return [(p.piece, p.score, p.type) for p in model.pieces]


class PieceCodec:
    """Encoder and decoder for one vocabulary; ``keep`` bounds the units remembered."""

    NORMAL, CONTROL, BYTE = 1, 3, 6

    def __init__(self, pieces: list[tuple[str, float, int]], keep: int = 1_500_000) -> None:
        self.pieces, self.keep = pieces, keep
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == self.NORMAL}
        self.score = {p: s for p, s, kind in pieces if kind == self.NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == self.BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.bos, self.eos = (next(i for i, x in enumerate(pieces) if x[0] == name) for name in ("<s>", "</s>"))
        self.letters = frozenset(p for p in self.ids if len(p) == 1)
        self.match = ahocorasick.Automaton()
        for p in self.ids:
            self.match.add_word(p, len(p))
        self.match.make_automaton()
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.units: dict[str, tuple[bytes, int, str]] = {}

    # ---- encoding
    def merge(self, text: str) -> list[str]:
        """Merging as the library does: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str | None, right: str) -> bool:
        """Whether merging the joined text gives the two (or the one) again."""
        if len(self.pairs) >= self.keep:
            self.pairs.clear()
        want = [right] if left is None else [left, right]
        known = self.pairs[left, right] = self.merge("".join(want)) == want
        return known

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all in the vocabulary."""
        n = len(text)
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, length in self.match.iter(text):  # by end, longer ones first: shorter last
            starts[end - length + 1].append(length)
        failed = bytearray(n + 1)  # 1: nothing compatible leads on from here
        pieces: list[str] = []
        choice: list[int] = []  # index into starts of the place before each piece
        at, nth, pairs = 0, len(starts[0]) - 1, self.pairs
        while at < n:
            lengths, left = starts[at], pieces[-1] if pieces else None
            while nth >= 0:
                end = at + lengths[nth]
                if not failed[end]:
                    piece = text[at:end]
                    known = pairs.get((left, piece))
                    if self.compatible(left, piece) if known is None else known:
                        break
                nth -= 1
            if nth >= 0:
                pieces.append(piece)
                choice.append(nth)
                at = end
                nth = len(starts[at]) - 1 if at < n else -1
            else:
                # All pieces before a place are compatible, so they are the only encoding of that
                # prefix: the place always has this left neighbour, and the mark is final.
                if not pieces:
                    raise ValueError("no encoding")
                failed[at] = 1
                at -= len(pieces.pop())
                nth = choice.pop() - 1
        return pieces

    def unit(self, unit: str) -> tuple[bytes, int, str]:
        """(ids as little-endian unsigned 32-bit integers, their number, decoded text)."""
        if self.letters.issuperset(unit):  # as nearly always
            pieces = self.backtrack(unit)
            return array("I", map(self.ids.__getitem__, pieces)).tobytes(), len(pieces), "".join(pieces).replace(MARK, " ")
        ids: list[int] = []
        for known, part in _runs(unit, self.ids):
            if known:
                ids += [self.ids[p] for p in self.backtrack(part)]
            else:
                ids += [self.byte_ids[b] for b in part.encode("utf-8")]
        return np.array(ids, "<u4").tobytes(), len(ids), self.surface(ids)

    def encode(self, text: str) -> tuple[bytes, int, str]:
        """Of a whole text with begin and end ids: ids, their number, the decoded text."""
        units = split_units(text)
        try:
            found = list(map(self.units.__getitem__, units))
        except KeyError:
            new = {u for u in units if u not in self.units}
            if len(self.units) + len(new) > self.keep:
                self.units.clear()
                new = set(units)
            self.units.update((u, self.unit(u)) for u in new)
            found = list(map(self.units.__getitem__, units))
        ids, counts, texts = zip(*found, strict=True) if found else ((), (), ())
        body = b"".join(ids)
        return np.array([self.bos], "<u4").tobytes() + body + np.array([self.eos], "<u4").tobytes(), sum(counts) + 2, "".join(texts)[1:]

    # ---- decoding
    def surface(self, ids: Iterable[int]) -> str:
        """Text of ids, word marks as spaces, byte ids as UTF-8; control ids have none."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if (b := self.bytes_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(_utf8(held))
                held.clear()
            piece, _, kind = self.pieces[i]
            if kind == self.NORMAL:
                out.append(piece)
            elif kind != self.CONTROL:
                out.append(" ⁇ ")
        if held:
            out.append(_utf8(held))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; the space that encoding puts in front goes."""
        ids = [i for i in ids if self.pieces[i][2] != self.CONTROL]
        text = self.surface(ids)
        return text[1:] if ids and self.pieces[ids[0]][0].startswith(MARK) else text


def _utf8(held: bytearray) -> str:
    """Valid sequences as characters, any other byte as U+FFFD."""
    out, at = [], 0
    while at < len(held):
        b = held[at]
        width = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        try:
            out.append(bytes(held[at : at + width]).decode("utf-8") if width else "�")
            at += width or 1
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def split_units(text: str) -> list[str]:
    """Runs of word marks, each with what follows it; the first one has the mark put in front."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return _UNITS.findall(MARK + text.replace(" ", MARK))
    return [MARK + w for w in text.split(" ")]


def _runs(unit: str, known: dict) -> Iterator[tuple[bool, str]]:
    """Maximal runs of characters inside or outside the vocabulary."""
    start, n = 0, len(unit)
    while start < n:
        inside, end = unit[start] in known, start + 1
        while end < n and (unit[end] in known) == inside:
            end += 1
        yield inside, unit[start:end]
        start = end


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One for each worker process."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(read_pieces(path))
    return _CODECS[path]


def encode_decode(docs: DataFrame, model: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document its ids and their decoded text; with ``digest`` the SHA-256 of both
    (ids as little-endian unsigned 32-bit integers) in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            counts, ids, texts = [], [], []
            for x in batch.column(1):
                raw, n, text = c.encode(x.as_py())
                counts.append(n)
                ids.append(hashlib.sha256(raw).hexdigest() if digest else np.frombuffer(raw, "<u4").astype("i8"))
                texts.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() if digest else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string() if digest else pa.list_(pa.int64())), pa.array(texts, pa.string())], names=names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
    texts = whole_texts(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<bigint>, decoded string"))
