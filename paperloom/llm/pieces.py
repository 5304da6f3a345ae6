"""SentencePiece encoding and decoding on the tokenizers library, from the model's protobuf."""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the SentencePiece model format: piece kinds, model kinds, the space marker.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"
#: Parts of texts whose ids a worker remembers, twice over; longer ones are not remembered.
REMEMBERED, LONGEST = 400_000, 64


def wire(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protobuf message: numbers with ints, floats (as 4 bytes) or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + n]
            at += n
        yield key >> 3, value


@dataclass
class Model:
    """What of a SentencePiece model bears on encoding; the defaults are the format's."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_spaces: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls()
        for number, value in wire(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in wire(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                model.pieces.append((piece, score, kind))
            elif number == 2:
                spec = dict(wire(value))
                model.kind, model.byte_fallback, model.suffix_spaces = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(wire(value))
                model.charsmap, model.dummy_prefix = spec.get(2, b""), bool(spec.get(3, 1))
                model.remove_extra, model.escape = bool(spec.get(4, 1)), bool(spec.get(5, 1))
        return model

    @property
    def splits_at_spaces(self) -> bool:
        """Whether no piece holds a space marker behind another character.

        Then no piece and no merge reaches over the start of a run of markers, so the parts
        between such starts can be encoded one by one.
        """
        known = {p for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED)}
        return SPACE in known and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in known)


def library_tokenizer(model: Model):
    """The model on the tokenizers library: normaliser, space marker, scores or merges, byte fallback, decoder."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if model.suffix_spaces or not model.escape:
        raise NotImplementedError("models with space suffixes or unescaped spaces")
    unk = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)
    if model.kind == UNIGRAM:
        # As in the format, an unused or control piece is never a result.
        worst = min(s for _, s, _ in model.pieces) - 100
        core = models.Unigram([(p, s if kind in (NORMAL, USER_DEFINED, UNKNOWN, BYTE) else worst) for p, s, kind in model.pieces], unk, model.byte_fallback)
    elif model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        usable = {p: (s, i) for i, (p, s, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
        # The format merges the pair whose union scores best; the library, the pair of least rank.
        merges = [(-s, i, p[:k], p[k:]) for p, (s, i) in usable.items() for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        core = models.BPE(vocab, [(a, b) for _, _, a, b in sorted(merges)], unk_token=model.pieces[unk][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise NotImplementedError("word and character models")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(SPACE)] if model.dummy_prefix else []
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    tokenizer.decoder = decoders.Sequence([*decoder_steps(model), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    own = [AddedToken(p, normalized=True) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    return tokenizer


def decoder_steps(model: Model) -> list:
    """From pieces to text; the space of a dummy prefix is still there."""
    from tokenizers import decoders

    return [decoders.Replace(SPACE, " "), *([decoders.ByteFallback()] if model.byte_fallback else []), decoders.Fuse()]


class _Parts(dict):
    """Ids by word; those of a word that is not there are asked of ``learn``."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        return self.learn(word)


class PieceCoder:
    """Encodes and decodes batches, and checks the library against SentencePiece itself.

    Where the vocabulary allows (``splits_at_spaces``) a text is normalised, cut before each
    run of space markers, and each distinct part is encoded and decoded once; a text's ids
    and its decoded text are those of its parts.  A part is known by its word: without the
    marker it begins with, or, where a text begins without one, behind a space.
    ``parity`` says of each text whether SentencePiece gives the whole text the same ids.
    """

    def __init__(self, path: str, threads: int = 2, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece
        from tokenizers import decoders

        with open(path, "rb") as file:
            self.model = Model.parse(file.read())
        self.full = library_tokenizer(self.model)
        self.bare = library_tokenizer(self.model)
        self.bare.normalizer = None
        self.bare.decoder = decoders.Sequence(decoder_steps(self.model))
        self.core = self.bare.model  # all that is left of it: parts go there without an encoding's other fields
        self.pieces = [p for p, _, _ in self.model.pieces]
        self.judge = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = not any(kind == USER_DEFINED for _, _, kind in self.model.pieces)
        self.by_part = self.model.splits_at_spaces and plain
        # Normalising does no more than write markers for spaces.
        self.marks_only = not self.model.charsmap and not self.model.remove_extra
        self.remembered = remembered
        self.parts = _Parts(self.learn)  # ids of parts, by word, as of late
        self.before: dict[str, bytes] = {}  # and of the time before
        self.changed: dict[str, str] = {}  # what parts decode to, where that is not the part
        self.passing: list[str] = []  # parts that are too long to be remembered

    def cut(self, text: str) -> list[str]:
        """The words of a text's parts."""
        if not text:
            return []
        if self.marks_only and SPACE not in text and "  " not in text and text[0] != " ":
            words = text.split(" ")
            if not self.model.dummy_prefix:
                words[0] = " " + words[0]
            return words
        parts = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", self.full.normalizer.normalize_str(text))
        return [p[1:] if p[0] == SPACE else " " + p for p in parts]

    def learn(self, word: str) -> bytes:
        """The ids of a word that is not among those of late, where they are now.

        Pieces that join to the part decode to it, but for what reads like a byte's piece;
        any other part is decoded by the library.
        """
        ids = self.before.get(word)
        if ids is None:
            bare = word[:1] == " "
            part = word[1:] if bare else SPACE + word
            if len(word) > LONGEST:  # tokens of a whole text at once would take more memory
                found = self.bare.encode_batch_fast([part], add_special_tokens=False)[0].ids
            else:
                found = [t.id for t in self.core.tokenize(part)]
            ids = array("I", found).tobytes()
            if "<0x" in part or "".join([self.pieces[i] for i in found]) != part:
                text = self.bare.decode(found, skip_special_tokens=False)
                if text != part.replace(SPACE, " "):
                    self.changed[word] = " " + text if bare else text[1:]
        self.parts[word] = ids
        if len(word) > LONGEST:
            self.passing.append(word)
        return ids

    def forget(self) -> None:
        """What is remembered has a bound in bytes: long parts go.

        Beyond ``remembered`` parts those of late become those before, and what was before
        and not met since is forgotten; so frequent parts stay, whatever comes between.
        """
        for word in self.passing:
            del self.parts[word]
            self.changed.pop(word, None)
        self.passing.clear()
        if len(self.parts) > self.remembered:
            self.before, self.parts = self.parts, _Parts(self.learn)
            self.changed = {w: text for w, text in self.changed.items() if w in self.before}

    def code_batch(self, texts: list[str]) -> tuple[list[bytes], list[str], list[bool]]:
        """Little-endian 32-bit ids, decoded text, and parity, of each text."""
        judged = [x.tobytes() for x in self.judge.encode(texts, num_threads=1, return_type="numpy")]  # no list of numbers
        if not self.by_part:
            found = [e.ids for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]
            ids, decoded = [array("I", x).tobytes() for x in found], self.full.decode_batch(found, skip_special_tokens=False)
            return ids, decoded, [x == y for x, y in zip(ids, judged, strict=True)]
        ids, decoded = [], []
        for text in texts:
            words = self.cut(text)
            ids.append(b"".join(map(self.parts.__getitem__, words)))
            decoded.append(self._told(words))
        self.forget()
        return ids, decoded, [x == y for x, y in zip(ids, judged, strict=True)]

    def _told(self, words: list[str]) -> str:
        told = words if self.changed.keys().isdisjoint(words) else [self.changed.get(w, w) for w in words]
        text = " ".join(told).replace(SPACE, " ")
        if self.model.dummy_prefix or not words:
            return text
        return text[1:] if words[0][:1] == " " else " " + text

    def encode_batch(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        ids, _, same = self.code_batch(texts)
        return ids, same

    def decode_batch(self, ids: list[bytes]) -> list[str]:
        return self.full.decode_batch([memoryview(x).cast("I").tolist() for x in ids], skip_special_tokens=False)


_coders: dict[str, PieceCoder] = {}


def code_pieces(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", batch_chars: int = 1 << 20) -> DataFrame:
    """Encodes every whole text with a SentencePiece model, decodes it again and checks parity.

    The model's protobuf is parsed and rebuilt on the tokenizers library; texts go there in
    batches of about ``batch_chars`` characters.  No shuffle: a row in, a row out, whatever
    its id, null or repeated.  Null texts are empty, with no pieces; a text longer than a
    batch is a batch of its own, whole.  Returns ``doc_id, n_pieces, ids_crc32`` (of the ids
    as little-endian unsigned 32-bit integers), ``ids``, ``decoded, round_trip`` (decoded =
    text, but for what the model's normaliser changes) and ``parity``: whether SentencePiece
    itself gives the whole text these ids, asked for every text.  Other columns are ignored,
    whatever their names.  An empty table gives an empty table.
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    shape = "doc_id long, n_pieces long, ids_crc32 long, ids binary, decoded string, round_trip boolean, parity boolean"
    return rows.mapInArrow(lambda it: _coded(it, model, batch_chars), shape)


def _coded(batches: Iterator[pa.RecordBatch], path: str, batch_chars: int) -> Iterator[pa.RecordBatch]:
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    coder = _coders[path]
    for batch in batches:
        texts, first = batch["text"].to_pylist(), 0
        while first < len(texts):
            last, chars = first, 0
            while last < len(texts) and (chars == 0 or chars + len(texts[last]) <= batch_chars):
                chars += len(texts[last]) + 1
                last += 1
            part = texts[first:last]
            ids, decoded, parity = coder.code_batch(part)
            yield pa.record_batch({
                "doc_id": batch["doc_id"][first:last], "n_pieces": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.string()),
                "round_trip": pa.array([x == y for x, y in zip(decoded, part, strict=True)], pa.bool_()), "parity": pa.array(parity, pa.bool_()),
            })
            first = last


def digest(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", "n_pieces", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip", "parity")
