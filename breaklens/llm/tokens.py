"""Token ids of whole texts, by a tokenizers vocabulary file, with a bounded memo of chunks."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breaklens.llm.words import small_batches
from breaklens.session import ship_package

#: Chunks of one generation of a worker's memo; it keeps two.
MEMO_CHUNKS = 400_000
#: Characters that are split into chunks at a time.
CHARS = 1 << 20

#: One word of Latin letters, maybe with a blank or line end before and punctuation behind.
_PLAIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%#*$&|]*)")
#: White space besides blank and line end.
_RARE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\0]")
_BETWEEN = re.compile(r"(?<=\S)(?=[ \n]\S)")


def _with_space(text: str) -> list[str]:
    """Keys of the chunks of a text that a byte-level vocabulary encodes one by one.

    Its pre-tokens take one space before a word along, or runs of white space
    alone; where one blank or line end stands between two other characters,
    a pre-token starts at it, whatever stands around. A key is a chunk without
    its leading blank; ``\\0`` before it tells that there is none, nor a line end.
    """
    if ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace()
            or _RARE.search(text)):
        return ["\0" + c for c in _BETWEEN.split(text)]
    parts = text.replace("\n", " \n").split(" ")
    parts[0] = "\0" + parts[0]
    return parts


def _literal(key: str) -> str:
    return key[1:] if key[0] == "\0" else key if key[0] == "\n" else " " + key


def _without_space(text: str) -> list[str]:
    """Chunks for a vocabulary that drops white space: no pre-token holds a blank or line end."""
    return text.replace("\n", " ").split(" ")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte (as a Latin-1 character):
    printable ones stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """Ids of chunks, made when first asked for, in two generations.

    A full generation becomes the old one, and the one before goes; what is
    asked for again moves over from the old one. So frequent chunks stay.
    """

    def __init__(self, make, most: int) -> None:
        self._make, self._most, self._old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        ids = self._old.get(key)
        if ids is None:
            ids = self._make(key)
        if len(self) >= self._most:
            self._old = dict(self)
            self.clear()
        self[key] = ids
        return ids


class ChunkEncoder:
    """Encodes texts chunk by chunk; ids equal those of the whole text.

    A new chunk that is one plain word is split here into its pre-tokens, and
    only the vocabulary's merges run on them; any other goes through the whole
    tokenizer.

    Strings of special tokens inside a text are ordinary text. A chunk is
    encoded once as long as the memo keeps it, which is what makes long
    corpora of recurring words cheap.
    """

    def __init__(self, path: str, memo_chunks: int = MEMO_CHUNKS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True
        self._memo = _Memo(self._new, memo_chunks)
        self._lower = self._tok.normalizer is not None
        self._split = _without_space if self._lower else _with_space
        self.vocab_size = self._tok.get_vocab_size()
        self._letters = _byte_letters()

    def _merged(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        letters = piece.encode().decode("latin-1").translate(self._letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self._tok.model.tokenize(letters)])

    def _new(self, key: str) -> bytes:
        """Ids of a chunk; pre-tokens of a plain word with something around it are looked up by themselves."""
        text = key if self._lower else key and _literal(key)
        if not text:
            return b""
        m = _PLAIN.fullmatch(text)
        if m is None:
            return b"".join([x.to_bytes(4, "little") for x in self._tok.encode(text, add_special_tokens=False).ids])
        lead, word, marks = m.groups()
        if self._lower:
            low = word.lower()
            if marks:
                return self._memo[low] + self._memo[marks]
            return self._merged(low) if low == word else self._memo[low]
        if lead == "\n":
            return self._memo["\0\n"] + self._memo["\0" + word + marks]
        if marks:
            return self._memo[word if lead else "\0" + word] + self._memo["\0" + marks]
        return self._merged(text)

    def encode(self, texts: Iterator[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        get = self._memo.__getitem__
        for t in texts:
            if len(t) > 2 * CHARS:
                yield b"".join(b"".join(map(get, self._split(p))) for p in _pieces(t))
            else:
                yield b"".join(map(get, self._split(t))) if t else b""


def _pieces(text: str) -> Iterator[str]:
    """A very long text cut where a chunk starts, about every ``CHARS`` characters."""
    at = 0
    cut = re.compile(r"(?<=\S)[ \n](?=\S)")
    while at < len(text):
        m = cut.search(text, at + CHARS)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


@functools.cache
def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker and vocabulary."""
    return ChunkEncoder(path)


def encoding(tokenizer_path: str, end_id: int):
    """The function of a task that turns batches of (id, text) into batches of (id, ids)."""
    tail = end_id.to_bytes(4, "little")

    def run(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            texts = (x.as_py() for x in pc.fill_null(batch.column(1), ""))
            held, size, lo = [], 0, 0
            for ids in enc.encode(texts):
                held.append(ids + tail)
                size += len(ids)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, len(held)), pa.array(held, pa.binary())], names=["id", "ids"])
                    lo, held, size = lo + len(held), [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, len(held)), pa.array(held, pa.binary())], names=["id", "ids"])

    return run


def encode_texts(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (binary: little-endian unsigned 32-bit ids of the
    whole text, then ``end_id``) for every row, in the order of the input.

    A null or empty text is ``end_id`` alone. Other columns are not looked at.
    """
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(encoding(tokenizer_path, end_id), f"id {kind}, ids binary").withColumnRenamed("id", id_col))
