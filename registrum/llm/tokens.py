"""Exact token ids and counts of whole texts, as the tokenizers library gives them.

Texts are cut where the pre-tokenizer always cuts: before white space that follows a visible character. Pieces recur, so
their ids are kept in a bounded cache, and a piece not yet seen goes to the library. Huge documents go to the library in
overlapping chunks whose encodings are spliced by offsets (encode_long).

Why a splice is exact: the pre-tokenizer scans to the right and looks at most one character ahead, so two scans that both
start a pre-token at p agree from p on. A start of a pre-token that both chunks show is such a p, if it lies before the end
of the left chunk by more than the longest special string, which the end may have cut. If the overlap shows none, it is
doubled, up to encoding both chunks as one.
"""

from __future__ import annotations

import array
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from registrum.llm.common import batches, doc_texts, documents, release

#: Characters of a chunk and of the overlap at first; texts over CHUNK are encoded in chunks.
CHUNK, OVERLAP = 16_384, 512
#: Entries a cache takes at most; later pieces are encoded anew.
CACHE = 250_000
LIMIT = 1024

#: White space beyond ASCII, or what some engines count as such: such texts are not cut.
_ODD_SPACE = re.compile("[" + "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]")
_PIECE = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_VISIBLE = re.compile(r"[^\t-\r ]+")
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\t-\r ]*[!-~{_LATIN}]+")
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_WORD = re.compile(rf"{_CONTRACTED}| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
_LOWER = "a-zß-öø-ÿ"
_LOWER_WORD = re.compile(rf"{_CONTRACTED}|[{_LOWER}]+|[0-9]|[^\s{_LOWER}0-9]+")


def _byte_table() -> dict[int, str]:
    """Byte-level BPE shows printable Latin-1 bytes as they are and the others, in order, from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_BYTES = _byte_table()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes; lower: for the lower-casing tokenizer that drops white space."""

    def __init__(self, path: str, lower: bool = False, cache: int = CACHE, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.t, self.lower, self.limit, self.chunk, self.overlap = load(path), lower, cache, chunk, overlap
        self.margin = 1 + max([0, *(len(x.content) for x in self.t.get_added_tokens_decoder().values())])
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.counts: dict[str, int] = {}

    def _word(self, w: str) -> bytes:
        v = self.words.get(w)
        if v is None:
            v = array.array("I", [x.id for x in self.t.model.tokenize("".join([_BYTES[b] for b in w.encode()]))]).tobytes()
            if len(self.words) < self.limit:
                self.words[w] = v
        return v

    def _ids(self, p: str) -> bytes:
        if _PLAIN.fullmatch(p) and "<|" not in p:
            return b"".join(map(self._word, _LOWER_WORD.findall(p.lower()) if self.lower else _BYTE_WORD.findall(p)))
        return self.direct(p)

    def _piece(self, p: str) -> bytes:
        v = self._ids(p)
        if len(self.pieces) < self.limit:
            self.pieces[p] = v
        return v

    def direct(self, text: str) -> bytes:
        return array.array("I", self.t.encode(text, add_special_tokens=False).ids).tobytes()

    def cut(self, text: str) -> list[str] | None:
        """The pieces of a text, None if it goes to the library whole or in chunks."""
        if self.lower:
            return _VISIBLE.findall(text)
        return None if len(text) > self.chunk or _ODD_SPACE.search(text) else _PIECE.findall(text)

    def whole(self, text: str) -> bytes:
        return array.array("I", self.encode_long(text)).tobytes() if len(text) > self.chunk else self.direct(text)

    def encode(self, text: str) -> bytes:
        found, get = self.cut(text), self.pieces.get
        return self.whole(text) if found is None else b"".join([v if (v := get(p)) is not None else self._piece(p) for p in found])

    def count(self, text: str) -> int:
        """How many ids encode() gives; pieces are kept as counts."""
        found, get, keep, n = self.cut(text), self.counts.get, self.counts, 0
        if found is None:
            return len(self.whole(text)) // 4
        for p in found:
            k = get(p)
            if k is None:
                k = len(self._ids(p)) // 4
                if len(keep) < self.limit:
                    keep[p] = k
            n += k
        return n

    def encode_long(self, text: str, chunk: int | None = None, overlap: int | None = None) -> list[int]:
        chunk, first = chunk or self.chunk, overlap or self.overlap
        out: list[int] = []

        def read(a: int, b: int) -> tuple[list[int], list[int], set[int]]:
            """Ids, places and pre-token starts of text[a:b]."""
            e = self.t.encode(text[a:b], add_special_tokens=False)
            at = [a + x for x, _ in e.offsets]
            w = e.word_ids
            return e.ids, at, {at[i] for i in range(len(at)) if not i or w[i] != w[i - 1]}

        base, end, begin = 0, min(chunk, len(text)), 0
        left = read(base, end)
        while end < len(text):
            wide = first
            while True:
                a = end - wide
                if a <= base:
                    end = min(len(text), end + chunk)
                    left, right = read(base, end), None
                    break
                to = min(len(text), a + max(chunk, 2 * wide))
                right = read(a, to)
                if common := [p for p in left[2] & right[2] if max(a, begin) < p <= end - self.margin]:
                    break
                wide *= 2
            if right is None:
                continue
            p = max(common)
            out += [i for i, at in zip(left[0], left[1]) if begin <= at < p]
            left, base, begin, end = right, a, p, to
        out += [i for i, at in zip(left[0], left[1]) if at >= begin]
        return out


@lru_cache(maxsize=1)
def counter(path: str) -> PieceEncoder:
    """One encoder for all tasks that a worker runs, so that later ones find the pieces of earlier ones."""
    return PieceEncoder(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    Null text counts as empty (0 tokens); repeated rows stay repeated; a row is counted for its own text, whatever its doc_id;
    extra columns are ignored; an empty table gives an empty result.
    """

    def run(it: Iterator) -> Iterator:
        coder = counter(path)
        for ids, texts in batches(it, "doc_id", "text"):
            n = [coder.count(t) for t in texts]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        release()

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
