"""BPE encoding and decoding of whole texts through a trie of their distinct words.

The tokenizer is lower-casing with end-of-word tokens.  Each batch of texts is cut into words,
the words not met before go through the prefix-sharing trie of :mod:`cardspark.llm.bpe`, and
texts are put together from their words' ids.  Spark deals out the texts; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from cardspark.llm import bpe
from cardspark.llm.common import held, slices

#: Words kept between batches, half as many with their decoded text; words longer than this many characters are not kept.
MEMO_WORDS, MEMO_CHARACTERS = 1_200_000, 64
#: Bytes of texts worked on at once.
SLICE_BYTES = 8 << 20


class WordTokenizer:
    """Ids and decoded text of whole texts.

    ``entry`` makes what is kept for a word from its ids: with ``decoding`` the packed ids and the
    tokens' joined text, without only the packed ids.
    """

    def __init__(self, path: str, ranges: dict, decoding: bool):
        from tokenizers import Tokenizer

        self.encoder = bpe.WordTrieEncoder(path)
        self.decoding = decoding
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.encoder.special, key=len, reverse=True))) + ")")
        self.wide = re.compile("[^\x00-\u036f]")  # beyond, the library's own normaliser is asked
        self.wide_word, self.plain_word, self.ascii_word = (self.pattern(ranges, last) for last in (0x10FFFF, 0x36F, 0x7F))
        self.memo: dict[str, object] = {}
        self.memo_words = MEMO_WORDS // (1 + decoding)

    @staticmethod
    def pattern(ranges: dict, last: int) -> re.Pattern:
        """The words of texts whose characters go up to ``last``."""
        letter, number, space = (bpe.charset((a, min(b, last)) for a, b in ranges[k] if a <= last) for k in ("letter", "number", "space"))
        return re.compile(f"[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d|[{number}]|[^{space}{letter}{number}]+")

    def words(self, text: str) -> list[str]:
        """Words in their order; a special token's string stands for itself, after a NUL pair."""
        if "<|" not in text:
            return self._words(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append("\0\0" + part)
            elif part:
                out += self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_word.findall(text.lower())
        if self.wide.search(text):
            return self.wide_word.findall(self.normalizer.normalize_str(text))
        composed = unicodedata.normalize("NFC", text)
        pattern = self.plain_word if composed is text or not self.wide.search(composed) else self.wide_word
        return pattern.findall(composed.lower())

    def learn(self, words: set[str]) -> dict[str, object]:
        """What stands for each of these words."""
        text_of, special = self.encoder.text_of, self.encoder.special
        known = {w: ([special[w[2:]]], w[2:]) for w in words if w.startswith("\0\0") and w[2:] in special}
        if len(self.memo) > self.memo_words:
            self.memo.clear()
        out = {}
        for w, ids in chain(self.encoder.encode(words - known.keys()), ((w, ids) for w, (ids, _) in known.items())):
            entry = array("I", ids).tobytes()
            if self.decoding:
                entry = (entry, known[w][1] if w in known else " ".join([text_of[i] for i in ids]))
            out[w] = entry
            if len(w) <= MEMO_CHARACTERS:
                self.memo[w] = entry
        return out

    def entries(self, texts: list[str | None]) -> list[list]:
        """For each text, what stands for its words."""
        cut = [self.words(t or "") for t in texts]
        get = self.memo.get
        found = [list(map(get, words)) for words in cut]
        new = {w for words, own in zip(cut, found) if None in own for w, e in zip(words, own) if e is None}
        if new:
            learnt = self.learn(new)
            for words, own in zip(cut, found):
                if None in own:
                    for k, e in enumerate(own):
                        if e is None:
                            own[k] = learnt[words[k]]
        return found


def tokenizer_key(path: str, decoding: bool = True) -> tuple:
    return "words", path, decoding


def tokenizer(path: str, ranges: dict, decoding: bool = True) -> WordTokenizer:
    """The tokenizer that a Python worker holds."""
    return held(tokenizer_key(path, decoding), lambda: WordTokenizer(path, ranges, decoding))


def encode_decode(df: DataFrame, tokenizer_file: str, text: str = "text", keep: tuple[str, ...] = (), ids: bool = True) -> DataFrame:
    """Encodes and decodes each text.

    Returns the columns ``keep`` and ``n_tokens``, ``ids`` (array; only with ``ids``), ``ids_sha256``
    (of the ids as little-endian unsigned 32-bit integers) and ``decoded_sha256``, and with ``ids``
    also ``decoded``.  Null and empty texts have no tokens and decode to the empty string.  Strings
    of special tokens inside texts become those tokens.  Repeated rows are encoded alike and kept;
    other columns are ignored, whatever their names.  An empty table gives an empty result.
    """
    ranges = bpe.classes()
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>", "decoded string"] * ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_file, ranges)
        for batch in slices(batches, "__text", SLICE_BYTES, tokenizer_key(tokenizer_file)):
            n, packed, sha, back, decoded_text = [], [], [], [], []
            for entries in tok.entries(batch.column("__text").to_pylist()):
                raw = b"".join([e[0] for e in entries])
                decoded = " ".join([e[1] for e in entries])
                n.append(len(raw) // 4)
                sha.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(decoded.encode()).hexdigest())
                if ids:
                    packed.append(memoryview(raw).cast("I").tolist())
                    decoded_text.append(decoded)
            columns = [batch.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            if ids:
                columns += [pa.array(packed, pa.list_(pa.int32())), pa.array(decoded_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * ids])

    return df.select(*keep, df[text].cast("string").alias("__text")).mapInArrow(run, schema)
