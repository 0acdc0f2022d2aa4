"""Token counts by a whole-token shortcut.

Offline (on the driver, once) every vocabulary string is run through the merges alone; those that come out as the one
token they are are proven whole. Counting then splits a text into pre-tokens, counts the proven ones directly and merges only
the rest, whose counts a worker remembers up to a bound. Plain texts are split by one pattern and looked up as they
stand; others are split by the library's pre-tokeniser and looked up as it spells them, by the same proof.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import apart

MEMO = 1 << 19
#: The byte-level pre-tokeniser's pattern over the characters of _PLAIN, whose classes are the same in
#: every Unicode version. Texts with any other character go to the library's own pre-tokeniser.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼½¾"
_SPACE = " \t\n\r"
_PRETOKEN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ſ–—‘’“”…]")


def byte_alphabet() -> list[str]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, the rest count up from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in seen}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(seen))
    return [letters[b] for b in range(256)]


class Counter:
    """Exact token counts of a byte-level BPE tokenizer given as its JSON."""

    def __init__(self, config: str, whole: frozenset[str] | None = None):
        from tokenizers import Tokenizer

        spec = json.loads(config)
        pre = spec.get("pre_tokenizer") or {}
        model = spec["model"]
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer") or model["type"] != "BPE" or model.get("dropout"):
            raise ValueError("the shortcut is for byte-level BPE with the byte-level pattern, no normaliser and no dropout")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in neighbours are not supported")
        self.tokenizer = Tokenizer.from_str(config)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.alphabet = {b: c for b, c in enumerate(byte_alphabet())}
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.back = {c: b for b, c in self.alphabet.items()}
        self.whole = self._prove() if whole is None else whole
        self.memo: dict[str, int] = {}
        self.spelt: dict[str, int] = {}
        self._forget()

    def _prove(self) -> frozenset[str]:
        """The vocabulary strings, as the tokenizer spells them, that encode alone as the one token they are."""
        return frozenset(s for s in self.tokenizer.get_vocab(with_added_tokens=False) if [t.value for t in self.model.tokenize(s)] == [s])

    def _plain(self, spelt: str) -> str | None:
        """The text of a proven string where the pattern leaves it in one piece."""
        try:
            text = bytes(self.back[c] for c in spelt).decode()
        except (KeyError, UnicodeDecodeError):
            return None
        return text if _PRETOKEN.findall(text) == [text] and not _NOT_PLAIN.search(text) else None

    def _forget(self) -> None:
        """Back to what is proven."""
        for memo, known in ((self.spelt, self.whole), (self.memo, filter(None, map(self._plain, self.whole)))):
            memo.clear()
            memo.update(dict.fromkeys(known, 1))

    def _merge(self, mapped: str) -> int:
        return len(self.model.tokenize(mapped))

    def _rest(self, memo: dict[str, int], piece: str, mapped: str) -> int:
        n = self._merge(mapped)
        if len(piece) <= 64:
            if len(self.memo) + len(self.spelt) >= MEMO + 2 * len(self.whole):
                self._forget()
            memo[piece] = n
        return n

    def _segment(self, text: str) -> int:
        if _NOT_PLAIN.search(text):
            total = 0
            for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
                total += self.spelt.get(piece) or self._rest(self.spelt, piece, piece)
            return total
        pieces = _PRETOKEN.findall(text)
        counts = list(map(self.memo.get, pieces))
        if None in counts:
            for i, n in enumerate(counts):
                if n is None:
                    counts[i] = self.memo.get(pieces[i]) or self._rest(self.memo, pieces[i], "".join([self.alphabet[b] for b in pieces[i].encode()]))
        return sum(counts)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.added is None:
            return self._segment(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(self._segment(p) for p in parts if p)


@lru_cache(maxsize=1)
def _counter(config: str, whole: frozenset[str]) -> Counter:
    """A worker keeps its counter, and what it remembers, from task to task."""
    return Counter(config, whole)


def count_tokens(docs: DataFrame, tokenizer_json: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of each row's whole text.

    tokenizer_json is a path on the driver; its content goes to the workers, so they need no such file, and its size is
    that of the vocabulary whatever the input. A null or empty text has 0 bytes and 0 tokens; repeated rows and null
    keys are counted row by row; an empty table gives an empty result; other columns are not read. A result column that clashes with the key gets ``_``.
    """
    with open(tokenizer_json, encoding="utf-8") as f:
        config = f.read()
    proven = docs.sparkSession.sparkContext.broadcast((config, Counter(config).whole))
    rows = docs.select(docs[f"`{key}`"].alias("k"), docs[f"`{text}`"].alias("t"))
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(*proven.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                sizes = [len(t or b"") for t in texts]
                tokens = [counter.count(t.decode()) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["k", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, schema).toDF(key, *apart(key, "n_bytes", "n_tokens"))
