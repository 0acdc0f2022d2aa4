"""Licence scans by a positional rare-token index.

Document frequencies of the licence vocabulary are counted over all documents. The index posts each template's key
phrase by word and place. Of each file the licence words with the highest IDF are looked up: as many, from the rarest
on, as it takes for each template whose key words the file holds to be met by its ``RARE`` rarest. Each posting votes for
the place where its template would start, and where all postings of a template under the file's looked-up words agree by
relative position, it is a candidate. Candidates are verified: the key phrase must stand whole, and the template's words
must be met, as a bag, by ``LEAST`` of their number in as many words from the start on; that share is the score. As the
key phrase must stand whole, a file that lacks one of its words cannot hold it, and no place that verification would
accept is missed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_TABLE, apart, words
from .license_texts import BASE, PARAGRAPHS, SENTENCES, Template

MORE = (*SENTENCES, *PARAGRAPHS)
#: A verification compares at most so many words at once; tables of templates are of at most so many bytes.
RARE, LEAST, AT_ONCE, TABLE_BYTES = 3, 0.75, 500_000, 64 << 20


def _split(text: str) -> list[str]:
    return [w.decode() for w in words(text.encode(), ALNUM_TABLE)]


class Index:
    """Templates as word ids, and the postings of their key phrases: a word's lie together."""

    def __init__(self, base: Sequence[Template], more: Sequence[Template], frequency: dict[str, int]):
        self.templates = [*base, *more]
        self.n_base = len(base)
        vocabulary = sorted({w for t in self.templates for w in _split(t.text)})
        self.ids = {w.encode(): i for i, w in enumerate(vocabulary, 1)}
        self.gap = len(vocabulary) + 1
        # a word's rank by IDF, from the rarest; words of no template and gaps have none
        self.rank = np.full(len(vocabulary) + 2, self.gap)
        self.rank[sorted(range(1, self.gap), key=lambda i: (frequency.get(vocabulary[i - 1], 0), i))] = np.arange(len(vocabulary))
        self.words, self.keys, postings = [], [], []
        self.holds = np.zeros((len(self.templates), len(vocabulary) + 2), np.float32)
        self.reach = np.zeros(len(self.templates), np.int64)
        votes = np.zeros((len(self.templates), len(vocabulary) + 2), np.int64)
        for n, t in enumerate(self.templates):
            found, key = _split(t.text), _split(t.key) or _split(t.text)
            at = next((i for i in range(len(found) - len(key) + 1) if found[i : i + len(key)] == key), None)
            if at is None or not key:
                raise ValueError(f"the key phrase of {t.label} does not stand in its template")
            self.words.append(np.array([self.ids[w.encode()] for w in found]))
            self.keys.append((at, len(key)))
            own = self.words[n][at : at + len(key)]
            self.holds[n, own] = 1
            ranks = np.sort(self.rank[np.unique(own)])
            self.reach[n] = ranks[min(RARE, len(ranks)) - 1]
            np.add.at(votes[n], self.rank[own], 1)
            postings += [(w, n, at + q) for q, w in enumerate(own.tolist())]
        #: of a template the postings under words up to a rank
        self.votes = votes.cumsum(axis=1)
        self.longest = max((len(w) for w in self.words), default=0)
        word, self.template, self.place = (np.array(x, np.int64) for x in zip(*sorted(postings))) if postings else (np.empty(0, np.int64),) * 3
        self.first = np.searchsorted(word, np.arange(len(vocabulary) + 3))

    def looked_up(self, text: np.ndarray, file: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each of n files which templates it may hold, and up to which rank its licence words are looked up (-1: none)."""
        held = np.zeros((n, self.gap + 1), np.float32)
        held[file[file >= 0], text[file >= 0]] = 1
        may = held @ self.holds.T == self.holds.sum(1)
        return may, np.where(may, self.reach, -1).max(axis=1, initial=-1)

    def candidates(self, text: np.ndarray, file: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(template, start): where all postings of a template under the words looked up agree. ``file`` is -1 in gaps."""
        may, upto = self.looked_up(text, file, n)
        at = np.flatnonzero((self.rank[text] <= upto[file]) & (file >= 0))
        many = np.diff(self.first)[text[at]]
        row = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[text[at]], many)
        at = np.repeat(at, many)
        start, template = at - self.place[row], self.template[row]
        some = (start >= 0) & may[file[at], template]
        vote, one, votes = np.unique((template * len(text) + start)[some], return_index=True, return_counts=True)
        template, start = vote // len(text), vote % len(text)
        agreed = votes == self.votes[template, upto[file[at[some][one]]]]
        return template[agreed], start[agreed]

    def search(self, text: np.ndarray, file: np.ndarray, n_files: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(template, verified starts, scores); text has ``longest`` times ``gap`` at both ends and between files."""
        template, start = self.candidates(text, file, n_files)
        for n in np.unique(template).tolist():
            (first, size), own = self.keys[n], self.words[n]
            starts = start[template == n]
            starts = starts[starts + len(own) <= len(text)]
            whole = text[starts[:, None] + np.arange(first, first + size)] == own[first : first + size]
            starts = starts[whole.all(1)]
            step = max(1, AT_ONCE // len(own))
            score = np.ones(len(starts)) if size == len(own) else np.concatenate([np.empty(0), *(self._overlap(text, starts[i : i + step], n) for i in range(0, len(starts), step))])
            yield n, starts[score >= LEAST], score[score >= LEAST]

    def _overlap(self, text: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """The share of a template's words, as a bag, among as many words of the file that has its key phrase."""
        own, (first, size) = self.words[n], self.keys[n]
        seen = text[starts[:, None] + np.arange(len(own))]
        # a gap between files parts what is before or behind it from the key phrase
        gap = seen == self.gap
        apart = np.zeros(gap.shape, bool)
        apart[:, first + size :] = np.maximum.accumulate(gap[:, first + size :], 1)
        apart[:, :first] = np.maximum.accumulate(gap[:, first - 1 :: -1], 1)[:, ::-1] if first else False
        kinds, bag = np.unique(own, return_counts=True)
        place = np.minimum(np.searchsorted(kinds, seen), len(kinds) - 1)
        same = (kinds[place] == seen) & ~apart
        counts = np.bincount((np.arange(len(starts))[:, None] * len(kinds) + place)[same], minlength=len(starts) * len(kinds)).reshape(-1, len(kinds))
        return np.minimum(counts, bag).sum(1) / len(own)


def _ids(texts: list[bytes | None], get) -> list[np.ndarray]:
    out = []
    for t in texts:
        found = words(t, ALNUM_TABLE)
        out.append(np.fromiter((get(w, 0) for w in found), np.int64, len(found)))
    return out


def _frequencies(vocabulary: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {w.encode(): i for i, w in enumerate(vocabulary, 1)}
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                held = set(words(t, ALNUM_TABLE)) & ids.keys()
                total[[ids[w] for w in held]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary), pa.array(total[1:])], names=["w", "n"])

    return run


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType()),
    ]
)


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap = np.full(index.longest, index.gap)
        step = max(8, min(500, AT_ONCE // max(index.longest, 1)))
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                ids = _ids(part.column(1).cast(pa.binary()).to_pylist(), index.ids.get)
                lengths = np.array([len(x) for x in ids], np.int64)
                begins = np.cumsum(lengths + len(gap)) - lengths
                text = np.concatenate([gap, *(y for x in ids for y in (x, gap))])
                n = len(ids)
                file = np.full(len(text), -1)
                file[np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())] = np.repeat(np.arange(n), lengths)
                n_base, score = np.zeros(n, np.int64), np.zeros(n)
                low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                labels: list[tuple[set[str], set[str]]] = [(set(), set()) for _ in ids]
                for k, starts, scores in index.search(text, file, n):
                    if not len(starts):
                        continue
                    doc = np.maximum(np.searchsorted(begins, starts + index.keys[k][0], side="right") - 1, 0)
                    np.maximum.at(score, doc, scores)
                    if k < index.n_base:
                        np.add.at(n_base, doc, 1)
                        np.minimum.at(low, doc, starts - begins[doc])
                        np.maximum.at(high, doc, starts - begins[doc])
                    for d in np.unique(doc).tolist():
                        labels[d][k >= index.n_base].add(index.templates[k].label)
                some = n_base > 0
                columns = [
                    part.column(0), pa.array(lengths), pa.array(n_base), pa.array(low, mask=~some), pa.array(high, mask=~some),
                    pa.array([sorted(b) for b, _ in labels], pa.list_(pa.string())), pa.array([sorted(b | m) for b, m in labels], pa.list_(pa.string())), pa.array(score),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["k", *RESULT.names])

    return run


def templates_of(table: DataFrame) -> list[Template]:
    """Templates of a table (label, text, key): whole licences, say. Its texts may have ``TABLE_BYTES`` bytes, else it raises.

    A null key asks for the whole text. Rows without a label or without words in the text are left out, repeated rows
    count once; other columns are not read.
    """
    rows = table.select("label", "text", F.coalesce("key", F.lit("")).alias("key")).where("label is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > TABLE_BYTES:
        raise ValueError(f"templates of {size} bytes; a worker holds {TABLE_BYTES}")
    return sorted(t for r in rows.collect() if _split((t := Template(*r)).text))


def scan_licenses(docs: DataFrame, *, key: str = "doc_id", text: str = "text", base: Sequence[Template] = BASE, more: Sequence[Template] = MORE) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score), a row a row; labels are sorted arrays.

    n_base counts all places of base phrases, overlapping ones included; first_word and last_word are the smallest and
    largest word they start at, null without any. score is the best verified template's share of words, 0 without one. base
    phrases must stand whole; more are licence sentences, paragraphs or whole licences (``templates_of`` reads a table).
    A null or empty text has no words. Repeated rows and null keys are scanned row by row; equal IDFs are taken in
    order of position; an empty table gives an empty result; other columns are not read. A result column that clashes
    with the key gets ``_``.
    """
    rows = docs.select(docs[f"`{key}`"].alias("k"), docs[f"`{text}`"].alias("t"))
    vocabulary = sorted({w for t in (*base, *more) for w in _split(t.text)})
    counted = rows.select("t").mapInArrow(_frequencies(vocabulary), T.StructType([T.StructField("w", T.StringType()), T.StructField("n", T.LongType())]))
    frequency = {r["w"]: r["n"] for r in counted.groupBy("w").agg(F.sum("n").alias("n")).collect()}  # a row a licence word
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), *RESULT.fields])
    return rows.mapInArrow(_scan(Index(base, more, frequency)), schema).toDF(key, *apart(key, *RESULT.names))
