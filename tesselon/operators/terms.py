"""Terms of whole texts, counted text by text in Python over Arrow batches.

The same terms as functions.text.tokenize(). A row for each term, each hashed letter by letter, costs Catalyst many times
what the texts cost; here a text is split once, and what follows from a spelling is worked out once for each task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Spellings that a task remembers, and rows of a batch that it hands on.
SPELLINGS, ROWS = 100_000, 50_000
_WORD = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_PART = re.compile(T.PART)
_STOP = frozenset(T.STOPWORDS)


def word_terms(word: str) -> tuple[str, ...]:
    """functions.text.word_terms() of one identifier."""
    low = word.lower()
    if low in _STOP:
        return ()
    parts = _PART.findall(word)
    if len(parts) < 2:
        return (low,) if len(low) >= 2 else ()
    lows = [x.lower() for x in parts]
    return (*([low] if 2 <= len(low) <= 48 else []), *[x for x in lows if len(x) >= 2 and not x.isdigit() and x not in _STOP])


def fnv1a32(term: str) -> int:
    """functions.text.fnv1a32() of an ASCII word."""
    h = 2166136261
    for c in term.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h


class Remembered(dict):
    """What a function gives for its last SPELLINGS arguments or fewer."""

    def __init__(self, of: Callable):
        super().__init__()
        self.of = of

    def __missing__(self, key):
        if len(self) >= SPELLINGS:
            self.clear()
        got = self[key] = self.of(key)
        return got


def _counted(text: str | None, of: Remembered) -> dict[str, int]:
    """Terms of a text and how often each is met."""
    out: dict[str, int] = {}
    for word, k in Counter(_WORD.findall(text or "")).items():
        for t in of[word]:
            out[t] = out.get(t, 0) + k
    return out


def _rows(corpus: DataFrame, of_text: Callable[[], Callable], columns: dict[str, pa.DataType], ddl: str) -> DataFrame:
    """Rows (id, columns) of each text of corpus (id, text); of_text() makes, once a task, the function of a text that gives
    one list for each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = of_text()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at, sizes, cells = 0, [], [[] for _ in columns]
            for i in range(batch.num_rows + 1):
                if i == batch.num_rows or len(cells[0]) >= ROWS:
                    if cells[0]:
                        take = pa.array([at + j for j, n in enumerate(sizes) for _ in range(n)], pa.int32())
                        yield pa.RecordBatch.from_arrays([ids.take(take), *[pa.array(c, kind) for c, kind in zip(cells, columns.values())]], ["id", *columns])
                    at, sizes, cells = i, [], [[] for _ in columns]
                if i < batch.num_rows:
                    got = one(texts[i].as_py())
                    sizes.append(len(got[0]))
                    for c, more in zip(cells, got):
                        c.extend(more)

    return corpus.select("id", "text").mapInArrow(run, f"id {dict(corpus.dtypes)['id']}, {ddl}")


def counts(corpus: DataFrame) -> DataFrame:
    """(id, term, tf) of each text; an id of several texts has rows of each."""

    def of_text():
        of = Remembered(word_terms)

        def one(text):
            tf = _counted(text, of)
            return tf.keys(), tf.values()

        return one

    return _rows(corpus, of_text, {"term": pa.string(), "tf": pa.int64()}, "term string, tf long")


def counts_of(corpus: DataFrame, wanted: list[str]) -> DataFrame:
    """(id, q, tf) of each text: how often it has each wanted term, and with a null q how many other terms."""
    asked = frozenset(wanted)

    def split(word: str) -> tuple[int, tuple[str, ...]]:
        every = word_terms(word)
        met = tuple(t for t in every if t in asked)
        return len(every) - len(met), met

    def of_text():
        of = Remembered(split)

        def one(text):
            rest, tf = 0, {}
            for word, k in Counter(_WORD.findall(text or "")).items():
                others, met = of[word]
                rest += k * others
                for t in met:
                    tf[t] = tf.get(t, 0) + k
            if rest:
                tf[None] = rest
            return tf.keys(), tf.values()

        return one

    return _rows(corpus, of_text, {"q": pa.string(), "tf": pa.int64()}, "q string, tf long")


def hashed(corpus: DataFrame, dimensions: int, sign_bit: int) -> DataFrame:
    """(id, idx, val): the sums of 1 + ln(tf) of each text by the cell and with the sign of the term's hash."""

    def of_text():
        of, hashes = Remembered(word_terms), Remembered(fnv1a32)

        def one(text):
            cells: dict[int, float] = {}
            for t, n in _counted(text, of).items():
                h = hashes[t]
                x = 1.0 + math.log(n) if n > 1 else 1.0
                i = h % dimensions
                cells[i] = cells.get(i, 0.0) + (-x if h >> sign_bit & 1 else x)
            return cells.keys(), cells.values()

        return one

    return _rows(corpus, of_text, {"idx": pa.int32(), "val": pa.float64()}, "idx int, val double")


def repeats(corpus: DataFrame) -> bool:
    """Whether an id has several texts."""
    return not corpus.groupBy("id").count().where(F.col("count") > 1).isEmpty()
