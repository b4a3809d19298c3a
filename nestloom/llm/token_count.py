"""Token counts by a map-side lookup of two tiers (operator 10).

No token of the model joins a space to a character before it, so the count of a text is the sum over its space-separated
pre-tokens. First tier: a broadcast table of the lengths of frequent pre-tokens, counted on a bounded sample and at most
FREQUENT entries. Second tier: each worker encodes what it misses and keeps it. No pre-token is shuffled, and the sample
decides about speed alone.

Nulls count as empty texts, which have no tokens and no bytes. One row is returned for each row, repeated ones too. Only
the id and text columns are read, so other columns can't clash. Texts are counted whole, however long.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import give_back, holds, make_room, text_batches, text_or_empty
from .word_cache import MOST_BYTES, found

#: Entries of the broadcast table, rows of the sample that ranks them, and longest sampled text, in characters.
FREQUENT, SAMPLE_ROWS, SAMPLE_CHARS = 50_000, 2_000, 20_000
_SEGMENT = re.compile(" *[^ ]+| +")
SPACE_MARK = "▁"
#: Pre-tokens that a worker remembers.
CACHE = 500_000


def segments(text: str) -> list[str]:
    """The pre-tokens, each without its first space; the model puts that space before every text anyway."""
    text = text.replace(SPACE_MARK, " ")
    parts = text.split(" ")
    if "" not in parts:
        return parts
    return [s[1:] for s in _SEGMENT.findall(" " + text)] if text else []


class Lengths:
    """Both tiers: the frequent pre-tokens, and what this worker has encoded itself."""

    def __init__(self, file: str, words: list[str], lengths: np.ndarray) -> None:
        self.model = vocab.piece_model(file)
        # A pre-token that is one space alone, so empty without its first one, is one token.
        self.texts, self.length = pa.array(["", *words], pa.string()), np.concatenate([[1], lengths]).astype(np.int64)
        self.frequent = len(self.texts)

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        spaced = pc.replace_substring(texts, SPACE_MARK, " ")
        odd = pc.match_substring_regex(spaced, "^$|^ | $|  ")
        if not pc.any(odd).as_py():
            return pc.split_pattern(spaced, " ")
        places = odd.to_numpy(zero_copy_only=False)
        by_hand = pa.array([segments(t) for t in spaced.filter(odd).to_pylist()], pa.list_(pa.string()))
        parts = pa.concat_arrays([pc.split_pattern(spaced.filter(pc.invert(odd)), " "), by_hand])
        at = np.empty(len(texts), np.int64)
        at[~places], at[places] = np.arange((~places).sum()), np.arange(places.sum()) + (~places).sum()
        return parts.take(pa.array(at))

    def count(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.empty(0, np.int64)
        parts = self._cut(texts)
        at = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        words = parts.flatten().dictionary_encode()
        number = found(self.texts, words.dictionary)
        if len(lacking := np.flatnonzero(number < 0)):
            new = words.dictionary.take(pa.array(lacking))
            if len(self.texts) + len(new) > self.frequent + CACHE or self.texts.nbytes > MOST_BYTES:  # the second tier starts anew
                self.texts, self.length = self.texts.slice(0, self.frequent), self.length[: self.frequent]
                number = found(self.texts, words.dictionary)
                lacking = np.flatnonzero(number < 0)
                new = words.dictionary.take(pa.array(lacking))
            number[lacking] = np.arange(len(lacking)) + len(self.texts)
            made = np.fromiter(map(len, self.model.encode(new.to_pylist(), num_threads=1)), np.int64, len(new))
            self.texts, self.length = pa.concat_arrays([self.texts, new]), np.concatenate([self.length, made])
        total = np.concatenate([[0], np.cumsum(self.length[number[words.indices.to_numpy()]])]) if len(words) else np.zeros(1, np.int64)
        return np.diff(total[at])


def frequent_table(docs: DataFrame, file: str, text_col: str) -> tuple[str, bytes]:
    """At most FREQUENT pre-tokens joined by newlines that none of them holds, and their lengths as 16-bit integers."""
    rows = docs.select(text_col).where(F.length(text_col).between(1, SAMPLE_CHARS)).limit(SAMPLE_ROWS).collect()
    seen = Counter(s for r in rows for s in segments(r[0]) if s and "\n" not in s and len(s) <= 64)
    model = vocab.piece_model(file)
    words = [w for w, _ in seen.most_common(FREQUENT)]
    return "\n".join(words), np.asarray([len(x) for x in model.encode(words)] if words else [], dtype="<u2").tobytes()


def count_tokens(docs: DataFrame, file: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: the id, n_bytes, n_tokens, over_limit."""
    text_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, file, text_col))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        lengths = _lengths(file, shared)
        for batch in batches:
            give_back(batch.nbytes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lengths.count(batch.column(1)), pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    text = text_or_empty(text_col)
    counted = docs.select(F.col(id_col), text.alias("text_"), F.octet_length(text).cast("bigint").alias("bytes_")).mapInArrow(run, f"{id_col} {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@functools.lru_cache(maxsize=1)
def _table(file: str, key: int, words: str, lengths: bytes) -> Lengths:
    return Lengths(file, words.split("\n") if words else [], np.frombuffer(lengths, "<u2"))


holds(__name__, _table.cache_clear)


def _lengths(file: str, shared) -> Lengths:
    words, lengths = shared.value
    return _table(file, hash(words), words, lengths)
