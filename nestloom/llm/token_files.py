"""Token ids as binary files in ascending id order (operator 4).

Texts are split at ASCII white space, which the tokenizer drops, and each different word of a batch is looked up in what
its worker has encoded before; ids are then gathered by number of the word. Each document gets an end id. The encoded rows
are written once; a distributed count of their ids gives the shared frequency table, of at most one entry for each id of
the vocabulary. Rows are then dealt out by ranges of their ids, and each task writes a file of blocks (see rans.py) under a
name of its attempt. The names that the tasks return are what is read: files of lost or repeated attempts don't count.
Reading decodes the blocks of all files in parallel; the ids before each file are summed in two levels.

Nulls are encoded as empty texts: the end id alone. Rows of one id are ordered by their numbers of tokens, then by a hash
of them; a null id comes first. Every row is written, repeated ones too, and many repeated rows spread over several files.
Only the id and text columns are read, so other columns can't clash. An empty table gives no files and no rows. A document
is never split over blocks, so a long one makes a long block.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

from . import rans, vocab
from .common import binary_files, file_folder, give_back, holds, make_room, put_file, small_side, text_batches, text_or_empty, written
from .word_cache import Known, joined

#: Ids for each range of documents that one task writes, and files whose ids are summed in one group.
RANGE_IDS, FILE_GROUP = 1 << 22, 4096
#: Words and pieces of words that a worker remembers; they only save time.
WORDS, PIECES = 500_000, 500_000
#: Workers of the stages that handle files don't need the encoder; bytes that coding takes for an id.
FILES, CODING = f"{__name__}.files", 16
#: Characters whose lower case and composition need no context, and the pieces that the tokenizer cuts them into.
_PLAIN = "^[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|\n|[^a-z0-9\n\u00df-\u00f6\u00f8-\u00ff]+")


@dataclass(frozen=True)
class TokenFiles:
    folder: str
    vocab_size: int
    counts: dict[int, int]
    files: DataFrame  # name, part, n: of each file that counts


def _unit(vocab_size: int) -> str:
    return "<u2" if vocab_size <= 1 << 16 else "<u4"


class Encoder:
    """Ids of whole texts, by way of the different words of a batch and the pieces that the tokenizer cuts words into."""

    def __init__(self, file: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = vocab.word_tokenizer(file)
        if self.whole.model.end_of_word_suffix != "</w>":
            raise ValueError("a tokenizer whose words end in </w> is needed")
        size = self.whole.get_vocab_size()
        self.end, self.unit = end_id, _unit(size)
        self.words, self.pieces = Known(self.unit), Known(self.unit)
        self.pieces.add(pa.array(["\n"]), np.empty(0, self.unit), np.zeros(1, np.int64))
        # The library's model alone, for pieces that are cut already and mapped to its characters for bytes.
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.mapped = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(33, 256) if re.match(_PLAIN, chr(c))}
        self.last = np.zeros(size, bool)  # ids that end a piece
        for token, i in self.whole.get_vocab(with_added_tokens=False).items():
            self.last[i] = token.endswith("</w>")

    def _learn_pieces(self, pieces: pa.Array) -> None:
        """Each piece ends with the first id that ends one."""
        ids = self.model.encode_batch_fast([joined(pieces, " ").translate(self.mapped)], add_special_tokens=False)[0].ids
        flat = np.array(ids, self.unit)
        self.pieces.add(pieces, flat, np.diff(np.flatnonzero(self.last[flat]), prepend=-1))

    def _plain_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words in plain characters, one after the other, and the number of ids of each word."""
        found = pa.array(_PIECES.findall(joined(words, "\n").lower()), pa.string()).dictionary_encode()
        if self.pieces.full(len(found.dictionary), PIECES):
            self.pieces = Known(self.unit)
            self.pieces.add(pa.array(["\n"]), np.empty(0, self.unit), np.zeros(1, np.int64))
        number = self.pieces.find(found.dictionary)
        if len(lacking := np.flatnonzero(number < 0)):
            number[lacking] = np.arange(len(lacking)) + len(self.pieces.texts)
            self._learn_pieces(found.dictionary.take(pa.array(lacking)))
        ids, ends = self.pieces.gathered(number[found.indices.to_numpy()])
        cut = np.flatnonzero(np.diff(ends, prepend=0) == 0)  # where words end, as no piece is without ids
        return ids, np.diff(ends[cut], prepend=0, append=ends[-1])

    def _learn(self, words: pa.Array) -> np.ndarray:
        """The words' new numbers. Words of plain characters are lower-cased and cut here, and only their new pieces go to
        the library's model; all others go through the whole library."""
        plain = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|")))
        number, simple = np.empty(len(words), np.int64), plain.to_numpy(zero_copy_only=False)
        if len(some := words.filter(plain)):
            number[simple] = np.arange(len(some)) + len(self.words.texts)
            self.words.add(some, *self._plain_ids(some))
        if len(some := words.filter(pc.invert(plain))):
            number[~simple] = np.arange(len(some)) + len(self.words.texts)
            made = [e.ids for e in self.whole.encode_batch_fast(some.to_pylist(), add_special_tokens=False)]
            size = np.fromiter(map(len, made), np.int64, len(made))
            self.words.add(some, np.fromiter(itertools.chain.from_iterable(made), self.unit, int(size.sum())), size)
        return number

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by the end id, and where each text's ids end."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        if self.words.full(len(words.dictionary), WORDS):
            self.words = Known(self.unit)
        number = self.words.find(words.dictionary)
        if len(lacking := np.flatnonzero(number < 0)):
            number[lacking] = self._learn(words.dictionary.take(pa.array(lacking)))
        flat, ends = self.words.gathered(number[words.indices.to_numpy()] if len(number) else np.empty(0, np.int64))
        ends = np.concatenate([[0], ends])
        at = split.offsets.to_numpy()
        stops = np.cumsum(np.diff(ends[at - at[0]]) + 1)
        out = np.full(int(stops[-1]) if len(stops) else 0, self.end, self.unit)
        own = np.ones(len(out), bool)
        own[stops - 1] = False
        out[own] = flat
        return out, stops


@functools.lru_cache(maxsize=1)
def _encoder(file: str, end_id: int) -> Encoder:
    return Encoder(file, end_id)


holds(__name__, _encoder.cache_clear)


def encoded(docs: DataFrame, file: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, ids packed as integers of the vocabulary's unit, hash of them, place of the row."""
    text_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        encoder = _encoder(file, end_id)
        wide = np.dtype(encoder.unit).itemsize
        for batch in batches:
            if batch.num_rows:
                flat, stops = encoder.encode(batch.column(1))
                offsets = pa.py_buffer(np.concatenate([[0], stops * wide]).astype("<i4"))
                ids = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(stops, prepend=0), pa.int64()), ids], names=["doc_id", "n", "ids"])
                give_back(batch.nbytes)
        give_back()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text_")).mapInArrow(run, "doc_id bigint, n bigint, ids binary")
    return rows.withColumn("hash", F.xxhash64("ids")).withColumn("place", F.monotonically_increasing_id())


def _id_counts(rows: DataFrame, vocab_size: int) -> dict[int, int]:
    """How often each id occurs: at most one row for each id of the vocabulary comes to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(FILES)
        seen = np.zeros(vocab_size, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                seen += np.bincount(_joined(batch.column(0), vocab_size), minlength=vocab_size)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(seen[used], pa.int64())], names=["id", "n"])

    return {r.id: r.n for r in rows.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def _joined(ids: pa.Array, vocab_size: int) -> np.ndarray:
    """The ids of all rows of a binary column, without a copy."""
    offsets = np.frombuffer(ids.buffers()[1], "<i4")[ids.offset : ids.offset + len(ids) + 1]
    unit = np.dtype(_unit(vocab_size))
    return np.frombuffer(ids.buffers()[2], unit, count=int(offsets[-1] - offsets[0]) // unit.itemsize, offset=int(offsets[0])) if offsets[-1] > offsets[0] else np.empty(0, unit)


def _table(counts: dict[int, int], vocab_size: int) -> rans.Table:
    all_counts = np.zeros(vocab_size)
    all_counts[list(counts)] = list(counts.values())
    return rans.Table(all_counts)


def write_files(docs: DataFrame, file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    spark = docs.sparkSession
    size = vocab.word_tokenizer(file).get_vocab_size()
    rows = written(encoded(docs, file, end_id, id_col, text_col), "ids")
    counts = _id_counts(rows, size)
    folder, shared = file_folder(spark, "rans"), spark.sparkContext.broadcast(counts)
    ranges = max(1, -(-sum(counts.values()) // RANGE_IDS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(FILES)
        table, part = _table(shared.value, size), TaskContext.get().partitionId()
        out, done = [rans.MAGIC], 0
        ids: list[np.ndarray] = []
        docs_in: list[int | None] = []
        sizes: list[int] = []

        def close() -> None:
            nonlocal done, ids, docs_in, sizes
            flat = np.concatenate(ids)
            out.append(rans.encode_block(flat, docs_in, sizes, done, table))
            done += len(flat)
            ids, docs_in, sizes = [], [], []
            give_back(CODING * len(flat))

        open_ids = 0
        for batch in batches:
            known, n, flat = batch.column(0).to_pylist(), batch.column(1).to_numpy(), _joined(batch.column(2), size) if batch.num_rows else np.empty(0)
            ends = np.cumsum(n)
            row = 0
            while row < len(known):  # as many rows as fill a block
                before = int(ends[row - 1]) if row else 0
                stop = min(len(known), int(np.searchsorted(ends, before + rans.BLOCK - open_ids)) + 1)
                docs_in += known[row:stop]
                sizes += n[row:stop].tolist()
                ids.append(flat[before : int(ends[stop - 1])].copy())
                open_ids += len(ids[-1])
                row = stop
                if open_ids >= rans.BLOCK:
                    close()
                    open_ids = 0
        if ids:
            close()
        if done:
            name = f"{part:08d}-{uuid.uuid4().hex}.rans"
            put_file(folder, name, b"".join(out))
            out.clear()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), pa.array([done], pa.int64())], names=["name", "part", "n"])
        give_back()

    order = ("doc_id", "n", "hash", "place")
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
    return TokenFiles(folder, size, counts, written(dealt.mapInArrow(run, "name string, part bigint, n bigint"), "files"))


def _starts(files: DataFrame) -> DataFrame:
    """name, base: the ids in the files before each. The driver gets a sum for each FILE_GROUP files."""
    spark, grouped = files.sparkSession, files.withColumn("group_", F.floor(F.col("part") / FILE_GROUP))
    first, total = [], 0
    for r in grouped.groupBy("group_").agg(F.sum("n").alias("n")).orderBy("group_").toLocalIterator():
        first.append((r.group_, total))
        total += r.n
    before = F.coalesce(F.sum("n").over(Window.partitionBy("group_").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = spark.createDataFrame(first, "group_ bigint, first_ bigint")
    return grouped.withColumn("before_", before).join(at, "group_").select("name", (F.col("first_") + F.col("before_")).alias("base"))


def read_files(spark, files: TokenFiles) -> DataFrame:
    """For each document in the files: doc_id, start, n_tokens, ids_crc32."""
    shared, size = spark.sparkContext.broadcast(files.counts), files.vocab_size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(FILES)
        table = None
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table, name = table or _table(shared.value, size), path.rpartition("/")[2]
                for b in rans.blocks(content.as_buffer()):
                    ids = b.decode(table)
                    ends = np.cumsum(b.sizes)
                    if ends[-1] != b.n:
                        raise ValueError("a block's documents don't fill it")
                    starts = ends - b.sizes
                    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(crc)), pa.array(b.doc_ids, pa.int64()), pa.array(starts + b.before, pa.int64()), pa.array(b.sizes, pa.int64()), pa.array(crc, pa.int64())], names=["name", "doc_id", "start", "n_tokens", "ids_crc32"])
                    give_back(CODING * b.n)
        give_back()

    decoded = binary_files(spark, files.folder, ".rans").mapInArrow(run, "name string, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    starts = written(_starts(files.files), "starts")
    return decoded.join(small_side(starts), "name").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return read_files(docs.sparkSession, write_files(docs, file, end_id, id_col, text_col))
