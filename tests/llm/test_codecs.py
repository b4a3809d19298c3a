"""Tokenizers, token files and media against their libraries and by round trips."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from nestloom.llm import bpe, media, queries, rans, token_count, token_files, vocab

ALPHABET = list(" \n\t abcABC'stre é中文字 0123🎉\x1c　  !!..▁")
MESSY = ["", None, " ", "  a  b ", "the the", "x" * 5000, "'s don't <|endoftext|> <s>", "é" * 300, "a\x00b", "▁▁a ▁", "中文 字" * 50, "the the"]


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(n)]


def messy(spark, texts=None):
    """Documents with nulls, repeated rows and columns named like the results."""
    rows = [(i // 2 if i > 9 else i, t, "en", None if i % 3 else "s", 0, "x", 5) for i, t in enumerate(texts or MESSY)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, n_tokens int")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(vocab.path(queries.BYTE_BPE))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=vocab.byte_ranks(vocab.path(queries.BYTE_BPE)), special_tokens={})


def test_byte_bpe_is_the_librarys(codec, library):
    for t in random_texts(600) + [t for t in MESSY if t]:
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == library.encode_ordinary(t), t
        assert codec.decode(codec.encode(t)) == t.encode()


def test_appends_and_edits_keep_the_prefix_table(codec):
    r = random.Random(2)
    for a, b in zip(random_texts(60, 3), random_texts(60, 4), strict=True):
        a, b = a.encode(), b.encode()[:8]
        whole = codec.bpe.append(bpe.Prefixes(), a + b)
        assert codec.bpe.append(codec.bpe.append(bpe.Prefixes(), a), b).last == whole.last
        at = r.randint(0, len(a))
        state = codec.bpe.append(bpe.Prefixes(), a)
        codec.bpe.edit(state, at, min(len(a), at + 3), b)
        assert state.last == codec.bpe.append(bpe.Prefixes(), bytes(state.data)).last


def test_byte_bpe_query_rows(spark, library):
    got = bpe.encode_decode(messy(spark), vocab.path(queries.BYTE_BPE)).collect()
    ids = [library.encode_ordinary(t or "") for t in MESSY]
    assert [(r.n_tokens, r.ids_sha256) for r in got] == [(len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for i in ids]
    assert [r.decoded_sha256 for r in got] == [hashlib.sha256((t or "").encode()).hexdigest() for t in MESSY]
    assert bpe.encode_decode(messy(spark).limit(0), vocab.path(queries.BYTE_BPE)).count() == 0


def test_token_counts_are_the_librarys(spark):
    file = vocab.path(queries.PIECE_BPE)
    model = vocab.piece_model(file)
    texts = random_texts(500, 5) + MESSY
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")
    got = {r.doc_id: r for r in token_count.count_tokens(rows, file, 40).collect()}
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 40), t
    assert token_count.count_tokens(rows.limit(0), file, 40).count() == 0


def test_token_files_give_the_ids_back(spark):
    file = vocab.path(queries.WORD_BPE)
    model = vocab.word_tokenizer(file)
    texts = random_texts(300, 6) + MESSY
    rows = spark.createDataFrame([(len(texts) - i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, start string")
    start = 0
    for r, t in zip(sorted(token_files.token_files(rows, file, 2).collect()), reversed(texts), strict=True):
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(r)[1:] == (start, len(ids), zlib.crc32(ids.tobytes())), t
        start += len(ids)
    assert token_files.token_files(rows.limit(0), file, 2).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (4, "c"), (4, "c")], "doc_id long, text string")
    assert sorted(((r.doc_id is None, r.start) for r in token_files.token_files(twice, file, 2).collect()), key=lambda x: x[1]) == [(True, 0), (False, 3), (False, 5)]


def test_copies_spread_over_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE_IDS", 200)
    monkeypatch.setattr(token_files, "FILE_GROUP", 3)
    rows = spark.createDataFrame([(7, "the same words again")] * 300 + [(i, f"text {i}") for i in range(5)] + [(9, None), (None, "x")], "doc_id long, text string")
    files = token_files.write_files(rows, vocab.path(queries.WORD_BPE), 2)
    assert files.files.count() > 4
    got = sorted(token_files.read_files(spark, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 4] + [7] * 300 + [9]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]


def test_workers_of_token_files_give_their_memory_back(spark, monkeypatch):
    """What the encoder took goes back when a task has encoded, and the stages that handle files drop the encoder."""

    class Frame:
        def __getattr__(self, name):
            return lambda *args: self

        def __iter__(self):
            return iter(())

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    file, given, frames = vocab.path(queries.WORD_BPE), [], [Frame() for _ in range(4)]
    for name in ("written", "small_side", "_starts"):
        monkeypatch.setattr(token_files, name, lambda df, *rest: df)
    monkeypatch.setattr(token_files, "text_batches", lambda spark: None)
    token_files.encoded(frames[0], file, 2, "doc_id", "text")
    token_files._id_counts(frames[1], 50_000)
    monkeypatch.setattr(token_files, "binary_files", lambda *args: frames[2])
    token_files.read_files(spark, token_files.TokenFiles("", 50_000, {5: 1}, frames[2]))
    frames[3].sparkSession = spark
    monkeypatch.setattr(token_files, "encoded", lambda *args: frames[3])
    monkeypatch.setattr(token_files, "_id_counts", lambda *args: {5: 1})
    token_files.write_files(frames[3], file, 2)
    monkeypatch.setattr(token_files, "TaskContext", type("Context", (), {"get": lambda: type("Task", (), {"partitionId": lambda self: 0})()}))
    monkeypatch.setattr(token_files, "give_back", lambda *args: given.append(args))
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["some words"])], names=["doc_id", "text_"])
    for frame in frames[1:]:
        assert len(list(frames[0].run(iter([batch])))) == 1
        assert given[-1] == () and token_files._encoder.cache_info().currsize == 1
        list(frame.run(iter(())))
        assert token_files._encoder.cache_info().currsize == 0


def test_batches_of_bytes_are_the_librarys(codec, library, monkeypatch):
    texts = random_texts(800, 11) + [t or "" for t in MESSY] + ["a b  c", " lead", "trail ", "x\u3000 y", "it's we'll \n\n z", "no-break\xa0 x", "\x0b \x0c", "tab\tword  "] * 3
    for generation, size in ((bpe.CACHE, 900), (40, 7)):
        monkeypatch.setattr(codec.first, "generation", generation)
        monkeypatch.setattr(codec.after, "generation", generation)
        for i in range(0, len(texts), size):
            part = texts[i : i + size]
            for t, x in zip(part, codec.encode_many(part), strict=True):
                assert np.frombuffer(x, "<u4").tolist() == library.encode_ordinary(t), t
                assert codec.decode(x) == t.encode()


def test_short_pieces_of_bytes_are_encoded_side_by_side(library, monkeypatch):
    """None of them alone, whatever is remembered of pairs; long ones alone."""
    monkeypatch.setattr(bpe, "PAIRS", 16)
    monkeypatch.setattr(bpe, "TOGETHER", 50)
    codec, alone, r = bpe.TextCodec(vocab.path(queries.BYTE_BPE)), [], random.Random(13)
    one = codec.bpe.encode
    monkeypatch.setattr(codec.bpe, "encode", lambda piece: alone.append(piece) or one(piece))
    syllables = ["qu", "eau", "ß", "é", "ing", "中", "x", "th", "aa", "🎉", "\x00", "##", "7"]
    texts = ["".join(r.choices(syllables, k=r.randint(1, 9))) for _ in range(1500)] + [t or "" for t in MESSY] + random_texts(200, 14)
    for i in range(0, len(texts), 300):
        for t, x in zip(texts[i : i + 300], codec.encode_many(texts[i : i + 300]), strict=True):
            assert np.frombuffer(x, "<u4").tolist() == library.encode_ordinary(t), t
    assert alone and all(len(piece) > bpe.SIDE_BY_SIDE for piece in alone)
    with pytest.raises(ValueError):
        bpe.PrefixBPE({b"a": 0, b"b": 1, b"ab": 2}).many.encode([b"abcab"])
    assert bpe.PrefixBPE({b"a": 0, b"b": 1, b"ab": 2}).many.encode([b"aab", b"ba"]) == [b"\0\0\0\0\2\0\0\0", b"\1\0\0\0\0\0\0\0"]


def test_counts_are_whole_when_forgotten(monkeypatch):
    monkeypatch.setattr(token_count, "CACHE", 30)
    file = vocab.path(queries.PIECE_BPE)
    lengths, model = token_count.Lengths(file, ["the", "a"], np.array([1, 1])), vocab.piece_model(file)
    texts = random_texts(300, 12) + ["", " ", "  ", "the  the", "▁", "a▁▁b", " x "]
    for i in range(0, len(texts), 9):
        part = pa.array(["skipped", *texts[i : i + 9]]).slice(1)
        assert lengths.count(part).tolist() == [len(model.encode(t)) for t in texts[i : i + 9]]


def test_words_are_learned_anew_when_forgotten(monkeypatch):

    monkeypatch.setattr(token_files, "WORDS", 30)
    monkeypatch.setattr(token_files, "PIECES", 20)
    file = vocab.path(queries.WORD_BPE)
    model, encoder = vocab.word_tokenizer(file), token_files.Encoder(file, 2)
    texts = random_texts(200, 9) + ["Don't STOP <|endoftext|>x", "ÀÉß×÷ñ µ ǅ Σ", ""]
    for i in range(0, len(texts), 7):
        flat, stops = encoder.encode(pa.array(texts[i : i + 7]))
        for t, ids in zip(texts[i : i + 7], np.split(flat, stops[:-1]), strict=True):
            assert ids.tolist() == model.encode(t, add_special_tokens=False).ids + [2], t


def test_rans_blocks(monkeypatch):
    monkeypatch.setattr(rans, "CHECKPOINT", 4096)
    ids = np.random.default_rng(1).zipf(1.3, 60_000).clip(0, 4000).astype(np.uint16)
    table = rans.Table(np.bincount(ids, minlength=5000))
    assert table.freq.sum() == 1 << rans.SCALE
    data = rans.MAGIC + rans.encode_block(ids, [1, 2], [10, len(ids) - 10], 0, table) + rans.encode_block(ids[:1], [3], [1], 9, table)
    first, second = rans.blocks(data)
    assert (first.decode(table) == ids).all() and (second.decode(table) == ids[:1]).all() and len(first.marks) > 5
    k = 3
    assert (first.decode_part(k, table) == ids[first.marks[k][0] * first.lanes : first.marks[k + 1][0] * first.lanes]).all()
    monkeypatch.undo()  # so many checkpoints take more than they save
    assert len(rans.encode_block(ids, [1], [len(ids)], 0, table)) < 1.5 * len(ids)
    with pytest.raises(ValueError):
        list(rans.blocks(data[:-1]))
    with pytest.raises(ValueError):
        list(rans.blocks(data[:200] + bytes([data[200] ^ 1]) + data[201:]))
    only = rans.Table(np.array([0, 9]))
    assert (next(rans.blocks(rans.MAGIC + rans.encode_block(np.ones(70, np.uint16), [1], [70], 0, only))).decode(only) == 1).all()


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\xff\xff\xff\0\0\0\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0\x3b"


def test_sniffing_confirms_carves_and_corrects(spark):
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
    for value, kind in ((png(), "image/png"), (GIF, "image/gif"), (media.wav(b"ab" * 9), "audio/wav"), (z.getvalue(), "application/zip"), (pdf, "application/pdf"), (bmp, "image/bmp"), (gzip.compress(b"abc"), "application/gzip")):
        whole, inside = media.sniff(value)
        assert (whole.type, whole.length, inside) == (kind, len(value), []), kind
        assert media.sniff(value[:-1])[0] is None, kind
        assert [(f.offset, f.type) for f in media.sniff(b"text " + value + b" GIF89a BM RIFF %PDF- PK\x03\x04")[1]] == [(5, kind)]
    rows = spark.createDataFrame([(1, bytearray(png() + b"..." + GIF), "text/html", "x"), (2, None, None, "x"), (3, bytearray(b""), "image/png", "x")], "id int, value binary, declared string, detected string")
    a, b, c = sorted(media.sniff_media(rows, "id", "value", "declared").collect())
    assert (a.detected, a.corrected, [(e.type, bytes(e.content)) for e in a.embedded]) == ("image/png", True, [("image/gif", GIF)])
    assert (b.detected, b.corrected, c.detected, c.corrected) == (None, False, None, False)


def test_many_magic_bytes_stay_cheap():
    import time

    for piece in (b"PK\x03\x04", b"%PDF-1.4 ", b"\xff\xd8\xff\xdb\x00\x04ab", b"PK\x05\x06" + b"\0" * 18, b"GIF89a", b"%PDF-1.4 endobj "):
        value = piece * (1_000_000 // len(piece))
        start = time.process_time()
        assert media.sniff(value)[0] is None
        assert time.process_time() - start < 20, piece


def test_media_query_rows(spark):
    texts = MESSY + ["RIFF GIF89a BM PNG", "a" * 576, "a" * 577]
    want = []
    for t in texts:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), hashlib.sha256(media.wav(payload)).hexdigest()))
    got = media.media_features(media.store_texts(messy(spark, texts))).collect()
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in got) == sorted(want)
    assert all("embedded=0" in r.feature for r in got)
    assert media.media_features(media.store_texts(messy(spark).limit(0))).count() == 0
