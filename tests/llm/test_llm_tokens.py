"""Encoders, counts and files against the libraries whose results they must equal."""

import base64
import hashlib
import random
import struct
import zlib

import corpus
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from chronoweave.llm import byte_bpe, common, pretokens, sequence_files, token_counts

RANKS, PIECES, LIBRARY = (public_tokenizers.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model", "byte_bpe_50k.json"))
BITS = [" ", "  ", "\n", "\t", "a", "B", "é", "ß", "漢", "1", "23", "'s", "'", "<s>", "▁", "▁▁", "😀", "\x1c", "\x85", "​", "²", "½", "<|endoftext|>", "the", "ing", " the", "!!", "--", " "]


def fuzz(n=3000):
    draw = random.Random(5)
    return ["".join(draw.choice(BITS) for _ in range(draw.randint(0, 30))) for _ in range(n)] + ["", " ", "   ", "aaaa" * 300, " " * 70, "\n" * 70, corpus.LONG]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_the_fast_pattern_is_equal():
    import regex

    assert pretokens.BYTE_LEVEL == public_tokenizers.PATTERN
    find, plain = pretokens.finder(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    draw = random.Random(8)
    texts = ["".join(chr(draw.randrange(256)) for _ in range(draw.randint(0, 40))) for _ in range(4000)]
    for text in texts + fuzz():
        assert find(text) == plain(text)


def test_byte_bpe_equals_the_library(tik):
    bpe = byte_bpe.load(RANKS, public_tokenizers.PATTERN)
    for text in fuzz():
        ids = bpe.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_every_character_class(tik):
    bpe = byte_bpe.load(RANKS, public_tokenizers.PATTERN)
    for c in [*range(0x3000), *range(0x3000, 0x110000, 97)]:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1 {chr(c)} {chr(c)}b"
            assert np.frombuffer(bpe.encode(text), "<u4").tolist() == tik.encode_ordinary(text), hex(c)


def test_backtracking_on_a_vocabulary_where_the_longest_match_is_wrong():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"bcd": 260, b"aa": 261, b"aaa": 262}
    bpe = byte_bpe.ByteBpe(ranks, r"\w+|\W+")
    library = tiktoken.Encoding("tiny", pat_str=r"\w+|\W+", mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(1)
    for _ in range(2000):
        text = "".join(draw.choice("abcd") for _ in range(draw.randint(1, 14)))
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_byte_bpe_rows(spark, tik):
    rows = byte_bpe.digests(corpus.docs(spark), RANKS, public_tokenizers.PATTERN).collect()
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    want = []
    for doc, text, _ in corpus.ROWS:
        ids = np.array(tik.encode_ordinary(text or ""), "<u4")
        want.append((doc or -1, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert byte_bpe.digests(corpus.none(spark), RANKS, public_tokenizers.PATTERN).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(corpus.docs(spark), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((d or -1, t or "") for d, t, _ in corpus.ROWS)


def test_piece_counts_equal_the_library():
    model, counter = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.load(PIECES)
    for text in fuzz():
        assert counter.count(text) == len(model.encode(text)), ascii(text[:80])


def test_piece_count_rows(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = token_counts.token_counts(corpus.docs(spark), PIECES).collect()
    want = []
    for doc, text, _ in corpus.ROWS:
        n = len(model.encode(text or ""))
        want.append((doc or -1, len((text or "").encode()), n, n > 4096))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted(want)
    assert token_counts.token_counts(corpus.none(spark), PIECES).count() == 0


def test_checksums_and_records():
    assert sequence_files.crc32c([b"123456789", b"", b"\0" * 32, b"\xff" * 32]) == [0xE3069283, 0, 0x8A9136AA, 0x62A8AB43]
    draw = random.Random(2)
    payloads = [draw.randbytes(n) for n in (0, 1, 63, 64, 65, 127, 128, 1000, 4096, 70_000)]

    def plain(data):
        crc = 0xFFFFFFFF
        for x in data:
            crc ^= x
            for _ in range(8):
                crc = crc >> 1 ^ (sequence_files.CASTAGNOLI if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    assert sequence_files.crc32c(payloads) == [plain(p) for p in payloads]
    records = sequence_files.frame(payloads)
    sizes, data = [len(r) for r in records], b"".join(records)
    assert sequence_files.unframe(data, sizes) == payloads
    for at in (0, 9, sizes[0] + 12, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            sequence_files.unframe(bytes(broken), sizes)
    with pytest.raises(ValueError):
        sequence_files.unframe(data[:-3], sizes)


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, None])
def test_sequence_files(spark, tmp_path, pattern):
    library, folder = Tokenizer.from_file(LIBRARY), f"{tmp_path}/out"
    manifest = sequence_files.write(corpus.docs(spark), folder, LIBRARY, pattern, end_id=2, parts=3)
    rows = sequence_files.digests(sequence_files.read(spark, folder)).collect()
    assert len(rows) == len(corpus.ROWS) == sum(r.docs for r in manifest.collect())
    want = {}
    for doc, text, _ in corpus.ROWS:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(doc, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert {d: sorted((r.n_tokens, r.ids_crc32) for r in rows if r.doc_id == d) for d in want} == {d: sorted(v) for d, v in want.items()}
    at, last = 0, None
    for r in sorted(rows, key=lambda r: r.start):  # ascending ids, each starting where the one before ends
        assert r.start == at and (last is None or r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else last
    # The offset index finds any record by itself.
    part = manifest.filter("docs > 1").first()
    offsets = np.frombuffer(open(f"{folder}/{part.file}.index", "rb").read(), "<u8")
    data = open(f"{folder}/{part.file}.records", "rb").read()
    one = data[offsets[1] : offsets[2]]
    assert struct.unpack("<Q", one[:8])[0] == len(one) - 16 and len(offsets) == part.docs + 1


def test_sequence_files_of_nothing(spark, tmp_path):
    sequence_files.write(corpus.none(spark), f"{tmp_path}/none", LIBRARY, public_tokenizers.PATTERN, end_id=2, parts=2)
    assert sequence_files.read(spark, f"{tmp_path}/none").count() == 0


def test_memo_forgets_nothing_that_matters():
    memo = common.Memo(lambda k: k * 2, 3)
    assert [memo[k % 7] for k in range(50)] == [k % 7 * 2 for k in range(50)] and len(memo) <= 3
