import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cardspark.llm import bpe
from cardspark.llm.common import tokenizer_path
from cardspark.llm.packing import best_fit_decreasing, pack
from cardspark.llm.token_counts import Counter, token_counts
from cardspark.llm.word_tokens import WordTokenizer, encode_decode

ODD = [None, "", " ", "  \n\t x  \t", "'s 's''s x's x're x'r x'l x'll 'l", "a'", "'r", "'v\n", "x 'll  'll\t'll", "Hello <|endoftext|> x<|startoftext|>", "ΟΔΟΣ İstanbul ½ ² 漢字カタカナ 😀😀 \x1c\x1d áé don't I'LL", "\0\0<|endoftext|>", "'" * 50 + "é" * 300, "a\u0085b c d", "12 34,56 ٣٤", "x" * 5000, "word " * 20000]


@pytest.fixture(scope="module")
def byte_tokens():
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), Counter(tokenizer_path("byte_bpe_50k.json"), bpe.classes())


@pytest.fixture(scope="module")
def word_tokens():
    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), WordTokenizer(tokenizer_path("word_bpe_49k.json"), bpe.classes(), True)


@settings(max_examples=200, deadline=None)
@given(text=st.one_of(st.text(max_size=80), st.text("'  \n\tsrevlldm1,aé", max_size=60)))
def test_counts_match_the_library(byte_tokens, text):
    library, counter = byte_tokens
    assert counter.counts([text, text + " "]).tolist() == [len(library.encode(x, add_special_tokens=False).ids) for x in (text, text + " ")]


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=80))
def test_ids_and_decoding_match_the_library(word_tokens, text):
    library, own = word_tokens
    (entries,) = own.entries([text])
    ids = library.encode(text, add_special_tokens=False).ids
    assert memoryview(b"".join(e[0] for e in entries)).cast("I").tolist() == ids
    assert " ".join(e[1] for e in entries) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pair_check_is_the_merges(name):
    own = bpe.WordTrieEncoder(tokenizer_path(name))
    draw = random.Random(1)
    ids = list(own.symbols_of)
    for _ in range(2000):
        symbols = own.symbols_of[draw.choice(ids)]
        cut = draw.randrange(len(symbols) + 1)
        pair = [own.ids.get(symbols[:cut]), own.ids.get(symbols[cut:])]
        pair = [draw.choice(ids) if p is None else p for p in pair]
        assert own._pair(*pair) == (own.merged(own.symbols_of[pair[0]] + own.symbols_of[pair[1]]) == pair)


def test_token_counts_table(spark, byte_tokens):
    library, _ = byte_tokens
    df = spark.createDataFrame([(k, x, 1) for k, x in enumerate(ODD)] + [(3, ODD[3], 1)], "doc_id long, text string, n_tokens int")
    found = sorted(map(tuple, token_counts(df, tokenizer_path("byte_bpe_50k.json"), keep=("doc_id",)).collect()))
    expected = []
    for k, x in [*enumerate(ODD), (3, ODD[3])]:
        n = len(library.encode(x or "", add_special_tokens=False).ids)
        expected.append((k, len((x or "").encode()), n, n > 1024))
    assert found == sorted(expected)
    assert token_counts(df.limit(0), tokenizer_path("byte_bpe_50k.json"), keep=("doc_id",)).count() == 0


def test_encode_decode_table(spark, word_tokens):
    library, _ = word_tokens
    df = spark.createDataFrame([(k, x, "e") for k, x in enumerate(ODD)], "doc_id long, text string, ids string")
    for r in encode_decode(df, tokenizer_path("word_bpe_49k.json"), keep=("doc_id",)).collect():
        ids = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, decoded)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert encode_decode(df.limit(0), tokenizer_path("word_bpe_49k.json"), keep=("doc_id",)).count() == 0


@settings(max_examples=100, deadline=None)
@given(window=st.sampled_from([8, 16, 100]), items=st.lists(st.integers(1, 99), max_size=200))
def test_plan_is_best_fit_decreasing(window, items):
    items = [1 + i % (window - 1) for i in items]
    counts = defaultdict(int)
    for i in items:
        counts[i] += 1
    plan, used = best_fit_decreasing(dict(counts), window)
    left = []
    for i in sorted(items, reverse=True):
        fit = [(r, k) for k, r in enumerate(left) if r >= i]
        if fit:
            left[min(fit)[1]] -= i
        else:
            left.append(window - i)
    content, placed = defaultdict(list), defaultdict(int)
    for length, rank, n, first, offset, per in plan:
        assert rank == placed[length]
        placed[length] += n
        for j in range(n):
            content[first + j // per].append((offset + j % per * length, length))
    assert placed == counts and used == len(left)
    assert sorted(window - sum(n for _, n in c) for c in content.values()) == sorted(left)


@pytest.mark.parametrize("window", [64, 4096])
def test_packing_table(spark, word_tokens, window):
    library, _ = word_tokens
    texts = [*ODD, "a b c", "a b c"]
    df = spark.createDataFrame([(k, x, 7) for k, x in enumerate(texts)], "doc_id long, text string, offset int").repartition(3)
    pieces = pack(df, tokenizer_path("word_bpe_49k.json"), window=window).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for k, x in enumerate(texts):
        ids = [*library.encode(x or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(by_doc[k], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    assert pack(df.limit(0), tokenizer_path("word_bpe_49k.json"), window=window).count() == 0
