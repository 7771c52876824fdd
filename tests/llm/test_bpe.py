import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from funnelkit.llm import bpe
from funnelkit.llm import words as w

tokenizers = pytest.importorskip("tokenizers")
BITS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "'", " ", "  ", "\n", "\t", " ", "　", "a",
        "re", "the", "é", "ß", "1", "²", "Ⅷ", "42", "!", "??", "_", "😀", "漢字", "<|endoftext|>", "<|endoftext",
        "|>", "​", "\x85", "\x00", "\x1c", "l", "ll", "don", "''", "ﬁ", "́", "٣", "x" * 40, "=" * 30,
        "aaaa", "\r\n"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_automaton(bpe.tokenizer_path()), bpe.character_classes())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.tokenizer_path())


def encode(codec, texts, limit=1 << 20):
    out = []
    for _, _, buf, off in w.text_blocks(pa.array(texts, pa.string()), limit):
        out += [np.frombuffer(b, "<u4").tolist() for b in codec.encode(buf, off)]
    return out


def plain(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_equals_the_library(codec, library):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randrange(14))) for _ in range(6000)]
    want = plain(library, texts)
    assert encode(codec, texts) == want
    assert encode(codec, texts[:300], limit=1) == want[:300]
    for ids, text in zip(want[:500], texts, strict=False):
        assert codec.decode(np.array(ids, np.int64)).decode() == text


def test_every_character(codec, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in points]
    assert encode(codec, texts) == plain(library, texts)


def test_random_letters_and_long_words(codec, library):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aeionrst") for _ in range(rnd.randrange(40))) for _ in range(3000)]
    texts += ["ab" * 3000, "=" * 5000, "é" * 2000, " " * 3000, "x\n" * 800]
    assert encode(codec, texts) == plain(library, texts)


def test_exactly_one_path(codec):
    """Of all ways to cut a word into tokens the automaton accepts exactly one."""
    a = codec.automaton

    def paths(word, state):
        if not word:
            return 1
        return sum(paths(word[i:], a.ids[word[:i]]) for i in range(1, len(word) + 1)
                   if word[:i] in a.ids and a.arc(state, a.ids[word[:i]]))

    rnd = random.Random(3)
    for _ in range(300):
        assert paths("".join(rnd.choice("aaabthe ") for _ in range(rnd.randrange(1, 9))).encode(), bpe.START) == 1


def test_small_merges_by_hand():
    labels = {i: bytes([i]) for i in range(256)}
    merges = [(b"a", b"a"), (b"aa", b"a"), (b"b", b"aa")]
    for i, (x, y) in enumerate(merges):
        labels[256 + i] = x + y
    a = bpe.Automaton(labels, merges)
    assert a.encode_word(b"aaaaa") == [256, 257]
    assert a.encode_word(b"baa") == [258]
    assert a.encode_word(b"baaa") == [98, 257]


def test_every_vocabulary_entry(codec, library):
    """Each token's text alone and after a word, where it is a text."""
    texts = []
    for label in codec.automaton.labels.values():
        try:
            texts += [label.decode(), "the " + label.decode() + "s"]
        except UnicodeDecodeError:
            continue
    assert len(texts) > 90_000
    assert encode(codec, texts) == plain(library, texts)


def test_merge_whose_path_is_gone():
    labels = {i: bytes([i]) for i in range(256)}
    merges = [(b"b", b"c"), (b"a", b"b"), (b"ab", b"c"), (b"abc", b"d")]
    for i, (x, y) in enumerate(merges):
        labels[256 + i] = x + y
    a = bpe.Automaton(labels, merges)
    assert a.encode_word(b"abc") == [97, 256]
    assert a.encode_word(b"abcd") == [97, 256, 100] and a.encode_word(b"ab") == [257]


@pytest.mark.parametrize("seed", range(6))
def test_random_merge_lists_equal_the_library(seed):
    """Merges in any order over few letters, dead ones among them."""
    rnd = random.Random(seed)
    letters = [bytes([c]) for c in b"abc"]
    tokens, merges = list(letters), []
    while len(merges) < 25:
        x, y = rnd.choice(tokens), rnd.choice(tokens)
        if x + y not in tokens and len(x + y) <= 7:
            tokens.append(x + y)
            merges.append((x, y))
    labels = dict(enumerate(tokens))
    a = bpe.Automaton(labels, merges)
    model = tokenizers.models.BPE(vocab={t.decode(): i for i, t in labels.items()},
                                  merges=[(x.decode(), y.decode()) for x, y in merges])
    lib = tokenizers.Tokenizer(model)
    for _ in range(400):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 14)))
        assert a.encode_word(word.encode()) == lib.encode(word).ids, (word, merges)


def test_query_rows(spark, library, tmp_path):
    rows = [(1, "Hello  world's <|endoftext|> é"), (2, None), (3, ""), (None, "x"), (1, "again"), (1, "again"),
            (4, "long word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted([tuple(r) for r in bpe.token_digests(df).collect()], key=str)
    want = []
    for d, t in rows:
        ids = plain(library, [t or ""])[0]
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_round_trip_and_extra_columns(spark):
    schema = "doc_id long, text string, ids string, row int, n_tokens string"
    path = bpe.tokenizer_path()
    assert bpe.encode_documents(spark.createDataFrame([], schema), path).collect() == []
    df = spark.createDataFrame([(1, "Naïve café's 12 ", "i", 5, "n")], schema)
    enc = bpe.encode_documents(df, path)
    [row] = enc.collect()
    assert tuple(row.row) == (1, "Naïve café's 12 ", "i", 5, "n") and row.n_tokens == len(row.ids)
    assert bpe.decode_documents(enc, path).first().decoded == "Naïve café's 12 "
    odd = spark.createDataFrame([([464, None, 10**6],), (None,), ([447],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode_documents(odd, path).collect()] == ["The", "", "�"]


def test_other_tokenizers_are_refused():
    path = bpe.tokenizer_path("word_bpe_49k.json")
    assert os.path.exists(path)
    with pytest.raises(ValueError):
        bpe.load_automaton(path)
