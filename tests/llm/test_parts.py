"""The Spark-free parts of the operators against brute force."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from auctionstream.llm import licenses, mixing, simhash, suffix_arrays, token_counts, token_files, toxicity
from auctionstream.llm.repeats import MOST_STARTS, segments

BYTES = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 32), st.data())
def test_packed_ids_come_back(bits, data):
    ids = data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=40))
    packed = token_files.pack(np.array(ids, np.uint64), bits)
    assert len(packed) == -(-len(ids) // 8) * bits
    first = data.draw(st.integers(0, len(ids)))
    count = data.draw(st.integers(0, len(ids) - first))
    assert token_files.unpack(packed, bits, first, count).tolist() == ids[first : first + count]


@pytest.mark.parametrize("vocabulary, bits", [(1, 1), (2, 1), (3, 2), (49_408, 16), (65_536, 16), (65_537, 17)])
def test_width(vocabulary, bits):
    assert token_files.width(vocabulary) == bits


TEXTS = [
    "", " ", "a", "Hello, World. It's 3pm!!", "x\x1cy\x1dz", "tab\tnew\nline\x0b\x0c\r end ", "<|endoftext|> inside<|startoftext|>x",
    "Ångström é ΣΑΣ İstanbul ﬁne 12,345.67", "word.. word., don't '' 's", "日本語 テスト。", "a b c", "_x_ __",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_of_words_are_those_of_the_text(text):
    expected = token_files.tokenizer(BYTES).encode(text, add_special_tokens=False).ids
    ids = token_files.WordIds(token_files.tokenizer(BYTES))
    assert ids.of(text).tolist() == expected == ids.of(text).tolist()


@pytest.mark.parametrize("text", [*TEXTS, "▁odd ▁▁ marks", "no" * 300, "a  b   c\n\n\nd" * 40, "word " * 200, "é☃𝔘 " * 90])
@pytest.mark.parametrize("chunk, overlap", [(16, 4), (64, 8), (50, 1)])
def test_chunked_counts_are_those_of_the_library(text, chunk, overlap):
    model, pairs = token_counts.encoder(PIECES)
    assert token_counts.count_in_chunks(text, model, pairs, chunk, overlap) == len(model.encode(text))


def test_overlap_is_widened_to_the_whole_text():
    model, pairs = token_counts.encoder(PIECES)
    text = "ab" * 5_000  # every neighbouring pair stands in some piece
    assert token_counts.stable_boundary(text, 0, len(text), pairs) is None
    assert token_counts.count_in_chunks(text, model, pairs, 100, 10) == len(model.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.integers(1, 4))
def test_suffix_array_and_prefixes(symbols, times):
    s = symbols * times + [0]
    order = sorted(range(len(s)), key=lambda i: s[i:])
    array = np.array(s, np.uint16)
    sa = suffix_arrays.suffix_array(array)
    assert sa.tolist() == order
    before, shared = suffix_arrays.permuted_prefixes(array, sa)
    for b, a in itertools.pairwise(order):
        same = next(k for k in range(len(s)) if s[a + k] != s[b + k])
        assert (before[a], shared[a]) == (b, same)


def test_large_alphabets_and_recursion_sort_alike():
    random.seed(3)
    for k in (2, 5, 500):
        s = np.array([random.randint(1, k) for _ in range(3_000)] * 2 + [0], np.int64)
        assert suffix_arrays.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_every_level_of_the_induced_sort_alike():
    random.seed(4)
    for k, n in itertools.product((1, 2, 3, 40), (0, 1, 2, 3, 200)):
        s = np.array([random.randint(1, k) for _ in range(n)] * 3 + [0], np.int64)
        order = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert suffix_arrays.suffix_array(s, suffix_arrays._induced_singly).tolist() == order


def test_segments_of_periodic_text_are_cut():
    found = list(segments(b"ab" * 10_000, 100))
    assert max(n - 99 for _, n, _, _, _ in found) == MOST_STARTS
    assert sum(n - 99 for _, n, _, _, _ in found) == 20_000 - 99


def test_segments_hold_every_string_once_and_equal_strings_share_keys():
    random.seed(1)
    text = bytes(random.choice(b"ab") for _ in range(900)) * 2 + b"c" * 700
    keys = {}
    starts = []
    for start, n, key, _, _ in segments(text, 100):
        for p in range(start, start + n - 99):
            starts.append(p)
            assert keys.setdefault(text[p : p + 100], key) == key
    assert starts == list(range(len(text) - 99))


def brute_pairs(prints):
    return {(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if bin(prints[i] ^ prints[j]).count("1") <= 2}


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 300])
def test_bit_sliced_distances(n):
    random.seed(n)
    base = random.getrandbits(64)
    prints = []
    for _ in range(n):
        x = base if random.random() < 0.5 else random.getrandbits(64)
        for _ in range(random.randint(0, 4)):
            x ^= 1 << random.randrange(64)
        prints.append(x)
    left, right = simhash.sliced_links(np.array(prints, np.uint64))
    assert set(zip(left.tolist(), right.tolist())) == brute_pairs(prints)


def test_roots_follow_chains():
    left, right = np.array([0, 1, 2, 5]), np.array([1, 2, 3, 6])
    assert simhash.roots(7, left, right).tolist() == [0, 0, 0, 0, 4, 5, 5]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_permutations_are_bijections_and_differ_by_key(n):
    index, size = np.arange(n, dtype=np.uint64), np.full(n, n, np.uint64)
    one = mixing.permuted(index, size, np.full(n, 5, np.uint64))
    two = mixing.permuted(index, size, np.full(n, 6, np.uint64))
    assert sorted(one.tolist()) == sorted(two.tolist()) == list(range(n))
    assert n < 65 or one.tolist() != two.tolist()


def test_noisy_or_locates_the_offending_sentence():
    model = toxicity.Model({b"awful": 9.0, b"loser~": 9.0}, -5.0)
    text = "Nice day.\nYou awful man! Fine. Loserish one".encode()
    score, found = toxicity.score_text(text, model, 0.3)
    assert [text[b:e].strip() for b, e, _ in found] == [b"You awful man!", b"Loserish one"]
    p = 1 / (1 + np.exp(-4.0))
    q = 1 / (1 + np.exp(5.0))
    assert score == pytest.approx(1 - (1 - p) ** 2 * (1 - q) ** 2)


def test_documents_train_sentences():
    random.seed(0)
    plain = [f"w{random.randrange(40)} w{random.randrange(40)} x." for _ in range(900)]
    bags = []
    for i in range(150):
        text = plain[i * 6 : i * 6 + 6]
        if i % 3 == 0:
            text[i % 6] += " vile thing."
        bags.append((int(i % 3 == 0), toxicity._sentences(" ".join(text).encode())))
    telling = toxicity._telling(bags)
    assert {b"vile", b"thing"} <= set(telling[:2]) 


def test_alignment_allows_edits_within_the_band():
    index = licenses.build_index(licenses.TEMPLATES)
    text = "Intro. Licensed under  the very Apache License, Version 2.0! Rest"
    [(name, begin, end, coverage, n)] = licenses.find(text, index, 0.8)
    assert (name, coverage, n) == ("Apache-2.0", 1.0, 8) and text[begin:end].startswith("Licensed under")
    assert text[begin:end].endswith("2.0")
    assert licenses.find("The Apache people fly under the radar", index, 0.8) == []


def test_the_longer_license_text_stays():
    index = licenses.build_index(licenses.TEMPLATES)
    long = licenses.TEMPLATES["Apache-2.0"][1]
    [(name, begin, end, coverage, _)] = licenses.find(f"x {long} y", index, 0.8)
    assert (name, begin, coverage) == ("Apache-2.0", 2, 1.0) and end >= len(long)


def test_shared_words_share_a_fingerprint():
    random.seed(5)
    for _ in range(200):
        common = [random.randint(1, 9) for _ in range(licenses.GRAM + licenses.WINNOW - 1)]
        a = [random.randint(1, 9) for _ in range(5)] + common + [random.randint(1, 9) for _ in range(5)]
        b = common + [random.randint(1, 9) for _ in range(3)]
        assert set(licenses.winnowed(np.array(a, np.uint64))[0]) & set(licenses.winnowed(np.array(b, np.uint64))[0])


def test_remembered_ids_are_few_and_right(monkeypatch):
    """Words of shared and of own pieces, far more of them than are remembered, many texts at once."""
    import pyarrow as pa

    monkeypatch.setattr(token_files, "REMEMBERED", 40)
    library = token_files.tokenizer(BYTES)
    ids = token_files.WordIds(library)
    texts = [
        "Straße ÉTÉ été Été, don't DON'T it's 12345 a-b-c ... x1y2 ×÷ ß ÿ é́ 日本 \x1c  [a] end-", "", "  ", "<|endoftext|> in a text",
        *[" ".join(f"Word{i}{'abc'[i % 3] * (i % 5)}, {i}x{i * 7}" for i in range(k, k + 30)) for k in range(0, 300, 20)],
    ]
    for _ in range(2):
        flat, counts = ids.of_many(pa.array(texts, pa.large_string()))
        assert [len(library.encode(t, add_special_tokens=False).ids) for t in texts] == list(counts)
        assert [i for t in texts for i in library.encode(t, add_special_tokens=False).ids] == flat.tolist()
        assert len(ids) + len(ids.earlier) <= 40
