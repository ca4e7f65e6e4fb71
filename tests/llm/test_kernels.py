"""Task-side kernels against brute force."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tierlens.llm import line_dedup
from tierlens.llm.bitslice import close_pairs, group_ends, spanning_roots
from tierlens.llm.decontamination import Search, searches
from tierlens.llm.license_scan import TEMPLATES, Index, align, winnow
from tierlens.llm.line_dedup import edit_distance, line_prints
from tierlens.llm.shingles import mixed, shingle_hashes, simhash
from tierlens.llm.simhash_dedup import block_masks
from tierlens.llm.substring_dedup import sentences_of, spans_of
from tierlens.llm.token_counts import Counter


@pytest.mark.parametrize("words,radius", [(1, 0), (1, 2), (1, 3), (4, 50)])
@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 300])
def test_close_pairs(n, words, radius):
    rng = np.random.default_rng(n + words)
    fp = rng.integers(0, 2**64, (n, words), dtype=np.uint64)
    for i in range(1, n, 2):
        fp[i] = fp[0]
        for bit in rng.integers(0, 64 * words, rng.integers(0, 2 * radius + 2)):
            fp[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    end = group_ends(np.sort(rng.integers(0, n // 40 + 1, n)))
    got = {(int(a), int(b)) for i, j in close_pairs(fp, end, radius) for a, b in zip(i, j)}
    want = {(i, j) for i in range(n) for j in range(i + 1, int(end[i])) if sum(int(x).bit_count() for x in fp[i] ^ fp[j]) <= radius}
    assert got == want


def test_spanning_roots_asks_only_for_pairs_not_yet_connected():
    asked = []
    pairs = [(np.array([0, 1, 0]), np.array([1, 2, 2]))]
    root = spanning_roots(4, pairs, lambda i, j: asked.append((i, j)) or True)
    assert root.tolist() == [0, 0, 0, 3] and asked == [(0, 1), (1, 2)]


def test_block_masks_cover_every_pattern_of_differing_bits():
    masks = [m % (1 << 64) for m in block_masks(2)]
    assert len(masks) == 15
    rng = random.Random(1)
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), 2))
        assert any(diff & m == 0 for m in masks)


def test_simhash_by_hand():
    h = shingle_hashes(b"A b  c\td", 3)
    assert len(h) == 2 and (h == shingle_hashes(b"a B c d", 3)).all()
    assert len(shingle_hashes(None, 3)) == len(shingle_hashes(b" \n", 3)) == 0
    assert len(shingle_hashes(b"one two", 3)) == 1
    many = np.random.default_rng(3).integers(0, 2**64, 70_001, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((many >> np.uint64(b) & np.uint64(1)).sum()) > len(many))
    assert int(simhash(many)[0]) == want and int(simhash(np.zeros(0, np.uint64))[0]) == 0


@given(st.text("abc", max_size=80), st.text("abc", max_size=80))
@settings(max_examples=200, deadline=None)
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    assert edit_distance(a, b) == row[-1]


def test_line_prints_do_not_depend_on_the_batch(monkeypatch):
    rng = random.Random(2)
    lines = [" ".join("".join(rng.choices("abcé", k=3)) for _ in range(n)) for n in (1, 2, 5, 50, 700, 40_000, 300)]
    together = [int(x) for x in line_prints(lines)]
    assert [int(line_prints([x])[0]) for x in lines] == together
    monkeypatch.setattr(line_dedup, "_PIECE", 50)
    assert [int(x) for x in line_prints(lines)] == together
    words = [sum((b + 1) * pow(line_dedup._BASE, i, 1 << 64) for i, b in enumerate(w.encode())) % (1 << 64) for w in lines[4].split()]
    assert int(simhash(mixed(np.array(words, np.uint64), 1))[0]) == together[4]
    assert line_prints(["a b"]) == line_prints(["b a"]) != line_prints(["ab"])
    assert line_prints([]).tolist() == []


@given(st.text(" ab.!?\n", max_size=200))
@settings(max_examples=300, deadline=None)
def test_sentences_tile_the_text(text):
    parts = sentences_of(text, 4)
    assert "".join(text[s:e] for s, e, _ in parts) == text
    assert sum(n for _, _, n in parts) == len(text.split()) and all(n <= 4 for _, _, n in parts)


def test_a_passage_inside_a_long_sentence_is_found():
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    for _ in range(20):
        passage = words(80)
        known = {h for h, _, _ in spans_of(f"{words(9)} {passage}   {words(5)}")}
        two = f"{words(4)} {passage}{' ' * 40}{words(7)}"
        parts = sentences_of(two)
        covered = {i for h, a, b in spans_of(two) if h in known for i in range(a, b + 1)}
        assert sum(parts[i][2] for i in covered) > 40 and all(two[s:e].strip() in passage for s, e, _ in (parts[i] for i in covered))


def test_every_long_aligned_passage_is_covered_by_spans():
    rng = random.Random(4)

    def prose(n):
        return " ".join(("".join(rng.choices("abcdefgh", k=5)) + ("." if rng.random() < 0.12 else "")) for _ in range(n)) + "."

    for _ in range(50):
        passage = prose(rng.randint(51, 120))
        one, two = f"{prose(30)}\n{passage}\n{prose(30)}", f"{prose(8)}\n{passage}\n{prose(3)}"
        known = {h for h, _, _ in spans_of(one)}
        covered = {i for h, a, b in spans_of(two) if h in known for i in range(a, b + 1)}
        parts = sentences_of(two)
        start = two.index(passage)
        inside = {i for i, (s, e, _) in enumerate(parts) if s >= start and e <= start + len(passage) + 1}
        assert inside == covered


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=8), max_size=6))
@settings(max_examples=300, deadline=None)
def test_wu_manber_finds_what_a_scan_finds(words, items):
    segments = [(str(i), b" ".join(x)) for i, x in enumerate(items)]
    got = {(s, p, i) for search in searches(segments, 5) for s, p in search.find(words) for i in search.items[p]}
    want = set()
    for i, x in enumerate(items):
        n = min(5, len(x))
        windows = {tuple(x[k:k + n]) for k in range(len(x) - n + 1)}
        want |= {(s, tuple(words[s:s + n]), str(i)) for s in range(len(words) - n + 1) if tuple(words[s:s + n]) in windows}
    assert got == want


def test_wu_manber_skips():
    search = Search(10, {tuple(f"w{i}".encode() for i in range(10)): {"1"}})
    assert search.skip == 8 and set(search.shift.values()) == set(range(8))


def test_winnow_and_alignment():
    assert winnow([]) == [] and winnow([5, 4]) == [1] and winnow([3, 1, 2, 1, 9]) == [1, 3]
    assert align([1, 2, 3, 4], [9, 1, 2, 3, 4, 9], 0, 2) == (4, 1, 4)
    assert align([1, 2, 3, 4], [9, 1, 2, 8, 3, 4], 0, 3) == (4, 1, 5)
    assert align([1, 2], [7, 7], 0, 1) == (0, -1, -1)
    index = Index(TEMPLATES)
    for name, text in TEMPLATES.items():
        words = [index.number.get(w, 0) for w in text.lower().replace(",", " ").split()]
        assert name in {m[0] for m in index.matches([0] * 7 + index.words[index.names.index(name)] + [0] * 3, 0.99)}, words


@pytest.fixture(scope="module")
def counter():
    return Counter(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_whole_tokens_are_proven(counter, library):
    sample = sorted(counter.whole)[::97]
    assert len(counter.whole) > 45_000
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in sample)


@given(text=st.text(st.characters(codec="utf-8"), max_size=60) | st.text(" \n'abtsdlrevm1 <|>\x1c\x85 é²½Ⅷ٣", max_size=60))
@settings(max_examples=400, deadline=None)
def test_token_counts_equal_the_library(counter, library, text):
    for t in (text, text + "<|endoftext|>" + text):
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_very_long_pre_tokens(counter, library):
    for t in ("a" * 5000, "ab" * 3000 + "é" * 900, " " * 4000, "\n" * 999 + "x", "thonor" * 400):
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids)
