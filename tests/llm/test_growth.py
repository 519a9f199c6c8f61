"""What operators do as tables and groups of similar rows grow."""

import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hashing, ngram_join, packing
from tests.llm.test_llm_operators import docs_of, linked_components, made, shingle_set


def one_group(n, seed=4):
    """Copies of one text, about half of them too far from all others."""
    rng, base, texts = np.random.default_rng(seed), made(1, 8, 200, 201, 4000)[0].split(), []
    for i in range(n):
        words = list(base)
        for at in rng.integers(0, len(words), rng.integers(3, 15)):
            words[at] = f"new{i % 40}x{rng.integers(4)}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("cheaper", [16, 0])
def test_members_of_a_large_group_do_not_meet_in_each_of_its_lists(spark, monkeypatch, cheaper):
    """With 0 no group is compared whole."""
    rows, gathered = [], ngram_join._gathered

    def counted(met, few, signed):
        rest, links = gathered(met, few, signed)
        long = F.col("many") > ngram_join.RARE
        rows.append((few.filter(long).count(), rest.filter(long).count()))
        return rest, links

    monkeypatch.setattr(ngram_join, "_gathered", counted)
    monkeypatch.setattr(ngram_join, "CHEAPER", cheaper)
    monkeypatch.setattr(ngram_join, "TILE_FEW", 11)
    monkeypatch.setattr(ngram_join, "TILE_OTHERS", 30)
    texts = one_group(150) + made(30, 3)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs_of(spark, texts)).collect()}
    expected = linked_components([shingle_set(t) for t in texts])
    assert [got[i] for i in range(len(texts))] == expected
    assert 5 < len(set(expected[:150])) < 145
    ((before, after),) = rows
    assert before > 100 and after == (0 if cheaper else before)


def plain_words(data, gap, fold):
    """Hash, start and end of every word, a word at a time."""
    values = hashing._FOLDED if fold else hashing._BYTE
    inside = [not gap[x] for x in data] + [False]
    start = [i for i in range(len(data)) if inside[i] and not (i and inside[i - 1])]
    end = [inside.index(False, i) for i in start]
    total = [sum(int(values[x]) * pow(int(hashing._BASE), j + 1, 1 << 64) for j, x in enumerate(data[a:b].tolist())) + b - a for a, b in zip(start, end, strict=True)]
    return hashing.mix(np.array([t % (1 << 64) for t in total], np.uint64)), start, end


@pytest.mark.parametrize("n", [0, 1, 40, hashing._STRIDE - 1, hashing._STRIDE, 2 * hashing._STRIDE + 5])
def test_word_hashes_from_running_sums(n):
    rng = np.random.default_rng(n)
    data = rng.choice(np.frombuffer("abXY9é. \n\t".encode(), np.uint8), n)
    data[n // 2 : n // 2 + 300] = 97  # across the border of two strides, if there are two
    for gap in (hashing.WHITE, hashing.NOT_ALNUM):
        for fold in (True, False):
            for got, expected in zip(hashing.words(data, gap, fold), plain_words(data, gap, fold), strict=True):
                assert list(got) == list(expected)


def test_words_are_hashed_without_an_array_of_numbers_for_all_bytes():
    """Eight bytes for each of the text, and more than once, were at work before."""
    data = np.frombuffer(b"a word or two " * 200_000, np.uint8)
    tracemalloc.start()
    hashing.words(data, np.ones(256, bool))
    hashing._sums(hashing._FOLDED, data, np.array([0, len(data)]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * len(data)


def test_encoder_keeps_pieces_that_come_again(monkeypatch):
    """Rare pieces alone are forgotten when too many are held; ids stay those of the tokenizer."""
    monkeypatch.setattr(packing, "_KNOWN", {})
    monkeypatch.setattr(packing.Encoder, "MOST", 120_000)
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    common = [f"often{i}" for i in range(500)]
    for turn in range(6):
        rare = [f"once{turn}x{i}" for i in range(30_000)]
        text = " ".join(common + rare + ["é\n\n ünd,"] + common)
        _, data, ends = next(hashing.blocks([text.encode()]))
        ids = encoder.block(data, ends)[0]
        assert ids[:-1].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.names) + encoder.n_new <= 120_000 + 50_000
    if encoder.new:
        encoder.remember()
    _, data, ends = next(hashing.blocks([" ".join(common).encode()]))
    encoder.block(data, ends)
    held = len(encoder.names)
    assert encoder.seen.sum() >= 499
    encoder.forget_unseen()
    assert 499 <= len(encoder.names) < 1_100 < held
