"""One text with more distinct words than the hash table starts with, for every operator that looks words up in it."""

import numpy as np
import pyarrow as pa
import pytest

from newsgrain.llm import kernel, langid, segment, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


def distinct_words(n):
    """Words of letters, no two equal, among them many a vocabulary knows."""
    letters = np.array(list("etaoinshr"))
    digits = (np.arange(n)[:, None] // 9 ** np.arange(7)) % 9
    return ["".join(row) for row in letters[digits]]


@pytest.mark.parametrize("bits", [4, 8, 12])
def test_table_grows(bits):
    rnd = np.random.default_rng(bits)
    table, added = kernel.Table(bits), np.zeros((0, 2), np.uint64)
    for n in (1, 7, 8, 9, 100, 5000, 1):
        pairs = rnd.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
        pairs[: n // 2, 0] = np.uint64(3)  # one home slot for half of them
        table.add(pairs[:, 0], pairs[:, 1])
        added = np.concatenate([added, pairs])
        assert (table.find(added[:, 0], added[:, 1]) == np.arange(len(added))).all()
        assert 2 * table.n <= 1 << table.bits
        assert (table.find(added[:, 0], ~added[:, 1]) == -1).all()


def test_language_of_a_long_text():
    words = distinct_words(1_200_000)
    model = langid.Model([("en", w, 5) for w in words[::1000]] + [("xx", w, 3) for w in words[1::997]])
    want = model.predict_all([" ".join(words[i : i + 100_000]) for i in range(0, len(words), 100_000)])
    (lang, score) = model.predict(" ".join(words))
    assert lang in {x for x, _ in want} and 0 < score <= 1
    assert model.predict(" ".join(words[:5])) == langid.Model([("en", w, 5) for w in words[::1000]] + [("xx", w, 3) for w in words[1::997]]).predict(" ".join(words[:5]))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_a_long_text(name):
    import tokenizers

    path = public_tokenizers.path(name)
    words = distinct_words(2_500_000)
    (_, ids, bounds), = tokens.Encoder(path).encode(pa.array([" ".join(words)]))
    assert bounds.tolist() == [0, len(ids)]
    library = tokenizers.Tokenizer.from_file(path)
    for lo, hi in ((0, 3000), (1_000_000, 1_003_000)):  # a space before, as inside the text, or none at its start
        part = " ".join(words[lo:hi]) if lo == 0 else " " + " ".join(words[lo:hi])
        want = library.encode(part, add_special_tokens=False).ids
        if lo == 0:
            assert ids[: len(want)].tolist() == want
        else:
            text = " ".join(words[:lo])
            before = sum(len(x.ids) for x in library.encode_batch([(" " if i else "") + text[i:j].strip() for i, j in _cuts(text)], add_special_tokens=False))
            assert ids[before : before + len(want)].tolist() == want


def _cuts(text, size=200_000):
    """Ranges that end before a space."""
    i = 0
    while i < len(text):
        j = text.find(" ", min(len(text), i + size))
        j = len(text) if j < 0 else j
        yield i, j
        i = j


def test_pieces_of_a_long_text():
    words = distinct_words(1_200_000)
    one = segment.Segmenter(public_tokenizers.path("piece_bpe_32k.model"), 1)
    (((score, ids),),) = one.segment([" ".join(words)])
    parts = [found[0] for found in one.segment([" ".join(words[i : i + 1000]) for i in range(0, 3000, 1000)])]
    want = np.concatenate([p for _, p in parts])
    assert ids[: len(want)].tolist() == want.tolist() and np.isfinite(score)
