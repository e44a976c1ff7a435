from collections import Counter

import numpy as np
import pytest

from tidewater.llm import pieces
from tidewater.llm.tokens import vocabulary

PATH = vocabulary("piece_bpe_32k.model")


def test_every_occurrence_varies_by_itself():
    coder = pieces.Pieces(PATH, 0.1)
    found = Counter()
    for doc in range(40):
        ids = np.frombuffer(coder.encode("the " * 500, doc), "<u4").tolist()
        found[len(ids)] += 1
    assert len(found) > 5
    words = coder.words("international organisations")
    cuts = {coder.encode("international", doc) for doc in range(2000)}
    assert len(cuts) > 10 and len(words) == 2


@pytest.mark.parametrize("dropout", [0.1, 0.5])
def test_candidates_are_skipped_at_the_rate_and_independently(dropout):
    coder = pieces.Pieces(PATH, dropout)
    whole = coder._held("▁the", ())
    text = " ".join(["the"] * 20_000)
    words = coder.words(text)
    assert set(words) == {"▁the"}
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    first = coder._first_skips(keys)
    assert first.tolist() == [next(coder._skips(k)) for k in keys.tolist()]
    assert abs((first >= whole[1]).mean() - (1 - dropout) ** whole[1]) < 0.015
    second = np.array([(s := coder._skips(k), next(s), next(s))[1:] for k in keys[:5000].tolist()])
    gap = second[:, 1] - second[:, 0] - 1
    assert abs((gap == 0).mean() - dropout) < 0.025 and abs(np.corrcoef(gap, second[:, 0])[0, 1]) < 0.05


@pytest.mark.parametrize("dropout", [0.1, 0.6])
def test_what_is_remembered_is_what_an_occurrence_alone_would_get(dropout):
    coder, alone = pieces.Pieces(PATH, dropout), pieces.Pieces(PATH, dropout)
    for key in range(1, 3000):
        word = ["▁international", "▁organisations", "▁the", "▁aaaaaaaaaaaaaaaa"][key % 4]
        whole = coder._held(word, ())
        skip = next(coder._skips(key))
        got = whole[0] if skip >= whole[1] else coder._varied(word, key, skip)
        assert got == alone._ids(word, key)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6, 1.0])
def test_texts_cut_side_by_side_are_those_cut_alone(dropout, monkeypatch):
    monkeypatch.setattr(pieces, "CELLS", 300)
    texts = ["", None, " ", "a", "the international organisations of the the", "  two  gaps \n and\tmore ", "日本語 ünïcödé 𝄞𝄞 x\x00y",
             "a▁b ▁ c", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa " * 30, "b" * 256 + " " + "ab" * 200 + " " + "日" * 300, "getCancellationToken();" * 5]
    coder, alone = pieces.Pieces(PATH, dropout), pieces.Pieces(PATH, dropout)
    docs = [*range(len(texts) - 1), None]
    assert coder.encode_all(texts, docs) == [alone.encode(t, d) for t, d in zip(texts, docs)]
    assert coder.encode_all([], []) == [] and coder.encode_all([None, ""], [1, 2]) == [b"", b""]
    assert [coder.encode_all([t], [d])[0] for t, d in zip(texts, docs)] == coder.encode_all(texts, docs)
