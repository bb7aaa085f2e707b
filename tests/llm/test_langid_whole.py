"""Language ID over the whole vocabulary."""

import numpy as np

from srcgraph.llm import langid


def test_every_letter_piece_is_kept():
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(langid.VOCABULARY))
    texts = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    texts = {t for t in texts if t.replace("▁", "", 1).isalpha()}
    vocab = langid.vocabulary(langid.VOCABULARY)
    assert texts <= set(vocab.pieces)
    by: dict[int, list[str]] = {}
    for t in texts:
        by.setdefault(len(t), []).append(t)
    for n, own in by.items():
        found = vocab.segments(np.array([[*map(ord, t)] for t in own], np.uint32))
        assert [vocab.pieces[k] for k in found[n - 1][:, 0]] == own


def test_forward_sums_segmentations_with_long_pieces():
    vocab = langid.vocabulary(langid.VOCABULARY)
    p = np.random.default_rng(0).random((vocab.n + 1, 2)) / 100
    p[-1] = 0
    at = {t: k for k, t in enumerate(vocab.pieces)}
    for word in ("▁international", "▁understanding", "▁zxqv", "▁मकन"):

        def total(i):
            return 1.0 if i == len(word) else sum(p[at[word[i:j]], 0] * total(j) for j in range(i + 1, len(word) + 1) if word[i:j] in at)

        both = np.array([[*map(ord, word)]] * 9 + [[0x2581, *[ord("a")] * (len(word) - 1)]], np.uint32)
        got = langid.forward(vocab.segments(both), p)[-1][:, 0] / langid.SCALE ** len(word)
        assert np.allclose(got[:9], total(0), rtol=1e-9, atol=0)


def test_scripts_have_pieces_of_their_own():
    vocab = langid.vocabulary(langid.VOCABULARY)
    for a, b in (("क", "ক"), ("א", "ա"), ("か", "の")):
        x, y = (vocab.segments(np.array([[ord(c)]], np.uint32))[0][0, 0] for c in (a, b))
        assert x != y
    assert vocab.segments(np.array([[0x10400]], np.uint32))[0][0, 0] >= len(vocab.pieces)
    langs, p = langid.fit({"x": ["कम नम मन"] * 5, "y": ["কম নম মন"] * 5})
    logs, _ = langid.Scorer(p, langid.VOCABULARY).score(["मन कम", "মন কম"])
    assert [langs[i] for i in logs.argmax(1)] == ["x", "y"]
