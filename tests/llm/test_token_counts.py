from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quantsieve.llm import encoding, token_counts
from tests.llm.conftest import LONG, ODD

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
PARTS = ["word", "Été", "日本", " ", "  ", "\n", " \t", " ", "　", "1234", "don't", "'", "!?", "<|endoftext|>", "<|endoft", "<|startoftext|>", "ﬁ", "é", "x" * 30, "\r\n", "\x1c", "🙂"]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("special", [True, False])
def test_cut_texts_count_as_whole_ones(path, special, monkeypatch):
    """Every length of span, over texts that no cut should change, against the library on whole texts."""
    monkeypatch.setattr(token_counts, "_LOOK", 16)
    rng = random.Random(5)
    texts = [None, "", *["".join(rng.choices(PARTS, k=rng.randint(1, 60))) for _ in range(400)], "", "y" * 500, "日" * 200, " " * 300, "<|endoftext|>" * 9]
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = not special
    want = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]
    enc = encoding.Encoder(path, special)
    for span in (1, 7, 40, 200, 10**6):
        n_bytes, n = token_counts.counts(enc, pa.array(texts), span)
        assert n.tolist() == want
        assert n_bytes.tolist() == [len((t or "").encode()) for t in texts]


def test_parts_are_short(monkeypatch):
    enc, data = encoding.Encoder(BYTE), LONG.encode()
    import numpy as np

    places = [0, *token_counts.inner_cuts(enc, np.frombuffer(data, np.uint8), 0, len(data), 1000), len(data)]
    assert max(b - a for a, b in zip(places, places[1:])) <= 1000 and len(places) < 2 * len(data) / 1000


@pytest.mark.parametrize("path", [BYTE, PIECE])
def test_count_tokens(docs_of, path):
    if path == BYTE:
        tok = Tokenizer.from_file(path)
        of = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        of = lambda t: len(model.encode(t))
    ids = [*range(len(ODD) - 2), 3, None]
    rows = token_counts.count_tokens(docs_of(ODD, ids, n_tokens=7), path, 512, span=5000).collect()
    want = [(str(i), len((t or "").encode()), of(t or ""), of(t or "") > 512) for i, t in zip(ids, ODD, strict=True)]
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == sorted(want)
    assert token_counts.count_tokens(docs_of([]), path, 512).collect() == []
    with pytest.raises(ValueError, match="n_tokens"):
        token_counts.count_tokens(docs_of(ODD, n_tokens=7), path, 512, keep=["n_tokens"])
