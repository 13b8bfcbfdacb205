from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models

from quantsieve.llm import encoding, packing, token_files
from tests.llm.conftest import ODD

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_tight(seed):
    rng = random.Random(seed)
    cap = 100
    hist = {rng.randint(1, cap): rng.randint(1, 400) for _ in range(rng.randint(1, 60))}
    plan = packing.plan_best_fit(hist, cap)
    assert plan.groupby("length")["n"].sum().to_dict() == hist
    used, seen = {}, {}
    for s in plan.itertuples():
        assert s.rank == seen.get(s.length, 0)
        seen[s.length] = s.rank + s.n
        for k in range(s.n):
            used.setdefault(s.sequence + k // s.each, []).append((s.offset + k % s.each * s.length, s.length))
    for parts in used.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end = at + length
        assert end <= cap
    assert sorted(used) == list(range(len(used)))
    # As best-fit decreasing over single items.
    rooms = []
    for length in sorted((x for x, n in hist.items() for _ in range(n)), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(cap - length)
    assert len(used) == len(rooms)


def test_pack_documents(docs_of):
    tok = Tokenizer.from_file(WORD)
    texts = [*ODD, "<|endoftext|> is text", *[f"short text {i % 5}" for i in range(40)]]
    ids = [*range(len(texts) - 2), 3, None]
    rows = packing.pack_documents(docs_of(texts, ids, rank=7, length="x"), WORD, with_ids=True).collect()
    want = []
    for i, t in zip(ids, texts, strict=True):
        e = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(str(i), k, at, len(e[at : at + 4096]), zlib.crc32(np.array(e[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(e), 4096))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    places = {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        ends = 0
        for at, n in sorted(p):
            assert at == ends
            ends += n
        assert ends <= 4096
    assert packing.pack_documents(docs_of([]), WORD).count() == 0


def test_sequences(docs_of):
    packed = packing.pack_documents(docs_of(["a b c", "d e", "f"]), WORD, with_ids=True, capacity=5)
    for r in packing.sequences(packed).collect():
        assert len(r["ids"]) == 4 * r["length"] <= 20
    with pytest.raises(ValueError):
        packing.pack(packed.drop("ids"), capacity=1)


@pytest.mark.parametrize("wide", [None, False, True])
def test_token_files(docs_of, wide):
    tok = Tokenizer.from_file(BYTE)
    texts = [*ODD, "<|endoftext|>", "é≠\U0001f600"]
    ids = [5, 3, 9, 1, 7, 2, 2, None, 100]
    manifest = token_files.write_token_files(docs_of(texts, ids, part=1), BYTE, 0, wide=wide, files=3)
    want = sorted(((i, t) for i, t in zip(ids, texts, strict=True)), key=lambda x: (-1 if x[0] is None else x[0], x[1] or ""))
    rows = sorted(token_files.read_digest(manifest).collect(), key=lambda r: r["start"])
    start = 0
    for (i, t), r in zip(want, rows, strict=True):
        e = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(e), zlib.crc32(e.tobytes()))
        start += len(e)
    by_id = {r["doc_id"]: r["ids"] for r in token_files.read_shuffled(manifest, 3).collect()}
    assert by_id[1] == tok.encode("one", add_special_tokens=False).ids + [0]
    assert token_files.read_digest(token_files.write_token_files(docs_of([]), BYTE)).count() == 0


def test_corruption_is_seen():
    import io

    good = token_files.frame(b"abcd") + token_files.frame(b"")
    assert list(token_files.unframe(io.BytesIO(good))) == [b"abcd", b""]
    for at in (0, 9, 13, 17):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(token_files.unframe(io.BytesIO(bytes(bad))))


def split_ids(enc, texts):
    out = []
    for ids, counts in enc.encode(pa.array(texts, pa.string())):
        assert len(ids) == counts.sum()
        out += [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
    return out


SPACES = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["\u180e", "\u200b", "\ufeff", "\x7f"]


@pytest.mark.parametrize("special", [True, False])
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_texts_are_encoded_as_by_the_library(path, special, monkeypatch):
    monkeypatch.setattr(encoding, "CACHE_PIECES", 400)  # so that generations turn over
    monkeypatch.setattr(encoding, "BATCH_BYTES", 3_000)
    enc, tok = encoding.Encoder(path, special), Tokenizer.from_file(path)
    if not special:
        tok.encode_special_tokens = True
    assert enc.local
    rng = random.Random(5)
    bits = [*"aZ é\n\t 1.,;!'s\u00a0\u2003\x1cΣßİﷺﬁ각̸́H̱×Å", "<|endoftext|>", "  ", "'ll ", " \n", "don't", "word ", "words, ", "x" * 60, "ẛ̣"]
    texts = ["", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(4000))]
    for w in SPACES:
        texts += [w, f"a{w}", f"{w}a", f"a{w}b", f" {w}b", f"{w}{w}b", f"a\n{w}b", f"a {w}", f"é{w}É", f"{w}\n", f"\n\n{w} x"]
    texts += [f"{a}<|endoftext|>{b}" for a in ("", "a", " ", "A\n") for b in ("", "b", " ", "\nB")] + ["<|startoftext|>", "<|endoftext|", "THE <|ENDOFTEXT|> A"]
    rng.shuffle(texts)
    assert split_ids(enc, texts) == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert split_ids(enc, [None]) == [[]] and split_ids(enc, []) == []


def test_other_tokenizers_get_texts_whole(tmp_path):
    tok = Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2, " ": 3}, [("a", "b")]))
    tok.save(path := str(tmp_path / "own.json"))
    enc = encoding.Encoder(path)
    assert not enc.local and split_ids(enc, ["ab ab", None, "b"]) == [[2, 3, 2], [], [1]]


def test_width_of_ids_is_checked(docs_of, tmp_path):
    tok = Tokenizer(models.BPE({chr(0x10000 + i): i for i in range(70_000)}, []))
    tok.save(path := str(tmp_path / "large.json"))
    text = "".join(chr(0x10000 + i) for i in (3, 66_000))
    manifest = token_files.write_token_files(docs_of([text]), path, 0)
    assert [r["ids"] for r in token_files.read_shuffled(manifest, 1).collect()] == [[3, 66_000, 0]]
    with pytest.raises(Exception, match="32 bits"):
        token_files.write_token_files(docs_of([text]), path, 0, wide=False).count()
