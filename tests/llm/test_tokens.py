import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewell.llm.packing import SEQUENCE, shortest_pack_first, slots
from tidewell.llm.token_counts import allocate, lines
from tidewell.llm.token_files import WaveletMatrix
from tidewell.llm import tokens
from tidewell.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_units_give_the_ids_of_whole_texts():
    plain = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    letters = ["a", "the", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "é", "ß", "12", "!!", "'s", "'", "🙂", "\x00", "\r\n", "​", "<|endoftext|>"]
    texts = ["", " ", "  ", "a ", " a", "a  b", "a   b", "a \n b", "\n\n a", "a　 b", "a 　b"]
    texts += ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(3000)]
    enc = Encoder(PATH)
    assert enc.byte_level
    lengths = enc.byte_lengths()
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
        assert lengths[np.frombuffer(ids, "<u4")].sum() == len(text.encode())


def test_marks_in_texts_are_what_the_library_makes_of_them():
    plain = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> ", " <|endoftext|>\n y", "<|endof text|> z"]
    for text, ids in zip(texts, tokens.encoded(texts, PATH), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert np.frombuffer(next(tokens.encoded(texts, PATH)), "<u4").tolist() == [64, 220, 50256, 275]


def test_long_texts_go_in_parts_and_words_are_forgotten(monkeypatch):
    plain = Tokenizer.from_file(PATH)
    rng = random.Random(8)
    monkeypatch.setattr(tokens, "CACHE", 200)
    monkeypatch.setattr(tokens, "KEPT", 50)
    texts = [" ".join("".join(rng.choices("abcé,. \n", k=rng.randrange(9))) for _ in range(rng.randrange(300))) for _ in range(40)] + ["x" * 900, " " * 300, None]
    for limit in (37, 500, 1 << 20):
        for text, ids in zip(texts, tokens.encoded(texts, PATH, limit), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids
        assert len(tokens.encoder(PATH).rows) < 200 + 40 * 300


def test_wavelet_matrix_agrees_with_a_list():
    rng = np.random.default_rng(1)
    for n, most in ((0, 1), (1, 1), (5, 50_000), (3000, 7), (5000, 60_000), (700, 2)):
        ids = rng.integers(0, most, n).astype(np.uint32)
        wm = WaveletMatrix(n, *WaveletMatrix.build(ids).parts())
        assert wm.decode().tolist() == ids.tolist()
        for i in rng.integers(0, n, 20) if n else []:
            v = int(ids[i])
            assert wm.access(int(i)) == v
            assert wm.rank(v, int(i)) == int((ids[:i] == v).sum())
            assert wm.count(v) == int((ids == v).sum())
        for v in {int(x) for x in ids[:3]}:
            assert wm.occurrences(v)[:50] == np.flatnonzero(ids == v)[:50].tolist()
        assert wm.count(1 << 20) == 0


def test_patterns_hold_every_piece_once():
    rng = random.Random(5)
    for _ in range(20):
        counts = {rng.randrange(1, SEQUENCE + 1): rng.randrange(1, 500) for _ in range(rng.randrange(1, 300))}
        patterns = shortest_pack_first(counts)
        seen: dict[int, int] = {}
        for n, lengths in patterns:
            assert n > 0 and sum(lengths) <= SEQUENCE
            for x in lengths:
                seen[x] = seen.get(x, 0) + n
        assert seen == counts
        places = set()
        for length, lo, hi, first, offset in slots(patterns):
            for r in range(lo, hi):
                places.add((first + r - lo, offset))
            assert length + offset <= SEQUENCE
        assert len(places) == sum(counts.values())
    assert shortest_pack_first({}) == []


def test_crossing_tokens_go_to_one_section():
    starts, ends, begins = np.array([0, 2, 5]), np.array([2, 5, 9]), np.array([0, 4, 6])
    assert [x.tolist() for x in allocate(starts, ends, begins)] == [[2, 1, 0], [1, 1, 0]]
    assert [x.tolist() for x in allocate(starts, ends, begins, "end")] == [[1, 1, 1], [0, 1, 1]]
    assert [x.tolist() for x in allocate(starts, ends, begins, "most")] == [[2, 0, 1], [1, 0, 1]]
    assert lines("a\nb\n") == [0, 2] and lines("") == [0] and lines("\n\nx") == [0, 1, 2]
