"""The encoder's table of words: what it passes to the tokenizer, and words that share a hash."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest

from granary.llm import token_files


@pytest.fixture
def made():
    return token_files.Encoder(token_files.vocabulary_path())


def same(made, texts):
    for t, ids in zip(texts, made(texts)):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == made.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["Wort", "café", "naïve", "Ŋ", "ɏ", "ɐ", "×", "÷", "a×b", "12", "٣", "½", "²", "中文", "नमस्ते", ",", ".", "'s", "'S", "don't", "\n", "\n\n", "\t", "\r\n",
             "_", "|", "-", "😀", "é", "ª", "“", "”", "–", "<|endoftext|>", "<|", " ", "x" * 300, "’", "\xad", "​"]
    return [" ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_words_of_known_pieces_are_not_encoded_again(made):
    same(made, ["a alpha,beta beta,alpha"])
    passed, encode = [], made._encode
    made._encode = lambda some: passed.extend(some) or encode(some)
    words = ["alpha,", "beta,alpha,beta", "alpha,beta,alpha", "beta,"]
    ids = made(["a " + " ".join(words)])
    assert not passed
    made._encode = encode
    assert list(struct.unpack(f"<{len(ids[0]) // 4}I", ids[0])) == made.tokenizer.encode("a " + " ".join(words), add_special_tokens=False).ids


def test_ids_are_those_of_whole_texts(made):
    for seed in range(6):
        same(made, texts(seed, 400))


def test_words_of_one_hash(made, monkeypatch):
    plain = token_files.B.words

    def few(*args, **more):
        w = plain(*args, **more)
        w.hash = w.hash & np.uint64(7)
        return w

    monkeypatch.setattr(token_files.B, "words", few)
    same(made, ["the cat and the dog are here there and everywhere", "a b c d e f g h i j k l m n o", *texts(9, 200)])
    assert made.hash.size <= 8


def test_full_tables_start_anew(made, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 40)
    monkeypatch.setattr(token_files, "CACHE_PIECES", 30)
    for seed in range(20, 40):
        same(made, texts(seed, 20))
    assert made.hash.size < 400


def test_new_beginnings_and_words_take_few_calls(made):
    some = [f"{a}{b} x{b}{a} 中{a}{b}" for a in "abcdefghijklmnopqrst" for b in "uvwxyzUVWXYZ"]
    calls, encode = [], made._encode
    made._encode = lambda x: calls.append(len(x)) or encode(x)
    ids = made(some)
    made._encode = encode
    assert len(calls) < 10
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in ids] == [made.tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_pieces_met_again_outlive_a_full_table(made, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_PIECES", 60)
    made(["a alpha,beta"])
    for i in range(8):
        made._forget()
        made([f"a alpha,beta {' '.join(f'x{c}{d}' for c in 'abcdefgh'[i] for d in 'abcdefghijklmnopqrstuvwxyz')}"])
    assert made.pieces.n < 120
    passed, encode = [], made._encode
    made._encode = lambda some: passed.extend(some) or encode(some)
    made._forget()
    made(["a alpha,beta beta,alpha".rsplit(" ", 1)[0]])
    assert not passed


def test_pieces_of_one_hash(made, monkeypatch):
    plain = token_files.B.span_hash
    monkeypatch.setattr(token_files.B, "span_hash", lambda *args: plain(*args) & np.uint64(7))
    same(made, ["the cat, and: the dog's are here; there", "'s a's's b'', c're, d'r e'st f\n'll g\n\n'd h\n\n\ni j'", *texts(11, 200)])
    assert made.pieces.n <= 8


def test_words_are_cut_as_the_vocabulary_cuts_them(made):
    rng = random.Random(3)
    for _ in range(300):
        some = ["".join(rng.choices(["a", "s", "re", "ll", "'", "'", ",", "1", "\n", "\n", "é", "t"], k=rng.randint(1, 9))).strip("\n") for _ in range(30)]
        same(made, ["x " + " ".join(w for w in some if w)])


def test_long_words_are_compared_to_their_end(made, monkeypatch):
    plain = token_files.B.words

    def by_length(*args, **more):
        w = plain(*args, **more)
        w.hash = (w.end - w.start).astype(np.uint64)
        return w

    monkeypatch.setattr(token_files.B, "words", by_length)
    stem = "abcdefghijklmnopqrstuvwxyz"
    same(made, [f"x {stem[:n]}Q {stem[:n]}Z {'Q' + stem[:n]} {stem[:n]}Q" for n in range(26)])


def test_freed_memory_is_given_back():
    def held():
        with open("/proc/self/status") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("VmRSS"))

    some = [bytes(2000) for _ in range(50_000)]
    last, some = some[-1], None
    before = held()
    token_files.give_back()
    assert last and before - held() > 50_000
