import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyweave.llm import tokens


PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine():
    return tokens.counter(PATH)


def plain(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_library(machine):
    rng = random.Random(1)
    bits = ["'s", "'re", "'ve", "'ll", "'l", "'r", "'", "''", " ", "  ", "\n", "\t ", " \n ", "a", "re", "ll", "don't", "é", "12", "½", "!?", "…", "<|endoftext|>", "<|end", " ", " ", "日本", "😀", "\x1c", "\x85", "S", "x" * 70]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    assert machine.counts(texts).tolist() == [plain(t) for t in texts]


def test_long_text_and_small_memory(machine, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_STATES", 5000)
    monkeypatch.setattr(tokens, "BLOCK", 1 << 16)
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefg'") for _ in range(rng.randint(1, 9))) for _ in range(300_000))
    assert machine.counts(["", text, ""]).tolist() == [0, plain(text), 0]


@pytest.mark.parametrize("block", [1, 2, 3, 5, 17])
def test_blocks_cut_anywhere(machine, monkeypatch, block):
    monkeypatch.setattr(tokens, "BLOCK", block)
    rng = random.Random(block)
    bits = ["'s", "'re", "'l", "'", " ", "  ", "\n", "re", "ll", "don't", "é", "12", "!?", "日本", "😀", "international", "<|endoftext|>", "<|end"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["x" * 300, "ab" * 200, " " * 100]
    assert machine.counts(texts).tolist() == [plain(t) for t in texts]


def test_transducer_equals_plain_merging():
    rng = random.Random(9)
    for _ in range(60):
        words, merges = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(30)], []
        split = [list(w) for w in words]
        for _ in range(rng.randint(1, 25)):  # train: the most frequent pair, in order
            pairs = Counter(p for w in split for p in zip(w, w[1:]))
            best = max((n, p) for p, n in pairs.items() if p[0] + p[1] not in {a + b for a, b in merges})[1] if any(a + b not in {x + y for x, y in merges} for a, b in pairs) else None
            if best is None:
                break
            merges.append(best)
            split = [merged(w, best) for w in split]
        machine = tokens.Merges([(a.encode(), b.encode()) for a, b in merges])
        for _ in range(100):
            w = list("".join(rng.choice("ab") for _ in range(rng.randint(1, 40))))
            data = np.frombuffer("".join(w).encode(), np.uint8)
            for m in merges:
                w = merged(w, m)
            assert machine.run(0, data.tobytes())[1] == len(w)


def merged(word, pair):
    out = []
    for c in word:
        if out and not isinstance(out[-1], tuple) and (out[-1], c) == pair:
            out[-1] = (pair[0] + pair[1],)
        else:
            out.append(c)
    return [x[0] if isinstance(x, tuple) else x for x in out]


def test_two_special_strings_in_one_text(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"].append(spec["added_tokens"][0] | {"content": "<|end|>", "id": 50257})
    path = tmp_path / "two.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    library, machine = Tokenizer.from_file(str(path)), tokens.counter(str(path))
    texts = ["a <|end|> b <|endoftext|><|end|>", "<|end|><|endoftext|>", "<|end<|end|>"]
    assert machine.counts(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_classes_are_those_of_the_library(machine):
    pre = LIBRARY.pre_tokenizer
    points = [*range(0x20, 0x3000), *range(0xA640, 0xABFF), *range(0xF900, 0xFFFF), *range(0x10000, 0x10400), *range(0x1F000, 0x1F700)]
    kinds = machine.classes[points]
    for cp, kind in zip(points, kinds, strict=True):
        letter, number = len(pre.pre_tokenize_str(f"a{chr(cp)}")) == 1, len(pre.pre_tokenize_str(f"1{chr(cp)}")) == 1
        assert letter == (kind <= tokens.E_), hex(cp)
        assert number == (kind == tokens.NUMBER), hex(cp)


def test_scan_composes_maps():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 11, (37, 11)).astype(np.uint8)
    out = tokens.compose_scan(maps)
    for s in range(11):
        at = s
        for i, m in enumerate(maps):
            at = m[at]
            assert out[i, s] == at


def test_nulls_empties_repeats_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "", 5), (2, "two words", 5), (2, "two words", 5)], "doc_id long, text string, n_tokens int")
    rows = sorted(map(tuple, tokens.count_tokens(df, limit=1).collect()), key=str)
    assert rows == sorted([(1, 0, 0, False), (None, 0, 0, False), (2, 9, 2, True), (2, 9, 2, True)], key=str)
    assert tokens.count_tokens(df.where("false")).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_vocabularies(spark, name):
    df = spark.createDataFrame([(1, "Hello there, world")], "doc_id long, text string")
    assert tokens.count_tokens(df, name).first()["n_tokens"] > 2
