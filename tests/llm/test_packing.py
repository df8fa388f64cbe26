import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from gridevents.llm import packing
from gridevents.llm.packing import Bins, WordIds, first_fit_decreasing, pack, sequences

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
R = random.Random(4)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_tree_finds_the_first_bin_with_room(lengths):
    bins, plain = Bins(100), []
    for n in lengths:
        found, offset = bins.place(n)
        want = next((i for i, used in enumerate(plain) if used + n <= 100), len(plain))
        if want == len(plain):
            plain.append(0)
        assert (found, offset) == (want, plain[want])
        plain[want] += n


def test_decreasing_order_needs_few_bins():
    lengths = np.array([60, 50, 50, 40, 30, 30, 20, 20])
    number, offset = first_fit_decreasing(lengths, 100)
    assert number.max() + 1 == 3 and (np.bincount(number, lengths) == 100).all()


def reference():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def test_word_memory_gives_the_ids_of_whole_texts():
    odd = ["Hello, world. It's 3.14 é É Σας ΑΣ ß İ \x1c x\x0by  a b c", "A.B, c., ... don't WE'LL 12a 中文。é,", "", " ", "<|endoftext|> x", "a<|startoftext|>B<|endoftext|><|endoftext|>c <|ENDOFTEXT|> <|endoftext| >", "<|endoftext|>",
           "".join(chr(R.choice([R.randrange(33, 127), R.randrange(0x300, 0x310), R.randrange(0xC0, 0x180), 32, 32, 10, 0xAC00, 0x1100, 0x1161])) for _ in range(4000))]
    ids, first = WordIds(PATH, limit=50).encode(odd)
    memory = WordIds(PATH, limit=50)
    memory.encode(["some words to fill the memory " + " ".join(f"w{i}" for i in range(99))])
    again, _ = memory.encode(odd)
    tokenizer = reference()
    want = [i for t in odd for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 2]]
    assert ids.tolist() == want and again.tolist() == want and len(first) == len(odd) + 1


def test_every_id_is_packed_once_without_gaps(docs):
    texts = {i: " ".join(R.choice(["alpha", "beta,", "gamma."]) for _ in range(R.randrange(0, 400))) for i in range(60)}
    texts[60], texts[61] = "word " * 9000, None
    rows = [*texts.items(), (None, "x"), (3, texts[3])]
    packed = pack(docs(rows), PATH, capacity=512, group_pieces=20)
    got = packed.collect()
    tokenizer = reference()
    pieces, filled = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts) | {None}
    for i, t in texts.items():
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        have = sorted(pieces[i], key=lambda r: r.start)
        copies = 2 if i == 3 else 1
        assert all(r.ids == want[r.start:r.start + r.length] and r.doc_tokens == len(want) for r in have)
        assert sum(r.length for r in have) == copies * len(want)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert sum(len(r.ids) for r in sequences(packed).collect()) == sum(r.length for r in got)
    assert pack(docs([]), PATH).collect() == []


def test_special_tokens_as_the_library_has_them():
    plain = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "word", "É", " ", "\n", ".", "it's", "12"]
    rows = ["".join(R.choice(plain) for _ in range(R.randint(1, 12))) for _ in range(400)]
    memory = WordIds(PATH, limit=40)
    for a in range(0, len(rows), 50):
        ids, first = memory.encode(rows[a:a + 50])
        for i, text in enumerate(rows[a:a + 50]):
            assert ids[first[i]:first[i + 1] - 1].tolist() == reference().encode(text, add_special_tokens=False).ids
    memory.rest(keep=3)
    assert len(memory.codes) <= 3 and memory.encode(["<|endoftext|> word"])[0].tolist() == [*reference().encode("<|endoftext|> word", add_special_tokens=False).ids, 2]


def test_copies_of_one_row_fall_into_several_groups(spark):
    frame = spark.createDataFrame([(1, "same words")] * 6000 + [(i, f"text {i}") for i in range(2, 100)], "doc_id long, text string")
    packed = pack(frame, PATH, capacity=64, group_pieces=500, with_ids=False).collect()
    assert len(packed) == 6098
    per_group = Counter(r["sequence_id"] >> 32 for r in packed)
    assert len(per_group) > 4 and max(per_group.values()) < 3000


def test_new_words_are_numbered_in_the_one_pass_over_all_words():
    """New words take numbers for the time being while known ones are looked up; none is left over."""
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    ids, library = packing.WordIds(path), Tokenizer.from_file(path)
    assert ids.codes["unseen"] == -1 and ids.codes["another"] == -2 and ids.codes["unseen"] == -1
    for column in (["One two, one.\tTWO\r\nthree", ""], ["three new. two new, NEW Äß one", "two"]):
        flat, first = ids.encode(column)
        assert not ids.codes.fresh and min(ids.codes.values()) >= 0
        got = [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
        assert got == [library.encode(t, add_special_tokens=False).ids + [packing.END] for t in column]
