"""Trees of pre-tokens under random edits in many scripts, against the tokenizer on the whole text."""

import random

from trajectree.llm.token_counts import Tree, counts, mask_personal
from trajectree.llm.tokens import default_path, encoder

ATOMS = ["a", "word", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "re", "1", "23", "—", "日本", "é", "é", "\U0001f600", "\xa0", " ", "​", "مرحبا", "नमस्ते", "!!", "x" * 20]
SPECIAL = ["<|endoftext|>", "<|endof", "text|>", "<|", "|>", "<"]


def made(pick, n, atoms):
    return "".join(pick.choice(atoms) for _ in range(n))


def test_trees_are_those_of_the_edited_text():
    encode, pick = encoder(default_path()), random.Random(7)
    whole = lambda t: len(encode.slow.encode(t, add_special_tokens=False).ids)
    for k in range(600):
        atoms = ATOMS + SPECIAL * (k % 3)
        text = made(pick, pick.choice([0, 1, 3, 10, 60, 300]), atoms)
        tree = Tree(text, encode)
        assert tree.count == whole(text), text
        for _ in range(pick.choice([1, 2, 4])):
            start = pick.randint(0, len(text))
            end, new = min(len(text), start + pick.choice([0, 0, 1, 3, 12, 40])), made(pick, pick.choice([0, 1, 2, 5]), atoms)
            tree.replace(start, end, new)
            text = text[:start] + new + text[end:]
            assert [p for leaf in tree.leaves for p in leaf] == encode.split(text) and tree.count == whole(text), text


def test_an_edit_that_makes_or_breaks_a_special_token():
    encode = encoder(default_path())
    assert counts("a <|endof|> b", [(9, 9, "text")], encode)[1] == len(encode.slow.encode("a <|endoftext|> b", add_special_tokens=False).ids) < counts("a <|endof|> b", [], encode)[0]
    assert counts("a  <|endoftext|> b", [(5, 8, "")], encode)[1] == len(encode.slow.encode("a  <|oftext|> b", add_special_tokens=False).ids)


def test_a_rare_character_costs_no_second_encoding():
    text = "— " + " ".join(f"w{i}x" for i in range(900)) + " 12345 end"
    before, after, edits, encoded = counts(text, mask_personal(text), encoder(default_path()))
    assert edits == 1 and encoded < len(text) + 50
