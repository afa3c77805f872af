"""Problem 4: hesitations of any length."""

import pytest

from turnweave.llm.transcript import read_line


@pytest.mark.parametrize("word", ["ummmmm", "uhhhhh", "mmmmm", "uuuuuuum", "uhhhhhhm", "eeeeeer", "hhhhhmm", "eeehhhhhmmmm", "u" + "m" * 50_000])
def test_long_hesitations(word):
    assert not read_line(f"A: {word}, ...", "fisher")[4]
    assert read_line(f"A: {word} yes", "fisher")[3:] == ("yes", True)


@pytest.mark.parametrize("word", ["err", "hmmmmmx", "errrrrand", "summmmmm", "uhuuuuuu", "mmmmmmy"])
def test_words(word):
    assert read_line(f"A: {word}", "fisher")[4]


@pytest.mark.parametrize("label,who", [("Speaker 0:", "A"), ("spk1:", "B"), ("[channel_0]", "A"), ("CH-1:", "B"), ("<speakerB>", "B"), ("(spk a):", "A"), ("0:", None), ("speaker 2:", None)])
def test_labels_with_digits(label, who):
    assert read_line(f"{label} good morning", "fisher")[2] == who
    assert read_line(f"well {label} good morning", "fisher")[2] is None
