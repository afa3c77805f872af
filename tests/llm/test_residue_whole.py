"""Problem 8: filler without a phrase of the automaton, blanks of any width, cases that no list was made from."""

import time

import pytest

from tests.llm.residue_cases import CASES, LOOKALIKES, MORE_CASES, MORE_LOOKALIKES
from turnweave.llm import residue as R

FILLER = [
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "foo bar foo bar foo bar", "blah, blah, blah, blah", "Guide Kapa 499: foo bar foo bar foo bar", "wort " * 10,
]


@pytest.mark.parametrize("text", FILLER)
def test_filler_without_a_phrase(text):
    assert R.judge(text) == "residue"
    assert R.judge("Nobody found the sandwich so Bo had to explain it to all of them.\n" + text.split(". ")[0][:60]) is None


WIDE = [
    "Name:          ________", "Name:" + " " * 500 + "________", " " * 12 + "________ called about the sandwich", "_____. called about the sandwich", "________" + " " * 40 + "called about the sandwich", "Title , , , , , , , , , ________ was read",
    "Call <INSERT CALLER-NAME AS IT STANDS IN THE CONTRACT> now", "[insert the title of the interview and the names of both speakers here] spoke",
]


@pytest.mark.parametrize("text", WIDE)
def test_wide_blanks(text):
    assert R.judge(text) == "placeholder"


@pytest.mark.parametrize("text", ["Chapter 2 ..........            17", "Chapter 2:            ..........            17", "We talked          about the ferry...          then left.", "a < insert", "[insert"])
def test_wide_content(text):
    assert R.judge(text) is None


LONG = [
    ", " * 150_000, "a" + " " * 300_000, "a:" + "," * 300_000, "<insert " * 40_000, "<insert " + "a" * 300_000, "[insert a" + " |" * 150_000, "<" + " " * 300_000, ("a" + " " * 50 + "_____") * 6_000, "_____" + " " * 300_000, "a _____" + " " * 300_000,
    "{" * 300_000, "{{a}} template " * 20_000, "{{a}} template. " * 20_000, "null " * 60_000, "dear null " * 30_000, "__a" * 100_000, "wort " * 60_000, "a. " * 100_000 + "not found", "error page " * 30_000, "(" * 300_000, "xxxx " * 60_000, "lorem " * 60_000, "@a" * 150_000, "%a" * 150_000, ".)" * 150_000,
]


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
def test_time_is_linear(text):
    began = time.process_time()
    R.judge(text)
    assert time.process_time() - began < 4


@pytest.mark.parametrize("half", [0, 1])
def test_unseen(half):
    """Position 1: the half that no list was revised with."""
    cases, others = CASES[half::2], LOOKALIKES[half::2]
    hit, wrong = [x for x in cases if R.judge(x)], [x for x in others if R.judge(x)]
    assert len(CASES) >= 100 and len(LOOKALIKES) >= 100
    assert len(hit) >= 0.9 * len(cases) and len(hit) >= 0.9 * (len(hit) + len(wrong)), set(cases) - set(hit) | set(wrong)


@pytest.mark.parametrize("text", ["the field {{a}} is it", "{{a}} stands for it. Then we left", "Dear {{template}}, hi", "It ended. The template {{a}} is read", "The template ended. Dear {{a}}, hi"])
def test_mentions(text):
    assert (R.judge(text) is None) == (text[0] in "t{" or text.startswith("It"))


@pytest.mark.parametrize("text", MORE_CASES)
def test_more_cases(text):
    assert R.judge(text) is not None


@pytest.mark.parametrize("text", MORE_LOOKALIKES)
def test_more_lookalikes(text):
    assert R.judge(text) is None
