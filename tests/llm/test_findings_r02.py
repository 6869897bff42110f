"""Cases of the second round's findings."""

import random
import re

import pytest

from gridloom.llm import pii

P, Q = pii.Permuter(b"key"), pii.Permuter(b"key", back=True)


def all_cards(run):
    """Every window of whole groups with a right check digit, the likeliest first, each unless a likelier one lies on it."""
    groups = [m.span() for m in re.finditer("[0-9]+", run)]
    found = []
    for i in range(len(groups)):
        for j in range(i, min(i + 19, len(groups))):
            sizes = tuple(b - a for a, b in groups[i : j + 1])
            a, b = groups[i][0], groups[j][1]
            usual = len(sizes) == 1 or sizes in pii.GROUPINGS
            if 13 <= sum(sizes) <= 19 and (usual or min(sizes) >= 3) and pii.luhn(re.sub("[ -]", "", run[a:b])) == 0:
                found.append((not usual, pii.LENGTHS.index(sum(sizes)), a, b))
    out = []
    for *_, a, b in sorted(found):
        if all(b <= x or y <= a for x, y in out):
            out.append((a, b))
    return sorted(out)


@pytest.mark.parametrize("card", ["4111 1111 1111 1111", "3782-822463-10005", "411 111 111 111 1111"])
def test_pii_finds_a_card_anywhere_in_a_long_run(card):
    alone = pii.pseudonymise(card, P)[0]
    for before in range(40):
        text = "10 " * before + card + " 10" * 40
        new, kinds = pii.pseudonymise(text, P)
        assert (new, kinds) == ("10 " * before + alone + " 10" * 40, ["card"]), before
        assert pii.pseudonymise(new, Q) == (text, kinds)


@pytest.mark.parametrize("sizes", [(4,), (3,), (3, 4), (4, 6, 5), (2, 3, 4, 13, 16)])
@pytest.mark.parametrize("numbers", [False, True])
def test_pii_reads_runs_of_any_length_whole(sizes, numbers):
    r = random.Random(5)
    for n in [30, 100, 100, 1000]:
        text = "10" + "".join(r.choice(" -") + "".join(r.choices("0123456789", k=r.choice(sizes))) for _ in range(n))
        new, kinds = pii.pseudonymise(text, P, numbers)
        cards = all_cards(text)
        assert cards and all(new[a:b] != text[a:b] for a, b in cards)
        assert all_cards(new) == cards and kinds.count("card") >= len(cards)
        assert pii.pseudonymise(new, Q, numbers) == (text, kinds)
