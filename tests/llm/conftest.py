import random

import pytest

WORDS = "the and of river stone cloud market window paper bright small green walk under after letter garden music silver winter road".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", "ed", "ly", "er", "o", "ia"]) for _ in range(n))


@pytest.fixture(scope="session")
def make():
    return prose
