import random

import pytest

WORDS = "the of and to in alpha beta gamma delta copper river stone light paper seven garden window quiet lantern basket".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def hard_texts():
    """Nulls, empty and blank texts, a very long one, copies, near copies, odd characters."""
    rng = random.Random(7)
    base = [f"{prose(rng, 60)} id{k}x y{k}z {prose(rng, 40)}" for k in range(20)]
    near = [t.replace("copper", "silver", 1) for t in base[:8]]
    odd = [None, "", " \n\t ", "one", "two words", "a b c", "x\x0by\x0cz", "naïve café ÉCOLE 漢字 <|endoftext|> it's  done\r\n", "  lead and trail  ", "é nbsp here"]
    morse = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    twins = [morse, morse.translate({97: 98, 98: 97})]
    return [*base, *base[:6], base[0], base[0], *near, *odd, *twins, "\n".join(twins), f"{prose(rng, 12_000)}\n" * 2, "w" * 9_000]


@pytest.fixture(scope="session")
def documents(spark, hard_texts):
    """With columns whose names clash with those the operators make."""
    rows = [(k, t, "row", k % 3, 1.5, "x") for k, t in enumerate(hard_texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, signature string, shard int, n double, blob string").repartition(3)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.where("doc_id < 0")
