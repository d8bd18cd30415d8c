import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, size string, doc string, at int, __text string, __source string"


def prose(rng, n):
    syllables = ["ther", "on", "ing", "ba", "lo", "ri", "ent", "Ma", "qu", "e"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(3)
    base = [prose(rng, n) for n in (120, 300, 40, 7, 4, 1)]
    near = base[1].split(" ")
    near[5], near[150] = "other", "words"
    passage = prose(rng, 80)
    texts = [
        *base, base[0], base[0].upper(), " ".join(near), base[0] + "\n" + passage, passage + " " + prose(rng, 100), prose(rng, 20_000),
        None, "", " ", "\n\n\n", "123 456 !!", "a" * 5000, "x y\n" * 300, "é" * 700, "日本語 " * 50, "<|endoftext|> and\tTabs", "İ ß ǅ é",
        "mail a.b@c.example.org, +1 (213) 555-5044 or 10.0.0.1 card 4111 1111 1111 1111 IBAN GB82 WEST 1234 5698 7654 32",
    ]
    rows = [(k, t, "en" if k % 3 else "fr", f"s{k % 4}", len(t or ""), 1, "x", "y", 2, "z", None) for k, t in enumerate(texts)]
    rows += [rows[1], rows[1], (None, base[2], None, None, None, None, None, None, None, None, None), (None, None, *[None] * 9), (1000, prose(rng, 50), None, None, *[None] * 7)]
    return rows


@pytest.fixture(scope="session")
def edges():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, edges):
    return spark.createDataFrame(edges, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.fixture(scope="session")
def groups():
    return Groups
