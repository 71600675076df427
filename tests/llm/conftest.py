import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, words string, size int, spans string"


def made_texts():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice(["an", "the", "on", "er", "é", "st", "Of", "x1"]) for _ in range(rnd.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    texts = [None, "", " ", "\n\t", "one", "two words", "a b c", "In. " * 90, "x y " * 60, passage, passage, text(20) + " " + passage + "\n" + text(25), passage[: len(passage) // 2] + " " + text(40)]
    base = text(120)
    texts += [base, base, base.replace("the", "The", 1), base + " tail", text(3000), "mail a.b@c.de, +1 (743) 555-3824, 10.0.0.1 and 4539578763621486.", "日本語 テキスト 😀 ünï", "İ ẞ ΑΣ <|endoftext|> 's 'LL don't", "a\x1cb\x85c\xa0d"]
    return texts + [text(rnd.randint(1, 80)) for _ in range(30)]


@pytest.fixture(scope="session")
def rows():
    """Null ids, equal ids, repeated rows, null sources, and columns whose names clash with the operators' own."""
    out = []
    for i, t in enumerate(made_texts()):
        out.append((i, t, [None, "en", "de"][i % 3], [None, "a", "b", "a"][i % 4], None, 5, "w", 3, "s"))
    out.append((None, "a row without an id", "en", "a", 1, 1, None, None, None))
    out.append((7, "another text under id 7", "en", "b", 1, 1, None, None, None))
    out.append(out[13])
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df):
    return [tuple(r) for r in df.collect()]
