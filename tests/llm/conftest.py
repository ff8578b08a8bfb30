import random
import re

import pytest
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHING = ["score", "lang_pred", "rid", "node", "kept", "word", "words", "size", "start", "row", "h", "_h", "held_out", "n", "key", "id", "length"]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls in every column, empty, blank, odd and long texts, ties, copies, near copies, repeated rows."""
    rng = random.Random(4)
    syllables = {"en": ["the", "ing", "and", "er", "th", "on", "re"], "de": ["ung", "sch", "ein", "ich", "keit", "ä", "ver"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3)))
    prose = lambda lang, n: " ".join(word(lang) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    rows = [(i, prose(lang, rng.randint(3, 120)), lang, f"s{i % 3}", None) for i in range(60) for lang in [("en", "de")[i % 2]]]
    base = prose("en", 150).split(" ")
    for i in range(60, 75):  # near copies
        near = list(base)
        near[rng.randrange(len(near))] = f"edit{i}"
        rows.append((i, " ".join(near), "en", "s0", 7))
    rows += [(i, " ".join(base), "en", None, 0) for i in range(75, 80)]  # copies
    rows += [rows[70], rows[70]]  # repeated rows
    rows += [
        (90, None, None, None, None), (91, "", "en", "s1", 0), (92, " \t\n\r\x0b\x0c ", "de", "", 7), (93, "123 !!! 456 $$", None, "s1", 14),
        (94, "한국어 텍스트 😀 𝔘𝔫𝔦", "ko", "s2", 1), (95, "one", "en", "s1", 3), (96, "All Rights Reserved. CC-BY cc by", "en", "s1", 3),
        (None, "a row without an id", "en", "s1", 1), (97, prose("en", 30_000), "en", "long", 1), (98, "x" * 50_000, "en", "long", 1),
        (99, "<|endoftext|> Σας İ é   a　b\x1cc", "en", "s2", 1), (-5, "negative id", "en", "s1", 1),
    ]
    return [(a, b, c, d, None if b is None else len(b)) for a, b, c, d, _ in rows]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    """The rows as a table, with extra columns whose names the operators use."""
    df = spark.createDataFrame(awkward_rows, DOCUMENTS).repartition(3)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
