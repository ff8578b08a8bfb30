import numpy as np

from hydrolake.llm import language_id
from hydrolake.llm.common import fold

SF = "/root/testdata/sf0.01"


def by_hand(trained: str, text: str, block: int) -> int:
    """Phrases by plain substring search, each block on its own."""
    n = 0
    for at in range(0, len(text), block):
        part, place = text[at : at + block], 0
        while place < len(part):
            size = 1
            while place + size < len(part) and part[place : place + size + 1] in trained:
                size += 1
            n += 1
            place += size
    return n


def test_parse_is_the_longest_match_parse(monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", 7)
    rng = np.random.default_rng(0)
    letters = "abcd"
    for _ in range(20):
        trained = {x: "".join(rng.choice(list("abc "), 60)).strip() for x in ("x", "y")}
        tables = {}
        lut = language_id.symbol_table(letters)
        for x, t in trained.items():
            found, _, _ = language_id.symbols(t.encode(), np.array([0, len(t)]), lut, 5)
            tables[x] = language_id.automaton(found, len(letters) + 3)
        trained = {x: " ".join(t.split()) for x, t in trained.items()}
        model = language_id.joined_model(tables, letters)
        texts = ["".join(rng.choice(list("abcd  é"), int(n))) for n in rng.integers(0, 40, 12)]
        raw = [t.encode() for t in texts]
        offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        found, places, lettered = language_id.symbols(b"".join(raw), offs, lut, 5)
        counts = language_id.phrase_counts(model, found, places)
        for k, text in enumerate(texts):
            plain = " ".join(text.replace("é", "?").split(" ")).split()
            plain = " ".join(plain)
            # a trailing gap stays a symbol
            if text.rstrip(" ") != text and plain:
                plain += " "
            assert lettered[k] == any(c.isalpha() for c in text)
            for j, x in enumerate(model.languages):
                assert counts[k, j] == by_hand(trained[x], plain, 7)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn(docs.where(fold("doc_id") != 0))
    rows = language_id.identify(docs.where(fold("doc_id") == 0), model).collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_awkward_rows(awkward, awkward_rows, nothing):
    model = language_id.learn(awkward)
    assert model.languages == ["de", "en", "ko"]
    found = language_id.identify(awkward, model)
    assert set(found.columns) == set(awkward.columns)
    rows = found.collect()
    assert len(rows) == len(awkward_rows)
    for r in rows:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not lettered) and (lettered or r["score"] == 0.0)
        assert r["rid"] == "own rid"
    assert {r["lang_pred"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 60} == {"de", "en"}
    assert language_id.identify(nothing, model).count() == 0
    unlearned = language_id.learn(nothing)
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(awkward, unlearned).collect()} == {("und", 0.0)}


def test_one_language_and_ties(spark):
    docs = spark.createDataFrame([(1, "abc", "b"), (2, "abc", "a"), (3, None, "c"), (4, "abc", None)], "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert {r["lang_pred"]: r["score"] for r in language_id.identify(docs.where("text is not null"), model).collect()} == {"a": 0.0}
    one = language_id.learn(docs.where("lang = 'b'"))
    assert {r["lang_pred"]: r["score"] for r in language_id.identify(docs.where("text is not null"), one).collect()} == {"b": 1.0}


def test_scripts_are_learned_whole_and_told_apart(spark):
    """Several scripts and large alphabets in one model; two pairs of languages share theirs."""
    rng = np.random.default_rng(3)
    alphabets = {"ba": (0x0D05, 30), "en": (0x61, 26), "el": (0x3B1, 25), "ja": (0x4E00, 2500), "ko": (0xAC00, 2500), "ru": (0x430, 32), "uk": (0x430, 32), "zh": (0x4E00, 2500), "ext": (0x20000, 800)}
    rows = []
    for lang, (first, n) in alphabets.items():
        letters = [chr(first + int(k)) for k in rng.permutation(n) if chr(first + int(k)).isalpha()]
        words = ["".join(rng.choice(letters, int(rng.integers(1, 5)))) for _ in range(400)]
        rows += [(len(rows) + k, " ".join(rng.choice(words, 120)), lang) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs.where("doc_id % 4 > 0"))
    used = {c.lower()[0] for i, text, _ in rows if i % 4 for c in text if c.isalpha()}
    assert len(used) > 2000 and len(model.letters) > 2000 and set(model.letters) <= used
    assert model.table.nbytes < 64 << 20
    found = language_id.identify(docs.where("doc_id % 4 = 0"), model).collect()
    assert all(r["lang"] == r["lang_pred"] and r["score"] > 0.1 for r in found) and len(found) == len(rows) // 4
