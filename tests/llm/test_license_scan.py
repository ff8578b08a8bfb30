import random
import re

from hydrolake.llm import license_scan

from .conftest import LOWER

SF = "/root/testdata/sf0.01"


def by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for label, phrase in license_scan.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        if at:
            labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(df, texts):
    rows = license_scan.scan_licenses(df).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows), key=repr)
    assert got == sorted(((a, *by_hand(b)) for a, b in texts), key=repr)
    for r in rows:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))
    return rows


def test_base_phrases_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert any("mit-short" in r["labels"] for r in rows)


def test_awkward_rows(awkward, awkward_rows, nothing):
    check(awkward, [(a, b) for a, b, *_ in awkward_rows])
    assert license_scan.scan_licenses(nothing).count() == 0


def test_templates_need_words_and_key_phrase(spark):
    mit = license_scan.TEMPLATES["mit"][0]
    words = mit.split(" ")
    texts = {
        1: f"x y z {mit.upper()} and more",
        2: " ".join(w if k % 9 != 3 else "zzz" for k, w in enumerate(words, 1)),  # some words differ, the key phrase is hit
        3: " ".join(words[:14]),  # far too short
        4: " ".join(words[12:]),  # without its key phrase
        5: "all rights reserved all rights reserved",
        6: f"{mit} {license_scan.TEMPLATES['isc'][0]}",
        7: "cc by cc by-cc by",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in check(df, texts.items())}
    assert "mit" in got[1]["labels"].split(",") and got[1]["score"] == 1.0
    for k in (2, 3, 4, 5):
        assert "mit" not in got[k]["labels"].split(",")
    assert got[5]["n_base"] == 2 and (got[5]["first_word"], got[5]["last_word"]) == (0, 3)
    assert {"mit", "isc"} <= set(got[6]["labels"].split(","))


def test_every_notice_of_a_file_with_many(spark):
    notices = [text for text, _ in license_scan.TEMPLATES.values()]
    pick = lambda *names: " x ".join(license_scan.TEMPLATES[n][0] for n in names)
    texts = {
        1: " ".join(notices), 2: " x ".join(reversed(notices * 3)), 3: pick("mit", "isc", "cc-by-short"), 4: pick("mit", "apache-2.0", "mit-short"),
        5: "word " * 30_000 + " ".join(notices),
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in check(df, texts.items())}
    for k in (1, 2, 5):
        assert got[k] == {*license_scan.TEMPLATES, *license_scan.BASE}
    assert {"mit", "isc", "cc-by-short"} <= got[3] and {"mit", "apache-2.0", "mit-short"} <= got[4]


def test_labels_are_those_of_all_places(spark):
    """Every template at every place of files of mixed, broken and cut notices."""
    rng = random.Random(2)
    split = lambda text: re.findall(r"[0-9a-z]+", text.lower())
    templates = {k: (split(text), [split(p) for p in keys]) for k, (text, keys) in license_scan.TEMPLATES.items()}
    texts = {}
    for i in range(60):
        words = []
        for name in rng.choices(sorted(templates), k=rng.randint(1, 6)):
            part = [w if rng.random() > rng.choice([0.0, 0.1, 0.25]) else "zzz" for w in templates[name][0]]
            words += part[rng.randint(0, 2) :] + ["of", "the"] * rng.randint(0, 2)
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in check(df, texts.items()):
        words, want, slack = texts[r["doc_id"]].split(" "), set(filter(None, r["base_labels"].split(","))), license_scan.SLACK
        for name, (template, keys) in templates.items():
            for shift in range(-len(template), len(words)):
                same = sum(0 <= shift + k < len(words) and words[shift + k] == w for k, w in enumerate(template))
                region = words[max(0, shift - slack) if shift > 0 else 0 : min(len(words), shift + len(template)) + slack]
                if same >= license_scan.MATCHED * len(template) and any(region[j : j + len(p)] == p for p in keys for j in range(len(region))):
                    want.add(name)
        assert set(filter(None, r["labels"].split(","))) == want
