import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer
from tokenizers.normalizers import NFC

from hydrolake.llm import packing
from hydrolake.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def check(rows, texts):
    """Round trip of (doc_id, text) rows: every id once, in order, and sequences without gaps."""
    tok = Tokenizer.from_file(vocabulary())
    want = defaultdict(list)
    for doc, text in texts:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[doc].append((k, at, len(part), zlib.crc32(part.tobytes())))
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(length for v in sequences.values() for _, length in v)
    return len(sequences), -(-total // 2048)


def test_awkward_documents_come_back_whole(awkward, awkward_rows):
    check(packing.pack_documents(awkward, vocabulary()).collect(), [(a, b) for a, b, *_ in awkward_rows])


def test_few_sequences_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    used, least = check(packing.pack_documents(docs, vocabulary()).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert used <= least + 2


def test_several_groups_and_an_empty_table(spark, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(packing.pack_documents(docs, vocabulary(), group=50).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert packing.pack_documents(nothing, vocabulary()).count() == 0


def test_two_pieces_replace_the_shortest():
    # greedy 60 leaves 40, then 30, and 10 are lost; 20 + 20 fill them
    rows = packing.best_two_fit(np.array([60, 30, 20, 20]), 100)
    assert sorted(map(sorted, rows)) == [[20, 20, 60], [30]]
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(0, 80))]
        rows = packing.best_two_fit(np.array(lengths, int), 60)
        assert sorted(x for r in rows for x in r) == sorted(lengths) and all(sum(r) <= 60 for r in rows)


def test_runs_are_encoded_as_the_whole_text():
    rng = random.Random(3)
    parts = ["a", "B", "́", "É", "Σ", "İ", "K", "1", "<|endoftext|>", "<", "'s", ".", ",", "\x1c", " ", "\n", "\t", " ", " ", "\r\n", "한", "😀", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    e, tok = packing.Encoder(vocabulary()), Tokenizer.from_file(vocabulary())
    assert [np.frombuffer(x, "<u4").tolist() for x in e.ids(texts)] == [f.ids for f in tok.encode_batch(texts, add_special_tokens=False)]


def both_ways(texts):
    e, tok = packing.Encoder(vocabulary()), Tokenizer.from_file(vocabulary())
    assert [np.frombuffer(x, "<u4").tolist() for x in e.ids(texts)] == [f.ids for f in tok.encode_batch(texts, add_special_tokens=False)]
    return e


def test_case_that_only_small_letters_have():
    # j, t, upsilon compose with the mark, their capitals do not; capitals make no special token
    both_ways(["J̌", "a T̈ b", "Υ̓", "Į̇", "É Å K", "<|ENDOFTEXT|> a", "x<|StartOfText|>", "<|endoftext|> <|EndOfText|>"])


def test_plain_runs_are_parted_into_words():
    e = both_ways(["Stop, stop. it's 'tis we're'll 2024 a1b2 été! don't''s ..'re", "naïve—жук, ως </w> a</w>b &lt;"])
    assert e["it's"] == e["it"] + e["'s"] and e["stop,"] == e["stop"] + e[","]
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x21, 0x590)]
    plain = [c for c in letters if packing.PLAIN.fullmatch(c)]
    both_ways([c + " x" + c + "y" for c in letters])
    both_ways(["".join(rng.choice([*plain, " ", " ", "'s", "'re", "'", "1", ".", "e"]) for _ in range(60)) for _ in range(1000)])


def test_only_new_words_reach_the_tokenizer():
    e = packing.Encoder(vocabulary())
    seen, learn_words = [], e.learn_words
    e.learn_words = lambda words: (seen.extend(words), learn_words(words))
    e.ids(["river rises, river (rises) river; rises."])
    e.ids(["rises: river!"])
    assert sorted(seen) == sorted(["river", "rises", ",", "(", ")", ";", ".", ":", "!"])


def test_other_vocabulary_steps_take_the_long_way(tmp_path):
    tok = Tokenizer.from_file(vocabulary())
    tok.normalizer = NFC()
    tok.save(path := str(tmp_path / "cased.json"))
    assert packing.Encoder(path).words is None and packing.Encoder(vocabulary()).words is not None
