import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from hydrolake.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def judge(rows):
    """Rows of one conversation in order with their first faults."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, out = set(), []
    for _, turn, role, text in rows:
        tail = text.rstrip(" \t\n\x0b\x0c\r")
        out.append((turn, role, text, "b" if not tail else "d" if (role, text) in seen else "t" if tail[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def search(rows):
    """The cheapest repair by trying all edits, inserts included: (cost, audit, repaired lines)."""
    options = []
    for _, role, text, fault in rows:
        own = [("D", 3, None)]
        if fault not in ("b", "d"):
            extra = fault == "t"
            own += [("K", extra, (role, text))] + [("R", 2 + extra, (r, text)) for r in ("user", "assistant")]
        options.append(own)
    gaps = [()] + [(a,) for a in ("user", "assistant")] + [("user", "assistant"), ("assistant", "user")]
    best = None
    for edits in itertools.product(*options):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(e[1] for e in edits) + 2 * sum(map(len, inserts))
            if best and cost > best[0]:
                continue
            audit, lines = "", []
            for k in range(len(rows) + 1):
                audit += "I" * len(inserts[k])
                lines += [(r, "") for r in inserts[k]]
                if k < len(rows):
                    audit += edits[k][0]
                    lines += [edits[k][2]] if edits[k][2] else []
            if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in lines)):
                best = min(best or (10**9,), (cost, audit, lines))
    return best


def expected(all_rows, repair=search):
    out = []
    for conv in {r[0] for r in all_rows}:
        rows = judge([r for r in damage(all_rows) if r[0] == conv])
        turns = [r[0] for r in rows if r[0] is not None]
        faults = [r[3] for r in rows]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        cost, audit, lines = repair(rows) if rows else (0, "", [])
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("part", "at", "fault", "n", "_copy", "audit")})
    got = cr.report(cr.damaged(df), df, **how)
    return sorted([tuple(r) for r in got.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()], key=repr)


def some_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for _ in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["A.", "b", "C!", " \n", None, "d? "])))
    return rows


def test_against_all_edits_of_short_conversations(spark):
    rows = some_rows(1, 40, 3) + [(None, 0, "user", "Hi."), (None, None, None, None), (-3, 4, "assistant", "x")]
    assert found(spark, rows) == expected(rows)


def by_table(rows):
    """The contract's minimum by a plain walk over grammar states."""
    takes = {"E": "u", "S": "u", "U": "a", "A": "u"}
    after = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}
    ways = {"E": (0, "", ())}

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for s, (cost, audit, lines) in list(out.items()):
                role = {"u": "user", "a": "assistant"}[takes[s]]
                to, new = after[s, takes[s]], (cost + 2, audit + "I", lines + ((role, ""),))
                if to not in out or new[:2] < out[to][:2]:
                    out[to] = new
        return out

    for _, role, text, fault in rows:
        now = {}
        for s, (cost, audit, lines) in inserted(ways).items():
            options = [(s, (cost + 3, audit + "D", lines))]
            if fault not in ("b", "d"):
                cost += fault == "t"
                if (s, role[:1]) in after:
                    options.append((after[s, role[:1]], (cost, audit + "K", lines + ((role, text),))))
                options.append((after[s, takes[s]], (cost + 2, audit + "R", lines + (({"u": "user", "a": "assistant"}[takes[s]], text),))))
            for to, new in options:
                if to not in now or new[:2] < now[to][:2]:
                    now[to] = new
        ways = now
    return min(w for s, w in inserted(ways).items() if s in "EA")


@pytest.mark.parametrize("segment, fan", [(1, 2), (3, 2), (128, 16)])
def test_one_conversation_with_most_rows_in_segments_of_any_size(spark, segment, fan):
    rng = random.Random(5)
    hot = [(7, rng.randint(0, 300), rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b"]) + str(rng.randint(0, 120)) + rng.choice([".", ""])) for _ in range(400)]
    rows = hot + [(7, 5, "user", "again.")] * 30 + some_rows(2, 20, 6)
    assert found(spark, rows, segment=segment, fan=fan) == expected(rows, by_table)


def test_very_long_texts_and_dropped_conversations(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Dropped."), (2000, 1, "user", "word " * 200_000 + "."), (2000, 2, "assistant", "Ok.")]
    got = found(spark, rows)
    assert got == expected(rows, by_table)
    assert next(r for r in got if r[0] == gone)[1:8] == (0, 0, 0, 0, 0, 0, "")


def test_an_empty_table(spark):
    assert found(spark, []) == []


def test_every_stack_of_the_grammar_is_known():
    tops = sorted(c[0] for c in cr.STACKS)
    assert tops == [0, 1, 2, 2, 2, 2, 4, 5]
    assert cr.shifted(cr.START, "a") is None and cr.shifted(cr.shifted(cr.START, "s"), "s") is None
