"""Conversation repair by a generalised LR parse with edits.

The roles of a conversation must spell ``(s?(ua)+)?``: an optional system turn, then user and assistant by turns. The
LR(0) table of

    Talk -> nothing | Body | s Body        Body -> Pair | Body Pair        Pair -> u a

runs over a graph-structured stack: a stack is a cell (state, cell below), cells are shared, and a frontier holds one
cell for each top state. Every row offers keep (shift of its own role), rerole (shift of the other symbol that the
top takes) and delete; inserted turns are shifts between rows. Where two ways lead to the same top state, the one of
the smaller (cost, audit) stays. Nothing is lost by that: ways that have read the same rows at the same cost differ at a
letter, so no audit is the beginning of the other, and what follows depends on the top state only.

A conversation may hold any share of the rows, so it is no group of any task. Rows are sorted by ranges of
(conversation, turn) and cut where they lie into segments of at most ``SEGMENT`` rows; a segment's parse starts from every
stack that can be there and so is a table from entry to exit stacks. Tables are composed ``FAN`` partitions at a time,
as the composition is associative; the cheapest whole audit is cut up again and handed to the segments, which write
their own repaired text. Only the digest of a conversation's text reads its segments one after the other, as a stream.

Faults: blank (null counts as one space), else duplicate (role and text stood in an earlier row), else truncated (the
last character that is not white space is none of ``.!?``). Rows equal in conversation, turn, role and text are one row with
a count: its copies are duplicates (or blank) and are deleted.

Defined cases: null conversations are one conversation; null turns come first; rows of one turn are ordered by role and
text; roles other than s, u, a are kept by no parse; texts and conversations of any length are read whole; an empty
table gives an empty result; columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake.llm.common import crc32_sql, stored

#: Distinct rows of a segment, UTF-8 bytes after which it is closed, and partitions whose tables are composed by one task.
SEGMENT = 128
SEGMENT_BYTES = 1 << 18
FAN = 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
WHITE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}

# ---- the grammar's table and its stacks -------------------------------------------------------------

# States 0 start, 1 after s, 2 after u, 3 first pair, 4 body, 5 body after s, 6 next pair, 7 after u a.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (4, "u"): 2, (5, "u"): 2, (2, "a"): 7}
REDUCE = {3: ("Body", 1), 6: ("Body", 2), 7: ("Pair", 2)}
GOTO = {(0, "Pair"): 3, (0, "Body"): 4, (1, "Pair"): 3, (1, "Body"): 5, (4, "Pair"): 6, (5, "Pair"): 6}
ACCEPTING = (0, 4, 5)
#: The symbol that each top state takes besides s at the start.
TAKES = {0: "u", 1: "u", 2: "a", 4: "u", 5: "u"}

START = (0, None)


@lru_cache(None)
def shifted(cell: tuple, symbol: str) -> tuple | None:
    """The stack after a symbol and all reductions that follow; None if the symbol can't stand there."""
    state = SHIFT.get((cell[0], symbol))
    if state is None:
        return None
    cell = (state, cell)
    while cell[0] in REDUCE:
        left, pops = REDUCE[cell[0]]
        for _ in range(pops):
            cell = cell[1]
        cell = (GOTO[cell[0], left], cell)
    return cell


def _reachable() -> list[tuple]:
    found = [START]
    for cell in found:
        found += [x for s in "sua" if (x := shifted(cell, s)) is not None and x not in found]
    return found


#: Every stack between two symbols; the grammar nests to a bounded depth.
STACKS = _reachable()
NUMBER = {cell: k for k, cell in enumerate(STACKS)}


def _offer(frontier: dict, cell: tuple | None, cost: int, audit: str) -> bool:
    """Merges a way into the frontier; equal tops keep the least (cost, audit)."""
    if cell is None:
        return False
    old = frontier.get(cell[0])
    if old is not None and (old[1], old[2]) <= (cost, audit):
        return False
    frontier[cell[0]] = (cell, cost, audit)
    return True


def with_inserts(frontier: dict) -> dict:
    """The frontier and all that inserted turns reach from it."""
    out, todo = dict(frontier), list(frontier.values())
    while todo:
        cell, cost, audit = todo.pop()
        grown = shifted(cell, TAKES[cell[0]])
        if _offer(out, grown, cost + INSERT, audit + "I"):
            todo.append(out[grown[0]])
    return out


def read_row(frontier: dict, initial: str, fault: str, count: int) -> dict:
    """The frontier after a row and its further copies. ``fault``: b, d, t or empty."""
    out: dict = {}
    extra = TRUNCATED if fault == "t" else 0
    for cell, cost, audit in with_inserts(frontier).values():
        _offer(out, cell, cost + DELETE, audit + "D")
        if fault not in ("b", "d"):
            _offer(out, shifted(cell, initial) if initial in ("s", "u", "a") else None, cost + KEEP + extra, audit + "K")
            _offer(out, shifted(cell, TAKES[cell[0]]), cost + REROLE + extra, audit + "R")
    if count > 1:
        out = {top: (cell, cost + DELETE * (count - 1), audit + "D" * (count - 1)) for top, (cell, cost, audit) in out.items()}
    return out


def best_end(frontier: dict) -> tuple[tuple, int, str]:
    """The cheapest way that ends where the grammar accepts: stack, cost, audit."""
    ends = [x for top, x in with_inserts(frontier).items() if top in ACCEPTING]
    return min(ends, key=lambda x: (x[1], x[2]))


# ---- segments ---------------------------------------------------------------------------------------

WAY = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
SUMMARY = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()),
           ("last", pa.string()), ("least", pa.int64()), ("most", pa.int64()), ("turns", pa.int64()), ("n", pa.int64())]
KEY = [("conv_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64())]
SEGMENTS = pa.schema([*KEY, *SUMMARY, ("ways", pa.list_(WAY)), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.large_string())), ("counts", pa.list_(pa.int64()))])
_LEGAL = {"su", "ua", "au"}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _illegal(a: str | None, b: str | None) -> int:
    return int(a is not None and b is not None and a + b not in _LEGAL)


def _summary(rows: list[dict]) -> dict:
    initials = [r["role"][:1] for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    return {
        "blank": sum(r["n"] for r in rows if r["fault"] == "b"),
        # further copies of a row that is not blank are duplicates
        "duplicate": sum(r["n"] if r["fault"] == "d" else r["n"] - 1 for r in rows if r["fault"] != "b"),
        "truncated": sum(r["fault"] == "t" for r in rows),
        "illegal": sum(r["n"] - 1 for r in rows) + sum(_illegal(a, b) for a, b in zip(initials, initials[1:])),
        "first": initials[0], "last": initials[-1], "least": min(turns, default=None), "most": max(turns, default=None), "turns": len(set(turns)),
        "n": sum(r["n"] for r in rows),
    }


def _ways(rows: list[dict], entries: list[tuple]) -> list[dict]:
    out = []
    for entry in entries:
        frontier = {entry[0]: (entry, 0, "")}
        for r in rows:
            frontier = read_row(frontier, r["role"][:1], r["fault"], r["n"])
        out += [{"entry": NUMBER[entry], "exit": NUMBER[cell], "cost": cost, "audit": audit} for cell, cost, audit in frontier.values()]
    return out


def cut_segments(size: int):
    """Arrow function over sorted rows: segments in order, each with its table of ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, held, opening = TaskContext.get().partitionId(), 0, [], False
        known, first, filled = None, True, 0

        def segment(rows: list[dict], at: int, opening: bool) -> dict:
            # a conversation that opens inside this partition starts from the empty stack, any other part from every stack
            head = {"conv_id": rows[0]["conv_id"], "part": part, "at": at, "ways": _ways(rows, [START] if opening else STACKS)}
            return head | _summary(rows) | {"roles": [r["role"] for r in rows], "texts": [r["text"] for r in rows], "counts": [r["n"] for r in rows]}

        ready: list[dict] = []
        for r in _rows(batches):
            new = known is None or r["conv_id"] != known[0]
            if held and (new or len(held) >= size or filled >= SEGMENT_BYTES):
                ready.append(segment(held, at, opening))
                held, at, filled, opening = [], at + 1, 0, False
                if len(ready) >= 64:
                    yield pa.RecordBatch.from_pylist(ready, SEGMENTS)
                    ready = []
            if new:
                # what comes first in a partition may go on from the partition before
                known, opening, first = (r["conv_id"],), not first, False
            held.append(r)
            filled += len(r["text"])
        if held:
            ready.append(segment(held, at, opening))
        if ready:
            yield pa.RecordBatch.from_pylist(ready, SEGMENTS)

    return run


def _composed(a: list[dict], b: list[dict]) -> list[dict]:
    after: dict[int, list[dict]] = {}
    for w in b:
        after.setdefault(w["entry"], []).append(w)
    best: dict[int, dict] = {}
    for w in a:
        frontier = best.setdefault(w["entry"], {})
        for v in after.get(w["exit"], []):
            _offer(frontier, STACKS[v["exit"]], w["cost"] + v["cost"], w["audit"] + v["audit"])
    return [{"entry": e, "exit": NUMBER[cell], "cost": cost, "audit": audit} for e, f in best.items() for cell, cost, audit in f.values()]


COMPOSED = pa.schema([*KEY, *SUMMARY, ("ways", pa.list_(WAY)), ("sizes", pa.list_(pa.struct([("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64())])))])


def _merge(a: dict, b: dict) -> dict:
    joined = int(a["most"] is not None and a["most"] == b["least"])
    low, high = [x for x in (a["least"], b["least"]) if x is not None], [x for x in (a["most"], b["most"]) if x is not None]
    return {
        **{k: a[k] for k in ("conv_id", "part", "at", "first")}, **{k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "n")},
        "illegal": a["illegal"] + b["illegal"] + _illegal(a["last"], b["first"]), "last": b["last"],
        "least": min(low, default=None), "most": max(high, default=None), "turns": a["turns"] + b["turns"] - joined,
        "ways": _composed(a["ways"], b["ways"]), "sizes": a["sizes"] + b["sizes"],
    }


def compose(fan: int):
    """Arrow function over rows sorted by (conv_id, part, at): one row for the parts of each fan of a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ready = None, []
        for r in _rows(batches):
            r["part"] //= fan
            if held is not None and (held["conv_id"], held["part"]) == (r["conv_id"], r["part"]):
                held = _merge(held, r)
                continue
            if held is not None:
                ready.append(held)
            held = r
            if len(ready) >= 512:
                yield pa.RecordBatch.from_pylist(ready, COMPOSED)
                ready = []
        if held is not None:
            ready.append(held)
        if ready:
            yield pa.RecordBatch.from_pylist(ready, COMPOSED)

    return run


RESULT = [("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.large_string())]
SHARE = pa.struct([("part", pa.int32()), ("at", pa.int64()), ("edits", pa.large_string()), ("ahead", pa.int64()), ("system", pa.bool_())])


def _long(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _shares(audit: str, sizes: list[dict], system: bool) -> list[dict]:
    """The part of the audit that belongs to each segment, and how many turns are written before it."""
    out, i, ahead = [], 0, 0
    for k, s in enumerate(sizes):
        j, rows = i, 0
        while rows < s["n"]:
            rows += audit[j] != "I"
            j += 1
        if k == len(sizes) - 1:
            j = len(audit)
        out.append({"part": s["part"], "at": s["at"], "edits": audit[i:j], "ahead": ahead, "system": system})
        ahead, i = ahead + sum(c != "D" for c in audit[i:j]), j
    return out


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest repair of every conversation, and each segment's share of it."""
    schema = pa.schema([*RESULT, ("shares", pa.list_(SHARE))])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            frontier: dict = {}
            for w in r["ways"]:
                if w["entry"] == NUMBER[START]:
                    _offer(frontier, STACKS[w["exit"]], w["cost"], w["audit"])
            cell, cost, audit = best_end(frontier)
            gaps = 0 if r["least"] is None else _long(r["most"] - r["least"] + 1 - r["turns"])
            out.append({**{k: r[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal")}, "gaps": gaps, "cost": cost, "audit": audit,
                        "shares": _shares(audit, r["sizes"], cell[0] == 5)})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)


def write_repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns of every segment, in order."""
    schema = pa.schema([*KEY, ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.large_string())])))])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            turns, row, done = [], -1, 0
            written = r["ahead"]
            for edit in r["edits"]:
                if edit != "I":
                    if done == 0:
                        row += 1
                        done = r["counts"][row]
                    done -= 1
                if edit == "D":
                    continue
                place = written - (1 if r["system"] else 0)
                role = "system" if place < 0 else ROLES["ua"[place % 2]]
                turns.append({"role": r["roles"][row] if edit == "K" else role, "text": "" if edit == "I" else r["texts"][row]})
                written += 1
            out.append({"conv_id": r["conv_id"], "part": r["part"], "at": r["at"], "turns": turns})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the ``role:text`` lines of each conversation, whose segments come one after the other."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    known, state, some, ready = None, hashlib.sha256(), False, []
    for r in _rows(batches):
        if known != (r["conv_id"],):
            if known:
                ready.append({"conv_id": known[0], "repaired_sha256": state.hexdigest()})
            known, state, some = (r["conv_id"],), hashlib.sha256(), False
        for turn in r["turns"]:
            state.update((("\n" if some else "") + f"{turn['role']}:{turn['text']}").encode())
            some = True
        if len(ready) >= 1024:
            yield pa.RecordBatch.from_pylist(ready, schema)
            ready = []
    if known:
        ready.append({"conv_id": known[0], "repaired_sha256": state.hexdigest()})
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema)


# ---- the operator -----------------------------------------------------------------------------------

_SQL_TYPES = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.large_string(): "string", pa.bool_(): "boolean"}


def ddl(kind) -> str:
    """Spark's name of an Arrow schema or type."""
    if isinstance(kind, pa.Schema):
        return ", ".join(f"`{f.name}` {ddl(f.type)}" for f in kind)
    if pa.types.is_list(kind):
        return f"array<{ddl(kind.value_type)}>"
    if pa.types.is_struct(kind):
        return f"struct<{', '.join(f'`{f.name}`:{ddl(f.type)}' for f in kind)}>"
    return _SQL_TYPES[kind]


def faulty(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (equal rows), fault (b, d, t or empty) of rows conv_id, turn, role, text."""
    said = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    one = rows.select(*[F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")], *said).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    one = one.withColumn("_tail", F.rtrim(F.col("text"), F.lit(WHITE)))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    one = stored(one.withColumn("_said", said))
    # a null turn is the first of all
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = one.groupBy("conv_id", "_said").agg(F.min(order).alias("_order"), F.count("*").alias("_times")).where("_times > 1")
    firsts = firsts.select(F.col("conv_id").alias("_conv"), F.col("_said").alias("_same"), "_order")
    met = one.join(firsts, one["conv_id"].eqNullSafe(firsts["_conv"]) & (one["_said"] == firsts["_same"]), "left")
    fault = (
        F.when(F.col("_tail") == "", "b")
        .when(F.col("_order").isNotNull() & (order > F.col("_order")), "d")
        .when(~F.substring("_tail", -1, 1).isin(".", "!", "?"), "t")
        .otherwise("")
    )
    return met.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


def repair(rows: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Conversations and their repaired segments.

    ``rows``: conv_id, turn, role, text; null roles and texts count as one space. First result: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit of each conversation; second: conv_id, part, at, turns (role, text), to be read in that order.
    """
    keys = [F.col(c) for c in ("conv_id", "turn", "role", "text")]
    ordered = faulty(rows).repartitionByRange(*keys).sortWithinPartitions(*keys)
    segments = stored(ordered.mapInArrow(cut_segments(segment), ddl(SEGMENTS)))
    size = F.array(F.struct("part", "at", "n")).alias("sizes")
    tables = segments.select(*[f.name for f in COMPOSED if f.name != "sizes"], size)
    parts = segments.agg(F.max("part")).first()[0]
    if parts is None:
        parts = 0
    while True:
        tables = tables.repartition("conv_id", F.floor(F.col("part") / fan)).sortWithinPartitions("conv_id", "part", "at")
        tables, parts = stored(tables.mapInArrow(compose(fan), ddl(COMPOSED))), parts // fan
        if parts == 0:
            break
    settled = stored(tables.mapInArrow(settle, f"{ddl(pa.schema(RESULT))}, shares array<{ddl(SHARE)}>"))
    shares = settled.select(F.explode("shares").alias("s")).select(*[F.col(f"s.{c}").alias(f"_{c}" if c in ("part", "at") else c) for c in ("part", "at", "edits", "ahead", "system")])
    met = segments.select("conv_id", "part", "at", "roles", "texts", "counts").join(shares, (F.col("part") == F.col("_part")) & (F.col("at") == F.col("_at"))).drop("_part", "_at")
    turns = "conv_id bigint, part int, at bigint, turns array<struct<role:string,text:string>>"
    return settled.drop("shares"), met.mapInArrow(write_repairs, turns)


def report(rows: DataFrame, conversations: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """One row for each conv_id of ``conversations``, also where ``rows`` (as for ``repair``) has none of it."""
    found, repaired = repair(rows, segment, fan)
    lines = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
    hashes = lines.mapInArrow(digests, "conv_id bigint, repaired_sha256 string").withColumnRenamed("conv_id", "_id")
    known = conversations.select(F.col("conv_id").cast("long")).distinct()
    ids = found.withColumnRenamed("conv_id", "_conv")
    out = known.join(ids, known["conv_id"].eqNullSafe(ids["_conv"]), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """The registered query's damage by crc32(`conv_id:turn`) mod 20; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text: Column = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    once = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", kind.alias("_kind")).where("_kind <> 0")
    role = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(space("role"))
    times = F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))
    return once.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


_WHITE_SQL = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_KIND = crc32_sql("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")

ORACLE = f"""
with recursive c as (select conv_id, case when conv_id is null then 'n' else conv_id::varchar end as k, turn, coalesce(role, ' ') as role,
   coalesce(text, ' ') as text, {_KIND} % 20 as kind from conversations),
 d as (select k, turn, case when kind = 4 then 'user' else role end as role,
   case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
   unnest(case when kind = 3 then [1, 2] else [1] end) as copy from c where kind <> 0),
 o as (select *, row_number() over (partition by k order by turn nulls first, role, text, copy) as pos, left(role, 1) as initial, rtrim(text, {_WHITE_SQL}) as tail,
   row_number() over (partition by k, role, text order by turn nulls first, copy) > 1 as again from d),
 f as materialized (select *, case when tail = '' then 'b' when again then 'd' when right(tail, 1) not in ('.', '!', '?') then 't' else '' end as fault,
   lag(initial) over (partition by k order by pos) || initial as pair from o),
 stats as (select k, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
   count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
   count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal, max(pos) as n from f group by k),
 ins(p, pre, q) as (values ('E', '', 'E'), ('E', 'I', 'U'), ('E', 'II', 'A'), ('S', '', 'S'), ('S', 'I', 'U'), ('S', 'II', 'A'), ('U', '', 'U'), ('U', 'I', 'A'), ('A', '', 'A'), ('A', 'I', 'U')),
 mv(q, edit, need, next) as (values ('E', 'D', '', 'E'), ('S', 'D', '', 'S'), ('U', 'D', '', 'U'), ('A', 'D', '', 'A'), ('E', 'R', '', 'U'), ('S', 'R', '', 'U'), ('U', 'R', '', 'A'), ('A', 'R', '', 'U'),
   ('E', 'K', 's', 'S'), ('E', 'K', 'u', 'U'), ('S', 'K', 'u', 'U'), ('A', 'K', 'u', 'U'), ('U', 'K', 'a', 'A')),
 r(k, pos, state, best) as (select k, 0::bigint, 'E', {{'cost': 0::bigint, 'audit': ''}} from stats
   union all select r.k, r.pos + 1, mv.next, min({{'cost': (r.best.cost + 2 * length(pre) + case edit when 'D' then 3 when 'R' then 2 else 0 end
     + case when edit <> 'D' and fault = 't' then 1 else 0 end)::bigint, 'audit': r.best.audit || pre || edit}})
   from r join f on f.k = r.k and f.pos = r.pos + 1 join ins on ins.p = r.state
    join mv on mv.q = ins.q and (edit = 'D' or (fault not in ('b', 'd') and (edit = 'R' or need = initial)))
   group by r.k, r.pos + 1, mv.next),
 ended as (select r.k, min({{'cost': r.best.cost + 2 * length(pre), 'audit': r.best.audit || pre}}) as best
   from r join stats on stats.k = r.k and r.pos = stats.n join ins on ins.p = r.state where ins.q in ('E', 'A') group by r.k),
 chars as (select k, unnest(range(1, length(best.audit) + 1)) as i, best.audit as audit from ended),
 edits as (select k, i, audit[i] as ch, count(*) filter (audit[i] <> 'I') over w as pos, count(*) filter (audit[i] <> 'D') over w as place from chars window w as (partition by k order by i)),
 turns as (select e.k, e.i, ch, place, f.role, f.text, f.initial from edits e left join f on f.k = e.k and f.pos = e.pos where ch <> 'D'),
 opened as (select k, max(case when place = 1 and ch = 'K' and initial = 's' then 1 else 0 end) as s from turns group by k),
 said as (select turns.k, sha256(string_agg(case when ch = 'K' then role when (place - 1 - s) % 2 = 0 then 'user' else 'assistant' end || ':' || case when ch = 'I' then '' else text end,
   chr(10) order by i)) as repaired_sha256 from turns join opened on turns.k = opened.k group by turns.k)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
 coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id, k from c) ids left join stats on stats.k = ids.k left join ended on ended.k = ids.k left join said on said.k = ids.k
"""
