"""Conversation structure repair: the cheapest edits that bring a conversation's roles into order, by divide and conquer.

The roles of a repaired conversation read `(s?(ua)+)?` by their initials. Walking along the rows, a repair is in one of
four states: nothing kept so far, last kept system, user or assistant. A row takes a state to another one by a token: a
few inserted rows and what happens to the row itself. Tokens are never prefixes of one another, so that of two repairs of
the same rows the one that differs at an earlier token decides the order of their audits, whatever follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut, small_side

#: Prices of the edits; Keep costs nothing.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: One row in so many is damaged in each way; adjacent initials that are in order.
DAMAGE = 20
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60


def _steps(symbol: str) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest token, and of equally cheap ones the least, that takes state p over a row to state q.

    symbol is the row: x if it must go, else its role's initial (o: another one), upper-case if its text is truncated.
    """
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for p in range(4):
        state = p
        for inserted in range(3):
            follows = ASSISTANT if state == USER else USER
            ends = [(state, DELETE, "D")]
            if symbol != "x":
                more = TRUNCATED if symbol.isupper() else 0
                ends.append((follows, REROLE + more, "R"))
                role = "osua".index(symbol.lower())
                if role == follows or (role == SYSTEM and state == NONE):
                    ends.append((role, more, "K"))
            for q, cost, letter in ends:
                new = (INSERT * inserted + cost, "I" * inserted + letter)
                found[p, q] = min(found.get((p, q), new), new)
            state = follows
    return found


STEPS = {s: _steps(s) for s in "xsuaoSUAO"}
#: Rows inserted after the last one, by state.
TAIL = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}


def _matrix(symbol: str) -> tuple:
    """Costs by (p, q), and the places of q among the four by what they append to the audit of p."""
    costs = tuple(tuple(STEPS[symbol].get((p, q), (NEVER, ""))[0] for q in range(4)) for p in range(4))
    tokens = [[STEPS[symbol].get((p, q), (NEVER, "~"))[1] for q in range(4)] for p in range(4)]
    return costs, tuple(tuple(sorted(range(4), key=lambda q: (t[q], q)).index(q) for q in range(4)) for t in tokens)


MATRICES = {s: _matrix(s) for s in STEPS}


@lru_cache(maxsize=1 << 16)
def _forward(vector: tuple, piece: str | tuple) -> tuple[int, tuple]:
    """The vector (costs, places of the audits) of the four states after a row or a stretch of rows, less its least cost."""
    costs, places = vector
    c, r = MATRICES[piece] if isinstance(piece, str) else piece
    best = [min((costs[p] + c[p][q], places[p], r[p][q]) for p in range(4)) for q in range(4)]
    order = sorted(range(4), key=lambda q: (best[q][0] >= NEVER, best[q][1:], q))
    base = min(b[0] for b in best)
    return base, (tuple(NEVER if b[0] >= NEVER else b[0] - base for b in best), tuple(order.index(q) for q in range(4)))


@lru_cache(maxsize=1 << 16)
def _backward(costs: tuple, piece: str | tuple) -> tuple[int, tuple]:
    """The costs to go of the four states before a row or a stretch of rows, less the least of them."""
    c, _ = MATRICES[piece] if isinstance(piece, str) else piece
    best = [min(costs[q] + c[p][q] for q in range(4)) for p in range(4)]
    base = min(best)
    return base, tuple(NEVER if b >= NEVER else b - base for b in best)


def _from(state: int) -> tuple:
    return tuple(0 if p == state else NEVER for p in range(4)), (0, 1, 2, 3)


def forward(pieces, start: int) -> tuple[tuple, tuple]:
    """The costs of reaching each state over all pieces from `start`, and the order of their audits."""
    total, vector = 0, _from(start)
    for x in pieces:
        base, vector = _forward(vector, x)
        total += base
    return tuple(NEVER if c >= NEVER else c + total for c in vector[0]), vector[1]


def crossings(pieces, start: int, end: int) -> list[int]:
    """The states after each piece on the least of the cheapest ways from `start` to `end`.

    The costs of the first half from its start and of the second half from its end meet in the middle. Of the states
    with the least sum the one whose audit so far is least is on the way; both halves are then solved alike. What is
    held at any time is a vector of four.
    """
    if len(pieces) <= 1:
        return [end] * len(pieces)
    middle = len(pieces) // 2
    ahead, places = forward(pieces[:middle], start)
    back = _from(end)[0]
    for x in reversed(pieces[middle:]):
        back = _backward(back, x)[1]
    at = min(range(4), key=lambda q: (ahead[q] + back[q], places[q]))
    return crossings(pieces[:middle], start, at) + crossings(pieces[middle:], at, end)


def audit_of(symbols: str, start: int, end: int) -> str:
    """The edits of a stretch of rows between two states."""
    ways = [start, *crossings(symbols, start, end)]
    return "".join(STEPS[s][p, q][1] for s, p, q in zip(symbols, ways, ways[1:], strict=False))


def last_state(costs: tuple, places: tuple) -> tuple[int, int]:
    """Where the cheapest repair ends, of equally cheap ones the least, and its cost."""
    total, _, state = min((costs[q] + INSERT * TAIL[q], places[q], q) for q in range(4))
    return state, total


# ---- rows


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of each row after damage: nulls are one space, copies is 0, 1 or 2."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % DAMAGE
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(space("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def undamaged(rows: DataFrame) -> DataFrame:
    """As damaged(), of rows that are taken as they are."""
    return rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).cast("long").alias("copies"))


ORDER = ["turn", "role", "h1", "h2"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(0x5EED), "role", "text").alias("h2"))


SEGMENT = (
    "part int, run int, symbols string, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "low long, high long, turns long, costs array<long>, places array<int>"
)


def _segment(symbols: bytearray, s: dict) -> dict:
    text = symbols.decode()
    ways = [forward(text, p) for p in range(4)]
    return s | {"symbols": text, "costs": [c for w in ways for c in w[0]], "places": [k for w in ways for k in w[1]]}


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}[kind]


def _schema(conv: pa.DataType, ddl: str) -> pa.Schema:
    return pa.schema([("conv_id", conv), *((name, _arrow(kind)) for name, kind in (c.strip().split(" ") for c in ddl.split(",")))])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to a symbol for each, in one row for each conversation of the task, with what its four states cost."""
    part, out, symbols, s, schema = TaskContext.get().partitionId(), [], bytearray(), None, None
    last = None
    for batch in batches:
        schema = schema or _schema(batch.schema.field("conv_id").type, SEGMENT)
        for conv, turn, role, n, blank, truncated, later in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "n", "blank", "truncated", "later")), strict=True):
            if s is None or conv != s["conv_id"]:
                if s is not None:
                    out.append(_segment(symbols, s))
                symbols = bytearray()
                s = {"conv_id": conv, "part": part, "run": 0 if s is None else s["run"] + 1} | dict.fromkeys(("n", "blank", "duplicate", "truncated", "illegal", "turns"), 0) | dict.fromkeys(("first", "last", "low", "high"))
            if not n:
                continue
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            s["first"] = s["first"] or initial
            s["illegal"] += (s["last"] is not None and s["last"] + initial not in LEGAL) + (n - 1)
            s["last"] = initial
            s["n"] += n
            if turn is not None and turn != s["high"]:
                s["low"] = turn if s["low"] is None else s["low"]
                s["high"] = turn
                s["turns"] += 1
            fault = "blank" if blank else "duplicate" if later else "truncated" if truncated else None
            if fault:
                s[fault] += 1
            s["blank" if blank else "duplicate"] += n - 1
            symbols += (b"x" if fault in ("blank", "duplicate") else (initial.upper() if fault else initial).encode()) + b"x" * (n - 1)
        if sum(len(x["symbols"]) for x in out) > 1 << 20 or len(out) > 5000:
            yield _table(out, schema)
            out = []
    if s is not None:
        yield _table([*out, _segment(symbols, s)], schema)


TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
WAY = "part int, run int, start int, end int, tail int, " + ", ".join(f"{c} long" for c in TOTALS)


def _ways(segments: list[dict]) -> list[dict]:
    """Where the segments of a conversation begin and end on its cheapest way; the last one has the totals."""
    pieces = [(tuple(tuple(s["costs"][4 * p : 4 * p + 4]) for p in range(4)), tuple(tuple(s["places"][4 * p : 4 * p + 4]) for p in range(4))) for s in segments]
    end, cost = last_state(*forward(pieces, NONE))
    ways = [NONE, *crossings(pieces, NONE, end)]
    total = {c: sum(s[c] for s in segments) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    low = high = last = None
    for s in segments:
        if s["last"] is not None:
            total["illegal"] += last is not None and last + s["first"] not in LEGAL
            last = s["last"]
        if s["high"] is not None:
            total["turns"] -= s["low"] == high
            low, high = (s["low"] if low is None else low), s["high"]
    gaps = 0 if low is None else high - low + 1 - total.pop("turns")
    total |= {"gaps": gaps, "cost": cost}
    out = [{"conv_id": s["conv_id"], "part": s["part"], "run": s["run"], "start": p, "end": q, "tail": 0} for s, p, q in zip(segments, ways, ways[1:], strict=False)]
    out[-1] |= {c: total[c] for c in TOTALS} | {"tail": TAIL[end]}
    return out


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted segments to their ways. A conversation has a segment a task of the step before at most."""
    schema, held = None, []
    for batch in batches:
        schema, out = schema or _schema(batch.schema.field("conv_id").type, WAY), []
        for s in batch.to_pylist():
            if held and s["conv_id"] != held[0]["conv_id"]:
                out += _ways(held)
                held = []
            held.append(s)
        yield _table(out, schema)
    if held:
        yield _table(_ways(held), schema)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces = [audit_of(s, p, q) + "I" * t for s, p, q, t in zip(*(batch.column(c).to_pylist() for c in ("symbols", "start", "end", "tail")), strict=True)]
        yield batch.drop_columns(["symbols", "start", "end", "tail"]).append_column("piece", pa.array(pieces, pa.string()))


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation in rows (as damaged() gives).

    Texts do not move here: a row is its role's initial, its faults and a hash. Equal rows are counted before they meet.
    Rows are dealt by ranges of (conversation, turn, role, hash), so that a conversation of any length is shared by many
    tasks; each sends the costs of its stretch from every state to every state. Those of a conversation, one a task, meet
    and are solved by divide and conquer; with both ends known, every stretch is then solved by itself in the same way.
    """
    keyed = _keyed(rows)
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    facts = keyed.select("conv_id", *ORDER, "copies", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    met = cut(facts.groupBy("conv_id", *ORDER).agg(F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")), "rows")
    text = ["conv_id", "h1", "h2"]
    again = met.where((F.col("n") > 0) & ~F.col("blank")).groupBy(*text).agg(F.count("*").alias("k"), F.min(F.struct("turn")).alias("since")).where(F.col("k") > 1)
    again = small_side(cut(again.select(*(F.col(c).alias(f"_{c}") for c in text), "since"), "again"), F.lit(40))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    later = F.coalesce(F.struct("turn") > F.col("since"), F.lit(False))
    marked = met.join(again, same, "left").select("conv_id", *ORDER, "n", "blank", "truncated", later.alias("later"))
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, "
    segments = cut(marked.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER).mapInArrow(_segments, conv + SEGMENT), "segments")
    ways = cut(segments.drop("symbols").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_solve, conv + WAY), "ways")
    pieces = segments.select("part", "run", "symbols").join(ways, ["part", "run"]).select("conv_id", "part", "symbols", "start", "end", "tail", *TOTALS)
    solved = pieces.mapInArrow(_audits, f"{conv}part int, " + ", ".join(f"{c} long" for c in TOTALS) + ", piece string")
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"]))
    return solved.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in TOTALS), joined.alias("audit"))


# ---- texts


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each conversation its audit row, then (edit, role, text) of each row of the repaired one and of each deleted row.

    The rows are sorted; a conversation's first one has its audit.
    """
    head, at, state = None, 0, NONE

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(head["audit"]) and head["audit"][at] == "I":
            at, state = at + 1, ASSISTANT if state == USER else USER
            yield "I", "assistant" if state == ASSISTANT else "user", ""

    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                if head is not None:
                    yield from inserted()
                head, at, state = row, 0, NONE
                yield head, None, None
                continue
            for _ in range(row["copies"]):
                yield from inserted()
                letter, role = head["audit"][at], row["role"]
                at += 1
                if letter == "R":
                    state = ASSISTANT if state == USER else USER
                    role = "assistant" if state == ASSISTANT else "user"
                elif letter == "K":
                    state = "osua".index(role[:1])
                yield letter, role, row["text"]
    if head is not None:
        yield from inserted()


def _digests(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, sha, first = [], None, None, True
        for letter, role, text in _edited(batches):
            if isinstance(letter, dict):
                if head is not None:
                    out.append({c: head.get(c) for c in schema.names} | {"repaired_sha256": sha.hexdigest()})
                head, sha, first = letter, hashlib.sha256(), True
                if len(out) >= 5000:
                    yield _table(out, schema)
                    out = []
            elif letter != "D":
                sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False
        if head is not None:
            yield _table([*out, {c: head.get(c) for c in schema.names} | {"repaired_sha256": sha.hexdigest()}], schema)

    return run


def _repaired(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, place, size = [], None, 0, 0
        for letter, role, text in _edited(batches):
            if isinstance(letter, dict):
                head, place = letter, 0
                continue
            out.append({"conv_id": head["conv_id"], "place": None if letter == "D" else place, "edit": letter, "role": role, "text": text})
            place, size = place + (letter != "D"), size + len(text)
            if len(out) >= 5000 or size > 1 << 24:
                yield _table(out, schema)
                out, size = [], 0
        if out:
            yield _table(out, schema)

    return run


def _streamed(rows: DataFrame, run: Callable, ddl: str) -> DataFrame:
    """Texts pass in order, after their conversation's audit, through a task that holds a batch of them at a time."""
    conv, kind = rows.schema["conv_id"].dataType, rows.schema["turn"].dataType.simpleString()
    heads = audits(rows)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    top = heads.select("conv_id", F.lit(0).alias("kind"), none("turn", kind), none("role", "string"), none("h1", "long"), none("h2", "long"), none("copies", "long"), none("text", "string"), *TOTALS, "audit")
    body = _keyed(rows).where(F.col("copies") > 0).select("conv_id", F.lit(1).alias("kind"), *ORDER, "copies", "text", *(none(c, "long") for c in TOTALS), none("audit", "string"))
    stream = top.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    return stream.mapInArrow(run, f"conv_id {conv.simpleString()}, {ddl}")


def _conv_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["conv_id"].dataType)


def repair_digests(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation.

    rows is as damaged() or undamaged() gives it. Rows of a conversation stand in the order of turn (nulls first), then
    role and a hash of role and text, so that rows of one turn have an order too; equal rows stand side by side. Role and
    text are compared by two 64-bit hashes. A null conv_id is a conversation of its own. A role's initial is its first
    character as it stands; an empty role has none and is in no order. A conversation without rows has zeros, an empty
    audit and the hash of the empty string; an empty table gives no rows. Other columns are left aside. The hash of a
    conversation's text is one sequence, so its rows pass through one task, which holds a batch of 64 MB at a time.
    """
    schema = pa.schema([("conv_id", _conv_type(rows)), *((c, pa.int64()) for c in TOTALS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return _streamed(rows, _digests(schema), ", ".join(f"{c} long" for c in TOTALS) + ", audit string, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit (K, R, D or I), role and text of the rows of every repaired conversation.

    Deleted rows have a null place. Order, hashes and edge cases are those of repair_digests(); a conversation of which
    no row is left has no rows here.
    """
    schema = pa.schema([("conv_id", _conv_type(rows)), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return _streamed(rows, _repaired(schema), "place long, edit string, role string, text string")
