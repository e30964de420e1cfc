"""Conversation repair against an enumeration of all edits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from stellagrid.llm import conversations as c
from stellagrid.llm import queries


def after_damage(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv]
        one = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0)) for k, v in by.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_audit(rows, faults):
    """Every audit that puts the roles in order, by walking all edits from left to right; roles are held by the pattern alone."""
    ways = [(0, "", "", ())]
    fits = re.compile(r"s?(ua)*u?")

    def grown(ways):
        out = list(ways)
        for _ in range(2):
            ways = [(cost + 3, audit + "I", roles + r, kept + ((name, ""),)) for cost, audit, roles, kept in ways for r, name in (("u", "user"), ("a", "assistant")) if fits.fullmatch(roles + r)]
            out += ways
        return out

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for cost, audit, roles, kept in grown(ways):
            more = 3 if fault == "truncated" else 0
            options = [(4, "D", "", ())]
            if fault not in ("blank", "duplicate"):
                options += [(more, "K", role[:1], ((role, text),)), (3 + more, "R", "u", (("user", text),)), (3 + more, "R", "a", (("assistant", text),))]
            for price, letter, r, row in options:
                if fits.fullmatch(roles + r) and (r or letter == "D"):
                    state = (roles + r)[-1:]
                    way = (cost + price, audit + letter, roles + r, kept + row)
                    if state not in new or way[:2] < new[state][:2]:
                        new[state] = way
        ways = list(new.values())
    return min((w for w in grown(ways) if re.fullmatch(r"(s?(ua)+)?", w[2])), key=lambda w: w[:2])


def all_audits(rows, faults):
    """The same by plain enumeration, for short conversations."""
    found = []
    tokens = ["I" * k + x for k in range(3) for x in "DKR"]
    for way in itertools.product(tokens, repeat=len(rows)):
        for tail in range(3):
            audit = "".join(way) + "I" * tail
            cost, letters = 0, [x for x in audit]
            at, options = 0, [""]
            for x in letters:
                if x == "I":
                    cost += 3
                    options = [o + r for o in options for r in "ua"]
                    continue
                fault, role = faults[at], rows[at][1][:1]
                at += 1
                if x == "D":
                    cost += 4
                    continue
                if fault in ("blank", "duplicate"):
                    options = []
                    break
                cost += (3 if fault == "truncated" else 0) + (3 if x == "R" else 0)
                options = [o + r for o in options for r in ("ua" if x == "R" else role if role else "#")]
            if any(re.fullmatch(r"(s?(ua)+)?", o) for o in options):
                found.append((cost, audit))
    return min(found)


def expected(rows):
    faults = faults_of(rows)
    cost, audit, _, kept = brute_audit(rows, faults)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join(f"{role}:{text}" for role, text in kept)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def conversation_rows(n, longest, seed=1):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "What?", "and then", " ", "", None, "é.", "Why not. "]
    rows = []
    for conv in [None, *range(n)]:
        size = r.randint(1, longest)
        turns = [None] + r.sample(range(size * 2), size)
        for t in turns[r.randint(0, 1) :]:
            rows.append((conv, t, r.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]), r.choice(texts) if r.random() < 0.4 else f"text {r.random()}" + r.choice([".", ""])))
    return rows


COLUMNS = [*c.TOTALS[:5], "cost", "audit", "repaired_sha256"]


def got(df):
    return {r["conv_id"]: tuple(r[k] for k in COLUMNS) for r in df.collect()}


def test_enumeration_agrees_with_the_walk():
    r = random.Random(3)
    for _ in range(60):
        rows = [(k, r.choice(["user", "assistant", "system", "odd"]), r.choice(["a.", "b.", "", "c"])) for k in range(r.randint(0, 3))]
        assert brute_audit(rows, faults_of(rows))[:2] == all_audits(rows, faults_of(rows))


def test_divide_and_conquer_is_least():
    r = random.Random(5)
    for _ in range(400):
        rows = [(k, r.choice(["user", "assistant", "system", "odd"]), r.choice(["a.", "b.", "", "c", f"{k}.", f"{k}"])) for k in range(r.randint(0, 14))]
        faults = faults_of(rows)
        symbols = "".join("x" if f in ("blank", "duplicate") else (x[1][0].upper() if f else x[1][0]) for x, f in zip(rows, faults, strict=True))
        end, cost = c.last_state(*c.forward(symbols, c.NONE))
        assert (cost, c.audit_of(symbols, c.NONE, end) + "I" * c.TAIL[end]) == brute_audit(rows, faults)[:2]


@pytest.fixture(scope="module")
def table(spark):
    rows = conversation_rows(150, 8) + [(900, t, "user" if t % 2 else "assistant", f"{t} said" + "." * (t % 3 > 0)) for t in range(700)]
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, audit string").repartition(5)


def test_against_brute_force(table):
    rows, df = table
    want = {k: expected(v) for k, v in after_damage(rows).items()}
    assert got(c.repair_digests(c.damaged(df))) == want


def test_a_conversation_over_many_tasks(spark, table):
    """Ranges cut a conversation anywhere, and its result stays the same."""
    rows, df = table
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert got(c.repair_digests(c.damaged(df))) == {k: expected(v) for k, v in after_damage(rows).items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_repaired_rows_give_the_digest(table):
    _, df = table
    rows = c.damaged(df)
    by = defaultdict(list)
    for r in c.repair(rows).where("edit != 'D'").collect():
        by[r["conv_id"]].append((r["place"], f"{r['role']}:{r['text']}"))
    for conv, values in got(c.repair_digests(rows)).items():
        assert hashlib.sha256("\n".join(t for _, t in sorted(by[conv])).encode()).hexdigest() == values[-1]
        assert re.fullmatch(r"(s?(ua)+)?", "".join(t[0] for _, t in sorted(by[conv])))


def test_edges(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert c.repair_digests(c.damaged(spark.createDataFrame([], schema))).count() == 0
    one = c.repair_digests(c.undamaged(spark.createDataFrame([("a", 1, "user", "x" * 3_000_000 + "."), ("a", 1, "user", "x" * 3_000_000 + "."), ("b", None, None, None)], schema)))
    found = {r["conv_id"]: r for r in one.collect()}
    assert (found["a"]["audit"], found["a"]["cost"], found["a"]["duplicate"]) == ("KDI", 7, 1) and found["b"]["audit"] == "D" and found["b"]["blank"] == 1


def test_sql(spark, small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    df = queries.QUERIES["op13_conversations"](spark, small)
    sql = con.execute("SELECT " + ", ".join(df.columns) + f" FROM ({queries.SQL['op13_conversations']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(sql) and sql
