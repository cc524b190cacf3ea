import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from quern.llm import conversation_repair as op

SCHEMA = "conv_id long, turn long, role string, text string, c string, part int, `block` string"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    one = lambda v: " " if v is None else v
    for c, t, role, text in rows:
        k = zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if k == 1 else text.translate({ord(m): None for m in ".!?"}) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def legal(initials):
    return "".join(x or "-" for x in initials) in ("", *(s + "ua" * n for s in ("", "s") for n in range(1, len(initials) + 1)))


def cheapest(rows, most=3):
    """Least (cost, audit, lines) over all edits with at most most inserts, tried one by one."""
    best = None
    arcs = []
    for role, text, fault in rows:
        arcs.append([("D", 2, None)])
        if fault not in ("blank", "duplicate"):
            extra = 5 * (fault == "truncated")
            arcs[-1] += [("K", extra, (role, text)), ("R", 1 + extra, ("user", text)), ("R", 1 + extra, ("assistant", text))]
    insert = [("I", 5, ("user", "")), ("I", 5, ("assistant", ""))]
    for n in range(most + 1):
        for gaps in itertools.combinations_with_replacement(range(len(rows) + 1), n):
            steps = []
            for i in range(len(rows) + 1):
                steps += [insert] * gaps.count(i) + ([arcs[i]] if i < len(rows) else [])
            for path in itertools.product(*steps):
                kept = [p[2] for p in path if p[2]]
                if legal([r[:1] for r, _ in kept]):
                    found = (sum(p[1] for p in path), "".join(p[0] for p in path), "\n".join(f"{r}:{t}" for r, t in kept))
                    best = found if best is None or found < best else best
    return best


def brute(rows, ids):
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(r[1:])
    out = {}
    for c in ids:
        seen, marked, mine = set(), [], sorted(convs[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        for _, role, text in mine:
            end = text.rstrip(SPACE)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [r[0] for r in mine if r[0] is not None]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, lines = cheapest(marked)
        count = lambda f: sum(m[2] == f for m in marked)  # noqa: B023, E731
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (c, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def conversations(seed, n=60, longest=5):
    r = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", None, "", "unknown", "Assistant", "übel"], ["Yes.", "No!", "cut off", "", " \n", "What?  ", None, "Ünï.", "a.\u0085", "end. "]
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, longest + 1)):
            rows.append((c, r.choice([t, t, t, t + 1, None]), r.choice(roles), r.choice(texts)))
            if r.random() < 0.1:
                rows.append(rows[-1])
    return rows + [(None, 1, "user", "Hello."), (None, None, "assistant", "Hi.")]


@pytest.fixture
def table_of(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("block", [2048, 2])
def test_all_cases(table_of, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK", block)  # blocks of two rows: paths composed from blocks are those of the whole
    rows = conversations(1)
    ids = {r[0] for r in rows}
    got = {r.conv_id: tuple(r) for r in op.report(table_of(rows)).collect()}
    plain = [(c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows]
    want = brute(plain, ids)
    assert [(got[i], want[i]) for i in ids if got[i] != want[i]] == [] and set(got) == ids


def test_damage_and_sql(spark, table_of):
    rows = conversations(2, 200, 7)
    d = table_of(rows)
    assert sorted(map(repr, damaged(rows))) == sorted(repr(tuple(r)) for r in op.damage(d).collect())
    got = {r.conv_id: tuple(r) for r in op.report(op.damage(d), d).collect()}
    short = {c for c in got if sum(r[0] == c for r in damaged(rows)) <= 4}
    want = brute([r for r in damaged(rows) if r[0] in short], short)
    assert {c: got[c] for c in short} == want and any(v[7] == "" for v in want.values())
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: r for r in con.execute(f"SELECT {', '.join(names)} FROM ({op.SQL})").fetchall()} == got


def viterbi(rows):
    """Cost by plain dynamic programming without strings."""
    inf = 10**9
    w = [0, inf, inf, inf]
    moves = [(0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)]

    def inserts(w):
        for _ in range(3):
            for a, x, b in moves:
                if x in "ua":
                    w[b] = min(w[b], w[a] + 5)
        return w

    for initial, fault in rows:
        w = inserts(w)
        new = [x + 2 for x in w]
        if fault not in "bd" or not fault:
            for a, x, b in moves:
                cost = 5 * (fault == "t") + (0 if x == initial else 1 if x in "ua" else inf)
                new[b] = min(new[b], w[a] + cost)
        w = new
    w = inserts(w)
    return min(w[0], w[3])


def test_one_conversation_with_most_rows(table_of, monkeypatch):
    """A third of all rows in one conversation: its blocks lie in many tasks; copies are counted, not moved."""
    monkeypatch.setattr(op, "BLOCK", 100)
    r = random.Random(5)
    hot = [(7, t, r.choice(["user", "assistant"]), f"text {t}" + r.choice(["", ".", "!"])) for t in range(4000)]
    rows = hot + [(7, 100, "user", "same.")] * 3000 + [(i, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for i in range(100, 1100) for t in range(2)]
    d = table_of(rows)
    got = {x.conv_id: x for x in op.report(d).collect()}
    hot_rows = sorted(hot + [(7, 100, "user", "same.")], key=lambda x: (x[1], x[2], hashlib.sha256(x[3].encode()).hexdigest()))
    marks = [(x[2][0], "t" if x[3][-1] not in ".!?" else "") for x in hot_rows]
    one = got[7]
    assert one.cost == viterbi(marks) + 2 * 2999 and one.duplicate == 2999 and one.gaps == 0
    assert sum(x in "KRD" for x in one.audit) == 7000 and one.illegal == 2999 + sum(a[0] + b[0] not in op.LEGAL for a, b in itertools.pairwise(marks))
    assert all(got[i].audit == "KK" and got[i].cost == 0 for i in range(100, 1100))
    fixed = op.repair(d).filter("conv_id = 7").orderBy("part", "block", "seq").collect()
    assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in fixed).encode()).hexdigest() == one.repaired_sha256
    assert legal([x.role[:1] for x in fixed][:2000]) and "".join(x.edit for x in fixed) == "".join(x for x in one.audit if x != "D")


def test_empty_table(table_of):
    d = table_of([])
    assert op.report(d).collect() == [] and op.repair(d).collect() == []
    gone = op.report(d, table_of([(3, 1, "user", "x")])).collect()
    assert [tuple(x) for x in gone] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
