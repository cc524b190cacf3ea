"""Conversation structure repair (operator 11) by weighted finite-state composition.

A conversation's rows in order are an input acceptor, a chain. The edit transducer reads a row and keeps it, changes
its role, deletes it, or inserts a row between two others, each at a cost. The grammar acceptor takes the initials of
the roles that come out. Their composition is expanded lazily, state by state along the chain, and a shortest path in
topological order over weights (cost, string of edit initials), compared in that order, gives the repair. Paths of
equal cost over the same rows never have strings of which one begins the other (an insert costs more than nothing),
so the order is kept by extension to both sides and paths can be composed from blocks.

Rows are keyed by (conversation, turn, role, SHA-256 of the text) with a count, so repeated rows are one narrow row;
a range partitioning by that key puts every conversation in order, and one that holds a third of all rows is spread
over many tasks. Each task cuts its run into blocks of at most BLOCK rows and gives each block its best path from any
grammar state to any other. Two sweeps over a few numbers for each block, from the end with four weights and from the
start with one state, choose the paths; blocks and texts meet them afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import CRC_TABLE, crc_sql, partitions, staged
from quern.operators.skew import hot_join

#: Rows of a block.
BLOCK = 2048
#: Grammar (s?(ua)+)? over role initials: next state by state and initial; 0 is the start. Accepting states.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPT = (0, 3)
#: Costs of the edits, of a row that stays though it is truncated; roles that can be written.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
STATES = range(len(GRAMMAR))
#: Pairs of initials that may follow one another. White space of the word rule.
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"


def _arcs(initial: str, fault: str) -> list[tuple[str, str | None, int]]:
    """Arcs of the edit transducer that read one row: (edit, role initial that comes out if any, cost)."""
    arcs: list[tuple[str, str | None, int]] = [("D", None, DELETE)]
    if fault not in ("b", "d"):
        extra = TRUNCATED if fault == "t" else 0
        arcs += [("K", initial, KEEP + extra)] + [("R", r, REROLE + extra) for r in ROLES if r != initial]
    return arcs


def _after(weights: dict, out: list[tuple[str, str | None, int]]) -> dict:
    """Best weights after one arc of out from each state reached: the composition's next states."""
    found: dict = {}
    for g, (cost, audit) in weights.items():
        for edit, initial, c in out:
            to = g if initial is None else GRAMMAR[g].get(initial)
            if to is not None:
                w = (cost + c, audit + edit)
                if to not in found or w < found[to]:
                    found[to] = w
    return found


def _inserted(weights: dict) -> dict:
    """weights with what inserts reach: at most one for each grammar state, as more only come back at a cost."""
    arcs = [("I", r, INSERT) for r in ROLES]
    for _ in STATES:
        for g, w in _after(weights, arcs).items():
            if g not in weights or w < weights[g]:
                weights = weights | {g: w}
    return weights


def paths(rows: tuple[tuple[str, str], ...]) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) of a block: the best path from each grammar state to each other that it reaches.

    rows are (role initial, fault). Inserts stand before rows, so of two strings none begins the other.
    """
    out = []
    for start in STATES:
        weights = {start: (0, "")}
        for initial, fault in rows:
            weights = _after(_inserted(weights), _arcs(initial, fault))
        out += [(start, to, *w) for to, w in sorted(weights.items())]
    return out


_known_paths = lru_cache(1 << 14)(paths)


def ending() -> dict[int, tuple[int, str]]:
    """Best weight from each grammar state to the end of a conversation: inserts up to an accepting state."""
    best = {}
    for g in STATES:
        reached = _inserted({g: (0, "")})
        best[g] = min(reached[to] for to in ACCEPT if to in reached)
    return best


_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Record batches of tuples in the columns of a DDL schema, some 2,000 rows or a million values each."""
    pairs = [f.split() for f in schema.split(", ")]
    fields = pa.schema([(name, pa.list_(_TYPES[kind[6:-1]]) if kind.startswith("array<") else _TYPES[kind]) for name, kind in pairs])
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) if isinstance(x, (list, str)) else 1 for x in r)
        if len(held) >= 2000 or size >= 1 << 20:
            yield pa.record_batch([pa.array(col, f.type) for col, f in zip(zip(*held, strict=True), fields, strict=True)], schema=fields)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(col, f.type) for col, f in zip(zip(*held, strict=True), fields, strict=True)], schema=fields)


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(col.to_pylist() for col in b.columns), strict=True)


_ROW = ["turn", "role", "dg", "initial", "fault", "copies"]
_BLOCK = (
    "c string, part long, block long, turn array<long>, role array<string>, dg array<string>, initial array<string>, fault array<string>, copies array<long>, "
    "src array<long>, dst array<long>, cost array<long>, audit array<string>, rank array<long>, illegal long"
)
_BACK = "c string, part long, block long, best array<long>, dst array<long>, end array<string>, total array<long>, illegal long, head string, tail string"
_CHOSEN = "part long, block long, c string, state long, path long, end string, total long, illegal long"
_EDITS = "c string, part long, block long, seq long, edit string, out string, turn long, role string, dg string"


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _cut(batches):
    """Blocks of a range partition's rows, which come in order; no block spans conversations."""

    def block(c: str, number: int, rows: list[tuple]) -> tuple:
        cols = [list(x) for x in zip(*rows, strict=True)]
        key = tuple(zip(cols[3], cols[4], strict=True))
        src, dst, cost, audit = map(list, zip(*(_known_paths(key) if len(key) <= 16 else paths(key)), strict=True))
        order = sorted(set(audit))
        return (c, part, number, *cols, src, dst, cost, audit, [order.index(a) for a in audit], _illegal(cols[3]))

    def cut():
        at, number, held = None, 0, []
        for c, *row in _rows(batches):
            if held and (c != at or len(held) == BLOCK):
                yield block(at, number, held)
                number, held = number + 1, []
            at = c
            held.append(row)
        if held:
            yield block(at, number, held)

    part = TaskContext.get().partitionId()
    yield from _batches(cut(), _BLOCK)


def _backward(batches):
    """From a conversation's last block to its first: for each grammar state the path taken there (its place among the
    block's, -1 where none leads to the end) and the cost from there; at the last block the inserts that end it."""

    def sweep():
        at, suffix, end = None, {}, ending()
        last_order = sorted({a for _, a in end.values()})
        for c, part, block, src, dst, cost, rank, illegal, head, tail in _rows(batches):
            last = c != at
            if last:
                suffix = {g: (w, last_order.index(a)) for g, (w, a) in end.items()}
            # (cost, place among the strings that follow) is all that composing a block needs.
            best, found = [-1] * len(STATES), {}
            for i, (g, to, w, r) in enumerate(zip(src, dst, cost, rank, strict=True)):
                if to in suffix:
                    weight = (w + suffix[to][0], r, suffix[to][1])
                    if g not in found or weight < found[g]:
                        found[g], best[g] = weight, i
            order = sorted({w[1:] for w in found.values()})
            suffix = {g: (w[0], order.index(w[1:])) for g, w in found.items()}
            at = c
            yield c, part, block, best, dst, [end[g][1] for g in STATES] if last else None, [suffix[g][0] if g in suffix else None for g in STATES], illegal, head, tail

    yield from _batches(sweep(), _BACK)


def _forward(batches):
    """From a conversation's first block to its last: the state it begins in, the path chosen, illegal pairs."""

    def sweep():
        at, state, before = None, 0, ""
        for c, part, block, best, dst, end, total, illegal, head, tail in _rows(batches):
            first, at = c != at, c
            state = 0 if first else state
            illegal += 0 if first else _illegal([before, head])
            path = best[state]
            to, before = dst[path], tail
            yield part, block, c, state, path, end[to] if end else "", total[0] if first else 0, illegal
            state = to

    yield from _batches(sweep(), _CHOSEN)


def _walk(batches):
    """One row for each row that stays or is inserted: its place, edit, role, and the key of the row it comes from."""

    def walk():
        for c, part, block, state, audit, turn, role, dg, initial in _rows(batches):
            i = 0
            for seq, edit in enumerate(audit):
                if edit != "D":
                    out = role[i] if edit == "K" else next(ROLES[x] for x in ROLES if x in GRAMMAR[state])
                    state = GRAMMAR[state][initial[i] if edit == "K" else out[0]]
                    yield c, part, block, seq, edit, out, *((None, None, None) if edit == "I" else (turn[i], role[i], dg[i]))
                i += edit != "I"

    yield from _batches(walk(), _EDITS)


def _keyed(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """c (the id as text, empty for null: ids are whole numbers), turn, role, text, dg (SHA-256 of the text)."""
    one = lambda col: F.coalesce(rows[col].cast("string"), F.lit(" "))
    out = rows.select(F.coalesce(rows[conv_col].cast("long").cast("string"), F.lit("")).alias("c"), rows[turn_col].cast("long").alias("turn"), one(role_col).alias("role"), one(text_col).alias("text"))
    return out.withColumn("dg", F.sha2("text", 256))


def faults(rows: DataFrame) -> DataFrame:
    """c, turn, role, dg, initial, fault (b, d, t or empty), copies of the distinct rows of _keyed.

    A row is a duplicate if its role and text have a smaller turn in its conversation; copies after the first are
    duplicates too and are only counted.
    """
    end = F.rtrim("text", F.lit(BLANKS))
    mark = F.when(end == "", "b").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    once = rows.groupBy("c", "turn", "role", "dg", mark.alias("mark")).agg(F.count(F.lit(1)).alias("copies"))
    once = staged(once, "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = once.groupBy("c", "role", "dg").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    out = hot_join(once, staged(first, "first-turns"), ["c", "role", "dg"], "_n", "left")
    later = F.coalesce(place > F.col("_first"), F.lit(False))
    fault = F.when(F.col("mark") == "b", "b").when(later, "d").otherwise(F.col("mark"))
    return out.select("c", "turn", "role", "dg", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "copies")


def solve(rows: DataFrame) -> DataFrame:
    """Blocks of the rows of faults(), in order by (c, part, block), with state, audit (edit initials of distinct rows
    and inserts), total (the conversation's cost but for copies, at its first block) and illegal."""
    p = partitions(rows.sparkSession)
    ranged = rows.repartitionByRange(p, "c", F.col("turn").asc_nulls_first(), "role", "dg").sortWithinPartitions("c", F.col("turn").asc_nulls_first(), "role", "dg")
    blocks = staged(ranged.select("c", *_ROW).mapInArrow(_cut, _BLOCK), "blocks")
    ends = [F.col("initial")[0].alias("head"), F.element_at("initial", -1).alias("tail")]
    place = ["c", "part", "block"]
    back = blocks.select(*place, "src", "dst", "cost", "rank", "illegal", *ends).repartition("c").sortWithinPartitions("c", F.desc("part"), F.desc("block"))
    back = staged(back.mapInArrow(_backward, _BACK), "backward")
    chosen = back.repartition("c").sortWithinPartitions(*place).mapInArrow(_forward, _CHOSEN)
    out = blocks.drop("illegal").join(chosen.drop("c"), ["part", "block"])
    audit = F.concat(F.col("audit")[F.col("path").cast("int")], "end")
    return staged(out.select(*place, "state", audit.alias("audit"), "total", "illegal", "turn", "role", "dg", "initial", "fault", "copies"), "solved")


def _repaired(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """c, part, block, seq, edit, role, text of the rows that stay or are inserted, in order by the first four."""
    edits = solved.select("c", "part", "block", "state", "audit", "turn", "role", "dg", "initial").mapInArrow(_walk, _EDITS)
    texts = rows.groupBy(F.col("c").alias("_c"), F.col("turn").alias("_turn"), F.col("role").alias("_role"), F.col("dg").alias("_dg")).agg(F.first("text").alias("text"))
    same = F.col("c").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("role") == F.col("_role")) & (F.col("dg") == F.col("_dg"))
    old = edits.filter("edit <> 'I'").join(texts, same).select("c", "part", "block", "seq", "edit", "out", "text")
    new = edits.filter("edit = 'I'").select("c", "part", "block", "seq", "edit", "out", F.lit("").alias("text"))
    return old.unionByName(new).withColumnRenamed("out", "role")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, part, block, seq, edit, role, text: the repaired conversations, in order by the first four columns.

    Rows of a conversation are in order by turn, null turns first, ties by role and then by the text's SHA-256; rows
    that repeat all four are one row and copies that are deleted. A null id is a conversation of its own; a null role
    or text is one space; an empty role has no initial, so such a row cannot be kept as it is. An empty table gives an empty result. Other columns are ignored.
    """
    keyed = _keyed(rows, conv_col, turn_col, role_col, text_col)
    out = _repaired(keyed, solve(faults(keyed)))
    return out.select(F.when(F.col("c") != "", F.col("c")).cast("long").alias("conv_id"), "part", "block", "seq", "edit", "role", "text")


def _hashed(batches):
    """SHA-256 of each conversation's role:text lines; one conversation is one stream, read in pieces."""

    def walk():
        at, h = None, None
        for c, role, text in _rows(batches):
            if c != at:
                if h is not None:
                    yield at, h.hexdigest()
                at, h = c, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(f"{role}:{text}".encode())
        if h is not None:
            yield at, h.hexdigest()

    yield from _batches(walk(), "c string, repaired_sha256 string")


def report(rows: DataFrame, ids: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ids (a column conv_col; default: those of rows) says which conversations are reported; one without rows has
    zeros, an empty audit and the hash of the empty string. Order, nulls, copies and empty tables are as in repair.
    The audit of a conversation is one string, and its hash reads its texts in one task (a piece at a time), since
    SHA-256 has no parts; all else of a conversation is spread over tasks.
    """
    keyed = _keyed(rows, conv_col, turn_col, role_col, text_col)
    narrow = staged(faults(keyed), "faults")
    solved = solve(narrow)
    some = lambda f, n: F.sum(F.when(F.col("fault") == f, n).otherwise(0))
    more = F.col("copies") - 1
    turns = narrow.groupBy("c", "turn").agg(
        some("b", F.col("copies")).alias("blank"), (some("d", F.col("copies")) + F.sum(F.when(F.col("fault").isin("b", "d"), 0).otherwise(more))).alias("duplicate"),
        some("t", F.lit(1)).alias("truncated"), F.sum(more).alias("more"),
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    facts = turns.groupBy("c").agg(gaps.alias("gaps"), *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "more")])
    deleted = F.transform("copies", lambda n: F.repeat(F.lit("D"), (n - 1).cast("int")))
    # The edits of distinct rows, each followed by the deletions of its copies; inserts stand before rows.
    steps = F.split(F.regexp_replace("audit", "(I*[KRD])", "$1,"), ",")
    whole = F.when(F.forall("copies", lambda n: n == 1), F.col("audit")).otherwise(F.array_join(F.zip_with(steps, deleted, lambda a, d: F.concat(F.coalesce(a, F.lit("")), F.coalesce(d, F.lit("")))), ""))
    pieces = F.array_sort(F.collect_list(F.struct("part", "block", whole.alias("a"))))
    paths_of = solved.groupBy("c").agg(F.sum("total").alias("total"), F.sum("illegal").alias("pairs"), F.array_join(F.transform(pieces, lambda x: x["a"]), "").alias("audit"))
    lines = _repaired(keyed, solved).repartition("c").sortWithinPartitions("c", "part", "block", "seq").select("c", "role", "text")
    hashes = lines.mapInArrow(_hashed, "c string, repaired_sha256 string")
    source = rows if ids is None else ids
    out = source.select(source[conv_col].cast("long").alias("conv_id"), F.coalesce(source[conv_col].cast("long").cast("string"), F.lit("")).alias("c")).distinct()
    for part in (facts, paths_of, hashes):
        out = out.join(part, "c", "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return out.select(
        "conv_id", *[zero(F.col(x)).alias(x) for x in ("gaps", "blank", "duplicate", "truncated")], zero(F.col("pairs") + F.col("more")).alias("illegal"),
        zero(F.col("total") + DELETE * F.col("more")).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def damage(rows: DataFrame) -> DataFrame:
    """conversations with faults by CRC-32 of conv_id:turn modulo 20 (a null in any column is one space there):
    0 drops a row, 1 empties its text, 2 removes its marks that end sentences, 3 repeats it, 4 makes its role user."""
    one = lambda col: F.coalesce(rows[col].cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20).alias("_kind")
    out = rows.select(rows["conv_id"], rows["turn"], one("role").alias("role"), one("text").alias("text"), kind).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_time")
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("_time")


_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_END = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
WITH RECURSIVE {CRC_TABLE},
k AS (SELECT key, {crc_sql("key")} % 20 AS kind FROM (SELECT DISTINCT {_KEY} AS key FROM conversations), tab),
o AS (SELECT conv_id, turn, kind, CASE kind WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text FROM conversations JOIN k ON key = {_KEY} WHERE kind <> 0),
m AS (SELECT conv_id, turn, role, text, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM o),
r AS (SELECT *, rtrim(text, {_END}) AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM m),
f AS (SELECT *, role[1] AS x, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN e = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN e[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM r),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
g(src, x, dst) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(src, dst, cost, a, o) AS (VALUES (0, 0, 0, '', CAST([] AS VARCHAR[])), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']),
  (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
e AS (SELECT conv_id, i, src, src AS dst, 2 AS cost, 'D' AS a, CAST([] AS VARCHAR[]) AS o FROM f, (SELECT unnest(range(4)) AS src)
  UNION ALL SELECT conv_id, i, src, dst, CASE fault WHEN 't' THEN 5 ELSE 0 END, 'K', [role || ':' || text] FROM f JOIN g USING (x) WHERE fault IN ('', 't')
  UNION ALL SELECT conv_id, i, src, dst, CASE fault WHEN 't' THEN 6 ELSE 1 END, 'R', [CASE g.x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
    FROM f JOIN g ON g.x <> f.x AND g.x IN ('u', 'a') WHERE fault IN ('', 't')),
w AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, {{'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])}} AS best FROM facts
  UNION ALL SELECT w.conv_id, w.i + 1, e.dst, min({{'c': best.c + ins.cost + e.cost, 'a': best.a || ins.a || e.a, 'o': best.o || ins.o || e.o}})
  FROM w JOIN ins ON ins.src = w.s JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.src = ins.dst GROUP BY w.conv_id, w.i, e.dst),
z AS (SELECT facts.conv_id, min({{'c': best.c + ins.cost, 'a': best.a || ins.a, 'o': best.o || ins.o}}) AS best FROM facts
  JOIN w ON w.conv_id IS NOT DISTINCT FROM facts.conv_id AND w.i = n JOIN ins ON ins.src = w.s WHERE ins.dst IN (0, 3) GROUP BY facts.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""
