"""Repair of conversation structure by a shortest path with scalar big-integer weights.

A repaired conversation is nothing, or an optional system turn and then user and
assistant in turn. Rows may be kept, given another role or deleted, and empty turns may
be inserted; the cheapest edit list is wanted, and of equally cheap ones the list whose
initials come first in ASCII order. Cost and letters are one integer: the high digits
are the cost, the low digits, of a fixed width, the letters by position, with zeros
after the end. Putting a letter before a list shifts its digits, so an ordinary integer
minimum over a directed acyclic graph of (row, state) decides cost and ties at once.

Conversations of ordinary size are solved whole. A long one is cut into segments of
bounded size; each gives the best list from every state to every state, and segments
are combined in levels, by the same integers. That is exact: two equally cheap lists
over the same rows between the same states are never one the beginning of the other,
since the longer one would hold further insertions, which cost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import durable

# cost and letter of each edit; letters are digits in ASCII order, 0 stands for the end
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {k: c for c, k in DIGIT.items()}
BITS = 3
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

# states: what the repaired turns so far end with
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by an inserted or rerolled turn
ACCEPTED = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}

MUST_DELETE, SHORTENED, FINE = "m", "t", "o"
BLANK = r"[\x20\x09-\x0D]"

SEGMENT = 512  # rows solved in one go
FAN = 64  # segments combined in one go
REMEMBERED = 20_000  # solved row patterns a worker keeps


def after_keep(state: int, initial: str) -> int | None:
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def best_edits(rows: list[tuple[str, str, int]], targets: tuple[int, ...]) -> list[tuple[int, str] | None]:
    """(cost, letters) of the best list from each state to any of ``targets``; None where there is none.

    A row is (role initial, fault, how often it is repeated); only rows that must be
    deleted repeat.
    """
    width = sum(n for _, _, n in rows) + 2 * len(rows) + 4
    low = BITS * width
    mask, top = (1 << low) - 1, low - BITS

    def before(letter: str, cost: int, rest: int | None) -> int | None:
        if rest is None:
            return None
        return (rest >> low) + cost << low | DIGIT[letter] << top | (rest & mask) >> BITS

    def least(*some: int | None) -> int | None:
        return min((x for x in some if x is not None), default=None)

    def with_inserts(here: list[int | None]) -> list[int | None]:
        one = [before("I", INSERT, here[NEXT[q]]) for q in range(4)]
        two = [before("I", INSERT, one[NEXT[q]]) for q in range(4)]  # a third could only repeat a state
        return [least(here[q], one[q], two[q]) for q in range(4)]

    now = with_inserts([0 if q in targets else None for q in range(4)])
    for initial, fault, times in reversed(rows):
        if fault == MUST_DELETE:
            for _ in range(times):
                now = [before("D", DELETE, x) for x in now]
            here = now
        else:
            extra = TRUNCATED if fault == SHORTENED else 0
            here = []
            for q in range(4):
                kept = after_keep(q, initial)
                here.append(
                    least(
                        before("K", extra, now[kept]) if kept is not None else None,
                        before("R", REROLE + extra, now[NEXT[q]]),
                        before("D", DELETE, now[q]),
                    )
                )
        now = with_inserts(here)
    out: list[tuple[int, str] | None] = []
    for x in now:
        if x is None:
            out.append(None)
            continue
        letters, digits = [], x & mask
        for at in range(top, -1, -BITS):
            digit = digits >> at & 7
            if not digit:
                break
            letters.append(LETTER[digit])
        out.append((x >> low, "".join(letters)))
    return out


def scalar(some: tuple[int, str], width: int) -> int:
    cost, letters = some
    digits = int("".join(str(DIGIT[c]) for c in letters) or "0", 8)
    return cost << BITS * width | digits << BITS * (width - len(letters))


def better(some: list[tuple[int, str]]) -> tuple[int, str] | None:
    """The smallest scalar weight."""
    if len(some) < 2:
        return some[0] if some else None
    width = max(len(letters) for _, letters in some)
    return min(some, key=lambda x: scalar(x, width))


@dataclass
class Span:
    """A stretch of consecutive rows of one conversation."""

    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None  # initials of the roles at both ends
    last: str | None = None
    low: int | None = None  # turns
    high: int | None = None
    turns: int = 0
    edits: tuple = ()  # (cost, letters) by from-state * 4 + to-state

    def then(self, other: Span) -> Span:
        edits = []
        for a in range(4):
            for c in range(4):
                pairs = [(self.edits[4 * a + b], other.edits[4 * b + c]) for b in range(4)]
                edits.append(better([(x[0] + y[0], x[1] + y[1]) for x, y in pairs if x and y]))
        known = [x for x in (self.low, self.high, other.low, other.high) if x is not None]
        return Span(
            rows=self.rows + other.rows,
            blank=self.blank + other.blank,
            duplicate=self.duplicate + other.duplicate,
            truncated=self.truncated + other.truncated,
            illegal=self.illegal + other.illegal + (self.last + other.first not in LEGAL),
            first=self.first,
            last=other.last,
            low=min(known, default=None),
            high=max(known, default=None),
            # turns come in order, so only one may stand on both sides
            turns=self.turns + other.turns - (self.high is not None and self.high == other.low),
            edits=tuple(edits),
        )

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


LEGAL = ("su", "ua", "au")
FIELDS = ("rows", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")
SPAN = "rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, costs array<long>, letters array<string>"
RESULT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha string"
_RESULT = pa.schema([("conv", pa.int64()), *[(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("sha", pa.string())])
_SPAN = [*[(k, pa.int64()) for k in FIELDS[:5]], ("first", pa.string()), ("last", pa.string()), *[(k, pa.int64()) for k in FIELDS[7:]],
         ("costs", pa.list_(pa.int64())), ("letters", pa.list_(pa.string()))]


def _row_of(span: Span) -> dict:
    out = {k: getattr(span, k) for k in FIELDS}
    return out | {"costs": [e and e[0] for e in span.edits], "letters": [e and e[1] for e in span.edits]}


def _span_of(row: dict) -> Span:
    edits = tuple(None if c is None else (c, x) for c, x in zip(row["costs"], row["letters"], strict=True))
    return Span(**{k: row[k] for k in FIELDS}, edits=edits)


@dataclass
class Line:
    """Equal rows of a conversation, one after another."""

    turn: int | None
    role: str
    text: str
    times: int
    fault: str | None  # of the first of them; the others are duplicates
    again: bool  # the first has been seen before, too


def measured(lines: list[Line]) -> Span:
    """Counts of some rows in order; the edits are still open."""
    out = Span(edits=())
    for line in lines:
        initial, n = line.role[:1], line.times
        fresh = 0 if line.again or line.fault == "blank" else 1
        out.rows += n
        out.blank += n if line.fault == "blank" else 0
        out.duplicate += 0 if line.fault == "blank" else n - fresh
        out.truncated += fresh if line.fault == "truncated" else 0
        out.illegal += (n - 1) * (initial + initial not in LEGAL)
        if out.first is None:
            out.first = initial
        else:
            out.illegal += out.last + initial not in LEGAL
        out.last = initial
        if line.turn is not None:
            out.low = line.turn if out.low is None else out.low
            out.turns += out.high != line.turn
            out.high = line.turn
    return out


def pattern(lines: list[Line]) -> list[tuple[str, str, int]]:
    """What the edits depend on."""
    out = []
    for line in lines:
        deleted = line.times
        if not line.again and line.fault != "blank":
            out.append((line.role[:1] if line.role[:1] in "sua" else "x", SHORTENED if line.fault == "truncated" else FINE, 1))
            deleted -= 1
        if deleted:
            out.append(("x", MUST_DELETE, deleted))
    return out


class Solver:
    """Best edits of row patterns, remembered."""

    def __init__(self) -> None:
        self.seen: dict[tuple, tuple] = {}

    def edits(self, lines: list[Line], targets: tuple[tuple[int, ...], ...]) -> tuple:
        rows = tuple(pattern(lines))
        found = self.seen.get((rows, targets))
        if found is None:
            found = tuple(best_edits(list(rows), t) for t in targets)
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            if len(rows) <= 16:
                self.seen[rows, targets] = found
        return found

    def whole(self, lines: list[Line]) -> tuple[int, str]:
        return self.edits(lines, (ACCEPTED,))[0][START]

    def between(self, lines: list[Line]) -> tuple:
        by_target = self.edits(lines, tuple((q,) for q in range(4)))
        return tuple(by_target[c][a] for a in range(4) for c in range(4))


def repaired(lines: list[Line], letters: str, state: int = START) -> Iterator[str]:
    """``role:text`` of every turn that stands after the edits."""
    rows = ((line.role, line.text) for line in lines for _ in range(line.times))
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            yield f"{ROLE[state]}:"
            continue
        role, text = next(rows)
        if letter == "R":
            state = NEXT[state]
            yield f"{ROLE[state]}:{text}"
        elif letter == "K":
            state = after_keep(state, role[:1])
            yield f"{role}:{text}"


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): rows with planted faults, chosen by CRC-32 of ``conv:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes out its ``[.!?]``, 3 repeats it next to
    itself, 4 sets the role user. Nulls count as one space, but turn stays null.
    """
    conv, turn = F.col(f"`{id_col}`").cast("long"), F.col(f"`{turn_col}`").cast("long")
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    shown = [F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)]
    kind = F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20
    out = rows.select(conv.alias("conv"), turn.alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    return out.where("kind <> 0").select(
        "conv",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def lines(rows: DataFrame) -> DataFrame:
    """Stored (conv, turn, role, text, times, fault, again) of (conv, turn, role, text, copies).

    Equal rows of one turn become one row with a count before anything else, so however
    often a row is repeated it is one.
    """
    equal = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("times"))
    mark = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    last = F.regexp_extract("text", rf"(?s)([^\x20\x09-\x0D]){BLANK}*\z", 1)
    fault = F.when(last == "", "blank").when(~last.rlike(r"[.!?]"), "truncated")
    equal = equal.withColumn("mark", mark).withColumn("fault", fault)
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = equal.groupBy(F.col("conv").alias("_conv"), F.col("mark").alias("_mark")).agg(F.min(when).alias("_first"))
    joined = equal.join(first, _same(F.col("conv"), F.col("_conv")) & (F.col("mark") == F.col("_mark")))
    again = ~_same(F.col("turn"), F.col("_first.turn"))
    return durable(joined.select("conv", "turn", "role", "text", "times", "fault", again.alias("again")), "turns")


ORDER = ("conv", "turn", "role", "text")
# what a task gives: results (without a task number) or segments (without a result)
PART = f"conv long, gaps long, cost long, audit string, sha string, task long, seq long, {SPAN}, roles array<string>, texts array<string>, times array<long>"
_PART = pa.schema(
    [
        ("conv", pa.int64()), ("gaps", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string()),
        ("task", pa.int64()), ("seq", pa.int64()), *_SPAN,
        ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("times", pa.list_(pa.int64())),
    ]
)


def _table(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _solver(size: int):
    """Conversations that a task holds as a whole are finished; of others come segments.

    The first and the last conversation of a task may go on in another one, so they
    always leave as segments, as do those of more than ``size`` rows.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver, task, seq = Solver(), TaskContext.get().partitionId(), 0
        out: list[dict] = []
        open_: list[Line] = []
        held, conv, alone, first = 0, None, True, True

        def segment() -> dict:
            nonlocal seq
            seq += 1
            span = replace(measured(open_), edits=solver.between(open_))
            rows = {"roles": [x.role for x in open_], "texts": [x.text for x in open_], "times": [x.times for x in open_]}
            return _row_of(span) | rows | {"conv": conv, "task": task, "seq": seq}

        def whole() -> dict:
            span, (cost, audit) = measured(open_), solver.whole(open_)
            sha = hashlib.sha256("\n".join(repaired(open_, audit)).encode()).hexdigest()
            return {k: getattr(span, k) for k in FIELDS} | {"conv": conv, "gaps": span.gaps(), "cost": cost, "audit": audit, "sha": sha}

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("conv", "turn", "role", "text", "times", "fault", "again")]
            for id_, turn, role, text, times, fault, again in zip(*columns, strict=True):
                if open_ and id_ != conv:
                    out.append(whole() if alone and not first else segment())
                    open_, held, alone, first = [], 0, True, False
                conv = id_
                while times:  # a row repeated very often fills segments of its own
                    n = min(times, size)
                    if held + n > size and open_:
                        out.append(segment())
                        open_, held, alone = [], 0, False
                    open_.append(Line(turn, role, text, n, fault, again))
                    held, times, again = held + n, times - n, True
            if out:
                yield _table(_PART, out)
                out = []
        if open_:
            yield _table(_PART, [segment()])

    return solve


def _combine(spans: Iterator[Span]) -> Span | None:
    out = None
    for span in spans:
        out = span if out is None else out.then(span)
    return out


_LEVEL = pa.schema([("conv", pa.int64()), ("at", pa.int64()), *_SPAN])


def _leveller(fan: int):
    def level(table: pa.Table) -> pa.Table:
        """Neighbouring segments as one; no more than ``fan`` rows."""
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        span = _combine(_span_of(r) for r in rows)
        return pa.Table.from_batches([_table(_LEVEL, [_row_of(span) | {"conv": rows[0]["conv"], "at": rows[0]["at"] // fan}])])

    return level


_SHARE = pa.schema([("conv", pa.int64()), ("at", pa.int64()), ("share", pa.string()), ("state", pa.int32())])


def _shares(table: pa.Table) -> pa.Table:
    """Deals the letters of a conversation out to its segments, with the state each begins in."""
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    audit = rows[0]["audit"]
    # what stands is an optional system turn and pairs, so an odd number tells that there is one
    system = sum(c != "D" for c in audit) % 2
    begin, standing, out = 0, 0, []
    for k, r in enumerate(rows):
        end, left = begin, r["rows"]
        while left:
            left -= audit[end] != "I"
            end += 1
        end = len(audit) if k == len(rows) - 1 else end
        pairs = standing - system
        state = SYSTEM if standing and not pairs else START if not standing else USER if pairs % 2 else ASSISTANT
        out.append({"conv": r["conv"], "at": r["at"], "share": audit[begin:end], "state": state})
        standing += end - begin - audit.count("D", begin, end)
        begin = end
    return pa.Table.from_batches([_table(_SHARE, out)])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns of each segment as one text; null where none stands."""
    schema = pa.schema([("conv", pa.int64()), ("at", pa.int64()), ("part", pa.string())])
    for batch in batches:
        parts = []
        for r in batch.to_pylist():
            rows = [Line(None, role, text, n, None, False) for role, text, n in zip(r["roles"], r["texts"], r["times"], strict=True)]
            some = list(repaired(rows, r["share"], r["state"]))
            parts.append("\n".join(some) if some else None)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("at"), pa.array(parts, pa.string())], schema=schema)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's parts, which come sorted; only the running state is held."""
    schema = pa.schema([("conv", pa.int64()), ("sha", pa.string())])
    conv, state, any_part = object(), None, False
    for batch in batches:
        out = []
        for id_, part in zip(batch.column("conv").to_pylist(), batch.column("part").to_pylist(), strict=True):
            if id_ != conv or state is None:
                if state is not None:
                    out.append((conv, state.hexdigest()))
                conv, state, any_part = id_, hashlib.sha256(), False
            if part is not None:
                state.update((b"\n" if any_part else b"") + part.encode())
                any_part = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()])], schema=schema)


def _long(parts: DataFrame, fan: int) -> DataFrame:
    """Results of conversations that came as segments."""
    # a window holds (task, seq) of a conversation's segments; texts and letters stay behind
    at = F.row_number().over(Window.partitionBy("conv").orderBy("task", "seq")) - 1
    places = durable(parts.select("conv", "task", "seq", "rows", at.cast("long").alias("at")), "segment-order")
    placed = parts.join(places.select("task", "seq", "at"), ["task", "seq"])
    spans = durable(placed.select("conv", "at", *[k for k, _ in _SPAN]), "segment-level")
    while not spans.where("at > 0").isEmpty():
        group = F.floor(F.col("at") / fan).alias("_group")
        spans = durable(spans.groupBy("conv", group).applyInArrow(_leveller(fan), f"conv long, at long, {SPAN}"), "segment-level")
    results = durable(spans.mapInArrow(_accepted, RESULT), "long-conversations")
    audits = results.select(F.col("conv").alias("_conv"), "audit")
    share = places.join(audits, _same(F.col("conv"), F.col("_conv")))
    share = share.select("conv", "at", "rows", F.when(F.col("at") == 0, F.col("audit")).alias("audit"))
    share = share.groupBy("conv").applyInArrow(_shares, "conv long, at long, share string, state int")
    share = share.select(F.col("conv").alias("_conv"), F.col("at").alias("_at"), "share", "state")
    here = _same(F.col("conv"), F.col("_conv")) & (F.col("at") == F.col("_at"))
    texts = placed.select("conv", "at", "roles", "texts", "times").join(share, here).drop("_conv", "_at")
    texts = texts.mapInArrow(_texts, "conv long, at long, part string")
    hashed = texts.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(_hashes, "conv long, sha string")
    hashed = hashed.select(F.col("conv").alias("_conv"), F.col("sha").alias("_sha"))
    return results.join(hashed, _same(F.col("conv"), F.col("_conv"))).withColumn("sha", F.col("_sha")).drop("_conv", "_sha")


def _accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            span = _span_of(r)
            cost, audit = better([e for e in (span.edits[q] for q in ACCEPTED) if e])
            rows.append({k: r[k] for k in ("conv", *FIELDS)} | {"gaps": span.gaps(), "cost": cost, "audit": audit})
        yield _table(_RESULT, rows)


def repair(rows: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha) for every conversation of (conv, turn, role, text, copies).

    Rows go by turn, nulls first, then by role and text, equal rows next to each other.
    A null conversation id is a conversation of its own; role and text must not be null.
    ``audit`` holds the letters of the edits (K, R, D, I) and ``sha`` the SHA-256 of the
    repaired ``role:text`` lines. One conversation's letters are one value, and its hash
    runs over its text in order; both come from segments, so no task holds its rows.
    """
    laid = lines(rows).repartitionByRange(*[F.col(c).asc_nulls_first() for c in ORDER])
    laid = laid.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ORDER])
    solved = durable(laid.mapInArrow(_solver(segment), PART), "repaired")
    result = [f.name for f in _RESULT]
    short = solved.where("task IS NULL").select(*result)
    return short.unionByName(_long(solved.where("task IS NOT NULL"), fan).select(*result))


def repair_damaged(conversations: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """One row for every ``conv_id`` of the given rows: the repair of its damaged conversation.

    Conversations without rows after the damage have zeros, an empty audit and the hash
    of the empty text. Null ids are one conversation; an empty table gives an empty
    result; other columns are ignored.
    """
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repair(damage(conversations), segment, fan)
    joined = ids.join(found, _same(F.col("conv_id"), F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(empty)).alias("repaired_sha256"))
