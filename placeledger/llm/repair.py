"""Conversation structure repair by branch and bound.

A conversation is repaired when the initials of its roles read ``(s?(ua)+)?``: nothing, or an optional system row and then
user and assistant in turn. Rows are kept, get another role, or are deleted, and empty rows are inserted; the cheapest edits
win, and of equally cheap ones those whose initials (D, I, K, R) are least in ASCII order.

The search (:func:`search`) walks depth first over an explicit stack of prefixes. A prefix dies when its cost and the lower
bound of the rest exceed the incumbent (cost, audit), or when the table of its node, that is row and state, holds a better one;
when the stack is empty the incumbent is proved best. Rows are cut into segments of at most :data:`SEGMENT` rows; a segment that
isn't a whole conversation is searched from each state to each, and the results are joined by state, which is associative. So a
conversation of any length is spread over tasks, and no task holds more of it than the letters of its edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeledger.session import cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows that are searched at once.
SEGMENT = 256
#: States: nothing yet, after the system row, after a user, after an assistant. The end must be in one of FINAL.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The states that letters other than s lead to.
TO = [[(c, t) for (f, c), t in STEP.items() if f == q and c != "s"] for q in range(4)]
#: Pairs of states that some rows can connect.
PAIRS = [(p, q) for p in range(4) for q in range(4) if q == p or q >= USER or (p, q) == (START, SYSTEM)]
GOOD_PAIRS = ("su", "ua", "au")
#: Code of a row: role initial (s, u, a, or another) + 4 * (1 must be deleted, 2 truncated).
LETTERS = "sua?"
MUST_GO, CUT_OFF = 4, 8

Best = tuple[int, str]


def bounds(codes: bytes, exits: tuple[int, ...]) -> list[list[int]]:
    """For each row and state, a lower bound of the cost from there to one of ``exits``.

    Rows alone: 3 for one that must go, 1 for a truncated one, 2 for a role that fits nowhere. Two neighbours among the rest
    (or a state and its next row, or the last row and the end) that may not follow each other cost 2 more, by another role,
    a deletion, or a row between; each row counts in one such pair at most, so as many pairs are matched as can be, from the right.
    """
    n = len(codes)
    out = [[0] * 4 for _ in range(n + 1)]
    alone, pairs, systems = 0, 0, False
    # What the next row is: "u" or "a", "?" for one that pays anyway, "." for the end. ``free``: it is in no pair yet.
    first, free = ".", True
    for i in range(n, -1, -1):
        if i < n:
            letter, kind = LETTERS[codes[i] & 3], codes[i] & 12
            if kind == MUST_GO:
                alone += DELETE
            else:
                alone += TRUNCATED * (kind == CUT_OFF)
                if letter in "ua":
                    bad = free and (first == letter or (first == "." and (USER if letter == "u" else ASSISTANT) not in exits))
                    pairs += bad
                    first, free = letter, not bad
                else:
                    alone += REROLE
                    systems |= letter == "s"
                    first, free = "?", False
        rest = alone + 2 * pairs
        for q in range(4):
            bad = first == "." and q not in exits or first in "ua" and (q, first) not in STEP
            out[i][q] = max(0, rest + 2 * (free and bad) - REROLE * (q == START and systems))
    return out


def search(codes: bytes, entry: int = START, exits: tuple[int, ...] = FINAL) -> Best | None:
    """The least (cost, audit) that leads the rows from ``entry`` to one of ``exits``; None if nothing does."""
    n, bound = len(codes), bounds(codes, exits)
    best: Best | None = None
    tables: list[dict[int, Best]] = [{} for _ in range(n + 1)]
    stack: list[tuple[int, int, int, str]] = [(0, entry, 0, "")]
    while stack:
        i, q, cost, audit = stack.pop()
        # The audit begins those of all that follow, so none of them is less than it.
        if best is not None and (cost + bound[i][q], audit) >= best:
            continue
        node = tables[i].get(q)
        if node is not None and node <= (cost, audit):
            continue
        tables[i][q] = (cost, audit)
        if i == n and q in exits:
            best = (cost, audit)
        # A second round of inserts comes back to a state of this row, whose table ends it.
        children = [(i, t, cost + INSERT, audit + "I") for _, t in TO[q]]
        if i < n:
            letter, kind = LETTERS[codes[i] & 3], codes[i] & 12
            children.append((i + 1, q, cost + DELETE, audit + "D"))
            if kind != MUST_GO:
                late = TRUNCATED * (kind == CUT_OFF)
                if (q, letter) in STEP:
                    children.append((i + 1, STEP[q, letter], cost + KEEP + late, audit + "K"))
                children += [(i + 1, t, cost + REROLE + late, audit + "R") for _, t in TO[q]]
        # The most promising child is taken first: least bound, then least audit.
        children.sort(key=lambda c: (c[2] + bound[c[0]][c[1]], c[3]), reverse=True)
        stack += children
    return best


Table = dict[tuple[int, int], Best]


def joined(left: Table, right: Table) -> Table:
    """The best way through two neighbouring stretches for each pair of outer states."""
    out: Table = {}
    for (p, q), (c1, a1) in left.items():
        for (q2, r), (c2, a2) in right.items():
            if q == q2:
                way = (c1 + c2, a1 + a2)
                if (p, r) not in out or way < out[p, r]:
                    out[p, r] = way
    return out


def all_joined(tables: list[Table]) -> Table:
    """Neighbours are joined in rounds, so that letters are copied as often as the logarithm of the number of tables."""
    while len(tables) > 1:
        tables = [joined(*tables[k : k + 2]) if k + 1 < len(tables) else tables[k] for k in range(0, len(tables), 2)]
    return tables[0]


def through(codes: bytes) -> Table:
    """The best way through a stretch for each pair of states."""
    return all_joined([
        {(p, q): best for p, q in PAIRS if (best := search(codes[k : k + SEGMENT], p, (q,))) is not None}
        for k in range(0, len(codes), SEGMENT)
    ])


def repair_codes(codes: bytes) -> Best:
    """The repair of a whole conversation. All rows can go, so there always is one."""
    if len(codes) <= SEGMENT:
        return search(codes)
    return min(best for (p, q), best in through(codes).items() if p == START and q in FINAL)


# --- jobs ----------------------------------------------------------------------------------------------------

_SPACES = " \t\n\x0b\x0c\r"


def in_order(turns: DataFrame) -> DataFrame:
    """(row_id, conv_id, turn, role, text) in the order of the conversations, written; ``row_id`` rises by one within a part.

    Rows of a conversation go by turn, nulls first; equal turns by role and text. A null role or text is one space. The order
    is dealt out by ranges, so a conversation of many rows lies in many parts.
    """
    blank = F.lit(" ")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    )
    key = ["conv_id", "turn", "role", "text"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges go by the beginning of the text, which keeps its order: what the driver samples stays short.
    dealt = rows.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, 32))
    return cut(dealt.sortWithinPartitions(*key).withColumn("row_id", F.monotonically_increasing_id()))


def row_codes(ordered: DataFrame) -> DataFrame:
    """(row_id, conv_id, turn, initial, fault, code) of each row, in order; without the texts.

    ``fault`` is the first that holds: 1 blank, 2 duplicate (role and text seen earlier in the conversation), 3 truncated
    (the last character that isn't white space is none of ``.!?``), else 0.
    """
    bare = F.rtrim("text", F.lit(_SPACES))
    solid, ended = F.length(bare) > 0, F.right(bare, F.lit(1)).isin(".", "!", "?")
    narrow = ordered.select(
        "row_id", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), solid.alias("solid"), ended.alias("ended"),
        F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")).alias("same"),
    )
    # One row for each different text comes out of each task; the join is by row_id, so a text that fills a conversation is no hot key.
    firsts = narrow.filter("solid").groupBy("conv_id", "same").agg(F.min("row_id").alias("row_id")).select("row_id", F.lit(True).alias("first"))
    marked = narrow.drop("same").join(firsts, "row_id", "left")
    fault = F.when(~F.col("solid"), 1).when(F.col("first").isNull(), 2).when(~F.col("ended"), 3).otherwise(0)
    coded = marked.select("row_id", "conv_id", "turn", "initial", fault.alias("fault"))
    letter = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    kind = F.when(F.col("fault").isin(1, 2), MUST_GO).when(F.col("fault") == 3, CUT_OFF).otherwise(0)
    n = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return coded.withColumn("code", (letter + kind).cast("int")).repartitionByRange(n, "row_id").sortWithinPartitions("row_id")


STRETCH = (
    "conv_id long, row_id long, whole boolean, n long, least long, most long, first_turn long, last_turn long, turns long, blank long, duplicate long, "
    "truncated long, illegal long, first string, last string, entries array<int>, exits array<int>, costs array<long>, audits array<string>"
)


class _Stretch:
    """Neighbouring rows of one conversation within a task."""

    def __init__(self, conv, row_id, whole):
        #: Nothing of the conversation is before this; and, set at the end, nothing after it.
        self.whole = whole
        self.conv, self.row_id, self.codes = conv, row_id, bytearray()
        self.least = self.most = self.first_turn = self.last_turn = None
        self.turns, self.faults, self.illegal = 0, [0] * 4, 0
        self.first = self.last = None

    def add(self, turn, initial, fault, code):
        if self.codes:
            self.illegal += self.last + initial not in GOOD_PAIRS
            self.turns += turn is not None and turn != self.last_turn
        else:
            self.first, self.first_turn = initial, turn
            self.turns = int(turn is not None)
        if turn is not None:  # rows come by turn
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.last, self.last_turn = initial, turn
        self.faults[fault] += 1
        self.codes.append(code)

    def row(self) -> dict:
        if self.whole:
            best = repair_codes(bytes(self.codes))
            ways = {(START, ASSISTANT if best[1].strip("D") else START): best}
        else:
            ways = through(bytes(self.codes))
        keys = sorted(ways)
        return dict(
            conv_id=self.conv, row_id=self.row_id, whole=self.whole, n=len(self.codes), least=self.least, most=self.most, first_turn=self.first_turn,
            last_turn=self.last_turn, turns=self.turns, blank=self.faults[1], duplicate=self.faults[2], truncated=self.faults[3],
            illegal=self.illegal, first=self.first, last=self.last, entries=[p for p, _ in keys], exits=[q for _, q in keys],
            costs=[ways[k][0] for k in keys], audits=[ways[k][1] for k in keys],
        )


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32()),
             "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def stretches(coded: DataFrame) -> DataFrame:
    """A row for each conversation and task (or gap of row ids): its counts, and the best way through for each pair of states.

    Only the first and the last conversation of a task can have rows in other tasks; the others are repaired as a whole.
    """
    schema = _arrow(STRETCH)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, out, size = None, None, [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("row_id", "conv_id", "turn", "initial", "fault", "code")]
            for row_id, conv, turn, initial, fault, code in zip(*columns, strict=True):
                if now is None or conv != now.conv or row_id != before + 1:
                    other = now is not None and conv != now.conv
                    if now is not None:
                        now.whole &= other
                        out.append(now.row())
                        size += len(now.codes)
                    if size > 1 << 14:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
                    now = _Stretch(conv, row_id, other)
                now.add(turn, initial, fault, code)
                before = row_id
        if now is not None:
            now.whole = False  # the next task may go on with it
            yield pa.RecordBatch.from_pylist([*out, now.row()], schema=schema)

    return coded.mapInArrow(walk, STRETCH)


PLAN = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "row_ids array<long>, places array<long>, audits array<string>"
)


def plans(found: DataFrame) -> DataFrame:
    """One row per conversation with rows: its counts, cost and audit, and the audit again by stretch.

    ``found`` (read twice) are all stretches. A stretch k has its first row in ``row_ids``, the number of repaired rows before it in
    ``places``, and its edits in ``audits``. Only conversations that reach over a task's end are put together, at most two for each
    task; what one group holds is a row for each part that the conversation lies in, with a letter for each edit and pair of states.
    """
    schema = _arrow(PLAN)

    def combine(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["row_id"])
        ways = all_joined([
            {(p, q): (c, a) for p, q, c, a in zip(r["entries"], r["exits"], r["costs"], r["audits"], strict=True)} for r in rows
        ])
        cost, audit = min(ways[k] for k in ways if k[0] == START and k[1] in FINAL)
        inner = list(zip(rows, rows[1:], strict=False))
        illegal = sum(r["illegal"] for r in rows) + sum(a["last"] + b["first"] not in GOOD_PAIRS for a, b in inner)
        turns = sum(r["turns"] for r in rows) - sum(b["first_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in inner)
        known = [r for r in rows if r["least"] is not None]
        # Inserted rows at a border go with the stretch that follows, those at the end with the last one.
        letters = np.frombuffer(audit.encode(), np.uint8)
        used = np.flatnonzero(letters != ord("I"))
        ends = np.cumsum([r["n"] for r in rows])
        edges = [0, *(used[ends[:-1] - 1] + 1).tolist(), len(letters)]
        places = np.concatenate([[0], np.cumsum(letters != ord("D"))])[edges[:-1]]
        return pa.Table.from_pylist([dict(
            conv_id=rows[0]["conv_id"], gaps=known[-1]["most"] - known[0]["least"] + 1 - turns if known else 0,
            blank=sum(r["blank"] for r in rows), duplicate=sum(r["duplicate"] for r in rows), truncated=sum(r["truncated"] for r in rows),
            illegal=illegal, cost=cost, audit=audit, row_ids=[r["row_id"] for r in rows], places=places.tolist(),
            audits=[audit[a:b] for a, b in zip(edges, edges[1:], strict=False)],
        )], schema=schema)

    audit = F.col("audits")[0]
    alone = found.filter("whole").select(
        "conv_id", F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate",
        "truncated", "illegal", F.col("costs")[0].alias("cost"), audit.alias("audit"), F.array("row_id").alias("row_ids"),
        F.array(F.lit(0).cast("long")).alias("places"), F.array(audit).alias("audits"),
    )
    return alone.unionByName(found.filter("not whole").groupBy("conv_id").applyInArrow(combine, PLAN))


EDITS = "conv_id long, place long, row_id long, edit string, new_role string"


def edits(planned: DataFrame) -> DataFrame:
    """(conv_id, place, row_id, edit, new_role) of every repaired row: ``row_id`` is null for an inserted one.

    The initials read s?(ua)+, so a row's place says its role; there is a system row if the number of rows is odd.
    """
    whole = F.length(F.replace("audit", F.lit("D"), F.lit("")))
    rows = planned.select("conv_id", (whole % 2 == 1).alias("odd"), F.explode(F.arrays_zip("row_ids", "places", "audits")).alias("p"))
    schema = _arrow(EDITS)

    def spell(batches):
        for batch in batches:
            for conv, odd, p in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "odd", "p")), strict=True):
                letters = np.frombuffer(p["audits"].encode(), np.uint8)
                taken, given = letters != ord("I"), letters != ord("D")
                row = p["row_ids"] + np.cumsum(taken) - 1
                place = p["places"] + np.cumsum(given) - 1
                user = (place - odd) % 2 == 0
                made = letters[given]
                role = np.where(made == ord("K"), None, np.where(user[given], "user", "assistant"))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(made), conv or 0), pa.int64(), mask=np.full(len(made), conv is None)),
                    pa.array(place[given], pa.int64()), pa.array(row[given], pa.int64(), mask=made == ord("I")),
                    pa.array([chr(c) for c in made.tolist()], pa.string()), pa.array(role.tolist(), pa.string()),
                ], schema=schema)

    return rows.mapInArrow(spell, EDITS)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, repaired rows) of all conversations in ``turns`` (conv_id, turn, role, text).

    Plans have a row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Repaired rows are
    (conv_id, place, edit, role, text), places from 0. A null role or text is one space; rows without a turn come first, rows of one
    turn go by role and text, equal rows all count (the later ones as duplicates); rows without a conv_id are one conversation.
    Other columns are not read. An empty table gives no rows.
    """
    ordered = in_order(turns)
    planned = cut(plans(cut(stretches(row_codes(ordered)))))
    made = edits(planned).join(ordered.select("row_id", "role", "text"), "row_id", "left")
    rows = made.select(
        "conv_id", "place", "edit", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return planned.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), rows


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the lines ``role:text`` of each conversation, joined by newlines.

    A digest has to see its lines in order, so each conversation goes through one task, as a stream: the task holds a batch.
    """
    ordered = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "place")

    def read(batches):
        now, sha, out = None, None, []

        def done():
            got = pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([s for _, s in out], pa.string())], names=["conv_id", "sha256"])
            out.clear()
            return got

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                line = f"{role}:{text}".encode()
                if sha is None or conv != now:
                    if sha is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = conv, hashlib.sha256(line)
                else:
                    sha.update(b"\n" + line)
            if len(out) > 4096:
                yield done()
        if sha is not None:
            out.append((now, sha.hexdigest()))
            yield done()

    return ordered.select("conv_id", "role", "text").mapInArrow(read, "conv_id long, sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` with faults, by crc32 of ``conv_id:turn`` modulo 20 (a null is one space in the key, role and text).

    0 drops the row, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes its role user.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text = F.coalesce(F.col("text").cast("string"), blank)
    case = F.col("case")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("case"),
    ).filter(case != 0)
    out = rows.withColumn("role", F.when(case == 4, "user").otherwise(F.col("role"))).withColumn(
        "text", F.when(case == 1, "").when(case == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    )
    twice: Column = F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("conv_id", "turn", "role", "text", twice.alias("copy")).drop("copy")


def with_all(planned: DataFrame, rows: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each conv_id of ``turns``: its plan and the digest of its repaired rows; zeros where nothing is left."""
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = planned.withColumnRenamed("conv_id", "p_conv").join(
        digests(rows).select(F.col("conv_id").alias("d_conv"), "sha256"), F.col("p_conv").eqNullSafe(F.col("d_conv")), "left"
    )
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = hashlib.sha256(b"").hexdigest()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("p_conv")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"),
    )
