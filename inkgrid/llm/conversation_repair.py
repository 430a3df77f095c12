"""Structure repair of conversations by weighted interval parsing.

A conversation is in order if its roles read ``(s?(ua)+)?`` (system, user, assistant). Each row may
be kept, given another role, or deleted, and empty turns may be inserted anywhere, each at a cost.
The repair grammar is in Chomsky normal form over spans of rows: for the four states of the
language, nonterminal ``[p, q]`` derives the edited spans that lead from p to q, by rules
``[p, q] -> [p, r] [r, q]``; a leaf is the edits of one row, closed under insertion. A cell holds for
each nonterminal the cheapest cost and, among the cheapest edit lists (``audit``, one initial an
edit), the one least in ASCII. Cells are combined bottom-up by span length.

In this grammar every split of a span gives the same cell, so the chart keeps one: spans double from level
to level, and n rows take n - 1 combinations. (Two edit lists of one span, nonterminal and cost are never
one the beginning of the other, as what is left over would be insertions, which cost: so the
least of a concatenation is the concatenation of the least.) The same fact lets one conversation
lie in many tasks: rows are dealt out by ranges of (conversation, turn), each task parses its own
stretches, and what travels to the conversation is a cell a stretch, never its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.shared import materialise, n_partitions

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant; and where each role leads from each.
STATES, ENDS = range(4), (0, 3)
LEADS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
LEGAL = {"su", "ua", "au"}
#: Rows and characters of a stretch.
ROWS, CHARS = 2048, 1 << 21

Cell = tuple[tuple[tuple[int, str] | None, ...], ...]


def least(*found: tuple[int, str] | None) -> tuple[int, str] | None:
    return min((x for x in found if x is not None), default=None)


def combined(a: Cell, b: Cell) -> Cell:
    """The cell of two spans side by side: ``[p, q] -> [p, r] [r, q]``."""
    out = []
    for row in a:
        begun = [(r, c, audit) for r, x in enumerate(row) if x is not None for c, audit in (x,)]
        out.append(tuple(least(*[(c + b[r][q][0], audit + b[r][q][1]) for r, c, audit in begun if b[r][q] is not None]) for q in STATES))
    return tuple(out)


@cache
def inserted() -> Cell:
    """The cell of no row: closure of the empty edit list under insertion."""
    cell: Cell = tuple(tuple((0, "") if p == q else None for q in STATES) for p in STATES)
    step = tuple(tuple((INSERT, "I") if any(LEADS[x].get(p) == q for x in "ua") else None for q in STATES) for p in STATES)
    for _ in STATES:
        longer = combined(cell, step)
        cell = tuple(tuple(least(cell[p][q], longer[p][q]) for q in STATES) for p in STATES)
    return cell


@cache
def leaf(initial: str, truncated: bool, doomed: bool) -> Cell:
    """The edits of one row and insertions after it; a doomed row (blank or duplicate) can only be deleted."""
    own: list[list] = [[(DELETE, "D") if p == q else None for q in STATES] for p in STATES]
    extra = TRUNCATED * truncated
    for role in () if doomed else ("s", "u", "a"):
        for p, q in LEADS[role].items():
            kept = (KEEP + extra, "K") if role == initial else None
            own[p][q] = least(own[p][q], kept, (REROLE + extra, "R") if role != "s" else None)
    return combined(tuple(map(tuple, own)), inserted())


def parsed(cells: list[Cell]) -> Cell:
    """The cell of all spans in order, by levels of doubling length."""
    while len(cells) > 1:
        cells = [combined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def chosen(cells: list[Cell]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of the cheapest legal repair of stretches in order, and for each the state it begins in and its audit.

    Insertions before the first row belong to the first stretch.
    """
    first = combined(inserted(), cells[0])
    reached = [{q: (x, None) for q, x in enumerate(first[0]) if x is not None}]
    for cell in cells[1:]:
        now: dict[int, tuple] = {}
        for q in STATES:
            ways = [((c + cell[p][q][0], audit + cell[p][q][1]), p) for p, ((c, audit), _) in reached[-1].items() if cell[p][q] is not None]
            if ways:
                now[q] = min(ways)
        reached.append(now)
    (cost, audit), end = min((reached[-1][q][0], q) for q in ENDS if q in reached[-1])
    pieces: list[tuple[int, str]] = []
    for i in range(len(cells) - 1, -1, -1):
        before = reached[i][end][1]
        part = first[0][end] if i == 0 else cells[i][before][end]
        pieces.append((before or 0, part[1]))
        end = before
    return cost, pieces[::-1]


def rewritten(state: int, audit: str, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """Role and text of the rows that an audit leaves, beginning in ``state``."""
    rows, out = iter(zip(roles, texts, strict=True)), []
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        state = LEADS[role[0]][state]
        out.append((role, text))
    return out


STRETCHES = (
    "conv_id {0}, stretch long, costs array<int>, audits array<string>, roles array<string>, texts array<string>, blank long, duplicate long, truncated long,"
    " illegal long, first_role string, last_role string, first_turn long, last_turn long, n_turns long"
)


def _stretches(turns: DataFrame) -> DataFrame:
    """Written table of stretches: rows of one conversation in order, with their cell and counts.

    Rows of one conversation, turn, role and text are equal: they stand side by side as one row with a
    number, so no key is hot; the first row of a role and text is found by a minimum, which combines before its shuffle.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t")).agg(F.min(at).alias("first"))
    rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")))
    order = ["conv_id", "turn", "role", "text"]
    space = r"[\x20\x09-\x0D]"
    dealt = rows.select(
        *order,
        "copies",
        (at > F.col("first")).alias("seen"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?]{space}*\z")).alias("cut"),
    )
    dealt = dealt.repartitionByRange(n_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, schema = TaskContext.get().partitionId() << 33, None

        def closed(conv: pa.Scalar, rows: list[tuple]) -> pa.RecordBatch:
            # Of a row: turn, role, text, blank, duplicate, truncated.
            cell = parsed([leaf(r[1][:1], r[5], r[3] or r[4]) for r in rows])
            flat = [x for line in cell for x in line]
            seen = [r[0] for r in rows if r[0] is not None]
            row = {
                "conv_id": conv, "stretch": number, "costs": [x and x[0] for x in flat], "audits": [x and x[1] for x in flat], "roles": [r[1] for r in rows], "texts": [r[2] for r in rows],
                "blank": sum(r[3] for r in rows), "duplicate": sum(r[4] for r in rows), "truncated": sum(r[5] for r in rows), "illegal": sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows[:-1], rows[1:], strict=True)),
                "first_role": rows[0][1][:1], "last_role": rows[-1][1][:1], "first_turn": seen[0] if seen else None, "last_turn": seen[-1] if seen else None, "n_turns": len(set(seen)),
            }
            return pa.RecordBatch.from_pylist([row], schema)

        conv, held, size = None, [], 0
        for batch in batches:
            if schema is None:
                lists = {"costs": pa.list_(pa.int32()), "audits": pa.list_(pa.string()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "first_role": pa.string(), "last_role": pa.string()}
                names = [c.split()[0] for c in STRETCHES.format("x").replace(",", ", ").split(", ")]
                schema = pa.schema([(n, batch.schema.field(0).type if n == "conv_id" else lists.get(n, pa.int64())) for n in names])
            ids, columns = batch.column(0).to_pylist(), [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
            for own, turn, role, text, copies, seen, blank, cut in zip(ids, *columns, strict=True):
                for k in range(copies):
                    if held and (own != conv or len(held) >= ROWS or size >= CHARS):
                        yield closed(conv, held)
                        number, held, size = number + 1, [], 0
                    twice = not blank and (seen or k > 0)
                    conv, size = own, size + len(text)
                    held.append((turn, role, text, blank, twice, cut and not blank and not twice))
        if held:
            yield closed(conv, held)

    return materialise(dealt.mapInArrow(run, STRETCHES.format(kind)), "stretches")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows with one conv_id after the other, of a task's sorted rows."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["conv_id"] != held[0]["conv_id"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
FOLDED = "conv_id {0}, stretch long, state int, piece string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"


def _folded(stretches: DataFrame) -> DataFrame:
    """Of each stretch the state it begins in and its audit; with a conversation's first stretch its counts, cost and whole audit."""
    kind = stretches.schema["conv_id"].dataType.simpleString()
    narrow = stretches.drop("roles", "texts").repartition(n_partitions(stretches.sparkSession), "conv_id").sortWithinPartitions("conv_id", "stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            cells = []
            for r in rows:
                flat = [None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)]
                cells.append(tuple(tuple(flat[4 * p : 4 * p + 4]) for p in STATES))
            cost, pieces = chosen(cells)
            pairs = list(zip(rows[:-1], rows[1:], strict=True))
            turns = [t for r in rows for t in (r["first_turn"], r["last_turn"]) if t is not None]
            distinct = sum(r["n_turns"] for r in rows) - sum(a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in pairs)
            whole = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
            whole["illegal"] += sum(a["last_role"] + b["first_role"] not in LEGAL for a, b in pairs)
            whole |= {"gaps": turns[-1] - turns[0] + 1 - distinct if turns else 0, "cost": cost, "audit": "".join(a for _, a in pieces)}
            out = [{"conv_id": r["conv_id"], "stretch": r["stretch"], "state": p, "piece": a} | (whole if i == 0 else {}) for i, (r, (p, a)) in enumerate(zip(rows, pieces, strict=True))]
            kinds = {"stretch": pa.int64(), "state": pa.int32(), "piece": pa.string(), **dict.fromkeys(COUNTS, pa.int64()), "audit": pa.string()}
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", ids[0]), *kinds.items()]))

    ids: list[pa.DataType] = []

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids[:] = [batch.schema.field("conv_id").type]
                yield batch

        yield from run(told())

    return narrow.mapInArrow(typed, FOLDED.format(kind))


class Repaired(NamedTuple):
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: every conversation that has rows.
    summary: DataFrame
    #: conv_id, stretch, turns (role, text): stretches in order make the repaired conversation.
    turns: DataFrame


def repair(turns: DataFrame) -> Repaired:
    """Repair conversations of columns conv_id, turn, role, text and, if there is one, copies (of a row, side by side).

    Rows go by turn, nulls first, then role and text. Null roles and texts count as one space. Of each
    row the first fault counts: blank (no text but white space), duplicate (role and text seen earlier), truncated (the text's last
    character is not ``.``, ``!`` or ``?``). A null conv_id is a conversation of its own; other columns
    are not read; an empty table gives empty tables. The audit of a conversation, one
    character an edit, and its 16 partial ones stand in one task, its rows never do.
    """
    copies = F.col("copies").cast("long") if "copies" in turns.columns else F.lit(1).cast("long")
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    stretches = _stretches(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *text, copies.alias("copies")))
    folded = materialise(_folded(stretches), "folded")
    rewrite = stretches.select("stretch", "roles", "texts").join(folded.select("conv_id", "stretch", "state", "piece"), "stretch")
    kind = stretches.schema["conv_id"].dataType.simpleString()
    row = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("state", "piece", "roles", "texts")]
            out = [[{"role": r, "text": t} for r, t in rewritten(*x)] for x in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("stretch"), pa.array(out, row)], ["conv_id", "stretch", "turns"])

    told = rewrite.mapInArrow(run, f"conv_id {kind}, stretch long, turns array<struct<role: string, text: string>>")
    return Repaired(folded.where("cost is not null").select("conv_id", *COUNTS, "audit"), told)


def damaged(conversations: DataFrame) -> DataFrame:
    """Every twentieth row dropped, emptied, without its ends of sentences, repeated, or given to the user, by the checksum of ``conv_id:turn``."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(key) % 20
    rows = conversations.select("conv_id", "turn", kind.alias("kind"), role.alias("role"), text.alias("text")).where("kind <> 0")
    k = F.col("kind")
    return rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), F.when(k == 3, 2).otherwise(1).alias("copies"))


def digests(repaired: DataFrame) -> DataFrame:
    """Per conversation the SHA-256 of its repaired ``role:text`` lines; stretches stream through a task in order, one at a time."""
    import hashlib

    kind = repaired.schema["conv_id"].dataType.simpleString()
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    pieces = repaired.where(F.size("turns") > 0).select("conv_id", "stretch", line.alias("lines"))
    pieces = pieces.repartition(n_partitions(repaired.sparkSession), "conv_id").sortWithinPartitions("conv_id", "stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv, known = None, None, None
        ids: list = []
        out: list[str] = []
        for batch in batches:
            known = batch.schema.field("conv_id").type
            for own, text in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                if state is None or own != conv:
                    if state is not None:
                        ids.append(conv)
                        out.append(state.hexdigest())
                    state, conv = hashlib.sha256(text.encode()), own
                else:
                    state.update(("\n" + text).encode())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, known), pa.array(out)], ["conv_id", "repaired_sha256"])
                ids, out = [], []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], known), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    return pieces.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")
