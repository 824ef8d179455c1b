"""Repair of the turn structure of conversations by run-length dynamic programming.

A conversation's rows, in order, are symbols: who speaks (by the role's first
letter: s, u, a or another) and what is wrong with the row.  The least edits
(keep 0, rerole 2, delete 3, insert 2; a kept or reroled truncated row 1 more)
that make the roles read ``(s?(ua)+)?`` are a shortest path over four states:
nothing yet, after s, after u, after a.

Equal neighbouring symbols are collapsed to runs.  A row is a 4 x 4 matrix over
(min, +); a run of n rows advances by the cached binary powers of its matrix.
The choices are unrolled the same way: the edits of a block of 2^k equal rows
hang only on the symbol, the state before it and the costs after it (less their
least), so halves of a block are looked up before they are worked out.  Among
the cheapest edits the ASCII-least string is taken letter by letter.

Distribution.  Rows are light here (a digest for role and text).  They are
range-partitioned by (conversation, turn, digest, salt) and numbered, so a
conversation that holds a third of all rows is many chunks.  A chunk gives its
matrix and its runs; a conversation's chunks (at most one a partition) are
multiplied from the end to the costs after each chunk; each chunk unrolls for
every state before it; the chunks' states are then chained.  A row is a
duplicate unless it has the least number of its digest: an aggregate with map-side
combine, so that no hot text is gathered.  Texts are shuffled once, in
``repair``, where each conversation streams in order through one task: a digest
of a whole conversation can only be taken in order.  That task holds one batch
of rows and the audit string, which is part of the result.

Order: turn (nulls first), then the SHA-256 of role and text.  Faults: blank (no
character but ``\\x20 \\x09-\\x0D``), duplicate (role and text seen earlier in the
conversation), truncated (the last such character is none of ``.!?``).

Edge cases: a null role or text reads as one space, a null turn comes first and
counts for no gap; a null conv_id is a conversation of its own; an empty role is
a role of another kind; ties of turn have the order above; equal rows are
duplicates of the first; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cargolake.llm.common import prepare, stored

SPACES = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
FAR = 1 << 40  # no way
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # the only role that may follow, by insert or rerole
NAMES = {AFTER_U: "user", AFTER_A: "assistant"}
INITIALS = "sua"  # any other role has code 3
FINE, MUST_GO, CUT_OFF = range(3)
LEGAL = {(0, 1), (1, 2), (2, 1)}

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def initial(role: str) -> int:
    return INITIALS.index(role[0]) if role[:1] and role[0] in INITIALS else 3


def kept(state: int, code: int) -> int | None:
    """The state after a kept row, if it may stand here."""
    if code == 0:
        return AFTER_S if state == NOTHING else None
    return NEXT[state] if code == (1 if NEXT[state] == AFTER_U else 2) else None


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(FAR, *(x + y for x, y in zip(row, column))) for column in zip(*b)) for row in a)


def apply(m: Matrix, v: Vector) -> Vector:
    return tuple(min(x + y for x, y in zip(row, v)) for row in m)


ONE: Matrix = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
INSERTS: Matrix = tuple(
    tuple(0 if i == j else INSERT if j == NEXT[i] else 2 * INSERT if j == NEXT[NEXT[i]] else FAR for j in range(4)) for i in range(4))
END: Vector = apply(INSERTS, (0, FAR, FAR, 0))  # cost to finish from each state


@cache
def row_matrix(symbol: int) -> Matrix:
    """Inserts, then the row itself."""
    code, fault = divmod(symbol, 3)
    extra = TRUNCATED if fault == CUT_OFF else 0
    own = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        own[state][state] = DELETE
        if fault != MUST_GO:
            own[state][NEXT[state]] = min(own[state][NEXT[state]], REROLE + extra)
            after = kept(state, code)
            if after is not None:
                own[state][after] = min(own[state][after], KEEP + extra)
    return times(INSERTS, tuple(map(tuple, own)))


@cache
def power(symbol: int, k: int) -> Matrix:
    """The matrix of 2^k equal rows."""
    return row_matrix(symbol) if k == 0 else times(power(symbol, k - 1), power(symbol, k - 1))


def bits(n: int) -> list[int]:
    return [k for k in range(n.bit_length()) if n >> k & 1]


@lru_cache(maxsize=65_536)
def run_matrix(symbol: int, n: int) -> Matrix:
    out = ONE
    for k in bits(n):
        out = times(out, power(symbol, k))
    return out


def level(v: Vector) -> Vector:
    least = min(v)
    return tuple(x - least for x in v)


@lru_cache(maxsize=4096)
def block_edits(symbol: int, k: int, state: int, after: Vector) -> tuple[str, int]:
    """Least edits of 2^k equal rows from ``state`` when ``after`` are the costs that follow; and the state then."""
    if k:
        first, middle = block_edits(symbol, k - 1, state, level(apply(power(symbol, k - 1), after)))
        second, end = block_edits(symbol, k - 1, middle, after)
        return first + second, end
    code, fault = divmod(symbol, 3)
    before, extra, out = apply(row_matrix(symbol), after), TRUNCATED if fault == CUT_OFF else 0, ""
    while True:
        if before[state] == DELETE + after[state]:
            return out + "D", state
        if before[state] == INSERT + before[NEXT[state]]:
            out, state = out + "I", NEXT[state]
            continue
        to = kept(state, code) if fault != MUST_GO else None
        if to is not None and before[state] == KEEP + extra + after[to]:
            return out + "K", to
        return out + "R", NEXT[state]


def chunk_matrix(runs: list[tuple[int, int]]) -> Matrix:
    out = ONE
    for symbol, n in runs:
        out = times(out, run_matrix(symbol, n))
    return out


def chunk_edits(runs: list[tuple[int, int]], after: Vector) -> list[tuple[str, int]]:
    """For each state before the chunk: its edits and the state then."""
    blocks = [(symbol, k) for symbol, n in runs for k in bits(n)]
    costs = [level(after)]
    for symbol, k in reversed(blocks[1:]):
        costs.append(level(apply(power(symbol, k), costs[-1])))
    found = []
    for state in range(4):
        parts = []
        for (symbol, k), then in zip(blocks, reversed(costs)):
            letters, state = block_edits(symbol, k, state, then)
            parts.append(letters)
        found.append(("".join(parts), state))
    return found


TAIL = {NOTHING: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}


# ---- Spark

def _light(rows: DataFrame) -> DataFrame:
    """One small row a row: conversation, turn, digest of role and text, role code, blank, truncated."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    last = F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)
    first = F.substring(role, 1, 1)
    code = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _digest(role, text).alias("digest"),
                       code.alias("code"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut_off"))


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def _numbered(rows: DataFrame) -> DataFrame:
    """Light rows numbered in order (``pos``; the upper bits are the slice), stored."""
    salt = F.xxhash64(F.monotonically_increasing_id())
    spread = _light(rows).withColumn("salt", salt).repartitionByRange("conv_id", "turn", "digest", "salt")
    in_order = spread.sortWithinPartitions("conv_id", "turn", "digest").drop("salt")
    return stored(in_order.withColumn("pos", F.monotonically_increasing_id()), "turns")


CHUNK_FIELDS = [("pos", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                ("illegal", pa.int64()), ("turns", pa.int64()), ("least", pa.int64()), ("most", pa.int64()),
                ("first_code", pa.int32()), ("last_code", pa.int32()),
                ("symbols", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int64())), ("matrix", pa.list_(pa.int64()))]
CHUNK_DDL = ("pos long, blank long, duplicate long, truncated long, illegal long, turns long, least long, most long, "
             "first_code int, last_code int, symbols array<int>, lengths array<long>, matrix array<long>")


class _Chunk:
    """Counts and runs of consecutive rows of one conversation in one slice."""

    def __init__(self, pos: int, code: int):
        self.pos, self.first, self.last, self.faults = pos, code, None, [0, 0, 0]
        self.illegal = self.turns = 0
        self.least = self.most = None
        self.symbols, self.lengths = [], []

    def add(self, turn: int | None, code: int, blank: bool, cut_off: bool, is_first: bool) -> None:
        fault = 0 if blank else 1 if not is_first else 2 if cut_off else None
        if fault is not None:
            self.faults[fault] += 1
        self.illegal += self.last is not None and (self.last, code) not in LEGAL
        self.last = code
        if turn is not None and turn != self.most:
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        symbol = code * 3 + (FINE if fault is None else CUT_OFF if fault == 2 else MUST_GO)
        if self.symbols and self.symbols[-1] == symbol:
            self.lengths[-1] += 1
        else:
            self.symbols.append(symbol)
            self.lengths.append(1)

    def row(self) -> tuple:
        flat = [x for line in chunk_matrix(list(zip(self.symbols, self.lengths))) for x in line]
        return (self.pos, *self.faults, self.illegal, self.turns, self.least, self.most, self.first, self.last,
                self.symbols, self.lengths, flat)


def _batch(key_type: pa.DataType, fields: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [key_type, *(kind for _, kind in fields)]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                      names=["conv_id", *(name for name, _ in fields)])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (pos, mark), each preceded by a mark if it is the first of its digest."""
    chunk, place, first_at, key_type = None, None, None, None
    for batch in batches:
        key_type, done = batch.column("conv_id").type, []
        columns = [batch.column(c).to_pylist() for c in ("pos", "mark", "conv_id", "turn", "code", "blank", "cut_off")]
        for pos, mark, conv, turn, code, blank, cut_off in zip(*columns):
            if mark == 0:
                first_at = pos
                continue
            if chunk is None or place != (pos >> 33, conv):
                if chunk is not None:
                    done.append((place[1], *chunk.row()))
                chunk, place = _Chunk(pos, code), (pos >> 33, conv)
            chunk.add(turn, code, blank, cut_off, first_at == pos)
        yield _batch(key_type, CHUNK_FIELDS, done)
    if chunk is not None:
        yield _batch(key_type, CHUNK_FIELDS, [(place[1], *chunk.row())])


SUMMARY_FIELDS = [(name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
SUMMARY_FIELDS.append(("exits", pa.list_(pa.struct([("pos", pa.int64()), ("after", pa.list_(pa.int64()))]))))
SUMMARY_DDL = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
               "exits array<struct<pos: long, after: array<long>>>")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from the list of its chunks (at most one a slice)."""
    for batch in batches:
        rows = []
        for conv, chunks in zip(batch.column("conv_id").to_pylist(), batch.column("chunks").to_pylist()):
            total = {k: sum(c[k] for c in chunks) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
            for left, right in zip(chunks, chunks[1:]):
                total["illegal"] += (left["last_code"], right["first_code"]) not in LEGAL
            least, most = None, None
            for c in chunks:
                total["turns"] -= c["least"] is not None and c["least"] == most
                least = c["least"] if least is None else least
                most = c["most"] if c["most"] is not None else most
            after, exits = END, []
            for c in reversed(chunks):
                exits.append({"pos": c["pos"], "after": list(level(after))})
                after = apply(tuple(tuple(c["matrix"][i:i + 4]) for i in range(0, 16, 4)), after)
            gaps = 0 if least is None else most - least + 1 - total["turns"]
            rows.append((conv, gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"], after[NOTHING], exits))
        yield _batch(batch.column("conv_id").type, SUMMARY_FIELDS, rows)


EDIT_FIELDS = [("pos", pa.int64()), ("letters", pa.list_(pa.string())), ("states", pa.list_(pa.int32()))]
EDIT_DDL = "pos long, letters array<string>, states array<int>"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "pos", "symbols", "lengths", "after")]
        rows = []
        for conv, pos, symbols, lengths, after in zip(*columns):
            found = chunk_edits(list(zip(symbols, lengths)), tuple(after))
            rows.append((conv, pos, [letters for letters, _ in found], [state for _, state in found]))
        yield _batch(batch.column("conv_id").type, EDIT_FIELDS, rows)


def _schema(df: DataFrame, ddl: str) -> StructType:
    return StructType([StructField("conv_id", df.schema["conv_id"].dataType), *StructType.fromDDL(ddl).fields])


def plan(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row a conversation of ``rows`` (conv_id, turn, role, text), and of ``ids`` (conv_id): gaps, blank, duplicate,
    truncated, illegal, cost, and the audit, the initials of the cheapest edits.  Stored."""
    prepare(rows.sparkSession)
    turns = _numbered(rows)
    firsts = turns.groupBy("conv_id", "digest").agg(F.min("pos").alias("pos"))
    light = turns.select("pos", F.lit(1).alias("mark"), "conv_id", "turn", "code", "blank", "cut_off")
    marked = light.unionByName(firsts.select("pos", F.lit(0).alias("mark")), allowMissingColumns=True)
    by_slice = marked.repartition(F.shiftright("pos", 33)).sortWithinPartitions("pos", "mark")
    chunks = stored(by_slice.mapInArrow(_chunks, _schema(rows, CHUNK_DDL)), "turn-chunks")

    facts = F.struct(*[c for c in chunks.columns if c not in ("conv_id", "symbols", "lengths")])
    known = (ids if ids is not None else rows).select("conv_id", F.lit(None).cast(chunks.select(facts.alias("c")).schema["c"].dataType).alias("c"))
    per = chunks.select("conv_id", facts.alias("c")).unionByName(known.distinct())
    grouped = per.groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("chunks"))
    summary = stored(grouped.mapInArrow(_summaries, _schema(rows, SUMMARY_DDL)), "conversations")

    exits = summary.select(F.explode("exits").alias("e")).select("e.pos", "e.after")
    edits = chunks.select("conv_id", "pos", "symbols", "lengths").join(exits, "pos").mapInArrow(_edits, _schema(rows, EDIT_DDL))
    chained = edits.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "letters", "states"))).alias("parts"))
    chain = F.aggregate("parts", F.struct(F.lit(NOTHING).alias("state"), F.lit("").alias("audit")), lambda acc, c: F.struct(
        F.get(c["states"], acc["state"]).alias("state"), F.concat(acc["audit"], F.get(c["letters"], acc["state"])).alias("audit")))
    tail = F.array(*[F.lit(TAIL[s]) for s in range(4)])
    audits = chained.select("conv_id", chain.alias("c")).select(
        F.col("conv_id").alias("id"), F.concat("c.audit", F.get(tail, F.col("c.state"))).alias("audit"))
    whole = summary.drop("exits").join(audits, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    return stored(whole.withColumn("audit", F.coalesce("audit", F.lit(""))), "conversation-plan")


REPAIRED_FIELDS = [("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
REPAIRED_DDL = "place long, edit string, role string, text string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation its plan, then its rows in order."""
    conv, audit, at, state, place, key_type = None, "", 0, NOTHING, 0, None

    def inserts() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            state = NEXT[state]
            yield conv, place, "I", NAMES[state], ""
            at, place = at + 1, place + 1

    for batch in batches:
        key_type, done = batch.column("conv_id").type, []
        for key, step, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if step is not None:
                done.extend(inserts())
                conv, audit, at, state, place = key, step, 0, NOTHING, 0
                continue
            done.extend(inserts())
            letter = audit[at]
            at += 1
            if letter == "D":
                done.append((conv, None, "D", role, text))
                continue
            state = kept(state, initial(role)) if letter == "K" else NEXT[state]
            done.append((conv, place, letter, role if letter == "K" else NAMES[state], text))
            place += 1
        yield _batch(key_type, REPAIRED_FIELDS, done)
    if key_type is not None:
        yield _batch(key_type, REPAIRED_FIELDS, list(inserts()))


def repair(rows: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """The repaired conversations, in order within a partition: conv_id, place (from 0; null if deleted), edit
    (K, R, I or D), role, text.  ``planned`` is ``plan`` of the same rows."""
    planned = plan(rows) if planned is None else planned
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    full = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), _digest(role, text).alias("digest"))
    heads = planned.filter("audit <> ''").select("conv_id", "audit")
    both = full.unionByName(heads, allowMissingColumns=True).withColumn("kind", F.col("audit").isNull())
    in_order = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest")
    return in_order.select("conv_id", "audit", "role", "text").mapInArrow(_repaired, _schema(rows, REPAIRED_DDL))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines, from rows in order."""
    conv, digest, started, key_type = None, None, False, None
    fields = [("repaired_sha256", pa.string())]
    for batch in batches:
        key_type, done = batch.column("conv_id").type, []
        for key, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
            if digest is None or key != conv:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest, started = key, sha256(), False
            if place is not None:
                digest.update((f"\n{role}:{text}" if started else f"{role}:{text}").encode())
                started = True
        yield _batch(key_type, fields, done)
    if digest is not None:
        yield _batch(key_type, fields, [(conv, digest.hexdigest())])


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the rows of ``repair``, straight after it (no shuffle between)."""
    return repaired.mapInArrow(_hashes, _schema(repaired, "repaired_sha256 string"))


def damage(conversations: DataFrame) -> DataFrame:
    """Faults for measuring the repair, by crc32(``conv_id:turn``) % 20: 0 drops the row, 1 empties its text, 2 takes its
    ``.!?`` out, 3 repeats it, 4 sets its role to user.  Nulls read as one space."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    hurt = conversations.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(filled("role")).alias("role"),
                                text.alias("text"), F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"))
    return hurt.drop("copy")


def repaired_summary(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``plan`` with the digest of each repaired conversation."""
    planned = plan(rows, ids)
    found = digests(repair(rows, planned)).withColumnRenamed("conv_id", "id")
    whole = planned.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    return whole.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())))
