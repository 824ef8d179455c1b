"""The repair of conversations against a plain search over (cost, audit)."""

import itertools
import random
import re
import sys
import zlib
from functools import cache
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cargolake.llm import conversations as C
from cargolake.llm.queries import QUERIES

sys.setrecursionlimit(20_000)  # the plain search below calls itself row by row
SCHEMA = "conv_id long, turn long, role string, text string, cost long, audit string"  # the last two clash with results
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def best_edits(rows):
    """rows: (initial, must_go, truncated).  The cheapest (cost, audit), by trying every edit."""
    @cache
    def best(i, last):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, ""))
        if last in ("", "s", "u") or i < len(rows):
            cost, rest = insert(i, last)
            found.append((cost + 2, "I" + rest))
        if i < len(rows):
            who, must_go, cut = rows[i]
            cost, rest = best(i + 1, last)
            found.append((cost + 3, "D" + rest))
            if not must_go:
                if who == NEXT[last] or (who == "s" and last == ""):
                    cost, rest = best(i + 1, who)
                    found.append((cost + cut, "K" + rest))
                cost, rest = best(i + 1, NEXT[last])
                found.append((cost + 2 + cut, "R" + rest))
        return min(found)

    @cache
    def insert(i, last):
        """After one insert at i; two more in a row are never cheapest."""
        last = NEXT[last]
        found = [(10 ** 9, "")]
        if i == len(rows):
            found.append((0, "") if last == "a" else (2, "I"))
        else:
            for state, cost, letters in ((last, 0, ""), (NEXT[last], 2, "I")):
                who, must_go, cut = rows[i]
                c, rest = best(i + 1, state)
                found.append((cost + c + 3, letters + "D" + rest))
                if not must_go:
                    if who == NEXT[state]:
                        c, rest = best(i + 1, who)
                        found.append((cost + c + cut, letters + "K" + rest))
                    c, rest = best(i + 1, NEXT[state])
                    found.append((cost + c + 2 + cut, letters + "R" + rest))
        return min(found)

    return best(0, "")


def expected(rows):
    """The result's columns of one conversation's (turn, role, text), damaged and in order."""
    blank = duplicate = truncated = 0
    seen, marked = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        kind = "blank" if not body else "dup" if (role, text) in seen else "cut" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        blank, duplicate, truncated = blank + (kind == "blank"), duplicate + (kind == "dup"), truncated + (kind == "cut")
        marked.append((role[:1] if role[:1] in "sua" and role else "x", kind in ("blank", "dup"), int(kind == "cut")))
    illegal = sum((a[0] + b[0]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = best_edits(tuple(marked))
    out, last, i = [], "", 0
    for letter in audit:
        if letter == "I":
            last = NEXT[last]
            out.append(("user" if last == "u" else "assistant") + ":")
            continue
        role, text = rows[i][1:]
        i += 1
        if letter == "K":
            last = role[0]
            out.append(f"{role}:{text}")
        elif letter == "R":
            last = NEXT[last]
            out.append(("user:" if last == "u" else "assistant:") + text)
    return gaps, blank, duplicate, truncated, illegal, cost, audit, sha256("\n".join(out).encode()).hexdigest()


def ordered(rows):
    def digest(role, text):
        return sha256(f"{len(role)}:{role}{text}".encode()).digest()

    filled = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(filled, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.extend([(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return out


def by_conversation(rows):
    found = {}
    for conv, *rest in rows:
        found.setdefault(conv, []).append(tuple(rest))
    return found


def result(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_runs_against_search():
    random.seed(7)
    kinds = [(w, m, c) for w in "suax" for m, c in ((False, 0), (False, 1), (True, 0))]
    cases = [list(p) for n in range(3) for p in itertools.product(kinds, repeat=n)]
    cases += [[random.choice(kinds[:9:3] + kinds) for _ in range(random.randint(3, 14))] for _ in range(400)]
    cases += [[k] * 9 + [random.choice(kinds)] * 5 for k in kinds]
    for rows in cases:
        symbols = ["suax".index(w) * 3 + (C.MUST_GO if m else C.CUT_OFF if c else C.FINE) for w, m, c in rows]
        runs = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
        cost = C.apply(C.chunk_matrix(runs), C.END)[C.NOTHING]
        letters, state = C.chunk_edits(runs, C.END)[C.NOTHING]
        assert (cost, letters + C.TAIL[state]) == best_edits(tuple(rows)), rows


def test_a_long_run_is_cheap():
    """Two million equal rows: powers, not steps; the cost is known in closed form."""
    n = 2_000_001
    assert C.apply(C.chunk_matrix([(3, n)]), C.END)[C.NOTHING] == 2 * (n // 2) + 2  # user, user: every other one reroled, one insert
    letters, state = C.chunk_edits([(3, n)], C.END)[C.NOTHING]
    audit = letters + C.TAIL[state]
    assert (len(audit), audit.count("R"), audit.count("I"), audit.count("K")) == (n + 1, n // 2, 1, n - n // 2)
    assert C.power.cache_info().currsize < 200


def odd_rows():
    random.seed(11)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["Yes.", "No!", "cut", " \t", "", None, "a?\n ", "Yes."]
    rows = [(c, t, random.choice(roles), random.choice(texts)) for c in range(40) for t in random.sample(range(12), random.randint(1, 9))]
    rows += [(None, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(6)]
    rows += [(100, None, "user", "a."), (100, None, "assistant", "b."), (100, 3, "user", "c."), (100, 3, "assistant", "d.")]
    rows += [(101, 0, "user", "same.")] * 9 + [(101, 1, "assistant", "é" * 5000 + ".")]
    rows += [(102, t, "user", " ") for t in range(5)]
    return rows


def test_repair_of_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = result(C.repaired_summary(df))
    want = {c: expected(ordered(r)) for c, r in by_conversation(rows).items()}
    assert got == want
    repaired = C.repair(df).filter("place IS NOT NULL").orderBy("conv_id", "place").collect()
    for conv, group in itertools.groupby(repaired, key=lambda r: r.conv_id):
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in group)), conv


def test_damage_and_repair(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = result(C.repaired_summary(C.damage(df), df))
    left = by_conversation(hurt(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", sha256().hexdigest())
    assert got == {c: expected(ordered(left[c])) if c in left else nothing for c in {r[0] for r in rows}}


def test_a_hot_conversation_is_many_chunks(spark):
    """A third of all rows in one conversation, half of them equal: the same result, from chunks of several slices."""
    random.seed(2)
    rows = [(7, t, random.choice(["user", "assistant"]), f"t{random.randint(0, 400)}{random.choice('.!,')}") for t in range(500)]
    rows += [(7, 250, "user", "again.")] * 500 + [(c, t, "user", "x.") for c in range(10, 410) for t in range(5)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(12)
    keys = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = C._numbered(df)
        assert turns.filter("conv_id = 7").select(F.shiftright("pos", 33)).distinct().count() > 2
        got = result(C.repaired_summary(df))
    finally:
        for k, v in keys.items():
            spark.conf.set(k, v)
    want = {c: expected(ordered(r)) for c, r in by_conversation(rows).items()}
    assert got[7][:7] == want[7][:7] and got == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.repaired_summary(C.damage(df), df).count() == 0 and C.repair(df).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_search(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = result(QUERIES["op12_conversation_repair"](spark, f"/root/testdata/{sf}"))
    left = by_conversation(hurt(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", sha256().hexdigest())
    assert got == {c: expected(ordered(left[c])) if c in left else nothing for c in {r[0] for r in rows}}
