import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from kindred.llm import conversation_repair as cr
from kindred.llm.queries import QUERIES, damaged

WORD = re.compile(r"[^\x20\x09-\x0D]")


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def same(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    """The report of one conversation, by trying all edits from every row and state on."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], same(r[1], r[2])))
    faults, seen = [], set()
    for turn, role, text in rows:
        said = WORD.findall(text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    fits = re.compile(r"(s?(ua)+)?$")
    grow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, puts):
        found = [(0, "")] if i == len(rows) and last in ("", "a") else []
        options = []
        if i < len(rows):
            must, late = faults[i] in ("blank", "duplicate"), faults[i] == "truncated"
            options.append((3, "D", i + 1, last, 0))
            if not must:
                options += [(2 + late, "R", i + 1, r, 0) for r in "ua" if r in grow[last]]
                if rows[i][1][:1] and rows[i][1][:1] in grow[last]:
                    options.append((int(late), "K", i + 1, rows[i][1][:1], 0))
        if puts < 3:
            options += [(2, "I", i, r, puts + 1) for r in "ua" if r in grow[last]]
        for cost, letter, j, role, more in options:
            rest = best(j, role, more)
            if rest:
                found.append((cost + rest[0], letter + rest[1]))
        return min(found) if found else None

    cost, audit = best(0, "", 0)
    lines, i, last = [], 0, ""
    for letter in audit:
        need = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
        if letter == "I":
            lines.append(f"{need}:")
            last = need[0]
            continue
        turn, role, text = rows[i]
        i += 1
        if letter != "D":
            role = need if letter == "R" else role
            lines.append(f"{role}:{text}")
            last = role[0]
    assert fits.match("".join(line[0] for line in lines))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def wanted(rows):
    convs = {r[0]: [] for r in rows}
    for r in harmed(rows):
        convs[r[0]].append(r)
    return {c: brute(r) for c, r in convs.items()}


def conversations():
    rng = random.Random(6)
    roles, texts = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "uncle"], ["Yes.", "No", " ", "", None, "a.\n", "b!  x", "Why?", "é.", "...", "c "]
    rows = [
        (c, rng.choice([None, *range(9)]) if c % 3 else t, rng.choice(roles), (rng.choice(texts) or "") + str(rng.randint(0, 3)) + "." if rng.random() < 0.4 else rng.choice(texts))
        for c in range(150) for t in range(rng.randint(1, 9))
    ]
    rows += [(None, t, "user", "hm.") for t in (None, 1, 2, 2, 2)] + [(900, t, rng.choice(roles[:5]), rng.choice(texts)) for t in range(130)]
    rows += [(901, 5, "user", "same.")] * 12 + [(902, -(2**63) + 1, "user", "a."), (902, 2**63 - 1, "assistant", "b.")] + [(903, 1, "user", "x" * 200_000 + ". \n")]
    return rows


@pytest.mark.parametrize("records", ["10000", "3"])
def test_equals_trying_everything(spark, tmp_path, records):
    rows = conversations()
    want = wanted(rows)
    want[902] = (min(want[902][0], 2**63 - 1), *want[902][1:])
    df = spark.createDataFrame([(*r, "clash", 1, True) for r in rows], "conv_id long, turn long, role string, text string, audit string, position int, first boolean")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        out = QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r[0]: tuple(r[1:]) for r in out}
    assert len(got) == len(out) and got == want


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.01").collect()}
    assert got == wanted(rows)


def test_repaired_rows_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello"), (1, 2, "user", ""), (2, 0, "tool", "x.")], schema)
    plans = cr.plan(rows)
    assert {r.conv_id: (r.cost, r.audit) for r in plans.collect()} == {1: (6, "KIKD"), 2: (3, "D")}
    out = cr.apply(rows, plans).orderBy("conv_id", "position").collect()
    assert [tuple(r) for r in out] == [(1, 1, 0, "system", "Be kind.", "K"), (1, 2, None, "user", "", "I"), (1, 3, 1, "assistant", "Hello", "K")]
    none = spark.createDataFrame([], schema)
    assert cr.plan(none).count() == 0 and cr.apply(none, cr.plan(none)).count() == 0 and damaged(none).count() == 0


def test_spans_joined_equal_one_search():
    rng = random.Random(3)
    for size in (0, 1, 31, 32, 33, 100, 5000):
        symbols = "".join(rng.choice("-suaxSUAXuaua") for _ in range(size))
        alone = cr.agenda([cr.edits(s) for s in symbols], 0, goal=True, insert=True)
        assert cr.lightest(symbols) == alone
        cuts = sorted(rng.randint(0, size) for _ in range(4))
        parts = [cr.span(symbols[a:b]) for a, b in zip([0, *cuts], [*cuts, size]) if a < b]
        assert cr.agenda(parts, 0, goal=True, insert=False) == alone
