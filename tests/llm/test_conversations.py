import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from hexlens.llm import conversations, queries

ROWS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    """Conversation -> rows after damage, in order, by the words of the contract."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        own = out[conv]
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def brute(rows):
    """The contract's columns for one conversation; edits by a search over whole strings, without weights."""
    seen, kinds = set(), []
    for _, role, text in rows:
        body = text.strip(WHITE)
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]

    @lru_cache(None)
    def rest(i, roles, ins):  # (cost, audit, repaired) from row i on; roles: "", "s" or the last initial
        asked = "a" if roles == "u" else "u"
        options = [(0, "", ())] if i == len(rows) and roles in ("", "a") else []

        def go(cost, letter, line, to, j, k):
            if (r := rest(j, to, k)) is not None:
                options.append((r[0] + cost, letter + r[1], (*line, *r[2])))

        if ins < 3:
            go(5, "I", [{"u": "user:", "a": "assistant:"}[asked]], asked, i, ins + 1)
        if i < len(rows):
            _, role, text = rows[i]
            go(2, "D", [], roles, i + 1, 0)
            if kinds[i] not in ("blank", "duplicate"):
                more = 5 if kinds[i] == "truncated" else 0
                if role[:1] == asked or (role[:1] == "s" and roles == ""):
                    go(more, "K", [f"{role}:{text}"], role[:1], i + 1, 0)
                go(1 + more, "R", [{"u": "user:", "a": "assistant:"}[asked] + text], asked, i + 1, 0)
        return min(options, default=None)

    cost, audit, lines = rest(0, "", 0)
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": kinds.count("blank"), "duplicate": kinds.count("duplicate"),
            "truncated": kinds.count("truncated"), "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(), "lines": lines}


def check(got, want):
    assert {r.conv_id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        w = brute(want[r.conv_id])
        assert r.asDict() == {"conv_id": r.conv_id, **{k: v for k, v in w.items() if k != "lines"}}


def made(seed, n, conversations=40):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "so", "Why?  ", " ", "", "\t\n", "a.\x85", None, "end.\n", "x!\x0b"]
    rows = []
    for _ in range(n):
        conv = r.choice([None, *range(conversations)])
        rows.append((conv, r.choice([None, *range(12)]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys", "User"]), r.choice(texts)))
    return rows


def test_cheapest_against_a_search(spark):
    r = random.Random(5)
    for _ in range(1500):
        kinds = "".join(r.choice("bdsuaoSUAOuaua") for _ in range(r.randrange(12)))
        names = {"s": "s", "u": "u", "a": "a", "o": "x"}
        rows, seen = [], 0
        for k in kinds:
            seen += 1
            rows.append((0, "u", " ") if k == "b" else rows[0] if k == "d" and rows and rows[0][2].strip() else (0, "u", "") if k == "d" else (0, names[k.lower()], f"{seen}" + (" " if k.isupper() else ".")))
        own = "".join(conversations.kind_of(role, text, any((role, text) == x[1:] for x in rows[:i])) for i, (_, role, text) in enumerate(rows))
        w = brute(rows)
        for segment in (256, 3, 1):
            assert conversations.cheapest(own, segment) == (w["cost"], w["audit"])


@pytest.mark.parametrize("long_rows", [20000, 6, 0])
def test_reports_against_a_search(spark, long_rows):
    rows = made(7, 400)
    d = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as place", "2 as kind", "3 as audit", "4 as present").repartition(5)
    got = conversations.report(conversations.damage(d), present_col="present", long_rows=long_rows).collect()
    check(got, damaged(rows))


@pytest.mark.parametrize("long_rows", [20000, 0])
def test_repaired_rows(spark, long_rows):
    rows = made(8, 200)
    got = conversations.repair(conversations.damage(spark.createDataFrame(rows, ROWS)), present_col="present", long_rows=long_rows).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.position):
        assert r.position == len(by[r.conv_id])
        by[r.conv_id].append(r)
    for conv, own in damaged(rows).items():
        w = brute(own)
        assert [f"{r.role}:{r.text}" for r in by[conv]] == list(w["lines"])
        assert "".join(r.edit for r in by[conv]) == w["audit"].replace("D", "")


def test_the_query_on_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(queries.op13_conversations(spark, "/root/testdata/sf0.01").collect(), damaged(rows))


def test_one_conversation_of_many_equal_rows(spark):
    rows = [(1, 3, "user", "Hi.")] * 3000 + [(1, 5, "assistant", "So.")] + [(2, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(2000)]
    d = spark.createDataFrame(rows, ROWS).repartition(4)
    short, long = ({r.conv_id: r for r in conversations.report(d, long_rows=n).collect()} for n in (20000, 100))
    assert short == long and short[1].duplicate == 2999 and short[1].cost == 5998 and short[2].audit == "K" * 2000


def test_odd_tables(spark):
    assert conversations.report(conversations.damage(spark.createDataFrame([], ROWS)), present_col="present").count() == 0
    assert conversations.repair(spark.createDataFrame([], ROWS)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    r, = conversations.report(conversations.damage(spark.createDataFrame([(gone, 0, "user", "x")], ROWS)), present_col="present").collect()
    assert (r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (gone, 0, 0, 0, 0, 0, 0, "")
    assert r.repaired_sha256 == hashlib.sha256(b"").hexdigest()
    r, = conversations.report(spark.createDataFrame([(1, 0, "user", "x " * 500000 + "."), (1, 1, "assistant", "y.")], ROWS), long_bytes=1000).collect()
    assert r.audit == "KK"
