"""Op 13: repair the structure of conversations with the cheapest edits.

Every row of a conversation is kept, given another role or deleted, and rows
without text may be inserted, so that the roles read ``(s?(ua)+)?``.  The edits
are a path through a graph of (row, state) nodes.  The weight of a path is one
integer: its high digits are the cost, its low digits, of fixed width and place,
the letters of its edits with zeros after the last.  The smallest integer is thus
the cheapest path and, of these, the one whose letters are least in ASCII; plain
minima from the last row to the first decide everything.

The letters of paths that leave a node differ at once, so what follows a segment
of rows decides nothing but cost in it: low digits span one segment, and the
time is linear in the rows.

Conversations of ordinary size are one group each.  A long one is never held:
its rows are ordered by ranges, its repair is decided on one byte a row, and its
rows are joined to the edits by their place.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexlens.llm.common import write_step
from hexlens.operators.ranking import rank_within_group

# Costs of the edits, and of leaving a truncated row in.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Edits in ASCII order; a letter's digit is its place, from 1.
LETTERS = "DIKR"
DIGIT_BITS = 3
WHITE = " \t\n\x0b\x0c\r"
#: Rows whose letters the low digits of one integer span.
SEGMENT = 256
#: Rows, and bytes of text, from which a conversation is long.
LONG_ROWS, LONG_BYTES = 20000, 32 << 20

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after an inserted row; a state asks for this role next.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
REPORT = ("conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
REPAIRED = "conv_id {id}, position long, role string, text string, edit string"


def _edges() -> dict[str, list[list[tuple[int, int, int]]]]:
    """For each kind of row and state: (cost, digit, state after) of its edits.

    Kinds: b blank, d duplicate; s, u, a, o (other role) sound, in upper case truncated.
    """
    own = {"s": (START, SYSTEM), "u": (None, USER), "a": (USER, ASSISTANT)}
    out = {}
    for kind in "bdsuaoSUAO":
        out[kind] = []
        for state in range(4):
            edges = [(DELETE, 1, state)]
            if kind not in "bd":
                more = TRUNCATED if kind.isupper() else 0
                asked = NEXT[state]
                k = kind.lower()
                if (k == "s" and state == START) or (k == "u" and asked == USER) or (k == "a" and asked == ASSISTANT):
                    edges.append((KEEP + more, 3, own[k][1]))
                edges.append((REROLE + more, 4, asked))
            out[kind].append(edges)
    return out


EDGES = _edges()


def _segment(kinds: str, ends: list[int | None], last: bool) -> tuple[list[int | None], int]:
    """Least weights from each state before a segment, given the least costs after it, and the bits of the low digits."""
    bits = DIGIT_BITS * (3 * len(kinds) + 3)
    top, low = bits - DIGIT_BITS, (1 << bits) - 1
    insert = (INSERT << bits) + (2 << top)

    def pushed(w):  # every letter one place on, to make room in front
        return None if w is None else (w >> bits << bits) + ((w & low) >> DIGIT_BITS)

    def inserts(base):  # two at most: a third would be back where the first began
        w = base
        for _ in range(2):
            after = [pushed(x) for x in w]
            via = [None if after[NEXT[state]] is None else after[NEXT[state]] + insert for state in range(4)]
            w = [min((x for x in pair if x is not None), default=None) for pair in zip(base, via, strict=True)]
        return w

    w = [None if c is None else c << bits for c in ends]
    if last:
        w = inserts(w)
    for kind in reversed(kinds):
        after = [pushed(x) for x in w]
        w = inserts([min((after[to] + (cost << bits) + (digit << top) for cost, digit, to in edges if after[to] is not None), default=None)
                     for edges in EDGES[kind]])
    return w, bits


def letters(low: int, bits: int) -> str:
    out = []
    for at in range(bits - DIGIT_BITS, -1, -DIGIT_BITS):
        digit = low >> at & (1 << DIGIT_BITS) - 1
        if not digit:
            break
        out.append(LETTERS[digit - 1])
    return "".join(out)


def replay(kinds: str, audit: str, state: int = START):
    """(row or None, role state) of every row that the edits leave, then the state at the end."""
    row, out = 0, []
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out.append((None, state))
            continue
        if letter == "K":
            state = SYSTEM if kinds[row].lower() == "s" else NEXT[state]
            out.append((row, None))
        elif letter == "R":
            state = NEXT[state]
            out.append((row, state))
        row += 1
    return out, state


def cheapest(kinds: str, segment: int = SEGMENT) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of rows of these kinds."""
    starts = list(range(0, len(kinds), segment)) or [0]
    costs, weights = [0, None, None, 0], {}
    for s in reversed(starts):
        w, bits = _segment(kinds[s : s + segment], costs, last=s == starts[-1])
        weights[s] = ([None if x is None else x & (1 << bits) - 1 for x in w], bits)
        costs = [None if x is None else x >> bits for x in w]
    state, audit = START, []
    for s in starts:
        low, bits = weights[s]
        audit.append(letters(low[state], bits))
        state = replay(kinds[s : s + segment], audit[-1], state)[1]
    return costs[START], "".join(audit)


def initial(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else "o"


def kind_of(role: str, text: str, seen: bool) -> str:
    """A row's first fault, or its role's initial."""
    body = text.rstrip(WHITE)
    if not body:
        return "b"
    if seen:
        return "d"
    own = initial(role)
    return own if body[-1] in ".!?" else own.upper()


def illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials))


def counts(kinds: str) -> tuple[int, int, int]:
    return kinds.count("b"), kinds.count("d"), sum(kinds.count(k) for k in "SUAO")


def _ordered(t: pa.Table) -> tuple[list, list[str], list[str], str]:
    """Turns, roles and texts of the rows that there are, in order, and their kinds."""
    t = t.filter(t["present"]).sort_by([("turn", "ascending"), ("role", "ascending"), ("text", "ascending")])
    turns, roles, texts = t["turn"].to_pylist(), t["role"].to_pylist(), t["text"].to_pylist()
    none = turns.count(None)  # Arrow sorts nulls last
    if none:
        turns, roles, texts = (x[-none:] + x[:-none] for x in (turns, roles, texts))
    seen, kinds = set(), []
    for role, text in zip(roles, texts, strict=True):
        kinds.append(kind_of(role, text, (role, text) in seen))
        seen.add((role, text))
    return turns, roles, texts, "".join(kinds)


def _repaired(roles, texts, kinds, audit):
    edit = iter(audit.replace("D", ""))
    for row, state in replay(kinds, audit)[0]:
        yield NAMES[state] if state is not None else roles[row], "" if row is None else texts[row], next(edit)


def _report(t: pa.Table, schema: pa.Schema) -> pa.Table:
    turns, roles, texts, kinds = _ordered(t)
    given = [x for x in turns if x is not None]
    gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
    cost, audit = cheapest(kinds)
    body = "\n".join(f"{role}:{text}" for role, text, _ in _repaired(roles, texts, kinds, audit))
    row = [t["conv_id"][0].as_py(), gaps, *counts(kinds), illegal("".join(map(initial, roles))), cost, audit, hashlib.sha256(body.encode()).hexdigest()]
    return pa.table([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)


def _rows(t: pa.Table, schema: pa.Schema) -> pa.Table:
    _, roles, texts, kinds = _ordered(t)
    _, audit = cheapest(kinds)
    out = list(_repaired(roles, texts, kinds, audit))
    cols = [[t["conv_id"][0].as_py()] * len(out), range(len(out)), *(list(c) for c in zip(*out, strict=True))] if out else [[]] * 5
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


class Split:
    """Ordinary conversations, and long ones with their parts as written tables."""

    def __init__(self, rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present_col: str | None, long_rows: int, long_bytes: int):
        blank = F.lit(" ")
        present = F.coalesce(F.col(present_col), F.lit(False)) if present_col else F.lit(True)
        self.rows = rows.select(
            F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), blank).alias("role"),
            F.coalesce(F.col(text_col), blank).alias("text"), present.alias("present"))
        self.id_type = self.rows.schema["conv_id"].dataType.simpleString()
        here = F.col("present")
        sizes = self.rows.groupBy("conv_id").agg(F.count_if(here).alias("n"), F.sum(F.when(here, F.octet_length("text").cast("long"))).alias("b"))
        self.long_ids = sizes.filter((F.col("n") > long_rows) | (F.col("b") > long_bytes)).select(F.col("conv_id").alias("long_id"))
        self.any_long = self.long_ids.limit(1).count() > 0
        self.ordinary, self.steps = self.rows, []
        if self.any_long:
            same = F.col("conv_id").eqNullSafe(F.col("long_id"))
            self.ordinary = self.rows.join(self.long_ids, same, "left_anti")
            self._prepare_long(self.rows.filter(here).join(self.long_ids, same, "left_semi"))

    def _step(self, df: DataFrame, name: str) -> DataFrame:
        df, path = write_step(df, name)
        self.steps.append(path)
        return df

    def _prepare_long(self, rows: DataFrame) -> None:
        """places: every row with its place from 0 and its kind; decided: kinds, initials and edits of each conversation."""
        none, key = F.col("conv_id").isNull(), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
        equal = (rows.groupBy(none.alias("c_null"), key.alias("c_key"), "conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
                 .withColumn("same", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
                 .withColumn("at", F.struct(F.col("turn").isNotNull(), "turn")))
        first = equal.groupBy("c_null", "c_key", "same").agg(F.min("at").alias("first"))
        kinds = (equal.join(first, ["c_null", "c_key", "same"])
                 .select("c_null", "c_key", "conv_id", "turn", "role", "text", (F.col("at") > F.col("first")).alias("seen"),
                         F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")))
        body = F.regexp_replace("text", r"[ \t-\r]+\z", "")
        letter = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
        kind = (F.when(F.trim(F.translate("text", WHITE, " " * 6)) == "", "b").when(F.col("seen") | (F.col("copy") > 1), "d")
                .when(F.substring(body, -1, 1).isin(".", "!", "?"), letter).otherwise(F.upper(letter)))
        kinds = kinds.withColumn("initial", letter).withColumn("kind", kind).drop("seen")
        order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
        self.places = rank_within_group(kinds, ["c_null", "c_key"], order, out="place")
        chunk = (self.places.groupBy("c_null", "c_key", "conv_id", F.floor(F.col("place") / 65536).alias("chunk"))
                 .agg(F.sort_array(F.collect_list(F.struct("place", "kind", "initial"))).alias("r"))
                 .select("c_null", "c_key", "conv_id", "chunk", F.array_join("r.kind", "").alias("kind"), F.array_join("r.initial", "").alias("initial")))
        whole = chunk.groupBy("c_null", "c_key", "conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "kind", "initial"))).alias("r"))
        turns = self.places.groupBy("c_null", "c_key", "turn").agg(F.lit(1)).groupBy("c_null", "c_key").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
        text = whole.join(turns, ["c_null", "c_key"]).select(
            "c_null", "c_key", "conv_id", "gaps", F.array_join("r.kind", "").alias("kinds"), F.array_join("r.initial", "").alias("initials"))

        def decide(batches):
            for b in batches:
                t = b.to_pydict()
                done = [(*counts(k), illegal(i), *cheapest(k)) for k, i in zip(t["kinds"], t["initials"], strict=True)]
                cols = list(zip(*done, strict=True)) if done else [[]] * 6
                yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.string()), b.column("kinds")],
                                                 names)

        names = ["c_null", "c_key", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "kinds"]
        self.decided = self._step(text.mapInArrow(decide, f"c_null boolean, c_key string, conv_id {self.id_type}, gaps long, blank long, duplicate long, "
                                                          "truncated long, illegal long, cost long, audit string, kinds string"), "conversations-decided")

    def long_repaired(self) -> DataFrame:
        """c_null, c_key, conv_id, position, role, text, edit of the rows that the repair of long conversations leaves."""
        def spread(batches):
            for b in batches:
                for c_null, c_key, conv, audit, kinds in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    left, edits = replay(kinds, audit)[0], audit.replace("D", "")
                    for s in range(0, len(left), 65536):
                        part = left[s : s + 65536]
                        n = len(part)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([c_null] * n, pa.bool_()), pa.array([c_key] * n, pa.string()), pa.array([conv] * n, b.schema.field(2).type), pa.array(range(s, s + n), pa.int64()),
                             pa.array([r for r, _ in part], pa.int64()), pa.array([NAMES.get(x) for _, x in part], pa.string()), pa.array(list(edits[s : s + n]), pa.string())],
                            ["c_null", "c_key", "conv_id", "position", "place", "new_role", "edit"])

        spread_out = self.decided.select("c_null", "c_key", "conv_id", "audit", "kinds").mapInArrow(
            spread, f"c_null boolean, c_key string, conv_id {self.id_type}, position long, place long, new_role string, edit string")
        own = self.places.select("c_null", "c_key", "place", F.col("role").alias("old_role"), "text")
        return spread_out.join(own, ["c_null", "c_key", "place"], "left").select(
            "c_null", "c_key", "conv_id", "position", F.coalesce("new_role", "old_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")

    def long_report(self) -> DataFrame:
        """Reports of long conversations; the digest streams over their sorted rows."""
        def digest(batches):
            now, h = None, None
            done = lambda: pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, h.hexdigest())], ["c_null", "c_key", "repaired_sha256"])
            for b in batches:
                for c_null, c_key, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (c_null, c_key) == now:
                        h.update(b"\n")
                    else:
                        if now is not None:
                            yield done()
                        now, h = (c_null, c_key), hashlib.sha256()
                    h.update(line.encode())
            if now is not None:
                yield done()

        lines = (self.long_repaired().repartition("c_null", "c_key").sortWithinPartitions("c_null", "c_key", "position")
                 .select("c_null", "c_key", F.concat_ws(":", "role", "text").alias("line")))
        hashes = lines.mapInArrow(digest, "c_null boolean, c_key string, repaired_sha256 string")
        return self.decided.join(hashes, ["c_null", "c_key"], "left").select(
            "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _arrow(ddl: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def report(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           present_col: str | None = None, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are in order of turn (nulls first), then role and text.  A null role or
    text is one space; a null conv_id is a conversation like others.  Rows whose
    ``present_col`` isn't true only name their conversation; one without other rows
    has zeros, an empty audit and the hash of an empty string.  Repeated rows are
    duplicates; other columns are not read; an empty table gives no rows.
    """
    s = Split(rows, conv_col, turn_col, role_col, text_col, present_col, long_rows, long_bytes)
    ddl = REPORT.format(id=s.id_type)
    schema = _arrow(ddl, rows.sparkSession)
    out = s.ordinary.groupBy("conv_id").applyInArrow(lambda t: _report(t, schema), ddl)
    return out.unionByName(s.long_report()) if s.any_long else out


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           present_col: str | None = None, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text, edit (K kept, R other role, I inserted).

    Odd rows as in ``report``; a conversation of which nothing is left has no rows.
    """
    s = Split(rows, conv_col, turn_col, role_col, text_col, present_col, long_rows, long_bytes)
    ddl = REPAIRED.format(id=s.id_type)
    schema = _arrow(ddl, rows.sparkSession)
    out = s.ordinary.groupBy("conv_id").applyInArrow(lambda t: _rows(t, schema), ddl)
    return out.unionByName(s.long_repaired().drop("c_null", "c_key")) if s.any_long else out


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, present: rows with faults of kind crc32(``conv_id:turn``) modulo 20.

    0 drops the row (its place stays, with present false), 1 empties the text, 2
    removes its ``.``, ``!`` and ``?``, 3 repeats the row, 4 sets the role user;
    others change nothing.  Nulls are one space, in the key as in role and text.
    """
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(filled(conv_col), F.lit(":"), filled(turn_col)).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(filled(text_col), "[.!?]", "")).otherwise(filled(text_col))
    return rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(filled(role_col)).alias("role"),
        text.alias("text"), (fault != 0).alias("present"), F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")
