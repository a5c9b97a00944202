"""Repair of the structure of conversations: the cheapest edits after which the roles follow a grammar.

Turns of a conversation, in the order of their numbers, are kept (K), given another role (R), deleted (D), or empty
turns are inserted (I) so that the first letters of the roles read `(s?(ua)+)?`. Blank and repeated turns must be
deleted; a turn cut off costs something unless it is deleted. A dynamic programme runs backward over (turn, state of the
grammar) and gives what the rest costs at least; a walk forward then takes, of the edits that keep to that cost, the one
of the least letter. A letter and a state determine what follows, so this is the least of all cheapest sequences.

Turns are dealt by ranges of (conversation, turn), so that a conversation with very many turns lies in several tasks. What
lies whole in one task is finished there. The others are cut in segments, one a task: a segment becomes a matrix of
costs from state to state, the matrices of a conversation are folded backward to give each segment the costs at its end,
then each segment is walked from every state, the states at which segments are really entered are folded forward, and the
turns of each segment are rebuilt. Only the hash over a whole conversation reads its segments one after another.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
#: States: nothing yet, after s, after u, after a. The role put in or given at each, and the state it leads to.
ROLE, LEADS = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
KEEPS = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1), "o": (-1, -1, -1, -1)}
NEVER = 1 << 50
#: Costs after the last turn: it may end before anything and after a.
END = (0, 6, 3, 0)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def fault(text: str, first: bool) -> str:
    """'' or the first of blank, duplicate and truncated that holds."""
    shown = text.rstrip(SPACE)
    return "blank" if not shown else "duplicate" if not first else "" if shown[-1] in ".!?" else "truncated"


def code(role: str, wrong: str) -> str:
    """x for what must be deleted, else the letter of the role (o for others), upper case if cut off."""
    letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return "x" if wrong in ("blank", "duplicate") else letter.upper() if wrong else letter


def before(c: str, after: tuple) -> tuple:
    """The least costs at each state before a turn, from those after it; turns may be inserted before it."""
    if c == "x":
        v = [DELETE + x for x in after]
    else:
        more, keeps = CUT_OFF * c.isupper(), KEEPS[c.lower()]
        v = [min(DELETE + after[s], more + REROLE + after[LEADS[s]], more + after[keeps[s]] if keeps[s] >= 0 else NEVER) for s in range(4)]
    user = min(v[2], INSERT + v[3])
    return min(v[0], INSERT + user), min(v[1], INSERT + user), user, min(v[3], INSERT + user)


def costs(codes: str, end: tuple = END) -> list[tuple]:
    """The least costs at each state before each turn, then those at the end."""
    out = [end]
    for c in reversed(codes):
        out.append(before(c, out[-1]))
    return out[::-1]


def matrix(codes: str) -> list[int]:
    """Least cost from each state before the turns to each state after them, by rows."""
    columns = [costs(codes, tuple(0 if s == t else NEVER for s in range(4)))[0] for t in range(4)]
    return [min(columns[t][s], NEVER) for s in range(4) for t in range(4)]


def walk(codes: str, least: list[tuple], state: int) -> tuple[str, int]:
    """The letters of the edits from a state on, and the state after the last turn."""
    out, i = [], 0
    while i < len(codes):
        c, v, after = codes[i], least[i], least[i + 1]
        more, keeps = CUT_OFF * c.isupper(), -1 if c == "x" else KEEPS[c.lower()][state]
        if v[state] == DELETE + after[state]:
            out.append("D")
        elif v[state] == INSERT + v[LEADS[state]]:
            out.append("I")
            state = LEADS[state]
            continue
        elif keeps >= 0 and v[state] == more + after[keeps]:
            out.append("K")
            state = keeps
        else:
            out.append("R")
            state = LEADS[state]
        i += 1
    return "".join(out), state


def closing(state: int) -> str:
    """Turns inserted after the last one."""
    return ("", "II", "I", "")[state]


def rebuilt(rows: list[tuple], audit: str, state: int) -> list[tuple]:
    """(edit, turn, role, text) of what an audit makes of (turn, role, text) rows from a state on; deleted turns are left out."""
    out, at = [], iter(rows)
    for edit in audit:
        if edit == "I":
            out.append(("I", None, ROLE[state], ""))
            state = LEADS[state]
            continue
        turn, role, text = next(at)
        if edit == "D":
            continue
        out.append((edit, turn, ROLE[state] if edit == "R" else role, text))
        state = LEADS[state] if edit == "R" else KEEPS[role[0]][state]
    return out


def lines(turns: list[tuple]) -> str:
    return "\n".join(f"{role}:{text}" for _, _, role, text in turns)


class Facts:
    """What is counted over the turns of one segment, in order."""

    def __init__(self, rows: list[tuple], firsts: list[bool]):
        wrong = [fault(text, first) for (_, _, text), first in zip(rows, firsts, strict=True)]
        self.codes = "".join(code(role, w) for (_, role, _), w in zip(rows, wrong, strict=True))
        self.faults = [wrong.count(k) for k in ("blank", "duplicate", "truncated")]
        letters = [role[:1] for _, role, _ in rows]
        self.illegal = sum(p not in LEGAL for p in zip(letters, letters[1:], strict=False))
        self.ends = (letters[0], letters[-1]) if letters else ("", "")
        turns = [t for t, _, _ in rows if t is not None]
        self.turns = (turns[0], turns[-1], len(set(turns))) if turns else (None, None, 0)


def seen_first(rows: list[tuple]) -> list[bool]:
    seen: set = set()
    return [not (k in seen or seen.add(k)) for k in ((role, text) for _, role, text in rows)]


def whole(rows: list[tuple]) -> tuple[list[int], str, list[tuple]]:
    """Counts, audit and rebuilt turns of a conversation that one task holds."""
    facts = Facts(rows, seen_first(rows))
    least = costs(facts.codes)
    audit, state = walk(facts.codes, least, 0)
    audit += closing(state)
    low, high, n = facts.turns
    return [high - low + 1 - n if n else 0, *facts.faults, facts.illegal, least[0][0]], audit, rebuilt(rows, audit, 0)


def by_ranges(turns: DataFrame) -> DataFrame:
    """Turns in order over tasks and within them; equal numbers by role and a hash of the text, copies by where they were read."""
    own = turns.withColumn("_h", F.xxhash64("role", "text")).withColumn("_at", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "_h", "_at")]
    return own.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone", F.spark_partition_id().alias("part"))


def finished_or_open(ordered: DataFrame, as_turns: bool) -> DataFrame:
    """Whole conversations finished; the turns of those that may go on in other tasks (the first and last of a task) as they are.

    Finished rows have a null `pos`, open ones their place in the task.
    """
    conv, number = ordered.schema["conv_id"], ordered.schema["turn"]
    plain = [conv, T.StructField("part", T.LongType()), T.StructField("pos", T.LongType()), number, T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("gone", T.BooleanType())]
    told = [T.StructField("place", T.LongType()), T.StructField("edit", T.StringType())] if as_turns else [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    wide = T.StructType([*plain, *told])

    def run(batches):
        kinds = None
        out: list[tuple] = []
        held: list[tuple] = []
        own, pos, opening = None, 0, True

        def packed():
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=wide.names)
            out.clear()
            return b

        def as_open():
            out.extend((own, part, p, turn, role, text, gone, *[None] * len(told)) for p, turn, role, text, gone in held)
            held.clear()

        def close():
            rows = [(turn, role, text) for _, turn, role, text, gone in held if not gone]
            counts, audit, turns = whole(rows)
            if as_turns:
                out.extend((own, part, None, turn, role, text, None, i, edit) for i, (edit, turn, role, text) in enumerate(turns))
            else:
                out.append((own, part, None, None, None, None, None, *counts, audit, hashlib.sha256(lines(turns).encode()).hexdigest()))
            held.clear()

        for b in batches:
            kinds = kinds or [b.column(0).type, pa.int64(), pa.int64(), b.column(1).type, pa.string(), pa.string(), pa.bool_(), *([pa.int64(), pa.string()] if as_turns else [pa.int64()] * len(COUNTS) + [pa.string()] * 2)]
            for k, turn, role, text, gone, part in zip(*(c.to_pylist() for c in b.columns), strict=True):  # noqa: B007  part is used by the helpers
                if pos and k != own:
                    if opening:
                        as_open()
                        opening = False
                    else:
                        close()
                own = k
                held.append((pos, turn, role, text, gone))
                pos += 1
                if opening and len(held) >= 1000:
                    as_open()
                if len(out) >= 1000:
                    yield packed()
        as_open()
        if out:
            yield packed()

    return ordered.mapInArrow(run, wide)


def segments(opened: DataFrame) -> DataFrame:
    """One row for each (conv_id, part) of open turns: codes, matrix and counts."""
    live = opened.where("not gone").withColumn("_key", F.sha2(F.concat_ws("\0", "role", "text"), 256))
    firsts = live.groupBy("conv_id", "_key").agg(F.min(F.struct("part", "pos")).alias("f")).select("f.part", "f.pos", F.lit(True).alias("first"))
    flagged = live.drop("_key").join(firsts, ["part", "pos"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    conv = opened.schema["conv_id"].dataType.simpleString()
    number = opened.schema["turn"].dataType.simpleString()
    names = ("blank", "duplicate", "truncated", "illegal")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        rows = [(None if pd.isna(t) else int(t), r, x) for t, r, x in zip(g["turn"], g["role"], g["text"], strict=True)]
        f = Facts(rows, g["first"].tolist())
        one = {"conv_id": g["conv_id"].iloc[:1].array, "part": g["part"].iloc[0], "codes": f.codes, "matrix": [matrix(f.codes)], "opens": f.ends[0], "closes": f.ends[1]}
        one |= dict(zip(names, [*f.faults, f.illegal], strict=True)) | dict(zip(("low", "high"), (pd.array([t], "Int64") for t in f.turns[:2]), strict=True)) | {"n_turns": f.turns[2]}
        return pd.DataFrame(one)

    kept = flagged.select("conv_id", "part", "pos", "turn", "role", "text", "first")
    return kept.groupBy("conv_id", "part").applyInPandas(run, f"conv_id {conv}, part long, codes string, matrix array<long>, opens string, closes string, {', '.join(f'{n} long' for n in names)}, low {number}, high {number}, n_turns long")


def ends_of(segs: DataFrame) -> DataFrame:
    """(conv_id, part, ends, counts): the least costs after each segment; the counts of the conversation are with its first one."""
    conv = segs.schema["conv_id"].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("part").reset_index(drop=True)
        ends, v = [], END
        for m in reversed(g["matrix"].tolist()):
            ends.append(list(v))
            v = tuple(min(int(m[4 * s + t]) + v[t] for t in range(4)) for s in range(4))
        joints = [(a, b) not in LEGAL for a, b in zip(g["closes"], g["opens"].iloc[1:], strict=False)]
        some = g[g["low"].notna()]
        low, high = some["low"].tolist(), some["high"].tolist()
        n = int(some["n_turns"].sum()) - sum(a == b for a, b in zip(high, low[1:], strict=False))
        gaps = int(high[-1] - low[0]) + 1 - n if low else 0
        counts = [gaps, *(int(g[c].sum()) for c in ("blank", "duplicate", "truncated")), int(g["illegal"].sum()) + sum(joints), int(v[0])]
        return pd.DataFrame({"conv_id": g["conv_id"], "part": g["part"], "ends": ends[::-1], "counts": [counts] + [None] * (len(g) - 1)})

    return segs.drop("codes").groupBy("conv_id").applyInPandas(run, f"conv_id {conv}, part long, ends array<long>, counts array<long>")


def entered(walks: DataFrame) -> DataFrame:
    """(conv_id, part, state, last): the state at which each segment is entered, and whether it is the last."""
    conv = walks.schema["conv_id"].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g, states, state = g.sort_values("part").reset_index(drop=True), [], 0
        for exits in g["exits"]:
            states.append(state)
            state = int(exits[state])
        return pd.DataFrame({"conv_id": g["conv_id"], "part": g["part"], "state": states, "last": [False] * (len(g) - 1) + [True]})

    return walks.select("conv_id", "part", "exits").groupBy("conv_id").applyInPandas(run, f"conv_id {conv}, part long, state long, last boolean")


def same_segment(a: DataFrame, b: DataFrame) -> DataFrame:
    """a with b's columns where conv_id (null like any other) and part agree."""
    b = b.withColumnsRenamed({"conv_id": "_conv", "part": "_part"})
    return a.join(b, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left").drop("_conv", "_part")


def walked(opened: DataFrame) -> DataFrame:
    """One row for each segment of open conversations: audit of its own, the state it is entered at, counts with the first."""
    segs = cut(segments(opened), "segments")
    joined = same_segment(segs.select("conv_id", "part", "codes"), ends_of(segs))
    wide = T.StructType([*joined.schema.fields, T.StructField("exits", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType()))])

    def run(batches):
        for b in batches:
            exits, audits = [], []
            for codes, end in zip(b.column("codes").to_pylist(), b.column("ends").to_pylist(), strict=True):
                least = costs(codes, tuple(end))
                ways = [walk(codes, least, s) if least[0][s] < NEVER else ("", 0) for s in range(4)]
                exits.append([s for _, s in ways])
                audits.append([a for a, _ in ways])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(exits, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], names=wide.names)

    walks = cut(joined.mapInArrow(run, wide), "walks")
    own = same_segment(walks, entered(walks))
    tail = F.when(F.col("last"), F.element_at(F.array(*[F.lit(closing(s)) for s in range(4)]), (F.col("exits")[F.col("state").cast("int")] + 1).cast("int"))).otherwise("")
    return own.select("conv_id", "part", "counts", "state", F.concat(F.col("audits")[F.col("state").cast("int")], tail).alias("audit"))


def pieces(opened: DataFrame, audits: DataFrame, as_turns: bool) -> DataFrame:
    """The rebuilt turns of each segment, or them as one text."""
    conv, number = (opened.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        rows = [(None if pd.isna(t) else int(t), r, x) for t, r, x in zip(g["turn"], g["role"], g["text"], strict=True)]
        turns = rebuilt(rows, g["audit"].iloc[0], int(g["state"].iloc[0]))
        one = {"conv_id": g["conv_id"].iloc[:1].repeat(len(turns) if as_turns else 1).array, "part": g["part"].iloc[0]}
        if as_turns:
            return pd.DataFrame(one | {"place": range(len(turns)), "edit": [e for e, *_ in turns], "turn": pd.array([t for _, t, *_ in turns], "Int64"), "role": [r for *_, r, _ in turns], "text": [x for *_, x in turns]})
        return pd.DataFrame(one | {"n": len(turns), "piece": lines(turns)})

    live = same_segment(opened.where("not gone").select("conv_id", "part", "pos", "turn", "role", "text"), audits.select("conv_id", "part", "state", "audit"))
    return live.groupBy("conv_id", "part").applyInPandas(run, f"conv_id {conv}, part long, " + (f"place long, edit string, turn {number}, role string, text string" if as_turns else "n long, piece string"))


def hashed(rows: DataFrame) -> DataFrame:
    """conv_id, audit and repaired_sha256 of rows (conv_id, part, audit, n, piece), read in order: one piece is held at a time."""
    conv = rows.schema["conv_id"]
    wide = T.StructType([conv, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        own, digest, audit, any_turn, kind = None, None, [], False, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([own], kind), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=wide.names)

        for b in batches:
            kind = b.column(0).type
            for i in range(b.num_rows):
                k, _, edits, n, piece = (c[i].as_py() for c in b.columns)
                if digest is None or k != own:
                    if digest is not None:
                        yield done()
                    own, digest, audit, any_turn = k, hashlib.sha256(), [], False
                audit.append(edits)
                if n:
                    digest.update(("\n" if any_turn else "").encode() + piece.encode())
                    any_turn = True
        if digest is not None:
            yield done()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "part", "audit", "n", "piece").mapInArrow(run, wide)


def prepared(turns: DataFrame) -> DataFrame:
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    return by_ranges(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone")))


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations turn by turn: conv_id, part and place (which order a conversation's turns), edit (K, R or I), turn (null where inserted), role, text."""
    out = cut(finished_or_open(prepared(turns), True), "turns")
    opened = out.where("pos is not null").select("conv_id", "part", "pos", "turn", "role", "text", "gone")
    names = ("conv_id", "part", "place", "edit", "turn", "role", "text")
    return out.where("pos is null").select(*names).unionByName(pieces(opened, walked(opened), True).select(*names))


def repair_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of turns (conv_id, turn, role, text).

    A null role or text is read as one space; a null turn comes first; turns of one number stand in the order of role and a hash
    of the text. Rows whose `gone` is true only tell that there is such a conversation: one without other rows has zeros, an empty audit and
    the hash of an empty text. A null conv_id is a conversation of its own. Other columns are ignored, an empty input gives an empty result.
    """
    out = cut(finished_or_open(prepared(turns), False), "conversations")
    names = ("conv_id", *COUNTS, "audit", "repaired_sha256")
    opened = out.where("pos is not null").select("conv_id", "part", "pos", "turn", "role", "text", "gone")
    audits = cut(walked(opened), "audits")
    counts = audits.where("counts is not null").select("conv_id", *[F.col("counts")[i].alias(c) for i, c in enumerate(COUNTS)])
    hashes = hashed(same_segment(audits.select("conv_id", "part", "audit"), pieces(opened, audits, False))).withColumnRenamed("conv_id", "_conv")
    whole_rows = counts.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(*names)
    # conversations at the edge of a task all of whose turns are gone have no segment
    nothing = opened.groupBy("conv_id").agg(F.every("gone").alias("none")).where("none").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit("").alias("audit"), F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256"))
    return out.where("pos is null").select(*names).unionByName(whole_rows).unionByName(nothing)


#: The repair of damaged conversations (queries.damaged), row by row: a recursion backward for the costs, one forward for the edits.
SQL = """
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
dealt AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, j: xor(c >> 1, 3988292384 * (c & 1))))) % 20 AS kind
  FROM raw),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
  FROM damaged),
judged AS (
  SELECT conv_id, i, turn, role, text, left(role, 1) AS l,
    CASE WHEN shown = '' THEN 'blank' WHEN min(i) OVER (PARTITION BY conv_id, role, text) < i THEN 'duplicate' WHEN right(shown, 1) IN ('.', '!', '?') THEN 'no' ELSE 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM numbered),
turns AS MATERIALIZED (SELECT *, fault IN ('blank', 'duplicate') AS del, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 ELSE 0 END AS never FROM judged),
sums AS MATERIALIZED (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id),
costs AS (
  SELECT conv_id, n + 1 AS i, 0 AS v0, 6 AS v1, 3 AS v2, 0 AS v3 FROM sums
  UNION ALL
  SELECT conv_id, i, least(x0, 3 + x2, 6 + x3), least(x1, 3 + x2, 6 + x3), least(x2, 3 + x3), least(x3, 3 + x2) FROM (
    SELECT t.conv_id, t.i, least(4 + v0, never + more + least(3 + v2, CASE l WHEN 's' THEN v1 WHEN 'u' THEN v2 ELSE 1000 + v2 END)) AS x0,
      least(4 + v1, never + more + least(3 + v2, CASE l WHEN 'u' THEN v2 ELSE 1000 + v2 END)) AS x1,
      least(4 + v2, never + more + least(3 + v3, CASE l WHEN 'a' THEN v3 ELSE 1000 + v3 END)) AS x2,
      least(4 + v3, never + more + least(3 + v2, CASE l WHEN 'u' THEN v2 ELSE 1000 + v2 END)) AS x3
    FROM costs AS c JOIN turns AS t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.i = c.i - 1) AS x),
least_costs AS MATERIALIZED (SELECT conv_id, i, [v0, v1, v2, v3] AS v FROM costs),
nodes AS MATERIALIZED (
  SELECT a.conv_id, a.i, a.v, b.v AS after, t.role, t.text, t.l, t.del, t.more FROM least_costs AS a
  LEFT JOIN least_costs AS b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = a.i + 1 LEFT JOIN turns AS t ON a.conv_id IS NOT DISTINCT FROM t.conv_id AND a.i = t.i),
walk AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS i, 0 AS st, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM sums
  UNION ALL
  SELECT conv_id, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN st WHEN 'K' THEN keeps ELSE leads END, audit || edit,
    CASE edit WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'I' THEN list_append(lines, given || ':') ELSE list_append(lines, given || ':' || text) END
  FROM (
    SELECT *, CASE WHEN after[st + 1] + 4 = v[st + 1] THEN 'D' WHEN v[leads + 1] + 3 = v[st + 1] THEN 'I' WHEN NOT del AND after[keeps + 1] + more = v[st + 1] THEN 'K' ELSE 'R' END AS edit FROM (
      SELECT w.*, n.v, n.after, n.role, n.text, n.del, n.more, CASE WHEN st = 2 THEN 3 ELSE 2 END AS leads, CASE WHEN st = 2 THEN 'assistant' ELSE 'user' END AS given,
        CASE WHEN n.l = 's' AND st = 0 THEN 1 WHEN n.l = 'u' AND st <> 2 THEN 2 WHEN n.l = 'a' AND st = 2 THEN 3 END AS keeps
      FROM walk AS w JOIN nodes AS n ON w.conv_id IS NOT DISTINCT FROM n.conv_id AND w.i = n.i WHERE n.after IS NOT NULL OR st NOT IN (0, 3)) AS a) AS b)
SELECT c.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
  CAST(coalesce(l.v[1], 0) AS BIGINT) AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN sums AS s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN least_costs AS l ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND l.i = 1
LEFT JOIN walk AS w ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = s.n + 1 AND w.st IN (0, 3)
"""
