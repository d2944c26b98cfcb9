"""Conversation structure repair: the cheapest edits that give a conversation's roles the form (s?(ua)+)?, the ASCII-least of them.

The cost to go from each turn and grammar state is found backward; a forward walk then takes, among the edits that lose nothing of
it, the ASCII-least letter. A letter leads to one state only, so the walk gives the ASCII-least string of all cheapest ones. Edits:
K(eep) 0, R(erole) 3, D(elete) 4, which blank turns and duplicates must be, I(nsert an empty turn) 3; a truncated turn that stays
costs 3 more. States: nothing yet, after s, after u, after a.

Rows are dealt out by ranges of (conv_id, turn). Conversations that lie inside a range are repaired there, in one pass. The first and
last one of each range may go on in the next: their rows are set aside, and each range's part of one becomes a 4 x 4 matrix of costs
(smallest sums), which are multiplied backward, then a map from states to states, which are followed forward; so a conversation
of any length is repaired by as many tasks as ranges it has. Only its hash is taken in one stream, as SHA-256 must be.

Nulls: a null role or text is one space (so such a text is blank), a null turn comes first and counts for no gap, a null conv_id is a
conversation. Ties and repeated rows: see turns.py. No rows: zeros, an empty audit, the hash of nothing. A role's first character is its
initial; an empty role has none and can only be deleted or changed. Extra columns are ignored, an empty table gives no rows."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .turns import conversation_rows, in_turn_order, parts_of

FAR = 1 << 60
NEXT = (2, 2, 3, 2)  # the state after an inserted or changed turn, by the state before it
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
END = (0, 6, 3, 0)  # costs to go when no turn is left
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
_SEEN = re.compile(r"[^\x20\x09-\x0D]")
_CUT = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")

COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"
RESULT = f"conv_id long, {COUNTS}, cost long, audit string, repaired_sha256 string, repaired string"
ASIDE = "name string, part int, i long, turn long, role string, text string, present boolean"


def is_blank(text: str) -> bool:
    return not _SEEN.search(text)


def is_truncated(text: str) -> bool:
    return not _CUT.search(text)


def step_back(after, role: str, fault: int) -> list[int]:
    """Costs to go before a turn, by state, from those after it."""
    costs = [4 + x for x in after]
    if fault not in (BLANK, DUPLICATE):
        more = 3 if fault == TRUNCATED else 0
        for state in range(4):
            costs[state] = min(costs[state], 3 + more + after[NEXT[state]])
            if (state, role) in KEEPS:
                costs[state] = min(costs[state], more + after[KEEPS[state, role]])
    u, a = min(costs[2], 3 + costs[3]), min(costs[3], 3 + costs[2])
    return [min(costs[0], 3 + u), min(costs[1], 3 + u), u, a]


def costs_to_go(roles: list[str], faults: list[int], end=END) -> list:
    out = [list(end)]
    for role, fault in zip(reversed(roles), reversed(faults)):
        out.append(step_back(out[-1], role, fault))
    return out[::-1]


def walk(roles: list[str], faults: list[int], costs: list, state: int = 0, last: bool = True) -> tuple[str, list[int], int]:
    """Edits' letters, for each the state that it leads to, and the last state. last: no turns follow, so the end may need inserts."""
    edits, states = [], []
    for i, (role, fault) in enumerate(zip(roles, faults)):
        more, stays = 3 if fault == TRUNCATED else 0, fault in (OK, TRUNCATED)
        while True:
            here, after = costs[i][state], costs[i + 1]
            if here == 4 + after[state]:
                edit = "D"
            elif here == 3 + costs[i][NEXT[state]]:
                edit, state = "I", NEXT[state]
            elif stays and (state, role) in KEEPS and here == more + after[KEEPS[state, role]]:
                edit, state = "K", KEEPS[state, role]
            else:
                edit, state = "R", NEXT[state]
            edits.append(edit)
            states.append(state)
            if edit != "I":
                break
    while last and costs[-1][state]:
        state = NEXT[state]
        edits.append("I")
        states.append(state)
    return "".join(edits), states, state


def rebuilt(edits: str, states: list[int], rows: list[tuple[str, str]]) -> list[str]:
    """role:text of the turns that the edits leave."""
    out, i = [], 0
    for edit, state in zip(edits, states):
        named = "assistant" if state == 3 else "user"
        if edit == "I":
            out.append(f"{named}:")
            continue
        role, text = rows[i]
        i += 1
        if edit != "D":
            out.append(f"{role if edit == 'K' else named}:{text}")
    return out


def sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def illegal(left: str, right: str) -> bool:
    return left + right not in ("su", "ua", "au")


def repaired(turns: list, rows: list[tuple[str, str]], texts: bool) -> dict:
    """The result of one whole conversation, whose turns' numbers and (role, text) come in order."""
    seen, faults = set(), []
    for row in rows:
        fault = BLANK if is_blank(row[1]) else DUPLICATE if row in seen else TRUNCATED if is_truncated(row[1]) else OK
        seen.add(row)
        faults.append(fault)
    roles = [r[:1] for r, _ in rows]
    known = {t for t in turns if t is not None}
    costs = costs_to_go(roles, faults)
    audit, states, _ = walk(roles, faults, costs)
    lines = rebuilt(audit, states, rows)
    return {"gaps": max(known) - min(known) + 1 - len(known) if known else 0, "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": sum(map(illegal, roles, roles[1:])), "cost": costs[0][0], "audit": audit, "repaired_sha256": sha(lines), "repaired": "\n".join(lines) if texts else None}


def first_pass(texts: bool):
    fields = [("conv_id", pa.int64()), *((x.split()[0], pa.int64()) for x in COUNTS.split(", ")), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("repaired", pa.string())]
    aside = [("name", pa.string()), ("part", pa.int32()), ("i", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("present", pa.bool_())]
    schema = pa.schema([*fields, *aside, ("kind", pa.int32())])

    def run(batches):
        """Whole conversations are repaired; the rows of the partition's first and last one are set aside."""
        held, group, first, out, size = None, [], True, [], 0

        def set_aside():
            for i, (conv, part, turn, role, text, present) in enumerate(group):
                yield {"conv_id": conv, "name": " " if conv is None else str(conv), "part": part, "i": i, "turn": turn, "role": role, "text": text, "present": present, "kind": 1}

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "text", "present"))):
                if group and row[0] != held:
                    if first:
                        out += set_aside()
                    else:
                        there = [r for r in group if r[5]]
                        out.append({"conv_id": held, "kind": 0} | repaired([r[2] for r in there], [(r[3], r[4]) for r in there], texts))
                    first, group = False, []
                held = row[0]
                group.append(row)
                size += len(row[4])
            if size > 4_000_000 or len(out) > 2000:
                yield from pa.Table.from_pylist(out, schema).to_batches(1000)
                out, size = [], 0
        out += set_aside()
        yield from pa.Table.from_pylist(out, schema).to_batches(1000)

    return run


def _segments(pdf):
    """Of one range's part of a conversation: what its neighbours must know of it, and its matrix of costs."""
    import pandas as pd

    pdf = pdf.sort_values("i")
    here = pdf[pdf["present"]]
    roles, faults = list(here["initial"]), [int(x) for x in here["fault"]]
    turns = here["turn"].dropna()
    matrix = [costs_to_go(roles, faults, [0 if k == j else FAR for k in range(4)])[0] for j in range(4)]
    return pd.DataFrame([{"name": pdf["name"].iloc[0], "part": int(pdf["part"].iloc[0]), "n": len(here), "first": roles[0] if roles else None, "last": roles[-1] if roles else None, "low": turns.min() if len(turns) else None, "high": turns.max() if len(turns) else None, "turns": turns.nunique(), "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": sum(map(illegal, roles, roles[1:])), "matrix": [min(FAR, matrix[j][s]) for s in range(4) for j in range(4)]}])


SEGMENT = "name string, part int, n long, first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, matrix array<long>"


def _stitch(pdf):
    """Of one conversation's parts (one row a range): the costs to go at each part's end, and the conversation's counts."""
    import pandas as pd

    pdf = pdf.sort_values("part")
    after, ends = list(END), []
    for matrix in reversed(list(pdf["matrix"])):
        ends.append(after)
        after = [min(FAR, *(int(matrix[4 * s + j]) + after[j] for j in range(4))) for s in range(4)]
    held = pdf[pdf["n"] > 0]
    met = sum(illegal(a, b) for a, b in zip(held["last"], held["first"].iloc[1:]))
    known = held[held["low"].notna()]
    shared = sum(a == b for a, b in zip(known["high"], known["low"].iloc[1:]))
    gaps = int(known["high"].max() - known["low"].min() + 1 - (known["turns"].sum() - shared)) if len(known) else 0
    out = pd.DataFrame({"name": pdf["name"], "part": pdf["part"], "ends": ends[::-1], "final": [False] * (len(pdf) - 1) + [True], "gaps": gaps, "cost": after[0]})
    return out.assign(**{c: int(pdf[c].sum()) for c in ("blank", "duplicate", "truncated")}, illegal=int(pdf["illegal"].sum()) + met)


STITCHED = f"name string, part int, ends array<long>, final boolean, cost long, {COUNTS}"


def _maps(pdf):
    """The state that each state before a part leads to after it."""
    import pandas as pd

    pdf = pdf.sort_values("i")
    here, final = pdf[pdf["present"]], bool(pdf["final"].iloc[0])
    roles, faults = list(here["initial"]), [int(x) for x in here["fault"]]
    costs = costs_to_go(roles, faults, [int(x) for x in pdf["ends"].iloc[0]])
    return pd.DataFrame([{"name": pdf["name"].iloc[0], "part": int(pdf["part"].iloc[0]), "leads": [walk(roles, faults, costs, s, final)[2] if costs[0][s] < FAR else 0 for s in range(4)]}])


def _entries(pdf):
    """The state before each part of a conversation."""
    state, states = 0, []
    pdf = pdf.sort_values("part")
    for leads in pdf["leads"]:
        states.append(state)
        state = int(leads[state])
    return pdf[["name", "part"]].assign(state=states)


def _pieces(pdf):
    """A part's letters and its lines, joined; null where it leaves none."""
    import pandas as pd

    pdf = pdf.sort_values("i")
    here, final = pdf[pdf["present"]], bool(pdf["final"].iloc[0])
    roles, faults = list(here["initial"]), [int(x) for x in here["fault"]]
    costs = costs_to_go(roles, faults, [int(x) for x in pdf["ends"].iloc[0]])
    audit, states, _ = walk(roles, faults, costs, int(pdf["state"].iloc[0]), final)
    lines = rebuilt(audit, states, list(zip(here["role"], here["text"])))
    return pd.DataFrame([{"name": pdf["name"].iloc[0], "part": int(pdf["part"].iloc[0]), "audit": audit, "piece": "\n".join(lines) if lines else None}])


def _joined(texts: bool):
    schema = pa.schema([("name", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("repaired", pa.string())])

    def run(batches):
        """Pieces come by name and part; the hash takes one piece at a time."""
        held, state, lines = None, None, []

        def ended():
            return pa.RecordBatch.from_pylist([{"name": held, "audit": "".join(state[0]), "repaired_sha256": state[1].hexdigest(), "repaired": "\n".join(lines) if texts else None}], schema)

        for batch in batches:
            for name, audit, piece in zip(*(batch.column(c).to_pylist() for c in ("name", "audit", "piece"))):
                if name != held:
                    if state:
                        yield ended()
                    held, state, lines = name, ([], hashlib.sha256(), []), []
                    begun = False
                state[0].append(audit)
                if piece is not None:
                    state[1].update(("\n" if begun else "").encode() + piece.encode())
                    begun = True
                    if texts:
                        lines.append(piece)
        if state:
            yield ended()

    return run


def repair(rows: DataFrame, texts: bool = True, parts: int | None = None) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, and `repaired`, its role:text
    lines (null unless `texts`). rows: conv_id, turn, role, text, and optionally `present`: false for a row that only says that its
    conversation exists."""
    spark = rows.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "repair")
    present = F.coalesce(F.col("present"), F.lit(True)) if "present" in rows.columns else F.lit(True)
    rows = conversation_rows(rows, " ", present.alias("present"))
    ordered = in_turn_order(rows, parts or parts_of(rows))
    passed = scratch.table(ordered.mapInArrow(first_pass(texts), f"{RESULT}, {ASIDE}, kind int"), "passed")
    names = [x.split()[0] for x in RESULT.split(", ")]
    whole = passed.filter("kind = 0").select(*names)

    aside = passed.filter("kind = 1").select("conv_id", "name", "part", "i", "turn", "role", "text", "present").withColumns({"at": F.struct("part", "i"), "same": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")), "blank_": ~F.col("text").rlike(r"[^\x20\x09-\x0D]")})
    # As a table of its own, so that Spark can split the join where one text fills a conversation.
    firsts = scratch.table(aside.filter("present AND NOT blank_").groupBy("name", "same").agg(F.min("at").alias("first_at")), "firsts")
    fault = F.when(F.col("blank_"), BLANK).when(F.col("at") > F.col("first_at"), DUPLICATE).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(OK)
    marked = scratch.table(aside.join(firsts, ["name", "same"], "left").select("conv_id", "name", "part", "i", "turn", "role", "text", "present", fault.alias("fault"), F.substring("role", 1, 1).alias("initial")), "aside")
    light = marked.select("name", "part", "i", "turn", "present", "fault", "initial")
    stitched = scratch.table(light.groupBy("name", "part").applyInPandas(_segments, SEGMENT).groupBy("name").applyInPandas(_stitch, STITCHED), "stitched")
    ends = stitched.select("name", "part", "ends", "final")
    maps = light.join(ends, ["name", "part"]).groupBy("name", "part").applyInPandas(_maps, "name string, part int, leads array<long>")
    states = maps.groupBy("name").applyInPandas(_entries, "name string, part int, state long")
    pieces = marked.join(ends, ["name", "part"]).join(states, ["name", "part"]).groupBy("name", "part").applyInPandas(_pieces, "name string, part int, audit string, piece string")
    joined = pieces.repartition("name").sortWithinPartitions("name", "part").mapInArrow(_joined(texts), "name string, audit string, repaired_sha256 string, repaired string")
    counts = stitched.filter("final").select("name", "cost", *(x.split()[0] for x in COUNTS.split(", ")))
    ids = marked.groupBy("name").agg(F.min("conv_id").alias("conv_id"))
    return whole.unionByName(joined.join(counts, "name").join(ids, "name").select(*names))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with known faults, by crc32 of `conv_id:turn` (a null is one space) modulo 20: 0 drops a row, 1 empties its text, 2 takes
    its . ! ? out, 3 repeats it, 4 makes its role user. Dropped rows stay with present = false."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversation_rows(rows, " ", (F.crc32(key.cast("binary")) % 20).alias("lot"))
    text = F.when(F.col("lot").isin(0, 1), "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("lot") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("lot") != 0).alias("present"), F.explode(copies).alias("copy"))
