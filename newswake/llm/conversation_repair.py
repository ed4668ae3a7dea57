"""Structure repair of conversations: the cheapest edits that make the roles legal.

Roles of a repaired conversation read `(s?(ua)+)?` by their initials. Edits: Keep costs 0, Rerole to
user or assistant 1, Delete 2 (required for blank and duplicate rows), Insert of an empty user or
assistant row 5; a truncated row that is not deleted adds 5. Of equally cheap repairs the one whose
initials, in order, are least in ASCII is taken.

Viterbi over four states (nothing, after s, after u, after a). What a row does is an edit with the
inserts before it, written I*[DKR]; no two different prefixes of as many rows are then prefixes of one
another, so survivors have an order by their complete texts, and with it the next ones have: by the
survivor they come from, then by their own edit. Ties compare this order, which stands for the
complete unresolved suffixes, and never read them anew.

Survivors hang in a tree of back pointers whose nodes count their successors. A node without any is
freed with its ancestors of that kind; when the oldest node has one successor only, all survivors
share it, its edit is emitted and the tree begins there. Memory holds what survivors disagree on.

A conversation of any length is cut: rows are range-sorted and numbered, and blocks of `BLOCK` numbers
are worked on by different tasks. A conversation that crosses blocks gives one small table for each:
costs from state to state and the order of the ways from each state. These are joined front to back
(a row a block), which tells each block its first and last state; then blocks emit their edits. What
goes through the sort is a row's key, its role's initial and its fault; the texts move once, to where
the edits of their conversation are written in order.

Defined results: rows of one turn are ordered by the SHA-256 of role and text; a role that is empty or
begins with another letter than s, u, a can be reroled or deleted; null values are read as one space, a
null conv_id is a conversation of its own; an empty table gives no rows. Given columns other than the
four are not carried.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from newswake.llm.ranks import numbered
from newswake.llm.tables import SPACES, stored

BLOCK = 1 << 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: legal next states by role initial, of the states nothing, after s, after u, after a
STEPS = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
GOOD, BLANK, DUPLICATE, CUT = range(4)
FAULTS = ["", "blank", "duplicate", "truncated"]
NEVER = 1 << 60


def inserts_from(state: int) -> dict[int, int]:
    """States that inserts alone lead to, and how many they take."""
    found, count = {state: 0}, 0
    while True:
        count += 1
        state = next((STEPS[state][i] for i in "ua" if i in STEPS[state]), None)
        if state in found:
            return found
        found[state] = count


def ways(fault: int, initial: str) -> list[list[tuple[int, str, str] | None]]:
    """[from][to] -> the cheapest (cost, edits, new role; empty: the row's own) of one row."""
    out: list[list[tuple[int, str, str] | None]] = [[None] * 4 for _ in range(4)]
    stays = TRUNCATED if fault == CUT else 0
    for start in range(4):
        for state, n in inserts_from(start).items():
            edits = [(state, DELETE, "D", "")]
            if fault in (GOOD, CUT):
                if initial in STEPS[state]:
                    edits.append((STEPS[state][initial], KEEP + stays, "K", ""))
                edits += [(STEPS[state][i], REROLE + stays, "R", NAMES[i]) for i in "ua" if i in STEPS[state]]
            for to, cost, edit, role in edits:
                way = (cost + n * INSERT, "I" * n + edit, role)
                if out[start][to] is None or way[:2] < out[start][to][:2]:
                    out[start][to] = way
    return out


WAYS = {(fault, initial): ways(fault, initial) for fault in range(4) for initial in ("s", "u", "a", "")}
ENDING = [min((n * INSERT, "I" * n) for state, n in inserts_from(s).items() if state in ENDS) for s in range(4)]


#: What it costs at most to go on from the first state as an optimal way goes on from the second: a
#: missing row is inserted, a kept s is deleted. A survivor dearer than that than another cannot win.
BRIDGES = [(3, 0, DELETE), (3, 1, 0), (3, 2, INSERT), (2, 3, INSERT), (2, 1, INSERT), (2, 0, INSERT + DELETE)]


def without_losers(survivors: list) -> list:
    out = list(survivors)
    for good, bad, bridge in BRIDGES:
        if survivors[good] and survivors[bad] and survivors[good][0] + bridge < survivors[bad][0]:
            out[bad] = None
    return out


class Node:
    """An edit of the back-pointer tree; the root has none."""
    __slots__ = ("parent", "edit", "role", "kids")

    def __init__(self, parent, edit, role):
        self.parent, self.edit, self.role, self.kids = parent, edit, role, []


def advance(survivors: list, row: tuple[int, str], tree: bool) -> list:
    """The best survivor of each state after a row: (cost, order among survivors, node)."""
    table, best = WAYS[row], []
    for to in range(4):
        found = None
        for start, survivor in enumerate(survivors):
            if survivor is None or table[start][to] is None:
                continue
            cost, edit, role = table[start][to]
            key = (survivor[0] + cost, survivor[1], edit)
            if found is None or key < found[0]:
                found = (key, survivor[2], role)
        best.append(found)
    order = {f[0][1:]: n for n, f in enumerate(sorted((f for f in best if f), key=lambda f: f[0][1:]))}
    after = []
    for f in best:
        if f is None:
            after.append(None)
            continue
        (cost, above, edit), node, role = f
        if tree:
            kid = Node(node, edit, role)
            node.kids.append(kid)
            node = kid
        after.append((cost, order[above, edit], node))
    return after


def free(nodes: list[Node]) -> None:
    """Drop former survivors that nothing follows, and ancestors that only led to them."""
    for node in nodes:
        while node.parent is not None and not node.kids:
            above, node.parent = node.parent, None
            above.kids.remove(node)
            node = above


def transfer(rows: list[tuple[int, str]]) -> tuple[list[list[int]], list[list[int]]]:
    """Costs and orders from each state to each over a stretch of rows."""
    costs, orders = [], []
    for start in range(4):
        survivors = [(0, 0, None) if s == start else None for s in range(4)]
        for row in rows:
            survivors = advance(survivors, row, tree=False)
        costs.append([NEVER if s is None else s[0] for s in survivors])
        orders.append([0 if s is None else s[1] for s in survivors])
    return costs, orders


def finish(survivors: list) -> int:
    """The state whose survivor ends best: by cost, then by the whole of its edits."""
    return min((s for s in range(4) if survivors[s] is not None),
               key=lambda s: (survivors[s][0] + ENDING[s][0], survivors[s][1]))


def edits_of(rows: Iterator[tuple[int, str]], start: int = 0, last: int | None = None) -> Iterator[tuple[str, str, str]]:
    """(edits, new role, edits at the end) of each row from a first state to a last one; without a
    last state, to the best ending. Yields as survivors come to share their past."""
    root = Node(None, "", "")
    survivors: list = [(0, 0, root) if s == start else None for s in range(4)]
    for row in rows:
        old = [s[2] for s in survivors if s is not None]
        after = advance(survivors, row, tree=True)
        survivors = without_losers(after)
        free([*old, *(a[2] for a, s in zip(after, survivors) if a is not None and s is None)])
        while len(root.kids) == 1 and root.kids[0].kids:
            root = root.kids[0]
            root.parent = None
            yield root.edit, root.role, ""
    state = finish(survivors) if last is None else last
    path, node = [], survivors[state][2]
    while node is not root:
        path.append(node)
        node = node.parent
    for node in reversed(path):
        yield node.edit, node.role, ENDING[state][1] if last is None and node is path[0] else ""


def space(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))


def damaged(df: DataFrame) -> DataFrame:
    """The rows after the damage that crc32(`conv_id:turn`) % 20 decides."""
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    hurt = df.select("conv_id", "turn", kind.alias("kind"), space("role").alias("role"), space("text").alias("text"))
    hurt = hurt.filter("kind <> 0").select(
        "conv_id", "turn", "kind", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"))
    return hurt.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1)))
                                             .otherwise(F.array(F.lit(0))))).drop("copy", "kind")


def conv_key() -> Column:
    return F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("conv")


def keyed(df: DataFrame) -> DataFrame:
    """conv, turn, key (of role and text), role, text."""
    whole = F.sha2(F.concat(F.octet_length(space("role")).cast("string"), F.lit(":"), space("role"), space("text")), 256)
    return df.select(conv_key(), F.col("turn").cast("long").alias("turn"), F.unhex(whole).alias("key"),
                     space("role").alias("role"), space("text").alias("text"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Every row in order: rank, conv, turn, key, initial, fault."""
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    initial = F.substring("role", 1, 1)
    narrow = rows.select("conv", "turn", "key", F.when(initial.isin("s", "u", "a"), initial).otherwise("").alias("initial"),
                         F.when(last == "", BLANK).when(last.isin(".", "!", "?"), GOOD).otherwise(CUT).alias("own"))
    # equal rows may stand in any order: their place in the input spreads them over tasks
    spread = narrow.withColumn("tie", F.monotonically_increasing_id())
    order = numbered(spread, F.col("conv"), F.asc_nulls_first("turn"), F.col("key"), F.col("tie"))
    # a row's number is its own, so neither a long conversation nor a common text makes a hot key
    first = order.groupBy("conv", "key").agg(F.min("rank").alias("rank")).select("rank", F.lit(True).alias("is_first"))
    fault = F.when(F.col("own") == BLANK, BLANK).when(F.col("is_first").isNull(), DUPLICATE).otherwise(F.col("own"))
    return order.join(first, "rank", "left").select("rank", "conv", "turn", "key", "initial", fault.alias("fault"))


def _pieces(frame: pd.DataFrame) -> Iterator[tuple[str, int, int]]:
    """(conv, first place, place after the last) of each conversation in a frame in order."""
    conv = frame["conv"].to_numpy()
    cuts = [0, *(np.flatnonzero(conv[1:] != conv[:-1]) + 1).tolist(), len(conv)]
    for a, b in itertools.pairwise(cuts):
        yield conv[a], a, b


def _rows_of(frame: pd.DataFrame, a: int, b: int) -> list[tuple[int, str]]:
    return list(zip(frame["fault"].iloc[a:b].tolist(), frame["initial"].iloc[a:b].tolist()))


TRANSFER = "conv string, block long, costs array<long>, orders array<long>"
PLAN = "block long, conv string, start int, last int"


def _transfers(frame: pd.DataFrame) -> pd.DataFrame:
    """Tables of the first and the last conversation of a block: the others lie within it."""
    frame = frame.sort_values("rank", ignore_index=True)
    pieces, block = list(_pieces(frame)), int(frame["block"].iloc[0])
    out = []
    for conv, a, b in dict.fromkeys((pieces[0], pieces[-1])):
        costs, orders = transfer(_rows_of(frame, a, b))
        out.append((conv, block, sum(costs, []), sum(orders, [])))
    return pd.DataFrame(out, columns=["conv", "block", "costs", "orders"])


def _joined(frame: pd.DataFrame) -> pd.DataFrame:
    """First and last state of a conversation in each of its blocks (last -1: the best ending)."""
    frame = frame.sort_values("block", ignore_index=True)
    survivors: list = [(0, 0), None, None, None]
    came = []
    for costs, orders in zip(frame["costs"], frame["orders"]):
        best = []
        for to in range(4):
            found = [(s[0] + costs[start * 4 + to], s[1], orders[start * 4 + to], start)
                     for start, s in enumerate(survivors) if s is not None and costs[start * 4 + to] < NEVER]
            best.append(min(found, default=None))
        order = {f[1:3]: n for n, f in enumerate(sorted((f for f in best if f), key=lambda f: f[1:3]))}
        came.append([None if f is None else f[3] for f in best])
        survivors = [None if f is None else (f[0], order[f[1:3]]) for f in best]
    state, last, plan = finish(survivors), -1, []
    for at in range(len(came) - 1, -1, -1):
        start = came[at][state]
        plan.append((int(frame["block"].iloc[at]), frame["conv"].iloc[at], start, last))
        state = last = start
    return pd.DataFrame(plan, columns=["block", "conv", "start", "last"])


EDITS = "conv string, turn long, known boolean, key binary, rank long, edits string, new_role string, fault int"


def _edited(frame: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("rank", ignore_index=True)
    states = {p.conv: (p.start, p.last) for p in plan.itertuples()}
    edits, roles = [], []
    for conv, a, b in _pieces(frame):
        start, last = states.get(conv, (0, -1))
        for edit, role, ending in edits_of(iter(_rows_of(frame, a, b)), start, None if last < 0 else last):
            edits.append(edit + ending)
            roles.append(role)
    out = frame[["conv", "turn", "known", "key", "rank", "fault"]].copy()
    out["edits"], out["new_role"] = edits, roles
    return out[["conv", "turn", "known", "key", "rank", "edits", "new_role", "fault"]]


def decisions(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The edits of every row: I* before it, its own D, K or R, I* after the last of a conversation."""
    faulty = stored(with_faults(rows).select(
        "conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("known"), "key", "rank",
        "initial", "fault", F.floor(F.col("rank") / block).cast("long").alias("block")))
    narrow = faulty.select("conv", "rank", "initial", "fault", "block")
    plan = (narrow.groupBy("block").applyInPandas(_transfers, TRANSFER)
            .groupBy("conv").applyInPandas(_joined, PLAN))
    return faulty.groupBy("block").cogroup(plan.groupBy("block")).applyInPandas(_edited, EDITS)


OUT = ("conv string, place long, turn long, known boolean, fault int, edit string, given_role string, "
       "role string, text string")
START = -1


def _written(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts and edits of conversations in order. Rows of one key are equal, so their text is held
    once and written for each of their edits."""
    conv, place, state, role, text = None, 0, 0, "", ""
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            if r.kind == 0:
                conv, place, state = r.conv, 0, 0
                out.append((conv, START, 0, False, GOOD, "", "", "", ""))
            elif r.kind == 1:
                role, text = r.role, r.text
            else:
                own = r.new_role or role
                for edit in r.edits:
                    if edit == "I":
                        made = "a" if state == 2 else "u"
                        row = (conv, place, 0, False, GOOD, edit, "", NAMES[made], "")
                        state = STEPS[state][made]
                    else:
                        row = (conv, place, r.turn, r.known, r.fault, edit, role, own, text)
                        state = state if edit == "D" else STEPS[state][own[0]]
                    out.append(row)
                    place += 1
        yield pd.DataFrame(out, columns=["conv", "place", "turn", "known", "fault", "edit", "given_role", "role", "text"])


def _in_order(rows: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """Every edit with its row, conversations whole and in order inside a task, which streams them."""
    none = {"turn": "long", "known": "boolean", "key": "binary", "rank": "long", "role": "string", "text": "string",
            "edits": "string", "new_role": "string", "fault": "int"}
    names = ["conv", "kind", *none]
    starts = convs.select("conv", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("turn"),
                          F.lit(False).alias("known"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()
                                                         if c not in ("turn", "known")])
    texts = rows.select("conv", F.lit(1).alias("kind"), F.coalesce("turn", F.lit(0)).alias("turn"),
                        F.col("turn").isNotNull().alias("known"), "key", F.lit(0).cast("long").alias("rank"), "role", "text",
                        *[F.lit(None).cast(none[c]).alias(c) for c in ("edits", "new_role", "fault")])
    made = decisions(rows, block).select("*", F.lit(2).alias("kind"), *[F.lit(None).cast("string").alias(c)
                                                                       for c in ("role", "text")])
    union = starts.select(*names).union(texts.select(*names)).union(made.select(*names))
    order = union.withColumn("head", F.col("kind") > 0)
    whole = F.coalesce("turn", F.lit(0)), F.coalesce("rank", F.lit(0)), F.coalesce("fault", F.lit(0))
    order = order.withColumns({"turn": whole[0], "rank": whole[1], "fault": whole[2]})
    return (order.repartition("conv").sortWithinPartitions("conv", "head", "known", "turn", "key", "kind", "rank")
            .select("conv", "kind", "turn", "known", "role", "text", "edits", "new_role", "fault")
            .mapInPandas(_written, OUT))


def _conversations(df: DataFrame) -> DataFrame:
    return df.select(conv_key()).distinct()


def _named(out: DataFrame, df: DataFrame) -> DataFrame:
    """conv_id of its own type in place of the key."""
    kind = df.schema["conv_id"].dataType
    given = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(kind)
    return out.select(given.alias("conv_id"), *[c for c in out.columns if c != "conv"])


def repair(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row an edit, in order of `place` within its conversation: conv_id, place, turn, fault, edit
    (K, R, D or I), given_role, role, text. Deleted rows are there with their edit."""
    out = _in_order(keyed(df), _conversations(df), block).filter(F.col("place") > START)
    fault = F.array(*[F.lit(f) for f in FAULTS])[F.col("fault")]
    return _named(out.select(
        "conv", "place", F.when(F.col("known"), F.col("turn")).alias("turn"), fault.alias("fault"), "edit",
        F.when(F.col("edit") != "I", F.col("given_role")).alias("given_role"), "role", "text"), df)


class Digest:
    """What is reported of a conversation, a row at a time; holds its edits, never its texts."""

    def __init__(self, conv: str):
        self.conv, self.cost, self.audit, self.sha, self.first = conv, 0, [], hashlib.sha256(), True
        self.least = self.most = None
        self.turns = self.illegal = 0
        self.faults, self.before = [0] * 4, None

    def add(self, r) -> None:
        self.audit.append(r.edit)
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[r.edit]
        if r.edit != "I":
            self.faults[r.fault] += 1
            self.cost += TRUNCATED if r.fault == CUT and r.edit != "D" else 0
            if r.known:
                self.least = r.turn if self.least is None else self.least
                self.turns += r.turn != self.most
                self.most = r.turn
            initial = r.given_role[:1]
            self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
            self.before = initial
        if r.edit != "D":
            self.sha.update(f"{'' if self.first else chr(10)}{r.role}:{r.text}".encode())
            self.first = False

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv, min(gaps, (1 << 63) - 1), *self.faults[1:], self.illegal, self.cost, "".join(self.audit),
                self.sha.hexdigest())


REPORT = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")


def _reported(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in REPORT.split(", ")]
    current = None
    for frame in frames:
        done = []
        for r in frame.itertuples(index=False):
            if r.place == START:
                if current is not None:
                    done.append(current.row())
                current = Digest(r.conv)
            else:
                current.add(r)
        yield pd.DataFrame(done, columns=columns)
    if current is not None:
        yield pd.DataFrame([current.row()], columns=columns)


def report(df: DataFrame, originals: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Per conversation of `originals` (default: of the rows): conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256. A conversation without rows has zeros, an empty
    audit and the hash of the empty text. One hash goes over a whole conversation, so one task reads
    its rows, in order and without holding them."""
    originals = df if originals is None else originals
    ordered = _in_order(keyed(df), _conversations(originals), block)
    return _named(ordered.mapInPandas(_reported, REPORT), originals)
