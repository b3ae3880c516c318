"""Repair of conversation structure: generalised LR over the role grammar with weighted edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakelake.llm.common import bounded_batches, numbered, own_columns, stored
from quakelake.llm.registry import query

#: Rules of the role grammar: an empty conversation, or perhaps a system turn and then exchanges.
GRAMMAR = (("S", ""), ("S", "E"), ("S", "sE"), ("E", "ua"), ("E", "Eua"))
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: Roles that an edit may write.
WRITTEN = "ua"
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Stacks that a grammar may need; left-recursive rules keep them few.
STACKS = 64
#: Bits of the number of rows in a page, and of the pages that are joined at once.
PAGE_BITS, FAN_BITS = 10, 8

BLANKS = " \t\n\x0b\x0c\r"
#: A row as one letter: four times its role (s, u, a, another) plus its fault.
KINDS = "abcdefghijklmnop"
OK, BLANK, DUPLICATE, CUT = range(4)


# --- the parser ---------------------------------------------------------------------------------


class Parser:
    """An LR automaton and its graph-structured stack.

    A vertex is a state upon another vertex, and equal vertices are one, so stacks share what lies
    below their tops. A vertex whose state can only reduce is reduced at once; otherwise all
    reductions are tried beside the shift. All vertices that the grammar can reach are numbered
    beforehand; 0 is the bottom.
    """

    def __init__(self, grammar: Sequence[tuple[str, str]] = GRAMMAR, terminals: str = "sua") -> None:
        self.grammar = grammar = (("", grammar[0][0]), *grammar)
        self.states: list[frozenset] = [self._closed({(0, 0)})]
        self.goto: list[dict[str, int]] = []
        for state in self.states:
            moves: dict[str, set] = {}
            for r, dot in state:
                if dot < len(grammar[r][1]):
                    moves.setdefault(grammar[r][1][dot], set()).add((r, dot + 1))
            into = {symbol: self._closed(items) for symbol, items in sorted(moves.items())}
            self.states += [s for s in dict.fromkeys(into.values()) if s not in self.states]
            self.goto.append({symbol: self.states.index(s) for symbol, s in into.items()})
        self.vertices: list[tuple[int, int]] = [(0, -1)]
        self.shift: list[dict[str, list[int]]] = []
        for v in range(STACKS + 1):
            if v == len(self.vertices):
                break
            tops = self._reduced(v)
            self.shift.append({c: to for c in terminals if (to := [self._shifted(w, c) for w in tops if c in self.goto[self.vertices[w][0]]])})
        else:
            raise ValueError("the grammar needs unbounded stacks; write its repetitions left-recursive")
        whole = (self.goto[0][grammar[0][1]], 0)
        self.accepting = [any(self.vertices[w] == whole for w in self._reduced(v)) for v in range(len(self.vertices))]

    def _closed(self, items: set) -> frozenset:
        items, open_ = set(items), list(items)
        while open_:
            r, dot = open_.pop()
            right = self.grammar[r][1]
            if dot < len(right):
                new = {(i, 0) for i, (left, _) in enumerate(self.grammar) if left == right[dot]} - items
                items |= new
                open_ += new
        return frozenset(items)

    def _push(self, state: int, below: int) -> int:
        if (state, below) not in self.vertices:
            self.vertices.append((state, below))
        return self.vertices.index((state, below))

    def _complete(self, v: int) -> list[tuple[str, int]]:
        """Rules that end at a vertex, as (left side, vertex below)."""
        out = []
        for r, dot in sorted(self.states[self.vertices[v][0]]):
            if dot == len(self.grammar[r][1]):
                below = v
                for _ in range(dot):
                    below = self.vertices[below][1]
                out.append((self.grammar[r][0], below))
        return out

    def _over(self, left: str, below: int) -> int | None:
        to = self.goto[self.vertices[below][0]].get(left)
        return None if to is None else self._push(to, below)

    def _reduced(self, v: int) -> list[int]:
        """A vertex and all that reductions make of it."""
        seen = [v]
        for w in seen:
            seen += [x for done in self._complete(w) if (x := self._over(*done)) is not None and x not in seen]
        return seen

    def _shifted(self, v: int, terminal: str) -> int:
        v = self._push(self.goto[self.vertices[v][0]][terminal], v)
        while not self.goto[self.vertices[v][0]] and len(done := self._complete(v)) == 1:
            over = self._over(*done[0])
            if over is None:
                break
            v = over
        return v


# --- edits --------------------------------------------------------------------------------------


class Step(NamedTuple):
    """One row's edit: vertex reached, cost, audit letters, inserted roles before it, edit, role written."""

    to: int
    cost: int
    audit: str
    before: str
    edit: str
    role: str


def _inserted(parser: Parser) -> list[dict[int, str]]:
    """Per vertex the cheapest roles whose insertion leads to each other vertex."""
    out = []
    for v in range(len(parser.vertices)):
        reach, open_ = {v: ""}, [v]
        while open_:
            at = open_.pop(0)
            for c in WRITTEN:
                for to in parser.shift[at].get(c, []):
                    if to not in reach:
                        reach[to] = reach[at] + c
                        open_.append(to)
        out.append(reach)
    return out


@lru_cache(1)
def machine() -> tuple[dict[str, list[dict[int, Step]]], list[dict[int, str]], Parser]:
    """Per kind of row and vertex the best step to each vertex: inserts, then the row's own edit."""
    parser = Parser()
    inserts = _inserted(parser)
    table = {}
    for code, kind in enumerate(KINDS):
        initial, fault = "sua?"[code // 4], code % 4
        rows = []
        for v in range(len(parser.vertices)):
            best: dict[int, Step] = {}
            for via, before in inserts[v].items():
                edits = [("D", "", via, DELETE)]
                if fault in (OK, CUT):
                    extra = TRUNCATED if fault == CUT else 0
                    shift = parser.shift[via]
                    edits += [("K", "", to, extra) for to in shift.get(initial, [])]
                    edits += [("R", c, to, REROLE + extra) for c in WRITTEN for to in shift.get(c, [])]
                for edit, role, to, cost in edits:
                    step = Step(to, cost + INSERT * len(before), "I" * len(before) + edit, before, edit, role)
                    if to not in best or step[1:3] < best[to][1:3]:
                        best[to] = step
            rows.append(best)
        table[kind] = rows
    return table, inserts, parser


def walk(tables: Iterable, entry: int, key):
    """Carry the frontier through the tables: per vertex reached the least (cost, audit), and the way back.

    ``tables[i][v]`` lists ``(vertex, cost, key)``; stacks that meet in one vertex are merged. Keys
    are compared as one long audit. Every key ends with the letter of an edit on a row, so of two
    audits over the same rows none begins the other, and the lesser prefix stays the lesser.
    """
    best, back = {entry: (0, key)}, []
    for table in tables:
        following, came = {}, {}
        for v, (cost, so_far) in best.items():
            for w, c, k in table[v]:
                old = following.get(w)
                if old is None or cost + c < old[0] or cost + c == old[0] and so_far + k < old[1]:
                    following[w], came[w] = (cost + c, so_far + k), v
        best = following
        back.append(came)
    return best, back


def route(back: list[dict[int, int]], end: int) -> list[tuple[int, int]]:
    """(from, to) in each table on the way to ``end``."""
    out = []
    for came in reversed(back):
        out.append((came[end], end))
        end = came[end]
    return out[::-1]


def ending(best: dict, inserts: list[dict[int, str]], accepting: list[bool], letter) -> tuple[int, int, str]:
    """The cheapest accepted end: its vertex, the whole cost and the roles inserted last."""
    ends = [
        (cost + INSERT * len(tail), audit + letter * len(tail), v, tail)
        for v, (cost, audit) in best.items()
        for to, tail in inserts[v].items()
        if accepting[to]
    ]
    cost, _, v, tail = min(ends)
    return v, cost, tail


def _letters(kinds: str):
    table, _, _ = machine()
    return [[[(s.to, s.cost, s.audit) for s in row.values()] for row in table[k]] for k in kinds]


def edits(kinds: str, entry: int, end: int | None = None):
    """Edits of consecutive rows between two vertices; without ``end`` to the cheapest accepted one.

    Gives (cost, roles inserted last, steps).
    """
    table, inserts, parser = machine()
    best, back = walk(_letters(kinds), entry, "")
    tail = ""
    if end is None:
        end, cost, tail = ending(best, inserts, parser.accepting, "I")
    else:
        cost = best[end][0]
    return cost, tail, [table[k][v][w] for k, (v, w) in zip(kinds, route(back, end))]


def _ranked(rows: list[dict[int, tuple]]) -> list[list[tuple[int, int, int]]]:
    """Audits replaced by their ranks among all of a page."""
    order = {a: i for i, a in enumerate(sorted({a for row in rows for _, a in row.values()}))}
    return [[(w, cost, order[a]) for w, (cost, a) in sorted(row.items())] for row in rows]


def page_table(kinds: str) -> list[list[tuple[int, int, int]]]:
    """Per entry vertex the (vertex, cost, rank of the audit) that a page of rows leads to."""
    letters = _letters(kinds)
    return _ranked([walk(letters, v, "")[0] for v in range(len(machine()[2].shift))])


def joined_table(tables: list) -> list[list[tuple[int, int, int]]]:
    """The same of several pages in a row."""
    keyed = [[[(w, c, (r,)) for w, c, r in row] for row in t] for t in tables]
    return _ranked([walk(keyed, v, ())[0] for v in range(len(machine()[2].shift))])


# --- Spark ---------------------------------------------------------------------------------------

TABLE = "array<array<struct<to:int,cost:long,rank:int>>>"


def _plain(table) -> list:
    return [[(x["to"], x["cost"], x["rank"]) for x in row] for row in table]


def _structs(table) -> list:
    return [[{"to": w, "cost": c, "rank": r} for w, c, r in row] for row in table]


def _same(*pairs: tuple[str, str]) -> Column:
    test = F.lit(True)
    for a, b in pairs:
        test = test & F.col(a).eqNullSafe(F.col(b))
    return test


def ordered_rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows numbered by ``at`` in the order of (conversation, turn, role, digest of the text), in pages.

    Ranges may end inside a conversation and inside equal rows, so no conversation is one task.
    """
    rows = df.select(
        F.col(f"`{conv}`").alias("c"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    ordered, _ = numbered(rows, ["c", "turn", "role", "digest"], "turns", "at")
    return ordered.withColumn("page", F.shiftright("at", PAGE_BITS))


def _pages(rows: DataFrame) -> DataFrame:
    """One row per conversation and page: the kinds of its rows as letters."""
    bare = F.rtrim("text", F.lit(BLANKS))
    seen = rows.select("c", "page", "at", "role", "digest", (bare == "").alias("blank"), F.right(bare, F.lit(1)).alias("last"))
    first = seen.filter("not blank").groupBy("c", "role", "digest").agg(F.min("at").alias("first")).select("first")
    marked = seen.join(first, F.col("at") == F.col("first"), "left")
    fault = (
        F.when(F.col("blank"), BLANK)
        .when(F.col("first").isNull(), DUPLICATE)
        .when(~F.col("last").isin(".", "!", "?"), CUT)
        .otherwise(OK)
    )
    letter = F.left("role", F.lit(1))
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    kind = F.substring(F.lit(KINDS), initial * 4 + fault + 1, F.lit(1))
    listed = F.sort_array(F.collect_list(F.struct("at", "kind")))
    return marked.withColumn("kind", kind).groupBy("c", "page").agg(
        F.min("at").alias("start"), F.max("at").alias("stop"), F.array_join(F.transform(listed, lambda x: x["kind"]), "").alias("kinds")
    )


def _routes(pages: DataFrame) -> DataFrame:
    """``(c, page, entry, end, tail)`` for conversations of several pages: a tree over their pages.

    Pages become tables from entry to end vertex, up to 256 neighbours are joined into one table,
    and so on until a conversation is one; then the best way is handed down again.
    """
    spark = pages.sparkSession
    kind = pages.schema["c"].dataType

    def leaf(batches):
        for batch in batches:
            made = [_structs(page_table(k)) for k in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, arrow_table)], names=["c", "key", "ways"])

    arrow_table = pa.list_(pa.list_(pa.struct([("to", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())])))
    shape = T.StructType([T.StructField("c", kind), T.StructField("key", T.LongType()), T.StructField("ways", T._parse_datatype_string(TABLE))])
    routed = T.StructType([*shape.fields[:2], T.StructField("entry", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("tail", T.StringType())])

    def join(part: pa.Table) -> pa.Table:
        part = part.sort_by("key")
        made = _structs(joined_table([_plain(t) for t in part["ways"].to_pylist()]))
        return pa.table([part["c"].slice(0, 1), part["parent"].slice(0, 1), pa.array([made], arrow_table)], names=["c", "key", "ways"])

    def top(batches):
        _, inserts, parser = machine()
        for batch in batches:
            ends = []
            for table in batch.column(2).to_pylist():
                best = {w: (c, (r,)) for w, c, r in _plain(table)[0]}
                v, _, tail = ending(best, inserts, parser.accepting, (-1,))
                ends.append((v, tail))
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([0] * n, pa.int32()), pa.array([e for e, _ in ends], pa.int32()), pa.array([t for _, t in ends])],
                names=routed.names,
            )

    def down(part: pa.Table) -> pa.Table:
        part = part.sort_by("key")
        keyed = [[[(w, c, (r,)) for w, c, r in row] for row in _plain(t)] for t in part["ways"].to_pylist()]
        _, back = walk(keyed, part["entry"][0].as_py(), ())
        legs = route(back, part["end"][0].as_py())
        tails = [""] * (len(legs) - 1) + [part["tail"][0].as_py()]
        ends = [pa.array([leg[i] for leg in legs], pa.int32()) for i in (0, 1)]
        return pa.table([part["c"], part["key"], *ends, pa.array(tails)], names=routed.names)

    nodes = stored(pages.select("c", "page", "kinds").mapInArrow(leaf, shape), "ways")
    levels, roots = [nodes], []
    while not nodes.isEmpty():
        merged = nodes.withColumn("parent", F.shiftright("key", FAN_BITS)).groupBy("c", "parent").applyInArrow(join, shape)
        above = stored(merged, "ways")
        several = above.groupBy("c").count().filter("count > 1").select(F.col("c").alias("open"))
        roots.append(above.join(several, _same(("c", "open")), "left_anti").mapInArrow(top, routed))
        nodes = stored(above.join(several, _same(("c", "open")), "left_semi"), "ways")
        levels.append(nodes)
    found = spark.createDataFrame([], routed)
    for at in range(len(roots) - 1, -1, -1):
        given = roots[at].unionByName(found).withColumnsRenamed({"c": "top", "key": "parent"})
        children = levels[at].withColumn("up", F.shiftright("key", FAN_BITS)).join(given, _same(("c", "top"), ("up", "parent")))
        found = stored(children.groupBy("c", "parent").applyInArrow(down, routed), "routes")
    return found.withColumnRenamed("key", "page")


class Repair(NamedTuple):
    """``rows (id, at, place, edit, role, text)`` and ``conversations``, one row per conversation."""

    rows: DataFrame
    conversations: DataFrame


def repair_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> Repair:
    """The cheapest edits that make every conversation follow the role grammar.

    Rows of a conversation are taken by turn (nulls first), then role, then digest of the text.
    Faults: blank, duplicate (role and text seen earlier), truncated; the first counts. Keep is free,
    rerole to user or assistant costs 1, delete 2 and is required for blank and duplicate rows,
    insert of an empty turn 5; a truncated row that stays costs 5 more. Of equally cheap edits the
    ASCII-least audit is taken.

    A generalised LR parser carries a graph-structured stack over the rows; stacks with the same top
    are merged by the least (cost, audit). Conversations are cut into pages of 1,024 rows, each a
    table from the stack at its entry to that at its end; tables are joined as a tree, and the best
    way is handed back to the pages. So a conversation may be of any length: only its audit, one
    letter a row, is ever one value. Texts move twice and never through Python.

    ``rows`` holds every row with its edit (deleted ones too) and the inserted ones; ``at`` and
    ``place`` give the order. ``conversations`` holds the counts ``gaps, blank, duplicate, truncated,
    illegal``, ``cost`` and ``audit``.

    Null roles and texts count as one blank; rows with a null id are one conversation; null turns
    come first and are ignored in gaps. Repeated rows and equal turns are duplicates or plain
    neighbours. Very long texts only move inside Spark. An empty table gives empty results; other
    columns are ignored.
    """
    bounded_batches(df.sparkSession)
    rows = ordered_rows(df, conv_col, turn_col, role_col, text_col)
    pages = stored(_pages(rows), "pages")
    several = pages.groupBy("c").count().filter("count > 1").select(F.col("c").alias("open"))
    alone = pages.join(several, _same(("c", "open")), "left_anti").select(
        "*", F.lit(0).alias("entry"), F.lit(None).cast("int").alias("end"), F.lit("").alias("tail")
    )
    spread = stored(pages.join(several, _same(("c", "open")), "left_semi"), "spread")
    ways = _routes(spread).withColumnsRenamed({"c": "of", "page": "on"})
    spread = spread.join(ways, _same(("c", "of"), ("page", "on"))).select(*alone.columns)
    asked = alone.unionByName(spread)

    kind = pages.schema["c"].dataType
    solved_type = T.StructType(
        [
            T.StructField("c", kind),
            *[T.StructField(n, T.LongType()) for n in ("page", "start", "stop")],
            T.StructField("kinds", T.StringType()),
            T.StructField("cost", T.LongType()),
            *[T.StructField(n, T.StringType()) for n in ("audit", "edits", "roles", "tail")],
            T.StructField("before", T.ArrayType(T.StringType())),
        ]
    )

    def solve(batches):
        once = lru_cache(1 << 14)(edits)
        for batch in batches:
            out = []
            for kinds, entry, end, tail in zip(*[batch.column(i).to_pylist() for i in (4, 5, 6, 7)]):
                cost, last, steps = once(kinds, entry, end)
                tail = tail or last
                cost += INSERT * len(tail) if end is not None else 0
                audit = "".join(s.audit for s in steps) + "I" * len(tail)
                out.append((cost, audit, "".join(s.edit for s in steps), "".join(s.role or "-" for s in steps), tail, [s.before for s in steps]))
            columns = list(zip(*out)) or [[]] * 6
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            made = [pa.array(list(c), t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], *made], names=solved_type.names)

    solved = stored(asked.mapInArrow(solve, solved_type), "edits")

    # One row per edit: those inserted before a row, the row, and those inserted at the end.
    slim = solved.select(F.col("c").alias("of"), F.col("page").alias("on"), "start", "stop", "edits", "roles", "tail", "before")
    place = (F.col("at") - F.col("start")).cast("int")
    edit, role = F.substring("edits", place + 1, F.lit(1)), F.substring("roles", place + 1, F.lit(1))
    name = F.when(role == "u", ROLES["u"]).when(role == "a", ROLES["a"]).otherwise(F.col("role"))

    def added(letters: Column) -> Column:
        split = F.filter(F.split(letters, ""), lambda x: x != "")
        return F.transform(split, lambda x: F.struct(F.lit("I").alias("edit"), F.when(x == "u", ROLES["u"]).otherwise(ROLES["a"]).alias("role"), F.lit("").alias("text")))

    own = F.array(F.struct(edit.alias("edit"), name.alias("role"), F.col("text").alias("text")))
    last = F.when(F.col("at") == F.col("stop"), added(F.col("tail"))).otherwise(F.array().cast("array<struct<edit:string,role:string,text:string>>"))
    listed = F.concat(added(F.get("before", place)), own, last)
    joined = rows.select("c", "page", "at", "role", "text").join(slim, _same(("c", "of"), ("page", "on")))
    result = joined.select(F.col("c").alias(conv_col), "at", F.posexplode(listed).alias("place", "x")).select(
        conv_col, "at", "place", "x.edit", "x.role", "x.text"
    )

    initials = F.translate("kinds", KINDS, "ssssuuuuaaaa????")
    pairs = F.transform(F.sequence(F.lit(1), F.length("kinds")), lambda i: F.substring(initials, i, F.lit(2)))
    inside = F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin(*LEGAL)))

    def faulty(code: int) -> Column:
        wanted = KINDS[code::4]
        return F.length("kinds") - F.length(F.translate("kinds", wanted, ""))

    parts = solved.groupBy("c").agg(
        F.sum(faulty(BLANK)).alias("blank"),
        F.sum(faulty(DUPLICATE)).alias("duplicate"),
        F.sum(faulty(CUT)).alias("truncated"),
        F.sum(inside).alias("inside"),
        F.sum("cost").alias("cost"),
        F.sort_array(F.collect_list(F.struct("page", "audit", F.left(initials, F.lit(1)).alias("first"), F.right(initials, F.lit(1)).alias("final")))).alias("parts"),
    )
    meets = F.zip_with(F.slice("parts", 1, F.size("parts") - 1), F.slice("parts", 2, F.size("parts")), lambda a, b: F.concat(a["final"], b["first"]))
    turns = rows.groupBy("c").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    counts = parts.select(
        F.col("c").alias("of"),
        *[F.col(n).cast("long").alias(n) for n in ("blank", "duplicate", "truncated")],
        (F.col("inside") + F.size(F.filter(meets, lambda p: ~p.isin(*LEGAL)))).cast("long").alias("illegal"),
        "cost",
        F.array_join(F.transform("parts", lambda x: x["audit"]), "").alias("audit"),
    )
    whole_ones = turns.join(counts, _same(("c", "of"))).drop("of").withColumnRenamed("c", conv_col)
    return Repair(result, whole_ones)


def text_digests(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``(id, sha256)`` of every conversation's repaired ``role:text`` lines, joined by newlines.

    The lines of a conversation pass through one task in order, as SHA-256 must read them; nothing of
    them is held.
    """
    lines = rows.filter("edit <> 'D'").select(F.col(conv_col).alias("c"), "at", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    placed = lines.repartition("c").sortWithinPartitions("c", "at", "place").select("c", "line")
    shape = T.StructType([T.StructField("c", placed.schema["c"].dataType), T.StructField("sha256", T.StringType())])

    def digest(batches):
        open_, state = None, None
        for batch in batches:
            done = []
            for c, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or c != open_:
                    if state is not None:
                        done.append((open_, state.hexdigest()))
                    open_, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode())
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([d for _, d in done], pa.string())], names=shape.names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_], kind), pa.array([state.hexdigest()])], names=shape.names)

    return placed.mapInArrow(digest, shape).withColumnRenamed("c", conv_col)


def damaged(df: DataFrame) -> DataFrame:
    """The given conversations with faults set by a checksum of id and turn."""
    key = F.concat_ws(":", *[F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("conv_id", "turn")])
    fault = F.crc32(key) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return df.filter(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


OP11_SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: unicode(c)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS d
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE r END AS r,
    CASE d WHEN 1 THEN '' WHEN 2 THEN translate(t, '.!?', '') ELSE t END AS t
  FROM src, range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
put AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(t)) AS i FROM hurt),
f AS (
  SELECT *, left(r, 1) AS c, CASE WHEN NOT regexp_matches(t, '[^\x20\x09-\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, r, t ORDER BY i) > 1 THEN 'd'
      WHEN regexp_extract(t, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'o' END AS fault
  FROM put),
ins(a, b, w) AS (VALUES (0, 0, ''), (0, 2, 'u'), (0, 3, 'ua'), (1, 1, ''), (1, 2, 'u'), (1, 3, 'ua'), (2, 2, ''), (2, 3, 'a'), (3, 3, ''), (3, 2, 'u')),
sh(a, c, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
said(w, x) AS (VALUES ('', []::VARCHAR[]), ('u', ['user:']), ('a', ['assistant:']), ('ua', ['user:', 'assistant:'])),
e AS (
  SELECT a, b, w, 'D' AS act, NULL::VARCHAR AS c, 2 AS cost FROM ins
  UNION ALL SELECT ins.a, sh.b, w, k.act, sh.c, k.cost FROM ins JOIN sh ON sh.a = ins.b, (VALUES ('K', 0), ('R', 1)) k(act, cost)
  WHERE k.act = 'K' OR sh.c <> 's'),
dp(conv_id, i, st, cost, audit, lines) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM f
  UNION ALL
  SELECT conv_id, i, st, cost, audit, lines FROM (
    SELECT dp.conv_id, f.i, e.b AS st, dp.cost + e.cost + 5 * len(e.w) + CASE WHEN e.act <> 'D' AND f.fault = 't' THEN 5 ELSE 0 END AS cost,
      dp.audit || repeat('I', len(e.w)) || e.act AS audit,
      dp.lines || said.x || CASE e.act WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.r || ':' || f.t]
        ELSE [CASE e.c WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.t] END AS lines
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN e ON e.a = dp.st JOIN said ON said.w = e.w
    WHERE e.act = 'D' OR (f.fault IN ('o', 't') AND (e.act = 'R' OR e.c = f.c)))
  QUALIFY row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) = 1),
done AS (
  SELECT dp.conv_id, dp.cost + 5 * len(t.w) AS cost, dp.audit || repeat('I', len(t.w)) AS audit, dp.lines || said.x AS lines
  FROM dp JOIN (SELECT conv_id, max(i) AS n FROM f GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.n = dp.i
  JOIN (VALUES (0, ''), (1, 'ua'), (2, 'a'), (3, '')) t(st, w) ON t.st = dp.st JOIN said ON said.w = t.w
  QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + 5 * len(t.w), dp.audit || repeat('I', len(t.w))) = 1),
st AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (p || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM f) GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op11_structure_repair", OP11_SQL)
def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every conversation after damage."""
    table = own_columns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), ["conv_id", "turn", "role", "text"])
    repair = repair_conversations(damaged(table))
    digests = text_digests(repair.rows).withColumnRenamed("conv_id", "said")
    found = repair.conversations.withColumnRenamed("conv_id", "of")
    every = table.select("conv_id").distinct()
    joined = every.join(found, _same(("conv_id", "of")), "left").join(digests, _same(("conv_id", "said")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        "conv_id",
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
