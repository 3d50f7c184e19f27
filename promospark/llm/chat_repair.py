"""Conversation structure repair by auction shortest paths.

A conversation's rows, in order, span a lattice: node (i, state) has consumed i rows and
emitted roles that stand in ``state`` of the pattern ``(s?(ua)+)?``. Arcs are edits with
integer costs: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty turn 5;
keeping or reroling a truncated row costs 5 more, and blank or duplicate rows can only be
deleted.

Prices are found by the auction algorithm, with every node as an origin, from the last
layer to the first: a path grows from the origin along its best arc (extension); where
the best arc is dearer than the end node's price, the price is raised to it and the path
gives the node up (contraction). Prices never exceed an arc's cost plus the price of its
head, so a path that meets a converged node is shortest and converges too. Arcs whose
cost equals the fall of price are tight: the cheapest repairs are just the paths of
tight arcs, of which the one with the least edit initials is traced.

Long conversations are cut into segments that are solved in parallel: the prices between
each state at a segment's start and end combine to the prices at its boundaries, and for
each state at its start a segment is traced; the chosen states are then passed along
those few rows. Only the last step, whose SHA-256 is sequential, streams a conversation's
rows through one task, without gathering them; it holds the audit, a character per edit.

Order and defined results: rows stand by turn (nulls first), then role, then text; null
roles and texts count as one space, and a role that begins with none of s, u, a (or is
empty) can't be kept. Equal rows are duplicates of the first one. Null conversation ids
are one conversation. A conversation without rows has zeros, an empty audit and the hash
of the empty string. An empty table gives no row; other columns are not read; texts are
read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promospark.llm.common import cut, ship_package

#: White space of blank texts, sentence ends, legal neighbours.
SPACES = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = ".!?"
LEGAL = {"su", "ua", "au"}
DELETE, INSERT, KEEP, REROLE = 2, 5, 0, 1
TRUNCATED = 5

#: States of the emitted roles: none yet, after the system turn, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or reroled turn leads to.
NEXT = [USER, USER, ASSISTANT, USER]
#: The states that can follow each state.
REACHED = [(START, SYSTEM, USER, ASSISTANT), (SYSTEM, USER, ASSISTANT), (USER, ASSISTANT), (USER, ASSISTANT)]
#: Prices at a conversation's end: what is missing is inserted.
END_PRICES = [0, 2 * INSERT, INSERT, 0]
END_EDITS = ["", "ua", "a", ""]
#: Beyond any price.
FAR = 1 << 50
#: Rows of a segment.
SEGMENT = 4096
#: Rows after which a task hands on what it has.
ROWS_AT_ONCE = 100_000

#: A row's code is its initial's place in ``INITIALS`` and its fault's in ``FAULTS``.
INITIALS, FAULTS = "suax", ("none", "truncated", "duplicate", "blank")


def _code_arcs(code: int) -> list[list[tuple[str, int, int, int]]]:
    """For each state the arcs (edit, cost, rows consumed, state), by their edits' initials.

    Edits: D, K, inserted turns as u and a, reroled ones as U and A.
    """
    initial, fault = INITIALS[code // len(FAULTS)], FAULTS[code % len(FAULTS)]
    kept = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}[initial]
    more = TRUNCATED if fault == "truncated" else 0
    arcs = []
    for state in range(4):
        role = "a" if NEXT[state] == ASSISTANT else "u"
        own = [("D", DELETE, 1, state), (role, INSERT, 0, NEXT[state])]
        if fault in ("none", "truncated"):
            if state in kept:
                own.append(("K", KEEP + more, 1, kept[state]))
            own.append((role.upper(), REROLE + more, 1, NEXT[state]))
        arcs.append(own)
    return arcs


ARCS = [_code_arcs(code) for code in range(len(INITIALS) * len(FAULTS))]


def auction_prices(codes: bytes, exits: list[int]) -> list[list[int]]:
    """Prices of the nodes of every layer; those of the last one are ``exits``.

    A layer's prices start at the least one that its states could reach in the next
    layer: never above an arc's cost plus the price of its head.
    """
    prices = [exits]
    for code in reversed(codes):
        arcs, beyond = ARCS[code], prices[-1]
        own = [min([beyond[to] for to in REACHED[state]]) for state in range(4)]
        converged = [price >= FAR for price in own]
        for origin in range(4):
            path = [origin]
            while not converged[path[-1]]:
                state = path[-1]
                least, head = FAR * 4, -1
                for _, cost, step, to in arcs[state]:
                    level = cost + (beyond[to] if step else own[to])
                    if level < least:
                        least, head = level, (-1 if step else to)
                if own[state] < least:  # contraction
                    own[state] = least
                    if len(path) > 1:
                        path.pop()
                elif head < 0:  # extension to the next layer, which has converged
                    break
                else:
                    path.append(head)
            for state in path:
                converged[state] = True
        prices.append(own)
    prices.reverse()
    return prices


def tight_path(codes: bytes, prices: list[list[int]], state: int) -> tuple[list[str], int]:
    """Each row's edits, inserted turns before its own, on the least path of tight arcs, and its last state."""
    out = []
    for layer, code in enumerate(codes):
        edits, own, beyond = "", prices[layer], prices[layer + 1]
        while True:
            for edit, cost, step, to in ARCS[code][state]:
                if own[state] == cost + (beyond[to] if step else own[to]):
                    break
            edits, state = edits + edit, to
            if step:
                break
        out.append(edits)
    return out, state


def distances(codes: bytes) -> list[int]:
    """Cost from each state at the start to each at the end, row by row."""
    ends = [auction_prices(codes, [0 if to == end else FAR for to in range(4)])[0] for end in range(4)]
    return [min(ends[end][start], FAR) for start in range(4) for end in range(4)]


# ---------------------------------------------------------------------------
# Rows


def damaged(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text of ``chats`` with faults planted by a checksum of conversation and turn.

    Of 20 rows one each is dropped, emptied, robbed of its sentence ends, repeated and said by the user.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled(conv_col), F.lit(":"), filled(turn_col)).cast("binary")) % 20
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", SENTENCE_ENDS, ""))
            .otherwise(F.col("text")))
    return (chats.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), filled(role_col).alias("role"),
                         filled(text_col).alias("text"), kind.alias("kind")).where("kind <> 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


def _in_order(rows: DataFrame) -> DataFrame:
    """``rows`` with their places in the order of all; equal rows are dealt out by where they were read."""
    numbered = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                           F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("read"))
    order = ["conv_id", "turn", "role", "text", "read"]
    ranged = numbered.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ranged.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("place")))


def _coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, place, code of ordered rows."""
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    marked = rows.select("conv_id", "turn", "place", F.substring("role", 1, 1).alias("initial"),
                         F.rtrim("text", F.lit(SPACES)).alias("said"), digest.alias("digest"))
    marked = marked.select("conv_id", "turn", "place", "initial", "digest", F.substring("said", -1, 1).alias("last"))
    firsts = (marked.groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("same"))
              .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"))
    joined = marked.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left")
    fault = (F.when(F.col("last") == "", FAULTS.index("blank"))
             .when(F.col("place") > F.col("first"), FAULTS.index("duplicate"))
             .when(~F.col("last").isin(*SENTENCE_ENDS), FAULTS.index("truncated")).otherwise(0))
    initial = F.coalesce(*(F.when(F.col("initial") == c, F.lit(k)) for k, c in enumerate("sua")), F.lit(INITIALS.index("x")))
    return cut(joined.select("conv_id", "turn", "place", (initial * len(FAULTS) + fault).cast("int").alias("code")))


SEGMENTS = "conv_id {0}, start bigint, whole boolean, codes binary, distances array<bigint>"


def _segmenter(size: int):
    """Segments of rows that stand in order, ``start`` being the place of the first and the others behind it.

    ``whole`` ones are all of their conversation. That isn't known at a task's ends, where more rows
    may stand in the next task, nor of conversations longer than ``size``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, held = None, [], 0
        conv, codes, start, begun = None, bytearray(), 0, False

        def close(whole: bool) -> None:
            own = bytes(codes)
            rows.append((conv, start, whole, own, None if whole else distances(own)))
            codes.clear()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("start", pa.int64()), ("whole", pa.bool_()),
                                    ("codes", pa.binary()), ("distances", pa.list_(pa.int64()))])
            for own, place, code in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "code"))):
                if codes and own != conv:
                    close(begun)
                    begun = True
                elif codes and (len(codes) >= size or place != start + len(codes)):
                    close(False)
                    begun = False
                if not codes:
                    conv, start = own, place
                codes.append(code)
            held += batch.num_rows
            if rows and held >= ROWS_AT_ONCE:
                yield flush()
                rows, held = [], 0
        if codes:
            close(False)
        if rows:
            yield flush()
    return run


def _exit_prices(segments: pd.DataFrame) -> pd.DataFrame:
    """Prices at the ends of one conversation's segments, from its last one backwards."""
    segments = segments.sort_values("start", ascending=False)
    prices, out = END_PRICES, []
    for d in segments["distances"]:
        out.append(prices)
        prices = [min(int(d[4 * s + e]) + prices[e] for e in range(4)) for s in range(4)]
    return pd.DataFrame({"start": segments["start"], "exits": out, "final": [k == 0 for k in range(len(out))]})


def _entry_states(segments: pd.DataFrame) -> pd.DataFrame:
    """The states at the starts of one conversation's segments, from its first one on."""
    segments = segments.sort_values("start")
    state, out = START, []
    for ends in segments["ends"]:
        out.append(state)
        state = int(ends[state])
    return pd.DataFrame({"start": segments["start"], "entry": out})


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states in which the tight paths from each segment's four starting states end."""
    for batch in batches:
        ends = []
        for row in batch.to_pylist():
            prices = auction_prices(row["codes"], row["exits"])
            ends.append([tight_path(row["codes"], prices, state)[1] for state in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column("start"), pa.array(ends, pa.list_(pa.int32()))], names=["start", "ends"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and edits of the segments' rows."""
    for batch in batches:
        places, edits = [], []
        for row in batch.to_pylist():
            own, state = tight_path(row["codes"], auction_prices(row["codes"], row["exits"]), row["entry"])
            if row["final"]:
                own[-1] += END_EDITS[state]
            places += range(row["start"], row["start"] + len(own))
            edits += own
            if len(places) >= ROWS_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(edits, pa.string())], names=["place", "edits"])
                places, edits = [], []
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(edits, pa.string())], names=["place", "edits"])


def _edits(coded: DataFrame, segment: int) -> DataFrame:
    """(place, edits) of every row."""
    kind = coded.schema["conv_id"].dataType.simpleString()
    segments = cut(coded.select("conv_id", "place", "code").repartitionByRange("place").sortWithinPartitions("place")
                   .mapInArrow(_segmenter(segment), SEGMENTS.format(kind)))
    columns = ["start", "codes", "exits", "final", "entry"]
    whole = segments.where("whole").select(
        "start", "codes", F.array(*map(F.lit, END_PRICES)).cast("array<bigint>").alias("exits"), F.lit(True).alias("final"),
        F.lit(START).alias("entry"))
    parts = segments.where("NOT whole").select("conv_id", "start", "codes", "distances")
    priced = cut(parts.select("conv_id", "start", "distances").groupBy("conv_id")
                 .applyInPandas(_exit_prices, "start bigint, exits array<bigint>, final boolean"))
    parts = parts.drop("distances").join(priced, "start")
    ends = parts.select("start", "codes", "exits").mapInArrow(_ends, "start bigint, ends array<int>")
    entries = (parts.select("conv_id", "start").join(ends, "start").groupBy("conv_id")
               .applyInPandas(_entry_states, "start bigint, entry int"))
    return (whole.unionByName(parts.join(entries, "start").select(*columns))
            .mapInArrow(_traced, "place bigint, edits string"))


def repairs(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, turn, place, role, text, code, edits of every row of ``rows`` (conv_id, turn, role, text).

    ``place`` is the row's in the order of all; ``edits`` are D (deleted), K (kept), U or A
    (reroled to user or assistant), with turns inserted before it, or behind a conversation's
    last row, as u and a.
    """
    ship_package(rows.sparkSession)
    ordered = _in_order(rows)
    coded = _coded(ordered)
    edits = _edits(coded, segment)
    return (ordered.join(coded.select(F.col("place").alias("at"), "code"), F.col("place") == F.col("at")).drop("at")
            .join(edits.withColumnRenamed("place", "at"), F.col("place") == F.col("at")).drop("at"))


def repaired_rows(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, turn, place, line, role, text: the turns that stand after the repair, in order of place and line."""
    edit = F.col("edit")
    role = (F.when(edit.isin("u", "U"), "user").when(edit.isin("a", "A"), "assistant").otherwise(F.col("role")))
    return (repairs(rows, segment).select("conv_id", "turn", "place", "role", "text", F.posexplode(F.split("edits", "")).alias("line", "edit"))
            .where("edit <> 'D' AND edit <> ''")
            .select("conv_id", F.when(~edit.isin("u", "a"), F.col("turn")).alias("turn"), "place", "line", role.alias("role"),
                    F.when(edit.isin("u", "a"), "").otherwise(F.col("text")).alias("text")))


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Chat:
    """What is known of a conversation whose rows have been met so far."""

    def __init__(self):
        self.low = self.high = None
        self.turns = self.illegal = self.cost = 0
        self.faults = dict.fromkeys(FAULTS, 0)
        self.last, self.audit, self.hash, self.lines = "", [], hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        if self.lines:
            self.hash.update(b"\n")
        self.lines += 1
        self.hash.update(f"{role}:{text}".encode())

    def add(self, turn, role: str, text: str, code: int, edits: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        initial, fault = INITIALS[code // len(FAULTS)], FAULTS[code % len(FAULTS)]
        self.faults[fault] += 1
        self.illegal += bool(self.last) and self.last + initial not in LEGAL
        self.last = initial
        self.audit.append(edits)
        for edit in edits:
            if edit in "ua":
                self.cost += INSERT
                self.line("user" if edit == "u" else "assistant", "")
            elif edit == "D":
                self.cost += DELETE
            else:
                self.cost += (KEEP if edit == "K" else REROLE) + (TRUNCATED if fault == "truncated" else 0)
                self.line({"U": "user", "A": "assistant"}.get(edit, role), text)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        audit = "".join(self.audit).translate(str.maketrans("uaUA", "IIRR"))
        return (gaps, *(self.faults[f] for f in ("blank", "duplicate", "truncated")), self.illegal, self.cost, audit,
                self.hash.hexdigest())


def _reporter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of a task; its rows stand in order and are not gathered."""
    conv, chat, done, kind = None, None, [], None

    def flush() -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * len(REPORT), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)],
                                          names=["conv_id", *REPORT, "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for own, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "code", "edits"))):
            if chat is None or own != conv:
                if chat is not None:
                    done.append((conv, *chat.row()))
                conv, chat = own, _Chat()
            chat.add(*row)
        if len(done) >= 10_000:
            yield flush()
            done = []
    if chat is not None:
        done.append((conv, *chat.row()))
        yield flush()


def repair_report(rows: DataFrame, conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The faults, cost, audit and repaired hash of each distinct conv_id of ``conversations``, from its ``rows``."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    found = (repairs(rows, segment).repartition("conv_id").sortWithinPartitions("conv_id", "place")
             .select("conv_id", "turn", "role", "text", "code", "edits")
             .mapInArrow(_reporter, f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in REPORT) + ", audit string, repaired_sha256 string"))
    asked = conversations.select(F.col("conv_id").alias("asked")).distinct()
    return asked.join(found, F.col("asked").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("asked").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in REPORT),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
