"""Repair of conversations at least cost, by a rank-convergence parallel Viterbi search.

A conversation's rows are kept, given another role, deleted or joined by inserted ones,
so that its roles read as an optional system row and then turns of user and assistant. What is cheapest
from a row on depends on one of four states alone, so a row turns a vector of four costs to
go into another. Rows in order are cut into chunks, one a task. Each chunk starts from a
speculative vector at its end and is run again from the vector of the chunk behind it, until
that differs from the one it was run with by a constant only, which changes no
decision; such vectors become parallel within a few rows. The costs stitched so then lead a trace from the front, which takes the
least letter among those that are still cheapest.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_batches, rows_of, width

#: States: nothing yet, after the system row, after a user's, after an assistant's; the last and the first may end.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state that an inserted or renamed row leads to, and the role it gets.
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
#: Costs to go where no row is left.
END = (0, 10, 5, 0)
KEEP, RENAME, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
#: Rows of a block at most, as a power of two: blocks are what chunks are stored as.
BLOCK_BITS = 10
#: What separates words: tab to carriage return, and space.
SPACE = " \t\n\x0b\x0c\r"
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows of conversations as a hash of id and turn damages them; a null role or text is one space.

    Of each twenty parts one loses the row, its text, its marks of a sentence's end, stands twice, or is said by the user.
    """
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    own = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("_h"))
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return own.where("_h <> 0").select("conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_c")).drop("_c")


def before_row(symbol: str, togo: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go of each state in front of a row, from those behind it.

    Symbols: b or d a row that must go (blank, duplicate), else the role's initial (s, u, a, or o for others), in capitals if the text is cut off.
    """
    at = []
    for q in range(4):
        best = DELETE + togo[q]
        if symbol not in "bd":
            more = BROKEN if symbol.isupper() else 0
            best = min(best, RENAME + more + togo[NEXT[q]])
            if (kept := STEP[q].get(symbol.lower())) is not None:
                best = min(best, KEEP + more + togo[kept])
        at.append(best)
    return with_inserts(at)


def with_inserts(at: list[int]) -> tuple[int, ...]:
    """Costs to go if rows may be inserted first."""
    for _ in range(3):
        at = [min(at[q], INSERT + at[NEXT[q]]) for q in range(4)]
    return tuple(at)


class Vectors(dict):
    """(symbol, vector with least cost 0) to the vector in front of the row, its least cost taken off: there are few."""

    def __missing__(self, key: tuple[str, tuple[int, ...]]) -> tuple[int, ...]:
        got = self[key] = level(before_row(*key))
        return got


def level(togo) -> tuple[int, ...]:
    low = min(togo)
    return tuple(x - low for x in togo)


def backward(symbols: str, right: tuple[int, ...], known: Vectors) -> list[tuple[int, ...]]:
    """Costs to go, up to a constant, in front of each row and behind the last."""
    out = [level(right)]
    for symbol in reversed(symbols):
        out.append(known[symbol, out[-1]])
    return out[::-1]


def traced(symbols: str, costs: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, int, int]:
    """(letters, cost, state behind): the cheapest edits from a state, the ASCII-least of equals; ``last`` adds what must be inserted at the end."""
    out, spent = [], 0
    for k, symbol in enumerate(symbols):
        behind, more = costs[k + 1], BROKEN if symbol.isupper() else 0
        while True:
            renamed, kept = NEXT[state], STEP[state].get(symbol.lower())
            options = [(DELETE + behind[state], "D", DELETE, state)]
            if symbol not in "bd":
                options += [(KEEP + more + behind[kept], "K", KEEP + more, kept)] if kept is not None else []
                options.append((RENAME + more + behind[renamed], "R", RENAME + more, renamed))
            # inserting leads to the same gap from another state; its cheapest way on is that state's
            row = min(x[0] for x in options)
            insert, at, paid = None, state, 0
            for _ in range(3):
                at, paid = NEXT[at], paid + INSERT
                o = [DELETE + behind[at]]
                if symbol not in "bd":
                    o += [RENAME + more + behind[NEXT[at]], *([KEEP + more + behind[STEP[at][symbol.lower()]]] if symbol.lower() in STEP[at] else [])]
                insert = min(paid + min(o), insert if insert is not None else paid + min(o))
            best = min(row, insert)
            letter = min([x[1:] for x in options if x[0] == best] + ([("I", INSERT, NEXT[state])] if insert == best else []))
            out.append(letter[0])
            spent += letter[1]
            state = letter[2]
            if letter[0] != "I":
                break
    while last and END[state]:
        out.append("I")
        spent += INSERT
        state = NEXT[state]
    return "".join(out), spent, state


def _blocks(narrow: DataFrame) -> DataFrame:
    """(part, conv_id, block, first, symbols): rows of a conversation in order, some at a time, dealt by ranges of that order. first: order of a block's first row."""
    each = narrow.groupBy("conv_id", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(
        F.min_by(F.struct("turn", "role", "digest"), "pos").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), "").alias("symbols"),
    )
    dealt = each.repartitionByRange(width(narrow.sparkSession), "conv_id", "block").sortWithinPartitions("conv_id", "block")
    return cut(dealt.withColumn("part", F.spark_partition_id()))


class Chunk:
    """What one task holds: blocks of conversations in order, of which the first and last may go on in other tasks."""

    def __init__(self, batches, *more: str):
        self.rows = [r for got in rows_of(batches, "part", "conv_id", "symbols", *more) for r in zip(*got, strict=True)]

    def solved(self, edge: tuple[int, ...], known: Vectors) -> list[list[tuple[int, ...]]]:
        """Costs to go in front of and behind the rows of each block; ``edge``: those behind the last block."""
        out: list = [None] * len(self.rows)
        for k in range(len(self.rows) - 1, -1, -1):
            right = edge if k == len(self.rows) - 1 else out[k + 1][0] if self.rows[k + 1][1] == self.rows[k][1] else END
            out[k] = backward(self.rows[k][2], right, known)
        return out

    def walked(self, costs: list, entry: int, ends: bool) -> list[tuple[str, int, int]]:
        """traced() of each block, from the state in front of the first; ``ends``: the last conversation goes on nowhere else."""
        out, state = [], entry
        for k, (_, conv, symbols, *_) in enumerate(self.rows):
            if k and self.rows[k - 1][1] != conv:
                state = 0
            last = ends if k == len(self.rows) - 1 else self.rows[k + 1][1] != conv
            out.append(traced(symbols, costs[k], state, last))
            state = out[-1][2]
        return out


def _stitched(blocks: DataFrame) -> tuple[dict[int, tuple[int, ...]], dict[int, int], set[int]]:
    """By task: the costs to go behind its last block, the state in front of its first, and which tasks' last conversation goes on.

    A row a task comes to the driver in each round. All tasks run first as if nothing followed; those whose last conversation goes on are run again
    from the next task's costs unless these are parallel to what was used, until all are.
    """

    def run(edges, batches):
        own = Chunk(batches)
        if not own.rows:
            return
        part, first = own.rows[0][:2]
        last = own.rows[-1][1]
        costs = own.solved(edges.get(part, END), Vectors())
        exits = [own.walked(costs, q, False)[-1][2] for q in (range(4) if first == last else [0])]
        kinds = pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, first, last, [*costs[0][0]], exits), kinds, strict=True)], ["part", "first", "last", "front", "exits"])

    seen, edges, stale = {}, {}, None
    while stale is None or stale:
        some = blocks if stale is None else blocks.where(F.col("part").isin(*stale))
        held = {p: edges[p] for p in stale or ()}
        for r in in_batches(some.select("part", "conv_id", "symbols")).mapInArrow(lambda b, held=held: run(held, b), "part int, first long, last long, front array<int>, exits array<int>").collect():
            seen[r.part] = r
        order = sorted(seen)
        on = {p for p, q in zip(order, order[1:], strict=False) if seen[p].last == seen[q].first}
        true = {p: tuple(seen[q].front) for p, q in zip(order, order[1:], strict=False) if p in on}
        stale = [p for p in true if true[p] != edges.get(p, END)]
        edges = true
    entries, state = {}, 0
    for p in order:
        entries[p] = state
        exits = seen[p].exits
        state = exits[state if len(exits) > 1 else 0] if p in on else 0
    return edges, entries, on


def edits(rows: DataFrame) -> DataFrame:
    """(conv_id, block, turn, role, digest, letters, cost, blank, duplicate, truncated): the cheapest edits of marked() rows, a block in order at a time; turn, role, digest: its first row's.

    What is shuffled of a row is its id, turn, role, digest and symbol, never its text. Rows are dealt by
    ranges of their order, so one conversation may spread over all tasks; a text's first place in its conversation is a
    grouped minimum, which meets the row by its place.
    """
    order = ("conv_id", "turn", "role", "digest")
    # equal rows are told apart by where they lie, so that they may be dealt to several tasks
    narrow = rows.select(*order, "blank", "broken", F.monotonically_increasing_id().alias("_n"))
    narrow = narrow.repartitionByRange(width(rows.sparkSession), *order, "_n").sortWithinPartitions(*order, "_n").drop("_n")
    narrow = cut(narrow.withColumn("pos", F.monotonically_increasing_id()))
    first = narrow.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("broken"), F.upper(kind)).otherwise(kind)
    blocks = _blocks(narrow.join(first, "pos", "left").withColumn("symbol", symbol))
    edges, entries, on = _stitched(blocks)
    names = ("conv_id", "block", "turn", "role", "digest", "letters", "cost", "blank", "duplicate", "truncated")
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), *[pa.int64()] * 4

    def run(batches):
        own = Chunk(batches, "block", "first")
        if not own.rows:
            return
        part = own.rows[0][0]
        got = own.walked(own.solved(edges.get(part, END), Vectors()), entries[part], part not in on)
        rows = [
            (conv, block, at["turn"], at["role"], bytes(at["digest"]), letters, cost, s.count("b"), s.count("d"), sum(map(str.isupper, s)))
            for (_, conv, s, block, at), (letters, cost, _) in zip(own.rows, got, strict=True)
        ]
        for k in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 4096], strict=True), kinds, strict=True)], names)

    schema = "conv_id long, block long, turn long, role string, digest binary, letters string, cost long, blank long, duplicate long, truncated long"
    return in_batches(blocks.select("part", "conv_id", "symbols", "block", "first")).mapInArrow(run, schema)


def marked(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with the text's digest, whether it is blank and whether it is cut off: its last sign is not that of a sentence's end."""
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    blank = end == ""
    return rows.select("conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"), blank.alias("blank"), (~blank & ~end.isin(".", "!", "?")).alias("broken"))


def repaired(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conv_id of conversations, from rows (conv_id, turn, role, text).

    Rows of a conversation are in order of turn, null ones first, then role, then the text's SHA-256: rows that
    agree in all of these are the same. A null conv_id is a conversation of its own, an empty table gives no rows, other columns are
    not read. A conversation without rows has zeros, an empty audit and the hash of nothing.

    The hash of a conversation follows its rows one by one, as SHA-256 has no other way: each is streamed by one task, which holds a batch of rows and the audit.
    """
    own = marked(rows)
    none = {"turn": "long", "role": "string", "digest": "binary", "text": "string", "block": "long"}
    blank = [F.lit(None).cast(t).alias(c) for c, t in none.items()]
    zero = [F.lit(0).cast("long").alias(c) for c in ("cost", "blank", "duplicate", "truncated")]
    ids = conversations.select("conv_id").distinct().select("conv_id", F.lit(0).alias("kind"), *blank, *zero)
    how = edits(own).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", F.col("letters").alias("text"), "block", "cost", "blank", "duplicate", "truncated")
    texts = own.select("conv_id", F.lit(2).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "digest", "text", F.lit(None).cast("long").alias("block"), *zero)
    stream = ids.unionByName(how).unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.col("kind") > 0, "turn", "role", "digest", "kind", "block")
    columns = ("conv_id", "kind", "turn", "role", "text", "cost", "blank", "duplicate", "truncated")

    def run(batches):
        now = None
        for got in rows_of(batches, *columns):
            done = []
            for conv, kind, turn, role, text, *faults in zip(*got, strict=True):
                if now is None or now.conv != conv:
                    if now:
                        done.append(now.result())
                    now = Repaired(conv)
                if kind == 1:
                    now.edits(text, *faults)
                elif kind == 2:
                    now.row(turn, role, text)
            yield _batch(done)
        if now:
            yield _batch([now.result()])

    schema = f"conv_id long, {', '.join(f'{c} long' for c in STATS)}, audit string, repaired_sha256 string"
    return in_batches(stream.select(*columns)).mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int64(), *[pa.int64()] * len(STATS), pa.string(), pa.string()
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array([*c], t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", *STATS, "audit", "repaired_sha256"])


class Repaired:
    """One conversation as its edits and rows come in order."""

    def __init__(self, conv):
        self.conv, self.hash, self.empty = conv, hashlib.sha256(), True
        self.letters, self.at, self.audit, self.state = "", 0, [], 0
        self.low = self.high = self.seen = None
        self.turns = self.cost = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None

    def edits(self, letters: str, cost: int, blank: int, duplicate: int, truncated: int) -> None:
        self.audit.append(letters)
        self.letters, self.at = self.letters[self.at :] + letters, 0
        self.cost += cost
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated

    def say(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def inserted(self) -> None:
        while self.letters[self.at : self.at + 1] == "I":
            self.state = NEXT[self.state]
            self.say(ROLES[self.state], "")
            self.at += 1

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.seen
            self.low, self.high, self.seen = turn if self.low is None else self.low, turn, turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = STEP[self.state][role[:1]]
            self.say(role, text)
        elif letter == "R":
            self.state = NEXT[self.state]
            self.say(ROLES[self.state], text)

    def result(self) -> tuple:
        self.inserted()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()
