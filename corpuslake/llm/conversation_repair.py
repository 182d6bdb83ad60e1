"""Repair of conversations into a legal order of roles, at the least cost.

A conversation is legal if the initials of its roles match ``(s?(ua)+)?``. The grammar is an automaton of four states. For every
turn, counted from the end, there are layers, one for each cost: the set of states from which the rest can be repaired at that
cost. Layers are bitsets of four bits, and sixteen of them, from the least cost on, stand in one 64-bit integer, so a turn's
edits are shifts and masks on all layers at once (as in Wu and Manber's matching with errors). Costs of states that can be reached
differ by 14 at most (deleting a kept system turn 2, one insertion 5, two of them 10 and so on), so sixteen layers hold them all. The first
layer that accepts gives the cost; walking the layers forwards, least edit first, gives the least audit.

Rows are dealt by ranges of conversation and turn, so one that holds a third of the table lies in many tasks. What crosses the
border of two ranges is small: for a block, the cost of getting from each state to each other. Those of the blocks at borders, at
most two a range, go to the driver, are joined there, and the blocks are walked once the states at their borders are known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import SPACE, cut, let_go

#: Costs of the edits, and what a truncated turn that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
#: Characters of a range, about.
RANGE = 32_000_000
#: Repeated texts are broadcast up to so many (some 60 bytes each).
SMALL = 300_000

MASK = (1 << 64) - 1
ONES = 0x1111111111111111
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. From where each letter leads.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What may be inserted, or what a turn may become, in each state.
WANTED = "uuau"
ENDS = 0b1001
NEVER = 1 << 60


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv, turn, role, text, copies, gone)`` after damage; a dropped row leaves one that is ``gone``."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    said = shown(text)
    told = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(code == 4, "user").otherwise(shown(role)).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias("text"), F.when(code == 3, 2).otherwise(1).alias("copies"), (code == 0).alias("gone"),
    )
    return told.select("conv", *[F.when(~F.col("gone"), F.col(c)).alias(c) for c in ("turn", "role", "text")], "copies", "gone")


def marked(rows: DataFrame) -> DataFrame:
    """Equal rows as one with the number of ``copies``, and ``fault``: of the first of them, copies being duplicates (or blank)."""
    spaces = f"[{SPACE}]"
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    ended = F.col("text").rlike(rf"[.!?]{spaces}*\z")
    each = rows.groupBy("conv", "gone", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    each = cut(each.withColumn("digest", F.when(~F.col("gone") & ~blank, F.unhex(F.sha2(F.concat_ws(":", F.col("role"), F.col("text")), 256)))))
    key = ["conv", "role", "digest"]
    again = each.where("digest is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("turn").isNull()).alias("null_first"), F.min("turn").alias("first")).where("n > 1")
    again = cut(again.select(*[F.col(c).alias(f"_{c}") for c in key], "null_first", "first"))
    again = F.broadcast(again) if again.count() <= SMALL else again
    met = each.join(again, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
    earlier = F.col("_digest").isNotNull() & F.col("turn").isNotNull() & (F.col("null_first") | (F.col("turn") > F.col("first")))
    fault = F.when(blank, BLANK).when(earlier, DUPLICATE).when(~ended, CUT_OFF).otherwise(FINE)
    return met.select("conv", "gone", "turn", "role", "text", "copies", fault.cast("int").alias("fault"))


def filled(layers: int) -> int:
    """A state reached at a cost is reached at every larger one."""
    for k in (4, 8, 16, 32):
        layers |= layers << k
    return layers & MASK


def before(after: tuple[int, int], initial: str, fault: int, copies: int = 1) -> tuple[int, int]:
    """Base cost and layers in front of a turn, from those behind it."""
    base, a = after
    base += DELETE * (copies - 1)
    out = a << 4 * DELETE
    if fault in (FINE, CUT_OFF):
        extra = TRUNCATED * (fault == CUT_OFF)
        kept = ((a >> 1) & ONES) if initial == "s" else ((a >> 2) & ONES) * 0b1011 if initial == "u" else ((a >> 3) & ONES) << 2 if initial == "a" else 0
        out |= kept << 4 * extra | _fitting(a) << 4 * (REROLE + extra)
    return settled(base, out & MASK)


def _fitting(a: int) -> int:
    """States that the wanted letter leads into the states ``a``."""
    return ((a >> 2) & ONES) * 0b1011 | ((a >> 3) & ONES) << 2


def settled(base: int, layers: int) -> tuple[int, int]:
    """With insertions in front (two lead round the grammar, so more never help), from the least cost on."""
    layers = filled(layers)
    for _ in range(2):
        layers = filled(layers | _fitting(layers) << 4 * INSERT)
    while layers and not layers & 15:
        layers = layers >> 4 | (layers >> 60) << 60
        base += 1
    return base, layers


def cost(at: tuple[int, int], state: int) -> int:
    base, layers = at
    found = layers >> state & ONES
    return base + ((found & -found).bit_length() - 1) // 4 if found else NEVER


def from_costs(costs: list[int]) -> tuple[int, int]:
    """Layers of the states' costs."""
    least = min(costs)
    layers = 0
    for state, c in enumerate(costs):
        if c - least < 16:
            layers |= 1 << 4 * (c - least) + state
    return least, filled(layers)


#: A block of rows of one conversation: (initial, fault, copies) each.
Row = tuple[str, int, int]


def layers_of(rows: list[Row], end: tuple[int, int]) -> list[tuple[int, int]]:
    """Layers in front of every row, and those behind the last."""
    found = [end]
    for initial, fault, copies in reversed(rows):
        found.append(before(found[-1], initial, fault, copies))
    return found[::-1]


def walked(rows: list[Row], layers: list[tuple[int, int]], state: int, final: bool) -> tuple[str, list[str | None], list[tuple[int, str]], int]:
    """Cheapest edits from ``state``, least first: the audit, each row's role (None: gone, empty: its own), insertions (row, role), the last state.

    Behind the last row only a ``final`` block inserts; the next block does it otherwise, so that its deletions come first.
    """
    audit, roles, inserted, i = [], [], [], 0
    while i < len(rows) or final:
        now, letter = cost(layers[i], state), WANTED[state]
        new, name = NEXT[state, letter], "user" if letter == "u" else "assistant"
        initial, fault, copies = rows[i] if i < len(rows) else ("", BLANK, 0)
        if i < len(rows) and cost(layers[i + 1], state) + DELETE * copies == now:
            audit.append("D" * copies)
            roles.append(None)
            i += 1
        elif cost(layers[i], new) + INSERT == now:
            audit.append("I")
            inserted.append((i, name))
            state = new
        elif i == len(rows):
            break
        else:
            kept, extra = NEXT.get((state, initial)), TRUNCATED * (fault == CUT_OFF) + DELETE * (copies - 1)
            keep = kept is not None and cost(layers[i + 1], kept) + extra == now
            audit.append(("K" if keep else "R") + "D" * (copies - 1))
            roles.append("" if keep else name)
            state = kept if keep else new
            i += 1
    return "".join(audit), roles, inserted, state


class Block:
    """What is known of consecutive rows of one conversation; blocks join in order."""

    def __init__(self, rows: list[tuple]):
        """``rows``: (turn, role, fault, copies)."""
        self.blank = sum(n for _, _, f, n in rows if f == BLANK)
        self.duplicate = sum(n for _, _, f, n in rows if f == DUPLICATE) + sum(n - 1 for _, _, f, n in rows if f in (FINE, CUT_OFF))
        self.truncated = sum(f == CUT_OFF for _, _, f, _ in rows)
        initials = [r[:1] for _, r, _, _ in rows]
        self.illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])) + sum(n - 1 for _, _, _, n in rows)
        self.ends = (initials[0], initials[-1]) if rows else None
        turns = [t for t, _, _, _ in rows if t is not None]
        self.turns = (turns[0], turns[-1], 1 + sum(a != b for a, b in zip(turns, turns[1:]))) if turns else None

    def joined(self, other: Block) -> Block:
        new = Block([])
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(new, name, getattr(self, name) + getattr(other, name))
        if self.ends and other.ends:
            new.illegal += self.ends[1] + other.ends[0] not in ("su", "ua", "au")
            new.ends = (self.ends[0], other.ends[1])
        else:
            new.ends = self.ends or other.ends
        if self.turns and other.turns:
            new.turns = (self.turns[0], other.turns[1], self.turns[2] + other.turns[2] - (self.turns[1] == other.turns[0]))
        else:
            new.turns = self.turns or other.turns
        return new

    def counts(self) -> tuple[int, ...]:
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
#: Behind the last turn: missing letters can be inserted.
DONE = settled(*from_costs([0, NEVER, NEVER, 0]))


def _by_conversation(batches: Iterator[pa.RecordBatch], texts: bool = True) -> Iterator[tuple]:
    """Consecutive rows of one conversation: ``(range, conv, [(turn, role, fault, copies)], [text])``."""
    names = ["part", "conv", "gone", "turn", "role", "fault", "copies", *["text"] * texts]
    rows = (row for batch in batches for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)))
    for (part, conv), own in groupby(rows, key=lambda r: r[:2]):
        own = [r for r in own if not r[2]]
        yield part, conv, [r[3:7] for r in own], [r[7] for r in own] if texts else []


def _plain(rows: list[tuple]) -> list[Row]:
    return [(role[:1], fault, copies) for _, role, fault, copies in rows]


def _pieces(rows: list[tuple], texts: list[str], roles: list[str | None], inserted: list[tuple[int, str]]) -> Iterator[str]:
    """Repaired turns in order."""
    at = 0
    for i in range(len(rows) + 1):
        while at < len(inserted) and inserted[at][0] == i:
            yield f"{inserted[at][1]}:"
            at += 1
        if i < len(rows) and roles[i] is not None:
            yield f"{roles[i] or rows[i][1]}:{texts[i]}"


def _edges(dealt: DataFrame) -> list:
    """For the first and the last conversation of every range: its place, the block, and the costs between states."""
    arrow = to_arrow_type(dealt.schema["conv"].dataType)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for found in _by_conversation(batches, False):
            first, last = first or found, found
        for place, found in enumerate((first, last) if first else ()):
            part, conv, rows, _ = found
            own, plain = Block(rows), _plain(rows)
            fronts = [layers_of(plain, from_costs([0 if e == end else NEVER for e in range(4)]))[0] for end in range(4)]
            between = [cost(fronts[end], s) for s in range(4) for end in range(4)]
            made = [own.blank, own.duplicate, own.truncated, own.illegal]
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "place": pa.array([place], pa.int32()), "conv": pa.array([conv], arrow), "between": [between], "made": [made], "ends": pa.array([own.ends], pa.list_(pa.string())), "turns": pa.array([own.turns], pa.list_(pa.int64()))})

    kind = f"part int, place int, conv {dealt.schema['conv'].dataType.simpleString()}, between array<long>, made array<long>, ends array<string>, turns array<long>"
    return dealt.drop("text").mapInArrow(each, kind).collect()


def _spanning(edges: list) -> list[list]:
    """Blocks of the conversations that lie in more than one range, in order."""
    found: dict[int, dict] = {}
    for r in edges:
        found.setdefault(r["part"], {})[r["place"]] = r
    runs, run = [], []
    for part in sorted(found):
        first, last = found[part][0], found[part][1]
        if run and run[-1]["conv"] == first["conv"]:
            run.append(first)
            if last["conv"] == first["conv"]:
                continue
        if len(run) > 1:
            runs.append(run)
        run = [last]
    return [*runs, run] if len(run) > 1 else runs


def _block_of(r) -> Block:
    own = Block([])
    own.blank, own.duplicate, own.truncated, own.illegal = r["made"]
    own.ends, own.turns = r["ends"] and tuple(r["ends"]), r["turns"] and tuple(r["turns"])
    return own


def _fronts(run: list) -> list[tuple[int, int]]:
    """Layers in front of each block, and those behind the last."""
    ends = [DONE]
    for r in reversed(run):
        costs = [cost(ends[-1], s) for s in range(4)]
        ends.append(from_costs([min(min(r["between"][4 * s + e] + costs[e], NEVER) for e in range(4)) for s in range(4)]))
    return ends[::-1]


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage=damaged) -> DataFrame:
    """One row per conversation: ``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    Rows of a conversation stand by turn (nulls first), those of one turn by role and text, so equal rows are neighbours. Null roles and texts
    are one space; null conversation ids are one conversation, which comes back with a null id. An initial is a role's first character; the empty
    role has none, so it is legal beside nothing. A duplicate is a row whose role and text an earlier row has, whatever becomes of either; the second of two equal rows is one.
    ``damage`` turns the table into ``(conv, turn, role, text, copies, gone)``; a conversation all of whose rows are ``gone`` has zeros, an empty audit and the hash of
    the empty string. An empty table gives no rows. Very long texts are read whole; a conversation of any length is walked in ranges, its
    result being one string with a letter an edit. SHA-256 needs its input in order, so the texts of a conversation that lies in several ranges are
    streamed through one task, which holds one text at a time. Columns of other names play no part.
    """
    spark = rows.sparkSession
    ready = cut(marked(damage(rows, conv, turn, role, text)))
    size = ready.agg(F.sum(F.length("text") + F.length("role") + 50)).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))
    keys = ["conv", "gone", "turn", "role", "text"]  # nulls come first
    dealt = cut(ready.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))
    runs = _spanning(_edges(dealt))
    crossing = {(r["part"], r["place"]): (n, i, end, i == len(run) - 1) for n, run in enumerate(runs) for i, (r, end) in enumerate(zip(run, _fronts(run)[1:]))}
    arrow = to_arrow_type(dealt.schema["conv"].dataType)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv_id, rows, texts, place in _placed(batches, crossing):
            if place is None:
                plain = _plain(rows)
                layers = layers_of(plain, DONE)
                audit, roles, inserted, _ = walked(plain, layers, 0, True)
                digest = hashlib.sha256(_bytes("\n".join(_pieces(rows, texts, roles, inserted)))).hexdigest()
                out.append((conv_id, *Block(rows).counts(), cost(layers[0], 0), audit, digest))
            if len(out) == 1000:
                yield _batch(out, arrow)
                out = []
        if out:
            yield _batch(out, arrow)
        let_go()

    schema = f"conv {dealt.schema['conv'].dataType.simpleString()}, {COUNTS}, audit string, repaired_sha256 string"
    found = dealt.mapInArrow(whole, schema)
    if runs:
        found = found.unionByName(_long(dealt, runs, crossing, schema))
    return found.withColumnRenamed("conv", conv)


def _bytes(said: str) -> bytes:
    return said.encode("utf-8", "surrogatepass")


def _batch(rows: list[tuple], arrow: pa.DataType) -> pa.RecordBatch:
    names = ["conv", *(c.split()[0] for c in COUNTS.split(", ")), "audit", "repaired_sha256"]
    types = [arrow, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _placed(batches: Iterator[pa.RecordBatch], crossing: dict) -> Iterator[tuple]:
    """Conversations of a range: ``(conv, rows, texts, place)``, the place being that of ``crossing`` or None.

    A range's first conversation crosses under place 0, its last under place 1, one that is both under either.
    """
    waiting, place = None, None
    for part, *found in _by_conversation(batches):
        if waiting is not None:
            yield *waiting, place
            place = None
        else:
            place = crossing.get((part, 0))
        waiting = found
    if waiting is not None:
        yield *waiting, place or crossing.get((part, 1))


def _long(dealt: DataFrame, runs: list[list], crossing: dict, schema: str) -> DataFrame:
    """Rows of the conversations that cross borders."""
    arrow = to_arrow_type(dealt.schema["conv"].dataType)
    some = dealt.where(F.col("part").isin(*{part for part, _ in crossing}))
    place_of = "run int, at int, "

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, _, place in _placed(batches, crossing):
            if place is not None:
                run, at, end, final = place
                plain = _plain(rows)
                layers = layers_of(plain, end)
                leads = [walked(plain, layers, s, final)[3] if cost(layers[0], s) < NEVER else -1 for s in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), pa.array([at], pa.int32()), pa.array([leads], pa.list_(pa.int32()))], ["run", "at", "leads"])

    # The state in front of each block: four possible ones are walked where they lie, the driver follows the chain.
    leads = {(r["run"], r["at"]): r["leads"] for r in some.mapInArrow(leading, place_of + "leads array<int>").collect()}
    states, known = {}, []
    for n, run in enumerate(runs):
        state = 0
        own = Block([])
        for i, r in enumerate(run):
            states[n, i], state = state, leads[n, i][state]
            own = own.joined(_block_of(r))
        known.append((run[0]["conv"], *own.counts(), cost(_fronts(run)[0], 0)))

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, texts, place in _placed(batches, crossing):
            if place is not None:
                run, at, end, final = place
                plain = _plain(rows)
                audit, roles, inserted, _ = walked(plain, layers_of(plain, end), states[run, at], final)
                for i, said in enumerate((audit, *_pieces(rows, texts, roles, inserted))):
                    yield pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), pa.array([at], pa.int32()), pa.array([i], pa.int64()), pa.array([said], pa.string())], ["run", "at", "i", "said"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(4))))
        for run, own in groupby(rows, key=lambda r: r[0]):
            digest, audits, begun = hashlib.sha256(), [], False
            for _, _, i, said in own:
                if i == 0:
                    audits.append(said)
                else:
                    digest.update(_bytes("\n" * begun + said))
                    begun = True
            yield _batch([(*known[run], "".join(audits), digest.hexdigest())], arrow)

    pieces = some.mapInArrow(edited, place_of + "i long, said string")
    return pieces.repartition(len(runs), "run").sortWithinPartitions("run", "at", "i").mapInArrow(hashed, schema)
