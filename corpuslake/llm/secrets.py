"""Secret scans: fixed patterns, and linking of the parts of a credential.

Patterns find base secrets (assignments, access keys, long hexadecimal strings) wherever they stand.
A credential may also come in parts that alone prove nothing: an account name, an opaque string, an
endpoint. Parts are intervals of the text. A scope is a section, which blank lines bound. The
parts of a document, its base secrets and the borders of its scopes are sorted and swept forwards and
backwards, which joins each part with those of its scope; a weak candidate is reported only if
complementary parts lie in its scope.

Positions come from the pieces between matches, so all of it is built-in functions in one pass over
the rows, without a shuffle. Arrays are walked in blocks, so that no step copies more than a block;
60,000 matches in one text take seconds, but 200,000 took over two minutes, so time is not linear there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: The base patterns. Letters of the key words stand in either case.
KEYS = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = KEYS + GIVEN + "([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Weak parts: an account given by name, an opaque string, an endpoint with a host.
ACCOUNT = "(?:[Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt])" + GIVEN + "[A-Za-z0-9_.@-]{3,}"
#: An opaque string also has a digit, a capital and a small letter.
OPAQUE = "[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = "[a-z][a-z0-9+]{1,9}://[A-Za-z0-9.-]+(?::[0-9]+)?"
#: Blank lines: what lies between two of them is a scope.
BORDER = r"\n[\x20\t\r]*\n"
#: Kinds in the order in which spans of equal starts are listed; borders are never reported.
KINDS = ("assign", "access", "hex", "account", "opaque", "endpoint", "border")
ASSIGN_NO, ACCESS_NO, HEX_NO, ACCOUNT_NO, OPAQUE_NO, ENDPOINT_NO, BORDER_NO = range(7)
SPAN = "struct<start: int, no: int, end: int>"
#: Items of an array that are walked together.
BLOCK = 64


def none_of(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def walked(items: Column, begin: Column, step: Callable, kind: str, enter: Callable = lambda s, part: s, leave: Callable = lambda s, out: out, size: int = BLOCK) -> Column:
    """What ``step`` puts out over an array, in order.

    ``step(state, item)`` returns the next state and an array of ``kind``; ``enter`` may change the state
    where a block (of ``size`` items) begins; ``leave(state, out)`` makes the result.
    """

    def within(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        start = F.struct(enter(acc["state"], part).alias("state"), none_of(kind).alias("out"))
        return F.aggregate(part, start, within, lambda own: F.struct(own["state"].alias("state"), F.concat(acc["out"], F.array(own["out"])).alias("out")))

    def blocks(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / size).cast("int")
        return F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * size + 1, F.lit(size)))).otherwise(F.array(xs))

    start = F.struct(begin.alias("state"), none_of(f"array<{kind}>").alias("out"))
    return F.aggregate(let(items, blocks), start, block, lambda acc: leave(acc["state"], F.flatten(acc["out"])))


def span(start: Column, no, end: Column) -> Column:
    return F.struct(start.alias("start"), (no if isinstance(no, Column) else F.lit(no)).alias("no"), end.alias("end"))


def spans_of(text: Column, pattern: str, kind: str, least: Callable[[Column], Column] | None = None) -> Column:
    """Spans (code points, end exclusive) of a pattern's matches from left to right, without overlaps.

    ``least``: a condition on the match's text. Texts without a match cost one search.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sized = F.zip_with(found, gaps, lambda m, g: F.struct(F.coalesce(F.length(g), F.lit(0)).alias("gap"), F.length(m).alias("n"), (least(m) if least else F.lit(True)).alias("good")))
    matched = F.filter(sized, lambda x: x["n"].isNotNull())  # the last gap has no match behind it

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        one = F.array(span(at + x["gap"], KINDS.index(kind), at + x["gap"] + x["n"]))
        return at + x["gap"] + x["n"], F.when(x["good"], one).otherwise(none_of(SPAN))

    return F.when(text.rlike(pattern), walked(matched, F.lit(0), step, SPAN)).otherwise(none_of(SPAN))


#: What a sweep has met in the present scope, and the end (forwards) or start (backwards) of the last base secret.
_MET = "struct<identifier: boolean, secret: boolean, endpoint: boolean, base: int>"
_SEEN = f"struct<span: {SPAN}, covered: boolean, identifier: boolean, secret: boolean, endpoint: boolean>"


def _met(state: Column, x: Column, clear: Column, base: Column) -> Column:
    """The state after span ``x``; a border begins a new scope. ``clear``: an opaque string that no base secret covers."""
    no, border = x["no"], x["no"] == BORDER_NO
    return F.struct(
        (~border & (state["identifier"] | no.isin(ACCESS_NO, ACCOUNT_NO))).alias("identifier"),
        (~border & (state["secret"] | no.isin(ASSIGN_NO, HEX_NO) | clear)).alias("secret"),
        (~border & (state["endpoint"] | (no == ENDPOINT_NO))).alias("endpoint"),
        F.when(no <= HEX_NO, base).otherwise(state["base"]).alias("base"),
    )


def joined(spans: Column) -> Column:
    """Of all spans and borders of a text, sorted: the base secrets, and the weak parts with complementary parts in their scope."""
    begin = lambda base: F.struct(*[F.lit(False).alias(k) for k in ("identifier", "secret", "endpoint")], F.lit(base).alias("base"))
    opaque = lambda x: x["no"] == OPAQUE_NO

    # Forwards: is an opaque string covered by a base secret that begins before it?
    def mark(end: Column, x: Column) -> tuple[Column, Column]:
        out = F.array(F.struct(x.alias("span"), (opaque(x) & (x["start"] < end)).alias("covered")))
        return F.when(x["no"] <= HEX_NO, F.greatest(end, x["end"])).otherwise(end), out

    # Backwards: or by one that begins inside it? Covered strings go; what lies behind in the scope is noted.
    def back(state: Column, y: Column) -> tuple[Column, Column]:
        x = y["span"]
        covered = opaque(x) & (y["covered"] | (state["base"] < x["end"]))
        out = F.array(F.struct(x.alias("span"), covered.alias("covered"), *[state[k].alias(k) for k in ("identifier", "secret", "endpoint")]))
        return _met(state, x, opaque(x) & ~covered, x["start"]), F.when(covered, none_of(_SEEN)).otherwise(out)

    # Forwards: with what lies before, the parts are judged.
    def judge(state: Column, y: Column) -> tuple[Column, Column]:
        x = y["span"]
        identifier, secret, endpoint = (state[k] | y[k] for k in ("identifier", "secret", "endpoint"))
        good = (x["no"] <= HEX_NO) | ((x["no"] == ACCOUNT_NO) & secret) | (opaque(x) & (identifier | endpoint)) | ((x["no"] == ENDPOINT_NO) & secret & identifier)
        return _met(state, x, opaque(x), x["end"]), F.when(good, F.array(x)).otherwise(none_of(SPAN))

    marked = walked(spans, F.lit(0), mark, f"struct<span: {SPAN}, covered: boolean>")
    seen = F.reverse(walked(F.reverse(marked), begin(2**31 - 1), back, _SEEN))
    return walked(seen, begin(0), judge, SPAN)


def linked(docs: DataFrame) -> DataFrame:
    """Adds ``base`` and ``all`` spans from the columns that ``spans_of`` filled."""
    base, weak = F.concat("assign", "access", "hex"), F.concat("account", "opaque", "endpoint")
    swept = F.sort_array(F.concat(base, weak, spans_of(F.col("text"), BORDER, "border")))
    return docs.withColumn("base", F.sort_array(base)).withColumn("all", F.when(F.size(weak) > 0, joined(swept)).otherwise(F.col("base")))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["no"] + 1), s["start"], s["end"])), ",")


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` in a struct ``held``, its text, its parts by kind, and the arrays ``base`` and ``all``."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"), text_of(f"`{text_col}`").alias("text"))
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    patterns = {"assign": (ASSIGN, value), "access": (ACCESS, None), "hex": (HEX, None), "account": (ACCOUNT, None), "opaque": (OPAQUE, mixed), "endpoint": (ENDPOINT, None)}
    found = held.select("held", "text", *[spans_of(F.col("text"), p, kind, least).alias(kind) for kind, (p, least) in patterns.items()])
    return linked(found)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, counts of base secrets, ``base_sha256`` and ``spans``.

    Null and empty texts have no spans (the digest is that of the empty string, ``spans`` is empty).
    Very long texts are read whole. Repeated rows and null ids come out as they are; an empty table gives
    an empty table; other columns of ``docs`` are not read.
    """
    found = with_spans(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select(F.col("held.id").alias(id_col), *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every reported secret and identifier in ``text_col`` replaced by ``mark``; endpoints stay.

    Spans that overlap get one mark. Null and empty texts, and texts without spans, stay as they are, so
    do rows that repeat, null ids and all other columns, whatever their names. An empty table stays empty.
    """
    found = with_spans(docs, text_col)
    text, hide = F.col("text"), F.filter("all", lambda s: s["no"] != ENDPOINT_NO)
    # Up to ``at`` all is put out. ``rest`` is the text from ``cut`` on, ``near`` its part that a block needs:
    # cutting a string takes time in proportion to it.
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("cut"), text.alias("rest"), F.lit("").alias("near"))
    rest = lambda s: F.substring(s["rest"], s["at"] - s["cut"] + 1, F.lit(2**31 - 1))

    def enter(s: Column, part: Column) -> Column:
        near = F.substring(s["rest"], s["at"] - s["cut"] + 1, F.element_at(part, -1)["end"] - s["at"])
        return F.struct(s["at"].alias("at"), s["at"].alias("cut"), rest(s).alias("rest"), near.alias("near"))

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        piece = F.array(F.substring(s["near"], s["at"] - s["cut"] + 1, x["start"] - s["at"]), F.lit(mark))
        moved = F.struct(F.greatest(s["at"], x["end"]).alias("at"), *[s[k].alias(k) for k in ("cut", "rest", "near")])
        return moved, F.when(x["start"] >= s["at"], piece).otherwise(none_of("string"))

    end = lambda s, out: F.array_join(F.concat(out, F.array(rest(s))), "")
    clean = F.when(F.size("all") > 0, walked(hide, begin, step, "string", enter, end, 128)).otherwise(F.col(f"held.`{text_col}`"))
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"held.`{c}`").alias(c) for c in docs.columns])
