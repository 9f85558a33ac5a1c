"""Regular-expression spans with DataFrame functions only: code-point places from the pieces between matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


_SPAN = "array<struct<start:int,end:int,value:string,part:string>>"
#: matches handled together; appending to an array copies it, so long lists are built in runs of this size
RUN = 128
#: code points of a block of text (see ``blocks``)
BLOCK = 1024


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once a row, however often ``use`` names it and wherever the optimizer puts the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def in_runs(rows: Column, after: Callable[[Column, Column], Column], step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """A running fold over ``rows`` that keeps what it makes of each: ``step(state, row)`` gives the next state and one element.

    ``after(state, run)`` is the state (an int, 0 at first) behind a whole run.
    The work is linear in the rows but for a factor of ``RUN``.
    """

    def inside(acc, x):
        state, made = step(acc["at"], x)
        return F.struct(state.alias("at"), F.concat(acc["out"], F.array(made)).alias("out"))

    def fold(run, start):
        return F.aggregate(run, F.struct(start.alias("at"), F.array().cast(kind).alias("out")), inside, lambda acc: acc["out"])

    def folded(runs):
        starts = F.aggregate(runs, F.array(F.lit(0)), lambda acc, run: F.concat(acc, F.array(after(F.element_at(acc, -1), run))))
        return F.flatten(F.zip_with(runs, F.slice(starts, F.lit(1), F.size(runs)), fold))

    def in_parts(rows):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / RUN).cast("int")), lambda i: F.slice(rows, i * RUN + 1, F.lit(RUN)))

    return bound(rows, lambda rows: F.when(F.size(rows) > 0, bound(in_parts(rows), folded)).otherwise(F.array().cast(kind)))


def places(pieces: Column, matches: Column, group: Column | None = None) -> Column:
    """``array<struct<start, end, value, part>>`` of the matches, from ``split(text, pattern, -1)`` and ``regexp_extract_all``."""
    rows = F.arrays_zip(matches.alias("m"), pieces.alias("p"), *([] if group is None else [group.alias("g")]))
    rows = F.filter(rows, lambda x: x["m"].isNotNull())  # the last piece has no match behind it
    after = lambda at, run: F.aggregate(run, at, lambda a, x: a + F.length(x["p"]) + F.length(x["m"]))

    def step(at, x):
        start = at + F.length(x["p"])
        end = start + F.length(x["m"])
        part = x["m"] if group is None else x["g"]
        return end, F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value"), part.alias("part"))

    return in_runs(rows, after, step, _SPAN)


def blocks(text: Column) -> Column:
    """The text in blocks of ``BLOCK`` code points, for :func:`cut`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start .. end`` of a text from its blocks: the work follows the piece, not its place."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, F.greatest(F.floor((end - 1) / BLOCK).cast("int") - first + 1, F.lit(1))), "")
    return F.when(end > start, F.substr(some, start - first * BLOCK + 1, end - start)).otherwise(F.lit(""))


def replaced(text: str, blocks: str, spans: str, mark: Callable[[Column, Column], Column]) -> Column:
    """The text with each span of ``spans`` (in order of start) replaced by ``mark(span, length)``; of overlapping
    spans the earlier one is replaced, and what it does not cover of the next. ``blocks`` are those of the text."""

    def step(at, x):
        here = F.greatest(at, x["start"])
        new = F.when(x["end"] > at, mark(x, F.greatest(x["end"] - here, F.lit(0)))).otherwise(F.lit(""))
        return F.greatest(at, x["end"]), F.concat(cut(F.col(blocks), at, here), new)

    after = lambda at, run: F.greatest(at, F.array_max(F.transform(run, lambda x: x["end"])))
    last = F.array_max(F.transform(F.col(spans), lambda x: x["end"]))
    done = F.concat(F.array_join(in_runs(F.col(spans), after, step, "array<string>"), ""), cut(F.col(blocks), last, F.length(text)))
    return F.when(F.size(spans) > 0, done).otherwise(F.col(text))


def add_spans(df, text: str, name: str, pattern: str, keep: Callable[[Column], Column] | None = None, gate: Column | None = None, group: int = 0):
    """Column ``name`` with the spans of ``pattern`` in ``text`` that pass ``keep`` (failing matches are dropped, never tried anew)."""
    p = F.lit(pattern)
    t = F.col(text) if gate is None else F.when(gate, F.col(text)).otherwise(F.lit(""))
    df = df.withColumn(f"_{name}", t).withColumn(f"_m_{name}", F.regexp_extract_all(F.col(f"_{name}"), p, F.lit(0)))
    some = F.size(f"_m_{name}") > 0
    df = df.withColumn(f"_p_{name}", F.when(some, F.split(F.col(f"_{name}"), pattern, -1)).otherwise(F.array().cast("array<string>")))
    extra = None
    if group:
        df = df.withColumn(f"_g_{name}", F.when(some, F.regexp_extract_all(F.col(f"_{name}"), p, F.lit(group))).otherwise(F.array().cast("array<string>")))
        extra = F.col(f"_g_{name}")
    spans = places(F.col(f"_p_{name}"), F.col(f"_m_{name}"), extra)
    df = df.withColumn(name, spans if keep is None else F.filter(spans, keep))
    return df.drop(*(c for c in df.columns if c in (f"_{name}", f"_m_{name}", f"_p_{name}", f"_g_{name}")))


def merged(kinds: list[str], columns: list[str] | None = None) -> Column:
    """All spans as ``array<struct<start, rank, end, kind, value>>`` in order of start, then kind as listed."""

    def labelled(kind: str, rank: int):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))

    parts = [F.transform(F.col(c), labelled(k, i)) for i, (k, c) in enumerate(zip(kinds, columns or kinds, strict=True))]
    return F.array_sort(F.concat(*parts))


def written_out(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
