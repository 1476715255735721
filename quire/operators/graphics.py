"""The graphics state in effect at operators, by windows over the operators alone.

``q`` saves the state and ``Q`` brings it back, so an operator sees the last setter that
no ``Q`` has undone since. A row's save level is a clamped sum. At each level, a save opens
a fresh, empty layer and hides the one before, and a setter writes to the layer of its
level; the state is, property by property, the topmost written layer from a row's level
down. A wanted row therefore probes all levels from 0 to its own, each in a window over the
layers of that level, and the highest answer wins. One exchange by page serves all steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import tokens
from quire.operators.layout import marked_depth

#: The operators that show text (fixed values).
SHOWS = ("Tj", "TJ", "'", '"')
#: Colour operators of device spaces: operator -> (property, space, components); fixed values.
DEVICE = {
    "g": ("fill", "DeviceGray", 1), "rg": ("fill", "DeviceRGB", 3), "k": ("fill", "DeviceCMYK", 4),
    "G": ("stroke", "DeviceGray", 1), "RG": ("stroke", "DeviceRGB", 3), "K": ("stroke", "DeviceCMYK", 4),
}
#: Properties that an operator sets to its first number: property -> (operator, value at the start of a page); fixed values.
NUMBERS = {"line_width": ("w", 1.0), "line_cap": ("J", 0), "line_join": ("j", 0), "miter_limit": ("M", 10.0), "flatness": ("i", 0.0), "char_space": ("Tc", 0.0), "word_space": ("Tw", 0.0), "leading": ("TL", 0.0), "rise": ("Ts", 0.0), "mode": ("Tr", 0)}
#: The operators whose operands are read; those of all others, as of what shows text, are passed on unread.
SETS = tuple(dict.fromkeys([*DEVICE, "cs", "CS", "sc", "scn", "SC", "SCN", *(o for o, _ in NUMBERS.values()), "TD", '"', "Tz", "Tf", "d", "ri"]))
_STRING = rf"{tokens.string()}|<[0-9A-Fa-f\s]*>"


def numbers(operands: Column) -> Column:
    """The numbers among operands that are spelled as in a file; those in strings, arrays and names aren't."""
    bare = F.regexp_replace(F.regexp_replace(tokens.masked(operands), _STRING, " "), r"\[[^\]]*\]|/[^\s/\[\]<>(){}%]*", " ")
    bare = F.when(operands.rlike(r"[(<\[/]"), bare).otherwise(operands)
    return F.array_compact(F.transform(F.split(F.trim(bare), r"\s+"), lambda t: F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), t.try_cast("double"))))


def names(operands: Column) -> Column:
    """The names among operands, without their slash."""
    got = F.regexp_extract_all(F.regexp_replace(tokens.masked(operands), _STRING, " "), F.lit(r"/([^\s/\[\]<>(){}%]*)"), F.lit(1))
    return F.when(operands.contains("/"), got).otherwise(F.when(operands.isNotNull(), F.array().cast("array<string>")))


def setters() -> dict[str, Column]:
    """For each property what an operator sets it to, over ``op``, ``_num`` and ``_name``; null where it doesn't.

    An operator with missing operands sets nothing. Colours are (space, components);
    ``sc`` and its kin write components alone and leave the space of the layers below.
    """
    op, num, name = F.col("op"), F.col("_num"), F.col("_name")
    out: dict[str, Column] = {}
    for which, space, more in (("fill", "cs", ("sc", "scn")), ("stroke", "CS", ("SC", "SCN"))):
        device = [(k, s, n) for k, (w, s, n) in DEVICE.items() if w == which]
        spaces = reduce(lambda c, d: c.when((op == d[0]) & (F.size(num) == d[2]), F.lit(d[1])), device, F.when((op == space) & (F.size(name) > 0), F.get(name, F.lit(0))))
        first = F.get(name, F.lit(0))
        zeros = F.array_repeat(F.lit(0.0), F.when(first == "DeviceRGB", 3).when(first == "DeviceCMYK", 4).otherwise(1))
        values = reduce(lambda c, d: c.when((op == d[0]) & (F.size(num) == d[2]), num), device, F.when((op == space) & (F.size(name) > 0), zeros))
        out[f"{which}_space"] = spaces
        out[which] = values.when(op.isin(*more) & (F.size(num) + F.size(name) > 0), num)
        out[f"{which}_pattern"] = F.when(F.col(f"_s_{which}_space").isNotNull(), F.lit("")).when(op.isin(*more) & (F.size(num) + F.size(name) > 0), F.coalesce(F.get(name, F.size(name) - 1), F.lit("")))
    for prop, (o, start) in NUMBERS.items():
        out[prop] = F.when((op == o) & (F.size(num) > 0), F.get(num, F.lit(0)).cast("int" if isinstance(start, int) else "double"))
    out["leading"] = F.when((op == "TD") & (F.size(num) == 2), -F.get(num, F.lit(1))).otherwise(out["leading"])
    spaced = (op == '"') & (F.size(num) >= 2)
    out["word_space"] = F.when(spaced, F.get(num, F.lit(0))).otherwise(out["word_space"])
    out["char_space"] = F.when(spaced, F.get(num, F.lit(1))).otherwise(out["char_space"])
    out["scale"] = F.when((op == "Tz") & (F.size(num) > 0), F.get(num, F.lit(0)) / 100)
    font = (op == "Tf") & (F.size(name) > 0) & (F.size(num) > 0)
    out["font"], out["font_size"] = F.when(font, F.get(name, F.lit(0))), F.when(font, F.get(num, F.size(num) - 1))
    out["dash"] = F.when((op == "d") & F.col("operands").contains("["), F.trim("operands"))
    out["intent"] = F.when((op == "ri") & (F.size(name) > 0), F.get(name, F.lit(0)))
    return out


#: What holds before any setter.
START = {"fill_space": "DeviceGray", "stroke_space": "DeviceGray", "fill_pattern": "", "stroke_pattern": "", "scale": 1.0, "font": "", "font_size": 0.0, "dash": "[] 0", "intent": "RelativeColorimetric"} | {p: v for p, (_, v) in NUMBERS.items()}


def state_at(operators: DataFrame, keys: list[str], wanted: Column, properties: list[str] | None = None) -> DataFrame:
    """The rows of ``operators`` (keys, seq, op, operands, others) for which ``wanted`` holds,
    with the state in effect there, their own setting included, and ``level``, the number of saves that are open.

    ``properties``: those of ``setters`` to carry, all if not given. ``seq`` orders the
    operators of a key, without ties. A ``Q`` without a ``q`` does nothing; null operands
    are none; an empty table gives an empty result; columns that this adds replace others
    of their names. No row meets any other: the work is a row for each open save of a
    wanted row, a sort by level and a running window.
    """
    found = setters()
    chosen = list(found) if properties is None else properties
    clash = {*chosen, "level"}
    given = [c for c in operators.columns if c not in clash]
    text = F.coalesce(F.col("operands"), F.lit(""))
    # what neither sets, saves, restores nor is wanted goes before anything is sorted
    rows = operators.where(F.col("op").isin(*SETS, "q", "Q") | F.coalesce(wanted, F.lit(False)))
    rows = rows.select(*keys, "seq", "op", text.alias("operands"), F.when(wanted, F.struct(*given)).alias("_row"), F.coalesce(wanted, F.lit(False)).alias("_want"), *[F.when(F.col("op").isin(*SETS), read(text)).alias(c) for c, read in (("_num", numbers), ("_name", names))])
    rows = rows.withColumns({f"_s_{p}": found[p] for p in found if p.endswith("_space")})
    rows = rows.withColumns({f"_s_{p}": found[p] for p in chosen if not p.endswith("_space")})
    writes = reduce(lambda a, b: a | b, [F.col(f"_s_{p}").isNotNull() for p in chosen], F.col("op") == "q")
    rows = marked_depth(rows, keys, "seq", F.when(F.col("op") == "q", 1).when(F.col("op") == "Q", -1).otherwise(0))
    as_writer = F.when(writes, F.array(F.struct(F.lit(0).alias("side"), F.col("depth").alias("level"))))
    as_reader = F.when(F.col("_want"), F.transform(F.sequence(F.lit(0), F.col("depth")), lambda k: F.struct(F.lit(1).alias("side"), k.alias("level"))))
    empty = F.array().cast("array<struct<side:int,level:int>>")
    cells = rows.withColumn("_c", F.explode(F.concat(F.coalesce(as_writer, empty), F.coalesce(as_reader, empty))))
    layer = Window.partitionBy(*keys, "_c.level").orderBy("seq", "_c.side").rowsBetween(Window.unboundedPreceding, 0)
    writer = F.col("_c.side") == 0

    def written(p: str) -> Column:
        """The layer's value, null inside where a save opened it and nothing was written since."""
        value = F.col(f"_s_{p}")
        mark = F.when(writer & (F.col("op") == "q"), F.struct(F.lit(None).cast(rows.schema[f"_s_{p}"].dataType).alias("v"))).when(writer & value.isNotNull(), F.struct(value.alias("v")))
        return F.last(mark, ignorenulls=True).over(layer)

    probed = cells.select(*keys, "seq", "_c", "depth", F.when(F.col("_c.level") == 0, F.col("_row")).alias("_row"), *[written(p)["v"].alias(f"_v_{p}") for p in chosen]).where("_c.side = 1")

    def top(p: str) -> Column:
        got = F.max_by(f"_v_{p}", F.when(F.col(f"_v_{p}").isNotNull(), F.col("_c.level")))
        start = F.array(F.lit(0.0)) if p in ("fill", "stroke") else F.lit(START[p])
        return F.coalesce(got, start).alias(f"_t_{p}")

    got = probed.groupBy(*keys, "seq").agg(F.first("_row", ignorenulls=True).alias("_row"), F.max("depth").alias("_d"), *[top(p) for p in chosen])
    return got.select("_row.*", F.col("_d").alias("level"), *[F.col(f"_t_{p}").alias(p) for p in chosen])
