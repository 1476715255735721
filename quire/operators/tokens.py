"""Content streams cut into operators by one pattern and windows, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.layout import marked_depth

_SPACE, _END = r"\x00\t\n\x0C\r ", r"\x00\t\n\x0C\r ()<>\[\]{}/%"
#: Escaped signs that would otherwise open, close or escape, and what they are while the text is cut: no character of the content is beyond one byte.
ESCAPED = (("\\\\", "\ue000\ue003"), ("\\(", "\ue000\ue001"), ("\\)", "\ue000\ue002"))
#: Balanced parentheses in a string: how deep, and how many side by side. The pattern's engine goes down a level of its own stack for each.
DEEP, MANY = 4, 200


def string(depth: int = DEEP) -> str:
    """A string without escapes, with balanced parentheses inside up to a depth."""
    return rf"\([^()]*+(?:{string(depth - 1)}[^()]*+){{0,{MANY}}}+\)" if depth else r"\([^()]*+\)"


def masked(text: Column) -> Column:
    """The text with escaped parentheses as signs of other kinds, of the same length."""
    for said, mask in ESCAPED:
        text = F.replace(text, F.lit(said), F.lit(mask))
    return text


#: A comment, an inline image's data, a string, brackets, a hexadecimal string, a name, or anything else in a row.
TOKEN = rf"%[^\r\n]*|(?<![^{_SPACE}\]>])ID[{_SPACE}][\s\S]*?[{_SPACE}]EI(?=[{_SPACE}]|$)|{string()}|<<|>>|<[0-9A-Fa-f{_SPACE}]*>|\[|\]|/[^{_END}]*|[^{_END}]+"


def operators(pages: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, seq, op, operands) of the decoded content of pages, in the order of ``seq`` from 0.

    ``operands`` is the tokens before an operator, as they are spelled, with a space
    between. A word inside an array or a dictionary is no operator, and a closing bracket
    of nothing is passed over. An inline image is ``BI``, ``ID`` with its dictionary's
    tokens and ``EI`` without operands. Operands without an operator go, comments too.
    Strings may hold balanced parentheses without escapes, ``DEEP`` deep and ``MANY`` side
    by side. A null or empty content has no rows.

    A page is cut by a pattern; brackets are counted by a clamped sum and operators by a
    running one, which says to which operator a token belongs. One exchange by page.
    """
    text = masked(F.decode(content, "ISO-8859-1"))
    rows = pages.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("_i", "_t")).where(~F.col("_t").startswith("%"))
    t = F.col("_t")
    opens, closes = t.isin("[", "<<"), t.isin("]", ">>")
    rows = marked_depth(rows, keys, "_i", F.when(opens, 1).when(closes, -1).otherwise(0))
    image = t.rlike(rf"^ID[{_SPACE}]")
    word: Column = (F.col("depth") == 0) & ~closes & ~t.rlike(r"^[(</]") & ~t.rlike(r"^[+\-.\d][\d.+\-]*$") & ~t.isin("true", "false", "null")
    rows = rows.withColumn("_n", F.when(image, 2).when(word, 1).otherwise(0))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_i")) - F.col("_n")
    rows = rows.withColumn("_g", before)
    tokens = F.array_sort(F.collect_list(F.when(F.col("_n") == 0, F.struct("_i", "_t"))))
    got = rows.groupBy(*keys, "_g").agg(F.max(F.when(F.col("_n") > 0, F.when(image, "ID").otherwise(t))).alias("op"), F.array_join(F.transform(tokens, lambda x: x["_t"]), " ").alias("operands")).where("op IS NOT NULL")
    for said, mask in ESCAPED:
        got = got.withColumn("operands", F.replace("operands", F.lit(mask), F.lit(said)))
    # an image's data is an operator of its own
    parts = F.when(F.col("op") == "ID", F.array(F.struct(F.lit(0).alias("k"), F.lit("ID").alias("op"), F.col("operands")), F.struct(F.lit(1).alias("k"), F.lit("EI").alias("op"), F.lit("").alias("operands")))).otherwise(F.array(F.struct(F.lit(0).alias("k"), F.col("op"), F.col("operands"))))
    return got.select(*keys, "_g", F.explode(parts).alias("_p")).select(*keys, (F.col("_g") + F.col("_p.k")).cast("int").alias("seq"), "_p.op", "_p.operands")
