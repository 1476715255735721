"""Characters of extracted text: normal forms, diacritics, directions; small Arrow functions over the character database."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: First and last code points of the presentation forms, which alone are decomposed (fixed values).
FORMS = ((0xFB00, 0xFDFF), (0xFE70, 0xFEFF))


def presentation(text: str) -> str:
    """Ligatures and presentation forms as the characters that they stand for; others stay as they are.

    Right-to-left forms of several characters keep their order of reading.
    """
    return "".join(unicodedata.normalize("NFKC", c).strip() if any(a <= ord(c) <= b for a, b in FORMS) else c for c in text)


def is_diacritic(text: str) -> bool:
    """One character that marks another: of category Mn, Sk or Lm, but for the long-vowel mark."""
    return len(text) == 1 and text != "ー" and unicodedata.category(text) in ("Mn", "Sk", "Lm")


#: Spacing marks and the combining ones that they stand for (fixed values).
COMBINING = {"`": "̀", "´": "́", "^": "̂", "ˆ": "̂", "~": "̃", "˜": "̃", "¯": "̄", "˘": "̆", "˙": "̇", "¨": "̈", "˚": "̊", "˝": "̋", "ˇ": "̌", "¸": "̧", "˛": "̨"}


def merged(base: str, mark: str) -> str:
    """A character with a diacritic shown over it, composed where the database has the pair."""
    return unicodedata.normalize("NFC", base + COMBINING.get(mark, mark)) if base else mark


def right_to_left(text: str) -> bool:
    """Whether the first strong character says so."""
    return next((unicodedata.bidirectional(c) in ("R", "AL") for c in text if unicodedata.bidirectional(c) in ("L", "R", "AL")), False)


def logical(text: str) -> str:
    """A line as shown, from left to right, in the order of reading.

    Runs of strong right-to-left characters, with what is neutral between them, are turned
    round and their paired signs mirrored; numbers keep their order. In a line whose first
    strong character is right-to-left the runs are taken from the right.
    """
    kinds = [unicodedata.bidirectional(c) for c in text]
    if not any(k in ("R", "AL") for k in kinds):
        return text
    strong = ["R" if k in ("R", "AL") else "L" if k in ("L", "EN", "AN") else "" for k in kinds]
    base = "R" if right_to_left(text) else "L"
    for i, s in enumerate(strong):
        if not s:
            left = next((x for x in reversed(strong[:i]) if x), base)
            right = next((x for x in strong[i + 1 :] if x), base)
            strong[i] = left if left == right else base
    runs: list[tuple[str, str]] = []
    for c, s in zip(text, strong):
        if runs and runs[-1][1] == s:
            runs[-1] = (runs[-1][0] + c, s)
        else:
            runs.append((c, s))
    if base == "R":
        runs.reverse()
    return "".join("".join(_mirror(c) for c in reversed(t)) if s == "R" else t for t, s in runs)


_PAIRS = str.maketrans("()[]{}<>«»", ")(][}{><»«")


def _mirror(c: str) -> str:
    return c.translate(_PAIRS)


def prepared(text: str) -> str:
    """A password or name as SASLprep maps it: odd spaces as spaces, invisible characters gone, form KC; forbidden ones raise."""
    import stringprep

    out = "".join(" " if stringprep.in_table_c12(c) else c for c in text if not stringprep.in_table_b1(c))
    out = unicodedata.normalize("NFKC", out)
    for c in out:
        if stringprep.in_table_c21_c22(c) or stringprep.in_table_c3(c) or stringprep.in_table_c4(c) or stringprep.in_table_c5(c) or stringprep.in_table_c6(c) or stringprep.in_table_c7(c) or stringprep.in_table_c8(c) or stringprep.in_table_c9(c):
            raise ValueError("a character that names can't hold")
    if any(map(stringprep.in_table_d1, out)) and (any(map(stringprep.in_table_d2, out)) or not (stringprep.in_table_d1(out[0]) and stringprep.in_table_d1(out[-1]))):
        raise ValueError("directions are mixed")
    return out


def utf16(data: bytes, big: bool = True) -> str:
    """UTF-16 of any quality: what can't be decoded becomes the replacement character, nothing raises."""
    return data.decode("utf-16-be" if big else "utf-16-le", "replace")


def over_text(name: str, text: Column) -> Column:
    """One of this module's functions from text to text over a column; null stays null."""
    f = {"presentation": presentation, "logical": logical, "prepared": prepared}[name]

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run(text)
