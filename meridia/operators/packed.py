"""Several values packed in one field.

Quoted spans become indexed placeholders, the rest is split at the field's
delimiters, the spans come back by array lookup, and the pieces are exploded
with their positions. Everything stays in built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Private-use characters that frame a placeholder's index. Where a text holds
#: one itself, that character becomes a placeholder too, so nothing collides.
OPEN, SHUT = "", ""
SPAN = rf'"(?:[^"\\]|\\.)*"|[{OPEN}{SHUT}]'
HELD = rf"{OPEN}(\d+){SHUT}"

_WORD = r"\s+(?:and|or|AND|OR|And|Or)\s+"
_BREAK = r"[\r\n\t]+"
#: What may stand between two telephone numbers. A blank or hyphen may not: both occur within a number.
PHONE_DELIMITER = rf"\s*[,;/|&]+\s*|\s*{_BREAK}\s*|{_WORD}"
#: Between addresses any blank separates, but not the one between a display name and its "<".
EMAIL_DELIMITER = rf"\s*[,;/|&]+\s*|\s*{_BREAK}\s*|{_WORD}|(?<=[^\s<])(?<![{SHUT}])\s+(?!<)|(?<={SHUT})\s+(?!<)"
#: In links , ; and & occur within queries; they separate only before a new value, a blank or the end.
_NEXT = rf"(?=\s|$|[,;|]|[{OPEN}]|https?://|HTTPS?://|www\.|WWW\.)"
WEBSITE_DELIMITER = rf"\s*[,;|]+{_NEXT}\s*|\s+[/&]+\s+|\s*{_BREAK}\s*|{_WORD}|(?<=\S)\s+(?=\S)"

DELIMITERS = {"phones": PHONE_DELIMITER, "emails": EMAIL_DELIMITER, "websites": WEBSITE_DELIMITER}


def split_packed(text: Column, delimiter: str) -> Column:
    """The values of one packed text, in order, as array<string>.

    Null gives an empty array, as do blanks and delimiters alone; a text with a
    bracketed list of quoted values counts as that list. Quote marks that
    enclose a whole value go, all else stays as written. An unpaired quote mark
    is an ordinary character.
    """
    bare = F.regexp_replace(text, r"^\s*\[\s*(\"[\s\S]*\")\s*\]\s*$", "$1")
    spans = F.regexp_extract_all(bare, F.lit(f"({SPAN})"), F.lit(1))
    around = F.split(bare, SPAN, -1)
    framed = F.array_join(
        F.transform(around, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(SHUT), s))), ""
    )

    def restore(piece: Column) -> Column:
        at = F.regexp_extract_all(piece, F.lit(HELD), F.lit(1))
        between = F.split(piece, HELD, -1)
        return F.array_join(
            F.transform(between, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.element_at(spans, F.get(at, i - 1).cast("int") + 1), s))), ""
        )

    pieces = F.filter(F.split(framed, delimiter, -1), lambda p: F.length(F.regexp_replace(p, r"^[\s,;/|&]+|[\s,;/|&]+$", "")) > 0)
    values = F.transform(pieces, lambda p: restore(F.regexp_replace(p, r"^[\s,;|&]+|[\s,;|&]+$", "")))
    values = F.transform(values, lambda v: F.trim(F.regexp_replace(v, r'^"((?:[^"\\]|\\.)*)"$', "$1")))
    return F.coalesce(F.filter(values, lambda v: F.length(v) > 0), F.array().cast("array<string>"))


def unpack(df: DataFrame, key: str, fields: dict[str, Column], delimiters: dict[str, str] = DELIMITERS, all_rows: bool = False) -> DataFrame:
    """(key, field_name, pos, val): one row per single value of the array columns in fields.

    pos counts from 1 through all elements of a field in order, empty pieces
    left out. Only fields of which at least one element holds several values
    come out, unless all_rows. Null arrays, null elements and empty texts give
    no rows; repeated rows of the input give repeated rows. Other columns of
    df don't matter, whatever their names. One row's values are exploded where
    they are, without a shuffle.
    """
    def lists_of(name: str, col: Column) -> Column:
        elements = F.coalesce(col, F.array().cast("array<string>"))
        return F.struct(F.lit(name).alias("f"), F.transform(elements, lambda e: split_packed(e, delimiters[name])).alias("parts"))

    lists = [lists_of(name, col) for name, col in fields.items()]
    each = df.select(F.col(key).alias(key), F.explode(F.array(*lists)).alias("_x"))
    if not all_rows:
        each = each.where(F.exists("_x.parts", lambda p: F.size(p) > 1))
    return each.select(key, F.col("_x.f").alias("field_name"), F.posexplode(F.flatten("_x.parts")).alias("_p", "val")).select(
        key, "field_name", (F.col("_p") + 1).cast("int").alias("pos"), "val"
    )
