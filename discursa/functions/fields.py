"""Fields of a delimited record and typed values of comment exports, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from discursa.functions.binding import let
from discursa.functions.text import strip

# One field after its leading comma: a quoted run with doubled quotes, or plain text.
_FIELD = r',("[^"]*+(?:""[^"]*+)*+"?+[^,]*+|[^,]*+)'
_QUOTED = r'^(?s)"([^"]*+(?:""[^"]*+)*+)"?+(.*)$'

DATE_SHAPE = r"^\d{1,2}/\d{1,2}/\d{4}$"
CLOCK_SHAPE = r"^\s*\d{1,2}\.\d{2}\.\d{2}\s*$"


def split_record(record: Column) -> Column:
    """Fields of one record; quotes count only at the start of a field."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD), F.lit(1))

    def unquote(f: Column) -> Column:
        inner = F.replace(F.regexp_extract(f, _QUOTED, 1), F.lit('""'), F.lit('"'))
        return F.when(
            f.startswith('"'), F.concat(inner, F.regexp_extract(f, _QUOTED, 2))
        ).otherwise(f)

    return F.when(record == "", F.array().cast("array<string>")).otherwise(
        F.transform(raw, unquote)
    )


def join_record(fields: Column) -> Column:
    """Inverse of split_record: quote a field only when it needs it."""
    return F.array_join(
        F.transform(
            fields,
            lambda f: F.when(
                f.rlike('[",\r\n]'),
                F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"')),
            ).otherwise(f),
        ),
        ",",
    )


def comment_time(date: Column, clock: Column) -> Column:
    """D/M/YYYY and H.MM.SS to a zone-free timestamp; NULL when not a real date or time."""
    shape = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2})\.(\d{1,2})\.(\d{1,2})$"

    def build(stamp: Column) -> Column:
        d, m, y, h, mi, s = (F.regexp_extract(stamp, shape, i).cast("int") for i in range(1, 7))
        return F.when(stamp.rlike(shape), F.try_make_timestamp_ntz(y, m, d, h, mi, s))

    return let(F.concat_ws(" ", strip(date), strip(clock)), build)


def whole_number(value: Column) -> Column:
    """Integer literal with optional sign and digit separators, else NULL."""
    v = strip(value)
    return F.when(
        v.rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(v, F.lit("_"), F.lit("")).try_cast("bigint")
    )


def is_reply(threaded: Column, kind: Column) -> Column:
    """In a threaded export every row whose type is not PARENT is a reply."""
    return threaded & (F.upper(strip(kind)) != "PARENT")


def record_post(id_: Column) -> Column:
    return F.split_part(id_, F.lit("#"), F.lit(1))


def record_number(id_: Column) -> Column:
    """Number in post#number or post#number.part."""
    number = F.split_part(id_, F.lit("#"), F.lit(2))
    return F.regexp_replace(number, r"^(\d+)\.\d+$", "$1").try_cast("bigint")
