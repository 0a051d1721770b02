"""Text to instant: event text, ISO-8601 and log formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every whitespace character, as stripped from both ends of log lines and fields.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Format directives and the Spark pattern letters they stand for.
# The second entry is the fixed-width form, used next to another number.
_DIRECTIVES = {
    "Y": ("yyyy", "yyyy"),
    "m": ("M", "MM"),
    "d": ("d", "dd"),
    "H": ("H", "HH"),
    "I": ("h", "hh"),
    "M": ("m", "mm"),
    "S": ("s", "ss"),
    "f": ("SSSSSS", "SSSSSS"),
    "j": ("D", "DDD"),
    "b": ("MMM", "MMM"),
    "B": ("MMMM", "MMMM"),
    "p": ("a", "a"),
    "z": ("[XXX][XX]", "[XXX][XX]"),
}
_TEXT_DIRECTIVES = "bBpz"
SYSLOG_FORMAT = "%b %d %H:%M:%S"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def parse_event_time(text: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss` found anywhere in the text, else any castable form."""
    plain = F.regexp_extract(text, r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", 0)
    return F.coalesce(
        F.try_to_timestamp(F.when(plain != "", plain), F.lit("yyyy-MM-dd HH:mm:ss")),
        text.try_cast("timestamp"),
    )


# Fixed value: the forms of ISO-8601 text taken as they are.
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$"


def parse_iso(text: Column) -> Column:
    """ISO-8601 date or date-time, basic or extended, `Z` or offset; else NULL."""
    basic = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=$|\D)", "$1-$2-$3")
    clock = F.regexp_replace(basic, r"^(\S{10}[T ]\d{2})(\d{2})(\d{2})(?=$|[.,Z+-])", "$1:$2:$3")
    clock = F.regexp_replace(clock, r"^(\S{10}[T ]\d{2})(\d{2})(?=$|[Z+-])", "$1:$2")
    full = F.regexp_replace(clock, r"^(\S{10}[T ]\d{2})(?=$|[Z+-])", "$1:00")
    full = F.regexp_replace(full, r"^(\S{10}[T ]\d{2}:\d{2})(?=$|[Z+-])", "$1:00")
    full = F.regexp_replace(full, r"(\d),(\d)", "$1.$2")
    full = F.regexp_replace(full, r"(:\d{2}(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2")
    full = F.regexp_replace(full, r"(:\d{2}(?:\.\d+)?[+-]\d{2})$", "$1:00")
    return F.when(text.rlike(ISO_SHAPE), text.try_cast("timestamp")).when(
        full.rlike(ISO_SHAPE), full.try_cast("timestamp")
    )


def spark_pattern(fmt: str) -> str:
    """Translate a strptime format into a Spark datetime pattern."""
    tokens: list[tuple[str, str]] = []
    i = 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            tokens.append(("text", "%") if fmt[i + 1] == "%" else ("field", fmt[i + 1]))
            i += 2
        elif fmt[i].isspace():
            if not tokens or tokens[-1] != ("text", " "):
                tokens.append(("text", " "))
            i += 1
        else:
            tokens.append(("text", fmt[i]))
            i += 1

    def is_number(k: int) -> bool:
        return 0 <= k < len(tokens) and tokens[k][0] == "field" and tokens[k][1] not in _TEXT_DIRECTIVES

    out, literal = [], ""
    for k, (kind, what) in enumerate([*tokens, ("end", "")]):
        if kind == "text":
            literal += what
            continue
        if literal:
            plain = not any(c.isalpha() or c in "[]{}#'" for c in literal)
            out.append(literal if plain else "'" + literal.replace("'", "''") + "'")
            literal = ""
        if kind == "field":
            if what not in _DIRECTIVES:
                raise ValueError(f"unsupported directive %{what} in {fmt!r}")
            out.append(_DIRECTIVES[what][1 if is_number(k - 1) or is_number(k + 1) else 0])
    return "".join(out)


def parse_log_time(text: Column, fmt: str, year: Column) -> Column:
    """Instant by strptime format; NULL where the text does not fit.

    The syslog format carries no year, so `year` is put in front.
    """
    text = F.regexp_replace(text, r"\s+", " ")
    if fmt == SYSLOG_FORMAT:
        text, fmt = F.concat_ws(" ", year.cast("string"), text), "%Y " + fmt
    return F.try_to_timestamp(text, F.lit(spark_pattern(fmt)))
