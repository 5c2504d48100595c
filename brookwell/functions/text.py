"""String functions of the retrieval pipeline as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "<SEP>"
#: Field delimiter and end mark of extraction records.
FIELD, DONE = "<|#|>", "<|COMPLETE|>"
#: ASCII white space and Unicode's separators.
BLANKS = " \t\n\v\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_CONTROLS = "".join(map(chr, [*range(9), 11, 12, *range(14, 32), 127, 0xFFFE, 0xFFFF]))
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufffe\uffff]"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def hashed_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(c))


def args_hash(*parts: Column) -> Column:
    """Digest of the parts one after the other, without separators."""
    return F.md5(F.concat(*(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)))


def multi_split(c: Column, *markers: str) -> Column:
    """Pieces between any of the literal markers, stripped, without empty ones."""
    quoted = "|".join("".join("\\" + x if not x.isalnum() else x for x in m) for m in markers)
    return F.filter(F.transform(F.split(c, quoted), strip), lambda x: x != "")


def sanitize(c: Column, outer_quotes: bool = False) -> Column:
    """Without control characters (tab, line feed and carriage return stay) and non-characters, stripped of blanks; with ``outer_quotes`` of quotes at the ends, too."""
    c = F.when(c.rlike(_CONTROL), F.translate(c, _CONTROLS, "")).otherwise(c)
    if outer_quotes:
        c = F.btrim(F.btrim(c, F.lit('"')), F.lit("'"))
    return strip(c)


def repair_fields(c: Column) -> Column:
    """Damaged field delimiters made whole."""
    return F.regexp_replace(c, r"<\s*#\s*>", FIELD)


#: What counts as a number, and the marks of a model's thoughts.
NUMBER = r"^[-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?$"
THOUGHTS = r"(?s)<think>.*?</think>"


def is_number(c: Column) -> Column:
    return strip(c).rlike(NUMBER)


def without_thoughts(c: Column) -> Column:
    return strip(F.regexp_replace(c, THOUGHTS, ""))


def plain_quotes(c: Column) -> Column:
    return F.translate(c, "\u201c\u201d\u201e\u2018\u2019", "\"\"\"''")


def mentions(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"@([\p{L}\p{N}_]+)"), F.lit(1))


def without_mention(c: Column, name: str, otherwise: str) -> Column:
    """The question that is left once ``@name`` is cut out, or ``otherwise``."""
    rest = strip(F.regexp_replace(c, f"(?i)@{name}", ""))
    return F.when(rest == "", otherwise).otherwise(rest)


def without_fence(c: Column) -> Column:
    """The inside of a fenced code block; other text as it is, stripped."""
    c = strip(c)
    return F.when(c.startswith("```"), strip(F.regexp_replace(F.regexp_replace(c, r"^```[^\n]*\n?", ""), r"(?s)```[^`]*$", ""))).otherwise(c)


def entity_type(c: Column) -> Column:
    """Lower-case type name: null if it has brackets or bars, else the first non-empty part before a comma."""
    first = F.element_at(F.filter(F.transform(F.split(c, ","), strip), lambda x: x != ""), 1)
    return F.when(~c.rlike(r"['()<>|/\\]") & (F.size(F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")) > 0), F.lower(F.replace(first, F.lit(" "), F.lit(""))))


def head_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def tail_lines(c: Column) -> Column:
    """What follows the first newline; empty without one."""
    return F.regexp_extract(c, r"(?s)^[^\n]*\n(.*)$", 1)


#: File extension to media type.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}


def media_type(path: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))
    return F.coalesce(kinds[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))], F.lit("image/jpeg"))


def safe_label(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_]+", "_")


def quoted_label(c: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))


def pair_key(a: Column, b: Column) -> Column:
    """One key for both directions of a relation."""
    return F.concat_ws(SEP, F.least(a, b), F.greatest(a, b))


def joined_ids(ids: Column) -> Column:
    return F.array_join(F.filter(ids, lambda x: x.isNotNull() & (x != "")), SEP)


def word_count(c: Column) -> Column:
    """Number of runs of other characters than white space."""
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0)).cast("long")


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def json_text(c: Column) -> Column:
    """The JSON of a model's answer: the text without thoughts and fence, else its first braces up to the first or to the last closing one; null if none of them parses."""
    plain = without_fence(without_thoughts(c))
    tried = [plain, F.regexp_extract(plain, r"(?s)\{.*?\}", 0), F.regexp_extract(plain, r"(?s)\{.*\}", 0)]
    return F.coalesce(*(F.when(F.try_parse_json(x).isNotNull(), x) for x in tried))


def json_quoted(c: Column) -> Column:
    """A string as JSON, other characters than quotes, backslashes and control characters as they are; null as ``null``."""
    return F.coalesce(F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.cast("string").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)), F.lit("null"))


def first_words(c: Column, n: int = 12) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)), 1, n), " ")
