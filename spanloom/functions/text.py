"""Scalar text functions as native Column expressions; Arrow UDFs only where Spark has no Unicode decomposition.

Every function returns null for null. ``\\s``, ``\\w`` and ``\\b`` of Java are ASCII, so Unicode classes are spelled out.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spanloom.session import ship

WORD = r"[\p{L}\p{N}]+"
NOT_BEFORE, NOT_AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def text_udf(f):
    """An Arrow UDF of strings that sees to it that executors have this package."""
    udf = F.pandas_udf(f, StringType())

    @functools.wraps(f)
    def call(c: Column | str) -> Column:
        if (spark := SparkSession.getActiveSession()) is not None:
            ship(spark)
        return udf(c)

    return call


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def title_cased(text: Column | str) -> Column:
    """Alphabetic runs of four or more letters without a lower-case one become capitalised, where that keeps their byte length."""
    def cased(run: Column) -> Column:
        new = F.concat(F.substring(run, 1, 1), F.lower(F.substring(run, F.lit(2), F.length(run))))
        fits = (F.length(run) >= 4) & run.rlike(r"^\p{IsAlphabetic}{4,}$") & ~run.rlike(r"\p{Ll}") & (F.octet_length(new) == F.octet_length(run))
        return F.when(fits, new).otherwise(run)

    # split keeps linear cost: each piece is a run of letters with what follows it
    t = col(text)
    runs = F.split(t, r"(?<=\p{IsAlphabetic})(?=\P{IsAlphabetic})|(?<=\P{IsAlphabetic})(?=\p{IsAlphabetic})", -1)
    return F.when(t.rlike(r"[\p{IsAlphabetic}&&\P{Ll}]{4}"), F.array_join(F.transform(runs, cased), "")).otherwise(t)  # most texts have no such run


def byte_offset(text: Column | str, chars: Column | str) -> Column:
    """UTF-8 bytes before a code-point offset."""
    return F.octet_length(F.substring(col(text), F.lit(1), col(chars)))


def utf16_offset(text: Column | str, chars: Column | str) -> Column:
    """UTF-16 units before a code-point offset; null when the offset is out of range."""
    t, k = col(text), col(chars)
    units = (F.octet_length(F.encode(F.substring(t, F.lit(1), k), "utf-16be")) / 2).cast("int")
    return F.when((k >= 0) & (k <= F.length(t)), units)


def utf16_of_byte(text: Column | str, byte: Column | str) -> Column:
    """UTF-16 units before a UTF-8 byte offset; null out of range or inside a character."""
    raw = F.encode(col(text), "utf-8")
    k = col(byte)
    nxt = F.conv(F.hex(F.substring(raw, k + 1, F.lit(1))), 16, 10).cast("int")
    inside = F.coalesce((nxt >= 128) & (nxt < 192), F.lit(False))
    units = (F.octet_length(F.encode(F.decode(F.substring(raw, F.lit(1), k), "utf-8"), "utf-16be")) / 2).cast("int")
    return F.when((k >= 0) & (k <= F.octet_length(raw)) & ~inside, F.when(k == 0, 0).otherwise(units))


def norm(text: Column | str) -> Column:
    """Lower case, every run of other characters than letters and digits one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}]+", " "))


def words(text: Column | str) -> Column:
    """The words in order, folded; split rather than extract-all, whose matches each copy the text."""
    folded = F.regexp_replace(F.lower(col(text)), "ß", "ss")
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words_: str, size: int) -> Column:
    """Distinct runs of ``size`` words of a column of words, null where there are fewer.

    It takes a column by name, not an expression: inside a lambda the words would be computed anew for every run (see ``session.once``).
    """
    w = F.col(words_)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " "))
    return F.when(F.size(w) >= size, F.array_distinct(runs))


def quoted(term: Column | str) -> Column:
    r"""A term as a literal regex; ``\E`` inside it is escaped."""
    return F.concat(F.lit(r"\Q"), F.replace(col(term), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def has_name(text: Column | str, name: Column | str) -> Column:
    """The name as whole words, in any case; an underscore is a boundary. The cheap test comes first."""
    t = col(text)
    return F.contains(F.lower(t), F.lower(col(name))) & F.regexp_like(t, F.concat(F.lit("(?iu)" + NOT_BEFORE), quoted(name), F.lit(NOT_AFTER)))


def has_keyword(text: Column | str, keyword: Column | str) -> Column:
    """An ASCII keyword as a whole word, any other as a substring."""
    t, k = col(text), col(keyword)
    whole = F.regexp_like(t, F.concat(F.lit("(?<![0-9A-Za-z])"), quoted(k), F.lit("(?![0-9A-Za-z])")))
    return F.when(k.rlike(r"^\p{ASCII}+$"), F.contains(t, k) & whole).otherwise(F.contains(t, k))


#: Character references resolved natively; ``unescape_all`` knows the whole HTML table.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&euro;": "€", "&pound;": "£", "&amp;": "&"}


#: Tags at which a line ends.
LINE_TAGS = ["br", "/p", "/div", "/tr", "/dd", "/dt", "/li", *(f"/h{i}" for i in range(10))]


def strip_tags(html: Column | str, unescape: bool = True) -> Column:
    """HTML to lines of text: scripts and styles go, some tags end a line, others are blanks; blanks and lines are squeezed.

    The page is taken apart at ``<`` once; each part is a tag and the text behind it, or text if it has no ``>``.
    """
    x = F.regexp_replace(col(html), r"<(script|style)[\s\S]*?</\1>", " ")

    def replaced(part: Column, i: Column) -> Column:
        stop = F.instr(part, ">")
        tag = F.rtrim(F.rtrim(F.lower(F.substring(part, F.lit(1), stop - 1))), F.lit(" /"))
        mark = F.when(tag.isin(LINE_TAGS), F.lit("\n")).otherwise(F.lit(" "))
        text = F.concat(mark, F.substring(part, stop + 1, F.length(part)))
        return F.when(i == 0, part).when(stop > 1, text).otherwise(F.concat(F.lit("<"), part))

    x = F.array_join(F.transform(F.split(x, "<", -1), replaced), "")
    if unescape:
        for name, char in ENTITIES.items():
            x = F.replace(x, F.lit(name), F.lit(char))
    return squeeze(x)


def squeeze(text: Column | str) -> Column:
    """Lines without blanks around them, before closing punctuation or in a row; empty lines go."""

    def line(x: Column) -> Column:
        words = F.array_join(F.filter(F.split(x, r"[ \t]"), lambda w: w != ""), " ")
        return F.regexp_replace(words, r" (?=[,.;:)])", "")

    lines = F.filter(F.transform(F.split(col(text), "\n", -1), line), lambda x: x != "")
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


@text_udf
def unescape_all(s: pd.Series) -> pd.Series:
    """Character references by the whole HTML5 table."""
    import html

    return s.map(html.unescape, na_action="ignore")


def grouped(text: Column | str, size: int = 4) -> Column:
    return F.rtrim(F.regexp_replace(col(text), f"(.{{{size}}})", "$1 "))


def as_text(c: Column | str) -> Column:
    """A scalar as trimmed text, null as empty."""
    return F.trim(F.coalesce(col(c).cast("string"), F.lit("")))


def as_list(json: Column | str) -> Column:
    """A JSON list of strings, a JSON scalar or nothing, as an array."""
    c = F.trim(col(json))
    return F.when(c.isNull() | (c == "") | (c == "null"), F.expr("cast(array() as array<string>)")).when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))


def fr_date(iso: Column | str) -> Column:
    return F.date_format(F.try_to_date(col(iso), "yyyy-MM-dd"), "dd/MM/yyyy")


#: Fixed values.
ES_MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
ES_DAYS = ["lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo"]


def es_long_date(iso: Column | str) -> Column:
    d = F.try_to_date(col(iso), "yyyy-MM-dd")
    return F.concat(F.dayofmonth(d).cast("string"), F.lit(" de "), F.element_at(F.array(*map(F.lit, ES_MONTHS)), F.month(d)), F.lit(" de "), F.year(d).cast("string"))


def es_weekday(iso: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, ES_DAYS)), F.weekday(F.try_to_date(col(iso), "yyyy-MM-dd")) + 1)


def name_words(name: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.filter(words(name), lambda w: (F.length(w) >= 2) & w.rlike(r"^\p{L}+$"))))


def same_name(a: Column | str, b: Column | str) -> Column:
    """Equal sets of words of two or more letters; two empty sets are not the same name."""
    x, y = name_words(a), name_words(b)
    return F.coalesce((F.size(x) > 0) & (x == y), F.lit(False))


def court_pieces(name: Column | str) -> Column:
    """``[head, place]`` of a court's name: the capitalised place behind de, du, des or d' at its end, if any."""
    c, pattern = col(name), r"^(.*\b(?:de |du |des |d['’]))(\p{Lu}[\p{L}\p{N} '’-]*)$"
    return F.when(c.rlike(pattern), F.array(F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2))).otherwise(F.array(c, F.lit(None).cast("string")))


def residual_names(text: Column | str, boilerplate: str) -> Column:
    """Capitalised sequences that look like names once the boilerplate is blanked: two or more words, two of over two letters, not all short capitals."""
    rest = F.regexp_replace(col(text), boilerplate, " | ")
    runs = F.regexp_extract_all(rest, F.lit(r"\p{Lu}[\p{L}'’-]*(?: \p{Lu}[\p{L}'’-]*)+"), F.lit(0))

    def is_name(run: Column) -> Column:
        w = F.split(run, " ")
        return (F.size(F.filter(w, lambda x: F.length(x) > 2)) >= 2) & ~F.forall(w, lambda x: (F.length(x) <= 4) & (x == F.upper(x)))

    return F.filter(runs, is_name)


def is_plain_name(text: Column | str) -> Column:
    """Two to four capitalised words without a digit."""
    c = col(text)
    w = F.split(F.trim(c), r"\s+")
    return F.size(w).between(2, 4) & F.forall(w, lambda x: x.rlike(r"^\p{Lu}")) & ~c.rlike(r"\d")


def has_injected_json(text: Column | str) -> Column:
    return col(text).rlike(r"""\{\s*["']?(types|never_hide|dictionary)""")


def _decompose(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@text_udf
def fold_lower(s: pd.Series) -> pd.Series:
    """Straight apostrophes, ss for ß, lower case, no accents."""
    return s.map(lambda x: _decompose(x.replace("’", "'").replace("ß", "ss").lower()), na_action="ignore")


@text_udf
def fold_keep_case(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _decompose(x.replace("’", "'").replace("ß", "ss")), na_action="ignore")


@text_udf
def slug(s: pd.Series) -> pd.Series:
    """No accents, lower case, ASCII letters and digits only."""
    return s.map(lambda x: "".join(c for c in _decompose(x).lower() if c.isascii() and c.isalnum()), na_action="ignore")
