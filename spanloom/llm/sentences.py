"""Sentence units of documents in any script, as SQL expressions only.

Everything that could be mistaken for a sentence end (decimals, URLs, initials, abbreviations, list marks, the insides of quotations and
brackets) is masked by private-use characters, one for one (those of the text itself are set aside), so offsets in the masked text are offsets in the text. Then one regex of
script-specific terminators cuts the masked text at zero-width positions; the units' text is taken from the original by offset.

Null and blank texts give no rows. A repeated ``doc_id`` gives its rows for each of its texts. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import once

DOT, CLOSED, GAP, STOP, BREAK, EDGE = "\ue001", "\ue002", "\ue003", "\ue00e", "\ue00f", "\ue000"
#: Stands for those six where the text itself has them: no white space, letter or end mark either.
TAKEN = "\ue010"

#: Abbreviations after which a sentence never ends, and those that only bind a number.
TITLES = "Sen|Gov|Gen|Rev|Hon|Capt|Sgt|Maj|Ing|Dipl|Dr|Dra|Prof|Mr|Mrs|Ms|Mme|Mlle|MM|Sr|Sra|Srta|Sres|Dña|Hr|Fr|St|Ste|Vgl|vgl|bzw|cf|Cf|evtl|ggf|inkl"
NUMBERED = "No|Nr|nº|núm|Núm|pp|p|pág|págs|fig|Fig|figs|art|Art|S|Abb|ca|approx|aprox|env|vol|Vol|cap|chap|Tel|tel|ref|Ref|Rn|Kap"
MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jan|Feb|Apr|Jun|Jul|Aug|Sep|Sept|Okt|Nov|Dez"

NO_WORD = r"(?<![\p{L}\p{N}])"
#: Full stops that end nothing. The pattern starts at the stop, so the scan is one comparison a character.
MASK = r"\.(?:" + "|".join([
    r"(?<=[\p{L}\p{N}/_@-]\.)(?=[\p{L}\p{N}/_@-])",  # decimals, versions, URLs, inner dots
    r"(?<=" + NO_WORD + r"\p{L}\.)(?=\s?(?:B|h|ä|a|ej|m|V|g|e|d|R)\.)",  # first halves of z. B., p. ej., a. m., e. V.
    r"(?<=\b(?:z\.\s?B|d\.\s?h|u\.\s?a|p\.\s?ej|i\.\s?e|e\.\s?g|c\.-à-d|par\sex)\.)",
    r"(?<=" + NO_WORD + f"(?:{TITLES})" + r"\.)(?=\s)",
    r"(?<=" + NO_WORD + f"(?:{NUMBERED})" + r"\.)(?=\s*[\d£€$])",
    r"(?<=(?<![\p{L}\p{N}.])(?<!\be\.\s?)\p{Lu}\.)(?=\s+\p{Lu})",  # initials, S. Coop.
    r"(?<=\bCo\.)(?=\s+KG)",
    r"(?<=(?<![\p{L}\p{N}.,])\d{1,2}\.)(?=\s+(?:" + MONTHS + r")(?!\p{L}))",
    r"(?<=(?:^|\n)[^\S\n]{0,8}\(?(?:\d{1,3}|\p{L})\.)(?=\s)",  # list marks
]) + ")"
#: Scans start with a class of one range besides Latin characters, as a union of many is slow to test; the exact class follows in a lookbehind.
ENDS = r"[.!?…।॥。！？｡．؟۔։።፧។៕။།‼⁇⁈⁉]"
SPACES = r"[\s\xa0  -   　]"
#: Quotations and brackets within a line; the first opener decides which way « and » point.
PAIRS = (
    r"(?=[\"(\[«»‘-（])("
    r"“[^“”\n]*”|\([^()\n]*\)|\"[^\"\n]*\"|‘(?:[^‘’\n]|’(?=\p{L}))*’|„[^„“”\n]*[“”]|«[^«»\n]*»|»[^«»\n]*«"
    r"|「[^「」\n]*」|『[^『』\n]*』|《[^《》\n]*》|（[^（）\n]*）|\[[^\[\]\n]*\])"
)
CJK = "[぀-鿿가-힯]"
THAI = "[฀-๿]"
#: A terminator, its closers, and a white space that becomes BREAK, unless the sentence goes on behind it.
SPACED = (
    r"([.!?\x{589}-．](?<=[.!?…।॥。！？｡．؟۔։።፧។៕။།‼⁇⁈⁉\x{E002}])[\"”’»«)\]]{0,2})" + SPACES
    + "(?=" + SPACES + r"*+(?!\p{Ll}|[—–,;:]|[\"“‘«»„]\s?\p{Ll}|\([\p{Ll}\d£€$])[^\s\xa0])"
)
#: Scripts that write no space after the terminator: the terminator itself becomes STOP.
UNSPACED = (
    r"[。！？｡．](?=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}「『“（《\p{N}\p{Lu}])"
    r"|…(?=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}「『“《])"
    r"|\x{E002}(?=[\p{IsHan}\p{IsKatakana}\p{IsHangul}「『“《]|[\p{IsHiragana}&&[^とっのをがはもにでやへ]])"
)
#: Thai has no terminator: the blank is the end mark.
BLANK = SPACES + r"(?<=[฀-๿][\d.,\x{E001}]{0,12}" + SPACES + ")(?=[^\\S\\n]*[฀-๿])"
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
LIST_MARK = r"^\s*(?:[•▪·*–-]|\(?\d{1,3}[.)])\s"


def _unwrap(text: Column, lines: Column, width: Column) -> Column:
    """Line breaks inside a sentence become blanks: the next line goes on in lower case, or its first word comes near the width of the longest line."""
    after = F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.lit("")))

    def join(line: Column, nxt: Column) -> Column:
        filled = F.length(F.rtrim(line)) + 1 + F.length(F.regexp_extract(nxt, r"^\s*(\S*)", 1)) > width * 0.75
        soft = line.rlike(r"\S") & (nxt.rlike(r"^\s*[\p{Ll}?!;:,.)»%€]") | (nxt.rlike(r"\S") & filled & ~nxt.rlike(LIST_MARK)))
        return F.concat(line, F.when(soft, F.lit(" ")).otherwise(F.lit("\n")))

    return F.array_join(F.zip_with(lines, after, join), "")


def _enclose(text: Column) -> Column:
    """Hide terminators and blanks inside quotations and brackets; a closer right behind a terminator becomes CLOSED."""

    def mask(seg: Column) -> Column:
        last = F.when(seg.rlike(ENDS + r"\s*.$"), F.lit(CLOSED)).otherwise(F.substring(seg, -1, 1))
        inner = F.regexp_replace(F.regexp_replace(F.substring(seg, F.lit(1), F.length(seg) - 1), ENDS, DOT), SPACES, GAP)
        return F.when(seg.rlike("^" + PAIRS + "$"), F.concat(inner, last)).otherwise(seg)

    parts = F.split(F.regexp_replace(text, PAIRS, EDGE + "$1" + EDGE), EDGE)
    return F.array_join(F.transform(parts, mask), "")


def sentence_offsets(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = 256) -> DataFrame:
    """``(key, start_char, end_char)`` of every unit, code points, half open. Prefix sums run in blocks, so cost is linear in a document's units up to ``block`` squared."""
    t = F.replace(F.col(text), F.lit("\r\n"), F.lit(" \n"))
    t = F.when(t.rlike(r"[\r\x0b\x0c\x85 - ]"), F.translate(t, "\r\x0b\x0c\x85  ", "\n" * 6)).otherwise(t)
    t = F.when(t.rlike("[\\x{E000}-\\x{E003}\\x{E00E}\\x{E00F}]"), F.translate(t, EDGE + DOT + CLOSED + GAP + STOP + BREAK, TAKEN * 6)).otherwise(t)
    d = docs.select(F.col(key), t.alias("t")).where(F.col(text).rlike(r"[^\p{IsWhite_Space}\x{FEFF}]"))
    wrapped = F.col("t").rlike(r"\n(?<!\n\n)[^\S\n]*\p{Ll}")
    d = once(d, lines=F.when(wrapped, F.split("t", "\n", -1)))
    d = once(d, width=F.array_max(F.transform("lines", lambda x: F.length(F.rtrim(x)))))
    d = once(d, t=F.when(F.col("lines").isNull(), F.col("t")).otherwise(_unwrap(F.col("t"), F.col("lines"), F.col("width")))).drop("lines", "width")
    d = once(d, t=F.regexp_replace("t", MASK, DOT))
    d = once(d, t=F.regexp_replace(_enclose(F.col("t")), SPACED, "$1" + BREAK))
    d = once(d, t=F.when(F.col("t").rlike(CJK), F.regexp_replace("t", UNSPACED, STOP)).when(F.col("t").rlike(THAI), F.regexp_replace("t", BLANK, BREAK)).otherwise(F.col("t")))
    white = F.lit(WHITE)

    def measure(s: Column) -> Column:
        whole = F.length(s)
        ragged = F.contains(white, F.substring(s, 1, 1)) | F.contains(white, F.substring(s, -1, 1))
        lead = F.when(ragged, whole - F.length(F.ltrim(s, white))).otherwise(0)
        core = F.when(ragged, F.length(F.trim(s, white))).otherwise(whole)
        return F.struct((whole + F.when(s.endswith(STOP), 0).otherwise(1)).alias("n"), lead.alias("a"), core.alias("c"))

    d = once(d, u=F.transform(F.split("t", f"[\n{BREAK}]|(?<={STOP})", -1), measure)).drop("t")
    empty = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    run = lambda units: F.aggregate(
        units,
        F.struct(F.lit(0).alias("p"), empty.alias("o")),
        lambda acc, x: F.struct((acc["p"] + x["n"]).alias("p"), F.array_append(acc["o"], F.struct((acc["p"] + x["a"]).alias("s"), (acc["p"] + x["a"] + x["c"]).alias("e"))).alias("o")),
    )
    d = once(d, b=F.transform(F.sequence(F.lit(0), ((F.size("u") - 1) / block).cast("int")), lambda i: F.slice(F.col("u"), i * block + 1, block))).drop("u")
    d = once(d, b=F.transform("b", run))
    base = F.aggregate("b", F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x["p"]))
    d = once(d, base=base)
    spans = F.flatten(F.zip_with("b", F.slice("base", 1, F.size("b")), lambda x, off: F.transform(x["o"], lambda o: F.struct((o["s"] + off).alias("s"), (o["e"] + off).alias("e")))))
    d = d.select(key, F.explode(spans).alias("x"))
    return d.where("x.e > x.s").select(key, F.col("x.s").cast("int").alias("start_char"), F.col("x.e").cast("int").alias("end_char"))
