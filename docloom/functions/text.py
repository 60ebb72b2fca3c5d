"""Scalar text functions as Catalyst columns. Null text counts as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The CJK block, the titles of a table of contents, and the key-term patterns that chunk texts depend on.
CJK = "[\\u4e00-\\u9fff]"
CONTENTS = ("目录", "Table of Contents", "TOC")
KEY_TERMS = (
    r"(以太网|Ethernet|SOMEIP|DoIP|CAN\s*FD|CANFD|LIN|FlexRay|AutoSAR|AUTOSAR|OSEK|UDS|OBD)",
    r"(Bootloader|刷写|烧写|调试工具|编译器|测试盒|休眠唤醒|网络管理|路由功能|诊断路由|诊断功能|信息安全|功能安全)",
    r"(R&A|S&A|CH事业部|供应商|埃泰克|负责|协助|验收|评审)",
    r"(ASIL\s*[A-D]|ISO\s*26262|GB\s*\d+|Q/BAIC|企标)",
    r"(EP1|EP2|PPV|PPAP|SOP|ESO|OTS|DV|PV)",
)


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_words(c: Column | str) -> Column:
    """Words of two or more ASCII letters, digits or underscores, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z0-9_]{2,}"), F.lit(0))


def tokenize(c: Column | str) -> Column:
    """CJK signs in order, ASCII words, then bigrams over the CJK signs alone (gaps are ignored)."""
    t = text_of(c)
    signs = F.regexp_extract_all(t, F.lit(CJK), F.lit(0))
    words = F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z0-9_]{2,}"), F.lit(0)), F.lower)
    pairs = F.when(F.size(signs) > 1, F.zip_with(F.slice(signs, 1, F.size(signs) - 1), F.slice(signs, 2, F.size(signs)), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(signs, words, pairs)


def estimate_tokens(c: Column | str) -> Column:
    """1.5 for each CJK sign and 0.3 for any other, at least 1."""
    t = text_of(c)
    signs = F.length(t) - F.length(F.regexp_replace(t, CJK, ""))
    return F.greatest(F.lit(1), (signs * 1.5 + (F.length(t) - signs) * 0.3).cast("int"))


def classify(title: Column | str, body: Column | str, rules) -> Column:
    """The first class whose pattern occurs in title and the first 500 signs of the body, else general_text."""
    seen = F.concat(text_of(title), F.lit(" "), F.left(text_of(body), F.lit(500)))
    out = None
    for name, pattern in rules:
        out = F.when(seen.rlike(pattern), name) if out is None else out.when(seen.rlike(pattern), name)
    return out.otherwise("general_text")


def key_terms(c: Column | str, patterns=KEY_TERMS, limit: int = 20) -> Column:
    """Distinct matches of all patterns, sorted, the first ``limit``, joined by a bar."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text_of(c), F.lit(p), F.lit(0)) for p in patterns]))
    return F.array_join(F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x) >= 2))), 1, limit), " | ")


def section_number(c: Column | str) -> Column:
    """The leading dotted number of a title, or null."""
    return F.nullif(F.regexp_extract(text_of(c), r"^(\d+(?:\.\d+)*)\s", 1), F.lit(""))


def module_name(c: Column | str) -> Column:
    """Table-of-contents titles give _TOC; titles of four CJK signs or more their first eight; else up to three words, cut at 20."""
    t = text_of(c)
    signs = F.regexp_extract_all(t, F.lit(CJK), F.lit(0))
    words = F.regexp_extract_all(t, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.when(F.trim(t).isin(*CONTENTS), "_TOC").when(F.size(signs) >= 4, F.array_join(F.slice(signs, 1, 8), "")).otherwise(F.left(F.array_join(F.slice(words, 1, 3), "_"), F.lit(20)))


def safe_id(c: Column | str, size: int = 50) -> Column:
    """Word signs and single underscores, cut to ``size``, without underscores at the ends."""
    said = text_of(c)
    t = F.regexp_replace(F.regexp_replace(said, r"(?U)[^\w]", "_"), "_+", "_")
    plain = (F.length(said) <= size) & said.rlike("^[A-Za-z0-9]++(?:_[A-Za-z0-9]++)*+\\z")  # most names are, and need one look
    return F.when(plain, said).otherwise(F.regexp_replace(F.left(t, F.lit(size)), "^_+|_+$", ""))


def slug(c: Column | str, size: int = 30) -> Column:
    """The first ``size`` signs, trimmed, white space as underscores."""
    return F.regexp_replace(F.trim(F.left(text_of(c), F.lit(size))), r"\s+", "_")


def rule_id(module: Column | str, kind: Column | str, text: Column | str) -> Column:
    return F.concat(F.lit("RULE_"), text_of(module), F.lit("_"), F.left(text_of(kind), F.lit(10)), F.lit("_"), F.left(F.md5(text_of(text).cast("binary")), F.lit(8)))


def voltage_range(c: Column | str) -> Column:
    """struct(low, high) of '9V-16V', '>18V' (high 99) and '<6V' (low 0); nulls where nothing matches."""
    t = text_of(c)
    span = r"(\d+(?:\.\d+)?)\s*V?\s*[-~]\s*(\d+(?:\.\d+)?)\s*V"
    over, under = r"[>≥]\s*(\d+(?:\.\d+)?)\s*V", r"[<≤]\s*(\d+(?:\.\d+)?)\s*V"
    number = lambda p, g: F.nullif(F.regexp_extract(t, p, g), F.lit("")).cast("double")
    low = F.coalesce(number(span, 1), number(over, 1), F.when(number(under, 1).isNotNull(), 0.0))
    high = F.coalesce(number(span, 2), F.when(number(over, 1).isNotNull(), 99.0), number(under, 1))
    return F.struct(low.alias("low"), high.alias("high"))


def coding_list(c: Column | str) -> Column:
    """array of struct(code, meaning) from '0x0=Off, 0x1=On' (full-width signs as well); entries without '=' are left out."""
    parts = F.filter(F.split(text_of(c), "[,，;；]"), lambda x: x.rlike("[=＝]"))
    return F.transform(parts, lambda x: F.struct(F.trim(F.split(x, "[=＝]", 2)[0]).alias("code"), F.trim(F.split(x, "[=＝]", 2)[1]).alias("meaning")))


def confidence(c: Column | str) -> Column:
    """CONFIDENCE=x, else 置信度 x, else a percentage, else the last number, else 0.5; above 1 is a percentage; within 0..1."""
    t = text_of(c)
    number = r"([0-9]+(?:\.[0-9]+)?)"
    pick = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit("")).cast("double")
    last = F.try_element_at(F.regexp_extract_all(t, F.lit(number), F.lit(1)), F.lit(-1)).cast("double")
    found = F.coalesce(pick("(?i)confidence\\s*[=:]\\s*" + number), pick("置信度\\s*[=:：]?\\s*" + number), pick(number + "\\s*%"), last, F.lit(0.5))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(found > 1, found / 100).otherwise(found)))


def json_part(c: Column | str, array: bool = True) -> Column:
    """The outermost JSON array (or object) of a model's answer, code fences stripped; null if there is none."""
    t = F.regexp_replace(text_of(c), "```(?:json)?", "")
    return F.nullif(F.regexp_extract(t, r"(?s)\[.*\]" if array else r"(?s)\{.*\}", 0), F.lit(""))


def capitalised(c: Column | str) -> Column:
    """First sign in upper case, the rest as it is."""
    t = text_of(c)
    return F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, 2, 1 << 30))


def signals(c: Column | str, limit: int = 20) -> Column:
    """Distinct signal names of a guard: capitalised identifiers, and what a value is assigned to by '='."""
    t = text_of(c)
    named = F.regexp_extract_all(t, F.lit(r"\b([A-Z][A-Za-z0-9_]{4,}(?:Sts|Mode|Req|St)?)\b"), F.lit(1))
    compared = F.filter(F.regexp_extract_all(t, F.lit(r"(?U)(\w+)\s*=\s*(?:0x[\dA-Fa-f]+|\w+)"), F.lit(1)), lambda x: F.length(x) > 1)
    return F.slice(F.array_distinct(F.concat(named, compared)), 1, limit)


def html_rows(c: Column | str) -> Column:
    """array<array<string>>: cell texts of the table rows in HTML, in Catalyst alone."""
    rows = F.regexp_extract_all(text_of(c), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))

    def plain(x: Column) -> Column:
        x = F.regexp_replace(x, "(?s)<[^>]+>", " ")
        for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            x = F.replace(x, F.lit(entity), F.lit(sign))
        return F.trim(F.regexp_replace(x, r"\s+", " "))

    return F.transform(rows, lambda r: F.transform(cells(r), plain))


def resolve_days(c: Column | str, as_of: Column) -> Column:
    """Days between the first ISO-like date in the text and ``as_of``, or null."""
    t = text_of(c)
    p = r"(\d{4})[年/-](\d{1,2})[月/-](\d{1,2})"
    part = lambda g: F.nullif(F.regexp_extract(t, p, g), F.lit("")).cast("int")
    return F.datediff(as_of, F.try_make_date(part(1), part(2), part(3))) if hasattr(F, "try_make_date") else F.datediff(as_of, F.to_date(F.nullif(F.concat_ws("-", part(1).cast("string"), F.lpad(part(2).cast("string"), 2, "0"), F.lpad(part(3).cast("string"), 2, "0")), F.lit("")), "yyyy-MM-dd"))


def expand_query(c: Column | str, triggers: dict[str, str]) -> Column:
    """The query, followed by the expansion of every trigger that occurs in it (in the dictionary's order)."""
    t = text_of(c)
    return F.concat_ws(" ", t, *[F.when(F.contains(F.lower(t), F.lit(k.lower())), F.lit(v)) for k, v in triggers.items()])


def is_toc_only(c: Column | str) -> Column:
    """Blank, or at least three heading lines with under 100 signs of other text."""
    t = text_of(c)
    rest = F.trim(F.regexp_replace(t, r"(?m)^#{2,4}\s.*$", ""))
    return (F.trim(t) == "") | ((F.size(F.regexp_extract_all(t, F.lit(r"(?m)^#{2,4}\s"), F.lit(0))) >= 3) & (F.length(rest) < 100))


def is_stub(c: Column | str, least: int = 30) -> Column:
    """Under ``least`` signs once empty cells and heading lines are gone."""
    rest = F.trim(F.regexp_replace(F.regexp_replace(text_of(c), r"\|\s*\|", ""), r"(?m)^#{1,6}\s.*$", ""))
    return F.length(rest) < least


def agent_tokens(c: Column | str) -> Column:
    """Identifiers as written, then CJK bigrams and signs, then lower-cased words of three letters or more; each once, in that order."""
    t = text_of(c)
    names = F.regexp_extract_all(t, F.lit(r"[A-Z][A-Za-z0-9_]+"), F.lit(0))
    signs = F.regexp_extract_all(t, F.lit(CJK), F.lit(0))
    pairs = F.when(F.size(signs) > 1, F.zip_with(F.slice(signs, 1, F.size(signs) - 1), F.slice(signs, 2, F.size(signs)), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    words = F.regexp_extract_all(F.lower(t), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_distinct(F.concat(names, pairs, signs, words))


def rewrite_query(c: Column | str, strategy: str, written: Column | str = "", modules: Column | None = None, signals_: Column | None = None, states: Column | None = None, functions: Column | None = None) -> Column:
    """A query rewritten with a model's text (hyde, query2doc), or with the names it asks for (keywords); without that text, by keywords."""
    q = text_of(c)
    doc = text_of(written) if isinstance(written, Column) or written else F.lit("")
    none = F.array().cast("array<string>")
    names = F.concat(*[F.slice(F.coalesce(x, none) if x is not None else none, 1, n) for x, n in ((modules, 3), (signals_, 5), (states, 3), (functions, 3))])
    keywords = F.concat_ws(" ", q, F.nullif(F.array_join(names, " "), F.lit("")))
    if strategy == "hyde":
        return F.when(doc != "", F.concat(F.left(doc, F.lit(800)), F.lit("\n\n问题: "), q)).otherwise(keywords)
    if strategy == "query2doc":
        return F.when(doc != "", F.concat(q, F.lit("\n\n"), F.left(doc, F.lit(500)))).otherwise(keywords)
    return keywords


def synonyms(terms: Column, known: dict[str, tuple[str, ...]], limit: int = 20) -> Column:
    """Terms, then the synonyms of each that is known (whatever its case), distinct, the first ``limit``."""
    none = F.array().cast("array<string>")
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k.lower()), F.array(*map(F.lit, v)))])
    more = F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, F.lower(t)), none)))
    return F.slice(F.array_distinct(F.concat(terms, more)), 1, limit)


def grid_html(cells: Column, header_rows: int = 1) -> Column:
    """HTML of a table grid: array<array<struct<text, row_span, col_span>>>; the first rows are th, spans over 1 are told, texts escaped."""

    def escaped(x: Column) -> Column:
        for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            x = F.replace(x, F.lit(sign), F.lit(entity))
        return x

    def cell(x: Column, tag: Column) -> Column:
        span = lambda name, n: F.when(n > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise("")
        return F.concat(F.lit("<"), tag, span("rowspan", x["row_span"]), span("colspan", x["col_span"]), F.lit(">"), escaped(F.coalesce(x["text"], F.lit(""))), F.lit("</"), tag, F.lit(">"))

    row = lambda r, i: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda x: cell(x, F.when(i < header_rows, "th").otherwise("td"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(cells, row), ""), F.lit("</table>"))
